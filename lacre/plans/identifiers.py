"""Queries of labelled identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacre.operators import batches, identifiers, rows
from lacre.operators.identifiers import HEADERS, HOLDER, PATTERNS
from lacre.plans.oracles import FIRST
from lacre.plans.register import query
from lacre.plans.rows import recursive
from lacre.sources.tables import table, written


def boxes_of(spark: SparkSession, base: str) -> DataFrame:
    """The boxes, and for each customer a page of its own: an account beside its label, an invoice number under its label, a
    holder, and for some a second number near the first or a different reading of the same cell."""
    b = table(spark, base, "boxes").distinct().select("box_id", F.lower("doc_id").alias("doc_id"), "page", "text", "confidence", "box_left", "box_top", "box_width", "box_height")
    k = F.col("c_custkey")
    c = table(spark, base, "customer").select(k.alias("k"), F.concat(F.lit("k"), k.cast("string")).alias("doc_id"), (60 + k % 41).cast("double").alias("confidence"))
    num = lambda prefix, n, width: F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))
    k = F.col("k")

    def box(where: str, slot: int, text: Column, left: int, top: int, width: int) -> DataFrame:
        size = [F.lit(v).alias(f"box_{n}") for n, v in (("left", left), ("top", top), ("width", width), ("height", 20))]
        return c.where(where).select((F.lit(20_000_000) + k * 10 + slot).alias("box_id"), "doc_id", F.lit(1).alias("page"), text.alias("text"), "confidence", *size)

    planted = (
        box("true", 0, F.concat(F.lit("Nº da conta: "), num("77", F.floor(k / 3), 6)), 100, 100, 200),
        box("k % 2 = 0", 1, F.lit("Titular: João da Silva"), 420, 100, 200),
        box("true", 2, F.lit("Número da"), 100, 200, 70), box("true", 3, F.lit("fatura"), 175, 201, 50), box("true", 4, num("88", k * 11 % 1_000_000, 6), 110, 230, 90),
        box("k % 5 = 0", 5, num("99", k, 6), 190, 231, 60), box("k % 7 = 0", 6, num("66", k, 6), 178, 231, 22), box("k % 4 = 1", 7, F.lit("CÓDIGO DO CLIENTE"), 500, 200, 140), box("k % 6 = 5", 9, F.lit("Débito automático"), 300, 200, 150),
        box("k % 4 = 1", 8, F.concat(F.floor(k / 10).cast("string"), F.lit(".55"), F.lit(" 55-"), (k % 10).cast("string")), 510, 240, 120),
    )
    for p in planted:
        b = b.unionByName(p)
    return b


def _planted(where: str, slot: int, text: str, left: int, top: int, width: int) -> str:
    return f"select 20000000 + c_custkey * 10 + {slot}, 'k' || c_custkey, 1, {text}, (60 + c_custkey % 41)::double, {left}, {top}, {width}, 20 from customer where {where}".replace("k %", "c_custkey %").replace("c_custc_custkey", "c_custkey")


BOXES = (
    "ib as (select distinct box_id, lower(doc_id) doc_id, page, text, confidence, box_left, box_top, box_width, box_height from boxes union all " + " union all ".join(
        (
            _planted("true", 0, "'Nº da conta: 77' || lpad((c_custkey // 3)::varchar, 6, '0')", 100, 100, 200), _planted("c_custkey % 2 = 0", 1, "'Titular: João da Silva'", 420, 100, 200), _planted("true", 2, "'Número da'", 100, 200, 70),
            _planted("true", 3, "'fatura'", 175, 201, 50), _planted("true", 4, "'88' || lpad((c_custkey * 11 % 1000000)::varchar, 6, '0')", 110, 230, 90), _planted("c_custkey % 5 = 0", 5, "'99' || lpad(c_custkey::varchar, 6, '0')", 190, 231, 60),
            _planted("c_custkey % 7 = 0", 6, "'66' || lpad(c_custkey::varchar, 6, '0')", 178, 231, 22), _planted("c_custkey % 4 = 1", 7, "'CÓDIGO DO CLIENTE'", 500, 200, 140), _planted("c_custkey % 6 = 5", 9, "'Débito automático'", 300, 200, 150),
            _planted("c_custkey % 4 = 1", 8, "(c_custkey // 10) || '.55 55-' || (c_custkey % 10)", 510, 240, 120),
        )
    ) + "), "
)
_E = "(?:^|[^\\p{L}\\p{N}_])"
_V = "\\s*[:#.-]?\\s*([0-9][0-9.\\-/ ]{4,29}[0-9])(?:[^0-9]|$)"


def _scan(t: str) -> str:
    """A list of structs (k, v) of the identifiers in a text."""
    parts = [f"list_transform(regexp_extract_all({t}, '(?i){_E}{p}{_V}', 1), lambda r: struct_pack(k := '{k}', v := regexp_replace(r, '[^0-9]', '', 'g')))" for k, p in PATTERNS.items()]
    names = f"list_filter(list_transform(regexp_extract_all({t}, '(?i){_E}{HOLDER}\\s*[:-]\\s*([A-ZÀ-Ü][A-Za-zÀ-ÿ'' -]{{5,75}})', 1), lambda r: upper(trim(regexp_replace(trim(r, ' .-/'), '\\s+', ' ', 'g')))), lambda v: contains(v, ' '))"
    holder = f"list_transform({names}, lambda v: struct_pack(k := 'holder', v := trim(regexp_replace(v, '(\\s{{2,}}|\\s+(CONTA|CLIENTE|FATURA|D[EÉ]BITO)\\s*[:#]).*$', ''))))"
    return f"list_filter(list_concat(list_concat({parts[0]}, {parts[1]}), list_concat(list_concat({parts[2]}, {parts[3]}), {holder})), lambda x: x.k = 'holder' or length(x.v) between 6 and 24)"


def _placed(boxes: str, n: str) -> str:
    """CTEs up to {n}s: boxes with row (line) and segment (sg)."""
    return (
        recursive("anchor", f"select doc_id, page, box_id, box_left, box_top, box_width, box_height from {boxes}", f"{n}r")
        + f", {n}j as (select {boxes}.*, line from {boxes} join {n}r using (doc_id, page, box_id)), {n}g as (select *, case when box_left - lag(box_left + box_width) over w > 140 then 1 else 0 end nw from {n}j window w as (partition by doc_id, page, line order by box_left, box_id)), "
        f"{n}s as (select * exclude (nw), sum(nw) over (partition by doc_id, page, line order by box_left, box_id rows unbounded preceding)::bigint sg from {n}g) "
    )


def _beside(n: str) -> str:
    return (
        f"{n}t as (select doc_id, page, line, sg, string_agg(coalesce(text, ''), ' ' order by box_left, box_id) t, min(confidence) confidence, min(box_left) as left, min(box_top) as top, max(box_left + box_width) as right, max(box_top + box_height) as bottom from {n}s group by 1, 2, 3, 4), "
        f"{n}b as (select doc_id, page, x.k as kind, x.v as value, confidence, \"left\", top, \"right\", bottom, false as has_region from (select *, unnest({_scan('t')}) x from {n}t)) "
    )


_CELL, _NAME = "[0-9][0-9.\\-/ ]{4,34}[0-9]", "[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'' -]{5,75}"


def _below(n: str) -> str:
    token = "trim(text, ' .-/')"
    labels = " union all ".join(
        f"select doc_id, page, line, '{k}' kind, unnest(list_transform(list_filter(range(1, length(t) + 1), lambda i: (i = 1 or not regexp_matches(substr(t, i - 1, 1), '[\\p{{L}}\\p{{N}}_]')) and regexp_matches(substr(t, i), '(?i)^{p}([^\\p{{L}}\\p{{N}}_]|$)')), "
        f"lambda i: struct_pack(a := i - 1, z := i - 1 + length(regexp_extract(substr(t, i), '(?i)^({p})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1))))) s from {n}x where regexp_matches(t, '(?i){p}')"
        for k, p in HEADERS.items()
    )
    return (
        f"{n}k as (select * replace (coalesce(text, '') as text), regexp_full_match(trim(coalesce(text, ''), ' .-/'), '{_CELL}') and length(regexp_replace({token}, '[^0-9]', '', 'g')) between 6 and 24 as fu from {n}s), "
        f"{n}m as (select *, case when fu or coalesce(lag(fu) over w, false) or box_left - lag(box_left + box_width) over w > 35 then 1 else 0 end nw, coalesce(sum(length(text) + 1) over (partition by doc_id, page, line order by box_left, box_id rows between unbounded preceding and 1 preceding), 0)::bigint off from {n}k window w as (partition by doc_id, page, line order by box_left, box_id)), "
        f"{n}n as (select *, sum(nw) over (partition by doc_id, page, line order by box_left, box_id rows unbounded preceding) cell from {n}m), "
        f"{n}c as (select doc_id, page, line, cell, trim(trim(string_agg(text, ' ' order by box_left, box_id)), ' .-/') r, min(confidence) c, bool_or(confidence is null) nn, min(box_left) as left, min(box_top) as top, max(box_left + box_width) as right, max(box_top + box_height) as bottom from {n}n group by 1, 2, 3, 4), "
        f"{n}d as (select *, case when regexp_full_match(r, '{_CELL}') and length(regexp_replace(r, '[^0-9]', '', 'g')) between 6 and 24 then regexp_replace(r, '[^0-9]', '', 'g') end num, case when regexp_full_match(r, '{_NAME}') and regexp_matches(r, '\\S\\s+\\S') then upper(regexp_replace(r, '\\s+', ' ', 'g')) end nam from {n}c), "
        f"{n}x as (select doc_id, page, line, string_agg(text, ' ' order by box_left, box_id) t from {n}n group by 1, 2, 3), {n}y as ({labels}), {n}z as (select *, list(s) over (partition by doc_id, page, line, kind) every from {n}y), {n}l as (select doc_id, page, line, kind, s from {n}z where length(list_filter(every, lambda o: o.a < s.a and o.z > s.a)) = 0), "
        f"{n}h as (select l.doc_id, l.page, l.line lr, kind, s.a as la, min(confidence) lc, bool_or(confidence is null) lnn, min(box_left) lx, min(box_top) ly, max(box_left + box_width) lz, max(box_top + box_height) lb from {n}l l join {n}n b on b.doc_id = l.doc_id and b.page = l.page and b.line = l.line and b.off < s.z and b.off + length(b.text) > s.a group by all), "
        f"{n}o as (select h.*, d.line, d.cell, d.c, d.nn, d.left, d.top, d.right, d.bottom, case when kind = 'holder' then nam else num end as value, abs((lx + lz) / 2.0 - (d.left + d.right) / 2.0) + 2 * (d.top - lb) as score from {n}h h join {n}d d on d.doc_id = h.doc_id and d.page = h.page and d.line > h.lr "
        "where case when kind = 'holder' then nam is not null else num is not null end and d.top - lb between 0 and 54 and least(lz, d.right) - greatest(lx, d.left) >= greatest(5.0, least(lz - lx, d.right - d.left) * 0.2)), "
        f"{n}q as (select *, row_number() over wl i, row_number() over wc j, lead(score) over wl si, lead(score) over wc sj from {n}o window wl as (partition by doc_id, page, lr, kind, la order by score, line, cell), wc as (partition by doc_id, page, line, cell order by score, lr, kind, la)), "
        f"{n}e as (select doc_id, page, kind, value, case when not lnn and not nn then least(lc, c) end as confidence, \"left\", top, \"right\", bottom, true as has_region from {n}q where i = 1 and j = 1 and coalesce(si - score >= 18, true) and coalesce(sj - score >= 18, true)) "
    )


LOCATED = "with recursive " + BOXES + _placed("ib", "v") + ", " + _beside("v") + ", " + _below("v")
_COLUMNS = "doc_id, page, kind, value, confidence, \"left\"::double as left, top::double as top, \"right\"::double as right, bottom::double as bottom, has_region"


def _observed(spark: SparkSession, base: str) -> DataFrame:
    return identifiers.from_boxes(boxes_of(spark, base))


@query(LOCATED + f"select {_COLUMNS} from vb union all select {_COLUMNS} from ve")
def located_identifiers(spark: SparkSession, base: str) -> DataFrame:
    """Identifiers beside and below their labels."""
    o = _observed(spark, base).drop("source")
    return o.withColumns({e: F.col(e).cast("double") for e in ("left", "top", "right", "bottom")})


@query(
    "with recursive sb as (select span_id as box_id, doc_id, page, text, 100.0::double as confidence, box_left * 2 as box_left, box_top * 2 as box_top, (box_right - box_left) * 2 as box_width, (box_bottom - box_top) * 2 as box_height from "
    "(select distinct span_id, lower(doc_id) doc_id, page, case when span_id % 3 = 0 then 'Conta nº 55' || lpad(span_id::varchar, 6, '0') else text end as text, box_left, box_top, box_right, box_bottom from spans)), "
    + _placed("sb", "n") + ", " + _beside("n") + ", " + _below("n") + "select doc_id, page, kind, value, round(\"left\" / 2, 4) as left, round(top / 2, 4) as top, has_region from (select * from nb union all select * from ne)"
)
def native_identifiers(spark: SparkSession, base: str) -> DataFrame:
    """The same over spans; every third span is made an account number."""
    s = table(spark, base, "spans").select("span_id", F.lower("doc_id").alias("doc_id"), "page", "text", "box_left", "box_top", "box_right", "box_bottom").distinct()
    s = s.withColumn("text", F.when(F.col("span_id") % 3 == 0, F.concat(F.lit("Conta nº 55"), F.lpad(F.col("span_id").cast("string"), 6, "0"))).otherwise(F.col("text")))
    return identifiers.from_spans(s).select("doc_id", "page", "kind", "value", F.round("left", 4).alias("left"), F.round("top", 4).alias("top"), "has_region")


_MORE = "\nConta 12345678 e Fatura nº 99.888.777\nCLIENTE: MARIA DE SOUZA\n"
_AGGREGATED = (
    f"tx as (select lower(doc_id) doc_id, 'NATIVE_AGGREGATED' source, native_text || case when pos % 3 = 0 then '{_MORE}' else '' end t from f where native_text is not null union all select lower(doc_id), 'OCR_AGGREGATED', ocr_text from f where ocr_text is not null union all "
    "select 'k' || c_custkey, 'OCR_AGGREGATED', 'Conta: 77' || lpad((c_custkey // 3)::varchar, 6, '0') || case when c_custkey % 3 = 0 then ' / Débito automático 123456-' || c_custkey % 10 else '' end from customer), "
    f"tl as (select doc_id, source, unnest(regexp_split_to_array(t, '\\r\\n|\\r|\\n')) t from tx), ta as (select doc_id, source, x.k as kind, x.v as value from (select doc_id, source, unnest({_scan('t')}) x from tl)) "
)


def _texts(spark: SparkSession, base: str) -> DataFrame:
    a = batches.first_analyses(table(spark, base, "analyses")).select(F.lower("doc_id").alias("doc_id"), F.concat("native_text", F.when(F.col("pos") % 3 == 0, _MORE).otherwise("")).alias("native"), "ocr_text")
    k = F.col("c_custkey")
    debit = F.when(k % 3 == 0, F.concat(F.lit(" / Débito automático 123456-"), (k % 10).cast("string"))).otherwise("")
    c = table(spark, base, "customer").select(F.concat(F.lit("k"), k.cast("string")).alias("doc_id"), F.concat(F.lit("Conta: 77"), F.lpad(F.floor(k / 3).cast("string"), 6, "0"), debit).alias("text"))
    ocr = a.select("doc_id", F.col("ocr_text").alias("text")).unionByName(c)
    return identifiers.from_texts(a.select("doc_id", F.col("native").alias("text")), "NATIVE_AGGREGATED").unionByName(identifiers.from_texts(ocr, "OCR_AGGREGATED"))


@query("with " + FIRST + ", " + _AGGREGATED + "select doc_id, source, kind, value from ta")
def text_identifiers(spark: SparkSession, base: str) -> DataFrame:
    """Identifiers in whole texts, line by line; some texts get more lines."""
    return _texts(spark, base).select("doc_id", "source", "kind", "value")


_OBS = (
    LOCATED + ", " + FIRST + ", " + _AGGREGATED + ", al as (select doc_id, page, kind, value, 'OCR_BOX' source, coalesce(confidence, 0.0) q, has_region, top, \"left\" le from vb union all select doc_id, page, kind, value, 'OCR_BOX', coalesce(confidence, 0.0), has_region, top, \"left\" from ve union all "
    "select doc_id, null, kind, value, source, case source when 'NATIVE_AGGREGATED' then 65.0 else 0.0 end, false, null, null from ta), "
    "de as (select * from al where page is not null or (doc_id, kind, value) not in (select (doc_id, kind, value) from al where page is not null) qualify row_number() over (partition by doc_id, kind, value, page order by q desc, has_region desc, source, top nulls first, le nulls first) = 1), "
    "pn as (select doc_id, kind, min(value) as value, max(q) q from de where kind <> 'holder' group by 1, 2 having count(distinct value) = 1), ho as (select doc_id, min(value) h from de where kind = 'holder' group by 1 having count(distinct value) = 1), pt as (select kind, value, doc_id, q, h from pn left join ho using (doc_id)) "
)


def _all(spark: SparkSession, base: str) -> DataFrame:
    return written(identifiers.deduplicated(_observed(spark, base).unionByName(_texts(spark, base))), "identifiers")


@query(_OBS + "select doc_id, page, kind, value, source, q::double as quality, has_region from de")
def identifier_observations(spark: SparkSession, base: str) -> DataFrame:
    """One observation for each document, kind, value and page, from all arms."""
    return _all(spark, base).select("doc_id", "page", "kind", "value", "source", "quality", "has_region")


@query(_OBS + "select kind, value, doc_id, q::double as quality, h as holder from pt")
def identifier_participants(spark: SparkSession, base: str) -> DataFrame:
    return identifiers.participants(_all(spark, base))


@query(
    _OBS + ", gv as (select kind, value, count(*) documents, min(q) q, count(distinct h) holders from pt group by 1, 2), va as (select * from gv where regexp_full_match(value, '[0-9]{6,24}')), "
    "mk as (select kind, value, documents, q, unnest(list_transform(range(1, length(value) + 1), lambda i: substr(value, 1, i - 1) || '*' || substr(value, i + 1))) mask from va), mg as (select kind, mask, min(value) a, max(value) b, sum(documents)::bigint d from mk group by 1, 2 having count(*) = 2 and min(q) >= 80), "
    "sw as (select kind, value, documents, q, unnest(list_distinct(list_transform(list_filter(range(1, length(value)), lambda i: substr(value, i, 1) <> substr(value, i + 1, 1)), lambda i: substr(value, 1, i - 1) || substr(value, i + 1, 1) || substr(value, i, 1) || substr(value, i + 2)))) o from va) "
    "select kind, 'EXACT' as relation, value, null::varchar as other_value, documents, holders from gv where documents > 1 union all select distinct kind, 'ONE_DIGIT', a, b, d, null::bigint from mg union all "
    "select sw.kind, 'TRANSPOSITION', sw.value, sw.o, sw.documents + va.documents, null from sw join va on va.kind = sw.kind and va.value = sw.o where sw.value < sw.o and sw.q >= 80 and va.q >= 80"
)
def identifier_comparisons(spark: SparkSession, base: str) -> DataFrame:
    """Equal and nearly equal identifiers of different documents."""
    return identifiers.compared(identifiers.participants(_all(spark, base)))


@query(
    LOCATED + ", rg as (select * from ve), cb as (select doc_id, page, regexp_replace(text, '[^0-9]', '', 'g') other, box_left, box_top, box_width, box_height from ib where length(regexp_replace(text, '[^0-9]', '', 'g')) between 6 and 24 and not regexp_matches(text, '[A-Za-z]')) "
    "select distinct doc_id, page, kind, value, other from rg join cb using (doc_id, page) where other <> value and greatest(least(box_left + box_width, \"right\") - greatest(box_left, \"left\"), 0) * greatest(least(box_top + box_height, bottom) - greatest(box_top, top), 0) / least(box_width * box_height, (\"right\" - \"left\") * (bottom - top)) >= 0.5"
)
def identifier_conflicts(spark: SparkSession, base: str) -> DataFrame:
    """Values that another box reads otherwise in the same cell."""
    return identifiers.region_conflicts(_observed(spark, base), boxes_of(spark, base))


@query(
    LOCATED + ", hx as (select doc_id, page, line, string_agg(coalesce(text, ''), ' ' order by box_left, box_id) t, median(box_height) h, min(box_left) as left, min(box_top) as top, max(box_left + box_width) as right, max(box_top + box_height) as bottom from vs group by 1, 2, 3), "
    "hk as (select *, list_filter([" + ", ".join(f"case when regexp_matches(t, '(?i){_E}{p}([^\\p{{L}}\\p{{N}}_]|$)') then '{k}' end" for k, p in HEADERS.items() if k != "holder") + "], lambda x: x is not null) kinds from hx), "
    "kn as (select doc_id, page, list(distinct kind) known from (select * from vb union all select * from ve) group by 1, 2), hm as (select *, list_sort(list_filter(kinds, lambda x: not list_contains(coalesce(known, []), x))) miss from hk left join kn using (doc_id, page) where length(kinds) >= 2 and h > 0), "
    "hn as (select *, row_number() over (partition by doc_id order by page, top, line) number from hm where length(miss) > 0) select doc_id, page, number, array_to_string(miss, ',') as missing, greatest(0.0, \"left\" - 2 * h) as left, greatest(0.0, top - h) as top, \"right\" + 2 * h as right, bottom + 3 * h as bottom from hn where number <= 4"
)
def proposed_regions(spark: SparkSession, base: str) -> DataFrame:
    """Where to read again: rows of headings whose values weren't found."""
    b = boxes_of(spark, base)
    placed = rows.segmented(b, rows.grouped(b, "anchor"), identifiers.COLUMN_GAP)
    return identifiers.proposed_regions(placed, _observed(spark, base)).withColumns({e: F.col(e).cast("double") for e in ("left", "top", "right", "bottom")})
