"""Queries of payment values and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacre.functions import checks
from lacre.operators import batches, money, rows
from lacre.plans import oracles
from lacre.plans.register import query
from lacre.plans.rows import recursive
from lacre.sources.tables import table, written

def _field(tag: str, c: Column) -> Column:
    return F.concat(F.lit(tag), F.lpad(F.length(c).cast("string"), 2, "0"), c)


def _codes(spark: SparkSession, base: str) -> DataFrame:
    """Two orders to a document, one a page: a collection code with the order's amount and an instant payment with the same or
    one more; wrong check digits and sums, references instead of money, second codes on a page by key."""
    K = F.col("o_orderkey")  # noqa: N806
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    mark = F.when(K % 7 == 3, "7").otherwise("6")
    rest = F.concat(F.lit("83"), mark, F.lpad(cents.cast("string"), 11, "0"), F.lpad(K.cast("string"), 29, "0"))
    o = table(spark, base, "orders").select("o_orderkey", cents.alias("cents"), rest.alias("rest"), F.concat(F.lit("o"), F.floor(K / 2).cast("string")).alias("doc_id"), (K % 2 + 1).cast("int").alias("page"))
    digit = (checks.modulo_10(F.col("rest")) + F.when(K % 5 == 0, 1).otherwise(0)) % 10
    itf = o.select("doc_id", "page", K.alias("barcode_index"), F.lit("ITF").alias("format"), F.concat(F.substring("rest", 1, 3), digit.cast("string"), F.substring("rest", 4, 40)).alias("content"))
    more = itf.where("barcode_index % 13 = 4").withColumn("content", F.concat(F.lit("81"), F.substring("content", 3, 42)))
    amount = ((F.col("cents") + F.when(K % 3 == 1, 100).otherwise(0)).cast("decimal(18,2)") / 100).cast("decimal(18,2)").cast("string")
    body = F.concat(
        F.lit("000201"), _field("26", F.concat(F.lit("0014br.gov.bcb.pix"), _field("01", F.concat(F.lit("key"), K.cast("string"))))), F.lit("52040000"), F.when(K % 17 == 0, "5303840").otherwise("5303986"),
        F.when(K % 19 != 0, _field("54", amount)).otherwise(""), F.lit("5802BR5905TESTE6009SAO PAULO6304"),
    )
    p = o.where("o_orderkey % 4 != 3").select("doc_id", "page", "o_orderkey", body.alias("body"))
    seal = F.when(K % 11 == 0, "0000").otherwise(checks.crc16(F.col("body")))
    pix = p.select("doc_id", "page", K.alias("barcode_index"), F.lit("QR_CODE").alias("format"), F.concat("body", seal).alias("content"))
    return itf.unionByName(more).unionByName(pix)


CRC = (
    "list_reduce(list_concat([65535], list_transform(string_split({c}, ''), lambda x: ascii(x)::integer)), lambda crc, x: "
    "list_reduce(list_concat([xor(crc, (x << 8)::integer)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: case when (a & 32768) <> 0 then xor((a << 1)::integer, 4129) & 65535 else (a << 1) & 65535 end))"
)
_TLV = "'{tag}' || lpad(length({c})::varchar, 2, '0') || {c}"
CODES = (
    "or1 as (select o_orderkey k, round(o_totalprice * 100)::bigint cents, 'o' || (o_orderkey // 2) doc_id, (o_orderkey % 2 + 1)::int page, '83' || (case when o_orderkey % 7 = 3 then '7' else '6' end) || lpad(round(o_totalprice * 100)::bigint::varchar, 11, '0') || lpad(o_orderkey::varchar, 29, '0') rest from orders), "
    f"or2 as (select *, {oracles.mod10('rest', 43)} dv, (cents + case when k % 3 = 1 then 100 else 0 end) pc from or1), "
    "itf as (select doc_id, page, k, k % 5 <> 0 as good, k % 7 = 3 as ref, cents, substr(rest, 1, 3) || ((dv + case when k % 5 = 0 then 1 else 0 end) % 10) || substr(rest, 4) as content from or2), "
    "bod as (select doc_id, page, k, pc, '000201' || " + _TLV.format(tag="26", c="('0014br.gov.bcb.pix' || " + _TLV.format(tag="01", c="('key' || k)") + ")") + " || '52040000' || case when k % 17 = 0 then '5303840' else '5303986' end || "
    "case when k % 19 <> 0 then " + _TLV.format(tag="54", c="printf('%d.%02d', pc // 100, pc % 100)") + " else '' end || '5802BR5905TESTE6009SAO PAULO6304' as body from or2 where k % 4 <> 3), "
    "pix as (select doc_id, page, k, pc, body, case when k % 17 = 0 then 'CURRENCY_OR_COUNTRY' when k % 11 = 0 then 'CHECK_SUM' when k % 19 = 0 then 'NO_AMOUNT' end reason, body || case when k % 11 = 0 then '0000' else printf('%04X', " + CRC.format(c="body") + ") end as content from bod), "
    f"mor as (select doc_id, page, k, '81' || substr(content, 3) as content, cents from itf where k % 13 = 4), mo2 as (select *, substr(content, 1, 3) || substr(content, 5) as rest from mor), mo3 as (select *, {oracles.mod10('rest', 43)} = substr(content, 4, 1)::int as good from mo2), "
    "cv as (select doc_id, page, k as barcode_index, 'ITF' as source, case when good and not ref then cents end as cents, case when not good then 'CHECK_DIGIT' when ref then 'NO_MONEY' end as reason, content from itf union all "
    "select doc_id, page, k, 'ITF', case when good and substr(content, 3, 1) = '6' then cents end, case when not good then 'CHECK_DIGIT' when substr(content, 3, 1) = '7' then 'NO_MONEY' end, content from mo3 union all "
    "select doc_id, page, k, 'PIX', case when reason is null then pc end, reason, content from pix) "
)


@query("with " + CODES + "select doc_id, page, barcode_index, source, cents / 100 as amount, reason, content from cv")
def code_values(spark: SparkSession, base: str) -> DataFrame:
    """Values of collection codes and instant payments, or why there is none."""
    return money.code_values(_codes(spark, base)).withColumn("amount", F.col("amount").cast("double"))


@query("with p as (select phrase_id, trim(regexp_replace(lower(" + oracles.unaccented("phrase") + "), '[^a-z0-9]+', ' ', 'g')) t from phrases) select phrase_id, printf('%04X', " + CRC.format(c="t") + ") as crc from p")
def check_sums(spark: SparkSession, base: str) -> DataFrame:
    """CRC16 of folded phrases."""
    from lacre.functions.text import label

    return table(spark, base, "phrases").select("phrase_id", checks.crc16(label(F.col("phrase"))).alias("crc"))


# Printed totals


def _boxes(spark: SparkSession, base: str) -> DataFrame:
    """The boxes, and for each order a printed total: in one box, in two beside each other, or label over amount, with a
    second amount near by for some."""
    b = table(spark, base, "boxes").distinct().select("box_id", F.lower("doc_id").alias("doc_id"), "page", "text", "confidence", "box_left", "box_top", "box_width", "box_height")
    K = F.col("o_orderkey")  # noqa: N806
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    shown = F.translate(F.format_number((cents.cast("decimal(18,2)") / 100).cast("decimal(18,2)"), 2), ",.", ".,")
    o = table(spark, base, "orders").select(K.alias("k"), F.concat(F.lit("o"), F.floor(K / 2).cast("string")).alias("doc_id"), (K % 2 + 1).cast("int").alias("page"), shown.alias("a"), (60 + K % 41).cast("double").alias("confidence"))

    def box(where: str, slot: int, text: Column, left: int, top: int, width: int) -> DataFrame:
        size = [F.lit(v).alias(f"box_{n}") for n, v in (("left", left), ("top", top), ("width", width), ("height", 20))]
        return o.where(where).select((F.lit(10_000_000) + F.col("k") * 4 + slot).alias("box_id"), "doc_id", "page", text.alias("text"), "confidence", *size)

    planted = (
        box("k % 3 = 0", 0, F.concat(F.lit("Total a pagar: R$ "), "a"), 100, 300, 260), box("k % 3 = 1", 0, F.lit("VALOR A PAGAR"), 100, 300, 130), box("k % 3 = 1", 1, F.col("a"), 240, 302, 80),
        box("k % 3 = 2", 0, F.lit("Total da fatura"), 100, 300, 130), box("k % 3 = 2", 1, F.col("a"), 110, 330, 80), box("k % 15 = 2", 2, F.lit("1,00"), 200, 331, 40),
    )
    for p in planted:
        b = b.unionByName(p)
    return b


_SHOWN = "translate(format('{:,.2f}', (cents / 100.0)::decimal(18,2)::double), ',.', '.,')"


def _planted(where: str, slot: int, text: str, left: int, top: int, width: int) -> str:
    return f"select 10000000 + k * 4 + {slot} as box_id, doc_id, page, {text} as text, (60 + k % 41)::double as confidence, {left} as box_left, {top} as box_top, {width} as box_width, 20 as box_height from pb where {where}"


BOXES = (
    "pb as (select o_orderkey k, round(o_totalprice * 100)::bigint cents, 'o' || (o_orderkey // 2) doc_id, (o_orderkey % 2 + 1)::int page from orders), "
    "bx as (select distinct box_id, lower(doc_id) doc_id, page, text, confidence, box_left, box_top, box_width, box_height from boxes union all " + " union all ".join(
        (
            _planted("k % 3 = 0", 0, f"'Total a pagar: R$ ' || {_SHOWN}", 100, 300, 260), _planted("k % 3 = 1", 0, "'VALOR A PAGAR'", 100, 300, 130), _planted("k % 3 = 1", 1, _SHOWN, 240, 302, 80),
            _planted("k % 3 = 2", 0, "'Total da fatura'", 100, 300, 130), _planted("k % 3 = 2", 1, _SHOWN, 110, 330, 80), _planted("k % 15 = 2", 2, "'1,00'", 200, 331, 40),
        )
    ) + "), "
)
_LABEL = money.LABEL.replace("(?:", "(", 1)
_SPOTS = (
    f"list_filter(range(1, length(t) + 1), lambda i: regexp_matches(substr(t, i), '(?i)^{_LABEL}([^\\p{{L}}\\p{{N}}_]|$)') and (i = 1 or not regexp_matches(substr(t, i - 1, 1), '[\\p{{L}}\\p{{N}}_]')))"
)
_AMOUNT = "((?:[0-9]{1,3}(?:[.][0-9]{3})+|[0-9]+),[0-9]{2})"
_AFTER = f"'(?i)^{_LABEL}[\\s:;|=>–—-]{{0,24}}(?:R[$]\\s*)?{_AMOUNT}(?:[^0-9]|$)'"
TOTALS = (
    recursive("centre", "select doc_id, page, box_id, box_left, box_top, box_width, box_height from bx", "rc")
    + ", tj as (select bx.* replace (trim(text) as text), line from bx join rc using (doc_id, page, box_id)), tg as (select *, case when box_left - lag(box_left + box_width) over w > 100 then 1 else 0 end nw from tj window w as (partition by doc_id, page, line order by box_left, box_id)), "
    "ts as (select *, sum(nw) over (partition by doc_id, page, line order by box_left, box_id rows unbounded preceding) sg from tg), tb as (select *, coalesce(sum(length(text) + 1) over (partition by doc_id, page, line, sg order by box_left, box_id rows between unbounded preceding and 1 preceding), 0)::bigint off from ts where text <> '' and box_width > 0 and box_height > 0), "
    "tt as (select doc_id, page, line, sg, string_agg(text, ' ' order by box_left, box_id) t, min(confidence) c, count(*) filter (confidence is null) nn, min(box_id) box_id from tb group by 1, 2, 3, 4), "
    f"tp as (select *, case when contains(t, ',') then length(list_filter(range(1, length(t) + 1), lambda i: (i = 1 or not regexp_matches(substr(t, i - 1, 1), '[0-9]')) and regexp_matches(substr(t, i), '^{_AMOUNT}([^0-9]|$)') and (i < 3 or not regexp_matches(substr(t, i - 2, 2), '[0-9][.]')))) else 0 end prices, "
    f"case when regexp_matches(t, '(?i){_LABEL}') then {_SPOTS} else [] end spots from tt), "
    f"th as (select *, list_filter(list_transform(spots, lambda i: regexp_extract(substr(t, i), {_AFTER}, 2)), lambda v: v <> '') hits from tp where prices <= 1), "
    "ln as (select doc_id, page, hits[1] raw, case when nn = 0 then c end confidence, 'LINE' how, box_id from th where length(hits) = 1), "
    f"lo as (select doc_id, page, line, sg, unnest(list_transform(spots, lambda i: struct_pack(a := i - 1, z := i - 1 + length(regexp_extract(substr(t, i), '(?i)^{_LABEL}', 0))))) s from th where length(hits) <> 1 and length(spots) > 0), "
    "la as (select lo.doc_id, lo.page, lo.line, lo.sg, s.a as la, min(box_left) lx, min(box_top) ly, max(box_left + box_width) lr, max(box_top + box_height) lb, min(confidence) lc, count(*) filter (confidence is null) lnn from lo join tb using (doc_id, page, line, sg) where off < s.z and off + length(text) > s.a group by all), "
    f"ca as (select tb.doc_id, tb.page, tb.box_id, regexp_extract(text, '(?i)^\\s*(?:R[$]\\s*)?{_AMOUNT}\\s*$', 1) raw, box_left cx, box_top cy, box_left + box_width cr, box_top + box_height cb, confidence from tb join (select doc_id, page, line, sg from th where length(hits) <> 1) using (doc_id, page, line, sg) where regexp_matches(text, '(?i)^\\s*(?:R[$]\\s*)?{_AMOUNT}\\s*$')), "
    "me as (select la.*, ca.box_id, raw, ca.confidence cc from la join ca using (doc_id, page) where (abs((ly + lb) / 2.0 - (cy + cb) / 2.0) <= greatest(9.0, least(lb - ly, cb - cy) * 0.9) and cx >= lr and cx - lr <= 260) or (cy - lb >= 0 and cy - lb <= greatest(36.0, 2.5 * (lb - ly)) and least(lr, cr) - greatest(lx, cx) >= greatest(5.0, least(lr - lx, cr - cx) * 0.2))), "
    "pa as (select doc_id, page, min(raw) raw, case when max(lnn + (cc is null)::int) = 0 then min(least(lc, cc)) end confidence, 'PAIR' how, min(box_id) box_id from me group by doc_id, page, line, sg, la having count(*) = 1), "
    "tot as (select doc_id, page, replace(replace(raw, '.', ''), ',', '.')::decimal(18,2) as amount, confidence, how, box_id from (select * from ln union all select * from pa)) "
)


def _totals(spark: SparkSession, base: str) -> DataFrame:
    b = _boxes(spark, base)
    return money.located_totals(rows.segmented(b, rows.grouped(b, "centre"), 100))


@query("with recursive " + BOXES + TOTALS + "select doc_id, page, amount::double as amount, confidence, how, box_id from tot")
def located_totals(spark: SparkSession, base: str) -> DataFrame:
    """Printed totals with their place."""
    return _totals(spark, base).withColumn("amount", F.col("amount").cast("double"))


_MORE = " / Total devido R$ 1.234,56 e TOTAL A PAGAR: 7,00; subtotal a pagar 9,00, Total a pagar 12,345"
_TEXTS = f"tx as (select lower(doc_id) || ':native_text' k, native_text || case when pos % 3 = 0 then '{_MORE}' else '' end t from f where native_text is not null union all select lower(doc_id) || ':ocr', ocr_text from f where ocr_text is not null)"


@query(
    "with " + oracles.FIRST + f", {_TEXTS}, sp as (select k, t, unnest({_SPOTS}) i from tx where regexp_matches(t, '(?i){_LABEL}')), h as (select k, i, regexp_extract(substr(t, i), '(?i)^{_LABEL}\\s*[:|>–—-]*\\s*(?:R[$]\\s*)?{_AMOUNT}(?:[^0-9]|$)', 2) raw from sp) "
    "select k, row_number() over (partition by k order by i) - 1 as place, replace(replace(raw, '.', ''), ',', '.')::double as amount from h where raw <> ''"
)
def text_totals(spark: SparkSession, base: str) -> DataFrame:
    """Totals after a label in native and OCR texts; every third native text gets some."""
    a = batches.first_analyses(table(spark, base, "analyses"))
    a = a.withColumn("native_text", F.concat("native_text", F.when(F.col("pos") % 3 == 0, _MORE).otherwise("")))
    one = lambda c, s: a.select(F.concat(F.lower("doc_id"), F.lit(f":{s}")).alias("k"), F.col(c).alias("t"))
    return money.text_totals(one("native_text", "native_text").unionByName(one("ocr_text", "ocr")), "k", "t").withColumn("amount", F.col("amount").cast("double"))


# Reconciliation

VALUES = (
    "with recursive " + BOXES + TOTALS + ", " + CODES + ", va as (select doc_id, page, source, (cents / 100.0)::decimal(18,2) as amount, content, null::double as confidence from cv where cents is not null union all select doc_id, page, 'PRINTED', amount, box_id::varchar, confidence from tot), "
    "sv as (select doc_id, page, source, count(distinct content) n, min(amount) lo, max(amount) hi from va where source <> 'PRINTED' or confidence >= 70 group by 1, 2, 3), "
    "cm as (select doc_id, page, string_agg(source, ',' order by source) sources, min(lo) as least, max(hi) as most from sv group by 1, 2 having count(*) > 1 and not bool_or((source <> 'PRINTED' and n > 1) or lo <> hi)), "
    "pe as (select doc_id, page, case when max(n) > 1 then 'AMBIGUOUS' when min(lo) = max(lo) then 'CONSISTENT' else 'REVIEWED' end as evidence from (select doc_id, page, source, count(distinct content) n, min(amount) lo from va where source <> 'PRINTED' group by 1, 2, 3) group by 1, 2 having count(*) = 2) "
)


def _values(spark: SparkSession, base: str) -> DataFrame:
    v = money.code_values(_codes(spark, base)).select("doc_id", "page", "source", "amount", "content", F.lit(None).cast("double").alias("confidence"))
    return v.unionByName(_totals(spark, base).select("doc_id", "page", F.lit("PRINTED").alias("source"), "amount", F.col("box_id").cast("string").alias("content"), "confidence"))


@query(VALUES + "select doc_id, page, sources, least::double as least, most::double as most, case when least = most then 'EQUAL_VALUES' else 'DIFFERENT_VALUES' end as relation from cm")
def page_comparisons(spark: SparkSession, base: str) -> DataFrame:
    return money.page_comparisons(_values(spark, base)).withColumns({c: F.col(c).cast("double") for c in ("least", "most")})


@query(VALUES + "select doc_id, page, evidence from pe")
def page_evidence(spark: SparkSession, base: str) -> DataFrame:
    return money.page_evidence(_values(spark, base))


_RESULT = (
    VALUES + ", n as (select doc_id, count(*) as values from va where amount is not null group by 1), e as (select doc_id, bool_or(evidence = 'REVIEWED') r, bool_or(evidence = 'AMBIGUOUS') a, bool_or(evidence = 'CONSISTENT') c from pe group by 1), "
    "d as (select doc_id, count(*) comparisons, sum((least <> most)::int)::bigint different, bool_or(least <> most and sources = 'ITF,PIX,PRINTED') three from cm group by 1), "
    "rs as (select doc_id, case when coalesce(three, false) or coalesce(r, false) then 'REVIEW_REQUIRED' when coalesce(a, false) then 'INCONCLUSIVE' when coalesce(c, false) then 'CONSISTENT' else 'INCONCLUSIVE' end as status, values, coalesce(comparisons, 0) as comparisons, coalesce(different, 0) as different from n left join e using (doc_id) left join d using (doc_id)) "
)


@query(_RESULT + "select * from rs")
def reconciliation(spark: SparkSession, base: str) -> DataFrame:
    """The reconciliation of each document."""
    return money.reconciled(written(_values(spark, base), "payment-values"))


@query(_RESULT + "select doc_id, 'status' as record_type, status as content, null::double as amount from rs union all select va.doc_id, 'value', source || ':' || page, amount::double from va")
def sheet_reconciliation(spark: SparkSession, base: str) -> DataFrame:
    """A report's rows of reconciliation: the status of each document, then its values."""
    v = written(_values(spark, base), "payment-values")
    s = money.reconciled(v).select("doc_id", F.lit("status").alias("record_type"), F.col("status").alias("content"), F.lit(None).cast("double").alias("amount"))
    return s.unionByName(v.where("amount is not null").select("doc_id", F.lit("value").alias("record_type"), F.concat_ws(":", "source", "page").alias("content"), F.col("amount").cast("double").alias("amount")))
