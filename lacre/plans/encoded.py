"""Queries of encoded texts and graphics of font characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacre.operators import detectors, encoded
from lacre.plans import oracles
from lacre.plans.register import query
from lacre.sources.tables import table


def _bits(c: Column) -> Column:
    return F.array_join(F.transform(F.split(F.hex(c.cast("binary")), ""), lambda x: F.lpad(F.conv(x, 16, 2), 4, "0")), "")


def _base64(c: Column) -> Column:
    return F.regexp_replace(F.base64(c.cast("binary")), r"\s", "")  # without line ends


def _observations(spark: SparkSession, base: str) -> DataFrame:
    """Phrases written as hexadecimal digits, base64, bits, base64 of hexadecimal digits, plainly in a matrix font, as bits of
    no text, and plainly."""
    k, p = F.col("phrase_id"), F.col("phrase")
    hexa = F.lower(F.hex(p.cast("binary")))
    text = (
        F.when(k % 7 == 0, hexa).when(k % 7 == 1, F.concat(F.lit("base64:"), _base64(p))).when(k % 7 == 2, _bits(p)).when(k % 7 == 3, F.concat(F.lit("base64:"), _base64(F.concat(F.lit("hex:"), hexa))))
        .when(k % 7 == 5, F.repeat(F.lit("01"), 24)).otherwise(p)
    )
    return table(spark, base, "phrases").select("phrase_id", text.alias("text"), F.when(k % 7 == 4, "VivoQRCode").otherwise("Arial").alias("font_name"), "phrase")


_PLANTED = "p as (select phrase_id k, phrase, lower(hex(encode(phrase))) h from phrases) "
_FOUND = (
    "with " + _PLANTED + ", f as (select k as phrase_id, case k % 7 when 4 then 'QR_FONT_CANDIDATE' when 5 then 'ENCODED_BINARY_UNRESOLVED' else 'ENCODED_TEXT_DECODED' end as code, k % 7 = 4 as font_hint, "
    "case k % 7 when 0 then 'hex' when 1 then 'base64' when 2 then 'binary_8bit' when 3 then 'base64,base64>hex' else '' end as chains, case when k % 7 = 3 then 'hex:' || h || '|' || phrase when k % 7 in (4, 5) then '' else phrase end as texts from p where k % 7 <> 6) "
)


@query(_FOUND + "select * from f")
def encoded_texts(spark: SparkSession, base: str) -> DataFrame:
    """Phrases in several notations, found and decoded."""
    i = encoded.inspected(_observations(spark, base), "phrase_id", "text", "font_name")
    many = lambda f, by: F.array_join(F.transform("decoded", lambda v: v[f]), by)
    return i.select("phrase_id", "code", "font_hint", many("chain", ",").alias("chains"), many("text", "|").alias("texts"))


def _codes(spark: SparkSession, base: str) -> DataFrame:
    o = _observations(spark, base)
    k = F.col("phrase_id")
    content = F.when(k % 50 == 6, F.repeat(F.lit("x"), 9000)).otherwise(F.col("text"))
    return o.select(F.lit("d").alias("doc_id"), k.alias("barcode_index"), F.lit(1).alias("page"), F.lit("QR-Code").alias("format"), content.alias("content"))


_TEXTS = (
    "with " + _PLANTED + ", t as (select k, case when k % 50 = 6 then 9 else k % 7 end m, phrase, h from p), s as (select k, '' as chain, case m when 9 then null when 0 then h when 1 then 'base64:' || to_base64(encode(phrase)) when 2 then array_to_string(list_transform(string_split(upper(h), ''), lambda x: lpad(bin(('0x' || x)::integer), 4, '0')), '') "
    "when 3 then 'base64:' || to_base64(encode('hex:' || h)) when 5 then repeat('01', 24) else phrase end as text, case when m = 9 then 'SKIPPED_OVERSIZE' else 'REQUIRES_SEMANTIC_ANALYSIS' end as status from t union all "
    "select k, case m when 0 then 'hex' when 1 then 'base64' when 2 then 'binary_8bit' else 'base64>hex' end, phrase, 'REQUIRES_SEMANTIC_ANALYSIS' from t where m in (0, 1, 2, 3) union all select k, 'base64', 'hex:' || h, 'REQUIRES_SEMANTIC_ANALYSIS' from t where m = 3) "
)


@query(_TEXTS + "select k as barcode_index, chain, md5(text) as digest, status from s")
def code_texts(spark: SparkSession, base: str) -> DataFrame:
    """What matrix codes hold, and what it decodes to."""
    return encoded.code_texts(_codes(spark, base)).select("barcode_index", "chain", F.md5("text").alias("digest"), "status")


@query(
    _TEXTS + f", fo as (select k, chain, {oracles.folded('text')} t from s where text is not null), pp as (select phrase_id, lower(category) category, {oracles.folded('phrase')} p from phrases) "
    "select k as barcode_index, chain, category, count(distinct phrase_id) as phrases from fo join pp on contains(t, p) group by all"
)
def code_evidence(spark: SparkSession, base: str) -> DataFrame:
    """Listed phrases in the texts of matrix codes, also where they are encoded."""
    t = encoded.code_texts(_codes(spark, base)).where("text is not null").select(F.concat_ws("|", "barcode_index", "chain").alias("k"), "barcode_index", "chain", "text")
    m = detectors.phrase_matches(t, table(spark, base, "phrases"), "k", "text").join(t.select("k", "barcode_index", "chain"), "k")
    return m.groupBy("barcode_index", "chain", F.lower("category").alias("category")).agg(F.count_distinct("phrase_id").alias("phrases"))


# Graphics of font characters


def _spans(spark: SparkSession, base: str) -> DataFrame:
    """Spans moved together, every third of them made bits of a matrix font."""
    s = table(spark, base, "spans").distinct().withColumn("doc_id", F.lower("doc_id"))
    k = F.col("span_id") % 3 == 0
    s = s.withColumns({"box_top": F.col("box_top") / 3, "box_bottom": F.col("box_bottom") / 3})
    return s.withColumns({"text": F.when(k, F.repeat(F.lit("0110"), 10)).otherwise(F.col("text")), "font_name": F.when(k, "QRCode").otherwise(F.col("font_name")), "font_size": F.when(k, 2.0).otherwise(F.col("font_size"))})


def _codes_on(spans: DataFrame) -> DataFrame:
    """A code over every ninth span."""
    b = spans.where("span_id % 9 = 0")
    return b.select("doc_id", "page", F.col("span_id").alias("barcode_index"), F.lit("QR Code").alias("format"), F.lit("V").alias("content"), F.col("box_left").alias("x"), F.col("box_top").alias("y"), (F.col("box_right") - F.col("box_left")).alias("w"), (F.col("box_bottom") - F.col("box_top")).alias("h"))


_NEAR = "g[1] <= n.r + 16 and n.l <= g[3] + 16 and g[2] <= n.b + 16 and n.t <= g[4] + 16"
GROUPS = (
    "with recursive sp as (select distinct span_id, lower(doc_id) doc_id, page, box_left l, box_top / 3 t, box_right r, box_bottom / 3 b from spans where span_id % 3 = 0 and box_left < box_right and box_top < box_bottom), "
    "nu as (select *, row_number() over (partition by doc_id, page order by t, l, span_id) i from sp), "
    "re as (select doc_id, page, i, span_id, [[l, t, r, b]] gs, 0::bigint as grp from nu where i = 1 union all select doc_id, page, i, span_id, case when k = 0 then list_append(gs, [l, t, r, b]) else list_transform(gs, lambda v, q: case when q = k then [least(v[1], l), least(v[2], t), greatest(v[3], r), greatest(v[4], b)] else v end) end, "
    "case when k = 0 then length(gs) else k - 1 end from (select n.*, gs, coalesce(list_max(list_transform(gs, lambda g, q: case when " + _NEAR + " and q > length(gs) - 100 then q end)), 0) k from re join nu n on n.doc_id = re.doc_id and n.page = re.page and n.i = re.i + 1)), "
    "gb as (select doc_id, page, grp, count(*) spans, min(l) gl, min(t) gt, max(r) gr, max(b) gb from re join sp using (doc_id, page, span_id) group by 1, 2, 3), "
    "ln as (select gb.*, span_id as barcode_index from gb join (select * from sp where span_id % 9 = 0) c using (doc_id, page) where greatest(least(gr, c.r) - greatest(gl, c.l), 0) * greatest(least(gb, c.b) - greatest(gt, c.t), 0) / least((gr - gl) * (gb - gt), (c.r - c.l) * (c.b - c.t)) >= 0.65) "
)


@query(GROUPS + "select doc_id, page, grp as group, spans, gl as box_left, gb as box_bottom from gb")
def graphic_groups(spark: SparkSession, base: str) -> DataFrame:
    s = _spans(spark, base)
    return encoded.group_boxes(encoded.span_groups(s), s).select("doc_id", "page", "group", "spans", "box_left", "box_bottom")


@query(GROUPS + "select doc_id, page, grp as group, barcode_index from ln")
def graphic_codes(spark: SparkSession, base: str) -> DataFrame:
    s = _spans(spark, base)
    return encoded.linked_codes(encoded.group_boxes(encoded.span_groups(s), s), _codes_on(s)).select("doc_id", "page", "group", "barcode_index")


@query(
    GROUPS + ", gr2 as (select distinct doc_id, page, gl, gt, gr, gb from ln), dr as (select distinct sp.span_id from sp join gr2 using (doc_id, page) where (l + r) / 2 between gl and gr and (t + b) / 2 between gt and gr2.gb), "
    "ti as (select distinct span_id from spans where case when span_id % 3 = 0 then true else trim(text) <> '' and font_size < 4 and font_size > 0 end) select span_id from ti where span_id not in (select span_id from dr)"
)
def tiny_text_less_graphics(spark: SparkSession, base: str) -> DataFrame:
    """Tiny text without the spans that draw a code."""
    s = _spans(spark, base)
    linked = encoded.linked_codes(encoded.group_boxes(encoded.span_groups(s), s), _codes_on(s))
    return encoded.without_graphics(detectors.tiny_text(s), encoded.graphic_spans(s, linked)).select("span_id")
