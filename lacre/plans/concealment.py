"""Queries of concealed text beyond the single detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacre.operators import detectors
from lacre.plans.derived import backgrounds
from lacre.plans.oracles import MEASURED, RATIO
from lacre.plans.register import query
from lacre.sources.tables import table

NEAR_WHITE = "trim(text) <> '' and red >= 245 / 255 and green >= 245 / 255 and blue >= 245 / 255"
HIDDEN = (
    MEASURED + f", hid as (select 'WHITE_TEXT' kind, 0 rank, span_id, doc_id, page from m where {NEAR_WHITE} and (bl is null or {RATIO} < 2.0) union all "
    f"select 'LOW_CONTRAST_TEXT', 1, span_id, doc_id, page from m where trim(text) <> '' and upper(font_name) <> 'OCR_UNKNOWN' and bl is not null and {RATIO} < 2.0 union all "
    "select 'TINY_TEXT', 2, span_id, doc_id, page from m where trim(text) <> '' and font_size < 4 and font_size > 0) "
)


def spans_of(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "spans").distinct().withColumn("doc_id", F.lower("doc_id"))


@query(HIDDEN + "select kind, span_id, doc_id, page from hid")
def concealed_text(spark: SparkSession, base: str) -> DataFrame:
    s = spans_of(spark, base)
    return detectors.concealed(s, backgrounds(s)).select("kind", "span_id", "doc_id", "page")


@query(
    MEASURED + ", f as (select span_id as finding_id, doc_id, page, case when span_id % 4 = 0 then text || '?' else text end as text, box_left, box_top, box_right, box_bottom from s), "
    "k as (select doc_id, page, text, box_left, box_top, box_right, box_bottom, arg_min(span_id, struct_pack(p := pos, i := span_id)) as span_id from s group by all) select finding_id, k.span_id from f left join k using (doc_id, page, text, box_left, box_top, box_right, box_bottom)"
)
def finding_spans(spark: SparkSession, base: str) -> DataFrame:
    """Findings led back to their spans; every fourth finding's text was changed and has none."""
    s = spans_of(spark, base)
    edges = ["box_left", "box_top", "box_right", "box_bottom"]
    f = s.select(F.col("span_id").alias("finding_id"), "doc_id", "page", F.when(F.col("span_id") % 4 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"), *edges)
    return detectors.source_spans(f, s)
