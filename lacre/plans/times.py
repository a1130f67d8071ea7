"""Queries of dates beyond timelines: places in texts, PDF dates, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacre.operators import temporal
from lacre.plans.register import query
from lacre.sources.tables import table

_D = "with d as (select distinct * replace (lower(doc_id) as doc_id, lower(source) as source) from dates) "


def _dates(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "dates").distinct().withColumns({"doc_id": F.lower("doc_id"), "source": F.lower("source")})
    return d.withColumnsRenamed({"date_value": "value", "raw_content": "raw"})


@query(
    _D + "select doc_id, count(*) as occurrences, array_to_string(list_sort(list(distinct date_value)), ',') as values, coalesce(array_to_string(list_sort(list(distinct page) filter (page is not null)), ','), '') as pages, min(coalesce(confidence, 0.0)) as confidence from d where date_value > date '2025-06-30' group by 1"
)
def future_dates(spark: SparkSession, base: str) -> DataFrame:
    return temporal.future_dates(_dates(spark, base), F.lit("2025-06-30").cast("date"))


@query(_D + "select date_id, doc_id, row_number() over (partition by doc_id order by date_value, coalesce(page, -1), source, coalesce(metadata_field, ''), raw_content nulls first, date_id) as place from d where date_value is not null")
def timeline_order(spark: SparkSession, base: str) -> DataFrame:
    return temporal.ordered(_dates(spark, base)).select("date_id", "doc_id", "place")


@query(
    "with t as (select doc_id, text, unnest(range(1, length(text) - 8)) i from documents where regexp_matches(text, '[0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}')), f as (select doc_id, i, text from t where regexp_full_match(substr(text, i, 10), '[0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}') "
    "and (i = 1 or not regexp_matches(substr(text, i - 1, 1), '[0-9A-Za-z_]')) and (i + 10 > length(text) or not regexp_matches(substr(text, i + 10, 1), '[0-9A-Za-z_]'))) "
    "select doc_id, (i - 1)::int as start, substr(text, i, 10) as raw, regexp_replace(substr(text, greatest(i - 40, 1), i + 49 - greatest(i - 40, 1) + 1), '^\\s+|\\s+$', '', 'g') as around from f"
)
def date_contexts(spark: SparkSession, base: str) -> DataFrame:
    """Dates in texts with forty characters on either side."""
    return temporal.context(table(spark, base, "documents"), "doc_id", "text")


_TRIES = "coalesce(case when length(digits) >= 8 then try_strptime(substr(digits, 1, 8), '%Y%m%d')::date end, " + ", ".join(
    f"case when regexp_full_match(t, '{p}') then try_strptime(t, '{f}')::date end" for p, f in ((r"\d{1,2}/\d{1,2}/\d{4}", "%d/%m/%Y"), (r"\d{4}-\d{1,2}-\d{1,2}", "%Y-%m-%d"), (r"\d{1,2}-\d{1,2}-\d{4}", "%d-%m-%Y"), (r"\d{4}/\d{1,2}/\d{1,2}", "%Y/%m/%d"), (r"\d{1,2}\.\d{1,2}\.\d{4}", "%d.%m.%Y"))
) + ")"
_RAW = "r as (select date_id, doc_id, metadata_field, raw_content, regexp_replace(trim(raw_content), '^D:', '') t from d), g as (select *, regexp_extract(t, '^([0-9]{4,14})(?:Z|[+-].*)?$', 1) digits from r) "


@query(_D + ", " + _RAW + f"select date_id, {_TRIES} as value from g where raw_content is not null")
def metadata_notations(spark: SparkSession, base: str) -> DataFrame:
    """Days of all raw dates by the rules of PDF dates and the common notations."""
    return _dates(spark, base).where("raw is not null").select("date_id", temporal.pdf_day(F.col("raw")).alias("value"))


@query(
    _D + ", " + _RAW + ", m as (select doc_id, metadata_field, max(raw_content) raw from d where metadata_field in ('creationDate', 'modDate') group by 1, 2), "
    "n as (select *, regexp_replace(trim(raw), '^D:', '') t from m), h as (select *, regexp_extract(t, '^([0-9]{4,14})(?:Z|[+-].*)?$', 1) digits from n) " + f"select doc_id, metadata_field, raw, {_TRIES} as value from h where {_TRIES} is not null"
)
def metadata_days(spark: SparkSession, base: str) -> DataFrame:
    """Creation and modification days of documents, from one wide row each."""
    d = _dates(spark, base)
    one = lambda f: F.max(F.when(F.col("metadata_field") == f, F.col("raw"))).alias(f)
    return temporal.metadata_days(d.groupBy("doc_id").agg(one("creationDate"), one("modDate")))


@query(
    _D + ", r as (select date_id, regexp_replace(trim(raw_content), '^D:', '') t from d where raw_content is not null), p as (select date_id, t, regexp_extract(t, '^([0-9]{14})', 1) s, regexp_extract(t, '^[0-9]{14}(.*)$', 1) z from r where regexp_full_match(t, '[0-9]{14}(Z|[+-][0-9]{2}''?([0-9]{2})?''?)?')), "
    "q as (select date_id, try_strptime(s, '%Y%m%d%H%M%S') moment, case when z = 'Z' then 0 when z = '' then -180 else (case when z[1] = '-' then -1 else 1 end) * (substr(z, 2, 2)::int * 60 + coalesce(try_cast(substr(replace(z, '''', ''), 4, 2) as int), 0)) end o from p) "
    "select date_id, epoch(moment)::bigint - o * 60 as seconds from q where moment is not null"
)
def pdf_instants(spark: SparkSession, base: str) -> DataFrame:
    """Instants of full PDF dates; those without an offset are read in the zone the reports use."""
    return _dates(spark, base).select("date_id", temporal.pdf_instant(F.col("raw")).alias("seconds")).where("seconds is not null")
