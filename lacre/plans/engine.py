"""Queries of batches, stores and the engine of registered functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacre.operators import batches, detectors, evidence
from lacre.plans import oracles, prompts
from lacre.plans.oracles import NAMED, NAMES, RANK, STATE
from lacre.plans.register import query
from lacre.plans.registry import Named
from lacre.sources.stores import Store
from lacre.sources.tables import shared_folder, table


@query("select batch_id, count(*) as total, count(*) as pending, 0.0::double as progress, 'processing' as status from (select distinct batch_id, lower(doc_id) from batch_documents) group by 1")
def new_batches(spark: SparkSession, base: str) -> DataFrame:
    """All batches as they were when they were made."""
    return batches.progress(batches.created(table(spark, base, "batch_documents"))).select("batch_id", "total", "pending", "progress", "status")


@query(
    "with b as (select distinct batch_id, lower(doc_id) doc_id, lower(status) status, event_ts, analysis_id from (select distinct * from batch_documents)), w as (select *, lag(status) over (partition by batch_id, doc_id order by event_ts nulls first, status, analysis_id nulls first) p from (select batch_id, lower(doc_id) doc_id, lower(status) status, event_ts, analysis_id from (select distinct * from batch_documents))) "
    "select batch_id, doc_id, sum((p is not null and p <> status)::int)::bigint as steps, sum((p is not null and p <> status and not ((p = 'pending' and status in ('processing', 'failed')) or (p = 'processing' and status in ('completed', 'failed')) or (p = 'failed' and status = 'processing')))::int)::bigint as irregular from w group by 1, 2"
)
def status_transitions(spark: SparkSession, base: str) -> DataFrame:
    return batches.transitions(table(spark, base, "batch_documents"))


@query("select doc_id, case when text is null or text = '' then 'failed' else 'completed' end as status, case when text is null then 'TypeError' when text = '' then 'ZeroDivisionError' end as error, case when text <> '' then length(text) end::bigint as characters from documents")
def processed_documents(spark: SparkSession, base: str) -> DataFrame:
    """Every document by itself through a function that fails for null and empty texts."""

    def work(row: dict) -> dict:
        return {"characters": len(row["text"]) * (len(row["text"]) // len(row["text"]))}

    p = batches.processed(table(spark, base, "documents").select("doc_id", "text"), work, "characters long")
    return p.select("doc_id", "status", F.split("error_message", ":")[0].alias("error"), "characters")


@query(
    STATE + ", g as (select batch_id, count(*) total, " + ", ".join(f"sum((status = '{s}')::int)::bigint {s}" for s in ("pending", "processing", "completed", "failed")) + " from s group by 1) "
    "select batch_id, total, pending, processing, completed, failed, round((completed + failed) / total * 100, 2) as progress, case when pending + processing > 0 then 'processing' when failed = total then 'failed' when failed = 0 then 'completed' else 'completed_with_errors' end as status from g "
    "union all select 'empty', 0, 0, 0, 0, 0, 0, 'failed'"
)
def batch_statuses(spark: SparkSession, base: str) -> DataFrame:
    """All batches and one without documents."""
    b = table(spark, base, "batch_documents").select("batch_id").union(spark.createDataFrame([("empty",)], "batch_id string"))
    return batches.with_empty(batches.latest(table(spark, base, "batch_documents")), b)


_NAMED = NAMED.removeprefix("with ")


@query(
    STATE + f", {_NAMED}, c as (select doc_id, count(*) k, min({RANK}) r from n group by 1) select batch_id, count(*) as documents, sum((k is not null)::int)::bigint as with_findings, " + ", ".join(f"sum((r = {i})::int)::bigint as {x}" for i, x in enumerate(("critical", "high", "medium", "low", "info")))
    + f", case when min(r) is not null then {NAMES}[min(r) + 1] end as worst from s left join c using (doc_id) group by 1"
)
def batch_overview(spark: SparkSession, base: str) -> DataFrame:
    """Documents of each batch by their gravest comparative finding, and the gravest of the batch."""
    d = evidence.finding_documents(table(spark, base, "findings"), evidence.code()).groupBy("doc_id").agg(F.min(evidence.severity_rank()).alias("r"))
    j = batches.latest(table(spark, base, "batch_documents")).join(d, "doc_id", "left")
    names = F.array(*(F.lit(s) for s in (*evidence.SEVERITY, "unknown")))
    n = [F.sum(F.coalesce(F.col("r") == i, F.lit(False)).cast("long")).alias(s) for i, s in enumerate(evidence.SEVERITY)]
    g = j.groupBy("batch_id").agg(F.count("*").alias("documents"), F.count("r").alias("with_findings"), *n, F.min("r").alias("_w"))
    return g.withColumn("worst", F.when(F.col("_w").isNotNull(), F.get(names, F.col("_w")))).drop("_w")


@query("with g as (select event_type, sum(value) s, count(*) c from events group by 1) select event_type as stage, round(s, 4) as seconds, c as calls, round(s / c, 6) as average, round(s / (select sum(s) from g) * 100, 2) as share from g")
def performance_report(spark: SparkSession, base: str) -> DataFrame:
    """Two reports of stages (here: types of events), of even and odd events, added up."""
    e = table(spark, base, "events")
    half = lambda i: e.where(F.col("event_id") % 2 == i).groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("seconds"), F.count("*").alias("calls"))
    r = batches.merged_reports([half(0), half(1)])
    return r.select("stage", F.round("seconds", 4).alias("seconds"), "calls", F.round("average", 6).alias("average"), F.round("share", 2).alias("share"))


@query("select doc_id, case when doc_id % 3 = 0 then 'second' else 'first' end as lang, n_chars from documents where doc_id % 7 <> 0")
def stored_documents(spark: SparkSession, base: str) -> DataFrame:
    """Documents put into a store, a third of them put again, every seventh deleted: what is there."""
    s = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", "doc_id", "doc_id long, lang string, n_chars long")
    d = table(spark, base, "documents").select("doc_id", F.lit("first").alias("lang"), "n_chars")
    s.put(d)
    s.put(d.where("doc_id % 3 = 0").withColumn("lang", F.lit("second")))
    s.delete(d.where("doc_id % 7 = 0"))
    return s.all()


# Registered functions


def comparators() -> Named:
    from lacre.plans.queries import _digests, identifier_matches, shared_codes

    n = Named()
    n.register("exact_duplicates", lambda g: _digests(*g).where("documents > 1").select(F.lit("EXACT_DUPLICATE").alias("code"), F.col("key").alias("reference"), F.col("documents").cast("long").alias("documents")))
    n.register("shared_codes", lambda g: shared_codes(*g).select(F.when(F.col("divergent"), "SHARED_CODE_DIVERGENT").otherwise("SHARED_CODE").alias("code"), F.col("content").alias("reference"), F.col("documents").cast("long").alias("documents")))
    n.register("identifiers", lambda g: identifier_matches(*g).select(F.concat(F.lit("IDENTIFIER_"), "relation").alias("code"), F.concat_ws(":", "kind", "value_a", "value_b").alias("reference"), F.col("documents").cast("long").alias("documents")))
    return n


@query(
    f"select 'exact_duplicates' as comparator, 'EXACT_DUPLICATE' as code, key as reference, documents::bigint as documents from ({oracles.DIGESTS}) where documents > 1 union all "
    f"select 'shared_codes', case when divergent then 'SHARED_CODE_DIVERGENT' else 'SHARED_CODE' end, content, documents::bigint from ({oracles.ORACLES['shared_codes']}) union all "
    f"select 'identifiers', 'IDENTIFIER_' || relation, kind || ':' || value_a || ':' || value_b, documents::bigint from ({oracles.ORACLES['identifier_matches']})"
)
def engine_findings(spark: SparkSession, base: str) -> DataFrame:
    """The findings of three registered comparators as one plan."""
    return comparators().union((spark, base), "comparator")


@query(
    prompts.PLACES + f", u as (select span_id, lower(lang) lang, lower(category) category, s, z, min(phrase_id) phrase_id from x group by all) select 'phrases' as detector, span_id, 'PROMPT_INJECTION_' || upper(replace(category, ' ', '_')) as code from u union all "
    f"select 'tiny', span_id, 'TINY_TEXT' from {oracles.SPAN} where trim(text) <> '' and font_size < 4 and font_size > 0"
)
def detector_evidence(spark: SparkSession, base: str) -> DataFrame:
    """The evidence of a text detector and a span detector, registered by name."""
    n = Named()
    phrases = table(spark, base, "phrases")
    n.register("phrases", lambda s: detectors.phrase_evidence(s.select("span_id", "text"), phrases, "span_id", "text").select("span_id", "code"))
    n.register("tiny", lambda s: detectors.tiny_text(s).select("span_id", F.lit("TINY_TEXT").alias("code")))
    return n.union(table(spark, base, "spans").distinct().withColumn("doc_id", F.lower("doc_id")), "detector")


@query("select 'analyses' as reader, count(*) as rows from analyses union all select 'boxes', count(*) from boxes union all select 'dates', count(*) from dates")
def reader_rows(spark: SparkSession, base: str) -> DataFrame:
    """Rows that registered readers find."""
    n = Named()
    for name in ("analyses", "boxes", "dates"):
        n.register(name, lambda g, name=name: table(*g, name).agg(F.count("*").alias("rows")))
    return n.union((spark, base), "reader")


