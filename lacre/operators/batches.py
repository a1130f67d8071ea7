"""Batches: latest state of each document, progress and status of the batch, joins to the analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(batch_documents: DataFrame) -> DataFrame:
    """The last state of each document in a batch (rows without event_ts come first; ties by status), by max_by."""
    state = F.struct("event_ts", "status", "analysis_id", "error_message")
    return (
        batch_documents.distinct().groupBy("batch_id", F.lower("doc_id").alias("doc_id")).agg(F.max_by(state, F.struct(F.coalesce("event_ts", F.lit("1970-01-01").cast("timestamp")), F.lower("status"), F.coalesce("analysis_id", F.lit("")))).alias("s"))
        .select("batch_id", "doc_id", F.lower("s.status").alias("status"), "s.analysis_id", "s.error_message", "s.event_ts")
    )


def created(uploads: DataFrame) -> DataFrame:
    """uploads(batch_id, doc_id) -> the state of new batches: every document once, pending."""
    return uploads.select("batch_id", F.lower("doc_id").alias("doc_id")).distinct().withColumn("status", F.lit("pending"))


#: Which status may follow which.
NEXT = {"pending": ("processing", "failed"), "processing": ("completed", "failed"), "completed": (), "failed": ("processing",)}


def transitions(batch_documents: DataFrame) -> DataFrame:
    """(batch_id, doc_id, steps, irregular): how often a document's status changed in order of time, and how many of these
    steps no rule allows. Rows without a time come first; ties by status."""
    e = batch_documents.distinct().select("batch_id", F.lower("doc_id").alias("doc_id"), F.lower("status").alias("status"), "event_ts", "analysis_id")
    w = Window.partitionBy("batch_id", "doc_id").orderBy(F.col("event_ts").asc_nulls_first(), "status", F.col("analysis_id").asc_nulls_first())
    e = e.withColumn("_before", F.lag("status").over(w))
    allowed = F.lit(False)
    for a, following in NEXT.items():
        allowed = allowed | ((F.col("_before") == a) & F.col("status").isin(*following))
    changed = F.col("_before").isNotNull() & (F.col("_before") != F.col("status"))
    n = lambda c: F.sum(c.cast("long"))
    return e.groupBy("batch_id", "doc_id").agg(n(changed).alias("steps"), n(changed & ~allowed).alias("irregular"))


def processed(documents: DataFrame, work, columns: str) -> DataFrame:  # noqa: ANN001
    """documents through a function of a row (as a dictionary) that returns a dictionary of the given columns (DDL): each
    document by itself, one that raises is a row with status failed and the error, the others go on."""
    from collections.abc import Iterator

    kept = documents.schema["doc_id"].dataType.simpleString()
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                try:
                    made = work(row)
                    rows.append((row["doc_id"], "completed", None, *(made[n] for n in names)))
                except Exception as e:  # noqa: BLE001 - whatever a document does, the batch goes on
                    rows.append((row["doc_id"], "failed", f"{type(e).__name__}: {e}", *(None for _ in names)))
            yield pd.DataFrame(rows, columns=["doc_id", "status", "error_message", *names])

    return documents.mapInPandas(run, f"doc_id {kept}, status string, error_message string, {columns}")


def with_empty(state: DataFrame, batches: DataFrame) -> DataFrame:
    """progress() of all batches(batch_id); one without documents has failed and made no progress."""
    p = batches.select("batch_id").distinct().join(progress(state), "batch_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total", "pending", "processing", "completed", "failed")}
    return p.withColumns({**zero, "progress": F.coalesce("progress", F.lit(0.0)), "status": F.coalesce("status", F.lit("failed"))})


def progress(state: DataFrame) -> DataFrame:
    """Documents by status, share that is over in percent, and the batch's status."""
    n = {s: F.sum((F.col("status") == s).cast("long")) for s in ("pending", "processing", "completed", "failed")}
    out = state.groupBy("batch_id").agg(F.count("*").alias("total"), *(c.alias(s) for s, c in n.items()))
    over = F.col("completed") + F.col("failed")
    status = F.when(F.col("pending") + F.col("processing") > 0, "processing").when(F.col("failed") == F.col("total"), "failed").when(F.col("failed") == 0, "completed").otherwise("completed_with_errors")
    return out.withColumns({"progress": F.round(over / F.col("total") * 100, 2), "status": status})


def first_analyses(analyses: DataFrame) -> DataFrame:
    """The row with the lowest pos of each document, in any letter case of its id."""
    best = analyses.groupBy(F.lower("doc_id").alias("k")).agg(F.min("pos").alias("pos"))
    return analyses.join(best, "pos").drop("k")


def loaded(state: DataFrame, analyses: DataFrame) -> DataFrame:
    """Documents of batches with their analysis; those without one are left out."""
    a = first_analyses(analyses).select(F.lower("doc_id").alias("doc_id"), F.lower("status").alias("analysis_status"), "size_bytes", F.lower("mime_type").alias("mime_type"))
    return state.join(a, "doc_id").select("batch_id", "doc_id", "status", "analysis_status", "size_bytes", "mime_type")


def missing(state: DataFrame, analyses: DataFrame) -> DataFrame:
    """Documents of batches that never reached the analyses."""
    return state.join(analyses.select(F.lower("doc_id").alias("doc_id")), "doc_id", "left_anti").select("batch_id", "doc_id", "status")


def merged_reports(reports: list[DataFrame]) -> DataFrame:
    """reports(stage, seconds, calls), added up by stage: seconds, calls, average, share of all seconds in percent."""
    every = reports[0]
    for r in reports[1:]:
        every = every.unionByName(r)
    g = every.groupBy("stage").agg(F.sum("seconds").alias("seconds"), F.sum("calls").alias("calls"))
    total = g.agg(F.sum("seconds").alias("_t"))
    j = g.crossJoin(F.broadcast(total))  # one row
    return j.select("stage", "seconds", "calls", (F.col("seconds") / F.col("calls")).alias("average"), F.when(F.col("_t") > 0, F.col("seconds") / F.col("_t") * 100).otherwise(0.0).alias("share"))
