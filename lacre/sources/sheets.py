"""The sheets of a report as DataFrames, one row each for what a reader looks up; writing them is write_sheets().

Lists that grow with the data (the documents of a code) are rows of a sheet of their own, never a cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacre.functions.text import title_of
from lacre.operators import batches, evidence
from lacre.operators.adapters import rescaled


def summary(state: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for each batch: documents by status, progress, first and last event, codes found in its documents."""
    times = state.groupBy("batch_id").agg(F.min("event_ts").alias("started"), F.max("event_ts").alias("finished"))
    codes = state.select("batch_id", "doc_id").join(evidence.finding_documents(findings, evidence.code()).select("doc_id", "code").distinct(), "doc_id").groupBy("batch_id").agg(F.count_distinct("code").alias("finding_types"))
    j = batches.progress(state).join(times, "batch_id").join(codes, "batch_id", "left")
    return j.withColumn("finding_types", F.coalesce("finding_types", F.lit(0))).withColumn("has_findings", F.col("finding_types") > 0)


def documents(state: DataFrame, findings: DataFrame, barcodes: DataFrame) -> DataFrame:
    """One row for each document of a batch with its comparative findings and its codes by kind."""
    c = evidence.comparative_context(findings).select("doc_id", F.col("findings").alias("comparative_findings"), F.col("gravest").alias("comparative_severity"))
    n = barcodes.where("trim(content) != ''").groupBy("doc_id").agg(F.count("*").alias("barcodes"))
    j = state.join(c, "doc_id", "left").join(n, "doc_id", "left")
    return j.select("batch_id", "doc_id", "status", "analysis_id", "error_message", F.coalesce("comparative_findings", F.lit(0)).alias("comparative_findings"), "comparative_severity", F.coalesce("barcodes", F.lit(0)).alias("barcodes"))


def findings_by_type(state: DataFrame, evidences: DataFrame) -> DataFrame:
    """Evidence codes of each batch: affected documents, occurrences, prevalence, highest confidence."""
    e = evidences.distinct().where("trim(code) != ''").select(evidence.code().alias("code"), F.lower("doc_id").alias("doc_id"), evidence.clamped().alias("c"))
    per_doc = e.groupBy("code", "doc_id").agg(F.count("*").alias("n"), F.max("c").alias("c"))
    total = state.groupBy("batch_id").agg(F.count_distinct("doc_id").alias("total_documents"))
    g = state.select("batch_id", "doc_id").distinct().join(per_doc, "doc_id").groupBy("batch_id", "code").agg(F.count("*").alias("affected"), F.sum("n").alias("occurrences"), F.max("c").alias("highest_confidence"))
    return g.join(total, "batch_id").select("batch_id", "code", title_of(F.col("code")).alias("title"), "affected", "total_documents", "occurrences", F.round(F.col("affected") / F.col("total_documents") * 100, 2).alias("prevalence"), "highest_confidence")


def affected_documents(evidences: DataFrame) -> DataFrame:
    """(code, doc_id): the documents of each code, as rows."""
    return evidences.where("trim(code) != ''").select(evidence.code().alias("code"), F.lower("doc_id").alias("doc_id")).distinct()


def evidence_rows(evidences: DataFrame, barcodes: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Evidences, readings of codes with a content, and observed identifiers in one list."""
    e = evidences.distinct().select(F.lower("doc_id").alias("doc_id"), evidence.code().alias("code"), F.lower("severity").alias("severity"), "page", F.round(evidence.clamped(), 4).alias("confidence"), F.col("evidence_id").cast("string").alias("reference"))
    info = (F.lit("info").alias("severity"), "page")
    b = barcodes.where("trim(content) != ''").select("doc_id", F.lit("BARCODE_READ_OBSERVED").alias("code"), *info, F.lit(1.0).alias("confidence"), F.col("barcode_index").cast("string").alias("reference"))
    i = identifiers.select("doc_id", F.lit("DOCUMENT_IDENTIFIER_OBSERVED").alias("code"), *info, F.round(F.col("confidence") / 100, 4).alias("confidence"), F.concat_ws(":", "kind", "value").alias("reference"))
    return e.unionByName(b).unionByName(i)


def financial_rows(validations: DataFrame, comparisons: DataFrame, values: DataFrame) -> DataFrame:
    """Validated lines, their comparisons with codes, and payment values, tagged by record type."""
    tagged = (
        validations.select(F.lit("validation").alias("record_type"), "doc_id", F.col("line_id").alias("reference"), "status", F.col("line").alias("content")),
        comparisons.select(F.lit("comparison").alias("record_type"), "doc_id", F.col("line_id").alias("reference"), F.col("result").alias("status"), F.col("barcode").alias("content")),
        values.select(F.lit("value").alias("record_type"), "doc_id", F.col("source").alias("reference"), F.lit("OBSERVED").alias("status"), F.col("amount").cast("string").alias("content")),
    )
    return reduce(lambda a, b: a.unionByName(b), tagged)


def prompt_rows(evidences: DataFrame) -> DataFrame:
    """Evidences of each document with a number from 1 (by pos, then id), their weighted score and the document's level."""
    e = evidences.distinct().withColumn("doc_id", F.lower("doc_id"))
    order = Window.partitionBy("doc_id").orderBy("pos", "evidence_id")
    weighted = F.round(evidence.clamped() * F.coalesce("weight", F.lit(0.5)), 4)
    rows = e.select("doc_id", "evidence_id", F.row_number().over(order).cast("long").alias("evidence_index"), evidence.code().alias("code"), F.lower(F.trim("category")).alias("category"), "lang", "page", weighted.alias("weighted_score"))
    return rows.join(evidence.assessments(evidences).select("doc_id", "score", "level"), "doc_id")


def concealment_rows(concealed: DataFrame, running: bool = True) -> DataFrame:
    """concealed(kind, rank, span_id, doc_id ...) with a number in each document: white text, low contrast, tiny text. Running
    over all three, or beginning anew with tiny text."""
    keys = ["doc_id"] if running else ["doc_id", F.col("rank") == 2]
    return concealed.withColumn("finding_index", F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "page", "span_id")).cast("long"))


def location_rows(lines: DataFrame, prompts: DataFrame, concealed: DataFrame) -> DataFrame:
    """Places of numeric lines, prompts and concealed text in one schema, confidences from 0 to 1.

    All three: doc_id, reference, page, confidence; lines state theirs in percent.
    """
    kinds = (("numeric_line", lines), ("prompt", prompts), ("concealment", concealed))
    parts = [
        df.select("doc_id", F.lit(k).alias("location_type"), F.col("reference").cast("string").alias("reference"), "page", F.round(rescaled(F.lit(k), F.col("confidence")), 4).alias("confidence"), F.col("page").isNotNull().alias("located")) for k, df in kinds
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def technical_rows(analyses: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """One wide row for each analysis: its file and how much of each kind it holds; counts: name -> rows with a doc_id."""
    a = batches.first_analyses(analyses)
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
    out = a.select(
        F.lower("doc_id").alias("doc_id"), F.lower("filename").alias("filename"), "size_bytes", (F.coalesce(F.trim("native_text"), F.lit("")) != "").alias("has_native_text"), size("native_text").alias("native_characters"), size("ocr_text").alias("ocr_characters")
    )
    for name, rows in counts.items():
        out = out.join(rows.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def image_rows(fingerprints: DataFrame) -> DataFrame:
    """One row for each fingerprint with a number in its document and how many the document has."""
    w = Window.partitionBy("doc_id")
    return fingerprints.withColumns({"fingerprint_index": F.row_number().over(w.orderBy("seq")).cast("long"), "images": F.count("*").over(w)})


def comparison_rows(findings: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Cross-document findings (two documents at least) and comparisons of identifiers in one list."""
    d = evidence.finding_documents(findings, evidence.code()).groupBy("finding_id", "code", "severity").agg(F.count("*").alias("documents")).where("documents > 1")
    f = d.select("code", F.col("finding_id").cast("string").alias("reference"), "severity", "documents")
    i = identifiers.select(F.concat(F.lit("DOCUMENT_IDENTIFIER_"), "relation").alias("code"), F.concat_ws(":", "kind", "value_a", "value_b").alias("reference"), F.lit("info").alias("severity"), F.col("documents").cast("long").alias("documents"))
    return f.unionByName(i)


def row_counts(sheets: dict[str, DataFrame]) -> DataFrame:
    """(sheet, rows) of a workbook, as one plan."""
    return reduce(lambda a, b: a.unionByName(b), (df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("sheet"), "rows") for name, df in sheets.items()))


def severity_view(rows: DataFrame, by: str, severity: str = "severity") -> DataFrame:
    """Rows of each severity and in all for each value of a column, with a message that names the gravest."""
    s = evidence.severity_counts(rows.withColumn("severity", F.col(severity)), by)
    total: Column = sum((F.col(x) for x in evidence.SEVERITY), F.lit(0))
    return s.withColumns({"total": total, "message": F.concat(total.cast("string"), F.lit(" evidences, gravest "), F.col("gravest"))})
