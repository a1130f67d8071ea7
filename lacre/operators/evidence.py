"""Evidence and finding aggregates: prevalence, assessment, severity, order, deduplication.

Evidence rows that repeat in every column count once; blank codes are dropped; confidences outside 0 to 1 are clamped,
missing ones count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacre.functions.text import title_of

SEVERITY = ("critical", "high", "medium", "low", "info")
LEVELS = (("NONE", 0.0), ("LOW", 0.3), ("MEDIUM", 0.55), ("HIGH", 0.8))


def code(c: str = "code") -> Column:
    return F.upper(F.trim(c))


def clamped(c: str = "confidence") -> Column:
    return F.least(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def severity_rank(c: str = "severity") -> Column:
    """0 for critical to 4 for info, 5 for anything else."""
    s = F.lower(F.trim(c))
    rank = F.lit(len(SEVERITY))
    for i, name in reversed(list(enumerate(SEVERITY))):
        rank = F.when(s == name, i).otherwise(rank)
    return rank


def prevalence(evidences: DataFrame, documents: DataFrame) -> DataFrame:
    """For each code: affected documents, occurrences, share of all documents in percent, highest confidence.

    The distinct documents are counted after a partial sum for each (code, document), so a frequent code is no hot task.
    """
    total = documents.select(F.count_distinct(F.lower("doc_id")).alias("total_documents"))
    e = evidences.distinct().where("trim(code) != ''").select(code().alias("code"), F.lower("doc_id").alias("doc_id"), clamped().alias("c"))
    per_doc = e.groupBy("code", "doc_id").agg(F.count("*").alias("n"), F.max("c").alias("c"))
    out = per_doc.groupBy("code").agg(F.count("doc_id").alias("affected"), F.sum("n").alias("occurrences"), F.max("c").alias("highest_confidence")).crossJoin(F.broadcast(total))
    return out.select("code", title_of(F.col("code")).alias("title"), "affected", "total_documents", "occurrences", F.round(F.col("affected") / F.col("total_documents") * 100, 2).alias("prevalence"), "highest_confidence")


#: Categories that count as strong.
STRONG = ("instruction_override", "system_prompt_extraction", "tool_manipulation")


def assessments(evidences: DataFrame) -> DataFrame:
    """Risk score of each document: the best weighted evidence plus bonuses for variety, number and strong categories."""
    e = evidences.distinct().select(F.lower("doc_id").alias("doc_id"), clamped().alias("c"), F.coalesce("weight", F.lit(0.5)).alias("w"), F.lower(F.trim("category")).alias("category"), "lang", "detector")
    top = F.max(F.col("c") * F.col("w"))
    cats, n = F.count_distinct("category"), F.count("*")
    strong_cats = F.count_distinct(F.when(F.col("category").isin(*STRONG), F.col("category")))
    score = top + F.least(0.05 * F.greatest(cats - 1, F.lit(0)), F.lit(0.15)) + F.least(0.03 * F.greatest(n - 1, F.lit(0)), F.lit(0.12)) + F.least(0.08 * strong_cats, F.lit(0.16))
    out = e.groupBy("doc_id").agg(F.round(F.least(score, F.lit(1.0)), 4).alias("score"), cats.alias("categories"), n.alias("evidences"), F.count_distinct("detector").alias("detectors"), F.count_distinct("lang").alias("languages"))
    level = F.lit("CRITICAL")
    for name, bound in reversed(LEVELS):
        level = F.when((F.col("score") <= bound) if name == "NONE" else (F.col("score") < bound), name).otherwise(level)
    return out.withColumn("level", level)


def severity_counts(rows: DataFrame, by: str) -> DataFrame:
    """Rows of each severity and the gravest one, for each value of a column."""
    d = rows.withColumn("_r", severity_rank())
    counts = [F.sum((F.col("_r") == i).cast("long")).alias(name) for i, name in enumerate(SEVERITY)]
    names = F.array(*(F.lit(s) for s in (*SEVERITY, "unknown")))
    return d.groupBy(by).agg(*counts, F.min("_r").alias("_top")).withColumn("gravest", names[F.col("_top")]).drop("_top")


def finding_documents(findings: DataFrame, key: Column) -> DataFrame:
    """Findings exploded to the documents they name, each once: finding_id, code, severity, confidence, doc_id."""
    ids = F.array_distinct(F.filter(F.transform("doc_ids", lambda x: key_of(x)), lambda x: x.isNotNull()))
    f = findings.dropDuplicates(["finding_id"]).select("finding_id", key.alias("code"), F.lower(F.trim("severity")).alias("severity"), "confidence", F.explode(ids).alias("doc_id"))
    return f


def key_of(c: Column) -> Column:
    """One notation for document ids: lower case with hyphens; null where it is no UUID."""
    h = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "^urn:uuid:", ""), r"[{}\s-]", "")
    return F.when(h.rlike("^[0-9a-f]{32}$"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def comparative_context(findings: DataFrame) -> DataFrame:
    """For each document the number of findings that name it, and their gravest severity."""
    d = finding_documents(findings, code())
    names = F.array(*(F.lit(s) for s in (*SEVERITY, "unknown")))
    return d.groupBy("doc_id").agg(F.count("*").alias("findings"), F.count_distinct("code").alias("codes"), F.min(severity_rank()).alias("_r")).select("doc_id", "findings", "codes", names[F.col("_r")].alias("gravest"))


def first_evidences(evidences: DataFrame) -> DataFrame:
    """The first row (by pos, then id) of each document, code, language, category, page and folded excerpt."""
    key = [F.lower("doc_id"), code(), F.lower("lang"), F.lower("category"), "page", F.lower(F.trim("normalized_excerpt")), "source"]
    w = Window.partitionBy(*key).orderBy("pos", "evidence_id")
    return evidences.distinct().withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def report_order(findings: DataFrame) -> DataFrame:
    """Rank of each finding inside its code: severity, falling confidence, id."""
    f = findings.dropDuplicates(["finding_id"]).select("finding_id", code().alias("code"), "severity", F.round(clamped(), 4).alias("confidence"))
    return f.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy(severity_rank(), F.col("confidence").desc(), "finding_id")).cast("long"))
