"""Labelled values on pages: extraction, the best observation, values that contradict each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels of the kinds, as patterns on folded text before a colon.
KINDS = (
    ("account", r"(?:n[o.]? (?:da )?conta|numero da conta|conta)"),
    ("invoice", r"(?:n[o.]? (?:da )?fatura|numero da fatura|fatura)"),
    ("customer", r"(?:cod(?:igo)?\.? (?:do )?cliente|agencia/codigo)"),
    ("automatic_debit", r"(?:(?:cod(?:igo)?\.? (?:de )?)?debito automatico)"),
    ("holder", r"(?:titular|nome do cliente|nome do titular|cliente|sacado|favorecido|account holder)"),
)
MEMBERS = "áàâãéêíóôõúçº"
PLAIN = "aaaaeeiooouco"


def labelled(boxes: DataFrame) -> DataFrame:
    """(box_id, doc_id, page, kind, value, confidence): "label: value" boxes; numbers of 4 to 24 digits, holders of two
    words or more without digits. Missing confidences count as 0."""
    label = F.trim(F.translate(F.lower(F.regexp_extract("text", r"^\s*([^:]{3,40}):", 1)), MEMBERS, PLAIN))
    value = F.trim(F.regexp_extract("text", r"^[^:]+:\s*(.+?)\s*$", 1))
    kind: Column = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS):
        kind = F.when(label.rlike(f"^{pattern}$"), name).otherwise(kind)
    b = boxes.distinct().where("text like '%:%'").select("box_id", F.lower("doc_id").alias("doc_id"), "page", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), kind.alias("kind"), value.alias("value"))
    number = F.regexp_replace("value", r"[.\-/ ]", "")
    good = F.when(F.col("kind") == "holder", F.when(F.col("value").rlike(r"^[^0-9]+ [^0-9]+$"), F.upper("value"))).otherwise(F.when(number.rlike("^[0-9]{4,24}$"), number))
    return b.where("kind is not null").withColumn("value", good).where("value is not null")


def best(observations: DataFrame) -> DataFrame:
    """The most confident box of each document, kind, value and page; ties by id."""
    w = Window.partitionBy("doc_id", "kind", "value", "page").orderBy(F.col("confidence").desc(), "box_id")
    return observations.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def conflicts(observations: DataFrame) -> DataFrame:
    """Kinds of which a document states more than one value: number of values, and the two ends of their order."""
    g = observations.groupBy("doc_id", "kind").agg(F.count_distinct("value").alias("distinct_values"), F.min("value").alias("first_value"), F.max("value").alias("last_value"))
    return g.where("distinct_values > 1")


def dominant_colours(spans: DataFrame, buckets: int = 16, least: float = 0.55) -> DataFrame:
    """The most frequent colour bucket of each page, where it holds the given share of the spans; ties to the lowest."""
    b = lambda c: F.least(F.floor(F.col(c) * buckets), F.lit(buckets - 1)).cast("long")
    s = spans.distinct().select(F.lower("doc_id").alias("doc_id"), "page", ((b("red") * buckets + b("green")) * buckets + b("blue")).alias("bucket"))
    n = s.groupBy("doc_id", "page", "bucket").agg(F.count("*").alias("n"))
    g = n.groupBy("doc_id", "page").agg(F.max(F.struct("n", (-F.col("bucket")).alias("k"))).alias("m"), F.sum("n").alias("all"))
    return g.where(F.col("m.n") / F.col("all") >= least).select("doc_id", "page", (-F.col("m.k")).alias("bucket"), F.round(F.col("m.n") / F.col("all"), 4).alias("share"))


def line_windows(lines: DataFrame, key: str, line: str) -> DataFrame:
    """(key, place, width, piece): the whole line, then its 48-digit windows that start with 8, then those of 47 digits."""
    l = F.col(line)

    def windows(width: int) -> Column:
        starts = F.when(F.length(l) > width, F.sequence(F.lit(1), F.length(l) - width + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.cast("long").alias("place"), F.lit(width).cast("long").alias("width"), F.substr(l, i, F.lit(width)).alias("piece")))

    whole = F.array(F.struct(F.lit(1).cast("long").alias("place"), F.length(l).cast("long").alias("width"), l.alias("piece")))
    allowed = F.concat(whole, F.filter(windows(48), lambda w: w["piece"].startswith("8")), windows(47))
    return lines.where(l.isNotNull()).select(key, F.inline(allowed)).distinct()
