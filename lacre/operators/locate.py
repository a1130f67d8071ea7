"""Where things are: phrases in spans, numbers in texts, neighbours on a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacre.functions.checks import digits
from lacre.functions.text import folded
from lacre.operators.detectors import phrase_hits

#: A neighbour below lies at most so far under a box, and shares a fifth of the narrower width, five units at least.
BELOW_GAP = 54


def phrase_places(spans: DataFrame, phrases: DataFrame) -> DataFrame:
    """The first span, by page and position, in which a document holds a phrase, and in how many spans it does."""
    hits = phrase_hits(spans, phrases, "span_id", "text").select("span_id", "phrase_id")
    s = hits.join(spans.select("span_id", F.lower("doc_id").alias("doc_id"), "page", "pos"), "span_id")
    first = F.min(F.struct("page", "pos", "span_id"))
    return s.groupBy("doc_id", "phrase_id").agg(first.alias("f"), F.count("*").alias("spans")).select("doc_id", "phrase_id", "f.page", "f.pos", "f.span_id", "spans")


def numeric_runs(texts: DataFrame, key: str, text: str, least: int = 40, most: int = 50) -> DataFrame:
    """(key, place, raw, digits): runs of 40 to 50 digits, separated by blanks, dots or hyphens at most."""
    pattern = r"(?<![0-9])([0-9](?:[ \t.\-]*[0-9]){%d,%d})(?![ \t.\-]*[0-9])" % (least - 1, most - 1)
    t = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("place", "raw"))
    return t.select(key, F.col("place").cast("long").alias("place"), "raw", digits(F.col("raw")).alias("digits"))


def below_neighbours(boxes: DataFrame, gap: int = BELOW_GAP, cell: int = 120) -> DataFrame:
    """(doc_id, page, upper, lower, score): boxes that are each other's best partner right below and above.

    score: vertical distance plus a tenth of the left edges' distance, ties by id. Candidates come from an equi-join on
    (document, page, grid row): a box looks into the rows its reach touches, so a page isn't joined with itself in full.
    """
    b = boxes.distinct().where("trim(text) != ''").select(F.lower("doc_id").alias("doc_id"), "page", "box_id", "box_left", "box_top", "box_width", "box_height")
    low = b.select("doc_id", "page", *(F.col(c).alias(f"l_{c}") for c in ("box_id", "box_left", "box_top", "box_width")), F.floor(F.col("box_top") / cell).alias("g"))
    bottom = F.col("box_top") + F.col("box_height")
    up = b.withColumn("bottom", bottom).withColumn("g", F.explode(F.sequence(F.floor(bottom / cell), F.floor((bottom + gap) / cell))))
    shared = F.least(F.col("box_left") + F.col("box_width"), F.col("l_box_left") + F.col("l_box_width")) - F.greatest("box_left", "l_box_left")
    near = up.join(low, ["doc_id", "page", "g"]).where(
        (F.col("box_id") != F.col("l_box_id")) & (F.col("l_box_top") - F.col("bottom")).between(0, gap) & (shared >= F.greatest(F.lit(5.0), 0.2 * F.least("box_width", "l_box_width")))
    )
    score = F.round(F.col("l_box_top") - F.col("bottom") + F.abs(F.col("box_left") - F.col("l_box_left")) / 10, 4)
    p = near.select("doc_id", "page", F.col("box_id").alias("upper"), F.col("l_box_id").alias("lower"), score.alias("score"))
    rank = lambda side, other: F.row_number().over(Window.partitionBy("doc_id", "page", side).orderBy("score", other))
    return p.select("*", rank("upper", "lower").alias("u"), rank("lower", "upper").alias("l")).where("u = 1 and l = 1").drop("u", "l")


def excerpt_windows(texts: DataFrame, key: str, text: str, sizes: tuple[int, ...] = (24, 16, 12, 8, 5)) -> DataFrame:
    """(key, words, excerpt): the first 24, 16, 12, 8 and 5 words; a shorter text once, whole."""
    t = texts.where(F.trim(text) != "").select(key, F.split(folded(F.col(text)), " ").alias("w"))
    n = F.size("w")
    which = F.filter(F.array(*(F.lit(s) for s in sizes)), lambda s: s <= n)
    t = t.select(key, "w", F.explode(F.when(F.size(which) > 0, which).otherwise(F.array(n))).alias("words"))
    return t.select(key, F.col("words").cast("long").alias("words"), F.array_join(F.slice("w", F.lit(1), F.col("words")), " ").alias("excerpt"))


def similar_excerpts(evidences: DataFrame, least: float = 0.7) -> DataFrame:
    """(doc_id, a, b, shared, similarity): two different excerpts of a document with token Jaccard of 0.7 or more, or of which
    one contains the other; a token at least is shared.

    Excerpts are met as representatives (the smallest evidence_id of each folded text), through an equi-join on
    (document, token); tokens have three characters or more.
    """
    e = evidences.distinct().where("trim(original_excerpt) != ''").select(F.lower("doc_id").alias("doc_id"), folded(F.col("original_excerpt")).alias("t"), "evidence_id")
    rep = e.groupBy("doc_id", "t").agg(F.min("evidence_id").alias("id"))
    tokens = F.array_distinct(F.filter(F.split("t", "[^\\p{L}\\p{N}]+"), lambda x: F.length(x) >= 3))
    k = rep.select("doc_id", "id", tokens.alias("ts")).where(F.size("ts") > 0).select("doc_id", "id", F.size("ts").alias("n"), F.explode("ts").alias("token"))
    r = k.select("doc_id", "token", F.col("id").alias("b"), F.col("n").alias("nb"))
    pairs = k.join(r, ["doc_id", "token"]).where("id < b").groupBy("doc_id", F.col("id").alias("a"), "b", "n", "nb").agg(F.count("*").alias("shared"))
    j = F.col("shared") / (F.col("n") + F.col("nb") - F.col("shared"))
    text = rep.select("doc_id", F.col("id").alias("a"), F.col("t").alias("ta"))
    pairs = pairs.join(text, ["doc_id", "a"]).join(text.select("doc_id", F.col("a").alias("b"), F.col("ta").alias("tb")), ["doc_id", "b"])
    return pairs.where((j >= least) | F.contains(F.col("ta"), F.col("tb")) | F.contains(F.col("tb"), F.col("ta"))).select("doc_id", "a", "b", "shared", F.round(j, 4).alias("similarity"))
