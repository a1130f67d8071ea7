"""Exact duplicate groups and Hamming joins over bit fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_groups(df: DataFrame, key: Column, element: str, document: str | None = None) -> DataFrame:
    """Groups of two or more elements with one key: key, elements, documents, relations, cross_relations.

    Counting is split into partial sums, so a key held by a third of all rows is no hot task; members aren't collected.
    """
    document = document or element
    per_doc = df.select(key.alias("key"), F.col(document).alias("doc"), F.col(element).alias("element")).where("key is not null").groupBy("key", "doc").agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    n = F.sum("n")
    return (
        per_doc.groupBy("key")
        .agg(n.alias("elements"), F.count("*").alias("documents"), pairs(n).cast("long").alias("relations"), (pairs(n) - F.sum(pairs(F.col("n")))).cast("long").alias("cross_relations"))
        .where("elements >= 2")
    )


def group_totals(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.count("*").alias("groups"), F.coalesce(F.sum("elements"), F.lit(0)).alias("elements"), F.coalesce(F.sum("relations"), F.lit(0)).alias("relations"),
        F.coalesce(F.sum((F.col("documents") > 1).cast("long")), F.lit(0)).alias("cross_groups"), F.coalesce(F.sum("cross_relations"), F.lit(0)).alias("cross_relations"),
    )


def pair_space(df: DataFrame, owner: str) -> DataFrame:
    """Pairs of rows with different owners, without making them: (N^2 - sum of squares) / 2."""
    n = df.groupBy(owner).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("owners"))
    return n.select("owners", "rows", ((F.col("rows") * F.col("rows") - F.col("squares")) / 2).cast("long").alias("potential_pairs"))


def sign_bits(vector: Column) -> Column:
    """64 signs of a vector as one long, the first element in the lowest bit."""
    bit = F.transform(F.slice(vector, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bit, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def hamming_pairs(df: DataFrame, element: str, bits: str, distance: int = 3, owner: str | None = None) -> DataFrame:
    """(v, w, distance, n_v, n_w) of each two different values within a Hamming distance, v < w, that stand for elements of
    different owners (of different elements, without an owner; a null owner is one of its own); n: elements of the value.

    Whose values they are is in members(), and values that several elements share are in exact_classes().
    Pigeonhole: the 64 bits are cut into distance + 1 segments, one of which two near values share, so the join is an
    equi-join on (segment number, segment); a pair is kept at the first segment it shares only, which needs no distinct.
    Equal values are joined once for all their elements: copies of one value meet as representatives.
    """
    parts = distance + 1
    base, longer = divmod(64, parts)
    cuts, at = [], 0
    for i in range(parts):
        width = base + (1 if i < longer else 0)
        cuts.append((at, width))
        at += width
    values = _values(df, element, bits, owner)
    segment = lambda c, cut: F.shiftrightunsigned(c, cut[0]).bitwiseAND((1 << cut[1]) - 1 if cut[1] < 64 else -1)
    keyed = values.select("v", "n", "lo", "hi", "ownerless", F.posexplode(F.array(*(segment(F.col("v"), c) for c in cuts))).alias("i", "s"))
    other = keyed.select(F.col("v").alias("w"), F.col("n").alias("n_w"), F.col("lo").alias("lo_w"), F.col("hi").alias("hi_w"), F.col("ownerless").alias("ownerless_w"), "i", "s")
    cross = F.expr("ownerless + ownerless_w > 0 or least(lo, lo_w) != greatest(hi, hi_w)")
    near = keyed.join(other, ["i", "s"]).where((F.col("v") < F.col("w")) & (F.bit_count(F.col("v").bitwiseXOR(F.col("w"))) <= distance))
    first = F.lit(True)
    for k, c in enumerate(cuts[:-1]):
        first = first & ((F.col("i") <= k) | (segment(F.col("v"), c) != segment(F.col("w"), c)))
    return near.where(first & cross).select("v", "w", F.bit_count(F.col("v").bitwiseXOR(F.col("w"))).alias("distance"), F.col("n").alias("n_v"), "n_w")


def _values(df: DataFrame, element: str, bits: str, owner: str | None) -> DataFrame:
    """(v, n, lo, hi, ownerless): a row for each value, with its elements, the range of their owners and those without."""
    return (
        members(df, element, bits, owner).groupBy("v")
        .agg(F.count_distinct("element").alias("n"), F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.sum(F.col("owner").isNull().cast("long")).alias("ownerless"))
    )


def members(df: DataFrame, element: str, bits: str, owner: str | None = None) -> DataFrame:
    """(v, element, owner): which elements each value of hamming_pairs() and exact_classes() stands for."""
    return df.where(F.col(bits).isNotNull()).select(F.col(bits).alias("v"), F.col(element).alias("element"), F.col(owner or element).alias("owner")).distinct()


def exact_classes(df: DataFrame, element: str, bits: str, owner: str | None = None) -> DataFrame:
    """(v, w, distance, n_v, n_w) of the values that elements of different owners share: v = w, distance 0."""
    shared = _values(df, element, bits, owner).where("n >= 2 and (ownerless > 0 or lo != hi)")
    return shared.select("v", F.col("v").alias("w"), F.lit(0).alias("distance"), F.col("n").alias("n_v"), F.col("n").alias("n_w"))


def similarity_class(distance: Column, bits: int, exact: Column) -> Column:
    """EXACT, STRONG (0.98 and more), MODERATE (0.95 and more) or NONE."""
    s = 1 - distance / bits
    return F.when(exact, "EXACT").when(s >= 0.98, "STRONG").when(s >= 0.95, "MODERATE").otherwise("NONE")


def identifier_matches(observations: DataFrame) -> DataFrame:
    """observations(kind, value, doc_id) -> kind, relation, value_a, value_b, documents.

    EXACT: one value in two documents or more. ONE_DIGIT: two values of one length that differ at one place, found by an
    equi-join on the value with that place masked, in buckets of exactly two values. TRANSPOSITION: two neighbours swapped.
    """
    obs = observations.where("value is not null and kind is not null").groupBy("kind", "value").agg(F.count_distinct("doc_id").alias("docs"))
    exact = obs.where("docs >= 2").select("kind", F.lit("EXACT").alias("relation"), F.col("value").alias("value_a"), F.col("value").alias("value_b"), F.col("docs").alias("documents"))
    places = F.sequence(F.lit(1), F.length("value"))
    masks = F.transform(places, lambda i: F.concat(F.substr("value", F.lit(1), i - 1), F.lit("*"), F.substr(F.col("value"), i + 1)))
    masked = obs.select("kind", "value", "docs", F.explode(masks).alias("mask"))
    one = masked.groupBy("kind", "mask").agg(F.count("*").alias("n"), F.min("value").alias("value_a"), F.max("value").alias("value_b"), F.sum("docs").alias("documents")).where("n = 2")
    one = one.select("kind", F.lit("ONE_DIGIT").alias("relation"), "value_a", "value_b", "documents")
    swap = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.concat(F.substr("value", F.lit(1), i - 1), F.substr(F.col("value"), i + 1, F.lit(1)), F.substr(F.col("value"), i, F.lit(1)), F.substr(F.col("value"), i + 2)))
    swapped = obs.where(F.length("value") >= 2).select("kind", F.col("value").alias("value_a"), F.col("docs").alias("da"), F.explode(F.array_distinct(swap)).alias("value"))
    swapped = swapped.where("value_a < value").join(obs.select("kind", "value", F.col("docs").alias("db")), ["kind", "value"])
    swapped = swapped.select("kind", F.lit("TRANSPOSITION").alias("relation"), "value_a", F.col("value").alias("value_b"), (F.col("da") + F.col("db")).alias("documents"))
    return exact.unionByName(one).unionByName(swapped)
