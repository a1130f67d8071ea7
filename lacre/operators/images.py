"""Fingerprints of images, logos and matrix codes: building, candidate pairs, comparison, classes and findings.

Occurrences with equal hashes, size and name are one class, so copies meet as representatives: a finding names two classes
(or one class whose members lie in several documents), and members() tells which occurrences a class stands for. Similar
hashes are found by segments (see similarity.hamming_pairs): two 64-bit hashes within three bits share one of four segments.

Defined results: blank hashes are missing ones; a hash that isn't hexadecimal is an error; hashes of other lengths than 64
bits meet by their digest only; the first analysis of a document counts; members of one document are no pair; repeated
rows count once; empty tables give empty results.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacre.operators.barcodes import code_format
from lacre.operators.similarity import similarity_class

HASHES = ("perceptual_hash", "average_hash", "difference_hash")
BITS = 64


def max_distance(bits: int, least_similarity: float) -> int:
    """The most bits that may differ at a similarity; the small addend keeps products like 3.0000 from falling to 2."""
    return floor(bits * (1 - least_similarity) + 1e-12)


def normal_hash(c: Column) -> Column:
    """Trimmed, lower case, null where blank; anything but hexadecimal digits is an error."""
    h = F.lower(F.trim(c))
    return F.when(h == "", None).when(h.rlike("^[0-9a-f]+$"), h).when(h.isNotNull(), F.raise_error(F.concat(F.lit("not a hexadecimal hash: "), h)))


def unpivoted(images: DataFrame, key: str) -> DataFrame:
    """(key, hash_type, value): the hashes of each image as rows, missing ones left out."""
    kinds = {"sha256": "image_hash", "phash": "perceptual_hash", "ahash": "average_hash", "dhash": "difference_hash"}
    pairs = F.array(*(F.struct(F.lit(k).alias("hash_type"), F.col(c).alias("value")) for k, c in kinds.items()))
    return images.select(key, F.inline(pairs)).where("trim(value) != ''")


def assembled(hashes: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Image fingerprints put together from hashes in rows and the images' size and place (the reverse of unpivoted)."""
    one = lambda kind: F.max(F.when(F.col("hash_type") == kind, F.col("value")))
    wide = hashes.groupBy(key).agg(one("sha256").alias("image_hash"), one("phash").alias("perceptual_hash"), one("ahash").alias("average_hash"), one("dhash").alias("difference_hash"))
    return images.select(key, "doc_id", "page", "width", "height").join(wide, key, "left")


def occurrences(fingerprints: DataFrame) -> DataFrame:
    """Fingerprints (doc_id, analysis_pos, seq, hashes, image_hash, width, height) of each document's first analysis, with
    normal hashes; seq orders them by arrival."""
    first = fingerprints.groupBy("doc_id").agg(F.min("analysis_pos").alias("analysis_pos"))
    f = fingerprints.distinct().join(first, ["doc_id", "analysis_pos"])
    return f.withColumns({h: normal_hash(F.col(h)) for h in (*HASHES, "image_hash")})


def _bits(c: str) -> Column:
    return F.when(F.length(c) == BITS // 4, F.conv(c, 16, -10).cast("long"))


def classes(occurrence: DataFrame, *names: str) -> DataFrame:
    """(cls, members, documents, lo, hi, p, a, d, image_hash, width, height, names): cls is the first member's seq; lo and
    hi are the ends of the order of its documents."""
    key = [*HASHES, "image_hash", "width", "height", *names]
    g = occurrence.groupBy(*key).agg(F.min("seq").alias("cls"), F.count("*").alias("members"), F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    return g.withColumns({"p": _bits("perceptual_hash"), "a": _bits("average_hash"), "d": _bits("difference_hash")}).drop(*HASHES)


def members(occurrence: DataFrame, *names: str) -> DataFrame:
    """(cls, seq, doc_id): which occurrences a class stands for."""
    key = [*HASHES, "image_hash", "width", "height", *names]
    first = occurrence.groupBy(*key).agg(F.min("seq").alias("cls"))
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key]
    return occurrence.alias("o").join(first.alias("f"), on).select("f.cls", "o.seq", "o.doc_id")


def candidate_pairs(cls: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs of classes (x, y by arrival) with members in different documents that share a digest or whose perceptual
    hashes differ in few bits, each once."""
    parts = distance + 1
    width = [BITS // parts + (i < BITS % parts) for i in range(parts)]
    starts = [sum(width[:i]) for i in range(parts)]
    cut = lambda c, i: F.shiftrightunsigned(c, starts[i]).bitwiseAND((1 << width[i]) - 1)
    keys = [F.struct(F.lit(i).alias("i"), cut(F.col("p"), i).cast("string").alias("k")) for i in range(parts)]
    every = F.array(*keys, F.when(F.col("image_hash").isNotNull(), F.struct(F.lit(parts).alias("i"), F.col("image_hash").alias("k"))))
    keyed = cls.select("*", F.inline(F.filter(every, lambda x: x["k"].isNotNull())))
    x, y = keyed.alias("x"), keyed.alias("y")
    near = F.bit_count(F.col("x.p").bitwiseXOR(F.col("y.p"))) <= distance
    same = F.coalesce(F.col("x.image_hash") == F.col("y.image_hash"), F.lit(False))
    earlier = [(F.col("x.i") <= k) | (cut(F.col("x.p"), k) != cut(F.col("y.p"), k)) for k in range(parts)]
    first = F.when(F.col("x.i") == parts, ~F.coalesce(near, F.lit(False))).otherwise(near)
    for e in earlier:
        first = first & (F.coalesce(e, F.lit(True)) | (F.col("x.i") == parts))
    across = (F.col("x.lo") != F.col("y.hi")) | (F.col("y.lo") != F.col("x.hi"))
    j = x.join(y, [F.col("x.i") == F.col("y.i"), F.col("x.k") == F.col("y.k"), F.col("x.cls") < F.col("y.cls")]).where(first & across & (near | same))
    kept = [c for c in cls.columns if c not in ("members", "documents", "lo", "hi")]
    return j.select(*(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "xy" for c in kept))


def compared(pairs: DataFrame) -> DataFrame:
    """Adds exact, <p, a, d>_distance and _similarity (null where a hash is missing), same_dimensions and the differences
    of width and height."""
    same = F.coalesce(F.col("image_hash_x") == F.col("image_hash_y"), F.lit(False))
    out = {"exact": same, "same_dimensions": (F.col("width_x") == F.col("width_y")) & (F.col("height_x") == F.col("height_y"))}
    for h in "pad":
        out[f"{h}_distance"] = F.bit_count(F.col(f"{h}_x").bitwiseXOR(F.col(f"{h}_y"))).cast("long")
    df = pairs.withColumns(out)
    df = df.withColumns({f"{h}_similarity": 1 - F.col(f"{h}_distance") / BITS for h in "pad"})
    return df.withColumns({"width_delta": F.abs(F.col("width_x") - F.col("width_y")), "height_delta": F.abs(F.col("height_x") - F.col("height_y"))})


def related(cls: DataFrame, distance: int = 3) -> DataFrame:
    """compared() of all candidate pairs and of each class of several documents with itself, with the class of the match."""
    kept = [c for c in cls.columns if c not in ("members", "documents", "lo", "hi")]
    own = cls.where("documents > 1 and (image_hash is not null or p is not null)").select(*(F.col(c).alias(f"{c}_{s}") for s in "xy" for c in kept))
    df = compared(candidate_pairs(cls, distance).unionByName(own))
    return df.withColumn("match", similarity_class(F.col("p_distance"), BITS, F.col("exact")))


def image_findings(relation: DataFrame, prefix: str = "IMAGE") -> DataFrame:
    """Adds code, severity and confidence; rows without a match are left out."""
    r = relation.where("match in ('EXACT', 'STRONG', 'MODERATE')")
    m = F.col("match")
    code = F.when(m == "EXACT", f"{prefix}_EXACT_MATCH").when(m == "STRONG", f"{prefix}_STRONG_VISUAL_MATCH").otherwise(f"{prefix}_VISUAL_MATCH")
    severity = F.when(m == "EXACT", "INFO").when((m == "STRONG") & F.col("same_dimensions"), "MEDIUM").otherwise("LOW")
    return r.withColumns({"code": code, "severity": severity, "confidence": F.when(m == "EXACT", 1.0).otherwise(F.col("p_similarity"))})


def logo_findings(relation: DataFrame, name: str = "company_name") -> DataFrame:
    """image_findings of logos; two known names that differ (trimmed, in any letter case) override code and severity."""
    f = image_findings(relation, "LOGO")
    key = lambda s: F.lower(F.trim(F.col(f"{name}_{s}")))
    known = (key("x") != "") & (key("y") != "")
    same = F.when(known, key("x") == key("y"))
    f = f.withColumn("same_company_name", same)
    other = F.coalesce(~F.col("same_company_name"), F.lit(False))
    grave = F.when(F.col("match").isin("EXACT", "STRONG"), "HIGH").otherwise("MEDIUM")
    return f.withColumns({"code": F.when(other, "LOGO_COMPANY_NAME_MISMATCH").otherwise(F.col("code")), "severity": F.when(other, grave).otherwise(F.col("severity"))})


def code_fingerprints(barcodes: DataFrame) -> DataFrame:
    """Fingerprints of the matrix codes that have a place: value, image hash, page, box, confidence 1."""
    b = barcodes.distinct().where(code_format(F.col("format")).isin("qr", "qrcode") & F.col("x").isNotNull() & F.col("y").isNotNull())
    return b.select("doc_id", "barcode_index", "page", F.col("content").alias("value"), F.lower(F.trim("image_hash")).alias("image_hash"), "x", "y", "w", "h", F.lit(1.0).alias("confidence"))


def code_findings(fingerprints: DataFrame) -> DataFrame:
    """(code, severity, classification, value, image_hash, documents, linked): matrix codes in different documents.

    EXACT: one value and one image. STRONG (regenerated): one value, several images; MODERATE (changed): one image, several
    values. Equal values and images are each an equivalence, so a group is a row with its documents and the number of
    different images or values it links, instead of all its pairs; groups are counted from partial sums.
    """
    f = fingerprints.select("doc_id", F.lower(F.trim("value")).alias("value"), F.when(F.col("image_hash") != "", F.col("image_hash")).alias("image_hash")).where("value != ''").distinct()

    def across(key: list[str], other: str | None) -> DataFrame:
        linked = F.count_distinct(F.coalesce(other, F.lit(""))) if other else F.lit(1).cast("long")
        g = f.groupBy(*key).agg(F.count_distinct("doc_id").alias("documents"), linked.alias("linked"))
        return g.where("documents > 1") if not other else g.where("documents > 1 and linked > 1")

    rows = (
        (across(["value", "image_hash"], None).where("image_hash is not null"), "QRCODE_EXACT_MATCH", "INFO", "EXACT"),
        (across(["value"], "image_hash").withColumn("image_hash", F.lit(None).cast("string")), "QRCODE_REGENERATED", "LOW", "STRONG"),
        (across(["image_hash"], "value").where("image_hash is not null").withColumn("value", F.lit(None).cast("string")), "QRCODE_VALUE_MISMATCH", "HIGH", "MODERATE"),
    )
    out = None
    for df, code, severity, kind in rows:
        df = df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(kind).alias("classification"), "value", "image_hash", "documents", "linked")
        out = df if out is None else out.unionByName(df)
    return out


def document_fingerprints(digests: DataFrame, images: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc_id, sha256, images, codes): one row for each document with the facets that identify it, lists in order."""
    i = images.groupBy("doc_id").agg(F.sort_array(F.collect_set("image_hash")).alias("images"))
    c = codes.groupBy("doc_id").agg(F.sort_array(F.collect_set("value")).alias("codes"))
    empty = F.array().cast("array<string>")
    j = digests.select("doc_id", "sha256").join(i, "doc_id", "full").join(c, "doc_id", "full")
    return j.select("doc_id", "sha256", F.coalesce("images", empty).alias("images"), F.coalesce("codes", empty).alias("codes"))
