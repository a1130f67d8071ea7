"""Raw reader output to canonical rows: spans, words, observations of codes, colours, boxes and page sizes.

Defined results: blank font names are "Unknown", sizes of zero or less 1.0, colours that are no integer black; a box whose
right or bottom edge lies before its left or top one is an error; texts that are exactly empty are dropped, blank ones
stay; confidences that are no number are -1; repeated rows count once; empty tables give empty results.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lacre.functions.geometry import Box
from lacre.operators.pages import packed_colour

ITALIC, MONO, BOLD = 2, 8, 16


def composed(c: Column) -> Column:
    """Compatibility forms replaced, accents composed (NFKC)."""

    @pandas_udf("string")
    def nfkc(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFKC")

    return nfkc(c)


def native_spans(raw: DataFrame) -> DataFrame:
    """raw(text, font, size, flags, color, bbox array<double>, ...) -> typed spans; the other columns stay."""
    box = [F.col("bbox")[i] for i in range(4)]
    good = (F.size("bbox") == 4) & (box[0] <= box[2]) & (box[1] <= box[3])
    rgb = packed_colour(F.coalesce(F.col("color"), F.lit(0)))
    flag = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    r = raw.where("text != ''").where(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("a span's box has no area or no four edges")).cast("boolean")))
    return r.withColumns(
        {
            "font_name": F.when(F.trim("font") != "", F.trim("font")).otherwise("Unknown"), "font_size": F.when(F.col("size") > 0, F.col("size")).otherwise(1.0), "bold": flag(BOLD), "italic": flag(ITALIC), "mono": flag(MONO),
            "red": rgb[0], "green": rgb[1], "blue": rgb[2], "box_left": box[0], "box_top": box[1], "box_right": box[2], "box_bottom": box[3],
        }
    ).drop("font", "size", "flags", "color", "bbox")


def flattened(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, blocks array<struct<type, lines array<struct<spans array<...>>>>>) -> one row for each span of the
    text blocks (type 0), with its place; missing blocks, lines and spans are passed over."""
    b = pages.select("doc_id", "page", F.posexplode("blocks").alias("block", "_b")).where("_b.type = 0")
    l = b.select("doc_id", "page", "block", F.posexplode("_b.lines").alias("line", "_l"))
    return l.select("doc_id", "page", "block", "line", F.posexplode("_l.spans").alias("place", "_s")).where("_s is not null").select("doc_id", "page", "block", "line", "place", "_s.*")


def all_pages(counts: DataFrame, spans: DataFrame) -> DataFrame:
    """counts(doc_id, pages), spans(doc_id, page, ...) -> (doc_id, page, spans): every page from 1 on, empty ones too."""
    p = counts.select("doc_id", F.explode(F.sequence(F.lit(1), F.greatest("pages", F.lit(1)))).alias("page"))
    n = spans.groupBy("doc_id", "page").agg(F.count("*").alias("spans"))
    return p.join(n, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("spans", F.lit(0).cast("long")).alias("spans"))


def sized_pages(sizes: DataFrame, spans: DataFrame) -> DataFrame:
    """sizes(doc_id, page, width, height) with the number and least confidence of the page's OCR spans; a span on a page that
    the document doesn't have is an error."""
    n = spans.groupBy("doc_id", "page").agg(F.count("*").alias("spans"), F.min("confidence").alias("confidence"))
    j = sizes.join(n, ["doc_id", "page"], "full")
    return j.where(F.when(F.col("width").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no such page: "), F.col("page").cast("string"))).cast("boolean")))


def parsed_confidence(c: Column) -> Column:
    """Text to a number; what is none is -1."""
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(-1.0))


def word_boxes(words: DataFrame) -> DataFrame:
    """Words with a text and a confidence of 0 or more, geometry as integers."""
    whole = {c: F.col(c).cast("int") for c in ("box_left", "box_top", "box_width", "box_height")}
    return words.where("trim(text) != '' and confidence >= 0").withColumns(whole)


def word_lines(words: DataFrame) -> DataFrame:
    """words(doc_id, page, block, paragraph, line, word, text) -> (doc_id, page, number, text): words in order, lines in order
    of their key."""
    key = ["doc_id", "page", "block", "paragraph", "line"]
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ")
    lines = words.where("trim(text) != ''").groupBy(*key).agg(text.alias("text"))
    return lines.select("doc_id", "page", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("block", "paragraph", "line")).cast("long").alias("number"), "text")


SAME_CODE = 0.45


def merged_observations(observed: DataFrame, overlap: float = SAME_CODE) -> DataFrame:
    """observed(doc_id, page, seq, format, content, x, y, w, h, pass) -> one row for each physical code.

    Observations with one format and trimmed content merge, in order of seq, into the first code of their page that they
    overlap (intersection over the smaller area), or that has no box like themselves. Codes of one page only ever meet each other; the fold runs in the JVM.
    """
    o = observed.distinct().where("trim(content) != ''").withColumn("content", F.trim("content"))
    item = F.struct("seq", "x", "y", "w", "h", "pass")
    g = o.groupBy("doc_id", "page", "format", "content").agg(F.sort_array(F.collect_list(item)).alias("_o"))
    start = F.array().cast("array<struct<seq:bigint,x:double,y:double,w:double,h:double,n:bigint,baseline:boolean,passes:array<string>>>")

    def same(k: Column, x: Column) -> Column:
        one, two = (Box.sized(v["x"], v["y"], v["w"], v["h"]) for v in (k, x))
        bare = k["x"].isNull() & x["x"].isNull()
        return bare | (k["x"].isNotNull() & x["x"].isNotNull() & F.coalesce(one.overlap(two) >= overlap, F.lit(False)))

    def put(kept: Column, x: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: same(k, x)), True)
        own = F.struct(
            x["seq"].alias("seq"), x["x"].alias("x"), x["y"].alias("y"), x["w"].alias("w"), x["h"].alias("h"), F.lit(1).cast("long").alias("n"), (x["pass"] == "baseline").alias("baseline"), F.array(x["pass"]).alias("passes")
        )
        merged = lambda k: F.struct(
            *(k[e].alias(e) for e in ("seq", "x", "y", "w", "h")),
            (k["n"] + 1).alias("n"), (k["baseline"] | (x["pass"] == "baseline")).alias("baseline"), F.array_union(k["passes"], F.array(x["pass"])).alias("passes"),
        )
        return F.when(at == 0, F.concat(kept, F.array(own))).otherwise(F.transform(kept, lambda k, i: F.when(i + 1 == at, merged(k)).otherwise(k)))

    return g.select("doc_id", "page", "format", "content", F.inline(F.aggregate("_o", start, put)))


def numbered_codes(codes: DataFrame) -> DataFrame:
    """Codes with an index from 1 in each document, by page and order of sight."""
    return codes.withColumn("barcode_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "seq")).cast("long"))


def is_short_itf(form: Column, content: Column) -> Column:
    from lacre.operators.barcodes import code_format

    return code_format(form).contains("itf") & (F.length(F.trim(content)) < 44)


def reading_condition(form: Column, content: Column) -> Column:
    """What a reading by itself tells: ITF_44, ITF_OTHER (with its length), QR or DECODED."""
    f = F.regexp_replace(F.lower(form), "[^a-z0-9]", "")
    itf = f.contains("itf") | f.contains("interleaved")
    return F.when(itf & content.rlike("^[0-9]{44}$"), "ITF_44").when(itf, F.concat(F.lit("ITF_OTHER_"), F.length(content))).when(f.contains("qr"), "QR").otherwise("DECODED")


def parsed_colour(c: Column) -> Column:
    """#RRGGBB or #RRGGBBAA, the # optional, as struct<red, green, blue, alpha> in 0 to 1; null for other texts."""
    h = F.regexp_replace(F.trim(c), "^#", "")
    part = lambda i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int") / 255
    alpha = F.when(F.length(h) == 8, part(3)).otherwise(1.0)
    return F.when(h.rlike("^(?:[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$"), F.struct(part(0).alias("red"), part(1).alias("green"), part(2).alias("blue"), alpha.alias("alpha")))


def rescaled(kind: Column, confidence: Column) -> Column:
    """Confidence of a place in 0 to 1: numeric lines are stated in percent (others outside 0 to 100 are dropped), the rest
    as a share, clamped."""
    percent = F.when(confidence.between(0, 100), confidence / 100)
    return F.when(kind == "numeric_line", percent).otherwise(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)))


def band(ratio: Column) -> Column:
    return F.when(ratio >= 0.9, "high").when(ratio >= 0.7, "medium").when(ratio.isNotNull(), "low").otherwise("unknown")


def extreme_pages(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, width, height) -> totals of each document, and its largest and smallest page by area, the first
    of equal ones."""
    area = F.col("width") * F.col("height")
    p = pages.withColumn("area", area)
    return p.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.sum("area").alias("area"), F.avg("area").alias("mean_area"), F.max_by("page", F.struct("area", -F.col("page"))).alias("largest"), F.min_by("page", F.struct("area", "page")).alias("smallest")
    )


def file_hashes(spark, path: str) -> DataFrame:  # noqa: ANN001
    """(path, size_bytes, sha256) of each file under a path; contents are hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def accepted(uploads: DataFrame) -> DataFrame:
    """Uploads with whether they are taken: only names that end in .pdf, in any letter case."""
    return uploads.withColumn("accepted", F.coalesce(F.lower("filename").endswith(".pdf"), F.lit(False)))
