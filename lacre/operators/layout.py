"""Page layout from boxes: rows, columns, ordered text, overlapping boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacre.functions.geometry import Box

#: Horizontal distance from which neighbours on a row belong to different columns.
COLUMN_GAP = 140


def rows(boxes: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Boxes with the number of their visual row on the page: a row ends where the next top lies more than a share of
    the box's height below the one before (gaps and islands over the tops; repeated rows count once)."""
    page = Window.partitionBy("doc_id", "page").orderBy("box_top", "box_left", "box_id")
    b = boxes.distinct().where("trim(text) != ''").withColumn("doc_id", F.lower("doc_id"))
    gap = F.col("box_top") - F.lag("box_top").over(page)
    b = b.withColumn("_new", F.when(gap > tolerance * F.col("box_height"), 1).otherwise(0))
    return b.withColumn("row", F.sum("_new").over(page.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def segments(placed: DataFrame, gap: float = COLUMN_GAP) -> DataFrame:
    """Rows cut into columns where the blank between neighbours is wide: adds segment (from 0)."""
    row = Window.partitionBy("doc_id", "page", "row").orderBy("box_left", "box_id")
    blank = F.col("box_left") - F.lag(F.col("box_left") + F.col("box_width")).over(row)
    s = placed.withColumn("_new", F.when(blank > gap, 1).otherwise(0))
    return s.withColumn("segment", F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def row_texts(cut: DataFrame) -> DataFrame:
    """One row for each segment: its words from left to right, their number and mean confidence."""
    word = F.struct("box_left", "box_id", "text")
    return cut.groupBy("doc_id", "page", "row", "segment").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(word)), lambda x: x["text"]), " ").alias("text"), F.count("*").alias("words"), F.round(F.avg("confidence"), 4).alias("confidence")
    )


def overlapping(boxes: DataFrame, least: float = 0.45, cell: int = 200, grow: int = 0) -> DataFrame:
    """(doc_id, page, a, b, overlap) of each two boxes of a page that, grown on all sides, share the given part of the
    smaller one.

    The join is an equi-join on (document, page, grid cell); a pair is kept in the first cell that both touch, so pages
    with many boxes don't meet in full and no distinct is needed.
    """
    b = boxes.distinct().where("box_width > 0 and box_height > 0")
    b = b.select(F.lower("doc_id").alias("doc_id"), "page", "box_id", *((F.col(f"box_{c}") + g).alias(f"box_{c}") for c, g in (("left", -grow), ("top", -grow), ("width", 2 * grow), ("height", 2 * grow))))
    span = lambda start, size: F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(start) + F.col(size)) / cell))
    keyed = b.select("doc_id", "page", "box_id", "box_left", "box_top", "box_width", "box_height", F.explode(span("box_left", "box_width")).alias("cx")).withColumn("cy", F.explode(span("box_top", "box_height")))
    l, r = keyed.alias("l"), keyed.alias("r")
    box = lambda a: Box.sized(*(F.col(f"{a}.box_{n}") for n in ("left", "top", "width", "height")))
    lead = (F.col("l.cx") == F.greatest(F.floor(F.col("l.box_left") / cell), F.floor(F.col("r.box_left") / cell))) & (F.col("l.cy") == F.greatest(F.floor(F.col("l.box_top") / cell), F.floor(F.col("r.box_top") / cell)))
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("doc_id", "page", "cx", "cy")]
    share = box("l").overlap(box("r"))
    joined = l.join(r, on).where((F.col("l.box_id") < F.col("r.box_id")) & lead & (share >= least))
    return joined.select(F.col("l.doc_id").alias("doc_id"), F.col("l.page").alias("page"), F.col("l.box_id").alias("a"), F.col("r.box_id").alias("b"), F.round(share, 4).alias("overlap"))


def page_totals(spans: DataFrame) -> DataFrame:
    """For each page: spans, characters, words, the box around all text, and the exact median size."""
    s = spans.distinct().where("trim(text) != ''").withColumn("doc_id", F.lower("doc_id"))
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    return s.groupBy("doc_id", "page").agg(
        F.count("*").alias("spans"), F.sum(F.length("text")).alias("characters"), F.sum(F.size(F.split(clean, " "))).alias("words"),
        F.min("box_left").alias("left"), F.min("box_top").alias("top"), F.max("box_right").alias("right"), F.max("box_bottom").alias("bottom"), F.median(F.when(F.col("font_size") > 0, F.col("font_size"))).alias("median_size"),
    )
