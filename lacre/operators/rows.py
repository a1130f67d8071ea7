"""Visual rows of a page by rules that depend on the order of reading.

Boxes are dealt to partitions by page, sorted there, and read once; only the open rows of the page at hand are kept. Rules
(a box joins a row, or begins one): see RULES.

Defined results: boxes with blank texts take part like others; repeated rows count once; null positions are left out; an
empty table gives an empty result; extra columns are ignored; a page's order is top (or centre), left, id.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: mean: the first row whose mean top lies within 20. first: the first row whose first top lies within 20. anchor: the last
#: row, if its first top lies within four tenths of the height, between 4 and 10 (a missing height is 14). half: the last
#: row, if its first top lies within half of the smaller height. centre: the last row, if its first centre lies within
#: seven tenths of the smaller height, between 6 and 12.
RULES = ("mean", "first", "anchor", "half", "centre")


def grouped(boxes: DataFrame, rule: str) -> DataFrame:
    """boxes(doc_id, page, box_id, box_left, box_top, box_width, box_height) -> (doc_id, page, box_id, row), rows from 0."""
    if rule not in RULES:
        raise ValueError(rule)
    kind = boxes.schema["box_id"].dataType.simpleString()
    at = F.col("box_top") + F.col("box_height") / 2 if rule == "centre" else F.col("box_top").cast("double")
    b = boxes.select(F.lower("doc_id").alias("doc_id"), "page", "box_id", F.col("box_left").cast("double").alias("x"), at.alias("y"), F.col("box_height").cast("double").alias("h")).distinct()
    b = b.where("x is not null and y is not null")

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        page: tuple = ()
        rows: list[list[float]] = []  # of each row: position, height, number of boxes, sum of positions
        for batch in batches:
            out = []
            for doc, number, y, h in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page", "y", "h")), strict=True):
                if (doc, number) != page:
                    page, rows = (doc, number), []
                k = -1
                if rule in ("mean", "first"):
                    k = next((i for i, r in enumerate(rows) if abs(y - (r[3] / r[2] if rule == "mean" else r[0])) <= 20), -1)
                elif rows:
                    r = rows[-1]
                    if rule == "anchor":
                        near = min(10.0, max(4.0, (h or 14.0) * 0.4))
                    else:
                        least = min(h or 0.0, r[1])
                        near = least * 0.5 if rule == "half" else max(6.0, min(12.0, least * 0.7))
                    k = len(rows) - 1 if abs(y - r[0]) <= near else -1
                if k < 0:
                    rows.append([y, h or 0.0, 1, y])
                    k = len(rows) - 1
                else:
                    rows[k][2] += 1
                    rows[k][3] += y
                out.append(k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page"), batch.column("box_id"), pa.array(out, pa.int64())], ["doc_id", "page", "box_id", "row"])

    ordered = b.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "y", "x", "box_id")
    return ordered.mapInArrow(read, f"doc_id string, page int, box_id {kind}, row long")


def segmented(boxes: DataFrame, rows: DataFrame, gap: float) -> DataFrame:
    """Boxes with their row, and the segment of it (from 0): cut where the blank to the box before is wider than gap."""
    b = boxes.withColumn("doc_id", F.lower("doc_id")).join(rows, ["doc_id", "page", "box_id"])
    w = Window.partitionBy("doc_id", "page", "row").orderBy("box_left", "box_id")
    new = F.when(F.col("box_left") - F.lag(F.col("box_left") + F.col("box_width")).over(w) > gap, 1).otherwise(0)
    return b.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")
