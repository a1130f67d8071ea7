"""Report sheets written to a folder, and the audit of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Fixed value: characters that a workbook cannot hold.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
LONGEST_CELL = 2000


def clean_cell(c: Column, most: int = LONGEST_CELL) -> Column:
    """A financial text: control characters out, cut at a length, an apostrophe before a formula sign (blanks before it
    don't count). Only the cell is cut, the data stay as they are."""
    t = F.substring(F.regexp_replace(c, CONTROL, ""), 1, most)
    return F.when(t.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), t)).otherwise(t)


def visible_cell(c: Column) -> Column:
    """Control characters written as \\xNN, so that a report shows them; all else stays."""
    spelt = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x.rlike(CONTROL), F.concat(F.lit("\\x"), F.lpad(F.hex(F.ascii(x)), 2, "0"))).otherwise(x)), "")
    return F.when(c.rlike(CONTROL), spelt).otherwise(c)


def json_text(c: Column, kind: str) -> Column:
    """A value as text: null, empty texts and empty collections as an empty one, texts as they are, all else as JSON."""
    if kind == "string":
        return F.coalesce(c, F.lit(""))
    if kind.startswith(("array", "map")):
        return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.to_json(c)).otherwise("")
    return F.coalesce(F.to_json(c), F.lit("")) if kind.startswith("struct") else F.coalesce(c.cast("string"), F.lit(""))


def as_sheet(df: DataFrame) -> DataFrame:
    """Flat columns with control characters made visible; arrays, maps and structs as JSON."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith(("array", "map", "struct")):
            c = json_text(c, kind)
        out.append((visible_cell(c.cast("string")) if kind == "string" or kind.startswith(("array", "map", "struct")) else c).alias(name))
    return df.select(*out)


def write_sheets(sheets: dict[str, DataFrame], folder: str, form: str = "parquet") -> dict[str, int]:
    """One sub-folder for each sheet; the rows of each, counted while they are written."""
    from pyspark.sql import Observation

    counts = {}
    for name, df in sheets.items():
        seen = Observation(name)
        writer = as_sheet(df).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
        (writer.option("header", True).csv if form == "csv" else writer.parquet)(f"{folder.rstrip('/')}/{name}")
        counts[name] = seen.get["rows"]
    return counts


def audited(exported: DataFrame, files: DataFrame) -> DataFrame:
    """exported(doc_id, sha) against files(doc_id, sha) -> status of each exported row: MISSING_PDF, HASH_MISMATCH,
    INSPECTION_FAILED (a file without a digest) or INSPECTED_HASH_VERIFIED."""
    f = files.groupBy("doc_id").agg(F.max("sha").alias("_sha")).withColumn("_there", F.lit(True))
    status = F.when(F.col("_there").isNull(), "MISSING_PDF").when(F.coalesce("_sha", F.lit("")) == "", "INSPECTION_FAILED").when(F.col("sha") == F.col("_sha"), "INSPECTED_HASH_VERIFIED").otherwise("HASH_MISMATCH")
    return exported.join(f, "doc_id", "left").select("doc_id", status.alias("status"))
