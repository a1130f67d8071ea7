"""Timelines of dated evidence and what contradicts itself in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacre.functions.once import step

#: Days a document's dates may span, and metadata may lie from the content.
RANGE_DAYS = 3650


def extracted(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, raw, value): dd/MM/yyyy, dd-MM-yyyy and dd.MM.yyyy in a text; impossible dates and mixed marks are dropped."""
    found = texts.where(F.col(text).isNotNull()).select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\b(\d{2}[/.-]\d{2}[/.-]\d{4})\b"), F.lit(1))).alias("raw"))
    mark = F.substring("raw", 3, 1)
    value = F.try_to_date(F.concat(F.substring("raw", 7, 4), F.lit("-"), F.substring("raw", 4, 2), F.lit("-"), F.substring("raw", 1, 2)), "yyyy-MM-dd")
    return found.where(mark == F.substring("raw", 6, 1)).select(key, "raw", value.alias("value")).where("value is not null")


def timelines(dates: DataFrame) -> DataFrame:
    """dates(doc_id, source, value, metadata_field) -> extents of each document; rows without a value don't count.

    divergence: the most days between a metadata date and a content date; it lies between opposite ends of the two extents,
    so no pairs are made.
    """
    far = lambda a, b: F.abs(F.date_diff(a, b))
    apart = F.greatest(far("_hi", "first_content"), far("_lo", "last_content")).cast("long")
    d = dates.where("value is not null")
    content = F.col("source").isin("native_text", "ocr")
    when = lambda c: F.when(c, F.col("value"))
    return d.groupBy("doc_id").agg(
        F.count("*").alias("dates"), F.count_distinct("value").alias("days"), F.min("value").alias("first"), F.max("value").alias("last"),
        F.min(when(content)).alias("first_content"), F.max(when(content)).alias("last_content"),
        F.min(when(F.col("metadata_field") == "creationDate")).alias("created"), F.min(when(F.col("metadata_field") == "modDate")).alias("modified"),
        F.min(when(F.col("source") == "pdf_metadata")).alias("_lo"), F.max(when(F.col("source") == "pdf_metadata")).alias("_hi"),
    ).withColumn("divergence", apart).drop("_lo", "_hi")


def anomalies(lines: DataFrame, reference: Column) -> DataFrame:
    """(doc_id, code, severity, days): modified before created, dates after the reference, wide range, far metadata."""
    checks = (
        ("METADATA_ORDER", "HIGH", F.col("modified") < F.col("created"), F.date_diff("created", "modified")),
        ("FUTURE_DATE", "MEDIUM", F.col("last") > reference, F.date_diff("last", reference)),
        ("WIDE_RANGE", "LOW", F.date_diff("last", "first") > RANGE_DAYS, F.date_diff("last", "first")),
        ("METADATA_DIVERGENCE", "MEDIUM", F.col("divergence") > RANGE_DAYS, F.col("divergence")),
    )
    rows = F.array(*(F.when(test, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), n.cast("long").alias("days"))) for c, s, test, n in checks))
    return lines.select("doc_id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.code", "x.severity", "x.days")


def future_dates(dates: DataFrame, reference: Column) -> DataFrame:
    """(doc_id, occurrences, values, pages, confidence): a document's dates after the reference, distinct ones in order, and
    the least confidence among them (a missing one counts as 0)."""
    d = dates.where(F.col("value") > reference)
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_set(c)), lambda x: x.cast("string")), ",")
    return d.groupBy("doc_id").agg(F.count("*").alias("occurrences"), listed("value").alias("values"), listed("page").alias("pages"), F.min(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def ordered(dates: DataFrame) -> DataFrame:
    """Dates with their place in the document's timeline: value, page (none first), source, field, raw text."""
    w = Window.partitionBy("doc_id").orderBy("value", F.coalesce("page", F.lit(-1)), "source", F.coalesce("metadata_field", F.lit("")), "raw", "date_id")
    return dates.where("value is not null").withColumn("place", F.row_number().over(w).cast("long"))


def context(texts: DataFrame, key: str, text: str, radius: int = 40) -> DataFrame:
    """(key, start, raw, around): dates of a text with the characters around them, blanks at the ends taken away.

    A text is cut at its dates once; the place of each is the length of what lies before it.
    """
    pattern = r"\b\d{2}[/.-]\d{2}[/.-]\d{4}\b"
    t = step(texts.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text")), _parts=F.split("_text", pattern, -1))
    before = lambda i: F.aggregate(F.slice("_parts", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
    starts = F.transform(F.sequence(F.lit(1), F.size("_parts") - 1), lambda i: before(i) + (i - 1) * 10)
    s = t.where(F.size("_parts") > 1).select(key, "_text", F.explode(starts).alias("start"))
    left = F.greatest(F.col("start") - radius, F.lit(0))
    around = F.trim(F.substr("_text", left + 1, F.col("start") + 10 + radius - left))
    return s.select(key, "start", F.substr("_text", F.col("start") + 1, F.lit(10)).alias("raw"), F.regexp_replace(around, r"^\s+|\s+$", "").alias("around"))


#: Notations of days that are tried one after the other where a text isn't a PDF date.
COMMON = (("^(\\d{1,2})/(\\d{1,2})/(\\d{4})$", (3, 2, 1)), ("^(\\d{4})-(\\d{1,2})-(\\d{1,2})$", (1, 2, 3)), ("^(\\d{1,2})-(\\d{1,2})-(\\d{4})$", (3, 2, 1)), ("^(\\d{4})/(\\d{1,2})/(\\d{1,2})$", (1, 2, 3)), ("^(\\d{1,2})\\.(\\d{1,2})\\.(\\d{4})$", (3, 2, 1)))


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def pdf_day(c: Column) -> Column:
    """The day of a PDF date (D: optional, 4 to 14 digits, then nothing, Z or an offset; its first eight digits), else of the
    common notations; null where neither is a day."""
    t = F.regexp_replace(F.trim(c), "^D:", "")
    digits = F.regexp_extract(t, r"^([0-9]{4,14})(?:Z|[+-].*)?$", 1)
    compact = F.when(F.length(digits) >= 8, _day(F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)))
    common = [F.when(t.rlike(p), _day(*(F.regexp_extract(t, p, i) for i in order))) for p, order in COMMON]
    return F.coalesce(compact, *common)


#: Fixed value: the offset of PDF dates that state none, in minutes.
PDF_OFFSET = -180


def pdf_instant(c: Column) -> Column:
    """Seconds since 1970 UTC of a full PDF date (14 digits) with Z, +hh'mm' or none; null for all else."""
    t = F.regexp_replace(F.trim(c), "^D:", "")
    pattern = r"^([0-9]{14})(?:(Z)|([+-])([0-9]{2})'?([0-9]{2})?'?)?$"
    part = lambda i: F.regexp_extract(t, pattern, i)
    d, sign = part(1), part(3)
    field = lambda a, n: F.substring(d, a, n).try_cast("int")
    day = F.unix_date(_day(F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).cast("long")
    good = field(9, 2).between(0, 23) & field(11, 2).between(0, 59) & field(13, 2).between(0, 59)
    shift = F.coalesce(part(4).try_cast("int"), F.lit(0)) * 60 + F.coalesce(part(5).try_cast("int"), F.lit(0))
    minutes = F.when(part(2) == "Z", 0).when(sign == "+", shift).when(sign == "-", -shift).otherwise(PDF_OFFSET)
    return F.when(good, day * 86400 + field(9, 2) * 3600 + field(11, 2) * 60 + field(13, 2) - minutes * 60)


def metadata_days(metadata: DataFrame) -> DataFrame:
    """metadata(doc_id, creationDate, modDate) -> (doc_id, metadata_field, raw, value): at most two rows a document."""
    pairs = F.array(*(F.struct(F.lit(f).alias("metadata_field"), F.col(f).alias("raw")) for f in ("creationDate", "modDate")))
    m = metadata.select("doc_id", F.inline(pairs))
    return m.withColumn("value", pdf_day(F.col("raw"))).where("value is not null")
