"""Bar codes and payment lines across pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def code_format(c: Column) -> Column:
    """Lower case without hyphens, underscores and blanks."""
    return F.regexp_replace(F.lower(F.trim(c)), "[-_ ]", "")


def code_kind(c: Column) -> Column:
    f = code_format(c)
    return F.when(f.contains("itf"), "itf").when(f.contains("qr"), "qr_code").when(f.contains("code39"), "code_39").otherwise("others")


def is_payment_code(form: Column, content: Column) -> Column:
    """Interleaved codes whose content has 44 digits."""
    f = F.regexp_replace(code_format(form), r"^.*\.", "")
    return (f.isin("itf", "interleaved2of5", "i2of5") | f.startswith("itf")) & (F.length(F.regexp_replace(content, "[^0-9]", "")) == 44)


def grouped(barcodes: DataFrame) -> DataFrame:
    """(doc_id, kind, codes, contents): blank contents are dropped; contents in order, separated by a bar."""
    b = barcodes.where("trim(content) != ''").withColumn("kind", code_kind(F.col("format")))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("barcode_index", "content"))), lambda x: x["content"])
    return b.groupBy("doc_id", "kind").agg(F.count("*").alias("codes"), F.array_join(listed, "|").alias("contents"))


def page_matches(lines: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Validated lines (line_id, doc_id, page, status, barcode) against the payment codes of their page -> line_id, result.

    MATCH and MISMATCH need a valid line and exactly one distinct payment code on its page; all else is INCONCLUSIVE.
    Codes are reduced to one row a page first, so no page's codes meet all its lines.
    """
    codes = barcodes.where(is_payment_code(F.col("format"), F.col("content"))).groupBy("doc_id", "page").agg(F.min("content").alias("_lo"), F.max("content").alias("_hi"))
    j = lines.join(codes, ["doc_id", "page"], "left")
    result = F.when((F.col("status") != "VALID") | F.col("_lo").isNull() | (F.col("_lo") != F.col("_hi")), "INCONCLUSIVE").when(F.col("barcode") == F.col("_lo"), "MATCH").otherwise("MISMATCH")
    return j.select("line_id", F.coalesce(result, F.lit("INCONCLUSIVE")).alias("result"))


def line_signatures(lines: DataFrame) -> DataFrame:
    """(doc_id, signature): the distinct lines of each document, sorted."""
    return lines.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("line")), "|").alias("signature"))


def shared_codes(barcodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Codes in two documents or more: content, documents, with_lines, signatures, divergent (two signatures or more)."""
    c = barcodes.where(code_format(F.col("format")).contains("itf")).select(F.regexp_replace("content", r"[^\p{L}\p{N}]", "").alias("content"), "doc_id").where("content != ''").distinct()
    j = c.join(line_signatures(lines), "doc_id", "left")
    g = j.groupBy("content").agg(F.count("*").alias("documents"), F.count("signature").alias("with_lines"), F.count_distinct("signature").alias("signatures"))
    return g.where("documents >= 2").withColumn("divergent", (F.col("with_lines") >= 2) & (F.col("signatures") >= 2))
