"""Texts of pages and documents put together from spans, and canonical forms of values."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_texts(spans: DataFrame) -> DataFrame:
    """(doc_id, page, text): a page's non-blank spans in order, one to a line."""
    s = spans.distinct().where("trim(text) != ''")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", "span_id", "text"))), lambda x: x["text"])
    return s.groupBy(F.lower("doc_id").alias("doc_id"), "page").agg(F.array_join(lines, "\n").alias("text"))


def document_texts(pages: DataFrame, header: str = "--- Página %d ---") -> DataFrame:
    """(doc_id, pages, characters, text): pages with a header each, a blank line between them."""
    part = F.struct("page", F.concat(F.format_string(header, F.col("page")), F.lit("\n"), "text").alias("t"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), "\n\n")
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), joined.alias("text")).select("doc_id", "pages", F.length("text").cast("long").alias("characters"), "text")


def canonical_trimmed(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


@cache
def case_forms() -> tuple[str, str, dict[str, str]]:
    """Characters whose folded case isn't their lower case: with one character (from, to), and with several."""
    forms = [(c, c.casefold()) for c in map(chr, range(0x80, 0x2000)) if c.casefold() != c.lower()]
    return "".join(c for c, f in forms if len(f) == 1), "".join(f for _, f in forms if len(f) == 1), {c: f for c, f in forms if len(f) > 1}


def canonical_folded(c: Column) -> Column:
    """Trimmed, case folded (sharp s as ss and the like)."""
    source, target, several = case_forms()
    table = F.map_from_arrays(F.array(*map(F.lit, several)), F.array(*map(F.lit, several.values())))
    spelt = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.lower(F.translate(canonical_trimmed(F.when(c.rlike("[" + "".join(several) + "]"), spelt).otherwise(c)), source, target))


@cache
def digit_class() -> str:
    """A pattern's class of all characters that are digits of any script, superscripts and circled ones included."""
    points = [i for i in range(0x110000) if chr(i).isdigit()]
    begins = [i for i, p in enumerate(points) if i == 0 or points[i - 1] != p - 1]
    return "".join(f"\\x{{{points[a]:x}}}-\\x{{{points[b - 1]:x}}}" for a, b in zip(begins, [*begins[1:], len(points)], strict=True))


def canonical_digits(c: Column) -> Column:
    """Digits of any script as they stand; null where there is none."""
    d = F.regexp_replace(c, f"[^{digit_class()}]", "")
    return F.when(d != "", d)


def canonical_compact(c: Column) -> Column:
    k = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return F.when(k != "", k)


def packed_colour(c: Column) -> tuple[Column, Column, Column]:
    """The three channels of 0xRRGGBB, in 0 to 1."""
    return tuple(F.shiftright(c, s).bitwiseAND(255) / 255 for s in (16, 8, 0))


def composite(top: Column, bottom: Column, alpha: Column) -> Column:
    """One channel laid over another."""
    return top * alpha + bottom * (1 - alpha)


def colour_distance(one: tuple[Column, Column, Column], other: tuple[Column, Column, Column]) -> Column:
    """Distance of two colours, 1 between black and white."""
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(one, other, strict=True)), F.lit(0.0)) / 3)
