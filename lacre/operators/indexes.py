"""Indexes over catalogue elements: keys by canonical forms, routing, memberships, candidate groups, inserts.

An index is a name, the element types it takes and a function from a value to its key; all indexes run in one plan: elements
are joined with the few routes and keyed by each index they match. Adding is a join against what is stored, so a batch is
idempotent: rows with an id that is stored with the same content add nothing, with another content they are conflicts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacre.operators.pages import canonical_compact, canonical_digits, canonical_folded, canonical_trimmed

CONTENT = ("doc_id", "element_type", "subtype", "value", "parent_id", "layer", "page")


@dataclass(frozen=True)
class Index:
    """One index: elements of these (type, subtype) pairs (a subtype of None takes all), keyed by a function of the value."""

    name: str
    routes: tuple[tuple[str, str | None], ...]
    canonical: Callable[[Column], Column] = canonical_trimmed

    def takes(self) -> Column:
        tests = [(F.lower("element_type") == t.lower()) & (F.lit(True) if s is None else F.coalesce(F.lower("subtype") == s.lower(), F.lit(False))) for t, s in self.routes]
        return reduce(lambda a, b: a | b, tests)


@dataclass
class Registry:
    """Indexes by name; names are unique in any letter case, and looked up so."""

    indexes: dict[str, Index] = field(default_factory=dict)

    def register(self, index: Index) -> None:
        if index.name.lower() in self.indexes:
            raise ValueError(f"{index.name} is registered already")
        self.indexes[index.name.lower()] = index

    def get(self, name: str) -> Index:
        if name.lower() not in self.indexes:
            raise KeyError(name)
        return self.indexes[name.lower()]

    def entries(self, elements: DataFrame, names: list[str] | None = None) -> DataFrame:
        """(element_id, doc_id, index, key): each element in every index that takes it and has a key for it; without names
        all indexes, else those named, each once."""
        chosen = list({n.lower(): self.get(n) for n in (names if names is not None else list(self.indexes))}.values())
        if not chosen:
            raise ValueError("no index is asked for")
        made = F.array(*(F.when(i.takes(), F.struct(F.lit(i.name).alias("index"), i.canonical(F.col("value")).alias("key"))) for i in chosen))
        return elements.select("element_id", "doc_id", F.inline(F.filter(made, lambda x: x["key"].isNotNull())))

    def statistics(self, elements: DataFrame) -> DataFrame:
        """(index, elements, documents, keys): what each index holds."""
        return self.entries(elements).groupBy("index").agg(F.count("*").alias("elements"), F.count_distinct("doc_id").alias("documents"), F.count_distinct("key").alias("keys"))


def standard() -> Registry:
    """Indexes for digests, texts, codes and numeric lines."""
    r = Registry()
    r.register(Index("sha256", (("hash", "sha256"),), canonical_folded))
    r.register(Index("text", (("text", None),), canonical_folded))
    r.register(Index("barcode", (("barcode", None),), canonical_compact))
    r.register(Index("numeric_line", (("numeric_line", "normalized"),), canonical_digits))
    r.register(Index("image", (("hash", "phash"), ("hash", "ahash"), ("hash", "dhash")), canonical_folded))
    return r


def candidate_groups(entries: DataFrame) -> DataFrame:
    """(index, key, elements, documents, relations, cross_relations) of the keys that several documents share.

    Counted from partial sums for each document, so a key of a third of all elements is no hot task.
    """
    pairs = lambda n: n * (n - 1) / 2
    per_doc = entries.groupBy("index", "key", "doc_id").agg(F.count("*").alias("n"))
    n = F.sum("n")
    g = per_doc.groupBy("index", "key").agg(n.alias("elements"), F.count("*").alias("documents"), pairs(n).cast("long").alias("relations"), (pairs(n) - F.sum(pairs(F.col("n")))).cast("long").alias("cross_relations"))
    return g.where("documents > 1")


def candidate_totals(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: groups, indexes, distinct elements and documents that take part, relations in sum."""
    part = entries.join(groups.select("index", "key"), ["index", "key"], "left_semi").agg(F.count_distinct("element_id").alias("elements"), F.count_distinct("doc_id").alias("documents"))
    g = groups.agg(F.count("*").alias("groups"), F.count_distinct("index").alias("sources"), F.coalesce(F.sum("relations"), F.lit(0)).alias("relations"))
    return g.crossJoin(F.broadcast(part))  # one row each


def inserted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new that aren't stored: each id once, the first by content order where a batch repeats it."""
    once = new.groupBy("element_id").agg(F.min(F.struct(*CONTENT)).alias("_c")).select("element_id", "_c.*")
    return once.join(stored.select("element_id"), "element_id", "left_anti")


def conflicts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(element_id, contents): ids that come with more than one content, in the batch or against what is stored."""
    every = stored.select("element_id", *CONTENT).unionByName(new.select("element_id", *CONTENT)).join(new.select("element_id").distinct(), "element_id", "left_semi")
    h = F.sha2(F.to_json(F.struct(*CONTENT), {"ignoreNullFields": "false"}), 256)
    return every.select("element_id", h.alias("_h")).groupBy("element_id").agg(F.count_distinct("_h").alias("contents")).where("contents > 1")


def added(stored: DataFrame, new: DataFrame) -> DataFrame:
    """What a batch adds to a catalogue; conflicts are an error. One row for each id that is newly added."""
    bad = conflicts(stored, new).select(F.col("element_id").alias("_bad"))
    j = inserted(stored, new).join(bad, F.col("element_id") == F.col("_bad"), "full")
    return j.where(F.when(F.col("_bad").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("an element with another content is stored: "), F.col("_bad"))).cast("boolean"))).drop("_bad")


def signature_candidates(codes: DataFrame, lines: DataFrame) -> DataFrame:
    """codes(doc_id, content), lines(doc_id, line_index, line, kind) -> shared codes whose documents have different lines:
    content, documents, with_lines, signatures, values (all lines of those documents, each once, in order of first sight).

    A document's signature is its distinct lines in order, concatenated fields left out.
    """
    l = lines.where("coalesce(kind, '') != 'concatenated_fields'").groupBy("doc_id", "line").agg(F.min("line_index").alias("at"))
    s = l.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("lines"))
    s = s.withColumn("signature", F.array_join("lines", "|"))
    c = codes.where("content != ''").select("content", "doc_id").distinct().join(s, "doc_id", "left")
    g = c.groupBy("content").agg(F.count("*").alias("documents"), F.count("signature").alias("with_lines"), F.count_distinct("signature").alias("signatures"))
    g = g.where("documents > 1 and signatures > 1")
    v = c.join(g.select("content"), "content", "left_semi").where("lines is not null").select("content", "doc_id", F.posexplode("lines").alias("at", "line"))
    v = v.groupBy("content", "line").agg(F.min(F.struct("doc_id", "at")).alias("first")).groupBy("content").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "line"))), lambda x: x["line"]), "|").alias("values"))
    return g.join(v, "content")
