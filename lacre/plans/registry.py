"""Extension points: readers, detectors and comparators are functions over tables, run together and measured.

A reader makes a table of a source, a text detector makes evidence rows of keyed texts, a document detector evidence rows of
named tables, a comparator findings across documents. All are registered by name, unique in any letter case, and run in
order of registration as one plan, so shared scans are reused.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Takes a session and a source (a path, a pattern), returns rows.
Reader = Callable[[SparkSession, str], DataFrame]
#: Takes texts (key, text, page, source), returns evidence (key, code, confidence ...).
TextDetector = Callable[[DataFrame], DataFrame]
#: Takes named tables, returns evidence (doc_id, code, severity, confidence ...).
DocumentDetector = Callable[[dict[str, DataFrame]], DataFrame]

#: Takes named tables, returns findings (code, severity, confidence, doc_id ...).
Comparator = Callable[[dict[str, DataFrame]], DataFrame]


@dataclass
class Named:
    """Functions of one kind by name, in order of registration; names are unique in any letter case."""

    members: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str, member: Callable) -> None:
        if not name.strip():
            raise ValueError("a name is needed")
        if name.lower() in {n.lower() for n in self.members}:
            raise ValueError(f"{name} is registered already")
        self.members[name] = member

    def get(self, name: str) -> Callable:
        for n, m in self.members.items():
            if n.lower() == name.lower():
                return m
        raise KeyError(name)

    def union(self, given, tag: str) -> DataFrame:  # noqa: ANN001
        """What all members make of the same input, tagged with their names."""
        if not self.members:
            raise ValueError("nothing is registered")
        out = None
        for name, make in self.members.items():
            df = make(given).withColumn(tag, F.lit(name))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out


@dataclass
class Engine:
    """Comparators in order of registration; names are unique in any letter case."""

    comparators: dict[str, Comparator] = field(default_factory=dict)

    def register(self, name: str, comparator: Comparator) -> None:
        if name.lower() in {n.lower() for n in self.comparators}:
            raise ValueError(f"{name} is registered already")
        self.comparators[name] = comparator

    def findings(self, tables: dict[str, DataFrame]) -> DataFrame:
        """All comparators' findings, tagged with their comparator; one plan, so shared scans are reused."""
        out = None
        for name, compare in self.comparators.items():
            df = compare(tables).withColumn("comparator", F.lit(name))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        if out is None:
            raise ValueError("nothing is registered")
        return out

    def run(self, tables: dict[str, DataFrame], folder: str) -> dict[str, float]:
        """Writes the findings and returns how many there are, by how many comparators, in how many milliseconds."""
        seen, began = Observation("findings"), time.perf_counter()
        self.findings(tables).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(folder)
        return {"comparators": len(self.comparators), "findings": seen.get["n"], "milliseconds": round((time.perf_counter() - began) * 1000, 1)}
