"""Consolidate pairwise links into groups: union-find in edge partitions, forests merged level by level.

Level: the edges are spread over partitions of bounded size; each partition runs union-find and keeps only its spanning
forest as stars (member -> smallest member). A member then has at most one parent for each partition that saw it; the
smallest becomes its parent for good, every other parent becomes an edge between two parents. Parents are resolved to
roots by pointer doubling, so the next level's edges join roots only: at most half of this level's nodes are left, the
number of partitions falls with them, and the levels end when no edge is left. A group of a third of all records is no
hot key: edges are spread by a hash of both ends, so a hub's edges are dealt over all partitions whichever end it is, and
stars are spread by member, not by root.

Defined results: null or blank members are no links; a link of a member with itself, or a list that names one member
only, makes no group; repeated links count once; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacre.sources.tables import written

#: Edges of one union-find task: some 100 bytes each in Python, so well under an executor's memory.
EDGES_PER_TASK = 400_000


def forest(edges: DataFrame) -> DataFrame:
    """(space, a, b) -> stars (space, node, parent) of each partition; parent is the smallest node of the local tree."""

    def stars(batches: Iterator) -> Iterator:
        import pandas as pd

        number: dict = {}
        names: list = []
        up: list[int] = []

        def node(key: tuple) -> int:
            i = number.get(key)
            if i is None:
                i = number[key] = len(names)
                names.append(key)
                up.append(i)
            return i

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        for batch in batches:
            for space, a, b in zip(batch["space"], batch["a"], batch["b"], strict=True):
                x, y = root(node((space, a))), root(node((space, b)))
                if x != y:
                    if names[y] < names[x]:
                        x, y = y, x
                    up[y] = x
        rows = [(*names[i], names[r][1]) for i in range(len(names)) if (r := root(i)) != i]
        for k in range(0, len(rows), 50_000):
            yield pd.DataFrame(rows[k : k + 50_000], columns=["space", "node", "parent"])

    return edges.select("space", "a", "b").mapInPandas(stars, "space string, node string, parent string")


def _resolve(parents: DataFrame) -> DataFrame:
    """(space, node, parent) with one parent for each node -> the same with the root as parent, by pointer doubling."""
    while True:
        p = parents.alias("p")
        q = parents.select("space", F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = written(p.join(q, ["space", "parent"], "left").select("space", "node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")), "jump")
        parents = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return parents


def components(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(space, a, b) -> (space, node, root) for every node of an edge between two nodes; root is the smallest node."""
    e = edges.where("a is not null and b is not null and a != b and space is not null").select("space", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    levels: list[DataFrame] = []
    while (n := e.count()) > 0:
        tasks = max(1, -(-n // edges_per_task))
        stars = written(forest(e.repartition(tasks, "space", "a", "b") if tasks > 1 else e.coalesce(1)), "forest")
        if tasks == 1:  # one partition saw every edge: its forest is final
            levels.append(stars)
            break
        best = stars.groupBy("space", "node").agg(F.collect_set("parent").alias("parents"))  # at most one for each task
        best = written(best.select("space", "node", F.array_min("parents").alias("parent"), F.array_except("parents", F.array(F.array_min("parents"))).alias("others")), "parents")
        top = _resolve(best.drop("others"))
        levels.append(top)
        link = best.select("space", F.col("parent").alias("a"), F.explode("others").alias("b"))
        for side in ("a", "b"):
            r = top.select("space", F.col("node").alias(side), F.col("parent").alias("_r"))
            link = link.join(r, ["space", side], "left").withColumn(side, F.coalesce("_r", side)).drop("_r")
        e = written(link.where("a != b").select("space", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not levels:
        return e.select("space", F.col("a").alias("node"), F.col("b").alias("root"))
    out = levels[0]
    for level in levels[1:]:
        r = level.select("space", F.col("node").alias("parent"), F.col("parent").alias("_r"))
        out = out.join(r, ["space", "parent"], "left").select("space", "node", F.coalesce("_r", "parent").alias("parent")).unionByName(level)
    out = out.distinct() if len(levels) > 1 else out
    roots = out.select("space", F.col("parent").alias("node"), "parent").distinct()
    return out.unionByName(roots).select("space", "node", F.col("parent").alias("root")).distinct()


def uuid_key(c: Column) -> Column:
    """One notation for a UUID: lower case with hyphens; null where it isn't one."""
    h = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "^urn:uuid:", ""), r"[{}\s-]", "")
    return F.when(h.rlike("^[0-9a-f]{32}$"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def finding_links(findings: DataFrame) -> DataFrame:
    """findings -> (space, a, b): the first document of each list with each other one; the lists' length is no bound."""
    ids = F.array_distinct(F.filter(F.transform("doc_ids", uuid_key), lambda x: x.isNotNull()))
    f = findings.select(F.upper(F.trim("code")).alias("space"), ids.alias("ids")).where("size(ids) > 1 and space is not null")
    return f.select("space", F.col("ids")[0].alias("a"), F.explode(F.slice("ids", 2, F.size("ids"))).alias("b"))


def found(findings: DataFrame) -> DataFrame:
    c = components(finding_links(findings))
    return c.select(F.col("space").alias("code"), F.col("node").alias("doc_id"), F.col("root").alias("group_doc_id"))
