"""Fill fixed-capacity containers: vector best-fit over tokens, documents and attention cost.

A container has three capacities: tokens, documents, and attention cost (the sum of squared piece lengths). The document
capacity is a share of the token capacity, the attention capacity a share of its square that several pieces can exceed:
one long piece with a short one costs more attention than pieces of middle length. A piece that alone exceeds the
attention capacity has a container of its own. Full pieces of longer documents are containers by themselves and need no
search. All other pieces, one a document at most, are spread over partitions of bounded size by hash and packed there in
falling order of size; an open container is eligible if the piece fits in every dimension, and the eligible one with the
smallest residual norm is taken, the weighted dot product of demand and residual deciding between equal norms. What
partitioning costs is at most a few containers for each partition of 20,000 pieces.

Defined results: a document above the capacity is cut into full pieces and a rest, any other stays whole; null, empty
and blank texts take part with their tokens (0 for the first two); repeated rows are items of their own; an empty table
gives an empty result; a capacity that is null or under 1 is ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEMS_PER_TASK = 20_000
#: Capacities beside the tokens: one document for each 16 of them, and so much of their square as attention.
TOKENS_PER_DOCUMENT = 16
ATTENTION_SHARE = 0.9
#: Ids of containers that hold one full piece begin here; those of a task's containers are far below.
FULL_FROM = 1 << 62
WEIGHTS = (1.0, 0.01, 0.1)


def best_fit(sizes, capacity: int, max_docs: int, max_attention: float, weights: tuple = WEIGHTS):  # noqa: ANN001, ANN201
    """Containers of pieces given in falling order of size: an array with each piece's container number."""
    import numpy as np

    n = len(sizes)
    where = np.empty(n, np.int64)
    tokens, docs, attention = (np.empty(n) for _ in range(3))
    scale = np.array([w / c for w, c in zip(weights, (capacity, max_docs, max_attention), strict=True)])
    ids = np.empty(n, np.int64)  # open containers, dense; a full one is replaced by the last
    opened = used = 0
    for i, size in enumerate(sizes):
        cost = float(size) * float(size)
        pick = -1
        if opened:
            rest = tokens[:opened] - size
            fits = (rest >= 0) & (docs[:opened] >= 1) & (attention[:opened] >= cost)
            if fits.any():
                norm = (rest * scale[0]) ** 2 + ((docs[:opened] - 1) * scale[1]) ** 2 + ((attention[:opened] - cost) * scale[2]) ** 2
                norm[~fits] = np.inf
                least = norm.min()
                ties = np.flatnonzero(norm == least)
                dot = size * scale[0] * tokens[ties] * scale[0] + scale[1] * docs[ties] * scale[1] + cost * scale[2] * attention[ties] * scale[2]
                pick = int(ties[dot.argmin()])
        if pick < 0:
            pick, ids[opened], tokens[opened], docs[opened], attention[opened] = opened, used, capacity, max_docs, max(max_attention, cost)
            opened += 1
            used += 1
        where[i] = ids[pick]
        tokens[pick] -= size
        docs[pick] -= 1
        attention[pick] -= cost
        if tokens[pick] <= 0 and size > 0 or docs[pick] < 1 or attention[pick] <= 0 and size > 0:
            opened -= 1
            for a in (ids, tokens, docs, attention):
                a[pick] = a[opened]
    return where


def pack(items: DataFrame, containers: DataFrame, items_per_task: int = ITEMS_PER_TASK, tokens_per_document: int = TOKENS_PER_DOCUMENT, attention_share: float = ATTENTION_SHARE) -> DataFrame:
    """items(doc_id, n_tokens), containers(container_kind, capacity_tokens) -> one row for each piece.

    Columns: container_kind, container_id (unique in its kind), doc_id, piece, n_tokens.
    """
    kinds = containers.where("capacity_tokens >= 1").select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    tasks = max(1, -(-items.count() // items_per_task))
    c, n = F.col("capacity"), F.col("n_tokens")
    each = items.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).crossJoin(F.broadcast(kinds))  # containers: a fixed table of three kinds
    whole = F.floor(n / c).cast("int")
    full = each.where(n >= c).select("container_kind", "doc_id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"), c.alias("n_tokens"))
    full = full.select("container_kind", (F.monotonically_increasing_id() + FULL_FROM).alias("container_id"), "doc_id", "piece", "n_tokens")
    rests = each.where((n < c) | (n % c > 0)).select("container_kind", "capacity", "doc_id", whole.alias("piece"), (n % c).alias("n_tokens"))
    rests = rests.withColumn("task", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(tasks)).cast("int"))
    kind = items.schema["doc_id"].dataType.simpleString()

    def fill(key, p):  # noqa: ANN001, ANN202
        import pandas as pd

        p = p.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable")
        cap = int(key[1])
        where = best_fit(p["n_tokens"].to_numpy(), cap, max(1, cap // tokens_per_document), attention_share * cap * cap)
        return pd.DataFrame({"container_kind": key[0], "container_id": where + int(key[2]) * (1 << 32), "doc_id": p["doc_id"], "piece": p["piece"], "n_tokens": p["n_tokens"]})

    packed = rests.groupBy("container_kind", "capacity", "task").applyInPandas(fill, f"container_kind string, container_id long, doc_id {kind}, piece int, n_tokens long")
    return packed.unionByName(full)
