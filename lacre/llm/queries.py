"""Registered queries of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacre.llm import components, confusables, history, packing, pii, spam, tokens
from lacre.plans.oracles import UUID
from lacre.sources.tables import shared_folder, table, written


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return history.found(table(spark, base, "analyses"), table(spark, base, "batch_documents"))


def p1_batches(spark: SparkSession, base: str) -> DataFrame:
    """The same through the store, in two batches by time of arrival: the second is looked up in the first."""
    a, b = table(spark, base, "analyses"), table(spark, base, "batch_documents")
    arrived = history.arrivals(b)
    cut = arrived.agg(F.percentile_approx("ts", 0.9).alias("cut"))
    late = written(arrived.crossJoin(F.broadcast(cut)).select("doc_id", (F.col("ts") > F.col("cut")).alias("late")), "arrivals")  # one row
    store = history.HistoryStore(spark, f"{shared_folder(spark)}/history-{uuid.uuid4().hex}")
    key = F.lower(F.trim("doc_id"))
    out = None
    for second in (False, True):
        ids = late.where(F.col("late") == second).select("doc_id")
        mine = a.withColumn("_k", key).join(ids.withColumnRenamed("doc_id", "_k"), "_k", "left_semi").drop("_k")
        got = store.add(mine, b.withColumn("_k", key).join(ids.withColumnRenamed("doc_id", "_k"), "_k", "left_semi").drop("_k"))
        out = got if out is None else out.unionByName(got)
    return out.distinct()


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return confusables.found(*(table(spark, base, t) for t in ("spans", "evidences", "phrases")))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return components.found(table(spark, base, "findings"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return pii.found(*(table(spark, base, t) for t in ("analyses", "boxes", "name_lexicon")))


def p5_replaced(spark: SparkSession, base: str) -> DataFrame:
    """The texts with placeholders; the key is a parameter of the operator, this one is for the test tables."""
    texts = pii.records(table(spark, base, "analyses"), table(spark, base, "boxes"))
    return pii.replaced(texts, pii.lexicon(table(spark, base, "name_lexicon")), b"key of the test tables")


def p6_ids(spark: SparkSession, base: str) -> DataFrame:
    return tokens.encode(table(spark, base, "documents"), tokens.vocabulary("byte_bpe_50k"))


def p7_containers(spark: SparkSession, base: str) -> DataFrame:
    sizes = written(tokens.count(table(spark, base, "documents"), tokens.vocabulary("byte_bpe_50k")), "token-counts")
    return packing.pack(sizes, table(spark, base, "containers"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return spam.found(table(spark, base, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_batches, p2_found, p4_found, p5_found, p5_replaced, p6_ids, p7_containers, p8_found)
}
ORACLES: dict[str, str] = {
    "p4_found": f"""with recursive n as (select upper(trim(code)) code, list_distinct(list_filter(list_transform(doc_ids, lambda x: {UUID}), lambda x: x is not null)) ids from findings),
l as (select distinct code, ids[1] a, unnest(ids[2:]) b from n where length(ids) > 1), e as (select code, a, b from l union select code, b, a from l),
r as (select distinct code, a as doc_id, a as m from e union select e.code, e.b, r.m from r join e on e.code = r.code and e.a = r.doc_id)
select code, doc_id, min(m) as group_doc_id from r group by 1, 2""",
}
