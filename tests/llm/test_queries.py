"""The registered queries: SQL where there is some, and a stable shape over the whole small tables."""

import pytest

from lacre.llm import queries

SHAPES = {
    "p1_found": ["doc_id_a", "doc_id_b"], "p2_found": ["src", "rec_id", "phrase_id"], "p4_found": ["code", "doc_id", "group_doc_id"], "p5_found": ["src", "rec_key", "kind", "start_pos"],
    "p6_ids": ["doc_id", "ids"], "p7_containers": ["container_kind", "container_id", "doc_id", "piece", "n_tokens"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_shape(spark, base, name):
    df = queries.QUERIES[name](spark, base)
    assert df.columns == SHAPES[name] and df.count() > 0


def test_groups_equal_sql(spark, base):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"create view findings as select * from '{base}/findings.parquet'")
    want = sorted(c.execute(queries.ORACLES["p4_found"]).fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES["p4_found"](spark, base).collect()) == want
