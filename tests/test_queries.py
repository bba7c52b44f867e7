import pytest
from plumbline.plans import every as Q
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(same, name):
    same(Q.QUERIES[name], Q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_search_takes_every_hundredth_vector(spark, tmp_path, monkeypatch):
    """Ids that start far above 0, copies, and vectors that match nothing, over several blocks, by brute force."""
    import numpy as np
    from plumbline.operators import corpus as C

    monkeypatch.setattr(C, "BLOCK", 100)
    monkeypatch.setattr(C, "HELD", 200)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8))
    x[300:360] = x[0]
    rows = [(1000 + i, [float(v) for v in r], i % 5) for i, r in enumerate(x)] + [(2000, None, 0), (2100, [0.0] * 8, 0), (2200, [1.0, None], 0), (2300, [], 0), (None, [1.0] * 8, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    x = x.astype(np.float32).astype(float)
    u = np.concatenate([x, np.ones((1, 8))])
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    ids, want = [*range(1000, 1900), None], set()
    for i in range(0, 900, 100):
        best = sorted((-round(float(s), 9), -1 if k is None else k) for s, k in zip(u @ u[i], ids) if s > 0.1)[:10]
        want |= {(1000 + i, None if k < 0 else k, n + 1) for n, (_, k) in enumerate(best)}
    for limit in (C.BROADCAST, 0):
        monkeypatch.setattr(C, "BROADCAST", limit)
        got = Q.QUERIES["vector_topk"](spark, str(tmp_path)).collect()
        assert {(r.query_id, r.id, r["rank"]) for r in got} == want and len(got) == len(want) == 90


def test_conflicts_between_orders_of_one_parity(spark, tmp_path):
    for name, sql in {
        "customer": "SELECT 1L AS c_custkey, 'BUILDING' AS c_mktsegment",
        "orders": "SELECT explode(array(2L, 4L, 5L)) AS o_orderkey, 1L AS o_custkey",
        "lineitem": "SELECT explode(array(2L, 4L, 4L)) AS l_orderkey, 7L AS l_partkey, 3L AS l_suppkey, 1 AS l_linenumber, 1.0D * 10 AS l_quantity",
    }.items():
        spark.sql(sql).write.parquet(str(tmp_path / f"{name}.parquet"))
    lines = spark.read.parquet(str(tmp_path / "lineitem.parquet"))
    lines.withColumn("l_quantity", F.when(F.col("l_orderkey") == 2, 10.0).otherwise(20.0)).write.parquet(str(tmp_path / "new"))
    (tmp_path / "lineitem.parquet").rename(tmp_path / "old")
    (tmp_path / "new").rename(tmp_path / "lineitem.parquet")
    got = Q.QUERIES["consistency_conflicts"](spark, str(tmp_path)).collect()
    assert got and {(r.id, r.sheet_a, r.value_a, r.sheet_b, r.value_b) for r in got} == {("7-3", "S-2", 700.0, "S-4", 900.0)}
