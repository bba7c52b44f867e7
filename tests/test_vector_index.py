"""The index of vectors: recall against the exact search, pruned reads, odd vectors, a list of copies."""

import numpy as np
import pytest
from plumbline.operators import corpus as C
from plumbline.operators import vector_index as V
from plumbline.plans import every as Q

ROW = "id long, embedding array<float>, note string"


def found(df):
    return {(r.query_id, r.id): (round(r.similarity, 9), r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_recall(spark, tmp_path, spread):
    """Grouped vectors and nearly unordered ones: 0.9 of the exact matches at least, and no other similarity for any."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    x = (centres[rng.integers(0, 40, 4000)] + spread * rng.normal(size=(4000, 32))).astype(np.float32)
    chunks = spark.createDataFrame([(i, v.tolist(), "n") for i, v in enumerate(x)], ROW)
    queries = chunks.where("id % 100 = 0").selectExpr("id AS query_id", "embedding AS q")
    meta = V.build(chunks, str(tmp_path / "i"))
    got, want = found(V.search(spark, str(tmp_path / "i"), queries, 0.1, 10)), found(C.similar(queries, chunks, 0.1, 10))
    both = set(got) & set(want)
    assert len(both) >= 0.9 * len(want) and all(got[k][0] == want[k][0] for k in both) and len(meta["centres"]) == 63
    if spread < 1:
        assert meta["probes"] < 20
    every = found(V.search(spark, str(tmp_path / "i"), queries, 0.1, 10, probes=63))
    assert every == want


def test_query_of_the_test_table(spark):
    got = {(r.query_id, r.id) for r in Q.QUERIES["vector_index_topk"](spark, "/root/testdata/sf0.01").collect()}
    want = {(r.query_id, r.id) for r in Q.QUERIES["vector_topk"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got & want) >= 0.9 * len(want) > 0


def test_only_wanted_lists_are_read(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(8)[i % 8] * 5 + rng.normal(size=8)).tolist(), "n") for i in range(800)]
    V.build(spark.createDataFrame(rows, ROW), str(tmp_path / "i"), lists=8)
    one = spark.createDataFrame([(1, np.eye(8)[3].tolist())], "query_id long, q array<double>")
    out = V.search(spark, str(tmp_path / "i"), one, 0.1, 10, probes=1)
    assert out.count() == 10
    assert "PartitionFilters: [isnotnull(list" in out._jdf.queryExecution().executedPlan().toString() or "list#" in out._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_little_is_sent_to_the_driver(spark, tmp_path):
    """A build and a search of 40 tasks: about the sample, not a sample of each task, and no query once for each of its lists."""
    rng = np.random.default_rng(6)
    spark.createDataFrame([(i, v.tolist(), "n") for i, v in enumerate(rng.normal(size=(8000, 64)).astype(np.float32))], ROW).repartition(40).write.parquet(str(tmp_path / "v"))
    chunks = spark.read.parquet(str(tmp_path / "v")).repartition(40)
    store = spark.sparkContext._jsc.sc().statusStore()

    def sent():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).resultSize() for i in range(stages.size()))

    before = sent()
    V.build(chunks, str(tmp_path / "i"), sample=256)
    assert sent() - before < 2_500_000
    out = V.search(spark, str(tmp_path / "i"), chunks.where("id % 4 = 0").selectExpr("id AS query_id", "embedding AS q"), 0.1, 10, probes=12)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 20_000


def test_odd_vectors(spark, tmp_path, monkeypatch):
    """Nulls, zeros, infinities, other lengths, copies beyond a block, and nothing at all."""
    monkeypatch.setattr(C, "BLOCK", 16)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).tolist(), "n") for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0, 4.0], "copy") for i in range(90)]
    rows += [(300, None, "n"), (301, [0.0] * 4, "n"), (302, [1.0, None, 1.0, 1.0], "n"), (303, [float("inf"), 1.0, 1.0, 1.0], "n"), (304, [1.0, 2.0], "n"), (305, [], "n"), (None, [4.0, 3.0, 2.0, 1.0], None), (306, [float("nan"), 1.0, 1.0, 1.0], "n")]
    chunks = spark.createDataFrame(rows, ROW)
    queries = chunks.where("id % 50 = 0 OR id > 300 OR id IS NULL").selectExpr("id AS query_id", "embedding AS q")
    V.build(chunks, str(tmp_path / "i"), lists=5)
    got, want = found(V.search(spark, str(tmp_path / "i"), queries, 0.2, 12, probes=5)), found(C.similar(queries, chunks, 0.2, 12))
    assert str(sorted(got.items(), key=str)) == str(sorted(want.items(), key=str)) and len(got) > 30
    none = chunks.limit(0)
    V.build(none, str(tmp_path / "none"))
    assert V.search(spark, str(tmp_path / "none"), queries).count() == 0 and V.search(spark, str(tmp_path / "i"), queries.limit(0)).count() == 0
