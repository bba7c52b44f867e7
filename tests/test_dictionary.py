"""The dictionary: words that hold a text, by brute force; long words; stored postings; citations of every kind."""

import random
import re
import time

import pytest
from plumbline.functions import text as X
from plumbline.operators import corpus as C
from plumbline.operators import dictionary as D
from pyspark.sql import functions as F

CHUNK = "id long, section_id string, section_title string, content string"


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        words = ["".join(rng.choice("abcd1") for _ in range(rng.choice([1, 2, 3, 4, 5, 9]))) for _ in range(rng.randint(0, 25))]
        rows.append((i, f"{rng.choice('39')}.{i}", rng.choice([None, "", "ABCD title"]), "".join(w + rng.choice([" ", "-", "  ", "\n", "é"]) for w in words)))
    long = "".join(rng.choice("abcd") for _ in range(3000))
    return [*rows, (None, "9.1", None, "abcd"), (500, "9.2", None, None), (501, None, "t", "x" + long + " y"), (502, "3.9", None, long[100:700].upper())], long


def searched(queries, rows, limit, prefix=None):
    """{query: ids}, nulls first."""
    out = {}
    for q, text in queries:
        terms = [t for t in dict.fromkeys(re.split("[^a-z0-9]+", (text or "").lower())) if len(t) >= 4 and t not in X.STOP_WORDS][:4]
        ids = {i for i, s, t, c in rows if (prefix is None or (s or "").startswith(prefix)) and any(w in ((c or "") + "\n" + (t or "")).lower() for w in terms)}
        out[q] = sorted(ids, key=lambda i: (i is not None, i))[:limit]
    return {q: ids for q, ids in out.items() if ids}


@pytest.mark.parametrize("few", [200_000, 0])
def test_keyword_search_brute_force(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(D, "FEW", few)
    monkeypatch.setattr(D, "BUCKETS", 5)
    rows, long = corpus(few)
    queries = [(1, "abcd bcda x"), (2, "the 1111"), (3, long[50:178]), (4, long[200:700]), (5, long[200:600] + "d" + long[600:650]), (6, None), (7, "zzzz"), (8, "ABCD1 title dddd cccc bbbb"), (9, long[2990:])]
    chunks, asked = spark.createDataFrame(rows, CHUNK).repartition(3), spark.createDataFrame(queries, "query_id long, query string")
    index = str(tmp_path / "index")
    C.keyword_index(chunks, index)
    for prefix in (None, "9."):
        want = searched(queries, rows, 7, prefix)
        for where in (None, index):
            got = {}
            for r in C.keyword_search(asked, chunks, 7, prefix, where).orderBy("rank").collect():
                got.setdefault(r.query_id, []).append(r.id)
            assert got == want
    C.keyword_index(chunks.limit(0), index + "-none")
    assert C.keyword_search(asked, chunks.limit(0), 7, index=index + "-none").count() == 0
    assert C.keyword_search(asked.limit(0), chunks, 7).count() == 0 and C.keyword_search(asked, chunks.limit(0), 7).count() == 0


@pytest.mark.parametrize("few", [200_000, 0])
def test_cited_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(D, "FEW", few)
    rows, long = corpus(7)
    docs = spark.createDataFrame([(c,) for *_, c in rows] + [("See 9.8.4.1 of the\tCode",), ("19.8.4.12",)], "body string").withColumn("found", F.lit(1))
    texts = ["9.8.4.1", "9.8.4.2", "8.4.", "of the\tcode", "of the code", "THE\tC", "e", "", " ", "  ", "\n\n", "\t", None, long[10:90], long[100:500], long[100:500] + "q", "x" + long[:300] + long[300:] + " y", "abcd", "bb-", "é", "a  b", "zz z"]
    every = [(c or "").lower() for *_, c in rows if c is not None] + ["see 9.8.4.1 of the\tcode", "19.8.4.12"]
    got = C.cited_in(spark.createDataFrame([(t,) for t in texts], "t string"), docs, "t", "body").collect()
    assert {r.t: r.found for r in got} == {t: t is not None and any(t.lower() in d for d in every) for t in texts} and len(got) == len(texts)


def test_one_long_run_is_linear(spark):
    """A megabyte without a gap, as encoded data has it."""
    rng = random.Random(1)
    run = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1_000_000))
    chunks = spark.createDataFrame([(1, "9.1", None, run), (2, "9.1", None, "short")], CHUNK)
    asked = spark.createDataFrame([(1, run[777_000:777_030] + " short"), (2, run[5:10] + "zzzz")], "query_id long, query string")
    start = time.time()
    assert sorted((r.query_id, r.id) for r in C.keyword_search(asked, chunks, 5).collect()) == [(1, 1), (1, 2)]
    assert C.cited_in(asked.select(F.split_part("query", F.lit(" "), F.lit(1)).alias("q")), chunks, "q", "content").where("found").count() == 1
    assert time.time() - start < 60


def test_tasks_of_postings_follow_the_corpus(spark, tmp_path, monkeypatch):
    """With a fixed number of shuffle partitions, a task that stores postings gets no more where there are more texts."""
    monkeypatch.setattr(D, "ROWS", 500, raising=False)
    monkeypatch.setattr(D, "BUCKETS", 16)
    chunks = spark.range(300).select("id", F.lit("9.1").alias("section_id"), F.lit(None).cast("string").alias("section_title"), F.expr("array_join(transform(sequence(1, 40), i -> concat('w', i, 'x', id % 7 * i)), ' ')").alias("content"))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        C.keyword_index(chunks, index := str(tmp_path / "index"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    stored = spark.read.parquet(f"{index}/postings").select("word", "id", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("task"))
    want = chunks.select("id", F.explode(F.array_distinct(F.split("content", " "))).alias("word")).where(F.length("word") >= X.TERM)
    assert sorted(map(tuple, stored.select("word", "id").collect())) == sorted((r.word, r.id) for r in want.collect())
    assert max(r["count"] for r in stored.groupBy("task").count().collect()) <= 1500
    words = {r.word: r.first for r in spark.read.parquet(f"{index}/words").collect()}
    assert words == {r.word: r.first for r in want.groupBy("word").agg(F.min("id").alias("first")).collect()}


@pytest.mark.parametrize("stored", [False, True])
def test_words_behind_the_first_chunks_are_not_joined(spark, tmp_path, monkeypatch, stored):
    """A term in hundreds of words, and one in a word of all chunks: only what may hold their first chunks is joined and sorted."""
    rng, sizes, plain = random.Random(3), {}, C.shared.stored
    ids = rng.sample(range(10_000), 400)
    rows = [(i, "9.1", None, f"common {'x' * rng.randint(0, 9)}flat{i}y {'rare' if i % 97 == 0 else ''}") for i in ids] + [(None, "9.2", None, "unflattened"), (20_000, "9.1", "Flat common", None)]
    chunks, asked = spark.createDataFrame(rows, CHUNK).repartition(5), [(1, "flat"), (2, "common"), (3, "rare"), (4, "flat rare"), (5, "none")]

    def noted(df, what, path=None):
        out = plain(df, what, path)
        sizes[what] = out.count()  # the last of a name
        return out

    monkeypatch.setattr(C.shared, "stored", noted)
    index = str(tmp_path / "index") if stored else None
    if index:
        C.keyword_index(chunks, index)
    for limit in (1, 5):
        got = {}
        for r in C.keyword_search(spark.createDataFrame(asked, "query_id long, query string"), chunks, limit, index=index).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == searched(asked, rows, limit)
        assert sizes["matches"] < 40  # of 403
    whole = C.keyword_search(spark.createDataFrame(asked, "query_id long, query string"), chunks, 1000, index=index)
    assert whole.count() == sum(map(len, searched(asked, rows, 1000).values()))
