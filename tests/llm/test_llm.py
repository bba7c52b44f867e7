"""Small fixtures with nulls, empties, repeats, ties and clashing names; brute force where SQL can't say it."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from plumbline.llm import decontamination, embedding_dedup, exact_dedup, html_text, language_id, language_model, lexical_search, line_dedup, mixing, near_dedup, prefix_trie, quality, queries, token_counts
from plumbline.llm import _base as B
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "[^\x20\x09-\x0d]+"


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")


@pytest.fixture(scope="session")
def odd(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, base, "en", "a", 1), (4, base, "en", "a", 1), (5, base.upper(), "en", None, 1), (6, base + " extra", "fr", "b", 1), (None, base, "en", "b", 1), (7, "x", "en", "b", 1), (8, "longword" * 40000, "en", "b", 1), (9, "été Ünï " * 5, "fr", "b", 1)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(same, name):
    same(queries.QUERIES[name], queries.SQL[name])


def brute_components(rows, percent):
    sets = {}
    for i, x in rows:
        w = re.findall(WORDS, lower(x))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    comp = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0]
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return comp, {i: len(s) for i, s in sets.items()}


def test_near_dedup_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    comp, sizes = brute_components(rows, 85)
    got = queries.op7_near_dedup(spark, SF).collect()
    assert {(r.doc_id, r.component_id, r.n_shingles, r.kept) for r in got} == {(i, comp[i], sizes[i], comp[i] == i) for i, _ in rows}


def test_near_dedup_dense_bucket(spark):
    """Near copies that are not all linked to one hub."""
    rng, base = np.random.default_rng(3), [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        w = list(base)
        for k in rng.choice(80, int(rng.integers(0, 4)), replace=False):
            w[k] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    comp, _ = brute_components(rows, 85)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == comp


def test_near_dedup_odd(odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == 11 and near_dedup.near_duplicates(none).count() == 0
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[4] == comp[5] == comp[6] == 4 and comp[1] == 1 and comp[2] == 2 and comp[None] is None


def test_line_dedup_odd(spark, odd, none):
    out = line_dedup.line_dedup(odd.withColumn("n_lines", F.lit("clash")), min_docs=2, prefix="__").collect()
    one = {r.doc_id: r for r in out}
    assert one[1].text == "" and one[1].__n_lines == 1 if hasattr(one[1], "__n_lines") else one[1]["__n_lines"] == 1
    assert one[4]["__n_dropped"] == 1 and one[4].text == "" and one[7]["__n_dropped"] == 0 and one[4].n_lines == "clash"
    assert line_dedup.line_dedup(none).count() == 0


def test_minimal_perfect_hash():
    keys = np.unique(B.mix(np.arange(50000, dtype=np.uint64)))
    sizes, bits, index = line_dedup.mph_build(keys)
    assert sorted(index) == list(range(len(keys)))
    assert (line_dedup.mph_find(keys, sizes, bits, np.cumsum(bits) - 1) == index).all()


def test_decontamination_odd(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, "!!"), (3, "WORD3 word4"), (None, "word9"), (5, " ".join(f"word{i}" for i in range(10, 25)))], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.decontaminate(odd, items).collect()}
    assert got[4].n_hit == 2 + 1 + 15 and got[4]["items"] == ["3", "5"] and got[1].n_words == 0 and got[7].n_hit == 0 and got[4].near == ["3", "5"]
    assert decontamination.decontaminate(none, items).count() == 0
    assert decontamination.decontaminate(odd, items.where("false")).where("n_hit > 0").count() == 0


def brute_runs(docs, items, width, near):
    """{document: (hit places, items, near items)} by looking at every place."""

    def ws(x):
        return re.findall("[0-9a-z\x80-\U0010ffff]+", lower(x))

    texts, tests = {i: ws(x) for i, x in docs}, {i: ws(x) for i, x in items if ws(x)}
    n, out = Counter(w for x in texts.values() for w in x), {}
    for doc, text in texts.items():
        hit, met, close = set(), set(), set()
        for item, words in tests.items():
            size = min(width, len(words))
            for lo in range(len(words) - size + 1):
                win = words[lo : lo + size]
                places = [p for p in range(len(text) - size + 1) if text[p : p + size] == win]
                hit |= {p + k for p in places for k in range(size)}
                met |= {item} if places else set()
                rarest = min(range(size), key=lambda k: (n[win[k]], k))
                if any(w == win[rarest] and set(win) <= set(text[max(0, p - near) : p + near + 1]) for p, w in enumerate(text)):
                    close.add(item)
        out[doc] = len(hit), *(sorted(str(i) for i in x if i is not None) for x in (met, close))  # an item without id is not listed
    return out


@pytest.mark.parametrize("listed", [1_000_000, 0])
def test_phrases_and_proximity_brute_force(spark, monkeypatch, listed):
    """Few words, so that lists are long and windows overlap; items of one frequent word, of two, and shuffled passages."""
    monkeypatch.setattr(decontamination, "LISTED", listed)
    rng = np.random.default_rng(11)
    vocabulary = [f"v{i}" for i in range(25)]
    items = [(i, " ".join(rng.choice(vocabulary, 14))) for i in range(6)] + [(6, "v1"), (7, "v2 v3"), (8, "V4 v4 v4"), (9, "v5 absent v6"), (None, "v7"), (10, "")]
    docs = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 150))))) for i in range(40)]
    docs += [(40 + i, f"v9 {items[i][1]}. v1 v4 v4 v4 v4") for i in range(6)] + [(50, " ".join(reversed(items[0][1].split()))), (51, None), (52, "v4 " * 30), (53, items[1][1][:30])]
    got = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), width=6).collect()
    want = brute_runs(docs, items, 6, 12)
    assert {r.doc_id: (r.n_hit, r["items"], r.near) for r in got} == want and len(got) == len(docs)
    assert any(set(x[2]) > set(x[1]) for x in want.values())


def test_mixing_odd(spark, odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == 11 and all(r.taken <= 2 * r.size for r in got) and mixing.mix(none).count() == 0
    assert {r.doc_id: r.size for r in got}[4] == 60 and mixing.mix(odd).count() == 11
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(odd).collect()))


def test_language_id(spark, odd, none):
    got = queries.op5_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    odd_got = {r.doc_id: r.lang_pred for r in language_id.predict(odd, language_id.learn(odd), ["doc_id"]).collect()}
    assert odd_got[1] == odd_got[2] == odd_got[3] == "und" and odd_got[9] == "fr"
    assert language_id.predict(odd, language_id.learn(none), ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_quality(spark, odd, none):
    got = queries.op6_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.95 and got[got.quality == 0].kept.mean() < 0.2
    assert quality.score(odd, quality.fit(odd), ["doc_id"]).where("doc_id < 4 and kept").count() == 0
    assert quality.score(none, quality.fit(none), ["doc_id"]).count() == 0


@pytest.mark.parametrize("block", [3, 64, token_counts.BLOCK])
def test_token_counts(odd, none, block):
    enc = token_counts.encoder(token_counts.default_vocabulary())
    got = token_counts.count_tokens(*token_counts.write_tokens(odd, block=block)).collect()
    want = sorted((str(r.doc_id), len(enc.encode_ordinary(r.text or ""))) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    assert token_counts.count_tokens(*token_counts.write_tokens(none, block=block)).count() == 0


def test_embeddings_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 32))
    near = base[:100] + 0.03 * rng.normal(size=(100, 32))
    x = np.concatenate([base, near, base[:20]])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [1.0, None]), (904, []), (None, [1.0] * 32)]
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = (u @ u.T >= 0.95).sum(axis=1) - 1
    found = sum(got[i].n_links for i in range(len(x)))
    assert all(got[i].n_links <= n[i] for i in range(len(x))) and found >= 0.9 * n.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, None))
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_embeddings_hot_buckets(spark, monkeypatch):
    """A dense group is compared in blocks: never fewer links than by pairs, never more than there are."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=32)
    x = np.concatenate([base + 0.22 * rng.normal(size=(260, 32)), rng.normal(size=(60, 32))])
    x = np.concatenate([x, x[:30]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = (u @ u.T >= 0.95).sum(axis=1) - 1
    monkeypatch.setattr(embedding_dedup, "HOT", 1 << 30)
    pairs = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    monkeypatch.setattr(embedding_dedup, "HOT", 3)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    blocks = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    assert all(pairs[i].n_links <= blocks[i].n_links <= n[i] for i in range(len(x)))
    assert 0 < n[:260].sum() < 260 * 289 and sum(r.n_links for r in blocks.values()) >= 0.9 * n.sum()
    assert all(blocks[i].component_id <= pairs[i].component_id for i in pairs)


def test_language_model(spark, odd, none):
    got = {r.doc_id: r for r in queries.op10_language_model(spark, SF).collect()}
    tokens = {r.doc_id: [*re.findall(WORDS, lower(r.text)), None] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    c = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    total = sum(c.values())
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in ws)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), total)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score < 0
    assert language_model.score(odd, language_model.learn(none), ["doc_id"]).count() == 11
    assert language_model.score(none, language_model.learn(odd), ["doc_id"]).count() == 0


def test_language_model_split_words_and_grams(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = {r.doc_id: r for r in language_model.score(docs, language_model.learn(docs), ["doc_id"]).collect()}
    b = {r.doc_id: r for r in language_model.score(docs, language_model.learn(docs, max_words=500, max_grams=20000), ["doc_id"]).collect()}
    assert all(a[i].n_known == b[i].n_known and a[i].base_score == pytest.approx(b[i].base_score, rel=1e-9) for i in a)
    assert all(a[i].score == pytest.approx(b[i].score, rel=1e-9) for i in a)


def test_language_model_whole_tree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    own = docs.where("doc_id % 3 <> 0")
    monkeypatch.setattr(language_model, "SHARE", 20000)
    monkeypatch.setattr(language_model, "ASKED", 500)
    monkeypatch.setattr(language_model, "ROW", 700)
    got = {r.doc_id: r.score for r in language_model.score(docs, language_model.learn(own, max_grams=3000), ["doc_id"]).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}

    def codes(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return language_model.stream(raw, np.array([0, len(raw)]))[0]

    every = np.concatenate([codes(t) for i, t in texts.items() if i % 3])
    tree = language_model.Tree([np.unique(every & np.uint64((1 << (8 * d + 8)) - 1), return_counts=True) for d in range(language_model.DEPTH + 1)])
    for i in list(texts)[::7]:
        assert got[i] == pytest.approx(tree.log10(codes(texts[i])).sum(), rel=1e-5)


def test_probabilities_sum_to_one():
    codes = B.mix(np.arange(3000, dtype=np.uint64)) & np.uint64(0x030303030303)
    tables = []
    for d in range(6):
        g, n = np.unique(codes & np.uint64((1 << (8 * d + 8)) - 1), return_counts=True)
        tables.append((g, n))
    tree = language_model.Tree(tables)
    context = (codes[:5] >> np.uint64(8)) << np.uint64(8)
    for c in [*context, np.uint64(0xABCDEF123400)]:
        p = 10 ** tree.log10(c | np.arange(256, dtype=np.uint64))
        assert p.sum() == pytest.approx(1, abs=1e-3)


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><a>home</a></nav><article><h1>A &amp; b</h1><p>Some  text\nhere<script>x('<p>')</script><p>More.</article><div class='comments'><p>nice</p></div><footer>f</footer>"
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (1, "u", page), (4, "u", "<!-- no end"), (5, "u", "x < y <p title='a>b'>z")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id", "url"]).collect()
    assert [r.text for r in got] == ["A & b\n\nSome text here\n\nMore.", "", "", "A & b\n\nSome text here\n\nMore.", "", "x < y\n\nz"]
    assert all(r.n_chars == len(r.text) for r in got)


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, seen = docs.count(), []
    for name, stage in C.STAGES:
        out = B.store(stage(spark, docs, SF), name)
        seen.append(out.count())
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
    assert seen[0] <= n and seen[2] < seen[1] and seen[3] < seen[2] and seen[4] == seen[3]
    got = near_dedup.near_duplicates(docs, percent=80)
    assert got.where("not kept").count() == 0
    hits = decontamination.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert hits.where("n_hit > 0").count() == 0


def test_html_unclosed_parts():
    """Only raw text is read to the end; other invisible parts end with their block or, unclosed, at the next one."""
    article = "<article><h1>A title</h1><p>" + "words of the article go on and on " * 8 + "</p></article>"
    want = html_text.main_text(article)
    assert "go on" in want
    for name in html_text.PARTS:
        for before in (f"<{name}>", f"<div><{name}>x</div>", f"<{name}>x<{name}>y</{name}>", f"<div><{name}>x</div></{name}>", f"<{name}><p>x</p></{name}>"):
            assert html_text.main_text(before + article) == want, before
        assert html_text.main_text(f"<div><{name}>x</div>{article}</{name}>") == want
    assert html_text.main_text("<object>a<object>b</object>c</object>" + article) == want
    assert html_text.main_text("<select><option>a<option>b" + article) == want
    assert html_text.main_text("<script>x" + article) == html_text.main_text("<textarea>x" + article) == ""
    assert html_text.main_text("<p>one <button><div>x</div></button> two") == "one two"


def test_pipeline_odd(spark, odd, none):
    """Every stage on nulls, empties, repeated rows, further columns, and no rows."""
    import corpus_pipeline as C

    for docs in (odd.withColumn("size", F.lit("clash")).withColumn("n_hit", F.lit(1)).withColumn("key", F.lit(2)), none):
        columns = docs.columns
        for name, stage in C.STAGES:
            out = B.store(stage(spark, docs, SF), name)
            if name != C.STAGES[-1][0]:
                assert out.columns == columns and out.count() <= docs.count()
                docs = out
            else:
                assert out.count() == docs.count()


def test_pipeline_brute_force(spark, odd, tmp_path):
    """run() on a fixture, its rows compared with those of stages written out in plain Python."""
    import corpus_pipeline as C

    said = "a line that many documents have"
    words = {k: [f"{k}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] for k in ("copy", "leak", "mine")}
    copy, leak = " ".join(words["copy"]), " ".join(words["leak"])
    rows = [(i, f"{said}\n" + " ".join(f"own{chr(97 + i)}{w}" for w in words["mine"]), "en", "a", 1) for i in range(12)]
    rows += [(20, None, None, None, None), (21, "", "en", "a", 0), (22, " 12 \n\t!", "en", "a", 7), (23, said, "en", "b", 31)]
    rows += [(30, copy, "en", "a", 1), (30, copy, "en", "a", 1), (31, copy.upper(), "en", None, 1), (32, copy + " extra", "en", "b", 1), (33, "x", "en", "b", 1)]
    rows += [(50 + i, " ".join(f"été{chr(97 + i)}{w}" for w in words["mine"][: 20 + i]), "fr", "cba"[i % 3], 1) for i in range(6)]
    rows += [(40, "before " + " ".join(words["leak"][5:20]) + " after", "en", "b", 1), (41, " ".join(words["leak"][:9]), "en", "b", 1)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 0, 0), (3, 1, 0), (3, 0, 0), (50, 1, 0), (51, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    left = [r for r in rows if re.search("[^\\W\\d_]", r[1] or "")]
    often = Counter(k for r in left for k in {lower(x.strip(" \t\n\x0b\x0c\r")) for x in r[1].split("\n")})
    cut = []
    for r in left:
        kept = [x for x in r[1].split("\n") if often[lower(x.strip(" \t\n\x0b\x0c\r"))] < 10]
        text = "\n".join(kept)
        if text.strip(" \t\n\x0b\x0c\r") or len(kept) == r[1].count("\n") + 1:
            cut.append((r[0], text, r[3]))
    comp, _ = brute_components([(i, x) for i, x, _ in cut], 80)
    cut = [r for r in cut if comp[r[0]] == r[0]]
    grams = {tuple(words["leak"][i : i + 10]) for i in range(51)}
    cut = [r for r in cut if not any(tuple(w[i : i + 10]) in grams for w in [re.findall(WORDS, lower(r[1]))] for i in range(len(w)))]
    want = sorted((i, repr(s), len(re.findall(WORDS, x))) for i, x, s in cut)
    assert [i for i, _, _ in want] == [*range(12), 30, 30, 33, 41, *range(50, 56)]
    got = C.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, repr(r.source), r["size"]) for r in got) == want
    target, taken = brute_mix([(i, x, s, {0: 0.5, 3: 2.0, 50: 2.0}.get(i)) for i, x, s in cut])
    assert all(r.target == pytest.approx(target[r.source]) for r in got)
    mine = {}
    for r in got:
        mine.setdefault((r.doc_id, r.source), []).append(r.taken)
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in taken.items()}


def test_line_index_keeps_ties(tmp_path):
    """Line hashes that share their 64-bit key keep their own counts."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    lo = np.arange(1, 7, dtype=np.uint64)
    hi = np.uint64(77) ^ B.mix(lo)
    hi[4:] += np.uint64(1)
    table = pa.table({"hi": hi.view(np.int64), "lo": lo.view(np.int64), "n": np.arange(10, 16), "shard": np.zeros(6, np.int64)})
    pq.write_table(line_dedup._build_shard(table), str(tmp_path / "part.parquet"))
    digests = [np.array([h, x], np.uint64).tobytes() for h, x in [*zip(hi, lo), (hi[0], lo[1]), (hi[5], np.uint64(99))]]
    assert line_dedup.probe(digests, str(tmp_path), 1).tolist() == [10, 11, 12, 13, 14, 15, 0, 0]


def test_near_dedup_repeated_ids(spark):
    """Rows that repeat an id with equal and with other texts: one vertex, and as many rows as came in."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(3, a), (5, a), (5, c), (5, c), (6, b), (7, c + " tail"), (8, b), (8, a + " end"), (9, None), (9, b), (2, "x"), (2, "y"), (2, "y")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    want = [(3, 3), (5, 3), (5, 3), (5, 3), (6, 3), (7, 3), (8, 3), (8, 3), (9, 9), (9, 3), (2, 2), (2, 2), (2, 2)]
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_embeddings_repeated_ids(spark):
    """Each row is a vector of its own, whether its id repeats with an equal or with another vector."""
    rng = np.random.default_rng(4)
    v, w = rng.normal(size=16), rng.normal(size=16)
    rows = [(5, v), (5, v + 0.01), (6, v - 0.01), (7, w), (7, w), (5, w + 0.01), (9, rng.normal(size=16)), (9, rng.normal(size=16)), (4, w)]
    got = embedding_dedup.near_vectors(spark.createDataFrame([(i, [float(t) for t in x]) for i, x in rows], "vec_id long, embedding array<double>")).collect()
    want = [(5, 2, 5), (5, 2, 5), (6, 2, 5), (7, 3, 4), (7, 3, 4), (5, 3, 4), (4, 3, 4), (9, 0, 9), (9, 0, 9)]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_embeddings_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 7, "x"), (2, [1.0, 0.0], 8, "y"), (3, None, 9, "z")]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int, component_id string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


_SENTENCES = [f"this is sentence {i} of the article and it goes on for some more words than a menu has." for i in range(6)]


def _page(before="", inside="{}", after=""):
    return before + inside.format("<h1>A title</h1>" + "".join(f"<p>{x}</p>" for x in _SENTENCES)) + after


@pytest.mark.parametrize("inside", [
    "<body class='page has-sidebar'><article>{}</article>", "<div class='content-sidebar-wrap'><article>{}</article></div>", "<div id='no-comments'>{}</div>", "<div class='popular-science-article'>{}</div>",
    "<article class='post has-share-buttons'>{}</article>", "<body id='comments-page'><div class='sidebar-left layout'><main>{}</main></div>", "<div class='content-sidebar-wrap'>{}</div>", "<div><div>{}</div></div>", "<td>{}</td>", "{}",
])
@pytest.mark.parametrize("before,after", [
    ("", ""), ("<nav><a>home</a> <a>news</a></nav>", "<footer>rights of the owner</footer>"), ("<div><a>home</a> <a>news</a> <a>contact us</a></div>", "<div><a>privacy</a> <a>terms of use</a></div>"),
    ("<header>name of the site</header><div class='cookie-notice'><p>we use cookies for this and that and more.</p></div>", "<div id='comments'><p>i think so.</p><p>me too, and I say it at some length here.</p></div><aside><p>read more of it</p></aside><form><p>your name</p></form>"),
])
def test_html_keeps_the_article(inside, before, after):
    """Names of the body and of wrappers of the article don't decide; menus, notices, comments and the like go."""
    assert html_text.main_text(_page(before, inside, after)) == "\n\n".join(["A title", *_SENTENCES])


@pytest.mark.parametrize("many", [1, 3, 12, 40, 400])
@pytest.mark.parametrize("name", ["id='comments'", "class='comment-list'", "class='cookie-notice'", "class='x related'", "role='navigation'"])
def test_html_names_hold_whatever_the_size(many, name):
    """Comments and notices go, few or many, behind the text or before it."""
    said = "".join(f"<p>Comment {i} which says something at some length about what stands above it.</p>" for i in range(many))
    short = "<h1>Title</h1><p>Short news of today in one line, and that is all there is to say of it here, as of now.</p>"
    whole = "Title\n\nShort news of today in one line, and that is all there is to say of it here, as of now."
    assert html_text.main_text(f"{short}<div {name}>{said}</div>") == whole
    if name != "class='comment-list'":  # a part of a name holds only behind a text
        assert html_text.main_text(f"<div {name}>{said}</div>{short}") == whole


def test_html_line_on_rights():
    for line in ("Copyright 2024 someone", "© the owner", "All rights reserved."):
        assert html_text.main_text(f"<h1>A title</h1>{''.join(f'<p>{x}</p>' for x in _SENTENCES)}<div>{line}</div>") == "\n\n".join(["A title", *_SENTENCES])


def test_html_tree_reads_neighbours():
    """The learned tree splits on words and links of a block and of its neighbours, and fits its small table."""
    text = html_text.tree().text()
    assert all(f"{name} <=" in text for name in ("words", "linked share", "words after", "linked share after", "linked share before"))
    misses = total = 0
    for page in html_text.LABELLED:
        found, elements = html_text.blocks(page.format(M=html_text._SAID, L=html_text._LONG, X=html_text._LONG * 2))
        keep = html_text.tree().keep(html_text.table(found, elements))
        misses, total = misses + sum(f[0].startswith("+") != k for f, k in zip(found, keep)), total + len(found)
    assert misses <= 0.05 * total


def test_html_blocks_brute_force(spark):
    """All blocks of the test pages against a parser of another kind, and the articles' own paragraphs as the result."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.inside, self.raw = [""], False, False

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            self.raw |= tag in ("script", "style")
            if tag in html_text.BLOCK:
                self.out.append("")
            elif tag == "br":
                self.out[-1] += " "

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            self.raw &= tag not in ("script", "style")
            if tag in html_text.BLOCK:
                self.out.append("")

        def handle_data(self, data):
            if self.inside and not self.raw:
                self.out[-1] += data

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages, ["page_id"]).collect()}
    for r in pages.collect():
        parser = Article()
        parser.feed(r.html)
        want = [" ".join(x.split()) for x in parser.out]
        assert got[r.page_id] == "\n\n".join(x for x in want if x)


def test_html_odd(spark):
    """An empty table, clashing column names, nulls, ties and a very long page."""
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", _page(), "t"), (3, "u", _page(), "t"), (4, "u", "<article>" + "<p>word &amp; more</p>" * 60000 + "</article>", "t"), (5, "u", "<p>" * 50000 + "x", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages, ["page_id", "url"]).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 0), (2, 0), (3, len(got[2].text)), (3, len(got[2].text)), (4, 60000 * 13 - 2), (5, 1)]
    assert html_text.extract(pages.where("false"), ["page_id", "url"]).count() == 0


def brute_tree(text_codes, depth):
    """log2 probabilities by context-tree weighting written as a recursion over dictionaries."""
    counts = Counter()
    for context, symbol in text_codes:
        for d in range(depth + 1):
            for j in range(8):
                counts[d, context[:d], j, symbol >> (8 - j), (symbol >> (7 - j)) & 1] += 1

    def n(d, c, j, prefix):
        return counts[d, c, j, prefix, 0], counts[d, c, j, prefix, 1]

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    kids = {}
    for d, c, j, prefix, _ in list(counts):
        if d:
            kids.setdefault((d - 1, c[:-1], j, prefix), set()).add(c)

    def weighted(d, c, j, prefix):
        """(block log probability, weight of the own estimate)"""
        own = log_kt(*n(d, c, j, prefix))
        below = kids.get((d, c, j, prefix))
        if not below:
            return own, 1.0
        rest = sum(weighted(d + 1, k, j, prefix)[0] for k in below)
        return np.logaddexp(own, rest) - math.log(2), 1 / (1 + math.exp(min(50, max(-50, rest - own))))

    def score(context, symbol):
        out = 0.0
        for j in range(8):
            prefix, bit, p = symbol >> (8 - j), (symbol >> (7 - j)) & 1, None
            for d in range(depth, -1, -1):
                a = n(d, context[:d], j, prefix)
                if sum(a):
                    est = (a[bit] + 0.5) / (sum(a) + 1)
                    w = weighted(d, context[:d], j, prefix)[1]
                    p = est if p is None else w * est + (1 - w) * p
            out += math.log10(0.5 if p is None else p)
        return out

    return score


def test_language_model_brute_force(spark, odd):
    """Scores of short texts against the recursion, which shares no code with the model; further columns may clash."""
    depth, texts = 3, ["the cat sat on the mat", "the hat", "a cat and a hat", "", None, "été", "THE  cat\n", "zz top", "on the mat the cat"]

    def coded(text):
        raw = [*" ".join(re.findall(WORDS, lower(text))).encode()]
        raw = [*raw, 10] if raw else [10]
        padded = [10] * depth + raw
        return [(tuple(padded[i - 1 : i - 1 - depth : -1] if i - 1 - depth >= 0 else padded[i - 1 :: -1]), padded[i]) for i in range(depth, len(padded))]

    score = brute_tree([x for t in texts[:5] for x in coded(t)], depth)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, __bucket string, score long")
    model = language_model.learn(docs.where("doc_id < 5"), depth=depth)
    got = {r.doc_id: r.score for r in language_model.score(docs, model, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(sum(score(*x) for x in coded(t)), rel=1e-5)


def brute_mix(rows, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by source and {(doc_id, source): [taken, ...]}, by sorting each source. rows: (doc_id, text, source, quality)."""
    import hashlib

    sized = []
    for i, text, source, q in rows:
        u = (int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        sized.append((source, -math.log(u) / max(1.0 if q is None else q, 1e-6), i, len(re.findall(WORDS, text or ""))))
    names = sorted({r[0] for r in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r[3] for r in sized if r[0] == s) for s in names}
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    open_, left, target = set(names), share * sum(size.values()), {}
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        full = [s for s in open_ if most * size[s] < level * w[s]]
        if not full:
            break
        for s in full:
            target[s] = float(most * size[s])
            left -= most * size[s]
            open_.remove(s)
    target |= {s: level * w[s] for s in open_}
    taken = {}
    for s in names:
        own = sorted((r for r in sized if r[0] == s), key=lambda r: (r[1], -1 if r[2] is None else r[2], r[3]))
        epochs = int(target[s] // size[s]) if size[s] else 0
        rest, upto, more = target[s] - epochs * size[s], 0, set()
        for k, r in enumerate(own):
            if upto + r[3] > rest:
                break
            upto += r[3]
            more.add(k)
        gap = rest - upto
        late = [(abs(r[3] - gap), k) for k, r in enumerate(own) if k >= len(more) and r[3] and abs(r[3] - gap) < gap]
        more |= {min(late)[1]} if late else set()
        for k, r in enumerate(own):
            taken.setdefault((r[2], s), []).append(r[3] * (epochs + (k in more)))
    return target, taken


@pytest.mark.parametrize("span", [200_000, 7])
def test_mixing_brute_force(spark, monkeypatch, span):
    """Many sources, one of them huge, low, null and unlike qualities, sources without words; ranges of any size."""
    monkeypatch.setattr(mixing, "RANGE", span)
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(0, 30)), "huge" if i % 3 else f"s{i % 13}", [None, 0.01, 0.01, 2.0, 1e-9][i % 5]) for i in range(240)]
    rows += [(300, None, "empty", None), (301, "", "empty", 1.0), (302, "a b", None, None), (303, "a b c", None, 3.0), (None, "x y", "s1", None)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string").repartition(5)
    quality = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] is not None], "doc_id long, q double")
    target, taken = brute_mix(rows)
    got = mixing.mix(docs, quality=quality).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.source): [r.taken] for r in got} == taken
    assert all(r.target == pytest.approx(target[r.source]) for r in got)


@pytest.mark.parametrize("keys,cache,span", [(1 << 16, 1 << 26, 0), (3, 0, 1), (3, 0, 1 << 20), (5, 1 << 26, 1 << 20)])
def test_line_dedup_brute_force(spark, monkeypatch, keys, cache, span):
    """One shard and many, kept and streamed, several blocks a pass; keys in exactly min_docs documents, ties and odd spaces."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", keys)
    rng = np.random.default_rng(8)
    lines = [f"Line {i}" for i in range(30)] + ["", " \t", "  line 3\v", "É é"]
    texts = ["\n".join(rng.choice(lines, int(rng.integers(1, 8)))) for _ in range(40)] + [None, "", "a\r\nb", "LINE 3"] + ["once " + str(i) + "\nexactly four" for i in range(4)] + ["only three"] * 3
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(4)

    def key(x):
        return lower(x.strip(" \t\n\v\f\r"))

    n = Counter(k for x in texts for k in {key(y) for y in (x or "").split("\n")} if len(k) >= 1)
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs, min_docs=4, cache=cache, span=span).collect()}
    for i, x in enumerate(texts):
        own = (x or "").split("\n")
        kept = [y for y in own if n[key(y)] < 4]
        assert (got[i].text, got[i].n_lines, got[i].n_dropped) == ("\n".join(kept), len(own), len(own) - len(kept))
    assert n["exactly four"] == 4 and got[44].n_dropped == 1 and got[48].text == "only three"


def test_shared_folder(spark, monkeypatch, tmp_path):
    """Stored tables can be deleted; without a shared folder only a local master gets a temporary one."""
    from types import SimpleNamespace

    B.store(spark.range(3), "mine")
    paths = list(spark.sparkContext._plumbline_paths)
    import os

    assert os.path.isdir(paths[-1].removeprefix("file:").replace("//", "/", 1)) and B.clean(spark) == len(paths)
    assert not os.path.isdir(paths[-1].removeprefix("file:").replace("//", "/", 1))
    conf = SimpleNamespace(get=lambda k: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        B.shared_dir(SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://somewhere:7077")))


def test_language_id_brute_force(spark, odd):
    """Counts, prior and posterior of naive Bayes over the same features, by dictionaries; further columns may clash."""
    rows = [(i, x, g, "c") for i, (x, g) in enumerate([("the cat sat", "en"), ("a cat", "en"), ("le chat noir", "fr"), ("été", "fr"), ("der Hund", "de"), (None, "de"), ("the dog", None), ("123", "en"), ("", None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    import pyarrow as pa

    def grams(x):
        return list(language_id.features(pa.array([x], pa.string()), 64)[0])

    langs = sorted({g for _, _, g, _ in rows if g})
    counts = {g: Counter(f for _, x, h, _ in rows if h == g for f in grams(x)) for g in langs}
    prior = {g: 1 + sum(h == g for *_, h, _ in rows) for g in langs}
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.learn(docs, buckets=64), ["doc_id"]).collect()}
    for i, x, _, _ in rows:
        f = grams(x)
        logs = {g: math.log(prior[g] / sum(prior.values())) + sum(math.log((counts[g][k] + 0.5) / (sum(counts[g].values()) + 0.5 * 64)) for k in f) for g in langs}
        top = max(logs.values())
        want = max(langs, key=lambda g: logs[g]) if f else "und"
        assert got[i].lang_pred == want and got[i].score == pytest.approx(1 / sum(math.exp(v - top) for v in logs.values()) if f else 0.0, rel=1e-4)


def test_quality_em_brute_force():
    """EM over patterns against EM over rows, and a likelihood that never falls."""
    rng = np.random.default_rng(1)
    v = rng.integers(-1, 2, (12, 4))
    n = rng.integers(1, 9, 12)
    post, table, good = quality.em(v, n, rounds=7)
    rows = np.repeat(np.arange(12), n)
    p = np.array([0.05 if (v[r] < 0).any() else 0.9 for r in rows])
    for _ in range(7):
        share = min(0.99, max(0.01, p.mean()))
        est = [[[(sum((w if c else 1 - w) for r, w in zip(rows, p) if v[r, j] == x) + 1) for x in (-1, 0, 1)] for c in (0, 1)] for j in range(4)]
        est = [[[x / sum(own) for x in own] for own in both] for both in est]
        p = np.array([(b := math.prod([share, *(est[j][1][v[r, j] + 1] for j in range(4))])) / (b + math.prod([1 - share, *(est[j][0][v[r, j] + 1] for j in range(4))])) for r in rows])
    assert [post[r] for r in rows] == pytest.approx(list(p), rel=1e-6) and good == pytest.approx(share)


def test_quality_odd(spark, odd, none):
    """Scores by hand, a sample within its bound though one id repeats, and clashing columns."""
    docs = odd.withColumn("score", F.lit("c")).withColumn("kept", F.lit(1))
    model = quality.fit(docs.union(docs.where("doc_id = 4")), sample=4)
    got = {r.doc_id: r for r in quality.score(docs, model, ["doc_id"]).collect()}
    posterior, weights, bias = model
    raw = np.frombuffer(b"x", np.uint8)
    h, s, e, _ = B.word_spans(raw, np.array([0, 1]))
    assert got[7].score == pytest.approx(1 / (1 + math.exp(-(weights[quality.features(raw, h, s, e)].sum() / 3 + bias))))
    assert got[1].score == 0 and not got[2].kept and len(got) == 10


def test_clashing_columns(spark, odd):
    """Tokens and vectors of tables whose further columns are named as the results or as what is used inside."""
    docs = odd.withColumn("n_tokens", F.lit("c")).withColumn("block", F.lit(1)).withColumn("file", F.lit(2))
    got = token_counts.count_tokens(*token_counts.write_tokens(docs, block=64)).collect()
    assert len(got) == 11 and {r.doc_id: r.n_tokens for r in got}[1] == 0
    items = spark.createDataFrame([(1, "word3 word4", 5)], "item_id long, text string, pos int")
    hit = decontamination.decontaminate(docs.withColumn("pos", F.lit(1)).withColumn("term", F.lit("t")).withColumn("item", F.lit(3)), items).collect()
    assert {r.doc_id: r.n_hit for r in hit}[4] == 2
    assert near_dedup.near_duplicates(docs.withColumn("band", F.lit(1)).withColumn("kept", F.lit(0)).withColumn("node", F.lit(0))).count() == 11
    assert mixing.mix(docs.withColumn("src", F.lit(1)).withColumn("key", F.lit(0)).withColumn("part", F.lit(0))).count() == 11


def brute_exact(rows):
    groups = {}
    for i, x in rows:
        groups.setdefault(lower(x), []).append(i)
    out = []
    for i, x in rows:
        own = groups[lower(x)]
        ids = [k for k in own if k is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(own), i == keep, hashlib.sha256(lower(x).encode()).hexdigest()))
    return Counter(out)


def exact_result(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_exact_fingerprint_composes():
    rng = np.random.default_rng(1)
    b = rng.integers(0, 256, 50_000, dtype=np.uint8)
    whole = exact_dedup.fingerprint(b)
    slow = [0] * 4
    for x in b[:3000].tolist():
        slow = [(v * p + x) % exact_dedup.PRIME for v, p in zip(slow, exact_dedup.POINTS)]
    assert slow == exact_dedup.fingerprint(b[:3000])
    for at in (0, 1, 8191, 8192, 8193, 30_000, 50_000):
        tail = b[at:]
        assert exact_dedup.combine(exact_dedup.fingerprint(b[:at]), exact_dedup.fingerprint(tail), exact_dedup.shift(exact_dedup.POINTS, len(tail))) == whole


@pytest.mark.parametrize("how", [{}, {"points": (0, 0, 0, 0)}, {"part": 3, "chunk": 7}, {"points": (0, 0, 0, 0), "part": 2, "chunk": 5}, {"huge": 64}, {"huge": 40, "part": 2, "chunk": 16, "classes": 0}])
def test_exact_dedup_brute_force(spark, odd, how):
    """Also with fingerprints that tell only the last byte, small parts and chunks, and texts hashed in pieces."""
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(100 + i, "Copy of one text, " + "abc"[i % 3] * 30 + "!") for i in range(60)] + [(None, "lonely"), (None, "LONELY"), (300, "ÉA"), (301, "éa"), (302, "Éa"), (303, "x" * 200 + "y"), (304, "X" * 200 + "Y"), (305, "x" * 199 + "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sha", F.lit(1)).withColumn("size", F.lit("a"))
    assert exact_result(exact_dedup.exact_duplicates(df, **how)) == brute_exact(rows)


def test_exact_dedup_empty(none):
    assert exact_dedup.exact_duplicates(none).count() == 0


def brute_search(docs, queries, count):
    def terms(x):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(x))

    own = [(i, Counter(terms(x)), len(terms(x))) for i, x in docs if terms(x)]
    n, total, df = len(own), sum(k for *_, k in own), Counter(t for _, c, _ in own for t in c)
    asked = {}
    for i, x in queries:
        asked.setdefault(i, Counter()).update(terms(x))
    out = []
    for item, q in asked.items():
        found = []
        for i, c, k in own:
            m = 75 + 25 * k * n // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in q.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:count])]
    return Counter(out)


@pytest.mark.parametrize("how", [{}, {"shard": 64, "block": 1}, {"rows": 2, "block": 2, "few": 0, "held": 3}, {"count": 2, "rows": 3, "held": 0}])
def test_lexical_search_brute_force(spark, odd, how):
    """Ties, repeated ids and terms, nulls, and shards and blocks of few rows."""
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    docs += [(50 + i, "same words here") for i in range(30)] + [(90, "Été-2024 ünï\x00here"), (91, "here here here!"), (None, "same words")]
    queries = [(1, "same words"), (1, "same"), (2, "HERE été 2024"), (3, None), (4, ""), (5, "absent"), (None, "word1 word2 word1"), (6, "x longword")]
    build = {k: v for k, v in how.items() if k in ("shard", "rows")}
    index = lexical_search.build_index(spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit(1)), **build)
    got = lexical_search.search(index, spark.createDataFrame(queries, "item_id long, text string"), **{k: v for k, v in how.items() if k not in build})
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()) == brute_search(docs, queries, how.get("count", 20))


def test_lexical_search_empty(spark, none):
    asked = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert lexical_search.search(lexical_search.build_index(none), asked).count() == 0
    docs = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert lexical_search.search(lexical_search.build_index(docs), asked.limit(0)).count() == 0


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    full = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + x[h:]
    nodes = {}
    for c, x in full.items():
        for d in range(len(x) + 1):
            nodes.setdefault(tuple(x[:d]), []).append(c)
    kids, leaves, saved = Counter(q[:-1] for q in nodes if q), Counter(), Counter()
    for q, members in nodes.items():
        for d in range(len(q) + 1):
            leaves[q[:d]] += kids[q] == 0
            saved[q[:d]] += (len(members) - 1) * len(re.findall(WORDS, q[-1][1])) if q else 0
    ends = {q: ",".join(str(c) for c in sorted(m) if len(full[c]) == len(q)) for q, m in nodes.items()}
    return Counter((min(m), len(q), min(nodes[q[:-1]]) if q else None, len(m), kids[q], leaves[q], saved[q], hashlib.sha256(ends[q].encode()).hexdigest()) for q, m in nodes.items())


def odd_conversations():
    rng, rows = np.random.default_rng(5), []
    for c in [*range(-25, 45), *range(1000, 1030)]:
        same = "abc"[int(rng.integers(0, 3))]
        rows += [(c, t, "user" if t % 2 else None, f"{same} turn {t} " * int(rng.integers(1, 3))) for t in range(int(rng.integers(0, 6)))]
    rows += [(2000 + c, t, "user", f"all the same {t}") for c in range(0, 60) for t in range(9)]
    rows += [(5001, t, "user", f"one long tail {t}") for t in range(70)] + [(5002, None, "x", None), (5002, None, "a", ""), (5002, 3, "b", "tie"), (5002, 3, "a", "tie"), (None, 1, "user", "nobody")]
    rows += [(c, t, "user", f"shared {t}" if t < 20 else f"own {c} {t}") for c in (6001, 6002, 6004) for t in range(26)] + [(7003, 0, "user", "gone")]
    return rows


@pytest.mark.parametrize("limit", [1, 6, 40, 1 << 14])
def test_prefix_trie_brute_force(spark, limit, monkeypatch):
    """Copies, long private and shared tails, short and absent bases, ties, and upper nodes of every kind."""
    monkeypatch.setattr(prefix_trie, "PACK_BITS", 2)
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("x")).withColumn("conv", F.lit("y"))
    got = Counter(tuple(r) for r in prefix_trie.prefix_trie(df, limit).collect())
    assert got == brute_trie(rows)


def test_prefix_trie_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(none).count() == 0
    bare = [(3, 0, "user", "only")]  # 3 keeps nothing after its first turns, and 0 is absent
    df = spark.createDataFrame(bare, "conv_id long, turn long, role string, text string")
    assert Counter(tuple(r) for r in prefix_trie.prefix_trie(df).collect()) == brute_trie(bare)


def test_trie_bits():
    """Two tops, the first with two children."""
    bits = np.packbits([1, 1, 0, 1, 1, 0, 0, 0, 0]).tobytes()
    assert prefix_trie.parents_of(bits, 4).tolist() == [-1, -1, 0, 0]


def test_line_dedup_rows_of_one_id(spark, tmp_path):
    """Rows are documents: ten rows of one id lose their common line, in the query as in its SQL; nine keep theirs."""
    import duckdb

    rows = [(1, f"Same line\nown {i}") for i in range(10)] + [(2, f"other line\nown {i} too") for i in range(9)] + [(None, " SAME LINE\n"), (3, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == Counter(c.execute(queries.OP2_SQL).fetchall()) and sum(n for (i, _, dropped, _), n in got.items() if i == 1 and dropped == 1) == 10


def test_quality_scorer_brute_force(spark, monkeypatch):
    """The linear scorer against steps in plain Python over dictionaries, and the same sample whatever the partitions."""
    monkeypatch.setattr(quality, "EPOCHS", 12)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    posterior, weights, bias = quality.fit(docs)
    rows = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        b, offs = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        h, s, e, _ = B.word_spans(b, offs)
        counts = Counter(quality.features(b, h, s, e).tolist())
        kept = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: quality.FEATURES]
        rows.append(({k: float(np.float32(c / max(1, 3 * len(h)))) for k, c in kept}, float(posterior[quality.pattern(quality.votes(b, offs)[0])[0]])))
    good = sum(y >= 0.5 for _, y in rows)
    w, seen, b0, b_seen = Counter(), {}, 0.0, 1e-8
    for _ in range(12):
        grad, total = Counter(), 0.0
        for own, y in rows:
            z = sum(w[k] * x for k, x in own.items()) + b0
            d = (1 / (1 + math.exp(-max(-50, min(50, z)))) - y) * (0.5 / max(good, 1) if y >= 0.5 else 0.5 / max(len(rows) - good, 1))
            total += d
            for k, x in own.items():
                grad[k] += x * d
        for k in set(grad) | set(w):
            g = grad[k] + 1e-7 * w[k]
            seen[k] = seen.get(k, 1e-8) + g * g
            w[k] -= 2.0 * g / math.sqrt(seen[k])
        b_seen += total**2
        b0 -= 0.2 * total / math.sqrt(b_seen)
    assert bias == pytest.approx(b0, abs=1e-6) and all(weights[k] == pytest.approx(w[k], abs=1e-5) for k in w) and np.count_nonzero(weights) == sum(v != 0 for v in w.values())
    some = [quality.fit(df, sample=9) for df in (docs.repartition(1), docs.repartition(7))]
    assert some[0][2] == pytest.approx(some[1][2]) and np.allclose(some[0][1], some[1][1])


def test_trie_scan_over_ranges(spark, monkeypatch):
    """Places, xors and sums of conversations that span many ranges."""
    rng = np.random.default_rng(2)
    rows = [(c, t, int(rng.integers(-(1 << 62), 1 << 62)), int(rng.integers(-(1 << 62), 1 << 62)), int(rng.integers(0, 9))) for c, n in ((1, 3000), (2, 1), (3, 40), (4, 900)) for t in range(n)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conv long, t long, v1 long, v2 long, words long").repartition(5)
        made = prefix_trie.scan(df, ["conv", "t"], ["conv", "t"], ["conv", "t", "v1", "v2", "words"], "test")
        got = {(r.conv, r.t): (r.pos, r.x1, r.x2, r.sum) for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    want, last = {}, None
    for c, t, v1, v2, words in rows:
        pos, x1, x2, total = (0, 0, 0, 0) if c != last else now
        now, last = (pos + 1, x1 ^ v1, x2 ^ v2, total + words), c
        want[c, t] = now
    assert got == want
