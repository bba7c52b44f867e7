"""Language ID: multinomial naive Bayes over hashed character n-grams.

Contract. Documents with a language teach it; predictions see the text alone. Non-letters count
as one boundary, letters are lower-cased; features are each letter and the three characters around
it, hashed to `buckets`. lang_pred is a learned language, or `und` where the text is null or
has no letter (score 0) or nothing was learned; score is the posterior of the prediction.

Cases: null, empty and letterless texts are `und`; rows with a null language teach nothing; ties
go to the language that sorts first; an empty table gives an empty result. Only the named
columns are read, so other columns can't clash.

Scale. Every teaching document is counted: a task keeps one count array for each language and
emits it once, Spark sums (language, bucket) rows. The log-probability matrix has languages x
buckets entries whatever the input, `max_languages` bounds it; it is broadcast.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _base as B

BUCKETS = 1 << 16
NO_LETTER = "und"


@functools.lru_cache(1)
def letters() -> np.ndarray:
    """Lower-cased code point of each letter, 0 for all else."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low[0])
    return table


@np.errstate(over="ignore")
def features(col: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features and each row's offsets in them."""
    if col.null_count:
        col = col.fill_null("")
    chars = pc.utf8_length(col).to_numpy(zero_copy_only=False).astype(np.int64) + 1  # with one separator
    cps = np.frombuffer(("\n" + "\n".join(col.to_pylist()) + "\n").encode("utf-32-le"), np.uint32)
    a = letters()[cps].astype(np.uint64)
    at = np.flatnonzero(a)
    mid = a[at]
    tri = mid * B.MULT[0] + a[at - 1] * B.MULT[1] + a[at + 1] * B.MULT[2]
    shift = np.uint64(64 - buckets.bit_length() + 1)
    out = np.empty(2 * len(at), np.int64)
    out[0::2] = (mid * B.MULT[3]) >> shift
    out[1::2] = ((tri ^ (tri >> np.uint64(29))) * B.MULT[4]) >> shift
    starts = np.concatenate([[1], 1 + np.cumsum(chars)])
    return out, 2 * np.searchsorted(at, starts)


def _counts(buckets: int):
    def run(batches):
        total: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for batch in batches:
            _, offs = B.text_buffers(batch.column(0))
            for lo, hi in B.row_blocks(offs, B.PIECE):
                grams, at = features(batch.column(0).slice(lo, hi - lo), buckets)
                langs = batch.column(1).slice(lo, hi - lo).to_pylist()
                rows = np.repeat(np.arange(hi - lo), np.diff(at))
                for lang in set(langs):
                    own = np.array([x == lang for x in langs])
                    total[lang] = total.get(lang, 0) + np.bincount(grams[own[rows]], minlength=buckets)
                    n[lang] = n.get(lang, 0) + int(own.sum())
        for lang, c in total.items():
            at = np.flatnonzero(c)
            at_all = np.concatenate([[-1], at])  # -1: number of documents
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at_all), pa.string()), pa.array(at_all.astype(np.int32)), pa.array(np.concatenate([[n[lang]], c[at]]).astype(np.int64))], ["lang", "bucket", "n"])

    return run


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, smoothing: float = 0.5, max_languages: int = 1000) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, log prior, and log probability (languages x buckets)."""
    B.ship(B.session(rows))
    taught = rows.where(F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col).cast("string"))
    counts = taught.mapInArrow(B.lean(_counts(buckets)), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = B.store(counts, "ngrams")
    langs = sorted(r[0] for r in counts.select("lang").distinct().limit(max_languages + 1).collect())
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    m, docs = np.full((len(langs), buckets), smoothing), np.ones(len(langs))
    got = counts.toArrow()  # at most languages x (buckets + 1) rows
    li = np.searchsorted(langs, got.column("lang").to_pylist()) if langs else np.zeros(0, int)
    bi, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    docs[li[bi < 0]] += n[bi < 0]
    m[li[bi >= 0], bi[bi >= 0]] += n[bi >= 0]
    return langs, np.log(docs / docs.sum()) if langs else docs, np.log(m / m.sum(axis=1, keepdims=True)) if langs else m


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs with the prediction and its score."""
    spark = B.session(docs)
    B.ship(spark)
    langs, prior, logp = model
    buckets = logp.shape[1]
    shared = spark.sparkContext.broadcast((prior, np.ascontiguousarray(logp.astype(np.float32))))
    src = docs.select(*keep, F.col(text_col).alias("__text"))
    names_all = [*keep, *names]
    schema = src.drop("__text").withColumn(names[0], F.lit("")).withColumn(names[1], F.lit(0.0)).schema

    def run(batches):
        prior, logp = shared.value
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            _, offs = B.text_buffers(col)
            for lo, hi in B.row_blocks(offs, B.PIECE):
                grams, at = features(col.slice(lo, hi - lo), buckets)
                scores = np.empty((hi - lo, len(langs)))
                for j in range(len(langs)):
                    run_sum = np.concatenate([[0.0], np.cumsum(logp[j][grams], dtype=np.float64)])
                    scores[:, j] = prior[j] + run_sum[at[1:]] - run_sum[at[:-1]]
                some = np.diff(at) > 0
                if langs:
                    best = scores.argmax(axis=1)
                    post = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
                    pred = [langs[k] if ok else NO_LETTER for k, ok in zip(best, some)]
                    post = np.where(some, np.clip(post, 0, 1), 0.0)
                else:
                    pred, post = [NO_LETTER] * (hi - lo), np.zeros(hi - lo)
                cols = [batch.column(c).slice(lo, hi - lo) for c in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(post)], names_all)

    return src.mapInArrow(B.lean(run), schema)


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds
