"""Quality classifier from weak labels.

Contract. Heuristic labellers vote good, bad or nothing on each text. Expectation-maximisation
estimates how often each labeller gives each vote in either class and the classes' shares;
each pattern of votes gets its posterior. A linear scorer over hashed word features learns
the posteriors of a bounded sample and scores every text from 0 to 1; `kept` means its score is
at least `least`; ties of posteriors and scores at their bounds count as good.

Cases: null, empty and wordless texts have no votes and no features: weak label and score are 0
and they aren't kept; an empty table gives an empty result; repeated rows score alike. Only
the named columns are read.

Scale. Votes over all documents are summed by pattern, of which there are 3 ** labellers at
most; only these sums reach the driver. The scorer is fitted on about `sample` documents by hash
of id and text, twice as many at most and each by its FEATURES most frequent features at most: the single bounded
step. Its weights are one array of `BUCKETS` numbers. All texts are scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _base as B

BUCKETS, SAMPLE, EPOCHS, FEATURES = 1 << 16, 4000, 60, 2048
# fixed values: bad beyond the first bound, plain within the second
SYMBOLS = b"#$%&*{}[]<>|\\^~=_@+`"
BOUNDS = {"symbols": (0.05, 0.01), "capitals": (0.4, 0.2), "exclaims": (0.05, 0.01), "digits": (0.3, 0.1), "long_words": (14.0, 10.0), "repeated_lines": (0.3, 0.1), "repeated_words": (0.8, 0.65), "echoes": (0.2, 0.06)}
JUNK = list(BOUNDS)
#: those with bounds vote bad or nothing, the last two vote good or nothing
FORM, WORDS = ("symbols", "capitals", "exclaims", "digits"), ("long_words", "repeated_lines", "repeated_words", "echoes")
LABELLERS = [*JUNK, "plain_form", "plain_words"]


def _rates(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labeller measures of each row, its number of words; word hashes, ends and row offsets."""
    h, s, e, at = B.word_spans(b, offs)
    n_words, n = np.diff(at), np.maximum(np.diff(offs), 1)

    def share(mask):
        run = np.concatenate([[0], np.cumsum(mask)])
        return run[offs[1:]] - run[offs[:-1]]

    sym = np.zeros(256, bool)
    sym[list(SYMBOLS)] = True
    upper, lower = share((b >= 65) & (b <= 90)), share((b >= 97) & (b <= 122))
    length = np.concatenate([[0], np.cumsum(e - s)])
    measures = np.zeros((len(n), len(JUNK)))
    measures[:, 0] = share(sym[b]) / n
    measures[:, 1] = upper / np.maximum(upper + lower, 1)
    measures[:, 2] = share(b == 33) / n
    measures[:, 3] = share((b >= 48) & (b <= 57)) / n
    measures[:, 4] = (length[at[1:]] - length[at[:-1]]) / np.maximum(n_words, 1)
    echo = np.concatenate([[False], h[1:] == h[:-1]])[: len(h)]
    echo[at[:-1][at[:-1] < len(h)]] = False  # a row's first word repeats nothing
    run = np.concatenate([[0], np.cumsum(echo)])
    measures[:, 7] = np.where(n_words >= 5, (run[at[1:]] - run[at[:-1]]) / np.maximum(n_words, 1), np.nan)
    for i in range(len(n)):
        lines = [x for x in b[offs[i] : offs[i + 1]].tobytes().split(b"\n") if x.strip()]
        measures[i, 5] = 1 - len(set(lines)) / len(lines) if len(lines) > 2 else np.nan
        measures[i, 6] = 1 - len(np.unique(h[at[i] : at[i + 1]])) / n_words[i] if n_words[i] >= 50 else np.nan
    return measures, n_words, h, e, at


def votes(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """-1 bad, 1 good, 0 no vote, for each row and labeller; number of words."""
    m, n, *_ = _rates(b, offs)
    bad, plain = (np.array([BOUNDS[x][k] for x in JUNK]) for k in (0, 1))
    with np.errstate(invalid="ignore"):
        v = np.where(m > bad, -1, 0)
        fine = ~(m > plain)  # what can't be measured is fine
    good = [fine[:, [JUNK.index(x) for x in group]].all(axis=1) for group in (FORM, WORDS)]
    v = np.concatenate([v, np.stack(good, axis=1).astype(int)], axis=1)
    v[n == 0] = 0
    return v, n


def pattern(v: np.ndarray) -> np.ndarray:
    return ((v + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def em(v: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern; P(vote | class) as [labeller, class, vote]; share of good."""
    n = n.astype(float)
    post = np.where((v < 0).any(axis=1), 0.05, 0.9)  # a bad vote starts as bad
    table, good = np.zeros((v.shape[1], 2, 3)), 0.5
    for _ in range(rounds):
        w = np.stack([(1 - post) * n, post * n])
        good = float(np.clip(w[1].sum() / max(w.sum(), 1e-9), 0.01, 0.99))
        for j in range(v.shape[1]):
            for c in range(2):
                own = np.bincount(v[:, j] + 1, weights=w[c], minlength=3) + 1.0
                table[j, c] = own / own.sum()
        log = np.stack([np.full(len(v), np.log(1 - good)), np.full(len(v), np.log(good))])
        for j in range(v.shape[1]):
            log += np.log(table[j][:, v[:, j] + 1])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            post = new
            break
        post = new
    return post, table, good


@np.errstate(over="ignore")
def features(b: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Three buckets a word: itself, its last two bytes, and its shape."""
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    last, prior = b[e - 1].astype(np.uint64), np.where(e - 2 >= s, b[np.maximum(e - 2, 0)], 0).astype(np.uint64)
    kind = np.zeros(256, np.uint64)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 1, 2, 3, 4
    shape = kind[b[s]] * np.uint64(125) + kind[last] * np.uint64(25) + kind[prior] * np.uint64(5) + np.minimum((e - s) // 5, 4).astype(np.uint64)
    out = np.empty(3 * len(h), np.int64)
    out[0::3] = (h * B.MULT[0]) >> shift
    out[1::3] = B.mix(last * np.uint64(256) + prior + B.MULT[1]) >> shift
    out[2::3] = B.mix(shape + B.MULT[2]) >> shift
    return out


def _vote(batches):
    for batch in batches:
        b, offs = B.text_buffers(batch.column(0))
        for lo, hi in B.row_blocks(offs, B.PIECE):
            v, n = votes(b[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            k, c = np.unique(pattern(v)[n > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["pattern", "n"])


def _sampled(batches):
    for batch in batches:
        b, offs = B.text_buffers(batch.column(0))
        for lo, hi in B.row_blocks(offs, B.PIECE):
            own, o = b[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            v, n = votes(own, o)
            h, s, e, at = B.word_spans(own, o)
            f = features(own, h, s, e)
            ids, shares = [], []
            for i in range(hi - lo):
                k, c = np.unique(f[3 * at[i] : 3 * at[i + 1]], return_counts=True)
                if len(k) > FEATURES:
                    top = np.sort(np.argsort(-c, kind="stable")[:FEATURES])
                    k, c = k[top], c[top]
                ids.append(k.astype(np.int32))
                shares.append((c / max(1, 3 * n[i])).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(pattern(v)), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["pattern", "ids", "shares"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE):
    """Posterior of each vote pattern, weights and bias of the scorer."""
    B.ship(B.session(docs))
    seen = docs.select(F.col(text_col)).mapInArrow(B.lean(_vote), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    got = seen.toArrow()  # at most 3 ** labellers rows
    k, n = got.column("pattern").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(k)
    k, n = k[order], n[order]
    v = (k[:, None] // 3 ** np.arange(len(LABELLERS))) % 3 - 1
    post, _, _ = em(v, n)
    posterior = np.zeros(3 ** len(LABELLERS))
    posterior[k] = post
    every = max(1, int(n.sum()) // sample)
    own = F.xxhash64(F.col(id_col), F.col(text_col))
    some = docs.where(F.pmod(own, F.lit(every)) == 0).select(F.col(text_col)).orderBy(own).limit(2 * sample)  # the same rows in every run
    got = some.mapInArrow(B.lean(_sampled), "pattern long, ids array<int>, shares array<float>").toArrow().combine_chunks()
    weights, bias = np.zeros(BUCKETS), 0.0
    if len(got):
        y = posterior[got.column("pattern").to_numpy()]
        ids, shares = got.column("ids").combine_chunks(), got.column("shares").combine_chunks()
        sizes = np.diff(ids.offsets.to_numpy())
        ids, shares = ids.flatten().to_numpy(), shares.flatten().to_numpy().astype(float)
        rows = np.repeat(np.arange(len(y)), sizes)
        balance = np.where(y >= 0.5, 0.5 / max((y >= 0.5).sum(), 1), 0.5 / max((y < 0.5).sum(), 1))
        grads, grad_bias = np.full(BUCKETS, 1e-8), 1e-8
        for _ in range(EPOCHS):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=shares * weights[ids], minlength=len(y)) + bias, -50, 50)))
            d = (p - y) * balance
            g = np.bincount(ids, weights=shares * d[rows], minlength=BUCKETS) + 1e-7 * weights
            grads += g * g
            weights -= 2.0 * g / np.sqrt(grads)
            grad_bias += d.sum() ** 2
            bias -= 0.2 * d.sum() / np.sqrt(grad_bias)
    return posterior, weights, bias


def score(docs: DataFrame, model, keep: list[str], text_col: str = "text", least: float = 0.5, names: tuple[str, str, str] = ("weak_label", "score", "kept")) -> DataFrame:
    """The columns `keep` of docs with the posterior of their votes, the scorer's probability of good, and kept."""
    spark = B.session(docs)
    B.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])

    def run(batches):
        posterior, weights, bias = shared.value
        for batch in batches:
            b, offs = B.text_buffers(batch.column(batch.num_columns - 1))
            for lo, hi in B.row_blocks(offs, B.PIECE):
                own, o = b[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                v, n = votes(own, o)
                h, s, e, at = B.word_spans(own, o)
                run_sum = np.concatenate([[0.0], np.cumsum(weights[features(own, h, s, e)])])
                z = (run_sum[3 * at[1:]] - run_sum[3 * at[:-1]]) / np.maximum(3 * n, 1) + bias
                p = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)
                weak = np.where(n > 0, posterior[pattern(v)], 0.0)
                cols = [batch.column(c).slice(lo, hi - lo) for c in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(weak), pa.array(p), pa.array((n > 0) & (p >= least))], schema.names)

    return src.mapInArrow(B.lean(run), schema)
