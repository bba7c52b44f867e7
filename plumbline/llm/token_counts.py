"""Token counts by a separator scan over flat token files.

Contract. `write_tokens` encodes each text (as ordinary text, without special tokens) and writes the
identifiers, each document followed by one end-of-document identifier, into flat files cut into
blocks of a fixed number of tokens; documents straddle blocks. `count_tokens` finds the
separators of each block at once and stitches what lies across borders: the tokens that precede a
block's first separator since the last one come from a prefix scan over the blocks' tails.

Cases: ids are whole numbers, what can't be read as one raises an error; null and empty texts are a lone separator and count 0; a document may span many blocks
or end on a border; identifiers of the separator never come from text; repeated rows are counted
each; an empty table gives no blocks and no rows. Only id and text are read.

Scale. One pass encodes, one scans; blocks are independent of each other and of files. The scan
shuffles a row for each block, not for each token.
"""

from __future__ import annotations

import base64
import functools
import importlib.util

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _base as B

BLOCK = 1 << 17
FILES = "file long, block long, ids binary, doc_ids array<long>"
# fixed value: the public pre-tokenizer pattern of this vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    """The installed public byte-level vocabulary of 50,256 ranks."""
    return importlib.util.find_spec("public_tokenizers").submodule_search_locations[0] + "/byte_bpe_50k.tiktoken"


@functools.lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plumbline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int | None = None, block: int = BLOCK) -> tuple[DataFrame, int, str]:
    """Stored blocks (file, block, ids, doc_ids of the documents that end in it), the end's identifier, and numpy's type of identifiers.

    end: by default the first identifier that the vocabulary leaves free.
    """
    B.ship(B.session(docs))
    path = vocabulary or default_vocabulary()
    stop = encoder(path).max_token_value + 1 if end is None else end
    kind = "<u2" if stop < 1 << 16 else "<u4"

    def run(batches):
        enc, file, at = encoder(path), TaskContext.get().partitionId(), 0
        held, ids = [], []  # tokens not yet written; (place of the end, id)
        size = 0

        def cut(last: bool):
            nonlocal held, ids, size, at
            flat = np.concatenate(held) if held else np.zeros(0, kind)
            full = len(flat) if last else len(flat) // block * block
            ends = np.array([p for p, _ in ids], np.int64)
            for lo in range(0, full, block):
                hi = min(lo + block, full)
                a, z = np.searchsorted(ends, [lo, hi])
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([at], pa.int64()), pa.array([flat[lo:hi].tobytes()], pa.binary()), pa.array([[d for _, d in ids[a:z]]], pa.list_(pa.int64()))], ["file", "block", "ids", "doc_ids"])
                at += 1
            z = int(np.searchsorted(ends, full))
            held, ids, size = [flat[full:]], [(p - full, d) for p, d in ids[z:]], len(flat) - full

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.array(enc.encode_ordinary(text.as_py() or ""), kind)
                held += [own, np.array([stop], kind)]
                size += len(own) + 1
                ids.append((size - 1, doc))
                if size >= 8 * block:
                    yield from cut(False)
        if size:
            yield from cut(True)

    src = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return B.store(src.mapInArrow(B.lean(run), FILES), "tokens", "zstd"), stop, kind


def _scan(stop: int, kind: str):
    def run(batches):
        for batch in batches:
            rows = {"n": [], "tail": [], "lens": []}
            for raw in batch.column(2):
                ids = np.frombuffer(raw.as_buffer(), kind)
                at = np.flatnonzero(ids == stop)
                rows["n"].append(len(at))
                rows["tail"].append(len(ids) - 1 - at[-1] if len(at) else len(ids))
                rows["lens"].append(np.diff(at, prepend=-1) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows["n"], pa.int64()), pa.array(rows["tail"], pa.int64()), pa.array(rows["lens"], pa.list_(pa.int64())), batch.column(3)], ["file", "block", "n", "tail", "lens", "doc_ids"])

    return run


def count_tokens(blocks: DataFrame, stop: int, kind: str) -> DataFrame:
    """Rows (doc_id, n_tokens) from the flat files."""
    B.ship(B.session(blocks))
    found = B.store(blocks.select("file", "block", "ids", "doc_ids").mapInArrow(B.lean(_scan(stop, kind)), "file long, block long, n long, tail long, lens array<long>, doc_ids array<long>"), "scan")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = found.select("file", "block", "n", F.coalesce(F.sum("tail").over(before), F.lit(0)).alias("upto"))
    carry = sums.select("file", "block", (F.col("upto") - F.coalesce(F.max(F.when(F.col("n") > 0, F.col("upto"))).over(before), F.lit(0))).alias("carry"))
    docs = found.where("n > 0").join(carry, ["file", "block"]).select("carry", F.posexplode(F.arrays_zip("doc_ids", "lens")).alias("k", "x"))
    return docs.select(F.col("x.doc_ids").alias("doc_id"), (F.col("x.lens") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))
