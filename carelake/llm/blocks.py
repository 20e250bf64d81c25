"""Counting keys over all documents in blocks.

Documents are dealt into blocks of about ``BLOCK_BYTES`` of text. A block sends every
distinct key it holds once, with its count, as packed arrays: one row per bucket of keys.
A bucket adds up what all blocks sent and answers each of them with one byte per key, in
the order sent: the class of the key's total. The block, met again by its number, derives
the same keys from the same texts and so needs no positions sent along.

A key that a third of all documents hold is sent once per block, so buckets stay even.
Both sides of the exchange are bounded: blocks by their bytes, buckets by ``BUCKET_BYTES``
of text each. The text itself is shuffled once; its exchange is reused by every pass."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import ship

BLOCK_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20
PACKED = "bucket int, block long, keys binary, counts binary"
ANSWER = "block long, kind int, bucket int, classes binary"


@dataclass(frozen=True)
class Blocks:
    """Documents with their block, and the numbers of blocks and buckets that fit their size."""

    docs: DataFrame
    n_blocks: int
    bucket_bits: int


def block_of(n_blocks: int, *cols: str):
    return F.pmod(F.xxhash64(*cols), F.lit(n_blocks))


def in_blocks(df: DataFrame, id_col: str, text_col: str, by_text: bool = True) -> Blocks:
    """``by_text``: rows that share an id may lie in different blocks."""
    ship(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(1))).first()[0]
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    docs = docs.withColumn("block", block_of(n_blocks, "doc_id", *["text"] * by_text))
    return Blocks(docs, n_blocks, max(1, int(-(-size // BUCKET_BYTES)).bit_length()))


def in_order(docs: pa.Table) -> pa.Table:
    """A block's documents in an order that does not depend on how they arrived."""
    return docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def pack(block: int, keys: np.ndarray, counts: np.ndarray, bits: int, width: int = 8) -> pa.Table:
    """Sorted distinct uint64 ``keys`` by bucket, which is their leading ``bits``. A key is
    sent as 8 bytes, or as the low 4 where the caller made keys of bits + 32 bits."""
    top = 64 if width == 8 else bits + 32
    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(top - bits))
    edges = np.concatenate(([0], edges, [len(keys)]))
    full = np.nonzero(np.diff(edges))[0]
    sent = keys if width == 8 else keys.astype(np.uint32)
    counts = np.minimum(counts, 255).astype(np.uint8)
    return pa.table({
        "bucket": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), block, np.int64)),
        "keys": pa.array([sent[edges[b]:edges[b + 1]].tobytes() for b in full], pa.binary()),
        "counts": pa.array([counts[edges[b]:edges[b + 1]].tobytes() for b in full], pa.binary())})


def answer(kind: int, width: int = 8):
    """The bucket's side: the class of a key is floor(log2(its total)), so 0 means once."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64 if width == 8 else np.uint32) for x in rows["keys"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["counts"].to_pylist()])
        found, at = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(found))
        classes = np.floor(np.log2(total)).astype(np.uint8)[at]
        cuts = np.cumsum([len(x) for x in parts])[:-1]
        return pa.table({
            "block": rows["block"], "kind": pa.array(np.full(len(rows), kind, np.int32)),
            "bucket": rows["bucket"],
            "classes": pa.array([x.tobytes() for x in np.split(classes, cuts)], pa.binary())})
    return run


def classes_of(answers: pa.Table, kind: int, n_keys: int) -> np.ndarray:
    """One class per key, in the order of the block's sorted distinct keys."""
    mine = answers.filter(pa.array(answers["kind"].to_numpy() == kind)).sort_by("bucket")
    found = np.frombuffer(b"".join(mine["classes"].to_pylist()), np.uint8)
    if len(found) != n_keys:
        raise RuntimeError(f"a block sent {n_keys} keys and got {len(found)} answers")
    return found
