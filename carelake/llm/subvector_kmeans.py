"""Exact k-means over subvector dictionaries.

Vectors become integers, ``floor(scale * x)``. Rows are packed in chunks of bounded size, and
every chunk is encoded without loss: blocks of neighbouring dimensions become dictionaries of
their distinct subvectors and one code per row. Blocks start as single dimensions; two
neighbours join while their distinct pairs stay a small share of the rows, so blocks are as
wide as the data repeat themselves. In a round the exact squared distances of every distinct
subvector to the centroids are computed once, a row's distances are the sums of its codes'
entries, and a cluster's component sums come from how often it holds each code. Only k sums
per component leave a task; the driver holds the centroids, which is k vectors.

The centroids start as the k rows whose ids hash lowest (sha256 of ``<seed>:<id>``, in hex).
A round assigns every row to the nearest centroid (ties: the smaller number), then sets
every centroid that has rows to the floor of their mean; after the last round rows are
assigned once more. All of it is integer arithmetic.

Defined results: vectors that are null, of another length or hold null or non-finite
components take no part; rows without an id are assigned but start no centroid; repeated
rows are rows each, also as starting centroids (equal ones leave the later cluster empty);
with fewer rows than k there are fewer centroids; an empty table, or one where no row has an
id, gives no rows; other columns are ignored. Components beyond ``LARGEST`` raise
ArithmeticError, as squared distances would pass 64 bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import ship, staged
from carelake.llm.vectors import dense

CHUNK = 16384
GAIN = 8
LARGEST = 1 << 26
ENCODED = "ids array<long>, widths array<int>, dictionaries array<binary>, codes array<binary>"
TOTALS = "cluster int, place int, total decimal(38,0)"
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
_COUNT, _INERTIA = -1, -2


def encode_blocks(matrix: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct subvectors, code of every row) of every block of dimensions, in order."""
    most = max(1, len(matrix) // GAIN)
    blocks = []
    for column in matrix.T:
        values, codes = np.unique(column, return_inverse=True)
        blocks.append((values[:, None], codes))
    grown = True
    while grown:  # neighbours of equal standing join, level by level
        grown, joined, at = False, [], 0
        while at < len(blocks):
            pair = None
            if at + 1 < len(blocks):
                (left, a), (right, b) = blocks[at], blocks[at + 1]
                if max(len(left), len(right)) <= most:
                    found, codes = np.unique(a.astype(np.int64) * len(right) + b, return_inverse=True)
                    if len(found) <= most:
                        pair = np.hstack((left[found // len(right)], right[found % len(right)])), codes
            joined.append(pair or blocks[at])
            at += 2 if pair else 1
            grown |= pair is not None
        blocks = joined
    return blocks


class Chunk:
    """A row of the encoded table."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.blocks, at = [], 0
        for width, values, codes in zip(row["widths"], row["dictionaries"], row["codes"], strict=True):
            self.blocks.append((slice(at, at + width), np.frombuffer(values, np.int64).reshape(-1, width), np.frombuffer(codes, np.uint16)))
            at += width
        self.dims = at

    def rows(self, which) -> np.ndarray:
        """The vectors of some rows, decoded."""
        return np.hstack([values[codes[which]] for _, values, codes in self.blocks])

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of every row."""
        total = np.zeros((len(centroids), len(self.ids)), np.int64)
        for place, values, codes in self.blocks:
            partial = np.square(values[None] - centroids[:, None, place]).sum(axis=2)
            total += partial[:, codes]
        cluster = total.argmin(axis=0)
        return cluster, np.take_along_axis(total, cluster[None], 0)[0]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Component sums by cluster, from the number of rows of every code."""
        out = np.zeros((k, self.dims), np.int64)
        for place, values, codes in self.blocks:
            held = np.bincount(cluster * len(values) + codes, minlength=k * len(values)).reshape(k, -1)
            out[:, place] = held @ values
        return out


def _encoded(scale: float, dims: int):
    def pack(ids: list, matrix: np.ndarray) -> pa.RecordBatch:
        whole = np.floor(scale * matrix)
        if np.abs(whole).max(initial=0) > LARGEST:
            raise ArithmeticError(f"a component reaches {np.abs(whole).max():g}; squared distances need {LARGEST} at most")
        blocks = encode_blocks(whole.astype(np.int64))
        return pa.RecordBatch.from_pydict({
            "ids": pa.array([ids], pa.list_(pa.int64())),
            "widths": pa.array([[values.shape[1] for values, _ in blocks]], pa.list_(pa.int32())),
            "dictionaries": pa.array([[np.ascontiguousarray(values).tobytes() for values, _ in blocks]], pa.list_(pa.binary())),
            "codes": pa.array([[codes.astype(np.uint16).tobytes() for _, codes in blocks]], pa.list_(pa.binary()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = [], [], 0
        for batch in batches:
            names = batch.column("vec_id").to_pylist()
            for at, matrix in dense(batch.column("vec")):
                if matrix.shape[1] != dims:
                    continue
                for lo in range(0, len(at), CHUNK):
                    ids += [names[i] for i in at[lo:lo + CHUNK]]
                    held.append(matrix[lo:lo + CHUNK])
                    n += len(held[-1])
                    if n >= CHUNK:
                        every = np.concatenate(held)
                        yield pack(ids[:CHUNK], every[:CHUNK])
                        ids, held, n = ids[CHUNK:], [every[CHUNK:]], n - CHUNK
        if n:
            yield pack(ids, np.concatenate(held))
    return run


def encoded(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0, dims: int = 64) -> DataFrame:
    """The chunks of ``df``, staged: no shuffle, one row per CHUNK vectors of a task."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    return staged(rows.mapInArrow(_encoded(scale, dims), ENCODED), "subvectors")


def _lowest(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                hashes = sorted((hashlib.sha256(f"{seed}:{x}".encode()).hexdigest(), i) for i, x in enumerate(chunk.ids) if x is not None)
                # equal ids may stand for different vectors, so all rows of the last hash go on
                first = [i for h, i in hashes if h <= hashes[min(k, len(hashes)) - 1][0]]
                if first:
                    vectors = chunk.rows(first).tolist()
                    best = sorted(zip([h for h, _ in hashes], vectors, strict=False))[:k]
                    yield pa.RecordBatch.from_pydict({"hash": [h for h, _ in best], "vec": pa.array([v for _, v in best], pa.list_(pa.int64()))})
    return run


def _exact_sum(x: np.ndarray) -> int:
    """Of non-negative 64-bit numbers, without overflow."""
    return (int((x >> 31).sum()) << 31) + int((x & (2 ** 31 - 1)).sum())


def _totals(centroids: np.ndarray):
    """Counts, inertia and component sums of every cluster in a task's chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, found = len(centroids), {}
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                cluster, distance = chunk.assign(centroids)
                sums = chunk.sums(cluster, k)
                for c in np.unique(cluster):
                    mine = cluster == c
                    for place, x in ((_COUNT, int(mine.sum())), (_INERTIA, _exact_sum(distance[mine])), *enumerate(sums[c].tolist())):
                        found[int(c), place] = found.get((int(c), place), 0) + x
        keys = sorted(found)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array([c for c, _ in keys], pa.int32()), "place": pa.array([p for _, p in keys], pa.int32()),
            "total": pa.array([found[x] for x in keys], pa.decimal128(38, 0))})
    return run


def totals(chunks: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """By (cluster, component), with the count and the inertia; k times (dims + 2) numbers."""
    rows = chunks.mapInArrow(_totals(centroids), TOTALS).groupBy("cluster", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
    return {(r.cluster, r.place): int(r.total) for r in rows.collect()}


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 10,
            scale: float = 1024.0, dims: int = 64, seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row per vector."""
    spark = df.sparkSession
    chunks = encoded(df, id_col, vec_col, scale, dims)
    first = chunks.mapInArrow(_lowest(k, seed), "hash string, vec array<long>").orderBy("hash", "vec").limit(k).collect()
    if not first:
        return spark.createDataFrame([], OUT)
    centroids = np.array([r.vec for r in first], np.int64).reshape(len(first), dims)
    for _ in range(rounds):
        found, moved = totals(chunks, centroids), centroids.copy()
        for c in range(len(centroids)):
            if (c, _COUNT) in found:  # Python's division of integers is the floor
                moved[c] = [found[c, d] // found[c, _COUNT] for d in range(dims)]
        if (moved == centroids).all():
            break
        centroids = moved
    found = totals(chunks, centroids)
    inertia = [found.get((c, _INERTIA), 0) for c in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    return chunks.mapInArrow(_assigned(centroids, inertia, names), OUT)


def _assigned(centroids: np.ndarray, inertia: list[int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                cluster, distance = chunk.assign(centroids)
                n = len(cluster)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": pa.array(chunk.ids, pa.int64()), "cluster": pa.array(cluster, pa.int32()), "distance": distance,
                    "cluster_inertia": pa.array(inertia, pa.int64()).take(pa.array(cluster)),
                    "inertia": pa.array([sum(inertia)] * n, pa.int64()),
                    "centroid_sha256": pa.array(names, pa.string()).take(pa.array(cluster))})
    return run
