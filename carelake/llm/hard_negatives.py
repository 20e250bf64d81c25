"""Hard-negative mining by residue-number-system products.

Vectors become integers, ``floor(scale * x)``. Their inner products are exact though every
matrix product runs in float32: components are reduced modulo several primes under 1024 to
residues around zero, so a product over ``SLICE`` components stays under 2**24, where float32
holds every integer; slices are added modulo the prime. The signed score comes back by
Chinese remaindering. As many primes are used as the norms at hand ask for.

The anchors are the stated query set. They are taken in tiles of bounded size; every task
goes once over its rows for a tile and keeps, for each anchor, only the best so far, so no
vector is shuffled and only short lists meet. A first pass finds an anchor's positives, a
second one the different-label rows inside the score window of each positive.

Defined results: rows with a null id, label or vector or with a null or non-finite component
take no part; only vectors of one length are compared (empty ones have the score 0); rows
that share the anchor's id are not its candidates; ties go to the smaller id; a repeated row
is a candidate each time and asks once; rows that share an id but differ ask each for
themselves; an anchor without positives or negatives gives no rows; an empty table gives no
rows; other columns are ignored. Scores that may pass what all primes hold (2**48) raise
ArithmeticError rather than wrap."""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import ship
from carelake.llm.vectors import NONE, Best, by_tile, dense, in_tiles, plain

TILE = 8192
BLOCK = 256
SLICE = 64
#: Residues reach half a prime, so a slice's product stays under 2**24 for primes up to here.
_TOP = 1024
PRIMES = [p for p in range(_TOP - 1, 2, -1) if all(p % q for q in range(2, 33))][:5]
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _reduced(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` modulo p around zero (p/2 may be passed by the rounding of the quotient)."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


class Residues:
    """An integer matrix by its residues, made per prime when first asked for."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.parts = matrix, {}
        self.norm = float(np.sqrt(np.square(matrix).sum(axis=1)).max(initial=0))

    def modulo(self, p: int) -> np.ndarray:
        if p not in self.parts:
            rest = np.mod(self.matrix, p)
            self.parts[p] = np.where(rest > p // 2, rest - p, rest).astype(np.float32)
        return self.parts[p]


def primes_for(bound: float) -> list[int]:
    """The fewest primes (two at least) whose product tells all scores up to ``bound`` apart."""
    for n in range(2, len(PRIMES) + 1):
        if prod(PRIMES[:n]) > 2 * bound * (1 + 1e-6) + 2:
            return PRIMES[:n]
    raise ArithmeticError(f"inner products may reach {bound:g}, beyond what {len(PRIMES)} primes hold")


def product_modulo(left: np.ndarray, right: np.ndarray, p: int) -> np.ndarray:
    """left @ right.T modulo p, around zero, slice by slice in float32."""
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, left.shape[1], SLICE):
        total = _reduced(total + left[:, at:at + SLICE] @ right[:, at:at + SLICE].T, p)
    return total


def reconstruct(residues: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed integers with these residues, by mixed-radix Chinese remaindering."""
    whole, base = residues[0].astype(np.int64) % primes[0], primes[0]
    for rest, p in zip(residues[1:], primes[1:], strict=True):
        digit = (rest.astype(np.int64) - whole) % p * pow(base, -1, p) % p
        whole, base = whole + base * digit, base * p
    return np.where(whole > base // 2, whole - base, whole)


def exact_products(left: Residues, right: Residues, rows: slice) -> np.ndarray:
    """Exact integer inner products of some rows of ``left`` with all of ``right``."""
    primes = primes_for(left.norm * right.norm)
    return reconstruct([product_modulo(left.modulo(p)[rows], right.modulo(p), p) for p in primes], primes)


class _Tile:
    """A tile's anchors, by vector length, in an order of their own."""

    def __init__(self, rows: pa.Table, scale: float):
        self.ids, self.labels, self.parts = [], [], {}
        n = 0
        for at, matrix in dense(rows["vec"]):
            self.ids.append(rows["vec_id"].to_numpy()[at])
            self.labels.append(rows["label"].combine_chunks().to_numpy(zero_copy_only=False)[at])
            self.parts[matrix.shape[1]] = (np.arange(n, n + len(at)), np.floor(scale * matrix))
            n += len(at)
        self.ids, self.labels = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.ids, self.labels))

    def scored(self, batches: Iterator[pa.RecordBatch], scale: float):
        """(anchors, ids, same label, score) over blocks of anchors and batches of rows; ids
        ascend and the anchor's own rows score NONE."""
        mine = {size: (askers, Residues(matrix)) for size, (askers, matrix) in self.parts.items()}
        for batch in batches:
            for at, matrix in dense(batch.column("vec")):
                if matrix.shape[1] not in mine:
                    continue
                askers, left = mine[matrix.shape[1]]
                ids = batch.column("vec_id").to_numpy()[at]
                order = np.argsort(ids, kind="stable")
                ids, labels = ids[order], batch.column("label").to_numpy(zero_copy_only=False)[at][order]
                right = Residues(np.floor(scale * matrix[order]))
                for lo in range(0, len(askers), BLOCK):
                    part = askers[lo:lo + BLOCK]
                    scores = exact_products(left, right, slice(lo, lo + BLOCK))
                    scores[self.ids[part][:, None] == ids] = NONE
                    yield part, ids, self.labels[part][:, None] == labels, scores


def _positives(tile, scale: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(tile.value.ids), k)
        for askers, ids, same, scores in tile.value.scored(batches, scale):
            best.add(askers, np.where(same, scores, NONE), ids)
        asker, other, score = best.found()
        yield pa.RecordBatch.from_pydict({"asker": pa.array(asker, pa.int64()), "vec_id": other, "score": score})
    return run


def _negatives(tile, positives, scale: float, k: int, window: tuple[int, int, int]):
    low, high, unit = window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = positives.value
        lists = [Best(len(bounds), k) for _ in range(bounds.shape[1])]
        for askers, ids, same, scores in tile.value.scored(batches, scale):
            for j, best in enumerate(lists):
                asked = bounds[askers, j][:, None]
                inside = ~same & (asked != NONE) & (scores != NONE) & (scores * unit >= low * asked) & (scores * unit <= high * asked)
                some = inside.any(axis=1)
                if some.any():
                    best.add(askers[some], np.where(inside[some], scores[some], NONE), ids)
        for j, best in enumerate(lists):
            asker, other, score = best.found()
            yield pa.RecordBatch.from_pydict({
                "asker": pa.array(asker, pa.int64()), "place": pa.array(np.full(len(asker), j), pa.int64()),
                "vec_id": other, "score": score})
    return run


def _first(lists: DataFrame, k: int, *by: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding",
         label: Column | str = "label", scale: float = 256.0, n_positives: int = 5, n_negatives: int = 5,
         window: tuple[int, int] = (80, 100), tile_rows: int = TILE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). An
    anchor's positives are its first ``n_positives`` other rows of the same label; for each,
    the first ``n_negatives`` rows of another label whose score lies within ``window`` per
    cent of the positive's."""
    spark = df.sparkSession
    ship(spark)
    label = F.col(label) if isinstance(label, str) else label
    rows = plain(df, id_col, vec_col, label=label, asks=F.coalesce(is_anchor, F.lit(False))).where("label IS NOT NULL")
    anchors, n_tiles = in_tiles(rows.where("asks").drop("asks"), tile_rows, "vec_id", "label", "vec")
    rows, share = rows.drop("asks"), np.gcd.reduce([*window, 100])
    limits = (window[0] // share, window[1] // share, 100 // share)

    def answer(found: pa.Table) -> DataFrame | None:
        tile = spark.sparkContext.broadcast(_Tile(found, scale))
        lists = rows.mapInArrow(_positives(tile, scale, n_positives), "asker long, vec_id long, score long")
        chosen = _first(lists, n_positives, "asker").toArrow()
        bounds, names = (np.full((len(tile.value.ids), n_positives), fill) for fill in (NONE, 0))
        at = chosen["asker"].to_numpy(), chosen["rank"].to_numpy() - 1
        bounds[at], names[at] = chosen["score"].to_numpy(), chosen["vec_id"].to_numpy()
        positives = spark.sparkContext.broadcast(bounds)
        lists = rows.mapInArrow(_negatives(tile, positives, scale, n_negatives, limits),
                                "asker long, place long, vec_id long, score long")
        kept = _first(lists, n_negatives, "asker", "place")
        return kept.mapInArrow(_named(spark.sparkContext.broadcast((tile.value.ids, names)), positives), OUT)

    return by_tile(anchors, n_tiles, answer, OUT)


def _named(names, positives):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asker, place = batch.column("asker").to_numpy(), batch.column("place").to_numpy()
            yield pa.RecordBatch.from_pydict({
                "anchor_id": names.value[0][asker], "positive_id": names.value[1][asker, place], "rank": batch.column("rank"),
                "negative_id": batch.column("vec_id"), "positive_score": positives.value[asker, place],
                "negative_score": batch.column("score")})
    return run
