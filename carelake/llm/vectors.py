"""Small helpers of the vector operators: dense matrices from Arrow lists, tiles of a stated
query set, running lists of the best."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import ship, staged
from carelake.session import ensure_checkpoint_dir

#: No score of an integer product is as low as this.
NONE = np.iinfo(np.int64).min


def dense(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) of the usable vectors, by vector length. Null vectors
    and those with a null or non-finite component are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    for size in np.unique(sizes[sizes >= 0]):
        rows = np.nonzero(sizes == size)[0]
        if len(rows) * size == len(flat):
            matrix = flat.reshape(len(rows), size)
        else:
            matrix = flat[begin[rows][:, None] + np.arange(size)]
        fine = np.isfinite(matrix).all(axis=1)
        yield (rows, matrix) if fine.all() else (rows[fine], matrix[fine])


def first_k(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of every row; of equal ones those further left.
    With fewer than k columns, all of them."""
    n = scores.shape[1]
    if n <= k:
        picked = np.tile(np.arange(n), (len(scores), 1))
    else:
        least = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
        over, same = scores > least, scores == least
        wanted = k - over.sum(axis=1, keepdims=True)
        picked = np.nonzero(over | (same & (np.cumsum(same, axis=1) <= wanted)))[1].reshape(len(scores), k)
    order = np.argsort(_falling(np.take_along_axis(scores, picked, 1)), axis=1, kind="stable")
    return np.take_along_axis(picked, order, 1)


def _falling(scores: np.ndarray) -> np.ndarray:
    """A key that ascends as scores descend, with NONE at the end."""
    return np.where(scores == NONE, np.iinfo(np.int64).max, -scores)


class Best:
    """The ``k`` best (score, id) seen so far by each of ``n`` askers; smaller ids first in ties."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def add(self, askers: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of the columns ``ids``, which ascend; ``NONE`` is no candidate."""
        at = first_k(scores, self.k)
        both = np.hstack((self.scores[askers], np.take_along_axis(scores, at, 1)))
        names = np.hstack((self.ids[askers], ids[at]))
        order = np.lexsort((names, _falling(both)), axis=-1)
        self.scores[askers] = np.take_along_axis(both, order, 1)[:, :self.k]
        self.ids[askers] = np.take_along_axis(names, order, 1)[:, :self.k]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(asker, id, score) of everything held."""
        asker, at = np.nonzero(self.scores != NONE)
        return asker, self.ids[asker, at], self.scores[asker, at]


def in_tiles(queries: DataFrame, size: int, *key: str) -> tuple[DataFrame, int]:
    """The query rows, each once, staged with the number of their tile: about ``size`` rows each."""
    rows = staged(queries.distinct(), "query-rows")
    n = max(1, -(-rows.count() // size))
    return rows.withColumn("tile", F.pmod(F.xxhash64(*key), F.lit(n))), n


def by_tile(queries: DataFrame, n_tiles: int, answer: Callable[[pa.Table], DataFrame | None], schema: str) -> DataFrame:
    """What ``answer`` makes of every tile, written to the shared folder tile by tile. A tile
    is bounded, so it may be held by the driver and sent to every task."""
    spark = queries.sparkSession
    ship(spark)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tiles-{uuid.uuid4().hex}"
    paths = []
    for t in range(n_tiles):
        rows = queries.where(F.col("tile") == t).drop("tile").toArrow()
        out = answer(rows) if rows.num_rows else None
        if out is not None:
            paths.append(f"{base}/{t}")
            out.write.parquet(paths[-1])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def plain(df: DataFrame, id_col: str, vec_col: str, **others: Column) -> DataFrame:
    """(vec_id, vec, others...): rows with an id and a vector; other columns stay behind."""
    return (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"),
                      *[c.alias(name) for name, c in others.items()])
            .where("vec_id IS NOT NULL AND vec IS NOT NULL"))
