"""Exact top-k inner-product search: tiled products, partial selection, tree merge.

Queries and candidates are dealt into tiles of bounded size. Every (query tile, shard)
cell is one task-sized matrix product whose top k per query survive; the per-query lists
then meet in a merge tree of fixed fan-in, so no task ever sees more than ``fan_in`` lists
of a query. The candidates' tiles are the shards of the search; queries are a stated set.

Defined results: vectors that are null, empty or hold null or non-finite components take
no part; only vectors of one length are compared; rows with the query's own id are not
its candidates; ties go to the smaller id; repeated rows are candidates each for itself and
ask once (different vectors under one id share that id's list);
fewer candidates than k give fewer rows; no queries or no candidates give no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import ship

QUERY_TILE = 1024
SHARD = 8192
FAN_IN = 8
_OUT = "qtile long, shard long, query_id long, vec_id long, score long"


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(vec_id, vec): floor(scale * x) of every usable vector, as doubles."""
    vec = F.col(vec_col).cast("array<double>")
    usable = (F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(vec) > 0)
              & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return (df.where(F.coalesce(usable, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(vec, lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("vec")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each row: score first, then the smaller id.
    ``ids`` ascend, so a position breaks ties as the id does."""
    n = scores.shape[1]
    if n > k:
        # the k-th best score; everything above it and the first ones equal to it
        kth = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
        above = scores > kth
        room = k - above.sum(1, keepdims=True)
        equal = scores == kth
        take = above | (equal & (np.cumsum(equal, axis=1) <= room))
        picked = np.nonzero(take)[1].reshape(len(scores), k)
    else:
        picked = np.tile(np.arange(n), (len(scores), 1))
    order = np.argsort(-np.take_along_axis(scores, picked, 1), axis=1, kind="stable")
    return np.take_along_axis(picked, order, 1)


def _cell(k: int):
    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, shard: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("qtile", "shard", "query_id", "vec_id", "score")})
        if not len(queries) or not len(shard):
            return empty
        shard = shard.sort_by("vec_id")
        q, c = _matrix(queries["vec"]), _matrix(shard["vec"])
        qid, cid = queries["vec_id"].to_numpy(), shard["vec_id"].to_numpy()
        out = []
        exact = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < 2.0 ** 53
        least = np.iinfo(np.int64).min
        for at in range(0, len(q), 128):
            part = q[at:at + 128]
            scores = ((part @ c.T).astype(np.int64) if exact
                      else part.astype(np.int64) @ c.astype(np.int64).T)
            scores[qid[at:at + 128][:, None] == cid[None, :]] = least
            best = _best(scores, cid, k)
            got = np.take_along_axis(scores, best, 1)
            row, col = np.nonzero(got != least)
            out.append((qid[at:at + 128][row], cid[best[row, col]], got[row, col]))
        query, vec, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"qtile": np.full(len(query), key[0].as_py(), np.int64),
                         "shard": np.full(len(query), key[1].as_py(), np.int64),
                         "query_id": query, "vec_id": vec, "score": score})
    return run


def _merge(k: int):
    def run(key: tuple[pa.Scalar, ...], lists: pa.Table) -> pa.Table:
        lists = lists.sort_by([("query_id", "ascending"), ("score", "descending"), ("vec_id", "ascending")])
        query = lists["query_id"].to_numpy()
        first = np.concatenate(([True], query[1:] != query[:-1]))
        start = np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
        return lists.filter(pa.array(np.arange(len(query)) - start < k))
    return run


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
          k: int = 20, scale: float = 64.0, query_tile: int = QUERY_TILE, shard: int = SHARD,
          fan_in: int = FAN_IN) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) for the rows of ``vectors`` where ``is_query``."""
    ship(vectors.sparkSession)
    flagged = vectors.select("*", F.coalesce(is_query, F.lit(False)).alias("_asks"))
    every = quantised(flagged, id_col, vec_col, scale)
    asks = quantised(flagged.where("_asks"), id_col, vec_col, scale).dropDuplicates(["vec_id", "vec"])
    n_asks, n_all = asks.count(), every.count()
    n_tiles, n_shards = -(-n_asks // query_tile) or 1, -(-n_all // shard) or 1
    dealt = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "vec"), F.lit(n))
    left = (asks.withColumn("qtile", dealt("q", n_tiles))
            .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long")))))
    right = (every.withColumn("shard", dealt("c", n_shards))
             .withColumn("qtile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_tiles - 1).cast("long")))))
    dims = F.size("vec").alias("dims")
    left, right = (x.select("qtile", "shard", dims, "vec_id", "vec") for x in (left, right))
    lists = (left.groupBy("qtile", "shard", "dims").cogroup(right.groupBy("qtile", "shard", "dims"))
             .applyInArrow(_cell(k), _OUT))
    while True:
        lists = (lists.withColumn("shard", F.floor(F.col("shard") / fan_in))
                 .groupBy("qtile", "shard").applyInArrow(_merge(k), _OUT))
        n_shards = -(-n_shards // fan_in)
        if n_shards == 1:
            break
    return lists.groupBy("qtile").applyInArrow(_ranked, "query_id long, rank int, vec_id long, score long")


def _ranked(key: tuple[pa.Scalar, ...], lists: pa.Table) -> pa.Table:
    query = lists.sort_by([("query_id", "ascending"), ("score", "descending"), ("vec_id", "ascending")])
    ids = query["query_id"].to_numpy()
    first = np.concatenate(([True], ids[1:] != ids[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    return pa.table({"query_id": ids, "rank": (np.arange(len(ids)) - start + 1).astype(np.int32),
                     "vec_id": query["vec_id"], "score": query["score"]})
