"""Approximate nearest neighbours by cosine: a navigable small-world graph per shard.

Rows are dealt evenly into shards; a shard's partition builds one hierarchical graph per
vector length. Equal vectors of a shard are one node. Nodes are numbered from the highest
level down, so a level consists of the first nodes and its neighbour lists are one flat
array of fixed width, with -1 for no neighbour; the index is a table of such arrays. Nodes
enter a level in batches: a batch searches the level as it stands, compares its members with
each other, keeps diverse neighbours and is linked back; a list grown over its width is
thinned the same way. All searches of a batch advance together in vector operations.

A query descends from the top level of every shard, keeps a beam of ``beam`` nodes on the
lowest one and scores those exactly, in double precision on the original vectors (each
scaled by a power of two, which changes no cosine). The shards' lists are merged. A shard of
no more nodes than the beam is scored whole.

Queries are a stated set, taken in tiles of bounded size that every shard answers at once.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do rows without an id; only vectors of one length are compared; rows with
the query's own id are not its candidates; ties go to the smaller id; an id is listed once,
with its best score, so repeated rows are one candidate and different vectors under one
query id share a list; fewer candidates give fewer rows; an empty table gives no rows; other
columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import ship, staged
from carelake.llm.vectors import by_tile, dense, in_tiles, plain

SHARD = 8192
WIDTH = 16
BUILD_BEAM = 100
BEAM = 160
STEP = 4
BATCH = 1024
ASKED = 256
TILE = 8192
INDEX = ("dims long, levels array<int>, neighbours array<binary>, vectors binary, ids binary, first_id binary")
OUT = "query_id long, rank int, vec_id long, score double"


def scaled(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors times a power of two each, lengths), free of overflow; zero vectors have length 0."""
    _, exponent = np.frexp(np.abs(matrix).max(axis=1, initial=0))
    matrix = np.ldexp(matrix, -exponent[:, None])
    return matrix, np.sqrt(np.square(matrix).sum(axis=1))


def _merged(beam: tuple[np.ndarray, ...], rows: np.ndarray, places: np.ndarray, fresh: tuple[np.ndarray, ...]):
    """The beams with fresh entries put in, nearest first, at their old width."""
    width = beam[0].shape[1]
    room = int(places.max(initial=-1)) + 1
    out = []
    for held, new, blank in zip(beam, fresh, (np.inf, -1, True), strict=True):
        wide = np.full((len(held), width + room), blank, held.dtype)
        wide[:, :width] = held
        wide[rows, width + places] = new
        out.append(wide)
    order = np.argsort(out[0], axis=1, kind="stable")[:, :width]
    return [np.take_along_axis(x, order, 1) for x in out]


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int,
                step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, distances) of every query's beam on one level, nearest first (-1 and infinity
    where it found fewer). A distance is the negative inner product."""
    n, width = len(queries), links.shape[1]
    seen = np.zeros((n, len(links)), bool)
    seen[np.arange(n), entries] = True
    dist, node, spent = np.full((n, beam), np.inf, np.float32), np.full((n, beam), -1, np.int32), np.ones((n, beam), bool)
    dist[:, 0], node[:, 0], spent[:, 0] = -np.einsum("ij,ij->i", queries, vectors[entries]), entries, False
    active = np.arange(n)
    while True:
        todo = ~spent[active]
        active, todo = active[some := todo.any(axis=1)], todo[some]
        if not len(active):
            return node, dist
        row, col = np.nonzero(todo & (np.cumsum(todo, axis=1) <= step))
        spent[active[row], col] = True
        near, row = links[node[active[row], col]].ravel(), np.repeat(row, width)
        fresh = (near >= 0) & ~seen[active[row], near]
        pairs = np.unique(row[fresh].astype(np.int64) * len(links) + near[fresh])
        row, near = pairs // len(links), pairs % len(links)
        seen[active[row], near] = True
        found = -np.einsum("ij,ij->i", queries[active[row]], vectors[near])
        good = found < dist[active[row], -1]
        row, near, found = row[good], near[good], found[good]
        if len(row):
            count = np.bincount(row, minlength=len(active))
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            dist[active], node[active], spent[active] = _merged(
                (dist[active], node[active], spent[active]), row, place, (found, near, False))


def diverse(vectors: np.ndarray, nodes: np.ndarray, dist: np.ndarray, width: int) -> np.ndarray:
    """Of every row's candidates, nearest first, up to ``width``: those that are nearer to the
    row than to any already kept, then the nearest of the rest."""
    held = vectors[np.maximum(nodes, 0)]
    between = -(held @ held.transpose(0, 2, 1))
    out, size = np.full((len(nodes), width), -1, np.int32), np.zeros(len(nodes), np.int64)
    kept, closest = np.zeros(nodes.shape, bool), np.full(nodes.shape, np.inf, np.float32)
    for apart in (True, False):
        for j in range(nodes.shape[1]):
            take = (nodes[:, j] >= 0) & ~kept[:, j] & (size < width)
            row = np.nonzero(take & (dist[:, j] < closest[:, j]) if apart else take)[0]
            out[row, size[row]] = nodes[row, j]
            size[row] += 1
            kept[row, j] = True
            closest[row] = np.minimum(closest[row], between[row, j])
    return out


def _nearest_first(vectors: np.ndarray, centres: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate lists ordered by distance from their centre; repeats and gaps become -1 at the end."""
    dist = -np.einsum("id,icd->ic", vectors[centres], vectors[np.maximum(nodes, 0)])
    order = np.argsort(nodes, axis=1, kind="stable")
    same = np.diff(np.take_along_axis(nodes, order, 1), axis=1, prepend=-2) == 0
    repeat = np.zeros(nodes.shape, bool)
    np.put_along_axis(repeat, order, same, 1)
    dist[repeat | (nodes < 0)] = np.inf
    order = np.argsort(dist, axis=1, kind="stable")
    nodes, dist = np.take_along_axis(nodes, order, 1), np.take_along_axis(dist, order, 1)
    return np.where(np.isinf(dist), -1, nodes), dist


def _link_back(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Add the new nodes to the lists of the neighbours they chose."""
    width = links.shape[1]
    source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.lexsort((-np.einsum("ij,ij->i", vectors[source], vectors[target]), target))
    source, target = source[order], target[order]
    centres, first, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, count)
    near = place < width  # of a hub's new neighbours only the nearest can stay
    source, target, place = source[near], target[near], place[near]
    wide = np.full((len(centres), width + int(place.max(initial=-1)) + 1), -1, np.int32)
    wide[:, :width] = links[centres]
    wide[np.searchsorted(centres, target), width + place] = source
    for lo in range(0, len(centres), BATCH):
        part = centres[lo:lo + BATCH]
        nodes, dist = _nearest_first(vectors, part, wide[lo:lo + BATCH])
        over = nodes.shape[1] > width and nodes[:, width] >= 0
        links[part] = nodes[:, :width]
        if np.any(over):
            links[part[over]] = diverse(vectors, nodes[over], dist[over], width)


def build_level(vectors: np.ndarray, size: int, above: int, entry_of, width: int, beam: int) -> np.ndarray:
    """Neighbour lists of the first ``size`` nodes; the first ``above`` of them are on the next
    level too and come first. ``entry_of`` gives entry nodes, on that level, for the others."""
    links, at = np.full((size, width), -1, np.int32), 0
    while at < size:
        end = min(size, at + min(BATCH, max(width, at)))
        end = above if at < above < end else end
        new = np.arange(at, end)
        queries = vectors[new]
        among = -(queries @ queries.T)
        np.fill_diagonal(among, np.inf)
        k = min(beam // 2, len(new) - 1)
        nodes = np.argpartition(among, max(0, k - 1), axis=1)[:, :k] + at
        if at:
            entries = entry_of(queries) if at >= above > 0 else np.zeros(len(new), np.int64)
            nodes = np.hstack((nodes, beam_search(vectors, links[:at], queries, entries, min(beam, at))[0]))
        nodes, dist = _nearest_first(vectors, new, nodes.astype(np.int32))
        chosen = diverse(vectors, nodes[:, :beam], dist[:, :beam], max(1, width // 2))
        links[new, :chosen.shape[1]] = chosen
        _link_back(vectors, links, new, chosen)
        at = end
    return links


def descend(vectors: np.ndarray, levels: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """The node greedy steps reach on the lowest of ``levels`` (top level first)."""
    at = np.zeros(len(queries), np.int64)
    for links in levels:
        at = beam_search(vectors, links, queries, at, 1, 1)[0][:, 0].astype(np.int64)
    return at


def build(ids: np.ndarray, matrix: np.ndarray, width: int = WIDTH, beam: int = BUILD_BEAM, seed: int = 12) -> dict:
    """One shard's index over usable vectors of one length, as a row of ``INDEX``."""
    order = np.lexsort((ids, *matrix.T[::-1]))
    ids, matrix = ids[order], matrix[order]
    fresh = np.concatenate(([True], (matrix[1:] != matrix[:-1]).any(axis=1)))
    node = np.cumsum(fresh) - 1
    matrix = matrix[fresh]
    n = len(matrix)
    draw = np.random.default_rng(seed).random(n)
    level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(width)).astype(np.int64)
    numbering = np.lexsort((draw, -level))  # draws fall as levels rise, and mix the nodes of one level
    matrix, level = matrix[numbering], level[numbering]
    place = np.empty(n, np.int64)
    place[numbering] = np.arange(n)
    order = np.lexsort((ids, place[node]))
    ids, node = ids[order], place[node][order]
    vectors, length = scaled(matrix)
    vectors = (vectors / length[:, None]).astype(np.float32)
    sizes = [int((level >= k).sum()) for k in range(int(level.max()), -1, -1)]
    levels, above = [], 0
    for k, size in enumerate(sizes):
        known = list(levels)
        levels.append(build_level(vectors, size, above, lambda q, known=known: descend(vectors, known, q),
                                  2 * width if k == len(sizes) - 1 else width, beam))
        above = size
    return {"dims": matrix.shape[1], "levels": sizes, "neighbours": [x.tobytes() for x in levels], "vectors": matrix.tobytes(),
            "ids": ids.tobytes(), "first_id": np.searchsorted(node, np.arange(n + 1)).astype(np.int64).tobytes()}


class Shard:
    """A row of the index, ready to search."""

    def __init__(self, row: dict):
        self.ids, self.first_id = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["first_id"], np.int64)
        self.matrix, self.length = scaled(np.frombuffer(row["vectors"]).reshape(-1, row["dims"]))
        self.vectors = (self.matrix / self.length[:, None]).astype(np.float32)
        self.levels = [np.frombuffer(x, np.int32).reshape(n, -1) for x, n in zip(row["neighbours"], row["levels"], strict=True)]

    def nodes(self, queries: np.ndarray, beam: int) -> np.ndarray:
        if len(self.vectors) <= beam:
            return np.tile(np.arange(len(self.vectors)), (len(queries), 1))
        return beam_search(self.vectors, self.levels[-1], queries, descend(self.vectors, self.levels[:-1], queries), beam)[0]

    def nearest(self, query_ids: np.ndarray, matrix: np.ndarray, length: np.ndarray, k: int, beam: int):
        """(query id, id, score) of the k best ids of every query, by exact cosines of the beam."""
        out = []
        for lo in range(0, len(matrix), ASKED):
            part, size = matrix[lo:lo + ASKED], length[lo:lo + ASKED]
            nodes = self.nodes((part / size[:, None]).astype(np.float32), beam)
            row, col = np.nonzero(nodes >= 0)
            node = nodes[row, col]
            # row-wise sums: equal vectors get equal scores, wherever they stand
            score = (part[row] * self.matrix[node]).sum(axis=1) / (size[row] * self.length[node])
            # of a node's ids (ascending) k + 1 are enough, as one of them may be the query's own
            count = np.minimum(self.first_id[node + 1] - self.first_id[node], k + 1)
            at = np.repeat(self.first_id[node], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            row, score, ids = np.repeat(row, count), np.repeat(score, count), self.ids[at]
            order = np.lexsort((ids, -score, row))
            order = order[ids[order] != query_ids[lo + row[order]]]
            row, score, ids = row[order], score[order], ids[order]
            once = np.zeros(len(row), bool)
            once[np.unique(row * np.int64(len(self.ids)) + np.unique(ids, return_inverse=True)[1], return_index=True)[1]] = True
            row, score, ids = row[once], score[once], ids[once]
            start = np.searchsorted(row, row)
            best = np.arange(len(row)) - start < k
            out.append((query_ids[lo + row[best]], ids[best], score[best]))
        return [np.concatenate(x) for x in zip(*out, strict=True)]


def _built(width: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            for at, matrix in dense(batch.column("vec")):
                some = matrix.any(axis=1)
                if some.any():
                    parts.setdefault(matrix.shape[1], []).append((batch.column("vec_id").to_numpy()[at][some], matrix[some]))
        for _, found in sorted(parts.items()):
            ids, matrix = (np.concatenate(x) for x in zip(*found, strict=True))
            row = build(*_once(ids, matrix + 0.0), width, beam)
            yield pa.RecordBatch.from_pydict({
                name: pa.array([value], kind) for (name, value), kind in zip(row.items(), _KINDS, strict=True)})
    return run


_KINDS = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary()]


def _once(ids: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows repeated in id and vector count once."""
    order = np.lexsort((ids, *matrix.T[::-1]))
    ids, matrix = ids[order], matrix[order]
    fresh = np.concatenate(([True], (ids[1:] != ids[:-1]) | (matrix[1:] != matrix[:-1]).any(axis=1)))
    return ids[fresh], matrix[fresh]


def index(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD, width: int = WIDTH,
          build_beam: int = BUILD_BEAM) -> DataFrame:
    """The index table: every usable row of ``df`` in shards of about ``shard`` rows each."""
    ship(df.sparkSession)
    rows = plain(df, id_col, vec_col)
    n = max(1, -(-rows.count() // shard))
    # the running number keeps rows that are alike from meeting in one shard
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vec", F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    return staged(dealt.repartitionById(n, "shard").select("vec_id", "vec").mapInArrow(_built(width, build_beam), INDEX),
                  "small-world")


def _search(tile, k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["dims"] in tile.value:
                    query, vec, score = Shard(row).nearest(*tile.value[row["dims"]], k, beam)
                    yield pa.RecordBatch.from_pydict({"query_id": query, "vec_id": vec, "score": score})
    return run


def search(graph: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
           beam: int = BEAM, tile_rows: int = TILE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of an index for each of ``queries``."""
    spark = graph.sparkSession
    ship(spark)
    asked, n_tiles = in_tiles(plain(queries, id_col, vec_col), tile_rows, "vec_id", "vec")

    def answer(found: pa.Table) -> DataFrame | None:
        tile = {}
        for at, matrix in dense(found["vec"]):
            matrix, length = scaled(matrix)
            some = length > 0
            if some.any():
                tile[matrix.shape[1]] = (found["vec_id"].to_numpy()[at][some], matrix[some], length[some])
        lists = graph.mapInArrow(_search(spark.sparkContext.broadcast(tile), k, max(beam, k + 1)),
                                 "query_id long, vec_id long, score double")
        best = lists.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    return by_tile(asked, n_tiles, answer, OUT)


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
            beam: int = BEAM, shard: int = SHARD) -> DataFrame:
    """``search`` of all rows of ``df`` for those where ``is_query``."""
    return search(index(df, id_col, vec_col, shard), df.where(F.coalesce(is_query, F.lit(False))), id_col, vec_col, k, beam)
