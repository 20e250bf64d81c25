"""Hard negatives, nearest neighbours and k-means against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelake.llm import hard_negatives, small_world, subvector_kmeans
from carelake.llm.vectors import dense

SCHEMA = "vec_id long, embedding array<double>, label int, score string, rank int, vec string, tile int, asker int, shard int, ids string"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "x", 1, 1, 1, "x") for i, v, label in rows], SCHEMA)


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# --- hard negatives -----------------------------------------------------------------------

def negatives(rows, scale=256, k=5):
    rows = [(i, tuple(math.floor(scale * x) for x in v), lab) for i, v, lab in rows if i is not None and lab is not None and fine(v)]
    out = []
    for i, v, lab in {r for r in rows if r[0] % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in rows if j != i and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == lab][:k]:
            inside = [x for x in scored if x[2] != lab and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(i, p, r + 1, j, -s, -n) for r, (n, j, _) in enumerate(inside)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **options).collect())


def test_hard_negatives_equal_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.5, 0.9, -0.1]) for _ in range(70)], rng.randrange(3)) for i in range(500)]
    rows += [(i, [0.5] * 70, 1) for i in range(500, 700)]  # one very common vector
    rows += rows[:40] + [(200, [0.4] * 70, 2)]  # repeated rows; one id for two vectors
    want = negatives(rows)
    assert len(want) > 100 and mined(frame(spark, rows)) == want
    assert mined(frame(spark, rows), tile_rows=2) == want


def test_hard_negatives_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (100, None, 1), (200, [], 1), (201, [], 1), (202, [], 2), (300, [NAN, 1.0], 1), (400, [1.0, None], 1), (500, [INF, 1.0], 1),
            (None, [1.0, 1.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.9], 2), (3, [1.0, 2.0], None), (4, [1.0, 2.0, 3.0], 2), (5, [-1.0, -2.0], 1),
            (600, [1.0, 2.0], 7), (700, [-1.0, 0.5], 3), (701, [1.0, 0.1], 3), (702, [1.0, -0.1], 2)]
    assert mined(frame(spark, rows)) == negatives(rows)
    assert mined(frame(spark, [])) == []
    with pytest.raises(Exception, match="ArithmeticError"):
        mined(frame(spark, [(0, [1e12, 1.0], 1), (1, [1e12, 1.0], 1)]))


def test_residue_products_are_exact():
    rng = np.random.default_rng(3)
    for dims, top in ((64, 255), (1000, 1 << 18), (3, 1 << 22), (0, 1)):
        left, right = (rng.integers(-top, top + 1, (n, dims)) for n in (7, 9))
        got = hard_negatives.exact_products(*(hard_negatives.Residues(x.astype(float)) for x in (left, right)), slice(0, 7))
        assert (got == left @ right.T).all()
    assert all((hard_negatives.SLICE * (p // 2) ** 2 < 2 ** 24) and all(p % q for q in range(2, p)) for p in hard_negatives.PRIMES)


# --- nearest neighbours ---------------------------------------------------------------------

def cosines(rows, k=5):
    rows = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and fine(v) and any(v)]
    out = {}
    for i, v in rows:
        if i % 50:
            continue
        best = dict(out.get(i, {}))
        for j, w in rows:
            if j != i and len(w) == len(v):
                best[j] = max(best.get(j, -2), float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))))
        out[i] = best
    return {i: sorted((-round(s, 9), j) for j, s in best.items())[:k] for i, best in out.items()}


def found(df, **options):
    out = {}
    for r in small_world.nearest(df, F.col("vec_id") % 50 == 0, **options).orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((-round(r.score, 9), r.vec_id))
    return out


def test_nearest_neighbours_recall(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=32).tolist(), 0) for i in range(3000)]
    want = cosines(rows)
    got = found(frame(spark, rows), shard=800, beam=60)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits / (5 * len(want)) >= 0.95


def test_nearest_neighbours_in_clusters_and_copies(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + rng.normal(size=16) / 20).tolist(), 0) for i in range(2000)]
    rows += [(i, [0.5] * 16, 0) for i in range(2000, 3000)]  # a third of all rows is one vector
    rows += rows[:300]  # repeated rows
    want, got = cosines(rows), found(frame(spark, rows), shard=1000, beam=80)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (5 * len(want)) >= 0.95
    assert got[2050] == [(-1.0, j) for j in range(2000, 2005)]


def test_nearest_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (50, None, 1), (100, [], 1), (150, [NAN, 1.0], 1), (200, [1.0, None], 1), (250, [0.0, 0.0], 1), (None, [1.0, 1.0], 1),
            (1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1), (3, [1.0, 2.0, 3.0], 1), (300, [1e300, 1e300], 1), (4, [1e-300, 0.0], 1), (350, [3.0], 1), (5, [1.0, -1.0], 1),
            (0, [-1.0, 0.5], 1), (0, [1.0, 2.0], 1)]
    tame = [(i, [x / 1e300 if x and abs(x) == 1e300 else x * 1e300 if x == 1e-300 else x for x in v] if v and fine(v) else v, c) for i, v, c in rows]
    want = {q: x for q, x in cosines(tame).items() if x}
    assert found(frame(spark, rows)) == want
    assert found(frame(spark, [])) == {} and found(frame(spark, [(50, [1.0], 0)])) == {}


def test_nearest_neighbours_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(map(float, r.embedding)), 0) for r in df.collect()]
    want, got = cosines(rows), found(df, shard=250, beam=40)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (5 * len(want)) >= 0.9


# --- k-means ----------------------------------------------------------------------------------

def kmeans(rows, k=8, rounds=10, dims=64):
    rows = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v, _ in rows if v and len(v) == dims and fine(v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    centroids = [v for _, v in seeds]
    if not centroids:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in rows]

    for _ in range(rounds):
        owner = [n for _, n in assign()]
        for n in range(len(centroids)):
            mine = [v for (_, v), o in zip(rows, owner) if o == n]
            if mine:
                centroids[n] = tuple(sum(x) // len(mine) for x in zip(*mine))
    last = assign()
    by = {n: sum(d for d, o in last if o == n) for n in range(len(centroids))}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, by[n], sum(by.values()), name[n]) for (i, _), (d, n) in zip(rows, last)), key=str)


def clustered(df, **options):
    return sorted((tuple(r) for r in subvector_kmeans.cluster(df, **options).collect()), key=str)


def test_kmeans_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(subvector_kmeans, "CHUNK", 100)
    rng = random.Random(6)
    rows = [(i, [rng.choice([0.1, 0.2, -0.7]) + (d % 8 == 0) * rng.random() for d in range(64)], 0) for i in range(400)]
    rows += [(i, [0.25] * 64, 0) for i in range(400, 500)] + rows[:20]
    df = frame(spark, rows)
    assert clustered(df) == kmeans(rows)
    assert clustered(df.where("vec_id < 5")) == kmeans([r for r in rows if r[0] < 5])


def test_kmeans_odd_rows(spark):
    v = lambda x: [x] * 64
    rows = [(1, v(0.1), 0), (2, v(0.1), 0), (2, v(0.3), 0), (None, v(0.5), 0), (3, None, 0), (4, [], 0), (5, v(0.2)[:63], 0), (6, [*v(0.1)[:63], None], 0),
            (7, [*v(0.1)[:63], NAN], 0), (8, v(-3.0), 0), (9, v(60.0), 0), (1, v(0.1), 0)]
    assert clustered(frame(spark, rows)) == kmeans(rows)
    assert clustered(frame(spark, [])) == [] and clustered(frame(spark, [(None, v(1.0), 0)])) == []
    with pytest.raises(Exception, match="ArithmeticError"):
        clustered(frame(spark, [(1, v(1e9), 0)]))


def test_dictionaries_are_lossless_and_as_wide_as_repeats_allow():
    rng = np.random.default_rng(1)
    few = rng.integers(-5, 5, (6, 64))[rng.integers(0, 6, 400)]
    many = rng.integers(-500, 500, (400, 64))
    half = np.hstack((few[:, :32], many[:, 32:]))
    for matrix, most in ((few, 1), (many, 64), (half, 33)):
        blocks = subvector_kmeans.encode_blocks(matrix)
        assert len(blocks) == most
        assert (np.hstack([values[codes] for values, codes in blocks]) == matrix).all()


def test_dense_leaves_out_unusable_vectors():
    import pyarrow as pa
    column = pa.array([[1.0, 2.0], None, [3.0], [None, 1.0], [4.0, 5.0], [], [INF, 1.0]], pa.list_(pa.float64()))
    got = {m.shape[1]: (rows.tolist(), m.tolist()) for rows, m in dense(column)}
    assert got == {0: ([5], [[]]), 1: ([2], [[3.0]]), 2: ([0, 4], [[1.0, 2.0], [4.0, 5.0]])}
