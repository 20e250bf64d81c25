"""Exact and near copies against plain loops."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from carelake.llm import components, exact_dedup, shingle_join, substring_dedup
from carelake.llm.words import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, doc))
    out = Counter()
    for norm, members in groups.items():
        keep = min(members)[3]
        for m in members:
            out[m[3], keep, len(members), m[3] == keep, hashlib.sha256(norm.encode()).hexdigest()] += 1
    return out


def got_exact(df, **options):
    return Counter((r.row_id, r.keep_id, r.group_size, r.kept, r.text_sha256)
                   for r in exact_dedup.copies(df, **options).collect())


def test_exact_odd_rows(odd, odd_rows):
    assert got_exact(odd) == exact([r[:2] for r in odd_rows])


def test_exact_with_a_full_filter(spark):
    """A filter too small for its rows lets all through to the grouping."""
    rng = random.Random(1)
    rows = [(i, "copy" if rng.random() < 0.3 else f"t{rng.randrange(900)}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_exact(df, max_bits=1 << 16) == exact(rows)
    assert got_exact(df) == exact(rows)


def test_exact_drop(odd, empty):
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns
    kept = [r.doc_id for r in left.collect()]
    assert 6 in kept and not {1, 8} & set(kept)  # the longest of equal texts stays
    assert kept.count(20) == 1 and 11 in kept
    assert exact_dedup.copies(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def jaccard(rows):
    sets = defaultdict(list)
    for doc, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        grams = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets[doc].append(frozenset(grams))
    ids = sorted(d for d in sets if d is not None)
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= 75 * len(x | y):
                        p, q = sorted((root(a), root(b)))
                        parent[q] = p
    return Counter((d, len(s), None if d is None else root(d)) for d, many in sets.items() for s in many)


def got_jaccard(df):
    return Counter(tuple(r) for r in shingle_join.link_components(df).collect())


def test_jaccard_odd_rows(odd, odd_rows, empty):
    assert got_jaccard(odd) == jaccard([r[:2] for r in odd_rows])
    assert shingle_join.link_components(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_random_families(spark, seed, monkeypatch):
    """Families of changed copies around the threshold, a passage that many share; small
    groups, so that candidate pairs of groups are many."""
    monkeypatch.setattr(shingle_join, "GROUP", 8)
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, rows = [word() for _ in range(40)], []
    for family in range(12):
        base = [word() for _ in range(rng.choice([4, 8, 30, 90, 200]))]
        for _ in range(rng.choice([1, 2, 12, 30])):
            text = [w if rng.random() > 0.025 else word() for w in base]
            rows.append((len(rows) + 100 * family, " ".join(text + passage * (rng.random() < 0.4))))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = jaccard(rows)
    assert got_jaccard(df) == want
    assert len({c for _, _, c in want}) < len(rows)
    left = {r.doc_id for r in shingle_join.drop_near_copies(df).collect()}
    assert left == {c for _, _, c in want}


def test_group_matrix_finds_what_stars_miss(spark, monkeypatch):
    """Without any pivot the groups alone give the same components."""
    monkeypatch.setattr(shingle_join, "star_links", lambda sets, percent: sets.sparkSession.createDataFrame([], "a long, b long"))
    rng = random.Random(5)
    base = [f"w{rng.randrange(999)}" for _ in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"x{rng.randrange(9999)}" for w in base)) for i in range(40)]
    assert got_jaccard(spark.createDataFrame(rows, "doc_id long, text string")) == jaccard(rows)


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8)], [(i, i + 1) for i in range(40)],
    [(0, i) for i in range(1, 60)] + [(70, i) for i in range(60, 70)], [(5, 3), (3, 5), (5, 3)]])
def test_components(spark, edges):
    parent = {v: v for e in edges if e[0] != e[1] for v in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(tuple(r) for r in components.components(df).collect()) == sorted((v, root(v)) for v in parent)


def repeats(rows, window=35):
    docs = [(doc, WORD.findall(text or "")) for doc, text in rows]
    seen = Counter(tuple(w[i:i + window]) for _, w in docs for i in range(len(w) - window + 1))
    out = Counter()
    for doc, w in docs:
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for p in range(i, i + window)}
        out[doc, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)] += 1
    return out


def test_repeats_odd_rows(odd, odd_rows, empty):
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(odd).collect())
    assert got == repeats([r[:2] for r in odd_rows])
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("period", [3, 7, 13, 21, 31])
def test_repeats_random(spark, period):
    """Passages of lengths around the window, at all offsets, within and across documents."""
    rng = random.Random(period)
    word = lambda: f"w{rng.randrange(3000)}"
    passages, rows = [[word() for _ in range(n)] for n in (33, 34, 35, 36, 60, 120)], []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(4)):
            text += [word() for _ in range(rng.randrange(50))]
            if rng.random() < 0.6:
                text += rng.choice(passages)
        rows.append((i, "  ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in substring_dedup.remove_repeats(df, period=period).collect()) == repeats(rows)


def test_covers():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_word_hashes_equal_words():
    rng = random.Random(3)
    texts = [None, "", " a  b ", "x" * 3000 + " y", *(" ".join(rng.choice("ab é 漢 Zz \t".split(" ")) for _ in range(50)) for _ in range(20))]
    for lower in (False, True):
        hashes, offsets = word_hashes(texts, lower)
        plain = [w for t in texts for w in WORD.findall((t or "").translate(LOWER) if lower else t or "")]
        assert len(plain) == len(hashes)
        assert len({(p, int(h)) for p, h in zip(plain, hashes)}) == len(set(plain)) == len({int(h) for h in hashes})
        assert [int(n) for n in offsets[1:] - offsets[:-1]] == [len(WORD.findall(t or "")) for t in texts]


def test_rows_leave_by_their_own_number(spark):
    """Repeated rows, shared and missing ids, and columns named like the operators' own."""
    names = ["_gone", "_gone_sha", "_sha", "_score", "_lang0", "row", "number", "text_sha256", "maybe", "component_id", "_bits", "rank"]
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
    near = " ".join([*base, "end"])
    rows = [(1, " ".join(base)), (1, " ".join(base)), (2, near), (2, "a clean and different text under the same id"), (None, near + " more"),
            (None, "no id and no copy of anything at all"), (3, "One  text"), (4, "Onetext"), (4, "One text "), (5, None), (5, "")]
    df = spark.createDataFrame([(i, t, *[f"{n}{k}" for n in names]) for k, (i, t) in enumerate(rows)],
                               "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    exact = exact_dedup.drop_copies(df)
    assert exact.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in exact.collect()) == sorted((i or 0, t or "") for i, t in [rows[0], *rows[2:6], rows[6], (5, "")])
    kept = shingle_join.drop_near_copies(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    # 1 stands for 1, 2 and the one without an id; short texts are compared word by word, empty ones stay
    assert got == sorted((i or 0, t or "") for i, t in [rows[0], rows[3], rows[5], rows[6], rows[7], *rows[9:11]])
    from carelake.llm import language_id
    langs = df.withColumn("lang", F.lit("en"))
    found = language_id.keep_identified(langs)
    assert found.columns == langs.columns and {r._score for r in found.collect()} <= {f"_score{k}" for k in range(len(rows))}
