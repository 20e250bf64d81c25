"""The pipeline's stages against plain loops, and on odd and empty documents."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from carelake.llm import grams
from tests.llm.test_copies import jaccard
from tests.llm.test_learned import check_pieces, plain_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGES = dict(corpus_pipeline.STAGES)


def run_stage(spark, name, docs):
    return STAGES[name](spark, docs, "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "pii", "packing"]


def test_stages(spark, docs):
    before = texts(docs)
    after = run_stage(spark, "language_id", docs)
    assert after.columns == COLUMNS
    assert texts(after) == {i: t for i, t in before.items() if grams.has_letter(t)}

    best = {}
    for i, t in before.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[key] = min(best.get(key, (1, 0)), (-len(t or ""), i))
    assert set(texts(run_stage(spark, "exact_dedup", docs))) == {i for _, i in best.values()}

    assert set(texts(run_stage(spark, "ngram_jaccard_join", docs))) == {c for _, _, c in jaccard(list(before.items()))}

    clean = run_stage(spark, "pii", docs)
    assert clean.columns == COLUMNS and clean.where("n_chars != length(text)").count() == 0
    for i, t in texts(clean).items():
        assert not plain_spans(t) and (plain_spans(before[i]) or "secret" in t.lower() or t == before[i])


def test_run(spark):
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    want = Counter({(p.doc_id, b"".join(q.ids for q in sorted((q for q in pieces if q.doc_id == p.doc_id), key=lambda q: q.start))): 1
                    for p in pieces})
    check_pieces(pieces, want)
    assert all(sum(p.length for p in pieces if p.doc_id == d) == n for d, n in {(p.doc_id, p.doc_tokens) for p in pieces})


def test_odd_and_empty(spark, odd, odd_rows, empty):
    for df, n in ((odd, len(odd_rows)), (empty, 0)):
        for name in list(STAGES)[:-1]:
            out = run_stage(spark, name, df)
            assert out.columns == df.columns and out.count() <= n
    kept = run_stage(spark, "ngram_jaccard_join", odd)
    # of the rows without an id one is a copy, the other has no text
    assert [r.text for r in kept.where(F.col("doc_id").isNull()).collect()] == [None]
