"""What near copies leave on disk, and that going over them in slices changes nothing."""

import os
import random

import pytest
from pyspark.sql import functions as F

from carelake.llm import blocks, shingle_join
from carelake.session import ensure_checkpoint_dir
from tests.llm.test_copies import got_jaccard, jaccard


def families(seed, n, lengths, passage=()):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for family in range(n):
        base = [word() for _ in range(rng.choice(lengths))]
        for _ in range(rng.choice([1, 2, 9])):
            text = [w if rng.random() > 0.03 else word() for w in base] + list(passage) * (rng.random() < 0.4)
            rows.append((len(rows) + 1000 * family, " ".join(text)))
    return rows


@pytest.mark.parametrize("opened", ["by slices", "at once"])
def test_slices_change_nothing(spark, monkeypatch, opened):
    monkeypatch.setattr(shingle_join, "GROUP", 8)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(shingle_join, "SLICE_BYTES", 20_000 if opened == "by slices" else 1 << 30)
    rows = families(3, 14, [4, 30, 120], [f"p{i}" for i in range(40)])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got_jaccard(df) == jaccard(rows)


def shuffled(spark):
    """Bytes of shuffle files that the application has on disk."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(os.path.getsize(os.path.join(d, f)) for top in manager.localDirs()
               for d, _, names in os.walk(str(top)) for f in names if f.startswith("shuffle_"))


def staged_files(spark):
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names}


def test_sets_and_shuffles_go(spark, tmp_path):
    """Texts, sets and groups that were moved stayed on disk to the end of the stage and beyond."""
    rows = families(4, 300, [300])
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    size = sum(len(t) for _, t in rows)
    spark._jvm.System.gc()
    before, there = shuffled(spark), staged_files(spark)
    kept = shingle_join.drop_near_copies(df)
    left = sum(n for f, n in staged_files(spark).items() if f not in there)
    assert shuffled(spark) - before < size / 10
    assert left < size
    assert kept.count() == len({c for _, _, c in got_jaccard(df)})
    assert kept.agg(F.max(F.length("text"))).first()[0] <= max(len(t) for _, t in rows)
