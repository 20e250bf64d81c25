"""Exact de-duplication by two-pass Bloom filtering.

Texts are equal when identical after white space is deleted. Pass one sets, for every
text, ``PROBES`` bits of a filter and finds the bits that more than one row sets. Pass two
tests every row against those bits: a row with a bit of its own has no equal and passes
straight through; only the rest, which hold every true copy and a few chance hits, are
grouped by their whole SHA-256. A chance hit costs a shuffled row, never a wrong result.

The filter has 16 bits a row and at most ``max_bits``; the driver and the executors hold
no more than that (16 MB of bits at the default), however large the table. Beyond
``max_bits / 16`` rows the filter lets more rows through to the grouping and stays right.

Defined results: null text counts as empty; empty texts are equal to each other and to
texts of white space alone; of equal texts the row with most code points in the original
stays, then the smallest id (null ids last); a repeated row is a copy like any other
(in ``copies`` all rows of one id in a group share the decision, ``drop_copies`` leaves one
of them); an empty table gives no rows.
Other columns pass through untouched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import BLANKS, lookup_hot, staged

PROBES = 2


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_id, n_points, text_sha256) of every row; the text goes no further."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).alias("row_id"),
        F.length(text).cast("long").alias("n_points"),
        F.sha2(F.regexp_replace(text, BLANKS, ""), 256).alias("text_sha256"))


def _bits(bits: int):
    """The rows' filter positions: PROBES independent parts of the digest."""
    return F.array_distinct(F.array(*[
        F.conv(F.substring("text_sha256", 1 + 8 * k, 8), 16, 10).cast("long")
        .bitwiseAND(F.lit(bits - 1)) for k in range(PROBES)]))


def repeated_bits(marks: DataFrame, bits: int) -> DataFrame:
    """(word, mask): 64-bit words of the filter with the bits that two or more rows set.
    At most bits / 64 rows."""
    twice = (marks.select(F.explode(_bits(bits)).alias("bit"))
             .groupBy("bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return (twice.groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")))


def _flagged(rows: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """``rows`` (with ``text_sha256``) and ``maybe``: whether another row may be equal."""
    probed = rows.withColumn("_bits", _bits(bits))
    for k in range(PROBES):  # the second position may equal the first
        at = F.coalesce(F.get("_bits", F.lit(k)), F.get("_bits", F.lit(0)))
        probed = (probed.withColumn("_at", at)
                  .join(F.broadcast(words.select(F.col("word").alias(f"_word{k}"),
                                                 F.col("mask").alias(f"_mask{k}"))),
                        F.shiftright("_at", 6) == F.col(f"_word{k}"), "left")
                  .withColumn(f"_hit{k}", F.expr(
                      f"coalesce(_mask{k} & shiftleft(1L, cast(_at & 63 as int)), 0L) != 0")))
    hit = F.expr(" AND ".join(f"_hit{k}" for k in range(PROBES)))
    return probed.select(*rows.columns, hit.alias("maybe"))


def filter_bits(total: int, max_bits: int) -> int:
    bits = 1 << 16
    while bits < 16 * total and bits < max_bits:
        bits <<= 1
    return bits


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           max_bits: int = 1 << 27) -> DataFrame:
    """One row per row of ``df``: row_id, n_points, text_sha256, keep_id, group_size, kept."""
    marks = staged(fingerprints(df, id_col, text_col), "exact-marks")
    total = marks.count()
    bits = filter_bits(total, max_bits)
    words = repeated_bits(marks, bits)
    probed = staged(_flagged(marks, words, bits), "exact-probed")
    order = F.struct(-F.col("n_points"), F.col("row_id").isNull(), F.col("row_id"))
    groups = (probed.where("maybe")
              .withColumn("_order", order)
              .groupBy("text_sha256")
              .agg(F.min("_order").alias("_first"), F.count(F.lit(1)).alias("group_size"))
              .where("group_size > 1")
              .select("text_sha256", F.col("_first.row_id").alias("keep_id"), "group_size",
                      F.lit(True).alias("_grouped")))
    rows = lookup_hot(probed.where("maybe").drop("maybe"), groups, "text_sha256", "group_size",
                      total, F.xxhash64("row_id", "n_points"))
    alone = F.col("_grouped").isNull()
    maybe = rows.select(
        "row_id", "n_points", "text_sha256",
        F.when(alone, F.col("row_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    clear = probed.where("NOT maybe").select(
        "row_id", "n_points", "text_sha256", F.col("row_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"))
    return clear.unionByName(maybe).withColumn("kept", F.col("row_id").eqNullSafe(F.col("keep_id")))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_bits: int = 1 << 27) -> DataFrame:
    """``df`` with one row of every group of equal texts; all columns stay, whatever their
    names. The row of a group is chosen as by ``copies``, so another text under the same id is
    left alone, and of rows equal in text and id one stays.

    Both passes of the filter look at a 64-bit print of the text. Rows whose bits are their
    own pass straight through; the rest are told apart by their whole SHA-256, and of each
    group one row a task, combined before the shuffle, goes on."""
    names = [f"c{i}" for i in range(len(df.columns))]
    text, name = (F.col(names[df.columns.index(c)]) for c in (text_col, id_col))
    text = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(text, BLANKS + "+", "")
    rows = df.toDF(*names).withColumn("text_sha256", F.lpad(F.hex(F.xxhash64(bare)), 16, "0"))
    marks = staged(rows.select("text_sha256"), "exact-marks")
    bits = filter_bits(marks.count(), max_bits)
    words = staged(repeated_bits(marks, bits), "exact-bits")
    flagged = _flagged(rows, words, bits)
    order = F.struct(-F.length(text).cast("long"), name.isNull(), name, text)
    first = (flagged.where("maybe").groupBy(F.sha2(bare, 256).alias("whole"))
             .agg(F.min_by(F.struct(*names), order).alias("row")))
    return flagged.where("NOT maybe").select(*names).unionByName(first.select("row.*")).toDF(*df.columns)
