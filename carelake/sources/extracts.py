"""Raw registry extracts (S-01..S-04): CSV, JSON or Parquet, read as text.

Every column is read as a string (no type inference: phone numbers keep their leading
zeros, mixed date layouts survive). CSV follows RFC 4180: quotes are doubled and fields may
hold line breaks; large files are cut by many tasks all the same (see ``records``), and every
file of a folder is read by its own header. ``row_id`` numbers rows in file order: files by
path, blocks by place, rows by position. A ``row_id`` column of the extract is used as it is
and must not be null (an error).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.sources.records import by_header
from carelake.streaming.store import read_if_there

EXTRACT_FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet"}


def extract_format(path: str, fmt: str | None = None) -> str:
    """S-04: the reader for a path, from ``fmt`` or the file suffix; anything else is refused."""
    if fmt:
        if fmt not in set(EXTRACT_FORMATS.values()):
            raise ValueError("Only .csv, .json and .parquet extracts are supported.")
        return fmt
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in EXTRACT_FORMATS:
        raise ValueError("Only .csv, .json and .parquet extracts are supported.")
    return EXTRACT_FORMATS[suffix]


def _numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """``row_id`` from 0 in file order. One row per block of a file is counted first; the
    blocks' offsets, in order, are joined back."""
    placed = df.select(*columns, F.col("_metadata.file_path").alias("_path"),
                       F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = placed.groupBy("_path", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n")).collect()
    offsets, running = [], 0
    for b in sorted(blocks, key=lambda r: (r["_path"], r["_block"])):
        offsets.append((b["_path"], b["_block"], running - b["_first"]))
        running += b["n"]
    table = df.sparkSession.createDataFrame(offsets, "_p string, _b long, _offset long")
    return (placed.join(F.broadcast(table), (F.col("_path") == F.col("_p")) & (F.col("_block") == F.col("_b")))
            .select((F.col("_at") + F.col("_offset")).alias("row_id"), *columns))


def read_extract(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """S-01/S-02: one extract folder or file as all-string columns plus ``row_id``."""
    fmt = extract_format(path, fmt)
    if fmt == "csv":
        df = by_header(spark, path)
        if "row_id" in df.columns[1:]:  # the extract numbers its rows itself
            df = df.toDF("_place", *df.columns[1:]).drop("_place")
    elif fmt == "json":
        df = spark.read.option("primitivesAsString", "true").json(path)
    else:
        df = spark.read.parquet(path)
    text = [c for c in df.columns if c != "row_id"]
    cast = [F.col(f"`{c}`").cast("string").alias(c) for c in text]
    if fmt == "csv" and df.schema[0].name == "row_id" and df.schema[0].dataType == T.LongType():
        return df
    if "row_id" in df.columns:
        given = F.col("row_id").try_cast("long")
        return df.select(F.coalesce(given, F.raise_error(F.lit("row_id must be a number")).cast("long")).alias("row_id"), *cast)
    return _numbered(df, [f"`{c}`" for c in text]).select("row_id", *cast)


def read_optional(spark: SparkSession, path: str, columns, fmt: str | None = None) -> DataFrame:
    """S-03: an optional extract; absent -> empty frame with the expected text columns."""
    schema = T.StructType([T.StructField("row_id", T.LongType())] + [T.StructField(c, T.StringType()) for c in columns])
    empty = lambda: spark.createDataFrame([], schema)
    if not path or read_if_there(lambda: spark.read.text(path), lambda: None) is None:
        return empty()
    return read_extract(spark, path, fmt)
