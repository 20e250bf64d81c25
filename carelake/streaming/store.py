"""Append-only table folders written one micro-batch per sub-folder.

Each batch writes ``<table>/batch=<id>`` with mode overwrite and ends with a mark in
``_published``. A batch reads only what batches before it have written, so running it
again, whole or after a stop between two writes, reads the same state, derives the same
rows and replaces its own output. Readers see published batches only; a single writer per
store is assumed. The mark also carries a small text of the batch's own, such as the runs of
its keyed state (see ``keyed``) and the largest ids, so that a batch need not look for them
in the tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

PUBLISHED = StructType([StructField("published", LongType()), StructField("state", StringType())])


def table_path(store: str, table: str) -> str:
    return f"{store.rstrip('/')}/{table}"


def read_if_there(load, empty) -> DataFrame:
    """``load()``, or ``empty()`` where the path does not exist; any other error is raised."""
    try:
        return load()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty()


def last_mark(spark: SparkSession, store: str, before: int | None = None):
    """(published, state) of the newest published batch (before ``before``), or None."""
    marks = read_if_there(lambda: spark.read.schema(PUBLISHED).parquet(table_path(store, "_published")),
                          lambda: spark.createDataFrame([], PUBLISHED))
    if before is not None:
        marks = marks.where(F.col("published") < before)
    newest = marks.agg(F.max(F.struct("published", "state")).alias("m")).first()["m"]
    return newest


def last_published(spark: SparkSession, store: str, before: int | None = None) -> int | None:
    """The newest published batch (before ``before``)."""
    mark = last_mark(spark, store, before)
    return None if mark is None else mark["published"]


def read_store(spark: SparkSession, store: str, table: str, schema: StructType, before: int | None = None,
               only: int | None = None) -> DataFrame:
    """Rows of published batches, of those before ``before``, or of batch ``only``."""
    newest = last_published(spark, store, before)
    empty = lambda: spark.createDataFrame([], schema)
    if newest is None:
        return empty()
    batched = StructType([*schema.fields, StructField("batch", LongType())])
    rows = read_if_there(lambda: spark.read.schema(batched).parquet(table_path(store, table)), empty)
    if "batch" not in rows.columns:
        return rows
    wanted = F.col("batch") <= newest if only is None else F.col("batch") == only
    return rows.where(wanted).select(*schema.fieldNames())


def write_batch(df: DataFrame, store: str, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{table_path(store, table)}/batch={batch_id}")


def write_all(tables: list[tuple[DataFrame, str]], store: str, batch_id: int, also: list[Callable[[], None]] = ()) -> None:
    """Write a batch's tables side by side (and run what else there is to write)."""
    todo = [(lambda rows=rows, table=table: write_batch(rows, store, table, batch_id)) for rows, table in tables] + list(also)
    spark = tables[0][0].sparkSession
    with ThreadPoolExecutor(max_workers=4) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(job)) for job in todo]:
            done.result()


def publish(spark: SparkSession, store: str, batch_id: int, state: str | None = None) -> None:
    """Make everything that the batch wrote visible."""
    mark = spark.range(1, numPartitions=1).select(F.lit(batch_id).cast("long").alias("published"), F.lit(state).cast("string").alias("state"))
    write_batch(mark, store, "_published", batch_id)
