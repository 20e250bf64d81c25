"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from carelake.session import ensure_checkpoint_dir

#: ASCII white space as the operators mean it: space and 0x09 to 0x0D.
BLANKS = r"[\x20\x09-\x0D]"


#: Of a row's number, the bits for its place in its file.
ROW_BITS = 40

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package (Spark's own file transfer, once per application), so
    that tasks can import it wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="carelake-code-"), "carelake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(n for n in names if n.endswith(".py")):
                z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(top)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, by whatever path or store Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Spark's setting by which the shuffle files of a job go when it ends, not whenever the
#: driver happens to collect its garbage.
_FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _without_shuffle_files(spark: SparkSession):
    before = spark.conf.get(_FILES_GO, "false")
    spark.conf.set(_FILES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(_FILES_GO, before)


def _stage_path(spark: SparkSession, what: str) -> str:
    ship(spark)
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again.

    Cuts the lineage, so that later jobs neither repeat the work nor depend on the
    executors that did it, and nothing that was shuffled for it stays on disk."""
    spark = df.sparkSession
    path = _stage_path(spark, what)
    with _without_shuffle_files(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def staged_slices(parts: Iterable[DataFrame], what: str) -> DataFrame:
    """All ``parts``, of one schema and at least one, as one staged frame with a column
    ``slice``: the number of the part. They are written one after the other, so only what one
    of them shuffles is on disk at a time; a filter on ``slice`` reads that slice alone."""
    path, schema = "", None
    for i, part in enumerate(parts):
        spark = part.sparkSession
        if schema is None:
            path, schema = _stage_path(spark, what), part.schema
        with _without_shuffle_files(spark):
            part.write.parquet(f"{path}/slice={i}")
    out = spark.read.schema(StructType([*schema, StructField("slice", IntegerType())])).parquet(path)
    out._staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unstaged(*frames: DataFrame) -> None:
    """Deletes the files of staged frames that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df._staged_at)


def by_slice(df: DataFrame, last_use: bool = False) -> Iterator[DataFrame]:
    """The slices of a frame of ``staged_slices``. At their ``last_use`` the files of each go
    when the next one is asked for."""
    n = df.agg(F.coalesce(F.max("slice"), F.lit(0))).first()[0] + 1
    for i in range(n):
        yield df.where(F.col("slice") == i)
        if last_use:
            _delete(df.sparkSession, f"{df._staged_at}/slice={i}")


def numbered(df: DataFrame, names: list[str], name: str) -> DataFrame:
    """``df`` with its columns renamed to ``names`` and a number of its own, ``name``, for every
    row, the same whenever it is read: by file and place where ``df`` is what Parquet files
    hold, or else by writing the rows."""
    placed = None
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in df.columns:
        with suppress(AnalysisException):  # not every kind of file tells a row's place
            placed = df.select("*", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    if placed is None:
        return staged(df.toDF(*names).withColumn(name, F.monotonically_increasing_id()), "numbered")
    placed = placed.toDF(*names, "_path", "_place")
    files = staged(placed.select("_path").distinct().coalesce(1).withColumn("_file", F.monotonically_increasing_id()), "files")
    return placed.join(F.broadcast(files), "_path").select(*names, (F.shiftleft("_file", ROW_BITS) + F.col("_place")).alias(name))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup_hot(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int,
               salt: Column, hot_groups: int = 1000) -> DataFrame:
    """Left join of ``rows`` with one row per ``key`` in ``groups``, safe for hot keys.

    A group of at least ``total / hot_groups`` rows is hot. There are at most
    ``hot_groups`` of those, whatever the data, so they are broadcast; their rows, and
    those without a key, get a salt in place of the key and spread over all partitions
    of the ordinary join, which then sees no group above that size.
    Columns of ``groups`` must not clash with those of ``rows`` (but for ``key``)."""
    bound = max(1.0, total / hot_groups)
    names = [c for c in groups.columns if c != key]
    hot = (groups.where(F.col(size) > bound)
           .select(F.col(key), *[F.col(c).alias(f"_hot_{c}") for c in names]))
    cool = (groups.where(F.col(size) <= bound)
            .select(F.col(key).alias("_cool_key"), F.lit(0).alias("_cool_salt"),
                    *[F.col(c).alias(f"_cool_{c}") for c in names]))
    settled = F.col(f"_hot_{size}").isNotNull() | F.col(key).isNull()
    keyed = (rows.join(F.broadcast(hot), key, "left")
             .withColumn("_row_key", F.when(~settled, F.col(key)))
             .withColumn("_row_salt", F.when(settled, F.pmod(salt, F.lit(1 << 30)) + 1)
                         .otherwise(0).cast("int")))
    joined = keyed.join(cool, (F.col("_row_salt") == F.col("_cool_salt"))
                        & F.col("_row_key").eqNullSafe(F.col("_cool_key")), "left")
    return joined.select(
        *rows.columns, *[F.coalesce(F.col(f"_hot_{c}"), F.col(f"_cool_{c}")).alias(c) for c in names])
