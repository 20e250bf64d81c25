"""Dense row positions without a global single-partition window.

1. range-partition and sort on the order column (Spark samples the key, so a large input is
   spread over many tasks) and write the rows with their partition and place in it;
2. count the written rows by partition and add the counts up: one row per partition;
3. position = rows in earlier partitions + place, by a broadcast join of those rows.

The sorted rows lie in the shared checkpoint folder, so the places used for counting and for
the output are the same even if tasks re-run. The input is read twice (the sample takes the
key only), so give a written table where it is costly. Where the caller knows that there are
no more rows than one task sorts with ease, one task does: no sample, no counting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.session import cut_lineage

_LOW_BITS = (1 << 33) - 1
#: Rows that one task sorts.
ONE_TASK = 200_000


def with_row_index(df: DataFrame, order_col: str = "row_id", name: str = "row_index",
                   start: int = 0, rows: int | None = None) -> DataFrame:
    """``df`` with ``name``: the place of each row in ``order_col`` order, from ``start``.
    ``rows``: how many there are (at most), where that is known."""
    spark = df.sparkSession
    if rows is not None and rows <= ONE_TASK:
        place = (F.monotonically_increasing_id() + F.lit(start)).cast("long")
        return cut_lineage(df.coalesce(1).sortWithinPartitions(order_col).withColumn(name, place))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    placed = cut_lineage(
        df.repartitionByRange(parts, order_col).sortWithinPartitions(order_col)
          .withColumns({"_part": F.shiftright(place, 33).cast("int"), "_place": place.bitwiseAND(F.lit(_LOW_BITS))}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    offsets = (placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    position = (F.col("_offset") + F.col("_place") + F.lit(start)).cast("long")
    return placed.join(F.broadcast(offsets), "_part").select(
        *[F.col(c) for c in df.columns if c != name], position.alias(name))
