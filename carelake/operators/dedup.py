"""De-duplication (D-01..D-04).

Keep-first is a min-by aggregate keyed on the identifier: Spark combines it
map-side, so even a key that holds a large share of all rows moves at most one
row per map task through the shuffle. Rows with a missing key never compete
and are passed through by a union instead of forming one huge null group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first_by(df: DataFrame, key: str, order_col: str = "row_id") -> DataFrame:
    """First row (smallest ``order_col``) per non-blank ``key``; blank-key rows all kept.

    One aggregate: a blank key is replaced by a per-row surrogate, so blank-key
    rows stay single-row groups spread by hash instead of one huge null group,
    and the input is scanned once.
    """
    cols = df.columns
    has_key = F.col(key).isNotNull() & (F.trim(F.col(key)) != "")
    group = F.when(has_key, F.concat(F.lit("k:"), F.col(key))).otherwise(
        F.concat(F.lit("r:"), F.coalesce(F.col(order_col).cast("string"),
                                         F.raise_error(F.lit(f"{order_col} must not be null")).cast("string"))))
    return (df.groupBy(group.alias("_grp"))
            .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order_col)).alias("_r"))
            .select("_r.*"))


def dedup_phone(df: DataFrame, order_col: str = "row_id") -> DataFrame:
    """D-01: keep the first row per phone number."""
    return keep_first_by(df, "phone_number", order_col)


def dedup_email(df: DataFrame, order_col: str = "row_id") -> DataFrame:
    """D-02: keep the first row per e-mail; rows without e-mail are all kept."""
    return keep_first_by(df, "email", order_col)


def dedup_chain(df: DataFrame, order_col: str = "row_id") -> DataFrame:
    """D-01 then D-02 (the order both cleaning pipelines use)."""
    return dedup_email(dedup_phone(df, order_col), order_col)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """P-09: key values occurring more than once, with their count."""
    return (df.where(F.col(key).isNotNull())
            .groupBy(key).agg(F.count(F.lit(1)).alias("occurrences"))
            .where(F.col("occurrences") > 1))
