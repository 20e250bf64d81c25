"""Data-quality profile of a raw extract (P-01..P-07, K-09).

All per-column counts come from one aggregate; distinct counts go through an
unpivot and a two-level aggregate (map-side combined) instead of one distinct
aggregate per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake import schema as S
from carelake.functions.expr import digits_only, null_if_token, parse_date, strip
from carelake.operators.headers import normalize_headers, unknown_columns


def _profiled(raw: DataFrame) -> tuple[DataFrame, list[str]]:
    df = normalize_headers(raw)
    return df, [c for c in df.columns if c != "row_id"]


def profile_missing(raw: DataFrame) -> DataFrame:
    """Null count per column (P-02), one row per column."""
    df, cols = _profiled(raw)
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return agg.unpivot([], cols, "column_name", "missing_count")


def profile_distinct(raw: DataFrame) -> DataFrame:
    """Distinct non-null values per column (P-03)."""
    df, cols = _profiled(raw)
    long = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], cols, "column_name", "value")
            .where(F.col("value").isNotNull()))
    return (long.distinct()
            .groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count")))


def _issue_columns(df: DataFrame) -> DataFrame:
    """What the issue counts look at, one row per row."""
    for c in ("phone_number", "email", "date_of_birth", "gender"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    dob_given = null_if_token("date_of_birth").isNotNull()
    gender = F.lower(strip("gender"))
    return df.select(
        F.col("phone_number").alias("p_raw"), F.nullif(digits_only("phone_number"), F.lit("")).alias("p_dig"),
        F.nullif(F.lower(strip("email")), F.lit("")).alias("e"),
        (~dob_given).alias("dob_missing"),
        (dob_given & parse_date("date_of_birth").isNull()).alias("dob_bad"),
        (F.col("gender").isNotNull() & ~gender.isin(S.ALLOWED_GENDER_VALUES)).alias("g_bad"))


#: The values whose repeats are issues, by the name of the count.
REPEATS = {"duplicate_phone_raw": "p_raw", "duplicate_phone_digits": "p_dig", "duplicate_email": "e"}


def profile_issues(raw: DataFrame) -> DataFrame:
    """One row: sizes and issue counts (P-01, P-04..P-07). Distinct values are counted in
    long form, by map-side combined aggregates; a row is written out for the three of them."""
    df, cols = _profiled(raw)
    base = _issue_columns(df)
    counts = base.agg(F.count(F.lit(1)).alias("row_count"), F.count_if("dob_missing").alias("dob_missing"),
                      F.count_if("dob_bad").alias("dob_unparseable"), F.count_if("g_bad").alias("inconsistent_gender"))
    values = base.unpivot([], list(REPEATS.values()), "what", "value").where("value IS NOT NULL")
    repeats = (values.groupBy("what", "value").agg((F.count(F.lit(1)) - 1).alias("n"))
               .groupBy().pivot("what", list(REPEATS.values())).agg(F.sum("n")))
    one = counts.select(*[F.col(c) for c in counts.columns], *[F.lit(None).cast("long").alias(c) for c in REPEATS.values()]).unionByName(
        repeats, allowMissingColumns=True)
    return one.agg(
        F.max("row_count").alias("row_count"), F.lit(len(cols)).cast("long").alias("column_count"),
        *[F.coalesce(F.max(c), F.lit(0)).alias(name) for name, c in REPEATS.items()],
        *[F.max(c).alias(c) for c in ("dob_missing", "dob_unparseable", "inconsistent_gender")],
    ).withColumn("unknown_columns", F.lit(", ".join(unknown_columns(df))))


# --- a profile that grows by batches --------------------------------------------------------

#: Values longer than this are told apart by their SHA-256.
LONG_VALUE = 64


def profile_part(raw: DataFrame) -> DataFrame:
    """(column_name, row_count, given): what of a batch's profile adds up. Besides its columns
    there are the issues' own values (``REPEATS``) and, as ``given`` of a row of their own,
    the issue counts that are plain sums."""
    df, cols = _profiled(raw)
    sums = {"dob_missing": "dob_missing", "dob_unparseable": "dob_bad", "inconsistent_gender": "g_bad"}
    columns = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.count(c).alias(c) for c in cols])
    issues = _issue_columns(df).agg(F.count(F.lit(1)).alias("row_count"), *[F.count(c).alias(f"#{n}") for n, c in REPEATS.items()],
                                    *[F.count_if(c).alias(f"#{n}") for n, c in sums.items()])
    long = lambda f: f.unpivot(["row_count"], [c for c in f.columns if c != "row_count"], "column_name", "given")
    return long(columns).unionByName(long(issues)).select("column_name", "row_count", "given")


def profile_values(raw: DataFrame) -> DataFrame:
    """(key): the distinct values of a batch, by column, for a keyed state."""
    df, cols = _profiled(raw)
    named = {c: F.col(c).cast("string") for c in cols}
    base = df.select(*[v.alias(c) for c, v in named.items()])
    long = base.unpivot([], cols, "column_name", "value").unionByName(
        _issue_columns(df).select(*[F.col(c).alias(f"#{n}") for n, c in REPEATS.items()])
        .unpivot([], [f"#{n}" for n in REPEATS], "column_name", "value"))
    short = F.when(F.length("value") <= LONG_VALUE, F.col("value")).otherwise(F.concat(F.lit("sha256:"), F.sha2("value", 256)))
    return long.where("value IS NOT NULL").select(F.concat("column_name", F.lit(":"), short).alias("key")).distinct()


def new_values(fresh: DataFrame) -> DataFrame:
    """(column_name, fresh): how many of the keys of ``profile_values`` each column has."""
    return fresh.groupBy(F.substring_index("key", ":", 1).alias("column_name")).agg(F.count(F.lit(1)).alias("fresh"))


def merged_profile(parts: DataFrame) -> DataFrame:
    """(column_name, missing_count, distinct_count) over all batches' parts."""
    return (parts.where(~F.startswith("column_name", F.lit("#"))).groupBy("column_name")
            .agg(F.sum(F.col("row_count") - F.col("given")).alias("missing_count"), F.sum("fresh").alias("distinct_count")))


def merged_issues(parts: DataFrame) -> DataFrame:
    """``profile_issues`` over all batches' parts, in one row."""
    at = lambda n, v: F.coalesce(F.sum(F.when(F.col("column_name") == f"#{n}", v)), F.lit(0))
    column = ~F.startswith("column_name", F.lit("#"))
    unknown = column & ~F.col("column_name").isin(S.EXPECTED_PATIENT_COLUMNS)
    return parts.agg(
        at("dob_missing", F.col("row_count")).alias("row_count"),
        F.count_distinct(F.when(column, F.col("column_name"))).alias("column_count"),
        *[at(n, F.col("given") - F.col("fresh")).alias(n) for n in REPEATS],
        *[at(n, F.col("given")).alias(n) for n in ("dob_missing", "dob_unparseable", "inconsistent_gender")],
        F.array_join(F.sort_array(F.collect_set(F.when(unknown, F.col("column_name")))), ", ").alias("unknown_columns"))


def write_quality_report(raw: DataFrame, path: str, fmt: str = "json") -> dict[str, str]:
    """K-09: persist the profile tables (missing, distinct, issues) under ``path``."""
    import os
    out = {}
    for name, frame in (("missing", profile_missing(raw)), ("distinct", profile_distinct(raw)),
                        ("issues", profile_issues(raw))):
        target = os.path.join(path, name)
        frame.coalesce(1).write.mode("overwrite").format(fmt).save(target)
        out[name] = target
    return out


def read_quality_report(spark, path: str, fmt: str = "json") -> DataFrame:
    """The written report by column: (column_name, missing_count, distinct_count)."""
    import os
    part = lambda name, c: spark.read.schema(f"column_name string, {c} long").format(fmt).load(os.path.join(path, name))
    return (part("missing", "missing_count").join(part("distinct", "distinct_count"), "column_name", "left")
            .select("column_name", "missing_count", F.coalesce("distinct_count", F.lit(0)).alias("distinct_count")))


def sheet_columns(raw: DataFrame, required=S.REQUIRED_PATIENT_COLUMNS, expected=S.EXPECTED_PATIENT_COLUMNS) -> DataFrame:
    """(column_name, status, given): every column of a sheet with the number of its values,
    and the required ones that it lacks (H-03, H-04); one aggregate over the sheet."""
    df, cols = _profiled(raw)
    unknown = unknown_columns(df, expected)
    lacking = [c for c in required if c not in cols]
    held = df.agg(*[F.count(c).alias(c) for c in cols], *[F.lit(0).cast("long").alias(c) for c in lacking])
    status = (F.when(F.col("column_name").isin(lacking), F.lit("missing"))
              .when(F.col("column_name").isin(unknown), F.lit("unknown")).otherwise(F.lit("expected")))
    return held.unpivot([], [*cols, *lacking], "column_name", "given").select("column_name", status.alias("status"), "given")
