"""Cleaning projections and filters (C-01..C-19).

Every rule is a column expression, so a whole pipeline is one projection plus
filters that Catalyst fuses into a single whole-stage-codegen stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake import schema as S
from carelake.functions.expr import (as_of_lit, clean_email, clean_text, digits_only,
                                     gender_label, null_if_token, parse_date, strip, title_case,
                                     upper_code)
from carelake.operators.headers import inject_missing, normalize_headers, require_columns


def _stage_text(df: DataFrame, split_names: bool, keep_id: bool) -> DataFrame:
    """Stage 1: strip / placeholder / digit rules, one column each (computed once)."""
    out = [F.col("row_id")] if "row_id" in df.columns else []
    if keep_id:
        out.append(strip("patient_id").try_cast("bigint").alias("patient_id"))
    return df.select(
        *out,
        clean_text("first_name").alias("_f"),
        clean_text("last_name").alias("_l"),
        F.lower(clean_text("gender")).alias("_g"),
        strip("date_of_birth").alias("_dob"),
        F.nullif(digits_only("phone_number"), F.lit("")).alias("phone_number"),
        clean_email("email").alias("email"),
        # the upload path strips addresses; the CLI path only blanks placeholders
        (clean_text("address") if split_names else null_if_token("address")).alias("address"),
        upper_code("blood_group").alias("blood_group"),
        strip("registration_date").alias("_reg"),
    )


def _stage_names(df: DataFrame, split_names: bool) -> DataFrame:
    """Stage 2: first / last name before casing (C-03, C-04 input)."""
    if split_names:
        parts = F.split("_f", r"(?U)\s+", 2)
        first, last = null_if_token(F.get(parts, 0)), F.coalesce("_l", null_if_token(F.get(parts, 1)))
    else:
        first, last = F.col("_f"), F.col("_l")
    return df.withColumns({"_first": first, "_last": last}).drop("_f", "_l")


def _stage_final(df: DataFrame, as_of=None) -> DataFrame:
    """Stage 3: casing, code maps and date parsing into the stored types."""
    keep = [c for c in ("row_id", "patient_id") if c in df.columns]
    return df.select(
        *keep,
        title_case("_first").alias("first_name"),
        title_case(F.coalesce("_last", F.lit("Unknown"))).alias("last_name"),
        gender_label("_g", lowered=True).alias("gender"),
        parse_date("_dob", stripped=True).alias("date_of_birth"),
        "phone_number", "email", "address", "blood_group",
        F.coalesce(parse_date("_reg", stripped=True), as_of_lit(as_of)).alias("registration_date"),
    )


def clean_patient_columns(df: DataFrame, as_of=None, split_names: bool = True,
                          keep_id: bool = False) -> DataFrame:
    """Typed, normalised patient columns (no rows removed)."""
    return _stage_final(_stage_names(_stage_text(df, split_names, keep_id), split_names), as_of)


def prepare_raw_patients(raw: DataFrame) -> DataFrame:
    df = normalize_headers(raw)
    return inject_missing(df, S.PATIENT_COLUMNS)


def _importable(first: str):
    """The import filter: a first name, and a phone number of some length."""
    return (F.col(first).isNotNull() & F.col("phone_number").isNotNull()
            & (F.length("phone_number") >= S.MIN_PHONE_DIGITS))


def clean_patients_upload(raw: DataFrame, as_of=None) -> DataFrame:
    """C-18 up to (not including) de-duplication: normalise and apply the import filter.
    The filter is applied before casing (casing keeps null-ness), so it is cheap."""
    names = _stage_names(_stage_text(prepare_raw_patients(raw), True, False), True)
    return _stage_final(names.where(_importable("_first")), as_of)


def clean_with_verdict(raw: DataFrame, as_of=None) -> DataFrame:
    """``clean_patients_upload`` of all rows, with ``_importable`` in place of the filter."""
    cleaned = clean_patient_columns(prepare_raw_patients(raw), as_of)
    return cleaned.withColumn("_importable", F.coalesce(_importable("first_name"), F.lit(False)))


def clean_patients_cli(raw: DataFrame, as_of=None) -> DataFrame:
    """C-16: requires the four CLI columns, keeps ``patient_id``; no name split.
    Rows without a phone are not loadable (T11) and are left out here; see
    :func:`cli_rejects` for them."""
    df = normalize_headers(raw)
    require_columns(df, S.REQUIRED_PATIENT_COLUMNS, "patient extract")
    df = inject_missing(df, S.PATIENT_COLUMNS)
    return clean_patient_columns(df, as_of, split_names=False, keep_id=True)


def cli_rejects(cleaned: DataFrame) -> DataFrame:
    return (cleaned.where(F.col("phone_number").isNull())
            .withColumn("reason", F.lit("Missing phone number")))


def clean_visits(raw: DataFrame, keep_undated: bool = False) -> DataFrame:
    """C-19: visits sheet normalised; rows without a parseable visit date dropped."""
    df = normalize_headers(raw)
    require_columns(df, S.REQUIRED_VISIT_COLUMNS, "visits sheet")
    df = inject_missing(df, ["patient_id", "phone_number", "email", "symptoms",
                             "medications", "follow_up_date"])
    out = [F.col("row_id")] if "row_id" in df.columns else []
    cleaned = df.select(
        *out,
        strip("patient_id").try_cast("bigint").alias("patient_id"),
        F.nullif(digits_only("phone_number"), F.lit("")).alias("phone_number"),
        clean_email("email").alias("email"),
        title_case(clean_text("doctor_name")).alias("doctor_name"),
        clean_text("symptoms").alias("symptoms"),
        clean_text("medications").alias("medications"),
        parse_date("follow_up_date").alias("follow_up_date"),
        parse_date("visit_date").alias("visit_date"),
    )
    return cleaned if keep_undated else cleaned.where(F.col("visit_date").isNotNull())


def truncate_to_bounds(df: DataFrame, bounds=None) -> DataFrame:
    """T17 option: cut over-long text to the stored column length (as an INSERT IGNORE
    into VARCHAR(n) columns would) instead of rejecting the row."""
    bounds = bounds or S.FIELD_LENGTH_BOUNDS
    return df.withColumns({c: F.substring(c, 1, hi) for c, (_, hi) in bounds.items() if c in df.columns})


def to_json_records(df: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """K-08: one JSON text per row; nulls stay null, NaN becomes null, dates as ISO text."""
    cols = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"dateFormat": date_format,
                                                       "ignoreNullFields": "false"}).alias("json"))
