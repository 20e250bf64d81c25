"""Row validation with reasons (V-01..V-09) and the error report (K-06).

One pass builds an ``errors`` array per row. The normalised rows are written once; duplicate
flags come from one count of both kinds of keys (map-side combined) looked up by the key. A
phone number on a large share of the rows is met by broadcast, so its rows stay where they
are; rows without a key spread by a salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake import schema as S
from carelake.functions.expr import (clean_email, clean_text, digits_only, null_if_token, parse_date,
                                     strip)
from carelake.operators.clean import prepare_raw_patients
from carelake.operators.load import PATIENT_KEYS, frequent_by_kind, look_up
from carelake.session import cut_lineage
from carelake.sources.numbering import with_row_index


def _repeated(df: DataFrame) -> DataFrame:
    """(kind, key) of phone numbers and e-mails that occur more than once: one aggregate."""
    keys = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("key")) for c in ("phone_number", "email")])
    return (df.select(F.explode(keys).alias("k")).select("k.*").where(F.col("key").isNotNull())
            .groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))


def validation_frame(raw: DataFrame, strict: bool = False, length_bounds: bool = False) -> DataFrame:
    """All raw rows with normalised key fields and an ``errors`` array."""
    df = prepare_raw_patients(raw)
    text = df.select(
        "row_id", clean_text("first_name").alias("_f"), clean_text("last_name").alias("_l"),
        F.nullif(digits_only("phone_number"), F.lit("")).alias("phone_number"),
        clean_email("email").alias("email"),
        F.col("date_of_birth").alias("_dob_raw"), strip("date_of_birth").alias("_dob"),
        *[F.col(c) for c in ("gender", "address", "blood_group")])
    parts = F.split("_f", r"(?U)\s+", 2)
    norm = (text.withColumns({
                "first_name": null_if_token(F.get(parts, 0)),
                "_last_given": F.coalesce("_l", null_if_token(F.get(parts, 1))),
                "date_of_birth": parse_date("_dob", stripped=True)})
            .withColumn("last_name", F.coalesce("_last_given", F.lit("Unknown")))
            .drop("_f", "_l", "_dob"))

    j = norm = cut_lineage(norm)
    repeated, frequent = _repeated(norm), frequent_by_kind(norm, PATIENT_KEYS)
    for key, out in (("phone_number", "_phone_n"), ("email", "_email_n")):
        found = repeated.where(F.col("kind") == key).select(F.col("key").alias(key))
        j = look_up(j, found, key, F.min(F.lit(1)), out, frequent=frequent[key])

    phone_ok = F.col("phone_number").isNotNull() & (F.length("phone_number") >= S.MIN_PHONE_DIGITS)
    email = F.col("email")
    checks = [
        F.when(F.col("first_name").isNull(), F.lit(S.MSG_MISSING_FIRST)),
        F.when(F.lit(strict) & F.col("_last_given").isNull(), F.lit(S.MSG_MISSING_LAST)),
        F.when(~phone_ok, F.lit(S.MSG_BAD_PHONE))
         .when(F.col("_phone_n").isNotNull(), F.lit(S.MSG_DUP_PHONE)),
        F.when(email.isNotNull() & F.col("_email_n").isNotNull(), F.lit(S.MSG_DUP_EMAIL)),
        F.when(email.isNotNull() & (~email.contains("@") | email.startswith("@") | email.endswith("@")),
               F.lit(S.MSG_BAD_EMAIL)),
        F.when(null_if_token("_dob_raw").isNotNull() & F.col("date_of_birth").isNull(),
               F.lit(S.MSG_BAD_DOB)),
    ]
    if length_bounds:
        for field, (lo, hi) in S.FIELD_LENGTH_BOUNDS.items():
            if field in j.columns:
                n = F.length(field)
                checks.append(F.when(F.col(field).isNotNull() & ((n < lo) | (n > hi)),
                                     F.lit(f"{field} length must be between {lo} and {hi}")))
    errors = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return j.withColumn("errors", errors).drop("_phone_n", "_email_n", "_last_given")


def invalid_rows(frame: DataFrame) -> DataFrame:
    """V-09 invalid branch."""
    return frame.where(F.size("errors") > 0)


def numbered(invalid: DataFrame, raw: DataFrame) -> DataFrame:
    """``invalid`` with ``row_number``, the row's place in the sheet (the header is row 1).
    Only the row ids of the sheet are put in order."""
    places = with_row_index(raw.select("row_id"), "row_id", "row_number", start=2)
    return invalid.join(places, "row_id")


def valid_rows(frame: DataFrame) -> DataFrame:
    """V-09 valid branch (the complement)."""
    return frame.where(F.size("errors") == 0)


def error_report(invalid: DataFrame) -> DataFrame:
    """K-06 columns: row #, names, phone, e-mail, DOB and the '; '-joined errors.
    Write with ``.write.csv(path, header=True, quoteAll=True, escape='"')``."""
    txt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return invalid.select(
        F.col("row_number"),
        txt("first_name").alias("first_name"),
        txt("last_name").alias("last_name"),
        txt("phone_number").alias("phone"),
        txt("email").alias("email"),
        txt("date_of_birth").alias("dob"),
        F.array_join("errors", "; ").alias("errors"),
    )


ERROR_REPORT_HEADERS = ["Row #", "First Name", "Last Name", "Phone", "Email", "DOB", "Errors"]


def write_error_report(invalid: DataFrame, path: str) -> None:
    """K-06 sink: CSV files with the report headers, every field quoted, quotes doubled."""
    report = error_report(invalid)
    report.toDF(*ERROR_REPORT_HEADERS).write.mode("overwrite").option("header", "true") \
        .option("quoteAll", "true").option("escape", '"').csv(path)
