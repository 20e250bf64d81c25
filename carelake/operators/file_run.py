"""A whole file as one operator: a patients sheet and a visits sheet in; the profile, the rows
to store, the rejected rows with reasons, and the checks after the load out.

Both sheets are read once: what later steps need of them is a written copy. Patients are cleaned
as the command-line path does (ids may be given), rows without phone number or first name are
rejected, of equal phone numbers and then of equal e-mails the first stays, and the rest is
inserted unless a key is taken. Visits are resolved against the stored patients and those just
accepted, so a visit may name a patient of the same file.

Nothing is stored here: the caller appends ``patients`` and ``visits``. A run over the same
inputs gives the same rows, so a run that was stopped can be repeated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake import schema as S
from carelake.operators import clean as C
from carelake.operators import dedup as D
from carelake.operators import load as L
from carelake.operators import profile as P
from carelake.session import cut_lineage


@dataclass(frozen=True)
class FileRun:
    """What a run gives; ``counts`` is one row."""
    missing: DataFrame
    distinct: DataFrame
    issues: DataFrame
    patients: DataFrame
    rejected_patients: DataFrame
    visits: DataFrame
    rejected_visits: DataFrame
    counts: DataFrame


def _in_one_row(*rows: DataFrame) -> DataFrame:
    """One-row frames of different columns side by side, without a join."""
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r, allowMissingColumns=True)
    return every.agg(*[F.max(c).alias(c) for c in every.columns])


def _accepted_patients(sheet: DataFrame, stored: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(judged, unique, inserted) rows of a patients sheet."""
    reason = L.joined_reasons([F.when(F.col("phone_number").isNull(), F.lit(S.MSG_MISSING_PHONE)),
                               F.when(F.col("first_name").isNull(), F.lit(S.MSG_MISSING_FIRST))])
    judged = cut_lineage(C.clean_patients_cli(sheet, as_of).withColumn("reason", reason))
    unique = cut_lineage(D.dedup_chain(judged.where("reason IS NULL").drop("reason")))
    return judged, unique, cut_lineage(L.insert_ignore(unique, stored, L.CLI_KEYS, exact=True))


def _judged_visits(sheet: DataFrame, known: DataFrame) -> DataFrame:
    """Visits with their patient and the reason they cannot be stored, or null."""
    matched = L.match_visits(C.clean_visits(sheet, keep_undated=True), known)
    undated = F.when(F.col("visit_date").isNull(), F.lit(S.MSG_BAD_VISIT_DATE))
    return cut_lineage(matched.withColumn("reason", F.coalesce(undated, L.visit_reason())).drop("_stored"))


def run_file(patients_sheet: DataFrame, visits_sheet: DataFrame, stored_patients: DataFrame, stored_visits: DataFrame,
             as_of=None) -> FileRun:
    """Sheets hold text columns and ``row_id``; the stored tables are in stored form."""
    sheet = cut_lineage(patients_sheet)
    judged, unique, patients = _accepted_patients(sheet, stored_patients, as_of)
    known = ["patient_id", "phone_number", "email"]
    visits = _judged_visits(visits_sheet, stored_patients.select(*known).unionByName(patients.select(*known)))
    accepted = L.append_visits(visits.where("reason IS NULL").drop("reason"), stored_visits)
    rows, refused = F.count(F.lit(1)), F.count("reason")
    checks = L.post_load_counts(stored_patients, stored_visits)
    counts = _in_one_row(
        judged.agg(rows.alias("patients_found"), refused.alias("patients_rejected")),
        unique.agg(rows.alias("patients_unique")),
        patients.agg(rows.alias("patients_inserted")),
        visits.agg(rows.alias("visits_found"), refused.alias("visits_rejected"),
                   F.count_if(F.col("reason").isNull()).alias("visits_inserted")),
        checks.select(F.col("patients").alias("_patients"), F.col("visits").alias("_visits")))
    totals = counts.withColumns({"patients_stored": F.col("_patients") + F.col("patients_inserted"),
                                 "visits_stored": F.col("_visits") + F.col("visits_inserted")}).drop("_patients", "_visits")
    return FileRun(P.profile_missing(sheet), P.profile_distinct(sheet), P.profile_issues(sheet),
                   patients, judged.where("reason IS NOT NULL"), accepted, visits.where("reason IS NOT NULL"), totals)
