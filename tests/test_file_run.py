"""A whole file's run: visits reach patients of the same file, reasons, empty sheets, repeats."""

import datetime as dt

from carelake import schema as S
from carelake.operators.file_run import run_file
from carelake.operators.profile import read_quality_report, sheet_columns, write_quality_report

SHEET = "row_id long, patient_id string, first_name string, last_name string, gender string, date_of_birth string, phone_number string, email string"
VISITS = "row_id long, patient_id string, phone_number string, email string, doctor_name string, symptoms string, visit_date string"


def stored(spark):
    patients = spark.createDataFrame([(7, "Ann", "Old", None, None, "5550001", "ann@x.org", None, None, dt.date(2020, 1, 1))], S.PATIENT_SCHEMA)
    visits = spark.createDataFrame([(3, 7, "Dr A", None, None, None, dt.date(2020, 2, 2))], S.VISIT_SCHEMA)
    return patients, visits


def sheets(spark):
    patients = spark.createDataFrame([
        (1, None, "bo", "one", "m", "1990-01-02", "555-0002", "bo@x.org"),
        (2, "40", "cy", "two", "f", "02-01-1990", "555-0003", None),
        (3, None, "bo", "again", None, None, "5550002", None),            # phone of row 1
        (4, None, "ann", "new", None, None, "555 0001", None),            # stored phone
        (5, None, None, "nameless", None, None, "5550009", None),
        (6, None, "di", "phoneless", None, None, "nan", None),
        (7, "40", "ed", "taken", None, None, "5550010", None)], SHEET)     # id of row 2
    visits = spark.createDataFrame([
        (1, None, "555-0002", None, "dr b", "cough", "2024-03-04"),        # patient of this file, by phone
        (2, None, None, " BO@x.org", "dr b", None, "04-03-2024"),          # by e-mail
        (3, "40", None, None, "dr c", None, "2024-03-05"),
        (4, "99", None, None, "dr c", None, "2024-03-05"),
        (5, None, "12345", None, "dr c", None, "2024-03-05"),
        (6, "7", None, None, " ", None, "2024-03-05"),
        (7, "7", None, None, "dr c", None, "soon")], VISITS)
    return patients, visits


def test_a_file_is_loaded_in_one_run(spark):
    for _ in range(2):  # nothing is stored by a run, so it can be repeated
        done = run_file(*sheets(spark), *stored(spark), as_of="2024-06-01")
        got = {r.row_id: r.patient_id for r in done.patients.collect()}
        assert got == {1: 41, 2: 40}
        assert sorted((r.row_id, r.visit_id, r.patient_id) for r in done.visits.collect()) == [(1, 4, 41), (2, 5, 41), (3, 6, 40)]
        assert {r.row_id: r.reason for r in done.rejected_patients.collect()} == {5: S.MSG_MISSING_FIRST, 6: S.MSG_MISSING_PHONE}
        assert {r.row_id: r.reason for r in done.rejected_visits.collect()} == {
            4: S.MSG_UNKNOWN_PATIENT, 5: S.MSG_UNRESOLVED_PATIENT, 6: S.MSG_MISSING_DOCTOR, 7: S.MSG_BAD_VISIT_DATE}
        assert done.counts.first().asDict() == {
            "patients_found": 7, "patients_rejected": 2, "patients_unique": 4, "patients_inserted": 2, "visits_found": 7,
            "visits_rejected": 4, "visits_inserted": 3, "patients_stored": 3, "visits_stored": 4}
        assert {r.column_name: r.missing_count for r in done.missing.collect()}["email"] == 6
        assert done.issues.first().row_count == 7


def test_empty_sheets(spark):
    patients, visits = sheets(spark)
    done = run_file(patients.limit(0), visits.limit(0), *[t.limit(0) for t in stored(spark)], as_of="2024-06-01")
    assert done.patients.count() == done.visits.count() == done.rejected_visits.count() == done.rejected_patients.count() == 0
    assert set(done.counts.first().asDict().values()) == {0}


def test_sheet_columns_and_report(spark, tmp_path):
    raw = sheets(spark)[0].withColumnRenamed("email", "Ward No").drop("date_of_birth")
    got = {r.column_name: (r.status, r.given) for r in sheet_columns(raw).collect()}
    assert got["date_of_birth"] == ("missing", 0) and got["ward_no"] == ("unknown", 1) and got["first_name"] == ("expected", 6)
    write_quality_report(raw, str(tmp_path))
    back = {r.column_name: (r.missing_count, r.distinct_count) for r in read_quality_report(spark, str(tmp_path)).collect()}
    assert back["first_name"] == (1, 5) and back["ward_no"] == (6, 1)
