"""Edge rows from FIXTURES.md (A7), one expression each."""

import datetime as dt

from pyspark.sql import functions as F

from carelake.functions import expr as X


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_phone_digits(spark):
    assert one(spark, X.digits_only("v"), "09699836744") == "09699836744"
    assert one(spark, X.digits_only("v"), "+91 (99) 88-77") == "91998877"


def test_mixed_and_impossible_dates(spark):
    assert one(spark, X.parse_date("v"), "11-03-2026") == dt.date(2026, 3, 11)
    assert one(spark, X.parse_date("v"), "2026-03-10") == dt.date(2026, 3, 10)
    assert one(spark, X.parse_date("v"), "31-02-1980") is None
    assert one(spark, X.parse_date("v"), " 29-02-2004 ") == dt.date(2004, 2, 29)
    assert one(spark, X.parse_date("v"), "11/03-2026") is None


def test_title_case_vs_initcap(spark):
    assert one(spark, X.title_case("v"), "o'brien") == "O'Brien"
    assert one(spark, X.title_case("v"), "MARY-JANE") == "Mary-Jane"
    assert one(spark, X.title_case("v"), "surname001 3rd") == "Surname001 3Rd" == "surname001 3rd".title()


def test_symptom_token(spark):
    assert one(spark, X.symptom_token("v"), "high-grade  FEVER") == "High-grade Fever"


def test_strip_all_whitespace(spark):
    assert one(spark, X.strip("v"), "\t x y \n") == "x y"
    assert one(spark, X.clean_text("v"), " NaN ") is None


def test_gender(spark):
    assert one(spark, X.gender_label("v"), " f") == "Female"
    assert one(spark, X.gender_label("v"), "OTHER") == "Other"
    assert one(spark, X.gender_label("v"), "none") is None


def test_leap_day_age(spark):
    df = spark.createDataFrame([(dt.date(2004, 2, 29),)], "d date")
    assert df.select(X.age_years("d", dt.date(2025, 2, 28))).first()[0] == 20
    assert df.select(X.age_years("d", dt.date(2025, 3, 1))).first()[0] == 21


def test_follow_up_status(spark):
    df = spark.createDataFrame([(-3,), (-1,), (0,), (1,), (5,)], "d int")
    got = [r[0] for r in df.select(X.follow_up_status("d")).collect()]
    assert got == ["Overdue by 3 days", "Overdue by 1 day", "Due today", "Due in 1 day", "Due in 5 days"]


def test_fuzzy_pair(spark):
    from carelake.operators.fuzzy import fuzzy_dedup
    rows = [(2, "Jonathann", "Smithson"), (1, "Jonathan", "Smithson"), (3, "Tide", "Smithson"), (4, "Diet", "Smithson")]
    df = spark.createDataFrame([(*r, "555", "1970-01-01") for r in rows],
                               "row_id long, first_name string, last_name string, phone_number string, date_of_birth string")
    assert sorted(r.row_id for r in fuzzy_dedup(df).collect()) == [1, 3, 4]


def test_single_name_split(spark):
    from carelake.operators.clean import clean_patients_upload
    raw = spark.createDataFrame([(1, "asha rani devi", None, "9988776655"), (2, "Asha", None, "9988776656")],
                                "row_id long, first_name string, last_name string, phone_number string")
    rows = {r.row_id: r for r in clean_patients_upload(raw, "2025-01-01").collect()}
    assert (rows[1].first_name, rows[1].last_name) == ("Asha", "Rani Devi")
    assert (rows[2].first_name, rows[2].last_name) == ("Asha", "Unknown")


def test_short_phone_rejected(spark):
    from carelake.operators.validate import invalid_rows, validation_frame
    raw = spark.createDataFrame([(1, "A", "B", "12-3")], "row_id long, first_name string, last_name string, phone_number string")
    errs = invalid_rows(validation_frame(raw)).select(F.array_join("errors", "; ")).first()[0]
    assert errs == "Invalid or missing phone number (min 5 digits)"


def test_api_length_bounds(spark):
    from carelake.operators.validate import invalid_rows, validation_frame
    raw = spark.createDataFrame([(1, "A" * 51, "B", "9988776655", "ABCDEF")],
                                "row_id long, first_name string, last_name string, phone_number string, blood_group string")
    errs = invalid_rows(validation_frame(raw, length_bounds=True)).select(F.array_join("errors", "; ")).first()[0]
    assert errs == "first_name length must be between 1 and 50; blood_group length must be between 0 and 5"


def test_extract_formats(spark, tmp_path):
    import pytest
    from carelake.sources.extracts import extract_format, read_extract, read_optional
    assert extract_format("x/patients.CSV") == "csv"
    with pytest.raises(ValueError):
        extract_format("x/patients.xlsx")
    p = str(tmp_path / "p.csv")
    spark.createDataFrame([("09699836744", "11-03-2026")], "phone_number string, dob string") \
        .write.option("header", "true").csv(p)
    r = read_extract(spark, p).first()
    assert r.phone_number == "09699836744" and r.dob == "11-03-2026" and r.row_id is not None
    assert read_optional(spark, str(tmp_path / "missing"), ["visit_date"]).columns == ["row_id", "visit_date"]
    assert read_optional(spark, f"file://{p}", ["dob"], "csv").count() == 1


def test_truncate_and_json_records(spark):
    import datetime as dt
    from carelake.operators.clean import to_json_records, truncate_to_bounds
    df = spark.createDataFrame([("X" * 60, "AB+XYZ", dt.date(2001, 8, 1), None)],
                               "first_name string, blood_group string, d date, email string")
    t = truncate_to_bounds(df).first()
    assert len(t.first_name) == 50 and t.blood_group == "AB+XY"
    js = to_json_records(df.select("d", "email")).first().json
    assert js == '{"d":"2001-08-01","email":null}'


def test_error_report_csv(spark, tmp_path):
    import glob
    from carelake.operators.validate import validation_frame, invalid_rows, write_error_report
    from carelake.sources.numbering import with_row_index
    raw = spark.createDataFrame([(0, 'O"Neil', "B", "12")], "row_id long, first_name string, last_name string, phone_number string")
    inv = invalid_rows(with_row_index(validation_frame(raw), "row_id", "row_number", start=2))
    out = str(tmp_path / "report")
    write_error_report(inv, out)
    text = open(glob.glob(out + "/*.csv")[0]).read().splitlines()
    assert text[0] == '"Row #","First Name","Last Name","Phone","Email","DOB","Errors"'
    assert text[1] == '"2","O""Neil","B","12","","","Invalid or missing phone number (min 5 digits)"'


def test_write_quality_report(spark, sf, tmp_path):
    from carelake.operators.profile import write_quality_report
    from carelake.sources.fixtures import fixture
    out = write_quality_report(fixture(spark, sf, "patients_raw"), str(tmp_path / "report"))
    assert set(out) == {"missing", "distinct", "issues"}
    assert spark.read.json(out["missing"]).count() == 10
    issues = spark.read.json(out["issues"]).first()
    assert issues.row_count == fixture(spark, sf, "patients_raw").count()


def test_dates_of_all_shapes(spark):
    from carelake.functions.expr import parse_date
    want = {"5 Mar 2026": "2026-03-05", "10-Mar-2026": "2026-03-10", "2026-03-10T09:00:00": "2026-03-10",
            "2026-03-10 09:00": "2026-03-10", "2026-03-10 00:00:00.0": "2026-03-10", "03/05/26": "2026-05-03",
            "29 february 2024": "2024-02-29", "31-02-2026": None, "5 Mart 2026": None, "": None}
    df = spark.createDataFrame([(v,) for v in want], "v string")
    assert {r.v: r.d and str(r.d) for r in df.select("v", parse_date("v").alias("d")).collect()} == want


def test_merged_headers_and_nan(spark):
    from carelake.operators.clean import to_json_records
    from carelake.operators.headers import normalize_headers, require_columns, unknown_columns
    df = spark.createDataFrame([("", "5551112222", "x")], "Mobile string, `Phone Number` string, `Other_Thing` string")
    out = normalize_headers(df)
    assert out.columns == ["phone_number", "other_thing"] and out.first().phone_number == "5551112222"
    assert unknown_columns(out) == ["other_thing"]
    import pytest
    with pytest.raises(ValueError, match="first_name"):
        require_columns(out, ["first_name"])
    assert to_json_records(spark.createDataFrame([(float("nan"), 1.5)], "a double, b double")).first().json == '{"a":null,"b":1.5}'


def test_row_ids_are_required_and_follow_files(spark, tmp_path):
    import pytest
    from carelake.operators.dedup import dedup_email
    from carelake.sources.extracts import read_extract
    rows = spark.createDataFrame([(None, None), (None, None)], "row_id long, email string")
    with pytest.raises(Exception, match="row_id must not be null"):
        dedup_email(rows).collect()
    for name, n in (("c", 1), ("a", 5), ("b", 3)):  # by name, not by size
        (tmp_path / f"{name}.csv").write_text("v\n" + "".join(f"{name}{i}\n" for i in range(n)))
    got = [r.v for r in read_extract(spark, str(tmp_path), "csv").orderBy("row_id").collect()]
    assert got == ["a0", "a1", "a2", "a3", "a4", "b0", "b1", "b2", "c0"]
