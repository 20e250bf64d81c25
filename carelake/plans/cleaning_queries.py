"""Registered queries: cleaning, validation, profiling, de-duplication (C-*, V-*, P-*, D-01/02)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from carelake import schema as S
from carelake.operators import clean as C
from carelake.operators import dedup as D
from carelake.operators import profile as P
from carelake.operators import validate as V
from carelake.plans import sqlfrag as Q
from carelake.plans.registry import register, sql
from carelake.session import ensure_checkpoint_dir
from carelake.sources.fixtures import FIXTURE_AS_OF as AS_OF, FIXTURE_AS_OF_SQL as AS_OF_SQL, fixture

RAW_COLUMNS = S.PATIENT_COLUMNS
OUT = ["row_id"] + S.CANONICAL_COLUMNS

# --- oracle CTEs -------------------------------------------------------------

_UPLOAD_CTE = f"""
up0 AS (SELECT row_id, {Q.first_word('first_name')} AS f, coalesce({Q.clean('last_name')}, {Q.rest_words('first_name')}) AS l,
               gender, date_of_birth, phone_number, email, address, blood_group, registration_date FROM patients_raw),
up AS (SELECT row_id, {Q.title('f')} AS first_name, {Q.title("coalesce(l, 'Unknown')")} AS last_name,
              {Q.gender('gender')} AS gender, {Q.parse_date('date_of_birth')} AS date_of_birth,
              {Q.digits('phone_number')} AS phone_number, lower({Q.clean('email')}) AS email,
              {Q.clean('address')} AS address, upper({Q.clean('blood_group')}) AS blood_group,
              coalesce({Q.parse_date('registration_date')}, {AS_OF_SQL}) AS registration_date FROM up0),
upf AS (SELECT * FROM up WHERE first_name IS NOT NULL AND last_name IS NOT NULL
        AND phone_number IS NOT NULL AND length(phone_number) >= 5)
"""

_CLI_CTE = f"""
cli AS (SELECT row_id, TRY_CAST({Q.strip('patient_id')} AS BIGINT) AS patient_id,
               {Q.title(Q.clean('first_name'))} AS first_name,
               {Q.title("coalesce(" + Q.clean('last_name') + ", 'Unknown')")} AS last_name,
               {Q.gender('gender')} AS gender, {Q.parse_date('date_of_birth')} AS date_of_birth,
               {Q.digits('phone_number')} AS phone_number, lower({Q.clean('email')}) AS email,
               {Q.null_token('address')} AS address, upper({Q.clean('blood_group')}) AS blood_group,
               coalesce({Q.parse_date('registration_date')}, {AS_OF_SQL}) AS registration_date FROM patients_raw)
"""


def _keep_first(src: str, key: str) -> str:
    """Rows of ``src`` that are first (min row_id) for their non-blank key, plus blank-key rows."""
    return (f"(SELECT * FROM {src} WHERE {key} IS NULL OR trim({key}) = '' OR row_id IN "
            f"(SELECT min(row_id) FROM {src} WHERE {key} IS NOT NULL AND trim({key}) <> '' GROUP BY {key}))")


_COLS = ", ".join(OUT)
_CLI_COLS = "row_id, patient_id, " + ", ".join(S.CANONICAL_COLUMNS)


def _upload(spark, sf):
    return C.clean_patients_upload(fixture(spark, sf, "patients_raw"), AS_OF)


@register("clean_patients_upload", sql(("patients_raw",), f"SELECT {_COLS} FROM upf", _UPLOAD_CTE),
          "C-01..C-13,C-17,C-18,H-01,H-02,H-05")
def clean_patients_upload(spark, sf):
    return _upload(spark, sf).select(*OUT)


@register("dedup_phone", sql(("patients_raw",), f"SELECT {_COLS} FROM {_keep_first('upf', 'phone_number')} x",
                             _UPLOAD_CTE), "D-01")
def dedup_phone(spark, sf):
    return D.dedup_phone(_upload(spark, sf)).select(*OUT)


@register("dedup_email", sql(("patients_raw",), f"SELECT {_COLS} FROM {_keep_first('upf', 'email')} x",
                             _UPLOAD_CTE), "D-02")
def dedup_email(spark, sf):
    return D.dedup_email(_upload(spark, sf)).select(*OUT)


@register("dedup_chain", sql(("patients_raw",), f"SELECT {_COLS} FROM {_keep_first('d1', 'email')} x",
                             _UPLOAD_CTE + f", d1 AS {_keep_first('upf', 'phone_number')}"), "D-01,D-02,U-01")
def dedup_chain(spark, sf):
    return D.dedup_chain(_upload(spark, sf)).select(*OUT)


@register("clean_patients_cli", sql(("patients_raw",),
                                    f"SELECT {_CLI_COLS} FROM {_keep_first('c1', 'email')} x",
                                    _CLI_CTE + ", c0 AS (SELECT * FROM cli WHERE phone_number IS NOT NULL), "
                                    f"c1 AS {_keep_first('c0', 'phone_number')}"), "C-16,T11,D-01,D-02")
def clean_patients_cli(spark, sf):
    cleaned = C.clean_patients_cli(fixture(spark, sf, "patients_raw"), AS_OF)
    return D.dedup_chain(cleaned.where(F.col("phone_number").isNotNull())).select(
        "row_id", "patient_id", *S.CANONICAL_COLUMNS)


@register("cli_rejects", sql(("patients_raw",), "SELECT row_id, 'Missing phone number' AS reason "
                             "FROM cli WHERE phone_number IS NULL", _CLI_CTE), "T11")
def cli_rejects(spark, sf):
    cleaned = C.clean_patients_cli(fixture(spark, sf, "patients_raw"), AS_OF)
    return C.cli_rejects(cleaned).select("row_id", "reason")


@register("dup_phone_check", sql(("patients_raw",), """
SELECT phone_number, CAST(count(*) AS BIGINT) AS occurrences FROM cli
WHERE phone_number IS NOT NULL GROUP BY phone_number HAVING count(*) > 1""", _CLI_CTE), "P-09")
def dup_phone_check(spark, sf):
    return D.duplicate_keys(C.clean_patients_cli(fixture(spark, sf, "patients_raw"), AS_OF), "phone_number")


@register("dup_email_check", sql(("patients_raw",), """
SELECT email, CAST(count(*) AS BIGINT) AS occurrences FROM cli
WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1""", _CLI_CTE), "P-09")
def dup_email_check(spark, sf):
    return D.duplicate_keys(C.clean_patients_cli(fixture(spark, sf, "patients_raw"), AS_OF), "email")


# --- validation ----------------------------------------------------------------

_VAL_CTE = f"""
vn AS (SELECT row_id, {Q.first_word('first_name')} AS first_name,
              coalesce(coalesce({Q.clean('last_name')}, {Q.rest_words('first_name')}), 'Unknown') AS last_name,
              {Q.digits('phone_number')} AS phone_number, lower({Q.clean('email')}) AS email,
              date_of_birth AS dob_raw, {Q.parse_date('date_of_birth')} AS date_of_birth FROM patients_raw),
vc AS (SELECT *, CASE WHEN phone_number IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY phone_number) END AS pn,
              CASE WHEN email IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY email) END AS en,
              row_number() OVER (ORDER BY row_id) + 1 AS row_number FROM vn),
ve AS (SELECT *, concat_ws('; ',
         CASE WHEN first_name IS NULL THEN '{S.MSG_MISSING_FIRST}' END,
         CASE WHEN phone_number IS NULL OR length(phone_number) < 5 THEN '{S.MSG_BAD_PHONE}'
              WHEN pn > 1 THEN '{S.MSG_DUP_PHONE}' END,
         CASE WHEN email IS NOT NULL AND en > 1 THEN '{S.MSG_DUP_EMAIL}' END,
         CASE WHEN email IS NOT NULL AND (NOT contains(email, '@') OR starts_with(email, '@') OR ends_with(email, '@'))
              THEN '{S.MSG_BAD_EMAIL}' END,
         CASE WHEN {Q.null_token('dob_raw')} IS NOT NULL AND date_of_birth IS NULL THEN '{S.MSG_BAD_DOB}' END
       ) AS errors FROM vc)
"""


def _invalid(spark, sf):
    raw = fixture(spark, sf, "patients_raw")
    return V.numbered(V.invalid_rows(V.validation_frame(raw)), raw)


@register("invalid_rows", sql(("patients_raw",), """
SELECT row_id, CAST(row_number AS BIGINT) AS row_number, first_name, last_name, phone_number, email,
       date_of_birth, errors FROM ve WHERE errors <> ''""", _VAL_CTE), "V-01..V-07,V-09")
def invalid_rows(spark, sf):
    return (_invalid(spark, sf)
            .select("row_id", "row_number", "first_name", "last_name", "phone_number", "email",
                    "date_of_birth", F.array_join("errors", "; ").alias("errors")))


@register("valid_rows", sql(("patients_raw",), """
SELECT row_id, first_name, last_name, phone_number, email, date_of_birth FROM ve WHERE errors = ''""",
                            _VAL_CTE), "V-09")
def valid_rows(spark, sf):
    return (V.valid_rows(V.validation_frame(fixture(spark, sf, "patients_raw")))
            .select("row_id", "first_name", "last_name", "phone_number", "email", "date_of_birth"))


@register("error_report", sql(("patients_raw",), """
SELECT CAST(row_number AS BIGINT) AS row_number, coalesce(first_name, '') AS first_name,
       coalesce(last_name, '') AS last_name, coalesce(phone_number, '') AS phone,
       coalesce(email, '') AS email, coalesce(CAST(date_of_birth AS VARCHAR), '') AS dob, errors
FROM ve WHERE errors <> ''""", _VAL_CTE), "K-06")
def error_report(spark, sf):
    return V.error_report(_invalid(spark, sf))


# --- profiling -------------------------------------------------------------------

_PROFILE_COLS = RAW_COLUMNS


@register("profile_missing", sql(("patients_raw",), "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS missing_count FROM patients_raw"
    for c in _PROFILE_COLS)), "P-01,P-02")
def profile_missing(spark, sf):
    return P.profile_missing(fixture(spark, sf, "patients_raw"))


@register("profile_distinct", sql(("patients_raw",), "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count FROM patients_raw"
    for c in _PROFILE_COLS)), "P-03")
def profile_distinct(spark, sf):
    return P.profile_distinct(fixture(spark, sf, "patients_raw"))


@register("profile_issues", sql(("patients_raw",), f"""
SELECT CAST(count(*) AS BIGINT) AS row_count, CAST({len(_PROFILE_COLS)} AS BIGINT) AS column_count,
       CAST(count(phone_number) - count(DISTINCT phone_number) AS BIGINT) AS duplicate_phone_raw,
       CAST(count({Q.digits('phone_number')}) - count(DISTINCT {Q.digits('phone_number')}) AS BIGINT) AS duplicate_phone_digits,
       CAST(count(nullif(lower({Q.strip('email')}), '')) - count(DISTINCT nullif(lower({Q.strip('email')}), '')) AS BIGINT) AS duplicate_email,
       CAST(count_if({Q.null_token('date_of_birth')} IS NULL) AS BIGINT) AS dob_missing,
       CAST(count_if({Q.null_token('date_of_birth')} IS NOT NULL AND {Q.parse_date('date_of_birth')} IS NULL) AS BIGINT) AS dob_unparseable,
       CAST(count_if(gender IS NOT NULL AND lower({Q.strip('gender')}) NOT IN ('male', 'female', 'other', 'm', 'f', 'o')) AS BIGINT) AS inconsistent_gender,
       '' AS unknown_columns
FROM patients_raw"""), "P-01,P-04..P-07,H-04")
def profile_issues(spark, sf):
    return P.profile_issues(fixture(spark, sf, "patients_raw"))


def _odd_sheet(spark, sf):
    """The raw sheet under other headers, without e-mail and with columns that no alias names."""
    raw = fixture(spark, sf, "patients_raw")
    return raw.withColumnsRenamed({"phone_number": "Mobile", "first_name": "First Name"}).drop("email").withColumns({
        "Ward Number": F.col("blood_group"), "remark": F.lit("seen")})


@register("sheet_columns", sql(("patients_raw",), "\nUNION ALL\n".join(
    [f"SELECT '{c}' AS column_name, 'expected' AS status, CAST(count({c}) AS BIGINT) AS given FROM patients_raw"
     for c in _PROFILE_COLS if c != "email"]
    + ["SELECT 'email', 'missing', CAST(0 AS BIGINT)",
       "SELECT 'ward_number', 'unknown', CAST(count(blood_group) AS BIGINT) FROM patients_raw",
       "SELECT 'remark', 'unknown', CAST(count(*) AS BIGINT) FROM patients_raw"])), "H-01,H-03,H-04")
def sheet_columns(spark, sf):
    """Which columns of a sheet are known, unknown or lacking, and how many values they hold."""
    return P.sheet_columns(_odd_sheet(spark, sf), required=(*S.REQUIRED_PATIENT_COLUMNS, "email"))


@register("quality_report", sql(("patients_raw",), "\nUNION ALL\n".join(
    [f"SELECT '{name}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS missing_count, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count FROM patients_raw"
     for c, name in [*[(c, c) for c in _PROFILE_COLS if c != "email"], ("blood_group", "ward_number")]]
    + ["SELECT 'remark', CAST(0 AS BIGINT), CAST(count(DISTINCT 1) AS BIGINT) FROM patients_raw"])), "K-09,P-02,P-03")
def quality_report(spark, sf):
    """The report tables, written to the shared folder and read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quality-report-{uuid.uuid4().hex}"
    P.write_quality_report(_odd_sheet(spark, sf), path)
    return P.read_quality_report(spark, path)


#: The similarity in SQL: longest common run, leftmost in the first text, then in the
#: second; then the same on both sides of it. Twice the matched letters over all letters.
_FUZZY_CTE = _UPLOAD_CTE + f""",
el AS (SELECT row_id, phone_number AS ph, date_of_birth AS dob, lower({Q.strip('first_name')}) AS f, lower({Q.strip('last_name')}) AS l
       FROM upf WHERE phone_number IS NOT NULL AND date_of_birth IS NOT NULL),
pr AS (SELECT y.row_id AS later, x.row_id AS kept, y.f AS yf, x.f AS xf, y.l AS yl, x.l AS xl
       FROM el x JOIN el y ON x.ph = y.ph AND x.dob = y.dob AND x.row_id < y.row_id),
st AS (SELECT DISTINCT yf AS a, xf AS b FROM pr UNION SELECT DISTINCT yl, xl FROM pr),
seg(a0, b0, a, b, k) AS (
  SELECT a, b, a, b, CAST(0 AS BIGINT) FROM st
  UNION ALL
  SELECT s.a0, s.b0, CASE side WHEN 1 THEN substr(s.a, 1, r.i - 1) ELSE substr(s.a, r.i + r.n) END,
         CASE side WHEN 1 THEN substr(s.b, 1, r.j - 1) ELSE substr(s.b, r.j + r.n) END, CASE side WHEN 1 THEN r.n ELSE 0 END
  FROM seg s, LATERAL (
         SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(n AS INTEGER) AS n
         FROM generate_series(1, length(s.a)) t1(i), generate_series(1, length(s.b)) t2(j), generate_series(1, least(length(s.a), length(s.b))) t3(n)
         WHERE i + n - 1 <= length(s.a) AND j + n - 1 <= length(s.b)
           AND substr(s.a, CAST(i AS INTEGER), CAST(n AS INTEGER)) = substr(s.b, CAST(j AS INTEGER), CAST(n AS INTEGER))
         ORDER BY n DESC, i, j LIMIT 1) r, (VALUES (1), (2)) v(side)
  WHERE length(s.a) > 0 AND length(s.b) > 0),
ra AS (SELECT a0, b0, 2.0 * sum(k) / (length(a0) + length(b0)) AS ratio FROM seg GROUP BY a0, b0),
eg AS (SELECT later, kept FROM pr JOIN ra rf ON rf.a0 = yf AND rf.b0 = xf JOIN ra rl ON rl.a0 = yl AND rl.b0 = xl
       WHERE rf.ratio >= {S.FUZZY_NAME_THRESHOLD} AND rl.ratio >= {S.FUZZY_NAME_THRESHOLD}),
lt AS MATERIALIZED (SELECT row_number() OVER (ORDER BY later) AS i, later, list(kept) AS kept FROM eg GROUP BY later),
gw(i, gone) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT lt.i, CASE WHEN len(list_filter(lt.kept, lambda x: NOT list_contains(w.gone, x))) > 0 THEN list_append(w.gone, lt.later) ELSE w.gone END
  FROM gw w JOIN lt ON lt.i = w.i + 1)
"""


@register("dedup_fuzzy", "WITH RECURSIVE " + sql(("patients_raw",), f"""
SELECT {_COLS} FROM upf WHERE row_id NOT IN (SELECT unnest(gone) FROM (SELECT gone FROM gw ORDER BY i DESC LIMIT 1) last)""",
                                                 _FUZZY_CTE)[len("WITH "):], "D-03,X-10")
def dedup_fuzzy(spark, sf):
    """Fuzzy rule before D-01 (run stand-alone; after an exact phone de-dup it can remove
    nothing)."""
    from carelake.operators.fuzzy import fuzzy_dedup
    return fuzzy_dedup(_upload(spark, sf)).select(*OUT)


# --- extracts read back from files (S-01, S-02, S-04) ----------------------------------

def _roundtrip(spark, sf, fmt: str):
    import os
    import uuid
    from carelake.session import ensure_checkpoint_dir
    from carelake.sources.extracts import read_extract
    path = os.path.join(ensure_checkpoint_dir(spark), f"extract-{uuid.uuid4().hex[:12]}.{fmt}")
    raw = fixture(spark, sf, "patients_raw")
    if fmt == "csv":  # aliased headers and a column with quotes and line breaks
        raw = raw.withColumnsRenamed({"phone_number": "Mobile", "first_name": "First Name", "date_of_birth": "DOB"}).select(
            F.lit('said "no",\nthen left').alias("Remark"), "*")
    w = raw.write.mode("overwrite")
    (w.option("header", "true").option("escape", '"').csv(path) if fmt == "csv" else w.json(path))
    return read_extract(spark, path)


@register("clean_from_csv", sql(("patients_raw",), f"SELECT {_COLS} FROM upf", _UPLOAD_CTE), "S-01,S-02,S-04,C-18")
def clean_from_csv(spark, sf):
    """The raw extract written as CSV, read back as text and cleaned: same rows as the table path."""
    return C.clean_patients_upload(_roundtrip(spark, sf, "csv"), AS_OF).select(*OUT)


@register("clean_from_json", sql(("patients_raw",), f"SELECT {_COLS} FROM upf", _UPLOAD_CTE), "S-02,S-04,C-18")
def clean_from_json(spark, sf):
    return C.clean_patients_upload(_roundtrip(spark, sf, "json"), AS_OF).select(*OUT)


# --- V-08: API length bounds ---------------------------------------------------------------

def _len_checks_sql():
    parts = []
    for field, (lo, hi) in S.FIELD_LENGTH_BOUNDS.items():
        if field == "doctor_name":
            continue
        parts.append(f"CASE WHEN {field} IS NOT NULL AND (length({field}) < {lo} OR length({field}) > {hi}) "
                     f"THEN '{field} length must be between {lo} and {hi}' END")
    return ",\n".join(parts)


_VAL_API_CTE = _VAL_CTE.replace(
    "date_of_birth AS dob_raw,", "date_of_birth AS dob_raw, gender, address, blood_group,").replace(
    "CASE WHEN {nt} IS NOT NULL AND date_of_birth IS NULL THEN '{msg}' END\n       ) AS errors".format(
        nt=Q.null_token('dob_raw'), msg=S.MSG_BAD_DOB),
    "CASE WHEN {nt} IS NOT NULL AND date_of_birth IS NULL THEN '{msg}' END,\n{lens}\n       ) AS errors".format(
        nt=Q.null_token('dob_raw'), msg=S.MSG_BAD_DOB, lens=_len_checks_sql()))


@register("invalid_rows_api", sql(("patients_raw",), """
SELECT row_id, first_name, last_name, phone_number, email, errors FROM ve WHERE errors <> ''""", _VAL_API_CTE),
    "V-08")
def invalid_rows_api(spark, sf):
    frame = V.validation_frame(fixture(spark, sf, "patients_raw"), length_bounds=True)
    return (V.invalid_rows(frame)
            .select("row_id", "first_name", "last_name", "phone_number", "email",
                    F.array_join("errors", "; ").alias("errors")))


# --- strict import (T3, V-02), JSON records (K-08), optional visits sheet (S-03) -------------

@register("strict_import", sql(("patients_raw",), f"""
SELECT {", ".join("u." + c for c in OUT)} FROM upf u JOIN ve ON ve.row_id = u.row_id JOIN patients_raw r ON r.row_id = u.row_id
WHERE ve.errors = '' AND coalesce({Q.clean('r.last_name')}, {Q.rest_words('r.first_name')}) IS NOT NULL""",
                               _UPLOAD_CTE + "," + _VAL_API_CTE), "V-02,V-08,V-09,T3")
def strict_import(spark, sf):
    """Only rows that pass every rule, length bounds and a given last name included."""
    raw = fixture(spark, sf, "patients_raw")
    good = V.valid_rows(V.validation_frame(raw, strict=True, length_bounds=True)).select("row_id")
    return C.clean_patients_upload(raw, AS_OF).join(good, "row_id", "left_semi").select(*OUT)


@register("json_records", sql(("patients_raw",), """
SELECT CAST(json_object('row_id', row_id, 'first_name', first_name, 'date_of_birth', CAST(date_of_birth AS VARCHAR),
  'email', email, 'ratio', CASE WHEN row_id % 7 <> 0 THEN (row_id % 100) * CAST(0.5 AS DOUBLE) END) AS VARCHAR) AS json
FROM upf""", _UPLOAD_CTE), "K-08")
def json_records(spark, sf):
    ratio = F.when(F.col("row_id") % 7 == 0, F.lit(float("nan"))).otherwise((F.col("row_id") % 100) * F.lit(0.5))
    return C.to_json_records(_upload(spark, sf).select("row_id", "first_name", "date_of_birth", "email", ratio.alias("ratio")))


@register("visits_absent", sql(("visits_raw",), "SELECT CAST(0 AS BIGINT) AS sheet_rows, count(*) AS other_rows FROM visits_raw"),
          "S-03")
def visits_absent(spark, sf):
    """A workbook without a visits sheet has no visits; with one, all of them."""
    import uuid
    from carelake.session import ensure_checkpoint_dir
    from carelake.sources.extracts import read_optional
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/visits-{uuid.uuid4().hex[:12]}"
    raw = fixture(spark, sf, "visits_raw")
    raw.write.option("header", "true").option("escape", '"').csv(f"{base}/there.csv")
    columns = [c for c in raw.columns if c != "row_id"]
    count = lambda name, out: read_optional(spark, f"{base}/{name}.csv", columns).agg(
        *[F.count(F.lit(1)).alias(c) if c == out else F.lit(0).cast("long").alias(c) for c in ("sheet_rows", "other_rows")])
    return count("absent", "sheet_rows").unionByName(count("there", "other_rows")).agg(
        F.sum("sheet_rows").alias("sheet_rows"), F.sum("other_rows").alias("other_rows"))
