"""Registered queries: loading with key checks, visit resolution, audit rows, import summary."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from carelake import schema as S
from carelake.operators import clean as C
from carelake.operators import dedup as D
from carelake.operators import file_run as FR
from carelake.operators import load as L
from carelake.plans import sqlfrag as Q
from carelake.plans.cleaning_queries import _CLI_CTE, _UPLOAD_CTE, _keep_first, _len_checks_sql
from carelake.plans.registry import register, sql
from carelake.session import cut_lineage
from carelake.sources.fixtures import FIXTURE_AS_OF as AS_OF, fixture

CHANGED_AT = _dt.datetime(2001, 8, 1, 0, 0, 0)
_CANON = ", ".join(S.CANONICAL_COLUMNS)

_INSERT_CTE = _UPLOAD_CTE + f""",
d1 AS {_keep_first('upf', 'phone_number')},
d2 AS {_keep_first('d1', 'email')},
ins AS (SELECT * FROM d2
        WHERE (phone_number IS NULL OR phone_number NOT IN (SELECT phone_number FROM patients WHERE phone_number IS NOT NULL))
          AND (email IS NULL OR email NOT IN (SELECT email FROM patients WHERE email IS NOT NULL))),
insid AS (SELECT row_id, (SELECT max(patient_id) FROM patients) + row_number() OVER (ORDER BY row_id) AS patient_id,
                 {_CANON} FROM ins)
"""


def _batch(spark, sf):
    return D.dedup_chain(C.clean_patients_upload(fixture(spark, sf, "patients_raw"), AS_OF))


def _inserted(spark, sf):
    return L.insert_ignore(_batch(spark, sf), fixture(spark, sf, "patients"))


@register("insert_ignore", sql(("patients_raw", "patients"), f"SELECT row_id, patient_id, {_CANON} FROM insid",
                               _INSERT_CTE), "K-01,J-06")
def insert_ignore(spark, sf):
    return _inserted(spark, sf).select("row_id", "patient_id", *S.CANONICAL_COLUMNS)


def _walk_sql(seed_phones: str, seed_emails: str, source: str = "upf") -> str:
    """Row-by-row INSERT IGNORE as a recursive walk over the batch in row order,
    carrying the keys taken so far (oracle only; quadratic, fine at test scale)."""
    return f"""
ord AS MATERIALIZED (SELECT row_number() OVER (ORDER BY row_id) AS i, * FROM {source}),
walk(i, phones, emails, ok) AS (
  SELECT CAST(0 AS BIGINT), {seed_phones}, {seed_emails}, CAST([] AS BIGINT[])
  UNION ALL
  SELECT o.i,
         CASE WHEN c.clash OR o.phone_number IS NULL THEN w.phones ELSE list_append(w.phones, o.phone_number) END,
         CASE WHEN c.clash OR o.email IS NULL THEN w.emails ELSE list_append(w.emails, o.email) END,
         CASE WHEN c.clash THEN w.ok ELSE list_append(w.ok, o.row_id) END
  FROM walk w JOIN ord o ON o.i = w.i + 1,
       LATERAL (SELECT coalesce(list_contains(w.phones, o.phone_number), false)
                    OR coalesce(list_contains(w.emails, o.email), false) AS clash) c),
accepted AS (SELECT unnest(ok) AS row_id FROM (SELECT ok FROM walk ORDER BY i DESC LIMIT 1) last)
"""


_EXACT_CTE = _UPLOAD_CTE + "," + _walk_sql("CAST([] AS VARCHAR[])", "CAST([] AS VARCHAR[])")
_REG_CTE = _UPLOAD_CTE + f""",
rb AS (SELECT *, concat_ws('; ', {_len_checks_sql()}) AS broken FROM upf),
rg AS (SELECT * FROM rb WHERE broken = ''),""" + _walk_sql(
    "(SELECT coalesce(list(phone_number) FILTER (WHERE phone_number IS NOT NULL), CAST([] AS VARCHAR[])) FROM patients)",
    "(SELECT coalesce(list(email) FILTER (WHERE email IS NOT NULL), CAST([] AS VARCHAR[])) FROM patients)", "rg")


def _recursive(text: str) -> str:
    return "WITH RECURSIVE " + text[len("WITH "):]


@register("insert_ignore_exact", _recursive(sql(("patients_raw",), f"""
SELECT u.row_id, row_number() OVER (ORDER BY u.row_id) AS patient_id, {", ".join("u." + c for c in S.CANONICAL_COLUMNS)}
FROM upf u JOIN accepted a ON a.row_id = u.row_id""", _EXACT_CTE)), "K-01 exact")
def insert_ignore_exact(spark, sf):
    """Row-by-row INSERT IGNORE of the whole (not pre-de-duplicated) batch into an empty table."""
    batch = C.clean_patients_upload(fixture(spark, sf, "patients_raw"), AS_OF)
    empty = spark.createDataFrame([], S.PATIENT_SCHEMA)
    return L.insert_ignore(batch, empty, exact=True).select("row_id", "patient_id", *S.CANONICAL_COLUMNS)


@register("registration_conflicts", _recursive(sql(("patients_raw", "patients"), f"""
SELECT u.row_id, u.phone_number, u.email, coalesce(nullif(u.broken, ''), '{S.MSG_DUPLICATE_VALUE}') AS reason
FROM rb u WHERE u.row_id NOT IN (SELECT row_id FROM accepted)""", _REG_CTE)), "K-03,V-08")
def registration_conflicts(spark, sf):
    """Registrations of the raw batch against the stored registry; clashes with a reason."""
    batch = C.clean_patients_upload(fixture(spark, sf, "patients_raw"), AS_OF)
    _, rejected = L.register_patients(batch, fixture(spark, sf, "patients"), AS_OF)
    return rejected.select("row_id", "phone_number", "email", "reason")


@register("audit_rows", sql(("patients_raw", "patients", "audit_logs"), """
SELECT (SELECT max(audit_id) FROM audit_logs) + row_number() OVER (ORDER BY row_id) AS audit_id,
       'patient' AS entity_type, patient_id AS entity_id, 'create' AS action, 'system' AS changed_by,
       TIMESTAMP '2001-08-01 00:00:00' AS changed_at,
       json_object('first_name', first_name, 'last_name', last_name, 'phone_number', phone_number)::VARCHAR AS details
FROM insid""", _INSERT_CTE), "K-05,X-08")
def audit_rows(spark, sf):
    return L.audit_rows(_inserted(spark, sf), fixture(spark, sf, "audit_logs"), "patient", "patient_id",
                        ["first_name", "last_name", "phone_number"], changed_at=CHANGED_AT)


@register("import_summary", sql(("patients_raw", "patients"), """
SELECT CAST((SELECT count(*) FROM patients_raw) AS BIGINT) AS records_found,
       CAST((SELECT count(*) FROM d2) AS BIGINT) AS records_after_cleaning,
       CAST((SELECT count(*) FROM upf) - (SELECT count(*) FROM insid) AS BIGINT) AS duplicates_removed,
       CAST((SELECT count(*) FROM patients_raw) - (SELECT count(*) FROM upf) AS BIGINT) AS invalid_rows_skipped,
       CAST((SELECT count(*) FROM insid) AS BIGINT) AS records_inserted""", _INSERT_CTE), "K-07,D-04")
def import_summary(spark, sf):
    return L.import_summary(L.import_stages(
        fixture(spark, sf, "patients_raw"), L.long_keys(fixture(spark, sf, "patients"), L.PATIENT_KEYS), AS_OF))


# --- CLI load: patients bring their ids, visits refer to them ------------------------------

_CLI_LOAD_CTE = _CLI_CTE + """,
st AS (SELECT * FROM patients WHERE patient_id % 3 = 0),
co AS MATERIALIZED (SELECT row_number() OVER (ORDER BY row_id) AS i, * FROM cli WHERE phone_number IS NOT NULL AND first_name IS NOT NULL),
cw(i, ids, phones, emails, ok) AS (
  SELECT CAST(0 AS BIGINT), (SELECT list(patient_id) FROM st), (SELECT list(phone_number) FROM st),
         (SELECT list(email) FILTER (WHERE email IS NOT NULL) FROM st), CAST([] AS BIGINT[])
  UNION ALL
  SELECT o.i, CASE WHEN c.clash OR o.patient_id IS NULL THEN w.ids ELSE list_append(w.ids, o.patient_id) END,
         CASE WHEN c.clash THEN w.phones ELSE list_append(w.phones, o.phone_number) END,
         CASE WHEN c.clash OR o.email IS NULL THEN w.emails ELSE list_append(w.emails, o.email) END,
         CASE WHEN c.clash THEN w.ok ELSE list_append(w.ok, o.row_id) END
  FROM cw w JOIN co o ON o.i = w.i + 1,
       LATERAL (SELECT coalesce(list_contains(w.ids, o.patient_id), false) OR coalesce(list_contains(w.phones, o.phone_number), false)
                    OR coalesce(list_contains(w.emails, o.email), false) AS clash) c),
ca AS (SELECT co.* FROM co WHERE row_id IN (SELECT unnest(ok) FROM (SELECT ok FROM cw ORDER BY i DESC LIMIT 1) last)),
top AS (SELECT max(patient_id) AS m FROM (SELECT patient_id FROM st UNION ALL SELECT patient_id FROM ca)),
cl AS (SELECT row_id, patient_id, phone_number, email, first_name FROM ca WHERE patient_id IS NOT NULL
       UNION ALL SELECT row_id, (SELECT m FROM top) + row_number() OVER (ORDER BY row_id), phone_number, email, first_name
       FROM ca WHERE patient_id IS NULL)
"""


def _loaded_cli(spark, sf):
    stored = fixture(spark, sf, "patients").where("patient_id % 3 = 0")
    batch = C.clean_patients_cli(fixture(spark, sf, "patients_raw"), AS_OF).where(
        "phone_number IS NOT NULL AND first_name IS NOT NULL")
    return stored, L.insert_ignore(batch, stored, L.CLI_KEYS, exact=True)


@register("load_patients_cli", _recursive(sql(("patients_raw", "patients"), """
SELECT row_id, patient_id, phone_number, email, first_name FROM cl""", _CLI_LOAD_CTE)), "K-01,J-06")
def load_patients_cli(spark, sf):
    """A sheet whose rows bring their ids, some missing and some taken, against a third of
    the stored registry."""
    return _loaded_cli(spark, sf)[1].select("row_id", "patient_id", "phone_number", "email", "first_name")


# --- visits ----------------------------------------------------------------------------

_VISIT_CTE = f"""
vc AS (SELECT row_id, TRY_CAST({Q.strip('patient_id')} AS BIGINT) AS patient_id,
              {Q.digits('phone_number')} AS phone_number, lower({Q.clean('email')}) AS email,
              {Q.title(Q.clean('doctor_name'))} AS doctor_name, {Q.clean('symptoms')} AS symptoms,
              CAST(NULL AS VARCHAR) AS medications, CAST(NULL AS DATE) AS follow_up_date,
              {Q.parse_date('visit_date')} AS visit_date
       FROM visits_raw WHERE {Q.parse_date('visit_date')} IS NOT NULL),
rv AS (SELECT vc.row_id, coalesce(vc.patient_id, bp.patient_id, be.patient_id) AS patient_id,
              CASE WHEN vc.patient_id IS NOT NULL THEN 'id' WHEN bp.patient_id IS NOT NULL THEN 'phone'
                   WHEN be.patient_id IS NOT NULL THEN 'email' END AS resolved_by,
              vc.doctor_name, vc.symptoms, vc.medications, vc.follow_up_date, vc.visit_date
       FROM vc LEFT JOIN patients bp ON vc.patient_id IS NULL AND bp.phone_number = vc.phone_number
               LEFT JOIN patients be ON vc.patient_id IS NULL AND bp.patient_id IS NULL AND be.email = vc.email)
"""


def _clean_visits(spark, sf):
    return C.clean_visits(fixture(spark, sf, "visits_raw"))


def _resolved(spark, sf):
    return L.resolve_visit_patients(_clean_visits(spark, sf), fixture(spark, sf, "patients"))


@register("clean_visits", sql(("visits_raw",), """
SELECT row_id, patient_id, phone_number, email, doctor_name, symptoms, medications, follow_up_date, visit_date
FROM vc""", _VISIT_CTE.split(",\nrv AS")[0]), "C-14,C-15,C-19")
def clean_visits(spark, sf):
    return _clean_visits(spark, sf).select("row_id", "patient_id", "phone_number", "email", "doctor_name",
                                           "symptoms", "medications", "follow_up_date", "visit_date")


@register("resolve_visits", sql(("visits_raw", "patients"), """
SELECT row_id, patient_id, resolved_by, visit_date FROM rv""", _VISIT_CTE), "J-02,J-03,O-04")
def resolve_visits(spark, sf):
    return _resolved(spark, sf).select("row_id", "patient_id", "resolved_by", "visit_date")


@register("orphan_visits", sql(("visits_raw", "patients"), """
SELECT row_id, patient_id, CASE WHEN patient_id IS NULL THEN 'Patient could not be resolved'
                                WHEN patient_id NOT IN (SELECT patient_id FROM patients) THEN 'Patient not found'
                                ELSE 'Missing doctor name' END AS reason
FROM rv WHERE patient_id IS NULL OR patient_id NOT IN (SELECT patient_id FROM patients) OR doctor_name IS NULL""", _VISIT_CTE), "J-04,T10")
def orphan_visits(spark, sf):
    _, bad = L.judge_visits(_clean_visits(spark, sf), fixture(spark, sf, "patients"))
    return bad.select("row_id", "patient_id", "reason")


@register("load_visits", sql(("visits_raw", "patients", "visits"), f"""
SELECT row_id, (SELECT max(visit_id) FROM visits) + row_number() OVER (ORDER BY row_id) AS visit_id,
       patient_id, doctor_name, symptoms, medications, follow_up_date, visit_date
FROM rv WHERE patient_id IN (SELECT patient_id FROM patients) AND doctor_name IS NOT NULL""", _VISIT_CTE), "K-02,K-04,J-04")
def load_visits(spark, sf):
    ok, _ = L.judge_visits(_clean_visits(spark, sf), fixture(spark, sf, "patients"))
    return L.append_visits(ok, fixture(spark, sf, "visits"))


@register("visit_load_summary", sql(("visits_raw", "patients"), """
SELECT CAST((SELECT count(*) FROM visits_raw) AS BIGINT) AS records_found,
       CAST((SELECT count(*) FROM visits_raw) - (SELECT count(*) FROM vc) AS BIGINT) AS dropped_no_date,
       CAST((SELECT count(*) FROM rv WHERE resolved_by = 'id') AS BIGINT) AS resolved_by_id,
       CAST((SELECT count(*) FROM rv WHERE resolved_by = 'phone') AS BIGINT) AS resolved_by_phone,
       CAST((SELECT count(*) FROM rv WHERE resolved_by = 'email') AS BIGINT) AS resolved_by_email,
       CAST((SELECT count(*) FROM rv WHERE patient_id IS NULL OR patient_id NOT IN (SELECT patient_id FROM patients) OR doctor_name IS NULL) AS BIGINT) AS rejected,
       CAST((SELECT count(*) FROM rv WHERE patient_id IN (SELECT patient_id FROM patients) AND doctor_name IS NOT NULL) AS BIGINT) AS records_loaded""",
    _VISIT_CTE), "C-15,J-02..J-04,K-02")
def visit_load_summary(spark, sf):
    return L.visit_load_summary(fixture(spark, sf, "visits_raw"), fixture(spark, sf, "patients"))


@register("post_load_counts", sql(("patients", "visits"), """
SELECT CAST((SELECT count(*) FROM patients) AS BIGINT) AS patients,
       CAST((SELECT count(*) FROM visits) AS BIGINT) AS visits"""), "P-08")
def post_load_counts(spark, sf):
    return L.post_load_counts(fixture(spark, sf, "patients"), fixture(spark, sf, "visits"))


@register("load_visits_cli", _recursive(sql(("visits_raw", "patients_raw", "patients"), """,
pp AS (SELECT patient_id, phone_number, email FROM st UNION ALL SELECT patient_id, phone_number, email FROM cl),
bph AS (SELECT phone_number, min(patient_id) AS pid FROM pp GROUP BY 1), bem AS (SELECT email, min(patient_id) AS pid FROM pp WHERE email IS NOT NULL GROUP BY 1),
rs AS (SELECT vc.row_id, coalesce(vc.patient_id, bph.pid, bem.pid) AS patient_id, vc.doctor_name, vc.visit_date
       FROM vc LEFT JOIN bph ON vc.patient_id IS NULL AND bph.phone_number = vc.phone_number
               LEFT JOIN bem ON vc.patient_id IS NULL AND bem.email = vc.email)
SELECT row_id, row_number() OVER (ORDER BY row_id) AS visit_id, patient_id, doctor_name, visit_date
FROM rs WHERE patient_id IN (SELECT patient_id FROM pp) AND doctor_name IS NOT NULL""".lstrip(",\n"),
    _CLI_LOAD_CTE + "," + _VISIT_CTE.split(",\nrv AS")[0]).replace("\npp AS", ",\npp AS", 1)), "K-01,K-02,J-02..J-04")
def load_visits_cli(spark, sf):
    """The visits of that sheet reach the patients whose ids it gave."""
    stored, loaded = _loaded_cli(spark, sf)
    known = ["patient_id", "phone_number", "email"]
    patients = cut_lineage(stored.select(*known).unionByName(loaded.select(*known)))
    ok, _ = L.judge_visits(_clean_visits(spark, sf), patients)
    none = spark.createDataFrame([], S.VISIT_SCHEMA)
    return L.append_visits(ok, none).select("row_id", "visit_id", "patient_id", "doctor_name", "visit_date")


# --- a whole file ------------------------------------------------------------------------

_FILE_CTE = (_CLI_LOAD_CTE.replace(
    "co AS MATERIALIZED (SELECT row_number() OVER (ORDER BY row_id) AS i, * FROM cli WHERE phone_number IS NOT NULL AND first_name IS NOT NULL)",
    f"""c0 AS (SELECT * FROM cli WHERE phone_number IS NOT NULL AND first_name IS NOT NULL),
c1 AS {_keep_first('c0', 'phone_number')},
c2 AS {_keep_first('c1', 'email')},
co AS MATERIALIZED (SELECT row_number() OVER (ORDER BY row_id) AS i, * FROM c2)""")
    + "," + _VISIT_CTE.split(",\nrv AS")[0] + """,
sv AS (SELECT * FROM visits WHERE visit_id % 2 = 0),
pp AS (SELECT patient_id, phone_number, email FROM st UNION ALL SELECT patient_id, phone_number, email FROM cl),
bph AS (SELECT phone_number, min(patient_id) AS pid FROM pp GROUP BY 1),
bem AS (SELECT email, min(patient_id) AS pid FROM pp WHERE email IS NOT NULL GROUP BY 1),
rs AS (SELECT vc.row_id, coalesce(vc.patient_id, bph.pid, bem.pid) AS patient_id, vc.doctor_name, vc.symptoms, vc.visit_date
       FROM vc LEFT JOIN bph ON vc.patient_id IS NULL AND bph.phone_number = vc.phone_number
               LEFT JOIN bem ON vc.patient_id IS NULL AND bem.email = vc.email),
vl AS (SELECT row_id, (SELECT max(visit_id) FROM sv) + row_number() OVER (ORDER BY row_id) AS visit_id, patient_id, doctor_name, symptoms, visit_date
       FROM rs WHERE patient_id IN (SELECT patient_id FROM pp) AND doctor_name IS NOT NULL)
""")
_FILE_VIEWS = ("patients_raw", "patients", "visits_raw", "visits")


def _file_run(spark, sf):
    """Both raw sheets against a third of the stored patients and half of the stored visits."""
    return FR.run_file(fixture(spark, sf, "patients_raw"), fixture(spark, sf, "visits_raw"),
                       fixture(spark, sf, "patients").where("patient_id % 3 = 0"),
                       fixture(spark, sf, "visits").where("visit_id % 2 = 0"), AS_OF)


@register("run_file_counts", _recursive(sql(_FILE_VIEWS, """
SELECT (SELECT count(*) FROM patients_raw) AS patients_found,
       (SELECT count(*) FROM patients_raw) - (SELECT count(*) FROM c0) AS patients_rejected,
       (SELECT count(*) FROM c2) AS patients_unique, (SELECT count(*) FROM cl) AS patients_inserted,
       (SELECT count(*) FROM visits_raw) AS visits_found,
       (SELECT count(*) FROM visits_raw) - (SELECT count(*) FROM vl) AS visits_rejected,
       (SELECT count(*) FROM vl) AS visits_inserted,
       (SELECT count(*) FROM pp) AS patients_stored, (SELECT count(*) FROM sv) + (SELECT count(*) FROM vl) AS visits_stored""",
    _FILE_CTE)), "K-01,K-02,P-08")
def run_file_counts(spark, sf):
    """What a whole file's run did, with the stored rows after it."""
    return _file_run(spark, sf).counts


@register("run_file_patients", _recursive(sql(_FILE_VIEWS, """
SELECT row_id, patient_id, phone_number, email, first_name FROM cl""", _FILE_CTE)), "K-01,D-01,D-02")
def run_file_patients(spark, sf):
    return _file_run(spark, sf).patients.select("row_id", "patient_id", "phone_number", "email", "first_name")


@register("run_file_visits", _recursive(sql(_FILE_VIEWS, """
SELECT row_id, visit_id, patient_id, doctor_name, symptoms, visit_date FROM vl""", _FILE_CTE)), "K-02,J-02..J-04")
def run_file_visits(spark, sf):
    return _file_run(spark, sf).visits.select("row_id", "visit_id", "patient_id", "doctor_name", "symptoms", "visit_date")


@register("run_file_rejects", _recursive(sql(_FILE_VIEWS, f"""
SELECT 'patient' AS sheet, row_id, concat_ws('; ', CASE WHEN phone_number IS NULL THEN '{S.MSG_MISSING_PHONE}' END,
       CASE WHEN first_name IS NULL THEN '{S.MSG_MISSING_FIRST}' END) AS reason
FROM cli WHERE phone_number IS NULL OR first_name IS NULL
UNION ALL
SELECT 'visit', r.row_id, CASE WHEN vc.row_id IS NULL THEN '{S.MSG_BAD_VISIT_DATE}' WHEN rs.patient_id IS NULL THEN '{S.MSG_UNRESOLVED_PATIENT}'
       WHEN rs.patient_id NOT IN (SELECT patient_id FROM pp) THEN '{S.MSG_UNKNOWN_PATIENT}' ELSE '{S.MSG_MISSING_DOCTOR}' END
FROM visits_raw r LEFT JOIN vc ON vc.row_id = r.row_id LEFT JOIN rs ON rs.row_id = r.row_id
WHERE r.row_id NOT IN (SELECT row_id FROM vl)""", _FILE_CTE)), "K-06,J-04,C-15")
def run_file_rejects(spark, sf):
    """Every row of both sheets that a whole file's run refuses, with its reasons."""
    done = _file_run(spark, sf)
    return done.rejected_patients.select(F.lit("patient").alias("sheet"), "row_id", "reason").unionByName(
        done.rejected_visits.select(F.lit("visit").alias("sheet"), "row_id", "reason"))
