"""Registered queries: per-patient triage, timeline, audit, diagnosis, search, report, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake import schema as S
from carelake.operators import patients as PT
from carelake.operators.search import patient_search as _search
from carelake.plans.registry import register, sql
from carelake.sources.fixtures import FIXTURE_AS_OF as AS_OF, FIXTURE_AS_OF_SQL as AS_OF_SQL, fixture

JSON_PATH = "$.k"  # the fixture audit payload keeps the patient id under "k"

_AGE_SQL = (f"CAST(year({AS_OF_SQL}) - year(date_of_birth) - CASE WHEN month({AS_OF_SQL}) * 100 + day({AS_OF_SQL}) "
            f"< month(date_of_birth) * 100 + day(date_of_birth) THEN 1 ELSE 0 END AS INTEGER)")
_KW_SQL = " OR ".join(f"contains(txt, '{k}')" for k in S.HIGH_RISK_KEYWORDS)
_AUDIT_KEY_SQL = ("CASE WHEN a.entity_type = 'patient' THEN CAST(a.entity_id AS VARCHAR) "
                  f"WHEN a.entity_type = 'visit' THEN json_extract_string(a.details, '{JSON_PATH}') END")
_LATEST_CTE = """
lv AS (SELECT patient_id, symptoms, medications FROM (
        SELECT patient_id, symptoms, medications, row_number() OVER (PARTITION BY patient_id ORDER BY
          (coalesce(symptoms, '') <> '' OR coalesce(medications, '') <> '') DESC, visit_date DESC, visit_id DESC) AS rn
        FROM visits) x WHERE rn = 1)
"""
_DIAG_SQL = ("CASE WHEN coalesce(lv.symptoms, '') <> '' THEN lv.symptoms "
             "WHEN coalesce(lv.medications, '') <> '' THEN 'Medications: ' || lv.medications "
             f"ELSE '{S.NO_DIAGNOSIS}' END")


def _pv(spark, sf):
    return fixture(spark, sf, "patients"), fixture(spark, sf, "visits")


@register("triage", sql(("patients", "visits"), f"""
SELECT patient_id, age, repeat_visits, score,
       CASE WHEN score >= 4 THEN 'red' WHEN score >= 2 THEN 'amber' ELSE 'green' END AS risk,
       concat_ws('; ', CASE WHEN age >= 60 THEN 'Age 60+' END,
                       CASE WHEN kw THEN 'Critical symptom keyword detected' END,
                       CASE WHEN repeat_visits >= 3 THEN 'Frequent repeat visits'
                            WHEN repeat_visits >= 2 THEN 'Multiple repeat visits' END) AS reasons
FROM (SELECT *, CAST((CASE WHEN age >= 60 THEN 2 ELSE 0 END) + (CASE WHEN kw THEN 3 ELSE 0 END)
                + (CASE WHEN repeat_visits >= 3 THEN 2 WHEN repeat_visits >= 2 THEN 1 ELSE 0 END) AS INTEGER) AS score
      FROM (SELECT p.patient_id, {_AGE_SQL} AS age, CAST(coalesce(a.n, 0) AS BIGINT) AS repeat_visits,
                   coalesce({_KW_SQL}, false) AS kw
            FROM patients p LEFT JOIN (
              SELECT patient_id, count(*) AS n,
                     lower(string_agg(coalesce(symptoms, ''), ' ' ORDER BY visit_date DESC, visit_id DESC)) AS txt
              FROM visits GROUP BY patient_id) a ON a.patient_id = p.patient_id) b) c"""), "A-12,A-13,J-08,X-09")
def triage(spark, sf):
    p, v = _pv(spark, sf)
    return PT.triage(p, v, AS_OF).withColumn("reasons", F.array_join("reasons", "; "))


@register("patient_age", sql(("patients",), f"SELECT patient_id, date_of_birth, {_AGE_SQL} AS age FROM patients"),
          "A-13")
def patient_age(spark, sf):
    return PT.patient_age(fixture(spark, sf, "patients"), AS_OF)


@register("audit_by_patient", sql(("patients", "audit_logs"), f"""
SELECT p.patient_id, a.audit_id, a.entity_type, a.entity_id, a.action, a.changed_by, a.changed_at, a.details
FROM audit_logs a JOIN patients p ON CAST(p.patient_id AS VARCHAR) = {_AUDIT_KEY_SQL}"""), "J-05,X-07")
def audit_by_patient(spark, sf):
    return PT.audit_by_patient(fixture(spark, sf, "patients"), fixture(spark, sf, "audit_logs"), JSON_PATH).select(
        "patient_id", "audit_id", "entity_type", "entity_id", "action", "changed_by", "changed_at", "details")


_TIMELINE_SQL = f"""
SELECT patient_id, 'registration' AS event_type, strftime(registration_date, '%Y-%m-%d') AS event_date,
       'Patient Registered' AS title,
       json_object('name', trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')),
                   'phone_number', phone_number, 'blood_group', blood_group)::VARCHAR AS details,
       0 AS source_order, CAST(NULL AS BIGINT) AS seq_date, CAST(NULL AS BIGINT) AS seq_id
FROM patients
UNION ALL
SELECT v.patient_id, 'visit', strftime(v.visit_date, '%Y-%m-%d'),
       'Visit with Dr. ' || coalesce(nullif(v.doctor_name, ''), 'Unknown'),
       json_object('symptoms', v.symptoms, 'medications', v.medications,
                   'follow_up_date', strftime(v.follow_up_date, '%Y-%m-%d'))::VARCHAR,
       1, -CAST(v.visit_date - DATE '1970-01-01' AS BIGINT), -v.visit_id
FROM visits v WHERE v.patient_id IN (SELECT patient_id FROM patients)
UNION ALL
SELECT p.patient_id, 'audit', strftime(date_trunc('second', a.changed_at), '%Y-%m-%d %H:%M:%S'),
       a.entity_type || ': ' || a.action,
       json_object('changed_by', a.changed_by, 'payload', a.details)::VARCHAR,
       2, -epoch_us(date_trunc('second', a.changed_at)), -a.audit_id
FROM audit_logs a JOIN patients p ON CAST(p.patient_id AS VARCHAR) = {_AUDIT_KEY_SQL}"""


@register("patient_timeline", sql(("patients", "visits", "audit_logs"), _TIMELINE_SQL), "A-14,A-15,U-02,O-02,X-12,X-13")
def patient_timeline(spark, sf):
    p, v = _pv(spark, sf)
    t = PT.timeline(p, v, fixture(spark, sf, "audit_logs"), JSON_PATH)
    return t.select("patient_id", "event_type", "event_date", "title", F.to_json("details").alias("details"),
                    "source_order", "seq_date", "seq_id")


@register("latest_diagnosis", sql(("patients", "visits"), f"""
SELECT p.patient_id, {_DIAG_SQL} AS diagnosis FROM patients p LEFT JOIN lv ON lv.patient_id = p.patient_id""",
                                  _LATEST_CTE), "A-16")
def latest_diagnosis(spark, sf):
    p, v = _pv(spark, sf)
    return PT.latest_diagnosis(p, v)


_SEARCH_NORM = "trim(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'))"
_SEARCH_CTE = f"""
terms AS (SELECT DISTINCT term FROM (
            SELECT {_SEARCH_NORM.format(x='first_name')} AS term FROM patients_raw
            UNION ALL SELECT {_SEARCH_NORM.format(x='last_name')} FROM patients_raw) t WHERE term <> ''),
cand AS (SELECT patient_id, {_SEARCH_NORM.format(x="coalesce(first_name, '') || ' ' || coalesce(last_name, '')")} AS n_full
         FROM patients),
m AS (SELECT t.term, c.patient_id, c.n_full = t.term AS exact FROM terms t JOIN cand c ON contains(c.n_full, t.term)),
agg AS (SELECT term, count(*) AS n, min(patient_id) AS any_id, min(CASE WHEN exact THEN patient_id END) AS exact_id
        FROM m GROUP BY term)
"""


@register("patient_search", sql(("patients", "patients_raw"), """
SELECT t.term, CAST(coalesce(a.n, 0) AS BIGINT) AS match_count,
       CASE WHEN coalesce(a.n, 0) = 0 THEN 'not_found' WHEN a.n = 1 THEN 'found'
            WHEN a.exact_id IS NOT NULL THEN 'found' ELSE 'ambiguous' END AS status,
       CASE WHEN a.n = 1 THEN a.any_id WHEN a.n > 1 THEN a.exact_id END AS patient_id
FROM terms t LEFT JOIN agg a ON a.term = t.term""", _SEARCH_CTE), "A-17,X-14")
def patient_search(spark, sf):
    raw = fixture(spark, sf, "patients_raw")
    terms = raw.select(F.col("first_name").alias("term")).unionByName(raw.select(F.col("last_name").alias("term")))
    return _search(terms, fixture(spark, sf, "patients"))


@register("patient_report", sql(("patients", "visits", "audit_logs"), f"""
SELECT p.patient_id,
       coalesce(nullif(trim(coalesce(p.first_name, '') || ' ' || coalesce(p.last_name, '')), ''), 'Unknown Patient') AS display_name,
       {_AGE_SQL.replace('date_of_birth', 'p.date_of_birth')} AS age,
       CAST(coalesce(vc.n, 0) AS BIGINT) AS visit_count, vc.last_visit_date, {_DIAG_SQL} AS diagnosis,
       CAST(coalesce(ac.n, 0) AS BIGINT) AS audit_count,
       coalesce(strftime(p.registration_date, '%B %-d, %Y'), 'N/A') AS registered_on
FROM patients p
LEFT JOIN (SELECT patient_id, count(*) AS n, max(visit_date) AS last_visit_date FROM visits GROUP BY patient_id) vc
  ON vc.patient_id = p.patient_id
LEFT JOIN lv ON lv.patient_id = p.patient_id
LEFT JOIN (SELECT p2.patient_id, count(*) AS n FROM audit_logs a JOIN patients p2
           ON CAST(p2.patient_id AS VARCHAR) = {_AUDIT_KEY_SQL} GROUP BY p2.patient_id) ac ON ac.patient_id = p.patient_id""",
                                _LATEST_CTE), "A-18,J-08,X-12")
def patient_report(spark, sf):
    p, v = _pv(spark, sf)
    r = PT.patient_report(p, v, fixture(spark, sf, "audit_logs"), AS_OF, JSON_PATH)
    return r.select("patient_id", "display_name", "age", "visit_count", "last_visit_date", "diagnosis",
                    "audit_count", "registered_on")


_ALL_P = ", ".join(S.PATIENT_COLUMNS)
_ALL_V = ", ".join(S.VISIT_COLUMNS)


@register("patient_list", sql(("patients",), f"SELECT {_ALL_P} FROM patients ORDER BY patient_id"), "S-05,O-01")
def patient_list(spark, sf):
    return fixture(spark, sf, "patients").select(*S.PATIENT_COLUMNS).orderBy("patient_id")


@register("patient_lookup", sql(("patients", "audit_logs"), f"""
SELECT {_ALL_P} FROM patients WHERE patient_id IN
  (SELECT entity_id FROM audit_logs WHERE entity_type = 'patient')"""), "S-06")
def patient_lookup(spark, sf):
    ids = fixture(spark, sf, "audit_logs").where(F.col("entity_type") == "patient").select(
        F.col("entity_id").alias("patient_id"))
    return PT.lookup_patients(fixture(spark, sf, "patients"), ids).select(*S.PATIENT_COLUMNS)


@register("patient_visits", sql(("visits", "audit_logs"), f"""
SELECT {_ALL_V} FROM visits WHERE patient_id IN
  (SELECT entity_id FROM audit_logs WHERE entity_type = 'patient')
ORDER BY patient_id, visit_date DESC, visit_id DESC"""), "S-07,O-01")
def patient_visits(spark, sf):
    ids = fixture(spark, sf, "audit_logs").where(F.col("entity_type") == "patient").select(
        F.col("entity_id").alias("patient_id"))
    return (PT.visits_of(fixture(spark, sf, "visits"), ids).select(*S.VISIT_COLUMNS)
            .orderBy("patient_id", F.desc("visit_date"), F.desc("visit_id")))


@register("preview_raw", sql(("patients_raw",), "SELECT * FROM patients_raw ORDER BY row_id LIMIT 10"), "S-08")
def preview_raw(spark, sf):
    return PT.first_rows(fixture(spark, sf, "patients_raw"), 10, "row_id")


@register("first_patients", sql(("patients",), """
SELECT patient_id, first_name, last_name, phone_number, email FROM patients ORDER BY patient_id LIMIT 5"""), "S-09")
def first_patients(spark, sf):
    return PT.first_rows(fixture(spark, sf, "patients"), 5, "patient_id",
                         ["patient_id", "first_name", "last_name", "phone_number", "email"])


@register("timeline_audit", sql(("patients", "audit_logs"), f"""
SELECT p.patient_id, strftime(date_trunc('second', a.changed_at), '%Y-%m-%d %H:%M:%S') AS event_date,
       a.entity_type || ': ' || a.action AS title
FROM audit_logs a JOIN patients p ON CAST(p.patient_id AS VARCHAR) = {_AUDIT_KEY_SQL}"""), "A-15")
def timeline_audit(spark, sf):
    p, v = _pv(spark, sf)
    t = PT.timeline(p, v, fixture(spark, sf, "audit_logs"), JSON_PATH)
    return t.where(F.col("event_type") == "audit").select("patient_id", "event_date", "title")


@register("patient_report_events", sql(("patients", "visits", "audit_logs"), f"""
SELECT patient_id, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY event_date IS NULL DESC, event_date DESC,
         source_order, seq_date NULLS FIRST, seq_id NULLS FIRST) AS INTEGER) AS position, event_type, event_date, title
FROM ({_TIMELINE_SQL}) t"""), "A-18,A-14,O-02")
def patient_report_events(spark, sf):
    p, v = _pv(spark, sf)
    return PT.report_events(p, v, fixture(spark, sf, "audit_logs"), JSON_PATH).select(
        "patient_id", "position", "event_type", "event_date", "title")
