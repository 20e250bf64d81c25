"""Deterministic fixture views over the generated test tables.

The same SQL text runs in Spark (tables passed as DataFrame arguments) and in
DuckDB (as a CTE over the pre-registered views), so Spark results and the
oracle see identical inputs. Row counts grow with the source tables.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession

from carelake.sources.tables import read_table

# Reference date of the fixtures: the latest o_orderdate at every scale.
FIXTURE_AS_OF = _dt.date(2001, 8, 1)
FIXTURE_AS_OF_SQL = "DATE '2001-08-01'"

PATIENTS_RAW_SQL = """
SELECT c_custkey AS row_id,
 CAST(c_custkey AS STRING) AS patient_id,
 CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 37 = 0 THEN 'asha rani devi'
      WHEN c_custkey % 3 = 0 THEN '  o''brien ' WHEN c_custkey % 3 = 1 THEN 'MARY-JANE' ELSE lower(c_mktsegment) END AS first_name,
 CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE concat('Surname', lpad(CAST(c_custkey % 997 AS STRING), 3, '0')) END AS last_name,
 CASE c_custkey % 7 WHEN 0 THEN 'M' WHEN 1 THEN ' f' WHEN 2 THEN 'Other' WHEN 3 THEN 'female' WHEN 4 THEN NULL WHEN 5 THEN 'x' ELSE 'MALE' END AS gender,
 CASE WHEN c_custkey % 29 = 0 THEN '31-02-1980' WHEN c_custkey % 31 = 0 THEN NULL
      WHEN c_custkey % 2 = 0 THEN concat(lpad(CAST(1 + c_custkey % 28 AS STRING),2,'0'),'-',lpad(CAST(1 + c_custkey % 12 AS STRING),2,'0'),'-',CAST(1930 + c_custkey % 80 AS STRING))
      ELSE concat(CAST(1930 + c_custkey % 80 AS STRING),'-',lpad(CAST(1 + c_custkey % 12 AS STRING),2,'0'),'-',lpad(CAST(1 + c_custkey % 28 AS STRING),2,'0')) END AS date_of_birth,
 CASE WHEN c_custkey % 43 = 0 THEN 'n/a' WHEN c_custkey % 47 = 0 THEN '12-3'
      ELSE concat('+91 (', lpad(CAST((c_custkey - CASE WHEN c_custkey % 20 = 19 THEN 19 ELSE 0 END) % 1000 AS STRING),3,'0'), ') ', lpad(CAST((c_custkey - CASE WHEN c_custkey % 20 = 19 THEN 19 ELSE 0 END) AS STRING),7,'0')) END AS phone_number,
 CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 53 = 0 THEN '@broken' ELSE concat(' User', CAST(c_custkey - CASE WHEN c_custkey % 25 = 24 THEN 1 ELSE 0 END AS STRING), '@Example.COM ') END AS email,
 concat(' ', CAST(c_nationkey AS STRING), ' Main St ') AS address,
 CASE c_custkey % 4 WHEN 0 THEN 'a+' WHEN 1 THEN ' O-' WHEN 2 THEN 'AB+' ELSE NULL END AS blood_group,
 CAST(DATE '1995-01-01' + CAST((c_custkey * 13) % 2405 AS INT) AS STRING) AS registration_date
FROM {customer}
UNION ALL
SELECT c_custkey + 100000000, NULL, concat('Jonathan', CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'n' END), 'Smithson', 'm', '01-01-1970',
 concat('555', lpad(CAST(c_custkey - c_custkey % 2 AS STRING),7,'0')), NULL, NULL, 'B+', NULL
FROM {customer} WHERE c_custkey % 10 < 2
UNION ALL
SELECT c_custkey + 200000000, NULL, CASE WHEN c_custkey % 3 = 0 THEN repeat('Ab', 30) ELSE 'Bounds' END,
 CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'Checked' END, 'm',
 CASE c_custkey % 4 WHEN 0 THEN 'nan' WHEN 1 THEN '5 Mar 1980' WHEN 2 THEN '1980-03-10T09:00:00' ELSE '07-08-1980' END,
 concat('444', lpad(CAST(c_custkey AS STRING), CASE WHEN c_custkey % 11 = 0 THEN 15 ELSE 7 END, '0')), NULL, NULL,
 CASE WHEN c_custkey % 9 = 0 THEN 'unknown group' ELSE 'B+' END, '05/06/99'
FROM {customer} WHERE c_custkey % 10 = 3
"""

# Stored-form patients (typed, already clean) for the analytics queries.
PATIENTS_SQL = """
SELECT c_custkey AS patient_id,
 CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 37 = 0 THEN 'Asha'
      WHEN c_custkey % 3 = 0 THEN 'O''Brien' WHEN c_custkey % 3 = 1 THEN 'Mary-Jane'
      ELSE concat(upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2))) END AS first_name,
 CASE WHEN c_custkey % 37 = 0 THEN 'Rani Devi' ELSE concat('Surname', lpad(CAST(c_custkey % 997 AS STRING), 3, '0')) END AS last_name,
 CASE c_custkey % 7 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'Other' WHEN 3 THEN 'Female' WHEN 4 THEN NULL WHEN 5 THEN 'X' ELSE 'Male' END AS gender,
 CASE WHEN c_custkey % 29 = 0 OR c_custkey % 31 = 0 THEN NULL
      ELSE make_date(CAST(1930 + c_custkey % 80 AS INT), CAST(1 + c_custkey % 12 AS INT), CAST(1 + c_custkey % 28 AS INT)) END AS date_of_birth,
 concat('91', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), lpad(CAST(c_custkey AS STRING), 7, '0')) AS phone_number,
 CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END AS email,
 concat(CAST(c_nationkey AS STRING), ' Main St') AS address,
 CASE c_custkey % 4 WHEN 0 THEN 'A+' WHEN 1 THEN 'O-' WHEN 2 THEN 'AB+' ELSE NULL END AS blood_group,
 DATE '1995-01-01' + CAST((c_custkey * 13) % 2405 AS INT) AS registration_date
FROM {customer}
"""

VISITS_SQL = """
SELECT o_orderkey AS visit_id, o_custkey AS patient_id,
 CASE WHEN o_orderkey % 17 = 0 THEN '  ' WHEN o_orderkey % 19 = 0 THEN concat('Dr Dóc', CAST(o_orderkey % 23 AS STRING)) WHEN o_orderkey % 2 = 0 THEN concat('Dr Doc', CAST(o_orderkey % 23 AS STRING)) ELSE concat('DR DOC', CAST(o_orderkey % 23 AS STRING)) END AS doctor_name,
 CASE o_orderkey % 9 WHEN 0 THEN 'Fever, headache' WHEN 1 THEN 'chest pain; cough' WHEN 2 THEN 'HIGH  fever / nausea' WHEN 3 THEN NULL WHEN 4 THEN '  ' WHEN 5 THEN 'Routine checkup' WHEN 6 THEN 'breathless,,cough' WHEN 7 THEN 'severe back pain/fatigue' ELSE 'cough' END AS symptoms,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('med', CAST(o_orderkey % 6 AS STRING)) END AS medications,
 CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 21 AS INT) ELSE NULL END AS follow_up_date,
 CAST(o_orderdate AS DATE) AS visit_date
FROM {orders}
"""

AUDIT_LOGS_SQL = """
SELECT event_id AS audit_id, CASE WHEN event_id % 3 = 0 THEN 'patient' ELSE 'visit' END AS entity_type,
 CASE WHEN event_id % 3 = 0 THEN user_id ELSE event_id END AS entity_id, event_type AS action,
 CASE WHEN event_id % 10 = 0 THEN 'admin' ELSE 'system' END AS changed_by, ts AS changed_at, props AS details
FROM {events}
"""

# Raw visits sheet: all text, mixed date layouts, ids missing on some rows (to be
# resolved by phone or e-mail), and planted orphans (ids shifted by 10^9).
VISITS_RAW_SQL = """
SELECT o_orderkey AS row_id,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL
      WHEN o_orderkey % 101 = 0 THEN CAST(o_custkey + 1000000000 AS STRING)
      ELSE CAST(o_custkey AS STRING) END AS patient_id,
 CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 = 0
      THEN concat('+91 ', lpad(CAST(o_custkey % 1000 AS STRING), 3, '0'), '-', lpad(CAST(o_custkey AS STRING), 7, '0'))
      ELSE NULL END AS phone_number,
 CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 = 1 AND o_custkey % 5 <> 0
      THEN concat(' USER', CAST(o_custkey AS STRING), '@example.com') ELSE NULL END AS email,
 CASE WHEN o_orderkey % 17 = 0 THEN '  ' WHEN o_orderkey % 2 = 0 THEN concat('dr doc', CAST(o_orderkey % 23 AS STRING)) ELSE concat('DR DOC', CAST(o_orderkey % 23 AS STRING)) END AS doctor_name,
 CASE o_orderkey % 9 WHEN 0 THEN 'Fever, headache' WHEN 1 THEN ' chest pain; cough ' WHEN 3 THEN NULL WHEN 4 THEN 'nan' ELSE 'cough' END AS symptoms,
 CASE WHEN o_orderkey % 13 = 0 THEN 'not a date'
      WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
      ELSE concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', CAST(year(o_orderdate) AS STRING)) END AS visit_date
FROM {orders}
"""

FIXTURE_SQL = {
    "patients_raw": (PATIENTS_RAW_SQL, ("customer",)),
    "patients": (PATIENTS_SQL, ("customer",)),
    "visits": (VISITS_SQL, ("orders",)),
    "audit_logs": (AUDIT_LOGS_SQL, ("events",)),
    "visits_raw": (VISITS_RAW_SQL, ("orders",)),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a Spark DataFrame (lazy; only the needed columns are scanned)."""
    sql, tables = FIXTURE_SQL[name]
    return spark.sql(sql, **{t: read_table(spark, sf_dir, t) for t in tables})


def oracle_with(*names: str) -> str:
    """``WITH`` prefix defining the given fixture views for DuckDB over the base views."""
    parts = []
    for n in names:
        sql, tables = FIXTURE_SQL[n]
        parts.append(f"{n} AS ({sql.format(**{t: t for t in tables}).strip()})")
    return "WITH " + ",\n".join(parts) + "\n"
