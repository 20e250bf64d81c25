"""Registered queries for the streaming operators (R-01..R-03) and A-19.

The stream inputs are files that Spark derives from the test tables and writes under the
shared checkpoint folder (``spark.checkpoint.dir``). A replay or upload runs once per
application and table folder; its queries return the tables it has stored."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake import schema as S
from carelake.plans import sqlfrag as Q
from carelake.plans.cleaning_queries import _UPLOAD_CTE, _keep_first
from carelake.plans.registry import register, sql
from carelake.session import ensure_checkpoint_dir
from carelake.sources.fixtures import FIXTURE_AS_OF as AS_OF, FIXTURE_AS_OF_SQL as AS_OF_SQL, fixture
from carelake.sources.tables import read_table
from carelake.streaming import ingest as I
from carelake.streaming import replay as R
from carelake.streaming.store import publish, read_store, write_batch

CHANGED_AT = "2001-08-01 00:00:00"
_STORES: dict[tuple, str] = {}


def _once(run, spark, sf, retry: bool) -> str:
    """The store that ``run`` filled for this application and folder."""
    key = (run.__name__, spark.sparkContext.applicationId, sf, retry)
    if key not in _STORES:
        base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{run.__name__.strip('_')}-{uuid.uuid4().hex[:12]}"
        run(spark, sf, base, retry)
        _STORES[key] = f"{base}/store"
    return _STORES[key]


def forget_runs() -> None:
    """Let the next query run its stream anew (for timing)."""
    _STORES.clear()


# --- replay --------------------------------------------------------------------------------

_KIND = "CASE WHEN event_id % 83 = 0 THEN 'note' WHEN event_id % 4 = 0 THEN 'patient' ELSE 'visit' END"


@register("pending_count", f"""
SELECT {_KIND} AS kind, CAST(count_if(NOT (event_id % 5 = 0)) AS BIGINT) AS pending_count
FROM events GROUP BY 1""", "A-19")
def pending_count(spark, sf):
    return R.pending_counts(R.pending_fixture(spark, read_table(spark, sf, "events")))


def _replay(spark, sf, base, retry):
    """Queued records in four deliveries of many files each, the first of them once more at
    the end (weeks late), replayed against the stored registry. ``retry``: a finished batch
    is applied again, and so is one that stopped after its first table."""
    events = read_table(spark, sf, "events").repartition(max(8, spark.sparkContext.defaultParallelism))  # narrow rows are dealt out
    store, records = f"{base}/store", R.pending_fixture(spark, events)
    write_batch(fixture(spark, sf, "patients").select(*S.PATIENT_COLUMNS), store, "patients", -1)
    publish(spark, store, -1)
    for k in (0, 1, 2, 3, 0):
        part = records.where(F.col("chunk") == k).drop("chunk")
        part.write.mode("append").json(f"{base}/in")
        R.run_replay(spark, f"{base}/in", store, f"{base}/ckpt", AS_OF, CHANGED_AT)
        if retry and k == 3:
            write_batch(spark.createDataFrame([], S.PATIENT_SCHEMA), store, "patients", 3)
            R.apply_pending_batch(part, 3, store, AS_OF, changed_at=CHANGED_AT)
            R.apply_pending_batch(part, 3, store, AS_OF, changed_at=CHANGED_AT)


_DUE = "NOT (event_id % 5 = 0)"
_REPLAY_CTE = f"""
q AS (SELECT event_id AS id, user_id, event_type, CAST(ts AS DATE) AS day, {_KIND} AS kind,
             CAST(floor((day(ts) - 1) / 8) AS INTEGER) AS chunk,
             CASE WHEN event_id % 67 = 0 THEN '{S.MSG_BAD_TIMESTAMP}' END AS bad_time,
             '77' || lpad(CAST(event_id % 5000 AS VARCHAR), 8, '0') AS phone
      FROM events WHERE {_DUE}),
pe AS (SELECT *, concat_ws('; ', bad_time, CASE WHEN id % 53 = 0 THEN '{S.MSG_MISSING_FIRST}' END,
              CASE WHEN id % 59 = 0 THEN 'phone_number length must be between 5 and 15' END) AS errors
       FROM q WHERE kind = 'patient'),
pr AS (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY chunk, id) AS turn FROM pe WHERE errors = ''),
pa AS (SELECT *, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY chunk, id) AS patient_id
       FROM pr WHERE turn = 1),
ve AS (SELECT *, concat_ws('; ', bad_time, CASE WHEN id % 61 = 0 THEN '{S.MSG_BAD_VISIT_DATE}' END) AS errors
       FROM q WHERE kind = 'visit'),
va AS (SELECT *, row_number() OVER (ORDER BY chunk, id) AS visit_id
       FROM ve WHERE errors = '' AND user_id IN (SELECT c_custkey FROM customer))
"""
_VISITS_OUT = """SELECT visit_id, user_id AS patient_id, 'dr queue' || CAST(id % 7 AS VARCHAR) AS doctor_name,
       event_type AS symptoms, CAST(NULL AS VARCHAR) AS medications, CAST(NULL AS DATE) AS follow_up_date, day AS visit_date
FROM va"""


@register("replay_pending", f"WITH {_REPLAY_CTE} {_VISITS_OUT}", "R-01")
def replay_pending(spark, sf):
    """The visits that the replay stored."""
    return read_store(spark, _once(_replay, spark, sf, False), "visits", S.VISIT_SCHEMA)


@register("replay_retry", f"WITH {_REPLAY_CTE} {_VISITS_OUT}", "R-01 retried batches")
def replay_retry(spark, sf):
    return read_store(spark, _once(_replay, spark, sf, True), "visits", S.VISIT_SCHEMA)


_PATIENTS_OUT = f"""SELECT patient_id, 'queued' || CAST(id % 97 AS VARCHAR) AS first_name, 'pending' AS last_name, 'f' AS gender,
       DATE '1990-01-01' AS date_of_birth, phone AS phone_number, CAST(NULL AS VARCHAR) AS email,
       CAST(NULL AS VARCHAR) AS address, 'O+' AS blood_group, {AS_OF_SQL} AS registration_date FROM pa"""


def _new_patients(spark, sf, retry):
    stored = fixture(spark, sf, "patients").agg(F.max("patient_id")).first()[0]
    return read_store(spark, _once(_replay, spark, sf, retry), "patients", S.PATIENT_SCHEMA).where(F.col("patient_id") > stored)


@register("replay_patients", f"WITH {_REPLAY_CTE} {_PATIENTS_OUT}", "R-01")
def replay_patients(spark, sf):
    """The patients that the replay added to the stored ones."""
    return _new_patients(spark, sf, False)


@register("replay_patients_retry", f"WITH {_REPLAY_CTE} {_PATIENTS_OUT}", "R-01 retried batches")
def replay_patients_retry(spark, sf):
    return _new_patients(spark, sf, True)


@register("replay_rejected", f"""WITH {_REPLAY_CTE}
SELECT kind, id, '{S.MSG_UNKNOWN_KIND}' AS reason FROM q WHERE kind = 'note'
UNION ALL SELECT kind, id, errors FROM pe WHERE errors <> ''
UNION ALL SELECT kind, id, '{S.MSG_DUPLICATE_VALUE}' FROM pr WHERE turn > 1
UNION ALL SELECT kind, id, errors FROM ve WHERE errors <> ''""", "R-01,K-03,K-04,V-08")
def replay_rejected(spark, sf):
    return read_store(spark, _once(_replay, spark, sf, False), "rejected_records", R.REJECT_SCHEMA)


@register("replay_audit", f"""WITH {_REPLAY_CTE},
au AS (SELECT chunk, 0 AS part, id, 'patient' AS entity_type, patient_id AS entity_id,
              json_object('first_name', 'queued' || CAST(id % 97 AS VARCHAR), 'last_name', 'pending', 'phone_number', phone) AS details FROM pa
       UNION ALL SELECT chunk, 1, id, 'visit', visit_id,
              json_object('patient_id', CAST(user_id AS VARCHAR), 'doctor_name', 'dr queue' || CAST(id % 7 AS VARCHAR),
                          'visit_date', CAST(day AS VARCHAR)) FROM va)
SELECT row_number() OVER (ORDER BY chunk, part, id) AS audit_id, entity_type, entity_id, 'create' AS action,
       'system' AS changed_by, TIMESTAMP '{CHANGED_AT}' AS changed_at, CAST(details AS VARCHAR) AS details FROM au""",
          "R-01,K-05")
def replay_audit(spark, sf):
    return read_store(spark, _once(_replay, spark, sf, False), "audit_logs", S.AUDIT_SCHEMA)


# --- uploads -------------------------------------------------------------------------------

#: Headers of the fixture's upload files: aliases, in another order than the table.
UPLOAD_HEADERS = {"phone_number": "Mobile", "last_name": "LName", "first_name": "First Name", "date_of_birth": "DOB",
                  "gender": "Sex", "email": "Email Address", "address": "Home Address", "blood_group": "Blood Type",
                  "registration_date": "Registered On"}


def _upload(spark, sf, base, retry):
    """The raw registry extract arrives as CSV files without row numbers, the even rows
    first, then the odd ones, then the even ones again. ``retry``: the second batch is
    applied again after it has finished, and after a stop behind its first table."""
    store, raw = f"{base}/store", fixture(spark, sf, "patients_raw")
    for k, half in enumerate((0, 1, 0)):
        rows = raw.where(F.col("row_id") % 2 == half).repartitionByRange(4, "row_id").sortWithinPartitions("row_id")
        rows.select(*[F.col(c).alias(h) for c, h in UPLOAD_HEADERS.items()],
                    F.lit('said "no",\nthen left').alias("Remark")).write.option("header", "true").option(
            "quote", '"').option("escape", '"').csv(f"{base}/in/c{k}")
        I.run_ingest(spark, f"{base}/in/*", store, f"{base}/ckpt", as_of=AS_OF, changed_at=CHANGED_AT)
        if retry and k == 1:
            write_batch(spark.createDataFrame([], S.PATIENT_SCHEMA), store, "patients", 1)
            for _ in range(2):
                paths = [r.path for r in spark.read.format("binaryFile").load(f"{base}/in/c1").select("path").collect()]
                I.ingest_batch(I.read_uploads(spark, paths, "csv"), 1, store, AS_OF, changed_at=CHANGED_AT)


_COLS = ", ".join(S.CANONICAL_COLUMNS)
_UPLOAD_STREAM_SQL = sql(("patients_raw",), f"""
SELECT patient_id, {_COLS} FROM b0 UNION ALL SELECT patient_id, {_COLS} FROM b1""", _UPLOAD_CTE + f""",
ev AS (SELECT * FROM upf WHERE row_id % 2 = 0),
e1 AS {_keep_first('ev', 'phone_number')},
e2 AS {_keep_first('e1', 'email')},
b0 AS (SELECT row_number() OVER (ORDER BY row_id) AS patient_id, * FROM e2),
od AS (SELECT * FROM upf WHERE row_id % 2 = 1),
o1 AS {_keep_first('od', 'phone_number')},
o2 AS {_keep_first('o1', 'email')},
o3 AS (SELECT * FROM o2
       WHERE (phone_number IS NULL OR phone_number NOT IN (SELECT phone_number FROM b0 WHERE phone_number IS NOT NULL))
         AND (email IS NULL OR email NOT IN (SELECT email FROM b0 WHERE email IS NOT NULL))),
b1 AS (SELECT (SELECT count(*) FROM b0) + row_number() OVER (ORDER BY row_id) AS patient_id, * FROM o3)""")


@register("upload_stream", _UPLOAD_STREAM_SQL, "R-02,S-01,H-01")
def upload_stream(spark, sf):
    """The registry that the upload batches stored."""
    return read_store(spark, _once(_upload, spark, sf, False), "patients", S.PATIENT_SCHEMA)


@register("upload_stream_retry", _UPLOAD_STREAM_SQL, "R-02 retried batches")
def upload_stream_retry(spark, sf):
    return read_store(spark, _once(_upload, spark, sf, True), "patients", S.PATIENT_SCHEMA)


_REJECTED_SQL = f"""
vn AS (SELECT row_id, row_id % 2 AS half, {Q.first_word('first_name')} AS first_name,
              coalesce(coalesce({Q.clean('last_name')}, {Q.rest_words('first_name')}), 'Unknown') AS last_name,
              {Q.digits('phone_number')} AS phone_number, lower({Q.clean('email')}) AS email,
              date_of_birth AS dob_raw, {Q.parse_date('date_of_birth')} AS date_of_birth FROM patients_raw),
vd AS (SELECT *, CASE WHEN phone_number IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY half, phone_number) END AS pn,
              CASE WHEN email IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY half, email) END AS en FROM vn),
vr AS (SELECT *, concat_ws('; ',
         CASE WHEN first_name IS NULL THEN '{S.MSG_MISSING_FIRST}' END,
         CASE WHEN phone_number IS NULL OR length(phone_number) < 5 THEN '{S.MSG_BAD_PHONE}'
              WHEN pn > 1 THEN '{S.MSG_DUP_PHONE}' END,
         CASE WHEN email IS NOT NULL AND en > 1 THEN '{S.MSG_DUP_EMAIL}' END,
         CASE WHEN email IS NOT NULL AND (NOT contains(email, '@') OR starts_with(email, '@') OR ends_with(email, '@'))
              THEN '{S.MSG_BAD_EMAIL}' END,
         CASE WHEN {Q.null_token('dob_raw')} IS NOT NULL AND date_of_birth IS NULL THEN '{S.MSG_BAD_DOB}' END) AS errors FROM vd)
"""
REJECTED_SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), *[
    T.StructField(c, T.StringType()) for c in ("first_name", "last_name", "phone_number", "email", "errors")]])


@register("rejected_stream", sql(("patients_raw",), """
SELECT first_name, last_name, phone_number, email, errors FROM vr WHERE errors <> ''
UNION ALL SELECT first_name, last_name, phone_number, email, errors FROM vr WHERE errors <> '' AND half = 0""", _REJECTED_SQL),
          "R-03,V-09")
def rejected_stream(spark, sf):
    """Rows refused per upload batch, with reasons (the even rows arrive twice)."""
    rows = read_store(spark, _once(_upload, spark, sf, False), "rejected_rows", REJECTED_SCHEMA)
    return rows.select("first_name", "last_name", "phone_number", "email", "errors")


# --- what the uploads and the replay keep beside their tables --------------------------------

#: All rows that arrive, in the three deliveries: the even ones twice.
_ARRIVED_CTE = """
arrived AS (SELECT 0 AS batch_id, * FROM patients_raw WHERE row_id % 2 = 0 UNION ALL SELECT 1, * FROM patients_raw WHERE row_id % 2 = 1
            UNION ALL SELECT 2, * FROM patients_raw WHERE row_id % 2 = 0),
sheet AS (SELECT first_name, last_name, gender, date_of_birth, phone_number, email, address, blood_group, registration_date,
                 'said "no",' || chr(10) || 'then left' AS remark FROM arrived)
"""
_SHEET = ["first_name", "last_name", "gender", "date_of_birth", "phone_number", "email", "address", "blood_group", "registration_date", "remark"]
_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count(nullif({c}, '')) AS BIGINT) AS missing_count, "
    f"CAST(count(DISTINCT nullif({c}, '')) AS BIGINT) AS distinct_count FROM sheet" for c in _SHEET)


@register("upload_profile", sql(("patients_raw",), _PROFILE_SQL, _ARRIVED_CTE), "R-02,P-02,P-03")
def upload_profile(spark, sf):
    """Missing and distinct values of all uploads, from parts kept by batch (retried ones too)."""
    return I.P.merged_profile(read_store(spark, _once(_upload, spark, sf, True), "upload_profile", I.PROFILE_SCHEMA))


@register("upload_issues", sql(("patients_raw",), f"""
SELECT CAST(count(*) AS BIGINT) AS row_count, CAST({len(_SHEET)} AS BIGINT) AS column_count,
       CAST(count(phone_number) - count(DISTINCT phone_number) AS BIGINT) AS duplicate_phone_raw,
       CAST(count({Q.digits('phone_number')}) - count(DISTINCT {Q.digits('phone_number')}) AS BIGINT) AS duplicate_phone_digits,
       CAST(count(nullif(lower({Q.strip('email')}), '')) - count(DISTINCT nullif(lower({Q.strip('email')}), '')) AS BIGINT) AS duplicate_email,
       CAST(count_if({Q.null_token('date_of_birth')} IS NULL) AS BIGINT) AS dob_missing,
       CAST(count_if({Q.null_token('date_of_birth')} IS NOT NULL AND {Q.parse_date('date_of_birth')} IS NULL) AS BIGINT) AS dob_unparseable,
       CAST(count_if(gender IS NOT NULL AND lower({Q.strip('gender')}) NOT IN ({", ".join(f"'{g}'" for g in S.ALLOWED_GENDER_VALUES)})) AS BIGINT)
         AS inconsistent_gender,
       'remark' AS unknown_columns
FROM sheet""", _ARRIVED_CTE), "R-02,P-01,P-04..P-07,H-04")
def upload_issues(spark, sf):
    """Issue counts of all uploads; the files have a column that no alias names."""
    return I.P.merged_issues(read_store(spark, _once(_upload, spark, sf, True), "upload_profile", I.PROFILE_SCHEMA))


_UPLOADED_CTE = _UPLOAD_STREAM_SQL.split(f"SELECT patient_id, {_COLS} FROM b0")[0]


@register("upload_summary", _UPLOADED_CTE + """
SELECT CAST(b AS BIGINT) AS batch_id, CAST(found AS BIGINT) AS records_found, CAST(uniq AS BIGINT) AS records_after_cleaning,
       CAST(ok - ins AS BIGINT) AS duplicates_removed, CAST(found - ok AS BIGINT) AS invalid_rows_skipped,
       CAST(ins AS BIGINT) AS records_inserted
FROM (SELECT 0 AS b, (SELECT count(*) FROM patients_raw WHERE row_id % 2 = 0) AS found, (SELECT count(*) FROM ev) AS ok,
             (SELECT count(*) FROM e2) AS uniq, (SELECT count(*) FROM b0) AS ins
      UNION ALL SELECT 1, (SELECT count(*) FROM patients_raw WHERE row_id % 2 = 1), (SELECT count(*) FROM od),
             (SELECT count(*) FROM o2), (SELECT count(*) FROM b1)
      UNION ALL SELECT 2, (SELECT count(*) FROM patients_raw WHERE row_id % 2 = 0), (SELECT count(*) FROM ev),
             (SELECT count(*) FROM e2), 0)""", "R-02,K-07,D-04")
def upload_summary(spark, sf):
    """The accounting row of every upload batch, with batches that were applied again."""
    return read_store(spark, _once(_upload, spark, sf, True), "import_summary", I.SUMMARY_SCHEMA)


@register("upload_audit", _UPLOADED_CTE + f"""
SELECT patient_id AS audit_id, 'patient' AS entity_type, patient_id AS entity_id, 'create' AS action, 'system' AS changed_by,
       TIMESTAMP '{CHANGED_AT}' AS changed_at,
       CAST(json_object('first_name', first_name, 'last_name', last_name, 'phone_number', phone_number) AS VARCHAR) AS details
FROM (SELECT patient_id, first_name, last_name, phone_number FROM b0 UNION ALL SELECT patient_id, first_name, last_name, phone_number FROM b1)""",
          "R-02,K-05")
def upload_audit(spark, sf):
    return read_store(spark, _once(_upload, spark, sf, True), "audit_logs", S.AUDIT_SCHEMA)


# --- visits that wait for their patient ------------------------------------------------------

def _replay_few(spark, sf, base, retry):
    """The same queue over a registry that holds a third of the patients it speaks of, with
    few patients in the queue: visits wait, some until a later batch stores their patient."""
    events = read_table(spark, sf, "events")
    top = events.agg(F.floor(F.max("user_id") / 3)).first()[0]
    store, records = f"{base}/store", R.pending_fixture(spark, events).where("kind <> 'patient' OR id % 256 = 0").repartition(4)
    write_batch(fixture(spark, sf, "patients").where(F.col("patient_id") <= top).select(*S.PATIENT_COLUMNS), store, "patients", -1)
    publish(spark, store, -1)
    for k in range(4):
        R.apply_pending_batch(records.where(F.col("chunk") == k).drop("chunk"), k, store, AS_OF, changed_at=CHANGED_AT)


_FEW_CTE = _REPLAY_CTE + """,
cap AS (SELECT CAST(floor(max(user_id) / 3) AS BIGINT) AS n FROM events),
fa AS (SELECT chunk, id, (SELECT n FROM cap) + row_number() OVER (ORDER BY chunk, id) AS patient_id FROM (
         SELECT *, row_number() OVER (PARTITION BY phone ORDER BY chunk, id) AS place FROM pe WHERE errors = '' AND id % 256 = 0) WHERE place = 1),
fv AS (SELECT ve.*, CASE WHEN user_id <= (SELECT n FROM cap) AND user_id IN (SELECT c_custkey FROM customer) THEN ve.chunk
                         ELSE greatest(ve.chunk, fa.chunk) END AS at_chunk,
              (user_id <= (SELECT n FROM cap) AND user_id IN (SELECT c_custkey FROM customer)) OR fa.id IS NOT NULL AS stored
       FROM ve LEFT JOIN fa ON fa.patient_id = user_id WHERE errors = '' AND user_id IS NOT NULL)
"""


@register("replay_waiting", f"""WITH {_FEW_CTE}
SELECT id, user_id AS patient_id, 'dr queue' || CAST(id % 7 AS VARCHAR) AS doctor_name, day AS visit_date FROM fv WHERE NOT stored""", "R-01")
def replay_waiting(spark, sf):
    """Visits whose patient has not come."""
    return R.still_waiting(spark, _once(_replay_few, spark, sf, False)).select(
        F.col("row_id").alias("id"), "patient_id", "doctor_name", "visit_date")


@register("replay_woken", f"""WITH {_FEW_CTE}
SELECT row_number() OVER (ORDER BY at_chunk, id) AS visit_id, user_id AS patient_id, 'dr queue' || CAST(id % 7 AS VARCHAR) AS doctor_name,
       day AS visit_date FROM fv WHERE stored""", "R-01,K-04")
def replay_woken(spark, sf):
    """All visits stored, many of them in the batch that stored their patient."""
    return read_store(spark, _once(_replay_few, spark, sf, False), "visits", S.VISIT_SCHEMA).select(
        "visit_id", "patient_id", "doctor_name", "visit_date")
