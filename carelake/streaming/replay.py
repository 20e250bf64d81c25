"""R-01 replay of pending (offline-queued) records, A-19 pending counts.

Records arrive as JSON files ``{id, kind, patientId, data{...}, timestamp, synced}``, at
least once and however late. A record seen before, by kind, id and payload hash, is known by
its key, which makes re-delivery harmless without a time bound. Inside a batch patients are
registered before visits, so a visit may refer to a patient queued in the same batch; one
whose patient is not stored yet waits until a batch stores that patient. A record that breaks
a registration rule goes to ``rejected_records`` with the reason; none is lost.

What a batch must know of the past is state by key (see ``keyed``): the keys of records seen
and of stored patients (id, phone number, e-mail), and the waiting visits by patient. All
keys of a batch are sought at once, in the buckets they fall in; waiting visits are read for
newly stored patients only, and the largest ids come with the last mark. So a batch reads
what its own records ask for, however large the store. The first batch over a store that has
tables but no such state builds it from them.

Values are stored as typed, blank ones as missing. Every accepted patient and visit gets an
audit row. All tables of a batch are published together (see ``store``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake import schema as S
from carelake.functions.expr import as_of_lit, null_if_token, parse_date
from carelake.operators import load as L
from carelake.session import cut_lineage
from carelake.streaming.state import (LEDGER_SCHEMA, STORED_KEYS, WAITING_SCHEMA, open_state, seen_key, still_waiting,
                                      waiting_rows)
from carelake.streaming.store import publish, write_all

__all__ = ["LEDGER_SCHEMA", "PENDING_SCHEMA", "REJECT_SCHEMA", "WAITING_SCHEMA", "apply_pending_batch", "pending_counts",
           "pending_fixture", "read_pending_stream", "run_replay", "still_waiting"]

DATA_FIELDS = ["first_name", "last_name", "gender", "date_of_birth", "phone_number", "email", "address",
               "blood_group", "doctor_name", "symptoms", "medications", "follow_up_date", "visit_date"]

PENDING_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("patientId", T.LongType()),
    T.StructField("data", T.StructType([T.StructField(f, T.StringType()) for f in DATA_FIELDS])),
    T.StructField("timestamp", T.StringType()),
    T.StructField("synced", T.BooleanType()),
])

# Pending-queue fixture over the events table (one record per event); some records are
# invalid: no first name, a short phone number, no such date, no timestamp, unknown kind.
PENDING_SQL = """
SELECT event_id AS id,
 CASE WHEN event_id % 83 = 0 THEN 'note' WHEN event_id % 4 = 0 THEN 'patient' ELSE 'visit' END AS kind,
 user_id AS patientId,
 named_struct(
  'first_name', CASE WHEN event_id % 53 = 0 THEN ' ' ELSE concat('queued', CAST(event_id % 97 AS STRING)) END,
  'last_name', 'pending', 'gender', 'f', 'date_of_birth', '01-01-1990',
  'phone_number', CASE WHEN event_id % 59 = 0 THEN '12' ELSE concat('77', lpad(CAST(event_id % 5000 AS STRING), 8, '0')) END,
  'email', CAST(NULL AS STRING), 'address', CAST(NULL AS STRING), 'blood_group', 'O+',
  'doctor_name', concat('dr queue', CAST(event_id % 7 AS STRING)), 'symptoms', event_type,
  'medications', CAST(NULL AS STRING), 'follow_up_date', CAST(NULL AS STRING),
  'visit_date', CASE WHEN event_id % 61 = 0 THEN '31-02-2020' ELSE CAST(CAST(ts AS DATE) AS STRING) END) AS data,
 CASE WHEN event_id % 67 = 0 THEN 'some day' ELSE CAST(ts AS STRING) END AS timestamp,
 event_id % 5 = 0 AS synced, CAST(floor((day(ts) - 1) / 8) AS INT) AS chunk
FROM {events}
"""

REJECT_SCHEMA = T.StructType([T.StructField("kind", T.StringType()), T.StructField("id", T.LongType()),
                              T.StructField("reason", T.StringType())])
_DATES = ("date_of_birth", "follow_up_date", "visit_date")


def pending_fixture(spark: SparkSession, events: DataFrame) -> DataFrame:
    return spark.sql(PENDING_SQL, events=events)


def pending_counts(records: DataFrame) -> DataFrame:
    """A-19: records still waiting to be synced, per kind."""
    return (records.groupBy("kind")
            .agg(F.count_if(~F.coalesce(F.col("synced"), F.lit(False))).alias("pending_count")))


def read_pending_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PENDING_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


def _typed(field: str):
    """A payload field as typed; blank ones and placeholders are missing."""
    return null_if_token(F.col(f"data.{field}"))


def _offered(batch: DataFrame) -> DataFrame:
    """Unsynced records, each once, with their key."""
    keys = LEDGER_SCHEMA.fieldNames()
    return (batch.where(~F.coalesce(F.col("synced"), F.lit(False)))
            .withColumn("data_hash", F.xxhash64(F.to_json(F.struct("patientId", "data"))))
            .groupBy(*keys).agg(F.min(F.struct("timestamp", "patientId", "data")).alias("r"))
            .select(*keys, "r.*", seen_key().alias("seen")))


def _judged(records: DataFrame, as_of) -> DataFrame:
    """Records of both kinds as typed columns, with the reason why one cannot be stored. The
    dates are parsed as one array: a third of the code, in a projection
    of its own; all in one were too long a method for the JVM to compile and ran interpreted."""
    typed = records.select(
        "kind", "id", "data_hash", "seen", F.col("patientId").alias("patient_id"),
        F.when(F.try_to_timestamp("timestamp").isNull(), F.lit(S.MSG_BAD_TIMESTAMP)).alias("_time"),
        *[_typed(f).alias(f) for f in DATA_FIELDS if f not in _DATES], _typed("date_of_birth").isNotNull().alias("_born"),
        F.transform(F.array(*[_typed(f) for f in _DATES]), lambda d: F.when(d.isNotNull(), parse_date(d))).alias("_dates"), as_of_lit(as_of).alias("registration_date"))
    typed = typed.withColumns({f: F.get("_dates", F.lit(i)) for i, f in enumerate(_DATES)})
    bad_birth = F.when(F.col("_born") & F.col("date_of_birth").isNull(), F.lit(S.MSG_BAD_DOB))
    reason = (F.when(F.col("kind") == "patient", L.joined_reasons([F.col("_time"), *L.patient_rule_checks(typed), bad_birth]))
              .when(F.col("kind") == "visit", L.joined_reasons([F.col("_time"), *L.visit_rule_checks()]))
              .otherwise(F.lit(S.MSG_UNKNOWN_KIND)))
    return typed.withColumn("reason", reason).drop("_time", "_born", "_dates")


def apply_pending_batch(batch: DataFrame, batch_id: int, store: str, as_of=None, changed_by: str = "system",
                        changed_at=None) -> None:
    """One micro-batch: register patients (first wins), then visits of stored patients."""
    spark = batch.sparkSession
    state = open_state(spark, store, batch_id)
    offered = cut_lineage(_offered(batch))
    patient, visit = F.col("kind") == "patient", F.col("kind") == "visit"
    sought = F.array(F.col("seen"), *[F.when(patient, F.concat(F.lit(f"{f}:"), _typed(f))) for f in L.PATIENT_KEYS],
                     F.when(visit, F.concat(F.lit("patient_id:"), F.col("patientId").cast("string"))))
    wanted = offered.select(F.explode(F.array_compact(sought)).alias("key")).distinct()
    known = state.held("keys", wanted)
    records = cut_lineage(_judged(offered.join(known, F.col("seen") == F.col("key"), "left_anti"), as_of))
    fits = F.col("reason").isNull()
    n = records.agg(F.count(F.lit(1)).alias("all"), F.count_if(fits & (F.col("kind") == "patient")).alias("patients"),
                    F.count_if(fits & (F.col("kind") == "visit")).alias("visits")).first()
    if not n["all"]:
        return  # nothing new
    fit = records.where(fits)
    order = F.struct("id", "data_hash").alias("_order")

    people = L.with_row_index(fit.where("kind = 'patient'").select(
        *[c for c in S.PATIENT_COLUMNS if c != "patient_id"], "id", order), "_order", "row_id", rows=n["patients"])
    ok, clashing = L.first_wins(people, known.withColumnRenamed("key", "_key"), n=2 * n["patients"] + known.count())
    accepted = L.assign_ids(ok, None, "patient_id", "row_id", state.tops["patients"], n["patients"])
    n_accepted = accepted.count()

    due = fit.where("kind = 'visit'").select(F.col("id").alias("row_id"), *WAITING_SCHEMA.fieldNames()[1:])
    stored_ids = (known.where(F.startswith("key", F.lit("patient_id:"))).select(F.substring("key", 12, 30).cast("long").alias("patient_id"))
                  .unionByName(accepted.select("patient_id")))
    n_due = n["visits"]
    if n_accepted and state["waiting"].runs:
        woken = state["waiting"].held(L.long_keys(accepted, ["patient_id"]).withColumnRenamed("_key", "key"))
        due = cut_lineage(due.unionByName(woken.select(*WAITING_SCHEMA.fieldNames())))
        n_due = None
    ready, early = L.split_foreign_key(due, stored_ids, "data_hash", written=True, n=n_due)
    n_ready, n_early = ready.count(), early.count()
    ready = ready.withColumn("_order", F.struct("row_id", "data_hash"))
    ready = L.assign_ids(ready, None, "visit_id", "_order", state.tops["visits"], n_ready)

    options = {"changed_by": changed_by, "changed_at": changed_at}
    audit = L.audit_of_dense(accepted, state.tops["patients"] + 1, state.tops["audit_logs"] + 1, "patient", "patient_id",
                             ["first_name", "last_name", "phone_number"], **options).unionByName(
        L.audit_of_dense(ready, state.tops["visits"] + 1, state.tops["audit_logs"] + 1 + n_accepted, "visit", "visit_id",
                         ["patient_id", "doctor_name", "visit_date"], **options))
    rejected = records.where("reason IS NOT NULL").select("kind", "id", "reason").unionByName(
        clashing.select(F.lit("patient").alias("kind"), "id", F.lit(S.MSG_DUPLICATE_VALUE).alias("reason")))
    early = early.select(*WAITING_SCHEMA.fieldNames())

    new_keys = records.select(F.col("seen").alias("key")).unionByName(L.long_keys(accepted, STORED_KEYS).withColumnRenamed("_key", "key"))
    also = [state.add("keys", new_keys, batch_id, n["all"] + len(STORED_KEYS) * n_accepted),
            state.add("waiting", waiting_rows(early), batch_id, n_early)]
    state.tops = {"patients": state.tops["patients"] + n_accepted, "visits": state.tops["visits"] + n_ready,
                  "audit_logs": state.tops["audit_logs"] + n_accepted + n_ready}
    write_all([(accepted.select(*S.PATIENT_COLUMNS), "patients"), (ready.select(*S.VISIT_COLUMNS), "visits"), (early, "waiting_visits"),
               (rejected, "rejected_records"), (audit.select(*S.AUDIT_COLUMNS), "audit_logs"),
               (records.select(*LEDGER_SCHEMA.fieldNames()), "ledger")], store, batch_id, also)
    publish(spark, store, batch_id, state.text())


def run_replay(spark: SparkSession, source: str, store: str, checkpoint: str, as_of=None, changed_at=None):
    """Process everything available now, then stop (``trigger(availableNow=True)``)."""
    q = (read_pending_stream(spark, source).writeStream
         .foreachBatch(lambda df, bid: apply_pending_batch(df, bid, store, as_of, changed_at=changed_at))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
