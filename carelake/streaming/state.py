"""What a micro-batch knows of the batches before it: the largest ids and the keyed states of
a store, as its last mark names them (see ``keyed`` and ``store``).

``keys`` holds the keys of replayed records and of stored patients, ``waiting`` the visits
that wait for a patient, by the patient's key, ``values`` the distinct values of uploaded
columns. A store that has tables but no state yet gets one made of them, once."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake import schema as S
from carelake.operators import load as L
from carelake.session import cut_lineage
from carelake.streaming.keyed import KeyedState
from carelake.streaming.store import last_mark, read_store

LEDGER_SCHEMA = T.StructType([T.StructField("kind", T.StringType()), T.StructField("id", T.LongType()),
                              T.StructField("data_hash", T.LongType())])
WAITING_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("patient_id", T.LongType()),
    T.StructField("doctor_name", T.StringType()), T.StructField("symptoms", T.StringType()),
    T.StructField("medications", T.StringType()), T.StructField("follow_up_date", T.DateType()),
    T.StructField("visit_date", T.DateType()), T.StructField("data_hash", T.LongType()),
])
KEY_SCHEMA = T.StructType([T.StructField("key", T.StringType())])
STATES = {"keys": KEY_SCHEMA, "waiting": T.StructType([*KEY_SCHEMA.fields, *WAITING_SCHEMA.fields]), "values": KEY_SCHEMA}
#: The stored tables whose ids go on, with their id.
NUMBERED = {"patients": "patient_id", "visits": "visit_id", "audit_logs": "audit_id"}
STORED_KEYS = ("patient_id", *L.PATIENT_KEYS)


def seen_key():
    """A record's key: kind, id and payload hash."""
    return F.concat(F.lit("seen:"), F.concat_ws("|", F.coalesce("kind", F.lit("")), F.coalesce(F.col("id").cast("string"), F.lit("")),
                                                F.col("data_hash").cast("string")), F.when(F.col("kind").isNull(), "|").otherwise(""))


def waiting_rows(visits: DataFrame) -> DataFrame:
    """Visits as rows of the state: by the key of the patient they wait for."""
    return visits.select(F.concat(F.lit("patient_id:"), F.col("patient_id").cast("string")).alias("key"), *WAITING_SCHEMA.fieldNames())


def still_waiting(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """Visits whose patient is not stored (yet): those that ever had to wait, less those whose
    patient has come."""
    read = lambda table, schema: read_store(spark, store, table, schema, before=before)
    return read("waiting_visits", WAITING_SCHEMA).join(read("patients", S.PATIENT_SCHEMA).select("patient_id"), "patient_id", "left_anti") \
        .select(*WAITING_SCHEMA.fieldNames())


@dataclass
class State:
    tops: dict[str, int]
    states: dict[str, KeyedState]

    def __getitem__(self, name: str) -> KeyedState:
        return self.states[name]

    def held(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of a state under ``keys``, as a written table."""
        state = self.states[name]
        return cut_lineage(state.held(keys)) if state.runs else state.spark.createDataFrame([], state.schema)

    def add(self, name: str, rows: DataFrame, batch_id: int, n: int) -> Callable[[], None]:
        """Take ``n`` new rows into a state; what is returned writes them."""
        state = self.states[name]
        if not n:
            return lambda: None
        runs, taken = state.added(str(batch_id), n)
        state.runs = runs
        return lambda: state.write(rows, runs, taken)

    def text(self) -> str:
        """For the batch's mark."""
        return json.dumps({"tops": self.tops} | {name: s.runs for name, s in self.states.items()})


def open_state(spark: SparkSession, store: str, batch_id: int) -> State:
    """The state that the last mark before the batch names, or one made of the stored tables."""
    mark = last_mark(spark, store, before=batch_id)
    saved = json.loads(mark["state"]) if mark is not None and mark["state"] else {}
    state = State(saved.get("tops", dict.fromkeys(NUMBERED, 0)), {
        name: KeyedState(spark, f"{store.rstrip('/')}/_state/{name}", schema, saved.get(name, [])) for name, schema in STATES.items()})
    if saved or mark is None:
        return state
    read = lambda table, schema: read_store(spark, store, table, schema, before=batch_id)
    for table, schema in (("patients", S.PATIENT_SCHEMA), ("visits", S.VISIT_SCHEMA), ("audit_logs", S.AUDIT_SCHEMA)):
        state.tops[table] = L.top_id(read(table, schema), NUMBERED[table])
    keys = L.long_keys(read("patients", S.PATIENT_SCHEMA), STORED_KEYS).withColumnRenamed("_key", "key").unionByName(
        read("ledger", LEDGER_SCHEMA).select(seen_key().alias("key")))
    for name, rows in (("keys", keys), ("waiting", waiting_rows(still_waiting(spark, store, batch_id)))):
        rows = cut_lineage(rows)
        state.add(name, rows, f"{batch_id}-base", rows.count())()
    return state
