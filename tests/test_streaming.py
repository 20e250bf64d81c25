"""Streams: re-delivery does not double rows; stream result equals the batch result."""

import __spark_entry__ as E
from carelake import schema as S
from carelake.streaming import ingest as I
from carelake.streaming import replay as R
from carelake.streaming import store as store_module
from carelake.streaming.store import read_store


def test_upload_stream_matches_batch(spark, sf):
    streamed = E.queries()["upload_stream"](spark, sf)
    batch = E.queries()["dedup_chain"](spark, sf)
    assert streamed.count() == batch.count()
    assert streamed.select("phone_number").distinct().count() == streamed.count()


def rec(i, kind, pid, ts, **data):
    return {"id": i, "kind": kind, "patientId": pid, "timestamp": ts, "synced": False, "data": data}


def ann(i, phone="9990001111", **more):
    return rec(i, "patient", None, "2024-01-01 11:00:00", **{"first_name": "ann", "last_name": "lee", "phone_number": phone} | more)


def frame(spark, records):
    import json
    return spark.read.schema(R.PENDING_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(r) for r in records], 2))


TABLES = {"patients": S.PATIENT_SCHEMA, "visits": S.VISIT_SCHEMA, "audit_logs": S.AUDIT_SCHEMA, "ledger": R.LEDGER_SCHEMA,
          "rejected_records": R.REJECT_SCHEMA}


def tables(spark, store):
    frames = {t: read_store(spark, store, t, s) for t, s in TABLES.items()} | {"waiting_visits": R.still_waiting(spark, store)}
    return {t: sorted(map(tuple, rows.collect()), key=str) for t, rows in frames.items()}


BATCHES = [
    [rec(1, "visit", 1, "2024-01-01 10:00:00", doctor_name="dr who", visit_date="2024-01-01", symptoms="cough")],
    [ann(2), ann(3, "12"), ann(4), rec(9, "visit", 7, "2024-01-01 10:00:00", doctor_name="dr who", visit_date="2024-01-02")],
    [rec(3, "visit", None, "2024-01-01 12:00:00", doctor_name="dr who", visit_date="2024-01-01"),
     rec(5, "visit", 1, "nonsense", doctor_name=None, visit_date="31-02-2024"), rec(6, "note", None, "2024-01-01 12:00:00"),
     rec(1, "visit", 1, "2024-01-09 10:00:00", doctor_name="dr who", visit_date="2024-01-01", symptoms="cough"),
     ann(7, "5550000000", first_name=" "), ann(8, "5551111111", date_of_birth="31-02-1980")],
    [dict(ann(10, "5552222222"), timestamp="2001-01-01 00:00:00")],  # queued for many years
]


def apply_all(spark, store, apply):
    for i, records in enumerate(BATCHES):
        apply(frame(spark, records), i, store)
    return tables(spark, store)


def plain(batch, i, store):
    R.apply_pending_batch(batch, i, store, "2024-01-02", changed_at="2024-01-02 00:00:00")


def test_replay_rules(spark, tmp_path):
    """Waiting, late, repeated and invalid records: each ends in a table."""
    got = apply_all(spark, str(tmp_path), plain)
    assert [(p[0], p[1], p[5]) for p in got["patients"]] == [(1, "ann", "9990001111"), (2, "ann", "5552222222")]
    assert [(v[0], v[1]) for v in got["visits"]] == [(1, 1)]  # stored once, when its patient came
    assert [w[0] for w in got["waiting_visits"]] == [9]
    assert [(a[0], a[1], a[2]) for a in got["audit_logs"]] == [(1, "patient", 1), (2, "visit", 1), (3, "patient", 2)]
    reasons = {(k, i): r for k, i, r in got["rejected_records"]}
    assert reasons == {
        ("patient", 3): "phone_number length must be between 5 and 15", ("patient", 4): S.MSG_DUPLICATE_VALUE,
        ("visit", 3): S.MSG_UNRESOLVED_PATIENT, ("note", 6): S.MSG_UNKNOWN_KIND, ("patient", 7): S.MSG_MISSING_FIRST,
        ("visit", 5): "; ".join([S.MSG_BAD_TIMESTAMP, S.MSG_MISSING_DOCTOR, S.MSG_BAD_VISIT_DATE]), ("patient", 8): S.MSG_BAD_DOB}
    assert len(got["ledger"]) == 11


def test_replay_retried_batches_change_nothing(spark, tmp_path, monkeypatch):
    """A finished batch applied again, and one that stops after any of its tables."""
    want = apply_all(spark, str(tmp_path / "once"), plain)

    def twice(batch, i, store):
        plain(batch, i, store)
        plain(batch, i, store)

    assert apply_all(spark, str(tmp_path / "twice"), twice) == want

    def stopped(batch, i, store):
        real, left = store_module.write_batch, [1 + i]

        def write(df, *where):
            if not left[0]:
                raise InterruptedError
            left[0] -= 1
            real(df, *where)

        monkeypatch.setattr(store_module, "write_batch", write)
        try:
            plain(batch, i, store)
        except InterruptedError:
            pass
        monkeypatch.setattr(store_module, "write_batch", real)
        plain(batch, i, store)

    assert apply_all(spark, str(tmp_path / "stopped"), stopped) == want


def test_read_errors_are_raised(spark, tmp_path):
    import pytest
    store = str(tmp_path)
    assert read_store(spark, store, "patients", S.PATIENT_SCHEMA).count() == 0
    plain(frame(spark, BATCHES[1]), 0, store)
    (tmp_path / "patients" / "batch=0" / "part-bad.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|read"):
        read_store(spark, store, "patients", S.PATIENT_SCHEMA).count()


def test_uploads_by_header_name(spark, tmp_path):
    """Reordered aliases, quotes, line breaks and no row numbers; file order counts."""
    (tmp_path / "b.csv").write_text('Phone,First Name,Last Name,DOB\n"555-000-2222",zed,"O""Neil ""Jr""",01-02-1990\n')
    (tmp_path / "a.csv").write_text('Remark,LName,fname,Mobile,Phone\n"two\nlines",lee,ann,,5550001111\nx,lee,bob,5550003333,\n')
    rows = I.read_uploads(spark, [str(tmp_path / n) for n in ("b.csv", "a.csv")], "csv").orderBy("row_id").collect()
    assert [(r.row_id, r.first_name, r.last_name, r.phone_number) for r in rows] == [
        (0, "ann", "lee", "5550001111"), (1, "bob", "lee", "5550003333"), (2, "zed", 'O"Neil "Jr"', "555-000-2222")]
    store = str(tmp_path / "store")
    I.ingest_batch(I.read_uploads(spark, [str(tmp_path / "b.csv")], "csv"), 0, store, "2024-01-01")
    assert [r.phone_number for r in read_store(spark, store, "patients", S.PATIENT_SCHEMA).collect()] == ["5550002222"]
