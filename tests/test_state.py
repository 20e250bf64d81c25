"""Keyed state reads buckets, not the store; uploads of many files make one plan; CSV records
over block ends; heavy keys stay spread; walks and rounds agree."""

import csv
import datetime as dt
import json
import os
import random
import subprocess
import sys

from pyspark.sql import functions as F

from carelake import schema as S
from carelake.operators import load as L
from carelake.operators import profile as P
from carelake.sources import records as RC
from carelake.sources.extracts import read_extract
from carelake.sources.numbering import with_row_index
from carelake.streaming import ingest as I
from carelake.streaming import keyed, state
from carelake.streaming.store import last_mark, publish, read_store, write_batch


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], state.KEY_SCHEMA)


def test_keyed_state_reads_the_buckets_of_its_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKET_ROWS", 100)
    held = keyed.KeyedState(spark, str(tmp_path), state.KEY_SCHEMA, [])
    rows = spark.range(5000).select(F.concat(F.lit("k:"), F.col("id").cast("string")).alias("key"))
    held.runs, taken = held.added("0", 5000)
    held.write(rows, held.runs, taken)
    assert held.runs[0]["bits"] == 6 and not taken
    near = held.near(keys(spark, "k:17", "k:4999", "no such key"))
    assert 1 <= len(near.inputFiles()) <= 3 and near.count() < 400
    assert sorted(r.key for r in held.held(keys(spark, "k:17", "k:4999", "k:5000")).collect()) == ["k:17", "k:4999"]
    for batch in range(1, 8):  # runs of similar size are taken up, so there are few
        new, taken = held.added(str(batch), 10)
        held.write(keys(spark, *[f"b{batch}:{i}" for i in range(10)]), new, taken)
        held.runs = new
    assert [r["rows"] for r in held.runs] == [5000, 70] or len(held.runs) <= 4
    found = held.held(keys(spark, "b1:3", "b7:9", "k:0", "b8:0"))
    assert sorted(r.key for r in found.collect()) == ["b1:3", "b7:9", "k:0"]


def test_state_is_made_of_the_tables_once(spark, tmp_path):
    store = str(tmp_path)
    rows = spark.createDataFrame([(7, "a", "b", None, None, "5550001", None, None, None, dt.date(2024, 1, 1))], S.PATIENT_SCHEMA)
    write_batch(rows, store, "patients", -1)
    publish(spark, store, -1)
    opened = state.open_state(spark, store, 0)
    assert opened.tops == {"patients": 7, "visits": 0, "audit_logs": 0}
    publish(spark, store, 0, opened.text())
    again = state.open_state(spark, store, 1)
    assert again.tops == opened.tops and again["keys"].runs == opened["keys"].runs
    assert sorted(r.key for r in again.held("keys", keys(spark, "patient_id:7", "phone_number:5550001", "email:x")).collect()) == [
        "patient_id:7", "phone_number:5550001"]
    assert last_mark(spark, store)["published"] == 0 and last_mark(spark, str(tmp_path / "none")) is None


def write_csv(path, rows, end="\r\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows(rows)


def test_records_reach_over_blocks(spark, tmp_path):
    rng = random.Random(11)
    texts = ["plain", 'a "quoted" word', "two\nlines", 'three\r\nlines\n"x",y', "", "comma, here", "é漢", "\n\n", "x" * 300]
    rows = [[str(i), rng.choice(texts), rng.choice(["x", '5" nail', "end"])] for i in range(600)]
    write_csv(tmp_path / "a.csv", [["No", "Text\nname", "Last"], *rows])
    write_csv(tmp_path / "b.csv", [["Last", "No", "Last"], ["l", "900", "m"], ["", "901", ""]], "\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text('No\n\n1000\n\n"10\n01"')
    want = [(i, *r) for i, r in enumerate(rows)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (old["spark.sql.files.maxPartitionBytes"], "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            one = read_extract(spark, str(tmp_path / "a.csv"))
            assert one.columns == ["row_id", "No", "Text\nname", "Last"]
            assert sorted((r[0], r[1], r[2] or "", r[3]) for r in one.collect()) == want
            every = read_extract(spark, str(tmp_path), "csv").where("row_id >= 600").orderBy("row_id")
            got = [(r["row_id"], r["No"], r["Last0"], r["Last2"]) for r in every.collect()]
            assert got == [(600, "900", "l", "m"), (601, "901", None, None), (602, "1000", None, None), (603, "10\n01", None, None)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert RC.csv_records(spark, str(tmp_path / "c.csv")).count() == 0


def test_many_files_make_one_plan(spark, tmp_path):
    for i in range(60):
        head = ["Phone", "First Name", "Extra"] if i % 2 else ["fname", "Mobile"]
        row = [f"555{i:07d}", f"name{i}", "z"] if i % 2 else [f"name{i}", f"555{i:07d}"]
        write_csv(tmp_path / f"{i:03d}.csv", [head, row])
    rows = I.read_uploads(spark, [str(tmp_path / f"{i:03d}.csv") for i in range(60)], "csv")
    assert [(r.row_id, r.first_name, r.phone_number) for r in rows.orderBy("row_id").collect()] == [
        (i, f"name{i}", f"555{i:07d}") for i in range(60)]
    assert set(rows.columns) == {"row_id", "phone_number", "first_name", "extra"}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_profile_parts_add_up(spark, tmp_path):
    rows = [(i, [None, "a b", "Zed"][i % 3], "l", ["M", "x"][i % 2], ["01-02-1990", "31-02-1990", None][i % 3], f"55-5{i % 7}", f" A{i % 4}@x.org", "v" * 80 + str(i % 2))
            for i in range(40)]
    raw = spark.createDataFrame(rows, "row_id long, `First Name` string, last_name string, gender string, DOB string, Mobile string, email string, Remark string")
    store = str(tmp_path)
    for batch, part in enumerate((raw.where("row_id < 15"), raw.where("row_id >= 15"), raw.where("row_id < 9"))):
        I.ingest_batch(I.normalize_headers(part), batch, store, "2024-01-01")
        if batch == 1:
            I.ingest_batch(I.normalize_headers(part), batch, store, "2024-01-01")
    every = raw.unionByName(raw.where("row_id < 9"))
    parts = read_store(spark, store, "upload_profile", I.PROFILE_SCHEMA)
    merged = {r.column_name: (r.missing_count, r.distinct_count) for r in P.merged_profile(parts).collect()}
    missing = {r.column_name: r.missing_count for r in P.profile_missing(every).collect()}
    distinct = {r.column_name: r.distinct_count for r in P.profile_distinct(every).collect()}
    assert merged == {c: (missing[c], distinct.get(c, 0)) for c in missing}
    assert P.merged_issues(parts).first().asDict() == P.profile_issues(every).first().asDict()


def test_frequent_keys_do_not_gather_their_rows(spark):
    n = 40_000
    rows = spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 11 == 0, None)
                                 .otherwise(F.col("id").cast("string")).alias("phone_number"))
    frequent = L.frequent_keys(rows, "phone_number")
    assert frequent == ["hot"]
    stored = spark.createDataFrame([("hot", 5), ("1", 6), ("1", 4), (None, 1)], "phone_number string, patient_id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = L.look_up(rows, stored, "phone_number", F.min("patient_id"), "pid", frequent=frequent)
        sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
        assert {(r.phone_number, r.pid): r["count"] for r in got.where("pid IS NOT NULL").groupBy("phone_number", "pid").count().collect()} == {
            ("hot", 5): -(-n // 3), ("1", 4): 1}
        assert got.count() == n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rounds_and_walk_refuse_the_same(spark):
    rng = random.Random(4)
    rows = [(i, f"p{rng.randrange(60)}" if rng.random() < 0.9 else None, f"e{rng.randrange(80)}" if rng.random() < 0.7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, phone_number string, email string")
    taken, want = set(), []
    for i, *ks in rows:
        ks = [(j, k) for j, k in enumerate(ks) if k]
        if taken.intersection(ks):
            want.append(i)
        else:
            taken.update(ks)
    for walk in (0, 40, 10_000):
        assert sorted(r[0] for r in L.rejected_in_batch(df, walk_rows=walk).collect()) == want


def test_positions_by_one_task_and_by_many(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("row_id"), F.lit(1).alias("x"))
    for n in (None, 500):
        assert [(r.row_id, r.at) for r in with_row_index(df, "row_id", "at", 3, n).orderBy("at").collect()] == [(i, i + 3) for i in range(500)]
    assert with_row_index(df.limit(0), "row_id", "at").count() == 0


#: Scans of source files that a load may make over all its jobs (the patients fixture alone
#: is a union of three reads of its table).
MOST_SCANS = {"load_patients_cli": 8, "load_visits": 4, "import_summary": 4, "visit_load_summary": 2}


def test_loads_read_each_input_few_times(sf, tmp_path):
    """Counted in the plans that ran, from the event log of an application of its own."""
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2')
         .config('spark.eventLog.enabled', 'true').config('spark.eventLog.dir', {str(tmp_path)!r}).config('spark.eventLog.compress', 'false')
         .config('spark.eventLog.rolling.enabled', 'false').config('spark.sql.session.timeZone', 'UTC').getOrCreate())
import __spark_entry__ as E
for name in {list(MOST_SCANS)!r}:
    spark.sparkContext.setJobDescription(name)
    E.queries()[name](spark, {sf!r}).collect()
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, capture_output=True, timeout=600)
    log = next(p for p in tmp_path.iterdir() if p.is_file() and not p.name.startswith("."))
    plans, query = {}, {}
    for line in filter(None, log.read_text(encoding="utf-8").split("\n")):
        event = json.loads(line)
        if event["Event"].endswith("SQLExecutionStart"):
            query[event["executionId"]] = event["description"]
        if event["Event"].endswith(("SQLExecutionStart", "SQLAdaptiveExecutionUpdate")):
            plans[event["executionId"]] = event["sparkPlanInfo"]

    def count(plan):
        return int(plan["nodeName"].startswith("Scan parquet")) + sum(count(c) for c in plan["children"])

    scans = {name: sum(count(p) for k, p in plans.items() if query[k] == name) for name in MOST_SCANS}
    assert all(0 < scans[name] <= most for name, most in MOST_SCANS.items()), scans
