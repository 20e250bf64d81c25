"""Properties and brute-force checks of the order-dependent operators."""

import difflib

from pyspark.sql import functions as F

from carelake import schema as S
from carelake.operators import clean as C, dedup as D, load as L, patients as PT, validate as V
from carelake.operators.fuzzy import fuzzy_dedup
from carelake.sources.fixtures import FIXTURE_AS_OF, fixture


def _upload(spark, sf):
    return C.clean_patients_upload(fixture(spark, sf, "patients_raw"), FIXTURE_AS_OF)


def sequential_insert_ignore(rows, keys):
    seen = {k: set() for k in keys}
    out = []
    for r in sorted(rows, key=lambda r: r["row_id"]):
        if any(r[k] is not None and r[k] in seen[k] for k in keys):
            continue
        for k in keys:
            if r[k] is not None:
                seen[k].add(r[k])
        out.append(r["row_id"])
    return out


def test_exact_insert_ignore_equals_sequential_loop(spark, sf):
    batch = _upload(spark, sf)
    rows = [r.asDict() for r in batch.select("row_id", "phone_number", "email").collect()]
    expected = sequential_insert_ignore(rows, ["phone_number", "email"])
    empty = spark.createDataFrame([], S.PATIENT_SCHEMA)
    got = L.insert_ignore(batch, empty, exact=True)
    assert sorted(r.row_id for r in got.select("row_id").collect()) == sorted(expected)
    ids = [r.patient_id for r in got.orderBy("row_id").select("patient_id").collect()]
    assert ids == list(range(1, len(expected) + 1))


def test_chained_keep_first_differs_from_row_by_row(spark):
    # A(p1,e1) B(p2,e1) C(p2,e3): insert-ignore keeps A and C, chained keep-first keeps A only
    df = spark.createDataFrame([(1, "p1", "e1"), (2, "p2", "e1"), (3, "p2", "e3")],
                               "row_id long, phone_number string, email string")
    acc, rej = L.resolve_in_batch(df)
    assert sorted(r.row_id for r in acc.collect()) == [1, 3]
    assert sorted(r.row_id for r in rej.collect()) == [2]
    assert sorted(r.row_id for r in D.dedup_chain(df).collect()) == [1]


def test_dedup_keys_unique(spark, sf):
    out = D.dedup_chain(_upload(spark, sf))
    assert out.where(F.col("phone_number").isNotNull()).groupBy("phone_number").count().where("count > 1").count() == 0
    assert out.where(F.col("email").isNotNull()).groupBy("email").count().where("count > 1").count() == 0


def test_valid_plus_invalid_is_input(spark, sf):
    raw = fixture(spark, sf, "patients_raw")
    frame = V.validation_frame(raw)
    assert V.valid_rows(frame).count() + V.invalid_rows(frame).count() == raw.count()


def ratio(later, kept):
    """What the rule asks of two names: the expected value of these tests."""
    return difflib.SequenceMatcher(None, later.strip().lower(), kept.strip().lower()).ratio()


def sequential_keep(rows):
    """Kept positions of (first, last) rows in order."""
    kept = []
    for i, (f, l) in enumerate(rows):
        if not any(ratio(f, rows[k][0]) >= 0.88 and ratio(l, rows[k][1]) >= 0.88 for k in kept):
            kept.append(i)
    return kept


def test_fuzzy_equals_sequential_loop(spark, sf):
    batch = _upload(spark, sf)
    rows = sorted([r.asDict() for r in batch.select("row_id", "first_name", "last_name", "phone_number",
                                                     "date_of_birth").collect()], key=lambda r: r["row_id"])
    kept = []
    for r in rows:
        dup = any(r["phone_number"] and k["phone_number"] == r["phone_number"] and r["date_of_birth"]
                  and k["date_of_birth"] == r["date_of_birth"]
                  and ratio(r["first_name"], k["first_name"]) >= 0.88
                  and ratio(r["last_name"], k["last_name"]) >= 0.88 for k in kept)
        if not dup:
            kept.append(r)
    got = sorted(r.row_id for r in fuzzy_dedup(batch).select("row_id").collect())
    assert got == sorted(r["row_id"] for r in kept)
    assert len(got) < len(rows)


def test_timeline_sizes(spark, sf):
    p, v, a = (fixture(spark, sf, n) for n in ("patients", "visits", "audit_logs"))
    t = PT.timeline(p, v, a, "$.k")
    n_audit = PT.audit_by_patient(p, a, "$.k").count()
    n_vis = v.join(p.select("patient_id"), "patient_id", "left_semi").count()
    assert t.count() == p.count() + n_vis + n_audit


def test_triage_keyword_across_visit_boundary(spark):
    p = spark.createDataFrame([(1, None)], "patient_id long, date_of_birth date")
    import datetime as dt
    v = spark.createDataFrame([(10, 1, dt.date(2024, 1, 2), "ache in chest"), (11, 1, dt.date(2024, 1, 1), "pain")],
                              "visit_id long, patient_id long, visit_date date, symptoms string")
    r = PT.triage(p, v, dt.date(2024, 1, 3)).first()
    assert r.score == 4 and "Critical symptom keyword detected" in r.reasons   # "...chest" + " " + "pain..."
    v2 = v.withColumn("visit_date", F.when(F.col("visit_id") == 10, F.lit(dt.date(2023, 1, 1))).otherwise(F.col("visit_date")))
    assert PT.triage(p, v2, dt.date(2024, 1, 3)).first().score == 1   # order reversed: "pain chest ..."


def test_fuzzy_hot_block_with_many_names(spark):
    """One (phone, dob) block with many distinct names: distributed path equals the loop."""
    import datetime as dt
    import random
    rnd = random.Random(7)
    base = ["jonathan", "jonathon", "johnathan", "maria", "marie", "mariah", "ann", "anne", "annie"]
    rows = []
    for i in range(120):
        f = rnd.choice(base) + rnd.choice(["", "", "a", "e", "n"])
        l = rnd.choice(["smith", "smyth", "smithe", "jones", "jonas"])
        rows.append((i, f, l, "5550001", dt.date(1970, 1, 1)))
    df = spark.createDataFrame(rows, "row_id long, first_name string, last_name string, phone_number string, date_of_birth date")
    got = sorted(r.row_id for r in fuzzy_dedup(df).select("row_id").collect())
    # loop over first occurrences of each distinct name pair, as the rule implies
    firsts, seen = [], set()
    for r in rows:
        if (r[1], r[2]) not in seen:
            seen.add((r[1], r[2]))
            firsts.append(r)
    assert got == [firsts[k][0] for k in sequential_keep([r[1:3] for r in firsts])]


def test_registration_first_wins_against_stored_and_batch(spark, sf):
    batch = _upload(spark, sf)
    stored = fixture(spark, sf, "patients")
    keys = ["phone_number", "email"]
    seen = {k: {r[k] for r in stored.select(k).collect() if r[k] is not None} for k in keys}
    rows = sorted((r.asDict() for r in batch.collect()), key=lambda r: r["row_id"])
    rejected_expected, broken = [], []
    for r in rows:
        if any(r.get(c) is not None and not low <= len(r[c]) <= high for c, (low, high) in S.FIELD_LENGTH_BOUNDS.items()):
            broken.append(r["row_id"])  # breaks a bound: refused for that, takes no key
            continue
        if any(r[k] is not None and r[k] in seen[k] for k in keys):
            rejected_expected.append(r["row_id"])
            continue
        for k in keys:
            if r[k] is not None:
                seen[k].add(r[k])
    accepted, rejected = L.register_patients(batch, stored, FIXTURE_AS_OF)
    reasons = {r.row_id: r.reason for r in rejected.collect()}
    assert sorted(i for i, why in reasons.items() if why == S.MSG_DUPLICATE_VALUE) == sorted(rejected_expected)
    assert sorted(i for i, why in reasons.items() if "length must be between" in why) == sorted(broken) != []
    assert accepted.count() + len(reasons) == len(rows)


def test_results_do_not_depend_on_session_time_zone(spark, sf):
    import __spark_entry__ as E
    names = ["patient_timeline", "audit_rows", "follow_up_reminders"]
    def run():
        return {n: sorted(map(tuple, E.queries()[n](spark, sf).collect())) for n in names}
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        utc = run()
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        assert run() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_hot_key_holding_a_third_of_rows(spark):
    """One phone number on a third of all rows: exact results, and keep-first is
    combined map-side (partial aggregate before the shuffle)."""
    n = 30_000
    rows = spark.range(n).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, F.lit("5550000000"))
         .otherwise(F.concat(F.lit("9"), F.lpad(F.col("id").cast("string"), 9, "0"))).alias("phone_number"),
        F.when(F.col("id") % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("u"), (F.col("id") % 20_000).cast("string"), F.lit("@x.org"))).alias("email"))
    kept = D.dedup_phone(rows)
    assert kept.count() == n - (n // 3) + 1
    assert kept.where(F.col("phone_number") == "5550000000").first().row_id == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
    flags = {r.key: r.n for r in V._repeated(rows).where("kind = 'phone_number'").collect()}
    assert flags == {"5550000000": n // 3}
    acc, rej = L.resolve_in_batch(rows)
    exp = sequential_insert_ignore([r.asDict() for r in rows.collect()], ["phone_number", "email"])
    assert sorted(r.row_id for r in acc.collect()) == sorted(exp)
