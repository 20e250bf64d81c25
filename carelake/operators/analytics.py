"""Clinic analytics over stored ``patients`` / ``visits`` (A-01..A-11).

Each function returns a small DataFrame; the heavy inputs are only scanned,
filtered and aggregated (partial aggregation before every shuffle), and the
driver receives at most a handful of rows per result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelake import schema as S
from carelake.functions.expr import (as_of_lit, follow_up_status, full_name, strip,
                                     symptom_token)


# --- A-01 / A-02 / A-03 ----------------------------------------------------

def overview_counts(patients: DataFrame, as_of=None) -> DataFrame:
    """Total patients and patients registered on ``as_of``."""
    return patients.agg(
        F.count(F.lit(1)).alias("total_patients"),
        F.count_if(F.col("registration_date") == as_of_lit(as_of)).alias("new_today"),
    )


def repeat_patients(visits: DataFrame, min_visits: int = 2) -> DataFrame:
    """Number of patients with at least ``min_visits`` visits."""
    per_patient = visits.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))
    return per_patient.agg(F.count_if(F.col("n") >= min_visits).alias("repeat_patients"))


def repeat_visit_rate(patients: DataFrame, visits: DataFrame, as_of=None) -> DataFrame:
    """total, repeat and rate % (1 decimal, half-even; 0 when there are no patients).

    The two one-row aggregates are stacked and folded by a final aggregate rather
    than cross-joined.
    """
    left = overview_counts(patients, as_of).select(
        "total_patients", "new_today", F.lit(None).cast("long").alias("repeat_patients"))
    right = repeat_patients(visits).select(
        F.lit(None).cast("long").alias("total_patients"), F.lit(None).cast("long").alias("new_today"),
        "repeat_patients")
    both = left.unionByName(right).agg(
        F.max("total_patients").alias("total_patients"),
        F.max("new_today").alias("new_today"),
        F.max("repeat_patients").alias("repeat_patients"))
    rate = F.when(F.col("total_patients") > 0,
                  F.bround(F.col("repeat_patients") / F.col("total_patients") * 100.0, 1)
                  ).otherwise(F.lit(0.0))
    return both.withColumn("repeat_visit_rate", rate)


# --- A-04 / A-05 / A-06 / J-07 --------------------------------------------

def visit_trend(visits: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    """Dense daily visit counts for the ``days`` days ending at ``as_of``.

    The scan is bounded on both ends (filter pushed to the reader); the count
    side has at most ``days`` rows, so joining it to the calendar is a join of
    two tiny relations.
    """
    spark = visits.sparkSession
    end = as_of_lit(as_of)
    start = F.date_sub(end, days - 1)
    counts = (visits.where((F.col("visit_date") >= start) & (F.col("visit_date") <= end))
              .groupBy(F.col("visit_date").alias("visit_day"))
              .agg(F.count(F.lit(1)).alias("visit_count")))
    calendar = spark.range(days).select(F.date_add(start, F.col("id").cast("int")).alias("visit_day"))
    return (calendar.join(F.broadcast(counts), "visit_day", "left")
            .select("visit_day",
                    F.date_format("visit_day", "EEE").alias("label"),
                    F.coalesce("visit_count", F.lit(0)).cast("long").alias("visit_count")))


def visit_trend_weekday(trend: DataFrame) -> DataFrame:
    """Re-key a trend by weekday Sun..Sat, summing repeats and zero-filling gaps."""
    spark = trend.sparkSession
    order = spark.createDataFrame([(i, d) for i, d in enumerate(S.WEEKDAY_ORDER)],
                                  "day_order int, label string")
    sums = trend.groupBy("label").agg(F.sum("visit_count").alias("visits"))
    return (order.join(F.broadcast(sums), "label", "left")
            .select("day_order", "label", F.coalesce("visits", F.lit(0)).cast("long").alias("visits")))


def trend_bar_scale(trend: DataFrame, floor_pct: int = 6) -> DataFrame:
    """Bar height % per day: ``max(floor, round(v / max(v, 1) * 100))``.

    The trend has a fixed number of rows (one per calendar day), so folding it
    into one row to get the maximum is bounded by construction.
    """
    folded = trend.agg(
        F.greatest(F.max("visit_count"), F.lit(1)).alias("peak"),
        F.collect_list(F.struct("visit_day", "label", "visit_count")).alias("pts"))
    return (folded.select("peak", F.explode("pts").alias("p"))
            .select("p.visit_day", "p.label", "p.visit_count",
                    F.greatest(F.lit(floor_pct),
                               F.round(F.col("p.visit_count") / F.col("peak") * 100.0).cast("int")
                               ).alias("bar_pct")))


# --- A-07 --------------------------------------------------------------------

def symptom_counts(visits: DataFrame) -> DataFrame:
    """All symptom tokens (split on / ; ,) normalised and counted."""
    tokens = (visits.where(F.col("symptoms").isNotNull() & (F.trim("symptoms") != ""))
              .select(F.explode(F.split("symptoms", "[/;,]")).alias("raw"))
              .select(symptom_token("raw").alias("symptom"))
              .where(F.col("symptom") != ""))
    return tokens.groupBy("symptom").agg(F.count(F.lit(1)).alias("symptom_count"))


def top_symptoms(visits: DataFrame, k: int = 5) -> DataFrame:
    """Top-k symptoms: count desc, then symptom asc (deterministic ties)."""
    return symptom_counts(visits).orderBy(F.desc("symptom_count"), F.asc("symptom")).limit(k)


# --- A-08 --------------------------------------------------------------------

def doctor_workload(visits: DataFrame, k: int = 5, collation: str | None = None) -> DataFrame:
    """Visits per doctor, blank names out, top-k by count desc then name.

    ``collation='UNICODE_CI_AI'`` groups names case/accent-insensitively (as the
    source database did); the displayed name is the smallest spelling in the group.
    """
    named = visits.where(F.col("doctor_name").isNotNull() & (F.trim("doctor_name") != ""))
    if collation:
        grouped = (named.groupBy(F.collate("doctor_name", collation).alias("doctor_key"))
                   .agg(F.min("doctor_name").alias("doctor_name"),
                        F.count(F.lit(1)).alias("visit_count"))
                   .drop("doctor_key"))
    else:
        grouped = named.groupBy("doctor_name").agg(F.count(F.lit(1)).alias("visit_count"))
    return grouped.orderBy(F.desc("visit_count"), F.asc("doctor_name")).limit(k)


# --- A-09 / A-10 / J-01 ------------------------------------------------------

def follow_up_rows(visits: DataFrame, patients: DataFrame | None = None, as_of=None) -> DataFrame:
    """Visits with a follow-up date, days until due and bucket; with ``patients`` also
    the patient name (left join, J-01)."""
    days = F.datediff("follow_up_date", as_of_lit(as_of))
    doctor = F.coalesce(F.nullif(F.col("doctor_name"), F.lit("")), F.lit(S.UNKNOWN_DOCTOR))
    rows = (visits.where(F.col("follow_up_date").isNotNull())
            .select("visit_id", "patient_id", doctor.alias("doctor_name"), "follow_up_date",
                    days.alias("days_until_follow_up"))
            .withColumn("bucket", F.when(F.col("days_until_follow_up") < 0, F.lit("overdue"))
                        .when(F.col("days_until_follow_up") <= 7, F.lit("due_soon"))))
    return rows if patients is None else with_patient_names(rows, patients)


def _names(patients: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(full_name("first_name", "last_name"), F.lit("")), F.lit(S.UNKNOWN_PATIENT_NAME))
    return patients.select("patient_id", name.alias("patient_name"))


def with_patient_names(rows: DataFrame, patients: DataFrame, small: bool = False) -> DataFrame:
    """Left join of patient names (J-01). ``small=True``: ``rows`` has a proven small
    bound, so only the matching patients are fetched (broadcast semi join of the ids)
    and looked up by broadcast; the patient table is never shuffled."""
    if not small:
        joined = rows.join(_names(patients), "patient_id", "left")
    else:
        ids = F.broadcast(rows.select("patient_id").distinct())
        few = patients.join(ids, "patient_id", "left_semi")
        joined = rows.join(F.broadcast(_names(few)), "patient_id", "left")
    return joined.withColumn("patient_name", F.coalesce("patient_name", F.lit(S.UNKNOWN_PATIENT_NAME)))


def follow_up_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("bucket") == "overdue").alias("overdue_count"),
                    F.count_if(F.col("bucket") == "due_soon").alias("due_soon_count"))


def follow_up_reminders(rows: DataFrame, k: int = 5, patients: DataFrame | None = None) -> DataFrame:
    """First ``k`` reminders per bucket in (follow_up_date asc, visit_id desc) order.

    ``row_number() <= k`` lets Spark place a partial WindowGroupLimit before the
    shuffle, so each bucket (there are only two) receives at most k rows per
    input partition instead of every reminder. Names are attached afterwards to
    the at most 2k chosen rows.
    """
    w = Window.partitionBy("bucket").orderBy(F.asc("follow_up_date"), F.desc("visit_id"))
    top = (rows.where(F.col("bucket").isNotNull())
           .withColumn("rank", F.row_number().over(w))
           .where(F.col("rank") <= k)
           .withColumn("status", follow_up_status("days_until_follow_up")))
    return top if patients is None else with_patient_names(top, patients, small=True)


def with_follow_up_status(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", follow_up_status("days_until_follow_up"))


# --- A-11 --------------------------------------------------------------------

def overview_bundle(patients: DataFrame, visits: DataFrame, as_of=None) -> dict[str, DataFrame]:
    """All overview parts, each a DataFrame over the same (optionally cached) inputs."""
    trend = visit_trend(visits, as_of)
    rows = follow_up_rows(visits, None, as_of)
    return {
        "summary": repeat_visit_rate(patients, visits, as_of),
        "visit_trend": trend,
        "visit_trend_weekday": visit_trend_weekday(trend),
        "top_symptoms": top_symptoms(visits),
        "doctor_workload": doctor_workload(visits),
        "follow_up_counts": follow_up_counts(rows),
        "follow_up_reminders": follow_up_reminders(rows, patients=patients),
    }


def _joined(df: DataFrame, sort_key, text) -> DataFrame:
    """Fold a small (bounded) result into one '; '-joined text in ``sort_key`` order."""
    items = df.agg(F.sort_array(F.collect_list(F.struct(sort_key.alias("s"), text.alias("t")))).alias("a"))
    return items.select(F.array_join(F.transform("a", lambda x: x.getField("t")), "; ").alias("v"))


def overview_row(patients: DataFrame, visits: DataFrame, as_of=None) -> DataFrame:
    """A-11 as one row: summary numbers and the bounded lists as text. The parts are
    stacked as (name, value) rows and pivoted, so no cross join is needed."""
    b = overview_bundle(patients, visits, as_of)
    text = lambda *cs: ", ".join(f"'{c}', cast({c} as string)" for c in cs)
    parts = [
        b["summary"].selectExpr(f"stack(4, {text('total_patients', 'new_today', 'repeat_patients', 'repeat_visit_rate')}) AS (k, v)"),
        b["follow_up_counts"].selectExpr(f"stack(2, {text('overdue_count', 'due_soon_count')}) AS (k, v)"),
        b["follow_up_reminders"].groupBy(F.col("bucket").alias("k")).agg(F.sort_array(F.collect_list(F.struct(
            "rank", F.concat_ws(":", F.col("visit_id").cast("string"), "patient_name", "status").alias("t")))).alias("a"))
        .select("k", F.array_join(F.transform("a", lambda x: x["t"]), "; ").alias("v")),
        _joined(b["visit_trend"], F.col("visit_day"),
                F.concat(F.date_format("visit_day", "yyyy-MM-dd"), F.lit(":"), F.col("visit_count").cast("string"))
                ).select(F.lit("visit_trend").alias("k"), "v"),
        _joined(b["top_symptoms"], F.struct(-F.col("symptom_count"), F.col("symptom")),
                F.concat("symptom", F.lit(":"), F.col("symptom_count").cast("string"))
                ).select(F.lit("top_symptoms").alias("k"), "v"),
        _joined(b["doctor_workload"], F.struct(-F.col("visit_count"), F.col("doctor_name")),
                F.concat("doctor_name", F.lit(":"), F.col("visit_count").cast("string"))
                ).select(F.lit("doctor_workload").alias("k"), "v"),
    ]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    keys = ["total_patients", "new_today", "repeat_patients", "repeat_visit_rate", "visit_trend",
            "top_symptoms", "doctor_workload", "overdue_count", "due_soon_count", "overdue", "due_soon"]
    row = stacked.groupBy().pivot("k", keys).agg(F.first("v"))
    longs = ["total_patients", "new_today", "repeat_patients", "overdue_count", "due_soon_count"]
    return row.select(*[F.col(k).cast("long").alias(k) if k in longs else
                        (F.col(k).cast("double").alias(k) if k == "repeat_visit_rate" else F.col(k)) for k in keys])
