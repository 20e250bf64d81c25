"""Registered queries for the overview analytics (A-01..A-10, J-01, J-07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.operators import analytics as A
from carelake.plans.registry import register, sql
from carelake.sources.fixtures import FIXTURE_AS_OF as AS_OF, FIXTURE_AS_OF_SQL as AS_OF_SQL, fixture

# DuckDB has no initcap: capitalise each space-separated word of lower-cased text.
_SYMPTOM_SQL = ("array_to_string(list_transform(string_split(regexp_replace(regexp_replace(lower(tok), "
                "'^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')")

_TREND_CTE = f"""
cal AS (SELECT CAST(d AS DATE) AS visit_day
        FROM generate_series(CAST({AS_OF_SQL} - INTERVAL 6 DAY AS DATE), {AS_OF_SQL}, INTERVAL 1 DAY) t(d)),
cnt AS (SELECT visit_date AS visit_day, count(*) AS n FROM visits
        WHERE visit_date >= CAST({AS_OF_SQL} - INTERVAL 6 DAY AS DATE) AND visit_date <= {AS_OF_SQL}
        GROUP BY visit_date),
trend AS (SELECT cal.visit_day, strftime(cal.visit_day, '%a') AS label,
                 CAST(coalesce(cnt.n, 0) AS BIGINT) AS visit_count
          FROM cal LEFT JOIN cnt ON cnt.visit_day = cal.visit_day)
"""

_FOLLOW_UP_CTE = f"""
fu AS (SELECT v.visit_id, v.patient_id,
              coalesce(nullif(p.first_name || ' ' || p.last_name, ''), 'Unknown patient') AS patient_name,
              coalesce(nullif(v.doctor_name, ''), 'Unknown') AS doctor_name,
              v.follow_up_date,
              CAST(v.follow_up_date - {AS_OF_SQL} AS INTEGER) AS days_until_follow_up
       FROM visits v LEFT JOIN patients p ON p.patient_id = v.patient_id
       WHERE v.follow_up_date IS NOT NULL),
fb AS (SELECT *, CASE WHEN days_until_follow_up < 0 THEN 'overdue'
                      WHEN days_until_follow_up <= 7 THEN 'due_soon' END AS bucket FROM fu)
"""

_STATUS_SQL = """CASE WHEN days_until_follow_up < 0 THEN
  CASE WHEN days_until_follow_up = -1 THEN 'Overdue by 1 day'
       ELSE 'Overdue by ' || CAST(-days_until_follow_up AS VARCHAR) || ' days' END
 WHEN days_until_follow_up = 0 THEN 'Due today'
 WHEN days_until_follow_up = 1 THEN 'Due in 1 day'
 ELSE 'Due in ' || CAST(days_until_follow_up AS VARCHAR) || ' days' END"""


def _pv(spark, sf):
    return fixture(spark, sf, "patients"), fixture(spark, sf, "visits")


@register("overview_counts", sql(("patients",), f"""
SELECT CAST(count(*) AS BIGINT) AS total_patients,
       CAST(count_if(registration_date = {AS_OF_SQL}) AS BIGINT) AS new_today
FROM patients"""), "A-01")
def overview_counts(spark, sf):
    return A.overview_counts(fixture(spark, sf, "patients"), AS_OF)


@register("repeat_patients", sql(("visits",), """
SELECT CAST(count(*) AS BIGINT) AS repeat_patients
FROM (SELECT patient_id FROM visits GROUP BY patient_id HAVING count(*) >= 2) r"""), "A-02")
def repeat_patients(spark, sf):
    return A.repeat_patients(fixture(spark, sf, "visits"))


@register("repeat_visit_rate", sql(("patients", "visits"), f"""
SELECT t.total_patients, t.new_today, r.repeat_patients,
       CASE WHEN t.total_patients > 0
            THEN round_even(r.repeat_patients / t.total_patients * 100.0, 1) ELSE 0.0 END AS repeat_visit_rate
FROM (SELECT CAST(count(*) AS BIGINT) AS total_patients,
             CAST(count_if(registration_date = {AS_OF_SQL}) AS BIGINT) AS new_today FROM patients) t,
     (SELECT CAST(count(*) AS BIGINT) AS repeat_patients
      FROM (SELECT patient_id FROM visits GROUP BY patient_id HAVING count(*) >= 2) x) r"""), "A-01,A-02,A-03")
def repeat_visit_rate(spark, sf):
    p, v = _pv(spark, sf)
    return A.repeat_visit_rate(p, v, AS_OF)


@register("visit_trend_7d", sql(("visits",), "SELECT visit_day, label, visit_count FROM trend",
                                _TREND_CTE), "A-04,J-07")
def visit_trend_7d(spark, sf):
    return A.visit_trend(fixture(spark, sf, "visits"), AS_OF)


@register("visit_trend_weekday", sql(("visits",), """
SELECT o.day_order, o.label, CAST(coalesce(s.visits, 0) AS BIGINT) AS visits
FROM (VALUES (0, 'Sun'), (1, 'Mon'), (2, 'Tue'), (3, 'Wed'), (4, 'Thu'), (5, 'Fri'), (6, 'Sat')) o(day_order, label)
LEFT JOIN (SELECT label, sum(visit_count) AS visits FROM trend GROUP BY label) s ON s.label = o.label""",
    _TREND_CTE), "A-05")
def visit_trend_weekday(spark, sf):
    return A.visit_trend_weekday(A.visit_trend(fixture(spark, sf, "visits"), AS_OF))


@register("trend_bar_scale", sql(("visits",), """
SELECT visit_day, label, visit_count,
       CAST(greatest(6, round(visit_count / (SELECT greatest(max(visit_count), 1) FROM trend) * 100.0)) AS INTEGER) AS bar_pct
FROM trend""", _TREND_CTE), "A-06")
def trend_bar_scale(spark, sf):
    return A.trend_bar_scale(A.visit_trend(fixture(spark, sf, "visits"), AS_OF))


@register("top_symptoms", sql(("visits",), f"""
SELECT symptom, CAST(count(*) AS BIGINT) AS symptom_count
FROM (SELECT {_SYMPTOM_SQL} AS symptom
      FROM (SELECT unnest(regexp_split_to_array(symptoms, '[/;,]')) AS tok
            FROM visits WHERE symptoms IS NOT NULL AND trim(symptoms) <> '') t) s
WHERE symptom <> ''
GROUP BY symptom ORDER BY symptom_count DESC, symptom ASC LIMIT 5"""), "A-07,X-05,X-06")
def top_symptoms(spark, sf):
    return A.top_symptoms(fixture(spark, sf, "visits"))


@register("symptom_counts", sql(("visits",), f"""
SELECT symptom, CAST(count(*) AS BIGINT) AS symptom_count
FROM (SELECT {_SYMPTOM_SQL} AS symptom
      FROM (SELECT unnest(regexp_split_to_array(symptoms, '[/;,]')) AS tok
            FROM visits WHERE symptoms IS NOT NULL AND trim(symptoms) <> '') t) s
WHERE symptom <> '' GROUP BY symptom"""), "A-07")
def symptom_counts(spark, sf):
    return A.symptom_counts(fixture(spark, sf, "visits"))


@register("doctor_workload", sql(("visits",), """
SELECT doctor_name, CAST(count(*) AS BIGINT) AS visit_count FROM visits
WHERE doctor_name IS NOT NULL AND trim(doctor_name) <> ''
GROUP BY doctor_name ORDER BY visit_count DESC, doctor_name ASC LIMIT 5"""), "A-08,X-02")
def doctor_workload(spark, sf):
    return A.doctor_workload(fixture(spark, sf, "visits"))


@register("doctor_workload_ci", sql(("visits",), """
SELECT min(doctor_name) AS doctor_name, CAST(count(*) AS BIGINT) AS visit_count FROM visits
WHERE doctor_name IS NOT NULL AND trim(doctor_name) <> ''
GROUP BY strip_accents(lower(doctor_name)) ORDER BY visit_count DESC, doctor_name ASC LIMIT 5"""), "A-08,T12")
def doctor_workload_ci(spark, sf):
    return A.doctor_workload(fixture(spark, sf, "visits"), collation="UNICODE_CI_AI")


@register("follow_up_reminders", sql(("patients", "visits"), f"""
SELECT bucket, CAST(rank AS INTEGER) AS rank, visit_id, patient_id, patient_name, doctor_name,
       follow_up_date, days_until_follow_up, {_STATUS_SQL} AS status
FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY follow_up_date ASC, visit_id DESC) AS rank
      FROM fb WHERE bucket IS NOT NULL) x
WHERE rank <= 5""", _FOLLOW_UP_CTE), "A-09,A-10,J-01,O-03")
def follow_up_reminders(spark, sf):
    p, v = _pv(spark, sf)
    return (A.follow_up_reminders(A.follow_up_rows(v, None, AS_OF), patients=p)
            .select("bucket", F.col("rank").cast("int").alias("rank"), "visit_id", "patient_id",
                    "patient_name", "doctor_name", "follow_up_date", "days_until_follow_up", "status"))


@register("follow_up_counts", sql(("patients", "visits"), """
SELECT CAST(count_if(bucket = 'overdue') AS BIGINT) AS overdue_count,
       CAST(count_if(bucket = 'due_soon') AS BIGINT) AS due_soon_count FROM fb""", _FOLLOW_UP_CTE), "A-09")
def follow_up_counts(spark, sf):
    p, v = _pv(spark, sf)
    return A.follow_up_counts(A.follow_up_rows(v, None, AS_OF))


@register("follow_up_status", sql(("patients", "visits"), f"""
SELECT visit_id, patient_id, patient_name, follow_up_date, days_until_follow_up, {_STATUS_SQL} AS status
FROM fb""", _FOLLOW_UP_CTE), "A-10,J-01,X-01")
def follow_up_status(spark, sf):
    p, v = _pv(spark, sf)
    return (A.with_follow_up_status(A.follow_up_rows(v, p, AS_OF))
            .select("visit_id", "patient_id", "patient_name", "follow_up_date",
                    "days_until_follow_up", "status"))


@register("overview_bundle", sql(("patients", "visits"), f"""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM patients) AS total_patients,
       (SELECT CAST(count_if(registration_date = {AS_OF_SQL}) AS BIGINT) FROM patients) AS new_today,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT patient_id FROM visits GROUP BY patient_id HAVING count(*) >= 2) r) AS repeat_patients,
       (SELECT CASE WHEN count(*) > 0 THEN round_even((SELECT count(*) FROM (SELECT patient_id FROM visits GROUP BY patient_id HAVING count(*) >= 2) r) / count(*) * 100.0, 1) ELSE 0.0 END FROM patients) AS repeat_visit_rate,
       (SELECT string_agg(strftime(visit_day, '%Y-%m-%d') || ':' || CAST(visit_count AS VARCHAR), '; ' ORDER BY visit_day) FROM trend) AS visit_trend,
       (SELECT string_agg(symptom || ':' || CAST(symptom_count AS VARCHAR), '; ' ORDER BY symptom_count DESC, symptom) FROM ts) AS top_symptoms,
       (SELECT string_agg(doctor_name || ':' || CAST(visit_count AS VARCHAR), '; ' ORDER BY visit_count DESC, doctor_name) FROM dw) AS doctor_workload,
       (SELECT CAST(count_if(bucket = 'overdue') AS BIGINT) FROM fb) AS overdue_count,
       (SELECT CAST(count_if(bucket = 'due_soon') AS BIGINT) FROM fb) AS due_soon_count,
       (SELECT string_agg(t, '; ' ORDER BY rank) FROM rem WHERE bucket = 'overdue') AS overdue,
       (SELECT string_agg(t, '; ' ORDER BY rank) FROM rem WHERE bucket = 'due_soon') AS due_soon""",
    _TREND_CTE.rstrip() + ",\n" + _FOLLOW_UP_CTE.strip() + f""",
rem AS (SELECT bucket, rank, CAST(visit_id AS VARCHAR) || ':' || patient_name || ':' || {_STATUS_SQL} AS t
        FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY follow_up_date ASC, visit_id DESC) AS rank
              FROM fb WHERE bucket IS NOT NULL) x WHERE rank <= 5),
ts AS (SELECT symptom, count(*) AS symptom_count
       FROM (SELECT {_SYMPTOM_SQL} AS symptom
             FROM (SELECT unnest(regexp_split_to_array(symptoms, '[/;,]')) AS tok
                   FROM visits WHERE symptoms IS NOT NULL AND trim(symptoms) <> '') t) s
       WHERE symptom <> '' GROUP BY symptom ORDER BY symptom_count DESC, symptom ASC LIMIT 5),
dw AS (SELECT doctor_name, count(*) AS visit_count FROM visits
       WHERE doctor_name IS NOT NULL AND trim(doctor_name) <> ''
       GROUP BY doctor_name ORDER BY visit_count DESC, doctor_name ASC LIMIT 5)"""), "A-11")
def overview_bundle(spark, sf):
    p, v = _pv(spark, sf)
    return A.overview_row(p, v, AS_OF)
