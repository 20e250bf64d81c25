"""Per-patient results computed for every patient in one job (A-12..A-18, J-05, J-08, S-05..S-09).

No per-patient result gathers a patient's visits into one collection: counts
and "latest" picks are map-side combined aggregates, and the only windows are
keyed on (patient, day), so one very active patient is still spread over many
tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelake import schema as S
from carelake.functions.expr import age_years, as_of_lit, display_name, keyword_hit, search_text


# --- A-12 / A-13 triage --------------------------------------------------------

def _boundary_masks(text):
    """Bit masks for keywords that could straddle the space joining two visit texts:
    bit i of ``ends`` = text ends with the part before the space of keyword i,
    bit i of ``starts`` = text starts with the part after it."""
    ends, starts = F.lit(0), F.lit(0)
    for i, k in enumerate(k for k in S.HIGH_RISK_KEYWORDS if " " in k):
        head, tail = k.split(" ", 1)
        ends = ends + F.when(text.endswith(head), F.lit(1 << i)).otherwise(F.lit(0))
        starts = starts + F.when(text.startswith(tail), F.lit(1 << i)).otherwise(F.lit(0))
    return ends, starts


def symptom_keyword_flags(visits: DataFrame) -> DataFrame:
    """Per patient: does the newest-first, space-joined, lower-cased text of all visit
    symptoms contain a high-risk keyword? Computed without building the text:
    a keyword is inside one visit's text, or straddles two adjacent visits."""
    t = F.lower(F.coalesce(F.col("symptoms"), F.lit("")))
    ends, starts = _boundary_masks(t)
    v = visits.select("patient_id", "visit_date", "visit_id",
                      keyword_hit(t).alias("hit"), ends.alias("ends"), starts.alias("starts"))
    # adjacent visits on the same day (newest first => next row is the older one)
    w_day = Window.partitionBy("patient_id", "visit_date").orderBy(F.desc("visit_id"))
    within = v.withColumn("pair", (F.col("ends").bitwiseAND(
        F.coalesce(F.lead("starts").over(w_day), F.lit(0)))) != 0)
    per_day = within.groupBy("patient_id", "visit_date").agg(
        F.max(F.col("hit") | F.col("pair")).alias("hit"),
        F.max_by("starts", "visit_id").alias("newest_starts"),
        F.min_by("ends", "visit_id").alias("oldest_ends"))
    # adjacent days: oldest visit of a day followed by the newest visit of the previous day
    w_pat = Window.partitionBy("patient_id").orderBy(F.desc("visit_date"))
    days = per_day.withColumn("pair", (F.col("oldest_ends").bitwiseAND(
        F.coalesce(F.lead("newest_starts").over(w_pat), F.lit(0)))) != 0)
    return days.groupBy("patient_id").agg(F.max(F.col("hit") | F.col("pair")).alias("keyword_hit"))


def visit_summary(visits: DataFrame) -> DataFrame:
    """J-08 one-to-many side: visit count, last visit date, latest diagnosis per patient."""
    has_any = ((F.coalesce(F.col("symptoms"), F.lit("")) != "")
               | (F.coalesce(F.col("medications"), F.lit("")) != ""))
    pick = F.max_by(F.struct("symptoms", "medications"),
                    F.struct(has_any, F.col("visit_date"), F.col("visit_id")))
    return visits.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("visit_count"),
        F.max("visit_date").alias("last_visit_date"),
        pick.alias("_latest"))


def diagnosis_text(latest):
    """A-16 text: symptoms, else ``Medications: ...``, else the default sentence."""
    sym, med = latest.getField("symptoms"), latest.getField("medications")
    return (F.when(F.coalesce(sym, F.lit("")) != "", sym)
            .when(F.coalesce(med, F.lit("")) != "", F.concat(F.lit("Medications: "), med))
            .otherwise(F.lit(S.NO_DIAGNOSIS)))


def latest_diagnosis(patients: DataFrame, visits: DataFrame) -> DataFrame:
    s = visit_summary(visits).select("patient_id", "_latest")
    return (patients.select("patient_id").join(s, "patient_id", "left")
            .select("patient_id", diagnosis_text(F.col("_latest")).alias("diagnosis")))


def triage(patients: DataFrame, visits: DataFrame, as_of=None) -> DataFrame:
    """A-12: risk score, colour and reasons for every patient."""
    counts = visits.groupBy("patient_id").agg(F.count(F.lit(1)).alias("repeat_visits"))
    flags = symptom_keyword_flags(visits)
    base = (patients.select("patient_id", age_years("date_of_birth", as_of).alias("age"))
            .join(counts, "patient_id", "left").join(flags, "patient_id", "left")
            .withColumn("repeat_visits", F.coalesce("repeat_visits", F.lit(0)).cast("long"))
            .withColumn("keyword_hit", F.coalesce("keyword_hit", F.lit(False))))
    old = F.coalesce(F.col("age") >= S.TRIAGE_AGE_THRESHOLD, F.lit(False))
    n = F.col("repeat_visits")
    score = (F.when(old, 2).otherwise(0) + F.when(F.col("keyword_hit"), 3).otherwise(0)
             + F.when(n >= 3, 2).when(n >= 2, 1).otherwise(0))
    reasons = F.filter(F.array(
        F.when(old, F.lit("Age 60+")),
        F.when(F.col("keyword_hit"), F.lit("Critical symptom keyword detected")),
        F.when(n >= 3, F.lit("Frequent repeat visits")).when(n >= 2, F.lit("Multiple repeat visits")),
    ), lambda x: x.isNotNull())
    return (base.withColumn("score", score.cast("int"))
            .withColumn("risk", F.when(F.col("score") >= 4, "red").when(F.col("score") >= 2, "amber")
                        .otherwise("green"))
            .withColumn("reasons", reasons)
            .select("patient_id", "age", "repeat_visits", "score", "risk", "reasons"))


def patient_age(patients: DataFrame, as_of=None) -> DataFrame:
    return patients.select("patient_id", "date_of_birth", age_years("date_of_birth", as_of).alias("age"))


# --- J-05 / A-14 / A-15 timeline -------------------------------------------------

def _epoch_ntz():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

def audit_patient_key(audit: DataFrame, json_path: str = "$.patient_id") -> DataFrame:
    """Derive the patient an audit row belongs to (patient rows by id, visit rows by the
    JSON payload) so that the lookup is one equi-join instead of an OR-join."""
    key = (F.when(F.col("entity_type") == "patient", F.col("entity_id").cast("string"))
           .when(F.col("entity_type") == "visit", F.get_json_object("details", json_path)))
    return audit.withColumn("patient_key", key)


def audit_by_patient(patients: DataFrame, audit: DataFrame, json_path: str = "$.patient_id") -> DataFrame:
    keyed = audit_patient_key(audit, json_path).where(F.col("patient_key").isNotNull())
    ids = patients.select("patient_id", F.col("patient_id").cast("string").alias("patient_key"))
    return keyed.join(ids, "patient_key", "inner").drop("patient_key")


def timeline(patients: DataFrame, visits: DataFrame, audit: DataFrame,
             json_path: str = "$.patient_id") -> DataFrame:
    """A-14: registration, visit and audit events of every patient as rows.

    Ordering columns reproduce the newest-first order (undated first; same text
    keeps registration, then visits by date/id desc, then audits by time/id desc):
    ``orderBy('patient_id', desc('undated'), desc('event_date'), 'source_order', 'seq_date', 'seq_id')``
    with ``seq_*`` already negated for descending order.
    """
    def m(*kv):
        return F.create_map(*[x for k, v in kv for x in (F.lit(k), v)])

    reg = patients.select(
        "patient_id", F.lit("registration").alias("event_type"),
        F.date_format("registration_date", "yyyy-MM-dd").alias("event_date"),
        F.lit("Patient Registered").alias("title"),
        m(("name", display_name("first_name", "last_name", "")),
          ("phone_number", F.col("phone_number")), ("blood_group", F.col("blood_group"))).alias("details"),
        F.lit(0).alias("source_order"), F.lit(None).cast("long").alias("seq_date"),
        F.lit(None).cast("long").alias("seq_id"))
    vis = visits.join(patients.select("patient_id"), "patient_id", "left_semi").select(
        "patient_id", F.lit("visit").alias("event_type"),
        F.date_format("visit_date", "yyyy-MM-dd").alias("event_date"),
        F.concat(F.lit("Visit with Dr. "), F.coalesce(F.nullif("doctor_name", F.lit("")),
                                                      F.lit(S.UNKNOWN_DOCTOR))).alias("title"),
        m(("symptoms", F.col("symptoms")), ("medications", F.col("medications")),
          ("follow_up_date", F.date_format("follow_up_date", "yyyy-MM-dd"))).alias("details"),
        F.lit(1).alias("source_order"), (-F.unix_date("visit_date")).cast("long").alias("seq_date"),
        (-F.col("visit_id")).alias("seq_id"))
    # audit times are wall-clock values (no zone): truncate and order them without
    # converting through the session time zone
    aud = audit_by_patient(patients, audit, json_path).withColumn(
        "_at", F.timestamp_add("SECOND", F.timestamp_diff("SECOND", _epoch_ntz(), F.col("changed_at").cast("timestamp_ntz")),
                               _epoch_ntz())).select(
        "patient_id", F.lit("audit").alias("event_type"),
        F.date_format("_at", "yyyy-MM-dd HH:mm:ss").alias("event_date"),
        F.concat("entity_type", F.lit(": "), "action").alias("title"),
        m(("changed_by", F.col("changed_by")), ("payload", F.col("details"))).alias("details"),
        F.lit(2).alias("source_order"),
        (-F.timestamp_diff("MICROSECOND", _epoch_ntz(), F.col("_at"))).alias("seq_date"),
        (-F.col("audit_id")).alias("seq_id"))
    return (reg.unionByName(vis).unionByName(aud)
            .withColumn("undated", F.col("event_date").isNull()))


def timeline_order():
    return [F.col("patient_id"), F.desc("undated"), F.desc("event_date"), F.asc("source_order"),
            F.asc("seq_date"), F.asc("seq_id")]


def report_events(patients: DataFrame, visits: DataFrame, audit: DataFrame, json_path: str = "$.patient_id") -> DataFrame:
    """A-18's visits and timeline: every patient's events as rows with their ``position`` in
    ``timeline_order`` (1 is the newest), so that no patient is one giant cell."""
    place = Window.partitionBy("patient_id").orderBy(*timeline_order()[1:])
    return timeline(patients, visits, audit, json_path).withColumn("position", F.row_number().over(place))


# --- A-17 name search --------------------------------------------------------------

def name_match_candidates(patients: DataFrame) -> DataFrame:
    return patients.select(
        "patient_id",
        search_text("first_name").alias("n_first"),
        search_text("last_name").alias("n_last"),
        search_text(F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "),
                             F.coalesce("last_name", F.lit("")))).alias("n_full"))


def resolve_search(terms: DataFrame, matches: DataFrame) -> DataFrame:
    """Per search term: status (found / ambiguous / not_found), chosen patient, match count.
    ``matches`` holds (term, n, any_id, exact_id)."""
    j = terms.select("term").join(matches, "term", "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    status = (F.when(n == 0, "not_found").when(n == 1, "found")
              .when(F.col("exact_id").isNotNull(), "found").otherwise("ambiguous"))
    chosen = F.when(n == 1, F.col("any_id")).when(n > 1, F.col("exact_id"))
    return j.select("term", n.alias("match_count"), status.alias("status"), chosen.alias("patient_id"))


# --- A-18 report, S-05..S-09 lookups ---------------------------------------------------

def patient_report(patients: DataFrame, visits: DataFrame, audit: DataFrame | None = None,
                   as_of=None, json_path: str = "$.patient_id") -> DataFrame:
    """One flat row per patient: profile, age, visit count, last visit, diagnosis, audit count."""
    s = visit_summary(visits)
    out = (patients.join(s, "patient_id", "left")
           .withColumn("visit_count", F.coalesce("visit_count", F.lit(0)).cast("long"))
           .withColumn("diagnosis", diagnosis_text(F.col("_latest")))
           .withColumn("age", age_years("date_of_birth", as_of))
           .withColumn("display_name", display_name("first_name", "last_name"))
           .withColumn("registered_on", F.coalesce(F.date_format("registration_date", "MMMM d, yyyy"),
                                                   F.lit("N/A")))
           .drop("_latest"))
    if audit is not None:
        ac = (audit_by_patient(patients.select("patient_id"), audit, json_path)
              .groupBy("patient_id").agg(F.count(F.lit(1)).alias("audit_count")))
        out = (out.join(ac, "patient_id", "left")
               .withColumn("audit_count", F.coalesce("audit_count", F.lit(0)).cast("long")))
    return out


def lookup_patients(patients: DataFrame, ids: DataFrame, id_col: str = "patient_id") -> DataFrame:
    """S-06 set form: the patients whose id is in ``ids`` (semi join)."""
    return patients.join(ids.select(F.col(id_col).alias("patient_id")).distinct(), "patient_id", "left_semi")


def visits_of(visits: DataFrame, ids: DataFrame, id_col: str = "patient_id") -> DataFrame:
    """S-07: visits of the given patients; present with ``orderBy(patient_id, desc(visit_date), desc(visit_id))``."""
    return visits.join(ids.select(F.col(id_col).alias("patient_id")).distinct(), "patient_id", "left_semi")


def first_rows(df: DataFrame, n: int, order_col: str, columns=None) -> DataFrame:
    """S-08 / S-09 previews (top-n by an order column: TakeOrderedAndProject)."""
    out = df.orderBy(order_col).limit(n)
    return out.select(*columns) if columns else out
