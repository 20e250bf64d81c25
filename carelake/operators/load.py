"""Loading with key checks (K-01..K-07, J-02..J-06).

Spark tables have no unique constraints, so the database's INSERT IGNORE and
foreign-key behaviour is expressed as joins:

* collisions with stored rows: the keys of all kinds, in long form, meet in one join (J-06);
* collisions inside the batch, exact row-by-row semantics: rows whose keys are all unique are
  accepted at once. What clashes is narrow (order, keys) and decided in parallel greedy
  rounds (accept every row that is the earliest remaining row on all of its keys, drop rows
  that share a key with an accepted row, repeat); once few enough rows are left for one task,
  that task walks through them in order, which decides chains of any length;
* look-ups: frequent keys of the row side are found by a bounded sketch, their rows stay where
  they are and meet the few values by broadcast;
* new surrogate ids: ``max(existing) + dense position`` (see numbering).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake import schema as S
from carelake.operators import clean as C
from carelake.session import cut_lineage
from carelake.sources.numbering import with_row_index

PATIENT_KEYS = ("phone_number", "email")
CLI_KEYS = ("patient_id", "phone_number", "email")
#: Clashing rows that one task decides by walking through them (some 20 MB).
WALK_ROWS = 200_000
#: A key is frequent when it holds at least this share of the rows; at most 1 / share keys do.
FREQUENT = 1 / 200
#: Fewer rows than this are no burden to one task, whatever their keys.
SKEW_ROWS = 10_000


def _present(c):
    return F.col(c).isNotNull()


def frequent_by_kind(rows: DataFrame, keys) -> dict[str, list]:
    """Of every key column, the values that hold at least ``FREQUENT`` of the rows, from
    sketches of bounded size (they overlook none). At most a few hundred values a column
    reach the driver."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[
        F.expr(f"approx_top_k({k}, 400, 8192) FILTER (WHERE {k} IS NOT NULL)").alias(f"top_{k}") for k in keys]).first()
    least = max(2, FREQUENT * found["n"])
    return {k: [t["item"] for t in found[f"top_{k}"] or [] if t["count"] >= least] if found["n"] >= SKEW_ROWS else [] for k in keys}


def frequent_keys(rows: DataFrame, key: str) -> list:
    return frequent_by_kind(rows, [key])[key]


def _join_key(df: DataFrame, key: str, salt: str, apart=None):
    """``key``, or where it is null (or the row is set ``apart``) a value of the row's own that
    no stored key equals, so that such rows spread over all partitions and match nothing."""
    own = F.xxhash64(F.lit(key), F.col(salt))
    value = F.col(key) if apart is None else F.when(~apart, F.col(key))
    if df.schema[key].dataType.simpleString() == "string":
        return F.coalesce(value, F.concat(F.lit("\u0000"), own.cast("string")))
    return F.coalesce(value.cast("long"), -F.abs(own) - 1)


def look_up(rows: DataFrame, lookup: DataFrame, key: str, value, out: str, salt: str = "row_id",
            frequent: list | None = None) -> DataFrame:
    """``rows`` with ``out``: ``value`` (an aggregate) of the ``lookup`` rows with the same
    ``key``, null without a match. One row per key, so nothing multiplies. Rows with one of
    the ``frequent`` keys get the value by broadcast and are not gathered by their key."""
    found = lookup.where(_present(key)).groupBy(F.col(key).alias("_found")).agg(value.alias(out))
    if not frequent:
        return rows.withColumn("_sought", _join_key(rows, key, salt)).join(
            found, F.col("_sought") == F.col("_found"), "left").drop("_sought", "_found")
    often = F.coalesce(F.col(key).isin(frequent), F.lit(False))
    few = found.where(F.col("_found").isin(frequent)).select(F.col("_found").alias("_often"), F.col(out).alias("_often_value"))
    rest = found.where(~F.col("_found").isin(frequent))
    return (rows.withColumn("_sought", _join_key(rows, key, salt, often))
            .join(F.broadcast(few), F.when(often, F.col(key)) == F.col("_often"), "left")
            .join(rest, F.col("_sought") == F.col("_found"), "left")
            .withColumn(out, F.coalesce(F.col(out), F.col("_often_value")))
            .drop("_sought", "_found", "_often", "_often_value"))


def long_keys(rows: DataFrame, keys, *kept, prefix=None) -> DataFrame:
    """(kept..., _key): one row per key that is not null, named by its kind."""
    parts = [F.when(_present(k), F.concat(F.lit(f"{prefix[k] if prefix else k}:"), F.col(k).cast("string"))) for k in keys]
    return rows.select(*kept, F.explode(F.array_compact(F.array(*parts))).alias("_key"))


def colliding(batch: DataFrame, stored: DataFrame, keys=PATIENT_KEYS, order_col: str = "row_id") -> DataFrame:
    """``order_col`` of the rows of ``batch`` (a written table) with a key that is ``stored``
    (in long form)."""
    sought = long_keys(batch, keys, F.col(order_col).alias("_o"))
    hits = look_up(sought, stored, "_key", F.min(F.lit(1)), "_hit", "_o", frequent_keys(sought, "_key"))
    return hits.where("_hit IS NOT NULL").select(F.col("_o").alias(order_col)).distinct()


def anti_existing(batch: DataFrame, existing: DataFrame, keys=PATIENT_KEYS, order_col: str = "row_id") -> DataFrame:
    """Rows of ``batch`` whose non-null keys collide with no stored row (J-06). Both sides are
    read once."""
    batch = cut_lineage(batch)
    return batch.join(colliding(batch, long_keys(existing, keys), keys, order_col), order_col, "left_anti")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's sequential INSERT IGNORE over (order, key) rows: the refused orders. Keys
    without an order are taken from the start."""
    keys_of: dict[int, list] = {}
    taken = set()
    for b in batches:
        for order, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if order is None:
                taken.add(key)
            else:
                keys_of.setdefault(order, []).append(key)
    refused = []
    for order in sorted(keys_of):
        if taken.isdisjoint(keys_of[order]):
            taken.update(keys_of[order])
        else:
            refused.append(order)
    yield pa.RecordBatch.from_pydict({"_o": pa.array(refused, pa.int64())})


def _walked(rows: DataFrame, keys, order_col: str, stored: DataFrame | None = None) -> DataFrame:
    """The refused of few rows (and few stored keys), decided by one task."""
    long = long_keys(rows, keys, F.col(order_col).cast("long").alias("_o"))
    if stored is not None:
        long = long.unionByName(stored.select(F.lit(None).cast("long").alias("_o"), "_key"))
    walk = lambda batches: _walk(batches)  # noqa: E731  (travels by value)
    return cut_lineage(long.coalesce(1).mapInArrow(walk, "_o long"))


def _clashing(rows: DataFrame, keys, frequent: dict) -> DataFrame:
    """The rows that share a key with another one."""
    todo, clash = rows, F.lit(False)
    for k in keys:
        todo = look_up(todo, rows, k, F.count(F.lit(1)), f"_n_{k}", "_o", frequent[k])
        clash = clash | F.coalesce(F.col(f"_n_{k}") > 1, F.lit(False))
    return todo.where(clash).select("_o", *keys)


def _round(todo: DataFrame, keys, frequent: dict) -> tuple[DataFrame, DataFrame]:
    """(refused, undecided) after one greedy round over ``todo``."""
    firsts, first = todo, F.lit(True)
    for k in keys:
        firsts = look_up(firsts, todo, k, F.min("_o"), f"_min_{k}", "_o", frequent[k])
        first = first & (F.col(f"_min_{k}").isNull() | (F.col(f"_min_{k}") == F.col("_o")))
    judged = cut_lineage(firsts.select("_o", *keys, first.alias("_won")))
    winners, rest, lost = judged.where("_won"), judged.where("NOT _won").drop("_won"), F.lit(False)
    for k in keys:
        rest = look_up(rest, winners, k, F.count(F.lit(1)), f"_lost_{k}", "_o", frequent[k])
        lost = lost | F.col(f"_lost_{k}").isNotNull()
    rest = cut_lineage(rest.select("_o", *keys, lost.alias("_lost")))
    return rest.where("_lost").select("_o"), rest.where("NOT _lost").drop("_lost")


def rejected_in_batch(batch: DataFrame, keys=PATIENT_KEYS, order_col: str = "row_id", walk_rows: int | None = None) -> DataFrame:
    """``order_col`` of the rows that sequential insert-ignore inside one batch refuses.

    A row is accepted iff no earlier accepted row shares one of its keys (nulls never clash).
    Every round settles at least the earliest undecided row of every chain; the last
    ``walk_rows`` undecided rows (or all, where there are no more) are settled by one task."""
    walk_rows = WALK_ROWS if walk_rows is None else walk_rows
    order = F.coalesce(F.col(order_col), F.raise_error(F.lit(f"{order_col} must not be null")).cast("long"))
    rows = cut_lineage(batch.select(order.cast("long").alias("_o"), *keys))
    if rows.count() <= walk_rows:
        return _walked(rows, keys, "_o").withColumnRenamed("_o", order_col)
    frequent = frequent_by_kind(rows, keys)
    todo = cut_lineage(_clashing(rows, keys, frequent))
    refused, left = [], todo.count()
    while left > walk_rows:
        out, todo = _round(todo, keys, frequent)
        refused.append(out)
        left = todo.count()
    if left:
        refused.append(_walked(todo, keys, "_o"))
    found = refused[0] if refused else todo.select("_o").limit(0)
    for more in refused[1:]:
        found = found.unionByName(more)
    return found.withColumnRenamed("_o", order_col)


def resolve_in_batch(batch: DataFrame, keys=PATIENT_KEYS, order_col: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Exact sequential insert-ignore inside one batch: (accepted, rejected)."""
    batch = cut_lineage(batch)
    out = rejected_in_batch(batch, keys, order_col)
    return batch.join(out, order_col, "left_anti"), batch.join(out, order_col, "left_semi")


def top_id(existing: DataFrame, id_col: str) -> int:
    """The largest stored id, 0 where there is none."""
    return existing.agg(F.max(id_col)).first()[0] or 0


def assign_ids(rows: DataFrame, existing: DataFrame | None, id_col: str, order_col: str = "row_id",
               top: int | None = None, n: int | None = None) -> DataFrame:
    """New ids continuing after the largest stored id (or ``top``), in ``order_col`` order.
    ``n``: the number of rows, at most, where it is known."""
    top = top_id(existing, id_col) if top is None else top
    return with_row_index(rows.drop(id_col) if id_col in rows.columns else rows, order_col, id_col, top + 1, n)


def assign_missing_ids(rows: DataFrame, existing: DataFrame, id_col: str, order_col: str = "row_id", n: int | None = None) -> DataFrame:
    """Ids that rows (a written table) bring are kept; the others continue after the largest
    known id."""
    top = top_id(existing.select(id_col).unionByName(rows.select(id_col)), id_col)
    given = rows.where(_present(id_col))
    made = assign_ids(rows.where(~_present(id_col)), None, id_col, order_col, top, n)
    return given.unionByName(made.select(*given.columns))


def insert_ignore(batch: DataFrame, existing: DataFrame, keys=PATIENT_KEYS, exact: bool = False,
                  order_col: str = "row_id") -> DataFrame:
    """K-01: rows that an INSERT IGNORE of ``batch`` (in ``order_col`` order) would add.

    ``exact=False`` assumes the batch is already unique on every key (the cleaning
    pipelines guarantee this); ``exact=True`` resolves in-batch clashes row by row. With
    ``patient_id`` among the keys, ids that rows bring are kept."""
    fresh = cut_lineage(anti_existing(batch, existing, keys, order_col))
    n = fresh.count()
    if exact:
        fresh = fresh.join(rejected_in_batch(fresh, keys, order_col), order_col, "left_anti")
    if "patient_id" not in keys:
        return assign_ids(fresh, existing, "patient_id", order_col, n=n)
    return assign_missing_ids(cut_lineage(fresh), existing, "patient_id", order_col, n)


# --- registration rules (V-08, K-03, K-04) ------------------------------------------------

def joined_reasons(checks):
    """The messages of the checks that fail, or null."""
    return F.nullif(F.concat_ws("; ", *checks), F.lit(""))


def length_check(field: str):
    low, high = S.FIELD_LENGTH_BOUNDS[field]
    return F.when(~F.length(field).between(low, high), F.lit(f"{field} length must be between {low} and {high}"))


def patient_rule_checks(rows: DataFrame):
    """Presence of names and phone, and all length bounds."""
    missing = (("first_name", S.MSG_MISSING_FIRST), ("last_name", S.MSG_MISSING_LAST), ("phone_number", S.MSG_MISSING_PHONE))
    return [*[F.when(F.col(c).isNull(), F.lit(m)) for c, m in missing],
            *[length_check(c) for c in S.FIELD_LENGTH_BOUNDS if c in rows.columns and c != "doctor_name"]]


def visit_rule_checks():
    return [F.when(F.col("patient_id").isNull(), F.lit(S.MSG_UNRESOLVED_PATIENT)),
            F.when(F.col("doctor_name").isNull(), F.lit(S.MSG_MISSING_DOCTOR)), length_check("doctor_name"),
            F.when(F.col("visit_date").isNull(), F.lit(S.MSG_BAD_VISIT_DATE))]


def register_patients(batch: DataFrame, existing: DataFrame, as_of=None,
                      keys=PATIENT_KEYS, order_col: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """K-03: registrations dated ``as_of``; rows that break a rule are rejected with it, and
    of clashing ones the first wins."""
    from carelake.functions.expr import as_of_lit
    dated = batch.withColumn("registration_date", as_of_lit(as_of)).withColumn(
        "reason", joined_reasons(patient_rule_checks(batch)))
    judged = cut_lineage(dated.select(*batch.columns, *[c for c in ("registration_date",) if c not in batch.columns], "reason"))
    n = judged.count()
    ok, clashing = first_wins(judged.where("reason IS NULL").drop("reason"), long_keys(existing, keys), keys, order_col)
    rejected = judged.where("reason IS NOT NULL").unionByName(
        clashing.withColumn("reason", F.lit(S.MSG_DUPLICATE_VALUE)).select(*judged.columns))
    return assign_ids(ok, existing, "patient_id", order_col, n=n), rejected


def first_wins(rows: DataFrame, stored: DataFrame, keys=PATIENT_KEYS, order_col: str = "row_id",
               n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of ``rows`` (a written table) against stored keys (in long form)
    and each other. ``n``: how many rows and stored keys there are, where that is known; few
    are decided by one task."""
    if n is not None and n <= WALK_ROWS:
        gone = _walked(rows, keys, order_col, stored).withColumnRenamed("_o", order_col)
    else:
        taken = cut_lineage(colliding(rows, stored, keys, order_col))
        free = rows.join(taken, order_col, "left_anti")
        gone = cut_lineage(taken.unionByName(rejected_in_batch(free, keys, order_col)))
    return rows.join(gone, order_col, "left_anti"), rows.join(gone, order_col, "left_semi")


def _to_second(ts):
    """Truncate a zone-free timestamp to whole seconds without passing through a time zone."""
    return F.timestamp_add("SECOND", F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts),
                           F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def audit_details(inserted: DataFrame, entity_type: str, id_col: str, detail_cols, action: str = "create",
                  changed_by: str = "system", changed_at=None) -> list:
    """The columns of an audit row but for its id; details are the JSON of the chosen fields."""
    details = F.to_json(F.create_map(*[x for c in detail_cols for x in (F.lit(c), F.col(c).cast("string"))]))
    # wall-clock time without a zone: a naive datetime/text is taken as written
    if changed_at is None:
        ts = F.localtimestamp()
    else:
        text = changed_at.isoformat(sep=" ") if hasattr(changed_at, "isoformat") else str(changed_at)
        ts = F.lit(text).cast("timestamp_ntz")
    return [F.lit(entity_type).alias("entity_type"), F.col(id_col).cast("long").alias("entity_id"),
            F.lit(action).alias("action"), F.lit(changed_by).alias("changed_by"),
            _to_second(ts).alias("changed_at"), details.alias("details")]


def audit_of_dense(inserted: DataFrame, first_id: int, audit_id: int, entity_type: str, id_col: str, detail_cols, **options) -> DataFrame:
    """K-05 for rows whose ids are dense from ``first_id``: audit ids run along from
    ``audit_id``, without another sort."""
    return inserted.select((F.col(id_col) - F.lit(first_id) + F.lit(audit_id)).cast("long").alias("audit_id"),
                           *audit_details(inserted, entity_type, id_col, detail_cols, **options))


def audit_rows(inserted: DataFrame, existing_audit: DataFrame, entity_type: str, id_col: str, detail_cols,
               action: str = "create", changed_by: str = "system", changed_at=None, order_col: str = "row_id") -> DataFrame:
    """K-05: one audit row per inserted entity, numbered in ``order_col`` order."""
    rows = inserted.select(F.col(order_col).alias("_order"),
                           *audit_details(inserted, entity_type, id_col, detail_cols, action, changed_by, changed_at))
    return assign_ids(rows, existing_audit, "audit_id", "_order", n=inserted.count()).select(*S.AUDIT_COLUMNS)


# --- visits: J-02..J-04, K-02, K-04 --------------------------------------------------

def match_visits(visits: DataFrame, patients: DataFrame, order_col: str = "row_id") -> DataFrame:
    """``visits`` with ``patient_id``, ``resolved_by`` and ``_stored``: a given id is looked for
    as it is; a missing one is filled from the phone number, then from the e-mail, where the
    smallest id of several patients is taken (O-04). All probes of a visit, in long form, meet
    the stored keys of all kinds in one join; the visits themselves are joined once."""
    probes = F.when(_present("patient_id"), F.array(F.struct(F.lit(0).alias("turn"), F.concat(F.lit("id:"), F.col("patient_id").cast("string")).alias("key")))) \
        .otherwise(F.array(*[F.struct(F.lit(turn).alias("turn"), F.concat(F.lit(f"{kind}:"), F.col(c)).alias("key"))
                             for turn, (kind, c) in enumerate((("phone", "phone_number"), ("email", "email")), 1)]))
    visits = cut_lineage(visits)
    sought = (visits.select(F.col(order_col).alias("_o"), F.explode(probes).alias("_p"))
              .select("_o", F.col("_p.turn").alias("_turn"), F.col("_p.key").alias("_key")).where(_present("_key")))
    kinds = {"patient_id": "id", "phone_number": "phone", "email": "email"}
    stored = long_keys(patients, list(kinds), F.col("patient_id").alias("_pid"), prefix=kinds)
    hits = look_up(sought, stored, "_key", F.min("_pid"), "_pid", "_o", frequent_keys(sought, "_key")).where(_present("_pid"))
    best = hits.groupBy("_o").agg(F.min(F.struct("_turn", "_pid")).alias("_best"))
    joined = visits.join(best, F.col(order_col) == F.col("_o"), "left")
    given = _present("patient_id")
    by = (F.when(given, "id").when(F.col("_best._turn") == 1, "phone").when(F.col("_best._turn") == 2, "email"))
    return (joined.withColumns({"resolved_by": by, "patient_id": F.coalesce("patient_id", F.col("_best._pid")),
                                "_stored": F.col("_best").isNotNull()}).drop("_o", "_best"))


def resolve_visit_patients(visits: DataFrame, patients: DataFrame, order_col: str = "row_id") -> DataFrame:
    """J-02, J-03: visits with their patient and how it was found."""
    return match_visits(visits, patients, order_col).drop("_stored")


def visit_reason(stored="_stored"):
    """Why a visit cannot be stored, or null (J-04)."""
    return (F.when(F.col("patient_id").isNull(), F.lit(S.MSG_UNRESOLVED_PATIENT))
            .when(~F.col(stored), F.lit(S.MSG_UNKNOWN_PATIENT))
            .when(F.col("doctor_name").isNull(), F.lit(S.MSG_MISSING_DOCTOR))
            .otherwise(length_check("doctor_name")))


def judge_visits(visits: DataFrame, patients: DataFrame, order_col: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """J-02..J-04 in one pass: (visits that can be stored, rejected visits with a reason)."""
    judged = cut_lineage(match_visits(visits, patients, order_col).withColumn("reason", visit_reason()).drop("_stored"))
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def split_foreign_key(resolved: DataFrame, patients: DataFrame, order_col: str = "row_id", written: bool = False,
                      n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """J-04 of visits whose patient is resolved already: the patient must be stored and the
    doctor given, within the length bound. One join and a flag. ``written``: the visits come
    from a written table and need no copy; ``n``: how many there are, where it is known."""
    resolved = resolved if written else cut_lineage(resolved)
    n = resolved.count() if n is None else n
    frequent = frequent_keys(resolved, "patient_id") if n >= SKEW_ROWS else []
    checked = look_up(resolved, patients.select("patient_id"), "patient_id", F.min(F.lit(1)), "_known", order_col, frequent)
    judged = cut_lineage(checked.withColumn("_known", _present("_known")).withColumn("reason", visit_reason("_known")).drop("_known"))
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def append_visits(accepted: DataFrame, existing_visits: DataFrame, order_col: str = "row_id") -> DataFrame:
    """K-02 / K-04: accepted visits with new visit ids, in stored column order (+ order column)."""
    with_ids = assign_ids(accepted, existing_visits, "visit_id", order_col, n=accepted.count())
    return with_ids.select(order_col, *S.VISIT_COLUMNS)


# --- K-07 --------------------------------------------------------------------------------

#: Where a row of an import leaves, in order; rows that leave nowhere are inserted.
IMPORT_STAGES = ("invalid", "duplicate_phone", "duplicate_email", "stored")


def import_stages(raw: DataFrame, stored: DataFrame, as_of=None, order_col: str = "row_id") -> DataFrame:
    """K-07: every row of ``raw``, cleaned, with ``left_at``: the stage of ``IMPORT_STAGES`` at
    which it leaves the import, or null. ``stored`` holds the stored keys in long form.

    The input is read once. The stages are decided over its narrow keys: two look-ups of the
    first row of a key, and one of the stored keys; one join puts them together."""
    cleaned = cut_lineage(C.clean_with_verdict(raw, as_of))
    open_ = cleaned.where("_importable").select(F.col(order_col).alias("_o"), *PATIENT_KEYS)
    gone = []
    for stage, key in (("duplicate_phone", "phone_number"), ("duplicate_email", "email")):
        first = look_up(open_, open_, key, F.min("_o"), "_first", "_o", frequent_keys(open_, key))
        judged = cut_lineage(first.withColumn("_dup", F.coalesce(F.col("_first") < F.col("_o"), F.lit(False))).drop("_first"))
        gone.append(judged.where("_dup").select("_o", F.lit(stage).alias("_left")))
        open_ = judged.where("NOT _dup").drop("_dup")
    gone.append(colliding(open_, stored, PATIENT_KEYS, "_o").withColumn("_left", F.lit("stored")))
    left = gone[0].unionByName(gone[1]).unionByName(gone[2])
    joined = cleaned.join(left, F.col(order_col) == F.col("_o"), "left")
    return cut_lineage(joined.withColumn("left_at", F.when(~F.col("_importable"), F.lit("invalid")).otherwise(F.col("_left")))
                       .drop("_importable", "_o", "_left"))


def import_summary(stages: DataFrame) -> DataFrame:
    """K-07: the accounting of ``import_stages`` in one row, by one aggregate; a duplicate is
    counted once, where it leaves."""
    at = lambda *names: F.count_if(F.coalesce(F.col("left_at").isin(*names), F.lit(False)))
    return stages.agg(
        F.count(F.lit(1)).alias("records_found"),
        (F.count(F.lit(1)) - at(*IMPORT_STAGES[:3])).alias("records_after_cleaning"),
        at(*IMPORT_STAGES[1:]).alias("duplicates_removed"),
        at("invalid").alias("invalid_rows_skipped"),
        F.count_if(F.col("left_at").isNull()).alias("records_inserted"))


def visit_load_summary(raw_visits: DataFrame, patients: DataFrame, order_col: str = "row_id") -> DataFrame:
    """C-15 / J-02..J-04 accounting in one row: rows found, dropped for a missing or
    unparseable visit date, resolved by id / phone / e-mail, rejected, loaded. Both inputs are
    read once; one aggregate counts the flags."""
    dated = F.col("visit_date").isNotNull()
    matched = match_visits(C.clean_visits(raw_visits, keep_undated=True), patients, order_col)
    flags = matched.select(dated.alias("dated"), "resolved_by", visit_reason().isNull().alias("ok"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    by = lambda how: count(F.col("dated") & (F.col("resolved_by") == how))
    return flags.agg(
        F.count(F.lit(1)).alias("records_found"), count(~F.col("dated")).alias("dropped_no_date"),
        by("id").alias("resolved_by_id"), by("phone").alias("resolved_by_phone"), by("email").alias("resolved_by_email"),
        count(F.col("dated") & ~F.col("ok")).alias("rejected"), count(F.col("dated") & F.col("ok")).alias("records_loaded"))


def post_load_counts(patients: DataFrame, visits: DataFrame) -> DataFrame:
    """P-08: row counts of the stored tables, folded into one row."""
    p = patients.agg(F.count(F.lit(1)).alias("patients")).select("patients", F.lit(None).cast("long").alias("visits"))
    v = visits.agg(F.count(F.lit(1)).alias("visits")).select(F.lit(None).cast("long").alias("patients"), "visits")
    return p.unionByName(v).agg(F.max("patients").alias("patients"), F.max("visits").alias("visits"))
