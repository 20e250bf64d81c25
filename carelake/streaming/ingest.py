"""R-02 upload ingestion as a file stream and R-03 the rejected-row stream.

Every micro-batch of raw registry files goes through the same batch operators: profile,
validation (rejects with reasons to their own table), cleaning, exact de-duplication,
insert-ignore against the stored registry, audit rows and a one-row import summary, published
together. Stored keys and known values are state by key (see ``state``), so a batch reads
what its own rows ask for.

Files are found by the stream and read by the batch, all CSV files in one pass: with their
own headers, which are matched by name (any order, any alias), and numbered in file order.
``cleanSource`` can archive consumed files.

The profile of all uploads is kept as parts that add up: per batch and column the rows, the
values given and the values that no earlier batch had (``upload_profile``). A column that a
file of a batch lacks, while another file has it, counts as missing there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake import schema as S
from carelake.operators import clean as C
from carelake.operators import load as L
from carelake.operators import profile as P
from carelake.operators import validate as V
from carelake.operators.headers import canonical_names, normalize_headers
from carelake.session import cut_lineage
from carelake.sources.extracts import extract_format, read_extract
from carelake.sources.records import by_header
from carelake.streaming.state import STORED_KEYS, open_state
from carelake.streaming.store import publish, write_all

FILES = "path string, modificationTime timestamp, length long, content binary"
PROFILE_SCHEMA = T.StructType([T.StructField("column_name", T.StringType()), *[
    T.StructField(c, T.LongType()) for c in ("row_count", "given", "fresh")]])
SUMMARY_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in (
    "records_found", "records_after_cleaning", "duplicates_removed", "invalid_rows_skipped", "records_inserted", "batch_id")])


def read_upload_stream(spark: SparkSession, path: str, archive_dir: str | None = None,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """The names of arriving files (their contents are read by the batch)."""
    reader = spark.readStream.format("binaryFile").schema(FILES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if archive_dir:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    return reader.load(path).select("path")


def read_uploads(spark: SparkSession, paths: list[str], fmt: str | None = None) -> DataFrame:
    """All rows of the files as text under canonical names, with ``row_id`` in file order.
    CSV files are read together, whatever their headers."""
    paths = sorted(paths)
    fmts = {extract_format(p, fmt) for p in paths}
    if fmts == {"csv"}:
        return by_header(spark, paths, canonical_names)
    raw, before = None, 0
    for path in paths:  # typed formats have schemas of their own
        rows = normalize_headers(read_extract(spark, path, fmt))
        n = rows.agg(F.coalesce(F.max("row_id") + 1, F.lit(0))).first()[0] if len(paths) > 1 else 0
        rows = rows.withColumn("row_id", F.col("row_id") + before)
        before += n
        raw = rows if raw is None else raw.unionByName(rows, allowMissingColumns=True)
    return raw


def ingest_batch(raw: DataFrame, batch_id: int, store: str, as_of=None, changed_by: str = "system",
                 changed_at=None) -> None:
    spark = raw.sparkSession
    raw = cut_lineage(raw)
    if raw.isEmpty():
        return
    state = open_state(spark, store, batch_id)
    rejects = V.invalid_rows(V.validation_frame(raw)).select(
        "row_id", "first_name", "last_name", "phone_number", "email", F.array_join("errors", "; ").alias("errors"))

    text = C.prepare_raw_patients(raw)
    sought = L.long_keys(C.clean_patient_columns(text).select(*L.PATIENT_KEYS), L.PATIENT_KEYS).select(F.col("_key").alias("key")).distinct()
    known = state.held("keys", sought).withColumnRenamed("key", "_key")
    stages = L.import_stages(text, known, as_of)
    summary = cut_lineage(L.import_summary(stages))
    n = summary.first()["records_inserted"]
    inserted = L.assign_ids(stages.where("left_at IS NULL").drop("left_at"), None, "patient_id", top=state.tops["patients"], n=n)
    audit = L.audit_of_dense(inserted, state.tops["patients"] + 1, state.tops["audit_logs"] + 1, "patient", "patient_id",
                             ["first_name", "last_name", "phone_number"], changed_by=changed_by, changed_at=changed_at)

    values = cut_lineage(P.profile_values(raw))
    fresh = cut_lineage(values.join(state.held("values", values), "key", "left_anti"))
    profile = (P.profile_part(raw).join(P.new_values(fresh), "column_name", "left")
               .select("column_name", "row_count", "given", F.coalesce("fresh", F.lit(0)).alias("fresh")))

    also = [state.add("keys", L.long_keys(inserted, STORED_KEYS).withColumnRenamed("_key", "key"), batch_id, len(STORED_KEYS) * n),
            state.add("values", fresh, batch_id, fresh.count())]
    state.tops |= {"patients": state.tops["patients"] + n, "audit_logs": state.tops["audit_logs"] + n}
    write_all([(rejects, "rejected_rows"), (inserted.select(*S.PATIENT_COLUMNS), "patients"), (audit.select(*S.AUDIT_COLUMNS), "audit_logs"),
               (summary.withColumn("batch_id", F.lit(batch_id).cast("long")), "import_summary"), (profile, "upload_profile")],
              store, batch_id, also)
    publish(spark, store, batch_id, state.text())


def run_ingest(spark: SparkSession, source: str, store: str, checkpoint: str, fmt: str = "csv", as_of=None,
               changed_at=None, archive_dir: str | None = None, max_files_per_trigger: int | None = None):
    def batch(files: DataFrame, batch_id: int) -> None:
        paths = [r.path for r in files.select("path").distinct().collect()]  # names of one batch's files
        if paths:
            ingest_batch(read_uploads(spark, paths, fmt), batch_id, store, as_of, changed_at=changed_at)

    q = (read_upload_stream(spark, source, archive_dir, max_files_per_trigger).writeStream.foreachBatch(batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
