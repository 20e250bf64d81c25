"""The corpus pipeline: documents pass the stages in order, each written before the next.

Every stage works on all that its predecessor kept. All but the last return the columns of
documents: rejected and repeated documents are gone, ``lang`` is what was identified, texts
have their personal data replaced, and ``n_chars`` follows the text. The last one returns
the pieces of the packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm import exact_dedup, language_id, packing, pii, shingle_join
from carelake.llm.common import staged, table
from carelake.llm.queries import tokenizer_path


#: Rows of an Arrow batch. They carry whole texts, of which a task, its Python process and the
#: buffers between them hold several batches at a time.
BATCH_ROWS = 250
#: Bytes of an Arrow batch, for rows of very long texts.
BATCH_BYTES = 4 << 20


def with_small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to at most ``BATCH_ROWS`` rows and about
    ``BATCH_BYTES``; results do not depend on it. It stays set, as the stages' frames are
    planned when they are written."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go; the others get their language (op 7)."""
    with_small_batches(spark)
    return language_id.keep_identified(docs)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays (op 9)."""
    with_small_batches(spark)
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by similarity one document stays (op 10)."""
    with_small_batches(spark)
    return shingle_join.drop_near_copies(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind (op 5)."""
    with_small_batches(spark)
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of one length from lexically similar documents (op 6)."""
    with_small_batches(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact),
    ("ngram_jaccard_join", drop_near),
    ("pii", redact),
    ("packing", pack),
]

#: The learned stages and packing have no SQL form; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
