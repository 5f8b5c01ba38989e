"""A corpus from raw documents to token ids, in five stages.

Each stage takes what the one before it kept, as Parquet written and read again. A stage's
function takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, mixing, neardup, quality, secrets
from plumbline.sources.folders import remove, shared_folder

#: Bytes of an Arrow batch, unless the session names its own: workers and JVM each hold a batch and its results. A stage
#: sets it for what it returns, which runs later; run() takes it back.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
#: Words a worker of the last stage keeps, bytes of text handled at once and characters of words in a query; the
#: executor's heap has grown by then.
WORDS_KEPT, PORTION, QUERY = 300_000, 1 << 20, 1 << 16


def _small_batches(spark: SparkSession) -> None:
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    _small_batches(spark)
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (sets of 5-word shingles with a likeness of 0.8 or more) stays:
    the one with the least doc_id."""
    _small_batches(spark)
    return neardup.keep_first(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays."""
    _small_batches(spark)
    return secrets.redact_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that each source's words come to its target."""
    _small_batches(spark)
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, source, n_tokens, ids."""
    _small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    small = {"cache": WORDS_KEPT, "portion": PORTION, "query": QUERY}
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN, carry=("doc_id", "source"), **small)
    return coded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("byte-level BPE", bpe_stage),
]

#: Signatures, exact set likeness and token ids have no counterpart in SQL; tests/llm/test_pipeline.py holds each stage and
#: run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written to the shared folder and read again.

    The folders of all stages but the last are removed, and the session's options left as they were.
    """
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    named = BATCH_KEY in spark.conf.getAll
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
            if k:
                remove(spark, f"{base}/{k - 1}")
    finally:
        if not named:
            spark.conf.unset(BATCH_KEY)
    return docs
