"""The corpus pipeline: documents through quality rules, near-dedup, secret scans, mixing and BPE."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, mixing, quality, secrets, simhash
from millrace.llm.common import load, shared_folder
from millrace.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS, word_tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.quality_filter(docs, load(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays, that of the least id."""
    return simhash.one_of_each(docs, width=5, least=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced by a mark; every document stays."""
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated (or left out) to bring the sources to their weights, and shuffled."""
    return mixing.mix(docs, MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, with the text decoded from them."""
    return bpe.encode_documents(docs, word_tokenizer_path())


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("secrets", secret_scan),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: None: XXH64 fingerprints and BPE have no SQL. tests/llm compares run() with a plain Python version.
ORACLE_SQL = None


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each but the last is written to the shared folder and read again.

    A stage's rows are deleted once those of the next are written; the last written ones stay, since the
    result is read from them.
    """
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
