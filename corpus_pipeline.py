"""A training corpus out of ``documents``: filter, deduplicate, redact, mix and encode, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import bpe, mixing, quality, secrets, simhash
from tidewire.llm.common import table, tokenizer_path
from tidewire.session import Scratch, attach

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return docs.select(*COLUMNS).where(quality.passes(F.col("text"), quality.CORPUS_RULES, F.col("lang")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    attach(spark)
    return simhash.one_of_each(docs.select(*COLUMNS), shingle=3, max_bits=2)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live secrets are cut out of the texts; sources are the owners."""
    attach(spark)
    clean = secrets.redacted(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics get their shares of the tokens."""
    attach(spark)
    return mixing.sampled(docs.select(*COLUMNS)).select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text that is left, ready for training."""
    attach(spark)
    return bpe.encoded(docs, tokenizer_path("word_bpe_49k.json"), keys=("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scans),
    ("source mixing", source_mixing),
    ("BPE encoding", bpe_encoding),
]

# Forced-boundary BPE and the fitted weights have no SQL form; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written and read again before the next, and its input deleted once it is written."""
    attach(spark)
    scratch = Scratch(spark, "pipeline")
    docs, written = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
