"""Readers for the canonical tables kept as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.filters import alive_only, valid_only
from tidewire.operators.versions import last_version


def messages(spark: SparkSession, *paths: str) -> DataFrame:
    """Messages of one or more recordings; invalid samples and empty payloads never come out."""
    return usable(spark.read.parquet(*paths))


def usable(df: DataFrame) -> DataFrame:
    return valid_only(df).where(F.octet_length("payload") > 0)


def endpoint_events(spark: SparkSession, publications: str, subscriptions: str) -> DataFrame:
    return endpoints_union(spark.read.parquet(publications), spark.read.parquet(subscriptions))


def endpoints_union(publications: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One feed out of the two announcement feeds, tagged by role."""
    return publications.withColumn("is_writer", F.lit(True)).unionByName(
        subscriptions.withColumn("is_writer", F.lit(False)))


def participants(df: DataFrame) -> DataFrame:
    """Latest live announcement per participant."""
    facts = ["hostname", "process_name", "pid", "entity_name"]
    return last_version(alive_only(df), ["guid"], facts).drop("seq")
