"""Bindings of the generic operators to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with their time as bigint microseconds."""
    return table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).select("user_id", "event_id", "us", "event_type", "value")


def waveforms(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as waveforms of doubles: (vec_id, label, wf)."""
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("wf"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """One row per waveform sample: (vec_id, label, pos from 0, x)."""
    return waveforms(spark, d).select("vec_id", "label", F.posexplode("wf").alias("pos", "x"))


#: The same bindings in SQL.
E = "with e as (select user_id, event_id, epoch_us(ts) us, event_type, value from events)"
S = "with s as (select vec_id, label, unnest(range(0, len(embedding))) pos, cast(unnest(embedding) as double) x from embeddings)"
