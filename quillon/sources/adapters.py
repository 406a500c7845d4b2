"""Logical tables (timeline, windows, manifest, vocabulary, sequences, logits) as views of
the star-schema tables.  Pure projections: filters and pruning reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECONDS = "cast(datediff(to_date(ts), date'2024-01-01') * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) as bigint)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_id, track, seq, time, dur, value, number."""
    return read(spark, sf_dir, "events").selectExpr(
        "user_id as score_id", "event_type as track", "event_id as seq", f"{SECONDS} as time", "greatest(1, cast(floor(value) as bigint)) as dur", "pmod(cast(floor(value) as bigint), 128) as value", "event_id % 4 as number"
    )


def coarse(events: DataFrame, ticks: int = 20000) -> DataFrame:
    """The timeline on a coarse grid, where ties are common."""
    return events.withColumn("time", F.expr(f"time div {ticks}")).withColumn("dur", F.expr("1 + dur % 3"))


def windows(events: DataFrame) -> DataFrame:
    """One window [s, e) for each score."""
    return events.select("score_id").distinct().selectExpr("score_id", "(score_id * 7919) % 500000 as s", "(score_id * 7919) % 500000 + 200000 as e")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second timeline: score_id, time, dur, pitch (line items of orders)."""
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as score_id", "cast(datediff(to_date(l_shipdate), date'1995-01-01') as bigint) as time", "cast(l_quantity as bigint) as dur", "l_partkey % 128 as pitch")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_id, piece."""
    return read(spark, sf_dir, "part").selectExpr("p_partkey as token_id", "p_name as piece")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, token_id, logit."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("token_id", "logit")).withColumn("logit", F.col("logit").cast("double"))
