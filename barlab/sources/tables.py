"""Ticks, bars and account rows derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.functions.clock import wall_seconds
from barlab.operators.bars import roll_up, with_bar_seq


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, time, tick_id, price, volume): events as trades, their wall clock in seconds."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("symbol"), wall_seconds(F.col("ts")).alias("time"), F.col("event_id").alias("tick_id"),
        (F.col("value") + 1.0).alias("price"), F.get_json_object("props", "$.k").cast("long").alias("volume"))


def tick_bars(t: DataFrame, seconds: int) -> DataFrame:
    one = t.select("symbol", "time", "tick_id", *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], F.col("volume").alias("tick_volume"))
    return roll_up(one, seconds, order=("time", "tick_id"))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_bar_seq(tick_bars(ticks(spark, sf_dir), 3600))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as daily bars of each priority; a bar's price is in thousands."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    t = o.select(F.col("o_orderpriority").alias("symbol"), wall_seconds(F.col("o_orderdate")).alias("time"), F.col("o_orderkey").alias("tick_id"),
        (F.col("o_totalprice") / 1000.0 + 1.0).alias("price"), F.lit(1).cast("long").alias("volume"))
    return with_bar_seq(tick_bars(t, 86400))
