"""Structured Streaming jobs over ticks, readings and alerts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barlab.streaming.state import after_cursor

TICK_SCHEMA = "time long, time_msc long, bid double, ask double, last double, volume long, flags int, volume_real double"
RANK = {"CRITICAL": 0, "WARN": 1, "INFO": 2}


def ingest_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of CSV ticks in folder/symbol=.../ (or in folder itself, for one symbol), each once, with the server's day to route by.

    state.after_cursor says which ticks are new. time_msc counts from 1970 on the server's clock, and so does the day, whatever the session's zone."""
    raw = spark.readStream.schema(f"{TICK_SCHEMA}, symbol string").option("header", True).csv(folder)
    return after_cursor(raw).withColumn("server_day", F.date_from_unix_date(F.floor(F.col("time_msc") / 86_400_000).cast("int")))


def write_ticks(ticks: DataFrame, path: str, checkpoint: str) -> Any:
    """Appends by server day; the checkpoint is the cursor that a restart goes on from."""
    return ticks.writeStream.format("parquet").partitionBy("server_day").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def roll_up_stream(ticks: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Bars of a stream (symbol, ts timestamp, tick_id, price, volume), labelled at their open; rows later than the delay are dropped and counted by Spark."""
    key = F.struct("ts", "tick_id")
    return ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width).alias("w")).agg(F.min_by("price", key).alias("open"),
        F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("volume").alias("tick_volume"),
            F.count("*").alias("n")).select("symbol", F.unix_timestamp("w.start").alias("time"), "open", "high", "low", "close", "tick_volume", "n")


ALERT = "account string, code string, key string, severity string, raised_at long"


def _throttled(rows: list[tuple], sent_at: int | None, severity: str | None, every: int) -> tuple[list[bool], int | None, str | None]:
    """Which of rows (raised_at, severity), in order, go out; and the state after them. It changes only when one is sent."""
    out = []
    for at, level in rows:
        go = sent_at is None or at - sent_at >= every or RANK[level] < RANK[severity]
        if go:
            sent_at, severity = at, level
        out.append(go)
    return out, sent_at, severity


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """By time; at one time the most severe first, so that it holds back the others."""
    return rows.assign(_rank=rows["severity"].map(RANK)).sort_values(["raised_at", "_rank"]).drop(columns="_rank")


def throttle_stream(alerts: DataFrame, every: int = 3600) -> DataFrame:
    """Alerts that are sent: per (account, code, key) one an hour, unless severity rises."""

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _in_order(pd.concat([*batches]))
        sent_at, severity = state.get if state.exists else (None, None)
        go, sent_at, severity = _throttled([*zip(rows["raised_at"].tolist(), rows["severity"], strict=True)], sent_at, severity, every)
        state.update((sent_at, severity))
        yield rows[go]

    return alerts.groupBy("account", "code", "key").applyInPandasWithState(run, ALERT, "sent_at long, severity string", "append", GroupStateTimeout.NoTimeout)


def throttle(alerts: DataFrame, every: int = 3600) -> DataFrame:
    """throttle_stream over a whole table of alerts, for many small groups as for few large ones: no group is held in one piece.

    An alert that comes a whole interval or more after the one before it, sent or not, goes out whatever was sent earlier. Such alerts, marked by Spark, cut
    the sorted rows into runs that don't depend on each other; only runs of several rows are gone through one by one."""
    by = ["account", "code", "key"]
    rank = F.nullif(F.array_position(F.array(*[F.lit(s) for s in RANK]), F.col("severity")), F.lit(0))
    order = [F.asc_nulls_last("raised_at"), F.asc_nulls_last("_rank")]
    w = Window.partitionBy(*by).orderBy(*order)
    late = F.coalesce(F.try_subtract("raised_at", F.lag("raised_at").over(w)) >= every, F.lit(False))
    told = alerts.select(*by, "severity", "raised_at", rank.alias("_rank")).withColumn("_first", (F.row_number().over(w) == 1) | late)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch.column("_first").to_numpy(zero_copy_only=False).astype(bool)
            starts = np.flatnonzero(np.r_[True, first[1:]])
            ends = np.r_[starts[1:], len(first)]
            go = first.copy()
            # without a time: due by no interval
            at = [math.nan if x is None else x for x in batch.column("raised_at").to_pylist()]
            rows = [*zip(at, batch.column("severity").to_pylist(), strict=True)]
            # the first run may go on from the last batch, the last one into the next
            for k in np.unique(np.r_[0, np.flatnonzero(ends - starts > 1), len(starts) - 1]).tolist():
                a, b = int(starts[k]), int(ends[k])
                go[a:b], *state = _throttled(rows[a:b], *((None, None) if first[a] else state), every)
            yield batch.filter(pa.array(go)).select([*by, "severity", "raised_at"])

    return told.sortWithinPartitions(*by, *order).mapInArrow(run, ALERT)


def _segment(table: DataFrame, columns: list[str]) -> Column:
    """A digest of rows whatever their order: sums of the row hashes' parts."""
    line = F.sha2(F.to_json(F.struct(*[f"`{c}`" for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
    part = lambda a: F.coalesce(F.sum(F.conv(F.substring(line, a, 12), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")
    return F.sha2(F.concat_ws("|", part(1), part(13), part(25)), 256)


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows, none if it was never written."""
    schema = "seq long, rows long, segment string, chain string, status string"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(f"{path}/ledger") if there else spark.createDataFrame([], schema)


def ledger_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: appends the batch and a ledger row of its count and digest, chained to the one before. A replayed batch is written once.

    A batch whose data was written before and whose ledger row was not (the writer died in between) is replaced and marked RECOVERED."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.agg(F.count("*").alias("rows"), _segment(batch, batch.columns).alias("segment")).first()
        done = _ledger(spark, path).where(F.col("seq") <= number).orderBy(F.desc("seq")).limit(1).collect()
        if done and done[0]["seq"] == number:
            return
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/batch={number}")
        status = "RECOVERED" if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) else "OK"
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        chain = F.sha2(F.lit((done[0]["chain"] if done else "") + own["segment"]), 256)
        row = spark.range(1).select(F.lit(number).cast("long").alias("seq"), F.lit(own["rows"]).cast("long").alias("rows"), F.lit(own["segment"])
            .alias("segment"), chain.alias("chain"), F.lit(status).alias("status"))
        row.coalesce(1).write.mode("append").parquet(f"{path}/ledger")

    return write


def audit_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(seq, rows, status) of the ledger's batches: the recorded status (OK or RECOVERED) where all agrees, else why not.

    TAMPERED: the batch's rows don't give the recorded segment. BROKEN: the chain isn't that of the row
    before, as when a row was changed or taken out. UNRECORDED: data without a ledger row. A row a batch."""
    ledger = _ledger(spark, path)
    data = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    now = data.groupBy(F.col("batch").cast("long").alias("seq")).agg(F.count("*").alias("found"),
        _segment(data, [c for c in data.columns if c != "batch"]).alias("actual"))
    # one row a batch, in the order that they are chained in
    before = F.coalesce(F.lag("chain").over(Window.orderBy("seq")), F.lit(""))
    linked = ledger.withColumn("links", F.col("chain") == F.sha2(F.concat(before, "segment"), 256))
    same = (F.col("rows") == 0) & F.col("found").isNull() | F.coalesce((F.col("found") == F.col("rows")) & (F.col("actual") == F.col("segment")), F.lit(False))
    status = F.when(F.col("rows").isNull(), "UNRECORDED").when(~same, "TAMPERED").when(~F.col("links"), "BROKEN").otherwise(F.col("status"))
    return linked.join(now, "seq", "full").select("seq", F.coalesce("rows", "found").alias("rows"), status.alias("status")).orderBy("seq")


def carry_log_rows(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with reason): readings with trusted timing and a measured or explicit offset go to the carry log."""
    reason = F.when(~F.coalesce(F.col("timing_trusted"), F.lit(False)),
        "timing not trusted").when(~F.coalesce(F.col("offset_source").isin("measured", "explicit"), F.lit(False)), "offset not measured")
    marked = readings.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def carry_log_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of readings: accepted rows go to the carry log, the others to its quarantine with their reason. A replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        for rows, name in zip(carry_log_rows(batch), ("log", "quarantine"), strict=True):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return write


def alert_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of alerts as JSON lines, the most severe first in each batch. A replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rank = F.array_position(F.array(*[F.lit(s) for s in RANK]), F.col("severity"))
        batch.orderBy(rank, "code", "key").write.mode("overwrite").json(f"{path}/batch={number}")

    return write
