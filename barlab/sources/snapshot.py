"""Immutable snapshots of derived bars, their digests, manifests and gated scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INVARIANTS = ("weekly_close", "release_hour", "volume_peak", "daily_break")


def table_digest(rows: DataFrame, by: str, seq: str, columns: list[str], fan: int = 1000, levels: int = 6) -> DataFrame:
    """(by, rows, digest): a hash of the values alone, whatever the files look like.

    A tree of digests: rows are hashed one by one, each run of fan numbers of seq into one digest, each run of fan of those into one,
    and so on for levels levels; fan ** levels covers any long but for ten runs at the top. No row holds more than fan digests, however large a group is."""
    # a row's JSON tells nulls from empty strings and columns from one another
    line = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    node = rows.select(by, F.col(seq).cast("long").alias("at"), F.lit(1).cast("long").alias("n"), line.alias("d"))
    inner = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "d"))), lambda x: x["d"]), "")
    for _ in range(levels):
        node = node.groupBy(by, F.floor(F.col("at") / fan).alias("up")).agg(F.sum("n").alias("n"), F.sha2(inner, 256).alias("d")).withColumnRenamed("up", "at")
    return node.groupBy(by).agg(F.sum("n").alias("rows"), F.sha2(inner, 256).alias("digest"))


def summary(bars: DataFrame) -> DataFrame:
    """Per symbol: rows, in-window, valid and labelled counts, first and last bar, and the last day that is whole (the one before the last bar's)."""
    count = lambda c: F.count_if(F.col(c)).alias(c)
    return bars.groupBy("symbol").agg(F.count("*").alias("rows"), count("in_window"), count("valid"), count("label_valid"), F.min("time")
        .alias("first_bar"), F.max("time").alias("last_bar"), (F.floor(F.max("time") / 86400) - 1).cast("long").alias("window_end"))


def gap_counts(gaps: DataFrame) -> DataFrame:
    """(symbol, gap_census map<cause, n>): a symbol's gaps by cause."""
    counts = gaps.groupBy("symbol", "cause").agg(F.count("*").alias("n"))
    return counts.groupBy("symbol").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cause", "n")))).alias("gap_census"))


def write_snapshot(bars: DataFrame, outcomes: DataFrame, path: str, calendar_hash: str, gaps: DataFrame | None = None, horizon: int = 24) -> None:
    """Writes bars and their manifest after the checks (symbol, name, outcome) are known; a failed one, or an existing snapshot, stops the write.

    The manifest has a row a symbol: its summary, the digests' calendar, the checks' outcomes, the horizon of the labels and, with gaps, their census."""
    failed = [r["name"] for r in outcomes.where("outcome = 'fail'").select("name").distinct().collect()]
    if failed:
        raise ValueError(f"not written, failed: {', '.join(sorted(failed))}")
    year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("time") / 86400).cast("int")))
    bars.withColumn("year", year).write.mode("errorifexists").partitionBy("symbol", "year").parquet(f"{path}/bars")
    checks = F.lit(",".join(f"{r['name']}={r['outcome']}" for r in outcomes.groupBy("name").agg(F.max("outcome").alias("outcome")).orderBy("name").collect()))
    census = bars.select("symbol").distinct().withColumn("gap_census", F.create_map().cast("map<string, bigint>")) if gaps is None else gap_counts(gaps)
    told = summary(bars).join(census, "symbol", "left").withColumn("gap_census", F.coalesce("gap_census", F.create_map().cast("map<string, bigint>")))
    told.withColumns({"calendar_hash": F.lit(calendar_hash), "checks": checks, "label_horizon_bars": F.lit(horizon)}).write.mode("errorifexists").parquet(f"{path}/manifest")


def load_window(spark: SparkSession, path: str, calendar_hash: str, valid_only: bool = True) -> DataFrame:
    """In-window (and valid) bars of a snapshot built under the calendar, with every invariant recorded; the filters reach the scan. A snapshot without such bars is an error, not an empty result."""
    manifest = spark.read.parquet(f"{path}/manifest")
    seen = manifest.select("calendar_hash", "checks").distinct().collect()
    if [r["calendar_hash"] for r in seen] != [calendar_hash]:
        raise ValueError("the snapshot was built under another calendar")
    recorded = dict(x.split("=") for x in seen[0]["checks"].split(","))
    missing = [n for n in INVARIANTS if recorded.get(n) not in ("pass", "insufficient")]
    if missing:
        raise ValueError(f"not recorded: {', '.join(missing)}")
    bars = spark.read.parquet(f"{path}/bars").where("in_window")
    bars = bars.where("valid") if valid_only else bars
    if bars.isEmpty():
        raise ValueError("no bars in the window" + " that are valid" * valid_only)
    return bars


def load_full(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/bars")
