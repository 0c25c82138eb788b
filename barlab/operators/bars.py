"""Bar roll-up, dense sequence numbers, and chunks with halos for bounded windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def roll_up(rows: DataFrame, seconds: int, shift: int = 0, order: tuple[str, ...] = ("time",)) -> DataFrame:
    """OHLCV of rows (symbol, time, open, high, low, close, tick_volume) in buckets [t, t + seconds), t labelled at its start.

    One hash aggregation that combines before the shuffle; an empty bucket has no row."""
    key = F.struct(*order)
    bucket = (F.floor((F.col("time") - shift) / seconds) * seconds + shift).cast("long")
    return rows.groupBy("symbol", bucket.alias("bucket")).agg(
        F.min_by("open", key).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", key).alias("close"),
            F.sum("tick_volume").alias("tick_volume"), F.count("*").alias("n"),
    ).withColumnRenamed("bucket", "time")


def with_bar_seq(bars: DataFrame, span: int = 30 * 86400) -> DataFrame:
    """bar_seq, dense from 0 within each symbol, without a sort of a whole symbol: rows are numbered
    within (symbol, span of time) and the small table of counts gives each span its first number."""
    part = F.floor(F.col("time") / span)
    counts = bars.groupBy("symbol", part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("symbol", "part", (F.sum("n").over(Window.partitionBy("symbol").orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("symbol", "part").orderBy("time"))
    return bars.withColumn("part", part).join(before, ["symbol", "part"]).withColumn("bar_seq", F.col("before") + own - 1).drop("part", "before")


def with_halo(bars: DataFrame, back: int = 0, ahead: int = 0, size: int = 4096) -> DataFrame:
    """chunk and halo: each chunk of bar_seq with the back rows before it and the ahead rows after it, so
    that windows by (symbol, chunk) see what they need and a long series is many tasks. Rows with halo
    true are only there to be seen. size should be well over back and ahead."""
    size = max(size, back + 1, ahead + 1)
    own, at = F.floor(F.col("bar_seq") / size), F.col("bar_seq") % size
    to = [F.struct(own.alias("chunk"), F.lit(False).alias("halo"))]
    if back:
        to.append(F.when(at >= size - back, F.struct((own + 1).alias("chunk"), F.lit(True).alias("halo"))))
    if ahead:
        to.append(F.when((at < ahead) & (own > 0), F.struct((own - 1).alias("chunk"), F.lit(True).alias("halo"))))
    return bars.withColumn("to", F.explode(F.array_compact(F.array(*to)))).select(*bars.columns, "to.chunk", "to.halo")


def series() -> Window:
    """The window of a chunked series."""
    return Window.partitionBy("symbol", "chunk").orderBy("bar_seq")


def without_halo(bars: DataFrame) -> DataFrame:
    return bars.where("not halo").drop("chunk", "halo")


def numbered(rows: DataFrame, by: list[str], span: Column, order: list[Column | str], out: str) -> DataFrame:
    """rows with a running number within by, in the order of (span, order): numbered within spans, which are offset by a running sum of their counts."""
    rows = rows.withColumn("_span", span)
    counts = rows.groupBy(*by, "_span").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_span")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy(*by, "_span").orderBy(*order))
    return rows.withColumn("_own", own).join(before, [*by, "_span"]).withColumn(out, F.col("_before") + F.col("_own")).drop("_span", "_own", "_before")
