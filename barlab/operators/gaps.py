"""Gaps between bars, their causes, and validity that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.functions.clock import HOUR, Clock, break_hour, day_number, day_of, hour_of
from barlab.operators.bars import series, with_halo, without_halo

CAUSES = ("out_of_window", "weekend", "daily_break", "holiday", "early_close", "unknown")
HOLIDAY_MISSING = 20


def spans_saturday(before: Column, after: Column) -> Column:
    """Whether any day from one to the other, both included, is a Saturday (day 2 since the epoch was one)."""
    return F.floor((day_number(after) - 2) / 7) > F.floor((day_number(before) - 3) / 7)


def find_gaps(bars: DataFrame, step: int = HOUR) -> DataFrame:
    """(symbol, before, after, missing): consecutive bars more than a step apart."""
    w = series()
    ahead = without_halo(with_halo(bars.select("symbol", "bar_seq", "time"), ahead=1).withColumn("after", F.lead("time").over(w)))
    return ahead.where(F.col("after") - F.col("time") > step).select("symbol", F.col("time").alias("before"), "after",
        (F.floor((F.col("after") - F.col("time")) / step) - 1).cast("long").alias("missing"))


def classify(gaps: DataFrame, near: DataFrame, clock: Clock = Clock()) -> DataFrame:
    """gaps with cause; the first rule that holds names it. near: (day, holiday), see near_holidays."""
    before, after = F.col("before"), F.col("after")
    rest = break_hour(day_of(before), clock)
    covers = F.pmod(rest - hour_of(before) - 1, F.lit(24)) < F.col("missing")
    resumes = covers | (hour_of(after) == rest) | (hour_of(after) == (rest + 1) % 24)
    # the holiday table has a few rows a year
    joined = gaps.withColumn("b", day_of(before)).withColumn("a",
        day_of(after)).join(F.broadcast(near.select(F.col("day").alias("b"), F.col("holiday").alias("hb"))), "b",
            "left").join(F.broadcast(near.select(F.col("day").alias("a"), F.col("holiday").alias("ha"))), "a", "left")
    holiday = F.coalesce("hb", "ha").isNotNull()
    cause = (
        F.when(F.col("b") < F.lit(clock.window_start), "out_of_window").when(spans_saturday(before, after), "weekend")
            .when((F.col("missing") == 1) & (hour_of(before) == F.pmod(rest - 1, F.lit(24))), "daily_break")
        .when(holiday & (F.col("missing") >= HOLIDAY_MISSING), "holiday").when(holiday & resumes, "early_close").otherwise("unknown")
    )
    return joined.select("symbol", "before", "after", "missing", cause.alias("cause"))


def census(gaps: DataFrame) -> DataFrame:
    """(cause, n): every cause, those without gaps at zero."""
    every = gaps.sparkSession.createDataFrame([(c,) for c in CAUSES], "cause string")
    counts = gaps.groupBy("cause").agg(F.count("*").alias("n"), F.sum("missing").alias("missing"))
    return every.join(F.broadcast(counts), "cause", "left").select("cause", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        F.coalesce("missing", F.lit(0)).cast("long").alias("missing"))


def bar_validity(bars: DataFrame, gaps: DataFrame) -> DataFrame:
    """bars with valid: both bars beside an unknown gap are not. No row goes."""
    bad = gaps.where("cause = 'unknown'").select("symbol", F.explode(F.array("before", "after")).alias("time")).distinct().withColumn("bad", F.lit(True))
    return bars.join(bad, ["symbol", "time"], "left").withColumn("valid", F.col("bad").isNull()).drop("bad")


def window_validity(bars: DataFrame, horizon: int = 24, lookback: int = 24, hold: int = 24) -> DataFrame:
    """label_valid: bars i..i+horizon are there and valid; feature_valid: i-lookback+1..i; trade_valid: i..i+hold+1."""
    w, bad = series(), F.when(F.col("valid"), 0).otherwise(1)
    whole = lambda a, b: (F.sum(bad).over(w.rowsBetween(a, b)) == 0) & (F.count("*").over(w.rowsBetween(a, b)) == b - a + 1)
    halo = with_halo(bars, back=lookback - 1, ahead=max(horizon, hold + 1))
    return without_halo(halo.withColumns({"label_valid": whole(0, horizon), "feature_valid": whole(-(lookback - 1), 0), "trade_valid": whole(0, hold + 1)}))


def labels_valid(bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """bars with label_valid_h for each horizon h: bars i..i+h are there and valid."""
    bad, w = F.when(F.col("valid"), 0).otherwise(1), series()
    ahead = lambda h: (F.sum(bad).over(w.rowsBetween(0, h)) == 0) & (F.count("*").over(w.rowsBetween(0, h)) == h + 1)
    return without_halo(with_halo(bars, back=0, ahead=max(horizons)).withColumns({f"label_valid_{h}": ahead(h) for h in horizons}))


def break_ledger(bars: DataFrame, gaps: DataFrame, dense: int = 20) -> DataFrame:
    """Per symbol the days that should hold one missing bar against the one-bar gaps that are there, and what is left over.

    Of days with dense bars or more those count that have not all 24, are no short Friday and hold no early close."""
    days = bars.groupBy("symbol", day_number(F.col("time")).alias("day")).agg(F.count("*").alias("n")).where(F.col("n") >= dense)
    # day 1 since the epoch was a Friday
    friday = F.pmod(F.col("day") - 1, F.lit(7)) == 0
    early = gaps.where("cause = 'early_close'").select("symbol", day_number(F.col("before")).alias("day")).distinct().withColumn("early", F.lit(True))
    whole, early_day = F.col("n") == 24, F.coalesce(F.col("early"), F.lit(False))
    of = days.join(early, ["symbol", "day"], "left").groupBy("symbol").agg(
        F.count("*").alias("dense"), F.count_if(whole).alias("whole"), F.count_if(F.col("n") == 23).alias("with_23"), F.count_if(~whole & friday)
            .alias("short_fridays"), F.count_if(~whole & ~friday & early_day).alias("early_closes"),
    )
    single = gaps.groupBy("symbol").agg(F.count_if(F.col("missing") == 1).alias("one_bar_gaps"), F.count_if(F.col("cause") == "daily_break").alias("breaks"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    told = bars.select("symbol").distinct().join(of, "symbol", "left").join(single, "symbol", "left")
    told = told.select("symbol", *[zero(c).alias(c) for c in ("dense", "whole", "with_23", "short_fridays", "early_closes", "one_bar_gaps", "breaks")])
    expected = F.col("dense") - F.col("whole") - F.col("short_fridays") - F.col("early_closes")
    return told.withColumns({"expected": expected, "residual": expected - F.col("one_bar_gaps")})
