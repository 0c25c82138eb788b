"""Checks that a clock conversion put the market's own hours where they belong; "insufficient" is neither pass nor fail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barlab.functions import clock


def boundaries(gaps: DataFrame, near: DataFrame, least: int = 86400) -> DataFrame:
    """The bar before each long gap (symbol, before in server time): its New York hour, UTC hour, US summer, and whether a holiday is near."""
    long = gaps.where(F.col("after") - F.col("before") >= least).withColumn("utc", clock.to_utc(F.col("before"))).withColumn("ny",
        clock.new_york(F.col("utc"))).withColumn("day", clock.day_of(F.col("before")))
    g = long.select("symbol", clock.hour_of(F.col("ny")).alias("ny_hour"), clock.hour_of(F.col("utc")).alias("utc_hour"),
        clock.us_is_summer(F.col("day")).alias("summer"), "day")
    return g.join(F.broadcast(near), "day", "left").withColumn("explained", F.col("holiday").isNotNull())


def weekly_close(closes: DataFrame, hour: int = 16, share: float = 0.1) -> DataFrame:
    """fail if over a share of closes is off the hour, one is off without a holiday, a daylight-saving regime has several UTC hours, or the regimes are not an hour apart."""
    off = F.col("ny_hour") != hour
    usual = lambda summer: F.collect_set(F.when(~off & (F.col("summer") == summer), F.col("utc_hour")))
    g = closes.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(off).alias("off"), F.count_if(off & ~F.col("explained"))
        .alias("unexplained"), usual(True).alias("s"), usual(False).alias("w"))
    apart = (F.size("s") > 0) & (F.size("w") > 0) & (F.pmod(F.col("w")[0] - F.col("s")[0], F.lit(24)) != 1)
    bad = (F.col("off") > share * F.col("n")) | (F.col("unexplained") > 0) | (F.size("s") > 1) | (F.size("w") > 1) | apart
    return g.select("symbol", F.lit("weekly_close").alias("name"), F.when(F.col("n") == 0, "insufficient").when(bad, "fail").otherwise("pass").alias("outcome"))


def release_hour(bars: DataFrame, fridays: DataFrame, near: DataFrame, least: int = 60) -> DataFrame:
    """Whether each first Friday within a symbol's days has its 08:00 New York bar; a missing one needs a holiday near. bars: (symbol, utc)."""
    ny = F.col("ny")
    days = bars.withColumn("ny", clock.new_york(F.col("utc"))).select("symbol", clock.day_of(ny).alias("day"), (clock.hour_of(ny) == 8).alias("at"),
        clock.hour_of(F.col("utc")).alias("h"))
    days = days.withColumn("summer", clock.us_is_summer(F.col("day")))
    span = days.groupBy("symbol").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    asked = span.join(F.broadcast(fridays), F.col("day").between(F.col("a"), F.col("b"))).select("symbol", "day")
    found = days.where("at").groupBy("symbol", "day").agg(F.max("h").alias("h"), F.first("summer").alias("summer"))
    j = asked.join(found, ["symbol", "day"], "left").join(F.broadcast(near), "day", "left")
    lost = F.count_if(F.col("h").isNull() & F.col("holiday").isNull())
    several = lambda s: F.size(F.collect_set(F.when(F.col("summer") == s, F.col("h")))) > 1
    g = j.groupBy("symbol").agg(F.count("*").alias("n"), (lost > 0).alias("lost"), several(True).alias("s"), several(False).alias("w"))
    return g.select("symbol", F.lit("release_hour").alias("name"), F.when(F.col("n") < least, "insufficient")
        .when(F.col("lost") | F.col("s") | F.col("w"), "fail").otherwise("pass").alias("outcome"))


def volume_peak(bars: DataFrame, least: int = 60, share: float = 0.25) -> DataFrame:
    """Per first Friday the New York hour from 5 to 12 of most volume over the median of the other Fridays' (earliest at a tie); their mode must be 8, with a share. bars: (symbol, utc, tick_volume)."""
    ny = F.col("ny")
    f = bars.withColumn("ny", clock.new_york(F.col("utc"))).where((clock.weekday(ny) == 4) & clock.hour_of(ny).between(5, 12)).select("symbol",
        clock.day_of(ny).alias("day"), clock.hour_of(ny).alias("hour"), "tick_volume")
    first = F.day("day") <= 7
    base = f.where(~first).groupBy("symbol", "hour").agg(F.percentile("tick_volume", 0.5).alias("base"))
    peaks = f.where(first).join(base, ["symbol", "hour"]).where("base > 0").groupBy("symbol",
        "day").agg(F.max_by("hour", F.struct(F.col("tick_volume") / F.col("base"), -F.col("hour"))).alias("hour"))
    counts = peaks.groupBy("symbol", "hour").agg(F.count("*").alias("k")).withColumn("n", F.sum("k").over(Window.partitionBy("symbol")))
    g = counts.groupBy("symbol").agg(F.max("n").alias("n"), F.max_by("hour", F.struct("k", -F.col("hour"))).alias("mode"), (F.max("k") / F.max("n")).alias("share"))
    every = bars.select("symbol").distinct().join(g, "symbol", "left")
    return every.select("symbol", F.lit("volume_peak").alias("name"), F.when(F.coalesce(F.col("n"), F.lit(0)) < least, "insufficient")
        .when((F.col("mode") == 8) & (F.col("share") >= share), "pass").otherwise("fail").alias("outcome"))


def daily_break(gaps: DataFrame, symbols: DataFrame, hour: int = 17) -> DataFrame:
    """Every daily break must begin at 17:00 New York."""
    ny = clock.hour_of(F.col("ny"))
    own = gaps.where("cause = 'daily_break'").withColumn("utc", clock.to_utc(F.col("before") + 3600)).withColumn("ny", clock.new_york(F.col("utc")))
    g = own.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(ny != hour).alias("off"))
    return symbols.join(g, "symbol", "left").select("symbol", F.lit("daily_break").alias("name"), F.when(F.col("n").isNull(), "insufficient")
        .when(F.col("off") > 0, "fail").otherwise("pass").alias("outcome"))


def all_outcomes(bars: DataFrame, gaps: DataFrame, near: DataFrame, near_wide: DataFrame, fridays: DataFrame, least: int = 60) -> DataFrame:
    """(symbol, name, outcome) of the four invariants for every symbol. least: first Fridays without which releases and volumes tell nothing."""
    symbols = bars.select("symbol").distinct()
    weekly = symbols.join(weekly_close(boundaries(gaps, near_wide)), "symbol", "left").select("symbol", F.lit("weekly_close").alias("name"),
        F.coalesce("outcome", F.lit("insufficient")).alias("outcome"))
    release = symbols.join(release_hour(bars, fridays, near, least), "symbol", "left").select("symbol", F.lit("release_hour").alias("name"),
        F.coalesce("outcome", F.lit("insufficient")).alias("outcome"))
    return weekly.unionByName(release).unionByName(volume_peak(bars, least)).unionByName(daily_break(gaps, symbols))
