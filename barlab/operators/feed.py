"""What a feed's history supports: clock fingerprints over several anchors, boundary hours, breaks, holidays, dense days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barlab.functions import clock
from barlab.operators.profile import modal_with_purity

WINTER, SUMMER, MISMATCH = "us-winter/eu-winter", "us-summer/eu-summer", "us-summer/eu-winter"


def boundary_anchors(gaps: DataFrame, dense_years: DataFrame, least: int = 86_400) -> DataFrame:
    """(symbol, anchor, time, bucket, hour) of events that New York fixes, in the dense years (symbol, year): the last bar before and the first
    after each gap of at least so many seconds, and the missing hour of each gap of one bar. gaps: (symbol, before, after, missing), on the server's clock."""
    one = lambda name, time: F.struct(F.lit(name).alias("anchor"), time.alias("time"))
    weekly = F.array(one("weekly_close", F.col("before")), one("weekly_open", F.col("after")))
    events = F.when(F.col("missing") == 1, F.array(one("daily_break", F.col("before") + 3600))).when(F.col("after") - F.col("before") >= least, weekly)
    rows = gaps.select("symbol", F.inline(events)).withColumn("year", F.year(clock.day_of(F.col("time"))))
    kept = rows.join(dense_years.select("symbol", "year"), ["symbol", "year"], "left_semi")
    return kept.select("symbol", "anchor", "time", clock.dst_bucket(clock.day_of(F.col("time"))).alias("bucket"), clock.hour_of(F.col("time")).alias("hour"))


def anchor_fingerprints(anchors: DataFrame, least: int = 8, purity: float = 0.8) -> DataFrame:
    """(symbol, anchor, n, winter, summer, mismatch, purity, reason, rule): each anchor's own answer to which daylight-saving rule the clock follows.

    By the modal hours while both calendars are in winter, both in summer, and only the American one in summer: FIXED if winter and summer
    differ, US if all three agree, else EU. UNDETERMINED if a matched season is empty, a bucket's purity is too low, or the
    mismatch has too few events; reason says which."""
    counts = anchors.groupBy("symbol", "anchor", "bucket", "hour").agg(F.count("*").alias("n"))
    modes = modal_with_purity(counts, ["symbol", "anchor", "bucket"], "hour")
    totals = counts.groupBy("symbol", "anchor", "bucket").agg(F.sum("n").alias("n"))
    at = lambda b, c: F.max(F.when(F.col("bucket") == b, F.col(c)))
    used = F.col("bucket").isin(WINTER, SUMMER, MISMATCH)
    g = modes.join(totals, ["symbol", "anchor", "bucket"]).groupBy("symbol", "anchor").agg(F.sum("n").alias("n"), at(WINTER, "modal").alias("winter"), at(SUMMER, "modal").alias("summer"),
        at(MISMATCH, "modal").alias("mismatch"), F.coalesce(at(MISMATCH, "n"), F.lit(0)).alias("apart"), F.min(F.when(used, F.col("purity"))).alias("purity"))
    moves = F.col("winter") != F.col("summer")
    reason = F.when(F.col("winter").isNull() | F.col("summer").isNull(), "EMPTY_SEASON").when(F.col("purity") < purity, "NOT_UNIMODAL").when(~moves & (F.col("apart") < least), "FEW_MISMATCHES")
    rule = F.when(reason.isNotNull(), "UNDETERMINED").when(moves, "FIXED").when(F.col("mismatch") == F.col("winter"), "US").otherwise("EU")
    return g.select("symbol", "anchor", "n", "winter", "summer", "mismatch", "purity", reason.alias("reason"), rule.alias("rule"))


def combined_fingerprint(fingerprints: DataFrame) -> DataFrame:
    """(symbol, anchors, usable, rule, reason, agreed): one rule if all anchors that have one agree. Undetermined ones don't vote, and a larger sample never outvotes another."""
    usable = F.when(F.col("rule") != "UNDETERMINED", F.col("rule"))
    g = fingerprints.groupBy("symbol").agg(F.count("*").alias("anchors"), F.count(usable).alias("usable"), F.min(usable).alias("a"), F.max(usable).alias("b"),
        F.array_join(F.sort_array(F.collect_list(F.when(usable.isNotNull(), F.col("anchor")))), ",").alias("agreed"))
    reason = F.when(F.col("a").isNull(), "NO_USABLE_ANCHOR").when(F.col("a") != F.col("b"), "ANCHORS_DISAGREE")
    return g.select("symbol", "anchors", "usable", F.when(reason.isNull(), F.col("a")).otherwise("UNDETERMINED").alias("rule"), reason.alias("reason"), F.when(reason.isNull(), F.col("agreed")).otherwise("").alias("agreed"))


def anchor_residuals(anchors: DataFrame) -> DataFrame:
    """(symbol, anchor, n, off, early, late): events away from their bucket's modal hour. A bar that is missing can only make an opening late, so early ones speak against the rule."""
    modes = modal_with_purity(anchors.groupBy("symbol", "anchor", "bucket", "hour").agg(F.count("*").alias("n")), ["symbol", "anchor", "bucket"], "hour")
    away = F.col("hour") - F.col("modal")
    j = anchors.join(modes.select("symbol", "anchor", "bucket", "modal"), ["symbol", "anchor", "bucket"])
    return j.groupBy("symbol", "anchor").agg(F.count("*").alias("n"), F.count_if(away != 0).alias("off"), F.count_if(away < 0).alias("early"), F.count_if(away > 0).alias("late"))


def boundary_hours(gaps: DataFrame, least: int = 86_400) -> DataFrame:
    """(symbol, side, clock, hour, n): at what hours of the server's, UTC and New York's clock long gaps begin (side close) and end (side open)."""
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).alias("time")) for side, c in (("close", "before"), ("open", "after"))])
    rows = gaps.where(F.col("after") - F.col("before") >= least).select("symbol", F.inline(sides)).withColumn("utc", clock.to_utc(F.col("time")))
    hours = {"server": F.col("time"), "utc": F.col("utc"), "new_york": clock.new_york(F.col("utc"))}
    read = F.array(*[F.struct(F.lit(name).alias("clock"), clock.hour_of(t).alias("hour")) for name, t in hours.items()])
    return rows.select("symbol", "side", F.inline(read)).groupBy("symbol", "side", "clock", "hour").agg(F.count("*").alias("n"))


def one_bar_gap_hours(gaps: DataFrame, material: float = 0.02) -> DataFrame:
    """(symbol, hour, n, share, is_break): the server hours before gaps of one bar. Hours with a material share are breaks: a break that moves has several."""
    counts = gaps.where("missing = 1").groupBy("symbol", clock.hour_of(F.col("before")).alias("hour")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("symbol"))
    return counts.withColumn("share", share).withColumn("is_break", F.col("share") >= material)


def full_weeks(bars: DataFrame, share: float = 0.9) -> DataFrame:
    """(symbol, weeks, median, full): weeks from Monday, the upper median of their bars, and the weeks that have at least that share of it."""
    # day 4 since the epoch was a Monday
    weeks = bars.groupBy("symbol", F.floor((clock.day_number(F.col("time")) - 4) / 7).alias("week")).agg(F.count("*").alias("n"))
    # weeks are counted by their number of bars first, so no symbol's weeks meet in one row
    counts = weeks.groupBy("symbol", "n").agg(F.count("*").alias("k"))
    upto = counts.withColumn("weeks", F.sum("k").over(Window.partitionBy("symbol")))
    upto = upto.withColumn("upto", F.sum("k").over(Window.partitionBy("symbol").orderBy("n")))
    median = F.min(F.when(F.col("upto") > F.floor(F.col("weeks") / 2), F.col("n"))).over(Window.partitionBy("symbol"))
    return upto.withColumn("median", median).groupBy("symbol", "weeks", "median").agg(F.sum(F.when(F.col("n") >= share * F.col("median"), F.col("k")).otherwise(0)).alias("full"))


def holiday_counts(days: DataFrame, near: DataFrame) -> DataFrame:
    """(symbol, holiday, n, first, last): the days (symbol, day) by the holiday that explains them; null has those that none does."""
    return days.join(F.broadcast(near), "day", "left").groupBy("symbol", "holiday").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


def unexplained_days(days: DataFrame, near: DataFrame) -> DataFrame:
    """The days (symbol, day) near no holiday."""
    return days.select("symbol", "day").join(F.broadcast(near.select("day")), "day", "left_anti").select("symbol", "day")


def dense_history(bars: DataFrame, horizon: int = 24, dense: int = 20) -> DataFrame:
    """(symbol, bars, dense_bars, dense_days, decisions, dense_decisions, first_dense, last_dense): counted, not extrapolated. Only dense days can hold a label of horizon bars."""
    days = bars.groupBy("symbol", clock.day_number(F.col("time")).alias("day")).agg(F.count("*").alias("n"))
    is_dense = F.col("n") >= dense
    g = days.groupBy("symbol").agg(F.sum("n").alias("bars"), F.coalesce(F.sum(F.when(is_dense, F.col("n"))), F.lit(0)).alias("dense_bars"), F.count_if(is_dense).alias("dense_days"),
        F.min(F.when(is_dense, F.col("day"))).alias("first_dense"), F.max(F.when(is_dense, F.col("day"))).alias("last_dense"))
    whole = lambda c: F.floor(F.col(c) / horizon).cast("long")
    return g.select("symbol", "bars", "dense_bars", "dense_days", whole("bars").alias("decisions"), whole("dense_bars").alias("dense_decisions"), "first_dense", "last_dense")


def days_by_era(bars: DataFrame, eras: DataFrame) -> DataFrame:
    """(symbol, era, days, bars) by the eras (start, end) of the sessions; era null has the days before the first."""
    days = bars.groupBy("symbol", clock.day_of(F.col("time")).alias("day")).agg(F.count("*").alias("bars"))
    within = (F.col("day") >= F.col("start")) & (F.col("end").isNull() | (F.col("day") < F.col("end")))
    j = days.join(F.broadcast(eras.select("start", "end")), within, "left")  # a few eras
    return j.groupBy("symbol", F.col("start").alias("era")).agg(F.count("*").alias("days"), F.sum("bars").alias("bars"))


def oldest_usable(profile: DataFrame, share: float = 0.5) -> DataFrame:
    """(symbol, day): the oldest day of a spread profile (symbol, day, share) of which over that share of quotes can be used; null if there is none."""
    return profile.groupBy("symbol").agg(F.min(F.when(F.col("share") > share, F.col("day"))).alias("day"))


def full_hours(hours: DataFrame, minutes: DataFrame) -> DataFrame:
    """(reading, full_tested, full_matches) over hours that have all sixty minutes under the reading of their label: left [t, t + 3600), right (t - 3600, t]."""
    starts = {"left": F.col("time") - F.col("time") % 3600, "right": F.floor((F.col("time") - 60) / 3600) * 3600 + 3600}
    both = F.array(*[F.struct(F.lit(r).alias("reading"), t.cast("long").alias("hour")) for r, t in starts.items()])
    rolled = minutes.select("symbol", "time", "open", "high", "low", "close", F.inline(both)).groupBy("symbol", "reading", "hour").agg(F.count("*").alias("n"), F.min_by("open", "time").alias("o"),
        F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "time").alias("c")).where("n = 60")
    j = rolled.withColumnRenamed("hour", "time").join(hours.select("symbol", "time", "open", "high", "low", "close"), ["symbol", "time"])
    same = (F.col("open") == F.col("o")) & (F.col("high") == F.col("h")) & (F.col("low") == F.col("l")) & (F.col("close") == F.col("c"))
    found = j.groupBy("reading").agg(F.count("*").alias("full_tested"), F.count_if(same).alias("full_matches"))
    every = hours.sparkSession.createDataFrame([("left",), ("right",)], "reading string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return every.join(found, "reading", "left").select("reading", zero("full_tested"), zero("full_matches"))
