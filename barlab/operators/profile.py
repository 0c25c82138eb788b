"""Feed profiles: readings of a bar's label, clock shifts, density, spread, session runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barlab.operators.bars import roll_up

FIELDS = ("open", "high", "low", "close")


def compare_readings(hours: DataFrame, minutes: DataFrame) -> DataFrame:
    """Per reading of a label (left: [t, t+3600), right: (t-3600, t]): hours tested, empty, and equal whole and by field.

    The reading is a derived key, so minutes meet hours in an equi-join."""
    left = roll_up(minutes, 3600).withColumn("reading", F.lit("left"))
    # under the right reading the minute t belongs to the hour ((t - 60) div 3600 + 1)
    right = roll_up(minutes.withColumn("at", F.col("time")).withColumn("time", F.col("time") - 60), 3600, order=("at",)).withColumn("time",
        F.col("time") + 3600).withColumn("reading", F.lit("right"))
    rolled = left.unionByName(right).select("symbol", "time", "reading", *[F.col(c).alias(f"m_{c}") for c in FIELDS])
    every = hours.select("symbol", "time", *FIELDS).withColumn("reading", F.explode(F.array(F.lit("left"), F.lit("right"))))
    same = {c: F.col(c) == F.col(f"m_{c}") for c in FIELDS}
    whole = same["open"] & same["high"] & same["low"] & same["close"]
    return every.join(rolled, ["symbol", "time", "reading"], "left").groupBy("reading").agg(
        F.count("*").alias("tested"), F.count_if(F.col("m_open").isNull()).alias("empty"), F.count_if(whole).alias("matches"),
            *[F.count_if(same[c]).alias(f"{c}_matches") for c in FIELDS],
    )


def _windows(step: int) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of each hour's and the next hour's minutes, prices of the hour long windows that open at each step of the first: the end of the one and the beginning of the other."""
    m = 3600 // step

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            row = np.repeat(np.arange(n), batch["bars"].map(len))
            bars = np.array([tuple(x.values()) for own in batch["bars"] for x in own], np.float64).reshape(-1, 5)
            order = np.lexsort((bars[:, 0], row))
            row, bars = row[order], bars[order]
            at = row * 2 * m + (bars[:, 0] // step).astype(np.int64)
            # open, high, low and close of each step of both hours; the first open and the last close stay
            o, h, l, c = np.full((4, n * 2 * m), np.nan)  # noqa: E741
            o[at[::-1]], c[at] = bars[::-1, 1], bars[:, 4]
            np.fmax.at(h, at, bars[:, 2])
            np.fmin.at(l, at, bars[:, 3])
            o, h, l, c = (x.reshape(n, 2, m) for x in (o, h, l, c))  # noqa: E741
            ends = lambda f, x: f.accumulate(x[:, 0, ::-1], axis=1)[:, ::-1]
            begins = lambda f, x: np.column_stack([np.full(n, np.nan), f.accumulate(x[:, 1], axis=1)[:, :-1]])
            there, steps = ~np.isnan(o), np.arange(m)
            # the first step from each on in this hour, the first of the next one; the last of this hour, the last before each in the next
            on = np.minimum.accumulate(np.where(there[:, 0], steps, m)[:, ::-1], axis=1)[:, ::-1]
            upto = np.column_stack([np.full(n, -1), np.maximum.accumulate(np.where(there[:, 1], steps, -1), axis=1)[:, :-1]])
            first, last = np.where(there[:, 1].any(1), there[:, 1].argmax(1), m), np.where(there[:, 0].any(1), m - 1 - there[:, 0, ::-1].argmax(1), -1)
            pick = lambda x, i: np.take_along_axis(np.column_stack([x, np.full(n, np.nan)]), np.where((i < 0) | (i >= m), m, i), 1)
            here, after = on < m, upto >= 0
            opens = np.where(here, pick(o[:, 0], on), np.where(after, pick(o[:, 1], np.repeat(first[:, None], m, 1)), np.nan))
            closes = np.where(after, pick(c[:, 1], upto), np.where(here, pick(c[:, 0], np.repeat(last[:, None], m, 1)), np.nan))
            highs, lows = (f(ends(f, x), begins(f, x)) for f, x in ((np.fmax, h), (np.fmin, l)))
            yield pd.DataFrame({"symbol": batch["symbol"], "hour": batch["hour"]} | {f"m_{f}": list(x) for f, x in zip(FIELDS, (opens, highs, lows, closes), strict=True)})

    return run


def scan_offsets(hours: DataFrame, minutes: DataFrame, step: int = 60, span: int = 7200) -> DataFrame:
    """(shift, matches, tested): hours equal to minutes of [t + shift, t + shift + 3600), for each shift by step (which divides 3600) up to span.

    Every such window is the end of one clock hour and the beginning of the next, so a minute goes to two hours, whatever the
    number of shifts; in an hour, running extrema from both sides give all windows at once. tested: windows with any minute."""
    late = F.explode(F.array(F.lit(0).cast("long"), F.lit(3600).cast("long"))).alias("late")
    keyed = minutes.select("symbol", "time", *FIELDS, late).withColumn("hour", (F.floor((F.col("time") - F.col("late")) / 3600) * 3600).cast("long"))
    numbers = [F.col(c).cast("double").alias(c) for c in FIELDS]
    packed = keyed.groupBy("symbol", "hour").agg(F.collect_list(F.struct((F.col("time") - F.col("hour")).cast("double").alias("at"), *numbers)).alias("bars"))
    windows = packed.mapInPandas(_windows(step), "symbol string, hour long, " + ", ".join(f"m_{c} array<double>" for c in FIELDS))
    whole = F.explode(F.array(*[F.lit(k).cast("long") for k in range(-(-span // 3600) * -3600, span + 1, 3600)])).alias("hours_on")
    asked = hours.select("symbol", "time", *FIELDS, whole).withColumn("hour", F.col("time") + F.col("hours_on"))
    there = lambda r: F.col("m_open")[r].isNotNull() & ~F.isnan(F.col("m_open")[r])
    same = lambda r: reduce(and_, [F.col(c) == F.col(f"m_{c}")[r] for c in FIELDS])
    sums = [F.struct(F.lit(r * step).alias("on"), F.count_if(there(r) & same(r)).alias("matches"), F.count_if(there(r)).alias("tested")) for r in range(3600 // step)]
    scan = asked.join(windows, ["symbol", "hour"]).groupBy("hours_on").agg(F.array(*sums).alias("s")).select("hours_on", F.inline("s"))
    scan = scan.select((F.col("hours_on") + F.col("on")).alias("shift"), "matches", "tested")
    every = hours.sparkSession.range(-(span // step), span // step + 1).select((F.col("id") * step).alias("shift"))
    return every.join(scan, "shift", "left").select("shift", F.coalesce("matches", F.lit(0).cast("long")).alias("matches"), F.coalesce("tested", F.lit(0).cast("long")).alias("tested"))


def upper_median(values: Column) -> Column:
    """Element n div 2 of the sorted values."""
    return F.try_element_at(F.sort_array(values), F.floor(F.size(values) / 2).cast("int") + 1)


def density(days: DataFrame, dense: int = 20) -> DataFrame:
    """days (symbol, year, day, bars): per year and, with year null, in all: days, dense days, their share, bars, the upper median."""
    # days are counted by their number of bars first, so no group's days meet in one row
    counts = days.groupBy("symbol", "year", "bars").agg(F.count("*").alias("k"))
    each = counts.select("symbol", F.explode(F.array("year", F.lit(None))).alias("year"), "bars", "k").groupBy("symbol", "year", "bars").agg(F.sum("k").alias("k"))
    upto = each.withColumn("upto", F.sum("k").over(Window.partitionBy("symbol", "year").orderBy("bars"))).withColumn("n", F.sum("k")
        .over(Window.partitionBy("symbol", "year")))
    median = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("bars")))
    g = upto.where("symbol is not null").groupBy("symbol", "year").agg(F.sum("k").alias("days"), F.sum(F.col("k") * F.col("bars")).alias("bars"),
        F.sum(F.when(F.col("bars") >= dense, F.col("k")).otherwise(0)).alias("dense"), median.alias("median_bars"))
    return g.withColumn("dense_share", F.col("dense") / F.col("days"))


def density_boundary(days: DataFrame, sparse: int = 3, dense: int = 20) -> DataFrame:
    """Per symbol: days by class, the last one left out, the first dense day, and whether no sparse day follows it."""
    last = days.groupBy("symbol").agg(F.max("day").alias("last"))
    full = days.join(last, "symbol").where("day < last")
    first = full.where(F.col("bars") >= dense).groupBy("symbol").agg(F.min("day").alias("first_dense"))
    return full.join(first, "symbol", "left").groupBy("symbol").agg(
        F.count_if(F.col("bars") <= sparse).alias("sparse"), F.count_if((F.col("bars") > sparse) & (F.col("bars") < dense)).alias("middling"),
            F.count_if(F.col("bars") >= dense).alias("dense"), F.first("first_dense").alias("first_dense"),
        (F.count_if((F.col("bars") <= sparse) & (F.col("day") > F.col("first_dense"))) == 0).alias("cliff"),
    )


def modal_with_purity(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """counts (by, value, n): the commonest value (smallest at a tie), its share, and its lead over the runner-up."""
    order = Window.partitionBy(*by).orderBy(F.desc("n"), value)
    ranked = counts.withColumn("r", F.row_number().over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    return ranked.groupBy(*by).agg(F.max(F.when(F.col("r") == 1, F.col(value))).alias("modal"),
        (F.max(F.when(F.col("r") == 1, F.col("n"))) / F.max("total")).alias("purity"),
            ((F.max(F.when(F.col("r") == 1, F.col("n"))) - F.coalesce(F.max(F.when(F.col("r") == 2, F.col("n"))), F.lit(0))) / F.max("total")).alias("margin"))


def modal_anomalies(days: DataFrame) -> DataFrame:
    """days (symbol, day, weekday, bars) from Tuesday to Thursday that are one bar off the symbol's modal count."""
    mid = days.where(F.col("weekday").between(1, 3))
    modal = modal_with_purity(mid.groupBy("symbol", "bars").agg(F.count("*").alias("n")), ["symbol"], "bars")
    return mid.join(modal.select("symbol", "modal"), "symbol").where(F.abs(F.col("bars") - F.col("modal")) == 1).select("symbol", "day", "bars", "modal")


def meet(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key is a key like any other."""
    other = right.select(*[F.col(c).alias(f"{c}__") for c in by], *[c for c in right.columns if c not in by])
    return left.join(other, reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in by]), how).drop(*[f"{c}__" for c in by])


def at_ranks(counts: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], ranges: int = 256) -> DataFrame:
    """counts (by, value, n), value not null: per group the element of each rank (from 0, worked out from the group's size) of its sorted rows.

    Ranges of about as many distinct values each are totalled first; only the range that holds a rank is looked through, so no task holds a group."""
    bounds = counts.groupBy(*by).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("bounds"))
    dealt = meet(counts.select(*by, value, "n"), bounds, by).select(*by, value, "n", F.size(F.filter("bounds", lambda x: x < F.col(value))).alias("range"))
    group = Window.partitionBy(*by)
    totals = dealt.groupBy(*by, "range").agg(F.sum("n").alias("own")).withColumns({"upto": F.sum("own").over(group.orderBy("range")), "size": F.sum("own").over(group)})
    asked = totals.select(*by, "range", (F.col("upto") - F.col("own")).alias("below"), "upto",
        F.explode(F.array(*[F.struct(F.lit(k).alias("what"), f(F.col("size")).cast("long").alias("rank")) for k, f in ranks.items()]))
            .alias("x")).select(*by, "range", "below", "upto", "x.*").where("rank >= below and rank < upto").drop("upto")
    near = meet(dealt, asked, [*by, "range"])
    found = near.withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy(*by, "range", "what").orderBy(value))).where("rank < upto")
    return found.groupBy(*by).agg(*[F.min(F.when(F.col("what") == k, F.col(value))).alias(k) for k in ranks])


def spread_profile(quotes: DataFrame) -> DataFrame:
    """quotes (symbol, day, spread): per symbol and day the usable share (spread over 0), the upper median and the p95 at int(.95 n)."""
    by, usable = ["symbol", "day"], F.col("spread") > 0
    counts = quotes.groupBy(*by, "spread").agg(F.count("*").alias("n"))
    whole = counts.groupBy(*by).agg(F.sum("n").alias("quotes"), F.coalesce(F.sum(F.when(usable, F.col("n"))), F.lit(0)).alias("usable"))
    found = at_ranks(counts.where(usable), by, "spread", {"median": lambda n: F.floor(n / 2), "p95": lambda n: F.floor(n * 0.95)})
    return meet(whole, found, by, "left").select(*by, "quotes", (F.col("usable") / F.col("quotes")).alias("share"), "median", "p95")


def coverage(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group: rows, those that record a value (not zero), their share, least, upper median and most."""
    seen = F.col(value) != 0
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    whole = counts.groupBy(*by).agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("recorded"),
        F.min(F.when(seen, F.col(value))).alias("least"), F.max(F.when(seen, F.col(value))).alias("most"))
    found = at_ranks(counts.where(seen), by, value, {"median": lambda n: F.floor(n / 2)})
    return meet(whole, found, by, "left").select(*by, "rows", "recorded", "least", "median", "most", (F.col("recorded") / F.col("rows")).alias("share"))


def session_runs(days: DataFrame) -> DataFrame:
    """days (symbol, day, state): maximal runs of equal state as (symbol, run, state, first, last, days)."""
    w = Window.partitionBy("symbol").orderBy("day")
    fresh = F.when(F.lag("state").over(w).eqNullSafe(F.col("state")), 0).otherwise(1)
    marked = days.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w))
    return marked.groupBy("symbol", "run", "state").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days"))


def absorb_short_runs(runs: DataFrame, least: int = 30) -> DataFrame:
    """runs with the shortest run under least days dropped and equal neighbours merged, again and again, by symbol."""

    def absorb(group: pd.DataFrame) -> pd.DataFrame:
        rows = [list(r) for r in group.sort_values("run")[["state", "first", "last", "days"]].itertuples(index=False)]
        while len(rows) > 1 and min(r[3] for r in rows) < least:
            rows.pop(min(range(len(rows)), key=lambda i: rows[i][3]))
            merged = rows[:1]
            for r in rows[1:]:
                if r[0] == merged[-1][0]:
                    merged[-1] = [r[0], merged[-1][1], r[2], merged[-1][3] + r[3]]
                else:
                    merged.append(r)
            rows = merged
        return pd.DataFrame([(group["symbol"].iloc[0], i + 1, *r) for i, r in enumerate(rows)], columns=["symbol", "run", "state", "first", "last", "days"])

    return runs.select("symbol", "run", "state", "first", "last", "days").groupBy("symbol").applyInPandas(absorb,
        runs.select("symbol", "run", "state", "first", "last", "days").schema)


def best_shifts(scan: DataFrame, k: int = 10) -> DataFrame:
    """The k shifts of most matches, the smaller shift first at a tie."""
    return scan.orderBy(F.desc("matches"), F.abs("shift"), "shift").limit(k)


def verdict(readings: DataFrame, decisive: DataFrame, least: int = 200) -> DataFrame:
    """The reading of a bar's label that the feed follows, where at least so many hours tell the readings apart and exactly one reading matches them all."""
    whole = readings.where("matches = tested - empty and tested > empty").agg(F.count("*").alias("exact"), F.first("reading").alias("reading"))
    n = decisive.agg(F.count("*").alias("decisive"))
    both = whole.join(F.broadcast(n))  # one row each
    return both.select("decisive", "exact", F.when((F.col("decisive") >= least) & (F.col("exact") == 1), F.col("reading")).otherwise("undecided").alias("verdict"))


def decisive_hours(minutes: DataFrame) -> DataFrame:
    """(symbol, time) of hours in which the left and the right reading give different prices."""
    left = roll_up(minutes, 3600)
    right = roll_up(minutes.withColumn("at", F.col("time")).withColumn("time", F.col("time") - 60), 3600, order=("at",)).withColumn("time", F.col("time") + 3600)
    r = right.select("symbol", "time", *[F.col(c).alias(f"r_{c}") for c in FIELDS])
    differs = F.lit(False)
    for c in FIELDS:
        differs = differs | (F.col(c) != F.col(f"r_{c}"))
    return left.join(r, ["symbol", "time"]).where(differs).select("symbol", "time")


def first_mismatches(hours: DataFrame, minutes: DataFrame, n: int = 10) -> DataFrame:
    """The n earliest hours of each symbol whose prices are not those of their minutes."""
    m = roll_up(minutes, 3600).select("symbol", "time", *[F.col(c).alias(f"m_{c}") for c in FIELDS])
    same = F.lit(True)
    for c in FIELDS:
        same = same & (F.col(c) == F.col(f"m_{c}"))
    bad = hours.join(m, ["symbol", "time"]).where(~same)
    return bad.withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy("time"))).where(F.col("r") <= n).select("symbol", "time", "r")


def stride_sample(rows: DataFrame, most: int, order: str = "bar_seq") -> DataFrame:
    """At most so many rows of each symbol, evenly spaced by their dense number."""
    size = rows.groupBy("symbol").agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.count("*") / most).cast("long")).alias("stride"))
    return rows.join(size, "symbol").where(F.col(order) % F.col("stride") == 0).drop("stride")


def dst_fingerprint(anchors: DataFrame, least: int = 8, purity: float = 0.8) -> DataFrame:
    """anchors (symbol, bucket, hour on the server's clock) of an event that New York fixes: the rule that the clock follows by the modal hours
    of the joint daylight-saving buckets. US: one hour throughout; EU: another only while the calendars disagree; FIXED: another in the whole US summer."""
    modes = modal_with_purity(anchors.groupBy("symbol", "bucket", "hour").agg(F.count("*").alias("n")), ["symbol", "bucket"], "hour")
    n = anchors.groupBy("symbol", "bucket").agg(F.count("*").alias("n"))
    at = lambda b, c: F.max(F.when(F.col("bucket") == b, F.col(c)))
    g = modes.join(n, ["symbol", "bucket"]).groupBy("symbol").agg(at("us-summer/eu-summer", "modal").alias("both"), at("us-winter/eu-winter", "modal")
        .alias("none"), at("us-summer/eu-winter", "modal").alias("apart"), at("us-summer/eu-winter", "n").alias("rows"), F.min("purity").alias("purity"))
    told = F.col("both").isNotNull() & F.col("none").isNotNull() & (F.col("rows") >= least) & (F.col("purity") >= purity)
    level = F.col("both") == F.col("none")
    rule = F.when(level & (F.col("apart") == F.col("none")), "US").when(level, "EU").when(F.col("apart") == F.col("both"), "FIXED").otherwise("UNDETERMINED")
    return g.select("symbol", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.when(told, rule).otherwise("UNDETERMINED").alias("rule"))


def hours_by_year(anchors: DataFrame) -> DataFrame:
    """anchors (symbol, year, hour): the modal hour of each year with purity, and whether it stepped from the year before."""
    modes = modal_with_purity(anchors.groupBy("symbol", "year", "hour").agg(F.count("*").alias("n")), ["symbol", "year"], "hour")
    return modes.withColumn("stepped", F.coalesce(F.col("modal") != F.lag("modal").over(Window.partitionBy("symbol").orderBy("year")), F.lit(False)))


def holiday_match(days: DataFrame, near: DataFrame, confirm: float = 0.9) -> DataFrame:
    """days (symbol, day): how many are on or beside a holiday, and whether that confirms the calendar."""
    j = days.join(F.broadcast(near), "day", "left")
    g = j.groupBy("symbol").agg(F.count("*").alias("days"), F.count("holiday").alias("matched"))
    return g.withColumn("share", F.col("matched") / F.col("days")).withColumn("confirmed", F.col("share") >= confirm)


def history(bars: DataFrame, horizon: int = 24, folds: int = 5, least: int = 150) -> DataFrame:
    """Per symbol: bars, decisions they allow, span in days, and whether each fold gets enough of them."""
    n = F.floor(F.count("*") / horizon).cast("long")
    return bars.groupBy("symbol").agg(F.count("*").alias("bars"), n.alias("decisions"), F.floor((F.max("time") - F.min("time")) / 86400).cast("long")
        .alias("span_days")).withColumn("enough", F.floor(F.col("decisions") / (2 * folds)) >= least)


def boundaries_agree(declared: DataFrame, measured: DataFrame, days: int = 3) -> DataFrame:
    """Whether two lists of days (symbol, day) have as many entries, pairwise in order at most so many days apart."""
    rank = lambda df, c: df.select("symbol", F.row_number().over(Window.partitionBy("symbol").orderBy("day")).alias("r"), F.col("day").alias(c))
    j = rank(declared, "a").join(rank(measured, "b"), ["symbol", "r"], "full")
    return j.groupBy("symbol").agg(F.bool_and(F.coalesce(F.abs(F.col("a") - F.col("b")) <= days, F.lit(False))).alias("agree"), F.count("*").alias("pairs"))
