"""Queries on what a feed's history supports."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.functions import calendar, clock
from barlab.operators import feed as fd
from barlab.operators import gaps as ga
from barlab.plans import sql as q
from barlab.plans.bars import _rounded, gaps, ny
from barlab.plans.evaluation import SQL as _EVALUATION
from barlab.plans.evaluation import spread_profile
from barlab.sources import scans
from barlab.sources.tables import daily_bars, hourly_bars, tick_bars, ticks


def _anchors(spark, d):
    """Gaps in the daily orders of each priority as sessions of a feed whose server follows the European rule: closes and openings at fixed hours of
    New York, some openings late, and those after every fifth day as breaks."""
    g = ga.find_gaps(daily_bars(spark, d), 86400).select("symbol", "before", "after")
    # 16:00 in New York on the server's clock
    on = lambda c, ny_hour: F.col(c) + F.pmod(F.lit(ny_hour + 5) + clock.offset_hours(clock.day_of(F.col(c))) - F.when(clock.us_is_summer(clock.day_of(F.col(c))), 1).otherwise(0), F.lit(24)) * 3600
    late = F.when(F.col("after") % 691200 == 0, 3600).otherwise(0)
    return g.select("symbol", on("before", 16).alias("before"), (on("after", 18) + late).alias("after"), F.when((F.col("before") / 86400) % 5 == 0, 1).otherwise(9).alias("missing"))


def _events(spark, d):
    years = daily_bars(spark, d).select("symbol", F.year(clock.day_of(F.col("time"))).alias("year")).where("year <> 1995").distinct()
    return fd.boundary_anchors(_anchors(spark, d), years)


def anchor_fingerprints(spark, d):
    return _rounded(fd.anchor_fingerprints(_events(spark, d), purity=0.6))


def combined_fingerprint(spark, d):
    return fd.combined_fingerprint(fd.anchor_fingerprints(_events(spark, d), purity=0.6))


def anchor_residuals(spark, d):
    return fd.anchor_residuals(_events(spark, d))


def boundary_hours(spark, d):
    return fd.boundary_hours(ga.find_gaps(daily_bars(spark, d), 86400))


def one_bar_gap_hours(spark, d):
    return _rounded(fd.one_bar_gap_hours(gaps(spark, d)))


def full_weeks(spark, d):
    return fd.full_weeks(daily_bars(spark, d))


def _lonely(spark, d):
    days = daily_bars(spark, d).where("n = 1").select("symbol", clock.day_of(F.col("time")).alias("day"))
    return days, calendar.near_holidays(calendar.us_market_holidays(spark, 1994, 2025))


def holiday_counts(spark, d):
    """Days with a single order by the holiday beside them."""
    return fd.holiday_counts(*_lonely(spark, d))


def unexplained_days(spark, d):
    return fd.unexplained_days(*_lonely(spark, d))


def dense_history(spark, d):
    return fd.dense_history(hourly_bars(spark, d))


def days_by_era(spark, d):
    """Daily bars, moved on 16 years so that they span the eras."""
    moved = daily_bars(spark, d).withColumn("time", F.col("time") + 16 * 31557600)
    return fd.days_by_era(moved, calendar.session_eras(spark))


def oldest_usable(spark, d):
    return fd.oldest_usable(spread_profile(spark, d))


def full_hours(spark, d):
    """The minutes of a day, all days and symbols together, so that hours have all sixty, against hours rolled from them."""
    m = tick_bars(ticks(spark, d), 60)
    flat = m.groupBy(F.lit("all").alias("symbol"), (F.col("time") % 86400).alias("time")).agg(F.min("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max("close").alias("close"), F.sum("tick_volume").alias("tick_volume"))
    from barlab.operators.bars import roll_up

    return fd.full_hours(roll_up(flat, 3600), flat)


def parsed_prices(spark, d):
    """Prices of line items read exactly from text, summed by return flag."""
    l = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("text"))
    return l.groupBy("l_returnflag").agg(F.sum(scans.parse_price(F.col("text"))).cast("double").alias("total"), F.count("*").alias("n"))


def unrecorded(spark, d):
    """Recorded spreads and volumes by line status, where a zero was not recorded."""
    l = spark.read.parquet(f"{d}/lineitem.parquet").select("l_linestatus", (F.col("l_partkey") % 3).cast("long").alias("spread"), (F.col("l_suppkey") % 4).cast("long").alias("real_volume"))
    return scans.unrecorded_to_null(l).groupBy("l_linestatus").agg(F.count("spread").alias("spreads"), F.count("real_volume").alias("volumes"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (anchor_fingerprints, combined_fingerprint, anchor_residuals, boundary_hours, one_bar_gap_hours, full_weeks, holiday_counts, unexplained_days,
    dense_history, days_by_era, oldest_usable, full_hours, parsed_prices, unrecorded)}

_at = lambda c, h: f"({c} + ({h} + 5 + {q.offset(q.day(c))} - CASE WHEN {q.us(q.day(c))} THEN 1 ELSE 0 END + 24) % 24 * 3600)"
ANCHORS = f"""{q.DAILY},
holes AS (SELECT symbol, time AS before, lead(time) {q.SERIES}) AS after FROM daily),
moved AS (SELECT symbol, {_at('before', 16)} AS b, {_at('after', 18)} + CASE WHEN after % 691200 = 0 THEN 3600 ELSE 0 END AS a, before // 86400 % 5 = 0 AS is_break FROM holes WHERE after - before > 86400),
anchors AS (SELECT symbol, anchor, time, CASE WHEN {q.us(q.day('time'))} THEN 'us-summer' ELSE 'us-winter' END || '/' || CASE WHEN {q.eu(q.day('time'))} THEN 'eu-summer' ELSE 'eu-winter' END AS bucket, time % 86400 // 3600 AS hour
  FROM (SELECT symbol, 'daily_break' AS anchor, b + 3600 AS time FROM moved WHERE is_break
    UNION ALL SELECT symbol, 'weekly_close', b FROM moved WHERE NOT is_break AND a - b >= 86400 UNION ALL SELECT symbol, 'weekly_open', a FROM moved WHERE NOT is_break AND a - b >= 86400)),
years AS (SELECT DISTINCT symbol, year({q.day('time')}) AS y FROM daily WHERE year({q.day('time')}) <> 1995),
dense AS (SELECT a.* FROM anchors a JOIN years ON years.symbol = a.symbol AND years.y = year({q.day('a.time')})),
counts AS (SELECT symbol, anchor, bucket, hour, count(*) AS n FROM dense GROUP BY ALL),
modes AS (SELECT symbol, anchor, bucket, arg_max(hour, (n, -hour)) AS modal, max(n) / sum(n) AS purity, sum(n)::BIGINT AS n FROM counts GROUP BY ALL),
prints AS (SELECT symbol, anchor, sum(n)::BIGINT AS n, max(modal) FILTER (bucket = '{fd.WINTER}') AS winter, max(modal) FILTER (bucket = '{fd.SUMMER}') AS summer, max(modal) FILTER (bucket = '{fd.MISMATCH}') AS mismatch,
  coalesce(max(n) FILTER (bucket = '{fd.MISMATCH}'), 0) AS apart, min(purity) FILTER (bucket IN ('{fd.WINTER}', '{fd.SUMMER}', '{fd.MISMATCH}')) AS purity FROM modes GROUP BY symbol, anchor),
reasons AS (SELECT *, CASE WHEN winter IS NULL OR summer IS NULL THEN 'EMPTY_SEASON' WHEN purity < 0.6 THEN 'NOT_UNIMODAL' WHEN winter = summer AND apart < 8 THEN 'FEW_MISMATCHES' END AS reason FROM prints),
told AS (SELECT symbol, anchor, n, winter, summer, mismatch, round(purity, 6) AS purity, reason, CASE WHEN reason IS NOT NULL THEN 'UNDETERMINED' WHEN winter <> summer THEN 'FIXED' WHEN mismatch = winter THEN 'US' ELSE 'EU' END AS rule FROM reasons)"""
_single = f"{q.DAILY}, {q.HOLIDAYS}, {q.near(2)}, lonely AS (SELECT symbol, {q.day('time')} AS day FROM daily WHERE n = 1)"
_utc = lambda t: f"({t} - {q.offset(q.day(t))} * 3600)"
SQL = {
    "anchor_fingerprints": f"WITH {ANCHORS} SELECT * FROM told",
    "combined_fingerprint": f"""WITH {ANCHORS}, v AS (SELECT symbol, count(*) AS anchors, count(*) FILTER (rule <> 'UNDETERMINED') AS usable, min(rule) FILTER (rule <> 'UNDETERMINED') AS a, max(rule) FILTER (rule <> 'UNDETERMINED') AS b,
  coalesce(string_agg(anchor, ',' ORDER BY anchor) FILTER (rule <> 'UNDETERMINED'), '') AS agreed FROM told GROUP BY symbol)
SELECT symbol, anchors, usable, CASE WHEN a = b THEN a ELSE 'UNDETERMINED' END AS rule, CASE WHEN a IS NULL THEN 'NO_USABLE_ANCHOR' WHEN a <> b THEN 'ANCHORS_DISAGREE' END AS reason, CASE WHEN a = b THEN agreed ELSE '' END AS agreed FROM v""",
    "anchor_residuals": f"""WITH {ANCHORS} SELECT d.symbol, d.anchor, count(*) AS n, count(*) FILTER (hour <> modal) AS off, count(*) FILTER (hour < modal) AS early, count(*) FILTER (hour > modal) AS late
FROM dense d JOIN modes m ON m.symbol = d.symbol AND m.anchor = d.anchor AND m.bucket = d.bucket GROUP BY ALL""",
    "boundary_hours": f"""WITH {q.DAILY}, holes AS (SELECT symbol, time AS before, lead(time) {q.SERIES}) AS after FROM daily),
sides AS (SELECT symbol, 'close' AS side, before AS time FROM holes WHERE after - before > 86400 UNION ALL SELECT symbol, 'open', after FROM holes WHERE after - before > 86400),
clocks AS (SELECT symbol, side, 'server' AS clock, time AS t FROM sides UNION ALL SELECT symbol, side, 'utc', {_utc('time')} FROM sides UNION ALL SELECT symbol, side, 'new_york', {ny('u')} FROM (SELECT *, {_utc('time')} AS u FROM sides))
SELECT symbol, side, clock, (t % 86400 + 86400) % 86400 // 3600 AS hour, count(*) AS n FROM clocks GROUP BY ALL""",
    "one_bar_gap_hours": f"""WITH {q.BARS}, {q.GAPS}, c AS (SELECT symbol, before % 86400 // 3600 AS hour, count(*) AS n FROM gaps WHERE missing = 1 GROUP BY ALL)
SELECT symbol, hour, n, round(n / sum(n) OVER (PARTITION BY symbol), 6) AS share, n / sum(n) OVER (PARTITION BY symbol) >= 0.02 AS is_break FROM c""",
    "full_weeks": f"""WITH {q.DAILY}, w AS (SELECT symbol, date_trunc('week', {q.day('time')}) AS week, count(*) AS n FROM daily GROUP BY ALL),
m AS (SELECT symbol, count(*) AS weeks, list_sort(list(n))[count(*) // 2 + 1] AS median FROM w GROUP BY symbol)
SELECT symbol, weeks, median, count(*) FILTER (n >= 0.9 * median) AS full FROM w JOIN m USING (symbol) GROUP BY ALL""",
    "holiday_counts": f"WITH {_single} SELECT symbol, holiday, count(*) AS n, min(day) AS first, max(day) AS last FROM lonely LEFT JOIN near USING (day) GROUP BY symbol, holiday",
    "unexplained_days": f"WITH {_single} SELECT symbol, day FROM lonely ANTI JOIN near USING (day)",
    "dense_history": f"""WITH {q.BARS}, d AS (SELECT symbol, time // 86400 AS day, count(*) AS n FROM bars GROUP BY ALL)
SELECT symbol, sum(n)::BIGINT AS bars, coalesce(sum(n) FILTER (n >= 20), 0)::BIGINT AS dense_bars, count(*) FILTER (n >= 20) AS dense_days, sum(n)::BIGINT // 24 AS decisions,
  coalesce(sum(n) FILTER (n >= 20), 0)::BIGINT // 24 AS dense_decisions, min(day) FILTER (n >= 20) AS first_dense, max(day) FILTER (n >= 20) AS last_dense FROM d GROUP BY symbol""",
    "days_by_era": f"""WITH {q.DAILY}, d AS (SELECT symbol, {q.day('(time + 504921600)')} AS day, count(*) AS bars FROM daily GROUP BY ALL),
eras AS (SELECT start, lead(start) OVER (ORDER BY start) AS final FROM (VALUES {', '.join(f"(DATE '{s}')" for s, _ in calendar.ERAS)}) e(start))
SELECT symbol, e.start AS era, count(*) AS days, sum(bars)::BIGINT AS bars FROM d LEFT JOIN eras e ON d.day >= e.start AND (e.final IS NULL OR d.day < e.final) GROUP BY symbol, e.start""",
    "oldest_usable": f"WITH p AS ({_EVALUATION['spread_profile']}) SELECT symbol, min(day) FILTER (share > 0.5) AS day FROM p GROUP BY symbol",
    "full_hours": f"""WITH {q.TICKS}, {q.tick_bars(60, out='minutes')},
flat AS (SELECT 'all' AS symbol, time % 86400 AS time, min(open) AS open, max(high) AS high, min(low) AS low, max(close) AS close FROM minutes GROUP BY ALL),
h AS (SELECT symbol, time - time % 3600 AS hour, first(open ORDER BY time) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY time) AS close FROM flat GROUP BY ALL),
spread AS (SELECT symbol, 'left' AS reading, time - time % 3600 AS hour, time, open, high, low, close FROM flat UNION ALL SELECT symbol, 'right', CAST(floor((time - 60) / 3600) AS BIGINT) * 3600 + 3600, time, open, high, low, close FROM flat),
r AS (SELECT symbol, reading, hour, first(open ORDER BY time) AS o, max(high) AS x, min(low) AS l, last(close ORDER BY time) AS c FROM spread GROUP BY ALL HAVING count(*) = 60),
j AS (SELECT r.reading, h.open = o AND h.high = x AND h.low = l AND h.close = c AS same FROM r JOIN h USING (symbol, hour))
SELECT e.reading, count(j.reading) AS full_tested, count(*) FILTER (same) AS full_matches FROM (VALUES ('left'), ('right')) e(reading) LEFT JOIN j ON j.reading = e.reading GROUP BY e.reading""",
    "parsed_prices": "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS total, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "unrecorded": "SELECT l_linestatus, count(*) FILTER (l_partkey % 3 <> 0) AS spreads, count(*) FILTER (l_suppkey % 4 <> 0) AS volumes, count(*) AS n FROM lineitem GROUP BY l_linestatus",
}
