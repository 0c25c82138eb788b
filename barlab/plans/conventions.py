"""Queries on a feed's conventions: which reading, which daylight-saving rule, which calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.functions import calendar, clock
from barlab.operators import profile as pr
from barlab.plans import sql as q
from barlab.plans.bars import SQL as _BARS
from barlab.plans.bars import _rounded
from barlab.sources.tables import daily_bars, hourly_bars, tick_bars, ticks


def reading_verdict(spark, d):
    t = ticks(spark, d)
    minutes = tick_bars(t, 60)
    return pr.verdict(pr.compare_readings(tick_bars(t, 3600), minutes), pr.decisive_hours(minutes))


def first_mismatches(spark, d):
    """The earliest hours that change when the minutes on the hour are left out."""
    t = ticks(spark, d)
    return pr.first_mismatches(tick_bars(t, 3600), tick_bars(t, 60).where("time % 3600 > 0"))


def stride_sample(spark, d):
    return pr.stride_sample(hourly_bars(spark, d), 40).select("symbol", "bar_seq", "time")


def _order_days(spark, d):
    """The first order of each day stands for an opening, its hour in New York being fixed: a feed whose server follows the European rule."""
    b = daily_bars(spark, d)
    day = clock.day_of(F.col("time"))
    hour = F.pmod(F.lit(22) + clock.offset_hours(day) - F.when(clock.us_is_summer(day), 1).otherwise(0), F.lit(24))
    return b.select("symbol", F.col("time"), clock.dst_bucket(day).alias("bucket"), F.year(day).alias("year"), hour.cast("int").alias("hour"))


def dst_fingerprint(spark, d):
    return pr.dst_fingerprint(_order_days(spark, d))


def hours_by_year(spark, d):
    return _rounded(pr.hours_by_year(_order_days(spark, d)))


def holiday_match(spark, d):
    """Days with a single order, against the holiday calendar."""
    days = daily_bars(spark, d).where("n = 1").select("symbol", clock.day_of(F.col("time")).alias("day"))
    return _rounded(pr.holiday_match(days, calendar.near_holidays(calendar.us_market_holidays(spark, 1994, 2025))))


def history(spark, d):
    return pr.history(daily_bars(spark, d), 5, 5, 30)


def boundaries_agree(spark, d):
    """First days of each year against the first days on which an hour-like count steps."""
    b = daily_bars(spark, d).withColumn("day", clock.day_number(F.col("time"))).withColumn("year", F.year(clock.day_of(F.col("time"))))
    first = b.groupBy("symbol", "year").agg(F.min("day").alias("day"))
    later = b.where("n >= 2").groupBy("symbol", "year").agg(F.min("day").alias("day"))
    return pr.boundaries_agree(first.select("symbol", "day"), later.select("symbol", "day"))


QUERIES = {f.__name__: f for f in (reading_verdict, first_mismatches, stride_sample, dst_fingerprint, hours_by_year, holiday_match, history, boundaries_agree)}
_days = f"days AS (SELECT symbol, time, {q.day('time')} AS day, n FROM daily)"
_anchor = f"""anchors AS (SELECT symbol, day, CAST(year(day) AS INTEGER) AS year, CASE WHEN {q.us('day')} THEN 'us-summer' ELSE 'us-winter' END || '/'
|| CASE WHEN {q.eu('day')} THEN 'eu-summer' ELSE 'eu-winter' END AS bucket, CAST((22 + {q.offset('day')} - CASE WHEN {q.us('day')} THEN 1 ELSE 0 END +
24) % 24 AS INTEGER) AS hour FROM days)"""
SQL = {
    "reading_verdict": f"""WITH readings AS ({_BARS['minute_readings']}), {q.TICKS}, {q.tick_bars(60, out='minutes')},
spread AS (SELECT symbol, 'left' AS reading, time - time % 3600 AS hour, * EXCLUDE (symbol) FROM minutes UNION ALL SELECT symbol, 'right', ((time - 60) // 3600 + 1) * 3600, * EXCLUDE (symbol) FROM minutes),
rolled AS (SELECT symbol, reading, hour, first(open ORDER BY time) AS o, max(high) AS h, min(low) AS l, last(close ORDER BY time) AS c FROM spread GROUP BY symbol, reading, hour),
d AS (SELECT count(*) AS decisive FROM rolled a JOIN rolled b ON a.symbol = b.symbol AND a.hour = b.hour AND a.reading = 'left' AND b.reading = 'right' WHERE a.o <> b.o OR a.h <> b.h OR a.l <> b.l OR a.c <> b.c),
w AS (SELECT count(*) AS exact, any_value(reading) AS reading FROM readings WHERE matches = tested - empty AND tested > empty)
SELECT decisive, exact, CASE WHEN decisive >= 200 AND exact = 1 THEN reading ELSE 'undecided' END AS verdict FROM d, w""",
    "stride_sample": f"""WITH {q.BARS}, s AS (SELECT symbol, greatest(1, CAST(ceil(count(*) / 40.0) AS BIGINT)) AS k FROM bars GROUP BY symbol) SELECT
symbol, bar_seq, time FROM bars JOIN s USING (symbol) WHERE bar_seq % k = 0""",
    "first_mismatches": f"""WITH {q.TICKS}, {q.tick_bars(3600, out='hours')}, {q.tick_bars(60, out='minutes')}, m AS (SELECT symbol, time - time %
3600 AS time, first(open ORDER BY time) AS o, max(high) AS h, min(low) AS l, last(close ORDER BY time) AS c FROM minutes WHERE time % 3600 > 0 GROUP
BY 1, 2),
b AS (SELECT a.symbol, a.time, row_number() OVER (PARTITION BY a.symbol ORDER BY a.time) AS r FROM hours a JOIN m USING (symbol, time) WHERE NOT (open
= o AND high = h AND low = l AND close = c)) SELECT symbol, time, CAST(r AS INTEGER) AS r FROM b WHERE r <= 10""",
    "hours_by_year": f"""WITH {q.DAILY}, {_days}, {_anchor}, counts AS (SELECT symbol, year, hour, count(*) AS n FROM anchors GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol, year ORDER BY n DESC, hour) AS r, sum(n) OVER (PARTITION BY symbol, year) AS total FROM
counts),
modes AS (SELECT symbol, year, max(hour) FILTER (r = 1) AS modal, round(max(n) FILTER (r = 1) / max(total), 6) AS purity, round((max(n) FILTER (r = 1)
- coalesce(max(n) FILTER (r = 2), 0)) / max(total), 6) AS margin FROM ranked GROUP BY symbol, year) SELECT *, coalesce(modal <> lag(modal) OVER
(PARTITION BY symbol ORDER BY year), false) AS stepped FROM modes""",
    "holiday_match": f"""WITH {q.DAILY}, {q.HOLIDAYS}, {q.near(2)}, {_days} SELECT symbol, count(*) AS days, count(holiday) AS matched,
round(count(holiday) / count(*), 6) AS share, count(holiday) / count(*) >= 0.9 AS confirmed FROM days LEFT JOIN near USING (day) WHERE n = 1 GROUP BY
symbol""",
    "history": f"""WITH {q.DAILY} SELECT symbol, count(*) AS bars, count(*) // 5 AS decisions, (max(time) - min(time)) // 86400 AS span_days, count(*)
// 5 // 10 >= 30 AS enough FROM daily GROUP BY symbol""",
    "boundaries_agree": f"""WITH {q.DAILY}, x AS (SELECT symbol, time // 86400 AS day, year({q.day('time')}) AS year, n FROM daily),
a AS (SELECT symbol, year, min(day) AS day FROM x GROUP BY ALL),
b AS (SELECT symbol, year, min(day) AS day FROM x WHERE n >= 2 GROUP BY ALL),
ra AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY day) AS r, day AS a FROM a),
rb AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY day) AS r, day AS b FROM b) SELECT symbol, bool_and(coalesce(abs(a - b) <= 3,
false)) AS agree, count(*) AS pairs FROM ra FULL JOIN rb USING (symbol, r) GROUP BY symbol""",
    "dst_fingerprint": f"""WITH {q.DAILY}, {_days}, {_anchor}, counts AS (SELECT symbol, bucket, hour, count(*) AS n FROM anchors GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol, bucket ORDER BY n DESC, hour) AS r, sum(n) OVER (PARTITION BY symbol, bucket) AS total
FROM counts),
g AS (SELECT symbol, max(hour) FILTER (bucket = 'us-summer/eu-summer' AND r = 1) AS both_, max(hour) FILTER (bucket = 'us-winter/eu-winter' AND r = 1)
AS none_, max(hour) FILTER (bucket = 'us-summer/eu-winter' AND r = 1) AS apart, max(total) FILTER (bucket = 'us-summer/eu-winter') AS rows_, min(n /
total) FILTER (r = 1) AS purity FROM ranked GROUP BY symbol) SELECT symbol, CAST(coalesce(rows_, 0) AS BIGINT) AS rows, CASE WHEN both_ IS NOT NULL
AND none_ IS NOT NULL AND rows_ >= 8 AND purity >= 0.8 THEN CASE WHEN both_ = none_ AND apart = none_ THEN 'US' WHEN both_ = none_ THEN 'EU' WHEN
apart = both_ THEN 'FIXED' ELSE 'UNDETERMINED' END ELSE 'UNDETERMINED' END AS rule FROM g""",
}
