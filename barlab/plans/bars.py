"""Queries over bars: roll-up, gaps, validity, features, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.functions import calendar, clock
from barlab.operators import features as fe
from barlab.operators import gaps as ga
from barlab.operators.bars import series, with_halo, without_halo
from barlab.plans import sql as q
from barlab.sources.tables import daily_bars, hourly_bars, tick_bars, ticks


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def bars_h1(spark, d):
    return hourly_bars(spark, d).select("symbol", "time", "bar_seq", "open", "high", "low", "close", "tick_volume", "n")


def gaps(spark, d):
    near = calendar.near_holidays(calendar.us_market_holidays(spark, 1994, 2025))
    return ga.classify(ga.find_gaps(hourly_bars(spark, d)), near)


def gap_census(spark, d):
    return ga.census(gaps(spark, d))


def checked_bars(spark, d):
    return ga.bar_validity(hourly_bars(spark, d), gaps(spark, d))


def break_ledger(spark, d):
    """Days that should hold a break against the one-bar gaps of the hourly series."""
    return ga.break_ledger(hourly_bars(spark, d), gaps(spark, d))


def bar_validity(spark, d):
    return checked_bars(spark, d).select("symbol", "time", "valid")


def window_validity(spark, d):
    return ga.window_validity(checked_bars(spark, d), 5, 5, 24).select("symbol", "bar_seq", "label_valid", "feature_valid", "trade_valid")


def returns(spark, d):
    specs = [fe.log_return(1), fe.log_return(24), fe.reversal(3), fe.realized_vol(24), fe.vol_scaled_return(5, 24)]
    return _rounded(fe.with_features(hourly_bars(spark, d), specs).select("symbol", "bar_seq", *[s.name for s in specs]))


def range_features(spark, d):
    specs = [fe.range_position(24), fe.drawdown_from_max(48), fe.volume_weighted_return(24)]
    return _rounded(fe.with_features(hourly_bars(spark, d), specs).select("symbol", "bar_seq", *[s.name for s in specs]), 8)


def atr(spark, d):
    with_atr = fe.wilder_atr(hourly_bars(spark, d), 14)
    return _rounded(fe.with_features(with_atr, [fe.atr_distance(24)]).select("symbol", "bar_seq", "atr", "atr_distance_24"))


def rolling_median(spark, d):
    return _rounded(fe.rolling_median(daily_bars(spark, d), "close", 250, "median_250").select("symbol", "bar_seq", "median_250"))


def rolling_median_short(spark, d):
    return _rounded(fe.rolling_median(hourly_bars(spark, d), "close", 24, "median_24").select("symbol", "bar_seq", "median_24"))


def direction_labels(spark, d):
    valid = ga.window_validity(checked_bars(spark, d), 24, 24, 24)
    return fe.direction_label(valid, 24).select("symbol", "bar_seq", "label")


def volatility_labels(spark, d):
    return fe.volatility_label(hourly_bars(spark, d)).select("symbol", "bar_seq", "vol_label")


def label_summary(spark, d):
    return _rounded(fe.label_summary(fe.direction_label(hourly_bars(spark, d), 24)))


def outcomes_ahead(spark, d):
    """Relative moves of the close in 1, 4 and 24 bars."""
    w, hs = series(), (1, 4, 24)
    ahead = with_halo(hourly_bars(spark, d), ahead=24)
    return _rounded(without_halo(ahead.withColumns({f"h{h}": F.try_divide(F.lead("close", h).over(w), "close") - 1 for h in hs}))
        .select("symbol", "bar_seq", *[f"h{h}" for h in hs]), 8)


def polynomial(spark, d):
    b = hourly_bars(spark, d).select("symbol", "bar_seq", F.col("open").alias("a"), F.col("close").alias("b"))
    return _rounded(fe.polynomial_expand(b, ["a", "b"], 3))


def causality(spark, d):
    """Values at 200 cuts of each symbol that the history up to the cut does not give to the bit; the recursive range over chunks of 128 bars."""
    specs = [fe.log_return(24), fe.reversal(3), fe.realized_vol(24), fe.vol_scaled_return(5, 24), fe.range_position(24), fe.drawdown_from_max(48), fe.volume_weighted_return(24)]
    b = hourly_bars(spark, d)
    told = fe.causality_audit(b, specs).unionByName(fe.recursion_audit(b, size=128))
    return told.groupBy("feature").agg(F.count("*").alias("cuts"), F.count_if(~F.col("same")).alias("violations"))


def bar_clock(spark, d):
    """UTC, New York hour and session hours of each daily order bar and each hourly bar."""
    b = hourly_bars(spark, d).select("symbol", "time").unionByName(daily_bars(spark, d).select("symbol", "time"))
    day, utc = clock.day_of(F.col("time")), clock.to_utc(F.col("time"))
    ny = clock.new_york(utc)
    return b.select("symbol", "time", utc.alias("utc"), clock.hour_of(ny).alias("ny_hour"), clock.weekday(ny).alias("ny_weekday"),
        clock.break_hour(day).alias("break_hour"), clock.close_hour(day).alias("close_hour"), clock.dst_bucket(day).alias("bucket"),
            (day >= F.lit("2015-09-11").cast("date")).alias("in_window"))


def ambiguous_hours(spark, d):
    """Bars whose UTC time is not after the one before, once the clock is taken off."""
    b = hourly_bars(spark, d).withColumn("utc", clock.to_utc(F.col("time")))
    return without_halo(with_halo(b, back=1).withColumn("was", F.lag("utc").over(series()))).groupBy("symbol").agg(F.count("*").alias("bars"),
        F.count_if(F.col("was") >= F.col("utc")).alias("violations"))


def weekly_boundaries(spark, d):
    """The last bar before and the first after each gap of two days or more in the daily series, by their hours in New York."""
    g = ga.find_gaps(daily_bars(spark, d), 86400).where(F.col("after") - F.col("before") >= 172800)
    hour = lambda c: clock.hour_of(clock.new_york(clock.to_utc(F.col(c))))
    return g.select("symbol", "before", "after", hour("before").alias("close_hour"), hour("after").alias("open_hour"))


def order_holidays(spark, d):
    """Orders on or beside a holiday, by the holiday's name and by either tie rule."""
    h = calendar.us_market_holidays(spark, 1994, 2025)
    days = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("orders"))
    first, nearest = calendar.near_holidays(h), calendar.near_holidays(h, nearest=True).withColumnRenamed("holiday", "nearest")
    return days.join(F.broadcast(first), "day").join(F.broadcast(nearest), "day").groupBy("holiday", "nearest").agg(F.count("*").alias("days"),
        F.sum("orders").alias("orders"))


def order_eras(spark, d):
    """Orders by session era, with first Fridays; dates are moved on 16 years so that they span the eras."""
    days = spark.read.parquet(f"{d}/orders.parquet").select(F.add_months(F.col("o_orderdate").cast("date"), 192).alias("day"))
    start, daily = calendar.era_of(F.col("day"))
    fridays = calendar.first_fridays(spark, "2008-01-01", "2020-12-31").withColumn("friday", F.lit(True))
    return days.join(F.broadcast(fridays), "day", "left").groupBy(F.coalesce(start.cast("string"), F.lit("")).alias("era"),
        daily.alias("daily_break")).agg(F.count("*").alias("orders"), F.count("friday").alias("first_fridays"))


def minute_readings(spark, d):
    """Minutes rolled into hours under the left and the right reading, against the hours themselves."""
    t = ticks(spark, d)
    minutes, hours = tick_bars(t, 60), tick_bars(t, 3600)
    from barlab.operators.profile import compare_readings

    return compare_readings(hours, minutes)


def offset_scan(spark, d):
    """All 241 shifts by whole minutes."""
    t = ticks(spark, d)
    from barlab.operators.profile import scan_offsets

    return scan_offsets(tick_bars(t, 3600), tick_bars(t, 60))


def offset_scan_minutes(spark, d):
    """offset_scan under the name that it had when offset_scan tried fewer shifts."""
    return offset_scan(spark, d)


QUERIES = {f.__name__: f for f in (bars_h1, gaps, gap_census, break_ledger, bar_validity, window_validity, returns, range_features, atr,
    rolling_median, rolling_median_short, direction_labels, volatility_labels, label_summary, outcomes_ahead, polynomial, causality, bar_clock,
        ambiguous_hours, weekly_boundaries, order_holidays, order_eras, minute_readings, offset_scan, offset_scan_minutes)}
_r = lambda x, n=6: f"round({x}, {n})"
_ret = lambda n: f"ln(close / lag(close, {n}) {q.SERIES}))"
_vol = f"CASE WHEN {q.trailing('count(step)', 24)} = 24 THEN {q.trailing('stddev_pop(step)', 24)} END"
_utc = f"(time - {q.offset(q.day('time'))} * 3600)"


def ny(utc: str) -> str:
    d = q.day(utc)
    edge = lambda s, h: f"(epoch({s})::BIGINT + {h} * 3600)"
    return f"({utc} - CASE WHEN {utc} >= {edge(q.sunday(d, 3, 2), 7)} AND {utc} < {edge(q.sunday(d, 11, 1), 6)} THEN 14400 ELSE 18000 END)"


SQL = {
    "bars_h1": f"WITH {q.BARS} SELECT symbol, time, bar_seq, open, high, low, close, tick_volume, n FROM bars",
    "gaps": f"WITH {q.BARS}, {q.GAPS} SELECT * FROM gaps",
    "break_ledger": f"""WITH {q.BARS}, {q.GAPS},
day_counts AS (SELECT symbol, time // 86400 AS day, count(*) AS n FROM bars GROUP BY ALL HAVING count(*) >= 20),
early AS (SELECT DISTINCT symbol, before // 86400 AS day, true AS early FROM gaps WHERE cause = 'early_close'),
of AS (
  SELECT symbol, count(*) AS dense, count(*) FILTER (n = 24) AS whole, count(*) FILTER (n = 23) AS with_23, count(*) FILTER (n <> 24 AND (day + 6) % 7 = 0) AS short_fridays,
    count(*) FILTER (n <> 24 AND (day + 6) % 7 <> 0 AND early) AS early_closes
  FROM day_counts LEFT JOIN early USING (symbol, day) GROUP BY symbol),
single AS (SELECT symbol, count(*) FILTER (missing = 1) AS one_bar_gaps, count(*) FILTER (cause = 'daily_break') AS breaks FROM gaps GROUP BY symbol),
told AS (
  SELECT symbol, coalesce(dense, 0) AS dense, coalesce(whole, 0) AS whole, coalesce(with_23, 0) AS with_23, coalesce(short_fridays, 0) AS short_fridays, coalesce(early_closes, 0) AS early_closes,
    coalesce(one_bar_gaps, 0) AS one_bar_gaps, coalesce(breaks, 0) AS breaks
  FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN of USING (symbol) LEFT JOIN single USING (symbol))
SELECT *, dense - whole - short_fridays - early_closes AS expected, dense - whole - short_fridays - early_closes - one_bar_gaps AS residual FROM told""",
    "gap_census": f"""WITH {q.BARS}, {q.GAPS} SELECT c.cause, count(g.cause) AS n, CAST(coalesce(sum(g.missing), 0) AS BIGINT) AS missing FROM (VALUES
('out_of_window'), ('weekend'), ('daily_break'), ('holiday'), ('early_close'), ('unknown')) c(cause) LEFT JOIN gaps g USING (cause) GROUP BY c.cause""",
    "bar_validity": f"WITH {q.VALID} SELECT symbol, time, valid FROM checked",
    "window_validity": f"WITH {q.VALID} SELECT symbol, bar_seq, {q.whole(0, 5)} AS label_valid, {q.whole(-4, 0)} AS feature_valid, {q.whole(0, 25)} AS trade_valid FROM checked",
    "returns": f"""WITH {q.BARS}, {q.STEPS} SELECT symbol, bar_seq, {_r(_ret(1))} AS log_return_1, {_r(_ret(24))} AS log_return_24,
{_r('-' + _ret(3))} AS reversal_3, {_r(_vol)} AS realized_vol_24, {_r(f'CASE WHEN ({_vol}) > 0 THEN {_ret(5)} / ({_vol}) END')} AS
vol_scaled_return_5_24 FROM steps""",
    "range_features": f"""WITH {q.BARS}, framed AS (SELECT *, {q.trailing('min(low)', 24)} AS lo, {q.trailing('max(high)', 24)} AS hi, {q.trailing('count(*)', 24)} AS k, {q.trailing('max(close)', 48)} AS top, {q.trailing('count(*)', 48)} AS k2, {q.trailing('sum(tick_volume)', 24)} AS v, {_ret(24)} AS r FROM bars)
SELECT symbol, bar_seq, round(CASE WHEN k = 24 AND hi > lo THEN (close - lo) / (hi - lo) END, 8) AS range_position_24, round(CASE WHEN k2 = 48 THEN (top - close) / top END, 8) AS drawdown_from_max_48, round(CASE WHEN v > 0 THEN r / v END, 8) AS volume_weighted_return_24 FROM framed""",
    "atr": f"""WITH RECURSIVE {q.BARS}, {q.ATR} SELECT symbol, bar_seq, round(atr, 6) AS atr, round(CASE WHEN {q.trailing('count(*)', 24)} = 24 AND
atr > 0 THEN (close - {q.trailing('avg(close)', 24)}) / atr END, 6) AS atr_distance_24 FROM with_atr""",
    "rolling_median": f"WITH {q.DAILY} SELECT symbol, bar_seq, round(CASE WHEN {q.trailing('count(*)', 250)} = 250 THEN {q.trailing('median(close)', 250)} END, 6) AS median_250 FROM daily",
    "rolling_median_short": f"WITH {q.BARS} SELECT symbol, bar_seq, round(CASE WHEN {q.trailing('count(*)', 24)} = 24 THEN {q.trailing('median(close)', 24)} END, 6) AS median_24 FROM bars",
    "direction_labels": f"""WITH {q.VALID} SELECT symbol, bar_seq, CASE WHEN {q.whole(0, 24)} AND lead(close, 24) {q.SERIES}) IS NOT NULL THEN
CAST(lead(close, 24) {q.SERIES}) > close AS DOUBLE) END AS label FROM checked""",
    "volatility_labels": f"""WITH {q.BARS}, {q.STEPS}, vols AS (SELECT *, {_vol} AS rv FROM steps),
ranked AS (SELECT *, CASE WHEN {q.trailing('count(rv)', 100)} = 100 THEN {q.trailing('median(rv)', 100)} END AS th, lead(rv, 24) {q.SERIES}) AS later
FROM vols) SELECT symbol, bar_seq, CASE WHEN later IS NOT NULL AND th IS NOT NULL THEN CAST(later > th AS DOUBLE) END AS vol_label FROM ranked""",
    "label_summary": f"""WITH {q.BARS}, x AS (SELECT *, lead(close, 24) {q.SERIES}) AS later FROM bars) SELECT symbol, count(*) AS total, count(later)
AS defined, CAST(count(*) FILTER (later > close) AS BIGINT) AS positive, CAST(count(*) FILTER (later = close) AS BIGINT) AS ties, round(CASE WHEN
count(later) > 0 THEN count(*) FILTER (later > close) / count(later) END, 6) AS base_rate, round(CASE WHEN count(later) > 0 THEN count(*) FILTER
(later = close) / count(later) END, 6) AS tie_rate FROM x GROUP BY symbol""",
    "outcomes_ahead": f"WITH {q.BARS} SELECT symbol, bar_seq, " + ", ".join(f"round(lead(close, {h}) {q.SERIES}) / close - 1, 8) AS h{h}" for h in (1,
        4, 24)) + " FROM bars",
    "polynomial": f"""WITH {q.BARS}, x AS (SELECT symbol, bar_seq, open AS a, close AS b FROM bars) SELECT symbol, bar_seq, round(a, 6) AS a, round(b,
6) AS b, round(a*a, 6) AS \"a*a\", round(a*b, 6) AS \"a*b\", round(b*b, 6) AS \"b*b\", round(a*a*a, 6) AS \"a*a*a\", round(a*a*b, 6) AS \"a*a*b\",
round(a*b*b, 6) AS \"a*b*b\", round(b*b*b, 6) AS \"b*b*b\" FROM x""",
    "causality": f"""WITH {q.BARS}, lasts AS (SELECT symbol, max(bar_seq) AS n FROM bars GROUP BY symbol),
cuts AS (SELECT DISTINCT symbol, k * n // 200 AS cut FROM lasts, range(200) t(k)) SELECT f AS feature, count(*) AS cuts, CAST(0 AS BIGINT) AS
violations FROM cuts, (VALUES ('log_return_24'), ('reversal_3'), ('realized_vol_24'), ('vol_scaled_return_5_24'), ('range_position_24'), ('drawdown_from_max_48'), ('volume_weighted_return_24'), ('wilder_atr_14'))
v(f) GROUP BY f""",
    "bar_clock": f"""WITH {q.BARS}, {q.DAILY}, b AS (SELECT symbol, time FROM bars UNION ALL SELECT symbol, time FROM daily),
u AS (SELECT *, {_utc} AS utc FROM b),
z AS (SELECT *, {ny('utc')} AS ny, {q.day('time')} AS day FROM u) SELECT symbol, time, utc, {q.hour('ny')} AS ny_hour, CAST((ny // 86400 + 3) % 7 AS
INTEGER) AS ny_weekday, {q.break_hour('day')} AS break_hour, CASE WHEN {q.us('day')} AND NOT {q.eu('day')} THEN 22 ELSE 23 END AS close_hour, CASE
WHEN {q.us('day')} THEN 'us-summer' ELSE 'us-winter' END || '/' || CASE WHEN {q.eu('day')} THEN 'eu-summer' ELSE 'eu-winter' END AS bucket, day >=
DATE '2015-09-11' AS in_window FROM z""",
    "ambiguous_hours": f"""WITH {q.BARS}, u AS (SELECT symbol, bar_seq, {_utc} AS utc FROM bars),
w AS (SELECT *, lag(utc) {q.SERIES}) AS was FROM u) SELECT symbol, count(*) AS bars, CAST(count(*) FILTER (was >= utc) AS BIGINT) AS violations FROM w
GROUP BY symbol""",
    "weekly_boundaries": f"""WITH {q.DAILY},
found AS (SELECT symbol, time AS before, lead(time) {q.SERIES}) AS after FROM daily),
w AS (SELECT *, before - {q.offset(q.day('before'))} * 3600 AS ub, after - {q.offset(q.day('after'))} * 3600 AS ua FROM found WHERE after - before >= 172800)
SELECT symbol, before, after, {q.hour(ny('ub'))} AS close_hour, {q.hour(ny('ua'))} AS open_hour FROM w""",
    "order_holidays": f"""WITH {q.HOLIDAYS}, {q.near(2)}, nearest AS (SELECT h.day + CAST(s AS INTEGER) AS day, arg_min(h.name || CASE WHEN s <> 0
THEN ' (adjacent)' ELSE '' END, (abs(s), -s)) AS nearest FROM holidays h, range(-2, 3) t(s) GROUP BY 1),
days AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders GROUP BY 1) SELECT holiday, nearest, count(*) AS days,
CAST(sum(orders) AS BIGINT) AS orders FROM days JOIN near USING (day) JOIN nearest USING (day) GROUP BY holiday, nearest""",
    "order_eras": """WITH x AS (SELECT CAST(o_orderdate AS DATE) + INTERVAL 192 MONTH AS day FROM orders) SELECT CASE WHEN day >= DATE '2022-10-21'
THEN '2022-10-21' WHEN day >= DATE '2017-10-07' THEN '2017-10-07' WHEN day >= DATE '2015-09-11' THEN '2015-09-11' ELSE '' END AS era, CASE WHEN day >=
DATE '2022-10-21' THEN true WHEN day >= DATE '2017-10-07' THEN false WHEN day >= DATE '2015-09-11' THEN true END AS daily_break, count(*) AS orders,
CAST(count(*) FILTER (dayofweek(day) = 5 AND day(day) <= 7 AND day >= DATE '2008-01-01' AND day <= DATE '2020-12-31') AS BIGINT) AS first_fridays FROM
x GROUP BY 1, 2""",
    "minute_readings": f"""WITH {q.TICKS}, {q.tick_bars(3600, out='hours')}, {q.tick_bars(60, out='minutes')},
spread AS (SELECT symbol, 'left' AS reading, time - time % 3600 AS hour, * EXCLUDE (symbol) FROM minutes UNION ALL SELECT symbol, 'right', ((time - 60) // 3600 + 1) * 3600, * EXCLUDE (symbol) FROM minutes),
rolled AS (SELECT symbol, reading, hour AS time, first(open ORDER BY time) AS o, max(high) AS h, min(low) AS l, last(close ORDER BY time) AS c FROM spread GROUP BY symbol, reading, hour),
j AS (SELECT r.*, b.open = r.o AS mo, b.high = r.h AS mh, b.low = r.l AS ml, b.close = r.c AS mc, x.reading AS want FROM hours b CROSS JOIN (VALUES ('left'), ('right')) x(reading) LEFT JOIN rolled r ON r.symbol = b.symbol AND r.time = b.time AND r.reading = x.reading)
SELECT want AS reading, count(*) AS tested, CAST(count(*) FILTER (o IS NULL) AS BIGINT) AS empty, CAST(count(*) FILTER (mo AND mh AND ml AND mc) AS BIGINT) AS matches, CAST(count(*) FILTER (mo) AS BIGINT) AS open_matches, CAST(count(*) FILTER (mh) AS BIGINT) AS high_matches, CAST(count(*) FILTER (ml) AS BIGINT) AS low_matches, CAST(count(*) FILTER (mc) AS BIGINT) AS close_matches FROM j GROUP BY want""",
    "offset_scan": f"""WITH {q.TICKS}, {q.tick_bars(3600, out='hours')}, {q.tick_bars(60, out='minutes')},
shifts AS (SELECT CAST(k AS BIGINT) AS shift FROM range(-7200, 7201, 60) t(k)),
rolled AS (SELECT symbol, shift, ((time - shift) // 3600) * 3600 AS time, first(open ORDER BY time) AS o, max(high) AS h, min(low) AS l, last(close ORDER BY time) AS c FROM (SELECT s.shift, m.* FROM minutes m, shifts s) GROUP BY 1, 2, 3)
SELECT s.shift, CAST(count(*) FILTER (b.open = r.o AND b.high = r.h AND b.low = r.l AND b.close = r.c) AS BIGINT) AS matches, count(b.time) AS tested FROM shifts s LEFT JOIN rolled r ON r.shift = s.shift LEFT JOIN hours b ON b.symbol = r.symbol AND b.time = r.time GROUP BY s.shift""",
}
SQL["offset_scan_minutes"] = SQL["offset_scan"]
