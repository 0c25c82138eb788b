"""Queries over profiles, folds and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.functions import clock
from barlab.operators import features as fe
from barlab.operators import folds as fo
from barlab.operators import gaps as ga
from barlab.operators import profile as pr
from barlab.plans import sql as q
from barlab.plans.bars import _rounded, checked_bars
from barlab.sources.tables import daily_bars, hourly_bars, ticks


def _days(spark, d):
    t = F.col("time")
    b = hourly_bars(spark, d)
    return b.groupBy("symbol", F.year(clock.day_of(t)).alias("year"), clock.day_number(t).alias("day"), clock.weekday(t).alias("weekday")).agg(F.count("*").alias("bars"))


def density(spark, d):
    return _rounded(pr.density(_days(spark, d)))


def density_boundary(spark, d):
    return pr.density_boundary(_days(spark, d), 20, 23)


def modal_anomalies(spark, d):
    return pr.modal_anomalies(_days(spark, d))


def modal_hours(spark, d):
    """The commonest hour of ticks by symbol and weekday, with purity and margin."""
    t = ticks(spark, d).groupBy("symbol", clock.weekday(F.col("time")).alias("weekday"), clock.hour_of(F.col("time")).alias("hour")).agg(F.count("*").alias("n"))
    return _rounded(pr.modal_with_purity(t, ["symbol", "weekday"], "hour"))


def spread_profile(spark, d):
    """Of every user's ticks the distance of price from volume stands for a spread."""
    t = ticks(spark, d)
    return _rounded(pr.spread_profile(t.select("symbol", clock.day_number(F.col("time")).alias("day"), F.round(F.col("price") - 2.0, 2).alias("spread"))))


def coverage(spark, d):
    t = ticks(spark, d).withColumn("year", F.year(clock.day_of(F.col("time"))))
    return _rounded(pr.coverage(t, ["symbol", "year"], "volume"))


def hours_present(spark, d):
    return hourly_bars(spark, d).groupBy("symbol", clock.day_number(F.col("time")).alias("day")).agg(F.count_distinct(clock.hour_of(F.col("time"))).alias("hours"))


def session_runs(spark, d):
    b = daily_bars(spark, d)
    return pr.session_runs(b.select("symbol", clock.day_number(F.col("time")).alias("day"), (F.col("n") >= 2).alias("state")))


def absorbed_runs(spark, d):
    return pr.absorb_short_runs(session_runs(spark, d), 3)


def largest_gaps(spark, d):
    """The fifteen longest gaps of daily bars."""
    g = ga.find_gaps(daily_bars(spark, d), 86400)
    return g.orderBy(F.desc("missing"), "symbol", "before").limit(15)


def _series(spark, d):
    """Hourly bars with validity, a direction label and a probability in closed form of two features."""
    specs = [fe.log_return(5), fe.range_position(24)]
    b = fe.with_features(fe.direction_label(checked_bars(spark, d), 5), specs)
    ok = F.col("label").isNotNull() & F.col("log_return_5").isNotNull() & F.col("range_position_24").isNotNull()
    p = 1 / (1 + F.exp(-(0.3 * F.col("log_return_5") - 1.5 * (F.col("range_position_24") - 0.5))))
    return b.withColumn("p", p).withColumn("usable", ok).withColumn("valid", F.col("valid") & ok)


def _members(spark, d):
    s = _series(spark, d)
    folds = fo.fold_geometry(s)
    return s, folds, fo.walk_forward(s, folds, 5)


def fold_counts(spark, d):
    return fo.fold_counts(_members(spark, d)[2])


def fold_counts_both_sides(spark, d):
    """The same where rows after a test window train, too."""
    s = _series(spark, d)
    return fo.fold_counts(fo.walk_forward(s, fo.fold_geometry(s), 5, both_sides=True))


def refused_series(spark, d):
    """Hourly series that are too short for 340 folds."""
    return fo.refused_series(hourly_bars(spark, d), 340)


def fold_leaks(spark, d):
    _, folds, members = _members(spark, d)
    return fo.leaks(members, folds, 5)


def _forecasts(spark, d):
    s, _, members = _members(spark, d)
    return members.where("role = 'test'").join(s.select("symbol", "bar_seq", "p", F.col("label").alias("y")), ["symbol", "bar_seq"])


def brier_skill(spark, d):
    return _rounded(fo.brier(_forecasts(spark, d), ["symbol", "fold"]))


def hit_rates(spark, d):
    return _rounded(fo.hit_rates(_forecasts(spark, d), ["symbol", "fold"]))


def target_means(spark, d):
    s = _series(spark, d).where("valid")
    return _rounded(fo.target_means(s, "log_return_5", "label").select("symbol", "bar_seq", "leak"))


def standardised(spark, d):
    s, _, members = _members(spark, d)
    rows = members.join(s.select("symbol", "bar_seq", "log_return_5", "range_position_24"), ["symbol", "bar_seq"])
    return _rounded(fo.standardise(rows, ["log_return_5", "range_position_24"]).where("role = 'test'")
        .select("symbol", "fold", "bar_seq", "log_return_5", "range_position_24"))


def eligibility(spark, d):
    s = _series(spark, d).withColumn("has_label", F.col("label").isNotNull()).withColumn("on_grid", F.col("bar_seq") % 5 == 0)
    return fo.funnel(s, ["valid", "has_label", "on_grid"])


def fold_eras(spark, d):
    s, _, members = _members(spark, d)
    return fo.era_shares(members, s.withColumn("era", F.floor(clock.day_number(F.col("time")) / 10)))


def untested_eras(spark, d):
    s, _, members = _members(spark, d)
    return fo.untested_eras(members, s.withColumn("era", F.floor(clock.day_number(F.col("time")) / 10)))


HORIZONS, SPLITS, PARAMETERS = (4, 24, 120), (0.3, 0.4, 0.5, 0.6, 0.7), (4, 11, 56)


def _geometry(spark, d):
    """Bars with the weeks as eras and, for each horizon, whether label and features may be used."""
    b = fe.with_features(ga.labels_valid(checked_bars(spark, d), HORIZONS), [fe.log_return(5), fe.range_position(24)])
    ok = F.col("log_return_5").isNotNull() & F.col("range_position_24").isNotNull()
    used = {f"used_{h}": F.col(f"label_valid_{h}") & ok for h in HORIZONS}
    return b.withColumns(used).withColumn("era", F.expr("time div 604800")), {h: f"used_{h}" for h in HORIZONS}, SPLITS


def fold_geometry_report(spark, d):
    """What each split point costs, for all horizons and numbers of parameters."""
    return _rounded(fo.geometry_report(*_geometry(spark, d), PARAMETERS))


def fold_geometry_folds(spark, d):
    return fo.geometry_folds(*_geometry(spark, d))


def fold_geometry_eras(spark, d):
    return _rounded(fo.geometry_eras(*_geometry(spark, d)))


def train_and_test(spark, d):
    """The distinct rows of each fold's train and test together."""
    _, _, m = _members(spark, d)
    one = lambda r: m.where(F.col("role") == r).select("symbol", "fold", "bar_seq")
    return one("train").union(one("test")).dropDuplicates().groupBy("symbol", "fold").agg(F.count("*").alias("rows"), F.sum("bar_seq").alias("total"))


QUERIES = {f.__name__: f for f in (density, density_boundary, modal_anomalies, modal_hours, spread_profile, coverage, hours_present, session_runs,
    absorbed_runs, largest_gaps, fold_counts, fold_counts_both_sides, refused_series, fold_leaks, brier_skill, hit_rates, target_means, standardised, eligibility, fold_eras, untested_eras,
    fold_geometry_report, fold_geometry_folds, fold_geometry_eras, train_and_test)}
DAYS = f"""{q.BARS}, days AS (SELECT symbol, CAST(year({q.day('time')}) AS INTEGER) AS year, time // 86400 AS day, CAST((time // 86400 + 3) % 7 AS
INTEGER) AS weekday, count(*) AS bars FROM bars GROUP BY ALL)"""
_upper = lambda x, where="": f"list_sort(list({x}) {where})[CAST(count({x}) {where} // 2 AS INTEGER) + 1]"
MODAL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, {v}) AS r, sum(n) OVER (PARTITION BY {by}) AS total FROM
counts),
modes AS (SELECT {by}, max({v}) FILTER (r = 1) AS modal, round(max(n) FILTER (r = 1) / max(total), 6) AS purity, round((max(n) FILTER (r = 1) -
coalesce(max(n) FILTER (r = 2), 0)) / max(total), 6) AS margin FROM ranked GROUP BY {by})"""
MEMBERS = f"""{q.VALID},
labelled AS (SELECT *, CASE WHEN lead(close, 5) {q.SERIES}) IS NOT NULL THEN CAST(lead(close, 5) {q.SERIES}) > close AS DOUBLE) END AS label, ln(close / lag(close, 5) {q.SERIES})) AS r5, {q.trailing('min(low)', 24)} AS lo, {q.trailing('max(high)', 24)} AS hi, {q.trailing('count(*)', 24)} AS k FROM checked),
feat AS (SELECT *, CASE WHEN k = 24 AND hi > lo THEN (close - lo) / (hi - lo) END AS rp FROM labelled),
series AS (SELECT * EXCLUDE (valid), valid AND label IS NOT NULL AND r5 IS NOT NULL AND rp IS NOT NULL AS valid, 1 / (1 + exp(-(0.3 * r5 - 1.5 * (rp - 0.5)))) AS p FROM feat),
sizes AS (SELECT symbol, max(bar_seq) + 1 AS n FROM series GROUP BY symbol),
geometry AS (SELECT symbol, CAST(floor(n * 0.5) AS BIGINT) AS first, (n - CAST(floor(n * 0.5) AS BIGINT)) // 5 AS size FROM sizes),
folds AS (SELECT symbol, CAST(k AS INTEGER) AS fold, first + k * size AS test_start, first + (k + 1) * size AS test_end FROM geometry, range(5) t(k)),
members AS (SELECT * FROM (SELECT s.symbol, f.fold, s.bar_seq, CASE WHEN s.bar_seq >= f.test_start THEN CASE WHEN (s.bar_seq - f.test_start) % 5 = 0 THEN 'test' END WHEN s.bar_seq + 5 >= f.test_start THEN 'purged' ELSE 'train' END AS role FROM series s JOIN folds f ON f.symbol = s.symbol AND s.bar_seq < f.test_end WHERE s.valid) WHERE role IS NOT NULL),
forecasts AS (SELECT m.symbol, m.fold, m.bar_seq, s.p, s.label AS y FROM members m JOIN series s USING (symbol, bar_seq) WHERE role = 'test')"""
# every membership row, by definition
GEOMETRY = f"""{q.VALID},
feat AS (SELECT *, lag(close, 5) {q.SERIES}) IS NOT NULL AND {q.trailing('count(*)', 24)} = 24 AND {q.trailing('max(high)', 24)} > {q.trailing('min(low)', 24)} AS ok,
  {", ".join(f"{q.whole(0, h)} AS v{h}" for h in HORIZONS)} FROM checked),
used AS ({" UNION ALL ".join(f"SELECT symbol, bar_seq, time // 604800 AS era, {h}::BIGINT AS horizon FROM feat WHERE ok AND v{h}" for h in HORIZONS)}),
eras AS (SELECT symbol, time // 604800 AS era, min(bar_seq) AS change FROM feat GROUP BY ALL),
spans AS (SELECT symbol, split, CAST(floor(n * split) AS BIGINT) AS first, (n - CAST(floor(n * split) AS BIGINT)) // 5 AS size
  FROM (SELECT symbol, max(bar_seq) + 1 AS n FROM feat GROUP BY symbol), (SELECT unnest([{", ".join(map(str, SPLITS))}]::DOUBLE[]) AS split)),
grid AS (SELECT symbol, split, horizon, fold, first + fold * size AS test_start, first + (fold + 1) * size AS test_end
  FROM spans, (SELECT unnest([{", ".join(map(str, HORIZONS))}]::BIGINT[]) AS horizon), range(5) f(fold) WHERE size > 0),
roles AS (SELECT g.*, u.bar_seq, u.era, CASE WHEN u.bar_seq >= test_start THEN 'test' ELSE 'train' END AS role FROM grid g JOIN used u USING (symbol, horizon)
  WHERE u.bar_seq + g.horizon < test_start OR (u.bar_seq >= test_start AND u.bar_seq < test_end AND (u.bar_seq - test_start) % g.horizon = 0)),
sums AS (SELECT symbol, split, horizon, fold, count(*) FILTER (role = 'train') AS train, count(*) FILTER (role = 'test') AS test FROM roles GROUP BY ALL),
counted AS (SELECT g.*, coalesce(s.train, 0) AS train, coalesce(s.test, 0) AS test,
  coalesce((SELECT string_agg(e.era::VARCHAR, ',' ORDER BY e.era::VARCHAR) FROM eras e WHERE e.symbol = g.symbol AND e.change > g.test_start AND e.change < g.test_end), '') AS straddles
  FROM grid g LEFT JOIN sums s USING (symbol, split, horizon, fold))"""
_ref = "avg(y) * (1 - avg(y))"
SQL = {
    "density": f"""WITH {DAYS} SELECT symbol, year, count(*) AS days, CAST(sum(bars) AS BIGINT) AS bars, CAST(count(*) FILTER (bars >= 20) AS BIGINT)
AS dense, {_upper('bars')} AS median_bars, round(count(*) FILTER (bars >= 20) / count(*), 6) AS dense_share FROM days GROUP BY GROUPING SETS ((symbol,
year), (symbol))""",
    "density_boundary": f"""WITH {DAYS}, lasts AS (SELECT symbol, max(day) AS last FROM days GROUP BY symbol),
kept AS (SELECT d.* FROM days d JOIN lasts l USING (symbol) WHERE day < last),
firsts AS (SELECT symbol, min(day) AS first_dense FROM kept WHERE bars >= 23 GROUP BY symbol) SELECT symbol, CAST(count(*) FILTER (bars <= 20) AS
BIGINT) AS sparse, CAST(count(*) FILTER (bars > 20 AND bars < 23) AS BIGINT) AS middling, CAST(count(*) FILTER (bars >= 23) AS BIGINT) AS dense,
any_value(first_dense) AS first_dense, count(*) FILTER (bars <= 20 AND day > first_dense) = 0 AS cliff FROM kept LEFT JOIN firsts USING (symbol) GROUP
BY symbol""",
    "modal_anomalies": f"""WITH {DAYS}, mid AS (SELECT * FROM days WHERE weekday BETWEEN 1 AND 3),
counts AS (SELECT symbol, bars, count(*) AS n FROM mid GROUP BY ALL), {MODAL.format(by='symbol', v='bars')} SELECT m.symbol, m.day, m.bars, x.modal
FROM mid m JOIN modes x USING (symbol) WHERE abs(m.bars - x.modal) = 1""",
    "modal_hours": f"""WITH {q.TICKS}, counts AS (SELECT symbol, CAST((time // 86400 + 3) % 7 AS INTEGER) AS weekday, {q.hour('time')} AS hour,
count(*) AS n FROM ticks GROUP BY ALL), {MODAL.format(by='symbol, weekday', v='hour')} SELECT * FROM modes""",
    "spread_profile": f"""WITH {q.TICKS}, s AS (SELECT symbol, time // 86400 AS day, round(price - 2.0, 2) AS spread FROM ticks),
g AS (SELECT symbol, day, count(*) AS quotes, list_sort(list(spread) FILTER (spread > 0)) AS u FROM s GROUP BY ALL) SELECT symbol, day, quotes,
round(coalesce(len(u), 0) / quotes, 6) AS share, round(u[len(u) // 2 + 1], 6) AS median, round(u[CAST(floor(len(u) * 0.95) AS INTEGER) + 1], 6) AS p95
FROM g""",
    "coverage": f"""WITH {q.TICKS}, g AS (SELECT symbol, CAST(year({q.day('time')}) AS INTEGER) AS year, count(*) AS rows, list_sort(list(volume)
FILTER (volume <> 0)) AS u FROM ticks GROUP BY ALL) SELECT symbol, year, rows, CAST(coalesce(len(u), 0) AS BIGINT) AS recorded, u[1] AS least,
u[len(u) // 2 + 1] AS median, u[len(u)] AS most, round(coalesce(len(u), 0) / rows, 6) AS share FROM g""",
    "hours_present": f"WITH {q.BARS} SELECT symbol, time // 86400 AS day, count(DISTINCT time % 86400 // 3600) AS hours FROM bars GROUP BY ALL",
    "session_runs": f"""WITH {q.DAILY}, s AS (SELECT symbol, time // 86400 AS day, n >= 2 AS state FROM daily),
f AS (SELECT *, CASE WHEN lag(state) OVER w IS NOT DISTINCT FROM state THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY symbol ORDER BY
day)),
r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY symbol ORDER BY day) AS BIGINT) AS run FROM f) SELECT symbol, run, state, min(day) AS first,
max(day) AS last, count(*) AS days FROM r GROUP BY symbol, run, state""",
    "largest_gaps": f"""WITH {q.DAILY}, g AS (SELECT symbol, time AS before, lead(time) {q.SERIES}) AS after FROM daily) SELECT symbol, before, after,
(after - before) // 86400 - 1 AS missing FROM g WHERE after - before > 86400 ORDER BY missing DESC, symbol, before LIMIT 15""",
    "fold_counts": f"WITH {MEMBERS} SELECT symbol, fold, " + ", ".join(f"CAST(count(*) FILTER (role = '{r}') AS BIGINT) AS {r}" for r in ("train",
        "test", "purged", "embargoed")) + " FROM members GROUP BY symbol, fold",
    "fold_counts_both_sides": f"""WITH {MEMBERS}, sides AS (SELECT s.symbol, f.fold, CASE WHEN s.bar_seq BETWEEN f.test_start AND f.test_end - 1 THEN CASE WHEN (s.bar_seq - f.test_start) % 5 = 0 THEN 'test' END
  WHEN s.bar_seq < f.test_start AND s.bar_seq + 5 >= f.test_start THEN 'purged' WHEN s.bar_seq >= f.test_end AND s.bar_seq < f.test_end + 5 THEN 'embargoed' ELSE 'train' END AS role FROM series s JOIN folds f USING (symbol) WHERE s.valid)
SELECT symbol, fold, """ + ", ".join(f"CAST(count(*) FILTER (role = '{r}') AS BIGINT) AS {r}" for r in ("train", "test", "purged", "embargoed")) + " FROM sides WHERE role IS NOT NULL GROUP BY symbol, fold",
    "refused_series": f"""WITH {q.BARS}, n AS (SELECT symbol, max(bar_seq) + 1 AS bars FROM bars GROUP BY symbol) SELECT symbol, bars, 'SERIES_TOO_SHORT' AS refusal FROM n WHERE (bars - CAST(floor(bars * 0.5) AS BIGINT)) // 340 <= 0""",
    "fold_leaks": f"""WITH {MEMBERS} SELECT f.symbol, f.fold, CAST((SELECT count(*) FROM members a JOIN members b USING (symbol, fold, bar_seq) WHERE
a.role = 'train' AND b.role = 'test' AND a.symbol = f.symbol AND a.fold = f.fold) AS BIGINT) AS overlap, coalesce((SELECT max(bar_seq) + 5 FROM
members m WHERE m.symbol = f.symbol AND m.fold = f.fold AND role = 'train') >= f.test_start, false) AS reaches FROM folds f""",
    "brier_skill": f"""WITH {MEMBERS} SELECT symbol, fold, count(*) AS n, round(avg((p - y) ** 2), 6) AS brier, round(avg(y), 6) AS base_rate,
round(CASE WHEN {_ref} > 1e-15 THEN 1 - avg((p - y) ** 2) / ({_ref}) END, 6) AS skill FROM forecasts GROUP BY GROUPING SETS ((symbol, fold), (symbol))""",
    "hit_rates": f"""WITH {MEMBERS}, b AS (SELECT symbol, fold, avg(y) AS base FROM forecasts GROUP BY ALL) SELECT f.symbol, f.fold, count(*) AS n,
round(avg((base - y) ** 2 - (p - y) ** 2), 6) AS gain, round(avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS long_share, round(avg(CASE WHEN (p >
0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM forecasts f JOIN b USING (symbol, fold) GROUP BY f.symbol, f.fold""",
    "target_means": f"""WITH {MEMBERS}, k AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY r5, bar_seq) - 1) // 4 AS b FROM series WHERE
valid) SELECT symbol, bar_seq, round(avg(label) OVER (PARTITION BY symbol, b), 6) AS leak FROM k""",
    "standardised": f"""WITH {MEMBERS}, x AS (SELECT m.*, s.r5, s.rp FROM members m JOIN series s USING (symbol, bar_seq)),
fit AS (SELECT symbol, fold, avg(r5) AS m1, stddev_pop(r5) AS s1, avg(rp) AS m2, stddev_pop(rp) AS s2 FROM x WHERE role = 'train' GROUP BY ALL) SELECT
x.symbol, x.fold, x.bar_seq, round((r5 - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 6) AS log_return_5, round((rp - m2) / CASE WHEN s2 = 0 THEN 1 ELSE
s2 END, 6) AS range_position_24 FROM x JOIN fit USING (symbol, fold) WHERE role = 'test'""",
    "eligibility": f"""WITH {MEMBERS}, s AS (SELECT symbol, 1 AS a, valid AS b, valid AND label IS NOT NULL AS c, valid AND label IS NOT NULL AND
bar_seq % 5 = 0 AS d FROM series),
g AS (SELECT symbol, count(*) AS a, count(*) FILTER (b) AS b, count(*) FILTER (c) AS c, count(*) FILTER (d) AS d FROM s GROUP BY symbol) SELECT
symbol, 'all' AS step, CAST(a AS BIGINT) AS rows FROM g UNION ALL SELECT symbol, 'valid', CAST(b AS BIGINT) FROM g UNION ALL SELECT symbol,
'has_label', CAST(c AS BIGINT) FROM g UNION ALL SELECT symbol, 'on_grid', CAST(d AS BIGINT) FROM g""",
    "fold_eras": f"""WITH {MEMBERS} SELECT m.symbol, m.fold, m.role, s.time // 864000 AS era, count(*) AS n FROM members m JOIN series s USING
(symbol, bar_seq) WHERE role IN ('train', 'test') GROUP BY ALL""",
    "untested_eras": f"""WITH {MEMBERS} SELECT DISTINCT symbol, time // 864000 AS era FROM series EXCEPT SELECT m.symbol, s.time // 864000 FROM
members m JOIN series s USING (symbol, bar_seq) WHERE role = 'test'""",
    "fold_geometry_report": f"""WITH {GEOMETRY},
tested AS (SELECT DISTINCT symbol, split, horizon, era FROM roles WHERE role = 'test'),
never AS (SELECT g.symbol, g.split, g.horizon, string_agg(e.era::VARCHAR, ',' ORDER BY e.era::VARCHAR) AS untested
  FROM (SELECT DISTINCT symbol, split, horizon FROM grid) g JOIN eras e USING (symbol) ANTI JOIN tested USING (symbol, split, horizon, era) GROUP BY ALL)
SELECT c.symbol, c.split, c.horizon, p.n_params, sum(test)::BIGINT AS pooled, min(test) AS fold_min, max(test) AS fold_max, round(sum(test) / 150, 6) AS floors,
  max(train) FILTER (fold = 0) AS train_first, max(train) FILTER (fold = 0) // p.n_params AS rows_per_param,
  (SELECT count(*) FROM tested t WHERE t.symbol = c.symbol AND t.split = c.split AND t.horizon = c.horizon) AS eras_tested,
  count(*) FILTER (straddles <> '') AS straddling, coalesce(any_value(n.untested), '') AS untested
FROM counted c LEFT JOIN never n USING (symbol, split, horizon), (SELECT unnest([{", ".join(map(str, PARAMETERS))}]::BIGINT[]) AS n_params) p
GROUP BY c.symbol, c.split, c.horizon, p.n_params""",
    "fold_geometry_folds": f"WITH {GEOMETRY} SELECT * FROM counted",
    "fold_geometry_eras": f"""WITH {GEOMETRY} SELECT symbol, split, horizon, fold, role, era, count(*) AS n,
round(count(*) / sum(count(*)) OVER (PARTITION BY symbol, split, horizon, fold, role), 6) AS share FROM roles GROUP BY symbol, split, horizon, fold, role, era""",
    "train_and_test": f"""WITH {MEMBERS}, u AS (SELECT DISTINCT symbol, fold, bar_seq FROM members WHERE role IN ('train', 'test')) SELECT symbol,
fold, count(*) AS rows, CAST(sum(bar_seq) AS BIGINT) AS total FROM u GROUP BY ALL""",
}
