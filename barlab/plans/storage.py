"""Queries over digests, summaries, invariants and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barlab.functions import calendar, clock
from barlab.operators import gaps as ga
from barlab.operators import invariants as iv
from barlab.plans import sql as q
from barlab.plans.account import ACCOUNT, risk_alerts
from barlab.plans.account import _deals as deals
from barlab.plans.bars import checked_bars, gaps, ny
from barlab.sources import snapshot
from barlab.sources.shared import shared_folder
from barlab.sources.tables import hourly_bars
from barlab.streaming import jobs


def table_digest(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return snapshot.table_digest(e, "event_type", "event_id", ["event_id", "user_id", "event_type", "props"])


def snapshot_summary(spark, d):
    b = ga.window_validity(checked_bars(spark, d), 24, 24, 24).withColumn("in_window", clock.day_of(F.col("time")) >= F.lit("2015-09-11").cast("date"))
    return snapshot.summary(b)


def invariants(spark, d, least=60):
    b = hourly_bars(spark, d).withColumn("utc", clock.to_utc(F.col("time")))
    h = calendar.us_market_holidays(spark, 1994, 2025)
    return iv.all_outcomes(b, gaps(spark, d), calendar.near_holidays(h), calendar.near_holidays(h, 4), calendar.first_fridays(spark, "2015-01-01", "2025-12-31"), least)


def invariants_any(spark, d):
    """The invariants where one first Friday is enough, as the given bars span a month."""
    return invariants(spark, d, 1)


def duplicate_keys(spark, d):
    """(order, line number) pairs that different line items share."""
    from barlab.sources.scans import conflicting_duplicates

    return conflicting_duplicates(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


def streamed_bars(spark, d):
    """Hourly bars of the events read as a stream, in one run over all that is there: those that the watermark, ten minutes behind the last event, has closed."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    t = e.select(F.col("event_type").alias("symbol"), F.timestamp_seconds(clock.wall_seconds(F.col("ts"))).alias("ts"), F.col("event_id")
        .alias("tick_id"), (F.col("value") + 1.0).alias("price"), F.get_json_object("props", "$.k").cast("long").alias("volume"))
    path = f"{shared_folder(spark)}/barlab/stream-{uuid.uuid4().hex}"
    bars = jobs.roll_up_stream(t).writeStream.outputMode("append").format("parquet").option("path", f"{path}/bars").option("checkpointLocation", f"{path}/checkpoint")
    bars.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/bars")


def sent_alerts(spark, d):
    """Each reading of an account (its deals' times) raises all of the account's alerts; of those, what the throttle lets out."""
    readings = deals(spark, d).select("account", F.col("closed_at").alias("raised_at")).distinct()
    a = risk_alerts(spark, d).join(readings, "account").withColumn("account", F.col("account").cast("string"))
    return jobs.throttle(a.select("account", "code", "key", "severity", "raised_at"))


def _invariants(least: int) -> str:
    hour = lambda t: f"(({t}) % 86400 // 3600)"
    utc = lambda t: f"({t} - {q.offset(q.day(t))} * 3600)"
    return f"""WITH {q.BARS}, {q.GAPS}, {q.near(4, 'near_wide')},
timed AS (SELECT *, {utc('time')} AS utc FROM bars),
local AS (SELECT *, {ny('utc')} AS ny FROM timed),
symbols AS (SELECT DISTINCT symbol FROM bars),
closing AS (SELECT symbol, before, {utc('before')} AS utc FROM gaps WHERE after - before >= 86400),
closes AS (SELECT symbol, {hour(ny('utc'))} AS ny_hour, {hour('utc')} AS utc_hour, {q.us(q.day('before'))} AS summer, h.holiday IS NOT NULL AS explained
  FROM closing c LEFT JOIN near_wide h ON h.day = {q.day('before')}),
weekly AS (SELECT symbol, count(*) AS n, count(*) FILTER (ny_hour <> 16) AS off, count(*) FILTER (ny_hour <> 16 AND NOT explained) AS unexplained,
  list_distinct(list(utc_hour) FILTER (ny_hour = 16 AND summer)) AS s, list_distinct(list(utc_hour) FILTER (ny_hour = 16 AND NOT summer)) AS w FROM closes GROUP BY symbol),
fridays AS (SELECT f AS day FROM (SELECT unnest(generate_series(DATE '2015-01-01', DATE '2025-12-31', INTERVAL 1 DAY))::DATE AS f) WHERE dayofweek(f) = 5 AND day(f) <= 7),
days AS (SELECT symbol, {q.day('ny')} AS day, {hour('ny')} AS ny_hour, {hour('utc')} AS h, tick_volume, (ny // 86400 + 3) % 7 AS weekday FROM local),
spans AS (SELECT symbol, min(day) AS a, max(day) AS b FROM days GROUP BY symbol),
released AS (SELECT symbol, day, max(h) AS h FROM days WHERE ny_hour = 8 GROUP BY ALL),
asked AS (SELECT s.symbol, f.day, x.h, {q.us('f.day')} AS summer, n.holiday FROM spans s JOIN fridays f ON f.day BETWEEN s.a AND s.b
  LEFT JOIN released x ON x.symbol = s.symbol AND x.day = f.day LEFT JOIN near n ON n.day = f.day),
release AS (SELECT symbol, count(*) AS n, count(*) FILTER (h IS NULL AND holiday IS NULL) AS lost, count(DISTINCT h) FILTER (summer) > 1 OR count(DISTINCT h) FILTER (NOT summer) > 1 AS several FROM asked GROUP BY symbol),
morning AS (SELECT * FROM days WHERE weekday = 4 AND ny_hour BETWEEN 5 AND 12),
base AS (SELECT symbol, ny_hour, median(tick_volume) AS base FROM morning WHERE day(day) > 7 GROUP BY ALL HAVING median(tick_volume) > 0),
peaks AS (SELECT m.symbol, m.day, arg_max(m.ny_hour, (m.tick_volume / b.base, -m.ny_hour)) AS peak FROM morning m JOIN base b USING (symbol, ny_hour) WHERE day(m.day) <= 7 GROUP BY ALL),
counts AS (SELECT symbol, peak, count(*) AS k FROM peaks GROUP BY ALL),
modes AS (SELECT symbol, sum(k) AS n, arg_max(peak, (k, -peak)) AS mode, max(k) / sum(k) AS share FROM counts GROUP BY symbol),
breaks AS (SELECT symbol, {utc('(before + 3600)')} AS utc FROM gaps WHERE cause = 'daily_break'),
broken AS (SELECT symbol, count(*) FILTER ({hour(ny('utc'))} <> 17) AS off FROM breaks GROUP BY symbol)
SELECT symbol, 'weekly_close' AS name, CASE WHEN n IS NULL THEN 'insufficient' WHEN off > 0.1 * n OR unexplained > 0 OR len(s) > 1 OR len(w) > 1 OR coalesce((w[1] - s[1] + 24) % 24 <> 1, false) THEN 'fail' ELSE 'pass' END AS outcome
FROM symbols LEFT JOIN weekly USING (symbol)
UNION ALL SELECT symbol, 'release_hour', CASE WHEN coalesce(n, 0) < {least} THEN 'insufficient' WHEN lost > 0 OR several THEN 'fail' ELSE 'pass' END FROM symbols LEFT JOIN release USING (symbol)
UNION ALL SELECT symbol, 'volume_peak', CASE WHEN coalesce(n, 0) < {least} THEN 'insufficient' WHEN mode = 8 AND share >= 0.25 THEN 'pass' ELSE 'fail' END FROM symbols LEFT JOIN modes USING (symbol)
UNION ALL SELECT symbol, 'daily_break', CASE WHEN off IS NULL THEN 'insufficient' WHEN off > 0 THEN 'fail' ELSE 'pass' END FROM symbols LEFT JOIN broken USING (symbol)"""


QUERIES = {f.__name__: f for f in (table_digest, snapshot_summary, invariants, invariants_any, duplicate_keys, streamed_bars, sent_alerts)}
SQL = {
    "invariants": _invariants(60),
    "invariants_any": _invariants(1),
    "table_digest": """WITH l0 AS (SELECT event_type, event_id AS pos, 1 AS n, sha256(CAST(to_json({event_id: event_id, user_id: user_id, event_type: event_type, props: props}) AS VARCHAR)) AS d FROM events),
""" + ",\n".join(f"l{k} AS (SELECT event_type, pos // 1000 AS pos, sum(n) AS n, sha256(string_agg(d, '' ORDER BY l{k - 1}.pos)) AS d FROM l{k - 1} GROUP BY event_type, l{k - 1}.pos // 1000)" for k in range(1, 7)) + """
SELECT event_type, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(d, '' ORDER BY pos)) AS digest FROM l6 GROUP BY event_type""",
    "snapshot_summary": f"""WITH {q.VALID}, w AS (SELECT *, {q.whole(0, 24)} AS lv FROM checked) SELECT symbol, count(*) AS rows, CAST(count(*) FILTER
({q.day('time')} >= DATE '2015-09-11') AS BIGINT) AS in_window, CAST(count(*) FILTER (valid) AS BIGINT) AS valid, CAST(count(*) FILTER (lv) AS BIGINT)
AS label_valid, min(time) AS first_bar, max(time) AS last_bar, max(time) // 86400 - 1 AS window_end FROM w GROUP BY symbol""",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM (SELECT DISTINCT * FROM lineitem) GROUP BY ALL HAVING count(*) > 1",
    "streamed_bars": f"WITH {q.BARS} SELECT symbol, time, open, high, low, close, tick_volume, n FROM bars WHERE time + 3600 <= (SELECT floor(epoch(max(ts))) - 600 FROM events)",
    # an alert goes out when its key's last was sent an hour ago or more; a key has one severity
    "sent_alerts": f"""WITH RECURSIVE {ACCOUNT},
raised AS MATERIALIZED (SELECT DISTINCT account, code, key, severity, closed_at AS raised_at FROM alerts JOIN deals USING (account)),
sent AS (
  SELECT account, code, key, severity, min(raised_at) AS raised_at FROM raised GROUP BY ALL
  UNION ALL
  SELECT r.account, r.code, r.key, r.severity, min(r.raised_at) FROM sent s JOIN raised r ON r.account = s.account AND r.code = s.code AND r.key = s.key AND r.severity = s.severity AND r.raised_at >= s.raised_at + 3600 GROUP BY ALL)
SELECT CAST(account AS VARCHAR) AS account, code, key, severity, raised_at FROM sent""",
}
