"""Queries over positions, deals and accounts that are derived from orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.functions.clock import wall_seconds
from barlab.operators import account as ac
from barlab.plans import sql as q
from barlab.plans.bars import _rounded

NOW, OFFSET = 1009843200, 3.0  # 2002-01-01, UTC

#: (symbol, point, tick_size, tick_value, min, max, step, spread, swap_mode, swap_long, swap_short, margin currency); the last priority has no terms.
TERMS = (
    ("1-URGENT", 0.01, 0.01, 1.0, 0.01, 50.0, 0.01, 30.0, 1, -6.5, 2.1, "USD"), ("2-HIGH", 0.01, 0.01, 1.0, 0.1, 5.0, 0.1, 20.0, 4, -4.0, -1.0, "USD"),
    ("3-MEDIUM", 0.001, 0.0, 1.0, 0.01, 50.0, 0.01, 25.0, 3, -2.0, -2.0, "EUR"), ("4-NOT SPECIFIED", 0.1, 0.05, 2.0, 0.01, 50.0, 0.0, 15.0, 6, -1.0, -1.0, "USD"),
)
_COLUMNS = "symbol, point, tick_size, tick_value, volume_min, volume_max, volume_step, spread_points, swap_mode, swap_long, swap_short, currency_margin"


def _terms(spark):
    kinds = ["string", *["double"] * 7, "int", "double", "double", "string"]
    return ac.declared_swaps(spark.createDataFrame(list(TERMS), ", ".join(f"{c} {k}" for c, k in zip(_COLUMNS.split(", "), kinds, strict=True))), "USD")


def _accounts(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey")
    return c.select(k.alias("account"), (F.col("c_acctbal") + 2000.0).alias("equity"), F.when(k % 11 == 0, 0.0).otherwise((k % 97) * 20.0)
        .alias("margin"), F.when(k % 13 == 0, 2).otherwise(k % 2).cast("int").alias("stopout_mode"), F.when(k % 17 == 0, 9000).otherwise(500)
            .alias("leverage"), F.lit(100.0).alias("call_level"), F.lit(50.0).alias("stop_level"))


def _positions(spark, d):
    """Open orders as positions."""
    o = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'O'")
    k = F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("account"), k.alias("ticket"), F.col("o_orderpriority").alias("symbol"), F.when(k % 2 == 0, "long")
        .otherwise("short").alias("direction"), ((k % 10 + 1) / 100.0).alias("volume"), (F.col("o_totalprice") / 100.0).alias("price_open"),
            wall_seconds(F.col("o_orderdate")).alias("opened_at"), F.when(k % 3 > 0, F.col("o_totalprice") / 110.0).alias("stop_loss"),
                (-(k % 700) / 100.0).alias("swap"), (((k * 37) % 20000 - 10000) / 100.0).alias("profit"))


def _with_equity(spark, d):
    return _positions(spark, d).join(_accounts(spark, d).select("account", "equity"), "account", "left")


def _deals(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus <> 'O'")
    k = F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("account"), k.alias("ticket"), (((k * 53) % 30000 - 15000) / 100.0).alias("profit"), F.lit(-3.5)
        .alias("commission"), (-(k % 90) / 100.0).alias("swap"), F.lit(0.0).alias("fee"), (wall_seconds(F.col("o_orderdate")) % 864000 + NOW - 432000).alias("closed_at"))


def position_sizes(spark, d):
    """Every open position: one without account or terms has a refusal."""
    rows = _positions(spark, d).join(_accounts(spark, d).select("account", "equity"), "account", "left").join(_terms(spark), "symbol", "left")
    rows = rows.withColumn("atr_points", (F.col("ticket") % 50) * 10.0).withColumn("price", F.col("price_open"))
    return _rounded(ac.size_positions(rows).select("ticket", "lots", "adverse_points", "stop_long", "stop_short", "refusal"))


def position_sizes_all(spark, d):
    """position_sizes under the name that it had when position_sizes kept fewer."""
    return position_sizes(spark, d)


def _carries(spark, d):
    return ac.position_carry(_with_equity(spark, d), _terms(spark), NOW, OFFSET)


def position_carry(spark, d):
    return _rounded(_carries(spark, d).select("account", "ticket", "nights", "carry_paid", "rate_declared", "rate_measured", "rate_nightly", "rate",
        "rate_source", "breakeven_points", "breakeven_price", "carry_pct_of_equity", F.concat_ws(",", F.col("refusals.code")).alias("refusals")), 8)


def carry_projection(spark, d):
    return _rounded(ac.carry_projection(_carries(spark, d)), 10)


def portfolio_carry(spark, d):
    return _rounded(ac.portfolio_carry(_carries(spark, d)), 4)


def measured_points(spark, d):
    return _rounded(ac.measured_points(_carries(spark, d)), 5)


def swap_divergence(spark, d):
    return ac.swap_divergence(_terms(spark), ac.measured_points(_carries(spark, d)), {"long": 6.0, "short": 8.0})


def annual_carry(spark, d):
    """At the mean opening price of each symbol's open positions."""
    return _rounded(ac.annual_carry(_terms(spark), _positions(spark, d).groupBy("symbol").agg(F.avg("price_open").alias("price"))), 6)


def _daily(spark, d):
    return ac.daily_loss(_accounts(spark, d), _positions(spark, d), _deals(spark, d), NOW, OFFSET)


def daily_loss(spark, d):
    return _rounded(_daily(spark, d), 4)


def concurrency(spark, d):
    return ac.concurrency(_positions(spark, d), 5)


def _margin(spark, d):
    return ac.margin_projection(_accounts(spark, d), ac.portfolio_carry(_carries(spark, d)))


def margin_projection(spark, d):
    return _rounded(_margin(spark, d), 4)


def risk_alerts(spark, d):
    c, p = _carries(spark, d), _positions(spark, d)
    moved = openings(spark, d).where("moved").join(p.select("ticket", "account"), "ticket").select("account", F.lit("OPENING_MOVED").alias("timing_refusal")).distinct()
    readings = heartbeat(spark, d).select("account", F.col("clear").alias("connected")).join(moved, "account", "left")
    divergence = p.select("account", "symbol").distinct().join(swap_divergence(spark, d), "symbol")
    return ac.risk_alerts(c, _margin(spark, d), _daily(spark, d), concurrency(spark, d), ac.portfolio_carry(c), readings, divergence)


def worst_severity(spark, d):
    return ac.worst_severity(risk_alerts(spark, d))


def openings(spark, d):
    p = _positions(spark, d)
    was = p.where("ticket % 5 > 0").select("ticket", (F.col("opened_at") - F.when(F.col("ticket") % 7 == 0, 60).otherwise(0)).alias("opened_at"))
    return ac.check_openings(was, p)


def _readings(spark, d):
    """A reading of each account for every line number of its open orders: the orders that have such a line. Some come back in time, some openings move."""
    o = _positions(spark, d).select("account", "ticket", "opened_at")
    l = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("ticket"), F.col("l_linenumber").cast("long").alias("reading"), "l_partkey")
    p = F.struct("ticket", (F.col("opened_at") + F.when(F.col("l_partkey") % 40 == 0, 3600).otherwise(0)).alias("opened_at"))
    back = F.when((F.col("account") % 10 == 0) & (F.col("reading") == 4), 9000).otherwise(0)
    return o.join(l, "ticket").groupBy("account", "reading").agg(F.collect_list(p).alias("positions")).withColumn("read_at", NOW + 3600 * F.col("reading") - back)


def continuity(spark, d):
    """Every position of every reading against the opening first seen."""
    return ac.check_readings(_readings(spark, d))


def heartbeat(spark, d):
    r = _deals(spark, d).where("account % 4 > 0").select("account", F.col("closed_at").alias("reading_at"))
    return ac.heartbeat(_accounts(spark, d), r, NOW + 432000 - 86400, 86400 * 2)


def clock_offsets(spark, d):
    o = _deals(spark, d)
    r = o.select("account", F.col("closed_at").alias("host_at"), (F.col("closed_at") + 10800 + F.col("ticket") % 900 - 450).alias("server_at"),
        F.when(F.col("ticket") % 50 == 0, 2).alias("explicit"), "ticket")
    # one reading at a time: the smallest ticket's
    return ac.clock_offsets(r.groupBy("account", "host_at").agg(F.min_by("server_at", "ticket").alias("server_at"), F.min_by("explicit", "ticket").alias("explicit")))


def _log(spark, d):
    """Readings of each supplier's shipments as a carry log: cumulative charges, a price, and the server's offset."""
    from pyspark.sql import Window

    l = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("ticket"), wall_seconds(F.col("l_shipdate"))
        .alias("at")).agg(F.min("l_extendedprice").alias("price"), F.sum("l_linenumber").alias("n"))
    return l.withColumn("carry_paid", F.sum(F.col("n") * 1.5).over(Window.partitionBy("ticket").orderBy("at"))).withColumn("offset", F.lit(2.0)).drop("n")


def nightly_charges(spark, d):
    return _rounded(ac.nightly_charges(_log(spark, d)))


def charge_structure(spark, d):
    return _rounded(ac.charge_structure(ac.nightly_charges(_log(spark, d))), 7)


QUERIES = {f.__name__: f for f in (position_sizes, position_sizes_all, position_carry, carry_projection, portfolio_carry, measured_points,
    swap_divergence, annual_carry, daily_loss, concurrency, margin_projection, risk_alerts, worst_severity, openings, continuity, heartbeat, clock_offsets,
        nightly_charges, charge_structure)}
_lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
_PV = "CASE WHEN point > 0 AND tick_size > 0 AND tick_value > 0 THEN tick_value * point / tick_size END"
_W = "CAST(floor(epoch({0})) AS BIGINT)"
ACCOUNT = f"""raw_terms AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_lit, r)) + ')' for r in TERMS)}) t({_COLUMNS})),
coded AS (SELECT *, CAST({_PV} AS DOUBLE) AS pv, CASE WHEN swap_mode NOT IN (0, 1, 3, 4) THEN 'SWAP_MODE_UNSUPPORTED' WHEN swap_mode = 3 AND currency_margin <> 'USD' THEN 'SWAP_CURRENCY_MISMATCH' WHEN swap_mode IN (3, 4) AND ({_PV}) IS NULL THEN 'NO_POINT_VALUE' END AS sr FROM raw_terms),
terms AS (SELECT *, CASE WHEN sr IS NULL THEN CASE swap_mode WHEN 0 THEN 0.0 WHEN 1 THEN -swap_long ELSE -swap_long / pv END END AS charge_long, CASE WHEN sr IS NULL THEN CASE swap_mode WHEN 0 THEN 0.0 WHEN 1 THEN -swap_short ELSE -swap_short / pv END END AS charge_short FROM coded),
accounts AS (SELECT c_custkey AS account, c_acctbal + 2000.0 AS equity, CASE WHEN c_custkey % 11 = 0 THEN 0.0 ELSE (c_custkey % 97) * 20.0 END AS margin, CASE WHEN c_custkey % 13 = 0 THEN 2 ELSE c_custkey % 2 END AS stopout_mode, CASE WHEN c_custkey % 17 = 0 THEN 9000 ELSE 500 END AS leverage FROM customer),
positions AS (SELECT o_custkey AS account, o_orderkey AS ticket, o_orderpriority AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS direction, (o_orderkey % 10 + 1) / 100.0 AS volume, o_totalprice / 100.0 AS price_open, {_W.format('o_orderdate')} AS opened_at, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 110.0 END AS stop_loss, -(o_orderkey % 700) / 100.0 AS swap, ((o_orderkey * 37) % 20000 - 10000) / 100.0 AS profit FROM orders WHERE o_orderstatus = 'O'),
deals AS (SELECT o_custkey AS account, o_orderkey AS ticket, ((o_orderkey * 53) % 30000 - 15000) / 100.0 AS profit, -3.5 AS commission, -(o_orderkey % 90) / 100.0 AS swap, 0.0 AS fee, {_W.format('o_orderdate')} % 864000 + {NOW} - 432000 AS closed_at FROM orders WHERE o_orderstatus <> 'O'),
night AS (SELECT p.*, a.equity, t.point, t.pv, t.symbol IS NOT NULL AS has_terms, ({NOW} - opened_at) / 86400.0 AS days, CASE WHEN {NOW} <= opened_at THEN 0 ELSE ({NOW} + 10800) // 86400 - (opened_at + 10800) // 86400 END AS nights, -p.swap AS paid, CASE WHEN direction = 'long' THEN t.charge_long ELSE t.charge_short END * t.pv * p.volume AS declared FROM positions p LEFT JOIN terms t USING (symbol) LEFT JOIN accounts a USING (account)),
rated AS (SELECT *, CASE WHEN days >= 1 AND paid <> 0 THEN paid / days END AS measured, CASE WHEN days >= 1 AND paid <> 0 AND nights > 0 THEN paid / nights END AS nightly FROM night),
carries AS (SELECT *, CASE WHEN declared IS NULL OR measured > declared THEN measured ELSE declared END AS rate, CASE WHEN declared IS NULL AND measured IS NULL THEN 'none' WHEN measured IS NULL THEN 'declared' WHEN declared IS NULL THEN 'measured' WHEN measured > declared THEN 'more_adverse_of_both' ELSE 'declared' END AS source, CASE WHEN volume * pv <> 0 THEN paid / (volume * pv) END AS bp, CASE WHEN equity > 0 THEN 100.0 * paid / equity END AS pct FROM rated),
book AS (SELECT account, count(*) AS positions, sum(paid) AS carry_paid, sum(rate) AS rate, sum(declared) AS rate_declared, sum(measured) AS rate_measured, count(*) FILTER (rate IS NULL) > 0 AS partial, max(equity) AS equity FROM carries GROUP BY account),
books AS (SELECT *, CASE WHEN rate > 0 AND equity > 0 THEN equity / rate END AS days_to_zero FROM book),
weighted AS (SELECT symbol, direction, count(measured) AS positions, CASE WHEN count(measured / (volume * pv)) > 0 THEN sum(measured / (volume * pv) * volume) / sum(volume) FILTER (measured / (volume * pv) IS NOT NULL) END AS daily, CASE WHEN count(nightly / (volume * pv)) > 0 THEN sum(nightly / (volume * pv) * volume) / sum(volume) FILTER (nightly / (volume * pv) IS NOT NULL) END AS nightly FROM carries GROUP BY ALL),
bounds AS (SELECT ({NOW} + 10800) // 86400 * 86400 - 10800 AS s),
done AS (SELECT account, sum(profit + commission + swap + fee) AS realised, count(*) AS deals FROM deals, bounds WHERE closed_at >= s AND closed_at < s + 86400 GROUP BY account),
floating AS (SELECT account, sum(profit + swap) AS floating, count(*) FILTER (opened_at < s) AS carried_in FROM positions, bounds GROUP BY account),
day0 AS (SELECT a.account, a.equity, coalesce(realised, 0) AS realised, coalesce(floating, 0) AS floating, coalesce(deals, 0) AS deals, coalesce(carried_in, 0) AS carried_in FROM accounts a LEFT JOIN done USING (account) LEFT JOIN floating USING (account)),
day1 AS (SELECT *, (equity - realised - floating) * 2.0 / 100.0 AS lim, greatest(0.0, -(realised + floating)) AS loss FROM day0),
days AS (SELECT *, CASE WHEN lim > 0 THEN loss / lim END AS used, lim > 0 AND loss >= lim AS breached FROM day1),
levels AS (SELECT a.account, a.equity, a.margin, CASE WHEN leverage NOT BETWEEN 1 AND 5000 THEN 'IMPLAUSIBLE_LEVERAGE' WHEN stopout_mode NOT IN (0, 1) THEN 'STOPOUT_MODE_UNKNOWN' WHEN margin <= 0 THEN 'NO_MARGIN_IN_USE' END AS refusal, stopout_mode, b.rate, x.level, x.value FROM accounts a LEFT JOIN books b USING (account), (VALUES ('call', 100.0), ('stop_out', 50.0)) x(level, value)),
heads AS (SELECT *, CASE WHEN refusal IS NULL THEN CASE stopout_mode WHEN 0 THEN margin * value / 100.0 ELSE value END END AS threshold FROM levels),
margins AS (SELECT account, level, CASE WHEN margin > 0 THEN 100.0 * equity / margin END AS level_pct, threshold, equity - threshold AS headroom, equity - threshold <= 0 AS breached, CASE WHEN NOT (equity - threshold <= 0) AND rate > 0 THEN (equity - threshold) / rate END AS days, refusal FROM heads),
counts AS (SELECT account, symbol, direction, count(*) AS open, CASE WHEN grouping(symbol) = 1 AND grouping(direction) = 1 THEN count(*) >= 5 END AS breached FROM positions GROUP BY GROUPING SETS ((account), (account, symbol), (account, direction))),
-- what is registered, 6 points a night long and 8 short, against what is published and measured
sides AS (SELECT symbol, 'long' AS direction, 42.0 AS reg, charge_long * 7 AS published FROM terms UNION ALL SELECT symbol, 'short', 56.0, charge_short * 7 FROM terms),
sided AS (SELECT s.*, w.daily * 7 AS daily, w.nightly * 7 AS nightly FROM sides s LEFT JOIN weighted w USING (symbol, direction)),
compared AS (
  SELECT symbol, published > reg AS e FROM sided WHERE published IS NOT NULL
  UNION ALL SELECT symbol, daily > reg * 1.05 FROM sided WHERE daily IS NOT NULL
  UNION ALL SELECT symbol, nightly > reg * 1.05 FROM sided WHERE nightly IS NOT NULL),
verdicts AS (
  SELECT t.symbol, t.swap_mode IN (2, 5, 6, 7, 8) AS price_dependent, count(c.e) AS comparisons, CAST(count(*) FILTER (c.e) AS BIGINT) AS exceeding,
    CASE WHEN count(c.e) = 0 THEN 'UNAVAILABLE' WHEN bool_or(c.e) THEN 'OPTIMISTIC' ELSE 'CONSERVATIVE' END AS verdict
  FROM terms t LEFT JOIN compared c USING (symbol) GROUP BY t.symbol, t.swap_mode),
diverging AS (SELECT *, verdict = 'OPTIMISTIC' OR price_dependent AS bears_on_registry FROM verdicts),
seen AS (SELECT account, max(closed_at) AS last FROM deals WHERE account % 4 > 0 GROUP BY account),
moved AS (SELECT DISTINCT account FROM positions WHERE ticket % 5 > 0 AND ticket % 7 = 0),
timed AS (SELECT * FROM carries WHERE account NOT IN (SELECT account FROM moved)),
alerts AS (
  SELECT account, 'TIME_IN_TRADE' AS code, CASE WHEN days >= 6 THEN 'CRITICAL' ELSE 'WARN' END AS severity, CAST(ticket AS VARCHAR) AS key FROM timed WHERE days >= 2
  UNION ALL SELECT account, 'CARRY_OF_EQUITY', CASE WHEN pct >= 3 THEN 'CRITICAL' ELSE 'WARN' END, CAST(ticket AS VARCHAR) FROM timed WHERE pct >= 1
  UNION ALL SELECT account, 'NO_STOP', 'WARN', CAST(ticket AS VARCHAR) FROM timed WHERE stop_loss IS NULL OR stop_loss = 0
  UNION ALL SELECT account, 'MARGIN_BREACHED', 'CRITICAL', level FROM margins WHERE breached
  UNION ALL SELECT account, 'MARGIN_NEAR', CASE WHEN days <= 7 THEN 'CRITICAL' ELSE 'WARN' END, level FROM margins WHERE days <= 30
  UNION ALL SELECT account, 'DAILY_LOSS', 'CRITICAL', 'day' FROM days WHERE breached
  UNION ALL SELECT account, 'DAILY_LOSS_NEAR', 'WARN', 'day' FROM days WHERE NOT breached AND used >= 0.75
  UNION ALL SELECT account, 'CONCURRENCY', 'WARN', 'open' FROM counts WHERE breached
  UNION ALL SELECT account, 'CARRY_EMPTIES_EQUITY', 'WARN', 'book' FROM books WHERE days_to_zero <= 90
  UNION ALL SELECT account, 'REFUSED', 'WARN', refusal FROM margins WHERE level = 'stop_out' AND refusal IN ('STOPOUT_MODE_UNKNOWN', 'IMPLAUSIBLE_LEVERAGE')
  UNION ALL SELECT account, 'REFUSED', 'CRITICAL', 'OPENING_MOVED' FROM moved
  UNION ALL SELECT account, 'DISCONNECTED', 'CRITICAL', 'reading' FROM accounts LEFT JOIN seen USING (account) WHERE NOT coalesce({NOW + 432000 - 86400} - last <= 172800, false)
  UNION ALL SELECT DISTINCT account, 'SWAP_DIVERGENCE', 'CRITICAL', symbol FROM positions JOIN diverging USING (symbol) WHERE bears_on_registry)"""
_d = lambda x, n=5: f"round(CAST({x} AS DOUBLE), {n}) + 0.0"
LOG = f"""log0 AS (SELECT l_suppkey AS ticket, {_W.format('l_shipdate')} AS tick, min(l_extendedprice) AS price, sum(l_linenumber) AS n FROM lineitem
GROUP BY ALL),
log AS (SELECT *, sum(n * 1.5) OVER (PARTITION BY ticket ORDER BY tick) AS carry FROM log0),
steps AS (SELECT *, CAST(round(carry - lag(carry) OVER (PARTITION BY ticket ORDER BY tick), 8) AS DOUBLE) AS charge FROM log),
units AS (SELECT ticket, median(abs(charge)) AS unit FROM steps WHERE charge <> 0 GROUP BY ticket),
charges AS (SELECT s.ticket, s.tick, s.charge, u.unit, greatest(1.0, round_even(abs(s.charge) / u.unit, 0)) AS multiplier, CAST(((tick + 7200) //
86400 + 3) % 7 AS INTEGER) AS weekday, s.price FROM steps s JOIN units u USING (ticket) WHERE s.charge <> 0)"""
SQL = {
    "position_sizes": f"""WITH {ACCOUNT}, x AS (SELECT p.ticket, a.equity, t.*, (p.ticket % 50) * 10.0 AS atr, p.price_open AS price FROM positions p JOIN accounts a USING (account) JOIN terms t USING (symbol)),
y AS (SELECT *, 1.5 * atr + spread_points AS adverse FROM x), z AS (SELECT *, equity * 1.0 / 100.0 / (adverse * pv) AS wanted FROM y),
s AS (SELECT *, CASE WHEN volume_step > 0 THEN round(floor(CASE WHEN volume_max > 0 AND wanted > volume_max THEN volume_max ELSE wanted END / volume_step + 1e-9) * volume_step, 8) END AS lots FROM z),
c AS (SELECT *, CASE WHEN atr <= 0 THEN 'NO_VOLATILITY' WHEN pv IS NULL THEN 'NO_POINT_VALUE' WHEN volume_step <= 0 THEN 'NO_VOLUME_STEP' WHEN spread_points < 0 THEN 'NO_POINT_VALUE' WHEN lots < volume_min THEN 'BELOW_MINIMUM_VOLUME' END AS refusal FROM s)
SELECT ticket, CASE WHEN refusal IS NULL THEN {_d('lots', 6)} END AS lots, CASE WHEN refusal IS NULL THEN {_d('adverse', 6)} END AS adverse_points, CASE WHEN refusal IS NULL THEN {_d('price - 1.5 * atr * point', 6)} END AS stop_long, CASE WHEN refusal IS NULL THEN {_d('price + 1.5 * atr * point', 6)} END AS stop_short, refusal FROM c""",
    "position_carry": f"WITH {ACCOUNT} SELECT account, ticket, CAST(nights AS BIGINT) AS nights, {_d('paid', 8)} AS carry_paid, {_d('declared', 8)} AS rate_declared, {_d('measured', 8)} AS rate_measured, {_d('nightly', 8)} AS rate_nightly, {_d('rate', 8)} AS rate, source AS rate_source, {_d('bp', 8)} AS breakeven_points, {_d('price_open + bp * point * CASE direction WHEN chr(108) || chr(111) || chr(110) || chr(103) THEN 1.0 ELSE -1.0 END', 8)} AS breakeven_price, {_d('pct', 8)} AS carry_pct_of_equity, concat_ws(',', CASE WHEN NOT has_terms THEN 'SYMBOL_TERMS_MISSING' END, CASE WHEN has_terms AND pv IS NULL THEN 'NO_POINT_VALUE' END, CASE WHEN measured IS NULL THEN 'CARRY_TOO_YOUNG' END, CASE WHEN source = 'none' THEN 'NO_CARRY_RATE' END) AS refusals FROM carries".replace("chr(108) || chr(111) || chr(110) || chr(103)", "'long'"),
    "carry_projection": f"""WITH {ACCOUNT} SELECT account, ticket, CAST(h AS INTEGER) AS horizon, {_d('rate * h', 10)} AS carry,
{_d('paid + rate * h', 10)} AS total, CASE WHEN equity > 0 THEN {_d('100.0 * rate * h / equity', 10)} END AS pct_of_equity FROM carries, (VALUES (7),
(30), (60), (90)) v(h)""",
    "portfolio_carry": f"""WITH {ACCOUNT} SELECT account, positions,
{', '.join(f'{_d(c, 4)} AS {c}' for c in ('carry_paid', 'rate', 'rate_declared', 'rate_measured', 'equity', 'days_to_zero'))}, partial FROM books""",
    "measured_points": f"WITH {ACCOUNT} SELECT symbol, direction, positions, {_d('daily')} AS daily_points, {_d('nightly')} AS nightly_points FROM weighted",
    "annual_carry": f"""WITH {ACCOUNT}, prices AS (SELECT symbol, avg(price_open) AS price FROM positions GROUP BY symbol),
sided_terms AS (SELECT symbol, point, 'long' AS direction, charge_long AS c FROM terms UNION ALL SELECT symbol, point, 'short', charge_short FROM terms)
SELECT symbol, direction, {_d('c', 6)} AS nightly_points, CASE WHEN price > 0 THEN {_d('36500.0 * c * point / price', 6)} END AS annual_pct FROM sided_terms LEFT JOIN prices USING (symbol)""",
    "swap_divergence": f"WITH {ACCOUNT} SELECT * FROM diverging",
    "daily_loss": f"""WITH {ACCOUNT} SELECT account, {', '.join(f'{_d(c, 4)} AS {c}' for c in ('equity', 'realised', 'floating', 'loss', 'used'))},
{_d('lim', 4)} AS \"limit\", CAST(deals AS BIGINT) AS deals, CAST(carried_in AS BIGINT) AS carried_in, breached FROM days""",
    "concurrency": f"WITH {ACCOUNT} SELECT * FROM counts",
    "margin_projection": f"""WITH {ACCOUNT} SELECT account, level, {_d('level_pct', 4)} AS level_pct, {_d('threshold', 4)} AS threshold,
{_d('headroom', 4)} AS headroom, breached, {_d('days', 4)} AS days, refusal FROM margins""",
    "risk_alerts": f"WITH {ACCOUNT} SELECT * FROM alerts",
    "worst_severity": f"WITH {ACCOUNT} SELECT account, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' ELSE 'WARN' END AS worst, count(*) AS alerts FROM alerts GROUP BY account",
    "openings": f"""WITH {ACCOUNT}, b AS (SELECT ticket, opened_at - CASE WHEN ticket % 7 = 0 THEN 60 ELSE 0 END AS was FROM positions WHERE ticket %
5 > 0) SELECT p.ticket, p.opened_at, coalesce(b.was, p.opened_at) AS first_seen, coalesce(abs(p.opened_at - b.was) > 1, false) AS moved FROM positions
p LEFT JOIN b USING (ticket)""",
    "continuity": f"""WITH {ACCOUNT},
readings AS (
  SELECT p.account, l.l_linenumber::BIGINT AS reading, p.ticket, p.opened_at + CASE WHEN l.l_partkey % 40 = 0 THEN 3600 ELSE 0 END AS opened_at,
    {NOW} + 3600 * l.l_linenumber - CASE WHEN p.account % 10 = 0 AND l.l_linenumber = 4 THEN 9000 ELSE 0 END AS read_at
  FROM positions p JOIN lineitem l ON l.l_orderkey = p.ticket),
clocked AS (SELECT *, read_at < max(read_at) OVER (PARTITION BY account ORDER BY reading RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back FROM readings),
accepted AS (SELECT *, dense_rank() OVER (PARTITION BY account ORDER BY reading) AS n FROM clocked WHERE back IS NOT TRUE),
in_runs AS (SELECT *, n - dense_rank() OVER (PARTITION BY account, ticket ORDER BY n) AS run FROM accepted),
firsts AS (SELECT *, first(opened_at) OVER (PARTITION BY account, ticket, run ORDER BY n, opened_at) AS first_seen FROM in_runs)
SELECT account, reading, read_at, ticket, opened_at, first_seen, abs(opened_at - first_seen) > 1 AS moved,
  CASE WHEN abs(opened_at - first_seen) > 1 THEN 'POSITION_AGE_MOVED' END AS refusal FROM firsts
UNION ALL SELECT account, reading, read_at, ticket, opened_at, NULL, NULL, 'READING_CLOCK' FROM clocked WHERE back""",
    "heartbeat": f"""WITH {ACCOUNT}, l AS (SELECT account, max(closed_at) AS last FROM deals WHERE account % 4 > 0 GROUP BY account) SELECT a.account,
l.last, {NOW + 432000 - 86400} - l.last AS age, coalesce({NOW + 432000 - 86400} - l.last <= 172800, false) AS clear FROM accounts a LEFT JOIN l USING
(account)""",
    "clock_offsets": f"""WITH {ACCOUNT}, r AS (SELECT account, closed_at AS host_at, arg_min(closed_at + 10800 + ticket % 900 - 450, ticket) AS
server_at, min(ticket) % 50 = 0 AS ex FROM deals GROUP BY account, closed_at),
m AS (SELECT *, CASE WHEN abs(server_at - host_at - 10800) <= 300 THEN 3.0 END AS measured FROM r),
w AS (SELECT *, max(measured) OVER (PARTITION BY account ORDER BY host_at) AS cached FROM m) SELECT account, host_at, CAST(CASE WHEN ex THEN 2.0 ELSE
coalesce(measured, cached) END AS DOUBLE) AS \"offset\", CASE WHEN ex THEN 'explicit' WHEN measured IS NOT NULL THEN 'measured' WHEN cached IS NOT
NULL THEN 'cached' ELSE 'unavailable' END AS source FROM w""",
    "nightly_charges": f"""WITH {LOG} SELECT ticket, tick AS \"at\", {_d('charge', 6)} AS charge, {_d('unit', 6)} AS unit, {_d('multiplier', 6)} AS
multiplier, weekday, {_d('price', 6)} AS price FROM charges""",
    "charge_structure": f"""WITH {LOG}, s AS (SELECT *, charge / multiplier AS per, sign(price - lag(price) OVER w) AS step FROM charges WINDOW w AS
(PARTITION BY ticket ORDER BY tick)),
t AS (SELECT *, CASE WHEN step * lag(step) OVER (PARTITION BY ticket ORDER BY tick) < 0 THEN 1 WHEN step * lag(step) OVER (PARTITION BY ticket ORDER
BY tick) IS NULL THEN NULL ELSE 0 END AS turn FROM s),
g AS (SELECT ticket, count(*) AS nights, max(price) - min(price) AS range, avg(price) AS mean_price, CAST(sum(turn) AS BIGINT) AS reversals,
avg(abs(per)) AS unit, stddev_samp(per) / abs(avg(per)) AS cv_charge, stddev_samp(per / price) / abs(avg(per / price)) AS cv_rate FROM t GROUP BY
ticket) SELECT ticket, nights, {', '.join(f'{_d(c, 7)} AS {c}' for c in ('range', 'mean_price', 'unit', 'cv_charge', 'cv_rate'))}, reversals, CASE
WHEN NOT (nights >= 5 AND range >= 0.03 / unit * mean_price AND reversals >= 2) THEN 'UNDETERMINED' WHEN cv_charge > 3 * cv_rate THEN
'PRICE_DEPENDENT' WHEN cv_rate > 3 * cv_charge THEN 'FIXED_RATE' ELSE 'UNDETERMINED' END AS verdict FROM g""",
}
# its own SQL, with left joins and their two codes
SQL["position_sizes"] = SQL["position_sizes_all"] = (
    SQL["position_sizes"].replace("JOIN accounts a USING (account) JOIN terms t USING (symbol)", "LEFT JOIN accounts a USING (account) LEFT JOIN terms t USING (symbol)")
    .replace("WHEN pv IS NULL THEN 'NO_POINT_VALUE' WHEN volume_step",
        "WHEN point IS NULL THEN 'SYMBOL_TERMS_MISSING' WHEN pv IS NULL THEN 'NO_POINT_VALUE' WHEN volume_step")
            .replace("WHEN lots < volume_min", "WHEN equity IS NULL THEN 'NO_EQUITY' WHEN lots < volume_min")
)
