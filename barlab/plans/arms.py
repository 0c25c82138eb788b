"""Queries over decisions, outcomes and arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.functions import clock, costs
from barlab.operators import features as fe
from barlab.operators import outcomes as ou
from barlab.plans import sql as q
from barlab.plans.bars import _rounded, ny, outcomes_ahead
from barlab.sources.shared import written
from barlab.sources.tables import hourly_bars

GRID = (0.0, 10.0, 25.0, 50.0, 75.0, 100.0, 150.0, 200.0, 400.0)


def _bars(spark, d):
    """Hourly bars with range, UTC and multiplier."""
    b = fe.wilder_atr(hourly_bars(spark, d), 14).withColumn("utc", clock.to_utc(F.col("time")))
    return ou.multipliers(b)


def _decisions(b):
    specs = [fe.range_position(24)]
    p = 1 / (1 + F.exp(-(F.col("range_position_24") - 0.5)))
    return fe.with_features(b, specs).where((F.col("bar_seq") % 24 == 0) & F.col("range_position_24")
        .isNotNull() & (F.col("atr") > 0)).select("symbol", "bar_seq", (F.col("atr") * 100.0).alias("atr"), p.alias("p"))


def _outcomes(spark, d, models):
    b = written(_bars(spark, d), "arm-bars")
    asked = written(_decisions(b), "decisions")
    points = ou.point_bars(b)
    return asked, ou.barrier_outcomes(asked.drop("p"), points, costs.variants(spark, models)), ou.refused_decisions(asked, points)


def spread_multipliers(spark, d):
    return _bars(spark, d).select("symbol", "bar_seq", "multiplier")


def multiplier_coverage(spark, d):
    return _rounded(ou.multiplier_coverage(_bars(spark, d)))


BASE = {"base": costs.CostModel(), "doubled": costs.CostModel().doubled()}


def barrier_outcomes(spark, d):
    return _rounded(_outcomes(spark, d, BASE)[1], 5)


def _runs(spark, d, models=BASE):
    asked, out, refused = _outcomes(spark, d, models)
    arms = ou.signal_arm(asked).unionByName(ou.long_arm(asked))
    return ou.run_arms(arms, written(out, "outcomes"), [*models], refused)


def arm_summary(spark, d):
    return _rounded(ou.arm_summary(_runs(spark, d)), 5)


def paired_difference(spark, d):
    return _rounded(ou.paired_difference(_runs(spark, d)), 5)


def cost_invariance(spark, d):
    return _rounded(ou.cost_invariance(ou.arm_summary(_runs(spark, d))).drop("commission_gap"), 5)


def random_arm_summary(spark, d):
    """Thirty random arms over the same decisions, in one job."""
    asked, out, refused = _outcomes(spark, d, {"base": costs.CostModel()})
    return ou.arm_summary(ou.run_arms(ou.random_arms(asked), written(out, "outcomes"), ["base"], refused))


def refused_decisions(spark, d):
    """The decisions that can't be run and why, over all bars as decisions."""
    b = written(_bars(spark, d), "arm-bars")
    return ou.refused_decisions(b.select("symbol", "bar_seq", (F.col("atr") * 100.0).alias("atr")), ou.point_bars(b))


def crossover_arm(spark, d):
    b = hourly_bars(spark, d)
    return ou.crossover_arm(b, b.where("bar_seq % 24 = 0").select("symbol", "bar_seq")).select("symbol", "bar_seq", "sign")


def _at_floors(spark, d, floors):
    """Differences of the signal from the other arm, with the least spread at each of some floors; one job for all."""
    models = {"base": costs.CostModel()} | {f"floor_{f:g}": costs.CostModel().at_floor(f, sweep=True) for f in floors}
    return ou.paired_difference(_runs(spark, d, models)).where("variant <> 'base'")


def breakeven_sweep(spark, d):
    diff = _at_floors(spark, d, GRID)
    return _rounded(diff.groupBy("variant").agg(F.avg("difference").alias("difference"), F.avg("signal_r").alias("signal_r")), 5)


def breakeven(spark, d):
    """The floor at which the difference changes sign: one job over the grid finds the cell, a second one evaluates nine floors in it."""
    told = lambda diff: ou.breakeven(diff.withColumn("floor", F.substring_index("variant", "_", -1).cast("double")))
    cell = written(told(_at_floors(spark, d, GRID)), "breakeven")
    found = cell.first()
    if found["outcome"] == "found":
        cell = told(_at_floors(spark, d, [found["low"] + (found["high"] - found["low"]) * k / 8 for k in range(9)]))
    return _rounded(cell.select("outcome", "floor"), 3)


def decision_log(spark, d):
    """The records of the two arms' decisions, their nested parts as JSON."""
    bars = hourly_bars(spark, d).withColumn("utc", clock.to_utc(F.col("time")))
    b = fe.with_features(bars, [fe.log_return(24), fe.range_position(24)]).select("symbol", "bar_seq", "utc", "log_return_24", "range_position_24")
    ahead = outcomes_ahead(spark, d)
    log = ou.decision_log(_runs(spark, d).where("variant = 'base'"), b.join(ahead, ["symbol", "bar_seq"], "left"), "run", "closed form")
    flat = [F.to_json(c, {"ignoreNullFields": "false"}).alias(c) for c in ("evidence_graph", "outcome")]
    return log.select(
        "decision_id", "arm", "symbol", "bar_seq", "bar_timestamp_utc", "final_decision", F.col("execution.reason").alias("reason"), F.round("outcome_r", 5).alias("outcome_r"),
        F.map_keys("features").cast("string").alias("features"), *flat,
    )


QUERIES = {f.__name__: f for f in (spread_multipliers, multiplier_coverage, barrier_outcomes, arm_summary, paired_difference, cost_invariance,
    random_arm_summary, refused_decisions, crossover_arm, breakeven_sweep, breakeven, decision_log)}
_MODELS = {k: costs.asdict(v) for k, v in BASE.items()}


def _variants(models: dict) -> str:
    return "variants AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {m.floor}, {m.slippage}, {m.commission}, {m.swap_long}, {m.swap_short}, {m.latency_seconds})" for k, m in models.items()) + ") v(variant, floor, slip, comm, sl, ss, lat))"


NIGHT = lambda t: f"(({ny(t)} - 61200) // 86400)"


def _sql(models: dict) -> str:
    return f"""{q.BARS}, {q.ATR},
timed AS (SELECT *, time - {q.offset(q.day('time'))} * 3600 AS utc FROM with_atr),
local AS (SELECT *, {ny('utc')} AS ny, CASE WHEN utc - lag(utc) {q.SERIES}) >= 86400 THEN 1 ELSE 0 END AS opens FROM timed),
multiplied AS (SELECT *, greatest(CASE WHEN {q.trailing('max(opens)', 3)} = 1 THEN 3.0 ELSE 1.0 END, CASE WHEN (ny // 86400 + 3) % 7 = 4 AND day({q.day('ny')}) <= 7 AND ny % 86400 // 3600 = 8 THEN 10.0 ELSE 1.0 END) AS multiplier, {q.trailing('min(low)', 24)} AS lo, {q.trailing('max(high)', 24)} AS hi, {q.trailing('count(*)', 24)} AS k24 FROM local),
decisions AS (SELECT symbol, bar_seq, atr * 100.0 AS atr, 1 / (1 + exp(-((close - lo) / (hi - lo) - 0.5))) AS p FROM multiplied WHERE bar_seq % 24 = 0 AND k24 = 24 AND hi > lo AND atr > 0),
{_variants(models)},
path AS (SELECT d.symbol, d.bar_seq, d.atr, s.sign, v.*, b.bar_seq - d.bar_seq AS k, b.utc, b.open * 100.0 AS o, b.high * 100.0 AS h, b.low * 100.0 AS l, 0.5 * v.floor * b.multiplier AS half
  FROM decisions d JOIN multiplied b ON b.symbol = d.symbol AND b.bar_seq BETWEEN d.bar_seq + 1 AND d.bar_seq + 25, (VALUES (1), (-1)) s(sign), variants v),
entries AS (SELECT symbol, bar_seq, sign, variant, o AS entry, half AS entry_half, utc AS entry_utc FROM path WHERE k = 1),
complete AS (SELECT symbol, bar_seq, sign, variant FROM path GROUP BY ALL HAVING count(*) = 25),
levels AS (SELECT p.*, e.entry, e.entry_half, e.entry_utc, e.entry - p.sign * 1.5 * p.atr AS stop, e.entry + p.sign * 2.0 * p.atr AS target FROM path p JOIN entries e USING (symbol, bar_seq, sign, variant) JOIN complete USING (symbol, bar_seq, sign, variant)),
tried AS (SELECT *, CASE WHEN k = 25 THEN 'time' WHEN (sign > 0 AND l - half <= stop) OR (sign < 0 AND h + half >= stop) THEN 'stop' WHEN (sign > 0 AND h - half >= target) OR (sign < 0 AND l + half <= target) THEN 'target' END AS reason FROM levels),
exits AS (SELECT * FROM tried WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, bar_seq, sign, variant ORDER BY k) = 1),
filled AS (SELECT *, CASE reason WHEN 'time' THEN o - sign * half WHEN 'target' THEN target ELSE CASE WHEN sign > 0 THEN least(o - half, stop) ELSE greatest(o + half, stop) END END AS price, 100.0 / (atr * 1.5) AS lots FROM exits),
costed AS (SELECT *, price + sign * half AS exit_mid, entry_half + half AS spread, 2 * slip * atr * sqrt(lots) AS slippage, 0.02 * atr * lat * CASE WHEN reason = 'target' THEN 1 ELSE 2 END AS latency, comm * 2 * lots AS commission,
  CASE WHEN utc <= entry_utc THEN 0 ELSE {NIGHT('utc')} - {NIGHT('entry_utc')} END AS nights, CASE WHEN reason = 'stop' THEN sign * (stop - price) ELSE 0 END AS gap_through FROM filled),
swapped AS (SELECT *, CASE WHEN sign > 0 THEN sl ELSE ss END * nights * lots AS swap, sign * (exit_mid - entry) AS gross FROM costed),
outcomes AS (SELECT *, gross - spread - slippage - latency - commission - swap AS net, (gross - spread - slippage - latency - commission - swap) * lots / 100.0 AS r FROM swapped),
asked AS (SELECT d.*, c.symbol IS NULL AS refused FROM decisions d LEFT JOIN (SELECT DISTINCT symbol, bar_seq FROM complete) c ON c.symbol = d.symbol AND c.bar_seq = d.bar_seq),
arms AS (SELECT symbol, bar_seq, refused, 'signal' AS arm, CASE WHEN p > 0.5 THEN 1 WHEN p < 0.5 THEN -1 ELSE 0 END AS sign FROM asked UNION ALL SELECT symbol, bar_seq, refused, 'always_long', 1 FROM asked),
runs AS (SELECT a.symbol, a.bar_seq, a.arm, a.sign, a.refused, v.variant, o.reason, o.lots, o.spread, o.slippage, o.latency, o.commission, o.swap, CASE WHEN a.refused THEN NULL WHEN a.sign = 0 THEN 0 ELSE o.r END AS r FROM arms a CROSS JOIN variants v LEFT JOIN outcomes o ON o.symbol = a.symbol AND o.bar_seq = a.bar_seq AND o.sign = a.sign AND o.variant = v.variant),
paired AS (SELECT symbol, bar_seq, variant, max(r) FILTER (arm = 'signal') AS signal_r, avg(r) FILTER (arm <> 'signal') AS control_r, count(*) AS arms FROM runs GROUP BY ALL),
summary AS (SELECT arm, variant, count(*) AS decisions, count(*) FILTER (refused) AS refused, avg(r) AS mean_r, count(*) FILTER (reason = 'stop') AS stop, count(*) FILTER (reason = 'target') AS target, count(*) FILTER (reason = 'time') AS time, count(*) FILTER (sign > 0 AND NOT refused) AS longs, count(*) FILTER (sign < 0 AND NOT refused) AS shorts, count(*) FILTER (sign = 0 AND NOT refused) AS flats, {', '.join(f'sum(coalesce({c} * lots / 100.0, 0)) / count(*) FILTER (NOT refused) AS {c}_r' for c in ou.COMPONENTS)} FROM runs GROUP BY arm, variant)"""


_two, _grid = _sql(BASE), _sql({"base": costs.CostModel()} | {f"floor_{f:g}": costs.CostModel().at_floor(f, sweep=True) for f in GRID})
_all = ["decisions", "refused", "stop", "target", "time", "longs", "shorts", "flats"]
_total = " + ".join(f"{c}_r" for c in ou.COMPONENTS)
SQL = {
    "spread_multipliers": f"WITH RECURSIVE {_two} SELECT symbol, bar_seq, CAST(multiplier AS DOUBLE) AS multiplier FROM multiplied",
    "multiplier_coverage": f"""WITH RECURSIVE {_two} SELECT symbol, count(*) AS bars, CAST(count(*) FILTER (multiplier > 1 AND multiplier < 10) AS
BIGINT) AS raised, CAST(count(*) FILTER (multiplier >= 10) AS BIGINT) AS news, round(count(*) FILTER (multiplier > 1) / count(*), 6) AS share FROM
multiplied GROUP BY symbol""",
    "barrier_outcomes": f"""WITH RECURSIVE {_two} SELECT symbol, bar_seq, sign, variant,
{', '.join(f'round(CAST({c} AS DOUBLE), 5) + 0.0 AS {c}' for c in ('atr', 'lots', 'exit_mid', 'gross', 'spread', 'slippage', 'latency', 'commission', 'swap', 'gap_through', 'net', 'r'))},
round(entry, 5) AS entry_mid, reason, bar_seq + k AS exit_seq, CAST(nights AS BIGINT) AS nights FROM outcomes""",
    "arm_summary": f"""WITH RECURSIVE {_two} SELECT arm, variant, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _all)},
{', '.join(f'round(CAST({c} AS DOUBLE), 5) + 0.0 AS {c}' for c in ['mean_r', *[f'{c}_r' for c in ou.COMPONENTS]])} FROM summary""",
    "paired_difference": f"""WITH RECURSIVE {_two} SELECT symbol, bar_seq, variant, arms, round(CAST(signal_r AS DOUBLE), 5) AS signal_r,
round(CAST(control_r AS DOUBLE), 5) AS control_r, round(CAST(signal_r - control_r AS DOUBLE), 5) + 0.0 AS difference FROM paired""",
    "cost_invariance": f"""WITH RECURSIVE {_two}, g AS (SELECT variant, avg({_total}) FILTER (arm = 'signal') - avg({_total}) FILTER (arm <> 'signal')
AS cost_gap, avg(mean_r) FILTER (arm = 'signal') - avg(mean_r) FILTER (arm <> 'signal') AS effect, avg(commission_r) FILTER (arm = 'signal') -
avg(commission_r) FILTER (arm <> 'signal') AS cg FROM summary GROUP BY variant) SELECT variant, round(CAST(cost_gap AS DOUBLE), 5) AS cost_gap,
round(CAST(effect AS DOUBLE), 5) AS effect, round(CAST(abs(cost_gap) / abs(effect) AS DOUBLE), 5) AS share, CASE WHEN abs(cg) > 1e-12 THEN 'void' WHEN
abs(cost_gap) / abs(effect) <= 0.1 THEN 'invariant' ELSE 'void' END AS verdict FROM g""",
    "refused_decisions": f"""WITH RECURSIVE {_two} SELECT m.symbol, m.bar_seq, CASE WHEN m.atr > 0 THEN 'WINDOW_PAST_SERIES' ELSE 'NO_RANGE' END AS refusal
FROM multiplied m JOIN (SELECT symbol, max(bar_seq) AS final FROM multiplied GROUP BY symbol) l USING (symbol) WHERE m.atr IS NULL OR m.atr <= 0 OR m.bar_seq + 25 > l.final""",
    "crossover_arm": f"""WITH {q.BARS}, m AS (SELECT symbol, bar_seq, CASE WHEN {q.trailing('avg(close)', 8)} > {q.trailing('avg(close)', 32)} THEN 1
ELSE -1 END AS sign FROM bars) SELECT * FROM m WHERE bar_seq % 24 = 0""",
    "breakeven_sweep": f"""WITH RECURSIVE {_grid} SELECT variant, round(CAST(avg(signal_r - control_r) AS DOUBLE), 5) AS difference,
round(CAST(avg(signal_r) AS DOUBLE), 5) AS signal_r FROM paired WHERE variant <> 'base' GROUP BY variant""",
}
