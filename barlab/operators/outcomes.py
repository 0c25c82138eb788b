"""Barrier outcomes of decisions, their costs, and arms compared over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.functions import clock, costs
from barlab.functions.costs import POINT_VALUE_PER_LOT
from barlab.operators.bars import series, with_halo, without_halo

COMPONENTS = ("spread", "slippage", "latency", "commission", "swap")


@dataclass(frozen=True)
class Risk:
    """Stop and target in multiples of the range (None: none), bars held at most, and money at risk."""

    stop: float | None = 1.5
    target: float | None = 2.0
    hold: int = 24
    money: float = 100.0


def multipliers(bars: DataFrame, open_multiplier: float = 3.0, news_multiplier: float = 10.0, open_bars: int = 3) -> DataFrame:
    """bars (with utc) and multiplier: raised on the first bars after a gap of a day or more and on the bar of first-Friday 08:00 New York; the larger counts. A series' start is no opening."""
    w = series()
    ny = clock.new_york(F.col("utc"))
    opened = with_halo(bars, back=open_bars + 1).withColumn("opens", (F.col("utc") - F.lag("utc").over(w) >= 86400).cast("int"))
    recent = F.coalesce(F.max("opens").over(w.rowsBetween(-(open_bars - 1), 0)), F.lit(0)) == 1
    news = (clock.weekday(ny) == 4) & (F.day(clock.day_of(ny)) <= 7) & (clock.hour_of(ny) == 8)
    return without_halo(opened.withColumn("multiplier", F.greatest(F.when(recent, open_multiplier).otherwise(1.0), F.when(news, news_multiplier)
        .otherwise(1.0))).drop("opens"))


def multiplier_coverage(bars: DataFrame) -> DataFrame:
    m = F.col("multiplier")
    return bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if((m > 1) & (m < 10)).alias("raised"), F.count_if(m >= 10).alias("news"),
        (F.count_if(m > 1) / F.count("*")).alias("share"))


def point_bars(bars: DataFrame, points: float = 100.0) -> DataFrame:
    """The bars that executions run on: prices in points, UTC time and multiplier."""
    return bars.select("symbol", "bar_seq", "utc", "multiplier", *[(F.col(c) * points).alias(c) for c in ("open", "high", "low")])


def barrier_outcomes(decisions: DataFrame, bars: DataFrame, variants: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """One row for each decision (symbol, bar_seq, atr in points), direction sign and cost variant: where, why and at what cost it closes.

    Entry is the next bar's open. Each bar from there is tried on the exit side's quote, the stop before
    the target; a stop fills at the worse of its level and the open, a target at its level, and after
    hold bars the position closes at the next open. All bars a decision needs come by one equi-join on
    (symbol, bar_seq); the first touch is an aggregation. Decisions without a positive range or with too
    few bars after them have no outcome; run_arms shows them as refused."""
    asked = decisions.where("atr > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(risk.hold + 1))))
    path = asked.withColumn("at", F.col("bar_seq") + F.col("k")).join(bars.select("symbol", F.col("bar_seq").alias("at"), "utc", "multiplier", "open",
        "high", "low"), ["symbol", "at"])
    bar = F.struct("k", "utc", "multiplier", "open", "high", "low")
    gathered = path.groupBy("symbol", "bar_seq", "atr").agg(F.sort_array(F.collect_list(bar)).alias("path")).where(F.size("path") == risk.hold + 1)
    # a decision's bars move once; directions and the few cost variants are told apart after that
    rows = gathered.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).join(F.broadcast(variants))
    sign, atr = F.col("sign"), F.col("atr")
    first = F.col("path")[0]
    entry = first["open"]
    level = lambda m, s: F.lit(None).cast("double") if m is None else entry + s * sign * m * atr
    rows = rows.withColumns({"entry_mid": entry, "stop": level(risk.stop, -1), "target": level(risk.target, 1)})

    def touched(b: Column) -> Column:
        half = costs.half_spread(b["multiplier"])
        high, low, open_ = b["high"] - sign * half, b["low"] - sign * half, b["open"] - sign * half
        stopped = F.when(sign > 0, low <= F.col("stop")).otherwise(high >= F.col("stop"))
        reached = F.when(sign > 0, high >= F.col("target")).otherwise(low <= F.col("target"))
        fill = F.when(sign > 0, F.least(open_, F.col("stop"))).otherwise(F.greatest(open_, F.col("stop")))
        timed = b["k"] == risk.hold + 1
        reason = F.when(timed, "time").when(F.coalesce(stopped, F.lit(False)), "stop").when(F.coalesce(reached, F.lit(False)), "target")
        price = F.when(timed, open_).when(F.coalesce(stopped, F.lit(False)), fill).otherwise(F.col("target"))
        return F.struct(reason.alias("reason"), b["k"].alias("k"), b["utc"].alias("utc"), half.alias("half"), price.alias("price"))

    rows = rows.withColumn("exit", F.filter(F.transform("path", touched), lambda x: x["reason"].isNotNull())[0])
    lots = risk.money / ((atr * risk.stop if risk.stop else atr) * POINT_VALUE_PER_LOT)
    rows = rows.withColumns({"lots": lots, "reason": F.col("exit.reason"), "exit_seq": F.col("bar_seq") + F.col("exit.k"),
        "exit_mid": F.col("exit.price") + sign * F.col("exit.half"), "nights": clock.rollovers_crossed(first["utc"], F.col("exit.utc"))})
    market = F.when(F.col("reason") == "target", 0).otherwise(1)
    cost = {
        "spread": costs.half_spread(first["multiplier"]) + F.col("exit.half"), "slippage_paid": 2 * costs.slippage(atr, F.col("lots")),
            "latency": costs.latency(atr) * (1 + market),
        "commission_paid": costs.commission(F.col("lots")), "swap": costs.swap(sign, F.col("nights"), F.col("lots")),
            "gap_through": F.when(F.col("reason") == "stop", sign * (F.col("stop") - F.col("exit.price"))).otherwise(0.0),
    }
    rows = rows.withColumns(cost).withColumn("gross", sign * (F.col("exit_mid") - F.col("entry_mid")))
    rows = rows.withColumn("net", F.col("gross") - F.col("spread") - F.col("slippage_paid") - F.col("latency") - F.col("commission_paid") - F.col("swap"))
    return rows.select("symbol", "bar_seq", "sign", "variant", "atr", "lots", "reason", "exit_seq", "entry_mid", "exit_mid", "gross", "spread",
        F.col("slippage_paid").alias("slippage"), "latency", F.col("commission_paid").alias("commission"), "swap", "nights", "gap_through", "net",
            (F.col("net") * F.col("lots") * POINT_VALUE_PER_LOT / risk.money).alias("r"))


def signal_arm(decisions: DataFrame, probability: str = "p") -> DataFrame:
    """sign 1 over a half, -1 under it, 0 at it."""
    return decisions.withColumn("arm", F.lit("signal")).withColumn("sign", F.when(F.col(probability) > 0.5, 1).when(F.col(probability) < 0.5, -1).otherwise(0))


def long_arm(decisions: DataFrame) -> DataFrame:
    return decisions.withColumn("arm", F.lit("always_long")).withColumn("sign", F.lit(1))


def random_arms(decisions: DataFrame, seeds: int = 30) -> DataFrame:
    """As many arms of directions that a hash of (seed, symbol, bar_seq) gives, blind to price."""
    bit = F.xxhash64("seed", "symbol", "bar_seq").bitwiseAND(F.lit(1).cast("long"))
    return decisions.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("arm",
        F.concat(F.lit("random_"), F.col("seed"))).withColumn("sign", F.when(bit == 1, 1).otherwise(-1)).drop("seed")


def crossover_arm(bars: DataFrame, decisions: DataFrame, fast: int = 8, slow: int = 32) -> DataFrame:
    """Long where the mean of the last fast closes is over that of the last slow, else short; shorter windows at the start."""
    w = series()
    means = without_halo(with_halo(bars, back=slow).withColumn("sign", F.when(F.avg("close").over(w.rowsBetween(-(fast - 1), 0)) > F.avg("close")
        .over(w.rowsBetween(-(slow - 1), 0)), 1).otherwise(-1)))
    return decisions.join(means.select("symbol", "bar_seq", "sign"), ["symbol", "bar_seq"]).withColumn("arm", F.lit("crossover"))


def refused_decisions(decisions: DataFrame, bars: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """(symbol, bar_seq, refusal) of decisions (symbol, bar_seq, atr) that can't be run: NO_RANGE without a positive range, WINDOW_PAST_SERIES where
    the bars end before the last possible exit, BARS_MISSING where there are too few within the window. Neither direction nor costs change that."""
    last = bars.groupBy("symbol").agg(F.max("bar_seq").alias("_last"))
    ahead = decisions.where("atr > 0").select("symbol", "bar_seq", F.explode(F.sequence(F.lit(1), F.lit(risk.hold + 1))).alias("_k")).withColumn("_at", F.col("bar_seq") + F.col("_k"))
    found = ahead.join(bars.select("symbol", F.col("bar_seq").alias("_at")), ["symbol", "_at"]).groupBy("symbol", "bar_seq").agg(F.count("*").alias("_found"))
    rows = decisions.select("symbol", "bar_seq", "atr").join(last, "symbol", "left").join(found, ["symbol", "bar_seq"], "left")
    past = F.coalesce(F.col("bar_seq") + risk.hold + 1 > F.col("_last"), F.lit(True))
    code = F.when(~F.coalesce(F.col("atr") > 0, F.lit(False)), "NO_RANGE").when(past, "WINDOW_PAST_SERIES").when(F.coalesce("_found", F.lit(0)) != risk.hold + 1, "BARS_MISSING")
    return rows.select("symbol", "bar_seq", code.alias("refusal")).where("refusal is not null")


def run_arms(arms: DataFrame, outcomes: DataFrame, variant_names: list[str], refusals: DataFrame | None = None) -> DataFrame:
    """arms (symbol, bar_seq, arm, sign) with each decision's outcome in each variant; a flat one has r 0 and no trade.

    Outcomes are worked out once for each direction, so any number of arms costs one join. A refused
    decision (refused_decisions) stays in every arm, flat or not, with its code and a null r. One that has neither outcome nor code is
    NO_OUTCOME."""
    asked = arms.select("symbol", "bar_seq", "arm", "sign").withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variant_names])))
    runs = asked.join(outcomes, ["symbol", "bar_seq", "sign", "variant"], "left")
    runs = runs.withColumn("refusal", F.lit(None).cast("string")) if refusals is None else runs.join(refusals.select("symbol", "bar_seq", "refusal"), ["symbol", "bar_seq"], "left")
    r = F.when(F.col("refusal").isNull(), F.when(F.col("sign") == 0, 0.0).otherwise(F.col("r")))
    return runs.withColumn("r", r).withColumn("refusal", F.when(F.col("r").isNull(), F.coalesce("refusal", F.lit("NO_OUTCOME"))))


def arm_summary(runs: DataFrame, money: float = 100.0) -> DataFrame:
    """Per arm and variant: decisions offered and refused; mean r and each cost in r over those that were run, flat ones included; exits and directions by kind, of those that were run."""
    n = F.count("r")
    cost = [(F.sum(F.coalesce(F.col(c) * F.col("lots") * POINT_VALUE_PER_LOT / money, F.lit(0.0))) / n).alias(f"{c}_r") for c in COMPONENTS]
    run = F.col("refusal").isNull()
    return runs.groupBy("arm", "variant").agg(F.count("*").alias("decisions"), F.count("refusal").alias("refused"), F.avg("r").alias("mean_r"),
        *[F.count_if(run & (F.col("reason") == x)).alias(x) for x in ("stop", "target", "time")], F.count_if(run & (F.col("sign") > 0)).alias("longs"),
            F.count_if(run & (F.col("sign") < 0)).alias("shorts"), F.count_if(run & (F.col("sign") == 0)).alias("flats"), *cost)


def paired_difference(runs: DataFrame, signal: str = "signal") -> DataFrame:
    """Per decision and variant: the signal's r less the mean of the other arms'; null where the decision was refused.

    Arms must have the same decisions, each once: a decision that an arm lacks, or has twice, or that is run in one arm and refused in another, is an error."""
    is_signal = F.col("arm") == signal
    arms = runs.select("arm").distinct().count()
    g = runs.groupBy("symbol", "bar_seq", "variant").agg(F.max(F.when(is_signal, F.col("r"))).alias("signal_r"), F.avg(F.when(~is_signal, F.col("r"))).alias("control_r"),
        F.count("*").alias("arms"), F.count_distinct("arm").alias("_own"), F.count("r").alias("_run"))
    equal = (F.col("arms") == arms) & (F.col("_own") == arms) & F.col("_run").isin(0, arms)
    unequal = F.raise_error(F.concat(F.lit(f"ARMS_UNEQUAL: of {arms} arms "), F.col("_own").cast("string"), F.lit(" have the decision, "), F.col("_run").cast("string"), F.lit(" ran it, at "), "symbol", F.lit(" "), F.col("bar_seq").cast("string")))
    return g.withColumn("difference", F.when(equal, F.col("signal_r") - F.col("control_r")).otherwise(unequal)).drop("_own", "_run")


def cost_invariance(summary: DataFrame, signal: str = "signal", tolerance: float = 0.1) -> DataFrame:
    """Per variant: whether the signal's commission is that of the controls and its total cost differs by no more than the tolerance of the effect."""
    total = sum((F.col(f"{c}_r") for c in COMPONENTS[1:]), F.col("spread_r"))
    side = lambda c, own: F.avg(F.when((F.col("arm") == signal) == F.lit(own), c))
    g = summary.groupBy("variant").agg((side(total, True) - side(total, False)).alias("cost_gap"),
        (side(F.col("mean_r"), True) - side(F.col("mean_r"), False)).alias("effect"),
            (side(F.col("commission_r"), True) - side(F.col("commission_r"), False)).alias("commission_gap"))
    share = F.try_divide(F.abs("cost_gap"), F.abs("effect"))
    return g.withColumns({"share": share, "verdict": F.when(F.abs("commission_gap") > 1e-12, "void").when(share <= tolerance, "invariant").otherwise("void")})


def breakeven(differences: DataFrame) -> DataFrame:
    """differences (floor, difference, in a grid): the cell (low, high) where the mean changes sign and the floor in it by linear interpolation, or why there is none."""
    from pyspark.sql import Window

    means = differences.groupBy("floor").agg(F.avg("difference").alias("d"))
    # the grid has a few rows, whatever the data
    w = Window.orderBy("floor")
    cells = means.withColumns({"next_floor": F.lead("floor").over(w), "next_d": F.lead("d").over(w)})
    flips = (F.col("d") > 0) != (F.col("next_d") > 0)
    at = F.col("floor") + (F.col("next_floor") - F.col("floor")) * F.col("d") / (F.col("d") - F.col("next_d"))
    in_cell = lambda c: F.max(F.when(flips, c))
    g = cells.agg(
        F.count_if(flips).alias("flips"), in_cell(at).alias("at"), in_cell(F.col("floor")).alias("low"), in_cell(F.col("next_floor")).alias("high"),
        F.min_by("d", "floor").alias("first"), F.max_by("d", "floor").alias("last"),
    )
    outcome = F.when(F.col("flips") > 1, "not monotone").when(F.col("first") <= 0, "none: not positive at the lowest")
    outcome = outcome.when(F.col("last") > 0, "above the bracket").otherwise("found")
    found = lambda c: F.when((F.col("flips") == 1) & (F.col("first") > 0), F.col(c))
    return g.select(outcome.alias("outcome"), found("at").alias("floor"), found("low").alias("low"), found("high").alias("high"))


OUTCOMES = ("h1", "h4", "h24")


def decision_log(runs: DataFrame, features: DataFrame, run_id: str, method: str, snapshot_sha256: str | None = None) -> DataFrame:
    """One nested record for each arm and decision; absent parts are null or empty and never left out.

    features (symbol, bar_seq, features) may have utc (the bar's time in seconds), p (the source's
    probability) and h1, h4, h24 (moves of the close after the decision), which fill their own parts of
    the record. Ids are version-5 UUIDs of run, method, arm, symbol and bar."""
    name = F.concat_ws("/", F.lit(run_id), F.lit(method), "arm", "symbol", F.col("bar_seq").cast("string"))
    # the URL namespace of RFC 4122
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    octet = F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)
    low = F.lower(F.concat(F.substring(F.hex(F.shiftright(octet, 4)), 1, 1), F.substring(digest, 18, 3)))
    uid = F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), low, F.substring(digest, 21, 12)
    )
    names = [c for c in features.columns if c not in ("symbol", "bar_seq", "utc", "p", *OUTCOMES)]
    given = lambda c, kind: (F.col(c) if c in features.columns else F.lit(None)).cast(kind)
    at = F.date_format(F.timestamp_seconds(given("utc", "long")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    value = lambda c: F.struct(F.col(c).alias("value"), F.lit(1).alias("version"), at.alias("computed_at"))
    values = features.select(
        "symbol", "bar_seq", at.alias("bar_timestamp_utc"), given("p", "double").alias("confidence_adjusted"),
        F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(value, names))).alias("features"),
        F.struct(*[given(h, "double").alias(h) for h in OUTCOMES]).alias("outcome"),
    )
    traded = F.col("reason").isNotNull()
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = runs.join(values, ["symbol", "bar_seq"], "left")
    return rows.select(
        uid.alias("decision_id"), F.lit(run_id).alias("run_id"), "bar_timestamp_utc", F.lit(snapshot_sha256).cast("string").alias("snapshot_sha256"),
        "arm", "symbol", "bar_seq", "features", none("string").alias("agents"), F.struct(none("string").alias("nodes"), none("string").alias("edges")).alias("evidence_graph"),
        *[F.lit(None).cast(k).alias(c) for c, k in (("n_eff", "double"), ("pc1_variance_share", "double"))], "confidence_adjusted", F.lit(None).cast("string").alias("devils_advocate"),
        F.when(F.col("sign") > 0, "long").when(F.col("sign") < 0, "short").otherwise("flat").alias("final_decision"), F.lit(method).alias("decision_method"),
        F.when(traded, F.struct(*COMPONENTS)).alias("costs_applied"), F.when(traded, F.struct("reason", "exit_seq", "entry_mid", "exit_mid", "lots")).alias("execution"),
        "outcome", F.col("r").alias("outcome_r"),
    )


def write_decision_log(log: DataFrame, path: str) -> None:
    """The records as JSON lines, nulls written out, by arm; an existing log stops the write."""
    log.write.mode("errorifexists").option("ignoreNullFields", "false").partitionBy("arm").json(path)
