"""Account risk: sizing, published and measured financing, limits, margin, alerts. Missing inputs become refusals, never dropped rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barlab.functions import clock

#: Swap modes by their terminal code; of the rest the units are not convertible here. Fixed values.
DISABLED, POINTS, MARGIN_CURRENCY, DEPOSIT_CURRENCY = 0, 1, 3, 4
#: Modes whose charge follows a price: symbol currency, interest and reopening. Fixed values.
PRICE_DEPENDENT = (2, 5, 6, 7, 8)
SEVERITY = ("CRITICAL", "WARN", "INFO")


def refusal(code: str, subject: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), subject.cast("string").alias("subject"))


def refusals(*cases: tuple[Column, str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(when, refusal(code, subject)) for when, code, subject in cases]))


def point_value() -> Column:
    """Currency a point and lot; null if any term is not positive."""
    ok = (F.col("point") > 0) & (F.col("tick_size") > 0) & (F.col("tick_value") > 0)
    return F.when(ok, F.col("tick_value") * F.col("point") / F.col("tick_size"))


def size_positions(rows: DataFrame, risk_pct: float = 1.0, stop_multiple: float = 1.5) -> DataFrame:
    """rows (account, symbol, equity, atr_points, spread_points, point, tick_size, tick_value, volume_min, volume_max, volume_step, price) with lots, adverse points, stop prices, or the code of the refusal."""
    adverse = stop_multiple * F.col("atr_points") + F.col("spread_points")
    pv = point_value()
    wanted = F.col("equity") * risk_pct / 100.0 / (adverse * pv)
    capped = F.when((F.col("volume_max") > 0) & (wanted > F.col("volume_max")), F.col("volume_max")).otherwise(wanted)
    lots = F.round(F.floor(capped / F.col("volume_step") + 1e-9) * F.col("volume_step"), 8)
    code = (
        F.when(F.coalesce(F.col("atr_points") <= 0, F.lit(True)), "NO_VOLATILITY").when(F.col("point").isNull(), "SYMBOL_TERMS_MISSING")
            .when(pv.isNull(), "NO_POINT_VALUE").when(F.col("volume_step") <= 0, "NO_VOLUME_STEP").when(F.col("spread_points") < 0, "NO_POINT_VALUE")
        .when(F.col("equity").isNull(), "NO_EQUITY").when(lots < F.col("volume_min"), "BELOW_MINIMUM_VOLUME")
    )
    stop = stop_multiple * F.col("atr_points") * F.col("point")
    ok = lambda c: F.when(F.col("refusal").isNull(), c)
    return rows.withColumn("refusal", code).withColumns({"lots": ok(lots), "adverse_points": ok(adverse), "stop_long": ok(F.col("price") - stop),
        "stop_short": ok(F.col("price") + stop)})


def declared_swaps(terms: DataFrame, currency: str) -> DataFrame:
    """terms with charge_long and charge_short in points a lot and night (positive: paid), or swap_refusal."""
    mode, pv = F.col("swap_mode"), point_value()
    money = mode.isin(MARGIN_CURRENCY, DEPOSIT_CURRENCY)
    code = F.when(~mode.isin(DISABLED, POINTS, MARGIN_CURRENCY, DEPOSIT_CURRENCY) | mode.isNull(),
        "SWAP_MODE_UNSUPPORTED").when((mode == MARGIN_CURRENCY) & (F.col("currency_margin") != currency),
            "SWAP_CURRENCY_MISMATCH").when(money & pv.isNull(), "NO_POINT_VALUE")
    charge = lambda c: F.when(code.isNull(), F.when(mode == DISABLED, 0.0).when(mode == POINTS, -F.col(c)).otherwise(-F.col(c) / pv))
    return terms.withColumns({"swap_refusal": code, "charge_long": charge("swap_long"), "charge_short": charge("swap_short")})


def position_carry(positions: DataFrame, terms: DataFrame, now: int, offset: float | None, min_days: float = 1.0) -> DataFrame:
    """positions (account, ticket, symbol, direction, volume, price_open, opened_at, swap, profit, equity) with what financing they paid, their rates a day, the more adverse of published and measured, and break-evens.

    terms is a table of symbols (see declared_swaps), broadcast: an instrument list, not data. A position without terms stays, with a refusal."""
    t = terms.select("symbol", "point", point_value().alias("per_point"), "charge_long", "charge_short", F.lit(True).alias("has_terms"))
    p = positions.join(t, "symbol", "left")
    days = (F.lit(now) - F.col("opened_at")) / 86400.0
    paid, long = -F.col("swap"), F.col("direction") == "long"
    p = p.withColumns({"days_open": days, "nights": clock.nights_between(F.col("opened_at"), F.lit(now),
        F.lit(offset)) if offset is not None else F.lit(None).cast("long"), "carry_paid": paid})
    declared = F.when(long, F.col("charge_long")).otherwise(F.col("charge_short")) * F.col("per_point") * F.col("volume")
    measured = F.when((F.col("days_open") >= min_days) & (F.col("carry_paid") != 0), F.col("carry_paid") / F.col("days_open"))
    p = p.withColumns({"rate_declared": declared, "rate_measured": measured,
        "rate_nightly": F.when(measured.isNotNull() & (F.col("nights") > 0), F.col("carry_paid") / F.col("nights"))})
    more = F.col("rate_measured") > F.col("rate_declared")
    points = F.try_divide(F.col("carry_paid"), F.col("volume") * F.col("per_point"))
    move = points * F.col("point") * F.when(long, 1.0).otherwise(-1.0)
    source = F.when(F.col("rate_declared").isNull() & F.col("rate_measured").isNull(), "none").when(F.col("rate_measured").isNull(),
        "declared").when(F.col("rate_declared").isNull(), "measured").when(more, "more_adverse_of_both").otherwise("declared")
    ticket = F.col("ticket")
    return p.withColumns({
        "rate": F.when(F.col("rate_declared").isNull() | more, F.col("rate_measured")).otherwise(F.col("rate_declared")), "rate_source": source,
            "breakeven_points": points, "breakeven_price": F.col("price_open") + move,
        "carry_pct_of_equity": F.when(F.col("equity") > 0, 100.0 * F.col("carry_paid") / F.col("equity")),
        "refusals": refusals((F.lit(offset is None), "NO_SERVER_CLOCK", ticket), (F.col("has_terms").isNull(), "SYMBOL_TERMS_MISSING", ticket),
            (F.col("has_terms") & F.col("per_point").isNull(), "NO_POINT_VALUE", ticket),
                (F.col("rate_measured").isNull(), "CARRY_TOO_YOUNG", ticket), (source == "none", "NO_CARRY_RATE", ticket)),
    }).drop("has_terms")


def carry_projection(carries: DataFrame, horizons: tuple[int, ...] = (7, 30, 60, 90)) -> DataFrame:
    """(account, ticket, horizon, carry, total, pct_of_equity) at each horizon in days; null where there is no rate."""
    p = carries.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    carry = F.col("rate") * F.col("horizon")
    return p.select("account", "ticket", "horizon", carry.alias("carry"), (F.col("carry_paid") + carry).alias("total"),
        F.when(F.col("equity") > 0, 100.0 * carry / F.col("equity")).alias("pct_of_equity"))


def portfolio_carry(carries: DataFrame) -> DataFrame:
    """Per account: paid, rates a day (null if no position has one), whether some have none, and days until equity is used up."""
    g = carries.groupBy("account").agg(F.count("*").alias("positions"), F.sum("carry_paid").alias("carry_paid"), F.sum("rate").alias("rate"),
        F.sum("rate_declared").alias("rate_declared"), F.sum("rate_measured").alias("rate_measured"), (F.count_if(F.col("rate").isNull()) > 0)
            .alias("partial"), F.max("equity").alias("equity"))
    return g.withColumn("days_to_zero", F.when((F.col("rate") > 0) & (F.col("equity") > 0), F.col("equity") / F.col("rate")))


def measured_points(carries: DataFrame) -> DataFrame:
    """Volume-weighted measured points a lot, per symbol and side, by day and by night."""
    per = lambda c: F.try_divide(F.col(c), F.col("volume") * F.col("per_point"))
    weighted = lambda c: F.try_divide(F.sum(per(c) * F.col("volume")), F.sum(F.when(per(c).isNotNull(), F.col("volume"))))
    return carries.groupBy("symbol", "direction").agg(F.count("rate_measured").alias("positions"), weighted("rate_measured").alias("daily_points"),
        weighted("rate_nightly").alias("nightly_points"))


def swap_divergence(terms: DataFrame, measured: DataFrame, registered: dict[str, float], tolerance: float = 0.05) -> DataFrame:
    """Per symbol: weekly points registered against published (exactly) and measured (with tolerance), by side; OPTIMISTIC if any exceeds what is registered.

    It bears on the registry if it is optimistic or if the charge follows a price, which no fixed number of points can stand for."""
    m = measured.select("symbol", "direction", "daily_points", "nightly_points")
    side = lambda d: terms.select("symbol", F.lit(d).alias("direction"), F.lit(registered[d] * 7).alias("registered"), (F.col(f"charge_{d}") * 7).alias("published"))
    rows = side("long").unionByName(side("short")).join(m, ["symbol", "direction"], "left").withColumn("daily",
        F.col("daily_points") * 7).withColumn("nightly", F.col("nightly_points") * 7)
    over = lambda c, t: F.col(c) > F.col("registered") * (1 + t)
    compared = rows.select("symbol", "direction", F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("source"),
        F.col(c).alias("weekly"), over(c, t).alias("exceeds"))) for c, t in (("published", 0.0), ("daily", tolerance), ("nightly", tolerance))])))
            .alias("x")).select("symbol", "direction", "x.*")
    verdict = F.when(F.count("source") == 0, "UNAVAILABLE").when(F.bool_or("exceeds"), "OPTIMISTIC").otherwise("CONSERVATIVE")
    told = terms.select("symbol", F.col("swap_mode").isin(*PRICE_DEPENDENT).alias("price_dependent")).join(compared, "symbol", "left")
    told = told.groupBy("symbol", "price_dependent").agg(F.count("source").alias("comparisons"), F.count_if("exceeds").alias("exceeding"), verdict.alias("verdict"))
    return told.withColumn("bears_on_registry", (F.col("verdict") == "OPTIMISTIC") | F.col("price_dependent"))


def annual_carry(terms: DataFrame, prices: DataFrame) -> DataFrame:
    """(symbol, direction, nightly_points, annual_pct): the published nightly charge over a year in percent of a lot's value at prices (symbol, price).

    Null where the charge can't be converted to points or there is no positive price."""
    side = lambda d: F.struct(F.lit(d).alias("direction"), F.col(f"charge_{d}").alias("nightly_points"))
    rows = terms.join(prices, "symbol", "left").select("symbol", "point", "price", F.explode(F.array(side("long"), side("short")))
        .alias("x")).select("symbol", "point", "price", "x.*")
    # both the charge and the lot's value are points times the value of a point
    pct = F.when(F.col("price") > 0, 100.0 * 365.0 * F.col("nightly_points") * F.col("point") / F.col("price"))
    return rows.select("symbol", "direction", "nightly_points", pct.alias("annual_pct"))


def daily_loss(accounts: DataFrame, positions: DataFrame, deals: DataFrame, now: int, offset: float | None, limit_pct: float = 2.0) -> DataFrame:
    """Per account: the server day's realised and floating result against the limit, the balance it opened at being equity less both. Without a clock: a refusal."""
    if offset is None:
        return accounts.select("account", F.lit("NO_SERVER_CLOCK").alias("refusal"))
    start, end = clock.server_day_bounds(F.lit(now).cast("long"), F.lit(offset))
    done = deals.where((F.col("closed_at") >= start) & (F.col("closed_at") < end)).groupBy("account").agg(F.sum(F.col("profit") + F.col("commission") + F.col("swap") + F.col("fee")).alias("realised"), F.count("*").alias("deals"))
    open_ = positions.groupBy("account").agg(F.sum(F.col("profit") + F.col("swap")).alias("floating"), F.count_if(F.col("opened_at") < start).alias("carried_in"))
    zero = lambda c, t="double": F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c)
    r = accounts.select("account", "equity").join(done, "account", "left").join(open_, "account", "left").select("account", "equity",
        zero("realised"), zero("floating"), zero("deals", "long"), zero("carried_in", "long"))
    total = F.col("realised") + F.col("floating")
    r = r.withColumn("limit", (F.col("equity") - total) * limit_pct / 100.0).withColumn("loss", F.greatest(F.lit(0.0), -total))
    return r.withColumns({"used": F.when(F.col("limit") > 0, F.col("loss") / F.col("limit")), "breached": (F.col("limit") > 0) & (F.col("loss") >= F.col("limit"))})


def concurrency(positions: DataFrame, limit: int) -> DataFrame:
    """Open positions per account against the limit, and by symbol and by direction, from one pass of grouping sets."""
    g = positions.cube("account", "symbol", "direction").agg(F.count("*").alias("open"), F.grouping_id().alias("sets"))
    # bits of grouping_id: account 4, symbol 2, direction 1
    kept = g.where(F.col("sets").isin(1, 2, 3))
    return kept.select("account", "symbol", "direction", "open", F.when(F.col("sets") == 3, F.col("open") >= limit).alias("breached"))


def margin_projection(accounts: DataFrame, carry: DataFrame, max_leverage: int = 5000) -> DataFrame:
    """Two rows an account (call, stop_out): threshold equity by percent (mode 0) or money (mode 1), headroom, and the days that daily carry takes to use it up."""
    a = accounts.join(carry.select("account", F.col("rate").alias("daily_carry")), "account", "left")
    code = F.when(~F.col("leverage").between(1, max_leverage), "IMPLAUSIBLE_LEVERAGE").when(~F.col("stopout_mode").isin(0, 1),
        "STOPOUT_MODE_UNKNOWN").when(F.col("margin") <= 0, "NO_MARGIN_IN_USE")
    rows = a.select("account", "equity", "margin", "stopout_mode", "daily_carry", code.alias("refusal"),
        F.when(F.col("margin") > 0, 100.0 * F.col("equity") / F.col("margin")).alias("level_pct"),
            F.explode(F.array(F.struct(F.lit("call").alias("level"), F.col("call_level").alias("value")),
                F.struct(F.lit("stop_out").alias("level"), F.col("stop_level").alias("value")))).alias("x"))
    threshold = F.when(F.col("refusal").isNull(), F.when(F.col("stopout_mode") == 0, F.col("margin") * F.col("x.value") / 100.0).otherwise(F.col("x.value")))
    rows = rows.withColumn("threshold", threshold).withColumn("headroom", F.col("equity") - F.col("threshold"))
    breached = F.col("headroom") <= 0
    days = F.when(~breached & (F.col("daily_carry") > 0), F.col("headroom") / F.col("daily_carry"))
    return rows.select("account", F.col("x.level").alias("level"), "level_pct", "threshold", "headroom", breached.alias("breached"), days.alias("days"), "refusal")


def risk_alerts(carries: DataFrame, margin: DataFrame, daily: DataFrame, open_counts: DataFrame, portfolio: DataFrame,
    readings: DataFrame | None = None, divergence: DataFrame | None = None) -> DataFrame:
    """(account, code, severity, key) by rule; three times a threshold is critical. The same function serves batches of a stream.

    readings (account, connected, timing_refusal): an account that is not connected, or whose positions'
    openings moved, raises a critical alert; the latter takes the place of its positions' alerts, whose
    ages can't be trusted. divergence (account, symbol, bears_on_registry): financing over what is
    registered is critical. A limit that can't be worked out is a REFUSED alert and not silence."""
    rule = lambda when, code, severity, key: F.when(when, F.struct(F.lit(code).alias("code"), severity.alias("severity"), key.cast("string").alias("key")))
    warn, critical = F.lit("WARN"), F.lit("CRITICAL")
    graded = lambda c, at: F.when(c >= 3 * at, "CRITICAL").otherwise("WARN")

    def raised(df: DataFrame, *rules: Column) -> DataFrame:
        return df.select("account", F.explode(F.array_compact(F.array(*rules))).alias("a")).select("account", "a.*")

    days, pct, refusal = F.col("days_open"), F.col("carry_pct_of_equity"), F.col("refusal")
    out = []
    if readings is not None:
        out.append(raised(readings, rule(~F.col("connected"), "DISCONNECTED", critical, F.lit("reading")),
            rule(F.col("timing_refusal").isNotNull(), "REFUSED", critical, F.col("timing_refusal"))))
        carries = carries.join(readings.where("timing_refusal is not null").select("account"), "account", "left_anti")
    if divergence is not None:
        out.append(raised(divergence, rule(F.col("bears_on_registry"), "SWAP_DIVERGENCE", critical, F.col("symbol"))))
    out.append(raised(carries, rule(days >= 2, "TIME_IN_TRADE", graded(days, 2), F.col("ticket")),
        rule(pct >= 1, "CARRY_OF_EQUITY", graded(pct, 1), F.col("ticket")),
            rule(F.col("stop_loss").isNull() | (F.col("stop_loss") == 0), "NO_STOP", warn, F.col("ticket"))))
    near = F.when(F.col("days") <= 7, "CRITICAL").otherwise("WARN")
    unknown = (F.col("level") == "stop_out") & refusal.isin("STOPOUT_MODE_UNKNOWN", "IMPLAUSIBLE_LEVERAGE")
    out.append(raised(margin, rule(F.col("breached"), "MARGIN_BREACHED", critical, F.col("level")),
        rule(F.col("days") <= 30, "MARGIN_NEAR", near, F.col("level")), rule(unknown, "REFUSED", warn, refusal)))
    if "refusal" in daily.columns:
        out.append(raised(daily, rule(refusal.isNotNull(), "REFUSED", warn, refusal)))
    else:
        out.append(raised(daily, rule(F.col("breached"), "DAILY_LOSS", critical, F.lit("day")),
            rule(~F.col("breached") & (F.col("used") >= 0.75), "DAILY_LOSS_NEAR", warn, F.lit("day"))))
    out.append(raised(open_counts.where("symbol is null and direction is null"), rule(F.col("breached"), "CONCURRENCY", warn, F.lit("open"))))
    out.append(raised(portfolio, rule(F.col("days_to_zero") <= 90, "CARRY_EMPTIES_EQUITY", warn, F.lit("book"))))
    return reduce(DataFrame.unionByName, out)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), severity)


def worst_severity(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("account").agg(F.min_by("severity", severity_rank(F.col("severity"))).alias("worst"), F.count("*").alias("alerts"))


def check_openings(baseline: DataFrame, positions: DataFrame, tolerance: int = 1) -> DataFrame:
    """positions with first_seen (the baseline's opening where there is one) and moved, when the two differ by more than the tolerance. Tickets no longer open drop out."""
    joined = positions.join(baseline.select("ticket", F.col("opened_at").alias("was")), "ticket", "left")
    return joined.select("ticket", "opened_at", F.coalesce("was", "opened_at").alias("first_seen"),
        F.coalesce(F.abs(F.col("opened_at") - F.col("was")) > tolerance, F.lit(False)).alias("moved"))


def check_readings(readings: DataFrame, tolerance: int = 1) -> DataFrame:
    """Each account's readings (account, reading, read_at, positions array<struct<ticket, opened_at>>) against the openings first seen.

    A reading timed before an earlier one is refused whole (READING_CLOCK) and shows nothing. Among the others, a ticket's unbroken run of readings has
    its first opening as first_seen; one that moved by more than the tolerance is POSITION_AGE_MOVED. Positions that could not be
    read (null) break no run; an empty list ends all. A reading that comes twice counts once."""
    by = Window.partitionBy("account").orderBy("reading")
    once = readings.where("account is not null and reading is not null and read_at is not null").groupBy("account", "reading").agg(F.min(F.struct("read_at", "positions")).alias("r"))
    before = F.max("read_at").over(by.rowsBetween(Window.unboundedPreceding, -1))
    timed = once.select("account", "reading", "r.*").withColumn("back", F.coalesce(F.col("read_at") < before, F.lit(False)))
    read = timed.where("not back and positions is not null").withColumn("n", F.row_number().over(by))
    shown = read.select("account", "reading", "read_at", "n", F.explode("positions").alias("p")).select("account", "reading", "read_at", "n", "p.ticket", "p.opened_at")
    own = Window.partitionBy("account", "ticket").orderBy("n")
    runs = shown.withColumn("run", F.col("n") - F.dense_rank().over(own))
    runs = runs.withColumn("first_seen", F.first("opened_at").over(Window.partitionBy("account", "ticket", "run").orderBy("n", "opened_at")))
    runs = runs.withColumn("moved", F.abs(F.col("opened_at") - F.col("first_seen")) > tolerance)
    columns = ["account", "reading", "read_at", "ticket", "opened_at"]
    told = runs.select(*columns, "first_seen", "moved", F.when(F.col("moved"), "POSITION_AGE_MOVED").alias("refusal"))
    refused = timed.where("back").select("account", "reading", "read_at", F.explode_outer("positions").alias("p")).select("account", "reading", "read_at", "p.ticket", "p.opened_at")
    return told.unionByName(refused.withColumn("refusal", F.lit("READING_CLOCK")), allowMissingColumns=True)


def fresh(age, stale: int):
    """Whether a reading of this age, a Column or a number, is recent enough."""
    return age <= stale


def heartbeat(expected: DataFrame, readings: DataFrame, now: int, stale: int = 180) -> DataFrame:
    """Per expected account: age of its last reading, and whether all is clear; no reading is not."""
    last = readings.groupBy("account").agg(F.max("reading_at").alias("last"))
    age = F.lit(now) - F.col("last")
    return expected.select("account").join(last, "account", "left").select("account", "last", age.alias("age"), F.coalesce(fresh(age, stale), F.lit(False)).alias("clear"))


def clock_offsets(readings: DataFrame, residual: int = 300) -> DataFrame:
    """readings (account, host_at, server_at, explicit): offset in whole hours, explicit before measured before the last good one."""
    hours = F.bround((F.col("server_at") - F.col("host_at")) / 3600.0)
    good = (F.abs(F.col("server_at") - F.col("host_at") - hours * 3600) <= residual) & clock.offset_is_plausible(hours)
    w = Window.partitionBy("account").orderBy("host_at")
    measured = F.when(good, hours)
    cached = F.last(measured, ignorenulls=True).over(w)
    return readings.select("account", "host_at", F.coalesce(F.col("explicit").cast("double"), measured, cached).alias("offset"),
        F.when(F.col("explicit").isNotNull(), "explicit").when(measured.isNotNull(), "measured").when(cached.isNotNull(), "cached")
            .otherwise("unavailable").alias("source"))


def nightly_charges(log: DataFrame) -> DataFrame:
    """log (ticket, at, carry_paid, price, offset): the increments of cumulative carry that are not zero, in units of their median, with the server's weekday."""
    w = Window.partitionBy("ticket").orderBy("at")
    steps = log.withColumn("charge", F.round(F.col("carry_paid") - F.lag("carry_paid").over(w), 8)).where("charge <> 0")
    units = steps.groupBy("ticket").agg(F.percentile(F.abs("charge"), 0.5).alias("unit"))
    j = steps.join(units, "ticket")
    return j.select("ticket", "at", "charge", "unit", F.greatest(F.lit(1.0), F.bround(F.abs("charge") / F.col("unit"))).alias("multiplier"),
        clock.weekday((F.col("at") + F.col("offset") * 3600).cast("long")).alias("weekday"), "price")


def charge_structure(charges: DataFrame, min_nights: int = 5, factor: float = 3.0, tick: float = 0.01) -> DataFrame:
    """Per ticket: whether the unit charge is fixed or follows the price, by the sample variation of the charge and of charge over price, where there are nights, range and reversals enough to tell."""
    w = Window.partitionBy("ticket").orderBy("at")
    own = charges.withColumn("per", F.col("charge") / F.col("multiplier")).withColumn("step", F.sign(F.col("price") - F.lag("price").over(w)))
    own = own.withColumn("turn", ((F.col("step") * F.lag("step").over(w)) < 0).cast("int"))
    cv = lambda c: F.try_divide(F.stddev_samp(c), F.abs(F.avg(c)))
    g = own.groupBy("ticket").agg(F.count("*").alias("nights"), (F.max("price") - F.min("price")).alias("range"), F.avg("price").alias("mean_price"),
        F.sum("turn").alias("reversals"), F.avg(F.abs("per")).alias("unit"), cv(F.col("per")).alias("cv_charge"), cv(F.col("per") / F.col("price")).alias("cv_rate"))
    told = (F.col("nights") >= min_nights) & (F.col("range") >= 3 * tick / F.col("unit") * F.col("mean_price")) & (F.col("reversals") >= 2)
    verdict = F.when(~told, "UNDETERMINED").when(F.col("cv_charge") > factor * F.col("cv_rate"),
        "PRICE_DEPENDENT").when(F.col("cv_rate") > factor * F.col("cv_charge"), "FIXED_RATE").otherwise("UNDETERMINED")
    return g.withColumn("verdict", verdict)
