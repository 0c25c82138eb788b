"""Hand-computed cases of the operators, storage round trips and streams."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.functions import clock, costs
from barlab.operators import account as ac
from barlab.operators import evaluate as ev
from barlab.operators import features as fe
from barlab.operators import folds as fo
from barlab.operators import gaps as ga
from barlab.operators import outcomes as ou
from barlab.operators import profile as pr
from barlab.operators.bars import roll_up, with_bar_seq
from barlab.sources import scans, snapshot
from barlab.streaming import jobs


def series(spark, close, high=None, low=None, volume=None):
    high, low, volume = high or close, low or close, volume or [1] * len(close)
    return spark.createDataFrame([("x", i, i * 3600, float(c), float(h), float(l), float(c), v) for i, (c, h, l, v) in enumerate(zip(close, high, low, volume, strict=True))], "symbol string, bar_seq long, time long, open double, high double, low double, close double, tick_volume long")


def column(df, name):
    return [r[name] for r in df.orderBy("bar_seq").collect()]


def near(a, b):
    return len(a) == len(b) and all(x is y is None or (x is not None and y is not None and math.isclose(x, y, abs_tol=1e-12)) for x, y in zip(a, b, strict=True))


def test_roll_up(spark):
    rows = spark.createDataFrame([("x", 0, 10.0, 15.0, 8.0, 12.0, 1), ("x", 60, 20.0, 25.0, 19.0, 24.0, 2), ("x", 120, 30.0, 33.0, 28.0, 31.0, 3)], "symbol string, time long, open double, high double, low double, close double, tick_volume long")
    r = roll_up(rows, 3600).first()
    assert (r["open"], r["high"], r["low"], r["close"], r["tick_volume"], r["n"]) == (10, 33, 8, 31, 6, 3)


def test_bar_seq_is_dense(spark):
    rows = spark.range(0, 5000).select(F.lit("x").alias("symbol"), (F.col("id") * 7200 + F.col("id") % 3).alias("time"))
    assert [r["bar_seq"] for r in with_bar_seq(rows).orderBy("time").collect()] == list(range(5000))


def test_features(spark):
    assert near(column(fe.with_features(series(spark, [100, 110, 121, 121]), [fe.log_return(2)]), "log_return_2"), [None, None, math.log(1.21), math.log(1.1)])
    assert near(column(fe.with_features(series(spark, [100, 110, 121, 133.1, 146.41]), [fe.realized_vol(2)]), "realized_vol_2"), [None, None, 0, 0, 0])
    assert near(column(fe.with_features(series(spark, [9, 11, 8], [10, 12, 11], [8, 9, 7]), [fe.range_position(2)]), "range_position_2"), [None, 0.75, 0.2])
    assert near(column(fe.with_features(series(spark, [100, 120, 90, 110, 60]), [fe.drawdown_from_max(3)]), "drawdown_from_max_3"), [None, None, 30 / 120, 10 / 120, 50 / 110])
    assert near(column(fe.with_features(series(spark, [100, 110, 121, 121], volume=[5, 10, 20, 40]), [fe.volume_weighted_return(2)]), "volume_weighted_return_2"), [None, None, math.log(1.21) / 30, math.log(1.1) / 60])
    assert near(column(fe.wilder_atr(series(spark, [9, 10, 11, 8], [10, 11, 12, 10], [8, 9, 10, 7]), 2), "atr"), [None, None, 2, 3])


def test_chunks_do_not_change_features(spark):
    rng = np.random.default_rng(1)
    bars = series(spark, (100 + rng.standard_normal(300).cumsum()).tolist())
    specs = [fe.log_return(5), fe.range_position(24), fe.realized_vol(10)]
    whole, cut = fe.with_features(bars, specs), fe.with_features(bars, specs, size=40)
    assert all(near(column(whole, s.name), column(cut, s.name)) for s in specs)
    assert near([round(x or 0, 9) for x in column(fe.wilder_atr(bars, 14), "atr")], [round(x or 0, 9) for x in column(fe.wilder_atr(bars, 14, size=37), "atr")])
    assert near(column(fe.rolling_median(bars, "close", 150, "m"), "m"), column(fe.rolling_median(bars, "close", 150, "m", size=151), "m"))


def test_rolling_median_with_nulls(spark):
    df = series(spark, [5, 1, 3, 9, 7]).withColumn("v", F.when(F.col("bar_seq") != 1, F.col("close")))
    assert near(column(fe.rolling_median(df, "close", 3, "m"), "m"), [None, None, 3, 3, 7])
    assert near(column(fe.rolling_median(df, "v", 3, "m"), "m"), [None, None, None, None, 7])


def test_labels_and_validity(spark):
    assert near(column(fe.direction_label(series(spark, [100, 101, 99, 100, 100]), 2), "label"), [0, 0, 1, None, None])
    bars = series(spark, [1] * 40).withColumn("valid", F.col("bar_seq") != 20)
    v = ga.window_validity(bars, 5, 5, 24)
    assert [i for i, x in enumerate(column(v, "label_valid")) if not x] == [*range(15, 21), *range(35, 40)]
    assert [i for i, x in enumerate(column(v, "feature_valid")) if not x] == [*range(4), *range(20, 25)]


def test_causality_audit_catches_a_leak(spark):
    bars = series(spark, [float(i % 17) + 1 for i in range(300)])
    leaky = fe.FeatureSpec("leaky", 3, lambda w: F.lead("close", 2).over(w))
    r = {x["feature"]: x["bad"] for x in fe.causality_audit(bars, [fe.log_return(2), leaky], 50).groupBy("feature").agg(F.count_if(~F.col("same")).alias("bad")).collect()}
    assert r["log_return_2"] == 0 and r["leaky"] > 0


def test_recursion_audit_is_bitwise_over_chunks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    close = np.cumsum(rng.standard_normal(700)) * 0.37 + 100
    rows = [("s", i, float(c), float(c + rng.random()), float(c - rng.random())) for i, c in enumerate(close)] + [("t", i, 1.0, 2.0, 0.5) for i in range(9)]
    bars = spark.createDataFrame(rows, "symbol string, bar_seq long, close double, high double, low double").repartition(5)
    told = fe.recursion_audit(bars, size=64, cuts=300).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(~F.col("same")).alias("bad")).collect()
    assert {r["symbol"]: (r["n"], r["bad"]) for r in told} == {"s": (300, 0), "t": (8, 0)}
    # the bar after is in the range: told at every cut that has a value
    monkeypatch.setattr(fe, "_true_range", lambda: F.greatest(F.col("high") - F.col("low"), F.coalesce(F.lead("high").over(fe.series()), F.lit(0.0))))
    assert fe.recursion_audit(bars.where("symbol = 's'"), size=64, cuts=20).where("not same").count() > 15


def test_rollovers(spark):
    at = lambda s: F.unix_timestamp(F.lit(s).cast("timestamp"))
    cases = [("2021-06-07 20:00:00", "2021-06-07 22:00:00", 1), ("2021-06-07 20:00:00", "2021-06-07 20:30:00", 0), ("2021-06-07 20:00:00", "2021-06-09 22:00:00", 3), ("2021-06-09 22:00:00", "2021-06-07 20:00:00", 0)]
    row = spark.range(1).select(*[clock.rollovers_crossed(at(a), at(b)).alias(str(i)) for i, (a, b, _) in enumerate(cases)]).first()
    assert [*row] == [n for _, _, n in cases]


def test_multipliers(spark):
    stamps = ["2021-06-04 20:00", "2021-06-04 21:00", "2021-06-06 21:00", "2021-06-06 22:00", "2021-06-06 23:00", "2021-06-07 00:00"]
    rows = spark.createDataFrame([("x", i, s) for i, s in enumerate(stamps)] + [("y", i, f"2021-06-04 {h}:00") for i, h in enumerate((11, 12, 13))], "symbol string, bar_seq long, s string").withColumn("utc", F.unix_timestamp(F.col("s").cast("timestamp")))
    got = {s: [r["multiplier"] for r in ou.multipliers(rows).where(F.col("symbol") == s).orderBy("bar_seq").collect()] for s in "xy"}
    assert got == {"x": [1, 1, 3, 3, 3, 1], "y": [1, 10, 1]}


def exec_bars(spark, path):
    return spark.createDataFrame([("x", i, 1623052800 + 3600 * i, 1.0, float(o), float(h), float(l)) for i, (o, h, l) in enumerate(path)], "symbol string, bar_seq long, utc long, multiplier double, open double, high double, low double")


@pytest.mark.parametrize(("path", "reason", "exit_mid", "gap"), [([(200100, 202000, 198000)] + [(200100,) * 3] * 3, "stop", 198600, 0), ([(200100,) * 3] + [(198000,) * 3] * 3, "stop", 198000, 600), ([(200100,) * 3] + [(202000,) * 3] * 3, "target", 201600, 0), ([(200100,) * 3] * 4, "time", 200100, 0)])
def test_barriers(spark, path, reason, exit_mid, gap):
    bars = exec_bars(spark, [(200100,) * 3, *path])
    free = costs.variants(spark, {"free": costs.CostModel().at_floor(0.0, sweep=True)})
    out = ou.barrier_outcomes(spark.createDataFrame([("x", 0, 1000.0)], "symbol string, bar_seq long, atr double"), bars, free, ou.Risk(1.5, 1.5, 3)).where("sign = 1").first()
    assert (out["reason"], out["exit_mid"], out["gap_through"]) == (reason, exit_mid, gap)


def test_cost_variants():
    base = costs.CostModel()
    assert base.doubled().floor == 150 and base.doubled().news_multiplier == 10
    with pytest.raises(ValueError):
        base.at_floor(10)


def test_folds(spark):
    bars = spark.range(30_000).select(F.lit("x").alias("symbol"), F.col("id").alias("bar_seq"), F.lit(True).alias("valid"))
    folds = spark.createDataFrame([("x", k, 10_000 + 4000 * k, 14_000 + 4000 * k) for k in range(5)], "symbol string, fold int, test_start long, test_end long")
    members = fo.walk_forward(bars, folds, 24)
    assert all((r["purged"], r["embargoed"]) == (24, 0) for r in fo.fold_counts(members).collect())
    assert all((r["overlap"], r["reaches"]) == (0, False) for r in fo.leaks(members, folds, 24).collect())


def test_brier(spark):
    f = spark.createDataFrame([(0, 0.8, 1.0), (0, 0.3, 0.0)], "fold int, p double, y double")
    assert fo.brier(f, ["fold"]).where("fold is null").first()["brier"] == pytest.approx(0.065)


def test_fit_agrees_with_one_machine(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 2))
    y = (rng.random(200) < ev.sigmoid(x @ [1.0, -0.5])).astype(float)
    rows = spark.createDataFrame([("s", 0, 0, i, "train" if i < 150 else "test", float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(200)], "symbol string, fold int, seed int, bar_seq long, role string, y double, a double, b double")
    got = [r["p"] for r in ev.fit_predict(rows, {"all": ["a", "b"]}).orderBy("bar_seq").collect()]
    z = (x - x[:150].mean(0)) / x[:150].std(0)
    assert np.allclose(got, ev.Logistic().fit(z[:150], y[:150]).predict(z[150:]))
    leak = ev.skill(ev.fit_predict(rows, {"all": ["a", "b"]}, "label_column"), ["symbol"]).first()["skill"]
    assert leak > 0.8


def test_fits_together_are_the_fits_alone():
    rng = np.random.default_rng(9)
    x, y = rng.standard_normal((120, 3)), (rng.random((120, 5)) < 0.4).astype(float)
    own = rng.standard_normal((120, 5))
    for steps, tolerance in ((50, None), (3000, 1e-3)):
        many = ev.Logistic(steps, tolerance=tolerance).fit(x, y, own)
        for k in range(5):
            one = ev.Logistic(steps, tolerance=tolerance).fit(np.column_stack([x, own[:, k]]), y[:, k])
            assert np.allclose(many.weights[:, k], one.weights) and np.allclose(many.intercept[k], one.intercept)
            assert (many.iterations[k], many.converged[k], many.hit_cap[k]) == (one.iterations, one.converged, one.hit_cap)


def test_null_fits_sum_up_the_forecasts(spark):
    rng = np.random.default_rng(13)
    rows = [("s", 0, i, "train" if i < 90 else "test", rng.standard_normal(2).tolist(), [float(rng.random() < 0.5), float(rng.random() < 0.3)]) for i in range(130)]
    table = spark.createDataFrame([(s, f, i, role, x[0], x[1], ys) for s, f, i, role, x, ys in rows], "symbol string, fold int, bar_seq long, role string, a double, b double, ys array<double>")
    sums = {(r["leak"], r["seed"]): r for r in ev.null_fits(table, {"all": ["a", "b"]}, ev.LEAKS).collect()}
    assert len(sums) == 10
    for seed in (0, 1):
        own = table.withColumn("y", F.col("ys")[seed]).withColumn("seed", F.lit(seed)).drop("ys")
        for leak in ev.LEAKS:
            f = ev.fit_predict(own, {"all": ["a", "b"]}, leak).agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("e")).first()
            r = sums[leak, seed]
            assert (r["n"], r["sum_y"]) == (f["n"], f["y"]) and r["sum_error"] == pytest.approx(f["e"])
            assert r["parameters"] == 3 + (leak in ("label_column", "target_means"))
    study = ev.null_study(ev.pooled_skill(spark.createDataFrame([*sums.values()]), ["symbol", "leak", "seed"]), ["symbol", "leak"]).collect()
    assert {r["leak"]: r["trips"] for r in study}["label_column"] and all(r["seeds"] == 2 for r in study)


def test_embargo_on_both_sides_and_reproduced_fits(spark):
    rng = np.random.default_rng(4)
    table = spark.createDataFrame([("s", i, True, float(rng.random() < 0.5), float(x), float(y)) for i, (x, y) in enumerate(rng.standard_normal((100, 2)))], "symbol string, bar_seq long, valid boolean, y double, a double, b double")
    folds = fo.fold_geometry(table, 5, 0.5)
    members = fo.walk_forward(table, folds, 4, both_sides=True)
    counts = {r["fold"]: tuple(r)[2:] for r in fo.fold_counts(members).orderBy("fold").collect()}
    # train, test, purged, embargoed: windows of ten rows from 50 on
    assert counts == {k: (46 + 10 * k + max(0, 36 - 10 * k), 3, 4, 4 if k < 4 else 0) for k in range(5)}
    assert fo.fold_counts(fo.walk_forward(table, folds, 4, embargo=False, both_sides=True)).agg(F.sum("embargoed").alias("n")).first()["n"] == 0
    rows = members.where("role in ('train', 'test')").join(table.drop("valid"), ["symbol", "bar_seq"]).withColumn("seed", F.lit(0))
    fits = ev.fit_predict(rows, {"all": ["a", "b"]}, model=lambda: ev.Logistic(50))
    scaled = fo.standardise(rows, ["a", "b"]).where("role = 'test'")
    assert all(r["agrees"] and r["rows"] == 3 for r in ev.reproduced(fits, scaled, ["a", "b"]).collect())
    off = scaled.withColumn("a", F.when((F.col("fold") == 2) & (F.col("bar_seq") % 10 == 0), F.col("a") + 0.1).otherwise(F.col("a")))
    assert {r["fold"]: r["agrees"] for r in ev.reproduced(fits, off, ["a", "b"]).collect()} == {k: k != 2 for k in range(5)}


def test_permutation_keeps_the_labels(spark):
    rows = spark.createDataFrame([("s", i, float(i % 5 == 0)) for i in range(100)], "symbol string, bar_seq long, y double")
    out = ev.permuted(rows, 3)
    assert [r["n"] for r in out.groupBy("seed").agg(F.sum("y").alias("n")).collect()] == [20, 20, 20] and out.count() == 300


def test_bootstrap(spark):
    rows = spark.createDataFrame([("s", i, 1.0 + (i % 7) / 10) for i in range(200)], "symbol string, bar_seq long, v double")
    for block in (1, 10):
        r = ev.bootstrap_mean(rows, ["symbol"], "v", 400, block).first()
        assert r["low"] < r["mean"] < r["high"] and r["p_value"] == pytest.approx(1 / 401)


@pytest.mark.parametrize("block", [1, 10])
def test_bootstrap_has_one_law_however_it_is_cut(spark, block):
    """Pieces and parts change no bit of the means; a hot group of many units beside small ones."""
    rng = np.random.default_rng(2)
    v = rng.standard_normal(9 * ev.UNIT + 17) + 0.02
    rows = [("s", i, float(x)) for i, x in enumerate(v)] + [("t", i, float(x)) for i, x in enumerate(v[:30])] + [("u", 0, 1.5), ("n", 0, None)]
    table = spark.createDataFrame(rows, "symbol string, bar_seq long, v double").repartition(7)
    got = [sorted(map(tuple, ev.bootstrap_mean(table, ["symbol"], "v", 60, block, piece_units=u, parts=p).collect())) for u, p in ((256, 8), (1, 3), (4, 1))]
    assert got[0] == got[1] == got[2] and [r[0] for r in got[0]] == ["s", "t", "u"]
    # by definition, on one machine
    for symbol, own in (("s", v), ("t", v[:30])):
        means = own[ev.drawn_rows(len(own), np.arange(60), block, 1337)].mean(1)
        _, mean, low, high, p = next(r for r in got[0] if r[0] == symbol)
        assert (mean, low, high) == pytest.approx((own.mean(), np.percentile(means, 2.5), np.percentile(means, 97.5)))
        assert p == (1 + (means - own.mean() >= own.mean()).sum()) / 61


def test_drawn_rows_are_stationary_blocks():
    n, block = 500, 10
    at = ev.drawn_rows(n, np.arange(400), block, 7)
    steps = (np.diff(at, axis=1) % n != 1).mean()
    assert at.min() == 0 and at.max() == n - 1 and steps == pytest.approx(1 / block, rel=0.05)
    assert np.bincount(at.ravel(), minlength=n).std() < 3 * np.sqrt(400 * block) and len(np.unique(at[:, 0])) > 250
    assert (at[:50] == ev.drawn_rows(n, np.arange(50), block, 7)).all() and (at[0] != ev.drawn_rows(n, np.arange(1), block, 8)[0]).any()
    ones = ev.drawn_rows(n, np.arange(400), 1, 7)
    means = ones.mean(1)
    assert means.std() == pytest.approx(n / np.sqrt(12) / np.sqrt(n), rel=0.15) and at.mean(1).std() > 3 * means.std()


@pytest.mark.parametrize("block_rows", [7, 64, 10_000])
def test_fits_by_blocks_are_the_grouped_fits(spark, block_rows):
    rng = np.random.default_rng(21)
    rows = []
    for symbol, fold, n in (("s", 0, 150), ("s", 1, 90), ("t", 0, 40)):
        for i in range(n):
            a, b = rng.standard_normal(2)
            rows.append((symbol, fold, 0, i, "test" if i % 5 == 0 else "train", float(rng.random() < ev.sigmoid(np.array(a - b / 2))), float(a), float(b), 3.0))
    rows += [("one", 0, 0, i, "train" if i else "test", 1.0, float(i), 0.0, 1.0) for i in range(9)] + [("none", 0, 0, 1, "test", 1.0, 1.0, 0.0, 1.0)]
    table = spark.createDataFrame(rows, "symbol string, fold int, seed int, bar_seq long, role string, y double, a double, b double, same double")
    names = ["a", "b", "same"]
    by = lambda df: {(r["symbol"], r["fold"], r["bar_seq"]): r for r in df.collect()}
    want = by(ev.fit_predict(table, {"all": names}, model=lambda: ev.Logistic(6)))
    got = by(ev.fit_predict_blocks(table, names, steps=6, block_rows=block_rows, every=4))
    assert got.keys() == want.keys() and len(got) == 56
    for k in got:
        assert got[k]["p"] == pytest.approx(want[k]["p"], abs=1e-9) and got[k]["y"] == want[k]["y"] and got[k]["norm"] == pytest.approx(want[k]["norm"])
    if block_rows == 64:
        want = by(ev.fit_predict(table, {"all": names}, model=lambda: ev.Logistic(200_000, tolerance=1e-10)))
        got = by(ev.fit_predict_blocks(table, names, steps=50, tolerance=1e-10, newton=True, block_rows=block_rows))
        assert all(got[k]["converged"] and got[k]["iterations"] < 15 and got[k]["p"] == pytest.approx(want[k]["p"], abs=1e-6) for k in want)


def test_sizing(spark):
    r = ac.size_positions(spark.createDataFrame([(4637.20, 500.0, 32.0, 0.01, 0.01, 1.0, 0.01, 50.0, 0.01, 2000.0)], "equity double, atr_points double, spread_points double, point double, tick_size double, tick_value double, volume_min double, volume_max double, volume_step double, price double")).first()
    assert (r["adverse_points"], r["lots"]) == (782, 0.05)


@pytest.mark.parametrize(("prices", "proportional", "verdict"), [([2400, 2424, 2410, 2436, 2418, 2430], True, "PRICE_DEPENDENT"), ([2400, 2424, 2410, 2436, 2418, 2430], False, "FIXED_RATE"), ([2400, 2410, 2420, 2430, 2440, 2450], True, "UNDETERMINED"), ([2400, 2400.4, 2400, 2400.5, 2400.1, 2400.3], True, "UNDETERMINED")])
def test_charge_structure(spark, prices, proportional, verdict):
    paid, rows = 0.0, [(1, 0, 0.0, 2400.0, 3.0)]
    for i, p in enumerate(prices):
        paid += round(6.79 * (p / 2400 if proportional else 1), 2)
        rows.append((1, (i + 1) * 86400, paid, float(p), 3.0))
    log = spark.createDataFrame(rows, "ticket long, at long, carry_paid double, price double, offset double")
    assert ac.charge_structure(ac.nightly_charges(log)).first()["verdict"] == verdict


def test_runs_are_absorbed(spark):
    days = spark.createDataFrame([("x", i, i < 40 or 45 <= i < 90) for i in range(140)], "symbol string, day long, state boolean")
    out = pr.absorb_short_runs(pr.session_runs(days), 30).orderBy("run").collect()
    assert [(r["state"], r["days"]) for r in out] == [(True, 85), (False, 50)]


def test_scans(spark, tmp_path):
    (tmp_path / "bars.csv").write_text("time,open,high,low,close,tick_volume,spread,real_volume\n0,1.00,2.00,0.50,1.50,3,0,7\n")
    row = scans.unrecorded_to_null(scans.load_bars(spark, str(tmp_path / "bars.csv"), "x")).first()
    assert row["spread"] is None and row["real_volume"] == 7
    (tmp_path / "wrong.csv").write_text("time,open,high,low,shut,tick_volume,spread,real_volume\n0,1,2,0,1,3,0,7\n")
    with pytest.raises(Exception):  # noqa: B017
        scans.load_bars(spark, str(tmp_path / "wrong.csv"), "x").collect()
    text = spark.createDataFrame([("4815.30",)], "p string")
    assert float(text.select(scans.parse_price(F.col("p")).alias("v")).first()["v"]) == 4815.3
    with pytest.raises(Exception):  # noqa: B017
        spark.createDataFrame([("4815.301",)], "p string").select(scans.parse_price(F.col("p"))).collect()


def test_file_audit(spark, tmp_path):
    for name, text in (("a", "one"), ("b", "two"), ("d", "four")):
        (tmp_path / name).write_text(text)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    (tmp_path / "a.sha256").write_text(digest("one") + "  a\n")
    registry = spark.createDataFrame([("a", digest("one"), False), ("b", digest("no"), False), ("c", digest("x"), False), ("e", None, True)], "filename string, sha256 string, awaiting boolean")
    assert {r["filename"]: r["state"] for r in scans.audit_files(spark, str(tmp_path), registry).collect()} == {"a": "matched", "b": "hash-mismatch", "c": "missing", "d": "unregistered", "e": "awaiting"}


def test_carry_log_refusal(spark, tmp_path):
    row = '{"at": "2026-01-01T00:00:00Z", "ticket": %d, "symbol": "x", "direction": "long", "volume": 1, "carry_paid": 0, "server_offset_hours": %s, "server_offset_source": "measured"}\n'
    (tmp_path / "good.jsonl").write_text(row % (1, 3) + "\n" + row % (2, 3))
    (tmp_path / "bad.jsonl").write_text(row % (3, 3) + row % (4, 99))
    good, bad = scans.load_carry_log(spark, str(tmp_path))
    assert sorted(r["ticket"] for r in good.collect()) == [1, 2] and sorted(r["ticket"] for r in bad.collect()) == [3, 4]


def test_snapshot_gates(spark, tmp_path):
    bars = series(spark, [1.0, 2.0, 3.0]).withColumns({"in_window": F.lit(True), "valid": F.col("bar_seq") > 0, "label_valid": F.lit(True)})
    checks = lambda x: spark.createDataFrame([("x", n, x) for n in snapshot.INVARIANTS], "symbol string, name string, outcome string")
    with pytest.raises(ValueError):
        snapshot.write_snapshot(bars, checks("fail"), f"{tmp_path}/s", "h")
    snapshot.write_snapshot(bars, checks("pass"), f"{tmp_path}/s", "h")
    assert snapshot.load_window(spark, f"{tmp_path}/s", "h").count() == 2 and snapshot.load_full(spark, f"{tmp_path}/s").count() == 3
    with pytest.raises(ValueError):
        snapshot.load_window(spark, f"{tmp_path}/s", "other")
    with pytest.raises(Exception):  # noqa: B017
        snapshot.write_snapshot(bars, checks("pass"), f"{tmp_path}/s", "h")


def test_tick_stream_and_ledger(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = ",".join(c.split()[0] for c in jobs.TICK_SCHEMA.split(", ")) + "\n"
    (tmp_path / "in/1.csv").write_text(head + "1,1000,1,2,0,0,2,0\n1,1000,1,2,0,0,2,0\n1,1000,1,3,0,0,2,0\n")
    jobs.write_ticks(jobs.ingest_ticks(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    sink = jobs.ledger_batch(str(tmp_path / "ledger"))
    for n in (0, 1, 1):
        sink(spark.range(n * 10, n * 10 + 5), n)
    assert [r["status"] for r in jobs.audit_ledger(spark, str(tmp_path / "ledger")).collect()] == ["OK", "OK"]
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "ledger/data/batch=1"))
    assert [r["status"] for r in jobs.audit_ledger(spark, str(tmp_path / "ledger")).collect()] == ["OK", "TAMPERED"]


def test_ledger_chain_and_recovery(spark, tmp_path):
    path = str(tmp_path / "l")
    sink = jobs.ledger_batch(path)
    for n in range(3):
        sink(spark.range(n * 10, n * 10 + 5), n)
    # the writer died between data and ledger
    spark.range(2).write.parquet(f"{path}/data/batch=3")
    sink(spark.range(30, 35), 3)
    status = lambda: [(r["seq"], r["status"]) for r in jobs.audit_ledger(spark, path).collect()]
    assert status() == [(0, "OK"), (1, "OK"), (2, "OK"), (3, "RECOVERED")]
    kept = [r.asDict() for r in spark.read.parquet(f"{path}/ledger").collect() if r["seq"] != 1]
    spark.createDataFrame(kept, "seq long, rows long, segment string, chain string, status string").write.mode("overwrite").parquet(f"{path}/ledger")
    assert status() == [(0, "OK"), (1, "UNRECORDED"), (2, "BROKEN"), (3, "RECOVERED")]


def test_throttle_prefers_the_severe_of_one_second(spark):
    df = spark.createDataFrame([("a", "C", "k", s, 5) for s in ("INFO", "WARN", "CRITICAL")] + [("b", "C", "k", s, 5) for s in ("INFO", "WARN")], jobs.ALERT)
    assert sorted((r["account"], r["severity"]) for r in jobs.throttle(df).collect()) == [("a", "CRITICAL"), ("b", "WARN")]


def test_throttle_by_definition_over_batches(spark):
    """Null keys, times and repeated rows, groups longer than an Arrow batch, against the rule row by row; no call for each group."""
    rng = np.random.default_rng(9)
    rows = [(a, "C", k, s, int(t)) for a, k, n, span in (("a", "k", 300, 9000), ("a", None, 40, 400_000), (None, "k", 60, 30_000), ("b", "k", 1, 5))
        for t, s in zip(rng.integers(-span, span, n), rng.choice(["INFO", "WARN", "CRITICAL"], n, p=[0.7, 0.25, 0.05]).tolist(), strict=True)]
    rows += rows[:50] + [("c", "C", str(i), "WARN", 3600 * t) for i in range(200) for t in range(3)] + [("d", "C", "k", "WARN", None), ("d", "C", "k", "WARN", 7)]
    rows += [("e", "C", "k", "WARN", -(2**63)), ("e", "C", "k", "WARN", 2**63 - 1)]
    want, last = [], {}
    for r in sorted(rows, key=lambda r: (r[4] is None, r[4] or 0, jobs.RANK[r[3]])):
        was = last.get(r[:3])
        if was is None or r[4] is not None and r[4] - was[4] >= 3600 or jobs.RANK[r[3]] < jobs.RANK[was[3]]:
            last[r[:3]] = r
            want.append(r)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sent = jobs.throttle(spark.createDataFrame(rows, jobs.ALERT).repartition(5))
        got = [tuple(r) for r in sent.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == sorted(want, key=str) and 600 < len(want) < len(rows)
    assert "FlatMapGroupsInPandas" not in sent._jdf.queryExecution().toString()


def test_sinks_of_alerts_and_carry_log(spark, tmp_path):
    alerts = spark.createDataFrame([("a", "C", "k", s, 5) for s in ("INFO", "CRITICAL")], jobs.ALERT)
    for _ in range(2):
        jobs.alert_batch(str(tmp_path / "alerts"))(alerts, 0)
        jobs.carry_log_batch(str(tmp_path / "carry"))(spark.createDataFrame([(1, True, "measured"), (2, False, "measured"), (3, True, "cached")], "ticket long, timing_trusted boolean, offset_source string"), 0)
    assert [r["severity"] for r in spark.read.json(str(tmp_path / "alerts/batch=0")).collect()] == ["CRITICAL", "INFO"]
    assert [r["ticket"] for r in spark.read.parquet(str(tmp_path / "carry/log")).collect()] == [1]
    assert {r["ticket"]: r["reason"] for r in spark.read.parquet(str(tmp_path / "carry/quarantine")).collect()} == {2: "timing not trusted", 3: "offset not measured"}


def test_throttle_stream_equals_batch(spark, tmp_path):
    rows = [("a", "C", "k", s, t) for s, t in (("WARN", 0), ("WARN", 10), ("CRITICAL", 20), ("WARN", 30), ("WARN", 3600), ("CRITICAL", 3625))] + [("b", "C", "k", "INFO", 5)]
    df = spark.createDataFrame(rows, jobs.ALERT)
    batch = sorted((r["account"], r["raised_at"]) for r in jobs.throttle(df).collect())
    assert batch == [("a", 0), ("a", 20), ("a", 3625), ("b", 5)]
    df.write.parquet(str(tmp_path / "alerts"))
    stream = jobs.throttle_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "alerts")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "sent")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["account"], r["raised_at"]) for r in spark.read.parquet(str(tmp_path / "sent")).collect()) == batch


def test_coverage_and_spreads_hold_no_group_in_one_row(spark):
    rng = np.random.default_rng(4)
    rows = [("a", 1, float(x)) for x in np.round(rng.exponential(50, 3000), 1) * (rng.random(3000) > 0.2)] + [("b", 1, x) for x in (3.0, 1.0, 1.0, None, -2.0)] + [("c", 2, 0.0), (None, 2, 7.0)]
    table = spark.createDataFrame(rows, "symbol string, day int, spread double")
    cover, spread = pr.coverage(table, ["symbol", "day"], "spread"), pr.spread_profile(table)
    for df in (cover, spread):
        assert "collect_list" not in df._jdf.queryExecution().toString()
    got, got_spread = ({r["symbol"]: r for r in df.collect()} for df in (cover, spread))
    assert len(got) == len(got_spread) == 4
    for s in ("a", "b", "c", None):
        own = [x for k, _, x in rows if k == s]
        seen, over = sorted(x for x in own if x), sorted(x for x in own if x and x > 0)
        at = lambda v, i: v[i] if v else None
        assert tuple(got[s][c] for c in ("rows", "recorded", "least", "median", "most", "share")) == (len(own), len(seen), at(seen, 0), at(seen, len(seen) // 2), at(seen, -1), len(seen) / len(own))
        assert tuple(got_spread[s][c] for c in ("quotes", "share", "median", "p95")) == (len(own), len(over) / len(own), at(over, len(over) // 2), at(over, int(len(over) * 0.95)))


def test_position_sizes_all_drops_no_position(spark):
    from barlab.plans import account

    d = "/root/testdata/sf0.001"
    tickets = [r["o_orderkey"] for r in spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'O'").collect()]
    sizes = account.position_sizes_all(spark, d).collect()
    assert sorted(r["ticket"] for r in sizes) == sorted(tickets) and any(r["refusal"] == "SYMBOL_TERMS_MISSING" for r in sizes)
    assert all((r["lots"] is None) == (r["refusal"] is not None) for r in sizes)


def test_offset_scan_minutes_asks_for_every_minute(spark):
    from barlab.plans import bars

    assert sorted(r["shift"] for r in bars.offset_scan_minutes(spark, "/root/testdata/sf0.001").collect()) == [*range(-7200, 7201, 60)]


def test_decision_log_records_are_whole(spark, tmp_path):
    import json
    import uuid

    from barlab.operators import outcomes as ou

    cost = ", ".join(f"{c} double" for c in ou.COMPONENTS)
    schema = f"symbol string, bar_seq long, arm string, sign int, reason string, exit_seq long, entry_mid double, exit_mid double, lots double, r double, {cost}"
    runs = spark.createDataFrame([("s", 7, "signal", 1, "stop", 9, 1.0, 2.0, 0.1, -1.0, *[0.5] * len(ou.COMPONENTS)), ("s", 8, "signal", 0, None, None, None, None, None, 0.0, *[None] * len(ou.COMPONENTS))], schema)
    features = spark.createDataFrame([("s", 7, 86400, 0.25, 1.5, 0.1, None, 0.3), ("s", 8, 90000, None, None, None, None, None)], "symbol string, bar_seq long, utc long, p double, f double, h1 double, h4 double, h24 double")
    log = ou.decision_log(runs, features, "r", "m", "abc")
    ou.write_decision_log(log, str(tmp_path / "log"))
    got = {json.loads(x)["bar_seq"]: json.loads(x) for f in tmp_path.glob("log/*/*.json") for x in f.read_text().splitlines()}
    assert got[7]["decision_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "r/m/signal/s/7"))
    assert got[7]["features"] == {"f": {"value": 1.5, "version": 1, "computed_at": "1970-01-02T00:00:00+00:00"}} and got[7]["outcome"] == {"h1": 0.1, "h4": None, "h24": 0.3}
    assert (got[7]["final_decision"], got[7]["confidence_adjusted"], got[7]["execution"]["reason"], got[7]["evidence_graph"]) == ("long", 0.25, "stop", {"nodes": [], "edges": []})
    assert (got[8]["final_decision"], got[8]["execution"], got[8]["costs_applied"], got[8]["devils_advocate"]) == ("flat", None, None, None)


def test_breakeven_cell(spark):
    from barlab.operators import outcomes as ou

    line = lambda f: spark.createDataFrame([(float(x), f(x)) for x in range(0, 50, 10)], "floor double, difference double")
    r = ou.breakeven(line(lambda x: 25.0 - x)).first()
    assert (r["outcome"], r["floor"], r["low"], r["high"]) == ("found", 25.0, 20.0, 30.0)
    assert ou.breakeven(line(lambda x: -1.0)).first()["outcome"].startswith("none")
    assert ou.breakeven(line(lambda x: 1.0)).first()["outcome"] == "above the bracket"


def test_series_too_short_for_folds_are_named(spark):
    bars = spark.createDataFrame([("a", i) for i in range(4)] + [("b", i) for i in range(100)], "symbol string, bar_seq long")
    assert [(r["symbol"], r["refusal"]) for r in fo.refused_series(bars).collect()] == [("a", "SERIES_TOO_SHORT")]
    assert {r["symbol"] for r in fo.fold_geometry(bars).collect()} == {"b"}
