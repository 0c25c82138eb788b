"""Queries that fit models on folds, permute labels and bootstrap; none has SQL, the tests compare them with single-machine versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.operators import evaluate as ev
from barlab.operators import features as fe
from barlab.operators import folds as fo
from barlab.plans.bars import checked_bars
from barlab.plans.evaluation import _forecasts
from barlab.sources.shared import written

BASE = [fe.log_return(5), fe.range_position(24), fe.drawdown_from_max(48)]
ADDED = [fe.reversal(3), fe.log_return(24), fe.realized_vol(24), fe.vol_scaled_return(5, 24), fe.volume_weighted_return(24), fe.atr_distance(24), fe.range_position(72)]
FEATURES = [f.name for f in BASE]
SEEDS = 30
HORIZONS = (4, 24, 120)
BLOCKS = (1, 10, 25)
#: Name, degree, squares and higher powers of one feature only; with three features 4 to 56 parameters.
RUNGS = (("C-0", 1, False), ("C-1", 2, True), ("C-2", 2, False), ("C-3", 3, False), ("C-4", 4, False), ("C-5", 5, False))


def _rows(spark, d, specs=tuple(BASE), horizon=5):
    """Fold members with label and features."""
    names = [f.name for f in specs]
    b = fe.with_features(fe.wilder_atr(fe.direction_label(checked_bars(spark, d), horizon), 14), specs)
    ok = F.col("label").isNotNull()
    for c in names:
        ok = ok & F.col(c).isNotNull()
    b = b.withColumn("valid", F.col("valid") & ok).withColumnRenamed("label", "y")
    members = fo.walk_forward(b, fo.fold_geometry(b), horizon).where("role in ('train', 'test')")
    return members.join(b.select("symbol", "bar_seq", "y", *names), ["symbol", "bar_seq"])


def _permuted_rows(spark, d):
    rows = written(_rows(spark, d), "fold-rows")
    labels = ev.permuted_labels(rows.select("symbol", "bar_seq", "y").distinct(), SEEDS)
    return rows.drop("y").join(labels, ["symbol", "bar_seq"])


def walk_forward_fit(spark, d):
    return ev.fit_predict(_rows(spark, d).withColumn("seed", F.lit(0)), {"all": FEATURES}).select("symbol", "fold", "bar_seq", F.round("p", 6).alias("p"), "y")


def leaky_fits(spark, d):
    """Pooled skill of each deliberate leak beside the clean fit."""
    rows = _rows(spark, d).withColumn("ys", F.array("y"))
    return ev.pooled_skill(ev.null_fits(rows, {"all": FEATURES}, ev.LEAKS), ["symbol", "leak"]).select("symbol", "leak", "n", "skill")


def converged_fits(spark, d):
    """Fits that go on until the gradient's largest part is 1e-6 or less, or for a million steps."""
    f = ev.fit_predict(_rows(spark, d).withColumn("seed", F.lit(0)), {"all": FEATURES}, model=lambda: ev.Logistic(1_000_000, tolerance=1e-6))
    return f.groupBy("symbol").agg(F.max("iterations").alias("iterations"), F.max("norm").alias("norm"), F.bool_and("converged").alias("converged"),
        F.bool_or("hit_cap").alias("hit_cap"))


def block_fits(spark, d):
    """The converged fits by steps of second derivatives over blocks of rows: forecasts that hold no fold in a task."""
    f = ev.fit_predict_blocks(_rows(spark, d), FEATURES, steps=100, tolerance=1e-9, newton=True)
    return f.select("symbol", "fold", "bar_seq", F.round("p", 6).alias("p"), "y", "iterations", "converged")


def permutation_null(spark, d):
    """30 permutations of the labels, clean."""
    return ev.null_study(ev.pooled_skill(ev.null_fits(_permuted_rows(spark, d), {"all": FEATURES}), ["symbol", "seed"]), ["symbol"])


def ablation(spark, d):
    """Gain of each arm over the base features at three horizons: base and one other, and all ten; intervals for three block lengths."""
    names = FEATURES + [f.name for f in ADDED]
    arms = {"base": FEATURES, "all": names} | {f"base+{c}": [*FEATURES, c] for c in names[3:]}
    gains = None
    for h in HORIZONS:
        f = ev.fit_predict(_rows(spark, d, (*BASE, *ADDED), h).withColumn("seed", F.lit(0)), arms).select("symbol", "fold", "bar_seq", "arm",
            F.pow(F.col("p") - F.col("y"), F.lit(2)).alias("loss"))
        # each arm's losses beside the base's, from one pass over the fits
        packed = f.groupBy("symbol", "fold", "bar_seq").agg(F.max(F.when(F.col("arm") == "base", F.col("loss"))).alias("base"),
            F.collect_list(F.struct("arm", "loss")).alias("arms"))
        own = packed.select(F.lit(h).alias("horizon"), "symbol", "fold", "bar_seq", "base",
            F.inline("arms")).where("arm <> 'base'").withColumn("gain", F.col("base") - F.col("loss"))
        gains = own if gains is None else gains.unionByName(own)
    return _intervals(gains, ["horizon", "symbol", "arm"])


def _intervals(gains, by):
    """Bootstrap intervals of the mean gain for each block length; the gains are worked out once."""
    gains, out = written(gains.select(*by, "bar_seq", "gain"), "gains"), None
    for b in BLOCKS:
        one = ev.bootstrap_mean(gains, by, "gain", block=b).withColumn("block", F.lit(b))
        out = one if out is None else out.unionByName(one)
    return out


def capacity_ladder(spark, d):
    """Null studies of six polynomial rungs, each clean and with every leak, by 30 permutations of the labels."""
    rungs = {}
    for name, degree, alone in RUNGS:
        rungs[name] = ["*".join(FEATURES[i] for i in t) for t in fe.polynomial_terms(3, degree, alone)]
    rows = fe.polynomial_expand(_permuted_rows(spark, d), FEATURES, RUNGS[-1][1])
    f = ev.null_fits(rows, rungs, ev.LEAKS, parts={name: n for n, (name, *_) in enumerate(RUNGS)})
    return ev.null_study(ev.pooled_skill(f, ["symbol", "arm", "leak", "seed"]), ["symbol", "arm", "leak"])


def response_probe(spark, d):
    """The probe of each fold's fit, and whether its coefficients give the fold's forecasts again."""
    rows = written(_rows(spark, d), "fold-rows")
    fits = written(ev.fit_predict(rows.withColumn("seed", F.lit(0)), {"all": FEATURES}), "fits")
    again = ev.reproduced(fits, fo.standardise(rows, FEATURES).where("role = 'test'"), FEATURES)
    return ev.response_probe(fits, FEATURES).join(again, ["symbol", "fold", "arm", "seed"])


def gain_interval(spark, d):
    """Percentile interval of the mean improvement of the closed-form forecasts."""
    return ev.bootstrap_mean(fo.improvement(_forecasts(spark, d), ["symbol"]), ["symbol"], "gain")


def block_interval(spark, d):
    """The same by stationary blocks of three mean lengths."""
    return _intervals(fo.improvement(_forecasts(spark, d), ["symbol"]), ["symbol"])


QUERIES = {f.__name__: f for f in (walk_forward_fit, leaky_fits, converged_fits, block_fits, permutation_null, ablation, capacity_ladder, response_probe,
    gain_interval, block_interval)}
SQL: dict[str, str] = {}
