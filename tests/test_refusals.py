"""What is refused, with its code, and what is counted over."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barlab.functions import costs
from barlab.operators import features as fe
from barlab.operators import outcomes as ou

RISK = ou.Risk(stop=1.0, target=1.0, hold=2)
FREE = {"base": costs.CostModel(floor=0.0, slippage=0.0, commission=0.0, swap_long=0.0, swap_short=0.0, latency_seconds=0.0)}


def points(spark, n, without=()):
    """A series that rises by ten points a bar."""
    rows = [("s", i, i * 3600, 1.0, 10.0 * i, 10.0 * i, 10.0 * i) for i in range(n) if i not in without]
    return spark.createDataFrame(rows, "symbol string, bar_seq long, utc long, multiplier double, open double, high double, low double")


def runs(spark, decisions, bars):
    asked = spark.createDataFrame([("s", i, a) for i, a in decisions], "symbol string, bar_seq long, atr double")
    out = ou.barrier_outcomes(asked, bars, costs.variants(spark, FREE), RISK)
    arms = ou.long_arm(asked).unionByName(asked.withColumn("arm", F.lit("signal")).withColumn("sign", F.when(F.col("bar_seq") == 1, 0).otherwise(-1)))
    return ou.run_arms(arms, out, ["base"], ou.refused_decisions(asked, bars, RISK))


def test_refused_decisions_have_codes_and_no_part_in_means(spark):
    bars = points(spark, 12, without=(6,))
    decisions = [(0, 5.0), (1, 5.0), (2, None), (3, 0.0), (4, 5.0), (7, 5.0), (8, 5.0), (9, 5.0), (20, 5.0)]
    got = {(r["arm"], r["bar_seq"]): r for r in runs(spark, decisions, bars).collect()}
    codes = {0: None, 1: None, 2: "NO_RANGE", 3: "NO_RANGE", 4: "BARS_MISSING", 7: None, 8: None, 9: "WINDOW_PAST_SERIES", 20: "WINDOW_PAST_SERIES"}
    for arm in ("always_long", "signal"):
        assert {i: got[arm, i]["refusal"] for i in codes} == codes
        assert all((got[arm, i]["r"] is None) == (c is not None) for i, c in codes.items())
    # a flat decision that could be run has r 0
    assert got["signal", 1]["r"] == 0.0 and got["signal", 1]["reason"] is None
    summary = {r["arm"]: r for r in ou.arm_summary(runs(spark, decisions, bars)).collect()}
    long, signal = summary["always_long"], summary["signal"]
    assert (long["decisions"], long["refused"], long["longs"], long["stop"] + long["target"] + long["time"]) == (9, 5, 4, 4)
    assert (signal["decisions"], signal["refused"], signal["shorts"], signal["flats"]) == (9, 5, 3, 1)
    for arm in summary:
        assert summary[arm]["mean_r"] == pytest.approx(sum(got[arm, i]["r"] for i in (0, 1, 7, 8)) / 4)
    diff = {r["bar_seq"]: r["difference"] for r in ou.paired_difference(runs(spark, decisions, bars)).collect()}
    assert {i for i, d in diff.items() if d is None} == {i for i, c in codes.items() if c}


def test_one_refused_of_two(spark):
    r = next(r for r in ou.arm_summary(runs(spark, [(0, 5.0), (1, None)], points(spark, 12))).collect() if r["arm"] == "always_long")
    assert (r["decisions"], r["refused"], r["mean_r"]) == (2, 1, 1.0)


def test_unequal_arms_are_an_error(spark):
    even = runs(spark, [(0, 5.0), (4, 5.0)], points(spark, 12))
    assert ou.paired_difference(even).count() == 2
    lacks, twice = even.where("not (arm = 'signal' and bar_seq = 4)"), even.unionByName(even.where("arm = 'signal' and bar_seq = 4"))
    for odd in (lacks, twice, even.withColumn("r", F.when((F.col("arm") == "signal") & (F.col("bar_seq") == 4), None).otherwise(F.col("r")))):
        with pytest.raises(PySparkException, match="ARMS_UNEQUAL"):
            ou.paired_difference(odd).collect()


def test_negative_volume_is_an_error(spark):
    rows = [("s", i, float(i + 1), v) for i, v in enumerate((5, None, 0, 7, 3))]
    bars = spark.createDataFrame(rows, "symbol string, bar_seq long, close double, tick_volume long")
    assert fe.with_features(bars, [fe.volume_weighted_return(2)]).count() == 5
    bad = bars.withColumn("tick_volume", F.when(F.col("bar_seq") == 3, -1).otherwise(F.col("tick_volume")))
    with pytest.raises(PySparkException, match="must not be negative"):
        fe.with_features(bad, [fe.volume_weighted_return(2)]).collect()
