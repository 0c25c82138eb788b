"""What a feed's history supports, by hand-computed cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from barlab.operators import feed as fd
from barlab.sources import snapshot

DAY = 86_400
ANCHOR = "symbol string, anchor string, time long, bucket string, hour int"


def events(name, winter, summer, mismatch, n=10, symbol="s", noise=0):
    rows = []
    for bucket, hour in ((fd.WINTER, winter), (fd.SUMMER, summer), (fd.MISMATCH, mismatch)):
        rows += [(symbol, name, i, bucket, hour) for i in range(n if hour is not None else 0)]
    return rows + [(symbol, name, 100 + i, fd.WINTER, winter + 1) for i in range(noise)]


def test_anchor_rules_and_their_combination(spark):
    rows = events("open", 23, 23, 22) + events("close", 23, 23, 22) + events("break", 0, 0, 0, noise=9)
    rows += events("open", 23, 23, 23, symbol="us") + events("break", 1, 1, 1, n=7, symbol="us") + events("close", 23, 23, 23, n=500, symbol="us")
    rows += events("open", 23, 22, 22, symbol="fixed") + events("close", 23, None, 22, symbol="fixed")
    rows += events("open", 23, 23, 22, symbol="split") + events("close", 23, 23, 23, n=900, symbol="split")
    rows += events("open", 5, None, 5, symbol="none")
    anchors = spark.createDataFrame(rows, ANCHOR)
    prints = fd.anchor_fingerprints(anchors)
    got = {(r["symbol"], r["anchor"]): (r["rule"], r["reason"]) for r in prints.collect()}
    assert got["s", "open"] == ("EU", None) and got["s", "break"] == ("UNDETERMINED", "NOT_UNIMODAL") and got["us", "open"] == ("US", None)
    assert got["us", "break"] == ("UNDETERMINED", "FEW_MISMATCHES") and got["fixed", "open"] == ("FIXED", None) and got["fixed", "close"] == ("UNDETERMINED", "EMPTY_SEASON")
    both = {r["symbol"]: (r["rule"], r["reason"], r["agreed"]) for r in fd.combined_fingerprint(prints).collect()}
    assert both == {"s": ("EU", None, "close,open"), "us": ("US", None, "close,open"), "fixed": ("FIXED", None, "open"),
        "split": ("UNDETERMINED", "ANCHORS_DISAGREE", ""), "none": ("UNDETERMINED", "NO_USABLE_ANCHOR", "")}
    odd = anchors.unionByName(spark.createDataFrame([("s", "open", 7, fd.WINTER, 22), ("s", "open", 8, fd.SUMMER, 3)], ANCHOR))
    left = {(r["symbol"], r["anchor"]): (r["n"], r["off"], r["early"], r["late"]) for r in fd.anchor_residuals(odd).collect()}
    assert left["s", "open"] == (32, 2, 2, 0) and left["s", "break"] == (39, 9, 0, 9)


def test_anchors_of_gaps_keep_to_dense_years(spark):
    at = lambda s: int(datetime.datetime.fromisoformat(s + "+00:00").timestamp())
    gaps = [("s", at("2019-07-05 23:00"), at("2019-07-08 01:00"), 49), ("s", at("2019-07-09 22:00"), at("2019-07-10 00:00"), 1), ("s", at("2018-07-06 23:00"), at("2018-07-09 01:00"), 49), ("s", at("2019-07-10 01:00"), at("2019-07-10 05:00"), 3)]
    table = spark.createDataFrame(gaps, "symbol string, before long, after long, missing long")
    got = fd.boundary_anchors(table, spark.createDataFrame([("s", 2019)], "symbol string, year int")).collect()
    assert sorted((r["anchor"], r["hour"], r["bucket"]) for r in got) == [("daily_break", 23, fd.SUMMER), ("weekly_close", 23, fd.SUMMER), ("weekly_open", 1, fd.SUMMER)]
    hours = {(r["side"], r["clock"]): (r["hour"], r["n"]) for r in fd.boundary_hours(table.where("before > 1550000000")).collect()}
    assert hours == {("close", "server"): (23, 1), ("close", "utc"): (20, 1), ("close", "new_york"): (16, 1), ("open", "server"): (1, 1), ("open", "utc"): (22, 1), ("open", "new_york"): (18, 1)}
    breaks = fd.one_bar_gap_hours(table).collect()
    assert [(r["hour"], r["n"], r["share"], r["is_break"]) for r in breaks] == [(22, 1, 1.0, True)]


def test_weeks_days_and_holidays(spark):
    # 1970-01-05 was a Monday: weeks of 5, 5, 4 and 1 bars, upper median 5
    bars = [("s", (4 + 7 * w + i) * DAY + h * 3600) for w, n in enumerate((5, 5, 4, 1)) for i in range(n) for h in range(1)]
    table = spark.createDataFrame(bars, "symbol string, time long")
    assert [tuple(r) for r in fd.full_weeks(table).select("symbol", "weeks", "median", "full").collect()] == [("s", 4, 5, 2)]
    dense = spark.createDataFrame([("s", d * DAY + h * 3600) for d, n in ((3, 24), (4, 20), (6, 19)) for h in range(n)] + [("t", 5)], "symbol string, time long")
    got = {r["symbol"]: tuple(r)[1:] for r in fd.dense_history(dense).select("symbol", "bars", "dense_bars", "dense_days", "decisions", "dense_decisions", "first_dense", "last_dense").collect()}
    assert got == {"s": (63, 44, 2, 2, 1, 3, 4), "t": (1, 0, 0, 0, 0, None, None)}
    d = datetime.date
    days = spark.createDataFrame([("s", d(2020, 12, 25)), ("s", d(2020, 12, 26)), ("s", d(2020, 6, 2))], "symbol string, day date")
    near = spark.createDataFrame([(d(2020, 12, 25), "Christmas"), (d(2020, 12, 26), "Christmas")], "day date, holiday string")
    assert {r["holiday"]: (r["n"], r["first"], r["last"]) for r in fd.holiday_counts(days, near).collect()} == {"Christmas": (2, d(2020, 12, 25), d(2020, 12, 26)), None: (1, d(2020, 6, 2), d(2020, 6, 2))}
    assert [r["day"] for r in fd.unexplained_days(days, near).collect()] == [d(2020, 6, 2)]
    eras = spark.createDataFrame([(d(2020, 12, 26), None), (d(2020, 12, 1), d(2020, 12, 26))], "start date, end date")
    timed = days.select("symbol", (F.unix_date("day").cast("long") * DAY).alias("time"))
    assert {r["era"]: (r["days"], r["bars"]) for r in fd.days_by_era(timed, eras).collect()} == {None: (1, 1), d(2020, 12, 1): (1, 1), d(2020, 12, 26): (1, 1)}
    profile = spark.createDataFrame([("s", 5, 0.5), ("s", 6, 0.51), ("s", 7, 0.9), ("t", 1, 0.1)], "symbol string, day long, share double")
    assert {r["symbol"]: r["day"] for r in fd.oldest_usable(profile).collect()} == {"s": 6, "t": None}


def test_full_hours(spark):
    minutes = [("s", t * 60, float(t), t + 1.0, t - 1.0, t + 0.5) for t in range(1, 190) if t != 130]
    table = spark.createDataFrame(minutes, "symbol string, time long, open double, high double, low double, close double")
    left = spark.createDataFrame([("s", h * 3600, h * 60.0, h * 60 + 60.0, h * 60 - 1.0, h * 60 + 59.5) for h in range(4)], table.schema)
    got = {r["reading"]: (r["full_tested"], r["full_matches"]) for r in fd.full_hours(left, table).collect()}
    # 60..119 is the one whole left hour; 1..60 and 61..120 are whole right hours
    assert got == {"left": (1, 1), "right": (2, 0)}


def test_snapshot_gates_and_census(spark, tmp_path):
    bars = spark.createDataFrame([("a", 3600 * i, i > 5, i != 7, True) for i in range(10)], "symbol string, time long, in_window boolean, valid boolean, label_valid boolean")
    ok = spark.createDataFrame([("a", n, "pass") for n in snapshot.INVARIANTS], "symbol string, name string, outcome string")
    gaps = spark.createDataFrame([("a", "weekend"), ("a", "weekend"), ("a", "unknown"), ("b", "holiday")], "symbol string, cause string")
    snapshot.write_snapshot(bars, ok, f"{tmp_path}/s", "h", gaps, 12)
    row = spark.read.parquet(f"{tmp_path}/s/manifest").first()
    assert row["gap_census"] == {"weekend": 2, "unknown": 1} and row["label_horizon_bars"] == 12
    assert snapshot.load_window(spark, f"{tmp_path}/s", "h").count() == 3 and snapshot.load_window(spark, f"{tmp_path}/s", "h", False).count() == 4
    snapshot.write_snapshot(bars.withColumn("valid", F.lit(False)), ok, f"{tmp_path}/t", "h")
    assert snapshot.load_window(spark, f"{tmp_path}/t", "h", False).count() == 4
    with pytest.raises(ValueError, match="no bars in the window that are valid"):
        snapshot.load_window(spark, f"{tmp_path}/t", "h")
