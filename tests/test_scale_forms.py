"""Forms for large tables against plain ones: windows of minutes, ranks by value, trees of digests."""

import random

import pytest
from pyspark.sql import functions as F

from barlab.operators import folds as fo
from barlab.operators import profile as pr
from barlab.sources import snapshot

BAR = "symbol string, time long, open double, high double, low double, close double"


@pytest.mark.parametrize("step", [60, 900])
def test_offset_windows_are_brute_forces(spark, step):
    rng = random.Random(step)
    minutes = []
    for symbol, share in (("a", 0.9), ("b", 0.2), ("c", 0.02)):
        for t in range(-7200, 6 * 3600, 60):
            if rng.random() < share:
                o, c = rng.randint(1, 9), rng.randint(1, 9)
                minutes.append((symbol, t + (rng.randint(0, 59) if symbol == "b" else 0), float(o), float(max(o, c) + rng.randint(0, 2)), float(min(o, c)), float(c)))

    def window(symbol, start):
        own = sorted(m for m in minutes if m[0] == symbol and start <= m[1] < start + 3600)
        return (own[0][2], max(m[3] for m in own), min(m[4] for m in own), own[-1][5]) if own else None

    true = {"a": 1800, "b": -3600, "c": 0}
    hours = [(s, t, *(window(s, t + true[s]) or (1.0, 1.0, 1.0, 1.0))) for s in true for t in range(-3600, 5 * 3600, 3600)]
    want = {}
    for shift in range(-7200, 7201, step):
        found = [(window(h[0], h[1] + shift), h[2:]) for h in hours]
        want[shift] = (sum(w == h for w, h in found), sum(w is not None for w, _ in found))
    got = pr.scan_offsets(spark.createDataFrame(hours, BAR), spark.createDataFrame(minutes, BAR).repartition(5), step).collect()
    assert {r["shift"]: (r["matches"], r["tested"]) for r in got} == want and len(got) == 14400 // step + 1
    assert want[1800][0] >= 6 and want[-3600][0] >= 5


def test_target_means_of_one_symbol_over_many_ranges(spark):
    """A single symbol, a third of it one value, nulls, small ranges of ties: the buckets are those of a plain sort."""
    rng = random.Random(6)
    rows = [("s", i, None if i % 50 == 0 else 0.5 if i % 3 == 0 else rng.choice([rng.random(), rng.randint(0, 4) / 4]), float(rng.random() < 0.4)) for i in range(3000)]
    rows += [("t", i, 1.0, float(i % 2)) for i in range(7)]
    table = spark.createDataFrame(rows, "symbol string, bar_seq long, x double, y double").repartition(6)
    got = fo.target_means(table, "x", "y", ranges=16, tie_rows=100)
    want = {}
    for s in "st":
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[2] is not None, r[2] or 0.0, r[1]))
        for a in range(0, len(own), 4):
            part = own[a : a + 4]
            want.update({(s, r[1]): sum(x[3] for x in part) / len(part) for r in part})
    assert got.columns == ["symbol", "bar_seq", "x", "y", "leak"]
    assert {(r["symbol"], r["bar_seq"]): r["leak"] for r in got.collect()} == pytest.approx(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # no window over a symbol's rows: the only one by symbol alone sums up the ranges' counts
    assert all("_span" in line for line in plan.splitlines() if "Window" in line and "row_number" in line)


def test_digest_is_a_tree_of_the_values(spark):
    rows = [("a", i, f"v{i}", None if i % 7 else "x") for i in (*range(300), 5000, 2**40, 2**62)] + [("b", -5, "v", "")]
    table = spark.createDataFrame(rows, "g string, n long, v string, w string")
    digest = lambda df, **how: {r["g"]: (r["rows"], r["digest"]) for r in snapshot.table_digest(df, "g", "n", ["n", "v", "w"], **how).collect()}
    one = digest(table.repartition(7))
    assert one == digest(table.coalesce(1).orderBy(F.desc("n"))) and one["a"][0] == 303 and one["b"][0] == 1
    for other in (table.where("n <> 5000"), table.withColumn("v", F.when(F.col("n") == 17, "V17").otherwise(F.col("v"))), table.withColumn("w", F.coalesce("w", F.lit("")))):
        changed = digest(other)
        assert changed["a"] != one["a"] and changed["b"] == one["b"]
    assert digest(table, fan=10, levels=18)["a"][0] == 303
