"""Causal rolling features, each declared with what it looks back on, and forward labels."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barlab.operators.bars import series, with_halo, without_halo


@dataclass(frozen=True)
class FeatureSpec:
    """A feature: rows it looks back on, rows until it is confirmed, and its Column over the series' window."""

    name: str
    lookback: int
    expr: Callable[[WindowSpec], Column]
    lag: int = 0
    version: int = 1


def _positive(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} must be positive")))


def _not_negative(c: str) -> Column:
    return F.when(F.col(c) < 0, F.raise_error(F.lit(f"{c} must not be negative"))).otherwise(F.col(c))


def _filled(value: Column, w: WindowSpec, n: int, over: Column) -> Column:
    """value where its frame has n rows with a value."""
    return F.when(F.count(over).over(w.rowsBetween(-(n - 1), 0)) == n, value)


def log_return(n: int) -> FeatureSpec:
    return FeatureSpec(f"log_return_{n}", n + 1, lambda w: F.ln(_positive("close") / F.lag("close", n).over(w)))


def reversal(n: int) -> FeatureSpec:
    return FeatureSpec(f"reversal_{n}", n + 1, lambda w: -F.ln(_positive("close") / F.lag("close", n).over(w)))


def realized_vol(n: int) -> FeatureSpec:
    """Population deviation of n one-bar log returns; needs the column step (see with_features)."""
    return FeatureSpec(f"realized_vol_{n}", n + 1, lambda w: _filled(F.stddev_pop("step").over(w.rowsBetween(-(n - 1), 0)), w, n, F.col("step")))


def vol_scaled_return(n: int, vol: int) -> FeatureSpec:
    def expr(w: WindowSpec) -> Column:
        v = realized_vol(vol).expr(w)
        return F.when(v > 0, log_return(n).expr(w) / v)

    return FeatureSpec(f"vol_scaled_return_{n}_{vol}", max(n, vol) + 1, expr)


def range_position(n: int) -> FeatureSpec:
    def expr(w: WindowSpec) -> Column:
        f = w.rowsBetween(-(n - 1), 0)
        low, high = F.min("low").over(f), F.max("high").over(f)
        return _filled(F.when(high > low, (F.col("close") - low) / (high - low)), w, n, F.col("close"))

    return FeatureSpec(f"range_position_{n}", n, expr)


def drawdown_from_max(n: int) -> FeatureSpec:
    def expr(w: WindowSpec) -> Column:
        top = F.max("close").over(w.rowsBetween(-(n - 1), 0))
        return _filled((top - F.col("close")) / top, w, n, F.col("close"))

    return FeatureSpec(f"drawdown_from_max_{n}", n, expr)


def volume_weighted_return(n: int) -> FeatureSpec:
    def expr(w: WindowSpec) -> Column:
        total = F.sum(_not_negative("tick_volume")).over(w.rowsBetween(-(n - 1), 0))
        return F.when(total > 0, log_return(n).expr(w) / total)

    return FeatureSpec(f"volume_weighted_return_{n}", n + 1, expr)


def atr_distance(n: int) -> FeatureSpec:
    """(close - mean close of n) / atr; needs the column atr (see wilder_atr)."""

    def expr(w: WindowSpec) -> Column:
        mean = F.avg("close").over(w.rowsBetween(-(n - 1), 0))
        return _filled(F.when(F.col("atr") > 0, (F.col("close") - mean) / F.col("atr")), w, n, F.col("close"))

    return FeatureSpec(f"atr_distance_{n}", n, expr)


def with_features(bars: DataFrame, specs: Iterable[FeatureSpec], size: int = 4096) -> DataFrame:
    """bars with a column for each feature; all share one exchange and sort by (symbol, chunk)."""
    specs = [*specs]
    w = series()
    halo = with_halo(bars, back=max(s.lookback + s.lag for s in specs) + 1, size=size).withColumn("step", F.ln(_positive("close") / F.lag("close", 1).over(w)))
    return without_halo(halo.withColumns({s.name: s.expr(w) for s in specs}).drop("step"))


def rolling_median(bars: DataFrame, column: str, n: int, out: str, size: int = 4096) -> DataFrame:
    """bars with the exact median of the last n values, null if any is null; long frames run in grouped maps by chunk."""
    halo = with_halo(bars, back=n - 1, size=size)
    if n <= 100:
        f = series().rowsBetween(-(n - 1), 0)
        return without_halo(halo.withColumn(out, F.when(F.count(column).over(f) == n, F.percentile(column, 0.5).over(f))))

    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("bar_seq")
        chunk[out] = chunk[column].rolling(n, min_periods=n).median()
        return chunk[~chunk["halo"]]

    schema = halo.withColumn(out, F.lit(None).cast("double")).schema
    return halo.groupBy("symbol", "chunk").applyInPandas(run, schema).drop("chunk", "halo")


def _true_range() -> Column:
    before = F.lag("close").over(series())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def _recursion(period: int, by: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """local: the recursion over a chunk's ranges in order, from zero."""
    keep = (period - 1) / period

    def local(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("at")
        y, out = 0.0, []
        for x in chunk["tr"].to_numpy():
            y = keep * y + x / period
            out.append(y)
        return chunk.assign(local=out)[[*by, "bar_seq", "at", "chunk", "local"]]

    return local


def _wilder(bars: DataFrame, period: int, size: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(bars with tr, the chunks' local values, the value carried into each chunk, the seeds)."""
    keep = (period - 1) / period
    ranged = without_halo(with_halo(bars, back=1, size=size).withColumn("tr", _true_range()))
    opening = ranged.where(F.col("bar_seq").between(1, period)).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("bar_seq", "tr"))).alias("t"))
    # added up in the order of the bars, so that the same bars give the same bits
    seeds = opening.where(F.size(F.filter("t", lambda x: x["tr"].isNotNull())) == period).select("symbol", (F.aggregate("t", F.lit(0.0), lambda s, x: s + x["tr"]) / period).alias("seed"))
    later = ranged.where(F.col("bar_seq") > period).withColumn("at", F.col("bar_seq") - period - 1).withColumn("chunk", F.floor(F.col("at") / size))
    parts = later.select("symbol", "bar_seq", "at", "chunk", "tr").groupBy("symbol", "chunk").applyInPandas(_recursion(period, ["symbol"]),
        "symbol string, bar_seq long, at long, chunk long, local double")
    ends = parts.groupBy("symbol", "chunk").agg(F.max_by("local", "at").alias("tail"), F.count("*").alias("n")).join(seeds, "symbol")

    def carried(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        carry, out = rows["seed"].iloc[0], []
        for tail, n in zip(rows["tail"], rows["n"], strict=True):
            out.append(carry)
            carry = tail + keep**n * carry
        return rows.assign(carry=out)[["symbol", "chunk", "carry"]]

    return ranged, parts, ends.groupBy("symbol").applyInPandas(carried, "symbol string, chunk long, carry double"), seeds


def _with_carry(period: int, size: int) -> Column:
    return F.col("local") + F.pow(F.lit((period - 1) / period), F.col("at") % size + 1) * F.col("carry")


def wilder_atr(bars: DataFrame, period: int = 14, size: int = 4096) -> DataFrame:
    """bars with atr: mean of the first period true ranges at row period, then (atr * (period - 1) + range) / period.

    The recursion is affine, so it runs as a block scan: each chunk from zero, the chunks' ends one row
    each in order, and last the carried value times its power, as a Column."""
    ranged, parts, carries, seeds = _wilder(bars, period, size)
    done = parts.join(carries, ["symbol", "chunk"]).select("symbol", "bar_seq", _with_carry(period, size).alias("atr"))
    first = seeds.select("symbol", F.lit(period).cast("long").alias("bar_seq"), F.col("seed").alias("atr"))
    return ranged.join(done.unionByName(first), ["symbol", "bar_seq"], "left").drop("tr")


def direction_label(bars: DataFrame, horizon: int = 24, out: str = "label") -> DataFrame:
    """1 if the close in horizon bars is higher, ties 0, null at the end; null too where label_valid is there and false."""
    ahead = with_halo(bars, ahead=horizon).withColumn("later", F.lead("close", horizon).over(series()))
    label = F.when(F.col("later").isNotNull(), (F.col("later") > F.col("close")).cast("double"))
    if "label_valid" in bars.columns:
        label = F.when(F.col("label_valid"), label)
    return without_halo(ahead.withColumn(out, label).withColumn("tie", F.col("later") == F.col("close")).drop("later"))


def volatility_label(bars: DataFrame, horizon: int = 24, vol: int = 24, threshold: int = 100, out: str = "vol_label") -> DataFrame:
    """1 if realised volatility in horizon bars is above the median of the last threshold values, ties 0."""
    name = f"realized_vol_{vol}"
    ranked = rolling_median(with_features(bars, [realized_vol(vol)]), name, threshold, "threshold")
    ahead = with_halo(ranked, ahead=horizon).withColumn("later", F.lead(name, horizon).over(series()))
    label = F.when(F.col("later").isNotNull() & F.col("threshold").isNotNull(), (F.col("later") > F.col("threshold")).cast("double"))
    if "label_valid" in bars.columns:
        label = F.when(F.col("label_valid"), label)
    return without_halo(ahead.withColumn(out, label).drop("later"))


def label_summary(rows: DataFrame, label: str = "label") -> DataFrame:
    """Per symbol: rows, defined, positive, ties, and rates over the defined, null when there are none."""
    defined = F.col(label).isNotNull()
    return rows.groupBy("symbol").agg(F.count("*").alias("total"), F.count(label).alias("defined"), F.count_if(F.col(label) == 1).alias("positive"),
        F.count_if(defined & F.col("tie")).alias("ties")).withColumns({"base_rate": F.try_divide("positive", "defined"), "tie_rate": F.try_divide("ties", "defined")})


def polynomial_terms(n: int, degree: int, diagonal_only: bool = False) -> list[tuple[int, ...]]:
    """Index tuples of the monomials of degree 1 to degree, in the order of combinations with replacement."""
    from itertools import combinations_with_replacement

    every = [t for d in range(1, degree + 1) for t in combinations_with_replacement(range(n), d)]
    return [t for t in every if not diagonal_only or len(set(t)) == 1]


def polynomial_expand(df: DataFrame, columns: list[str], degree: int, diagonal_only: bool = False) -> DataFrame:
    """df with a product column for each term of degree two and more, named by its factors joined by *."""
    out = {}
    for term in polynomial_terms(len(columns), degree, diagonal_only):
        if len(term) > 1:
            product = F.col(columns[term[0]])
            for i in term[1:]:
                product = product * F.col(columns[i])
            out["*".join(columns[i] for i in term)] = product
    return df.withColumns(out)


def _cuts(bars: DataFrame, cuts: int) -> DataFrame:
    """(symbol, cut): so many evenly spaced rows of each symbol, all of a shorter one."""
    size = bars.groupBy("symbol").agg(F.max("bar_seq").alias("last"))
    return size.select("symbol", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cuts - 1).cast("long"))).alias("k"), "last").select("symbol",
        F.floor(F.col("k") * F.col("last") / cuts).cast("long").alias("cut")).distinct()


def _same_bits(a: str, b: str) -> Column:
    """Whether two doubles are the same to the bit, null and NaN like themselves: each double has a text of its own, and so has -0.0."""
    return F.col(a).cast("string").eqNullSafe(F.col(b).cast("string"))


def causality_audit(bars: DataFrame, specs: list[FeatureSpec], cuts: int = 200) -> DataFrame:
    """(symbol, cut, feature, same): each feature at a cut, computed from the history up to the cut plus its lag
    alone, against its value on the whole series, to the bit. At least so many cuts a symbol, evenly spaced."""
    full = with_features(bars, specs)
    deep, lag = max(s.lookback + s.lag for s in specs) + 1, max(s.lag for s in specs)
    needed = _cuts(bars, cuts).select("symbol", "cut", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("cut") - deep), F.col("cut") + lag)).alias("bar_seq"))
    history = bars.join(needed, ["symbol", "bar_seq"]).withColumn("chunk", F.col("cut")).withColumn("step", F.ln(F.col("close") / F.lag("close").over(series())))
    again = history.withColumns({f"{s.name}_cut": s.expr(series()) for s in specs}).where("bar_seq = cut").select("symbol", "bar_seq", *[f"{s.name}_cut" for s in specs])
    both = again.join(full, ["symbol", "bar_seq"])
    return both.select("symbol", F.col("bar_seq").alias("cut"),
        F.explode(F.array(*[F.struct(F.lit(s.name).alias("feature"), _same_bits(s.name, f"{s.name}_cut").alias("same")) for s in specs]))
            .alias("x")).select("symbol", "cut", "x.*")


def recursion_audit(bars: DataFrame, period: int = 14, size: int = 4096, cuts: int = 200) -> DataFrame:
    """causality_audit of wilder_atr: (symbol, cut, feature, same).

    The history of a cut ends there. It is replayed from the value carried into the cut's chunk, which only earlier
    chunks make, through the ranges of the chunk's bars up to the cut, in one fixed order; up to the first period bars it is the seed or null."""
    full = wilder_atr(bars, period, size).select("symbol", "bar_seq", "atr")
    _, _, carries, seeds = _wilder(bars, period, size)
    at = F.col("cut") - period - 1
    asked = _cuts(bars, cuts).withColumn("first", F.floor(at / size) * size + period + 1)
    needed = asked.where(at >= 0).select("symbol", "cut", "first", F.explode(F.sequence(F.col("first") - 1, F.col("cut"))).alias("bar_seq"))
    history = bars.join(needed, ["symbol", "bar_seq"]).withColumn("chunk", F.col("cut")).withColumn("tr", _true_range()).where("bar_seq >= first")
    rows = history.select("symbol", "cut", "bar_seq", (F.col("bar_seq") - period - 1).alias("at"), "tr").withColumn("chunk", F.floor(F.col("at") / size))
    local = rows.groupBy("symbol", "cut").applyInPandas(_recursion(period, ["symbol", "cut"]), "symbol string, cut long, bar_seq long, at long, chunk long, local double").where("bar_seq = cut")
    replayed = local.join(carries, ["symbol", "chunk"]).select("symbol", "cut", _with_carry(period, size).alias("again"))
    opening = asked.where(at < 0).join(seeds, "symbol", "left").select("symbol", "cut", F.when(F.col("cut") == period, F.col("seed")).alias("again"))
    both = asked.select("symbol", "cut").join(replayed.unionByName(opening), ["symbol", "cut"], "left").join(full.withColumnRenamed("bar_seq", "cut"), ["symbol", "cut"])
    return both.select("symbol", "cut", F.lit(f"wilder_atr_{period}").alias("feature"), _same_bits("atr", "again").alias("same"))
