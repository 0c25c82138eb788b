"""Purged walk-forward folds and what is measured on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barlab.operators.bars import numbered


def fold_geometry(bars: DataFrame, n_folds: int = 5, first_share: float = 0.5) -> DataFrame:
    """(symbol, fold, test_start, test_end): the first test window opens at first_share of the series, the rest is cut evenly."""
    size = bars.groupBy("symbol").agg((F.max("bar_seq") + 1).alias("n")).withColumn("first", F.floor(F.col("n") * first_share)
        .cast("long")).withColumn("size", F.floor((F.col("n") - F.col("first")) / n_folds).cast("long")).where("size > 0")
    folds = size.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    return folds.select("symbol", "fold", (F.col("first") + F.col("fold") * F.col("size")).alias("test_start"),
        (F.col("first") + (F.col("fold") + 1) * F.col("size")).alias("test_end"))


def refused_series(bars: DataFrame, n_folds: int = 5, first_share: float = 0.5) -> DataFrame:
    """(symbol, bars, refusal): series too short to be cut into the folds, which fold_geometry leaves out."""
    size = bars.groupBy("symbol").agg((F.max("bar_seq") + 1).alias("bars"))
    short = F.floor((F.col("bars") - F.floor(F.col("bars") * first_share)) / n_folds) <= 0
    return size.where(short).select("symbol", "bars", F.lit("SERIES_TOO_SHORT").alias("refusal"))


def embargoed(at: Column, test_end: Column, horizon: int) -> Column:
    """Whether a row lies so close after a test window that the window's labels reach it."""
    return (at >= test_end) & (at < test_end + horizon)


def walk_forward(bars: DataFrame, folds: DataFrame, horizon: int, spacing: int | None = None, embargo: bool = True, both_sides: bool = False) -> DataFrame:
    """(symbol, fold, bar_seq, role) with role train, test, purged or embargoed, of bars (symbol, bar_seq, valid).

    Test rows are spaced from the window's start first and filtered by valid second; training rows are
    the valid ones before it whose label ends before it opens. Windows expand, so only rows before the window may
    train. With both_sides rows after it train, too, but for those that the labels of the window reach, which are embargoed."""
    spacing = spacing or horizon
    joined = bars.where("valid").join(folds, "symbol")
    joined = joined if both_sides else joined.where("bar_seq < test_end")
    at, start, end = F.col("bar_seq"), F.col("test_start"), F.col("test_end")
    role = F.when((at >= start) & (at < end), F.when((at - start) % spacing == 0, "test").otherwise("between")).when((at < start) & (at + horizon >= start), "purged")
    if embargo:
        role = role.when(embargoed(at, end, horizon), "embargoed")
    return joined.select("symbol", "fold", "bar_seq", role.otherwise("train").alias("role")).where("role <> 'between'")


def fold_counts(members: DataFrame) -> DataFrame:
    c = lambda r: F.count_if(F.col("role") == r).alias(r)
    return members.groupBy("symbol", "fold").agg(c("train"), c("test"), c("purged"), c("embargoed"))


def leaks(members: DataFrame, folds: DataFrame, horizon: int) -> DataFrame:
    """Per fold: rows in both train and test, and training labels that reach the test window; both must be 0."""
    both = members.where("role = 'train'").select("symbol", "fold", "bar_seq").intersect(members.where("role = 'test'")
        .select("symbol", "fold", "bar_seq")).groupBy("symbol", "fold").agg(F.count("*").alias("overlap"))
    reach = members.where("role = 'train'").groupBy("symbol", "fold").agg(F.max(F.col("bar_seq") + horizon).alias("reach"))
    return folds.join(reach, ["symbol", "fold"], "left").join(both, ["symbol", "fold"], "left").select("symbol", "fold",
        F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"), F.coalesce(F.col("reach") >= F.col("test_start"), F.lit(False)).alias("reaches"))


def brier(forecasts: DataFrame, by: list[str]) -> DataFrame:
    """Brier score and skill against the base rate, per group and, with the last column null, pooled over it; null skill where the outcome has one value."""
    sets = forecasts.rollup(*by) if by else forecasts.groupBy()
    score = F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2)))
    ref = F.avg("y") * (1 - F.avg("y"))
    out = sets.agg(F.count("*").alias("n"), score.alias("brier"), F.avg("y").alias("base_rate"), F.when(ref > 1e-15, 1 - score / ref).alias("skill"))
    return out.where(F.col(by[0]).isNotNull()) if len(by) > 1 else out


def improvement(forecasts: DataFrame, by: list[str]) -> DataFrame:
    """forecasts with gain, (base - y)^2 - (p - y)^2, the base being the group's; the small table of bases is joined back."""
    bases = forecasts.groupBy(*by).agg(F.avg("y").alias("base"))
    return forecasts.join(bases, by).withColumn("gain", F.pow(F.col("base") - F.col("y"), F.lit(2)) - F.pow(F.col("p") - F.col("y"), F.lit(2))).drop("base")


def hit_rates(forecasts: DataFrame, by: list[str]) -> DataFrame:
    return improvement(forecasts, by).groupBy(*by).agg(F.count("*").alias("n"), F.avg("gain").alias("gain"), F.avg((F.col("p") > 0.5).cast("double"))
        .alias("long_share"), F.avg(((F.col("p") > 0.5) == (F.col("y") == 1)).cast("double")).alias("accuracy"))


def target_means(rows: DataFrame, feature: str, label: str, bucket: int = 4, ranges: int = 256, tie_rows: int = 65_536) -> DataFrame:
    """rows with leak: the mean label of each bucket of so many rows in the order of (feature, bar_seq), by symbol. A deliberate leak.

    A symbol's rows are numbered within ranges of the feature, between splitters from a quantile sketch, and offset by the ranges' counts, so
    a single symbol is many tasks. Rows that share a splitter's value are a range of their own, cut further by bar_seq. Null features come first. The
    splitters only deal out the work: the numbers don't depend on them."""
    cuts = rows.groupBy("symbol").agg(F.percentile_approx(F.col(feature).cast("double"), F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10_000).alias("_cuts"))
    dealt = rows.join(cuts, "symbol").withColumn("_v", F.col(feature).cast("double"))
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    tied = F.coalesce(F.array_contains("_cuts", F.col("_v")), F.lit(False))
    range_of = F.when(F.col("_v").isNull(), -1).otherwise(2 * below + F.when(tied, 1).otherwise(0)).cast("long")
    within = F.when(tied | F.col("_v").isNull(), F.floor(F.col("bar_seq") / tie_rows)).otherwise(0).cast("long")
    dealt = dealt.withColumn("_range", range_of * F.lit(2**40) + within).drop("_cuts")
    keyed = numbered(dealt, ["symbol"], F.col("_range"), [F.col("_v").asc_nulls_first(), "bar_seq"], "_r")
    keyed = keyed.withColumn("bucket", F.floor((F.col("_r") - 1) / bucket)).drop("_r", "_v", "_range")
    return keyed.withColumn("leak", F.avg(label).over(Window.partitionBy("symbol", "bucket"))).drop("bucket")


def standardise(members: DataFrame, columns: list[str]) -> DataFrame:
    """members with each column less its training mean over its training population deviation (1 if that is 0), by symbol and fold."""
    fit = members.where("role = 'train'").groupBy("symbol", "fold").agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])
    joined = members.join(fit, ["symbol", "fold"])
    return joined.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_std") == 0, 1.0)
        .otherwise(F.col(f"{c}_std")) for c in columns}).drop(*[f"{c}_{k}" for c in columns for k in ("mean", "std")])


def funnel(rows: DataFrame, constraints: list[str]) -> DataFrame:
    """(symbol, step, rows): rows left after each further boolean column, in one pass."""
    kept, out = F.lit(True), [F.count("*").alias("all")]
    for c in constraints:
        kept = kept & F.coalesce(F.col(c), F.lit(False))
        out.append(F.count_if(kept).alias(c))
    names = ["all", *constraints]
    wide = rows.groupBy("symbol").agg(*out)
    return wide.select("symbol", F.explode(F.array(*[F.struct(F.lit(c).alias("step"), F.col(f"`{c}`").alias("rows")) for c in names])).alias("x")).select("symbol", "x.*")


def era_shares(members: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, fold, role, era, n) of train and test rows; bars has era."""
    return members.where("role in ('train', 'test')").join(bars.select("symbol", "bar_seq", "era"), ["symbol", "bar_seq"]).groupBy("symbol", "fold",
        "role", "era").agg(F.count("*").alias("n"))


def untested_eras(members: DataFrame, bars: DataFrame) -> DataFrame:
    tested = era_shares(members, bars).where("role = 'test'").select("symbol", "era")
    return bars.select("symbol", "era").distinct().join(tested, ["symbol", "era"], "left_anti")


def split_cells(bars: DataFrame, horizons: dict[int, str], splits: tuple[float, ...], n_folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """((symbol, split, first, size), (symbol, split, horizon, era, fold, train, test)): rows of each role by era, for all splits and horizons in one pass.

    bars: (symbol, bar_seq, era) and a boolean column for each horizon, horizons[h], whether the row may be used at it. No row of
    a fold is made: a bar is in at most one test window, whose number is a quotient, and it may train from the first fold on whose
    window opens after its label ends. Bars are counted by these two numbers, which combines before the
    shuffle, and the counts are summed over folds."""
    spans = bars.groupBy("symbol").agg((F.max("bar_seq") + 1).alias("n")).withColumn("split", F.explode(F.array(*[F.lit(float(s)) for s in splits])))
    spans = spans.withColumn("first", F.floor(F.col("n") * F.col("split")).cast("long")).withColumn("size", F.floor((F.col("n") - F.col("first")) / n_folds).cast("long")).where("size > 0")
    used = F.filter(F.array(*[F.when(F.col(f"`{c}`"), F.lit(h).cast("long")) for h, c in horizons.items()]), lambda h: h.isNotNull())
    rows = bars.select("symbol", "bar_seq", "era", F.explode(used).alias("horizon")).join(spans, "symbol").withColumn("at", F.col("bar_seq") - F.col("first"))
    inside = (F.col("at") >= 0) & (F.col("at") < n_folds * F.col("size"))
    rows = rows.select("symbol", "split", "horizon", "era", F.when(inside, F.expr("at div size")).alias("window"), F.coalesce(inside & (F.col("at") % F.col("size") % F.col("horizon") == 0), F.lit(False)).alias("spaced"),
        F.when(F.col("at") + F.col("horizon") < 0, 0).otherwise(F.expr("(at + horizon) div size") + 1).alias("since"))
    counts = rows.groupBy("symbol", "split", "horizon", "era", "window", "since").agg(F.count("*").alias("n"), F.count_if("spaced").alias("spaced"))
    keys = ["symbol", "split", "horizon", "era", "fold"]
    train = counts.where(F.col("since") < n_folds).withColumn("fold", F.explode(F.sequence("since", F.lit(n_folds - 1).cast("long")))).select(*keys, F.col("n").alias("train"), F.lit(0).cast("long").alias("test"))
    test = counts.where("window is not null").select(*keys[:-1], F.col("window").alias("fold"), F.lit(0).cast("long").alias("train"), F.col("spaced").alias("test"))
    cells = train.unionByName(test).groupBy(*keys).agg(F.sum("train").alias("train"), F.sum("test").alias("test"))
    return spans.select("symbol", "split", "first", "size"), cells


def geometry_folds(bars: DataFrame, horizons: dict[int, str], splits: tuple[float, ...], n_folds: int = 5) -> DataFrame:
    """(symbol, split, horizon, fold, test_start, test_end, train, test, straddles): each fold of each split and horizon, also those without rows;
    straddles: the eras, comma-joined, whose first bar lies strictly inside the test window."""
    spans, cells = split_cells(bars, horizons, splits, n_folds)
    grid = spans.withColumn("horizon", F.explode(F.array(*[F.lit(h).cast("long") for h in horizons]))).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_folds - 1).cast("long"))))
    grid = grid.select("symbol", "split", "horizon", "fold", (F.col("first") + F.col("fold") * F.col("size")).alias("test_start"), (F.col("first") + (F.col("fold") + 1) * F.col("size")).alias("test_end"))
    keys = ["symbol", "split", "horizon", "fold"]
    rows = grid.join(cells.groupBy(*keys).agg(F.sum("train").alias("train"), F.sum("test").alias("test")), keys, "left").fillna(0, ["train", "test"])
    # a row an era of a symbol
    changes = bars.groupBy("symbol", "era").agg(F.min("bar_seq").alias("change")).where("change > 0").groupBy("symbol").agg(F.collect_list(F.struct("change", "era")).alias("changes"))
    crossed = F.filter(F.coalesce("changes", F.array()), lambda c: (c["change"] > F.col("test_start")) & (c["change"] < F.col("test_end")))
    return rows.join(changes, "symbol", "left").select(*keys, "test_start", "test_end", "train", "test", F.array_join(F.array_sort(F.transform(crossed, lambda c: c["era"].cast("string"))), ",").alias("straddles"))


def geometry_eras(bars: DataFrame, horizons: dict[int, str], splits: tuple[float, ...], n_folds: int = 5) -> DataFrame:
    """(symbol, split, horizon, fold, role, era, n, share): what eras each fold's train and test rows are of."""
    _, cells = split_cells(bars, horizons, splits, n_folds)
    keys = ["symbol", "split", "horizon", "fold", "role"]
    rows = cells.unpivot(["symbol", "split", "horizon", "era", "fold"], ["train", "test"], "role", "n").where("n > 0")
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).select(*keys, "era", "n", "share")


def geometry_report(bars: DataFrame, horizons: dict[int, str], splits: tuple[float, ...], parameters: tuple[int, ...], n_folds: int = 5, floor: int = 150) -> DataFrame:
    """(symbol, split, horizon, n_params, pooled, fold_min, fold_max, floors, train_first, rows_per_param, eras_tested, straddling, untested): what each
    split point costs. pooled: decisions over all folds, floors: as a multiple of the fewest that count as a result; train_first: training rows of
    the first fold; straddling: folds whose window holds an era change; untested: the eras, comma-joined, that no window tests."""
    keys = ["symbol", "split", "horizon"]
    _, cells = split_cells(bars, horizons, splits, n_folds)
    folds = geometry_folds(bars, horizons, splits, n_folds).groupBy(*keys).agg(F.sum("test").alias("pooled"), F.min("test").alias("fold_min"), F.max("test").alias("fold_max"),
        F.max(F.when(F.col("fold") == 0, F.col("train"))).alias("train_first"), F.count_if(F.col("straddles") != "").alias("straddling"))
    tested = cells.where("test > 0").groupBy(*keys).agg(F.collect_set("era").alias("tested"))
    known = bars.groupBy("symbol").agg(F.collect_set("era").alias("eras"))
    rows = folds.join(tested, keys, "left").join(known, "symbol").withColumn("n_params", F.explode(F.array(*[F.lit(p).cast("long") for p in parameters])))
    never = F.array_except("eras", F.coalesce("tested", F.array().cast(bars.select(F.array("era")).schema[0].dataType)))
    return rows.select(*keys, "n_params", "pooled", "fold_min", "fold_max", (F.col("pooled") / floor).alias("floors"), "train_first", F.expr("train_first div n_params").alias("rows_per_param"),
        F.coalesce(F.size("tested"), F.lit(0)).cast("long").alias("eras_tested"), "straddling", F.array_join(F.array_sort(F.transform(never, lambda e: e.cast("string"))), ",").alias("untested"))
