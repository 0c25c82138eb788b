"""Walk-forward fits, permutation nulls, ablations and bootstraps: many small independent fits as grouped maps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.operators.bars import numbered
from barlab.sources.shared import written

LEAKS = ("none", "label_column", "scale_on_all", "train_and_test", "target_means")


def sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1 + e)


class Logistic:
    """Mean log-loss with an L2 penalty (the intercept free), by full-batch steps from zero.

    Stops at steps, or, with tolerance, when the gradient's largest part is no larger. y may hold many
    columns of labels: one fit for each, all in the same steps, each stopping by itself. own, of y's
    shape, is one more feature, with other values for each fit; its weights come last."""

    def __init__(self, steps: int = 1000, rate: float = 0.5, l2: float = 1e-6, tolerance: float | None = None):
        self.steps, self.rate, self.l2, self.tolerance = steps, rate, l2, tolerance

    def fit(self, x: np.ndarray, y: np.ndarray, own: np.ndarray | None = None) -> Logistic:
        single, y = y.ndim == 1, y.reshape(len(y), -1)
        many, p = y.shape[1], x.shape[1]
        weights, intercept = np.zeros((p + (own is not None), many)), np.zeros(many)
        norm, iterations = np.full(many, np.inf), np.zeros(many, np.int64)
        live = np.arange(many)
        for _ in range(self.steps):
            z = x @ weights[:p] + intercept
            error = sigmoid(z if own is None else z + own * weights[p]) - y
            gw = x.T @ error
            if own is not None:
                gw = np.vstack([gw, (own * error).sum(0)])
            gw, gb = gw / len(y) + self.l2 * weights, error.mean(0)
            now = np.maximum(np.abs(gb), np.abs(gw).max(0, initial=0.0))
            norm[live] = now
            iterations[live] += 1
            going = now > self.tolerance if self.tolerance is not None else np.ones(len(live), bool)
            if not going.all():
                self._store(live[~going], weights[:, ~going], intercept[~going], many)
                live, weights, intercept, gw, gb, y = live[going], weights[:, going], intercept[going], gw[:, going], gb[going], y[:, going]
                own = own if own is None else own[:, going]
                if not len(live):
                    break
            weights = weights - self.rate * gw
            intercept = intercept - self.rate * gb
        self._store(live, weights, intercept, many)
        self.norm, self.iterations = norm, iterations
        self.converged = norm <= self.tolerance if self.tolerance is not None else np.zeros(many, bool)
        self.hit_cap = ~self.converged & (iterations >= self.steps)
        if single:
            self.weights, self.intercept = self.weights[:, 0], self.intercept[0]
            self.norm, self.iterations, self.converged, self.hit_cap = norm[0], int(iterations[0]), bool(self.converged[0]), bool(self.hit_cap[0])
        return self

    def _store(self, at: np.ndarray, weights: np.ndarray, intercept: np.ndarray, many: int) -> None:
        if not hasattr(self, "weights") or self.weights.shape != (len(weights), many):
            self.weights, self.intercept = np.zeros((len(weights), many)), np.zeros(many)
        self.weights[:, at], self.intercept[at] = weights, intercept

    def predict(self, x: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        if own is None:
            return sigmoid(x @ self.weights + self.intercept)
        return sigmoid(x @ self.weights[:-1] + own * self.weights[-1] + self.intercept)


def _scaled(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    std = base.std(0)
    return (x - base.mean(0)) / np.where(std == 0, 1.0, std)


def _fits(x: np.ndarray, y: np.ndarray, train: np.ndarray, test: np.ndarray, leak: str, model: Callable[[], Logistic]) -> tuple[np.ndarray, np.ndarray, Logistic] | None:
    """(fits that are there, their forecasts of the test rows, the model), for each column of labels y; rows in order of bars.

    Scales on the training rows, fits on them, predicts the test rows. The leaks put on purpose into the fit what it must not see."""
    learn = train | test if leak == "train_and_test" else train
    if not learn.any() or not test.any():
        return None
    there = np.flatnonzero(y[learn].min(0) != y[learn].max(0))
    if not len(there):
        return None
    own, y = None, y[:, there]
    if leak == "label_column":
        own = y
    if leak == "target_means":
        order = np.argsort(x[:, 0], kind="stable")
        heads = np.arange(0, len(x), 4)
        means = np.add.reduceat(y[order], heads, axis=0) / np.diff(np.r_[heads, len(x)])[:, None]
        own = np.empty_like(y)
        own[order] = np.repeat(means, np.diff(np.r_[heads, len(x)]), axis=0)
    base = np.ones(len(x), bool) if leak == "scale_on_all" else learn
    x = _scaled(x, x[base])
    own = own if own is None else _scaled(own, own[base])
    fitted = model().fit(x[learn], y[learn], own if own is None else own[learn])
    return there, fitted.predict(x[test], own if own is None else own[test]), fitted


FIT = "symbol string, fold int, arm string, seed int, bar_seq long, p double, y double, iterations int, norm double, converged boolean, hit_cap boolean, weights array<double>, intercept double"


def fit_predict(rows: DataFrame, columns: dict[str, list[str]], leak: str = "none", model: Callable[[], Logistic] = Logistic) -> DataFrame:
    """Forecasts of the test rows of rows (symbol, fold, seed, bar_seq, role, y, features), for each arm's list of columns.

    One task for each (symbol, fold) fits all arms and seeds, so rows move once. Groups without
    training rows, test rows or two outcomes give nothing. A fold's rows are held by one worker."""
    names = sorted({c for own in columns.values() for c in own})

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for seed, rows_ in group.groupby("seed", sort=True):
            own = rows_.sort_values("bar_seq")
            y = own["y"].to_numpy(np.float64)
            train, test = (own["role"] == "train").to_numpy(), (own["role"] == "test").to_numpy()
            for arm, features in columns.items():
                out = _fits(own[features].to_numpy(np.float64), y[:, None], train, test, leak, model)
                if out is None:
                    continue
                _, p, fitted = out
                n = int(test.sum())
                found.append(pd.DataFrame({
                    "symbol": own["symbol"].to_numpy()[test], "fold": own["fold"].to_numpy()[test], "arm": arm, "seed": seed,
                        "bar_seq": own["bar_seq"].to_numpy()[test], "p": p[:, 0], "y": y[test], "iterations": fitted.iterations[0],
                    "norm": fitted.norm[0], "converged": fitted.converged[0], "hit_cap": fitted.hit_cap[0],
                        "weights": [fitted.weights[:, 0].tolist()] * n, "intercept": fitted.intercept[0],
                }))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=[c.split()[0] for c in FIT.split(", ")])

    return rows.select("symbol", "fold", "seed", "bar_seq", "role", "y", *names).groupBy("symbol", "fold").applyInPandas(run, FIT)


def _block_sums(parameters: int, curved: bool) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of each block of rows and its fold's weights, the gradient's parts, the intercept's last, and with curved those of the matrix of second derivatives."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for symbol, fold, x, y, w in zip(batch["symbol"], batch["fold"], batch["x"], batch["ys"], batch["w"], strict=True):
                x = np.column_stack([np.asarray(x, np.float64).reshape(-1, parameters - 1), np.ones(len(y))])
                p = sigmoid(x @ np.asarray(w, np.float64))
                parts = x.T @ (p - np.asarray(y, np.float64))
                if curved:
                    parts = np.r_[parts, (x.T * (p * (1 - p)) @ x).ravel()]
                out.append((symbol, fold, parts.tolist()))
            yield pd.DataFrame(out, columns=["symbol", "fold", "parts"])

    return run


def fit_predict_blocks(rows: DataFrame, features: list[str], steps: int = 1000, rate: float = 0.5, l2: float = 1e-6, tolerance: float | None = None,
    newton: bool = False, block_rows: int = 65_536, every: int = 20) -> DataFrame:
    """Forecasts of the test rows of rows (symbol, fold, bar_seq, role, y, features), for folds too large for a worker: fit_predict's clean fit without its seeds and arms.

    Training rows are scaled by their fold's mean and deviation and packed into blocks of block_rows; a step adds up the blocks' parts of the
    gradient, so no task holds a fold and only a vector a block is shuffled. newton takes steps by the matrix of second derivatives, a
    handful for a converged fit (give a tolerance); else there are steps jobs. Weights are a written table every so many steps.
    A fold that has met the tolerance keeps its weights. Folds without training rows or two outcomes give nothing."""
    n_params, keys = len(features) + 1, ["symbol", "fold"]
    rows = written(rows.select(*keys, "bar_seq", "role", "y", *features), "fit-rows")
    fit = rows.where("role = 'train'").groupBy(*keys).agg(F.count("*").alias("n"), F.min("y").alias("_low"), F.max("y").alias("_high"),
        *[a for i, c in enumerate(features) for a in (F.avg(f"`{c}`").alias(f"_m{i}"), F.stddev_pop(f"`{c}`").alias(f"_s{i}"))]).where("_low <> _high")
    scaled = rows.join(fit, keys).withColumn("x", F.array(*[(F.col(f"`{c}`") - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") == 0, 1.0).otherwise(F.col(f"_s{i}")) for i, c in enumerate(features)]))
    train = scaled.where("role = 'train'").withColumn("block", F.expr(f"bar_seq div {block_rows}"))
    blocks = written(train.groupBy(*keys, "block").agg(F.flatten(F.collect_list("x")).alias("x"), F.collect_list(F.col("y").cast("double")).alias("ys")).drop("block"), "fit-blocks")
    weights = written(fit.select(*keys, "n", F.array_repeat(F.lit(0.0), n_params).alias("w"), F.lit(0).cast("long").alias("iterations"), F.lit(float("inf")).alias("norm")), "fit-weights")
    n_parts = n_params * (n_params + 1) if newton else n_params
    penalty = np.r_[np.full(n_params - 1, l2), 0.0]

    def moved(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                w, parts = np.asarray(r["w"], np.float64), np.asarray(r["sums"], np.float64) / r["n"]
                gradient = parts[:n_params] + penalty * w
                norm = np.abs(gradient).max()
                if tolerance is None or norm > tolerance:
                    w = w - (np.linalg.solve(parts[n_params:].reshape(n_params, n_params) + np.diag(np.maximum(penalty, 1e-12)), gradient) if newton else rate * gradient)
                out.append((r["symbol"], r["fold"], r["n"], w.tolist(), r["iterations"] + 1, float(norm)))
            yield pd.DataFrame(out, columns=["symbol", "fold", "n", "w", "iterations", "norm"])

    for step in range(1, steps + 1):
        live = weights if tolerance is None else weights.where(F.col("norm") > tolerance)
        parts = blocks.join(live.select(*keys, "w"), keys).mapInPandas(_block_sums(n_params, newton), "symbol string, fold int, parts array<double>")
        one = parts.select(*keys, F.posexplode("parts").alias("at", "part")).groupBy(*keys, "at").agg(F.sum("part").alias("part"))
        sums = one.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]).alias("sums"))
        new = live.join(sums, keys).mapInPandas(moved, "symbol string, fold int, n long, w array<double>, iterations long, norm double")
        weights = new if tolerance is None else new.unionByName(weights.where(F.col("norm") <= tolerance))
        if newton or step % every == 0 or step == steps:
            weights = written(weights, "fit-weights")
            if tolerance is not None and not weights.where(F.col("norm") > tolerance).limit(1).count():
                break
    dot = F.aggregate(F.zip_with("x", F.slice("w", 1, n_params - 1), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) + F.element_at("w", n_params)
    met = F.lit(False) if tolerance is None else F.col("norm") <= tolerance
    return scaled.where("role = 'test'").join(weights.drop("n"), keys).select(*keys, "bar_seq", (1 / (1 + F.exp(-dot))).alias("p"), F.col("y").cast("double").alias("y"), "iterations", "norm", met.alias("converged"))


STUDY = "symbol string, fold int, arm string, leak string, seed int, parameters int, n long, sum_y double, sum_error double, norm double, converged boolean"


def null_fits(rows: DataFrame, columns: dict[str, list[str]], leaks: tuple[str, ...] = ("none",), model: Callable[[], Logistic] = Logistic,
    parts: dict[str, int] | None = None) -> DataFrame:
    """Sums of each (symbol, fold, arm, leak, seed) over its test rows, of rows (symbol, fold, bar_seq, role, ys, features): n, labels, squared errors.

    ys holds the row's label under each seed. All seeds are fitted together in matrices, so a (symbol,
    fold) moves once for each part of the arms (parts: which part an arm belongs to, all in one by default)."""
    names = sorted({c for own in columns.values() for c in own})
    part_of = {a: (parts or {}).get(a, 0) for a in columns}
    asked = rows.withColumn("part", F.explode(F.array(*[F.lit(n) for n in sorted({*part_of.values()})])))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bar_seq")
        y = np.stack(group["ys"].to_numpy()).astype(np.float64)
        train, test = (group["role"] == "train").to_numpy(), (group["role"] == "test").to_numpy()
        found = []
        for arm, features in columns.items():
            if part_of[arm] != group["part"].iloc[0]:
                continue
            x = group[features].to_numpy(np.float64)
            for leak in leaks:
                out = _fits(x, y, train, test, leak, model)
                if out is None:
                    continue
                seeds, p, fitted = out
                own = y[test][:, seeds]
                found.append(pd.DataFrame({
                    "symbol": group["symbol"].iloc[0], "fold": group["fold"].iloc[0], "arm": arm, "leak": leak, "seed": seeds,
                        "parameters": len(fitted.weights) + 1, "n": len(own), "sum_y": own.sum(0), "sum_error": ((p - own) ** 2).sum(0),
                    "norm": fitted.norm, "converged": fitted.converged,
                }))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=[c.split()[0] for c in STUDY.split(", ")])

    return asked.select("symbol", "fold", "part", "bar_seq", "role", "ys", *names).groupBy("symbol", "fold", "part").applyInPandas(run, STUDY)


def permuted(rows: DataFrame, seeds: int, spans: int = 64) -> DataFrame:
    """rows (symbol, bar_seq, y) with seed 0 to seeds - 1, y permuted over the whole symbol by each: the label of rank r by bar goes to the row of rank r by a hash of (seed, bar).

    Ranks are taken within spans of bars and of hashes, so that a long symbol is many tasks."""
    labels = numbered(rows, ["symbol"], F.floor(F.col("bar_seq") / 8192), ["bar_seq"], "r")
    every = rows.drop("y").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    mixed = F.xxhash64("seed", "bar_seq")
    places = numbered(every.withColumn("_hash", mixed), ["symbol", "seed"], F.floor(F.col("_hash") / (2.0**64 / spans)), ["_hash", "bar_seq"], "r").drop("_hash")
    return places.join(labels.select("symbol", "r", "y"), ["symbol", "r"]).drop("r")


def permuted_labels(rows: DataFrame, seeds: int) -> DataFrame:
    """(symbol, bar_seq, ys): each row's labels under seeds 0 to seeds - 1 of permuted, in one array."""
    listed = permuted(rows, seeds).groupBy("symbol", "bar_seq").agg(F.sort_array(F.collect_list(F.struct("seed", "y"))).alias("ys"))
    return listed.select("symbol", "bar_seq", F.transform("ys", lambda x: x["y"].cast("double")).alias("ys"))


def skill(forecasts: DataFrame, by: list[str]) -> DataFrame:
    ref = F.avg("y") * (1 - F.avg("y"))
    return forecasts.groupBy(*by).agg(F.count("*").alias("n"), F.when(ref > 1e-15, 1 - F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))) / ref).alias("skill"))


def pooled_skill(sums: DataFrame, by: list[str]) -> DataFrame:
    """Skill of null_fits' sums, pooled over folds."""
    total = sums.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("sum_y").alias("y"), F.sum("sum_error").alias("e"), F.first("parameters")
        .alias("parameters"), F.max("norm").alias("norm"), F.bool_and("converged").alias("converged"))
    ref = F.col("y") / F.col("n") * (1 - F.col("y") / F.col("n"))
    return total.select(*by, "n", "parameters", "norm", "converged", F.when(ref > 1e-15, 1 - F.col("e") / F.col("n") / ref).alias("skill"))


def null_study(skills: DataFrame, by: list[str], mean_limit: float = 0.01, max_limit: float = 0.05, resamples: int = 10_000) -> DataFrame:
    """Of permuted fits' skills (by, seed, skill): mean, median and largest over the seeds, the bootstrap interval of the mean, and whether
    the null holds: the interval's upper end, the largest and the median within limits. trips: the mean is over the limit of the largest.

    A study needs two seeds at least; groups with fewer have holds null."""
    more = [c for c in ("n", "parameters", "norm", "converged") if c in skills.columns]
    skills = written(skills.select(*by, "seed", "skill", *more), "skills")
    g = skills.groupBy(*by).agg(F.count("skill").alias("seeds"), F.percentile("skill", 0.5).alias("median"), F.max("skill").alias("largest"),
        *[(F.bool_and(c) if c == "converged" else F.max(c)).alias(c) for c in more])
    interval = bootstrap_mean(skills, by, "skill", resamples, order="seed").select(*by, "mean", F.col("low").alias("lower"), F.col("high").alias("upper"))
    holds = (F.col("upper") <= mean_limit) & (F.col("largest") <= max_limit) & (F.col("median") <= 0)
    return g.join(interval, by).withColumn("holds", F.when(F.col("seeds") >= 2, holds)).withColumn("trips", F.col("mean") > max_limit)


def reproduced(forecasts: DataFrame, scaled: DataFrame, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(symbol, fold, arm, seed, rows, agrees): whether the fit's coefficients give its forecasts again from the scaled test rows (symbol, fold, bar_seq, columns), each to the tolerance."""
    dot = sum((F.col("weights")[i] * F.col(f"`{c}`") for i, c in enumerate(columns)), F.col("intercept"))
    j = forecasts.join(scaled.select("symbol", "fold", "bar_seq", *columns), ["symbol", "fold", "bar_seq"], "left")
    same = F.coalesce(F.abs(1 / (1 + F.exp(-dot)) - F.col("p")) <= tolerance, F.lit(False))
    return j.groupBy("symbol", "fold", "arm", "seed").agg(F.count("*").alias("rows"), F.bool_and(same).alias("agrees"))


def response_probe(forecasts: DataFrame, columns: list[str]) -> DataFrame:
    """Per fold the change in probability for a step of one deviation of each feature from the mean, from the fit's coefficients."""
    one = forecasts.groupBy("symbol", "fold", "arm", "seed").agg(F.first("weights").alias("w"), F.first("intercept").alias("b"))
    s = lambda z: 1 / (1 + F.exp(-z))
    return one.select("symbol", "fold", "arm", "seed", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
        (s(F.col("b") + F.col("w")[i]) - s(F.col("b"))).alias("response")) for i, c in enumerate(columns)])).alias("x")).select("symbol", "fold", "arm", "seed", "x.*")


#: Rows whose weighted values are added up in one piece; sums of these go up a binary tree over the units, whatever tasks hold them.
UNIT = 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 random-looking bits of each counter."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(seed: int, resamples: np.ndarray, places: np.ndarray, stream: int) -> np.ndarray:
    """A number in [0, 1) for each (seed, resample, place), a row a resample."""
    own = _mixed(_mixed(np.uint64(2 * seed + stream) + np.uint64(0x9E3779B97F4A7C15) * (resamples.astype(np.uint64) + np.uint64(1))))
    return (_mixed(own[:, None] + np.uint64(0xD1342543DE82EF95) * (places.astype(np.uint64) + np.uint64(1))) >> np.uint64(11)) * 2.0**-53


def drawn_rows(n: int, resamples: np.ndarray, block: float, seed: int) -> np.ndarray:
    """The row at each of the n places of each resample: stationary blocks of that mean length, wrapped around; 1 draws rows.

    Whether a place opens a block, and at which row, depends on (seed, resample, place) alone."""
    places = np.arange(n)
    start = np.floor(_uniform(seed, resamples, places, 0) * n).astype(np.int64)
    if block <= 1:
        return start
    opens = _uniform(seed, resamples, places, 1) < 1 / block
    opens[:, 0] = True
    last = np.maximum.accumulate(np.where(opens, places, 0), axis=1)
    return (np.take_along_axis(start, last, 1) + places - last) % n


def _tree(parts: list[np.ndarray]) -> np.ndarray:
    """The sum of parts, neighbours first. Zeros that fill it up to a power of two change no bit."""
    while len(parts) > 1:
        parts = [a + b for a, b in zip(parts[::2], [*parts[1::2], *[0.0] * (len(parts) % 2)], strict=True)]
    return parts[0]


def _piece_sums(v: np.ndarray, first: int, n: int, resamples: np.ndarray, block: float, seed: int) -> np.ndarray:
    """For each resample the sum of rows first..first+len(v)-1 of the n, as often as it draws them. Resample -1 has each row once."""
    out, step = np.empty(len(resamples)), max(1, 2_000_000 // n)
    for a in range(0, len(resamples), step):
        own = resamples[a : a + step]
        at = drawn_rows(n, own, block, seed) - first
        flat = (np.arange(len(own))[:, None] * len(v) + at)[(at >= 0) & (at < len(v))]
        weights = np.bincount(flat, minlength=len(own) * len(v)).reshape(len(own), len(v))
        weights[own < 0] = 1
        out[a : a + step] = _tree([(weights[:, u : u + UNIT] * v[u : u + UNIT]).sum(1) for u in range(0, len(v), UNIT)])
    return out


def bootstrap_mean(values: DataFrame, by: list[str], column: str, resamples: int = 10_000, block: float = 1, seed: int = 1337, order: str = "bar_seq",
    alpha: float = 0.05, piece_units: int = 256, parts: int = 8) -> DataFrame:
    """Per group: mean, its percentile interval from resamples, and the one-sided p-value, add-one smoothed.

    block 1 resamples rows; more takes stationary blocks of that mean length, wrapped around. Random numbers are
    hashes of (seed, resample, place), so one law holds for groups of any size: a group is cut into pieces of piece_units * 4,096
    rows (a power of two), each of which finds by itself how often a resample draws each of its rows, and the pieces' sums are
    added up in pairs. Neither piece_units nor parts, the tasks that the resamples are dealt to, changes a bit of the means. No task holds
    more than a piece; the draws are worked out anew for each piece, which for n rows is n * n / piece numbers a resample.

    Null values don't count; a group without any other has no row."""
    kinds = dict(values.dtypes)
    named = ", ".join(f"`{b}` {kinds[b]}" for b in by)
    rows = values.where(F.col(column).isNotNull()).select(*by, F.col(order).alias("_at"), F.col(column).cast("double").alias("_v"))
    ranked = numbered(written(rows, "bootstrap"), by, F.floor(F.col("_at") / 65_536), ["_at", "_v"], "_r").withColumn("_r", F.col("_r") - 1)
    sizes = written(ranked.groupBy(*by).agg(F.count("*").alias("_n")), "bootstrap-sizes")
    packed = ranked.groupBy(*by, F.expr(f"_r div {piece_units * UNIT}").alias("_piece")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_v"))), lambda x: x["_v"]).alias("_values"))
    dealt = packed.join(sizes, by).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts, *by, "_part")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                own = np.arange(-1 + row["_part"], resamples, parts)
                if len(own):
                    x = _piece_sums(np.array(row["_values"], np.float64), row["_piece"] * piece_units * UNIT, row["_n"], own, block, seed)
                    yield pd.DataFrame({b: [row[b]] * len(own) for b in by} | {"_n": row["_n"], "_b": own, "_piece": row["_piece"], "_x": x})

    sums = dealt.mapInPandas(run, f"{named}, _n long, _b long, _piece long, _x double")
    pieces = -(-(sizes.agg(F.max("_n")).first()[0] or 0) // (piece_units * UNIT))
    while pieces > 1:
        sums = sums.groupBy(*by, "_n", "_b", F.expr("_piece div 2").alias("_piece")).agg(F.sum("_x").alias("_x"))
        pieces = -(-pieces // 2)
    means = sums.select(*by, "_b", (F.col("_x") / F.col("_n")).alias("m"))
    drawn = means.where("_b >= 0").join(means.where("_b < 0").select(*by, F.col("m").alias("mean")), by)
    return drawn.groupBy(*by).agg(F.first("mean").alias("mean"), F.percentile("m", alpha / 2).alias("low"), F.percentile("m", 1 - alpha / 2)
        .alias("high"), ((1 + F.count_if(F.col("m") - F.col("mean") >= F.col("mean"))) / (F.count("*") + 1)).alias("p_value"))
