"""Quality classifier: a generalised additive model with pairwise interactions over features of the text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.shared import ship

FEATURES = (
    "log bytes", "log words", "bytes a word", "upper case a byte", "digits a byte", "marks a byte", "exclamations a word", "pipes a word",
        "symbols a word", "white space a byte",
    "lines a word", "other bytes a byte", "distinct words a word", "share of the commonest word", "words like the last", "repeated lines a line",
        "words without letters", "upper-case words", "short words", "longest word",
)
_SETS = {n: [*map(ord, s)] for n, s in {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "mark": ".,;:!?'\"()-", "bang": "!",
    "pipe": "|", "symbol": "#$%&*+<=>@[\\]^_`{}~", "space": " \t\n\r\v\f", "line": "\n"}.items()}


def features(text: str | None) -> list[float]:
    """The features of a whole text; a null or empty one has zeros."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = {k: int(count[v].sum()) for k, v in _SETS.items()}
    n, w = len(raw), len(words)
    seen, lines = Counter(words), [x for x in raw.split(b"\n") if x]
    return [
        np.log1p(n), np.log1p(w), n / w, of["upper"] / n, of["digit"] / n, of["mark"] / n, of["bang"] / w, of["pipe"] / w, of["symbol"] / w, of["space"] / n,
        of["line"] / w, int(count[128:].sum()) / n, len(seen) / w, max(seen.values()) / w, sum(map(eq, words, words[1:])) / w, 1 - len(set(lines)) / len(lines),
        sum(c for x, c in seen.items() if not x.upper() != x.lower()) / w, sum(c for x, c in seen.items() if len(x) > 1 and x.isupper()) / w,
            sum(c for x, c in seen.items() if len(x) <= 2) / w, np.log1p(max(map(len, seen))),
    ]


@dataclass
class Model:
    """Scores are the logistic of the intercept and a looked-up addition for each feature's bin and each pair's cell."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += table[np.searchsorted(cut, x[:, f], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-z))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(x)
    return (values[1:] + values[:-1]) / 2 if len(values) <= bins else np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, least: float = 2.0) -> np.ndarray:
    """A value for each bin: greedy splits of the bins' order by gain, to so many leaves."""
    ranges = [(0, len(g))]
    while len(ranges) < leaves:
        best = (1e-6, None, None)
        for a, b in ranges:
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gr, hr = g[a:b].sum() - gl, h[a:b].sum() - hl
            gain = np.where((hl >= least) & (hr >= least), gl * _leaf(gl, hl) + gr * _leaf(gr, hr) - g[a:b].sum() * _leaf(g[a:b].sum(), h[a:b].sum()), 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (a, b), a + int(gain.argmax()) + 1)
        if best[1] is None:
            break
        ranges.remove(best[1])
        ranges += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in ranges:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best single cut of both axes."""
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    part = lambda c: np.stack([c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1]])
    q, w = part(G), part(H)
    gain = (q * _leaf(q, w)).sum(0) - G[-1, -1] * _leaf(G[-1, -1], H[-1, -1])
    a, b = np.unravel_index(gain.argmax(), gain.shape)
    out, leaf = np.zeros(g.shape), _leaf(q[:, a, b], w[:, a, b])
    out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = leaf
    return float(gain[a, b]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, bins: int = 64, pair_bins: int = 12, n_pairs: int = 8, pair_rounds: int = 60) -> Model:
    """Boosting that visits the features in turn, one shallow tree a visit; then the pairs of most gain over what is left."""
    model = Model()
    if not len(x):
        return model
    p = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(p / (1 - p)))
    z = np.full(len(y), model.intercept)
    model.cuts, model.coarse = [_quantiles(c, bins) for c in x.T], [_quantiles(c, pair_bins) for c in x.T]
    at = [np.searchsorted(cut, c, side="right") for cut, c in zip(model.cuts, x.T, strict=True)]
    model.tables = [np.zeros(len(cut) + 1) for cut in model.cuts]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _shallow_tree(np.bincount(at[f], g, len(table)), np.bincount(at[f], h, len(table)))
            table += step
            z += step[at[f]]
    low = [np.searchsorted(cut, c, side="right") for cut, c in zip(model.coarse, x.T, strict=True)]
    shape = [len(cut) + 1 for cut in model.coarse]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        return tuple(np.bincount(low[i] * shape[j] + low[j], v, shape[i] * shape[j]).reshape(shape[i], shape[j]) for v in (g, h))

    gains = sorted(((_quadrants(*cells(i, j))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            step = rate * _quadrants(*cells(i, j))[1]
            table += step
            z += step[low[i], low[j]]
    return model


def fold(doc_id: Column | str, of: int = 5) -> Column:
    """crc32 of the id as text, modulo; a null id counts as ''."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))) % of


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Model:
    """Fit on at most max_rows labelled documents (the bounded sample: those of least hashed id) outside fold 0.

    labels: (doc_id long, quality int); null labels and ids teach nothing, several labels of one
    document count as their majority, 1 at a tie. Of several texts of one id one teaches, whatever
    the order of the rows, and no more than one a labelled id reaches the driver. Without labelled rows every score is 0.5."""
    ship(docs.sparkSession)
    marks = labels.where("doc_id is not null and quality is not null").where(fold("doc_id") != 0).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "x": [features(t) for t in batch["text"]]})

    # the sample has at most max_rows rows of two numbers; of an id's texts the one with the least features teaches
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInPandas(run, "doc_id long, y int, x array<double>")
    rows = found.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toPandas().sort_values("doc_id")
    return fit(np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(np.float64)) if len(rows) else Model()


def quality(model: Model, text: Column | str) -> Column:
    """The score of each whole text, 0 to 1; null and empty texts score as texts without words."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(np.array([features(t) for t in batch]).reshape(-1, len(FEATURES))) if len(batch) else np.zeros(0))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(text)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents from a model of the labels outside fold 0; see learn and quality for nulls, empty texts, conflicting labels and empty tables. Repeated rows are scored each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    scored = docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), quality(model, "text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


SQL: dict[str, str] = {}
