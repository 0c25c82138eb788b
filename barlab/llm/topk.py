"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barlab.llm.shared import empty, keep, ship

RESULT = "query_id long, rank int, vec_id long, score long"


def whole_components(vector: str | Column, scale: int) -> Column:
    """floor(scale * x) of each component as a double; null where the vector takes no part."""
    v = F.col(vector) if isinstance(vector, str) else vector
    wide = F.transform(v, lambda x: x.cast("double"))
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # beyond 2**52 a double is whole, and floor() would not fit a long
    whole = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
    return F.when(fine, F.transform(wide, lambda x: whole(x * float(scale))))


def _scores(q: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Integer inner products of what is not own, exact: in doubles below 2**53, in longs below 2**63, else in Python's integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
    exact = whole(q) @ whole(c).T
    exact[own] = 0
    if max(map(abs, exact.ravel())) >= 2**63:
        raise OverflowError("an inner product does not fit a long")
    return exact.astype(np.int64)


class Queries:
    """One round of queries with their open ranges, by the vectors' width."""

    def __init__(self, rows: pd.DataFrame):
        width = rows["v"].map(len).to_numpy() if len(rows) else np.zeros(0, np.int64)
        self.by_width = {}
        for n in np.unique(width):
            own = rows[width == n]
            self.by_width[int(n)] = (np.stack(own["v"].to_numpy()).astype(np.float64), *(own[c].to_numpy(np.int64) for c in ("no", "vec_id", "low", "open", "above")))

    def scored(self, batches: Iterable[pa.RecordBatch], rows: int = 512, columns: int = 4096) -> Iterator[tuple]:
        """(width, a, b, ids, scores, is-own flags): queries a to b of that width against some candidates."""
        for batch in batches:
            v, ids = batch.column("v"), batch.column("vec_id").to_numpy()
            widths = pc.list_value_length(v).to_numpy(zero_copy_only=False)
            for n in np.unique(widths):
                if int(n) not in self.by_width:
                    continue
                at = np.flatnonzero(widths == n)
                c = v.take(pa.array(at)).flatten().to_numpy().reshape(-1, n)
                q, _, own_ids, *_ = self.by_width[int(n)]
                for s in range(0, len(at), columns):
                    c_ids = ids[at[s : s + columns]]
                    for a in range(0, len(q), rows):
                        b = min(a + rows, len(q))
                        own = np.zeros((b - a, len(c_ids)), bool)
                        same = np.flatnonzero(np.isin(own_ids[a:b], c_ids))
                        own[same] = own_ids[a:b][same, None] == c_ids[None, :]
                        yield int(n), a, b, c_ids, _scores(q[a:b], c[s : s + columns], own), own


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, round_bytes: int = 16_000_000, bits: int = 7) -> DataFrame:
    """The k best candidates of each query by integer inner product, ties to the smaller id.

    vectors, queries: (vec_id long, v array<double> of whole numbers). All of both take part but rows
    with a null id or null v, and a row never answers a query of its own id. Candidates are written
    once and read in every pass; queries go past them in rounds, each a broadcast of at most
    round_bytes of vectors and their open ranges, so what is stored grows with the rows and not with
    the pairs. A pass counts every score into 2**bits bins of the query's open range, a task adds up
    all its candidates before the shuffle, and the bin that holds the k-th best becomes the next
    range, until it is one value wide. The last pass keeps what is above that value and, of the ties at
    it, only the smallest ids.

    Repeated rows count as often as they stand; repeated query rows are answered once; query rows of
    one id with different vectors are answered each; vectors of unequal lengths never meet. Scores are
    exact; one that doesn't fit a long raises an error. Empty tables give an empty result."""
    spark = vectors.sparkSession
    ship(spark)
    q = queries.where("vec_id is not null and v is not null").select("vec_id", "v").distinct()
    c = keep(vectors.where("vec_id is not null and v is not null").select("vec_id", "v"), "topk-candidates")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n_c, far = c.agg(F.count("*"), F.max(squares)).first()
    n_q, size = q.agg(F.count("*"), F.sum(F.size("v") * 8 + 64)).first()
    if not n_c or not n_q:
        return empty(spark, RESULT)
    rounds = -(-size // round_bytes)
    # the bound of Cauchy and Schwarz, as a power of two
    power = F.least(F.lit(63), F.ceil(F.log2(F.sqrt(squares) * F.lit(math.sqrt(far)) + 2)).cast("int"))
    asked = q.withColumn("no", F.xxhash64("vec_id", "v")).withColumn("s", F.pmod("no", F.lit(rounds)))
    asked = keep(asked.withColumn("power", power).repartition("s").sortWithinPartitions("s"), "topk-queries")
    state = asked.select("no", (-F.pow(F.lit(2.0), F.col("power"))).cast("long").alias("low"), (F.col("power") + 1).alias("open"), F.lit(0).cast("long").alias("above"))
    state = keep(state, "topk-ranges")

    def past(f: Callable, state: DataFrame, schema: str, name: str) -> DataFrame:
        """f over all candidates for each round of queries, one table for all rounds."""
        parts = []
        for s in range(rounds):
            # at most round_bytes of queries
            held = spark.sparkContext.broadcast(Queries(asked.where(F.col("s") == s).join(state, "no").toPandas()))
            parts.append(keep(c.mapInArrow(lambda batches, held=held: f(held.value, batches), schema), name))
            held.unpersist()
        return reduce(DataFrame.unionByName, parts)

    def counted(own: Queries, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 1 << bits
        counts = {w: np.zeros((len(x[0]), n + 1), np.int64) for w, x in own.by_width.items()}
        for w, a, b, _, score, is_own in own.scored(batches):
            low, open_ = own.by_width[w][3][a:b, None], own.by_width[w][4][a:b, None]
            at = (score.view(np.uint64) - low.view(np.uint64)) >> np.maximum(0, open_ - bits).astype(np.uint64)
            at = np.where(is_own | (score < low) | (at >= np.uint64(1) << np.minimum(open_, bits).astype(np.uint64)), n, at.view(np.int64))
            at += np.arange(b - a)[:, None] * (n + 1)
            counts[w][a:b] += np.bincount(at.ravel(), minlength=(b - a) * (n + 1)).reshape(b - a, n + 1)
        for w, count in counts.items():
            _, no, _, _, _, above = own.by_width[w]
            count = count[:, :n]
            # bins below the one that holds this task's own k-th best can't hold the k-th best of all
            better = np.cumsum(count[:, ::-1], axis=1)[:, ::-1] - count
            i, j = np.nonzero((count > 0) & (better < (k - above)[:, None]))
            yield pa.record_batch([pa.array(no[i]), pa.array(j.astype(np.int64)), pa.array(count[i, j])], names=["no", "bin", "n"])

    def picked(own: Queries, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, a, b, c_ids, score, is_own in own.scored(batches):
            _, no, ids, low, _, above = (x[a:b] for x in own.by_width[w])
            i, j = np.nonzero((score > low[:, None]) & ~is_own)
            order = np.argsort(c_ids, kind="stable")
            tie = ((score == low[:, None]) & ~is_own)[:, order]
            x, y = np.nonzero(tie & (np.cumsum(tie, axis=1) <= (k - above)[:, None]))
            i, j = np.r_[i, x], np.r_[j, order[y]]
            yield pa.record_batch([pa.array(v) for v in (no[i], ids[i], c_ids[j], score[i, j])], names=["no", "query_id", "vec_id", "score"])

    widest = state.agg(F.max("open")).first()[0]
    while widest > 0:
        sums = past(counted, state, "no long, bin long, n long", "topk-counts").groupBy("no", "bin").agg(F.sum("n").alias("n"))
        order = Window.partitionBy("no").orderBy(F.desc("bin"))
        found = sums.withColumn("upto", F.sum("n").over(order)).join(state, "no").where(f"upto >= {k} - above and upto - n < {k} - above")
        left = F.greatest(F.lit(0), F.col("open") - bits)
        low = F.col("low").cast("decimal(38,0)") + F.col("bin").cast("decimal(18,0)") * F.pow(F.lit(2.0), left).cast("decimal(20,0)")
        hit = found.select("no", low.cast("long").alias("low"), left.alias("open"), (F.col("above") + F.col("upto") - F.col("n")).alias("above"))
        few = state.join(hit.select("no"), "no", "left_anti").select("no", F.lit(-(2**63)).alias("low"), F.lit(0).alias("open"), "above")
        state = keep(hit.unionByName(few), "topk-ranges")
        widest = state.agg(F.max("open")).first()[0]

    best = past(picked, state, "no long, query_id long, vec_id long, score long", "topk-best")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for each whose vec_id is divisible by 20; see top_k for nulls, ties, repeats and empty tables."""
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", whole_components("embedding", 64).alias("v"))
    return top_k(base, base.where("vec_id % 20 = 0"), k=20)


SQL = {
    "op3_topk": """
WITH base AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
flat AS (SELECT vec_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM base),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM flat q JOIN flat c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20"""
}
