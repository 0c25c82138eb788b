"""Near-duplicate embeddings by Euclidean p-stable hashing, checked by exact cosines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.shared import by_sorted_group, components, drop, forest, keep, ship


def _units(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def near_vectors(vectors: DataFrame, threshold: float = 0.95, tables: int = 64, projections: int = 20, width: float = 2.0, block: int = 4096,
    seed: int = 20) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id long, embedding array).

    Normalised vectors are hashed in each of the tables by floor((p.x + u) / width) of Gaussian
    projections p; rows that share a whole key are compared by cosine in double precision. A pair is
    counted in the first table where it meets, so no pairs are stored: a bucket gives link counts and
    a forest. Equal vectors are one class throughout. Buckets over block rows become a grid of
    blocks. To a bucket goes the vector in the column's own precision, with those keys of earlier
    tables that some other vector has too. With the defaults a pair at cosine 0.98 meets with a probability over 0.99999, at exactly
    0.95 of 0.98; random pairs rarely do.

    Vectors that are null, zero, empty, or hold null or non-finite components link with nothing, and
    neither do rows with a null vec_id (component null, kept). Vectors of unequal lengths never link.
    Repeated rows count each as a vector. Empty input gives an empty result."""
    spark = vectors.sparkSession
    ship(spark)
    wide = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(wide,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(wide, lambda x: x != 0)
    base = vectors.select("vec_id", F.when(fine, wide).alias("v")).withColumn("class", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    classes = base.where("v is not null").groupBy("class").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    directions: dict[int, tuple] = {}
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64

    def hashed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mix = np.random.default_rng(seed).integers(1, 2**63, projections, dtype=np.int64) | 1
        for whole in batches:
            for size, batch in whole.groupby(whole["v"].map(len)):
                if size not in directions:
                    g = np.random.default_rng([seed, size])
                    directions[size] = (g.standard_normal((size, tables * projections)), g.uniform(0, width, tables * projections))
                p, u = directions[size]
                raw = np.stack(batch["v"].to_numpy())
                cell = np.floor((_units(raw) @ p + u) / width).astype(np.int64).reshape(len(raw), tables, projections)
                with np.errstate(over="ignore"):
                    key = ((cell + size) * mix).sum(axis=2)
                    key ^= key >> 31
                yield pd.DataFrame({"class": batch["class"].to_numpy(), "copies": batch["copies"].to_numpy(),
                    "first_id": batch["first_id"].to_numpy(), "size": np.int32(size), "vector": [x.tobytes() for x in raw.astype(kind)], "keys": list(key)})

    nodes = keep(classes.mapInPandas(hashed, "class long, copies long, first_id long, size int, vector binary, keys array<long>"), "vectors")
    met = nodes.select("class", F.posexplode("keys").alias("table", "key"))
    full = keep(met.join(met.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1"), ["table", "key"]), "vector-buckets")
    shared = full.groupBy("class").agg(F.collect_list(F.struct(F.col("table").cast("byte").alias("t"), "key")).alias("shared"))
    carried = nodes.select("class", "copies", "size", "vector").join(shared, "class")
    parts = F.ceil(F.col("n") / block).cast("long")
    own, zero = F.pmod(F.xxhash64("class"), parts), F.lit(0).cast("long")
    cells = full.withColumn("own", own).select("table", "key", "class", "own",
        F.explode(F.transform(F.sequence(zero, parts - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))).alias("to"))
    cells = cells.select("table", "key", "to.i", "to.j", "own", "class").join(carried, "class")
    cells = cells.withColumn("shared", F.filter("shared", lambda x: x["t"] < F.col("table")))
    cells = cells.withColumn("tables", F.col("shared.t")).withColumn("keys", F.col("shared.key")).drop("shared")

    def compare(group: pd.DataFrame) -> pd.DataFrame | None:
        if len(group) < 2:
            return None
        table, i, j = int(group["table"].iloc[0]), int(group["i"].iloc[0]), int(group["j"].iloc[0])
        classes, copies, own = (group[c].to_numpy(np.int64) for c in ("class", "copies", "own"))
        keys, has = np.zeros((len(group), table), np.int64), np.zeros((len(group), table), bool)
        at = np.repeat(np.arange(len(group)), group["keys"].map(len)), np.concatenate(group["tables"].to_list()).astype(np.int64)
        keys[at], has[at] = np.concatenate(group["keys"].to_list()), True
        size = group["size"].to_numpy()
        counts, label = np.zeros(len(group), np.int64), np.arange(len(group))
        for length in np.unique(size):
            left, right = np.flatnonzero((own == i) & (size == length)), np.flatnonzero((own == j) & (size == length))
            if not len(left) or not len(right):
                continue
            x, y = (_units(np.frombuffer(b"".join(group["vector"].iloc[n]), kind).reshape(len(n), -1)) for n in (left, right))
            for s in range(0, len(left), 256):
                a, b = np.nonzero(x[s : s + 256] @ y.T >= threshold)
                a, b = left[s + a], right[b]
                use = (a < b) if i == j else (a != b)
                a, b = a[use], b[use]
                for c in range(0, len(a), 100_000):
                    p, q = a[c : c + 100_000], b[c : c + 100_000]
                    first = ~((keys[p] == keys[q]) & has[p] & has[q]).any(axis=1)
                    p, q = p[first], q[first]
                    np.add.at(counts, p, copies[q])
                    np.add.at(counts, q, copies[p])
                    label = forest(len(group), np.r_[p, np.arange(len(group))], np.r_[q, label])
        n, e = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(group)))
        return pd.DataFrame({"a": np.r_[classes[n], classes[e]], "b": pd.array(np.r_[np.zeros(len(n), np.int64), classes[label[e]]], dtype="Int64"),
            "links": np.r_[counts[n], np.zeros(len(e), np.int64)]})

    found = keep(by_sorted_group(cells, ["table", "key", "i", "j"], compare, "a long, b long, links long"), "vector-links")
    drop(full)
    counted = found.where("links > 0").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    roots = components(found.where("links = 0").select("a", "b")).withColumnRenamed("node", "class")
    rooted = nodes.select("class", "copies", "first_id").join(counted, "class", "left").join(roots, "class", "left").select("class", "first_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class").alias("root"))
    rooted = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("class", "n_links", "component_id")
    out = base.select("vec_id", "class").join(rooted, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id")
        .eqNullSafe(component).alias("kept"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links at cosine 0.95 or more between all embeddings; see near_vectors for nulls, zero vectors, repeats and empty tables."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = {
    "op5_embedding_dedup": """
WITH RECURSIVE base AS (
  SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM base a JOIN base b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(m.m, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(m.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counted c USING (vec_id) LEFT JOIN least_of m USING (vec_id)"""
}
