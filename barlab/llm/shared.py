"""What several operators need: stage tables, sorted-group iteration, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN_FOLDER: list[str] = []
_SHIPPED: set[str] = set()
#: Where each table of keep() lies, by the frame that reads it.
_KEPT: dict[int, tuple] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder from spark.checkpoint.dir. A folder of our own only in local mode, where executors see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="barlab-"))
    return _OWN_FOLDER[0]


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="barlab-ship-"), "barlab.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("barlab", os.path.relpath(path, top)))
    spark.sparkContext.addPyFile(target)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a stage's table to the shared folder and read it back, which cuts the lineage.

    A lost executor costs at most the tasks that were running: the table is on shared storage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/barlab/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _KEPT[id(back)] = (weakref.ref(back, lambda _, i=id(back): _KEPT.pop(i, None)), path)
    return back


def drop(*tables: DataFrame) -> None:
    """Delete tables that keep() wrote, once what was made from them is written too."""
    for table in tables:
        if id(table) in _KEPT:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(_KEPT[id(table)][1])
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def marked(ids: DataFrame, key: str, most_bits: int = 26) -> tuple[DataFrame, int]:
    """(word long, bits long), number of bits: a bitmap of the hashes of ids.key, 16 bits an id and 2**most_bits in all at most.

    The bitmap has at most 2**(most_bits - 6) rows (a million), whatever the data, so it may be broadcast;
    where ids are too many for it, more rows pass may_hold and the exact join after it is larger."""
    bits = min(most_bits, max(10, (16 * ids.count()).bit_length()))
    at = F.xxhash64(key).bitwiseAND(2**bits - 1)
    word = F.shiftright(at, 6)
    one = F.expr(f"shiftleft(1L, cast(xxhash64(`{key}`) & 63 as int))")
    return ids.groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits")), bits


def may_hold(df: DataFrame, key: str, bitmap: tuple[DataFrame, int]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not among the bitmap's ids, the other rows). Keys are longs and not null where it matters: a null key is surely not."""
    table, bits = bitmap
    columns = df.columns
    at = F.xxhash64(F.col(f"`{key}`")).bitwiseAND(2**bits - 1)
    words = F.broadcast(table.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
    joined = df.withColumn("_at", at).join(words, F.shiftright("_at", 6) == F.col("_word"), "left")
    hit = F.coalesce(F.expr("(shiftright(_bits, cast(_at & 63 as int)) & 1) = 1"), F.lit(False)) & F.col(f"`{key}`").isNotNull()
    back = [f"`{c}`" for c in columns]
    return joined.where(~hit).select(*back), joined.where(hit).select(*back)


def empty(spark: SparkSession, schema: str | StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def sorted_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of consecutive rows with equal integer keys, from batches sorted by them.

    Only the group that is still open is held from one batch to the next. Yields the batch's full
    groups one frame at a time."""
    rest: list[pd.DataFrame] = []
    last: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        k = np.stack([batch[c].to_numpy(np.int64) for c in keys], axis=1)
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(batch)]
        for n, (a, b) in enumerate(zip(starts, ends, strict=True)):
            own = tuple(k[a])
            if rest and own != last:
                yield rest[0] if len(rest) == 1 else pd.concat(rest, ignore_index=True)
                rest = []
            last = own
            rest.append(batch.iloc[a:b])
    if rest:
        yield rest[0] if len(rest) == 1 else pd.concat(rest, ignore_index=True)


def by_sorted_group(df: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame | pa.RecordBatch | None], schema: str | StructType,
    partitions: int | None = None, arrow: bool = False) -> DataFrame:
    """f over each group: shuffled by the keys, sorted, streamed; many small groups cost no call each into Spark. arrow: f returns record batches."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for group in sorted_groups(batches, keys):
            out = f(group)
            if out is not None and len(out):
                held.append(out)
                rows += len(out)
            if rows > 20_000:
                yield pd.concat(held, ignore_index=True)
                held, rows = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    def run_arrow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups((b.to_pandas() for b in batches), keys):
            yield f(group)

    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    dealt = dealt.sortWithinPartitions(*keys)
    return dealt.mapInArrow(run_arrow, schema) if arrow else dealt.mapInPandas(run, schema)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest member) of the graph on 0..n-1 with edges a-b, by repeated minimum and pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def contracted(edges: DataFrame, block: int = 1_000_000) -> DataFrame:
    """(lo, hi): what edges (lo long, hi long) connect, with the links of each block of a partition replaced by stars around their smallest nodes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def stars() -> pa.RecordBatch:
            ends = np.concatenate([np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in held], axis=1)
            nodes, at = np.unique(ends, return_inverse=True)
            at = at.reshape(2, -1)
            label = forest(len(nodes), at[0], at[1])
            tied = np.flatnonzero(label != np.arange(len(nodes)))
            return pa.record_batch([pa.array(nodes[label[tied]]), pa.array(nodes[tied])], names=["lo", "hi"])

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= block:
                yield stars()
                held, rows = [], 0
        if rows:
            yield stars()

    return edges.select("lo", "hi").mapInArrow(run, "lo long, hi long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a long, b long) as (node, root): root is the smallest node; roots have no row.

    Alternating large-star and small-star, each partition's links drawn together first. Each round is
    aggregations that combine before the shuffle, and joins of written tables, where a hub with a third
    of all links is a skewed key that Spark splits. Nothing is collected but one row of totals for each
    round, and a round's tables go when the next has been written. Null ends are dropped; loops and
    repeated links count once."""
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    now = keep(contracted(pairs), "links")
    was = None
    for _ in range(rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if seen == was or not seen[0]:
            break
        was = seen
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        low = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-low")
        large = keep(both.where("v > u").join(low, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct(), "links-large")
        least = keep(large.groupBy("hi").agg(F.min("lo").alias("m")), "links-least")
        moved = large.join(least, "hi").where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        new = keep(contracted(moved.union(least.select(F.col("m").alias("lo"), "hi")).distinct()), "links")
        drop(now, low, large, least)
        now = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
