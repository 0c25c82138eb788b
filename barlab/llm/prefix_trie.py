"""Prefix trie of conversations: ternary search trees over turn ids, one a range shard, whose boundary nodes are merged."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barlab.llm.shared import keep, ship

_NO_ENDS = hashlib.sha256(b"").hexdigest()
TURNS = "array<struct<id:long,words:long>>"


class TernaryTree:
    """A trie whose children of one node are a binary search tree: each node has links below, at and above its turn id."""

    def __init__(self) -> None:
        self.key: list[int] = [0]
        self.below, self.down, self.above = [-1], [-1], [-1]
        self.words, self.depth, self.n, self.least, self.ends = [0], [0], [0], [None], [None]

    def insert(self, ids: Sequence[int], words: Sequence[int], n: int, least: int, ends: str) -> None:
        at, depth = 0, 0
        self._member(0, n, least)
        for own, size in zip(ids, words, strict=True):
            depth += 1
            link, last, at = self.down, at, self.down[at]
            while at >= 0 and self.key[at] != own:
                link, last = (self.below if own < self.key[at] else self.above), at
                at = link[at]
            if at < 0:
                at = link[last] = len(self.key)
                self.key.append(own)
                for x in (self.below, self.down, self.above):
                    x.append(-1)
                for x, value in ((self.words, size), (self.depth, depth), (self.n, 0), (self.least, None), (self.ends, None)):
                    x.append(value)
            self._member(at, n, least)
        self.ends[at] = ends

    def _member(self, at: int, n: int, least: int) -> None:
        self.n[at] += n
        if self.least[at] is None or least < self.least[at]:
            self.least[at] = least

    def path(self, ids: Sequence[int]) -> list[int]:
        """The nodes of a sequence that is there, the root first."""
        at, nodes = 0, [0]
        for own in ids:
            at = self.down[at]
            while self.key[at] != own:
                at = self.below[at] if own < self.key[at] else self.above[at]
            nodes.append(at)
        return nodes

    def walk(self) -> tuple[list[int], list[int]]:
        """(nodes in an order that puts parents first, parent of each node), with a stack of its own."""
        parent, order, stack = [-1] * len(self.key), [], [(0, -1)]
        while stack:
            at, up = stack.pop()
            parent[at] = up
            order.append(at)
            stack.extend((to, own) for to, own in ((self.above[at], up), (self.below[at], up), (self.down[at], at)) if to >= 0)
        return order, parent


def medians(n: int) -> Iterator[int]:
    """0..n-1, the middle of each interval before its halves."""
    queue = deque([(0, n)])
    while queue:
        a, b = queue.popleft()
        if a < b:
            mid = (a + b) // 2
            yield mid
            queue.extend(((a, mid), (mid + 1, b)))


def prefix_keys(ids: Iterable[int]) -> list[bytes]:
    """The 128-bit key of each prefix, the empty one first."""
    h = hashlib.blake2b(digest_size=16)
    keys = [h.copy().digest()]
    for own in ids:
        h.update(int(own).to_bytes(8, "little", signed=True))
        keys.append(h.copy().digest())
    return keys


NODE = "shard int, edge boolean, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, gross long, once long, ends_sha256 string"
_SUMS = ("n_convs", "n_children", "n_leaves", "gross", "once")
_FIELDS = [c.split()[0] for c in NODE.split(", ")]


def shard_rows(shard: int, sequences: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one shard. Those on the way to its first or last sequence, which other shards may have too, are edges and have keys.

    gross: members times words, summed over the subtree; once: words of its nodes. What is saved is the difference, and both can be added up over shards."""
    tree = TernaryTree()
    ids = [[t["id"] for t in s] for s in sequences["turns"]]
    members = [sequences[c].tolist() for c in ("n", "least", "ends")]
    for j in medians(len(ids)):
        tree.insert(ids[j], [t["words"] for t in sequences["turns"].iloc[j]], *(c[j] for c in members))
    order, parent = tree.walk()
    size = len(tree.key)
    children, leaves = [0] * size, [0] * size
    gross, once = [n * w for n, w in zip(tree.n, tree.words, strict=True)], list(tree.words)
    for at in reversed(order):
        leaves[at] = leaves[at] or 1
        up = parent[at]
        if up >= 0:
            children[up] += 1
            leaves[up] += leaves[at]
            gross[up] += gross[at]
            once[up] += once[at]
    keys: dict[int, bytes] = {}
    for s in (ids[0], ids[-1]):
        keys.update(zip(tree.path(s), prefix_keys(s), strict=True))
    ups = pd.array([None if up < 0 else tree.least[up] for up in parent], dtype="Int64")
    columns = (shard, [at in keys for at in range(size)], [keys.get(at) for at in range(size)], [keys.get(up) for up in parent], tree.least, tree.depth, ups, tree.n, children, leaves, gross, once, tree.ends)
    return pd.DataFrame(dict(zip(_FIELDS, columns, strict=True)))


def overlap_rows(last: Sequence[dict], first: Sequence[dict]) -> list[tuple]:
    """What to add to the sums for a last sequence of a shard and the first of the next: the nodes of their common prefix were counted twice."""
    common = 0
    while common < min(len(last), len(first)) and last[common]["id"] == first[common]["id"]:
        common += 1
    keys, after = prefix_keys(t["id"] for t in last[:common]), 0
    rows = []
    for depth in range(common, -1, -1):
        after += last[depth - 1]["words"] if depth else 0
        # a sequence that ends where the next shard goes on was no leaf
        rows.append((keys[depth], depth, 0, -int(depth < common), -int(len(last) == common), 0, -after))
    return rows


def turn_digest() -> Column:
    return F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))


def encoded(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<id, words>>): conversations in the order of their turns, as ids of the dictionary of distinct (role, text).

    turns: (conv_id, turn, role, text). Ids are numbers of the written dictionary's rows, found by a 128-bit digest, so texts don't leave the scan."""
    texts = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.select("conv_id", "turn", turn_digest().alias("digest"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    rows = keep(rows, "turns")
    dictionary = keep(rows.groupBy("digest").agg(F.max("words").alias("words")).withColumn("id", F.monotonically_increasing_id()), "turn-dictionary")
    coded = rows.drop("words").join(dictionary, "digest")
    own = coded.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"), "digest", "id", "words"))).alias("turns"))
    return own.select("conv_id", F.expr(f"cast(transform(turns, t -> struct(t.id as id, t.words as words)) as {TURNS})").alias("turns"))


def trie(conversations: DataFrame, shard_turns: int = 200_000) -> DataFrame:
    """One row a node of the prefix trie of conversations (conv_id long, turns array<struct<id: long, words: long>>): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Equal sequences become one, whose members are streamed in order through SHA-256, so no group of copies is held. The distinct
    sequences are dealt to shards by ranges of their ids, whatever their first turns have in common. Each shard builds a ternary search
    tree, the middle sequence of each interval first, and walks it once. Nodes on a shard's first and last path are merged
    by key over all shards; for two neighbouring shards the common prefix of the one's last and the other's first sequence
    is taken off once. A conversation is one row of 16 bytes a turn.

    A conversation without turns ends at the root. No conversations, no nodes."""
    spark = conversations.sparkSession
    ship(spark)
    members = conversations.select("conv_id", "turns", F.md5(F.array_join(F.transform("turns", lambda t: t["id"].cast("string")), ",")).alias("seq"))

    def grouped(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, turns, n, least, digest = None, None, 0, 0, None

        def done() -> dict:
            return {"turns": turns, "n": n, "least": least, "ends": digest.hexdigest()}

        for batch in batches:
            own, ids, out = batch["seq"].to_numpy(), batch["conv_id"].to_numpy(), []
            cuts = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1, len(own)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if own[a] != now:
                    if now is not None:
                        out.append(done())
                    now, turns, n, least, digest = own[a], batch["turns"].iloc[a], 0, int(ids[a]), hashlib.sha256()
                digest.update(("," * (n > 0) + ",".join(map(str, ids[a:b].tolist()))).encode())
                n += int(b - a)
            if out:
                yield pd.DataFrame(out)
        if now is not None:
            yield pd.DataFrame([done()])

    distinct = keep(members.repartition("seq").sortWithinPartitions("seq", "conv_id").mapInPandas(grouped, f"turns {TURNS}, n long, least long, ends string"), "turn-sequences")
    total = distinct.agg(F.sum(F.size("turns"))).first()[0] or 0
    shards = distinct.repartitionByRange(max(12, -(-total // shard_turns)), "turns").sortWithinPartitions("turns").withColumn("shard", F.spark_partition_id())

    def built(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            sequences = pd.concat(held, ignore_index=True)
            shard = int(sequences["shard"].iloc[0])
            nodes = shard_rows(shard, sequences)
            for name, at in (("first", 0), ("last", -1)):
                nodes[name] = [sequences["turns"].iloc[at], *[None] * (len(nodes) - 1)]
            yield nodes

    nodes = keep(shards.mapInPandas(built, f"{NODE}, first {TURNS}, last {TURNS}"), "trie-shards")

    ends = nodes.where("first is not null").select("shard", "first", "last")
    following = ends.select("shard", F.lead("shard").over(Window.orderBy("shard")).alias("after"))
    borders = ends.select("shard", "last").join(following, "shard").join(ends.select(F.col("shard").alias("after"), "first"), "after")

    def taken_off(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for last, first in zip(batch["last"], batch["first"], strict=True):
                yield pd.DataFrame(overlap_rows(last, first), columns=["key", "depth", *_SUMS])

    twice = borders.select("last", "first").mapInPandas(taken_off, "key binary, depth long, " + ", ".join(f"{c} long" for c in _SUMS))
    parts = nodes.where("edge").select("key", "parent_key", "conv_id", "depth", "ends_sha256", *_SUMS)
    merged = parts.unionByName(twice, allowMissingColumns=True).groupBy("key", "depth").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"),
        F.max("ends_sha256").alias("ends_sha256"), *[F.sum(c).alias(c) for c in _SUMS])
    merged = keep(merged, "trie-edges")
    inner = nodes.where("not edge")
    columns = ["conv_id", "depth", "parent_conv_id", "ends_sha256", *_SUMS]
    below = merged.drop("key").unionByName(inner.where("parent_key is not null").select("conv_id", "depth", "parent_key", "ends_sha256", *_SUMS), allowMissingColumns=True)
    below = below.join(merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key", "left").select(*columns)
    every = inner.where("parent_key is null").select(*columns).unionByName(below)
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("gross") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt on the turns of every twentieth; see trie.

    Turns without a conv_id belong to no conversation. Turns of one number go by the digest of role and text; a null turn
    comes first; null roles and texts are empty; repeated rows are turns each; other columns play no part."""
    own = keep(encoded(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")), "conversations")
    heads = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    shared = own.withColumn("base", F.expr("conv_id - conv_id % 20")).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")).join(heads, "base", "left")
    rebuilt = F.concat(F.slice(F.coalesce("head", F.array().cast(TURNS)), F.lit(1), F.col("h")), F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))"))
    return trie(shared.select("conv_id", rebuilt.alias("turns")))


SQL: dict[str, str] = {
    "op11_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, turn, md5(strlen(role)::VARCHAR || ':' || role || text) AS digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
own AS (
  SELECT conv_id, list({'d': digest, 'w': words} ORDER BY turn NULLS FIRST, digest) AS seq,
    list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b:
      list_reduce(list_concat([xor(c, b)], range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc
  FROM t GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.seq, [])[1:o.h], o.seq[o.h + 1:]) AS seq
  FROM (SELECT *, xor(crc, 4294967295) % 4 AS h FROM own) o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
prefixes AS (
  SELECT conv_id, d, array_to_string(list_transform(seq[1:d], lambda x: x.d), '') AS path, CASE WHEN d = 0 THEN 0 ELSE seq[d].w END AS w, d = len(seq) AS is_end
  FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends
  FROM prefixes GROUP BY path, d),
children AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS c FROM nodes WHERE d > 0 GROUP BY 1),
below AS (
  SELECT left(n.path, 32 * n.a) AS path, sum((n.n - 1) * n.w)::BIGINT AS saved, count(*) FILTER (c.c IS NULL) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM nodes) n LEFT JOIN children c ON c.path = n.path GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.c, 0) AS n_children, b.leaves AS n_leaves, b.saved AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN children c ON c.path = n.path LEFT JOIN nodes p ON n.d > 0 AND p.path = left(n.path, 32 * (n.d - 1))"""
}
