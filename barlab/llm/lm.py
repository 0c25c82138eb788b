"""Language-model scoring by deleted interpolation."""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.shared import by_sorted_group, empty, keep, ship

#: The token that ends every document and, as context, begins it. Words hold no white space.
END = b"\n"
HELD_OUT, MIXING, COUNTING = 0, 1, 2
BUCKETS = 48


def planes(x: np.ndarray) -> bytes:
    """The array byte plane by byte plane, compressed: the planes of high bytes are nearly empty."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unplanes(packed: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 56-bit hash of each ordered pair of word hashes, in the high bytes of 64 bits."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) & np.uint64(0xFFFFFFFFFFFFFF00)


class Types:
    """The words and word pairs of one chunk of documents, each list in the order of its hashes."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, end: int):
        self.before = np.r_[end, tokens[:-1]].astype(np.int64)
        self.before[np.r_[0, np.cumsum(lengths)[:-1]]] = end
        pairs, at = np.unique(self.before * len(hashes) + tokens, return_inverse=True)
        own = pair_hash(hashes[pairs // len(hashes)], hashes[pairs % len(hashes)])
        order = np.argsort(own, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words, self.pairs, self.token, self.pair = hashes, own[order], tokens, rank[at]


class Builder:
    """Gathers documents as word numbers until a chunk is full."""

    def __init__(self, mixing: bool):
        self.mixing, self.tokens = mixing, 0
        self.ids, self.roles, self.own = [], [], []
        self.number: defaultdict = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[END]

    def add(self, doc_id, text, role: int) -> None:
        words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
        number = self.number
        self.own.append(np.array([number[w] for w in words] + [0], dtype=np.uint32))
        self.ids.append(doc_id)
        self.roles.append(role)
        self.tokens += len(words) + 1

    def row(self) -> pd.DataFrame:
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.number], dtype=np.uint64)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return pd.DataFrame([{
            "chunk": uuid.uuid4().int >> 65, "is_mixing": self.mixing, "ids": planes(np.array([0 if i is None else i for i in self.ids], np.int64)),
                "nulls": np.array([i is None for i in self.ids], np.uint8).tobytes(),
            "roles": np.array(self.roles, np.uint8).tobytes(), "lengths": planes(np.array([len(x) for x in self.own], np.uint32)),
                "tokens": planes(rank[np.concatenate(self.own)]), "words": planes(np.diff(hashes[order], prepend=np.uint64(0))), "end": int(rank[0]),
        }])


def _types(row) -> tuple[Types, np.ndarray, np.ndarray]:
    """(types, lengths, roles) of a chunk's row."""
    lengths = unplanes(row["lengths"], np.uint32).astype(np.int64)
    words = np.cumsum(unplanes(row["words"], np.uint64), dtype=np.uint64)
    return Types(unplanes(row["tokens"], np.uint32).astype(np.int64), lengths, words, int(row["end"])), lengths, np.frombuffer(row["roles"], np.uint8)


PAYLOAD = "chunk long, is_mixing boolean, ids binary, nulls binary, roles binary, lengths binary, tokens binary, words binary, end long"
ASKED = "chunk long, is_mixing boolean, level int, slice long, hashes binary, counting binary, mixing binary"
TOLD = "chunk long, is_mixing boolean, level int, slice long, counting binary, counts binary, n long, n_counting long, v long, v_counting long"


def score_documents(docs: DataFrame, chunk_tokens: int = 1_000_000, slice_bytes: int = 8_000_000, rounds: int = 15) -> DataFrame:
    """log10 probability of each text under P(w|v) = l2 c(v w)/c(v) + l1 c(w)/N + l0/(V+1).

    docs: (doc_id long, text string, role int): HELD_OUT texts are only scored, COUNTING texts give
    the n-gram counts from which the weights are learned, MIXING texts are held out from those counts
    and teach the weights l by expectation-maximisation, one set for each power of two of the
    context's count c(v). The counts that score then come from both. Tokens are runs of
    `[^\\x20\\x09-\\x0D]`, A-Z lower-cased, and one end for each document, which is also the first
    token's context.

    Each task writes chunks of documents as word numbers, those that teach the weights apart. The
    chunk's distinct words (64-bit hashes) and word pairs (56 bits), combined before the shuffle, so
    that a frequent word counts once a chunk, are dealt out by ranges of their hash, summed over all
    chunks, and the totals go back to the chunks that asked. Nothing is broadcast; the driver sees N,
    V and the weights.

    A null or empty text is the end alone. A null doc_id stays null. Repeated rows are scored each
    and, if they teach, counted each. Without training texts every token has probability 1/(V+1) = 1.
    Without mixing texts the weights are fixed ones. Empty input gives an empty result."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text", "role")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(40, max(2, math.ceil(math.log2(1 + size / slice_bytes))))

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        building = {m: Builder(m) for m in (False, True)}
        for batch in batches:
            for i, text, role in zip(batch["doc_id"], batch["text"], batch["role"], strict=True):
                own = building[role == MIXING]
                own.add(None if pd.isna(i) else int(i), text, int(role))
                if own.tokens >= chunk_tokens:
                    yield own.row()
                    building[role == MIXING] = Builder(own.mixing)
        for own in building.values():
            if own.ids:
                yield own.row()

    table = keep(docs.mapInPandas(read, PAYLOAD), "lm-chunks")
    out_schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    chunks = {r["is_mixing"]: r["count"] for r in table.groupBy("is_mixing").count().collect()}
    if not chunks:
        return empty(spark, out_schema)
    # several slices or chunks a task
    dealt, grouped = max(12, 2**bits // 2), max(12, sum(chunks.values()) // 4)

    def ask(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                types, lengths, roles = _types(row)
                role, rows = np.repeat(roles, lengths), []
                for level, hashes, at in ((1, types.words, types.token), (2, types.pairs, types.pair)):
                    sums = [np.bincount(at[role == r], minlength=len(hashes)).astype(np.int64) for r in (COUNTING, MIXING)]
                    part = (hashes >> np.uint64(64 - bits)).astype(np.int64)
                    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
                    low = np.uint64(8 * (level == 2))
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        rows.append((row["chunk"], row["is_mixing"], level, int(part[a]), planes(np.diff(hashes[a:b] >> low, prepend=np.uint64(0))),
                            planes(sums[0][a:b]), planes(sums[1][a:b])))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ASKED.split(", ")])

    def totals(group: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.cumsum(unplanes(x, np.uint64), dtype=np.uint64) for x in group["hashes"]]
        cuts, rows = np.cumsum([0, *map(len, hashes)]), []
        _, at = np.unique(np.concatenate(hashes), return_inverse=True)
        counting, mixing = (np.bincount(at, weights=np.concatenate([unplanes(x, np.int64) for x in group[c]])).astype(np.int64) for c in ("counting", "mixing"))
        both = counting + mixing
        for n, (chunk, mixed, level, part) in enumerate(zip(group["chunk"], group["is_mixing"], group["level"], group["slice"], strict=True)):
            own = at[cuts[n] : cuts[n + 1]]
            sums = (both.sum(), counting.sum(), (both > 0).sum(), (counting > 0).sum()) if n == 0 else (0, 0, 0, 0)
            rows.append((chunk, mixed, level, part, planes(counting[own]) if mixed else None, planes(both[own]), *sums))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TOLD.split(", ")])

    told = keep(by_sorted_group(table.mapInPandas(ask, ASKED), ["level", "slice"], totals, TOLD, dealt), "lm-totals")
    n_all, n_counting, v_all, v_counting = (int(x or 0) for x in told.where("level = 1").agg(*[F.sum(c) for c in ("n", "n_counting", "v", "v_counting")]).first())
    together = table.unionByName(told.select("chunk", "is_mixing", "level", "slice", "counting", "counts"), allowMissingColumns=True)

    def opened(group: pd.DataFrame, column: str):
        own = group[group["tokens"].notna()].iloc[0]
        rest = group[group["tokens"].isna()].sort_values(["level", "slice"])
        one, two = (np.concatenate([unplanes(x, np.int64) for x in rest.loc[rest["level"] == level, column]]) for level in (1, 2))
        return own, *_types(own), one, two

    def events(group: pd.DataFrame) -> pd.DataFrame:
        _, types, _, _, one, two = opened(group, "counting")
        rows = np.stack([two[types.pair], one[types.before], one[types.token]], axis=1)
        return pd.DataFrame(rows, columns=["both", "context", "word"]).value_counts().reset_index(name="n")

    weights = np.tile([0.4, 0.59, 0.01], (BUCKETS, 1))
    weights[0] = [0, 0.99, 0.01]
    if n_counting and chunks.get(True):
        seen = by_sorted_group(together.where("is_mixing"), ["chunk"], events, "both long, context long, word long, n long",
            max(12, chunks[True] // 4)).groupBy("both", "context", "word").agg(F.sum("n").alias("n"))
        bucket = F.when(F.col("context") > 0, F.least(F.lit(BUCKETS - 1), F.floor(F.log2("context")).cast("int") + 1)).otherwise(0)
        seen = keep(seen.select("n", bucket.alias("b"), F.coalesce(F.try_divide("both", "context"), F.lit(0.0)).alias("f2"),
            (F.col("word") / n_counting).alias("f1")), "lm-events")
        f0 = 1 / (v_counting + 1)
        for _ in range(rounds):
            w = [F.element_at(F.array(*[F.lit(float(x)) for x in weights[:, j]]), F.col("b") + 1) for j in range(3)]
            shares = seen.select("b", "n", (w[0] * F.col("f2")).alias("p2"), (w[1] * F.col("f1")).alias("p1"), (w[2] * f0)
                .alias("p0")).withColumn("p", F.col("n") / (F.col("p2") + F.col("p1") + F.col("p0")))
            for row in shares.groupBy("b").agg(*[F.sum(F.col("p") * F.col(c)).alias(c) for c in ("p2", "p1", "p0")]).collect():
                new = np.maximum([0 if row["b"] == 0 else row["p2"], row["p1"], row["p0"]], [0, 0, 1e-9 * (row["p2"] + row["p1"] + row["p0"])])
                weights[row["b"]] = new / new.sum()

    def scored(group: pd.DataFrame) -> pd.DataFrame:
        own, types, lengths, roles, one, two = opened(group, "counts")
        word, context, both = one[types.token], one[types.before], two[types.pair]
        if n_all:
            w = weights[np.where(context > 0, np.minimum(BUCKETS - 1, np.frexp(context.astype(np.float64))[1]), 0)]
            p = w[:, 0] * both / np.maximum(context, 1) + w[:, 1] * word / n_all + w[:, 2] / (v_all + 1)
        else:
            p = np.ones(len(word))
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        total = lambda x: np.add.reduceat(x, starts)
        ids = pd.array(unplanes(own["ids"], np.int64), dtype="Int64")
        ids[np.frombuffer(own["nulls"], np.uint8) == 1] = pd.NA
        return pd.DataFrame({"doc_id": ids, "held_out": roles == HELD_OUT, "n_tokens": lengths, "n_known": total((word > 0).astype(np.int64)),
            "train_tokens": n_all, "base_score": total(np.log10((word + 0.1) / (n_all + 0.1 * (v_all + 1)))), "score": total(np.log10(p))})

    return by_sorted_group(together.drop("counting"), ["chunk"], scored, out_schema, grouped)


def op1_lm_scores(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, see score_documents for nulls, empty texts, repeats and empty tables. Remainder 0 of crc32 is held out, 1 teaches the weights, 2 to 9 the counts behind them. A null doc_id counts as the text ''."""
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.least(remainder, F.lit(2)).cast("int").alias("role")))


SQL: dict[str, str] = {}
