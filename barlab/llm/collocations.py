"""Phrase collocations by dynamic itemset counting."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barlab.llm.lm import planes, unplanes
from barlab.llm.shared import by_sorted_group, drop, empty, keep, ship

#: A-Z lower-cased, each delimiter of pieces a full stop, a tab a space.
_FOLD = bytes(ord(".") if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
NEVER = 255
#: A place of a phrase is one long: chunk, offset in the chunk, length of the phrase.
_OFFSET, _LENGTH = 33, 3


def words_and_stops(text: str | None) -> list[bytes]:
    """The text's words, with b"." between pieces; a word holds no full stop."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).replace(b".", b" . ").split() if isinstance(text, str) else []


class Builder:
    """Documents of one language as word numbers; 0 is the end of a piece."""

    def __init__(self, lang: str):
        self.lang, self.tokens, self.words, self.own = lang, 0, 0, []
        self.number: defaultdict = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[b"."]

    def add(self, text: str | None) -> None:
        number = self.number
        own = np.array([number[w] for w in words_and_stops(text)] + [0], dtype=np.uint32)
        self.own.append(own)
        self.tokens += len(own)
        self.words += int((own > 0).sum())

    def row(self, chunk: int, shard: int) -> tuple:
        return (shard, chunk, self.lang, self.words, planes(np.concatenate(self.own)), zstandard.ZstdCompressor(level=3).compress(b".".join(list(self.number)[1:])))


CHUNK = "shard int, chunk long, lang string, n_words long, tokens binary, words binary"
PART = "slice long, keys binary, counts binary, done binary, places binary, reached binary"


def _words(packed: bytes) -> list[bytes]:
    return [b"", *zstandard.ZstdDecompressor().decompress(packed).split(b".")]


def _longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit keys of phrases one word longer."""
    x = key * np.uint64(0x9E3779B97F4A7C15) + (word ^ (word >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def active(lang: str, tokens: np.ndarray, words: list[bytes], step: int, shards: int, longest: int, reached: np.ndarray) -> Iterator[tuple]:
    """(length, keys, counts, last step of the cycle, first offsets) of the chunk's phrases that are being counted at this step.

    reached: for each value of a key's high bits the first step after which some phrase with them was at the
    threshold. A word is counted from step 0. A longer phrase is counted for one cycle of all shards from
    the step after both of its parts, without the last and without the first word, had reached it."""
    salt = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
    hashes = np.array([xxhash.xxh64_intdigest(w, seed=salt) for w in words], dtype=np.uint64)
    shift = np.uint64(64 - (len(reached) - 1).bit_length())
    if step < shards:
        counts = np.bincount(tokens, minlength=len(words))
        first = np.full(len(words), len(tokens), np.int64)
        first[tokens[::-1]] = np.arange(len(tokens) - 1, -1, -1)
        there = np.flatnonzero(counts[1:]) + 1
        yield 1, hashes[there], counts[there], np.full(len(there), shards - 1, np.uint8), first[there]
    at = np.flatnonzero(tokens)
    keys, start = hashes[tokens[at]], np.zeros(len(at), np.int64)
    for length in range(2, longest + 1):
        # no sooner than the phrase itself was counted, whatever else has the same bits
        since = np.maximum(reached[(keys >> shift).astype(np.int64)], start)
        # places whose phrase and the next place's both are at the threshold
        pair = np.flatnonzero((at[1:] == at[:-1] + 1) & (since[1:] < NEVER) & (since[:-1] < NEVER))
        start = np.maximum(since[pair], since[pair + 1]) + 1
        last = tokens[at[pair] + length - 1]
        keys, at = _longer(keys[pair], hashes[last]), at[pair]
        now = np.flatnonzero((start <= step) & (step < start + shards))
        if len(now):
            own, where, counts = np.unique(keys[now], return_index=True, return_counts=True)
            yield length, own, counts, (start[now[where]] + shards - 1).astype(np.uint8), at[now[where]]
        if not len(at):
            return


def frequent_phrases(docs: DataFrame, threshold: int, longest: int, shards: int = 4, chunk_tokens: int = 2_000_000, slice_keys: int = 1_000_000, most_bits: int = 26) -> tuple[DataFrame, DataFrame]:
    """((lang, words array<string>, f), (lang, n)): every phrase of up to longest words with f >= threshold occurrences, and each language's words.

    Dynamic itemset counting. Tasks write documents as chunks of word numbers, dealt to shards. Step t
    scans shard t mod shards and counts, for all lengths at once, the phrases that are active: a
    phrase of k words becomes so in the step after both its (k-1)-word parts had reached the threshold
    in what was scanned so far, and stays so for one full cycle, so that each shard counts it once. It ends
    when nothing has reached the threshold for a cycle.

    A chunk's counts, one for each distinct phrase, go to slices of the key's range, where they
    are added to what the slice holds; phrases that end their cycle below the threshold are dropped there. A chunk
    has at most a row for each of its phrases, so rows grow with the input. Which phrases have reached the
    threshold is broadcast as a table of at most 2**most_bits bytes over the high bits of the keys:
    another phrase with the same bits only means more phrases counted; each is still counted for exactly
    one cycle, since an entry never changes. Keys are 64-bit hashes of language and words."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_chunks: dict[str, Builder] = {}
        number, held = TaskContext.get().partitionId(), 0
        columns = [c.split()[0] for c in CHUNK.split(", ")]

        def close(lang: str) -> pd.DataFrame:
            nonlocal chunks, held
            done, chunks = open_chunks.pop(lang), chunks + 1
            held -= done.tokens
            return pd.DataFrame([done.row(number * 1024 + chunks - 1, (number + chunks) % shards)], columns=columns)

        chunks = 0
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                own = open_chunks.setdefault(lang, Builder(lang))
                held -= own.tokens
                own.add(text)
                held += own.tokens
                if own.tokens >= chunk_tokens:
                    yield close(lang)
                elif held >= 2 * chunk_tokens:
                    yield close(max(open_chunks, key=lambda x: open_chunks[x].tokens))
        for lang in list(open_chunks):
            yield close(lang)

    table = keep(docs.mapInPandas(read, CHUNK), "phrases-chunks")
    totals = table.groupBy("lang").agg(F.sum("n_words").alias("n"))
    n_chunks, size = table.agg(F.count("*"), F.sum("n_words")).first()
    if not size:
        return empty(spark, "lang string, words array<string>, f long"), totals
    slice_bits = max(1, math.ceil(math.log2(1 + size / slice_keys)))
    bits = max(slice_bits + 3, min(most_bits, max(12, math.ceil(math.log2(1 + 16 * size / threshold)))))
    reached = np.full(2**bits, NEVER, np.uint8)

    def counted(step: int, known):
        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, row in batch.iterrows():
                    tokens = unplanes(row["tokens"], np.uint32).astype(np.int64)
                    found = list(active(row["lang"], tokens, _words(row["words"]), step, shards, longest, known.value))
                    if not found:
                        continue
                    keys = np.concatenate([x[1] for x in found])
                    order = np.argsort(keys)
                    keys = keys[order]
                    counts, done = (np.concatenate([x[i] for x in found])[order] for i in (2, 3))
                    places = np.concatenate([(row["chunk"] << _OFFSET) | (x[4] << _LENGTH) | x[0] for x in found])[order]
                    part = (keys >> np.uint64(64 - slice_bits)).astype(np.int64)
                    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
                    yield pd.DataFrame([(int(part[a]), planes(np.diff(keys[a:b], prepend=np.uint64(0))), planes(counts[a:b]), planes(done[a:b]), planes(places[a:b]), None)
                        for a, b in zip(cuts[:-1], cuts[1:], strict=True)], columns=[c.split()[0] for c in PART.split(", ")])

        return run

    def added(step: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            keys = np.concatenate([np.cumsum(unplanes(x, np.uint64), dtype=np.uint64) for x in group["keys"]])
            own, where, at = np.unique(keys, return_index=True, return_inverse=True)
            counts = np.zeros(len(own), np.int64)
            np.add.at(counts, at, np.concatenate([unplanes(x, np.int64) for x in group["counts"]]))
            done, places = (np.concatenate([unplanes(x, kind) for x in group[c]])[where] for c, kind in (("done", np.uint8), ("places", np.int64)))
            stays = np.flatnonzero((counts >= threshold) | (done > step))
            own, counts, done, places = own[stays], counts[stays], done[stays], places[stays]
            first = int(group["slice"].iloc[0]) << (bits - slice_bits)
            over = np.zeros(2 ** (bits - slice_bits), np.uint8)
            part = (counts >= threshold) & ((places & 7) < longest)
            over[(own[part] >> np.uint64(64 - bits)).astype(np.int64) - first] = 1
            packed = zstandard.ZstdCompressor(level=1).compress(np.packbits(over).tobytes())
            return pd.DataFrame([(group["slice"].iloc[0], planes(np.diff(own, prepend=np.uint64(0))) if len(own) else None, planes(counts) if len(own) else None,
                planes(done) if len(own) else None, planes(places) if len(own) else None, packed)], columns=[c.split()[0] for c in PART.split(", ")])

        return run

    state, quiet, dealt = empty(spark, PART), 0, max(12, 2**slice_bits // 2)
    for step in range(NEVER):
        known = spark.sparkContext.broadcast(reached)
        rows = table.where(F.col("shard") == step % shards).drop("shard", "n_words").repartition(max(6, n_chunks // shards // 2), "chunk").mapInPandas(counted(step, known), PART)
        new = keep(by_sorted_group(rows.union(state.where("keys is not null")), ["slice"], added(step), PART, dealt), "phrases-state")
        before = int((reached < NEVER).sum())
        for row in new.select("slice", "reached").toLocalIterator():
            piece = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(row["reached"]), np.uint8))[: 2 ** (bits - slice_bits)]
            own = reached[row["slice"] << (bits - slice_bits) : (row["slice"] + 1) << (bits - slice_bits)]
            own[(piece == 1) & (own == NEVER)] = step
        drop(state)
        known.destroy()
        state = new
        quiet = 0 if int((reached < NEVER).sum()) > before else quiet + 1
        if quiet >= shards and step >= shards - 1:
            break
    else:
        raise RuntimeError("counting did not end")

    def opened(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                if row["keys"] is not None:
                    counts, places = unplanes(row["counts"], np.int64), unplanes(row["places"], np.int64)
                    over = counts >= threshold
                    yield pd.DataFrame({"chunk": places[over] >> _OFFSET, "place": places[over] & (2**_OFFSET - 1), "f": counts[over]})

    def spelt(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                tokens, words = unplanes(row["tokens"], np.uint32), _words(row["words"])
                own = [(row["lang"], [words[w].decode("utf-8", "surrogatepass") for w in tokens[p["place"] >> _LENGTH :][: p["place"] & 7]], p["f"]) for p in row["phrases"]]
                yield pd.DataFrame(own, columns=["lang", "words", "f"])

    places = state.where("keys is not null").select("keys", "counts", "places").mapInPandas(opened, "chunk long, place long, f long")
    places = places.groupBy("chunk").agg(F.collect_list(F.struct("place", "f")).alias("phrases"))
    return keep(table.join(places, "chunk").select("lang", "tokens", "words", "phrases").mapInPandas(spelt, "lang string, words array<string>, f long"), "phrases"), totals


def collocations(docs: DataFrame, threshold: int = 100, longest: int = 5, top: int | None = 2000, **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of docs (lang string, text string): the first top phrases of each language, or all (None).

    A text is cut into pieces at `[.,;:!?\\x0A-\\x0D]`, a piece into words `[^\\x20\\x09]+`, A-Z lower-cased.
    Phrases have 2 to longest words and a >= threshold occurrences in pieces, overlaps included. Each cut in two parts with l
    and r occurrences scores floor(1000 a n / (l r)), exactly, in decimals of 38 digits; the lowest score counts, ties to
    the shorter first part. Phrases inside a longer one with as many occurrences are dropped. Order: score and a
    descending, phrase ascending by UTF-8 bytes.

    A null lang is `und`; null and empty texts have no words; repeated rows count each; documents need no ids, and other columns play no part.
    A text of any length is one document of its chunk. Empty input, or one without frequent phrases, gives an empty result."""
    found, totals = frequent_phrases(docs, threshold, longest, **sizes)
    found = found.select("lang", "words", F.size("words").alias("k"), F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"))
    candidates = found.where("k > 1")
    # a longer phrase around this one with as many occurrences has one of one word more in between
    around = candidates.where("k > 2").select("lang", F.explode(F.array(F.expr("slice(words, 1, k - 1)"), F.expr("slice(words, 2, k - 1)"))).alias("inner"), "a")
    around = around.groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("a").alias("outer"))
    left = candidates.join(around, ["lang", "phrase"], "left").where("outer is null or 100 * outer < 100 * a")
    cuts = left.select("lang", "phrase", "a", "words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.expr("slice(words, 1, cut)"), " ").alias("first"), F.array_join(F.expr("slice(words, cut + 1, k - cut)"), " ").alias("rest"))
    counts = found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cuts = cuts.join(counts.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"]).join(counts.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumn("over", F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n"))).withColumn("under", wide("l") * wide("r")).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long"))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """The 2000 strongest collocations of each language of documents; see collocations for nulls, repeats and empty tables."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


SQL: dict[str, str] = {
    "op13_collocations": r"""
WITH tokens AS (
  SELECT lang, doc, p, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, doc, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS p
        FROM (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
                regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
              FROM documents WHERE text IS NOT NULL))),
grams AS (
  SELECT lang, w[i:i + k - 1] AS words, k FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM tokens), (SELECT unnest(range(1, 6)) AS k)
  WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, words, any_value(k) AS k, count(*) AS a, array_to_string(words, ' ') AS phrase FROM grams GROUP BY lang, words HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM tokens GROUP BY lang),
around AS (SELECT lang, sub, max(a) AS outer_a FROM (SELECT lang, words[1:k - 1] AS sub, a FROM f WHERE k > 2
                                                     UNION ALL SELECT lang, words[2:k] AS sub, a FROM f WHERE k > 2) GROUP BY lang, sub),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.words, c.cut, x.a AS l, y.a AS r, n.n, ((1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1) c
  JOIN f x ON x.lang = c.lang AND x.words = c.words[1:c.cut] JOIN f y ON y.lang = c.lang AND y.words = c.words[c.cut + 1:c.k] JOIN n ON n.lang = c.lang
  WHERE NOT EXISTS (SELECT 1 FROM around o WHERE o.lang = c.lang AND o.sub = c.words AND 100 * o.outer_a >= 100 * c.a)),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000"""
}
