"""Harmonic packing of tokenised documents into sequences."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barlab.llm.shared import keep, ship

#: A run of marks that ends a word after a plain letter or digit: the tokenizer's own words end there too.
ENDING = r"([a-z0-9])([.,!?;:]+)([ \t-\r]|$)"
_LOADED: dict[tuple[str, int], WordTokens] = {}


class WordTokens:
    """Ids of whole texts, by the ids of their words: the tokenizer lower-cases, drops white space, and never joins
    words across it, nor a letter to the marks after it. A worker keeps what it knows from task to task.
    Number 0 stands for the end of a text."""

    def __init__(self, path: str, end_id: int, most: int = 1_000_000):
        # a worker has one core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.most = Tokenizer.from_file(path), end_id, most
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(1 + max(vocabulary.values(), default=0), bool)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        if suffix:
            self.closes[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
        self.clear()

    @classmethod
    def of(cls, path: str, end_id: int) -> WordTokens:
        if (path, end_id) not in _LOADED:
            _LOADED[path, end_id] = cls(path, end_id)
        return _LOADED[path, end_id]

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.starts = np.array([self.end_id], np.uint32), np.array([0, 1], np.int32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each of some different words; words not seen before are tokenized."""
        number = self.number
        known = list(map(number.get, words))
        fresh = [w for w, n in zip(words, known, strict=True) if n is None]
        if fresh:
            asked = [w.decode("utf-8", "replace") for w in fresh]
            letters = [w for w in asked if w.isalpha()]
            # many words of letters side by side cost less than many calls; each ends with one token that closes a word
            found = [e.ids for e in self.tokenizer.encode_batch_fast([" ".join(letters[k : k + 1000]) for k in range(0, len(letters), 1000)], add_special_tokens=False)]
            flat = np.array([i for ids in found for i in ids], np.uint32)
            ends = np.flatnonzero(self.closes[flat]) + 1
            if len(ends) == len(letters):
                order = sorted(range(len(asked)), key=[not w.isalpha() for w in asked].__getitem__)
                fresh, rest = [fresh[i] for i in order], [w for w in asked if not w.isalpha()]
            else:
                flat, ends, rest = flat[:0], ends[:0], asked
            found = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            ends = np.r_[ends, len(flat) + np.cumsum([len(ids) for ids in found], dtype=np.int64)]
            number.update(zip(fresh, range(len(number) + 1, len(number) + len(fresh) + 1), strict=True))
            self.flat = np.concatenate([self.flat, flat, np.array([i for ids in found for i in ids], np.uint32)])
            self.starts = np.r_[self.starts, self.starts[-1] + ends].astype(np.int32)
        return np.array(list(map(number.__getitem__, words)) if fresh else known, np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the texts one after the other, each text's number of ids), the end's id after each text."""
        if len(self.number) > self.most:
            self.clear()
        # special tokens are told by their exact letters, so texts that may hold one stay as they are
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), ENDING, r"\1 \2\3")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, plain))
        coded = split.flatten().dictionary_encode()
        # white space at a text's ends leaves empty words, which have no ids
        known = self.numbers(coded.dictionary.cast(pa.binary()).to_pylist())
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        words = np.insert(known[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int32), ends, 0)
        first = self.starts[words]
        count = self.starts[words + 1] - first
        upto = np.cumsum(count, dtype=np.int32)
        ids = self.flat[np.repeat(first - upto + count, count) + np.arange(upto[-1], dtype=np.int32)]
        return ids, np.diff(upto[ends + np.arange(len(ends))], prepend=0).astype(np.int64)


def cut(length: int, capacity: int, smallest: int) -> list[tuple[int, int]]:
    """(length, class) of a document's pieces. Class j: a bin takes j such pieces.

    Whole sequences first, then each time the largest reciprocal of the capacity that fits, down to
    the smallest piece that is cut; what is left, being shorter, is a last piece of its own class."""
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest >= smallest:
        j = -(-capacity // rest)
        out.append((capacity // j, j))
        rest -= capacity // j
    return [*out, (rest, capacity // rest)] if rest else out


@lru_cache(100_000)
def _cut(length: int, capacity: int, smallest: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array(x, np.int64) for x in zip(*cut(length, capacity, smallest), strict=True))


PIECES = "doc_id long, start long, length long, doc_tokens long, class int, worker int, nth long, ids binary"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("class", pa.int32()),
    ("worker", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary())])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, smallest: int = 64, end_id: int = 2, batch_bytes: int = 4_000_000) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): the pieces of all documents, packed.

    docs: (doc_id long, text string). ids: the piece's token ids, 32 bits each, little-endian. A
    document is its ids, then end_id. Each worker cuts its documents (see cut) and numbers the pieces
    of each class; the classes' counts by worker give every piece its bin and place without moving a
    token. The pieces that are left when the last bin of a class isn't full are fewer than the bins'
    counts, a bound that doesn't depend on the data (under 22,000 for 4096 and 64); they are laid end
    to end and cut at sequence ends, the last sequences being powers of two, so that they need no padding.

    Null and empty texts are end_id alone. A null doc_id stays null. Repeated rows are packed each.
    Empty input gives an empty result."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens.of(tokenizer, end_id)
        worker, counts = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

        def pieces(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
            tokens, tokens_of = words.encode(texts)
            own = [_cut(n, capacity, smallest) for n in tokens_of.tolist()]
            size, kind = (np.concatenate([x[k] for x in own]) for k in (0, 1))
            doc = np.repeat(np.arange(len(own)), [len(x[0]) for x in own])
            ends = np.cumsum(size)
            order = np.argsort(kind, kind="stable")
            first = np.flatnonzero(np.diff(kind[order], prepend=-1))
            many = np.diff(np.r_[first, len(order)])
            nth = np.empty(len(order), np.int64)
            nth[order] = np.arange(len(order)) - np.repeat(first - counts[kind[order[first]]], many)
            counts[kind[order[first]]] += many
            data = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, 4 * ends].astype(np.int32)), pa.py_buffer(tokens.astype("<u4"))])
            start = ends - size - (np.cumsum(tokens_of) - tokens_of)[doc]
            columns = [ids.take(pa.array(doc)), start, size, tokens_of[doc], kind.astype(np.int32), np.full(len(size), worker, np.int32), nth, data]
            return pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema=PIECES_ARROW)

        for batch in batches:
            ids, texts = batch.column("doc_id"), pc.fill_null(batch.column("text"), "")
            upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + batch_bytes, side="right")))
                yield pieces(ids.slice(a, b - a), texts.slice(a, b - a))
                a = b

    table = keep(docs.select("doc_id", "text").mapInArrow(run, PIECES), "pieces")
    counts = table.groupBy("class", "worker").agg(F.count("*").alias("n"))
    before = keep(counts.select("class", "worker", (F.sum("n").over(Window.partitionBy("class").orderBy("worker")) - F.col("n")).alias("before"), "n"), "piece-counts")
    totals = {r["class"]: (r["n"], r["length"]) for r in table.groupBy("class").agg(F.count("*").alias("n"), F.max("length").alias("length")).collect()}  # a row a class
    first, base, left = {}, 0, 0
    for j, (n, length) in sorted(totals.items()):
        first[j] = base
        base += n // j
        left += (n % j) * length
    ends, at = [], 0  # where sequences of the rest end
    for size in [capacity] * (left // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if (left % capacity) >> b & 1]:
        at += size
        ends.append(at)
    of = lambda d: F.element_at(F.create_map(*[F.lit(x) for j, v in d.items() for x in (j, v)]), F.col("class")) if d else F.lit(0)
    placed = table.join(before.drop("n"), ["class", "worker"]).withColumn("g", F.col("before") + F.col("nth")).withColumn("full",
        of({j: n // j * j for j, (n, _) in totals.items()}).cast("long"))
    columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    whole = placed.where("g < full").withColumn("sequence_id", of(first).cast("long") + F.floor(F.col("g") / F.col("class"))).withColumn("offset",
        F.pmod("g", F.col("class").cast("long")) * F.col("length")).select(columns)
    if not ends:
        return whole
    rest = placed.where("g >= full").withColumn("x", F.sum("length").over(Window.orderBy("class", "g").rowsBetween(Window.unboundedPreceding, -1)))
    rest = rest.withColumn("x", F.coalesce("x", F.lit(0).cast("long")))
    bounds = F.array(*[F.struct(F.lit(n).cast("long").alias("q"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for n,
        (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True))])
    parts = rest.withColumn("s", F.explode(F.filter(bounds, lambda s: (s["b"] > F.col("x")) & (s["a"] < F.col("x") + F.col("length")))))
    skip = F.greatest(F.lit(0).cast("long"), F.col("s.a") - F.col("x"))
    size = F.least(F.col("x") + F.col("length"), F.col("s.b")) - F.col("x") - skip
    tail = parts.select("doc_id", (F.col("start") + skip).alias("start"), size.alias("length"), "doc_tokens",
        (F.lit(base).cast("long") + F.col("s.q")).alias("sequence_id"), (F.col("x") + skip - F.col("s.a")).alias("offset"),
            F.substring("ids", (4 * skip + 1).cast("int"), (4 * size).cast("int")).alias("ids"))
    return whole.unionByName(tail)


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    out = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Where each piece of all documents lies in the packed sequences; see pack for nulls, empty texts, repeats and empty tables."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL: dict[str, str] = {}
