"""Repeated byte strings across documents, by deep-shallow suffix sorting."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barlab.llm.lm import planes, unplanes
from barlab.llm.shared import by_sorted_group, empty, keep, ship

#: Bytes of an anchor: every string that is looked for holds the anchor of least hash in it.
ANCHOR = 16
#: Places of an anchor in its string that one part of a hot anchor's runs takes.
WIDTH = 5
#: Starts of strings whose anchors are found at once, and the bits that hold a place among them and the strings' rest.
BLOCK = 2**16
PLACES = np.uint64(2 * BLOCK - 1)
#: Bytes that the shallow sort looks at: eight at once, then five at a time beside the group's number.
SHALLOW = 13
LAST = np.iinfo(np.int64).max
OUT = "doc_id long, n_bytes long, removed array<struct<start:long,length:long>>, kept binary"
CHUNKS = pa.schema([("chunk", pa.int64()), ("slice", pa.int64()), *[(c, pa.binary()) for c in ("texts", "lengths", "ids", "rest", "hashes", "several")]])
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def words_at(buffer: bytes) -> np.ndarray:
    """The eight bytes from each place on, as a number whose order is theirs; zeros follow the end."""
    return np.ndarray((len(buffer),), ">u8", buffer + bytes(8), strides=(1,)).astype(np.uint64)


def equal_before(x: np.ndarray) -> np.ndarray:
    """Leading bytes of the eight in which two words agree, from their exclusive or."""
    return sum((x < np.uint64(1 << (8 * j))).astype(np.int64) for j in range(1, 8))


def refined(group: np.ndarray, key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, first-of-group flags) of rows sorted by group, then by a key of so many bits; rows come in the order of their groups."""
    dense = np.cumsum(np.r_[False, group[1:] != group[:-1]]).astype(np.uint64)
    if int(dense[-1]) >> (64 - bits):
        order = np.lexsort((key, dense))
    else:
        # one sort of group and key together
        order = np.argsort((dense << np.uint64(bits) if bits < 64 else np.uint64(0)) | key.astype(np.uint64))
    g, k = dense[order], key[order]
    return order, np.r_[True, (g[1:] != g[:-1]) | (k[1:] != k[:-1])]


def deep_shallow(buffer: bytes, suffixes: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of their first length bytes, the number of each one's group of equals).

    Shallow: multikey quicksort splits the groups several bytes at a time down to the shallow depth.
    Deep: each remaining group of long common prefixes is put in a blind trie, all groups at once and
    level by level: a node skips to the first byte in which any member leaves the node's first member
    and branches on that byte only."""
    word = words_at(buffer)
    raw = np.frombuffer(buffer, np.uint8)
    order = np.asarray(suffixes, np.int64).copy()
    group = np.zeros(len(order), np.int64)
    if not len(order):
        return order, group
    open_ = np.arange(len(order))

    def split(rows: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
        moved, first = refined(group[rows], key, bits)
        order[rows] = order[rows[moved]]
        starts = np.flatnonzero(first)
        group[rows] = np.repeat(rows[starts], np.diff(np.r_[starts, len(rows)]))
        size = np.diff(np.r_[starts, len(rows)])
        return rows[np.repeat(size > 1, size)]

    depth, shallow = 0, min(shallow, length)
    while depth + (step := 8 if depth == 0 else 5) <= shallow:
        if len(open_):
            open_ = split(open_, word[order[open_] + depth] >> np.uint64(64 - 8 * step), 8 * step)
        depth += step
    shallow = depth
    while len(open_):
        starts = np.flatnonzero(np.r_[True, np.diff(group[open_]) != 0])
        node = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(open_)]))
        own, leader = order[open_], order[open_[starts]][node]
        agree = np.full(len(own), length)
        for depth in [length - 8, *range(shallow + (length - shallow) // 8 * 8 - 8, shallow - 1, -8)] if length >= 8 + shallow else []:
            x = word[own + depth] ^ word[leader + depth]
            differ = np.flatnonzero(x)
            agree[differ] = depth + equal_before(x[differ])
        if length < 8 + shallow:
            for depth in range(length - 1, shallow - 1, -1):
                agree = np.where(raw[own + depth] != raw[leader + depth], depth, agree)
        skip = np.minimum.reduceat(agree, starts)
        live = skip[node] < length
        open_ = open_[live]
        if len(open_):
            open_ = split(open_, raw[order[open_] + skip[node][live]], 8)
    return order, group


def spread(h: np.ndarray) -> np.ndarray:
    """48 bits of each hash, mixed again: anchors are the least hashes near them."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(16)


def anchors(buffer: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first start, last start, the anchor's place, its hash) of each run of strings that have one anchor.

    ends: where documents end in the buffer. Every string of length bytes within a document belongs
    to one run; its anchor is the leftmost of least hash (the bits above PLACES), so equal strings have it at one place."""
    n, span = len(buffer), length - ANCHOR + 1
    none, many = np.zeros(0, np.int64), n - length + 1
    if many < 1:
        return none, none, none, none, none.astype(np.uint64)
    at, hashed = np.empty(many, np.int64), np.empty(n - ANCHOR + 1, np.uint64)
    # in blocks that stay in the processor's cache
    for a in range(0, many, BLOCK):
        b = min(many, a + BLOCK)
        word = words_at(buffer[a : b + length - 1])
        size = b - a + span - 1
        with np.errstate(over="ignore"):
            h = word[:size] * np.uint64(0x9E3779B97F4A7C15)
            h ^= (word[8 : size + 8] ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        hashed[a : a + size] = h
        # the place in the low bits: one minimum finds the least of the other bits, and the leftmost of equals
        low, have = (h & ~PLACES) | np.arange(size, dtype=np.uint64), 1
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        at[a:b] = (low & PLACES).astype(np.int64) + a
    starts = np.r_[0, ends[:-1]]
    # the last length - 1 bytes of a document start no string of its own
    short = ends[:, None] - np.arange(1, length)
    valid = np.ones(many, bool)
    short = short[short >= starts[:, None]]
    valid[short[short < many]] = False
    head = np.r_[True, at[1:] != at[:-1]]
    head[starts[starts < many]] = True
    first = np.flatnonzero(head & valid)
    last = np.flatnonzero(valid & np.r_[head[1:] | ~valid[1:], True])
    return np.searchsorted(ends, first, side="right"), first, last, at[first], spread(hashed[at[first]])


class Chunk:
    """Some documents in one buffer, and where their strings' anchors are."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, length: int):
        self.buffer, self.ids = b"".join(texts), ids
        self.ends = np.cumsum([len(t) for t in texts])
        self.doc, self.low, self.high, self.place, self.hash = anchors(self.buffer, self.ends, length)
        self.unique, self.at = np.unique(self.hash, return_inverse=True)
        self.length = length

    def parts(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(run, first start, last start, hash) of the runs at hot anchors, cut by the anchor's place in the string, five places a part.

        The strings of a part have length - 4 bytes in common places, all but the four at either end that not all of them hold; these are hashed, so that a
        phrase in every document is as many groups as there are texts around it."""
        runs = np.flatnonzero(hot[self.at])
        none = np.zeros(0, np.int64)
        found = [(none, none, none, none.astype(np.uint64))]
        for k in range((self.length - ANCHOR) // WIDTH + 1):
            low, high = np.maximum(self.low[runs], self.place[runs] - WIDTH * k - WIDTH + 1), np.minimum(self.high[runs], self.place[runs] - WIDTH * k)
            there = low <= high
            begin = (self.place[runs] - WIDTH * k)[there]
            same = [xxhash.xxh64_intdigest(self.buffer[a : a + self.length - WIDTH + 1], seed=k) for a in begin.tolist()]
            found.append((runs[there], low[there], high[there], spread(np.array(same, np.uint64))))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def contexts(self, shared: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Of runs whose anchor is shared, those at hot ones in parts: (run, first start, last start, context of each, the contexts, their least id, their hash), contexts by hash."""
        plain = np.flatnonzero((shared & ~hot)[self.at])
        runs, low, high, hashed = (np.concatenate(x) for x in zip((plain, self.low[plain], self.high[plain], self.hash[plain]), self.parts(hot), strict=True))
        order = np.argsort(hashed, kind="stable")
        runs, low, high, hashed = runs[order], low[order], high[order], hashed[order]
        number: dict = {}
        texts: Iterable = (self.buffer[a:b] for a, b in zip(low.tolist(), (high + self.length).tolist(), strict=True))
        # equal bytes at two places of a hot anchor are two contexts
        own = np.array([number.setdefault(x, len(number)) for x in (zip(texts, hashed.tolist(), strict=True) if hot.any() else texts)], np.int64)
        least, hashes = np.full(len(number), LAST), np.zeros(len(number), np.uint64)
        np.minimum.at(least, own, self.ids[self.doc[runs]])
        hashes[own] = hashed
        return runs, low, high, own, [x for x, _ in number] if hot.any() else list(number), least, hashes

    def covered(self, shared: np.ndarray, hot: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Whether each byte is in a string that starts in a smaller document too."""
        runs, low, high, own, _, least, _ = self.contexts(shared, hot)
        change = np.zeros(len(self.buffer) + self.length + 1, np.int64)
        whole = self.ids[self.doc[runs]] > least[own]
        np.add.at(change, low[whole], 1)
        np.add.at(change, high[whole] + self.length, -1)
        part = np.flatnonzero(~whole & (masks[own] != 0))
        for bit in range(self.length - ANCHOR + 1):
            use = part[(masks[own[part]] >> bit) & 1 == 1]
            np.add.at(change, low[use] + bit, 1)
            np.add.at(change, low[use] + bit + self.length, -1)
        return np.cumsum(change)[: len(self.buffer)] > 0


def smaller_masks(contexts: Iterable[bytes], told: np.ndarray, length: int) -> np.ndarray:
    """For each context, with the least id that its chunk told: bit n is set if its n-th string of length bytes is in some context of a smaller id.

    Equal contexts, as several chunks have them, are sorted once, for the least of their ids."""
    number: dict = {}
    same = np.array([number.setdefault(x, len(number)) for x in contexts], np.int64)
    buffer, size, least = b"".join(number), np.array([*map(len, number)], np.int64), np.full(len(number), LAST)
    np.minimum.at(least, same, told)
    count = size - length + 1
    of = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    place = np.cumsum(size) - size
    order, equal = deep_shallow(buffer, place[of] + nth, length)
    back = np.empty(len(buffer), np.int64)
    back[place[of] + nth] = np.arange(len(of))
    row = back[order]
    heads = np.flatnonzero(np.r_[True, equal[1:] != equal[:-1]])
    best = np.repeat(np.minimum.reduceat(least[of[row]], heads), np.diff(np.r_[heads, len(row)]))
    masks = np.zeros(len(size), np.int64)
    smaller = row[best < least[of[row]]]
    np.bitwise_or.at(masks, of[smaller], np.int64(1) << nth[smaller])
    # where a smaller id has the whole context it has all its strings
    return np.where(told > least[same], (np.int64(1) << count[same]) - 1, masks[same])


def repeated_strings(docs: DataFrame, length: int = 50, whole_characters: bool = False, chunk_bytes: int = 2_000_000, slice_bytes: int = 6_000_000,
    sorted_bytes: int = 4_000_000, hot_runs: int = 200_000) -> DataFrame:
    """Per row of docs (doc_id long, text string, rest of any type): doc_id, n_bytes, the removed spans, the kept bytes, and rest as it was.

    Removed is each byte covered by a string of length bytes (25 to 78) that also starts in a document
    with a smaller doc_id, judged on the input; strings never cross documents. whole_characters shrinks
    the spans to whole characters of UTF-8, so that what is kept is text.

    Tasks write chunks of documents and ask which anchors (see anchors) other documents have too; the
    answers come from ranges of the hash. Runs of strings at shared anchors, each distinct one once a
    chunk, are then dealt out by anchor and sorted there (deep_shallow), and each chunk learns which
    strings a smaller document has. A string in a third of all documents thus counts once a chunk. An anchor with about
    hot_runs runs or more in all chunks is dealt out by the bytes around it, too (Chunk.parts), so no task sorts all that holds one phrase.

    Null text is empty. A null doc_id stands beside the largest possible one, after all others. Rows with one doc_id do not remove from
    each other. Texts shorter than length lose nothing. Empty input gives an empty result."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text", "rest")
    out_schema = StructType([*StructType.fromDDL(OUT).fields, docs.schema["rest"]])
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # ranges of hashes that are matched, and the finer ones in which strings are sorted
    bits, fine = (min(40, max(2, math.ceil(math.log2(1 + size / n)))) for n in (slice_bytes, sorted_bytes))

    def slices(hashes: np.ndarray, bits: int = bits) -> tuple[np.ndarray, np.ndarray]:
        part = (hashes >> np.uint64(48 - bits)).astype(np.int64)
        return part, np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)] if len(part) else np.zeros(1, np.int64)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, rests, nulls, n = [], [], [], [], 0
        # written once and shuffled twice, so worth the effort of a higher level
        squeeze = zstandard.ZstdCompressor(level=5)

        def flush() -> pa.RecordBatch:
            own = Chunk(texts, np.concatenate(ids), length)
            number = uuid.uuid4().int >> 65
            rest = pa.concat_arrays(rests)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("rest", rest.type), ("none", pa.bool_())])) as out:
                out.write_batch(pa.record_batch([rest, pa.concat_arrays(nulls)], names=["rest", "none"]))
            rows = [{"chunk": number, "slice": -1, "texts": squeeze.compress(own.buffer), "lengths": planes(np.diff(own.ends, prepend=0)),
                "ids": planes(own.ids), "rest": squeeze.compress(sink.getvalue())}]
            ids_at = own.ids[own.doc]
            low, high = np.full(len(own.unique), LAST), np.full(len(own.unique), -LAST)
            np.minimum.at(low, own.at, ids_at)
            np.maximum.at(high, own.at, ids_at)
            part, cuts = slices(own.unique)
            power = np.frexp(np.bincount(own.at, minlength=len(own.unique)).astype(np.float64))[1] - 1
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                # how many runs, as a power of two, and whether in several documents
                rows.append({"chunk": number, "slice": int(part[a]), "hashes": planes(np.diff(own.unique[a:b], prepend=np.uint64(0))),
                    "several": squeeze.compress((2 * power[a:b] + (low[a:b] < high[a:b])).astype(np.uint8).tobytes())})
            return pa.RecordBatch.from_pylist(rows, schema=CHUNKS)

        for batch in batches:
            raw = batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
            own = batch.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)
            begin = 0
            for k, text in enumerate(raw):
                texts.append(text)
                n += len(text) + 64
                if n >= chunk_bytes or k + 1 == len(raw):
                    ids.append(own[begin : k + 1])
                    rests.append(batch.column("rest").slice(begin, k + 1 - begin))
                    nulls.append(batch.column("doc_id").slice(begin, k + 1 - begin).is_null())
                    begin = k + 1
                if n >= chunk_bytes:
                    yield flush()
                    texts, ids, rests, nulls, n = [], [], [], [], 0
        if texts:
            yield flush()

    table = keep(docs.mapInArrow(read, "chunk long, slice long, texts binary, lengths binary, ids binary, rest binary, hashes binary, several binary"), "suffix-chunks")
    payloads = table.where("slice = -1").select("chunk", "texts", "lengths", "ids", "rest")
    chunks = payloads.count()
    if not chunks:
        return empty(spark, out_schema)
    grouped = max(12, chunks // 4)

    def shared(group: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.cumsum(unplanes(x, np.uint64), dtype=np.uint64) for x in group["hashes"]]
        loose = zstandard.ZstdDecompressor()
        several = np.concatenate([np.frombuffer(loose.decompress(s), np.uint8) for s in group["several"]])
        _, at = np.unique(np.concatenate(hashes), return_inverse=True)
        yes = (np.bincount(at) + np.bincount(at, weights=several & 1) > 1)[at]
        hot = yes & (np.bincount(at, weights=np.left_shift(np.int64(1), (several >> 1).astype(np.int64))) > hot_runs)[at]
        cuts = np.cumsum([0, *map(len, hashes)])
        bits = lambda x: [np.packbits(x[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pd.DataFrame({"chunk": group["chunk"].to_numpy(), "slice": group["slice"].to_numpy(), "told": bits(yes), "hot": bits(hot) if hot.any() else None})

    flags = keep(by_sorted_group(table.where("slice >= 0").select("chunk", "slice", "hashes", "several"), ["slice"], shared,
        "chunk long, slice long, told binary, hot binary", max(12, 2**bits // 2)), "suffix-shared")

    def opened(group: pd.DataFrame) -> tuple[pd.Series, Chunk, np.ndarray, np.ndarray]:
        own = group[group["texts"].notna()].iloc[0]
        ends = np.cumsum(unplanes(own["lengths"], np.int64))
        whole = zstandard.ZstdDecompressor().decompress(own["texts"])
        chunk = Chunk([whole[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)], unplanes(own["ids"], np.int64), length)
        told = group[group["told"].notna()].sort_values("slice")
        _, cuts = slices(chunk.unique)
        flags = [np.zeros(0, np.uint8)], [np.zeros(0, np.uint8)]
        for t, h, a, b in zip(told["told"], told["hot"], cuts[:-1], cuts[1:], strict=True):
            flags[0].append(np.unpackbits(np.frombuffer(t, np.uint8), count=b - a))
            flags[1].append(np.zeros(b - a, np.uint8) if h is None else np.unpackbits(np.frombuffer(h, np.uint8), count=b - a))
        return own, chunk, *(np.concatenate(x).astype(bool) for x in flags)

    def candidates(group: pd.DataFrame) -> pd.DataFrame:
        own, chunk, yes, hot = opened(group)
        *_, contexts, least, hashes = chunk.contexts(yes, hot)
        part, cuts = slices(hashes, fine)
        squeeze, rows = zstandard.ZstdCompressor(level=3), []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows.append((own["chunk"], int(part[a]), squeeze.compress(b"".join(contexts[a:b])), np.array([len(c) for c in contexts[a:b]], np.uint8)
                .tobytes(), planes(least[a:b])))
        return pd.DataFrame(rows, columns=["chunk", "slice", "contexts", "lengths", "least"])

    def sorted_slice(group: pd.DataFrame) -> pd.DataFrame:
        loose = zstandard.ZstdDecompressor()
        sizes = [np.frombuffer(x, np.uint8).astype(np.int64) for x in group["lengths"]]
        told = np.concatenate([unplanes(x, np.int64) for x in group["least"]])

        def texts() -> Iterator[bytes]:
            for whole, own in zip(group["contexts"], sizes, strict=True):
                text, ends = loose.decompress(whole), np.cumsum(own)
                yield from (text[a:b] for a, b in zip((ends - own).tolist(), ends.tolist(), strict=True))

        masks = smaller_masks(texts(), told, length)
        cuts = np.cumsum([0, *map(len, sizes)])
        return pd.DataFrame({"chunk": group["chunk"].to_numpy(), "slice": group["slice"].to_numpy(),
            "masks": [planes(masks[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})

    with_flags = payloads.unionByName(flags, allowMissingColumns=True)
    asked = by_sorted_group(with_flags, ["chunk"], candidates, "chunk long, slice long, contexts binary, lengths binary, least binary", grouped)
    masks = keep(by_sorted_group(asked, ["slice"], sorted_slice, "chunk long, slice long, masks binary", max(12, 2**fine // 4)), "suffix-masks")

    def cut(group: pd.DataFrame) -> pa.RecordBatch:
        own, chunk, yes, hot = opened(group)
        told = group[group["masks"].notna()].sort_values("slice")
        gone = chunk.covered(yes, hot, np.concatenate([unplanes(x, np.int64) for x in told["masks"]]) if len(told) else np.zeros(0, np.int64))
        carried = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(own["rest"])).read_next_batch()
        raw = np.frombuffer(chunk.buffer, np.uint8)
        spans, kept, begin = [], [], 0
        for end in chunk.ends.tolist():
            text, out = raw[begin:end], gone[begin:end]
            edge = np.diff(np.r_[0, out.astype(np.int8), 0])
            starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            if whole_characters and len(starts):
                heads = np.r_[np.flatnonzero((text & 0xC0) != 0x80), len(text)]
                starts, stops = heads[np.searchsorted(heads, starts)], heads[np.searchsorted(heads, stops, side="right") - 1]
                starts, stops = starts[starts < stops], stops[starts < stops]
                out = np.zeros(len(text), bool)
                for a, b in zip(starts, stops, strict=True):
                    out[a:b] = True
            spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(starts, stops, strict=True)])
            kept.append(text[~out].tobytes())
            begin = end
        none = carried.column("none").to_numpy(zero_copy_only=False)
        columns = [pa.array(chunk.ids, mask=none), pa.array(np.diff(chunk.ends, prepend=0)), pa.array(spans, SPANS), pa.array(kept, pa.binary()), carried.column("rest")]
        return pa.record_batch(columns, names=["doc_id", "n_bytes", "removed", "kept", "rest"])

    return by_sorted_group(with_flags.unionByName(masks, allowMissingColumns=True), ["chunk"], cut, out_schema, grouped, arrow=True)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What 50-byte strings of smaller documents cover in all documents; see repeated_strings for nulls, short texts, repeats and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit(None).cast("string").alias("rest"))
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return repeated_strings(docs, 50).select("doc_id", "n_bytes", total.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


SQL = {
    "op2_suffix_dedup": """
WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
grams AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS g FROM (SELECT doc_id, h, unnest(range(greatest(0, length(h) // 2 - 49))) AS i FROM hexed)),
firsts AS (SELECT g, min(doc_id) AS m FROM grams GROUP BY g HAVING min(doc_id) < max(doc_id)),
starts AS (SELECT doc_id, i FROM grams JOIN firsts USING (g) WHERE m < doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 50 THEN 0 ELSE 1 END AS fresh FROM starts WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL SELECT s.doc_id, max(s.b), max(length(h.h) // 2) FROM spans s JOIN hexed h USING (doc_id) GROUP BY s.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h.h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (y - x) AS BIGINT)), '' ORDER BY x) AS k FROM gaps JOIN hexed h USING (doc_id) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n, sum(b - a) AS removed FROM spans GROUP BY doc_id)
SELECT h.doc_id, CAST(length(h.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(c.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k.k, h.h))) AS kept_sha256
FROM hexed h LEFT JOIN counted c USING (doc_id) LEFT JOIN kept k USING (doc_id)"""
}
