"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.shared import ship

SPACE = "▁"


class Pieces:
    """A model's pieces, scores and byte pieces; encodes and decodes single texts."""

    def __init__(self, path: str, most: int = 300_000):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.byte_ids) < 256:
            raise ValueError("the model has no byte pieces for what its pieces don't cover")
        self.table = [b""] * n
        for b, i in self.byte_ids.items():
            self.table[i] = bytes([b])
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            piece = model.id_to_piece(i)
            self.table[i] = piece.replace(SPACE, " ").encode()
            self.automaton.add_word(piece, (i, model.get_score(i), len(piece)))
        self.automaton.make_automaton()
        self.unknown = min((model.get_score(i) for i in normal), default=0.0) - 10
        names = [model.id_to_piece(i) for i in normal]
        # No piece goes on into a space, and none holds a line end: then the best path of a text is made of
        # the best paths of its words, and words come again and again.
        bare = all(re.fullmatch(f"{SPACE}*[^{SPACE}]*", p) for p in names)
        lines = "\n" if bare and not any("\n" in p for p in names) else ""
        self.parts = re.compile(f"{lines}| *[^ {lines}]+| +" if lines else " *[^ ]+| +" if bare else r"(?s:.+)")
        self.most, self.known = most, {}

    def _viterbi(self, s: str) -> list[int]:
        # best sum and last step (length, piece) up to each position; a place that no piece ends at is a character of bytes
        n, unknown = len(s), self.unknown
        best, back, at = [0.0] * (n + 1), [(1, -1)] * (n + 1), -1
        for end, (i, score, size) in self.automaton.iter(s):
            while at < end:
                at += 1
                best[at + 1] = best[at] + unknown
            x, own = best[end + 1 - size] + score, back[end + 1]
            if x > best[end + 1] or (x == best[end + 1] and size > own[0]):
                best[end + 1], back[end + 1] = x, (size, i)
        out, at = [], n
        while at:
            size, i = back[at]
            out += [i] if i >= 0 else [self.byte_ids[b] for b in reversed(s[at - 1 : at].encode("utf-8", "surrogatepass"))]
            at -= size
        return out[::-1]

    def _word(self, raw: str) -> list[int]:
        marks = [self.byte_ids[b] for b in SPACE.encode()]
        out: list[int] = []
        for n, x in enumerate(raw.split(SPACE)):
            out += (marks if n else []) + self._viterbi(x.replace(" ", SPACE))
        return out

    def encode(self, text: str) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        known, out = self.known, []
        for part in self.parts.findall(" " + text) if text else ():
            own = known.get(part)
            if own is None:
                own = known[part] = self._word(part)
            out += own
        return np.array(out, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.table.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, model: str) -> DataFrame:
    """docs (doc_id, text) with ids binary (32 bits each, little-endian) in the text's place.

    The ids have the highest sum of piece scores; of equal sums the one whose last differing piece is
    longer. Spaces are the pieces' mark, one is put before the text; characters that no piece covers,
    and the mark itself in a text, are byte pieces at the model's least score less 10 a character.
    A null text has null ids, an empty text none. Other columns are dropped; repeated rows stand each."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(model)
        for whole in batches:
            for s in range(0, len(whole), 500):
                batch = whole.iloc[s : s + 500]
                yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"),
                    "ids": [pieces.encode(t).astype("<u4").tobytes() if isinstance(t, str) else None for t in batch["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded (doc_id, ids) with text added: exactly what encode was given."""
    ship(encoded.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(model)
        for whole in batches:
            for s in range(0, len(whole), 500):
                batch = whole.iloc[s : s + 500]
                yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": batch["ids"],
                    "text": [pieces.decode(np.frombuffer(x, "<u4")) if isinstance(x, bytes) else None for x in batch["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, ids binary, text string")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Per document: the ids' number and crc32, and the digest of the text that they decode to; a null text counts as empty."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = decode(encode(docs, model), model)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


SQL: dict[str, str] = {}
