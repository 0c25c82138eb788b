"""Token counts of greedy word pieces in one pass, by a longest-match automaton."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.shared import ship

ROOT, INSIDE, NONE = 0, 1, -1


class LongestMatch:
    """A trie of the word-initial pieces and, from INSIDE, the others. Where a character has no way on,
    the failure link goes to the node for what is left when the longest pieces are popped, and
    popped says how many those are. So each character is read once and no piece is built."""

    def __init__(self, initial: Iterable[str], inner: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        whole: set[int] = set()
        for start, pieces in ((ROOT, initial), (INSIDE, inner)):
            for piece in pieces:
                at = start
                for c in piece:
                    to = self.next[at].get(c)
                    if to is None:
                        to = self.next[at][c] = len(self.next)
                        self.next.append({})
                    at = to
                if piece:
                    whole.add(at)
        self.fail, self.popped = [NONE] * len(self.next), [0] * len(self.next)
        queue = deque((at, c, to) for at in (ROOT, INSIDE) for c, to in self.next[at].items())
        while queue:
            at, c, to = queue.popleft()
            if to in whole:
                self.fail[to], self.popped[to] = INSIDE, 1
            else:
                z, n = self.fail[at], self.popped[at]
                while z != NONE and c not in self.next[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z != NONE:
                    self.fail[to], self.popped[to] = self.next[z][c], n
            queue.extend((to, x, y) for x, y in self.next[to].items())

    def count(self, word: str) -> int:
        """Pieces of the word; 0 if greedy matching gets stuck."""
        at, n = ROOT, 0
        for c in word:
            while c not in self.next[at]:
                if self.fail[at] == NONE:
                    return 0
                n += self.popped[at]
                at = self.fail[at]
            at = self.next[at][c]
        while at != INSIDE:
            if self.fail[at] == NONE:
                return 0
            n += self.popped[at]
            at = self.fail[at]
        return n


def vocabulary(model: str) -> tuple[list[str], list[str]]:
    """(word-initial, inner) pieces of a SentencePiece file: the first are those that begin with one mark."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
    return [p[1:] for p in names if p[0] == "▁" and len(p) > 1 and "▁" not in p[1:]], [p for p in names if "▁" not in p]


def token_counts(docs: DataFrame, model: str, most: int = 300_000) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of each row of docs (doc_id long, text string).

    Words are runs of `[^\\x20\\x09-\\x0D]`, as they are. A word is cut greedily: the longest initial
    piece, then the longest inner pieces; one that gets stuck is a single unknown token. Null and
    empty texts have zeros. A null doc_id stays null; repeated rows stand each; a word's count is
    remembered by the worker, up to so many words at a time. Empty input gives an empty result."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, known = LongestMatch(*vocabulary(model)), {}
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
                if len(known) > most:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = automaton.count(w.decode("utf-8", "surrogatepass"))
                counts = [known[w] for w in words]
                unknown = counts.count(0)
                rows.append((len(words), sum(counts) + unknown, unknown))
            frame = pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"], dtype="int64")
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield frame.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Word-piece counts of all documents; see token_counts for nulls, empty texts, repeats and empty tables."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


SQL: dict[str, str] = {}
