"""Counts of greedy word pieces by a linear longest-match automaton."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from mktstream.llm.bpe import ByteBpe

CACHE_WORDS = 400_000
_loaded: dict[str, "PieceCounter"] = {}


class PieceCounter(dict):
    """A trie of the vocabulary with failure links and, at each link, the number of pieces it pops.

    A word is matched as a blank and its UTF-8 bytes, so pieces that begin words are those with a blank in
    front. Every byte is read once; no piece is built. A word that cannot be cut into pieces counts as one.
    As a dict it keeps the counts of words seen, at most CACHE_WORDS.
    """

    def __init__(self, pieces: Iterable[bytes]):
        super().__init__()
        goto: dict[int, int] = {}
        parent, byte, final = [0], [0], [False]
        for piece in pieces:
            v = 0
            for b in piece:
                u = goto.get(v << 8 | b)
                if u is None:
                    u = goto[v << 8 | b] = len(parent)
                    parent.append(v)
                    byte.append(b)
                    final.append(False)
                v = u
            if v:
                final[v] = True
        depth = [0] * len(parent)
        for v in range(1, len(parent)):
            depth[v] = depth[parent[v]] + 1
        fail, pops = [-1] * len(parent), [0] * len(parent)
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if final[v]:
                fail[v], pops[v] = 0, 1
                continue
            z, n = fail[parent[v]], pops[parent[v]]
            while z >= 0 and z << 8 | byte[v] not in goto:
                n += pops[z]
                z = fail[z]
            if z >= 0:
                fail[v], pops[v] = goto[z << 8 | byte[v]], n
        self.goto, self.fail, self.pops = goto, fail, pops

    @classmethod
    def load(cls, path: str) -> "PieceCounter":
        if path not in _loaded:
            bpe = ByteBpe.load(path)
            _loaded[path] = cls([s for s in bpe.strings if s and s.decode("utf-8", "replace") not in bpe.special])
        return _loaded[path]

    def count(self, data: bytes) -> int:
        goto, fail, pops = self.goto.get, self.fail, self.pops
        v = n = 0
        for b in data:
            u = goto(v << 8 | b)
            while u is None:
                n += pops[v]
                v = fail[v]
                if v < 0:
                    return 1
                u = goto(v << 8 | b)
            v = u
        while v:
            n += pops[v]
            v = fail[v]
            if v < 0:
                return 1
        return n

    def __missing__(self, word: bytes) -> int:
        n = self.count(b" " + word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


def token_counts(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words and n_tokens, the number of greedy longest-match pieces, for each row.

    Words are runs of other bytes than blanks (20, 09-0D). Null and empty texts have no words and no
    tokens. A row is counted by itself, so repeated rows and null identifiers do no harm; long texts are
    counted whole; an empty table gives no rows; further columns aren't read. There is no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceCounter.load(vocab)
        for batch in batches:
            words = [(v.as_py() or "").encode("utf-8", "replace").split() for v in batch.column(1)]
            tokens = [sum(map(pieces.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, words), pa.int64()), pa.array(tokens, pa.int64())], [id_col, "n_words", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_tokens bigint")
