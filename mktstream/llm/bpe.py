"""Byte-level BPE encoding and decoding.

Each pre-token is a doubly linked list of symbols; a priority queue holds the merge rank of every
neighbouring pair, and entries whose pair has changed since are skipped when they come up. Decoding
concatenates the byte strings of the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# The white space of Unicode and the pre-token pattern of byte-level BPE.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

CACHE_WORDS = 100_000
NONE = 1 << 30
_loaded: dict[str, "ByteBpe"] = {}


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, letter to byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe(dict):
    """A tokenizer read from a tokenizers JSON file; as a dict it keeps encoded pre-tokens.

    At most CACHE_WORDS are in the dict and as many in `older`, what the dict held when it was full last. A
    pre-token that is met again moves back from there, so frequent ones outlive the many that occur once.
    """

    def __init__(self, path: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in vocab}
        self.first = [0] * 256
        for token, data in raw.items():
            if len(data) == 1:
                self.first[data[0]] = vocab[token]
        self.merges: dict[int, int] = {}
        self.result: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 32 | vocab[b]] = rank
            self.result.append(vocab[a + b])
        self.byte_merges = [self.merges.get(x << 32 | y, NONE) for x in self.first for y in self.first]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = raw[token]
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.words = regex.compile(PATTERN)
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None

    @classmethod
    def load(cls, path: str) -> "ByteBpe":
        """One instance per process and file."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def __missing__(self, word: str) -> bytes:
        data = self.older.get(word)
        if data is None:
            data = b"".join([i.to_bytes(4, "little") for i in self.merge(word.encode())])
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = data
        return data

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token after all merges, lowest rank first and leftmost among equals.

        due[i] is the rank of the pair that begins at i now; a queue entry with another rank is stale.
        """
        n, first = len(data), self.first
        if n == 1:
            return [first[data[0]]]
        byte_merges, rank_of, result = self.byte_merges, self.merges.get, self.result
        due = [byte_merges[a << 8 | b] for a, b in zip(data, data[1:])]
        queue = [rank << 32 | i for i, rank in enumerate(due) if rank != NONE]
        symbols = [first[b] for b in data]
        if not queue:
            return symbols
        heapify(queue)
        due.append(NONE)
        following, preceding = list(range(1, n + 1)), list(range(-1, n))
        while queue:
            entry = heappop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            if due[i] != rank:
                continue
            j = following[i]
            k = following[i] = following[j]
            preceding[k] = i
            due[j] = NONE
            symbols[i] = merged = result[rank]
            if k < n:
                due[i] = rank = rank_of(merged << 32 | symbols[k], NONE)
                if rank != NONE:
                    heappush(queue, rank << 32 | i)
            else:
                due[i] = NONE
            h = preceding[i]
            if h >= 0:
                due[h] = rank = rank_of(symbols[h] << 32 | merged, NONE)
                if rank != NONE:
                    heappush(queue, rank << 32 | h)
        out, i = [], 0
        while i < n:
            out.append(symbols[i])
            i = following[i]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text, each as four bytes, little-endian. Strings of special tokens become their ids."""
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, self.words.findall(text)))
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out.append(b"".join(map(self.__getitem__, self.words.findall(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids as encode returns them; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """Encode every text and decode the ids again.

    Returns id_col and n_tokens, and with digests ids_sha256 and decoded_sha256, else ids (array of int) and
    round_trip (whether the decoded text is the text). A null text counts as empty: no ids. Repeated rows are
    encoded each; very long texts are encoded whole, in time that grows with their pre-tokens; of pairs that tie in rank the leftmost
    is merged first; an empty table gives no rows; other columns aren't read, so clashing names do no harm. There is no shuffle, and a lost
    task is redone from its input alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "round_trip"))]
    ends = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, round_trip boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(vocab)
        for batch in batches:
            encoded, checks = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                data = bpe.encode(text)
                decoded = bpe.decode(data)
                encoded.append(data)
                checks.append(hashlib.sha256(decoded.encode()).hexdigest() if digests else decoded == text)
            counts = pa.array([len(data) // 4 for data in encoded], pa.int64())
            if digests:
                ids = pa.array([hashlib.sha256(data).hexdigest() for data in encoded], pa.string())
            else:
                ends_at = np.cumsum([0, *(len(data) // 4 for data in encoded)])
                ids = pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.array(np.frombuffer(b"".join(encoded), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, ids, pa.array(checks, pa.string() if digests else pa.bool_())], names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, {ends}")


def decode(docs: DataFrame, vocab: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text, decoded from an array of ids; null ids give a null text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(vocab)
        for batch in batches:
            texts = [None if v is None else bpe.decode(np.array(v, "<i4").tobytes()) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return docs.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
