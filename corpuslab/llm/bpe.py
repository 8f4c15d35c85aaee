"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding.

A text is cut by the vocabulary's pattern; each distinct word that a worker meets is encoded once: its bytes
are single-byte pieces, and the adjacent pair with the lowest rank (the leftmost on ties) is merged
until no pair has a rank. The ids of a text are its words' ids in order; decoding concatenates
the pieces of the ids.

The ranks reach the executors once per Python worker from the file's lines, which are bounded by the
vocabulary. The memory of encoded words is bounded by ``CACHE`` and starts anew when full; results do
not depend on it.

Defined results: a null text is empty; an empty text has no ids; text that looks like a special
token is ordinary text; a word of any length takes n log n steps.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import slices

#: Words whose ids a worker keeps; longer words than KEEP_BYTES are never kept.
CACHE, KEEP_BYTES = 300_000, 64


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks from a file of lines 'base64 rank'."""
    return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines.splitlines() if line)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: a fold over merges in rank order."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    return _merge_short(word, ranks) if len(word) <= KEEP_BYTES else _merge_long(word, ranks)


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Keeps the rank of every adjacent pair in a list and merges at its minimum."""
    rank, none = ranks.get, len(ranks) + 1
    pieces = [word[i: i + 1] for i in range(len(word))]
    pairs = [rank(word[i: i + 2], none) for i in range(len(word) - 1)]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        merged = pieces[i] = pieces[i] + pieces.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank(merged + pieces[i + 1], none)
        if i:
            pairs[i - 1] = rank(pieces[i - 1] + merged, none)
    return [ranks[p] for p in pieces]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold with the pairs in a heap; an entry whose pieces have changed is skipped."""
    n = len(word)
    ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i: i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if ends[i] else n
        if not ends[i] or j >= n or ends[j] != end:
            continue
        ends[i], ends[j], after[i] = end, 0, after[j]
        if after[i] < n:
            before[after[i]] = i
            k = after[i]
            if (r := ranks.get(word[i: ends[k]])) is not None:
                heapq.heappush(heap, (r, i, ends[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get(word[h: end])) is not None:
            heapq.heappush(heap, (r, h, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i: ends[i]]])
        i = after[i]
    return ids


class Codec:
    """Encoder and decoder of one Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.words = ranks, regex.compile(pattern).findall
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self.known: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        ids = array("I", merge_word(raw, self.ranks)).tobytes()
        if len(raw) <= KEEP_BYTES:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, word = self.known, self.word
        return b"".join([known.get(w) or word(w) for w in self.words(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=1)
def codec_of(vocabulary: bytes, pattern: str) -> Codec:
    """The codec of this Python worker, with the words that its earlier tasks have met."""
    return Codec(read_ranks(vocabulary), pattern)


def encode(docs: DataFrame, vocabulary: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): token ids of every whole text as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary, pattern)
        for batch in slices(batches):
            ids = [codec.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["key", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, ids binary").withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary: bytes, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, bytes): the concatenated pieces of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary, pattern)
        for batch in slices(batches):
            raw = [codec.decode(i.as_py() or b"") for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], ["key", "ids", "bytes"])

    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, "key long, ids binary, bytes binary").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, vocabulary: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, bytes): encoded, and decoded from the ids, by one worker with one vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary, pattern)
        for batch in slices(batches):
            ids = [codec.encode(t.as_py() or "") for t in batch.column(1)]
            raw = [codec.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(raw, pa.binary())], ["key", "ids", "bytes"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, ids binary, bytes binary").withColumnRenamed("key", key)


def digests(decoded: DataFrame, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256), and the ids if asked for."""
    return decoded.select(
        key, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"), *(["ids"] if keep_ids else []))
