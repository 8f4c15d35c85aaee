"""Exact removal of repeated byte strings with enhanced suffix arrays over dealt segments.

A string of ``length`` bytes holds, among its grams of ``GRAM`` bytes, one with the least hash, its
anchor (the leftmost, if it occurs twice). Consecutive strings of a document with the anchor at the
same place form a segment, so equal strings lie in different segments with equal anchors:

1. Documents are cut into segments (about one per 35 bytes). A task first joins segments that are equal
   in anchor and bytes: the earliest stays, the others are repeated whole. So however often a text
   is copied, a task sends it once, and a group that meets in the shuffle has a row per task at most.
2. Of equal segments from different tasks the earliest stays, too. Only anchors whose segments differ
   in their bytes (at the edges of repeated passages) go on, with the bytes of their segments.
3. Segments are dealt by anchor and a suffix array is built over those of a block: suffixes
   with at least ``length`` bytes ahead, ordered by their first ``length`` bytes and then by what follows,
   with the common prefixes of neighbours. A stack scan walks the tree of common-prefix intervals;
   an interval whose occurrences differ in the byte to the left is a maximal repeat, and its group
   holds all its occurrences. All but the earliest occurrence of each group are repeated.

A repeat longer than a segment comes as a chain of overlapping groups, whose union is the same.

An anchor that holds more than ``HOT_SHARE`` of all segments (a line of a third of all documents) would
gather its different segments in one task. Such anchors are found by a first pass; there are
at most 2 / HOT_SHARE of them, so the list is sent to the tasks, and their segments are dealt string by
string, by the hash of ``length`` bytes, where equal strings join within each task again.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; repeated rows of one id
and text count as one document; a row without an id is not compared and loses nothing; an
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from corpuslab.llm.common import slices
from corpuslab.plans.scale import cut_lineage

LENGTH, GRAM = 100, 24
#: Text bytes that a task joins at a time, positions hashed at a time, bytes of a suffix array.
CHUNK, STEP, BLOCK = 8 << 20, 1 << 16, 1 << 19
#: An anchor is dealt string by string beyond this share of all segments, and this many of them.
HOT_SHARE, HOT_ROWS = 1e-5, 2_000
_ODD = [np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_PLACE = np.uint64((1 << 17) - 1)  # a place among the grams of a step
_LOW = (1 << 31) - 1  # a position is start << 31 | number of bytes


def cut_segments(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(start, stop, document, anchor) of the segments of documents that lie end to end in ``data``;
    ``bounds`` has each document's start and the end of the last."""
    n, width = len(data), length - GRAM + 1
    at, value, last = [], [], None
    for p in range(0, n - length + 1, STEP):
        q = min(p + STEP, n - length + 1)
        m = q - p + width - 1
        words = np.ndarray(m + GRAM - 8, "<u8", data, offset=p, strides=(1,)).copy()
        h = words[:m] * _ODD[0]
        for k in range(1, GRAM // 8):
            h += words[8 * k: 8 * k + m] * _ODD[k]
        h ^= h >> np.uint64(32)
        h *= _ODD[4]
        h ^= h >> np.uint64(29)
        least, span = (h & ~_PLACE) | np.arange(m, dtype=np.uint64), 1  # the leftmost of equal grams
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: span - width], least[width - span:])
        place = (least & _PLACE).astype(np.int64)
        change = np.flatnonzero(place[1:] != place[:-1]) + 1
        if last is None or place[0] + p != last:
            change = np.concatenate(([0], change))
        last = place[-1] + p
        at.append(change + p)
        value.append(h[place[change]])
    if not at:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty, empty
    at, value = np.concatenate(at), np.concatenate(value)
    start = np.union1d(at, bounds[:-1][bounds[:-1] <= n - length])
    anchor = value[np.searchsorted(at, start, "right") - 1]
    doc = np.searchsorted(bounds, start, "right") - 1
    stop = np.minimum(np.append(start[1:], n), bounds[doc + 1] - length + 1) + length - 1
    real = stop - start >= length
    return start[real], stop[real], doc[real], anchor[real].view(np.int64)


def _chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, data, bounds) of about ``limit`` bytes of texts each, in id order."""
    rows, held = [], 0
    for batch in slices(batches):
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            raw = text.as_py()
            if raw is None or not key.is_valid:
                continue
            raw = raw.encode("utf-8")
            rows.append((key.as_py(), raw))
            held += len(raw)
            if held >= limit:
                yield _laid(rows)
                rows, held = [], 0
    if rows:
        yield _laid(rows)


def _laid(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows.sort(key=lambda r: r[0])
    ids = np.array([r[0] for r in rows], dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum([len(r[1]) for r in rows]))).astype(np.int64)
    return ids, np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint8), bounds


def _windows(start: np.ndarray, stop: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, which segment) of every string of ``length`` bytes in the segments."""
    n = stop - start - length + 1
    of = np.repeat(np.arange(len(start)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[of], of


def _bodies(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the bytes of segments."""
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    out = np.empty(len(start), dtype=np.uint64)
    for at in range(0, len(start), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = [digest(view[s:e]) for s, e in zip(start[part].tolist(), stop[part].tolist(), strict=True)]
    return out.view(np.int64)


def _joined(anchor, body, doc, start, stop, own, ids):
    """Places of the earliest of equal segments, and the merged spans of the others. Segments are in
    order of their start in the chunk, ``own`` is their start in the document."""
    order = np.argsort(body, kind="stable")
    a, b = anchor[order], body[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (b[1:] != b[:-1]) | (a[1:] != a[:-1])
    first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    again = np.sort(order[~fresh & ((ids[doc[order]] != ids[doc[first]]) | (own[order] != own[first]))])
    kept = np.sort(order[fresh])
    d, s, e = doc[again], start[again], stop[again]
    begin = np.ones(len(d), dtype=bool)
    begin[1:] = (d[1:] != d[:-1]) | (s[1:] > np.maximum.accumulate(e)[:-1])
    begin = np.flatnonzero(begin)
    ends = np.maximum.reduceat(e, begin) if len(begin) else e
    return kept, d[begin], s[begin], ends


def _segment_rows(batches, length, hot):
    hot = np.array(sorted(hot), dtype=np.int64)
    for ids, data, bounds in _chunks(batches):
        start, stop, doc, anchor = cut_segments(data, bounds, length)
        if not len(start):
            continue
        if len(hot):
            place = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
            single = hot[place] == anchor
            s, of = _windows(start[single], stop[single], length)
            start, stop = np.concatenate((start[~single], s)), np.concatenate((stop[~single], s + length))
            anchor = np.concatenate((anchor[~single], np.zeros(len(s), dtype=np.int64)))
            doc = np.concatenate((doc[~single], doc[single][of]))
            order = np.argsort(start, kind="stable")
            start, stop, doc, anchor = start[order], stop[order], doc[order], anchor[order]
        body = _bodies(data, start, stop)
        anchor = np.where(anchor == 0, body, anchor)
        own = start - bounds[doc]
        kept, d, s, e = _joined(anchor, body, doc, start, stop, own, ids)
        pos = np.concatenate((own[kept] << 31 | (stop - start)[kept], (s - bounds[d]) << 31 | (e - s)))
        d = ids[d]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate((anchor[kept], d * np.int64(0x1E3779B97F4A7C15)))),
            pa.array(np.concatenate((body[kept], np.zeros(len(d), dtype=np.int64))),
                     mask=np.arange(len(kept) + len(d)) >= len(kept)),
            pa.array(np.concatenate((ids[doc[kept]], d))), pa.array(pos)], ["anchor", "body", "doc", "pos"])


def segments(docs: DataFrame, length: int = LENGTH, hot: Iterable[int] = ()) -> DataFrame:
    """(anchor, body, doc, pos): the earliest of a task's equal segments, by the hash of its bytes; a
    null body marks a span that repeats something earlier in the task. ``docs`` is (doc, content)."""
    hot = frozenset(hot)
    return docs.mapInArrow(lambda b: _segment_rows(b, length, hot), "anchor long, body long, doc long, pos long")


def hot_anchors(docs: DataFrame, length: int = LENGTH, share: float = HOT_SHARE) -> list[int]:
    """Anchors with more than ``share`` of all segments, where a chunk's equal segments count once. A
    chunk reports the anchors that are frequent in it and the number of its segments; at most
    2 / share rows can pass the final filter."""

    def run(batches):
        for _, data, bounds in _chunks(batches):
            start, stop, _, anchor = cut_segments(data, bounds, length)
            _, inverse, counts = np.unique(anchor, return_inverse=True, return_counts=True)
            often = np.flatnonzero(counts[inverse] >= max(4, share * len(anchor) / 2))
            different = np.unique(np.stack((anchor[often], _bodies(data, start[often], stop[often])), axis=1), axis=0)
            found, counts = np.unique(different[:, 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.append(found, 0)), pa.array(np.append(counts, len(anchor)))], ["anchor", "n"])

    counted = cut_lineage(docs.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")))
    total = counted.filter("anchor = 0").agg(F.sum("n")).first()[0] or 0
    return [r.anchor for r in counted.filter(
        (F.col("anchor") != 0) & (F.col("n") > max(HOT_ROWS, share * total / 2))).select("anchor").collect()]


class SuffixArray:
    """Suffixes of ``texts`` with at least ``length`` bytes ahead whose first ``length`` bytes occur
    twice, ordered by (hash of these bytes, what follows), with the common prefixes of neighbours.
    What lies before a text counts as different from all others."""

    def __init__(self, texts: list[bytes], length: int):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        long = np.flatnonzero(sizes >= length)
        at, of = _windows(bounds[long], bounds[long] + sizes[long], length)
        of, raw = long[of], b"".join(texts)
        digest, view = xxhash.xxh3_64_intdigest, memoryview(raw)
        head = np.fromiter((digest(view[p: p + length]) for p in at.tolist()), dtype=np.uint64, count=len(at))
        _, inverse, counts = np.unique(head, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        at, of, group = at[twice], of[twice], inverse[twice].tolist()
        tails = [raw[p + length: q] for p, q in zip(at.tolist(), bounds[of + 1].tolist(), strict=True)]
        order = sorted(range(len(at)), key=lambda i: (group[i], tails[i]))
        self.text, self.start = of[order].tolist(), (at - bounds[of])[order].tolist()
        self.left = [
            raw[p - 1] if s else -1 - t for p, s, t in zip(at[order].tolist(), self.start, self.text, strict=True)]
        self.common = [0]
        for i, j in zip(order, order[1:], strict=False):
            self.common.append(length + _shared(tails[i], tails[j]) if group[i] == group[j] else 0)

    def intervals(self) -> Iterator[tuple[int, int, int, bool]]:
        """(depth, first, end, maximal) of every common-prefix interval, inner before outer, by one scan
        with a stack; maximal if its occurrences differ in the byte to the left."""
        many, n = object(), len(self.text)
        stack: list[list] = [[0, 0, many]]
        for k in range(1, n + 1):
            depth = self.common[k] if k < n else 0
            first, byte = k - 1, self.left[k - 1]
            while stack[-1][0] > depth:
                deep, first, inside = stack.pop()
                byte = inside if inside == byte else many
                yield deep, first, k, byte is many
            if stack[-1][0] < depth:
                stack.append([depth, first, byte])
            elif stack[-1][2] != byte:
                stack[-1][2] = many


def _shared(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return int((np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)).argmax())


def maximal_repeats(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, list]]:
    """(bytes, [(text, start)]) of all maximal repeats of at least ``length`` bytes: strings with two
    occurrences or more that are not all continued by the same byte on the left or on the right."""
    array = SuffixArray(texts, length)
    return [(depth, list(zip(array.text[first:end], array.start[first:end], strict=True)))
            for depth, first, end, maximal in array.intervals() if maximal]


def repeated_spans(texts: list[bytes], places: list[tuple[int, int]], length: int) -> Iterator[tuple]:
    """(document, start, end) of all but the earliest occurrence of each maximal repeat; ``places`` has
    (document, start) of each text. An occurrence is written with its longest repeat only: what
    an interval has not written is handed to the interval around it."""
    array = SuffixArray(texts, length)
    where = [(places[t][0], places[t][1] + s) for t, s in zip(array.text, array.start, strict=True)]
    waiting: list[tuple[int, int, list[int]]] = []  # (first, end, not yet written) of closed intervals
    for depth, first, end, maximal in array.intervals():
        rest, open_to = [], end
        while waiting and waiting[-1][0] >= first:
            begin, stop, inner = waiting.pop()
            rest.extend(range(stop, open_to))
            rest, inner = (inner, rest) if len(inner) > len(rest) else (rest, inner)
            rest.extend(inner)
            open_to = begin
        rest.extend(range(first, open_to))
        if maximal:
            least = min(rest, key=where.__getitem__)
            for k in rest:
                if where[k] != where[least]:
                    yield where[k][0], where[k][1], where[k][1] + depth
            rest = [least]
        waiting.append((first, end, rest))


def _edge_rows(batches, length):
    """Spans from segments that arrive in anchor order; a suffix array covers whole anchors."""

    def spans(rows):
        found = list(repeated_spans([r[2] for r in rows], [r[:2] for r in rows], length))
        columns = zip(*found, strict=True) if found else ([], [], [])
        doc, start, end = (np.array(c, dtype=np.int64) for c in columns)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start << 31 | (end - start))], ["doc", "pos"])

    rows, held, last = [], 0, None
    for batch in slices(batches, 4096):
        for anchor, doc, pos, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if anchor != last and held >= BLOCK:
                yield spans(rows)
                rows, held = [], 0
            rows.append((doc, pos >> 31, raw))
            held += len(raw)
            last = anchor
    if rows:
        yield spans(rows)


def _edge_bytes(batches):
    """The bytes of the named segments of each document."""
    for batch in slices(batches):
        out = []
        for doc, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = (text or "").encode("utf-8")
            for w in wanted:
                start, n = w["pos"] >> 31, w["pos"] & _LOW
                out.append((w["anchor"], doc, w["pos"], raw[start: start + n]))
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([
                *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], ["anchor", "doc", "pos", "raw"])


def _keyed(docs: DataFrame, key: str, text: str, carry: Sequence[str] = ()) -> DataFrame:
    """The texts by id. Both joins on the id read this under the same new names, so that Spark finds
    their shuffles of the texts equal and makes one."""
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("content"), *carry).filter("doc is not null")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc, cuts): for each document with a repeated string, the spans to remove as an array of
    positions ``start << 31 | bytes``; they may overlap."""
    plain = _keyed(docs, key, text)
    found = segments(plain, length, hot_anchors(plain, length))
    equal = W.Window.partitionBy("anchor", "body").orderBy("doc", F.shiftright("pos", 31))
    ranked = found.withColumn("_place", F.dense_rank().over(equal)).withColumn(
        "_low", F.min("body").over(W.Window.partitionBy("anchor"))).withColumn(
        "_high", F.max("body").over(W.Window.partitionBy("anchor")))
    gone = F.col("body").isNull() | (F.col("_place") > 1)
    edge = ~gone & (F.col("_low") != F.col("_high"))
    marked = ranked.filter(gone | edge).groupBy("doc").agg(
        F.collect_list(F.when(gone, F.col("pos"))).alias("cuts"),
        F.collect_set(F.when(edge, F.struct("anchor", "pos"))).alias("edges"))
    marked = cut_lineage(marked)
    edges = plain.join(marked.filter(F.size("edges") > 0).select("doc", "edges"), "doc")
    dealt = edges.mapInArrow(_edge_bytes, "anchor long, doc long, pos long, raw binary")
    dealt = dealt.repartition("anchor").sortWithinPartitions("anchor", "doc", "pos")
    more = dealt.mapInArrow(lambda b: _edge_rows(b, length), "doc long, pos long")
    cuts = marked.select("doc", F.explode("cuts").alias("pos")).unionByName(more)
    return cuts.groupBy("doc").agg(F.collect_set("pos").alias("cuts"))


def merged(cuts: list[int] | None, n: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes in a text of ``n`` bytes."""
    out: list[list[int]] = []
    for start, end in sorted((c >> 31, min((c >> 31) + (c & _LOW), n)) for c in cuts or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        elif start < end:
            out.append([start, end])
    return [tuple(x) for x in out]


def remove_repeats(
    docs: DataFrame, cuts: DataFrame, key: str = "doc_id", text: str = "text", carry: Sequence[str] = (),
) -> DataFrame:
    """Per input row: key, the columns of ``carry``, the remaining text, n_bytes, n_removed, n_spans and
    kept_sha256 of the remaining bytes. A cut may split a character; the text leaves such bytes out."""
    made = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in slices(batches):
            rows = []
            for raw, spans in zip(*(batch.column(c).to_pylist() for c in ("content", "cuts")), strict=True):
                raw = (raw or "").encode("utf-8")
                runs = merged(spans, len(raw))
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                digest = hashlib.sha256(kept).hexdigest()
                rows.append((kept.decode("utf-8", "ignore"), len(raw), len(raw) - len(kept), len(runs), digest))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([
                batch.column("doc"), *(batch.column(c) for c in carry),
                *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [key, *carry, *made])

    rows = _keyed(docs, key, text, carry).join(cuts, "doc", "left")
    idless = docs.filter(F.col(key).isNull()).select(
        F.lit(None).cast("long").alias("doc"), F.col(text).cast("string").alias("content"), *carry).withColumn(
        "cuts", F.lit(None).cast("array<bigint>"))
    rows = rows.select("doc", "content", *carry, "cuts").unionByName(idless)
    fields = [rows.schema[c] for c in carry]
    schema = T.StructType([T.StructField(key, T.LongType()), *fields, *(
        T.StructField(c, T.StringType() if t == pa.string() else T.LongType()) for c, t in zip(made, types, strict=True))])
    return rows.mapInArrow(run, schema)
