"""Fill-in-the-middle transformation of whole texts by displacement scatter, and its inverse.

A text of n code points is cut at two drawn places into prefix, middle and suffix. The rearranged
output of a whole Arrow batch is one buffer: every segment moves by one displacement, the differences
of displacements at the cuts go into a difference array over the batch's bytes, their running sum is the
shift of each byte, and one numpy scatter writes all bytes at their places. The inverse reads the places
of the three marks in the output, builds the same kind of array for the source of each restored byte
and gathers. Cuts are scanned as code points: the r-th start byte of the batch is the r-th code point.

The draws come from the sha256 of the document's key, so a rerun or a lost task gives the same output.
Draws, form and cut points are Spark expressions; workers only move bytes, in windows of ``WINDOW`` bytes
and in slices of about ``SLICE`` bytes, so that a text of any length needs a small multiple of its own size.

Defined results: a null text is empty; an empty text and a text that holds a mark stay plain; a null key
draws like an empty one; equal keys with equal texts get equal outputs; repeated rows stay rows; an
empty table gives an empty one; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks, the share of texts that are rearranged and the share of those with the suffix first, in
#: hundredths (fixed values of the contract).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
REARRANGED, SUFFIX_FIRST = 90, 20

#: Bytes per window of a running sum and per slice of a batch.
WINDOW, SLICE = 1 << 18, 4 << 20

_MARK = len(PREFIX)


def draws(key: str | Column, n: int = 4) -> list[Column]:
    """The first 8-digit groups of the hex sha256 of '1:' and the key, as numbers."""
    col = F.col(key) if isinstance(key, str) else key
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n, form, first, second): the form of every text and its two cuts in code points;
    cuts of plain texts are null."""
    h1, h2, h3, h4 = (F.col(f"h{i}") for i in range(1, 5))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", F.length("text").cast("long").alias("n"), *(h.alias(f"h{i + 1}") for i, h in enumerate(draws("key"))))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("n") == 0) | marked | (h3 % 100 >= REARRANGED)
    form = F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    return rows.select(
        "key", "text", "n", form.alias("form"), F.when(~plain, F.least(a, b)).alias("first"),
        F.when(~plain, F.greatest(a, b)).alias("second"))


def byte_slices(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose texts have at most about ``SLICE`` bytes; a longer text is a part."""
    for batch in batches:
        ends = _offsets(batch.column(column))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1
            upto = min(max(upto, at + 1), batch.num_rows)
            yield batch.slice(at, upto - at)
            at = upto


def _offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary column's values."""
    if not len(column):
        return np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return ends[column.offset: column.offset + len(column) + 1].astype(np.int64)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values as one byte array and the offsets in it."""
    ends = _offsets(column)
    data = column.buffers()[2] if len(column) else None
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0]: ends[-1]], ends - ends[0]


def _column(data: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    wide = pa.large_binary() if kind == pa.binary() else pa.large_string()
    return pa.Array.from_buffers(wide, len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(kind)


def code_point_bytes(data: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Byte position of the code points with these (ascending) ranks in the buffer; the rank behind the
    last one is the buffer's end."""
    out, seen = np.full(len(ranks), len(data), np.int64), 0
    for at in range(0, len(data), WINDOW):
        starts = np.flatnonzero((data[at: at + WINDOW] & 0xC0) != 0x80)
        lo, hi = np.searchsorted(ranks, [seen, seen + len(starts)])
        out[lo:hi] = starts[ranks[lo:hi] - seen] + at
        seen += len(starts)
    return out


def shifts(places: np.ndarray, steps: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, shift of each position) in windows: the running sum of a difference array that holds
    ``steps`` at the ascending ``places``; steps at one place add up."""
    carry = 0
    for at in range(0, size, WINDOW):
        upto = min(size, at + WINDOW)
        lo, hi = np.searchsorted(places, [at, upto])
        diff = np.zeros(upto - at, np.int64)
        np.add.at(diff, places[lo:hi] - at, steps[lo:hi])
        diff[0] += carry
        run = np.cumsum(diff)
        carry = int(run[-1])
        yield at, upto, run


def scatter(data: np.ndarray, starts: np.ndarray, targets: np.ndarray, out: np.ndarray) -> None:
    """Write the segments that begin at ``starts`` (ascending, empty ones included) at ``targets``."""
    move = targets - starts
    for at, upto, run in shifts(starts, np.diff(move, prepend=0), len(data)):
        out[np.arange(at, upto) + run] = data[at:upto]


def gather(data: np.ndarray, starts: np.ndarray, sources: np.ndarray, out: np.ndarray) -> None:
    """Fill the segments of ``out`` that begin at ``starts`` from ``sources`` in ``data``."""
    move = sources - starts
    for at, upto, run in shifts(starts, np.diff(move, prepend=0), len(out)):
        out[at:upto] = data[np.arange(at, upto) + run]


def rearrange(texts: pa.Array, n: np.ndarray, form: np.ndarray, first: np.ndarray, second: np.ndarray) -> pa.Array:
    """The outputs of a batch; ``form`` is 0 for plain, 1 for psm and 2 for spm."""
    data, ends = _bytes(texts)
    begin, end = ends[:-1], ends[1:]
    moved = form > 0
    base = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
    ranks = np.stack([base + np.where(moved, first, 0), base + np.where(moved, second, 0)], 1)
    places = code_point_bytes(data, ranks.ravel()).reshape(-1, 2)
    a, b = (np.where(moved, places[:, i], begin) for i in (0, 1))
    new_ends = np.concatenate([[0], np.cumsum(end - begin + np.where(moved, 3 * _MARK, 0))])
    at = new_ends[:-1]
    spm = form == 2
    to_prefix = at + np.where(spm, 2 * _MARK + end - b, _MARK)
    to_middle = at + np.where(spm, 2 * _MARK + end - b + a - begin, 3 * _MARK + a - begin + end - b) + np.where(spm, _MARK, 0)
    to_suffix = at + np.where(spm, _MARK, 2 * _MARK + a - begin)
    starts = np.stack([begin, a, b], 1)
    targets = np.where(moved[:, None], np.stack([to_prefix, to_middle, to_suffix], 1), at[:, None] + starts - begin[:, None])
    out = np.zeros(int(new_ends[-1]), np.uint8)
    scatter(data, starts.ravel(), targets.ravel(), out)
    for mark, target in ((PREFIX, to_prefix), (MIDDLE, to_middle), (SUFFIX, to_suffix)):
        for i, byte in enumerate(mark.encode()):
            out[target[moved] - _MARK + i] = byte
    return _column(out, new_ends, pa.string())


def _mark_places(data: np.ndarray, mark: str) -> np.ndarray:
    """Start bytes of every occurrence of a mark in the buffer."""
    found, raw = [], mark.encode()
    for at in range(0, max(len(data) - _MARK + 1, 0), WINDOW):
        part = data[at: at + WINDOW + _MARK - 1]
        hit = np.ones(max(len(part) - _MARK + 1, 0), bool)
        for i, byte in enumerate(raw):
            hit &= part[i: len(part) - _MARK + 1 + i] == byte
        found.append(np.flatnonzero(hit) + at)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def put_back(outputs: pa.Array, form: np.ndarray) -> pa.Array:
    """The exact texts from outputs and forms alone: each rearranged output holds every mark once."""
    data, ends = _bytes(outputs)
    begin, end = ends[:-1], ends[1:]
    moved, spm = form > 0, form == 2
    at = {}
    for mark in (PREFIX, SUFFIX, MIDDLE):
        places = _mark_places(data, mark)
        at[mark] = np.where(moved, _first_in(places, begin), begin)
    p, s, m = at[PREFIX], at[SUFFIX], at[MIDDLE]
    middle = end - (m + _MARK)
    prefix = np.where(spm, m, s) - (p + _MARK)
    suffix = np.where(spm, p, m) - (s + _MARK)
    prefix, middle, suffix = (np.where(moved, x, y) for x, y in ((prefix, end - begin), (middle, 0), (suffix, 0)))
    new_ends = np.concatenate([[0], np.cumsum(prefix + middle + suffix)])
    to = new_ends[:-1]
    starts = np.stack([to, to + prefix, to + prefix + middle], 1)
    skip = np.where(moved, _MARK, 0)
    sources = np.stack([p + skip, np.where(moved, m + skip, end), np.where(moved, s + skip, end)], 1)
    out = np.zeros(int(new_ends[-1]), np.uint8)
    gather(data, starts.ravel(), sources.ravel(), out)
    return _column(out, new_ends, pa.string())


def _first_in(places: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For every text the first place at or behind its begin (unused for texts without one)."""
    where = np.searchsorted(places, begin)
    return np.append(places, 0)[where]


_FORMS = pa.array(["plain", "psm", "spm"])


def _form_codes(column: pa.Array) -> np.ndarray:
    return _numbers(pc.index_in(column, value_set=_FORMS))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, 1):
            key, texts, n, form, first, second = part.columns
            made = rearrange(texts, _numbers(n), _form_codes(form), _numbers(first), _numbers(second))
            yield pa.RecordBatch.from_arrays([key, n, form, first, second, made], ["key", "n", "form", "first", "second", "output"])

    rows = cut(docs, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    moved = rows.mapInArrow(run, f"key {kind}, n long, form string, first long, second long, output string")
    return moved.select(
        F.col("key").alias(key), "n", "form", F.col("first").alias("prefix_chars"),
        (F.col("second") - F.col("first")).alias("middle_chars"), "output")


def restore(outputs: DataFrame) -> DataFrame:
    """The rows with the column restored: the exact text, rebuilt from the columns output and form."""
    names = [f"c{i}" for i in range(len(outputs.columns))]
    plain = outputs.toDF(*names)
    at, form_at = outputs.columns.index("output"), outputs.columns.index("form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, at):
            back = put_back(part.column(at), _form_codes(part.column(form_at)))
            yield pa.RecordBatch.from_arrays([*part.columns, back], [*names, "restored"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(run, f"{schema}, restored string").toDF(*outputs.columns, "restored")


def digests(restored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    return restored.select(
        key, "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))
