"""SentencePiece BPE with the source span of every piece, and decoding.

A text is normalised by the compiled character map of the model: at every place the longest key of the
map's double-array trie is replaced, and each normalised byte keeps the source byte it came from. Blanks
become the piece blank; with a dummy prefix one stands in front. The normalised text is cut where no
piece can join two characters (before a run of blanks, and around characters that are in no longer
piece), ranked merges are folded over the characters of each part, and characters without a piece fall
back to their bytes. Sums of the pieces' lengths are normalised offsets, and the alignment projects them
to byte spans of the original text.

The model file reaches the workers once; it is bounded by the vocabulary. Texts never meet, so a
hot source or copies make no group; a worker remembers the pieces of parts it has met, up to ``CACHE``.

Defined results: a null text is empty and has no ids; text that looks like a control or byte piece is
ordinary text; a byte-fallback character has its whole span at its last byte and empty spans before, as
the library reports them; a part of any length takes n log n steps; repeated rows stay rows; an empty
table gives an empty one; columns other than key and text are not read. Decoding drops control pieces
and raises ValueError for ids the model does not have.
"""

from __future__ import annotations

import heapq
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import slices
from corpuslab.llm.infill import byte_slices

#: Parts whose pieces a worker keeps; parts of more than KEEP characters are never kept and merge in a heap;
#: parts that are merged at once; the rank of a pair that forms no piece.
CACHE, KEEP, AT_ONCE, NEVER = 300_000, 48, 4096, np.iinfo(np.int32).max
#: Fixed values of the file format: the blank of pieces, kinds of pieces, the marks of unknown text.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
REPLACEMENT = "�".encode()
_VALID = regex.compile(
    rb"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at: at + size], at + size
        yield tag >> 3, value


class CharacterMap:
    """Longest-prefix replacement by a compiled map: a double-array trie and its replacements."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = array("I", compiled[4: 4 + size])
        self.texts = compiled[4 + size:]

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes replaced) of the longest key at a place."""
        units, found = self.units, None
        node = _child(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= _child(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        value, length = found
        return self.texts[value: self.texts.index(b"\0", value)], length


def _child(unit: int) -> int:
    return (unit >> 10) << ((unit & (1 << 9)) >> 6)


class Model:
    """Vocabulary and settings of a model file."""

    def __init__(self, file: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(file):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0):
            raise ValueError("only byte-pair models with blanks in front are supported")
        if any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for *_, kind in self.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.fallback = bool(trainer.get(35, 0))
        self.unknown_text = trainer.get(44, " ⁇ ".encode())
        self.map = CharacterMap(normalizer.get(2, b"")) if normalizer.get(2) else None
        self.dummy, self.squeeze = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        self.escape = bool(normalizer.get(5, 1))


class Codec:
    """Encoder and decoder of one Python worker."""

    def __init__(self, file: bytes):
        self.model = model = Model(file)
        normal = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        place = {s: r for r, s in enumerate(sorted({model.pieces[i][1] for i in normal.values()}, reverse=True))}
        self.ids = normal
        self.ranks = {p: place[model.pieces[i][1]] for p, i in normal.items()}
        self._tables(normal)
        self.unknown = next(i for i, (*_, kind) in enumerate(model.pieces) if kind == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        joined = {c for p in normal if len(p) > 1 for c in p}
        alone = "".join(regex.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        inner = any(BLANK in p.lstrip(BLANK) for p in normal)  # then blanks bind to both sides
        alone_one = f"[{alone}]" if alone else "(?!)"
        self.parts = regex.compile(
            f"[^{alone}]+|{alone_one}" if inner and alone else "(?s:.+)" if inner
            else f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+|{alone_one}").findall
        self.known: dict[str, bytes] = {}
        blank = BLANK.encode()
        self.surface = [
            b"" if kind == CONTROL else model.unknown_text if kind == UNKNOWN else bytes([int(p[3:5], 16)]) if kind == BYTE
            else p.encode().replace(blank, b" ") for p, _, kind in model.pieces]
        self.kind = [kind for *_, kind in model.pieces]

    def normalise(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each of them and for the end, the source byte it came from."""
        if not raw:
            return b"", np.zeros(1, np.int64)
        model, blank = self.model, BLANK.encode() if self.model.escape else b" "
        head = 0
        if model.map is None and not model.squeeze and _sound(raw):
            data = np.frombuffer(raw, np.uint8)
            made = raw.replace(b" ", blank)
            origin = np.repeat(np.arange(len(raw)), np.where(data == 32, len(blank), 1))
        else:
            made, origin, head = self._normalise_by_map(raw, blank)
        origin = np.append(origin, len(raw))
        if model.dummy and (len(made) or not model.squeeze):
            made, origin = blank + made, np.concatenate([np.full(len(blank), head), origin])
        if model.squeeze:
            while made.endswith(blank):
                made, origin = made[: len(made) - len(blank)], origin[: len(origin) - len(blank)]
        return made, origin

    def _normalise_by_map(self, raw: bytes, blank: bytes) -> tuple[bytes, np.ndarray, int]:
        """Normalised bytes, their sources, and the source behind the blanks skipped at the head."""
        out, origin, at, squeeze = bytearray(), array("q"), 0, self.model.squeeze
        while squeeze and at < len(raw):
            made, used = self._prefix(raw, at)
            if made != b" ":
                break
            at += used
        head, spaced = at, squeeze
        while at < len(raw):
            made, used = self._prefix(raw, at)
            if spaced:
                made = made.lstrip(b" ")
            if made:
                escaped = made.replace(b" ", blank)
                out += escaped
                origin.extend([at] * len(escaped))
                spaced = squeeze and made.endswith(b" ")
            at += used
        return bytes(out), np.array(origin, np.int64), head

    def _prefix(self, raw: bytes, at: int) -> tuple[bytes, int]:
        found = self.model.map.longest(raw, at) if self.model.map else None
        if found:
            return found
        char = _VALID.match(raw, at)
        return (char.group(), char.end() - at) if char else (REPLACEMENT, 1)

    def _tables(self, normal: dict[str, int]) -> None:
        """Arrays for the fold over many parts at once. A symbol is a piece's id, or the number of pieces
        plus the code point of a character without one; a pair of symbols that form a piece has a row in the
        sorted table of pairs."""
        n = len(self.model.pieces)
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int64)
        self.size = np.zeros(n, np.int32)
        for p, i in normal.items():
            self.size[i] = len(p.encode())
            if len(p) == 1:
                self.symbol[ord(p)] = i
        pairs = {}
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                left = normal.get(a) if cut > 1 else int(self.symbol[ord(a)])
                right = normal.get(b) if len(b) > 1 else int(self.symbol[ord(b)])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = self.ranks[p], i
        keys = sorted(pairs)
        self.pair_keys = np.array([*keys, np.iinfo(np.int64).max], np.int64)
        self.pair_ranks = np.array([*(pairs[k][0] for k in keys), NEVER], np.int32)
        self.pair_ids = np.array([*(pairs[k][1] for k in keys), -1], np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id of the joined piece) of pairs of symbols; NEVER where they form none."""
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        found = self.pair_keys[at] == key
        return np.where(found, self.pair_ranks[at], NEVER), np.where(found, self.pair_ids[at], -1)

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """For distinct parts the id and the normalised length of every piece, in turn."""
        made = {p: self._bytes_of(self._merge_long(p)) for p in parts if len(p) > KEEP}
        short = sorted((p for p in parts if len(p) <= KEEP), key=len)
        for at in range(0, len(short), AT_ONCE):
            self._fold(short[at: at + AT_ONCE], made)
        return made

    def _fold(self, parts: list[str], made: dict[str, bytes]) -> None:
        """Ranked merges of many parts, a merge in each per step: the adjacent pair with the best rank, the
        leftmost on ties, becomes one symbol, and what stands behind it moves up."""
        lengths = np.array([len(p) for p in parts])
        width = int(lengths[-1])
        row = np.repeat(np.arange(len(parts)), lengths)
        column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        symbols = np.full((len(parts), width), -1, np.int64)
        symbols[row, column] = self.symbol[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
        final, counts = np.full((len(parts), width), -1, np.int64), lengths.copy()
        ranks, joins = np.full((len(parts), max(width - 1, 1)), NEVER, np.int32), np.full((len(parts), max(width - 1, 1)), -1, np.int64)
        if width > 1:
            left, right = symbols[:, :-1], symbols[:, 1:]
            inside = right >= 0
            ranks[inside], joins[inside] = self._pairs(left[inside], right[inside])
        live = np.arange(len(parts))
        while len(live):
            best = ranks.argmin(1)
            here = np.arange(len(live))
            going = ranks[here, best] < NEVER
            final[live[~going], : symbols.shape[1]] = symbols[~going]
            live, best = live[going], best[going]
            if not len(live):
                break
            symbols, ranks, joins = symbols[going], ranks[going], joins[going]
            here = np.arange(len(live))
            counts[live] -= 1
            symbols[here, best] = joins[here, best]
            symbols = _without(symbols, best + 1)
            ranks, joins = (_without(x, best) if x.shape[1] > 1 else np.full_like(x, fill) for x, fill in ((ranks, NEVER), (joins, -1)))
            for at in (best - 1, best):  # the pairs on both sides of the new symbol
                ok = (at >= 0) & (at + 1 < symbols.shape[1])
                ok[ok] = symbols[here[ok], at[ok] + 1] >= 0
                r, i = here[ok], at[ok]
                ranks[r, i], joins[r, i] = self._pairs(symbols[r, i], symbols[r, i + 1])
        flat = final[np.arange(width)[None, :] < counts[:, None]]
        ends = np.cumsum(counts)
        strange = set(np.repeat(np.arange(len(parts)), counts)[flat >= len(self.size)].tolist())
        sized = np.empty((len(flat), 2), np.int32)
        sized[:, 0] = np.where(flat < len(self.size), flat, 0)
        sized[:, 1] = self.size[sized[:, 0]]
        raw = sized.tobytes()
        for i, (part, end, n) in enumerate(zip(parts, ends.tolist(), counts.tolist())):
            if i in strange:
                part_ids = flat[end - n: end].tolist()
                made[part] = self._bytes_of([self.model.pieces[j][0] if j < len(self.size) else chr(j - len(self.size)) for j in part_ids])
            else:
                made[part] = raw[8 * (end - n): 8 * end]

    def _bytes_of(self, pieces: list[str]) -> bytes:
        out = array("i")
        for piece in pieces:
            raw, own = piece.encode(), self.ids.get(piece)
            if own is not None or not self.model.fallback:
                out.extend((self.unknown if own is None else own, len(raw)))
            else:
                for i, byte in enumerate(raw, 1):
                    out.extend((self.bytes[byte], len(raw) if i == len(raw) else 0))
        return out.tobytes()

    def _merge_long(self, part: str) -> list[str]:
        """The fold over one long part, with its pairs in a heap and neighbours in links; a pair whose ends have
        moved is stale."""
        n, rank = len(part), self.ranks.get
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(part[i: i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = ends[i]  # 0 once merged into its left neighbour
            if not j or j >= n or ends[j] != end:
                continue
            ends[i], ends[j] = end, 0
            if end < n:
                before[end] = i
                if (r := rank(part[i: ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            h = before[i]
            if h >= 0 and (r := rank(part[h: end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(part[i: ends[i]])
            i = ends[i]
        return out

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begin, end) of every text; spans are bytes of the original."""
        normal = [self.normalise(t) for t in texts]
        cut = [self.parts(made.decode("utf-8")) for made, _ in normal]
        known = self.known
        found = [[known.get(p) for p in parts] for parts in cut]
        new = self.learn(list({p for parts, own in zip(cut, found) if None in own for p, f in zip(parts, own) if f is None}))
        found = [[f or new[p] for p, f in zip(parts, own)] if None in own else own for parts, own in zip(cut, found)]
        if len(known) + len(new) > CACHE:
            known.clear()
        known.update((p, own) for p, own in new.items() if len(p) <= KEEP)
        return [self._joined(own, origin) for own, (_, origin) in zip(found, normal)]

    def _joined(self, found: list[bytes], origin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = np.frombuffer(b"".join(found), np.int32)
        ids, ends = whole[0::2], np.cumsum(whole[1::2], dtype=np.int64)
        if not self.model.fallback and len(ids):  # neighbouring unknown pieces are one
            keep = np.append((ids[:-1] != self.unknown) | (ids[1:] != self.unknown), True)
            ids, ends = ids[keep], ends[keep]
        return ids, origin[np.concatenate([[0], ends[:-1]])[: len(ends)]], origin[ends]

    def decode(self, numbers: list[int]) -> bytes:
        """The text of the ids in UTF-8."""
        if numbers and not 0 <= min(numbers) <= max(numbers) < len(self.surface):
            raise ValueError("id beyond the vocabulary")
        surface, kind, model = self.surface, self.kind, self.model
        parts = [surface[i] for i in numbers]
        if model.dummy or model.squeeze:
            for at, i in enumerate(numbers):
                if kind[i] == CONTROL:
                    continue
                if kind[i] == NORMAL and parts[at].startswith(b" "):
                    parts[at] = parts[at][1:]
                    if not parts[at] and model.squeeze:
                        continue
                break
        whole = b"".join(parts)
        return whole if b"" not in parts and _sound(whole) else self._repaired(numbers, parts)  # an empty part ends a run of bytes

    def _repaired(self, numbers: list[int], parts: list[bytes]) -> bytes:
        """Runs of byte pieces read as UTF-8, every byte outside a character replaced."""
        out, run = [], bytearray()
        for i, part in zip(numbers, parts):
            if self.kind[i] == BYTE:
                run += part
                continue
            out += [_replaced(bytes(run)), part]
            run.clear()
        return b"".join([*out, _replaced(bytes(run))])


def _without(matrix: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Every row without one of its elements."""
    rows, width = matrix.shape
    keep = np.ones((rows, width), bool)
    keep[np.arange(rows), column] = False
    return matrix[keep].reshape(rows, width - 1)


def _sound(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
        return True
    except UnicodeDecodeError:
        return False


def _replaced(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        char = _VALID.match(raw, at)
        out += char.group() if char else REPLACEMENT
        at = char.end() if char else at + 1
    return bytes(out)


@lru_cache(maxsize=1)
def codec_of(file: bytes) -> Codec:
    """The codec of this Python worker, with the parts that its earlier tasks have met."""
    return Codec(file)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """One list of ints per part."""
    sizes = np.cumsum([0, *map(len, parts)])
    values = np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values))


def encode(docs: DataFrame, file: bytes, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids, begin, end): ids of every whole text and the span of each in the text's UTF-8 bytes; with
    ``decoded`` also the text that the worker decodes from the ids."""
    names = ["key", "ids", "begin", "end", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(file)
        for batch in byte_slices(batches, 1):
            made = codec.encode(batch.column(1).to_pylist())
            columns = [_lists([m[i] for m in made]) for i in range(3)]
            if decoded:
                columns.append(pa.array([codec.decode(m[0].tolist()) for m in made], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, ids array<int>, begin array<int>, end array<int>"
    made = rows.mapInArrow(run, f"{schema}, decoded binary" if decoded else schema)
    return made.withColumnRenamed("key", key)


def decode(encoded: DataFrame, file: bytes) -> DataFrame:
    """The rows with the column decoded: the text of the column ids in UTF-8."""
    names = [f"c{i}" for i in range(len(encoded.columns))]
    plain, at = encoded.toDF(*names), encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(file)
        for batch in slices(batches):
            texts = [codec.decode(i.as_py() or []) for i in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*names, "decoded"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(run, f"{schema}, decoded binary").toDF(*encoded.columns, "decoded")


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): the ids as decimals joined by commas."""
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select(
        key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
