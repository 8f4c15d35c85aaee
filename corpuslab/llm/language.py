"""Language identification with language-bitmask n-gram filters.

One Bloom filter holds the frequent n-grams of all languages: its slots are not bits but masks with a
bit per language (bit slices), so one lookup, the AND of a gram's ``HASHES`` slots, returns all
languages that contain the gram. Per text the bits are counted per language. A filter of which a
share f of the slots has a language's bit answers f ** HASHES of all other grams by mistake; with n
grams and c hits, ``(c - n * p) / (1 - p)`` corrects the count. The largest corrected count decides,
its share of all corrected counts is the score.

Training takes, per language, the documents with the smallest id hashes, about ``PER_LANGUAGE`` of them (the
documented bound of the sample), and of their grams those in at least ``MIN_SHARE`` of the documents. That
bounds the grams per language, and so the filter, which goes to every task. Languages beyond 64 take
further mask planes.

A gram is ``GRAM`` bytes of the lower-cased text with everything but letters as spaces, at any
place. Defined results: a null text or one without a letter is `und` with score 0; a text without any
known gram gets the language with most training documents (the smaller name on ties) and score 0; without training
rows everything is `und`; training rows without a text or language teach nothing; ties go to the
smaller name; repeated rows are treated alike; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import slices
from corpuslab.plans.scale import cut_lineage

GRAM = 5
PER_LANGUAGE = 2_000
MIN_SHARE = 0.05
HASHES = 2
SLOTS_PER_GRAM = 16
#: Text bytes that are looked up at a time.
STEP = 1 << 18
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]
_SPACES = np.uint64(int.from_bytes(b" " * GRAM, "little"))


def grams(text: str) -> np.ndarray:
    """All grams of a text as numbers; none for a text without a letter."""
    raw = b" %s " % _OTHER.sub(" ", text.lower()).strip().encode("utf-8")
    n = len(raw) - GRAM + 1
    if n < 1:
        raw = raw.ljust(GRAM)
        n = 1
    padded = np.frombuffer(raw + bytes(8 - GRAM), dtype=np.uint8)
    words = np.ndarray(n, "<u8", padded, strides=(1,)).copy()
    return words & np.uint64((1 << 8 * GRAM) - 1)


def _slots(found: np.ndarray, size: int) -> list[np.ndarray]:
    out = []
    for k in range(HASHES):
        h = found * _ODD[k]
        h ^= h >> np.uint64(29)
        h *= _ODD[2]
        out.append((h >> np.uint64(32)).astype(np.int64) & (size - 1))
    return out


@dataclass
class GramFilter:
    """The fitted model: language names, mask planes (plane, slot) and per language the share of
    slots that hold its bit, to the power of HASHES."""

    names: list[str]
    planes: np.ndarray
    mistakes: np.ndarray
    fallback: str

    @classmethod
    def build(cls, found: dict[str, np.ndarray], fallback: str) -> GramFilter:
        names = sorted(found)
        most = max((len(g) for g in found.values()), default=1)
        size = 1 << max(10, int(most * SLOTS_PER_GRAM - 1).bit_length())
        planes = np.zeros(((len(names) + 63) // 64 or 1, size), dtype=np.uint64)
        for i, name in enumerate(names):
            for slots in _slots(found[name].astype(np.uint64), size):
                planes[i // 64][slots] |= np.uint64(1 << (i % 64))
        filled = [float(np.count_nonzero(planes[i // 64] >> np.uint64(i % 64) & np.uint64(1))) / size for i in range(len(names))]
        return cls(names, planes, np.array(filled) ** HASHES, fallback)

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Hits per language and number of grams."""
        found, hits = grams(text), np.zeros(len(self.names), dtype=np.int64)
        for at in range(0, len(found), STEP):
            slots = _slots(found[at: at + STEP], self.planes.shape[1])
            for p, plane in enumerate(self.planes):
                masks = plane[slots[0]]
                for s in slots[1:]:
                    masks &= plane[s]
                for i in range(64 * p, min(64 * p + 64, len(self.names))):
                    hits[i] += np.count_nonzero(masks & np.uint64(1 << (i % 64)))
        return hits, len(found)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.names or not text or not _LETTER.search(text):
            return "und", 0.0
        hits, n = self.counts(text)
        real = np.maximum((hits - n * self.mistakes) / (1 - self.mistakes), 0.0)
        total = float(real.sum())
        if total <= 0:
            return self.fallback, 0.0
        best = int(real.argmax())
        return self.names[best], float(real[best]) / total


def held_out(key: str | Column) -> Column:
    """Documents that are kept from training: crc32 of the id as text, modulo 4, is 2."""
    col = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE,
) -> GramFilter:
    """Fit the filter on documents that may be learned from."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[lang]: r.n for r in rows.groupBy(lang).agg(F.count("*").alias("n")).collect()}  # one row per language
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))
    share = F.create_map(*(F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, per_language / n)))) if sizes else F.lit(None)
    sample = rows.filter(part < (share[F.col(lang)] if sizes else F.lit(0.0))).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held: dict[str, list[np.ndarray]] = {}
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(name, []).append(np.unique(grams(body)) if _LETTER.search(body) else np.empty(0, np.uint64))
            for name, parts in held.items():
                found, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * (len(found) + 1)), pa.array(np.append(found, _SPACES).view(np.int64)),
                    pa.array(np.append(counts, len(parts)))], ["lang", "gram", "n"])

    counted = cut_lineage(sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    documents = {r.lang: r.n for r in counted.filter(F.col("gram") == int(_SPACES)).collect()}
    least = F.create_map(*(F.lit(x) for name, n in documents.items() for x in (name, MIN_SHARE * n))) if documents else F.lit(None)
    frequent = counted.filter((F.col("gram") != int(_SPACES)) & (F.col("n") >= (
        least[F.col("lang")] if documents else F.lit(0.0)))) if documents else counted.limit(0)
    kept: dict[str, list[int]] = {name: [] for name in documents}
    for r in frequent.collect():  # at most (grams of a text) / MIN_SHARE per language
        kept[r.lang].append(r.gram)
    fallback = min(sizes, key=lambda x: (-sizes[x], x)) if sizes else "und"
    return GramFilter.build({name: np.array(g, dtype=np.int64) for name, g in kept.items()}, fallback)


def identify(docs: DataFrame, model: GramFilter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in slices(batches):
            found = [fitted.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["key", "lang_pred", "score"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, lang_pred string, score double").withColumnRenamed("key", key)
