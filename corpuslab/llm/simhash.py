"""SimHash near-duplicates: fingerprints of word shingles, linked by pigeonring filtering.

A fingerprint of 64 bits is cut into ``segments`` around a ring. If two fingerprints differ in at
most ``distance`` bits, some segment starts a chain in which, for every length l, the first l
segments differ in at most ``l * distance / segments`` bits. The longest prefix whose budget
rounds down to zero has to be equal, so it is the join key; the budgets of the longer prefixes
drop most candidates before the full Hamming check.

A key that many different fingerprints share would pair them quadratically. Such a bucket takes
an exact linear way: every member is written under itself and its one-bit neighbours outside the
key, and members meeting there differ in at most two bits. Two members that differ in two bits
always meet, so no link is lost to reachability; a meeting point holds at most one member
per bit, whatever the bucket's size.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; fewer
words than a shingle are one shingle; repeated rows are returned once each, and rows
that share an id count as linked; a null id gets the
component of its fingerprint and is never its name unless no id is there (then null).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import connected_components, slices
from corpuslab.plans.scale import cut_lineage

BITS = 64
SEED = 42
#: Buckets with more different fingerprints than this take the linear way.
PAIRED = 128


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned fingerprint; bits are counted in blocks, so a long text needs no more memory."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    begin, stop = starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64), len(begin)
    for at in range(0, n, 1 << 15):
        block = [digest(joined[s:e], SEED) for s, e in zip(begin[at: at + (1 << 15)], stop[at: at + (1 << 15)], strict=True)]
        bits = np.unpackbits(np.array(block, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, carry: Sequence[str] = (),
) -> DataFrame:
    """(key, fp, carry..): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(marks.view(np.int64)), *batch.columns[2:]], ["key", "fp", *carry])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), *carry)
    carried = "".join(f", `{c}` {t}" for c, t in rows.dtypes[2:])
    return rows.mapInArrow(run, f"key long, fp long{carried}").withColumnRenamed("key", key)


def _mask(start: int, length: int) -> int:
    """``length`` bits from ``start`` around the ring, as a signed long."""
    bits = sum(1 << ((start + i) % BITS) for i in range(length))
    return bits - (1 << 64) if bits >> 63 else bits


def _flip(bit: int) -> Column:
    return F.lit(_mask(bit, 1))


def links(prints: DataFrame, node: str, distance: int = 2, segments: int = 5) -> DataFrame:
    """(a, b) links between different fingerprints; ``prints`` has one row per fingerprint ``fp``
    with the id ``node`` that stands for it."""
    cuts = [round(i * BITS / segments) for i in range(segments + 1)]
    exact = max(n for n in range(segments + 1) if n * distance // segments == 0)
    span = lambda i, n: sum(cuts[(i + j) % segments + 1] - cuts[(i + j) % segments] for j in range(n))
    prefix = [[_mask(cuts[i], span(i, n)) for n in range(segments + 1)] for i in range(segments)]
    keys = F.array(*(
        F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(prefix[i][exact])).alias("part"))
        for i in range(segments)))
    members = prints.select(F.col(node).alias("id"), "fp", F.explode(keys).alias("k")).select("id", "fp", "k.i", "k.part")
    sizes = cut_lineage(members.groupBy("i", "part").agg(F.count("*").alias("n")).filter("n > 1"))
    small = members.join(sizes.filter(F.col("n") <= PAIRED).drop("n"), ["i", "part"])
    pairs = small.alias("x").join(small.alias("y"), ["i", "part"]).filter("x.fp < y.fp").select(
        "i", F.col("x.id").alias("a"), F.col("y.id").alias("b"),
        F.col("x.fp").bitwiseXOR(F.col("y.fp")).alias("diff"))
    within = F.lit(True)
    for i in range(segments):
        chain = F.lit(True)
        for n in range(exact + 1, segments + 1):
            chain = chain & (F.bit_count(F.col("diff").bitwiseAND(F.lit(prefix[i][n]))) <= n * distance // segments)
        within = F.when(F.col("i") == i, chain).otherwise(within)
    near = pairs.filter(within & (F.bit_count("diff") <= distance)).select("a", "b")
    if distance != 2:
        raise ValueError("the linear way for large buckets is exact for a distance of 2")
    others = [[b for b in range(BITS) if not (prefix[i][exact] >> b) & 1] for i in range(segments)]
    around = F.lit(None).cast("array<bigint>")
    for i in range(segments):
        around = F.when(F.col("i") == i, F.array(
            F.col("fp"), *(F.col("fp").bitwiseXOR(_flip(b)) for b in others[i]))).otherwise(around)
    large = members.join(sizes.filter(F.col("n") > PAIRED).drop("n"), ["i", "part"])
    meet = large.select("id", "i", F.explode(around).alias("at")).groupBy("i", "at").agg(
        F.collect_set("id").alias("ids")).filter(F.size("ids") > 1)  # at most one member per bit
    meeting = meet.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b")).filter("a <> b")
    return near.unionByName(meeting).distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(key, fp, component_id, carry..), one row per input row; carried columns are given back as they came."""
    prints = cut_lineage(fingerprints(docs, key, text, width, carry))
    nodes = prints.groupBy("fp").agg(F.min(key).alias("_node"))
    joined = links(nodes.filter(F.col("_node").isNotNull()), "_node", distance)
    groups = connected_components(joined).select(F.col("node").alias("_node"), "component")
    named = cut_lineage(nodes.join(groups, "_node", "left").select(
        "fp", F.coalesce("component", "_node").alias("component_id")))
    return prints.join(named, "fp")


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
