"""Embedding near-duplicates by Euclidean p-stable hashing.

Equal vectors are one vector with a count first. Each different vector, scaled to length one, is projected
on random normal directions; a projection plus a random offset, cut into cells of ``CELL``, is one hash,
and ``width`` hashes together are a table's bucket. Vectors that share a bucket in any of the
tables are compared by cosine in double precision.

``width`` grows with the logarithm of the number of vectors, so that ``CROWD`` unrelated vectors share a
bucket on average, and the number of tables follows from the wanted recall at the threshold: a link is
missed with a probability of ``MISS`` at most, and far less above the threshold.

A bucket of any size is dealt in blocks of ``BLOCK`` vectors; each pair of blocks is one group of
rows. A group writes no pairs: per vector the number of links that no earlier table has found
(rows carry the hashes of all tables) and the smallest vector of its part of the group.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
rows without an id, link with nothing and are their own component; vectors of different
lengths never link; repeated rows count as vectors of their own; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.common import connected_components
from corpuslab.plans.scale import cut_lineage

CELL, CROWD, MISS, BLOCK, SEED = 2.0, 256, 1e-3, 2048, 7


def collision(distance: float, cell: float = CELL) -> float:
    """Probability that two points at this distance share a cell of a random projection."""
    if distance <= 0:
        return 1.0
    r = cell / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(vectors: int, cosine: float) -> tuple[int, int]:
    """(hashes per table, tables) for so many different vectors. Unrelated vectors are taken to be at
    right angles."""
    far, near = collision(math.sqrt(2)), collision(math.sqrt(max(2 - 2 * cosine, 0)))
    width = max(1, math.ceil(math.log(max(vectors / CROWD, 1) + 1) / -math.log(far)))
    hit = near ** width
    return width, (1 if hit >= 1 else max(1, math.ceil(math.log(MISS) / math.log1p(-hit))))


def _vectors(batch: pa.RecordBatch, column: int) -> list[np.ndarray | None]:
    """Usable vectors in double precision, else None."""
    out: list[np.ndarray | None] = []
    for v in batch.column(column):
        x = None
        if v.is_valid and len(v) and v.values.null_count == 0:
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64)
            if not np.isfinite(x).all() or not x.any():
                x = None
        out.append(x)
    return out


def _digests(kind: pa.DataType):
    """``kind`` is the components' own type: a vector of floats travels as floats, which is exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable = _vectors(batch, 1)
            found = [None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in usable]
            numbers = [None if x is None else x.astype(kind.to_pandas_dtype()) for x in usable]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(found, pa.binary()), pa.array(numbers, pa.list_(kind))], ["id", "digest", "vector"])

    return run


def _hashes(tables: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            rows = []
            for x in _vectors(batch, 1):
                if len(x) not in drawn:
                    source = np.random.default_rng([SEED, len(x)])
                    drawn[len(x)] = (source.standard_normal((tables * width, len(x))), source.uniform(0, CELL, tables * width))
                directions, offsets = drawn[len(x)]
                x = x / np.abs(x).max()
                cells = np.floor((directions @ (x / np.linalg.norm(x)) + offsets) / CELL).astype(np.int32).reshape(tables, width)
                rows.append([int.from_bytes(
                    hashlib.blake2b(c.tobytes() + len(x).to_bytes(4, "little"), digest_size=4).digest(), "little", signed=True)
                    for c in cells])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int32()))], ["rep", "vector", "n", "keys"])

    return run


def _group(rows: list[tuple], table: int, cosine: float) -> pa.RecordBatch | None:
    """Links within one group of rows (rep, vector, n, keys, block)."""
    reps, size = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.int64)
    block = np.array([r[4] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    keys = np.array([r[3][:table] for r in rows], dtype=np.int32).reshape(len(rows), table)
    across = block[0] != block[-1]
    left, right = [], []
    for at in range(0, len(rows), 256):
        near = x[at: at + 256] @ x.T >= cosine
        a, b = np.nonzero(near)
        a += at
        keep = (block[a] < block[b]) if across else (a < b)
        a, b = a[keep], b[keep]
        for t in range(table):
            fresh = keys[a, t] != keys[b, t]
            a, b = a[fresh], b[fresh]
        left.append(a)
        right.append(b)
    a, b = np.concatenate(left), np.concatenate(right)
    if not len(a):
        return None
    links = np.bincount(a, weights=size[b], minlength=len(rows)) + np.bincount(b, weights=size[a], minlength=len(rows))
    root = reps.copy()
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (before == root).all():
            break
    seen = links > 0
    return pa.RecordBatch.from_arrays([
        pa.array(reps[seen]), pa.array(links[seen].astype(np.int64)), pa.array(root[seen])], ["rep", "links", "root"])


def _compare(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = [], None
        for batch in batches:
            for t, key, one, two, block, rep, n, vector, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                group = (t, key, one, two, len(vector))
                if group != last and rows:
                    found = _group(rows, last[0], cosine) if len(rows) > 1 else None
                    if found is not None:
                        yield found
                    rows = []
                last = group
                rows.append((rep, vector, n, keys, block))
        found = _group(rows, last[0], cosine) if len(rows) > 1 else None
        if found is not None:
            yield found

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(key, n_links, component_id, kept), one row per input row."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    kind = "float" if rows.schema["vector"].dataType.elementType == T.FloatType() else "double"
    rows = rows.withColumn("vector", F.col("vector").cast(f"array<{kind}>"))
    marked = rows.mapInArrow(
        _digests(pa.float32() if kind == "float" else pa.float64()), f"id long, digest binary, vector array<{kind}>").withColumn(
        "digest", F.when(F.col("id").isNotNull(), F.col("digest")))
    distinct = cut_lineage(marked.filter("digest is not null").groupBy("digest").agg(
        F.min("id").alias("least"), F.count("*").alias("n"), F.first("vector").alias("vector")))
    distinct = distinct.withColumn("rep", F.monotonically_increasing_id())  # of written rows, so it stays the same
    width, tables = plan(distinct.count(), cosine)
    hashed = cut_lineage(distinct.select("rep", "vector", "n").mapInArrow(
        _hashes(tables, width), f"rep long, vector array<{kind}>, n long, keys array<int>"))
    dealt = hashed.select("*", F.posexplode("keys").alias("table", "key"))
    sizes = cut_lineage(dealt.groupBy("table", "key").agg(F.count("*").alias("size")).filter("size > 1"))
    placed = dealt.join(sizes, ["table", "key"]).withColumn(
        "blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = ["table", "key", "one", "two"]
    placed = placed.select(
        "table", "key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block",
        "rep", "n", "vector", "keys")
    placed = placed.repartition(*group).sortWithinPartitions(*group, F.size("vector"), "block")
    found = cut_lineage(placed.mapInArrow(_compare(cosine), "rep long, links long, root long"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = cut_lineage(distinct.select("digest", "least", "rep", "n").join(counts, "rep", "left").join(
        groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component")))
    named = cut_lineage(linked.groupBy("component").agg(F.min("least").alias("component_id")))
    named = cut_lineage(linked.join(named, "component").select("digest", "n_links", "component_id"))
    out = marked.drop("vector").join(named, "digest", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
