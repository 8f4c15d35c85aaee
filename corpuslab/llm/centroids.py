"""Centroid clustering in exact integers by equal-average equal-variance search.

Vectors become integers floor(scale * x); Lloyd's rounds assign every vector to its nearest centroid by
squared Euclidean distance and replace a centroid by the floor of its vectors' mean. The search keeps the
centroids sorted by the sum of their components (their mean, in integers). A vector starts at the centroid
with the nearest sum and scans outward on both sides; with k components, sums s and spreads
v = k * sum(x^2) - s^2 (k^2 times the variance)

    k * d^2 >= (s_x - s_c)^2                            ends the scan of a side,
    k * d^2 >= (s_x - s_c)^2 + (sqrt v_x - sqrt v_c)^2   rejects a centroid without its components,

and only what is left gets an exact integer distance. The first test is exact; the second leaves a
margin for its square roots, so rejected centroids are farther than the best one. Ties go to the
smaller number, wherever it stands in the scan.

A round is one pass over the written integer vectors: tasks return one row of sums per centroid, Spark
adds them up, and the driver holds centroids x components numbers. Vectors are never grouped, so
a cluster that holds most of them, or copies of one vector, makes no task larger than another.

Defined results: null vectors, vectors with another number of components and vectors with a null or
non-finite component are left out; equal vectors get equal answers whatever their ids; repeated rows count each
time; fewer vectors than centroids make as many centroids as vectors; an empty table gives an
empty one; a null id draws like an empty one; other columns are not read. A component beyond ``LIMIT`` after
scaling raises ValueError, as its squared distances are no longer long integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.plans.scale import cut_lineage

#: Largest component in integers and number of components: the squared differences still add up to a long.
LIMIT, WIDEST = 1 << 27, 64
#: Vectors a worker compares at once.
ROWS = 8192


def integer_vectors(rows: DataFrame, key: str, vec: str, size: int, scale: int) -> DataFrame:
    """(key, v): the kept vectors as integers; one beyond an int is null, which ``cluster`` refuses."""
    if size > WIDEST:
        raise ValueError(f"at most {WIDEST} components keep squared distances in a long")
    col = F.col("v")
    whole = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    made = F.transform(col, lambda x: F.floor(x * F.lit(float(scale))).try_cast("int"))
    kept = rows.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("v"))
    return kept.filter(F.coalesce((F.size(col) == size) & whole, F.lit(False))).select("key", made.alias("v"))


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of '3:' and the key, in hash order; equal hashes by components."""
    hashed = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


class Search:
    """Centroids in the order of their sums, and the scan of a batch of vectors over them."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(1)
        self.order = np.argsort(sums, kind="stable")
        self.rows, self.sums = centroids[self.order], sums[self.order]
        self.k, self.size = centroids.shape
        self.spread = _spread(self.rows, self.sums)
        self.compared = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of every row."""
        n = len(x)
        sums = x.sum(1)
        spread = _spread(x, sums)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, self.k)
        right = np.searchsorted(self.sums, sums)  # next centroid above, and the one below it
        left = right - 1
        live = np.arange(n)
        while len(live):
            gap_l = self._gap(sums[live], left[live])
            gap_r = self._gap(sums[live], right[live])
            down = gap_l <= gap_r
            gap = np.where(down, gap_l, gap_r)
            # the nearer side decides: if even it is too far by the mean, so is everything further out
            go = (gap <= _REACH) & ~_beyond(gap, best[live], self.size)
            live, down, gap = live[go], down[go], gap[go]
            if not len(live):
                break
            at = np.where(down, left[live], right[live])
            left[live] -= down
            right[live] += ~down
            bound = gap.astype(np.float64) ** 2 + (spread[live] - self.spread[at]) ** 2
            close = bound * (1 - 1e-8) - 1 <= best[live].astype(np.float64) * self.size
            rows, at = live[close], at[close]
            self.compared += len(rows)
            diff = x[rows] - self.rows[at]
            d = np.einsum("ij,ij->i", diff, diff)
            name = self.order[at]
            better = (d < best[rows]) | ((d == best[rows]) & (name < number[rows]))
            rows = rows[better]
            best[rows], number[rows] = d[better], name[better]
        return number, best

    def _gap(self, sums: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distance of the sums; beyond every real one where the side has no more centroids."""
        inside = (at >= 0) & (at < self.k)
        return np.where(inside, np.abs(sums - self.sums[np.clip(at, 0, self.k - 1)]), _REACH + 1)


#: No two sums of components within LIMIT are further apart.
_REACH = 2 * WIDEST * LIMIT


def _spread(rows: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Square root of k * sum(x^2) - sum(x)^2, from components less their mean."""
    centred = rows - (sums / rows.shape[1])[:, None]
    return np.sqrt(rows.shape[1] * np.einsum("ij,ij->i", centred, centred))


def _beyond(gap: np.ndarray, best: np.ndarray, size: int) -> np.ndarray:
    """Exactly gap^2 > size * best: the whole part of gap^2 / size against best (both sides are long)."""
    square = gap // size
    whole = square * gap + (gap % size) * gap // size  # floor(gap^2 / size) without gap^2
    rest = ((gap % size) * gap) % size
    return (whole > best) | ((whole == best) & (rest > 0))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


def _slices(batches, rows: int = ROWS):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def partial_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, sums): one row per task and centroid that has vectors there."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in _slices(batches):
            x = _matrix(batch.column(0), size)
            number, _ = search.nearest(x)
            order = np.argsort(number, kind="stable")
            met, starts = np.unique(number[order], return_index=True)
            if len(met):
                sums[met] += np.add.reduceat(x[order], starts, axis=0)
                counts += np.bincount(number, minlength=k)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int32()), pa.array(counts[own]), pa.array(list(sums[own]), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"])

    return vectors.select("v").mapInArrow(run, "cluster int, n long, sums array<long>")


def lloyd(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after so many rounds: exact floors of means, empty ones as they were."""
    size = centroids.shape[1]
    wide = [F.sum(F.element_at("sums", i + 1).cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    for _ in range(rounds):
        moved = centroids.copy()
        for row in partial_sums(vectors, centroids).groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():
            moved[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(size)]  # a row per centroid
        if (moved == centroids).all():
            break  # every further round would repeat this one
        centroids = moved
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(key, cluster, distance)."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in _slices(batches):
            number, distance = search.nearest(_matrix(batch.column(1), size))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number, pa.int32()), pa.array(distance)], ["key", "cluster", "distance"])

    return vectors.mapInArrow(run, f"key {vectors.schema['key'].dataType.simpleString()}, cluster int, distance long")


def cluster(
    rows: DataFrame, key: str = "vec_id", vec: str = "embedding", k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024,
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid) of every kept vector; the centroid is
    that of its cluster after the last round."""
    vectors = cut_lineage(integer_vectors(rows, key, vec, size, scale))
    wide = F.exists("v", lambda x: x.isNull() | (x > LIMIT) | (x < -LIMIT))
    if vectors.filter(wide).limit(1).count():
        raise ValueError(f"components beyond {LIMIT} after scaling")
    first = first_centroids(vectors, k)
    centroids = lloyd(vectors, first, rounds) if len(first) else np.zeros((1, size), np.int64)
    found = cut_lineage(assign(vectors, centroids))
    own = {
        r.cluster: int(r.own) for r in
        found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # a row per centroid
    }
    total = sum(own.values())
    facts = [(i, own.get(i, 0), total, [int(x) for x in c]) for i, c in enumerate(centroids)]
    table = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(table), "cluster").select(
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digests(clustered: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    text = F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string")))
    return clustered.select(
        key, "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text.cast("binary"), 256).alias("centroid_sha256"))
