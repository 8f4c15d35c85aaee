"""Radial kernels by landmarks: a feature map whose dot products stand in for exp(-gamma |x - z|^2).

The map of a problem is fitted on at most ``landmarks`` of its rows, those with the smallest key hashes (the
documented bound of the fit); with K the kernel among them, a row becomes k(row, landmarks) K^(-1/2) on K's
range. Its length says how good the map is: with residual r = 1 - |phi|^2 the error of any entry is at most
sqrt(r_x r_z), and it is zero when all rows are landmarks. Machines on these features are the kernel's.
No query uses the map: the grid's radial machines are fitted with the exact kernel (``radial``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LANDMARKS = 256
ROWS_PER_PART = 1024


def choose_landmarks(rows: DataFrame, landmarks: int = LANDMARKS) -> DataFrame:
    """(problem, marks): the landmark rows of every problem; the limit is applied in each task first."""
    order = Window.partitionBy("problem").orderBy("_h", "key")
    ranked = rows.select("problem", "key", "idx", "val", F.xxhash64(F.col("key").cast("string")).alias("_h")).withColumn(
        "_n", F.row_number().over(order))
    kept = F.array_sort(F.collect_list(F.struct("_n", "idx", "val")))
    return ranked.filter(F.col("_n") <= landmarks).groupBy("problem").agg(kept.alias("marks"))


def _sparse(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, terms, values) of rows (.., idx, val)."""
    *_, idx, val = rows.flatten()
    sizes = pc.list_value_length(idx).to_numpy(zero_copy_only=False).astype(np.int64)
    return (np.concatenate([[0], np.cumsum(sizes)]), idx.flatten().to_numpy(zero_copy_only=False),
            val.flatten().to_numpy(zero_copy_only=False))


class RadialMap:
    """The feature maps of one problem for several gammas."""

    def __init__(self, marks: pa.StructArray):
        ends, terms, values = _sparse(marks)
        self.terms, cols = np.unique(terms, return_inverse=True)
        self.marks = np.zeros((len(self.terms), len(ends) - 1))
        self.marks[cols, np.repeat(np.arange(len(ends) - 1), np.diff(ends))] = values
        self.square = (self.marks * self.marks).sum(0)
        self.own = np.maximum(self.square[:, None] + self.square[None, :] - 2 * self.marks.T @ self.marks, 0.0)

    def distances(self, rows: pa.StructArray) -> np.ndarray:
        """Squared distances of rows and landmarks; terms that no landmark has count in the row's length."""
        ends, terms, values = _sparse(rows)
        sizes = np.diff(ends)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        square = np.bincount(owner, values * values, minlength=len(sizes))
        place = np.searchsorted(self.terms, terms)
        place[place == len(self.terms)] = 0
        known = self.terms[place] == terms if len(self.terms) else np.zeros(len(terms), bool)
        dense = np.zeros((len(sizes), len(self.terms)))
        dense[owner[known], place[known]] = values[known]
        return np.maximum(square[:, None] + self.square[None, :] - 2 * dense @ self.marks, 0.0)

    def root(self, gamma: float) -> np.ndarray:
        """K^(-1/2) on the range of K, as columns of its eigenvectors."""
        value, vector = np.linalg.eigh(np.exp(-gamma * self.own))
        real = value > value[-1] * 1e-10
        return vector[:, real] / np.sqrt(value[real])


def radial_features(rows: DataFrame, gammas: Sequence[float], landmarks: int = LANDMARKS, fit: str = "true") -> DataFrame:
    """(problem, gamma, key, y, fold, role, idx, val, residual): the rows (problem, key, y, fold, role, idx, val) in the
    map of their problem, which the rows that meet the condition ``fit`` make."""
    marks = choose_landmarks(rows.filter(fit), landmarks)
    most = rows.groupBy("problem").count().agg(F.max("count")).first()[0] or 1
    n = max(1, -(-most // ROWS_PER_PART))
    part = F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    row = F.struct("key", "y", "fold", "role", "idx", "val")
    parts = rows.groupBy("problem", part.alias("part")).agg(F.collect_list(row).alias("rows"))
    copies = marks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))  # one per part of the problem
    joined = parts.join(copies, ["problem", "part"]).select("problem", "rows", "marks")
    key_type = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found, own = RadialMap(batch.column(2)[i].values), batch.column(1)[i].values
                far = found.distances(own)
                key, y, fold, role, *_ = own.flatten()
                for gamma in gammas:
                    made = np.exp(-gamma * far) @ found.root(gamma)
                    size = made.shape[1]
                    ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * size)
                    places = pa.array(np.tile(np.arange(size, dtype=np.int32), len(made)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([batch.column(0)[i].as_py()] * len(made)), pa.array(np.full(len(made), gamma)), key, y, fold, role,
                        pa.ListArray.from_arrays(ends, places), pa.ListArray.from_arrays(ends, pa.array(made.ravel())),
                        pa.array(1.0 - (made * made).sum(1))],
                        ["problem", "gamma", "key", "y", "fold", "role", "idx", "val", "residual"])

    return joined.mapInArrow(run, (
        f"problem string, gamma double, key {key_type}, y int, fold int, role string, idx array<int>, val array<double>, residual double"))
