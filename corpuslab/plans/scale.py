"""Plan-shaping helpers: lineage cuts, exact ranks without a single-task window,
hash cut points, joins with split hot keys and size-checked small tables."""

from __future__ import annotations

import gc
import math
import random
import tempfile
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

MAX_INLINE_ROWS = 10_000
MAX_INLINE_CHARS = 16 << 20
TEXT_PER_TASK = 4 << 20
RELEASE_EVERY = 3.0  # seconds; a collection takes a fraction of one
_released = -math.inf  # when the driver was last told to collect its garbage
_PARTITION_SHIFT = 33  # monotonically_increasing_id keeps the partition number above bit 33


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; a temporary one only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master == "local" or context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpuslab-ckpt-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def drop_unused(spark: SparkSession, every: float = RELEASE_EVERY) -> None:
    """Let Spark delete the shuffle files and checkpoints that nothing refers to any more: it does so when the driver collects
    its garbage, which by itself may take half an hour. Not more often than ``every`` so many seconds."""
    global _released
    if time.monotonic() - _released < every:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _released = time.monotonic()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the reliable checkpoint folder and read on from there."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    drop_unused(spark)
    return df.checkpoint(eager=True)


def cut_plan(df: DataFrame) -> tuple[DataFrame, str]:
    """Write the rows as Parquet under the checkpoint folder and read on from there; also the path, for
    ``forget``. A checkpoint keeps the size estimate of its plan, and a loop with joins would multiply it in
    every round; files give their own sizes."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    drop_unused(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete the files of a round that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Slots:
    """Rows written once under the checkpoint folder, the rows of each of ``n`` slots in files of their own: reading one
    slot costs what it holds, however many others there are. ``spread`` (a hash) deals a slot to its files."""

    def __init__(self, df: DataFrame, n: int, slot: Column, spread: Column, files: int = 4):
        self.spark, self.n, self.schema = df.sparkSession, n, df.schema
        ensure_checkpoint_dir(self.spark)
        self.path = f"{self.spark.sparkContext.getCheckpointDir()}/slots-{uuid.uuid4().hex}"
        dealt = df.withColumn("_slot", slot).withColumn("_file", F.pmod(spread, F.lit(files)))
        placed = dealt.repartition(n * files, "_slot", "_file").drop("_file")
        placed.write.partitionBy("_slot").parquet(self.path)
        self.held = {r[0] for r in placed.sparkSession.read.parquet(self.path).select("_slot").distinct().collect()}  # n at most

    def order(self, seed: int) -> list[int]:
        """The slots that hold rows, in an order of their own for every seed."""
        slots = sorted(self.held)
        random.Random(seed).shuffle(slots)
        return slots

    def read(self, slot: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/_slot={slot}")

    def forget(self) -> None:
        forget(self.spark, self.path)


def widen_scan(df: DataFrame) -> DataFrame:
    """Redistribute rows only when the files give fewer splits than there are cores.

    Large inputs arrive in many splits and pass through untouched.
    """
    spark = df.sparkSession
    if df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def place_by_size(df: DataFrame, key: str, text: str, per_task: int = TEXT_PER_TASK) -> DataFrame:
    """Put the rows of a key together in as many partitions as the measured bytes of ``text`` need, so what a task
    grows out of its texts does not grow with the table. Texts that fit one task leave the number to Spark."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    if total <= per_task:
        return df.repartition(key)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(total / per_task)), key)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row. The optimizer merges a plain projection
    into a later lambda that reads it, which would evaluate it again for every element; a
    one-row generator is not merged."""
    made = F.struct(*(value.alias(name) for name, value in columns.items()))
    return df.select("*", F.inline(F.array(made)))


def bounded_rows(df: DataFrame, limit: int = MAX_INLINE_ROWS) -> list:
    """Collect a table that must be small; raise instead of truncating when it is not."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"expected at most {limit} rows in a dimension table")
    return rows


def inline_table(df: DataFrame, limit: int = MAX_INLINE_ROWS) -> Column:
    """A size-checked table as one constant array<struct> column, so no join is planned."""
    as_json = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    body = ",".join(row.j for row in bounded_rows(as_json, limit))
    if len(body) > MAX_INLINE_CHARS:
        raise ValueError(f"expected at most {MAX_INLINE_CHARS} characters in a constant table")
    return F.from_json(F.lit(f"[{body}]"), T.ArrayType(df.schema))


def global_rank(
    df: DataFrame, order: Sequence[str], within: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """Exact 0-based rank by ``order`` (a total key), optionally restarting per group.

    One range-partitioned sort on (within, order), so a group of any size is spread over
    tasks. The sorted rows are checkpointed with their position; offsets come from one
    row per partition, and group starts from one row per (partition, group).
    """
    within = list(within)
    placed = cut_lineage(
        df.orderBy(*within, *order).withColumn("_at", F.monotonically_increasing_id())
    )
    pid = F.shiftrightunsigned("_at", _PARTITION_SHIFT)
    pos = F.col("_at").bitwiseAND(F.lit((1 << _PARTITION_SHIFT) - 1))
    placed = placed.withColumn("_pid", pid).withColumn("_pos", pos)
    before = W.Window.orderBy("_pid").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_pid")
        .agg(F.count("*").alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    indexed = placed.join(F.broadcast(offsets), "_pid").withColumn(
        "_idx", F.col("_off") + F.col("_pos")
    )
    if within:
        starts = (
            indexed.groupBy("_pid", *within)
            .agg(F.min("_idx").alias("_first"))
            .withColumn("_start", F.min("_first").over(W.Window.partitionBy(*within)))
            .drop("_first")
        )
        indexed = indexed.join(starts, ["_pid", *within]).withColumn(
            "_idx", F.col("_idx") - F.col("_start")
        )
    return indexed.withColumn(name, F.col("_idx")).select(*df.columns, name)


def running(
    df: DataFrame, group: str, position: str, value: str, how: str, name: str, block: int = 4096
) -> DataFrame:
    """Running min or max before the current row, safe for a group holding most rows.

    Positions are cut in blocks; block extremes are scanned per group (one row per block)
    and each block is finished on its own.
    """
    if how not in ("min", "max"):
        raise ValueError(f"unknown running aggregate {how!r}")
    fold = F.min if how == "min" else F.max
    pick = F.least if how == "min" else F.greatest
    blocked = df.withColumn("_block", F.floor(F.col(position) / block))
    earlier = (
        W.Window.partitionBy(group).orderBy("_block").rowsBetween(W.Window.unboundedPreceding, -1)
    )
    carry = (
        blocked.groupBy(group, "_block")
        .agg(fold(value).alias("_extreme"))
        .withColumn("_carry", fold("_extreme").over(earlier))
        .drop("_extreme")
    )
    inside = (
        W.Window.partitionBy(group, "_block")
        .orderBy(position)
        .rowsBetween(W.Window.unboundedPreceding, -1)
    )
    return (
        blocked.join(carry, [group, "_block"])
        .withColumn(name, pick("_carry", fold(value).over(inside)))
        .drop("_block", "_carry")
    )


def measured(df: DataFrame, limit: int = MAX_INLINE_ROWS) -> DataFrame:
    """Materialise a table expected to be small and mark it for broadcast only if it counts
    at most ``limit`` rows; a larger one is joined by shuffle."""
    small = cut_lineage(df)
    return F.broadcast(small) if small.count() <= limit else small


def hot_keys(df: DataFrame, key: str) -> dict:
    """Keys with more rows than a shuffle partition's even share, with the number of parts that
    bring them to a quarter of it, as parts of several keys meet in a partition. There are fewer than shuffle partitions by construction, whatever
    the size of the data; one pass counts the rows per key with map-side combine."""
    counts = cut_lineage(df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, math.ceil((counts.agg(F.sum("n")).first()[0] or 0) / partitions))
    return {row[key]: math.ceil(4 * row.n / share) for row in counts.filter(F.col("n") > share).collect()}


def hot_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    hot: dict,
    spread_by: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Join where ``left`` repeats the hot keys: their left rows are split by ``spread_by``
    and only their right rows are copied."""
    if not hot:
        return left.join(right, on, how)
    schema = T.StructType([T.StructField(on, left.schema[on].dataType), T.StructField("_parts", T.IntegerType())])
    parts = F.broadcast(left.sparkSession.createDataFrame(list(hot.items()), schema))  # see hot_keys for the bound
    copies = F.coalesce("_parts", F.lit(1))
    lhs = left.join(parts, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), copies).cast("int")).drop("_parts")
    rhs = right.join(parts, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_parts")
    return lhs.join(rhs, [on, "_salt"], how).drop("_salt")
