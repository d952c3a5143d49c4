"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

The rows lie in P source partitions and go to Q target blocks, whose sizes are fixed beforehand; a
shard is a run of blocks, and shard sizes differ by one at most. How many rows of a partition go to
a block in a uniform permutation follows the multivariate hypergeometric law. A row of that matrix is
drawn in its own task by descending a binary tree over the partitions: at a node the block sizes are
split between its halves, with a generator seeded by the node, so all tasks see the same matrix and
no one holds it. A task then permutes its rows and labels them; after the exchange every block is
permuted again, and a row's slot is its block's offset plus its rank.

Defined cases: repeated rows and ties are rows like others; null ids are kept; an empty table gives an
empty result; columns named like the result's own are replaced. The same input partitions and seed
give the same result; the input is written first, so a retried task sees the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import shared_dir

_OWN = ("shard", "slot")
#: Rows from which numpy's draws give way to inversion.
LARGE = 1_000_000_000


def block_sizes(n: int, n_shards: int, per_block: int) -> tuple[np.ndarray, int]:
    """Sizes of all blocks, and blocks in a shard: blocks of a shard are gapless, sizes at most one apart."""
    each = max(1, math.ceil(math.ceil(n / n_shards) / per_block))
    shards = np.full(n_shards, n // n_shards, np.int64)
    shards[: n % n_shards] += 1
    sizes = np.repeat(shards // each, each).reshape(n_shards, each)
    sizes += np.arange(each)[None, :] < (shards % each)[:, None]
    return sizes.ravel(), each


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of `take` rows drawn from good + bad are good."""
    n = good + bad
    if n < LARGE:
        return int(rng.hypergeometric(good, bad, take)) if n else 0
    # Inversion: weights relative to the mode's, by the exact ratio of neighbours, ten deviations to a side.
    low, high = max(0, take - bad), min(take, good)
    mode = min(high, max(low, (take + 1) * (good + 1) // (n + 2)))
    reach = int(10 * math.sqrt(take / n * good / n * bad * (n - take) / (n - 1))) + 50
    low, high = max(low, mode - reach), min(high, mode + reach)

    def ratio(k: np.ndarray) -> np.ndarray:
        """Weight of k + 1 to that of k."""
        return (good - k) * (take - k) / ((k + 1) * (bad - take + k + 1))

    k = np.arange(low, high, dtype=np.float64)
    up, down = np.cumprod(ratio(k[mode - low:])), np.cumprod(1 / ratio(k[:mode - low][::-1]))[::-1]
    total = np.cumsum(np.concatenate([down, [1.0], up]))
    return low + int(np.searchsorted(total, rng.random() * total[-1], side="right"))


def _split(rng: np.random.Generator, sizes: np.ndarray, take: int) -> np.ndarray:
    """How many of `take` uniformly drawn rows come from each block."""
    if len(sizes) == 1:
        return np.array([take], np.int64)
    n = int(sizes.sum())
    if n < LARGE:
        return rng.multivariate_hypergeometric(sizes, take, method="marginals")
    half = len(sizes) // 2
    first = int(sizes[:half].sum())
    got = _hypergeometric(rng, first, n - first, take)
    return np.concatenate([_split(rng, sizes[:half], got), _split(rng, sizes[half:], take - got)])


def matrix_row(counts: np.ndarray, sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row `part` of the communication matrix of partitions with `counts` rows to blocks of `sizes`."""
    low, high, left = 0, len(counts), sizes.copy()
    while high - low > 1:
        mid = (low + high) // 2
        first = _split(np.random.default_rng([seed, low, high]), left, int(counts[low:mid].sum()))
        left, low, high = (first, low, mid) if part < mid else (left - first, mid, high)
    return left


def shuffle_shards(df: DataFrame, n_shards: int = 16, seed: int = 7, per_block: int = 65_536) -> DataFrame:
    """df with shard (0 to n_shards - 1) and slot (gapless from 0 in its shard)."""
    spark, own = df.sparkSession, df.drop(*_OWN)
    folder = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    fixed = own.checkpoint()
    per_part = {r.p: r.n for r in fixed.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = fixed.rdd.getNumPartitions()
    counts = np.array([per_part.get(p, 0) for p in range(parts)], np.int64)
    n = int(counts.sum())
    _, each = block_sizes(n, n_shards, per_block)
    held = spark.sparkContext.broadcast(counts)  # a number per partition

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        sizes, _ = block_sizes(n, n_shards, per_block)
        row = matrix_row(held.value, sizes, part, seed)
        rng = np.random.default_rng([seed, 1, part])
        labels = rng.permutation(np.repeat(np.arange(len(sizes), dtype=np.int32), row))
        for batch in batches:
            own = labels[at:at + batch.num_rows]
            if len(own) < batch.num_rows:
                raise RuntimeError(f"partition {part} has more rows than when it was counted")
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own), pa.array(rng.integers(1 << 62, size=len(own)))], names=[*batch.schema.names, "__tessera_block", "__tessera_key"])

    schema = T.StructType([*fixed.schema, T.StructField("__tessera_block", T.IntegerType()), T.StructField("__tessera_key", T.LongType())])
    moved = fixed.mapInArrow(label, schema)
    rank = F.row_number().over(Window.partitionBy("__tessera_block").orderBy("__tessera_key")) - 1
    # A block's offset in its shard follows from the sizes: no join.
    shard = F.floor(F.col("__tessera_block") / each).cast("int")
    of_shard = F.lit(int(n // n_shards)) + F.when(F.col("shard") < int(n % n_shards), 1).otherwise(0)
    k = F.col("__tessera_block") - F.col("shard") * each
    offset = k * F.floor(of_shard / each) + F.least(k, of_shard % each)
    ranked = moved.withColumn("__tessera_rank", rank).withColumn("shard", shard)
    return ranked.withColumn("slot", (offset + F.col("__tessera_rank")).cast("long")).drop("__tessera_block", "__tessera_key", "__tessera_rank")
