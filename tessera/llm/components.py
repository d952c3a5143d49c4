"""Connected components of an edge table by alternating large and small stars.

Every round is two joins on node ids and a written table; the number of rounds grows with the
logarithm of the longest path. Tasks first contract the edges they hold. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import removed, written

#: Up to so many edges, one task contracts them all and no round follows.
LOCAL_EDGES = 200_000
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the task's edges, each node to its least node."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = y = above.get(y, y)
            x = y
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = root(u), root(v)
            if a != b:
                above[max(a, b)] = min(a, b)
        if len(above) > 1_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(above)), pa.array([root(x) for x in above])], schema=_EDGE)
            above.clear()
    if above:
        yield pa.RecordBatch.from_arrays([pa.array(list(above)), pa.array([root(x) for x in above])], schema=_EDGE)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reached) of all nodes of edges (u, v); loops are allowed, nulls not."""
    spark = edges.sparkSession
    now, path = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(
        _contracted, "u long, v long"))
    if now.count() <= LOCAL_EDGES:
        whole, _ = written(now.coalesce(1).mapInArrow(_contracted, "u long, v long"))
        removed(spark, path)
        return _named(whole)
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            lower.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = written(small)
        removed(spark, path)
        now, path = new, new_path
        # Exact for the stars' fixed point: order-free sums over all edges.
        said = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if said == before:
            break
        before = said
    return _named(now)


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
