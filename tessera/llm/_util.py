"""Helpers shared by the corpus operators: tables, the shared folder, batches of bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own default of the setting: it names no shared folder, so tests get a fresh one.
_UNSET = ("", "/tmp/checkpoints")
#: Bits of the table that says which documents an exchange of texts needs: at most 4 MB are broadcast.
BLOOM_BITS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if found in _UNSET:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="tessera-")
        shared_dir.own = found
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"


def written(df: DataFrame, partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path: the lineage ends there."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def needed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without most of those whose doc_id is not in ids: a bit table of fixed size rules them out
    before texts are exchanged. It never rules out one of ids."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BLOOM_BITS))
    held = ids.select(bit("doc_id").alias("h")).groupBy(F.bitmap_bucket_number("h").alias("__tessera_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("__tessera_bits"))
    at = F.bitmap_bit_position(bit("doc_id"))
    octet = F.conv(F.hex(F.substring("__tessera_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return docs.withColumn("__tessera_bucket", F.bitmap_bucket_number(bit("doc_id"))).join(
        F.broadcast(held), "__tessera_bucket").filter(F.call_function("getbit", octet, (at % 8).cast("int")) == 1).select(docs.columns)


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def in_chunks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose column has about `most` bytes at most, one row at least."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        start = size = 0
        lengths = pa.compute.binary_length(batch.column(at)).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(lengths):
            yield batch.slice(start)
