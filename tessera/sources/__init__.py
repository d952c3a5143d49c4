"""Bringing JSON text and VARIANT columns to the parser, and writing encoded columns.

Files and tables are Spark's own readers and writers; these helpers only place the one parse of a
text before all that reads it, so it happens once per row.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import Options, encoder, parse
from ..schema import Schema, json_string


def json_lines(spark: SparkSession, path: str, s: Schema, into: str = "value", mode: str = "permissive", options: Options | None = None) -> DataFrame:
    """Lines of JSON text under path, parsed by s."""
    return parse(spark.read.text(path), "value", s, into="parsed", mode=mode, options=options).withColumnsRenamed(
        {"value": "line", "parsed": into, "parsed_error": f"{into}_error"})


def as_variant(df: DataFrame, column: str, into: str) -> DataFrame:
    """JSON text parsed once to VARIANT; null where it is no JSON."""
    return df.withColumn(into, F.try_parse_json(column))


def write_json_lines(df: DataFrame, column: str, s: Schema, path: str) -> None:
    """A typed column as lines of JSON text; the job fails at a value that has none."""
    r = encoder(json_string.convert(s))(column)
    df.select(F.when(r.error.isNotNull(), F.raise_error(r.error["reason"])).otherwise(r.value).alias("value")).write.text(path)


__all__ = ["as_variant", "json_lines", "write_json_lines"]
