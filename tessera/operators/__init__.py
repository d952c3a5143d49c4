"""Operations of schemas on columns and DataFrames.

Column forms return a Result(value, error); error is null for valid values, else
struct<code, path, reason>, the first error alone. DataFrame forms add columns or filter rows. The
source is JSON text (`string`), VARIANT (`json`: it came from JSON; `unknown`: it did not), or typed.
"""

import asyncio
import functools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alone, bound, json_in, wrapped_json
from ..plans import ERROR, Compiler, Options, Out, failure, first, none, rendered, together, type_of, unless
from ..plans.recursion import refers, unread
from ..schema import DEFAULTS, Schema, SchemaError, as_schema

_PARSED, _STRICT, _OUT, _RESULT = "__tessera_parsed", "__tessera_strict", "__tessera_out", "__tessera_result"
_PIECES = pa.schema([("task", pa.int32()), ("nth", pa.int32()), ("column", pa.int32()), ("n", pa.int64()), ("text", pa.string())])
_VALUE, _ERROR, _ENTERED = "__tessera_v", "__tessera_e", "__tessera_n"


@dataclass
class Result:
    """valid is error.isNull() without putting the error into words."""

    value: Column
    error: Column
    type: str
    valid: Column


def _linked(schemas: tuple) -> Schema:
    nodes = [as_schema(s) for s in schemas]
    if not nodes:
        raise SchemaError("an operation needs a schema")
    out = nodes[0]
    for s in nodes[1:]:
        out = out.convert(s)
    return out


def _result(s: Schema, out: Any) -> Result:
    if out.error is None:
        return Result(out.value, none(ERROR), type_of(s), F.lit(True))
    return Result(out.value, rendered(out.error), type_of(s), out.error.isNull())


def parser(*schemas: Any, options: Options | None = None) -> Callable[..., Result]:
    """unknown -> last output, with all checks; takes (column, source)."""
    s = _linked(schemas)

    def run(column: Column | str, source: str = "string") -> Result:
        c = F.col(column) if isinstance(column, str) else column

        def made(compiler: Compiler) -> Out:
            if source == "string":
                return _from_text(compiler, s, c, wrapped_json(c))
            if source in ("json", "unknown"):
                return compiler.parse(s, c, source)
            raise SchemaError(f"no such source: {source}")

        if not refers(s):
            return _result(s, made(Compiler(options)))
        # Errors and values of recursive schemas are columns of their own: what a query doesn't ask for is not computed.
        out, told = made(Compiler(options)), made(Compiler(options, values=not unread(s, s.defs)))
        return Result(out.value, rendered(told.error, once=True), type_of(s), told.error.isNull())

    return run


def decoder(*schemas: Any, options: Options | None = None) -> Callable[[Column | str], Result]:
    """Typed input -> output: type checks of the first schema are left out."""
    s = _linked(schemas)
    return lambda column: _result(s, Compiler(options).typed(s, F.col(column) if isinstance(column, str) else column))


def encoder(*schemas: Any, options: Options | None = None) -> Callable[[Column | str], Result]:
    """Typed output -> input: a decoder over the reversed schemas."""
    return decoder(*(as_schema(s).reverse() for s in schemas), options=options)


# Spark is asynchronous by itself: these are the same operations, and take coders made by async_coder.
async_parser, async_decoder, async_encoder = parser, decoder, encoder


def parse(df: DataFrame, column: str, s: Any, into: str = "value", mode: str = "permissive", source: str = "string", options: Options | None = None) -> DataFrame:
    """df with the parsed column. mode permissive adds `<into>_error`; drop_invalid leaves failing rows
    out; fail_fast ends the job with the first error's text."""
    node, compiler = as_schema(s), Compiler(options)
    if source != "string":
        return _staged(df, df, compiler.parse(node, F.col(column), source), node, into, mode)
    # The text is parsed once, below everything that reads it; outside of lambdas columns are compiled, so what is used
    # again is a column of its own.
    text, parsed = F.col(column), F.col(_PARSED)
    staged = df.select("*", wrapped_json(text).alias(_PARSED))
    ok = text.isNull() | (parsed.isNotNull() if compiler.o.trusted_json else alone(parsed))
    staged = staged.select(*(F.col(f"`{c}`") for c in df.columns), json_in(parsed).alias(_PARSED), ok.alias(_STRICT))
    out = compiler.parse(node, parsed, "json")
    if out.pair is not None:
        staged = staged.select("*", out.pair.alias(_OUT))
        out = out.inside(F.col(_OUT))
    bad = unless(F.col(_STRICT), failure((), "Expected JSON string, received ", got=text.cast("variant")))
    return _staged(df, staged, Out(out.value, first(bad, out.error)), node, into, mode)


def _from_text(compiler: Compiler, s: Schema, text: Column, parsed: Column) -> Out:
    shape: list[Out] = []

    def run(parsed: Column) -> Column:
        out = compiler.parse(s, json_in(parsed), "json")
        ok = text.isNull() | (parsed.isNotNull() if compiler.o.trusted_json else alone(parsed))
        bad = unless(ok, failure((), "Expected JSON string, received ", got=text.cast("variant")))
        shape.append(together([out], lambda o: Out(o[0].value, first(bad, o[0].error)), 1))
        return shape[-1].held()

    if refers(s):  # all of it is interpreted, so the text is parsed once only if it is bound
        pair = bound(parsed, run)
        return shape[-1].inside(pair, shape[-1].weight)
    run(parsed)
    return shape[-1]


def _staged(df: DataFrame, below: DataFrame, out: Out, s: Schema, into: str, mode: str) -> DataFrame:
    """The value and error of out beside the columns of df; columns of their names are replaced. Both are computed
    once: a generator of one row keeps later filters on them from being pushed into what computes them, and the error
    is put into words from a column, for failing rows alone."""
    made = {"__tessera_value": into, "__tessera_value_error": f"{into}_error"} if mode == "permissive" else {"__tessera_value": into}
    kept = [F.col(f"`{c}`") for c in df.columns if c not in made.values()]
    fields = [c for c, x in ((_VALUE, out.value), (_ERROR, out.error), (_ENTERED, out.entered)) if x is not None]
    rows = below.select(*kept, out.held().alias(_RESULT)).select(*kept, F.inline(F.array(_RESULT)).alias(*fields))
    result = _result(s, Out(F.col(_VALUE), None if out.error is None else F.col(_ERROR)))
    done = _in_mode(rows, result, "__tessera_value", mode)
    return done.select(*kept, *(F.col(k).alias(v) for k, v in made.items()))


def decode(df: DataFrame, column: Column | str, *schemas: Any, into: str = "value", mode: str = "permissive") -> DataFrame:
    return _converted(df, column, _linked(schemas), into, mode)


def encode(df: DataFrame, column: Column | str, *schemas: Any, into: str = "value", mode: str = "permissive") -> DataFrame:
    return _converted(df, column, _linked(tuple(as_schema(s).reverse() for s in schemas)), into, mode)


def _converted(df: DataFrame, column: Column | str, s: Schema, into: str, mode: str) -> DataFrame:
    return _staged(df, df, Compiler().typed(s, F.col(column) if isinstance(column, str) else column), s, into, mode)


def _in_mode(df: DataFrame, r: Result, into: str, mode: str) -> DataFrame:
    if mode == "permissive":
        return df.select("*", F.when(r.valid, r.value).alias(into), r.error.alias(f"{into}_error"))
    if mode == "drop_invalid":
        return df.select("*", r.value.alias(into), r.valid.alias("__tessera_valid")).filter("__tessera_valid").drop("__tessera_valid")
    if mode == "fail_fast":
        return df.select("*", F.when(r.valid, r.value).otherwise(F.raise_error(message(r.error))).alias(into))
    raise SchemaError(f"no such mode: {mode}")


def message(error: Column) -> Column:
    where = F.when(F.size(error["path"]) > 0, F.concat(F.lit("at "), path_text(error["path"]))).otherwise(F.lit("at root"))
    return F.concat(F.lit("Failed "), where, F.lit(": "), error["reason"])


def path_text(path: Column) -> Column:
    """["a"]["0"] of an array of segments."""
    return F.array_join(F.transform(path, lambda p: F.concat(F.lit("["), F.to_json(p.cast("variant")), F.lit("]"))), "")


def path_to_array(text: str) -> list[str]:
    """The segments of a path's text; a segment is a JSON string and may hold brackets itself."""
    read, out, at = json.JSONDecoder().raw_decode, [], 0
    while at < len(text):
        if text[at] != "[":
            raise ValueError(f"no path: {text}")
        part, end = read(text, at + 1)
        if text[end:end + 1] != "]":
            raise ValueError(f"no path: {text}")
        out.append(part)
        at = end + 1
    return out


def path_from_array(path: list[str]) -> str:
    return "".join(f"[{json.dumps(p)}]" for p in path)


def path_concat(a: str, b: str) -> str:
    return a + b


def is_valid(s: Any, column: Column | str, source: str = "string", options: Options | None = None) -> Column:
    return parser(s, options=options)(column, source).valid


def assert_valid(df: DataFrame, column: str, s: Any, source: str = "string") -> DataFrame:
    """df, whose job fails at the first invalid value."""
    r = parser(s)(column, source)
    return df.filter(F.when(r.valid, F.lit(True)).otherwise(F.raise_error(message(r.error))))


def safe(r: Result) -> Column:
    """struct<success, value, error>."""
    return F.struct(r.valid.alias("success"), F.when(r.valid, r.value).alias("value"), r.error.alias("error"))


safe_async = safe


def standard_validate(s: Any, column: Column | str, source: str = "string") -> Column:
    """struct<value, issues>: issues is null, or an array with the first issue's message and path."""
    r = parser(s)(column, source)
    issue = F.array(F.struct(r.error["reason"].alias("message"), r.error["path"].alias("path")))
    return F.struct(F.when(r.valid, r.value).alias("value"), F.when(~r.valid, issue).alias("issues"))


def standard(s: Any) -> dict[str, Any]:
    """The `~standard` interface of a schema: validation of a column, documents of both sides."""
    from ..jsonschema import to_json_schema

    s = as_schema(s)
    return {"version": 1, "vendor": "tessera", "validate": functools.partial(standard_validate, s), "jsonSchema": {
        "input": lambda target=None: to_json_schema(s, target), "output": lambda target=None: to_json_schema(s.reverse(), target)}}


def reverse(s: Any) -> Schema:
    return as_schema(s).reverse()


def coder(fn: Callable, returns: str) -> Callable[[Column], Column]:
    """A Python function of one value as a conversion; what it raises becomes invalid_conversion. Values go
    to Python and back in Arrow batches."""
    @F.udf(returnType=f"struct<value:{returns},error:string>", useArrow=True)
    def run(x: Any) -> tuple:
        try:
            return fn(x), None
        except Exception as e:  # noqa: BLE001
            return None, str(e)

    return _catching(run)


def _catching(run: Callable[[Column], Column]) -> Callable[[Column], Column]:
    wrapped = functools.partial(lambda c: run(c))
    wrapped.catches = True
    return wrapped


def async_coder(fn: Callable, returns: str, in_flight: int = 64, timeout: float | None = None) -> Callable[[Column], Column]:
    """An `async def` of one value as a conversion: up to in_flight calls of a task wait at once, values keep their
    order. What a call raises, or a call of more than timeout seconds, becomes invalid_conversion of its value alone;
    null is not passed on. A task holds the values of one Arrow batch."""
    @F.pandas_udf(f"struct<value:{returns},error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        async def one(x: Any, room: asyncio.Semaphore) -> tuple:
            async with room:
                try:
                    return await asyncio.wait_for(fn(x), timeout), None
                except TimeoutError:
                    return None, f"no answer in {timeout} s"
                except Exception as e:  # noqa: BLE001
                    return None, str(e)

        async def all_(xs: list) -> list[tuple]:
            room = asyncio.Semaphore(in_flight)
            return await asyncio.gather(*(_nothing() if x is None else one(x, room) for x in xs))

        with asyncio.Runner() as loop:
            for batch in batches:
                values = [None if pd.api.types.is_scalar(x) and pd.isna(x) else x for x in batch.tolist()]
                made = loop.run(all_(values))
                yield pd.DataFrame({"value": pd.Series([v for v, _ in made], dtype=object), "error": pd.Series([e for _, e in made], dtype=object)})

    return _catching(run)


async def _nothing() -> tuple:
    return None, None


def batch_coder(fn: Callable, returns: str) -> Callable[[Column], Column]:
    """A function of a pandas Series to one of the same length as a conversion. If it raises, the values of the batch are
    tried one by one, so that an error is that of its value alone."""
    @F.pandas_udf(f"struct<value:{returns},error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(x: pd.Series) -> tuple:
            try:
                return fn(x.reset_index(drop=True)).iloc[0], None
            except Exception as e:  # noqa: BLE001
                return None, str(e)

        for batch in batches:
            try:
                yield pd.DataFrame({"value": fn(batch), "error": None})
            except Exception:  # noqa: BLE001
                made = [one(batch.iloc[i:i + 1]) for i in range(len(batch))]
                yield pd.DataFrame({"value": pd.Series([v for v, _ in made], dtype=object), "error": pd.Series([e for _, e in made], dtype=object)})

    return _catching(run)


def columns_of(s: Schema, order_by: str) -> Column:
    """Aggregate: the rows of a group as compact columns, JSON text, in order. Groups are bounded by the caller."""
    if s.kind != "object":
        raise SchemaError("compact columns need an object schema")
    rows = F.sort_array(F.collect_list(F.struct(F.col(order_by).alias("_o"), *(F.col(k) for k, _ in s.props))))

    def column(name: str, kind: Schema) -> Column:
        cells = F.transform(rows, lambda r: F.coalesce(Compiler().text(kind, r[name], ()).value, F.lit("null")))
        return F.concat(F.lit("["), F.array_join(cells, ","), F.lit("]"))

    parts = [column(k, t) for k, t in s.props]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def column_pieces(df: DataFrame, s: Schema, order_by: str | list[str], most: int = 1 << 16) -> DataFrame:
    """All rows of df as one compact columns text, in pieces: `position`, `column`, `first_row`, `text`, whose texts in
    order of position make the JSON text. Rows are ranged over tasks by order_by and each task writes pieces of its own
    rows, `most` cells at most, so no task holds a column or the table. first_row counts the rows before a piece; ties in
    order_by are broken by the cells. Without rows the text has empty columns."""
    if s.kind != "object":
        raise SchemaError("compact columns need an object schema")
    names = [n for n, _ in s.props]
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    cell = lambda n, kind: F.coalesce(Compiler().text(kind, F.col(f"`{n}`"), (n,)).value, F.lit("null"))
    cells = df.select(*(F.col(k).alias(f"__tessera_o{i}") for i, k in enumerate(keys)), *(cell(n, t).alias(f"__tessera_c{j}") for j, (n, t) in enumerate(s.props)))
    order = [c for c in cells.columns]
    ranged = cells.repartitionByRange(*order[:len(keys)]).sortWithinPartitions(*order).select(*order[len(keys):], F.spark_partition_id().alias("__tessera_p"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                batch = whole.slice(at, most)
                task = batch.column(len(names))[0].as_py()
                texts = [",".join(batch.column(j).to_pylist()) for j in range(len(names))]
                yield pa.RecordBatch.from_pydict({"task": [task] * len(names), "nth": [nth] * len(names), "column": list(range(len(names))), "n": [batch.num_rows] * len(names), "text": texts}, _PIECES)
                nth += 1

    pieces = ranged.mapInArrow(write, "task int, nth int, column int, n long, text string")
    # One row per piece is what the windows see; the number of rows before a piece is the same for every column.
    ordered = Window.partitionBy("column").orderBy("task", "nth")
    pieces = pieces.select("column", "task", "nth", (F.sum("n").over(ordered) - F.col("n")).alias("first_row"), F.row_number().over(ordered).alias("at"),
                           F.count(F.lit(1)).over(Window.partitionBy("column")).alias("of"), "text")
    start = F.when(F.col("at") > 1, ",").when(F.col("column") == 0, "[[").otherwise(",[")
    end = F.when(F.col("at") < F.col("of"), "").when(F.col("column") == len(names) - 1, "]]").otherwise("]")
    position = (F.col("column").cast("long") * F.col("of") + F.col("at") - 1).alias("position")
    made = pieces.select(position, "column", "first_row", F.concat(start, "text", end).alias("text"))
    empty = df.sparkSession.createDataFrame([(0, 0, 0, "[" + ",".join("[]" for _ in names) + "]")], made.schema)
    return made.unionByName(empty.join(df.limit(1).select(F.lit(1).alias("__tessera_any")), F.lit(True), "left_anti")).orderBy("position")


def error_statistics(df: DataFrame, error: str = "value_error") -> DataFrame:
    """Failing rows by code and path."""
    return df.filter(F.col(error).isNotNull()).groupBy(
        F.col(error)["code"].alias("code"), path_text(F.col(error)["path"]).alias("path")).agg(F.count(F.lit(1)).alias("n"))


def to_struct_type(s: Schema) -> str:
    return type_of(s)


def with_default_extras(s: Schema, mode: str) -> Schema:
    """The schema as under a global default extras mode."""
    return replace(s, extras=mode) if s.kind == "object" else s


def global_options(default_extras: str = "strip", allow_nan: bool = False) -> None:
    """Defaults for what is made from now on: the extras mode of objects, and if numbers may be NaN. Without
    arguments, the first ones again. They are read on the driver, while schemas and columns are made."""
    if default_extras not in ("strip", "strict"):
        raise SchemaError(f"no such extras mode: {default_extras}")
    DEFAULTS.update(extras=default_extras, allow_nan=allow_nan)


def schema_of(kind: Any) -> Schema:
    """The schema of a Spark type: structs are objects, nullable fields optional."""
    from pyspark.sql import types as T

    from .. import schema as S

    if isinstance(kind, T.StructType):
        return S.object_({f.name: S.optional(schema_of(f.dataType)) if f.nullable else schema_of(f.dataType) for f in kind})
    if isinstance(kind, T.ArrayType):
        return S.array(S.optional(schema_of(kind.elementType)) if kind.containsNull else schema_of(kind.elementType))
    if isinstance(kind, T.MapType):
        return S.record(schema_of(kind.valueType))
    plain = {T.StringType: S.string, T.DoubleType: S.number, T.FloatType: S.number, T.IntegerType: S.int32, T.BooleanType: S.boolean,
             T.LongType: S.bigint, T.DecimalType: S.bigint, T.TimestampType: S.date, T.BinaryType: S.uint8_array, T.VariantType: S.json_value}
    if type(kind) not in plain:
        raise SchemaError(f"no schema for {kind}", "unsupported_decode")
    return plain[type(kind)]
