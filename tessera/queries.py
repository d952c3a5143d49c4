"""One query per operator group over the tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as O
from . import schema as S
from . import tablequeries
from .functions import number_text
from .jsonschema import from_json_schema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _long(c: str):  # noqa: ANN202
    return F.col(c).cast("long").alias(c)


#: Every seventh event gets a value of the wrong type, every eleventh none, every thirteenth one key more.
def _broken() -> Column:
    return F.when(F.col("event_id") % 7 == 0, F.lit('{"k":"x"}')).when(F.col("event_id") % 11 == 0, F.lit("{}")).when(
        F.col("event_id") % 13 == 0, F.lit('{"k":5,"z":1}')).when(F.col("event_id") % 17 == 0, F.lit('{"k":null}')).otherwise(F.col("props"))

_BROKEN_SQL = ("CASE WHEN event_id % 7 = 0 THEN '{\"k\":\"x\"}' WHEN event_id % 11 = 0 THEN '{}' WHEN event_id % 13 = 0 THEN "
               "'{\"k\":5,\"z\":1}' WHEN event_id % 17 = 0 THEN '{\"k\":null}' ELSE props END")


@query("SELECT event_type, count(*)::BIGINT AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events "
       "WHERE (props->>'$.k')::BIGINT >= 50 GROUP BY event_type")
def parse_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.parse(_table(spark, sf_dir, "events").select("event_type", "props"), "props", S.object_({"k": S.int32.gte(50)}), mode="drop_invalid")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum("value.k").cast("long").alias("total"))


@query(f"SELECT event_id, json_type(p, '$.k') IN ('BIGINT', 'UBIGINT') AND try_cast(p->>'$.k' AS BIGINT) > 20 AS valid FROM (SELECT event_id, {_BROKEN_SQL} AS p FROM events)"
       .replace("json_type(p, '$.k') IN ('BIGINT', 'UBIGINT') AND try_cast(p->>'$.k' AS BIGINT) > 20", "coalesce(json_type(p, '$.k') IN ('BIGINT', 'UBIGINT') AND try_cast(p->>'$.k' AS BIGINT) > 20, false)"))
def is_valid_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", _broken().alias("p"))
    rows = O.parse(rows, "p", S.object_({"k": S.int32.gt(20)}))
    return rows.select("event_id", F.col("value_error").isNull().alias("valid"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'invalid_input' END AS code, CASE WHEN o_orderkey % 5 = 0 THEN 'p' END AS field, "
       "CASE WHEN o_orderkey % 5 = 0 THEN 'Expected number, received \"bad\"' END AS reason FROM orders")
def safe_orders_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit('{"p":"bad"}')).otherwise(F.concat(F.lit('{"p":'), F.col("o_totalprice").cast("string"), F.lit("}")))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    got = O.parse(rows, "t", S.object_({"p": S.number}), into="p")
    return got.select("o_orderkey", F.col("p_error.code").alias("code"), F.get("p_error.path", F.lit(0)).alias("field"), F.col("p_error.reason").alias("reason"))


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS valid FROM orders")
def enum_order_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("o_orderstatus").cast("variant")
    return _table(spark, sf_dir, "orders").select("o_orderkey", O.is_valid(S.enum(["F", "O"]), v, "json").alias("valid"))


@query("SELECT conv_id, turn, role IN ('user', 'assistant') AS valid FROM conversations")
def enum_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", O.is_valid(S.enum(["user", "assistant"]), F.col("role").cast("variant"), "json").alias("valid"))


@query("SELECT p_partkey, regexp_matches(p_brand, '^Brand#[1-3][0-9]$') AS valid FROM part")
def pattern_part_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", O.decoder(S.string.pattern("^Brand#[1-3][0-9]$"))("p_brand").valid.alias("valid"))


@query("SELECT l_orderkey, l_linenumber, l_quantity >= 5 AND l_quantity < 40 AS q, l_discount > 0.02 AND l_discount <= 0.08 AS d FROM lineitem")
def bounds_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", O.decoder(S.number.gte(5).lt(40))("l_quantity").valid.alias("q"),
        O.decoder(S.number.gt(0.02).lte(0.08))("l_discount").valid.alias("d"))


@query("SELECT l_orderkey, l_linenumber, l_quantity % 6 = 0 AS valid FROM lineitem")
def multiple_of_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", O.decoder(S.number.multiple_of(2).multiple_of(3))("l_quantity").valid.alias("valid"))


@query("SELECT doc_id, coalesce(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) BETWEEN 200 AND 2000, false) AS valid FROM documents")
def length_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", O.decoder(S.string.min_length(200).max_length(2000))("text").valid.alias("valid"))


@query("SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^\\s/?#]+[^\\s]*$') AND page_id % 3 <> 0 AS valid FROM pages")
def format_uri_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("page_id") % 3 == 0, F.concat(F.col("url"), F.lit(" x"))).otherwise(F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", O.decoder(S.uri)(text).valid.alias("valid"))


@query("SELECT c_custkey, (c_custkey * 3)::DOUBLE AS n, (c_custkey * 3)::VARCHAR AS t FROM customer")
def number_string_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.string.convert(S.number)
    rows = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 3).cast("string").alias("s"))
    rows = rows.select("c_custkey", O.decoder(s)("s").value.alias("n"))
    return rows.select("c_custkey", "n", O.encoder(s)("n").value.alias("t"))


@query("SELECT l_orderkey, l_linenumber, (l_orderkey::HUGEINT * 1000000007)::VARCHAR AS t FROM lineitem")
def string_to_bigint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey").cast("decimal(20,0)") * 1000000007).cast("string").alias("s"))
    s = S.string.convert(S.bigint)
    return rows.select("l_orderkey", "l_linenumber", O.decoder(s)("s").value.cast("string").alias("t"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS t FROM orders")
def date_encode_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", O.encoder(S.string.convert(S.date))(F.col("o_orderdate").cast("timestamp")).value.alias("t"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(chr(9) || ' ' || text || chr(10), '^\\s+', ''), '\\s+$', '')) AS t FROM documents")
def trim_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("\t "), F.col("text"), F.lit("\n"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(O.decoder(S.string.trim())(padded).value).alias("t"))


@query(f"SELECT event_id, len(json_keys(p)) > 1 AS extra FROM (SELECT event_id, {_BROKEN_SQL} AS p FROM events)")
def strict_rejects_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", _broken().alias("p"))
    error = O.parser(S.object_({"k": S.optional(S.unknown)}).strict())("p").error
    return rows.select("event_id", F.coalesce(error["code"] == "unrecognized_keys", F.lit(False)).alias("extra"))


@query(f"SELECT event_id, CASE WHEN json_type(p, '$.k') = 'VARCHAR' THEN NULL ELSE coalesce(try_cast(p->>'$.k' AS INTEGER), -1) END AS k FROM (SELECT event_id, {_BROKEN_SQL} AS p FROM events)")
def default_on_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.parse(_table(spark, sf_dir, "events").select("event_id", _broken().alias("p")), "p", S.object_({"k": S.optional(S.int32, -1)}))
    return rows.select("event_id", F.col("value.k").alias("k"))


_HAS = "json_type(p, '$.k')"


@query(f"SELECT event_id, coalesce({_HAS} = 'NULL', true) AND {_HAS} IS NOT NULL AS is_null, {_HAS} IS NULL AS is_missing, {_HAS} IS NULL OR {_HAS} = 'NULL' AS is_nullish "
       f"FROM (SELECT event_id, {_BROKEN_SQL} AS p FROM events)")
def nullable_vs_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", F.try_parse_json(_broken()).alias("v"))
    has = lambda s: O.parser(S.object_({"k": s}))("v", "unknown").valid
    return rows.select("event_id", has(S.nullable(S.never_())).alias("is_null"), has(S.optional(S.never_())).alias("is_missing"), has(S.nullish(S.never_())).alias("is_nullish"))


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'buy:' || (props->>'$.k') WHEN event_type = 'view' THEN 'see:' || (props->>'$.k') END AS said, "
       "CASE WHEN event_type NOT IN ('purchase', 'view') THEN 'invalid_input' END AS code FROM events")
def tagged_union_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"kind":"'), F.col("event_type"), F.lit('","p":'), F.col("props"), F.lit("}"))
    arm = lambda kind, verb: S.object_({"kind": kind, "p": S.object_({"k": S.int32})})  # noqa: E731, ARG005
    rows = O.parse(_table(spark, sf_dir, "events").select("event_id", text.alias("t")), "t", S.union(arm("purchase", "buy"), arm("view", "see")), into="v")
    rows = rows.select("event_id", "v", F.col("v_error.code").alias("code"))
    verb = F.when(F.col("v.kind") == "purchase", "buy:").when(F.col("v.kind") == "view", "see:")
    return rows.select("event_id", F.when(F.col("code").isNull(), F.concat(verb, F.col("v.p.k").cast("string"))).alias("said"), "code")


@query("SELECT event_id, CASE WHEN (props->>'$.k')::INT < 30 THEN 'small' WHEN (props->>'$.k')::INT % 2 = 0 THEN 'even' ELSE 'text' END AS arm FROM events")
def first_match_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda s, text: s.convert(S.string, decode=lambda _: F.lit(text))
    s = S.object_({"k": S.union(name(S.int32.lt(30), "small"), name(S.int32.multiple_of(2), "even"), name(S.number, "text"))})
    return O.parse(_table(spark, sf_dir, "events").select("event_id", "props"), "props", s).select("event_id", F.col("value.k").alias("arm"))


@query("SELECT c_custkey AS id, c_name AS label, c_mktsegment AS segment FROM customer")
def shape_rename_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.object_(lambda c: {"id": c.field("c_custkey", S.bigint), "who": {"label": c.field("c_name", S.string), "segment": c.field("c_mktsegment", S.string)}})
    rows = O.decode(_table(spark, sf_dir, "customer"), F.struct(F.col("c_custkey").cast("decimal(38,0)").alias("c_custkey"), "c_name", "c_mktsegment"), s)
    return rows.select(F.col("value.id").cast("long").alias("id"), "value.who.label", "value.who.segment")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders")
def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = S.object_({"status": S.string})

    def shape(c):  # noqa: ANN001, ANN202
        own = c.flatten(more)
        return {"id": c.field("id", S.number), "status": own["status"], "price": c.nested("money").field("total", S.number)}

    text = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.struct(F.col("o_totalprice").alias("total")).alias("money")))
    rows = O.parse(_table(spark, sf_dir, "orders").select(text.alias("t")), "t", S.object_(shape))
    return rows.select(F.col("value.id").cast("long").alias("id"), F.col("value.status").alias("status"), F.col("value.price").alias("price"))


@query("""SELECT c_custkey, '{"id":"' || c_custkey || '","name":"' || c_name || '","nation":' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN ',"segment":"' || c_mktsegment || '"' ELSE '' END || ',"ok":true}' AS t FROM customer""")
def encode_json_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.json_string.convert(S.object_({"id": S.bigint, "name": S.string, "nation": S.int32, "segment": S.optional(S.string), "ok": S.boolean}))
    row = F.struct(F.col("c_custkey").cast("decimal(38,0)").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
                   F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"), F.lit(True).alias("ok"))
    return _table(spark, sf_dir, "customer").select("c_custkey", O.encoder(s)(row).value.alias("t"))


@query("""SELECT n_nationkey, n_name, t FROM nation, (SELECT '[[' || string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) || '],[' || string_agg('"' || n_name || '"', ',' ORDER BY n_nationkey) || ']]' AS t FROM nation)""")
def compact_columns_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = S.object_({"n_nationkey": S.int32, "n_name": S.string})
    packed = _table(spark, sf_dir, "nation").agg(O.columns_of(row, "n_nationkey").alias("t"))  # 25 rows by the benchmark's definition
    return O.parse(packed, "t", S.compact_columns(row)).select("t", F.inline("value")).select("n_nationkey", "n_name", "t")


@query("SELECT vec_id, len(embedding)::INT AS n, list_min(embedding)::DOUBLE >= -0.5 AS low FROM embeddings")
def array_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.size(O.decoder(S.array(S.number))(x).value).alias("n"), O.decoder(S.array(S.number.gte(-0.5)))(x).valid.alias("low"))


@query(f"SELECT event_id, CASE WHEN coalesce(json_type(p, '$.k') IN ('BIGINT', 'UBIGINT'), json_array_length(json_keys(p)) IS NULL AND len(json_keys(p)) = 0) THEN coalesce((p->>'$.k')::DOUBLE, 0) + coalesce((p->>'$.z')::DOUBLE, 0) END AS total FROM (SELECT event_id, {_BROKEN_SQL} AS p FROM events)"
       .replace("json_array_length(json_keys(p)) IS NULL AND len(json_keys(p)) = 0", "len(json_keys(p)) = 0"))
def dict_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.parse(_table(spark, sf_dir, "events").select("event_id", _broken().alias("p")), "p", S.record(S.number))
    return rows.select("event_id", F.aggregate(F.map_values("value"), F.lit(0.0), lambda a, x: a + x).alias("total"))


def _document(name: str, document: dict, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = F.to_variant_object(F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")))
        return _table(spark, sf_dir, "orders").select("o_orderkey", O.is_valid(from_json_schema(document), v, "json").alias("valid"))

    run.__name__ = name
    query(f"SELECT o_orderkey, {sql} AS valid FROM orders")(run)


_OVER = lambda n: {"properties": {"price": {"type": "number", "minimum": n}}}
_IS = lambda s: {"properties": {"status": {"const": s}}}
_document("jsonschema_all_of", {"type": "object", "allOf": [_OVER(100000), _IS("F")]}, "o_totalprice >= 100000 AND o_orderstatus = 'F'")
_document("jsonschema_any_of", {"type": "object", "anyOf": [_OVER(100000), _IS("F")]}, "o_totalprice >= 100000 OR o_orderstatus = 'F'")
_document("jsonschema_one_of", {"type": "object", "oneOf": [_OVER(100000), _IS("F")]}, "(o_totalprice >= 100000) <> (o_orderstatus = 'F')")
_document("jsonschema_not", {"type": "object", "not": _OVER(100000)}, "o_totalprice < 100000")
_document("jsonschema_if_then", {"type": "object", "if": _IS("F"), "then": _OVER(50000), "else": _OVER(150000)}, "CASE WHEN o_orderstatus = 'F' THEN o_totalprice >= 50000 ELSE o_totalprice >= 150000 END")


@query("SELECT c_mktsegment, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment")
def compose_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    orders = orders.filter(O.is_valid(S.literal("F"), F.col("o_orderstatus").cast("variant"), "json"))
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.sum("o_orderkey").cast("long").alias("keys"))


@query(f"SELECT code, path, count(*)::BIGINT AS n FROM (SELECT 'invalid_input' AS code, '[\"k\"]' AS path, json_type(p, '$.k') AS t FROM (SELECT {_BROKEN_SQL} AS p FROM events)) WHERE t IS NULL OR t NOT IN ('BIGINT', 'UBIGINT') GROUP BY code, path")
def error_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.parse(_table(spark, sf_dir, "events").select(_broken().alias("p")), "p", S.object_({"k": S.int32}))
    return O.error_statistics(rows)


@query("SELECT l_orderkey, l_linenumber, regexp_replace((l_extendedprice * l_discount)::VARCHAR, '\\.0$', '') AS t FROM lineitem")
def number_text_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", number_text(F.col("l_extendedprice") * F.col("l_discount")).alias("t"))


QUERIES.update(tablequeries.QUERIES)
SQL.update(tablequeries.SQL)
