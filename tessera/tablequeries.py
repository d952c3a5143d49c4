"""A query per operator over values of the tables, good ones and bad ones at computed rows.

The input is an expression over a table's columns that both engines take; what the operator makes of it is
computed by Spark through a schema, and by SQL from the input with means of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as O
from . import schema as S
from .jsonschema import extend_json_schema, from_json_schema, to_json_schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_KEYS = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey, l_linenumber", "part": "p_partkey", "pages": "page_id",
         "documents": "doc_id", "events": "event_id", "conversations": "conv_id, turn"}


def over(name: str, table: str, x: str, made: Callable[[Column], Column], sql: str, dear: bool = False) -> None:
    """made(x) per row of a table, called `said`; sql computes the same from x. Where a row is much work (dear), rows are
    dealt to all cores: a file of few bytes is read by few tasks, in one if it is one row group."""
    keys = _KEYS[table].split(", ")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
        if dear:
            rows = rows.repartition(4 * spark.sparkContext.defaultParallelism)
        return rows.select("*", F.expr(x).alias("x")).select(*keys, made(F.col("x")).alias("said"))

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = f"SELECT {_KEYS[table]}, {sql} AS said FROM (SELECT *, {x} AS x FROM {table})"


def valid(name: str, table: str, x: str, s: object, sql: str, source: str = "string", dear: bool = False) -> None:
    over(name, table, x, lambda c: O.is_valid(s, c if source == "string" else F.try_parse_json(c), source), f"coalesce({sql}, false)", dear)


def matches(name: str, table: str, x: str, s: object, sql: str) -> None:
    """Validity of a typed value."""
    over(name, table, x, lambda c: O.decoder(s)(c).valid, f"coalesce({sql}, false)")


def value(name: str, table: str, x: str, s: object, sql: str, part: Callable[[Column], Column] = lambda v: v) -> None:
    """A part of the parsed value; null where it is not valid."""
    def made(c: Column) -> Column:
        r = O.parser(s)(c)
        return F.when(r.valid, part(r.value))

    over(name, table, x, made, sql)


def reason(name: str, table: str, x: str, s: object, sql: str) -> None:
    over(name, table, x, lambda c: O.parser(s)(c).error["reason"], sql)


def encoded(name: str, table: str, x: str, s: object, typed: Callable[[Column], Column], sql: str, after: Callable[[Column], Column] = lambda v: v) -> None:
    def made(c: Column) -> Column:
        r = O.encoder(s)(typed(c))
        return F.when(r.valid, after(r.value))

    over(name, table, x, made, sql)


def _two(n: str) -> str:
    return f"lpad(CAST({n} AS STRING), 2, '0')"


# --- formats: texts made of keys, dates, names and addresses --------------------------------------
_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_HOST = "split_part(url, '/', 3)"
_HEX = "md5(c_name)"
matches("t1_iso_date_time", "orders", f"{_DAY} || 'T' || {_two('o_orderkey % 26')} || ':' || {_two('o_custkey % 61')} || ':00' || CASE WHEN o_orderkey % 5 = 0 THEN '+01:00' ELSE 'Z' END",
        S.iso_date_time, "substr(x, 12, 2)::INT < 24 AND substr(x, 15, 2)::INT < 60 AND x LIKE '%Z'")
matches("t2_iso_date", "orders", f"CAST(1890 + o_orderkey % 120 AS STRING) || '-' || {_two('1 + o_custkey % 13')} || '-' || {_two('1 + o_orderkey % 32')}", S.iso_date, "try_cast(x AS DATE) IS NOT NULL")
matches("t3_iso_time", "orders", f"{_two('o_orderkey % 25')} || ':' || {_two('o_custkey % 61')} || ':' || {_two('o_orderkey % 60')} || CASE o_orderkey % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '-08:00' ELSE '' END",
        S.iso_time, "left(x, 2)::INT < 24 AND substr(x, 4, 2)::INT < 60 AND length(x) > 8")
matches("t4_duration", "orders", "'P' || CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS STRING) || 'D' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN 'T' || CAST(o_custkey % 99 AS STRING) || 'H' ELSE '' END",
        S.duration, r"x <> 'P' AND regexp_matches(x, '^P(\d+D)?(T\d+H)?$')")
matches("t5_email", "customer", "replace(lower(c_name), '#', '.') || CASE c_custkey % 4 WHEN 0 THEN '@x.com' WHEN 1 THEN '@a..b' WHEN 2 THEN '@-a.com' ELSE '@mail.' || lower(c_mktsegment) || '.org' END",
        S.email, r"regexp_matches(x, '^[a-z0-9.]+@([a-z0-9]+\.)+[a-z]{2,}$')")
# White space as JavaScript's \s has it, and characters that are none of it but look alike.
_WHITE = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_ALIKE = "\x1c\x85\u180e\u200b\u2060"
_LOCAL = "'ü' || CAST(c_custkey AS STRING)"
_BLANK = f"substr('{_WHITE}', CAST(1 + c_custkey % {len(_WHITE)} AS INT), 1)"
matches("t6_idn_email", "customer", f"CASE c_custkey % 16 WHEN 0 THEN {_LOCAL} || '@ö.de' WHEN 1 THEN {_LOCAL} || 'ö.de' WHEN 2 THEN {_LOCAL} || ' @ö.de' WHEN 3 THEN {_LOCAL} || '@ö@de' WHEN 4 THEN '@' || {_LOCAL} WHEN 5 THEN {_LOCAL} || '@' "
        f"WHEN 6 THEN rpad({_LOCAL}, 64, 'ö') || '@y' WHEN 7 THEN rpad({_LOCAL}, 65, 'ö') || '@y' WHEN 8 THEN rpad({_LOCAL}, 64, '😀') || '@y' WHEN 9 THEN 'x@' || rpad({_LOCAL}, 255, '😀') WHEN 10 THEN 'x@' || rpad({_LOCAL}, 256, 'ö') "
        f"WHEN 11 THEN 'a' || {_BLANK} || {_LOCAL} || '@c' WHEN 12 THEN {_LOCAL} || '@ö' || {_BLANK} || 'de' WHEN 13 THEN {_LOCAL} || '@ö' || {_BLANK} "
        f"WHEN 14 THEN {_LOCAL} || substr('{_ALIKE}', CAST(1 + c_custkey % {len(_ALIKE)} AS INT), 1) || '@ö.de' ELSE '\"' || {_LOCAL} || '\"@ö.' || c_mktsegment END",
        S.idn_email, f"regexp_full_match(x, '[^@]{{1,64}}@[^@]{{1,255}}') AND translate(x, '{_WHITE}', '') = x")
matches("t7_uuid", "customer", f"substr({_HEX}, 1, 8) || '-' || substr({_HEX}, 9, 4) || '-' || substr({_HEX}, 13, 4) || '-' || substr({_HEX}, 17, 4) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '-' END || substr({_HEX}, 21, 12)",
        S.uuid, "length(x) = 36 AND try_cast(x AS UUID) IS NOT NULL")
matches("t8_cuid", "customer", f"CASE c_custkey % 4 WHEN 0 THEN 'x' ELSE 'c' END || CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE '' END || substr({_HEX}, 1, CAST(c_custkey % 24 AS INT))", S.cuid,
        "left(x, 1) = 'c' AND length(x) >= 9 AND NOT contains(x, '-')")
matches("t9_uri", "pages", "CASE page_id % 4 WHEN 0 THEN substr(url, 7) WHEN 1 THEN url || ' x' ELSE url END", S.uri, "x LIKE 'http%' AND NOT contains(x, ' ')")
matches("t10_uri_reference", "pages", "CASE page_id % 4 WHEN 0 THEN replace(url, '/', '\\\\') WHEN 1 THEN url || ' x' WHEN 2 THEN substr(url, 7) ELSE url END".replace("\\\\", "^"), S.uri_reference, "NOT contains(x, '^') AND NOT contains(x, ' ')")
matches("t11_uri_template", "pages", "url || CASE page_id % 4 WHEN 0 THEN '{&page,ref*}' WHEN 1 THEN '{' WHEN 2 THEN '{x:0}' ELSE '' END", S.uri_template, r"regexp_matches(x, '^[^{}]*(\{[+#./;?&]?\w+(:[1-9]\d*|\*)?(,\w+(:[1-9]\d*|\*)?)*\}[^{}]*)*$')")
matches("t12_iri", "documents", "'http://é' || lang || '.de/' || source || CASE WHEN doc_id % 3 = 0 THEN ' ö' ELSE 'ö' END", S.iri, "NOT contains(x, ' ')")
matches("t13_iri_reference", "documents", "'/é' || lang || CASE doc_id % 3 WHEN 0 THEN '^' WHEN 1 THEN '' ELSE '?ö' END || source", S.iri_reference, "NOT contains(x, '^')")
matches("t14_hostname", "pages", f"CASE page_id % 3 WHEN 0 THEN replace({_HOST}, '.', '..') WHEN 1 THEN '-' || {_HOST} ELSE {_HOST} END", S.hostname, "x NOT LIKE '-%' AND NOT contains(x, '..')")
matches("t15_idn_hostname", "pages", f"CASE page_id % 3 WHEN 0 THEN replace({_HOST}, '.', '. ') WHEN 1 THEN 'ö-' || {_HOST} ELSE {_HOST} END", S.idn_hostname, "NOT contains(x, ' ')")
matches("t16_ipv4", "orders", "CAST(o_orderkey % 300 AS STRING) || '.' || CAST(o_custkey % 256 AS STRING) || '.0' || CASE WHEN o_orderkey % 7 = 0 THEN '1' ELSE '' END || '.' || CAST(o_custkey % 10 AS STRING)", S.ipv4,
        "len(string_split(x, '.')) = 4 AND list_bool_and(list_transform(string_split(x, '.'), lambda p: coalesce(p = try_cast(p AS UTINYINT)::VARCHAR, false)))")
matches("t17_ipv6", "orders", "'2001:db8:' || CASE WHEN o_orderkey % 3 = 0 THEN ':1:' ELSE '' END || ':' || hex(o_orderkey % 80000)", S.ipv6, "regexp_matches(x, '^2001:db8::[0-9A-F]{1,4}$')")
matches("t18_json_pointer", "part", "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '/' END || replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '~1' WHEN 1 THEN '~2' ELSE '/' END)", S.json_pointer, "left(x, 1) = '/' AND NOT contains(x, '~2')")
matches("t19_relative_json_pointer", "part", "CASE p_partkey % 5 WHEN 0 THEN '-' WHEN 1 THEN '0' ELSE '' END || CAST(p_size AS STRING) || CASE p_partkey % 3 WHEN 0 THEN '#' WHEN 1 THEN '/' || p_brand ELSE '' END", S.relative_json_pointer,
        "NOT starts_with(x, '-') AND regexp_extract(x, '^[0-9]*') = try_cast(regexp_extract(x, '^[0-9]*') AS INT)::VARCHAR")
valid("t20_port", "orders", "CAST(o_orderkey * 7 AS STRING) || CASE WHEN o_custkey % 7 = 0 THEN '.5' ELSE '' END", S.port, "x::DOUBLE <= 65535 AND NOT contains(x, '.')")

# --- conversions ----------------------------------------------------------------------------------
value("c1_string_to_number", "customer", "'\"' || CASE c_custkey % 5 WHEN 0 THEN CAST(c_acctbal AS STRING) WHEN 1 THEN '  ' || CAST(c_custkey AS STRING) || ' ' WHEN 2 THEN '0x' || hex(c_custkey) WHEN 3 THEN CAST(c_custkey AS STRING) || 'e3' ELSE c_name END || '\"'",
      S.string.convert(S.number), "CASE c_custkey % 5 WHEN 2 THEN c_custkey::DOUBLE WHEN 4 THEN NULL ELSE trim(x, '\" ')::DOUBLE END")
valid("c2_number_to_int32", "orders", "CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey AS STRING) WHEN 1 THEN CAST(o_totalprice AS STRING) ELSE CAST(o_custkey * 10000000 AS STRING) END", S.number.convert(S.int32), "x::DOUBLE = floor(x::DOUBLE) AND x::DOUBLE < 2147483648")
encoded("c3_scalar_to_string", "lineitem", "l_extendedprice * 1.0", S.string.convert(S.number), lambda x: x, r"regexp_replace(x::VARCHAR, '\.0$', '')")
value("c4_literal_to_string", "part", "CAST(p_size AS STRING)", S.literal(12).convert(S.string), "CASE WHEN p_size = 12 THEN '12' END")
value("c5_string_to_boolean", "lineitem", "CASE l_returnflag WHEN 'A' THEN '\"true\"' WHEN 'R' THEN '\"false\"' ELSE '\"TRUE\"' END", S.string.convert(S.boolean), "CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END")
value("c6_string_to_bigint", "orders", "'\"' || CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '' END || CAST(o_orderkey AS STRING) || '00000000000000000000' || CAST(o_custkey AS STRING) || CASE WHEN o_orderkey % 7 = 0 THEN '.5' ELSE '' END || '\"'", S.string.convert(S.bigint),
      "CASE WHEN o_orderkey % 7 <> 0 THEN trim(x, '\"')::HUGEINT::VARCHAR END", lambda v: v.cast("string"))
# Numbers of 60 to 100 digits: a key, a run of its last digits, another key.
_LONG = "CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '' END || CAST(1 + o_orderkey AS STRING) || repeat(CAST(o_orderkey % 10 AS STRING), CAST(60 + o_custkey % 40 AS INT)) || CAST(o_custkey % 10 AS STRING)"
value("c6_string_to_bigint_of_any_size", "orders", "'\"+0' || " + _LONG.replace("'-'", "'.'") + " || '\"'", S.string.convert(S.wide_bigint), "CASE WHEN NOT contains(x, '.') THEN substr(x, 4, length(x) - 4) END")
valid("c6_bounds_of_any_size", "orders", "'\"' || " + _LONG + " || '\"'", S.string.convert(S.wide_bigint.gt(10**70).lte(5 * 10**90).multiple_of(6)),
      "NOT contains(x, '-') AND length(x) - 2 BETWEEN 71 AND 91 AND (length(x) - 2 > 71 OR regexp_matches(x, '^.10{69}[1-9]') OR NOT regexp_matches(x, '^.10')) AND (length(x) - 2 < 91 OR substr(x, 2, 1) < '5' OR regexp_matches(x, '^.50*.$')) AND o_custkey % 2 = 0 "
      "AND list_sum(list_transform(string_split(trim(x, '\"'), ''), lambda c: coalesce(try_cast(c AS INT), 0))) % 3 = 0")
value("c7_number_to_bigint", "orders", "CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE floor(o_totalprice) END AS STRING)", S.number.convert(S.bigint), "CASE WHEN x::DOUBLE = floor(x::DOUBLE) THEN floor(o_totalprice)::BIGINT::VARCHAR END", lambda v: v.cast("string"))
value("c8_string_to_literal", "part", "'\"' || CAST(p_size AS STRING) || '\"'", S.string.convert(S.literal(5)), "CASE WHEN p_size = 5 THEN 5.0::DOUBLE END")
value("c9_literal_to_literal", "orders", "'\"' || o_orderstatus || '\"'", S.literal("F").convert(S.literal(True)), "CASE WHEN o_orderstatus = 'F' THEN true END")
value("c10_string_to_date", "orders", f"'\"' || CAST(1995 + o_orderkey % 9 AS STRING) || '-' || {_two('1 + o_custkey % 13')} || '-' || {_two('1 + o_orderkey % 32')} || CASE WHEN o_orderkey % 2 = 0 THEN 'T00:00:00Z' ELSE '' END || '\"'", S.string.convert(S.date),
      "try_cast(substr(x, 2, 10) AS DATE)::VARCHAR", lambda v: v.cast("date").cast("string"))
encoded("c11_date_to_string", "events", "ts", S.string.convert(S.date), lambda x: x.cast("timestamp"), "strftime(date_trunc('milliseconds', x), '%Y-%m-%dT%H:%M:%S.%gZ')")
valid("c12_string_to_url", "pages", "'\"' || CASE WHEN page_id % 3 = 0 THEN replace(url, 'http', ':') ELSE url END || '\"'", S.string.convert(S.url), "x LIKE '\"http%'")
encoded("c13_url_to_string", "pages", "url", S.string.convert(S.url), lambda x: x, "x")
over("c14_string_to_bytes", "documents", "text", lambda x: F.md5(F.hex(O.decoder(S.string.convert(S.uint8_array))(x).value)), "md5(hex(encode(x)))")
encoded("c14_bytes_to_string", "documents", "text", S.string.convert(S.uint8_array), lambda x: F.encode(x, "UTF-8"), "md5(x)", F.md5)
_SPELLED = "upper(split_part(url, '/', 1)) || '//u ser:p@' || upper(split_part(url, '/', 3)) || ':443/x/../b/%2e/c d\\\\' || CAST(page_id AS STRING) || '/..?q= é''#f`'"
value("c13_url_href", "pages", "'\"' || " + _SPELLED.replace("\\\\", "/") + " || '\"'", S.string.convert(S.url).convert(S.string),
      "split_part(url, '/', 1) || '//u%20ser:p@' || split_part(url, '/', 3) || CASE WHEN url LIKE 'https%' THEN '' ELSE ':443' END || '/b/c%20d/?q=%20%C3%A9%27#f%60'")
value("c15_json_to_typed", "events", "CASE WHEN event_id % 4 = 0 THEN '{\"k\":\"' || event_type || '\"}' ELSE props END", S.json_value.convert(S.object_({"k": S.number})), "try_cast(x->>'$.k' AS DOUBLE)", lambda v: v["k"])
encoded("c16_typed_to_json", "orders", "o_orderkey", S.json_value.convert(S.object_({"id": S.bigint, "at": S.date, "note": S.optional(S.string), "f": S.nullable(S.boolean)})),
        lambda x: F.struct(x.cast("decimal(38,0)").alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.when(x % 2 == 0, F.col("o_orderpriority")).alias("note"), F.when(x % 3 == 0, x % 2 == 0).alias("f")),
        """'{"at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') || '","f":' || CASE WHEN x % 3 = 0 THEN (x % 2 = 0)::VARCHAR ELSE 'null' END || ',"id":"' || x || '"' || CASE WHEN x % 2 = 0 THEN ',"note":"' || o_orderpriority || '"' ELSE '' END || '}'""", F.to_json)
encoded("c17_nan_in_lists", "lineitem", "CASE WHEN l_linenumber = 3 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END", S.json_string.convert(S.array(S.number)), lambda x: F.array(F.lit(0.5), x), "CASE WHEN l_linenumber <> 3 THEN '[0.5,' || l_quantity::BIGINT || ']' END")
encoded("c18_typed_to_json_string", "documents", "coalesce(text, '')", S.json_string.convert(S.object_({"id": S.bigint, "t": S.string, "l": S.optional(S.string)})),
        lambda x: F.struct(F.col("doc_id").cast("decimal(38,0)").alias("id"), x.alias("t"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("l")),
        """md5('{"id":"' || doc_id || '","t":' || to_json(x)::VARCHAR || CASE WHEN doc_id % 2 = 0 AND lang IS NOT NULL THEN ',"l":"' || lang || '"' ELSE '' END || '}')""", F.md5)
value("c19_json_string_to_literal", "part", "'\"' || CAST(p_size AS STRING) || '\"'", S.json_string.convert(S.literal(7)), "CASE WHEN p_size = 7 THEN 7.0::DOUBLE END")
value("c20_null_to_undefined", "part", "CASE WHEN p_size % 2 = 0 THEN 'null' ELSE '\"' || p_brand || '\"' END", S.union(S.string, None).convert(S.union(S.string, S.undefined)), "CASE WHEN p_size % 2 = 1 THEN p_brand END")
value("c21_trim", "part", "'\"  ' || p_name || ' ' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END || '   \"'", S.string.trim(), "trim(trim(x, '\"'))")
valid("s2_json_string_source", "customer", "CASE c_custkey % 3 WHEN 0 THEN '\"' || CAST(c_acctbal AS STRING) || '\"' WHEN 1 THEN '\"' || c_name || '\"' ELSE CAST(c_acctbal AS STRING) END", S.json_string.convert(S.number), "left(x, 1) = '\"' AND try_cast(trim(x, '\"') AS DOUBLE) IS NOT NULL")
encoded("s4_json_string_with_space", "orders", "o_orderstatus", S.json_string_with_space(3).convert(S.object_({"s": S.string, "l": S.array(S.number)})),
        lambda x: F.struct(x.alias("s"), F.array(F.col("o_orderkey").cast("double"), F.col("o_custkey").cast("double")).alias("l")),
        """'{' || chr(10) || '   "s": "' || x || '",' || chr(10) || '   "l": [' || chr(10) || '      ' || o_orderkey || ',' || chr(10) || '      ' || o_custkey || chr(10) || '   ]' || chr(10) || '}'""")
valid("s5_json", "events", "CASE event_id % 4 WHEN 0 THEN props || props WHEN 1 THEN substr(props, 2) WHEN 2 THEN '[' || props || ',]' ELSE props END", S.json_value, "event_id % 4 = 3")
over("s6_bytes_round_trip", "conversations", "text", lambda x: F.md5(O.decoder(S.string.convert(S.uint8_array).convert(S.string))(x).value), "md5(x)")

# --- refinements ----------------------------------------------------------------------------------
_PAIR = "'{\"a\":' || CAST(l_quantity AS STRING) || ',\"b\":' || CAST(l_linenumber * 10 AS STRING) || '}'"
valid("f1_refine", "lineitem", _PAIR, S.object_({"a": S.number, "b": S.number}).refine(lambda o: o["a"] < o["b"], "a before b", ["a"]), "l_quantity < l_linenumber * 10")
valid("f2_refine_input", "orders", "'\"' || o_orderstatus || '\"'", S.string.refine_input(lambda v: F.try_variant_get(v, "$", "string") != "P"), "o_orderstatus <> 'P'")
for _name, _change, _test in (("f3_gt", S.number.gt(0.05), "> 0.05"), ("f4_gte", S.number.gte(0.05), ">= 0.05"), ("f5_lt", S.number.lt(0.05), "< 0.05"), ("f6_lte", S.number.lte(0.05), "<= 0.05")):
    valid(_name, "lineitem", "CAST(l_discount AS STRING)", _change, f"l_discount {_test}")
valid("f7_multiple_of", "lineitem", "CAST(l_extendedprice AS STRING) || CASE WHEN l_linenumber % 3 = 0 THEN '5' ELSE '' END", S.number.multiple_of(0.01), "x::DECIMAL(18,4) * 100 % 1 = 0")
_WORD = "split_part(replace(coalesce(text, ''), '\n', ' '), ' ', 2)"
matches("f8_min_length", "documents", _WORD, S.string.min_length(5), "length(x) >= 5")
matches("f9_max_length", "documents", _WORD, S.string.max_length(5), "length(x) <= 5")
over("f10_length", "documents", "coalesce(text, '')", lambda x: O.decoder(S.array(S.string).length(7))(F.split(x, r"\.")).valid, "len(string_split(x, '.')) = 7")
matches("f11_non_empty", "documents", "split_part(coalesce(text, ''), '.', 9)", S.string.non_empty(), "x <> ''")
for _name, _size, _test in (("f12_min_size", S.uint8_array.min_size(6), ">= 6"), ("f13_max_size", S.uint8_array.max_size(6), "<= 6"), ("f14_size", S.uint8_array.size(6), "= 6")):
    over(_name, "documents", _WORD, lambda x, s=_size: O.decoder(s)(F.encode(x, "UTF-8")).valid, f"strlen(x) {_test}")
matches("f15_pattern", "part", "p_name || CASE WHEN p_partkey % 5 = 0 THEN '\n' ELSE '' END", S.string.pattern(r"^(?<size>small|large)\s\w+$"), "left(x, 6) IN ('small ', 'large ') AND x NOT LIKE '%' || chr(10)")
valid("f16_bound_algebra", "part", "CAST(p_size AS STRING)", S.number.gte(1).gte(3).lt(40).lte(30), "p_size BETWEEN 3 AND 30")
valid("f18_no_validation", "events", "CASE event_id % 3 WHEN 0 THEN '[' || CAST(event_id AS STRING) || ']' WHEN 1 THEN '{\"k\":\"' || event_type || '\"}' ELSE props END", S.object_({"k": S.number.no_validation()}), "event_id % 3 <> 0")
reason("f20_error_text", "part", "CASE WHEN p_partkey % 6 = 0 THEN CAST(p_size AS STRING) ELSE '\"' || split_part(p_name, ' ', 2) || '\"' END", S.string.min_length(5, "too short"),
       "CASE WHEN p_partkey % 6 = 0 THEN 'Expected string (length >= 5), received ' || p_size WHEN length(x) < 7 THEN 'too short' END")

# --- objects and tuples ---------------------------------------------------------------------------
_ORDER = "'{\"id\":' || CAST(o_orderkey AS STRING) || ',\"s\":\"' || o_orderstatus || '\"' || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ',\"n\":' || CAST(o_custkey AS STRING) WHEN 2 THEN ',\"n\":\"x\"' ELSE ',\"n\":1,\"z\":0' END || '}'"
_N = "CASE WHEN o_orderkey % 4 = 1 THEN o_custkey WHEN o_orderkey % 4 = 3 THEN 1 END"
value("p1_literal", "orders", "'\"' || o_orderstatus || '\"'", S.literal("F"), "CASE WHEN o_orderstatus = 'F' THEN 'F' END")
value("p4_field_or", "orders", _ORDER, S.object_(lambda c: {"n": c.field_or("n", S.number, 5)}), f"CASE WHEN o_orderkey % 4 = 0 THEN 5 ELSE {_N} END::DOUBLE", lambda v: v["n"])
value("p5_tag", "orders", _ORDER, S.object_(lambda c: (c.tag("s", "F"), {"id": c.field("id", S.number)})[1]), "CASE WHEN o_orderstatus = 'F' THEN o_orderkey::DOUBLE END", lambda v: v["id"])
value("p6_nested", "orders", f"'{{\"o\":' || {_ORDER} || '}}'", S.object_(lambda c: {"n": c.nested("o").field("n", S.number)}), f"({_N})::DOUBLE", lambda v: v["n"])
value("p9_shaped_serialize", "orders", "'{\"ID\":' || CAST(o_orderkey AS STRING) || '}'", S.object_(lambda c: {"id": c.field("ID", S.number)}).convert(S.json_string), "'{\"id\":' || o_orderkey || '}'")
value("p10_tuple", "orders", "'[\"' || o_orderstatus || '\",' || CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS STRING) || ']' WHEN 1 THEN '\"x\"]' ELSE '1,2]' END", S.tuple_([S.string, S.number]), "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey::DOUBLE END", lambda v: v["_2"])
value("p11_merge", "orders", _ORDER, S.merge(S.object_({"id": S.number, "n": S.string}), S.object_({"n": S.number})), f"({_N})::DOUBLE", lambda v: v["n"])
value("p12_strip", "orders", _ORDER, S.object_({"id": S.number}).strict().strip(), "'{\"id\":' || o_orderkey || '.0}'", F.to_json)
reason("p13_strict", "orders", _ORDER, S.object_({"id": S.number, "s": S.string, "n": S.optional(S.unknown)}).strict(), "CASE WHEN o_orderkey % 4 = 3 THEN 'Unrecognized key \"z\"' END")
valid("p14_deep_strip", "orders", f"'{{\"y\":1,\"o\":' || {_ORDER} || '}}'", S.object_({"o": S.object_({"n": S.number}).strict()}).deep_strip(), "o_orderkey % 4 IN (1, 3)")
valid("p15_deep_strict", "orders", f"'{{\"o\":' || {_ORDER} || '}}'", S.object_({"o": S.object_({"id": S.number, "s": S.string, "n": S.optional(S.number)})}).deep_strict(), "o_orderkey % 4 IN (0, 1)")
value("p16_object", "orders", _ORDER, S.object_({"s": S.string, "n": S.optional(S.number)}), f"CASE WHEN o_orderkey % 4 <> 2 THEN o_orderstatus || coalesce(({_N})::VARCHAR, '') END", lambda v: F.concat(v["s"], F.coalesce(v["n"].cast("long").cast("string"), F.lit(""))))
value("p17_dict_to_object", "events", "CASE WHEN event_id % 3 = 0 THEN '{\"k\":1,\"y\":\"' || event_type || '\"}' ELSE '{\"k\":\"' || event_type || '\"}' END", S.record(S.string).convert(S.object_({"k": S.string})), "CASE WHEN event_id % 3 <> 0 THEN event_type END", lambda v: v["k"])
value("p18_object_to_dict", "lineitem", _PAIR, S.object_({"a": S.number, "b": S.number}).convert(S.record(S.string)), "l_quantity::BIGINT || '/' || l_linenumber * 10", lambda v: F.concat(v["a"], F.lit("/"), v["b"]))

# --- absence --------------------------------------------------------------------------------------
_MAYBE = "CASE event_id % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{\"k\":null}' WHEN 2 THEN '{\"k\":\"' || event_type || '\"}' ELSE props END"
for _name, _kind, _ok in (("n1_optional", S.optional, "0, 3"), ("n3_nullable", S.nullable, "1, 3"), ("n5_nullish", S.nullish, "0, 1, 3"), ("n7_option", S.option, "0, 3"), ("n6_null_as_option", S.null_as_option, "1, 3")):
    valid(_name, "events", _MAYBE, S.object_({"k": _kind(S.number)}), f"event_id % 4 IN ({_ok})" if "option" not in _name or _name == "n6_null_as_option" else "event_id % 4 IN (0, 1, 3)")
value("n2_optional_default", "events", _MAYBE, S.object_({"k": S.optional(S.number, 3)}), "CASE WHEN event_id % 4 IN (0, 1) THEN 3 WHEN event_id % 4 = 3 THEN (props->>'$.k')::DOUBLE END::DOUBLE", lambda v: v["k"])
value("n4_nullable_default", "events", _MAYBE, S.object_({"k": S.nullable(S.union(S.string, S.number.convert(S.string)), "bar")}), "CASE event_id % 4 WHEN 1 THEN 'bar' WHEN 2 THEN event_type WHEN 3 THEN props->>'$.k' END", lambda v: v["k"])

# --- unions ---------------------------------------------------------------------------------------
_ANY = "CASE event_id % 6 WHEN 0 THEN '\"' || event_type || '\"' WHEN 1 THEN CAST(user_id AS STRING) WHEN 2 THEN 'true' WHEN 3 THEN 'null' WHEN 4 THEN '[' || CAST(user_id AS STRING) || ',\"x\"]' ELSE props END"
_EVENT = "'{\"kind\":\"' || event_type || '\",' || CASE WHEN event_id % 3 = 0 THEN '\"y\":\"q\"' ELSE '\"x\":' || CAST(user_id AS STRING) END || '}'"
_TAGGED = S.union(S.object_({"kind": "view", "x": S.number}), S.object_({"kind": "click", "y": S.string}))
valid("u1_union", "events", _ANY, S.union(S.string, S.number), "event_id % 6 IN (0, 1)")
valid("u2_enum", "events", _ANY, S.enum(["click", "view", 7, True, None]), "x IN ('\"click\"', '\"view\"', '7', 'true', 'null')")
value("u3_union_first_match", "events", _ANY, S.union(S.int32.lt(50).convert(S.string, decode=lambda c: F.lit("small")), S.string, S.number.convert(S.string), S.object_({"k": S.number}).convert(S.string, decode=lambda c: c["k"].cast("int").cast("string"))),
      "CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN CASE WHEN user_id < 50 THEN 'small' ELSE user_id::VARCHAR END WHEN 5 THEN props->>'$.k' END")
value("u4_union_of_every_type", "events", _ANY, S.union(S.string.min_length(5), S.number.gte(10), S.boolean, None, S.array(S.union(S.number, S.literal("x"))), S.object_({"k": S.number.lt(50)}), S.string),
      "CASE event_id % 6 WHEN 1 THEN CASE WHEN user_id >= 10 THEN 'n' ELSE NULL END WHEN 3 THEN 'absent' WHEN 5 THEN CASE WHEN (props->>'$.k')::INT < 50 THEN 'o' END WHEN 0 THEN 's' WHEN 2 THEN 'b' ELSE 'a' END",
      lambda v: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in ("STR", "s", "BIG", "n", "DEC", "n", "DOU", "n", "BOO", "b", "ARR", "a", "OBJ", "o"))), F.substring(F.schema_of_variant(v), 1, 3)), F.lit("absent")))
reason("u7_union_error", "events", _EVENT, S.union(S.object_({"kind": "view", "x": S.number}), S.object_({"kind": "click", "x": S.number.lt(50)})),
       """CASE WHEN event_type NOT IN ('view', 'click') THEN 'Expected { kind: "view"; x: number; } | { kind: "click"; x: number (< 50); }, received ' || x WHEN event_id % 3 = 0 THEN CASE event_type WHEN 'view' THEN 'Expected number, received undefined' ELSE 'Expected number (< 50), received undefined' END WHEN event_type = 'click' AND user_id >= 50 THEN 'Expected number (< 50), received ' || user_id END""")
value("u8_discriminator", "events", f"'{{\"u\":' || {_EVENT} || '}}'", S.object_({"u": S.union(S.object_({"kind": "view", "x": S.number}), S.object_({"kind": "click", "x": S.number.gt(50)}))}),
      "CASE WHEN event_id % 3 <> 0 AND (event_type = 'view' OR event_type = 'click' AND user_id > 50) THEN user_id::DOUBLE END", lambda v: v["u"]["x"])
valid("u8_discriminated_arms", "events", _EVENT, _TAGGED, "event_type = 'view' AND event_id % 3 <> 0 OR event_type = 'click' AND event_id % 3 = 0")
value("u9_string_to_union", "events", "'\"' || CASE event_id % 3 WHEN 0 THEN CAST(user_id AS STRING) WHEN 1 THEN 'true' ELSE event_type END || '\"'", S.string.convert(S.union(S.number, S.boolean)), "CASE event_id % 3 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN 'true' END",
      lambda v: F.when(F.schema_of_variant(v) == "BOOLEAN", "true").otherwise(F.try_variant_get(v, "$", "double").cast("long").cast("string")))
value("u10_union_to_string", "events", _ANY, S.union(S.number, S.boolean).convert(S.string), "CASE WHEN event_id % 6 IN (1, 2) THEN x END")
value("u11_union_to_union", "events", _ANY, S.union(S.string, S.number).convert(S.union(S.number.convert(S.string), S.string)), "CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN x END")
value("u11_union_to_never", "events", _ANY, S.union(S.number, S.string).convert(S.union(S.number.convert(S.never), S.string)), "CASE WHEN event_id % 6 = 0 THEN event_type END")
valid("u11_null_to_undefined", "events", _ANY, S.union(S.string, None).convert(S.union(S.string, S.undefined)), "event_id % 6 IN (0, 3)")
encoded("u12_union_encode", "orders", "CAST(o_custkey AS DOUBLE)", S.union(S.string.convert(S.number.gt(500)), S.boolean.convert(S.number, decode=lambda c: c.cast("double"), encode=lambda c: c % 2 == 1)), lambda x: x,
        "CASE WHEN x > 500 THEN o_custkey::VARCHAR ELSE (o_custkey % 2 = 1)::VARCHAR END", lambda v: v.cast("string"))
encoded("u12_union_text", "orders", "o_orderkey", S.json_string.convert(S.array(S.union(S.object_({"kind": "id", "n": S.bigint}), S.object_({"kind": "at", "d": S.date}), S.number, None))),
        lambda x: F.array(F.to_variant_object(F.struct(F.lit("id").alias("kind"), x.cast("decimal(38,0)").alias("n"))), F.to_variant_object(F.struct(F.lit("at").alias("kind"), F.col("o_orderdate").cast("timestamp").alias("d"))),
                          F.when(x % 2 == 0, F.col("o_custkey").cast("double").cast("variant"))),
        """'[{"kind":"id","n":"' || x || '"},{"kind":"at","d":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') || '"},' || CASE WHEN x % 2 = 0 THEN o_custkey::VARCHAR ELSE 'null' END || ']'""")
valid("u13_fall_through", "events", "'\"' || event_type || '\"'", S.union(S.string.max_length(5), S.string.pattern("^p")), "length(event_type) <= 5 OR event_type = 'purchase'")
valid("u14_never_arm", "events", _ANY, S.union(S.never, S.number), "event_id % 6 = 1")
valid("r4_never_slot_in_union", "events", _ANY, S.union(S.string.convert(S.number, decode="never"), S.number), "event_id % 6 = 1")

# --- lists and recursion --------------------------------------------------------------------------
_LIST = "'[' || CAST(l_linenumber AS STRING) || CASE l_linenumber % 3 WHEN 0 THEN ',\"x\"' WHEN 1 THEN '' ELSE ',' || CAST(l_quantity AS STRING) END || ']'"
value("l1_array", "lineitem", _LIST, S.array(S.number), "CASE l_linenumber % 3 WHEN 1 THEN l_linenumber WHEN 2 THEN l_linenumber + l_quantity END::DOUBLE", lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x))
valid("l2_tuple", "lineitem", "'[\"' || l_returnflag || '\",' || substr(" + _LIST + ", 2)", S.tuple_([S.literal("A"), S.int32, S.number]), "l_returnflag = 'A' AND l_linenumber % 3 = 2")
value("l4_record", "lineitem", "'{\"' || l_returnflag || '\":' || CAST(l_quantity AS STRING) || CASE WHEN l_linenumber % 3 = 0 THEN ',\"z\":\"x\"' ELSE '' END || '}'", S.record(S.number), "CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag || l_quantity::BIGINT END",
      lambda v: F.concat(F.get(F.map_keys(v), F.lit(0)), F.get(F.map_values(v), F.lit(0)).cast("long").cast("string")))
# A chain of as many links as the key says, up to 40; the last link of some is wrong.
_CHAIN = "repeat('{\"v\":\"1\",\"next\":', CAST(c_custkey % 40 AS INT)) || '{\"v\":\"' || CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE CAST(c_custkey AS STRING) END || '\"}' || repeat('}', CAST(c_custkey % 40 AS INT))"
_NODE = S.recursive("Node", lambda n: S.object_({"v": S.string.convert(S.number), "next": S.optional(n)}))
valid("l6_recursive", "customer", _CHAIN, _NODE, "c_custkey % 7 <> 0", dear=True)
over("l7_recursive_values", "customer", _CHAIN, lambda x: F.array_join(O.parser(_NODE)(x).error["path"], "."), "CASE WHEN c_custkey % 7 = 0 THEN repeat('next.', (c_custkey % 40)::INT) || 'v' END", dear=True)

# --- operations -----------------------------------------------------------------------------------
_BAD = "CASE WHEN event_id % 5 = 0 THEN '{\"k\":[' || CAST(user_id AS STRING) || ',\"' || event_type || '\"]}' ELSE '{\"k\":[' || CAST(user_id AS STRING) || ']}' END"
_KS = S.object_({"k": S.array(S.number)})
over("o2_async_parser", "events", _BAD, lambda x: O.async_parser(_KS)(x).valid, "event_id % 5 <> 0")
over("o4_async_decoder", "lineitem", "l_quantity", lambda x: O.async_decoder(S.number.gte(10))(x).valid, "x >= 10")
over("o6_async_encoder", "lineitem", "l_quantity", lambda x: O.async_encoder(S.string.convert(S.number))(x).value, "x::BIGINT::VARCHAR")
valid("o8_is_variant", "events", _BAD, _KS, "event_id % 5 <> 0", "json")
over("o9_safe", "events", _BAD, lambda x: O.safe(O.parser(_KS)(x))["success"], "event_id % 5 <> 0")
over("o10_safe_async", "events", _BAD, lambda x: O.safe_async(O.parser(_KS)(x))["error"]["code"], "CASE WHEN event_id % 5 = 0 THEN 'invalid_input' END")
over("o13_reverse", "events", "value", lambda x: O.decoder(O.reverse(S.string.convert(S.number)))(x).value, r"regexp_replace(x::VARCHAR, '\.0$', '')")
over("o14_standard_validate", "events", _BAD, lambda x: F.get(O.standard_validate(_KS, x)["issues"], F.lit(0))["message"], "CASE WHEN event_id % 5 = 0 THEN 'Expected number, received \"' || event_type || '\"' END")
over("o21_error_path", "events", _BAD, lambda x: O.path_text(O.parser(_KS)(x).error["path"]), "CASE WHEN event_id % 5 = 0 THEN '[\"k\"][\"1\"]' END")
reason("m2_brand", "orders", "CASE WHEN o_orderkey % 2 = 0 THEN '\"' || o_orderstatus || '\"' ELSE CAST(o_custkey AS STRING) END", S.string.brand("Id"), "CASE WHEN o_orderkey % 2 = 1 THEN 'Expected Id, received ' || o_custkey END")
over("r3_coder", "part", "'\"' || split_part(p_name, ' ', CAST(1 + p_partkey % 3 AS INT)) || '\"'", lambda x: (lambda r: F.when(r.valid, r.value.cast("string")).otherwise(r.error["reason"]))(O.parser(S.string.convert(S.number, decode=O.coder(lambda t: 12.0 / len(t), "double")))(x)),
     "CASE WHEN length(x) = 2 THEN 'float division by zero' ELSE (12.0::DOUBLE / (length(x) - 2))::VARCHAR END")

over("o16_input_expression", "orders", "o_custkey", lambda x: F.concat(F.lit(S.string.convert(S.number).input_expression() + "/" + S.string.convert(S.number).output_expression() + "/"), x.cast("string")), "'string/number/' || x")
valid("l5_list", "lineitem", _LIST, S.list_(S.number.gte(3)), "CASE l_linenumber % 3 WHEN 1 THEN l_linenumber >= 3 WHEN 2 THEN l_linenumber >= 3 AND l_quantity >= 3 END")
value("r1_custom_conversion", "orders", "'\"' || o_orderpriority || '\"'", S.string.convert(S.int32, decode=lambda c: F.substring(c, 1, 1).cast("int"), encode=lambda c: c.cast("string")), "left(o_orderpriority, 1)::INT")
encoded("r2_encoding_slot", "part", "p_size", S.string.convert(S.int32, decode=lambda c: F.length(c), encode=lambda c: F.repeat(F.lit("x"), c)), lambda x: x, "repeat('x', p_size)")
value("r8_default_from_a_function", "events", _MAYBE, S.object_({"k": S.optional(S.number, lambda: F.lit(2.0) * 21)}), "CASE WHEN event_id % 4 IN (0, 1) THEN 42 WHEN event_id % 4 = 3 THEN (props->>'$.k')::DOUBLE END::DOUBLE", lambda v: v["k"])
over("s7_blob", "documents", "coalesce(text, '')", lambda x: O.decoder(S.blob.min_size(1000).max_size(3000))(F.encode(x, "UTF-8")).valid, "strlen(x) BETWEEN 1000 AND 3000")


def o7_assert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of valid values pass; an invalid one would end the job."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select("event_type", "props")
    return O.assert_valid(rows, "props", S.object_({"k": S.int32.gte(0)})).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES["o7_assert"] = o7_assert
SQL["o7_assert"] = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"

def s11_columns_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as compact columns, read back from its pieces: cells by place, per column."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pieces = O.column_pieces(rows, S.object_({"l_orderkey": S.number, "l_partkey": S.number, "l_quantity": S.nullable(S.number)}), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    cells = pieces.select("column", "first_row", F.posexplode(F.split(F.regexp_replace("text", r"^[\[,]+|\]+$", ""), ",")).alias("i", "cell"))
    return cells.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("first_row") + F.col("i") + 1) % 1009 * F.col("cell").cast("long")).alias("said"))


QUERIES["s11_columns_lineitem"] = s11_columns_lineitem
SQL["s11_columns_lineitem"] = """
SELECT c AS "column", count(*) AS n, sum(i % 1009 * CASE c WHEN 0 THEN l_orderkey WHEN 1 THEN l_partkey ELSE l_quantity::BIGINT END)::BIGINT AS said
FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem), (VALUES (0), (1), (2)) AS v(c) GROUP BY c"""

# --- JSON Schema ----------------------------------------------------------------------------------
_DOC = {"type": "object", "properties": {"id": {"type": "integer"}, "s": {"enum": ["F", "O"]}}, "required": ["id"]}
valid("j7_from_json_schema", "orders", _ORDER, from_json_schema(_DOC), "o_orderstatus IN ('F', 'O')", "json")
_OWN = S.object_({"id": S.int32, "s": S.enum(["F", "O"]), "n": S.optional(S.number.lte(700))})
valid("j1_to_json_schema", "orders", _ORDER, from_json_schema(to_json_schema(_OWN.strict())), f"o_orderstatus IN ('F', 'O') AND o_orderkey % 4 IN (0, 1) AND coalesce({_N}, 0) <= 700", "json")
valid("j2_structural_emit", "lineitem", _LIST, from_json_schema(to_json_schema(S.as_schema([S.int32, S.number.gt(9)]))), "l_linenumber % 3 = 2 AND l_quantity > 9", "json")
valid("j3_emit_of_the_input", "events", _ANY, from_json_schema(to_json_schema(S.union(S.string.min_length(6).convert(S.number), S.number.convert(S.string)))), "event_id % 6 = 0 AND length(event_type) >= 6 OR event_id % 6 = 1", "json")
valid("j5_extended", "part", "CAST(p_size AS STRING)", from_json_schema(to_json_schema(extend_json_schema(S.number, {"maximum": 20}))), "p_size <= 20", "json")
valid("j8_ref", "customer", "'{\"value\":1,\"children\":[' || " + "repeat('{\"value\":2},', CAST(c_custkey % 5 AS INT)) || '{\"children\":[{\"value\":' || CASE WHEN c_custkey % 3 = 0 THEN '\"' || c_name || '\"' ELSE CAST(c_custkey AS STRING) END || '}]}]}'",
      from_json_schema({"$ref": "#/definitions/node", "definitions": {"node": {"type": "object", "properties": {"value": {"type": "number"}, "children": {"type": "array", "items": {"$ref": "#/definitions/node"}}}}}}), "c_custkey % 3 <> 0", "json")
valid("j10_untyped_keywords", "events", _ANY, from_json_schema({"minLength": 5, "minimum": 50}), "event_id % 6 = 0 AND length(event_type) >= 5 OR event_id % 6 = 1 AND user_id >= 50 OR event_id % 6 > 1", "json")
valid("j12_enum_equality", "events", "CASE event_id % 3 WHEN 0 THEN '[' || CAST(user_id AS STRING) || '.0]' WHEN 1 THEN '{\"a\":\"' || event_type || '\"}' ELSE CAST(user_id AS STRING) END", from_json_schema({"enum": [1, [2], {"a": "view"}, 8.0]}),
      "CASE event_id % 3 WHEN 0 THEN user_id = 2 WHEN 1 THEN event_type = 'view' ELSE user_id IN (1, 8) END", "json")
valid("j13_code_points", "documents", "'\"' || replace(" + _WORD + ", '\"', '') || repeat('😀', CAST(doc_id % 4 AS INT)) || '\"'", from_json_schema({"type": "string", "maxLength": 6}), "length(x) <= 8", "json")
valid("j14_empty_range", "part", "CAST(p_size AS STRING)", from_json_schema({"type": "number", "minimum": 30, "maximum": 10}), "false", "json")
value("j15_default", "orders", _ORDER, from_json_schema({"type": "object", "properties": {"n": {"type": "number", "default": 4}, "s": {"type": "string"}}}), f"CASE WHEN o_orderkey % 4 = 0 THEN 4 ELSE {_N} END::DOUBLE", lambda v: v["n"])
valid("j16_nullable", "events", _ANY, from_json_schema({"type": "string", "nullable": True}), "event_id % 6 IN (0, 3)", "json")
valid("j17_ref_siblings", "events", _ANY, from_json_schema({"$schema": "https://json-schema.org/draft/2020-12/schema", "$defs": {"s": {"type": "string"}}, "$ref": "#/$defs/s", "minLength": 6}), "event_id % 6 = 0 AND length(event_type) >= 6", "json")
