"""Tables of inputs and what parsing, encoding and documents make of them."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from tessera import functions as fn
from tessera import operators as O
from tessera import schema as S
from tessera.jsonschema import from_json_schema, to_json_schema
from tessera.plans.recursion import unread


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").orderBy("i")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def parsed(spark, s, values, source="string"):
    """[(value, None) or (None, (code, path, reason))] of JSON texts."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string").orderBy("i")
    if source != "string":
        df = df.select("i", F.try_parse_json("x").alias("x"))
    r = O.parser(s)("x", source)
    value = F.to_json(F.struct(r.value.alias("v"))) if r.type == "variant" else r.value
    return [(None, (x.e.code, x.e.path, x.e.reason)) if x.e else (x.v, None) for x in df.select(value.alias("v"), r.error.alias("e")).collect()]


def present(x):
    """JSON without its absent fields, which a VARIANT has as null."""
    return {k: present(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [present(i) for i in x] if isinstance(x, list) else x


def verdicts(spark, s, values, source="string"):
    return [e is None for _, e in parsed(spark, s, values, source)]


def test_number_text(spark):
    assert column(spark, [1.0, 1.5, -0.0, 1e21, 1e-7, 123456789.5, 1e20, 0.001, 1e-6, -5.25], fn.number_text, "double") == [
        "1", "1.5", "0", "1e+21", "1e-7", "123456789.5", "100000000000000000000", "0.001", "0.000001", "-5.25"]


def test_text_to_number(spark):
    assert column(spark, ["123", "123.4", " 12 ", "", "0x10", "1e3", "Infinity", "NaN", "1d", "abc"], fn.to_number) == [
        123.0, 123.4, 12.0, 0.0, 16.0, 1000.0, float("inf"), None, None, None]
    got = column(spark, ["0", "-5", "", "0x1F", "1.5", "9" * 38, "9" * 41], fn.to_bigint)
    assert [None if x is None else int(x) for x in got] == [0, -5, 0, 31, None, int("9" * 38), None]


def test_strict_json(spark):
    values = ['{"a":1}', '{"a":1} x', "1] [2", "1} {", '1,"y":2', "{'a':1}", '{"a":01}', "[1,]", "NaN", ""]
    assert column(spark, values, fn.strict_json) == [True] + [False] * 9


def test_lengths_and_quotes(spark):
    assert column(spark, ["\U0001F600a"], fn.utf16_length) == [3]
    assert [json.loads(x) for x in column(spark, ['a"b\\c\n\x01é'], fn.quoted)] == ['a"b\\c\n\x01é']


def test_object_order_of_errors(spark):
    s = S.object_({"k": S.int32.gte(0), "n": S.optional(S.string, "d")})
    got = parsed(spark, s, ['{"k":5}', '{"k":-1}', '{"k":"x","n":1}', "[1]", '{"k":1} x', "null", '{"k":1,"n":null}'])
    assert tuple(got[0][0]) == (5, "d") and tuple(got[6][0]) == (1, "d")
    assert got[1][1] == ("invalid_input", ["k"], "Expected int32 (>= 0), received -1")
    assert got[2][1][1:] == (["k"], 'Expected int32 (>= 0), received "x"')
    assert [g[1][1] for g in got[3:6]] == [[], [], []]


def test_presence(spark):
    values = ["{}", '{"a":null}', '{"a":"x"}']
    field = lambda t: S.object_({"a": t})
    assert verdicts(spark, field(S.optional(S.string)), values, "unknown") == [True, False, True]
    assert verdicts(spark, field(S.optional(S.string)), values, "json") == [True, True, True]
    assert verdicts(spark, field(S.nullable(S.string)), values, "unknown") == [False, True, True]
    assert verdicts(spark, field(S.nullish(S.string)), values, "unknown") == [True, True, True]
    assert verdicts(spark, field(S.nullable(S.string, "d")), values, "unknown") == [False, True, True]


def test_strict_and_deep(spark):
    s = S.object_({"a": S.object_({"b": S.number})})
    values = ['{"a":{"b":1}}', '{"a":{"b":1,"c":2}}', '{"a":{"b":1},"z":0}']
    assert verdicts(spark, s, values) == [True] * 3
    assert verdicts(spark, s.strict(), values) == [True, True, False]
    assert verdicts(spark, s.deep_strict(), values) == [True, False, False]
    assert parsed(spark, s.strict(), values)[2][1] == ("unrecognized_keys", [], 'Unrecognized key "z"')


def test_arrays_tuples_records(spark):
    assert parsed(spark, S.array(S.object_({"b": S.string})), ['[{"b":"x"},{"b":1}]'])[0][1] == ("invalid_input", ["1", "b"], "Expected string, received 1")
    assert verdicts(spark, S.as_schema([S.string, S.number]), ['["a",1]', '["a"]', '["a",1,2]', "{}"]) == [True, False, False, False]
    assert verdicts(spark, S.record(S.number), ['{"a":1}', '{"a":"x"}', "[]"]) == [True, False, False]
    assert verdicts(spark, S.array(S.number).min_length(1).max_length(2), ["[]", "[1]", "[1,2,3]"]) == [False, True, False]


def test_unions(spark):
    tagged = S.union(S.object_({"kind": "a", "x": S.number}), S.object_({"kind": "b", "y": S.string}))
    got = parsed(spark, tagged, ['{"kind":"a","x":1}', '{"kind":"b","y":1}', '{"kind":"c"}'])
    assert got[0][1] is None
    assert got[1][1] == ("invalid_input", ["y"], "Expected string, received 1")
    assert got[2][1][1] == []
    assert verdicts(spark, S.union(S.string.max_length(1), S.string.pattern("^x")), ['"a"', '"xyz"', '"ab"']) == [True, True, False]
    assert verdicts(spark, S.enum(["a", 1, True, None]), ['"a"', "1", "true", "null", '"b"']) == [True] * 4 + [False]
    with pytest.raises(S.SchemaError):
        S.union([])


def test_conversions(spark):
    s = S.string
    assert [v for v, _ in parsed(spark, s.convert(S.number), ['"0x10"', '""', '"abc"'])] == [16.0, 0.0, None]
    assert [v for v, _ in parsed(spark, s.convert(S.number), ['"0x1' + "F" * 17 + '"', '"0b' + "1" * 300 + '"', '"0o17"'])] == [float(int("1" + "F" * 17, 16)), float(2**300 - 1), 15.0]
    assert [v for v, _ in parsed(spark, s.convert(S.bigint), ['"0x' + "F" * 31 + '"', '"0x' + "F" * 32 + '"', '"0b0101"'])] == [16**31 - 1, None, 5]
    assert verdicts(spark, s.convert(S.boolean), ['"true"', '"false"', '"t"', '"1"', '"TRUE"']) == [True, True, False, False, False]
    assert verdicts(spark, s.convert(S.date), ['"2021-02-03T04:05:06.789Z"', '"2021-02-29"', '"x"']) == [True, False, False]
    assert verdicts(spark, s.convert(S.port), ['"80"', '"65536"', '"1.5"']) == [True, False, False]
    assert [v for v, _ in parsed(spark, s.trim(), ['"\\t a \\n"'])] == ["a"]
    assert [bytes(v) for v, _ in parsed(spark, s.convert(S.uint8_array), ['"é"'])] == ["é".encode()]
    with pytest.raises(S.SchemaError, match="string has the same type as the source and the others don't"):
        O.parser(s.convert(S.union(S.number, S.string)))("x")
    for a, b in ((S.boolean, S.number), (S.number, S.date), (S.string, S.array(S.string))):
        with pytest.raises(S.SchemaError) as e:
            O.parser(a.convert(b))("x")
        assert e.value.code == "unsupported_decode"


def test_custom_coders(spark):
    s = S.string.convert(S.number, decode=lambda c: F.length(c), encode=lambda c: F.repeat(F.lit("x"), c.cast("int")))
    assert parsed(spark, s, ['"abc"'])[0][0] == 3.0
    df = spark.sql("select 2.0D as x")
    assert df.select(O.encoder(s)("x").value).first()[0] == "xx"
    with pytest.raises(S.SchemaError):
        O.encoder(S.string.convert(S.number, decode=lambda c: F.length(c)))("x")
    caught = S.string.convert(S.number, decode=O.coder(lambda x: 1.0 / len(x), "double"))
    got = parsed(spark, caught, ['"ab"', '""'])
    assert got[0][0] == 0.5 and got[1][1][0] == "invalid_conversion"


def test_bounds_algebra():
    assert dict(S.number.gte(1).gte(3).gte(2).bounds) == {"gte": 3}
    assert dict(S.number.multiple_of(4).multiple_of(6).bounds) == {"multipleOf": 12}
    for bad in (lambda: S.number.gt(3).lt(2), lambda: S.string.min_length(3).max_length(2), lambda: S.string.gt(1), lambda: S.number.multiple_of(0)):
        with pytest.raises(S.SchemaError):
            bad()


def test_refinements(spark):
    assert column(spark, [0.0075, 0.00755], lambda x: fn.is_multiple(x, 0.0001), "double") == [True, False]
    s = S.object_({"a": S.number, "b": S.number}).refine(lambda o: o["a"] < o["b"], "a before b", ["a"])
    assert parsed(spark, s, ['{"a":1,"b":2}', '{"a":2,"b":1}'])[1][1] == ("invalid_input", ["a"], "a before b")
    assert verdicts(spark, S.string.pattern("^a$"), ['"a"', '"a\\n"']) == [True, False]
    assert parsed(spark, S.string.min_length(2, "too short"), ['"a"'])[0][1][2] == "too short"
    assert verdicts(spark, S.integer, ["1e21", "1.5"]) == [True, False]


@pytest.mark.parametrize("name,good,bad", [
    ("date-time", ["2020-02-29T12:00:00Z", "2020-02-29t12:00:00.5z", "2016-12-31T23:59:60Z"], ["2021-02-29T12:00:00Z", "2020-02-29T12:00:00+01:00", "2016-12-31T22:59:60Z", "2020-01-01T24:00:00Z"]),
    ("date", ["2000-02-29", "2020-04-30"], ["1900-02-29", "2020-04-31"]),
    ("time", ["12:00:00Z", "01:29:60+01:30", "23:59:60z", "15:59:60.123-08:00"], ["12:00:00", "23:59:60+01:00", "12:60:00Z", "12:00:61Z", "12:00:00+24:00"]),
    ("duration", ["P1Y2M3DT4H5M6S", "P2W", "PT1M", "P1M"], ["P", "PT", "P1.5Y", "P1Y2D", "PT1H2S", "P1YT", "P1W2D"]),
    ("email", ["a.b@c.de", "a@b-.com", "o'n@a.io", "-@1.aa"], ["a@b", ".a@b.co", "a..b@c.de", "a'@b.co", "a@b@c.de", "a@-b.com", "a.@b.co"]),
    ("idn-email", ["ü@ö", "x" * 64 + "@" + "y" * 255], ["ü", "x" * 65 + "@y", "x@" + "y" * 256, "a b@c", "@c"]),
    ("uuid", ["123e4567-e89b-12d3-a456-426614174000"], ["123e4567"]), ("cuid", ["cjld2cjxh0000qzrmn831i7rn"], ["x"]),
    ("uri", ["http://a.b/c?d#e", "urn:a:b", "http://[::1]:80/", "mailto:x@y"], ["/a", "http://a b", "http://[::1", "1a:b"]), ("uri-reference", ["/a", "a?b"], ["\\a"]),
    ("uri-template", ["/a{?b,c*}", "{+x:3}/😀", ""], ["/a{", "a\x85b", "{a.b}", "{x:0}"]), ("iri", ["http://ä.de/ö"], ["ä"]), ("iri-reference", ["/ö"], ["\\ö"]),
    ("hostname", ["a-b.c", "x" * 63], ["-a", "a_b", "a..b", "x" * 64, "a."]), ("idn-hostname", ["ä.de", "a_b", "ö。ä"], ["-ä", "a b", "ä..b"]), ("ipv4", ["1.2.3.4"], ["01.2.3.4", "256.1.1.1", "1.2.3"]),
    ("ipv6", ["::1", "1::8", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::"], ["1::2::3", "12345::", "1:2:3:4:5:6:7:8::", "1:2:3:4:5:6:7:8:9", "::1.2.3"]), ("json-pointer", ["", "/a~0b"], ["a", "/~2"]),
    ("relative-json-pointer", ["0#", "1/a"], ["-1", "01"])])
def test_formats(spark, name, good, bad):
    assert verdicts(spark, S.formatted(name), [json.dumps(x) for x in good + bad]) == [True] * len(good) + [False] * len(bad)


def test_shapes_and_encode(spark):
    s = S.object_(lambda c: {"id": c.field("Id", S.string), "z": c.nested("n").field("q", S.number), "k": (c.tag("type", 0), 7)[1]})
    assert parsed(spark, s, ['{"Id":"a","n":{"q":2},"type":0}'])[0][0].asDict() == {"id": "a", "z": 2.0, "k": 7.0}
    assert parsed(spark, s, ['{"Id":"a","n":{"q":2}}'])[0][1][1] == ["type"]
    row = spark.sql("select named_struct('id','a','z',2.0D,'k',7.0D) x").select(O.encoder(s)("x").value).first()[0]
    assert row.asDict(True) == {"Id": "a", "type": 0.0, "n": {"q": 2.0}}
    with pytest.raises(S.SchemaError):
        O.encoder(S.object_(lambda c: {"a": c.field("a", S.string), "b": (c.field("b", S.string), 1)[1]}))("x")
    with pytest.raises(S.SchemaError):
        S.object_(lambda c: (c.field("a", S.string), c.field("a", S.string)))


def test_json_text_round_trip(spark):
    s = S.object_({"a": S.int32, "b": S.optional(S.string), "d": S.date, "g": S.bigint, "l": S.array(S.number), "m": S.record(S.boolean), "t": S.as_schema([S.string, S.number])})
    text = '{"a":1,"d":"2020-01-02T03:04:05.678Z","g":"12","l":[1.5,2],"m":{"x":true},"t":["q",3]}'
    df = O.parse(spark.createDataFrame([(text,)], "x string"), "x", s)
    assert df.select("value_error").first()[0] is None
    assert df.select(O.encoder(S.json_string.convert(s))("value").value).first()[0] == text
    bad = spark.sql("select double('Infinity') x").select(O.encoder(S.json_string.convert(S.number))("x").error["reason"]).first()[0]
    assert bad == "Expected JSON, received Infinity"


def test_compact_columns(spark):
    s = S.compact_columns(S.object_({"a": S.int32, "b": S.string}))
    got = parsed(spark, s, ['[[1,2],["x","y"]]', '[[1,2],["x"]]', "[[1]]", "[[],[]]"])
    assert [tuple(r) for r in got[0][0]] == [(1, "x"), (2, "y")] and got[3][0] == []
    assert got[1][1] == ("invalid_input", ["1", "b"], "Expected string, received undefined")
    assert got[2][1][1] == []


def test_recursive(spark):
    s = S.recursive("Node", lambda n: S.object_({"v": S.string, "next": S.optional(n)}))
    got = parsed(spark, s, ['{"v":"a","next":{"v":"b"}}', '{"v":"a","next":{"v":1}}'])
    assert got[0][1] is None and got[1][1][1] == ["next", "v"]
    deep, bad = '{"v":"a"}', '{"v":1}'
    for _ in range(500):
        deep, bad = (f'{{"v":"a","next":{x}}}' for x in (deep, bad))
    got = parsed(spark, s, [deep, bad])
    assert present(json.loads(got[0][0])["v"]) == json.loads(deep) and got[1][1] == ("invalid_input", ["next"] * 500 + ["v"], "Expected string, received 1")


def test_recursion_through_lists_records_and_unions(spark):
    tree = S.recursive("Tree", lambda t: S.object_({"n": S.string.convert(S.number), "kids": S.optional(S.array(t)), "by": S.optional(S.record(t))}))
    value = {"n": "1", "kids": [{"n": "2", "z": 0}, {"n": "3", "kids": []}, {"n": "4", "by": {"x": {"n": "5"}, "y": {"n": "6", "kids": [{"n": "7"}]}}}]}
    bad = json.dumps(value).replace('"7"', '"seven"')
    got = parsed(spark, tree, [json.dumps(value), bad, '{"n":"1","kids":[null]}', '{"n":"1","kids":{}}', "[]"])
    want = json.loads(json.dumps(value).replace(', "z": 0', ""), parse_int=int)
    numbers = lambda x: {k: float(v) if k == "n" else [numbers(i) for i in v] if k == "kids" else {a: numbers(b) for a, b in v.items()} for k, v in x.items()}
    assert present(json.loads(got[0][0])["v"]) == numbers(want)
    assert got[1][1] == ("invalid_input", ["kids", "2", "by", "y", "kids", "0", "n"], 'Expected number, received "seven"')
    assert got[2][1][1] == ["kids", "0"] and got[3][1][1] == ["kids"] and got[4][1][1] == []
    expr = S.recursive("Expr", lambda e: S.union(S.number, S.object_({"op": "+", "args": S.array(e)}), S.object_({"op": "-", "arg": e})))
    texts = ["1", '{"op":"+","args":[1,{"op":"-","arg":2},[]]}', '{"op":"+","args":[1,{"op":"-","arg":{"op":"+","args":[]}}]}', '{"op":"*"}', '{"op":"-"}']
    assert verdicts(spark, expr, texts) == [True, False, True, False, False]
    grid = S.recursive("Grid", lambda g: S.object_({"rows": S.optional(S.array(S.array(g)))}))
    assert verdicts(spark, grid, ['{"rows":[[{},{"rows":[]}],[{"rows":[[{}]]}]]}', '{"rows":[[{}],[{},{"rows":[[1]]}]]}']) == [True, False]
    assert parsed(spark, grid, ['{"rows":[[{}],[{},{"rows":[[1]]}]]}'])[0][1][1] == ["rows", "1", "1", "rows", "0", "0"]


def test_recursive_schemas_that_hold_each_other(spark):
    inner = S.recursive("Inner", lambda i: S.object_({"v": S.string, "next": S.optional(i)}))
    outer = S.recursive("Outer", lambda o: S.object_({"inner": inner, "next": S.optional(o)}))
    texts = ['{"inner":{"v":"a"}}', '{"inner":{"v":"a","next":{"v":"b"}},"next":{"inner":{"v":"c"}}}', '{"inner":{"v":"a"},"next":{"inner":{"v":"c","next":{"v":2}}}}', '{"next":{}}']
    got = parsed(spark, outer, texts)
    assert [present(json.loads(v)["v"]) if v else None for v, _ in got] == [json.loads(texts[0]), json.loads(texts[1]), None, None]
    assert got[2][1][1] == ["next", "inner", "next", "v"] and got[3][1][1] == ["inner"]
    with pytest.raises(S.SchemaError, match="behind a check"):
        O.parser(from_json_schema({"type": "object", "properties": {"a": {"$ref": "#"}}, "allOf": [{"properties": {"a": {"$ref": "#"}}}]}))("x")


def test_recursive_schemas_that_hold_each_other_at_one_place(spark):
    """Levels of nodes are more than brackets there."""
    s = S.recursive("A", lambda a: S.union(S.recursive("B", lambda b: S.object_({"a": a})), S.number))
    texts = ["1"]
    for _ in range(5):
        texts.append(f'{{"a":{texts[-1]}}}')
    assert verdicts(spark, s, [*texts, texts[-1].replace("1", '"x"')]) == [True] * 6 + [False]


def test_checks_of_recursive_schemas_make_no_values(spark):
    df = spark.createDataFrame([('{"v":"1","next":{"v":"2"}}',)], "x string")
    plan = lambda c: df.select(c)._jdf.queryExecution().optimizedPlan().toString()
    node = S.recursive("Node", lambda n: S.object_({"v": S.string.convert(S.number), "next": S.optional(n)}))
    assert "to_variant_object" not in plan(O.is_valid(node, "x")) and plan(O.is_valid(node, "x")).count("parseJson") == 1
    assert "to_variant_object" in plan(O.parser(node)("x").value)
    # Strings full of brackets are not levels, and a check that reads a value gets it.
    deep = json.dumps({"v": "1", "next": {"v": "[" * 500, "next": {"v": "2"}}})
    assert verdicts(spark, node, [deep, deep.replace("[" * 500, '\\"' * 100), deep.replace("[" * 500, "3")]) == [False, False, True]
    names = [f"d{i}" for i in range(14)]  # each definition is looked at once, not once per way to it
    each = S.Schema("object", props=tuple((n, S.Schema("ref", ref=n)) for n in names))
    assert unread(S.Schema("ref", ref="d0", defs=dict.fromkeys(names, each)), {})
    read = S.recursive("Node", lambda n: S.object_({"v": S.string, "next": S.optional(n)}).refine(lambda o: F.coalesce(F.try_variant_get(o["next"], "$.v", "string"), F.lit("")) != "2", "no 2"))
    assert verdicts(spark, read, ['{"v":"2","next":{"v":"1"}}', '{"v":"1","next":{"v":"1","next":{"v":"2"}}}']) == [True, False]


def test_errors_of_recursive_schemas_are_found_once(spark):
    node = S.recursive("Node", lambda n: S.object_({"v": S.string.convert(S.number), "next": S.optional(n)}))
    df = spark.createDataFrame([('{"v":"1","next":{"v":"x"}}',)], "x string").select(O.parser(node)("x").error.alias("e"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert tuple(df.first().e) == ("invalid_input", ["next", "v"], 'Expected number, received "x"')


@pytest.mark.parametrize("name", ["l6_recursive", "l7_recursive_values"])
def test_rows_of_a_small_file_are_dealt_to_all_cores(spark, name):
    from tessera import tablequeries

    assert tablequeries.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_merge_reverse_text():
    a, b = S.object_({"x": S.string, "y": S.number}), S.object_({"y": S.boolean})
    assert S.expression(S.merge(a, b)) == "{ x: string; y: boolean; }"
    s = S.string.convert(S.number)
    assert str(s) == "Schema<string, number>" and str(s.reverse()) == "Schema<number, string>"
    assert S.expression(S.array(S.union(S.string, S.null))) == "(string | null)[]"
    with pytest.raises(S.SchemaError):
        S.merge(a, S.string)
    with pytest.raises(S.SchemaError):
        S.symbol()
    assert O.path_to_array(O.path_from_array(["a", "0"])) == ["a", "0"]


def test_modes(spark):
    df = spark.createDataFrame([('{"k":1}',), ('{"k":"x"}',)], "x string")
    s = S.object_({"k": S.number})
    assert O.parse(df, "x", s, mode="drop_invalid").count() == 1
    with pytest.raises(Exception, match="Expected number"):
        O.parse(df, "x", s, mode="fail_fast").collect()
    with pytest.raises(Exception, match="Expected number"):
        O.assert_valid(df, "x", s).collect()
    issues = df.select(O.standard_validate(s, "x").alias("r")).collect()
    assert issues[0].r.issues is None and issues[1].r.issues[0].path == ["k"]
    assert [(r.code, r.path, r.n) for r in O.error_statistics(O.parse(df, "x", s)).collect()] == [("invalid_input", '["k"]', 1)]


def test_no_shuffle(spark):
    df = O.parse(spark.createDataFrame([("{}",)], "x string"), "x", S.object_({"k": S.array(S.number)}))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_export():
    s = S.object_({"a": S.string.min_length(1), "b": S.optional(S.int32, 3), "c": S.nullable(S.boolean), "d": S.enum(["x", "y"])}).strict()
    assert to_json_schema(s) == {
        "type": "object", "properties": {"a": {"type": "string", "minLength": 1}, "b": {"type": "integer", "default": 3},
                                         "c": {"anyOf": [{"type": "boolean"}, {"type": "null"}]}, "d": {"type": "string", "enum": ["x", "y"]}},
        "additionalProperties": False, "required": ["a", "c", "d"]}
    assert "prefixItems" in to_json_schema(S.as_schema([S.string]), "draft-2020-12")
    assert to_json_schema(S.nullable(S.string), "openapi-3.0") == {"type": "string", "nullable": True}
    with pytest.raises(S.SchemaError):
        to_json_schema(S.object_({"d": S.bigint}))
    s = S.recursive("N", lambda n: S.object_({"c": S.array(n)}))
    assert to_json_schema(s)["$ref"] == "#/definitions/N"


@pytest.mark.parametrize("doc,good,bad", [
    ({"type": "string", "minLength": 2}, ['"ab"', '"\U0001F600a"'], ['"a"', "1"]),
    ({"minLength": 2}, ['"ab"', "1", "[]"], ['"a"']),
    ({"type": "object", "properties": {"a": {"type": "number"}}, "required": ["a"], "additionalProperties": False}, ['{"a":1}'], ["{}", '{"a":1,"b":2}']),
    ({"type": "object", "properties": {"a": {}}, "additionalProperties": {"type": "number"}}, ['{"a":"x","b":1}'], ['{"a":1,"b":"x"}']),
    ({"type": "array", "items": {"type": "integer"}, "minItems": 1}, ["[1]"], ["[]", "[1.5]"]),
    ({"type": "array", "prefixItems": [{"type": "string"}], "items": False}, ['["a"]', "[]"], ['["a",1]', "[1]"]),
    ({"enum": ["a", 1, None]}, ['"a"', "1", "null"], ['"b"']), ({"const": {"a": 1}}, ['{"a":1}'], ['{"a":2}', "1"]),
    ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, ["2", '"x"'], ["0", "4"]),
    ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ['"x"', "3"], ["2"]),
    ({"oneOf": [{"minimum": 1}, {"minimum": 3}]}, ["2"], ["0", "4"]),
    ({"not": {"type": "string"}}, ["1"], ['"x"']),
    ({"if": {"type": "string"}, "then": {"maxLength": 1}, "else": {"type": "number"}}, ['"a"', "1"], ['"ab"', "true"]),
    ({"$ref": "#/$defs/n", "$defs": {"n": {"type": "object", "properties": {"v": {"type": "number"}, "c": {"type": "array", "items": {"$ref": "#/$defs/n"}}}, "required": ["v"]}}},
     ['{"v":1,"c":[{"v":2}]}'], ['{"v":1,"c":[{}]}']),
    ({"type": ["string", "null"]}, ['"a"', "null"], ["1"]), (True, ["1"], []), (False, [], ["1"])])
def test_import(spark, doc, good, bad):
    assert verdicts(spark, from_json_schema(doc), good + bad, "json") == [True] * len(good) + [False] * len(bad)


def test_import_defaults_and_equality(spark):
    s = from_json_schema({"type": "object", "properties": {
        "a": {"type": "array", "items": {"type": "number"}, "default": []}, "o": {"type": "object", "properties": {"x": {"type": "string"}}, "default": {"x": "y"}},
        "n": {"type": "integer", "default": ""}}})
    got = parsed(spark, s, ["{}", '{"a":[1],"n":2}'])
    assert got[0][0]["a"] == [] and got[0][0]["o"]["x"] == "y" and got[0][0]["n"] is None and got[1][0]["a"] == [1.0]
    assert verdicts(spark, from_json_schema({"enum": [1, [2]]}), ["1e0", "1", "[2.0]", "[2,2]", '"1"']) == [True, True, True, False, False]
    assert verdicts(spark, from_json_schema({"const": {"a": [1, None], "b": True}}), ['{"b":true,"a":[1.0,null]}', '{"a":[1,null]}', '{"a":[1,0],"b":true}']) == [True, False, False]


def test_paths():
    for path in ([], ["a"], ['x"]["y', "]", "[", "0"], [""]):
        assert O.path_to_array(O.path_from_array(path)) == path
    with pytest.raises(ValueError):
        O.path_to_array('["a"')


def test_never_in_a_union(spark):
    s = S.union(S.string.convert(S.number, encode=lambda c: c.cast("string")), S.string.convert(S.number, decode="never"), S.number)
    assert verdicts(spark, S.union(S.string.convert(S.number, decode="never"), S.number), ["1", '"1"']) == [True, False]
    assert s.arms
    with pytest.raises(S.SchemaError):
        O.parser(S.union(S.string.convert(S.number, decode="never"), S.never))("x")


def test_size_of_expressions(spark):
    """Linear in the nodes of a schema, however deep they are."""
    def size(s):
        r = O.parser(s)("x")
        return len(str(r.error._jc.toString())) + len(str(r.value._jc.toString()))

    def nested(depth, wrap):
        s = S.string
        for _ in range(depth):
            s = wrap(s)
        return size(s)

    wraps = (lambda s: S.optional(S.object_({"a": s, "b": S.number})), lambda s: S.union(S.object_({"k": "a", "x": s}), S.object_({"k": "b", "y": S.number})),
             lambda s: S.object_({"o": S.optional(S.number), "u": S.union(S.string, S.array(s))}), lambda s: S.array(S.nullable(s, None)), lambda s: S.record(S.union(S.int32.gt(1), s)))
    for wrap in wraps:
        sizes = [nested(n, wrap) for n in (2, 4, 6)]
        assert sizes[2] - sizes[1] < 1.7 * (sizes[1] - sizes[0]) + 1000
    two = S.recursive("Node", lambda n: S.object_({"v": S.string.convert(S.number), "left": S.optional(n), "right": S.optional(n)}))
    assert size(two) < 250_000
    node = S.recursive("Node", lambda n: S.object_({"v": S.string.convert(S.number), "d": S.optional(S.number, 7), "next": S.optional(n)}))
    value = json.loads(parsed(spark, node, ['{"v":"1","x":2,"next":{"v":"2"}}'])[0][0])["v"]
    assert (value["v"], value["d"], value["next"]["v"], value["next"]["d"], "x" in value, value["next"].get("next")) == (1, 7, 2, 7, False, None)


def test_arms_keep_their_order(spark):
    arms = S.string, S.literal("a").convert(S.literal("b")), S.object_({"k": S.number})
    assert parsed(spark, S.union(*arms), ['"a"'])[0][0] == '{"v":"a"}'
    assert parsed(spark, S.union(arms[1], arms[0], arms[2]), ['"a"', '"c"'])[0][0] == '{"v":"b"}'
    broad, tagged = S.record(S.number), S.object_({"t": S.literal(1), "u": S.optional(S.number)})
    assert parsed(spark, S.union(broad, tagged), ['{"t":1,"u":2,"w":3}'])[0][0] == '{"v":{"t":1.0,"u":2.0,"w":3.0}}'
    assert parsed(spark, S.union(tagged, broad), ['{"t":1,"u":2,"w":3}'])[0][0] == '{"v":{"t":1.0,"u":2.0}}'
    refined = S.union(S.string.min_length(3), S.number, S.string)
    assert verdicts(spark, refined, ['"abcd"', '"ab"', '""', "42", "true"]) == [True, True, True, True, False]
    assert parsed(spark, refined, ["true"])[0][1][2] == "Expected string (length >= 3) | number | string, received true"


def test_arms_that_no_value_reaches():
    from tessera.plans import Options, live, mask

    names = lambda *arms, kind="json": [S.expression(a) for a in live(tuple(map(S.as_schema, arms)), kind, Options())]
    assert names("a", S.string, "b") == ["string"] and names(S.string, "a", 1) == ["string", "1"]
    assert names("a", S.string.trim(), S.string) == ['"a"', "string", "string"]  # one arm changes strings
    assert names(S.string, S.never, S.url, kind="unknown") == ["string"]  # no VARIANT is a URL
    assert mask(S.optional(S.array(S.number)), "json") == {"array", "absent", "null"} and mask(S.nullable(S.bigint), "unknown") == {"number", "null"}


def test_one_test_of_the_type(spark):
    s = S.union(S.string, S.number, S.array(S.number), S.object_({"a": S.number}), S.boolean, None)
    text = str(O.parser(s)("x", "unknown").value._jc.toString())
    assert text.count("schema_of_variant(x)") == 1
    values = ['"a"', "1.5", "[1,2]", '{"a":3}', "true", "null", '["x"]', '{"a":"y"}']
    assert [e and (e[1], e[2].split("\n")[1:]) for _, e in parsed(spark, s, values, "unknown")] == [None] * 6 + [
        ([], ['- At ["0"]: Expected number, received "x"']), ([], ['- At ["a"]: Expected number, received "y"'])]


def test_text_of_unions(spark):
    """Each arm writes its own text, wherever the union is."""
    tagged = S.union(S.object_({"kind": "a", "n": S.bigint}), S.object_({"kind": "b", "d": S.date, "x": S.number}), S.object_({"kind": "c", "n": S.bigint}))
    source = S.union(S.object_({"kind": "a", "n": S.bigint}), S.object_({"kind": "b", "d": S.date, "x": S.number}), S.object_({"kind": "c", "n": S.bigint}))
    texts = ['{"kind":"a","n":"5"}', '{"kind":"b","d":"2020-01-02T03:04:05.678Z","x":1e21}', '{"kind":"c","n":"7"}']
    df = O.parse(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i"), "x", source)
    write = lambda s, c: [r[0] for r in df.select(O.encoder(S.json_string.convert(s))(c).value).collect()]
    want = [texts[0], texts[1].replace("1e21", "1e+21"), texts[2]]
    assert write(tagged, F.col("value")) == want
    assert write(S.array(tagged), F.array("value", "value")) == [f"[{t},{t}]" for t in want]
    assert write(S.record(tagged), F.create_map(F.lit("k"), F.col("value"))) == [f'{{"k":{t}}}' for t in want]
    assert write(S.object_({"u": S.nullable(tagged)}), F.struct(F.when(F.col("i") > 0, F.col("value")).alias("u"))) == ['{"u":null}', f'{{"u":{want[1]}}}', f'{{"u":{want[2]}}}']
    as_json = df.select(F.to_json(O.encoder(S.json_value.convert(tagged))("value").value)).first()[0]
    assert json.loads(as_json) == {"kind": "a", "n": "5"}
    # Structs of one type are told apart by their constants too.
    same = S.union(S.object_({"kind": "a", "n": S.bigint}), S.object_({"kind": "b", "n": S.bigint}))
    row = spark.sql("select named_struct('kind', 'b', 'n', 12bd) x")
    assert row.select(O.encoder(S.json_string.convert(same))("x").value).first()[0] == '{"kind":"b","n":"12"}'
    scalars = S.union(S.bigint, S.number, S.date, S.boolean, S.uint8_array, S.string, None)
    row = spark.sql("select array(cast(5 as decimal(38,0))::variant, 5.0D::variant, timestamp'2020-01-01 00:00:00'::variant, true::variant, X'41'::variant, 'q\"'::variant, null) x")
    assert row.select(O.encoder(S.json_string.convert(S.array(scalars)))("x").value).first()[0] == '["5",5,"2020-01-01T00:00:00.000Z",true,"A","q\\"",null]'
    bad = spark.sql("select double('NaN')::variant x").select(O.encoder(S.json_string.convert(S.union(S.number, S.string)))("x").error["reason"]).first()[0]
    assert "NaN" in bad


def test_paths_of_tuples(spark):
    s = S.as_schema([S.string, S.number.gt(1)])
    row = spark.sql("select named_struct('_1', 'a', '_2', 0.0D) x")
    assert row.select(O.decoder(s)("x").error["path"]).first()[0] == ["1"]
    row = spark.sql("select named_struct('_1', 'a', '_2', double('Infinity')) x")
    assert row.select(O.encoder(S.json_string.convert(S.as_schema([S.string, S.number])))("x").error["path"]).first()[0] == ["1"]


def test_import_rejects():
    for key in ("uniqueItems", "patternProperties", "contains", "$dynamicRef"):
        with pytest.raises(S.SchemaError):
            from_json_schema({key: True})
    with pytest.raises(S.SchemaError):
        from_json_schema({"$ref": "other.json"})


def test_streaming(spark, tmp_path):
    from tessera.streaming import parse_stream

    src = str(tmp_path / "in")
    spark.createDataFrame([('{"k":1}',), ('{"k":"x"}',)], "value string").write.text(src)
    stream = parse_stream(spark.readStream.text(src), "value", S.object_({"k": S.number}), into="out", mode="drop_invalid")
    q = stream.select("out.k").writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.k for r in spark.table("kept").collect()] == [1.0]


def test_schema_of_types():
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("a", T.StringType(), False), T.StructField("b", T.ArrayType(T.DoubleType(), False))])
    assert S.expression(O.schema_of(kind)) == "{ a: string; b: number[] | undefined; }"


def test_operator_cases(spark):
    """Single operators on listed inputs, with answers by their definitions."""
    from tests import cases

    for name, run in cases.CASES.items():
        got, want = run(spark)
        assert got == want, name


def test_table_queries(spark):
    import duckdb

    from tessera import tablequeries

    con, folder = duckdb.connect(), "/root/testdata/sf0.001"
    for table in tablequeries._KEYS:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    for name in ("t5_email", "c6_string_to_bigint", "c18_typed_to_json_string", "f15_pattern", "p9_shaped_serialize", "u4_union_of_every_type", "u7_union_error", "u12_union_text", "l7_recursive_values", "j8_ref"):
        got = sorted(map(repr, map(tuple, tablequeries.QUERIES[name](spark, folder).collect())))
        assert got == sorted(map(repr, con.execute(tablequeries.SQL[name]).fetchall())), name


def test_idn_email_query_meets_every_limit(spark, tmp_path):
    """Its inputs tell the format from each pattern that is looser or tighter in one place."""
    import re

    import duckdb

    from tessera import tablequeries

    con = duckdb.connect()
    con.execute(f"COPY (SELECT c_custkey, CASE WHEN c_custkey % 37 > 0 THEN 'BUILDING' END AS c_mktsegment FROM range(2000) r(c_custkey) UNION ALL SELECT NULL, 'X') TO '{tmp_path}/customer.parquet'")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    sql = tablequeries.SQL["t6_idn_email"]
    got = dict(map(tuple, tablequeries.QUERIES["t6_idn_email"](spark, str(tmp_path)).collect()))
    assert len(got) == 2001 and got == dict(con.execute(sql).fetchall())
    inputs = con.execute("SELECT c_custkey, x FROM (" + sql.split(" FROM (", 1)[1]).fetchall()

    def told(pattern):
        return {k: x is not None and re.fullmatch(pattern, x) is not None for k, x in inputs}

    white = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
    assert got == told(f"[^{white}@]{{1,64}}@[^{white}@]{{1,255}}")
    for local, domain in (("0,64", "1,255"), ("1,63", "1,255"), ("1,65", "1,255"), ("1,64", "0,255"), ("1,64", "1,254"), ("1,64", "1,256")):
        assert got != told(f"[^{white}@]{{{local}}}@[^{white}@]{{{domain}}}"), (local, domain)
    assert got != told(f"[^{white}@]{{1,64}}@[^{white}]{{1,255}}") and got != told(f"[^{white}@]{{1,64}}@?[^{white}@]{{1,255}}")
    assert got != told(f"[^{white}@\\x80-\\U0010ffff]{{1,64}}@[^{white}@]{{1,255}}") and any(len(x.encode("utf-16-le")) > 2 * 256 for k, x in inputs if got[k])
    for c in white:
        rest = white.replace(c, "")
        assert got != told(f"[^{rest}@]{{1,64}}@[^{white}@]{{1,255}}") and got != told(f"[^{white}@]{{1,64}}@[^{rest}@]{{1,255}}"), ascii(c)
    for c in "\x1c\x85\u180e\u200b\u2060":
        assert got != told(f"[^{white}{c}@]{{1,64}}@[^{white}@]{{1,255}}"), ascii(c)


def test_entry_queries_have_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 30


@pytest.mark.parametrize(("source", "target", "why"), [
    (S.union(S.number, S.string), S.string, "string has the same type as the target and the others don't"),
    (S.union(S.number, S.string, S.boolean), S.union(S.number, S.string), "boolean has no same-type variant on the other side"),
    (S.union(S.number, S.string), S.union(S.number, S.string, S.boolean), "boolean has no same-type variant on the other side"),
])
def test_unclear_union_conversions_are_refused(spark, source, target, why):
    with pytest.raises(S.SchemaError, match=why):
        O.parser(source.convert(target))(F.lit("1"))


def test_unions_of_one_type_and_covered_unions_are_taken(spark):
    O.parser(S.string.convert(S.union("a", "b")))(F.lit("1"))
    O.parser(S.union(S.string, None).convert(S.union(S.string, S.undefined)))(F.lit("1"))


def test_global_options_hold_for_what_is_made_later():
    before = S.object_({"a": S.number})
    O.global_options(default_extras="strict", allow_nan=True)
    try:
        assert S.object_({"a": S.number}).extras == "strict" and before.extras == "strip"
        assert S.object_({"a": S.object_({"b": S.number})}).props[0][1].extras == "strict"
        assert O.Options().allow_nan
    finally:
        O.global_options()
    assert S.object_({"a": S.number}).extras == "strip" and not O.Options().allow_nan
    with pytest.raises(S.SchemaError):
        O.global_options(default_extras="keep")


def test_text_formats_in_documents():
    assert to_json_schema(S.cuid) == {"type": "string"}
    text = S.json_string.convert(S.object_({"a": S.number}))
    assert to_json_schema(text, "draft-07")["contentMediaType"] == "application/json"
    assert "contentSchema" not in to_json_schema(text, "draft-07")
    assert to_json_schema(text, "draft-2020-12")["contentSchema"]["properties"] == {"a": {"type": "number"}}
    assert to_json_schema(text, "openapi-3.0") == {"type": "string"}
    assert "contentSchema" not in to_json_schema(S.json_string.convert(S.bigint), "draft-2020-12")


@pytest.mark.parametrize(("pattern", "flags", "good", "bad"), [
    (r"^a[^]b$", "", ["a\nb", "axb"], ["ab", "a\r\nb"]), (r"(?<a_b>x)y\k<a_b>", "", ["xyx"], ["xyy"]), (r"^\u{61}$", "u", ["a"], ["u"]), (r"^\u{3}$", "", ["uuu"], ["a", "\x03"]),
    (r"^\s$", "", [" ", "﻿", " ", " "], ["\u0085", "᠎", "x"]), (r"^.$", "", ["\u0085", "x"], ["\n", "\r", " ", " "]), (r"^.$", "s", ["\n", " "], ["", "ab"]),
    (r"^\w\d$", "", ["a1", "_9"], ["é1", "a٣"]), (r"\bfoo\b", "", ["a foo.", "éfooé"], ["foot", "_foo"]), (r"^a$", "", ["a"], ["a\n", "b\na"]), (r"^a$", "m", ["a\n", "b\na c"], ["ab"]),
    (r"^[a-z&&[aeiou]]$", "", ["a]", "&]", "[]"], ["a", "A]"]), (r"^x{,2}$", "", ["x{,2}"], ["xx"]), (r"^a{2}]}$", "", ["aa]}"], ["aa"]), (r"^[\b\-\]]+$", "", ["\b-]"], ["b"]),
    (r"^\cJ\x41\101\0$", "", ["\nAA\0"], ["JAA0"]), (r"(?i)", "", [], None), (r"ÉTÉ", "i", ["été"], ["ete"]), (r"^\p{Lu}+$", "u", ["ÀÉ"], ["à"]), (r"^\p{Script=Greek}$", "u", ["α"], ["a"]), (r"^p{2}$", "", ["pp"], ["p{2}"]),
    (r"^[^\s\d]+$", "", ["ab"], ["a b", "a1"]), (r"^(?:a|b)*?c(?=d)", "", ["abcd"], ["abc"]), (r"(?<!\$)\d{2,3}", "", ["x12"], ["$1"]), (r"^#\Q$", "", ["#Q"], ["#"]), (r"a++", "", [], None), ("(", "", [], None), ("a{3,1}", "", [], None),
    (r"(?<x>a)|b\k<x>", "", [], None), (r"(a)?\1", "", [], None), (r"[z-a]", "", [], None), (r"\u{110000}", "u", [], None), (r"\-", "u", [], None), (r"[]", "", [], ["", "a"]), (r"(?<n>a)(?<n>b)", "", [], None)])
def test_patterns(spark, pattern, flags, good, bad):
    if bad is None:
        with pytest.raises(S.SchemaError, match="Invalid pattern"):
            S.string.pattern(pattern, flags=flags)
        return
    got = column(spark, good + bad, lambda x: O.decoder(S.string.pattern(pattern, flags=flags))(x).valid)
    assert got == [True] * len(good) + [False] * len(bad)


def test_patterns_that_the_engine_refuses(spark):
    with pytest.raises(S.SchemaError, match="Invalid pattern"):
        O.decoder(S.string.pattern(r"\p{Nonsense}", flags="u"))("x")


def test_defaults_are_checked_when_made(spark):
    import datetime

    for make in (lambda: S.optional(S.number, "x"), lambda: S.optional(S.number.gt(5), 1), lambda: S.nullable(S.string.min_length(3), "ab"), lambda: S.nullish(S.array(S.number), [1, "x"]),
                 lambda: S.optional(S.object_({"a": S.number}), {"a": "x"}), lambda: S.optional(S.enum(["a", "b"]), "c"), lambda: S.optional(S.int32, 1.5), lambda: S.optional(S.string.pattern(r"^\d+$"), "x"),
                 lambda: S.optional(S.string.convert(S.number), "1"), lambda: S.object_(lambda c: c.field_or("a", S.boolean, 1))):
        with pytest.raises(S.SchemaError, match="Invalid default for"):
            make()
    with pytest.raises(S.SchemaError, match=r'Invalid default for number\[\] \| undefined: Failed at \["1"\]: Expected number, received "x"'):
        S.optional(S.array(S.number), [1, "x"])
    s = S.object_({"n": S.optional(S.string.convert(S.number), 7), "l": S.optional(S.array(S.number), [1, 2]), "o": S.nullable(S.object_({"x": S.string, "d": S.date}), {"x": "q", "d": datetime.datetime(2020, 1, 2)}),
                   "u": S.optional(S.union(S.string, S.number), 5), "f": S.optional(S.number, lambda: F.lit(3.0))})
    got = parsed(spark, s, ['{"o":null}', '{"n":"8","l":[],"o":{"x":"y","d":"2021-01-01"},"u":"t","f":1}'])
    assert (got[0][0]["n"], got[0][0]["l"], got[0][0]["o"]["x"], got[0][0]["o"]["d"], got[0][0]["u"].toPython(), got[0][0]["f"]) == (7, [1, 2], "q", datetime.datetime(2020, 1, 2), 5, 3)
    assert got[1][1] is None and got[1][0]["n"] == 8
    doc = to_json_schema(S.object_({"n": S.optional(S.string.convert(S.number), 7), "f": S.optional(S.number, lambda: F.lit(1.0)), "c": S.optional(S.string.convert(S.number, decode=lambda c: F.length(c)), 2)}))
    assert doc["properties"] == {"n": {"type": "string", "default": "7"}, "f": {"type": "number"}, "c": {"type": "string"}}


def test_examples_are_kept_in_input_form():
    s = S.string.convert(S.number).with_meta(examples=[1, 2.5, 1e21, 1e-7])
    assert to_json_schema(s)["examples"] == ["1", "2.5", "1e+21", "1e-7"]
    nested = S.object_({"a": S.array(S.string.convert(S.bigint)), "b": S.optional(S.string.convert(S.boolean))}).with_meta(examples=[{"a": [1, 10**30], "b": True}, {"a": []}])
    assert to_json_schema(nested)["examples"] == [{"a": ["1", "1" + "0" * 30], "b": "true"}, {"a": []}]
    with pytest.raises(S.SchemaError, match='Expected number, received "1"'):
        S.string.convert(S.number).with_meta(examples=["1"])
    assert "examples" not in to_json_schema(S.string.convert(S.number, decode=lambda c: F.length(c)).with_meta(examples=[1]))
    assert from_json_schema({"type": "string", "examples": [1]}).get_meta("examples") == [1]


def test_merged_documents_require_every_key():
    doc = to_json_schema(S.merge(S.object_({"a": S.optional(S.string)}), S.object_({"b": S.number})))
    assert doc["required"] == ["a", "b"] and list(doc["properties"]) == ["a", "b"]
    assert to_json_schema(S.string.pattern("^a", flags="i"))["pattern"] == "^a"


def test_asynchronous_coders(spark):
    import asyncio

    async def slow(x):
        await asyncio.sleep(0.05 + (len(x) % 3) * 0.01)
        if x == "bad":
            raise ValueError("no " + x)
        if x == "late":
            await asyncio.sleep(30)
        return len(x)

    values = ["x" * i for i in range(1, 120)] + ["bad", None, "late", "ok"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string").coalesce(1)
    s = S.optional(S.string.convert(S.number, decode=O.async_coder(slow, "double", in_flight=40, timeout=2)))
    r = O.async_decoder(s)("x")
    began = time.time()
    got = df.select(r.value.alias("v"), r.error.alias("e")).collect()
    took = time.time() - began
    assert [x.v for x in got[:119]] == [float(i) for i in range(1, 120)] and got[-1].v == 2.0
    assert [x.e and (x.e.code, x.e.reason) for x in got[119:]] == [("invalid_conversion", "no bad"), None, ("invalid_conversion", "no answer in 2 s"), None]
    assert took < 119 * 0.05 + 2  # one by one they would wait 7 s before the last


def test_batch_coders_and_containers_of_coders(spark):
    s = S.string.convert(S.number, decode=O.batch_coder(lambda x: 12.0 / x.str.len().where(x != "", other=float("nan")).map(lambda n: n if n == n else int("none")), "double"))
    assert [v for v, _ in parsed(spark, s, ['"ab"', '"abc"'])] == [6.0, 4.0]
    got = parsed(spark, s, ['"ab"', '""', '"abc"'])
    assert [v for v, _ in got] == [6.0, None, 4.0] and got[1][1][0] == "invalid_conversion"
    lists = S.string.convert(S.array(S.number), decode=lambda c: F.split(c, ","))
    got = parsed(spark, lists, ['"1,2"', '"1,x"'])
    assert got[0][0] == [1.0, 2.0] and got[1][1][1] == ["1"]


def test_standard_interface(spark):
    it = O.standard(S.object_({"a": S.string.convert(S.number)}))
    assert it["version"] == 1 and it["jsonSchema"]["input"]()["properties"] == {"a": {"type": "string"}} and it["jsonSchema"]["output"]("draft-07")["properties"] == {"a": {"type": "number"}}
    row = spark.createDataFrame([('{"a":"x"}',)], "x string").select(it["validate"]("x").alias("r")).first().r
    assert row.issues[0].path == ["a"]


@pytest.mark.parametrize(("text", "want"), [
    ("http://EXAMPLE.com", "http://example.com/"), (" https://a.b:443/x/./y/../z?q#f ", "https://a.b/x/z?q#f"), ("http:\\\\a.b\\c", "http://a.b/c"), ("http:a.b", "http://a.b/"), ("HTTP://u:p%40@a.b:8080", "http://u:p%40@a.b:8080/"),
    ("http://a.b/%2e%2E/..", "http://a.b/"), ("http://a.b/c/.", "http://a.b/c/"), ("http://a.b/é ?ü'#<>", "http://a.b/%C3%A9%20?%C3%BC%27#%3C%3E"), ("ht\ntp://a\t.b", "http://a.b/"), ("http://a.b?", "http://a.b/?"), ("http://a.b#", "http://a.b/#"),
    ("http://0x7f.1", "http://127.0.0.1/"), ("http://017.0.0.1/", "http://15.0.0.1/"), ("http://1.2.3.4.", "http://1.2.3.4/"), ("http://256", "http://0.0.1.0/"), ("http://1.2.3.256", None), ("http://a.1.b.09", None),
    ("http://[2001:DB8:0:0:1:0:0:1]:80", "http://[2001:db8::1:0:0:1]/"), ("http://[::ffff:1.2.3.4]", "http://[::ffff:102:304]/"), ("http://[::1", None), ("http://[1::2::3]", None), ("http://%41.com", "http://a.com/"), ("http://a%00b", None),
    ("http://", None), ("http://a b", None), ("http://a.b:x", None), ("http://a.b:65536", None), ("http://a.b:", "http://a.b/"), ("http://a.b:0080", "http://a.b/"), ("//a.b", None), ("a", None), ("", None), ("1a:b", None), ("http://@a.b", "http://a.b/"), ("http://a@b@c.d/", "http://a%40b@c.d/"),
    ("file:///a/../b", "file:///b"), ("file://localhost/c", "file:///c"), ("file:x", "file:///x"), ("mailto:x@y.z", "mailto:x@y.z"), ("data:text/plain,é b", "data:text/plain,%C3%A9 b"), ("foo://Bar/a/../b", "foo://Bar/b"), ("foo:/a/./b", "foo:/a/b"), ("foo://", "foo://"), ("foo:/..//b", "foo:/.//b"),
    ("ws://a.b:80/", "ws://a.b/"), ("javascript:alert(1)", "javascript:alert(1)"), ("blob:x", "blob:x"), (None, None)])
def test_urls(spark, text, want):
    from tessera.urls import href

    assert column(spark, [text, text], href)[0] == want


def test_urls_are_normal(spark):
    s = S.object_({"u": S.url})
    assert parsed(spark, s, ['{"u":"HTTP://A.b/x/.."}', '{"u":"x y"}'])[0][0]["u"] == "http://a.b/"
    assert parsed(spark, s, ['{"u":"x y"}'])[0][1] == ("invalid_input", ["u"], 'Expected URL, received "x y"')


def test_columns_in_pieces(spark):
    rows = spark.createDataFrame([(i, f'q"{i}', None if i % 3 else i * 0.5) for i in range(1000)], "k int, t string, x double").repartition(5)
    s = S.object_({"k": S.int32, "t": S.string, "x": S.nullable(S.number)})
    got = O.column_pieces(rows, s, "k", most=70).collect()
    assert [r.position for r in got] == list(range(len(got))) and len(got) >= 3 * 15
    assert json.loads("".join(r.text for r in got)) == [list(range(1000)), [f'q"{i}' for i in range(1000)], [None if i % 3 else i * 0.5 for i in range(1000)]]
    assert {(r.column, r.first_row) for r in got if r.first_row == 0} == {(0, 0), (1, 0), (2, 0)}
    assert [r.text for r in O.column_pieces(rows.limit(0), s, "k").collect()] == ["[[],[],[]]"]
    back = O.parse(spark.createDataFrame([("".join(r.text for r in got),)], "t string"), "t", S.compact_columns(s)).select(F.inline("value"))
    assert back.count() == 1000 and back.filter("k = 999").first().t == 'q"999'


def test_whole_numbers_of_any_size(spark):
    from tessera.functions import wide

    values = ["0", "-0", "+007", "", " 12 ", "9" * 100, "-" + "0" * 5 + "1" * 100, "0x" + "F" * 80, "0o" + "7" * 70, "0b" + "10" * 90, "1.5", "0x", "--1", "1e3", "-0x1", None]
    want = ["0", "0", "7", "0", "12", "9" * 100, "-" + "1" * 100, str(int("F" * 80, 16)), str(int("7" * 70, 8)), str(int("10" * 90, 2)), None, None, None, None, None, None]
    assert column(spark, values, wide.canonical) == want
    numbers = [0, 5, -5, 10**50, 10**50 + 1, -(10**50), 10**99, 123456789012345678901234567890, -17 * 10**40]
    for to in (0, 5, -5, 10**50, -(10**50), 10**60):
        assert column(spark, [str(n) for n in numbers], lambda x, to=to: wide.compared(x, to)) == [(n > to) - (n < to) for n in numbers]
    for of in (1, 7, 10**9, 17 * 10**15):
        assert column(spark, [str(n) for n in numbers], lambda x, of=of: wide.is_multiple(x, of)) == [n % of == 0 for n in numbers]
    s = S.object_({"n": S.wide_bigint.gt(10**60).multiple_of(3)})
    big = 3 * 10**99
    got = parsed(spark, s, [f'{{"n":"{big}"}}', f'{{"n":"{big + 1}"}}', '{"n":"9"}', '{"n":9}'])
    assert got[0][0]["n"] == str(big) and [g[1] is None for g in got] == [True, False, False, False] and got[3][1][2].startswith("Expected bigint (> 1")
    row = spark.createDataFrame([(str(big),)], "x string").select(F.struct("x").alias("x")).select(F.struct(F.col("x.x").alias("n")).alias("x"))
    assert row.select(O.encoder(S.json_string.convert(s))("x").value).first()[0] == f'{{"n":"{big}"}}'
    assert [v for v, _ in parsed(spark, S.number.convert(S.wide_bigint), ["12", "1.5", "1e20"])] == ["12", None, "1" + "0" * 20]
    assert [v for v, _ in parsed(spark, S.string.convert(S.wide_bigint).convert(S.bigint).convert(S.string), ['"0012"', '"' + "9" * 39 + '"'])] == ["12", None]


def test_null_among_constants_in_typed_values(spark):
    s = S.array(S.object_({"k": S.enum(["a", None]), "n": S.union(S.number, S.object_({"x": S.nullable(S.bigint)}))}))
    text = '[{"k":"a","n":1.5},{"k":null,"n":{"x":null}},{"k":"a","n":{"x":"7"}}]'
    df = O.parse(spark.createDataFrame([(text,)], "x string"), "x", s)
    assert df.select("value_error").first()[0] is None
    assert df.select(O.encoder(S.json_string.convert(s))("value").value).first()[0] == text
