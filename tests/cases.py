"""Single operators over inputs good and bad. A case is an input and what the operator makes of it, said by the
operator's definition: JSON text of the value as `{"v":...}`, or the reason why there is none."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera import operators as O
from tessera import schema as S
from tessera.jsonschema import from_json_schema

CASES: dict[str, Callable[[SparkSession], tuple[list, list]]] = {}


def _add(name: str, made: Callable[[Column], Column], cases: list[tuple[str | None, Any]]) -> None:
    def run(spark: SparkSession) -> tuple[list, list]:
        rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string").coalesce(1)
        return [r.said for r in rows.select("i", made(F.col("x")).alias("said")).orderBy("i").collect()], [a for _, a in cases]

    CASES[name] = run


def _told(r: O.Result) -> Column:
    return F.when(r.valid, F.to_json(F.struct(r.value.alias("v")))).otherwise(r.error["reason"])


def parses(name: str, s: Any, *cases: tuple[str | None, str]) -> None:
    """The value or the reason from JSON text."""
    _add(name, lambda x: _told(O.parser(s)(x)), list(cases))


def takes(name: str, s: Any, good: list[str | None], bad: list[str | None], source: str = "string") -> None:
    """Which JSON texts are valid?"""
    _add(name, lambda x: O.is_valid(s, x if source == "string" else F.try_parse_json(x), source), [(x, True) for x in good] + [(x, False) for x in bad])


def encodes(name: str, s: Any, typed: Callable[[Column], Column], *cases: tuple[str, str]) -> None:
    """The input side of a typed value made from text."""
    def made(x: Column) -> Column:
        r = O.encoder(s)(typed(x))
        return F.when(r.valid, r.value.cast("string")).otherwise(r.error["reason"])

    _add(name, made, list(cases))


def _format(name: str, kind: Any, good: list[str], bad: list[str]) -> None:
    _add(name, lambda x: O.decoder(kind)(x).valid, [(x, True) for x in good] + [(x, False) for x in bad])


# --- T: formats --------------------------------------------------------------------------------
_format("t1_iso_date_time", S.iso_date_time, ["2020-02-29T12:00:00Z", "2020-02-29t12:00:00.5z", "2016-12-31T23:59:60Z"], ["2021-02-29T12:00:00Z", "2020-02-29T12:00:00+01:00", "2016-12-31T22:59:60Z", "2020-01-01T24:00:00Z"])
_format("t2_iso_date", S.iso_date, ["2000-02-29", "2020-04-30", "1999-12-31"], ["1900-02-29", "2020-04-31", "2020-1-1", "2020-13-01"])
_format("t3_iso_time", S.iso_time, ["12:00:00Z", "01:29:60+01:30", "23:59:60z", "15:59:60.123-08:00"], ["12:00:00", "23:59:60+01:00", "12:60:00Z", "12:00:61Z", "12:00:00+24:00"])
_format("t4_duration", S.duration, ["P1Y2M3DT4H5M6S", "P2W", "PT1M", "P1M"], ["P", "PT", "P1.5Y", "P1Y2D", "PT1H2S", "P1YT", "P1W2D"])
_format("t5_email", S.email, ["a.b@c.de", "a@b-.com", "o'n@a.io"], ["a@b", ".a@b.co", "a..b@c.de", "a'@b.co", "a@b@c.de", "a@-b.com"])
_format("t6_idn_email", S.idn_email, ["ü@ö", "x" * 64 + "@y"], ["ü", "x" * 65 + "@y", "a b@c", "@c"])
_format("t7_uuid", S.uuid, ["123e4567-e89b-12d3-a456-426614174000", "123E4567-E89B-12D3-A456-426614174000"], ["123e4567", "123e4567-e89b-12d3-a456-42661417400g", "123e4567e89b12d3a456426614174000"])
_format("t8_cuid", S.cuid, ["cjld2cjxh0000qzrmn831i7rn", "C12345678"], ["x12345678", "c1234567", "c1234-5678"])
_format("t9_uri", S.uri, ["http://a.b/c?d#e", "urn:a:b", "http://[::1]:80/", "mailto:x@y"], ["/a", "http://a b", "http://[::1", "1a:b"])
_format("t10_uri_reference", S.uri_reference, ["/a", "a?b", "", "#f", "//h/p"], ["\\a", "a b", "a%zz"])
_format("t11_uri_template", S.uri_template, ["/a{?b,c*}", "{+x:3}/b", ""], ["/a{", "a\x85b", "{x:0}", "a b"])
_format("t12_iri", S.iri, ["http://ä.de/ö", "http://a.b"], ["ä", "http://ä b"])
_format("t13_iri_reference", S.iri_reference, ["/ö", "ä"], ["\\ö", "ö ä"])
_format("t14_hostname", S.hostname, ["a-b.c", "x" * 63], ["-a", "a_b", "a..b", "x" * 64, "a."])
_format("t15_idn_hostname", S.idn_hostname, ["ä.de", "a_b", "ö。ä"], ["-ä", "a b", "ä..b"])
_format("t16_ipv4", S.ipv4, ["1.2.3.4", "255.255.255.255"], ["01.2.3.4", "256.1.1.1", "1.2.3"])
_format("t17_ipv6", S.ipv6, ["::1", "1::8", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "::"], ["1::2::3", "12345::", "1:2:3:4:5:6:7:8:9", "::1.2.3"])
_format("t18_json_pointer", S.json_pointer, ["", "/a~0b", "/a/b"], ["a", "/~2"])
_format("t19_relative_json_pointer", S.relative_json_pointer, ["0#", "1/a"], ["-1", "01", "/a"])
takes("t20_port", S.port, ["0", "80", "65535"], ["65536", "-1", "1.5", '"80"'])

# --- C: conversions ----------------------------------------------------------------------------
parses("c1_string_to_number", S.string.convert(S.number), ('"123"', '{"v":123.0}'), ('" 12.5 "', '{"v":12.5}'), ('""', '{"v":0.0}'), ('"0x3635C9ADC5DEA00000"', '{"v":1.0E21}'),
       ('"0b' + "1" * 70 + '"', '{"v":1.1805916207174113E21}'), ('"0o17"', '{"v":15.0}'), ('"1e3"', '{"v":1000.0}'), ('"abc"', 'Expected number, received "abc"'), ('"1d"', 'Expected number, received "1d"'), ("1", "Expected string, received 1"))
takes("c2_number_to_int32", S.number.convert(S.int32), ["1", "-2147483648", "2147483647", "1.0"], ["1.5", "2147483648", '"1"'])
encodes("c3_scalar_to_string", S.string.convert(S.number), lambda x: x.cast("double"), ("1", "1"), ("1.5", "1.5"), ("1e21", "1e+21"), ("0.0000001", "1e-7"), ("123456789.5", "123456789.5"), ("1e20", "100000000000000000000"))
parses("c4_literal_to_string", S.literal(12).convert(S.string), ("12", '{"v":"12"}'), ("13", "Expected 12, received 13"))
parses("c5_string_to_boolean", S.string.convert(S.boolean), ('"true"', '{"v":true}'), ('"false"', '{"v":false}'), ('"t"', 'Expected boolean, received "t"'), ('"TRUE"', 'Expected boolean, received "TRUE"'))
parses("c6_string_to_bigint", S.string.convert(S.bigint), ('"0"', '{"v":0}'), ('"-5"', '{"v":-5}'), ('""', '{"v":0}'), ('"0x1F"', '{"v":31}'), ('"0b' + "1" * 70 + '"', '{"v":1180591620717411303423}'),
       ('"0x' + "F" * 30 + '"', '{"v":1329227995784915872903807060280344575}'), ('"' + "9" * 38 + '"', '{"v":' + "9" * 38 + "}"), ('"1.5"', 'Expected bigint, received "1.5"'))
parses("c7_number_to_bigint", S.number.convert(S.bigint), ("12", '{"v":12}'), ("-3", '{"v":-3}'), ("1.5", "Expected bigint, received 1.5"))
parses("c8_string_to_literal", S.string.convert(S.literal(5)), ('"5"', '{"v":5.0}'), ('"6"', 'Expected 5, received "6"'))
parses("c9_literal_to_literal", S.literal("a").convert(S.literal(True)), ('"a"', '{"v":true}'), ('"b"', 'Expected "a", received "b"'))
takes("c10_string_to_date", S.string.convert(S.date), ['"2021-02-03T04:05:06.789Z"', '"2021-02-03"'], ['"2021-02-29"', '"x"', "1"])
takes("c12_string_to_url", S.string.convert(S.url), ['"http://a.b/c"', '"https://x.org"'], ['"::"', "1"])
parses("c14_string_to_bytes", S.string.convert(S.uint8_array), ('"abc"', '{"v":"YWJj"}'), ('"é"', '{"v":"w6k="}'), ("1", "Expected string, received 1"))
encodes("c14_bytes_to_string", S.string.convert(S.uint8_array), lambda x: F.encode(x, "UTF-8"), ("abc", "abc"), ("é", "é"))
parses("c15_json_to_typed", S.json_value.convert(S.object_({"a": S.number})), ('{"a":1,"b":2}', '{"v":{"a":1.0}}'), ('{"a":"1"}', 'Expected number, received "1"'), ("3", "Expected { a: number; }, received 3"))
encodes("c18_typed_to_json_string", S.json_string.convert(S.object_({"a": S.string, "b": S.optional(S.number)})), lambda x: F.struct(x.alias("a"), F.when(x != "n", F.lit(1.5)).alias("b")),
        ("x", '{"a":"x","b":1.5}'), ('q"\\\n', '{"a":"q\\"\\\\\\n","b":1.5}'), ("n", '{"a":"n"}'))
parses("c19_json_string_to_literal", S.json_string.convert(S.literal(7)), ('"7"', '{"v":7.0}'), ('"8"', "Expected 7, received 8"))
parses("c21_trim", S.string.trim(), ('"\\t a \\n"', '{"v":"a"}'), ('"b"', '{"v":"b"}'), ('"\\u00a0c\\ufeff"', '{"v":"c"}'))
parses("s6_bytes_round_trip", S.string.convert(S.uint8_array).convert(S.string), ('"abc"', '{"v":"abc"}'), ('"é"', '{"v":"é"}'))
encodes("s4_json_string_with_space", S.json_string_with_space(3).convert(S.object_({"a": S.string, "b": S.array(S.number), "c": S.object_({})})), lambda x: F.struct(x.alias("a"), F.when(x == "n", F.array().cast("array<double>")).otherwise(F.array(F.lit(1.0), F.lit(2.5))).alias("b"), F.struct(F.lit(1).alias("z")).alias("c")),
        ('q"{,\\', '{\n   "a": "q\\"{,\\\\",\n   "b": [\n      1,\n      2.5\n   ],\n   "c": {}\n}'), ("n", '{\n   "a": "n",\n   "b": [],\n   "c": {}\n}'))
encodes("c17_nan_in_lists", S.json_string.convert(S.array(S.number)), lambda x: F.array(F.lit(1.0), x.cast("double")), ("2", "[1,2]"), ("NaN", "Expected JSON, received NaN"))
takes("s5_json", S.json_value, ["1", "null", '{"a":[1]}', '"x"'], ["{", "[1,]", "1 2", "NaN", ""])
takes("s2_json_string_source", S.json_string.convert(S.number), ['"1"', '" 2 "'], ['"x"', "1", '"1 2"'])

# --- F: refinements ----------------------------------------------------------------------------
takes("f1_refine", S.object_({"a": S.number, "b": S.number}).refine(lambda o: o["a"] < o["b"], "a before b", ["a"]), ['{"a":1,"b":2}'], ['{"a":2,"b":1}', '{"a":1}'])
takes("f2_refine_input", S.string.refine_input(lambda v: F.try_variant_get(v, "$", "string") != "no"), ['"yes"'], ['"no"', "1"])
takes("f3_gt", S.number.gt(5), ["5.1", "6"], ["5", "4"])
takes("f4_gte", S.number.gte(5), ["5", "6"], ["4.9"])
takes("f5_lt", S.number.lt(5), ["4.9"], ["5", "6"])
takes("f6_lte", S.number.lte(5), ["5", "4"], ["5.1"])
takes("f7_multiple_of", S.number.multiple_of(0.01), ["1.23", "0", "19.99"], ["1.234", '"1"'])
takes("f8_min_length", S.string.min_length(3), ['"abc"', '"😀a"'], ['"ab"', '"😀"', '""'])
takes("f9_max_length", S.string.max_length(3), ['"abc"', '""', '"😀a"'], ['"abcd"', '"😀😀"'])
takes("f10_length", S.array(S.number).length(2), ["[1,2]"], ["[1]", "[1,2,3]"])
takes("f11_non_empty", S.string.non_empty(), ['"a"', '" "'], ['""'])
_add("f12_min_size", lambda x: O.decoder(S.uint8_array.min_size(2))(F.encode(x, "UTF-8")).valid, [("ab", True), ("é", True), ("a", False)])
_add("f13_max_size", lambda x: O.decoder(S.uint8_array.max_size(2))(F.encode(x, "UTF-8")).valid, [("ab", True), ("é", True), ("abc", False)])
_add("f14_size", lambda x: O.decoder(S.uint8_array.size(2))(F.encode(x, "UTF-8")).valid, [("ab", True), ("a", False), ("abc", False)])
takes("f15_pattern", S.string.pattern("^a[0-9]+$"), ['"a1"', '"a22"'], ['"b1"', '"a"', '"a1\\n"'])
takes("f16_bound_algebra", S.number.gte(1).gte(3).lt(9).lte(7), ["3", "7"], ["2", "8", "9"])
takes("f18_no_validation", S.object_({"a": S.number.no_validation()}), ['{"a":1}', '{"a":"x"}', "{}"], ["1"])
parses("f20_error_text", S.string.min_length(2, "too short"), ('"ab"', '{"v":"ab"}'), ('"a"', "too short"), ("1", "Expected string (length >= 2), received 1"))

# --- P: objects and tuples ---------------------------------------------------------------------
parses("p1_literal", S.literal("on"), ('"on"', '{"v":"on"}'), ('"off"', 'Expected "on", received "off"'))
parses("p4_field_or", S.object_(lambda c: {"a": c.field_or("a", S.number, 5)}), ('{"a":1}', '{"v":{"a":1.0}}'), ("{}", '{"v":{"a":5.0}}'), ('{"a":"x"}', 'Expected number | undefined, received "x"'))
parses("p5_tag", S.object_(lambda c: (c.tag("type", 0), {"n": c.field("n", S.number)})[1]), ('{"type":0,"n":2}', '{"v":{"n":2.0}}'), ('{"type":1,"n":2}', "Expected 0, received 1"))
parses("p6_nested", S.object_(lambda c: {"q": c.nested("n").field("q", S.number)}), ('{"n":{"q":2}}', '{"v":{"q":2.0}}'), ('{"n":{"q":"2"}}', 'Expected number, received "2"'))
parses("p10_tuple", S.tuple_([S.string, S.number]), ('["a",1]', '{"v":{"_1":"a","_2":1.0}}'), ('["a","b"]', 'Expected number, received "b"'), ('["a"]', 'Expected [string, number], received ["a"]'))
parses("p11_merge", S.merge(S.object_({"a": S.string, "b": S.number}), S.object_({"b": S.boolean})), ('{"a":"x","b":true}', '{"v":{"a":"x","b":true}}'), ('{"a":"x","b":1}', "Expected boolean, received 1"))
parses("p12_strip", S.object_({"a": S.number}).strict().strip(), ('{"a":1,"z":2}', '{"v":{"a":1.0}}'))
parses("p13_strict", S.object_({"a": S.number}).strict(), ('{"a":1}', '{"v":{"a":1.0}}'), ('{"a":1,"z":2}', 'Unrecognized key "z"'))
takes("p14_deep_strip", S.object_({"a": S.object_({"b": S.number}).strict()}).deep_strip(), ['{"a":{"b":1,"z":2},"y":1}'], ['{"a":{"z":2}}'])
takes("p15_deep_strict", S.object_({"a": S.object_({"b": S.number})}).deep_strict(), ['{"a":{"b":1}}'], ['{"a":{"b":1,"z":2}}', '{"a":{"b":1},"y":1}'])
parses("p16_object", S.object_({"a": S.string, "b": S.optional(S.number)}), ('{"a":"x"}', '{"v":{"a":"x"}}'), ('{"a":"x","b":2}', '{"v":{"a":"x","b":2.0}}'), ("[]", "Expected { a: string; b: number | undefined; }, received []"))
parses("p18_object_to_dict", S.object_({"a": S.number, "b": S.number}).convert(S.record(S.string)), ('{"a":1,"b":2}', '{"v":{"a":"1","b":"2"}}'), ('{"a":1}', "Expected number, received undefined"))
parses("p17_dict_to_object", S.record(S.string).convert(S.object_({"a": S.string})), ('{"a":"x","b":"y"}', '{"v":{"a":"x"}}'))

# --- N: absence --------------------------------------------------------------------------------
takes("n1_optional", S.object_({"a": S.optional(S.number)}), ["{}", '{"a":1}'], ['{"a":"x"}'])
parses("n2_optional_default", S.object_({"a": S.optional(S.number, 3)}), ("{}", '{"v":{"a":3.0}}'), ('{"a":1}', '{"v":{"a":1.0}}'))
takes("n3_nullable", S.object_({"a": S.nullable(S.number)}), ['{"a":null}', '{"a":1}'], ["{}", '{"a":"x"}'])
parses("n4_nullable_default", S.object_({"a": S.nullable(S.string, "bar")}), ('{"a":null}', '{"v":{"a":"bar"}}'), ('{"a":"x"}', '{"v":{"a":"x"}}'))
takes("n5_nullish", S.object_({"a": S.nullish(S.number)}), ["{}", '{"a":null}', '{"a":1}'], ['{"a":"x"}'])
takes("n6_null_as_option", S.null_as_option(S.number), ["null", "1"], ['"x"'])
takes("n7_option", S.object_({"a": S.option(S.string)}), ["{}", '{"a":"x"}'], ['{"a":1}'])

# --- U: unions ---------------------------------------------------------------------------------
_TAGGED = S.union(S.object_({"kind": "a", "x": S.number}), S.object_({"kind": "b", "y": S.string}))
takes("u1_union", S.union(S.string, S.number), ['"a"', "1"], ["true", "null", "[]"])
takes("u2_enum", S.enum(["a", 1, True, None]), ['"a"', "1", "true", "null"], ['"b"', "2", "false"])
parses("u3_union_first_match", S.union(S.int32.lt(10).convert(S.string, decode=lambda c: F.lit("small")), S.number.convert(S.string, decode=lambda c: F.lit("number"))), ("5", '{"v":"small"}'), ("50", '{"v":"number"}'), ("0.5", '{"v":"number"}'))
parses("u8_discriminator", S.object_({"u": S.union(S.object_({"kind": "a", "x": S.number}), S.object_({"kind": "b", "x": S.number.gt(5)}))}),
       ('{"u":{"kind":"a","x":1}}', '{"v":{"u":{"kind":"a","x":1.0}}}'), ('{"u":{"kind":"b","x":"1"}}', 'Expected number (> 5), received "1"'), ('{"u":{"kind":"b","x":9}}', '{"v":{"u":{"kind":"b","x":9.0}}}'))
takes("u8_discriminated_arms", _TAGGED, ['{"kind":"a","x":1}', '{"kind":"b","y":"t"}'], ['{"kind":"a","y":"t"}', '{"kind":"b","y":1}', '{"kind":"c"}', "1"])
takes("u9_string_to_union", S.string.convert(S.union(S.number, S.boolean)), ['"12"', '"true"'], ['"x"', "1"])
parses("u10_union_to_string", S.union(S.number, S.boolean).convert(S.string), ("1.5", '{"v":"1.5"}'), ("true", '{"v":"true"}'), ('"x"', 'Expected number | boolean, received "x"'))
parses("u11_union_to_union", S.union(S.string, S.number).convert(S.union(S.number.convert(S.string), S.string)), ('"12"', '{"v":"12"}'), ("1.5", '{"v":"1.5"}'), ("true", "Expected string | number, received true"))
parses("u11_union_to_never", S.union(S.number, S.string).convert(S.union(S.number.convert(S.never), S.string)), ('"ok"', '{"v":"ok"}'), ("42", "Expected never, received 42"))
takes("u11_null_to_undefined", S.union(S.string, None).convert(S.union(S.string, S.undefined)), ['"a"', "null"], ["1", "true"])
encodes("u12_union_encode", S.union(S.string.convert(S.number.gt(5)), S.boolean.convert(S.number, decode=lambda c: c.cast("double"), encode=lambda c: c == 1)), lambda x: x.cast("double"), ("7.5", "7.5"), ("1", "true"), ("0", "false"))
takes("u13_fall_through", S.union(S.string.max_length(1), S.string.pattern("^x")), ['"a"', '"xyz"'], ['"ab"'])
takes("u14_never_arm", S.union(S.never, S.number), ["1"], ['"a"'])
takes("r4_never_slot_in_union", S.union(S.string.convert(S.number, decode="never"), S.number), ["1"], ['"1"'])

# --- L: lists and recursion --------------------------------------------------------------------
parses("l1_array", S.array(S.number), ("[1,2]", '{"v":[1.0,2.0]}'), ("[]", '{"v":[]}'), ('[1,"x"]', 'Expected number, received "x"'), ("{}", "Expected number[], received {}"))
takes("l2_tuple", S.tuple_([S.literal("point"), S.int32, S.int32]), ['["point",1,2]'], ['["point",1]', '["p",1,2]', '["point",1,2,3]'])
parses("l4_record", S.record(S.number), ('{"a":1}', '{"v":{"a":1.0}}'), ('{"a":"x"}', 'Expected number, received "x"'))
_NODE = S.recursive("Node", lambda n: S.object_({"v": S.string.convert(S.number), "next": S.optional(n)}))
takes("l6_recursive", _NODE, ['{"v":"1"}', '{"v":"1","next":{"v":"2"}}'], ['{"v":"x"}', '{"v":"1","next":{"v":"y"}}', "{}"])
_add("l7_recursive_values", lambda x: F.try_variant_get(O.parser(_NODE)(x).value, "$.next.v", "double").cast("string"), [('{"v":"1","next":{"v":"2","z":1}}', "2.0"), ('{"v":"1"}', None)])

# --- O, M: operations --------------------------------------------------------------------------
_add("o9_safe", lambda x: O.safe(O.parser(S.number)(x))["success"], [("1", True), ('"x"', False)])
_add("o14_standard_validate", lambda x: F.get(O.standard_validate(S.object_({"a": S.number}), x)["issues"], F.lit(0))["message"], [('{"a":1}', None), ('{"a":"x"}', 'Expected number, received "x"')])
_add("o13_reverse", lambda x: O.decoder(O.reverse(S.string.convert(S.number)))(x.cast("double")).value, [("1", "1"), ("2.5", "2.5")])
_add("o21_error_path", lambda x: O.path_text(O.parser(S.object_({"a": S.array(S.object_({"b": S.string}))}))(x).error["path"]), [('{"a":[{"b":"x"},{"b":1}]}', '["a"]["1"]["b"]'), ('{"a":1}', '["a"]'), ("1", "")])
takes("o8_is_variant", S.object_({"a": S.number}), ['{"a":1}'], ['{"a":"1"}', "{}"], source="json")
parses("m2_brand", S.string.brand("Id"), ('"a"', '{"v":"a"}'), ("1", "Expected Id, received 1"))
_add("r3_coder", lambda x: _told(O.parser(S.string.convert(S.number, decode=O.coder(lambda t: 1.0 / len(t), "double")))(x)), [('"ab"', '{"v":0.5}'), ('""', "float division by zero")])

# --- J: JSON Schema ----------------------------------------------------------------------------
takes("j7_from_json_schema", from_json_schema({"type": "object", "properties": {"id": {"type": "string"}, "role": {"enum": ["a", "b"]}}, "required": ["id"]}), ['{"id":"x"}', '{"id":"x","role":"a"}'], ['{"role":"a"}', '{"id":"x","role":"c"}'], source="json")
takes("j8_ref", from_json_schema({"$ref": "#/definitions/node", "definitions": {"node": {"type": "object", "properties": {"value": {"type": "number"}, "children": {"type": "array", "items": {"$ref": "#/definitions/node"}}}}}}),
      ['{"value":1,"children":[{"value":2}]}'], ['{"value":1,"children":[{"value":"x"}]}'], source="json")
takes("j10_untyped_keywords", from_json_schema({"minLength": 2}), ['"ab"', "1", "[]"], ['"a"'], source="json")
takes("j12_enum_equality", from_json_schema({"enum": [1, [2], {"a": 1}]}), ["1e0", "1", "[2.0]", '{"a":1.0}'], ["[2,2]", '"1"', '{"a":1,"b":2}'], source="json")
takes("j13_code_points", from_json_schema({"type": "string", "maxLength": 2}), ['"😀a"', '"ab"'], ['"abc"', '"😀😀😀"'], source="json")
takes("j14_empty_range", from_json_schema({"type": "number", "minimum": 5, "maximum": 1}), [], ["1", "3", "5"], source="json")
parses("j15_default", from_json_schema({"type": "object", "properties": {"a": {"type": "array", "items": {"type": "number"}, "default": []}, "n": {"type": "number", "default": 4}}}), ("{}", '{"v":{"a":[],"n":4.0}}'), ('{"a":[1],"n":2}', '{"v":{"a":[1.0],"n":2.0}}'))
takes("j16_nullable", from_json_schema({"type": "string", "nullable": True}), ['"a"', "null"], ["1"], source="json")
takes("j17_ref_siblings", from_json_schema({"$schema": "https://json-schema.org/draft/2020-12/schema", "$defs": {"s": {"type": "string"}}, "$ref": "#/$defs/s", "minLength": 2}), ['"ab"'], ['"a"', "12"], source="json")
