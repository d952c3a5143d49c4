"""Compiling schemas to pairs of Spark columns: a value and the first error.

Every compiled operation is row-local: no shuffle, no user function unless a coder is one. What an
operation can never do raises SchemaError while the columns are built.

What is used more than once is bound first: a node's value and error are one struct, computed once, so
expressions grow with the schema's nodes and not with their nesting. A union is one switch on the type of
the value; the arms that take the type are tried in order. Recursive schemas are unfolded to a list of nodes
per value, without a limit of depth (see `recursion`).

A JSON source and an unknown source are both VARIANT; SQL NULL is `undefined`. They differ in that
JSON text brings bigints, dates, URLs and bytes as strings, and its null is absence for `optional`. A
third kind, `typed`, is a VARIANT of typed values, as unions of several types have: decimals are bigints there.
"""

from __future__ import annotations

import contextlib
import functools
import json
import math
import operator
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import formats, patterns, urls
from ..functions import (alone, bound, indented, is_multiple, iso_text, json_in, number_of, number_text, quoted, strict_json, text_of_bytes,
                         to_bigint, to_number, trimmed, utf16_length, wrapped_json)
from ..functions import wide
from ..schema import ABSENT, AUTO, DEFAULTS, NEVER, Place, Schema, SchemaError, expression, literal_text

ERROR = "struct<code:string,path:array<string>,reason:string>"
#: While it is found: the reason in parts, of which each may end in a received value. They are put into words once, at the end.
PART = "struct<text:string,got:variant,shown:boolean>"
FOUND = f"struct<code:string,path:array<string>,parts:array<{PART}>>"
BIG = "decimal(38,0)"
#: First letters of the type names of numbers in a VARIANT.
_NUMBERS = ("BIG", "DEC", "DOU", "FLO", "INT", "SMA", "TIN")
TYPES = {"string": "string", "trimmed": "string", "number": "double", "int32": "int", "integer": "double", "port": "int",
         "bigint": BIG, "wide": "string", "boolean": "boolean", "date": "timestamp", "url": "string", "bytes": "binary", "blob": "binary",
         "file": "struct<name:string,content:binary>", "json": "variant", "jsonString": "string", "unknown": "variant",
         "nan": "double", "undefined": "string", "never": "string", "ref": "variant"}
WRAPS = ("optional", "nullable", "nullish")


@dataclass(frozen=True)
class Options:
    allow_nan: bool = field(default_factory=lambda: DEFAULTS["allow_nan"])
    trusted_json: bool = False  # leave out the strictness guard of JSON text


@dataclass
class Out:
    value: Column
    error: Column | None  # null: valid
    entered: Column | None = None  # did the value have the container type or discriminator?
    pair: Column | None = None  # all three as one struct, if they are its fields
    weight: int = 1  # expressions in it, about

    def held(self) -> Column:
        """One column of it all."""
        if self.pair is not None:
            return self.pair
        parts = {"v": self.value, "e": self.error, "n": self.entered}
        return F.struct(*(c.alias(k) for k, c in parts.items() if c is not None))

    def inside(self, pair: Column, weight: int = 1) -> Out:
        """The same, read from a column made by held()."""
        return Out(pair["v"], None if self.error is None else pair["e"], None if self.entered is None else pair["n"], pair, weight)


#: Expressions that a body may repeat before what it reads is bound.
LIGHT = 16


def together(outs: list[Out], body: Callable[[list[Out]], Out], uses: int = 2) -> Out:
    """body(outs), where the outs are computed once if they are more than light."""
    weight = sum(o.weight for o in outs)
    if weight * uses <= LIGHT:
        made = body(outs)
        made.weight = max(made.weight, weight * uses)
        return made
    shape: list[Out] = []

    def run(all_: Column) -> Column:
        made = body([o.inside(all_[f"o{i}"]) for i, o in enumerate(outs)])
        shape.append(made)
        return made.held()

    pair = bound(F.struct(*(o.held().alias(f"o{i}") for i, o in enumerate(outs))), run)
    return shape[-1].inside(pair, weight + LIGHT)


def none(kind: str = FOUND) -> Column:
    return F.lit(None).cast(kind)


def at_path(path: tuple) -> Column:
    parts = [F.lit(p) if isinstance(p, str) else p for p in path]
    return F.array(*parts) if parts else F.array().cast("array<string>")


def label(s: Schema, name: str) -> str:
    """What paths call a field: items of tuples have their numbers."""
    return str(int(name[1:]) - 1) if s.kind == "tuple" else name


def part(text: Column | str, got: Column | None = None) -> Column:
    return F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), (none("variant") if got is None else got).alias("got"), F.lit(got is not None).alias("shown"))


def failure(path: tuple, reason: Column | str, code: str = "invalid_input", got: Column | None = None, tail: Column | None = None) -> Column:
    parts = F.array(part(reason, got))
    return F.struct(F.lit(code).alias("code"), at_path(path).alias("path"), (parts if tail is None else F.concat(parts, tail)).alias("parts"))


def rendered(error: Column, once: bool = False) -> Column:
    """The error as it is returned; once: it is dear, and not to be computed again for failing rows."""
    said = lambda e: F.array_join(F.transform(e["parts"], lambda p: F.concat(p["text"], F.when(p["shown"], received_variant(p["got"])).otherwise(F.lit("")))), "")
    made = lambda e: F.struct(e["code"].alias("code"), e["path"].alias("path"), said(e).alias("reason"))
    return bound(error, lambda e: F.when(e.isNotNull(), made(e))) if once else F.when(error.isNotNull(), bound(error, made))


def first(*errors: Column | None) -> Column | None:
    some = [e for e in errors if e is not None]
    return None if not some else some[0] if len(some) == 1 else F.coalesce(*some)


def unless(ok: Column, error: Column) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), error)


def literal_type(value: Any) -> str:
    return "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) or value is None else "double"


def type_of(s: Schema) -> str:
    """Spark type of a schema's output."""
    return node_type(s.output)


def _struct(fields: list[tuple[str, str]]) -> str:
    return "struct<" + ",".join(f"`{k.replace('`', '``')}`:{v}" for k, v in fields) + ">"


def entry_type(s: Schema) -> str:
    """The type of a union's values before its arms' links."""
    found = {node_type(a) for a in s.arms if a.kind not in ("undefined", "never") and a.const is not None}
    return found.pop() if len(found) == 1 else "variant" if found else "string"


def node_type(s: Schema) -> str:
    if s.kind == "literal":
        return literal_type(s.const)
    if s.kind in WRAPS:
        return type_of(s.items[0])
    if s.kind == "array":
        return f"array<{type_of(s.items[0])}>"
    if s.kind == "record":
        return f"map<string,{type_of(s.items[0])}>"
    if s.kind == "compactColumns":
        return f"array<{node_type(s.items[0])}>"
    if s.kind in ("object", "tuple"):
        return shape_type(s, s.shape) if s.shape is not None and not s.flipped else _struct([(k, type_of(v)) for k, v in fields_of(s)])
    if s.kind == "union":
        found = list(dict.fromkeys(type_of(a) for a in s.arms if a.output.kind not in ("undefined", "never") and a.output.const is not None))
        return found[0] if len(found) == 1 else "string" if not found else "variant"
    return TYPES[s.kind]


def fields_of(s: Schema) -> list[tuple[str, Schema]]:
    return [(f"_{i + 1}", x) for i, x in enumerate(s.items)] if s.kind == "tuple" else list(s.props)


def at_place(s: Schema, place: Place) -> Schema:
    node = s
    for part in place.path:
        node = node.output if node is not s else node
        node = node.items[int(part)] if node.kind == "tuple" else dict(node.props)[part]
    return node


def shape_type(s: Schema, shape: Any) -> str:
    if isinstance(shape, Place):
        return type_of(at_place(s, shape)) if shape.path else node_type(replace(s, shape=None))
    if isinstance(shape, dict):
        return _struct([(k, shape_type(s, v)) for k, v in shape.items()])
    return literal_type(shape)


# --- what was received, as text ----------------------------------------------------------------
def is_number(tag: Column) -> Column:
    return F.substring(tag, 1, 3).isin(*_NUMBERS)


def received_variant(v: Column) -> Column:
    tag = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit("undefined")).when(tag == "STRING", quoted(F.try_variant_get(v, "$", "string")))
            .when(is_number(tag), number_text(F.try_variant_get(v, "$", "double"))).otherwise(F.to_json(v)))


def expected(s: Schema, got: Column | str, path: tuple, key: str = "type") -> Column:
    own = dict(s.messages)
    if text := own.get(key) or own.get("_"):
        return failure(path, text)
    said = f"Expected {s.said or expression(s)}, received "
    return failure(path, said + got) if isinstance(got, str) else failure(path, said, got=got)


# --- refinements -------------------------------------------------------------------------------
def checked(s: Schema, x: Column, kind: str, path: tuple, before: bool = False) -> Column | None:
    errors: list[Column] = []
    show = _variant(x, kind)
    for key, bound in () if before else s.bounds:
        large = isinstance(bound, int) and abs(bound) >= 2**63
        other = F.lit(str(bound)).try_cast(BIG) if large else F.lit(bound)
        if s.kind == "wide" and key in ("gt", "gte", "lt", "lte"):
            order = wide.compared(x, bound)
            test = {"gt": order > 0, "gte": order >= 0, "lt": order < 0, "lte": order <= 0}[key]
        elif s.kind == "wide" and key == "multipleOf":
            test = wide.is_multiple(x, bound)
        elif key in ("gt", "gte", "lt", "lte"):
            test = {"gt": x > other, "gte": x >= other, "lt": x < other, "lte": x <= other}[key]
            if kind == "double":
                test = test & ~F.isnan(x)
        elif key == "multipleOf":
            test = is_multiple(x, bound)
        elif key in ("minLength", "maxLength"):
            n = (F.char_length(x) if s.code_points else utf16_length(x)) if kind == "string" else F.size(x)
            test = n >= bound if key == "minLength" else n <= bound
        elif key in ("minSize", "maxSize"):
            n = F.octet_length(x if kind == "binary" else x["content"])
            test = n >= bound if key == "minSize" else n <= bound
        else:
            test = x.rlike(patterns.compiled(*patterns.parted(bound)))
        error = failure(path, dict(s.messages).get("pattern", "Invalid pattern")) if key == "pattern" and "_" not in dict(s.messages) else expected(s, show, path, key)
        errors.append(unless(test, error))
    if s.format and not before:
        errors.append(unless(formats.matches(x, s.format), expected(s, show, path, "format")))
    for c in s.input_checks if before else s.checks:
        errors.append(unless(c.test(x), failure((*path, *c.path), dict(s.messages).get("_", c.reason))))
    return first(*errors)


# --- reading a VARIANT -------------------------------------------------------------------------
def step(name: str) -> str:
    return '$["' + name.replace("\\", "\\\\").replace('"', '\\"') + '"]'


class Compiler:
    def __init__(self, options: Options | None = None, defs: dict | None = None, values: bool = True) -> None:
        self.o, self.defs, self.valued = options or Options(), defs or {}, values
        self.walk: Walk | None = None  # set inside the body of a recursive schema

    def parse(self, s: Schema, v: Column, kind: str, path: tuple = (), tag: Column | None = None) -> Out:
        """A VARIANT column (kind json, unknown or typed) through the whole chain of s; tag is its type, if known."""
        out = self.read(s, v, kind, path, tag)
        if s.input_checks:
            out = together([out], lambda o: replace(o[0], error=first(checked(s, v, "variant", path, before=True), o[0].error), pair=None))
        return self.follow(s, out, path)

    def typed(self, s: Schema, x: Column, path: tuple = ()) -> Out:
        """A typed column through the chain of s: no type checks, refinements and conversions only."""
        out = self.inside(s, x, path)
        if s.input_checks:
            before = checked(s, x, node_type(replace(s, flipped=False)), path, before=True)
            out = together([out], lambda o: replace(o[0], error=first(before, o[0].error), pair=None))
        return self.follow(s, out, path)

    def follow(self, s: Schema, out: Out, path: tuple) -> Out:
        node, out = s, self.validated(s, out, path)
        while node.to is not None:
            out = together([out], lambda o: self.linked(node, o[0], path))  # noqa: B023
            node = node.to
            out = self.validated(node, out, path)
        return out

    def linked(self, node: Schema, out: Out, path: tuple) -> Out:
        got = self.link(node, node.to, out.value, path)
        if out.error is None:
            return replace(got, entered=out.entered, pair=None)
        return together([got], lambda g: Out(g[0].value, first(out.error, g[0].error), out.entered))

    def validated(self, s: Schema, out: Out, path: tuple) -> Out:
        if not s.validates or s.kind in WRAPS and not s.checks or not (s.bounds or s.format or s.checks):
            return out
        made = together([out], lambda o: replace(o[0], error=first(o[0].error, checked(s, o[0].value, node_type(s), path)), pair=None))
        made.weight += len(s.bounds) + len(s.checks)
        return made

    def _tag(self, s: Schema, v: Column, kind: str, path: tuple, ok: Column, value: Column) -> Out:
        error = None if not s.validates else unless(ok, expected(s, v, path))
        return Out(value, error, F.coalesce(ok, F.lit(False)))

    def read(self, s: Schema, v: Column, kind: str, path: tuple, tag: Column | None = None) -> Out:
        get = lambda t: F.try_variant_get(v, "$", t)
        tag = F.schema_of_variant(v) if tag is None else tag
        text = tag == "STRING"
        k = s.kind
        if k in ("string", "trimmed", "jsonString"):
            x = get("string")
            if k == "jsonString":
                return self._tag(s, v, kind, path, text & strict_json(x), x)
            return self._tag(s, v, kind, path, text, trimmed(x) if k == "trimmed" else x)
        if k in ("number", "int32", "integer", "port"):
            x, ok = get("double"), is_number(tag)
            if kind == "typed":
                ok = ok & ~tag.startswith("DEC")
            return self._tag(s, v, kind, path, ok & self.fits(k, x), self.narrow(k, x))
        if k == "boolean":
            return self._tag(s, v, kind, path, tag == "BOOLEAN", get("boolean"))
        if k == "bigint":
            if kind == "json":
                x = F.when(text, to_bigint(get("string")))
                return self._tag(s, v, kind, path, text & x.isNotNull(), x)
            return self._tag(s, v, kind, path, tag.rlike(r"^DECIMAL\(\d+,0\)" if kind == "typed" else r"^(?:BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))"), get(BIG))
        if k == "wide":
            if kind == "json":
                return together([Out(F.when(text, wide.canonical(get("string"))), None, weight=LIGHT)], lambda o: self._tag(s, v, kind, path, text & o[0].value.isNotNull(), o[0].value))
            whole = tag.rlike(r"^(?:BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))")
            return self._tag(s, v, kind, path, whole, get("decimal(38,0)").cast("string"))
        if k in ("date", "url", "bytes"):
            if kind == "json":
                got = self.convert(Schema("string"), s, get("string"), path)
                bad = unless(text, expected(s, v, path))
                return Out(got.value, first(bad, got.error), text)
            have = {"date": ("^TIMESTAMP|^DATE", "timestamp"), "url": ("^STRING" if kind == "typed" else "^(?!)", "string"), "bytes": ("^BINARY", "binary")}[k]
            return self._tag(s, v, kind, path, tag.rlike(have[0]), get(have[1]))
        if k in ("blob", "file"):
            return self._tag(s, v, kind, path, tag.rlike("^BINARY") if k == "blob" else F.lit(False), get("binary") if k == "blob" else none(TYPES["file"]))
        if k == "literal":
            return self.constant(s, v, kind, path, tag, get)
        if k == "undefined":
            return self._tag(s, v, kind, path, v.isNull() | (F.is_variant_null(v) if kind == "json" else F.lit(False)), none("string"))
        if k == "nan":
            ok = F.is_variant_null(v) if kind == "json" else F.isnan(get("double")) & is_number(tag) if kind == "typed" else F.lit(False)
            return self._tag(s, v, kind, path, ok, F.lit(float("nan")))
        if k == "json":
            return self._tag(s, v, kind, path, v.isNotNull(), v)
        if k == "unknown":
            return Out(v, None, F.lit(True))
        if k == "never":
            return Out(none("string"), expected(s, v, path), F.lit(False))
        if k == "ref":
            return self.recursive(s, v, kind, path)
        if k in WRAPS:
            return self.wrapped(s, v, kind, path)
        if k == "array":
            return self.each(s, v, kind, path)
        if k == "record":
            return self.values(s, v, kind, path)
        if k in ("object", "tuple"):
            return self.fields(s, v, kind, path)
        if k == "union":
            return self.switch(s, v, kind, path)
        if k == "compactColumns":
            return self.columns(s, v, kind, path)
        raise SchemaError(f"{expression(s)} can't be read", "unsupported_decode")

    def fits(self, k: str, x: Column) -> Column:
        if k == "number":
            return x.isNotNull() if self.o.allow_nan else ~F.isnan(x) & x.isNotNull()
        whole = (x % 1 == 0) & ~F.isnan(x)
        low, high = {"int32": (-2147483648, 2147483647), "port": (0, 65535)}.get(k, (-math.inf, math.inf))
        return whole & (F.abs(x) < math.inf) if k == "integer" else whole & (x >= low) & (x <= high)

    @staticmethod
    def narrow(k: str, x: Column) -> Column:
        return x.try_cast("int") if k in ("int32", "port") else x

    def constant(self, s: Schema, v: Column, kind: str, path: tuple, tag: Column, get: Callable) -> Out:
        c = s.const
        if c is None:
            ok = v.isNull() | F.is_variant_null(v) if kind == "typed" else v.isNotNull() & F.is_variant_null(v)
        elif isinstance(c, bool):
            ok = (get("boolean") == F.lit(c)) & (tag == "BOOLEAN")
        elif isinstance(c, str):  # values before types: few values pass, and a type is dear
            ok = (get("string") == F.lit(c)) & (tag == "STRING")
        else:
            ok = (get("double") == F.lit(float(c))) & is_number(tag)
        return self._tag(s, v, kind, path, ok, self.lit(s))

    @staticmethod
    def lit(s: Schema) -> Column:
        c = s.const
        return none("string") if c is None else F.lit(float(c)) if isinstance(c, (int, float)) and not isinstance(c, bool) else F.lit(c)

    def recursive(self, s: Schema, v: Column, kind: str, path: tuple) -> Out:
        if self.walk is not None and s.slot is not None:
            return self.walk.child(self, s, v, kind, path)
        return Walk({**self.defs, **s.defs}, self.o, self.valued).run(s, v, kind, path)

    def wrapped(self, s: Schema, v: Column, kind: str, path: tuple) -> Out:
        # At this place itself errors name the whole.
        inner = self.parse(replace(s.items[0], said=s.said or expression(s)), v, kind, path)
        absent, empty = v.isNull(), v.isNotNull() & F.is_variant_null(v)
        empty = absent | empty if kind == "typed" else empty
        missing = {"optional": absent | empty if kind == "json" else absent, "nullable": empty, "nullish": absent | empty}[s.kind]
        missing = F.coalesce(missing, F.lit(False))

        def body(o: list[Out]) -> Out:
            error = None if o[0].error is None else F.when(~missing, o[0].error)
            value = none(type_of(s)) if self.mute(s) else F.when(missing, self.default(s)).otherwise(o[0].value)
            return Out(value, error, missing | (o[0].entered if o[0].entered is not None else F.lit(True)))

        return replace(body([inner]), weight=LIGHT) if self.mute(s) else together([inner], body, 1)

    def mute(self, s: Schema) -> bool:
        """Are only the errors of s asked for? Its parts are used once then, and need not be bound."""
        return self.walk is not None and not self.walk.values and refers(s)

    def default(self, s: Schema) -> Column:
        kind = type_of(s.items[0])
        if s.default is ABSENT:
            return none(kind)
        if callable(s.default):
            return s.default()
        if isinstance(s.default, (dict, list, tuple)) or kind == "variant":
            # Read by its own type from JSON text, which stands for the value once per plan.
            text = json.dumps(_json_form(s.default))
            return as_type(self.parse(_plain(s.items[0].output), F.parse_json(F.lit(text)), "json").value, node_type(_plain(s.items[0].output)), kind)
        return F.lit(s.default).cast(kind)

    def each(self, s: Schema, v: Column, kind: str, path: tuple) -> Out:
        items = F.try_variant_get(v, "$", "array<variant>")
        item = s.items[0]
        bad = unless(items.isNotNull(), expected(s, v, path)) if s.validates else None
        if item.kind == "unknown" and not item.to and not item.checks:
            return Out(items, bad, items.isNotNull())

        def run(x: Column, i: Column) -> Out:
            with self.at(i):
                return self.parse(item, x, kind, (*path, i.cast("string")))

        return together([_items(items, run)], lambda o: Out(o[0].value, first(bad, o[0].error), o[0].value.isNotNull()))

    def values(self, s: Schema, v: Column, kind: str, path: tuple) -> Out:
        found = F.try_variant_get(v, "$", "map<string,variant>")
        item = s.items[0]
        bad = unless(found.isNotNull(), expected(s, v, path))
        keys = F.map_keys(found)

        def run(x: Column, i: Column) -> Out:
            with self.at(i):
                return self.parse(item, x, kind, (*path, F.get(keys, i)))

        return together([_items(F.map_values(found), run)], lambda o: Out(F.map_from_arrays(keys, o[0].value), first(bad, o[0].error), o[0].value.isNotNull()))

    @contextlib.contextmanager
    def at(self, i: Column):  # noqa: ANN201
        """While an item is compiled, children of recursive schemas are found by its number."""
        if self.walk is None:
            yield
            return
        self.walk.numbers.append(i)
        try:
            yield
        finally:
            self.walk.numbers.pop()

    def fields(self, s: Schema, v: Column, kind: str, path: tuple, known: str | None = None) -> Out:
        """Objects and tuples; known is a field of constants that the caller has found to be right."""
        place = lambda n: step(n) if s.kind == "object" else f"$[{int(n[1:]) - 1}]"
        at = {n: F.try_variant_get(v, place(n), "variant") for n, _ in fields_of(s)}
        if self.walk is not None:
            at |= {n: x for n, k in fields_of(s) if (x := self.walk.given(k)) is not None}
        if s.kind == "object":
            found = F.try_variant_get(v, "$", "map<string,variant>")
            # A field that is there tells the type too, and is cheaper than all of them.
            some = [c.isNotNull() for c in list(at.values())[:2]]
            ok = F.lit(True) if known else functools.reduce(operator.or_, [*some, found.isNotNull()])
        else:
            found = F.try_variant_get(v, "$", "array<variant>")
            n = len(s.items)
            ok = F.coalesce(F.size(found) == n if s.extras == "strict" else F.size(found) >= n, F.lit(False)) & found.isNotNull()
        kinds = dict(fields_of(s))
        outs = [Out(self.lit(x), None) if n == known else self.parse(x, at[n], kind, (*path, label(s, n))) for n, x in kinds.items()]
        entered = ok
        if not known and (tag := discriminator(s)):
            name, const = tag
            entered = ok & F.coalesce(self.constant(const, at[name], kind, path, F.schema_of_variant(at[name]), lambda t: F.try_variant_get(at[name], "$", t)).entered, F.lit(False))

        def body(children: list[Out]) -> Out:
            errors = [unless(ok, expected(s, v, path)) if s.validates and not known else None, *(c.error for c in children)]
            if s.kind == "object" and s.extras == "strict":
                extra = F.get(F.filter(F.map_keys(found), lambda k: ~k.isin(*kinds)) if kinds else F.map_keys(found), F.lit(0))
                errors.append(F.when(extra.isNotNull(), failure(path, F.concat(F.lit("Unrecognized key "), quoted(extra)), "unrecognized_keys")))
            value = none(type_of(s)) if self.mute(s) else self.assembled(s, {n: c.value for n, c in zip(kinds, children, strict=True)}, ok)
            return Out(value, first(*errors), entered)

        return replace(body(outs), weight=LIGHT) if self.mute(s) else together(outs, body, 1)

    def assembled(self, s: Schema, children: dict[str, Column], ok: Column | None) -> Column:
        """The output struct of an object or tuple, in its shape."""
        def build(shape: Any) -> Column:
            if isinstance(shape, Place):
                if not shape.path:
                    return F.struct(*(c.alias(k) for k, c in children.items()))
                head, *rest = shape.path
                col = children[f"_{int(head) + 1}" if s.kind == "tuple" else head]
                for part in rest:
                    col = col.getField(part)
                return col
            if isinstance(shape, dict):
                return F.struct(*(build(x).alias(k) for k, x in shape.items()))
            return self.lit(Schema("literal", const=shape))

        made = build(s.shape if s.shape is not None and not s.flipped else Place(()))
        return made if ok is None else F.when(ok, made)

    def columns(self, s: Schema, v: Column, kind: str, path: tuple) -> Out:
        row = s.items[0]
        found = F.try_variant_get(v, "$", "array<array<variant>>")
        n = len(row.props)
        ok = F.coalesce(F.size(found) == n, F.lit(False)) & found.isNotNull()
        most = F.coalesce(F.array_max(F.transform(found, lambda c: F.size(c))), F.lit(0))
        at = F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>"))

        def run(i: Column, _: Column) -> Out:
            where = (*path, i.cast("string"))
            cells = [self.parse(x, F.get(F.get(found, F.lit(j)), i), kind, (*where, k)) for j, (k, x) in enumerate(row.props)]
            return together(cells, lambda c: Out(self.assembled(row, {k: o.value for (k, _), o in zip(row.props, c, strict=True)}, None), first(*(o.error for o in c))), 1)

        return together([_items(at, run)], lambda o: Out(F.when(ok, o[0].value), first(unless(ok, expected(s, v, path)), None if o[0].error is None else F.when(ok, o[0].error)), ok))

    # --- unions --------------------------------------------------------------------------------
    def switch(self, s: Schema, v: Column, kind: str, path: tuple) -> Out:
        """A VARIANT through a union: one test of its type, then the arms that take the type, in order."""
        arms = live(s.arms, kind, self.o)
        if not arms:
            raise SchemaError("every arm of the union is never")
        if (tagged := exclusive(arms)) is not None:
            return self.by_constant(s, arms, tagged, v, kind, path)
        masks = [mask(a, kind) for a in arms]
        sets: dict[tuple[int, ...], list[str]] = {}
        for name in NAMES:
            taking = tuple(i for i, m in enumerate(masks) if name in m)
            sets.setdefault(taking, []).append(name)
        named = {i for taking in sets for i in taking}
        refused: list[SchemaError] = []

        def body(v: Column, tag: Column) -> Out:
            failing = Out(none(node_type(s)), self.unfit(s, v, path, []), F.lit(True))
            pair = failing.held()
            for taking, names in sets.items():
                if not taking:
                    continue
                picked = [arms[i] for i in taking]
                try:
                    made = self.attempts(s, picked, lambda a: self.parse(a, v, kind, path, tag), v, path)
                except SchemaError as e:
                    if e.code != "never_decoded":
                        raise
                    refused.append(e)
                    continue
                pair = F.when(is_one_of(names, v, tag), self.uniform(made, node_type(s))).otherwise(pair)
            return failing.inside(pair, LIGHT)

        if all(a.kind == "literal" and plain(a) for a in arms):
            return self.constants(s, arms, v, kind, path)
        if len([t for t in sets if t]) == 1 and len(named) == len(arms) == 1:
            return self.attempts(s, arms, lambda a: self.parse(a, v, kind, path), v, path)
        shape: list[Out] = []

        def run(b: Column) -> Column:
            shape.append(body(b["v"], b["t"]))
            return shape[-1].held()

        pair = bound(F.struct(v.alias("v"), F.schema_of_variant(v).alias("t")), run)
        if refused and len(refused) == len([t for t in sets if t]):
            raise refused[0]
        return shape[-1].inside(pair, LIGHT)

    @staticmethod
    def uniform(out: Out, kind: str) -> Column:
        """The pair of one arm in the form that all arms share."""
        return F.struct(out.value.cast(kind).alias("v") if out.value is not None else none(kind).alias("v"),
                        (none() if out.error is None else out.error).alias("e"), F.lit(True).alias("n")) if out.pair is None else bound(
            out.pair, lambda p: F.struct(p["v"].alias("v"), (none() if out.error is None else p["e"]).alias("e"), F.lit(True).alias("n")))

    def constants(self, s: Schema, arms: list[Schema], v: Column, kind: str, path: tuple) -> Out:
        """A union of constants: one test by type."""
        tag, whole = F.schema_of_variant(v), node_type(s)
        texts, flags, sizes = ([a.const for a in arms if isinstance(a.const, t) and (t is bool or not isinstance(a.const, bool))] for t in (str, bool, (int, float)))
        ok = F.lit(False)
        if texts:
            ok = ok | F.try_variant_get(v, "$", "string").isin(*texts) & (tag == "STRING")
        if flags:
            ok = ok | F.try_variant_get(v, "$", "boolean").isin(*flags) & (tag == "BOOLEAN")
        if sizes:
            ok = ok | F.try_variant_get(v, "$", "double").isin(*map(float, sizes)) & is_number(tag)
        ok = F.coalesce(ok, F.lit(False))
        if any(a.const is None for a in arms):
            ok = ok | F.coalesce(F.is_variant_null(v), F.lit(False)) | (v.isNull() if kind == "typed" else F.lit(False))
        value = F.when(~F.is_variant_null(v), v) if whole == "variant" else F.try_variant_get(v, "$", whole)
        return Out(F.when(ok, value), None if not s.validates else unless(ok, self.unfit(s, v, path, [])), F.lit(True), weight=4)

    def by_constant(self, s: Schema, arms: list[Schema], name: str, v: Column, kind: str, path: tuple) -> Out:
        """Objects that one field of constants tells apart: no other arm is looked at."""
        whole = node_type(s)
        failing = Out(none(whole), expected(s, v, path, "_"), F.lit(True))

        child = F.try_variant_get(v, step(name), "variant")

        def run(v: Column, child: Column, tag: Column) -> Column:
            pair = failing.held()
            for a in reversed(arms):
                const = dict(a.props)[name]
                ok = F.coalesce(self.constant(const, child, kind, path, tag, lambda t: F.try_variant_get(child, "$", t)).entered, F.lit(False))
                made = self.follow(a, self.before(a, self.fields(a, v, kind, path, known=name), v, path), path)
                made = together([made], lambda o, a=a: Out(as_type(o[0].value, type_of(a), whole), o[0].error), 1)
                pair = F.when(ok, self.uniform(made, whole)).otherwise(pair)
            return pair

        # Where it is cheap to read, the constant is not bound: columns outside lambdas are compiled, not interpreted.
        if len(arms) <= 8:
            return failing.inside(run(v, child, F.schema_of_variant(child)), LIGHT)
        pair = bound(F.struct(v.alias("v"), child.alias("c"), F.schema_of_variant(child).alias("t")), lambda b: run(b["v"], b["c"], b["t"]))
        return failing.inside(pair, LIGHT)

    def before(self, s: Schema, out: Out, v: Column, path: tuple) -> Out:
        if not s.input_checks:
            return out
        return together([out], lambda o: replace(o[0], error=first(checked(s, v, "variant", path, before=True), o[0].error), pair=None))

    def unfit(self, s: Schema, show: Column, path: tuple, tried: list[tuple[Out, Schema]]) -> Column:
        """The error of a value that no arm takes: the lines of those that had its type follow."""
        if own := dict(s.messages).get("_"):
            return failure(path, own)
        error = failure(path, f"Expected {s.said or expression(s)}, received ", got=show)
        told = []
        for o, _ in tried:
            if o.entered is None:
                continue
            where = F.when(F.size(o.error["path"]) > len(path), F.concat(F.lit("At ["), F.array_join(F.transform(F.slice(o.error["path"], len(path) + 1, 1000), lambda p: F.to_json(p.cast("variant"))), "]["), F.lit("]: ")))
            start = F.concat(F.lit("\n- "), F.coalesce(where, F.lit("")))
            # At one place one value is received, so the texts tell if two lines are the same.
            key = F.concat(start, F.array_join(o.error["parts"]["text"], ""))
            told.append(F.when(F.coalesce(o.entered, F.lit(False)), F.struct(key.alias("key"), F.concat(F.array(part(start)), o.error["parts"]).alias("parts"))))
        if told:
            lines = bound(F.filter(F.array(*told), lambda t: t.isNotNull()), lambda t: F.flatten(F.filter(t, lambda x, i: F.array_position(t["key"], x["key"]) == i + 1)["parts"]))
            error = failure(path, f"Expected {s.said or expression(s)}, received ", got=show, tail=lines)
        for o, a in reversed(tried):
            if discriminator(a) and o.entered is not None:  # the arm that the discriminator names tells its own error
                error = F.when(o.entered, o.error).otherwise(error)
        return error

    def attempts(self, s: Schema, arms: list[Schema], run: Callable[[Schema], Out], show: Column, path: tuple) -> Out:
        """Arms in order, each only if those before it failed; the first success wins."""
        kind, never = node_type(s), None
        outs: list[tuple[Out, Schema]] = []
        for a in arms:
            try:
                outs.append((run(a), a))
            except SchemaError as e:  # an arm that is never decoded takes no value
                if e.code != "never_decoded":
                    raise
                never = e
        if not outs:
            raise never or SchemaError("every arm of the union is never")
        own = lambda o, a: none(kind) if a.output.kind == "undefined" else as_type(o.value, type_of(a), kind)
        if all(o.error is None for o, _ in outs[:1]):
            return together([outs[0][0]], lambda o: Out(own(o[0], outs[0][1]), None, F.lit(True)), 1)
        sure = next((i for i, (o, _) in enumerate(outs) if o.error is None), None)
        outs = outs if sure is None else outs[:sure + 1]

        def chain(at: int, tried: list[tuple[Out, Schema]]) -> Column:
            if at == len(outs):
                return F.struct(none(kind).alias("v"), self.unfit(s, show, path, tried).alias("e"), F.lit(True).alias("n"))
            out, a = outs[at]
            if out.error is None:
                return F.struct(own(out, a).alias("v"), none().alias("e"), F.lit(True).alias("n"))
            good = lambda o: F.struct(own(o, a).alias("v"), none().alias("e"), F.lit(True).alias("n"))

            def body(p: Column) -> Column:
                o = out.inside(p)
                return F.when(o.error.isNull(), good(o)).otherwise(chain(at + 1, [*tried, (o, a)]))

            return bound(out.held(), body)

        return Out(kind, none(), F.lit(True)).inside(chain(0, []), sum(o.weight for o, _ in outs) + LIGHT)

    def dispatch(self, s: Schema, run: Callable[[Schema], Out], show: Column, path: tuple) -> Out:
        """A typed value through a union: arms in order."""
        return self.attempts(s, [a for a in s.arms if a.kind != "never"], run, show, path)

    # --- typed values --------------------------------------------------------------------------
    def inside(self, s: Schema, x: Column, path: tuple) -> Out:
        """A typed value of s itself: containers run their children, scalars pass."""
        k = s.kind
        if k in WRAPS:
            return together([self.typed(s.items[0], x, path)], lambda o: Out(
                F.when(x.isNull(), self.default(s)).otherwise(o[0].value), None if o[0].error is None else F.when(x.isNotNull(), o[0].error)), 1)
        missing = F.when(x.isNull(), failure(path, f"Expected {expression(s)}, received undefined"))
        if k in ("undefined", "unknown", "json", "ref") or k == "literal" and s.const is None:
            return Out(x, None)
        if k == "never":
            raise SchemaError("never has no value")
        if k in ("array", "record"):
            item, keys = s.items[0], F.map_keys(x) if k == "record" else None
            run = lambda e, i: self.typed(item, e, (*path, i.cast("string") if keys is None else F.get(keys, i)))
            return together([_items(x if keys is None else F.map_values(x), run)], lambda o: Out(
                o[0].value if keys is None else F.map_from_arrays(keys, o[0].value), first(missing, o[0].error)))
        if k in ("object", "tuple"):
            names = [n for n, _ in fields_of(s)]
            outs = [self.typed(kind, self.source(s, n, kind, x), (*path, label(s, n))) for n, kind in fields_of(s)]
            return together(outs, lambda c: Out(self.assembled(s, {n: o.value for n, o in zip(names, c, strict=True)}, x.isNotNull()), first(missing, *(o.error for o in c))), 1)
        if k == "compactColumns":
            return self._transposed(s, x, missing)
        if k == "union":
            have = entry_type(s)
            if have == "variant":
                return self.dispatch(s, lambda a: self.parse(a, x, "typed", path), x, path)
            if any(a.to for a in s.arms):
                return self.dispatch(s, lambda a: self.typed(a, x, path), _variant(x, have), path)
            return Out(x, missing if not any(a.kind == "undefined" or a.const is None for a in s.arms) else None)
        if k == "literal":
            return Out(x, unless(x.eqNullSafe(self.lit(s)), expected(s, _variant(x, literal_type(s.const)), path)))
        return Out(trimmed(x) if k == "trimmed" else x, missing)

    def source(self, s: Schema, name: str, kind: Schema, x: Column) -> Column:
        """Where an object's field is in the typed value: by the shape when encoding."""
        if s.shape is None or not s.flipped:
            return x.getField(name)
        key = str(int(name[1:]) - 1) if s.kind == "tuple" else name

        def find(shape: Any, at: Column) -> Column | None:
            if isinstance(shape, Place):
                if shape.path == (key,):
                    return at
                return at.getField(key) if not shape.path else None
            if isinstance(shape, dict):
                for k, v in shape.items():
                    if (got := find(v, at.getField(k))) is not None:
                        return got
            return None

        def rebuilt(prefix: tuple[str, ...], node: Schema) -> Column | None:
            if node.kind == "literal":
                return self.lit(node)
            if node.kind == "object" and node.shape is None:
                parts = []
                for k, v in node.props:
                    at = found(s.shape, x, (*prefix, k))
                    parts.append((k, rebuilt((*prefix, k), v.chain[0]) if at is None else at))
                return F.struct(*(c.alias(k) for k, c in parts)) if all(c is not None for _, c in parts) else None
            return None

        def found(shape: Any, at: Column, path: tuple[str, ...]) -> Column | None:
            if isinstance(shape, Place):
                return at if shape.path == path else None
            if isinstance(shape, dict):
                for k, v in shape.items():
                    if (got := found(v, at.getField(k), path)) is not None:
                        return got
            return None

        got = find(s.shape, x)
        if got is None:
            got = rebuilt((key,), kind.chain[0])
        if got is None:
            raise SchemaError(f'Missing input for "{key}"')
        return got

    def _transposed(self, s: Schema, x: Column, missing: Column) -> Out:
        row = s.items[0]

        def column(name: str, kind: Schema) -> Column:
            return F.transform(x, lambda r: as_type(r.getField(name), type_of(kind), "variant"))

        return Out(F.array(*(column(k, t) for k, t in row.props)), missing)

    # --- conversions ---------------------------------------------------------------------------
    def link(self, a: Schema, b: Schema, x: Column, path: tuple) -> Out:
        coder = a.coder
        if coder is None or coder.decode == AUTO:
            return self.convert(a, b, x, path)
        if coder.decode == NEVER:
            raise SchemaError(f"{expression(a)} is never decoded to {expression(b)}", "never_decoded")
        made = coder.decode(x)
        if getattr(coder.decode, "catches", False):
            out = Out(made["value"], F.when(made["error"].isNotNull(), failure(path, made["error"], "invalid_conversion")), weight=LIGHT)
        else:
            out = Out(made, None)
        kind = node_type(b)

        def body(o: list[Out]) -> Out:
            value, error = o[0].value, o[0].error
            if kind.startswith(("struct", "array", "map")):
                # Parts that are of another type become null, which `inside` reports at their place.
                cast = value.try_cast(kind)
                error = first(error, F.when(value.isNotNull() & cast.isNull(), expected(b, "another type", path)))
                value = cast
            elif kind != "variant":
                cast = value.try_cast(kind)
                error = first(error, F.when(value.isNotNull() & cast.isNull(), expected(b, value.cast("variant"), path)))
                value = cast
            return together([self.inside(b, value, path)], lambda i: Out(i[0].value, first(error, i[0].error)))

        return together([out], body)

    def convert(self, a: Schema, b: Schema, x: Column, path: tuple) -> Out:
        p, q = a.kind, b.kind
        show = _variant(x, node_type(a))
        bad = lambda ok, y=None: Out(y if y is not None else x, unless(ok, expected(b, show, path)))
        texts, numbers = ("string", "trimmed", "url"), ("number", "int32", "integer", "port")
        if p in WRAPS and q not in ("union",):
            if q in ("json", "jsonString"):
                return self.to_json(a, b, x, path)
            inner = self.convert(a.items[0].output, b.items[0] if q in WRAPS else b, x, path)
            if q in WRAPS:
                return together([inner], lambda o: Out(F.when(x.isNull(), self.default(b)).otherwise(o[0].value), None if o[0].error is None else F.when(x.isNotNull(), o[0].error)), 1)
            return together([inner], lambda o: Out(o[0].value, first(F.when(x.isNull(), expected(b, "undefined", path)), o[0].error)), 1)
        if q in WRAPS:
            inner = self.follow(b.items[0], self.convert(a, b.items[0], x, path), path)
            return inner
        if q == "unknown":
            return Out(as_type(x, node_type(a), "variant"), None)
        if p == "unknown" or p == "json" or p == "ref":
            return self.read(b, x, "unknown" if p == "unknown" else "json", path)
        if p == "jsonString" and q != "jsonString":
            shape: list[Out] = []

            def run(w: Column) -> Column:
                inner = self.read(b, json_in(w), "json", path)
                shape.append(together([inner], lambda o: Out(o[0].value, first(unless(alone(w), expected(Schema("jsonString"), show, path)), o[0].error)), 1))
                return shape[-1].held()

            pair = bound(wrapped_json(x), run)
            return shape[-1].inside(pair, LIGHT)
        if q in ("json", "jsonString") and p != "jsonString":
            return self.to_json(a, b, x, path)
        if p == q == "union":
            return self.passed(a, b, x, path)
        if q == "union":
            covered(a, b)
            return self.dispatch(b, lambda arm: self.follow(arm, self.convert(a, arm, x, path), path), show, path)
        if p == "union":
            told_apart(a, b)
            return self.dispatch_to(a, b, x, path)
        if p in texts:
            if q in ("string",):
                return Out(x, None)
            if q == "trimmed":
                return Out(trimmed(x), None)
            if q in numbers:
                def number(o: list[Out]) -> Out:
                    y = o[0].value
                    ok = y.isNotNull() & ~F.isnan(y)
                    after = unless(self.fits(q, y), expected(b, _variant(y, "double"), path)) if q != "number" else None
                    return Out(self.narrow(q, y), first(unless(ok, expected(b, show, path)), after))

                # Bound in bodies of recursive schemas, which are always interpreted.
                return number([Out(to_number(x), None)]) if self.walk is None else together([Out(bound(trimmed(x), number_of), None, weight=LIGHT)], number)
            if q == "boolean":
                y = F.when(x == "true", F.lit(True)).when(x == "false", F.lit(False))
                return bad(y.isNotNull(), y)
            if q == "bigint":
                return bad(to_bigint(x).isNotNull(), to_bigint(x))
            if q == "wide":
                return together([Out(wide.canonical(x), None, weight=LIGHT)], lambda o: Out(o[0].value, unless(o[0].value.isNotNull(), expected(b, show, path))))
            if q == "date":
                y = iso_date_time(x)
                return Out(y, unless(y.isNotNull(), expected(b, "invalid Date", path)))
            if q == "url":
                y = Out(urls.href(x), None, weight=LIGHT)
                return together([y], lambda o: Out(o[0].value, unless(o[0].value.isNotNull(), expected(b, show, path))))
            if q in ("bytes", "blob"):
                return Out(F.encode(x, "UTF-8"), None)
            if q in ("literal", "undefined", "nan"):
                text = {"undefined": "undefined", "nan": "NaN"}.get(q) or (b.const if isinstance(b.const, str) else literal_text(b.const))
                y = none("string") if q == "undefined" else F.lit(float("nan")) if q == "nan" else self.lit(b)
                return bad(x == text, y)
        if p in numbers and q in numbers:
            y = x.cast("double")
            return bad(self.fits(q, y), self.narrow(q, y))
        if p in numbers and q == "string":
            return Out(number_text(x.cast("double")), None)
        if p in numbers and q == "bigint":
            return bad(x.cast("double") % 1 == 0, x.try_cast(BIG))
        if p in ("bigint", "boolean", "wide") and q == "string":
            return Out(x.cast("string"), None)
        if p == "wide" and q in ("bigint", *numbers):
            y = x.try_cast(BIG if q == "bigint" else "double")
            return bad(y.isNotNull() if q == "bigint" else self.fits(q, y), y if q == "bigint" else self.narrow(q, y))
        if q == "wide" and p in ("bigint", *numbers):
            y = x.cast("string") if p != "number" and p != "integer" else F.when((x % 1 == 0) & (F.abs(x) < 1e21), number_text(x))
            return bad(y.isNotNull(), y)
        if p == "date" and q == "string":
            return Out(iso_text(x), None)
        if p in ("bytes", "blob") and q == "string":
            return Out(text_of_bytes(x), None)
        if p in ("literal", "undefined", "nan"):
            if q in ("literal", "undefined", "nan"):
                return Out(none("string") if q == "undefined" else F.lit(float("nan")) if q == "nan" else self.lit(b), None)
            if q == "string":
                return Out(F.lit({"undefined": "undefined", "nan": "NaN"}.get(p) or (a.const if isinstance(a.const, str) else literal_text(a.const))), None)
        if p == q == "array":
            item = lambda e, i: self.follow(b.items[0], self.convert(a.items[0].output, b.items[0], e, (*path, i.cast("string"))), (*path, i.cast("string")))
            return _items(x, item)
        if p == "object" and q == "record":
            outs = {k: self.follow(b.items[0], self.convert(t.output, b.items[0], x.getField(k), (*path, k)), (*path, k)) for k, t in a.props}
            return together(list(outs.values()), lambda o: Out(F.create_map(*(c for k, i in zip(outs, o, strict=True) for c in (F.lit(k), i.value))), first(*(i.error for i in o))), 1)
        if q == "object" and p in ("object", "record"):
            have = dict(a.props)
            outs = {}
            for k, t in b.props:
                if p == "object" and k not in have:
                    raise SchemaError(f'Missing input for "{k}"', "unsupported_decode")
                from_ = have[k].output if p == "object" else Schema("optional", items=(a.items[0].output,))
                value = x.getField(k) if p == "object" else F.try_element_at(x, F.lit(k))
                outs[k] = self.follow(t, self.convert(from_, t, value, (*path, k)), (*path, k))
            return together(list(outs.values()), lambda o: Out(self.assembled(b, {k: i.value for k, i in zip(outs, o, strict=True)}, x.isNotNull()), first(*(i.error for i in o))), 1)
        if p == q:
            return self.inside(b, x, path)
        raise SchemaError(f"Can't decode {expression(a)} to {expression(b)}. Use a custom coder", "unsupported_decode")

    def dispatch_to(self, a: Schema, b: Schema, x: Column, path: tuple) -> Out:
        """A union's value to one type: every arm must have a conversion."""
        whole = node_type(a)

        def run(arm: Schema) -> Out:
            if whole != "variant":
                return self.convert(arm.output, b, x, path)
            got = self.parse(arm, x, "typed", path)
            return together([got], lambda g: together([self.convert(arm.output, b, g[0].value, path)], lambda m: Out(m[0].value, first(g[0].error, m[0].error))))

        failing = Out(none(node_type(b)), failure(path, f"Expected {expression(a)}, received ", got=_variant(x, whole)), F.lit(True))
        pair, outs = failing.held(), [run(arm) for arm in a.arms]
        for o in reversed(outs):
            if o.error is None:
                pair = self.uniform(o, node_type(b))
                continue
            pair = _or_else(o, lambda value: F.struct(value.alias("v"), none().alias("e"), F.lit(True).alias("n")), pair)
        return failing.inside(pair, LIGHT)

    def passed(self, a: Schema, b: Schema, x: Column, path: tuple) -> Out:
        """A union's value to another union: each arm's values pass to the arms of their type, none is coerced."""
        whole, kind = node_type(a), node_type(b)
        routes = paired(a, b)
        failing = Out(none(kind), failure(path, f"Expected {expression(a)}, received ", got=_variant(x, whole)), F.lit(True))
        pair = failing.held()
        for arm, targets in reversed(routes):
            got = self.parse(arm, x, "typed", path) if whole == "variant" else Out(
                x, None if arm.kind != "literal" else unless(x.eqNullSafe(self.lit(arm)), failure(path, "")))

            def routed(value: Column, arm: Schema = arm, targets: list[Schema] = targets) -> Column:
                if any(t.kind == "never" for t in targets[0].chain) and len(targets) == 1:
                    return F.struct(none(kind).alias("v"), failure(path, "Expected never, received ", got=_variant(x, whole)).alias("e"), F.lit(True).alias("n"))
                step = lambda t: self.follow(t, self.convert(arm.output, t, value, path), path)
                some = replace(b, arms=tuple(targets))
                made = step(targets[0]) if len(targets) == 1 else self.dispatch(some, step, _variant(value, type_of(arm)), path)
                have = type_of(targets[0]) if len(targets) == 1 else node_type(some)
                return self.uniform(together([made], lambda o: Out(as_type(o[0].value, have, kind), o[0].error), 1), kind)

            pair = _or_else(got, routed, pair)
        return failing.inside(pair, LIGHT)

    # --- JSON text -----------------------------------------------------------------------------
    def to_json(self, a: Schema, b: Schema, x: Column, path: tuple) -> Out:
        out = self.text(replace(a, to=None, coder=None), x, path)

        def body(o: list[Out]) -> Out:
            made = F.coalesce(o[0].value, F.lit("null"))
            if b.kind == "json":
                return Out(F.try_parse_json(made), o[0].error)
            space = dict(b.meta).get("space")
            return Out(indented(made, space) if space else made, o[0].error)

        return together([out], body, 1)

    def text(self, s: Schema, x: Column, path: tuple) -> Out:
        """JSON text of a typed value, null where it is absent; the error of what can't be text."""
        k = s.kind
        if s.to is not None:
            s, k = s.output, s.output.kind
        if k in WRAPS:
            inner = self.text(s.items[0], x, path)
            return inner if k == "optional" else together([inner], lambda o: Out(F.coalesce(o[0].value, F.lit("null")), o[0].error), 1)
        if k in ("string", "trimmed", "url", "jsonString"):
            return Out(F.concat(F.lit('"'), x, F.lit('"')) if s.format in ("uuid", "date", "date-time", "ipv4") else quoted(x), None)
        if k in ("number", "int32", "integer", "port"):
            y = x.cast("double")
            bad = F.when(F.isnan(y) | (F.abs(y) == math.inf), failure(path, "Expected JSON, received ", got=y.cast("variant"))) if k == "number" else None
            return Out(number_text(y) if k in ("number", "integer") else x.cast("string"), bad)
        if k == "boolean":
            return Out(x.cast("string"), None)
        if k in ("bigint", "wide"):
            return Out(F.concat(F.lit('"'), x.cast("string"), F.lit('"')), None)
        if k == "date":
            return Out(F.concat(F.lit('"'), iso_text(x), F.lit('"')), None)
        if k in ("bytes", "blob"):
            return Out(quoted(text_of_bytes(x)), None)
        if k == "literal":
            return Out(F.lit(literal_text(s.const)), None)
        if k == "undefined":
            return Out(none("string"), None)
        if k == "nan":
            return Out(F.lit("null"), None)
        if k in ("json", "unknown", "ref"):
            return Out(F.to_json(x), None)
        if k in ("array", "compactColumns"):
            made = _items(x, lambda e, i: self.text(s.items[0], e, (*path, i.cast("string"))))
            return together([made], lambda o: Out(F.concat(F.lit("["), F.array_join(o[0].value, ",", "null"), F.lit("]")), o[0].error), 1)
        if k == "record":
            keys = F.map_keys(x)
            made = _items(F.map_values(x), lambda e, i: self.text(s.items[0], e, (*path, F.get(keys, i))))

            def pairs(o: list[Out]) -> Out:
                each = F.zip_with(keys, o[0].value, lambda n, t: F.concat(quoted(n), F.lit(":"), t))
                return Out(F.concat(F.lit("{"), F.array_join(F.filter(each, lambda p: p.isNotNull()), ","), F.lit("}")), o[0].error)

            return together([made], pairs, 1)
        if k in ("tuple", "object") and s.shape is not None and not s.flipped:
            return self.text_of_shape(s, s.shape, x, path)
        if k in ("tuple", "object"):
            names = [n for n, _ in fields_of(s)]
            outs = [self.text(t, x.getField(n), (*path, label(s, n))) for n, t in fields_of(s)]

            def whole(o: list[Out]) -> Out:
                if k == "tuple":
                    made = F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(c.value, F.lit("null")) for c in o)), F.lit("]"))
                else:  # concat_ws leaves null pieces out, as absent fields are
                    parts = [F.concat(F.lit(literal_text(n) + ":"), c.value) for n, c in zip(names, o, strict=True)]
                    made = F.concat(F.lit("{"), F.concat_ws(",", *parts) if parts else F.lit(""), F.lit("}"))
                return Out(F.when(x.isNotNull(), made), first(*(None if c.error is None else F.when(x.isNotNull(), c.error) for c in o)))

            return together(outs, whole, 1)
        if k == "union":
            return self.text_of_union(s, x, path)
        raise SchemaError(f"{expression(s)} has no JSON text", "unsupported_decode")

    def text_of_shape(self, s: Schema, shape: Any, x: Column, path: tuple) -> Out:
        """The text of an object's output in its shape."""
        if isinstance(shape, Place):
            return self.text(at_place(s, shape) if shape.path else replace(s, shape=None), x, path)
        if not isinstance(shape, dict):
            return Out(F.lit(literal_text(shape)), None)
        outs = [self.text_of_shape(s, inner, x.getField(n), (*path, n)) for n, inner in shape.items()]

        def whole(o: list[Out]) -> Out:
            parts = [F.concat(F.lit(literal_text(n) + ":"), c.value) for n, c in zip(shape, o, strict=True)]
            return Out(F.when(x.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))), first(*(None if c.error is None else F.when(x.isNotNull(), c.error) for c in o)))

        return together(outs, whole, 1)

    def text_of_union(self, s: Schema, x: Column, path: tuple) -> Out:
        """The text of the arm that the value is of. Values of several types are a VARIANT; equal types are told
        apart by their constants, so containers are looked into as well."""
        kind = node_type(s)
        arms = [replace(a.output, said=None) for a in s.arms if a.output.kind not in ("undefined", "never")]
        empty = F.lit("null") if any(a.const is None for a in arms) else none("string")
        arms = [a for a in arms if a.const is not None]
        if not arms:
            return Out(empty, None)
        if kind != "variant" and not kind.startswith(("struct", "array", "map")):
            some = next((a for a in arms if a.kind != "literal"), arms[0])
            text = self.text(some, x, path) if some.kind != "literal" else Out({"string": quoted, "double": number_text, "boolean": lambda c: c.cast("string")}[kind](x), None)
            return together([text], lambda o: Out(F.coalesce(o[0].value, empty), o[0].error), 1)
        v = as_type(x, kind, "variant")
        plain_arms = [_plain(a) for a in arms]
        failing = Out(empty, F.when(x.isNotNull(), failure(path, f"Expected {expression(s)}, received ", got=v)), F.lit(True))

        def run(b: Column) -> Column:
            pair = failing.held()
            for a in reversed(plain_arms):
                text = lambda value, a=a: self.uniform(self.text(a, value, path), "string")
                pair = _or_else(self.parse(a, b["v"], "typed", path, b["t"]), text, pair)
            return F.when(b["v"].isNull(), failing.held()).otherwise(pair)

        return failing.inside(bound(F.struct(v.alias("v"), F.schema_of_variant(v).alias("t")), run), LIGHT)


def iso_date_time(s: Column) -> Column:
    """ISO 8601 text to a timestamp, with or without time and zone (none: UTC)."""
    ok = s.rlike(r"^\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+\-]\d\d:\d\d)?)?\z")
    return F.when(ok, F.date_trunc("MILLISECOND", F.replace(s, F.lit(" "), F.lit("T")).try_cast("timestamp")))


def _variant(x: Column, kind: str) -> Column:
    return as_type(x, kind, "variant")


def _items(items: Column, run: Callable[[Column, Column], Out]) -> Out:
    """(values, first error) of an array's items, each of which is compiled once."""
    sure = False

    def pair(x: Column, i: Column) -> Column:
        nonlocal sure
        out = run(x, i)
        sure = out.error is None
        if sure:
            return out.value
        return out.held()

    both = F.transform(items, pair)
    if sure:
        return Out(both, None, weight=LIGHT)
    shape = Out(both, none())
    made = bound(both, lambda b: F.struct(F.transform(b, lambda p: p["v"]).alias("v"), F.get(F.filter(F.transform(b, lambda p: p["e"]), lambda e: e.isNotNull()), F.lit(0)).alias("e")))
    return shape.inside(made, LIGHT)


def _or_else(got: Out, then: Callable[[Column], Column], rest: Column) -> Column:
    """then(value) where got is valid, rest elsewhere."""
    if got.error is None:
        return bound(got.held(), lambda p: then(p["v"]))
    return bound(got.held(), lambda p: F.when(p["e"].isNull(), then(p["v"])).otherwise(rest))


def _json_form(x: Any) -> Any:
    """A value as JSON brings it."""
    if isinstance(x, dict):
        return {k: _json_form(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_json_form(v) for v in x]
    if isinstance(x, bytes):
        return x.decode()
    if hasattr(x, "isoformat"):
        return x.isoformat() if "T" in x.isoformat() and x.isoformat().endswith("Z") else f"{x:%Y-%m-%dT%H:%M:%S}Z"
    return x


def _plain(s: Schema) -> Schema:
    """The output type of s alone: its values have been checked."""
    node = replace(s.output, checks=(), input_checks=(), bounds=(), format=None, coder=None, shape=None, default=ABSENT, extras="strip")
    return replace(node, items=tuple(map(_plain, node.items)), props=tuple((k, _plain(x)) for k, x in node.props), arms=tuple(map(_plain, node.arms)))


def as_type(x: Column, have: str, want: str) -> Column:
    if have == want or want != "variant":
        return x if have == want else x.cast(want)
    return F.to_variant_object(x) if have.startswith(("struct", "map", "array")) else x.cast("variant")


_OPEN = (*WRAPS, "unknown", "json", "ref", "union")


def _end(s: Schema) -> Schema:
    """What a chain produces: never as soon as one link gives nothing."""
    for node in s.chain:
        if node.kind == "never" or node.coder is not None and node.coder.decode == NEVER:
            return Schema("never")
    return s.output


def same_type(a: Schema, b: Schema) -> bool:
    """Are the values of both of one type and format? Constants are of their value's type."""
    def told(s: Schema) -> tuple:
        if s.kind == "literal":
            c = s.const
            return ("null" if c is None else "boolean" if isinstance(c, bool) else "string" if isinstance(c, str) else "number"), None
        if s.kind in ("string", "trimmed", "jsonString"):
            return "string", s.format or ("json" if s.kind == "jsonString" else None)
        if s.kind in ("number", "int32", "integer", "port"):
            return "number", None if s.kind == "number" else s.kind
        return s.kind, s.format

    return told(a) == told(b)


def _refused(a: Schema, b: Schema, why: str) -> SchemaError:
    return SchemaError(f"Invalid operation: can't convert {expression(a)} to {expression(b)} — {why}. "
                       "Say what is meant with convert, or mark the arm as never")


def told_apart(a: Schema, b: Schema) -> None:
    """From a union to one type all arms produce its type or none does: else it is open what is converted."""
    arms = [x for x in map(_end, a.arms) if x.kind != "never"]
    if b.kind in _OPEN or any(x.kind in _OPEN for x in arms):
        return
    same = [x for x in arms if same_type(x, b)]
    if same and len(same) < len(arms):
        raise _refused(a, b, f"{expression(same[0])} has the same type as the target and the others don't")


def covered(a: Schema, b: Schema) -> None:
    """From one type to a union all arms take its type or none does: else it is open if a value passes or is converted."""
    arms = [x for x in b.arms if x.kind != "never" and not _unlinked(x)]
    if a.kind in _OPEN or a.kind == "literal" or any(x.kind in _OPEN for x in arms):
        return
    same = [x for x in arms if same_type(a, x)]
    if same and len(same) < len(arms):
        raise _refused(a, b, f"{expression(same[0])} has the same type as the source and the others don't")


def _unlinked(s: Schema) -> bool:
    return any(x.coder is not None and x.coder.decode == NEVER for x in s.chain)


def paired(a: Schema, b: Schema) -> list[tuple[Schema, list[Schema]]]:
    """(arm of a, arms of b that take its values); each arm must have its type on the other side, null and
    undefined each other."""
    nullish = {"undefined": "null", "null": "undefined"}
    name = lambda s: "null" if s.kind == "literal" and s.const is None else s.kind
    open_ = [t for t in b.arms if t.kind != "never" and not _unlinked(t)]
    routes, covered, sources = [], set(), set()
    for arm in a.arms:
        end = _end(arm)
        if end.kind == "never":
            continue
        sources.add(name(end))
        targets = [t for t in open_ if same_type(end, t)]
        covered |= {id(t) for t in targets}
        if not targets:
            targets = [t for t in open_ if name(t) == nullish.get(name(end)) and _end(t).kind != "never"][:1]
        if not targets:
            raise _refused(a, b, f"{expression(end)} has no same-type variant on the other side")
        routes.append((arm, targets))
    for t in open_:
        if id(t) not in covered and (_end(t).kind == "never" or nullish.get(name(t)) not in sources):
            raise _refused(a, b, f"{expression(t)} has no same-type variant on the other side")
    return routes


#: The types that a union tells apart in a VARIANT, by the first letters of their names; absent is SQL NULL.
NAMES = {"absent": (), "null": ("VOI",), "string": ("STR",), "number": _NUMBERS, "boolean": ("BOO",), "array": ("ARR",), "object": ("OBJ",),
         "bytes": ("BIN",), "date": ("TIM", "DAT")}


def is_one_of(names: list[str], v: Column, tag: Column) -> Column:
    letters = [x for n in names for x in NAMES[n]]
    found = F.coalesce(F.substring(tag, 1, 3).isin(*letters), F.lit(False)) if letters else F.lit(False)
    return found | v.isNull() if "absent" in names else found


def mask(s: Schema, kind: str, inner: tuple[str, ...] = ()) -> frozenset[str]:
    """The types of values that s may take."""
    json = kind == "json"
    k = s.kind
    if k == "literal":
        c = s.const
        return frozenset({"null", "absent"} if c is None and kind == "typed" else {"null"} if c is None else {"boolean"} if isinstance(c, bool) else {"string"} if isinstance(c, str) else {"number"})
    if k in WRAPS:
        more = {"optional": {"absent", "null"} if json else {"absent"}, "nullable": {"absent", "null"} if kind == "typed" else {"null"}, "nullish": {"absent", "null"}}[k]
        return mask(s.items[0], kind, inner) | more
    if k == "union":
        return frozenset().union(*(mask(a, kind, inner) for a in s.arms))
    if k == "ref":
        body = s.defs.get(s.ref)
        return frozenset(NAMES) if body is None or s.ref in inner else mask(body, kind, (*inner, s.ref))
    if k == "unknown":
        return frozenset(NAMES)
    if k == "json":
        return frozenset(NAMES) - {"absent"}
    own = {"string": "string", "trimmed": "string", "jsonString": "string", "number": "number", "int32": "number", "integer": "number", "port": "number", "boolean": "boolean",
           "array": "array", "tuple": "array", "compactColumns": "array", "object": "object", "record": "object", "blob": "bytes"}
    if k in own:
        return frozenset({own[k]})
    if k == "undefined":
        return frozenset({"absent", "null"} if json else {"absent"})
    if k == "nan":
        return frozenset({"null"} if json else {"number"} if kind == "typed" else ())
    if json:
        return frozenset({"string"} if k in ("bigint", "wide", "date", "url", "bytes") else ())
    return frozenset({"bigint": {"number"}, "wide": {"number"}, "date": {"date"}, "bytes": {"bytes"}, "url": {"string"} if kind == "typed" else ()}.get(k, ()))


def plain(s: Schema) -> bool:
    """Does a value of the right type pass, and pass unchanged?"""
    return not (s.to or s.checks or s.input_checks or s.bounds or s.format or s.messages or not s.validates)


def effect(s: Schema, kind: str, o: Options) -> int:
    """0: takes every value of its types, unchanged; 1: some of them, unchanged; 2: changes values or looks inside."""
    if s.kind in ("string", "boolean", "json", "unknown") or s.kind == "number" and (kind == "json" or o.allow_nan):
        return 2 if s.to else 0 if plain(s) else 1
    return 1 if s.kind in ("literal", "number", "int32", "integer", "port") and not s.to and (s.kind in ("literal", "number")) else 2


def live(arms: tuple[Schema, ...], kind: str, o: Options) -> list[Schema]:
    """The arms that a value can reach, in their order. One that passes values through unchanged is dead where other
    arms take all values of its types anyway and none changes them: which of them a value meets can't be seen."""
    masks, effects = [mask(a, kind) for a in arms], [effect(a, kind, o) for a in arms]
    total = frozenset().union(*(m for m, e in zip(masks, effects, strict=True) if e == 0))
    changed = frozenset().union(*(m for m, e in zip(masks, effects, strict=True) if e == 2))
    return [a for a, m, e in zip(arms, masks, effects, strict=True) if a.kind != "never" and m and not (e == 1 and m <= total and not m & changed)]


def exclusive(arms: list[Schema]) -> str | None:
    """The field of constants that tells these objects apart, if one does."""
    tags = [discriminator(a) for a in arms]
    told = len(arms) > 1 and all(a.kind == "object" and t is not None for a, t in zip(arms, tags, strict=True)) and len({t[0] for t in tags}) == 1 and len(
        {(type(t[1].const), t[1].const) for t in tags}) == len(arms)
    return tags[0][0] if told else None


def discriminator(s: Schema) -> tuple[str, Schema] | None:
    """The first literal field of an object or tuple."""
    if s.kind not in ("object", "tuple"):
        return None
    return next(((k, x) for k, x in fields_of(s) if x.kind == "literal" and not x.to), None)


from .recursion import Walk, refers  # noqa: E402
