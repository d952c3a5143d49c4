"""Schemas: immutable descriptions of a value, with an input and an output side.

A schema is a chain of nodes linked by `to`: the first node is the input, the last the output.
Modifiers return changed copies. What can never work raises SchemaError here, before any job.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from . import constants, formats, patterns
from .errors import SchemaError


ABSENT = type("Absent", (), {"__repr__": lambda s: "undefined", "__bool__": lambda s: False})()
NEVER = "never"
AUTO = "auto"
#: What `operators.global_options` sets: the extras mode of objects, and if numbers may be NaN.
DEFAULTS = {"extras": "strip", "allow_nan": False}


@dataclass(frozen=True)
class Check:
    """A refinement: test(Column) -> Column; path is added to the error's path."""

    test: Callable
    reason: str
    path: tuple[str, ...] = ()


@dataclass(frozen=True)
class Coder:
    """A custom conversion: Column functions or UDFs by direction; None, `auto` or `never` otherwise."""

    decode: Any = AUTO
    encode: Any = AUTO


@dataclass(frozen=True)
class Schema:
    kind: str
    const: Any = ABSENT
    format: str | None = None
    bounds: tuple[tuple[str, Any], ...] = ()
    messages: tuple[tuple[str, str], ...] = ()
    items: tuple[Schema, ...] = ()  # tuple positions, or the one item/value schema
    props: tuple[tuple[str, Schema], ...] = ()
    extras: str = "strip"
    arms: tuple[Schema, ...] = ()
    to: Schema | None = None
    coder: Coder | None = None  # of the link to `to`
    checks: tuple[Check, ...] = ()
    input_checks: tuple[Check, ...] = ()
    default: Any = ABSENT
    shape: Any = None  # of an object's output: nested dicts of Place and constants
    validates: bool = True
    name: str | None = None
    meta: tuple[tuple[str, Any], ...] = ()
    extension: tuple[tuple[str, Any], ...] = ()
    ref: str | None = None
    defs: dict = field(default_factory=dict, compare=False)
    required: tuple[str, ...] | None = None  # the keys that a document requires, if not those that are not optional
    slot: int | None = field(default=None, compare=False)  # of a reference, while its body is compiled
    flipped: bool = False  # coders run in the other direction
    code_points: bool = False  # lengths count code points
    said: str | None = field(default=None, compare=False)  # what errors at its place call it, if not by its own text

    # --- links ---------------------------------------------------------------------------------
    @property
    def chain(self) -> list[Schema]:
        out: list[Schema] = []
        node: Schema | None = self
        while node is not None:
            out.append(node)
            node = node.to
        return out

    @property
    def output(self) -> Schema:
        return self.chain[-1]

    def _at_output(self, change: Callable[[Schema], Schema]) -> Schema:
        return replace(self, to=self.to._at_output(change)) if self.to else change(self)

    def pipe(self, fn: Callable, *args: Any, **kw: Any) -> Any:
        return fn(self, *args, **kw)

    def convert(self, target: Any, decode: Any = AUTO, encode: Any = AUTO) -> Schema:
        """Link target behind this schema; the conversion is checked when an operation is made."""
        target = as_schema(target)
        if callable(decode) and encode == AUTO:
            encode = NEVER
        coder = None if decode == AUTO and encode == AUTO else Coder(decode, encode)
        return self._at_output(lambda s: replace(s, to=target, coder=coder))

    def reverse(self) -> Schema:
        """Input and output swapped."""
        nodes = self.chain
        out: Schema | None = None
        for i, node in enumerate(nodes):
            link = nodes[i - 1].coder if i else None
            turned = replace(
                node, to=out, coder=Coder(link.encode, link.decode) if link else None,
                checks=node.input_checks, input_checks=node.checks, default=ABSENT,
                items=tuple(x.reverse() for x in node.items), props=tuple((k, x.reverse()) for k, x in node.props),
                arms=tuple(x.reverse() for x in node.arms), flipped=not node.flipped)
            out = turned
        assert out is not None
        return out

    # --- modifiers -----------------------------------------------------------------------------
    def refine(self, test: Callable, error: str = "Refinement failed", path: tuple[str, ...] | list[str] = ()) -> Schema:
        return self._at_output(lambda s: replace(s, checks=(*s.checks, Check(test, error, tuple(path)))))

    def refine_input(self, test: Callable, error: str = "Refinement failed") -> Schema:
        return replace(self, input_checks=(*self.input_checks, Check(test, error)))

    def bound(self, key: str, value: Any, message: str | None = None) -> Schema:
        def change(s: Schema) -> Schema:
            if s.kind in ("optional", "nullable", "nullish"):
                return replace(s, items=(s.items[0].bound(key, value, message),))
            if key == "pattern":
                bounds = (*s.bounds, (key, value))
            else:
                bounds = narrowed(s, key, value)
            return replace(s, bounds=bounds, messages=(*s.messages, (key, message)) if message else s.messages)

        return self._at_output(change)

    def gt(self, n: Any, message: str | None = None) -> Schema:
        return self.bound("gt", n, message)

    def gte(self, n: Any, message: str | None = None) -> Schema:
        return self.bound("gte", n, message)

    def lt(self, n: Any, message: str | None = None) -> Schema:
        return self.bound("lt", n, message)

    def lte(self, n: Any, message: str | None = None) -> Schema:
        return self.bound("lte", n, message)

    def multiple_of(self, n: Any, message: str | None = None) -> Schema:
        if n <= 0:
            raise SchemaError("multipleOf must be greater than 0")
        return self.bound("multipleOf", n, message)

    def min_length(self, n: int, message: str | None = None) -> Schema:
        return self.bound("minLength", n, message)

    def max_length(self, n: int, message: str | None = None) -> Schema:
        return self.bound("maxLength", n, message)

    def length(self, n: int, message: str | None = None) -> Schema:
        return self.bound("minLength", n, message).bound("maxLength", n, message)

    def non_empty(self, message: str | None = None) -> Schema:
        return self.min_length(1, message)

    def min_size(self, n: int, message: str | None = None) -> Schema:
        return self.bound("minSize", n, message)

    def max_size(self, n: int, message: str | None = None) -> Schema:
        return self.bound("maxSize", n, message)

    def size(self, n: int, message: str | None = None) -> Schema:
        return self.min_size(n, message).max_size(n, message)

    def pattern(self, regex: str, message: str = "Invalid pattern", flags: str = "") -> Schema:
        """A pattern in JavaScript's dialect, anywhere in the text."""
        patterns.java(regex, flags)
        return self.bound("pattern", f"(?{flags})".join(("", regex)) if flags else regex, message)

    def trim(self) -> Schema:
        return self.convert(Schema("trimmed"))

    def strip(self) -> Schema:
        return replace(self, extras="strip")

    def strict(self) -> Schema:
        return replace(self, extras="strict")

    def _deep(self, mode: str) -> Schema:
        items = tuple(x._deep(mode) for x in self.items) if self.kind == "tuple" else self.items
        return replace(self, extras=mode, items=items, props=tuple((k, x._deep(mode)) for k, x in self.props))

    def deep_strip(self) -> Schema:
        return self._deep("strip")

    def deep_strict(self) -> Schema:
        return self._deep("strict")

    def no_validation(self, off: bool = True) -> Schema:
        return replace(self, validates=not off)

    def error_message(self, text: str) -> Schema:
        return replace(self, messages=(*self.messages, ("_", text)))

    def with_meta(self, **meta: Any) -> Schema:
        """name, title, description, deprecated, examples and own keys. Examples are given in output form and kept in
        input form; a bad one raises, and where the input form can't be worked out without Spark there are none."""
        if "examples" in meta:
            for x in meta["examples"]:
                constants.checked(self, x)
            try:
                meta["examples"] = [constants.encoded(self, x) for x in meta["examples"]]
            except constants.Unknown:
                del meta["examples"]
        if "name" in meta:
            return replace(self, name=meta["name"], meta=tuple({**dict(self.meta), **meta}.items()))
        return replace(self, meta=tuple({**dict(self.meta), **meta}.items()))

    def brand(self, name: str) -> Schema:
        return replace(self, name=name)

    def get_meta(self, key: str) -> Any:
        return dict(self.meta).get(key)

    def shaped(self, make: Callable) -> Schema:
        """The output in another static arrangement, made by a function of a place."""
        return self._at_output(lambda s: replace(s, shape=make(Place(()))))

    # --- text ----------------------------------------------------------------------------------
    def input_expression(self) -> str:
        return expression(self)

    def output_expression(self) -> str:
        return expression(self.reverse())

    def __str__(self) -> str:
        return f"Schema<{self.input_expression()}, {self.output_expression()}>"


@dataclass(frozen=True)
class Place:
    """A path into a parsed value, by which a shape says where its parts come from."""

    path: tuple[str, ...]

    def __getattr__(self, name: str) -> Place:
        if name.startswith("__"):
            raise AttributeError(name)
        return Place((*self.path, name))

    def __getitem__(self, name: str) -> Place:
        return Place((*self.path, str(name)))


_LOWER, _UPPER = {"gt", "gte"}, {"lt", "lte"}
_PAIRS = (("minLength", "maxLength"), ("minSize", "maxSize"))


def narrowed(s: Schema, key: str, value: Any) -> tuple[tuple[str, Any], ...]:
    """Bounds with one more: the tighter of two on a side stays; what no value can meet raises."""
    allowed = {
        "gt": {"number", "int32", "integer", "port", "bigint", "wide", "date"}, "minLength": {"string", "array", "trimmed"},
        "minSize": {"blob", "file", "bytes"}, "multipleOf": {"number", "int32", "integer", "port", "bigint", "wide"}}
    group = "gt" if key in _LOWER | _UPPER else "minLength" if "Length" in key else "minSize" if "Size" in key else key
    if s.kind not in allowed[group]:
        raise SchemaError(f"{key} is not for {s.input_expression()}")
    have = dict(s.bounds)
    if key in _LOWER | _UPPER:
        side = _LOWER if key in _LOWER else _UPPER
        old = next(((k, v) for k, v in s.bounds if k in side), None)
        if old:
            tighter = value > old[1] if side is _LOWER else value < old[1]
            if not tighter and not (value == old[1] and key in ("gt", "lt")):
                return s.bounds
            have.pop(old[0])
    elif key == "multipleOf" and key in have:
        a, b = have[key], value
        if float(a).is_integer() and float(b).is_integer():
            value = math.lcm(int(a), int(b))
        else:
            scale = 10 ** max(len(f"{x:.12f}".rstrip("0").split(".")[1]) for x in (float(a), float(b)))
            value = math.lcm(round(a * scale), round(b * scale)) / scale
    elif key in have and (value <= have[key] if key.startswith("min") else value >= have[key]):
        return s.bounds
    have[key] = value
    low, high = next(((k, have[k]) for k in ("gt", "gte") if k in have), None), next(((k, have[k]) for k in ("lt", "lte") if k in have), None)
    if low and high and (low[1] > high[1] or low[1] == high[1] and (low[0], high[0]) != ("gte", "lte")):
        raise SchemaError(f"no value is {low[0]} {low[1]} and {high[0]} {high[1]}")
    for a, b in _PAIRS:
        if a in have and b in have and have[a] > have[b]:
            raise SchemaError(f"no value has {a} {have[a]} and {b} {have[b]}")
    return tuple(have.items())


# --- builders ----------------------------------------------------------------------------------
string = Schema("string")
number = Schema("number")
int32 = Schema("int32")
integer = Schema("integer")
port = Schema("port")
bigint = Schema("bigint")  # 38 digits, a decimal
wide_bigint = Schema("wide")  # of any size, as canonical decimal text
boolean = Schema("boolean")
date = Schema("date")
url = Schema("url")
uint8_array = Schema("bytes")
blob = Schema("blob")
file = Schema("file")
json_value = Schema("json")
json_string = Schema("jsonString")
unknown = Schema("unknown")
any_value = unknown
never = Schema("never")
null = Schema("literal", const=None)
undefined = Schema("undefined")
void = undefined
nan = Schema("nan")


def json_string_with_space(space: int) -> Schema:
    return replace(json_string, meta=(("space", space),))


def formatted(name: str) -> Schema:
    if name not in formats.NAMES:
        raise SchemaError(f"no such format: {name}")
    return replace(string, format=name)


iso_date_time, iso_date, iso_time, duration = map(formatted, ("date-time", "date", "time", "duration"))
email, idn_email, uuid, cuid = map(formatted, ("email", "idn-email", "uuid", "cuid"))
uri, uri_reference, uri_template = map(formatted, ("uri", "uri-reference", "uri-template"))
iri, iri_reference, hostname, idn_hostname = map(formatted, ("iri", "iri-reference", "hostname", "idn-hostname"))
ipv4, ipv6, json_pointer, relative_json_pointer = map(formatted, ("ipv4", "ipv6", "json-pointer", "relative-json-pointer"))


def literal(value: Any) -> Schema:
    if value is ABSENT:
        return undefined
    if isinstance(value, float) and math.isnan(value):
        return nan
    if not isinstance(value, (str, bool, int, float, type(None))):
        raise SchemaError(f"{value!r} is no literal of data")
    return Schema("literal", const=value)


def as_schema(x: Any) -> Schema:
    """Schemas stay; dicts are objects, lists and tuples are tuples, other values literals."""
    if isinstance(x, Schema):
        return x
    if isinstance(x, dict):
        return Schema("object", props=tuple((k, as_schema(v)) for k, v in x.items()), extras=DEFAULTS["extras"])
    if isinstance(x, (list, tuple)):
        return Schema("tuple", items=tuple(map(as_schema, x)), extras="strict")
    return literal(x)


schema = as_schema


class _Definer:
    """What object() hands to its function: it notes fields and gives their places."""

    def __init__(self, at: tuple[str, ...] = ()) -> None:
        self.props: dict[str, Schema] = {}
        self.inner: dict[str, _Definer] = {}
        self.at = at

    def field(self, name: str, kind: Any) -> Place:
        if name in self.props or name in self.inner:
            raise SchemaError(f"the field {name} is defined twice")
        self.props[name] = as_schema(kind)
        return Place((*self.at, name))

    def field_or(self, name: str, kind: Any, default: Any) -> Place:
        return self.field(name, optional(kind, default))

    def tag(self, name: str, value: Any) -> None:
        self.field(name, literal(value))

    def nested(self, name: str) -> _Definer:
        if name in self.props:
            raise SchemaError(f"the field {name} is defined twice")
        return self.inner.setdefault(name, _Definer((*self.at, name)))

    def flatten(self, other: Any) -> Any:
        other = as_schema(other)
        if other.kind != "object":
            raise SchemaError("only objects can be flattened")
        for name, kind in other.props:
            if self.props.setdefault(name, kind) != kind:
                raise SchemaError(f"the field {name} is defined twice with different schemas")
        return other.shape if other.shape is not None else {name: Place((*self.at, name)) for name, _ in other.props}

    def made(self) -> Schema:
        inner = {k: v.made() for k, v in self.inner.items()}
        return Schema("object", props=(*self.props.items(), *inner.items()), extras=DEFAULTS["extras"])


def object_(definition: Any) -> Schema:
    """An object by a dict of fields, or by a function of a definer that returns the output's shape."""
    if not callable(definition):
        return as_schema(definition)
    definer = _Definer()
    shape = definition(definer)
    return replace(definer.made(), shape=shape)


def tuple_(definition: Any) -> Schema:
    """A tuple by a list, or by a function of a definer with item(i, schema) and tag(i, value)."""
    if not callable(definition):
        return as_schema(tuple(definition))
    found: dict[int, Schema] = {}

    class Definer:
        def item(self, i: int, kind: Any) -> Place:
            if i in found:
                raise SchemaError(f"the item {i} is defined twice")
            found[i] = as_schema(kind)
            return Place((str(i),))

        def tag(self, i: int, value: Any) -> None:
            self.item(i, literal(value))

    shape = definition(Definer())
    return Schema("tuple", items=tuple(found.get(i, undefined) for i in range(max(found, default=-1) + 1)), extras="strict", shape=shape)


def array(item: Any) -> Schema:
    return Schema("array", items=(as_schema(item),))


list_ = array


def record(value: Any) -> Schema:
    return Schema("record", items=(as_schema(value),))


def optional(kind: Any, default: Any = ABSENT) -> Schema:
    kind = as_schema(kind)
    if kind.kind == "optional" and default is ABSENT:
        return kind
    return _with_default(Schema("optional", items=(kind,)), default)


def _with_default(s: Schema, default: Any) -> Schema:
    """The schema with a default of its output type, a value or a function that returns a column."""
    if default is not ABSENT and default is not None and not callable(default):
        try:
            constants.checked(s.items[0], default)
        except SchemaError as e:
            raise SchemaError(f"Invalid default for {expression(s)}: {e.reason}") from None
    return replace(s, default=default)


option = optional


def nullable(kind: Any, default: Any = ABSENT) -> Schema:
    return _with_default(Schema("nullable", items=(as_schema(kind),)), default)


def nullish(kind: Any, default: Any = ABSENT) -> Schema:
    return _with_default(Schema("nullish", items=(as_schema(kind),)), default)


def null_as_option(kind: Any) -> Schema:
    """null, decoded as absence."""
    return nullable(kind)


nullable_as_option = nullish


def union(*arms: Any) -> Schema:
    arms = arms[0] if len(arms) == 1 and isinstance(arms[0], (list, tuple)) else arms
    flat: list[Schema] = []
    for arm in map(as_schema, arms):
        flat += arm.arms if arm.kind == "union" and not (arm.to or arm.checks or arm.name) else [arm]
    if not flat:
        raise SchemaError("a union needs an arm")
    return flat[0] if len(flat) == 1 else Schema("union", arms=tuple(flat))


any_of = union


def enum(values: list) -> Schema:
    return union([literal(v) for v in values])


def merge(a: Schema, b: Schema) -> Schema:
    """The fields of both, those of b first in right; the extras mode is a's. A document requires all keys."""
    if a.kind != "object" or b.kind != "object" or a.to or b.to or a.shape is not None or b.shape is not None:
        raise SchemaError("only plain objects can be merged")
    props = {**dict(a.props), **dict(b.props)}
    return replace(a, props=tuple(props.items()), required=tuple(props), checks=(), input_checks=(), meta=(), name=None)


def compact_columns(rows: Schema) -> Schema:
    """An array of columns, read as an array of rows of the object rows."""
    if rows.kind != "object":
        raise SchemaError("compact columns need an object schema for their rows")
    return Schema("compactColumns", items=(rows,))


def recursive(name: str, make: Callable[[Schema], Schema]) -> Schema:
    """A schema that refers to itself through the argument of make."""
    hole = Schema("ref", ref=name)
    body = make(hole)
    hole.defs[name] = body
    return Schema("ref", ref=name, defs=hole.defs)


def instance(kind: str) -> Schema:
    """The classes that are data: Date, URL, Uint8Array, Blob, File."""
    known = {"Date": date, "URL": url, "Uint8Array": uint8_array, "Blob": blob, "File": file}
    if kind not in known:
        raise SchemaError(f"{kind} is not data", "unsupported_decode")
    return known[kind]


def symbol(*_: Any) -> Schema:
    raise SchemaError("symbols are not data", "unsupported_decode")


# --- text --------------------------------------------------------------------------------------
def literal_text(value: Any) -> str:
    if isinstance(value, float):
        return "Infinity" if value == math.inf else "-Infinity" if value == -math.inf else f"{value:.15g}"
    return json.dumps(value, ensure_ascii=False)


_TEXT = {"wide": "bigint", "date": "Date", "bytes": "Uint8Array", "url": "URL", "blob": "Blob", "file": "File", "json": "JSON",
         "jsonString": "JSON string", "nan": "NaN", "trimmed": "string"}
_FORMAT_TEXT = {"date-time": "UTC date-time"}


def expression(s: Schema) -> str:
    """The input type as text."""
    if s.name:
        return s.name
    if s.kind == "literal":
        text = literal_text(s.const)
    elif s.kind in ("array", "record"):
        inner = expression(s.items[0])
        inner = f"({inner})" if " | " in inner and s.kind == "array" else inner
        text = f"{inner}[]" if s.kind == "array" else f"{{ [key: string]: {inner}; }}"
    elif s.kind == "tuple":
        text = f"[{', '.join(map(expression, s.items))}]"
    elif s.kind == "object":
        text = "{ " + " ".join(f"{k}: {expression(v)};" for k, v in s.props) + " }" if s.props else "{}"
    elif s.kind == "union":
        text = " | ".join(dict.fromkeys(map(expression, s.arms)))
    elif s.kind in ("optional", "nullable", "nullish"):
        text = expression(s.items[0]) + {"optional": " | undefined", "nullable": " | null", "nullish": " | undefined | null"}[s.kind]
    elif s.kind == "compactColumns":
        text = f"[{', '.join('unknown[]' for _ in s.items[0].props)}]"
    elif s.kind == "ref":
        text = s.ref or "ref"
    elif s.format:
        text = _FORMAT_TEXT.get(s.format, s.format)
    else:
        text = _TEXT.get(s.kind, s.kind)
    return bounded(text, s)


def bounded(text: str, s: Schema) -> str:
    """The type's text with its bounds around it."""
    b = dict(s.bounds)
    sign = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
    said = [f"{sign[k]} {literal_text(b[k]) if not hasattr(b[k], 'isoformat') else b[k].isoformat()}" for k in ("gt", "gte", "lt", "lte") if k in b]
    for low, high, what in (("minLength", "maxLength", "length"), ("minSize", "maxSize", "size")):
        if low in b and b.get(low) == b.get(high):
            said.append(f"{what} {b[low]}")
        else:
            said += [f"{what} >= {b[low]}"] if low in b else []
            said += [f"{what} <= {b[high]}"] if high in b else []
    if "multipleOf" in b:
        said.append(f"multiple of {literal_text(b['multipleOf'])}")
    return f"{text} ({', '.join(said)})" if said else text


def never_() -> Schema:
    return never
