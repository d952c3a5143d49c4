"""Single Python values against schemas, on the driver, while a schema is made: defaults and examples.

`checked` says why a value is none of a schema's type, `encoded` gives the input form of an output value. Both work
without a session, so what only Spark can run (coders, refinements by columns, formats) is not looked at: `encoded`
raises Unknown there, and the caller leaves the value out, as metadata is no operation.
"""

from __future__ import annotations

import datetime
import json
import math
import re
from typing import TYPE_CHECKING, Any

from . import patterns
from .errors import SchemaError

if TYPE_CHECKING:
    from .schema import Schema


class Unknown(Exception):
    """What can't be worked out without Spark."""


_INTEGERS = {"int32": (-2147483648, 2147483647), "port": (0, 65535), "integer": (-math.inf, math.inf)}


def shown(value: Any) -> str:
    from .schema import ABSENT

    if value is ABSENT:
        return "undefined"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return "Date"
    if isinstance(value, bytes):
        return "Uint8Array"
    return json.dumps(value, ensure_ascii=False) if not isinstance(value, float) else number(value)


def number(x: float) -> str:
    """A number as JavaScript writes it."""
    if isinstance(x, int) or float(x).is_integer() and abs(x) < 1e21:
        return str(int(x))
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    text = repr(float(x))
    if abs(x) >= 1e-6 and "e-" in text:
        return f"{x:.20f}".rstrip("0")
    return re.sub(r"e([+-])0+(\d)", r"e\1\2", text)


def _is(s: Schema, v: Any) -> bool:
    from .schema import ABSENT

    k, plain = s.kind, isinstance(v, (int, float)) and not isinstance(v, bool)
    if k in ("unknown", "ref"):
        return True
    if k == "json":
        return _json(v)
    if k == "literal":
        return type(v) is type(s.const) and v == s.const or plain and isinstance(s.const, (int, float)) and not isinstance(s.const, bool) and v == s.const
    if k in _INTEGERS:
        return plain and float(v).is_integer() and _INTEGERS[k][0] <= v <= _INTEGERS[k][1]
    if k == "number":
        return plain and not (isinstance(v, float) and math.isnan(v))
    if k == "nan":
        return isinstance(v, float) and math.isnan(v)
    if k in ("bigint", "wide"):
        return isinstance(v, int) and not isinstance(v, bool)
    if k == "undefined":
        return v is ABSENT
    types = {"string": str, "trimmed": str, "url": str, "jsonString": str, "boolean": bool, "date": (datetime.datetime, datetime.date), "bytes": bytes, "blob": bytes,
             "array": (list, tuple), "tuple": (list, tuple), "object": dict, "record": dict, "compactColumns": (list, tuple)}
    return isinstance(v, types[k]) if k in types else False


def _json(v: Any) -> bool:
    if isinstance(v, dict):
        return all(isinstance(k, str) and _json(x) for k, x in v.items())
    return all(map(_json, v)) if isinstance(v, (list, tuple)) else v is None or isinstance(v, (str, bool, int)) or isinstance(v, float) and math.isfinite(v)


def _within(s: Schema, v: Any) -> bool:
    for key, limit in s.bounds:
        n = len(v.encode("utf-16-le")) // 2 if isinstance(v, str) and not s.code_points else len(v) if hasattr(v, "__len__") else 0
        ok = {"gt": lambda: v > limit, "gte": lambda: v >= limit, "lt": lambda: v < limit, "lte": lambda: v <= limit, "minLength": lambda: n >= limit, "maxLength": lambda: n <= limit,
              "minSize": lambda: n >= limit, "maxSize": lambda: n <= limit, "multipleOf": lambda: _multiple(v, limit), "pattern": lambda: _matches(limit, v)}[key]()
        if not ok:
            return False
    return True


def _multiple(x: float, of: float) -> bool:
    ratio = x / of
    return abs(ratio - round(ratio)) < 1e-9 * max(1.0, abs(ratio))


def _matches(pattern: str, v: str) -> bool:
    """Java's form of a pattern is Python's too, but for code points and some properties."""
    text = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", patterns.java(*patterns.parted(pattern))).replace("\\z", "\\Z")
    try:
        return re.search(text, v) is not None
    except re.error:
        return True  # left to Spark


def checked(s: Schema, v: Any, path: tuple = ()) -> None:
    """Raise SchemaError if v is no value of the output of s."""
    from .schema import ABSENT, expression

    s = s.output
    if s.kind in ("optional", "nullable", "nullish"):
        if v is ABSENT and s.kind != "nullable" or v is None and s.kind != "optional" or v is None and s.kind == "optional":
            return
        checked(s.items[0], v, path)
        return
    if s.kind == "union":
        for a in s.arms:
            try:
                checked(a, v, path)
                return
            except SchemaError:
                continue
        raise _fault(f"Expected {expression(s)}, received {shown(v)}", path)
    if not _is(s, v) or s.kind == "tuple" and len(v) != len(s.items) or not _within(s, v):
        raise _fault(f"Expected {expression(s)}, received {shown(v)}", path)
    if s.kind in ("array", "record"):
        for k, x in enumerate(v) if s.kind == "array" else v.items():
            checked(s.items[0], x, (*path, str(k)))
    if s.kind == "tuple":
        for i, (a, x) in enumerate(zip(s.items, v, strict=True)):
            checked(a, x, (*path, str(i)))
    if s.kind == "object" and s.shape is None:
        for k, x in s.props:
            checked(x, v.get(k, ABSENT), (*path, k))
        extra = [k for k in v if k not in dict(s.props)]
        if extra and s.extras == "strict":
            raise _fault(f"Unrecognized key {json.dumps(extra[0])}", path)


def _fault(reason: str, path: tuple) -> SchemaError:
    at = "".join(f"[{json.dumps(p)}]" for p in path)
    return SchemaError(f"Failed at {at}: {reason}" if path else reason, "invalid_input")


def encoded(s: Schema, v: Any) -> Any:
    """The input form of a value of the output of s."""
    nodes = s.chain
    value = _inside(nodes[-1], v)
    for i in range(len(nodes) - 1, 0, -1):
        link = nodes[i - 1].coder
        if link is not None and link.encode != "auto":
            raise Unknown
        value = _back(nodes[i], nodes[i - 1], value)
    return value


def _inside(s: Schema, v: Any) -> Any:
    from .schema import ABSENT

    if s.kind in ("optional", "nullable", "nullish"):
        return v if v is None or v is ABSENT else encoded(s.items[0], v)
    if s.kind == "union":
        for a in s.arms:
            try:
                checked(a, v)
            except SchemaError:
                continue
            return encoded(a, v)
        raise Unknown
    if s.kind == "array":
        return [encoded(s.items[0], x) for x in v]
    if s.kind == "record":
        return {k: encoded(s.items[0], x) for k, x in v.items()}
    if s.kind == "tuple":
        return [encoded(a, x) for a, x in zip(s.items, v, strict=True)]
    if s.kind == "object":
        if s.shape is not None:
            raise Unknown
        return {k: encoded(x, v[k]) for k, x in s.props if k in v}
    return v


def _back(a: Schema, b: Schema, v: Any) -> Any:
    """A value of the node a as one of the node b before it."""
    p, q = a.kind, b.kind
    if q in ("string", "trimmed"):
        if p in ("string", "trimmed", "url"):
            return v
        if isinstance(v, bool) or p == "boolean":
            return "true" if v else "false"
        if p == "literal":
            return v if isinstance(v, str) else "null" if v is None else number(v)
        if p in ("number", "integer", "int32", "port", "bigint", "wide"):
            return number(v)
        if p == "date":
            return v.astimezone(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{v.microsecond // 1000:03d}Z" if isinstance(v, datetime.datetime) and v.tzinfo else f"{v:%Y-%m-%dT%H:%M:%S}.000Z"
        if p in ("bytes", "blob"):
            return v.decode("utf-8", "replace")
    if q == "jsonString":
        return json.dumps(_jsonable(v), ensure_ascii=False, separators=(",", ":"))
    if q == "json":
        return _jsonable(v)
    if q == "literal":
        return b.const
    if p == q or {p, q} <= {"number", "integer", "int32", "port", "bigint"} or q == "unknown":
        return v
    raise Unknown


def _jsonable(v: Any) -> Any:
    if isinstance(v, dict):
        return {k: _jsonable(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_jsonable(x) for x in v]
    if isinstance(v, float) and v.is_integer():
        return int(v)
    if v is None or isinstance(v, (str, bool, int, float)):
        return v
    raise Unknown
