"""JSON Schema documents from schemas and schemas from documents (draft-07, 2020-12, OpenAPI 3.0).

The input side of a schema is described. An imported document describes JSON values: keywords that
have no row-local form are rejected when it is read, before any job.
"""

from __future__ import annotations

import json
from dataclasses import replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants, formats, patterns
from . import schema as S
from .plans import Compiler
from .schema import ABSENT, Check, Schema, SchemaError

DIALECTS = {"draft-07": "http://json-schema.org/draft-07/schema#", "draft-2020-12": "https://json-schema.org/draft/2020-12/schema", "openapi-3.0": None}

# Keywords of the JSON Schema specifications, in the order of their vocabularies, whose meaning
# a value-local mapping can't keep.
REJECTED = (
    "$dynamicRef", "$recursiveRef",
    "dependentSchemas", "contains", "patternProperties", "propertyNames", "dependencies",
    "unevaluatedItems", "unevaluatedProperties",
    "uniqueItems", "maxContains", "minContains", "maxProperties", "minProperties", "dependentRequired")

_NUMBER_KEYS = {"gte": "minimum", "gt": "exclusiveMinimum", "lte": "maximum", "lt": "exclusiveMaximum", "multipleOf": "multipleOf"}


# --- export ------------------------------------------------------------------------------------
def to_json_schema(s: Any, target: str | None = None) -> dict:
    """The document of the input side; `$schema` only where a target is named."""
    if target is not None and target not in DIALECTS:
        raise SchemaError(f"no such target: {target}")
    s = S.as_schema(s)
    defs: dict[str, dict] = {}
    out = _emit(s, target or "draft-07", (), defs)
    if defs:
        out["definitions" if (target or "draft-07") == "draft-07" else "$defs"] = defs
    if target and DIALECTS[target]:
        out = {"$schema": DIALECTS[target], **out}
    return out


def extend_json_schema(s: Schema, keywords: dict) -> Schema:
    """The schema, whose document also has these keywords."""
    return replace(s, extension=tuple({**dict(s.extension), **keywords}.items()))


def _bad(s: Schema, path: tuple) -> SchemaError:
    at = f"Failed at {''.join(f'[{json.dumps(p)}]' for p in path)}: " if path else ""
    return SchemaError(f"{at}Expected JSON, received {S.expression(s)}")


def _emit(s: Schema, target: str, path: tuple, defs: dict) -> dict:
    out = _base(s, target, path, defs)
    meta = dict(s.meta)
    for key in ("title", "description", "deprecated"):
        if key in meta:
            out[key] = meta[key]
    if "examples" in meta:
        out["examples"] = list(meta["examples"])
    return {**out, **dict(s.extension)}


def _default_form(s: Schema) -> Any:
    """The default of a schema as its document has it, in input form; absent if there is none or it can't be told."""
    if s.default is ABSENT or s.default is None or callable(s.default):
        return ABSENT
    try:
        return constants.encoded(s.items[0], s.default)
    except constants.Unknown:
        return ABSENT


def _base(s: Schema, target: str, path: tuple, defs: dict) -> dict:
    k, b, openapi = s.kind, dict(s.bounds), target == "openapi-3.0"
    if k in ("string", "trimmed", "jsonString"):
        out: dict = {"type": "string"}
        out |= {x: b[x] for x in ("minLength", "maxLength") if x in b}
        if s.format and s.format != "cuid":  # no format of the specifications
            out["format"] = s.format
        if "pattern" in b:
            out["pattern"] = patterns.parted(b["pattern"])[0]
        if k == "jsonString" and not openapi:  # OpenAPI 3.0 has no content keywords, draft-07 no contentSchema
            out["contentMediaType"] = "application/json"
            if s.to is not None and target == "draft-2020-12":
                try:
                    content = _emit(s.to, target, path, defs)
                except SchemaError:  # a content without a schema is not described
                    content = {}
                out |= {"contentSchema": content} if content else {}
        return out
    if k in ("number", "int32", "integer", "port"):
        out = {"type": "number" if k == "number" else "integer"}
        if k == "port":
            out |= {"minimum": 0, "maximum": 65535}
        for key, name in _NUMBER_KEYS.items():
            if key in b:
                if openapi and key in ("gt", "lt"):
                    out |= {"minimum" if key == "gt" else "maximum": b[key], name: True}
                else:
                    out[name] = b[key]
        return out
    if k == "boolean":
        return {"type": "boolean"}
    if k == "literal":
        if s.const is None:
            return {"nullable": True} if openapi else {"type": "null"}
        kind = "boolean" if isinstance(s.const, bool) else "string" if isinstance(s.const, str) else "number"
        return {"type": kind, "enum": [s.const]} if openapi else {"type": kind, "const": s.const}
    if k in ("json", "unknown"):
        return {}
    if k == "never":
        return {"not": {}}
    if k == "array":
        out = {"type": "array", "items": _emit(s.items[0], target, (*path, "[]"), defs)}
        return out | {name: b[key] for key, name in (("minLength", "minItems"), ("maxLength", "maxItems")) if key in b}
    if k == "tuple":
        items = [_emit(x, target, (*path, str(i)), defs) for i, x in enumerate(s.items)]
        n = len(items)
        if openapi:
            return {"type": "array", "items": {"anyOf": items} if items else {}, "minItems": n, "maxItems": n}
        if target == "draft-2020-12":
            return {"type": "array", "prefixItems": items, "minItems": n, **({"items": False, "maxItems": n} if s.extras == "strict" else {})}
        return {"type": "array", "items": items, "minItems": n, **({"additionalItems": False, "maxItems": n} if s.extras == "strict" else {})}
    if k == "object":
        props, required = {}, []
        for name, x in s.props:
            inner = x
            if x.kind == "optional":
                props[name] = _emit(x.items[0], target, (*path, name), defs)
                if (default := _default_form(x)) is not ABSENT:
                    props[name]["default"] = default
                continue
            if x.kind == "undefined":
                continue
            props[name] = _emit(inner, target, (*path, name), defs)
            if x.kind != "nullish":
                required.append(name)
        out = {"type": "object", "properties": props}
        if s.extras == "strict":
            out["additionalProperties"] = False
        required = [n for n in s.required if n in props] if s.required is not None else required
        if required:
            out["required"] = required
        return out
    if k == "record":
        return {"type": "object", "additionalProperties": _emit(s.items[0], target, (*path, "{}"), defs)}
    if k == "nullable" or k == "nullish":
        inner = _emit(s.items[0], target, path, defs)
        out = {**inner, "nullable": True} if openapi else {"anyOf": [inner, {"type": "null"}]}
        return {"default": default, **out} if (default := _default_form(s)) is not ABSENT else out
    if k == "union":
        arms = [a for a in s.arms if a.kind not in ("undefined", "never")]
        if arms and all(a.kind == "literal" and a.const is not None and not a.to for a in arms):
            kinds = list(dict.fromkeys("boolean" if isinstance(a.const, bool) else "string" if isinstance(a.const, str) else "number" for a in arms))
            return {**({"type": kinds[0]} if len(kinds) == 1 else {}), "enum": [a.const for a in arms]}
        return {"anyOf": [_emit(a, target, path, defs) for a in arms]}
    if k == "ref":
        where = "definitions" if target == "draft-07" else "$defs"
        if s.ref in s.defs and s.ref not in defs:
            defs[s.ref] = {}
            defs[s.ref] = _emit(s.defs[s.ref], target, path, defs)
        return {"$ref": f"#/{where}/{s.ref}"}
    if k == "compactColumns":
        return {"type": "array", "items": {"type": "array"}, "minItems": len(s.items[0].props), "maxItems": len(s.items[0].props)}
    raise _bad(s, path)


# --- import ------------------------------------------------------------------------------------
_TYPES = {"string": S.string, "number": S.number, "integer": S.integer, "boolean": S.boolean, "null": S.null}
_OWN_KEYS = {
    "string": ("minLength", "maxLength", "pattern", "format"),
    "number": ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"),
    "object": ("properties", "required", "additionalProperties"),
    "array": ("items", "prefixItems", "additionalItems", "minItems", "maxItems")}


def from_json_schema(document: dict | bool) -> Schema:
    return _Reader(document).read(document)


def passes(s: Schema, defs: dict | None = None) -> Any:
    """A predicate on VARIANT columns: does a JSON value pass the schema?"""
    def test(v: Column) -> Column:
        error = Compiler(None, defs).parse(s, v, "json").error
        return F.lit(True) if error is None else error.isNull()

    return test


class _Reader:
    def __init__(self, root: Any) -> None:
        self.root = root
        said = root.get("$schema", "") if isinstance(root, dict) else ""
        self.siblings = "2019-09" in said or "2020-12" in said
        self.open: list[str] = []
        self.recursive: set[str] = set()
        self.defs: dict[str, Schema] = {}

    def resolve(self, ref: str) -> Any:
        if not ref.startswith("#"):
            raise SchemaError(f"only local references can be followed: {ref}")
        node = self.root
        for part in ref[1:].split("/")[1:]:
            part = part.replace("~1", "/").replace("~0", "~").replace("%25", "%").replace("%22", '"')
            try:
                node = node[int(part)] if isinstance(node, list) else node[part]
            except (KeyError, ValueError, IndexError, TypeError):
                raise SchemaError(f"nothing is at {ref}") from None
        return node

    def read(self, d: Any) -> Schema:
        if d is True:
            return S.json_value
        if d is False:
            return S.never
        if not isinstance(d, dict):
            raise SchemaError(f"{d!r} is no JSON Schema")
        for key in REJECTED:
            if key in d:
                raise SchemaError(f"the keyword {key} is not supported")
        if "$ref" in d:
            out = self.reference(d["$ref"])
            rest = {k: v for k, v in d.items() if k not in ("$ref", "$schema", "$defs", "definitions", "$id", "title", "description")}
            if self.siblings and rest:
                out = replace(S.json_value, input_checks=(Check(passes(out, self.defs), "Should pass the referenced schema"), Check(passes(self.read(rest), self.defs), "Should pass the schema beside the reference")))
            return out
        out = self.composed(d, self.constants(d, self.base(d)))
        if d.get("nullable"):
            out = S.nullable(out)
        if "default" in d:
            out = out.with_meta(default=d["default"])
        meta = {k: d[k] for k in ("title", "description", "deprecated") if k in d}
        out = out.with_meta(**meta) if meta else out
        # A document's examples are in input form already.
        return replace(out, meta=(*out.meta, ("examples", d["examples"]))) if "examples" in d else out

    def reference(self, ref: str) -> Schema:
        if ref in self.open:
            if self.open[-1] == ref:
                raise SchemaError(f"{ref} refers to itself alone")
            self.recursive.add(ref)
            return Schema("ref", ref=ref, defs=self.defs)
        target = self.resolve(ref)
        self.open += [ref, "#in"]
        try:
            found = self.read(target) if not (isinstance(target, dict) and target.get("$ref") == ref) else None
        finally:
            self.open = self.open[:-2]
        if found is None:
            raise SchemaError(f"{ref} refers to itself alone")
        if ref in self.recursive:
            self.defs[ref] = found
            return Schema("ref", ref=ref, defs=self.defs)
        return found

    def base(self, d: dict) -> Schema:
        kind = d.get("type")
        if isinstance(kind, list):
            return S.union([self.typed(k, d) for k in kind]) if kind else S.never
        if kind is not None:
            return self.typed(kind, d)
        own = [k for k, keys in _OWN_KEYS.items() if any(x in d for x in keys)]
        if not own:
            return S.json_value
        # Keywords constrain their own type alone; other JSON passes.
        checks = []
        tags = {"string": "^STRING", "number": r"^(?:BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)", "object": "^OBJECT", "array": "^ARRAY"}
        for k in own:
            test, tag = passes(self.typed(k, d), self.defs), tags[k]
            checks.append(Check(lambda v, test=test, tag=tag: ~F.coalesce(F.schema_of_variant(v).rlike(tag), F.lit(False)) | test(v), f"Should pass the keywords of {k}"))
        return replace(S.json_value, input_checks=tuple(checks))

    def typed(self, kind: str, d: dict) -> Schema:
        if kind in ("number", "integer"):
            s, low, high = _TYPES[kind], d.get("exclusiveMinimum"), d.get("exclusiveMaximum")
            try:
                if low is True or high is True:  # draft-04 and OpenAPI
                    s = s.gt(d["minimum"]) if low is True else s.gte(d["minimum"]) if "minimum" in d else s
                    return s.lt(d["maximum"]) if high is True else s.lte(d["maximum"]) if "maximum" in d else s
                for key, name in _NUMBER_KEYS.items():
                    if name in d and not isinstance(d[name], bool):
                        s = s.bound(key, d[name])
                return s
            except SchemaError:
                return S.never
        if kind == "string":
            s = replace(S.string, code_points=True)
            try:
                if "minLength" in d:
                    s = s.min_length(d["minLength"])
                if "maxLength" in d:
                    s = s.max_length(d["maxLength"])
            except SchemaError:
                return S.never
            if "pattern" in d:
                try:  # by the specification, with the grammar of Unicode mode
                    s = s.pattern(d["pattern"], flags="u")
                except SchemaError:
                    s = s.pattern(d["pattern"])
            return replace(s, format=d["format"]) if d.get("format") in formats.NAMES else s
        if kind == "object":
            return self.object(d)
        if kind == "array":
            return self.array(d)
        if kind not in _TYPES:
            raise SchemaError(f"no such type: {kind}")
        return _TYPES[kind]

    def object(self, d: dict) -> Schema:
        props = {k: self.read(v) for k, v in d.get("properties", {}).items()}
        required, extra = d.get("required", []), d.get("additionalProperties", True)
        if not props and not required and isinstance(extra, dict):
            return S.record(self.read(extra))
        fields = {}
        for k, v in props.items():
            fields[k] = v if k in required else S.optional(v, self.default(v))
        s = S.object_(fields)
        s = s.strict() if extra is False else s
        checks = [Check(lambda v, k=k: F.try_variant_get(v, '$["' + k.replace('"', '\\"') + '"]', "variant").isNotNull(), f"Missing required property {json.dumps(k)}") for k in required if k not in props]
        if isinstance(extra, dict):
            test = passes(self.read(extra), self.defs)
            names = list(props)
            checks.append(Check(lambda v: F.forall(F.map_entries(F.map_filter(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, _: ~k.isin(*names) if names else F.lit(True))),
                                                   lambda e: test(e["value"])), "Additional properties should pass their schema"))
        return replace(s, input_checks=tuple(checks)) if checks else s

    def default(self, s: Schema) -> Any:
        """The default of a property as its schema reads it; one that is of another type stays a mere note."""
        value = dict(s.meta).get("default")
        if value is None or not _fits(s, value):
            return ABSENT
        if not isinstance(value, (dict, list)):
            return value
        text, defs = json.dumps(value), self.defs
        return lambda: Compiler(None, defs).parse(s, F.parse_json(F.lit(text)), "json").value

    def array(self, d: dict) -> Schema:
        prefix = d.get("prefixItems") if "prefixItems" in d else d.get("items") if isinstance(d.get("items"), list) else None
        low, high = d.get("minItems"), d.get("maxItems")
        if low is not None and high is not None and low > high:
            return S.never
        if prefix is None:
            s = S.array(self.read(d.get("items", True)))
            s = s.min_length(low) if low is not None else s
            return s.max_length(high) if high is not None else s
        rest = d.get("items" if "prefixItems" in d else "additionalItems", True)
        if rest is False and (low or 0) == len(prefix):
            return S.as_schema([self.read(x) for x in prefix])
        tests = [passes(self.read(x), self.defs) for x in prefix]
        after = passes(self.read(rest), self.defs)
        n = len(prefix)

        def test(v: Column) -> Column:
            items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
            ok = F.forall(F.slice(items, n + 1, 1 << 30), after) if rest is not True else F.lit(True)
            for i, t in enumerate(tests):
                ok = ok & ((F.size(items) <= i) | t(F.get(items, F.lit(i))))
            return ok

        s = replace(S.array(S.json_value), input_checks=(Check(test, "Items should pass their schemas"),))
        s = s.min_length(low) if low is not None else s
        return s.max_length(high) if high is not None else s

    def constants(self, d: dict, s: Schema) -> Schema:
        values = [d["const"]] if "const" in d else d.get("enum")
        if values is None:
            return s
        if all(not isinstance(v, (dict, list)) for v in values) and s == S.json_value:
            return S.union([S.literal(v) for v in values]) if values else S.never
        test = passes(s, self.defs)

        def equal(v: Column) -> Column:
            ok = F.lit(False)
            for value in values:
                ok = ok | _equals(v, value)
            return ok & test(v)

        plain = {str: "string", bool: "boolean", int: "number", float: "number"}
        kinds = {plain.get(type(v)) for v in values}
        if s.kind in ("string", "number", "integer", "boolean") and kinds <= {"string", "number", "boolean"}:
            own = [v for v in values if plain[type(v)] == ("number" if s.kind == "integer" else s.kind)]
            return replace(s, input_checks=(*s.input_checks, Check(equal, f"Expected {' | '.join(map(S.literal_text, own))}"))) if own else S.never
        return replace(s, input_checks=(*s.input_checks, Check(equal, "Should equal one of the constants")))

    def composed(self, d: dict, s: Schema) -> Schema:
        checks: list[Check] = []
        plain = s == S.json_value
        if "anyOf" in d and plain and not any(k in d for k in ("allOf", "oneOf", "not", "if")):
            return S.union([self.read(x) for x in d["anyOf"]])
        for x in d.get("allOf", []):
            checks.append(Check(passes(self.read(x), self.defs), "Should pass all schemas according to the allOf property"))
        if "anyOf" in d:
            tests = [passes(self.read(x), self.defs) for x in d["anyOf"]]
            checks.append(Check(lambda v: _count(tests, v) >= 1, "Should pass at least one schema according to the anyOf property"))
        if "oneOf" in d:
            ones = [passes(self.read(x), self.defs) for x in d["oneOf"]]
            checks.append(Check(lambda v: _count(ones, v) == 1, "Should pass single schema according to the oneOf property"))
        if "not" in d:
            bad = passes(self.read(d["not"]), self.defs)
            checks.append(Check(lambda v: ~bad(v), "Should NOT be valid against schema in the not property"))
        if "if" in d:
            when = passes(self.read(d["if"]), self.defs)
            then, other = (passes(self.read(d.get(k, True)), self.defs) for k in ("then", "else"))
            checks.append(Check(lambda v: F.when(when(v), then(v)).otherwise(other(v)), "Should pass the schema of its branch"))
        return replace(s, input_checks=(*s.input_checks, *checks)) if checks else s


def _fits(s: Schema, value: Any) -> bool:
    """Is a JSON value of the schema's type?"""
    k = s.kind
    if k in ("json", "unknown", "ref"):
        return True
    if k == "union":
        return any(_fits(a, value) for a in s.arms)
    if k in ("nullable", "nullish", "optional"):
        return value is None or _fits(s.items[0], value)
    if k == "literal":
        return s.const == value and isinstance(s.const, bool) == isinstance(value, bool)
    if k in ("number", "integer", "int32", "port"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (k == "number" or float(value).is_integer())
    if k == "array":
        return isinstance(value, list) and all(_fits(s.items[0], x) for x in value)
    if k == "tuple":
        return isinstance(value, list) and len(value) == len(s.items) and all(map(_fits, s.items, value))
    if k == "record":
        return isinstance(value, dict) and all(_fits(s.items[0], x) for x in value.values())
    if k == "object":
        return isinstance(value, dict) and all(_fits(x, value[n]) if n in value else x.kind == "optional" for n, x in s.props)
    return {"string": str, "boolean": bool}.get(k, ()) and isinstance(value, {"string": str, "boolean": bool}[k])


def _equals(v: Column, value: Any) -> Column:
    """Is a VARIANT this JSON value? Numbers count by value, objects without regard to order."""
    tag = lambda pattern: F.coalesce(F.schema_of_variant(v).rlike(pattern), F.lit(False))
    if isinstance(value, dict):
        found = F.try_variant_get(v, "$", "map<string,variant>")
        ok = tag("^OBJECT") & (F.size(found) == len(value))
        for k, x in value.items():
            ok = ok & _equals(F.try_element_at(found, F.lit(k)), x)
    elif isinstance(value, list):
        found = F.try_variant_get(v, "$", "array<variant>")
        ok = tag("^ARRAY") & (F.size(found) == len(value))
        for i, x in enumerate(value):
            ok = ok & _equals(F.get(found, F.lit(i)), x)
    else:
        return F.coalesce(passes(S.literal(value))(v), F.lit(False))
    return F.coalesce(ok, F.lit(False))


def _count(tests: list, v: Column) -> Column:
    total = F.lit(0)
    for t in tests:
        total = total + t(v).cast("int")
    return total
