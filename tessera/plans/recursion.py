"""Recursive schemas without a limit of depth, inside a row and without user functions.

The places where a schema's body refers to a recursive schema are numbered slots. A value is first unfolded level by
level to a list of nodes: each has the slot and path at which its parent holds it, and its children; as many levels as
its JSON text opens brackets, once per schema, are enough, and those that find no nodes cost next to nothing. Then the
nodes are compiled bottom up: the body is one expression, in which a slot reads the child's result instead of going
down. Results wait in a queue until their parent takes them. So expressions grow with the schema, and work with the
nodes of the value; what is copied per level are lists of references, and the text below a node once.

Lambdas are interpreted and share nothing by themselves, so what a body uses again is bound. Where only errors are
asked for and nothing in the schemas reads a converted value, no values are made.

A converted value is a VARIANT, since its type has no end. An absent value at a slot is read as the body reads
absence. A body that reaches itself only behind a check or a conversion is refused.
"""

from __future__ import annotations

import functools
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import bound
from ..schema import Schema, SchemaError, expression
from . import FOUND, WRAPS, Compiler, Options, Out, as_type, at_path, fields_of, label, none, step, type_of

_NODE = "struct<ref:int,slot:int,path:array<string>,v:variant>"
_DONE = f"struct<slot:int,path:array<string>,x:variant,v:variant,e:{FOUND}>"
#: Opening brackets of a text up to which those in strings are not told apart.
FEW = 64
#: Recursive schemas whose bodies are being compiled.
_compiling: list[tuple[int, str]] = []


def _children(s: Schema) -> tuple[Schema, ...]:
    return (*s.items, *(x for _, x in s.props), *s.arms)


def refers(s: Schema) -> bool:
    return s.kind == "ref" or any(map(refers, _children(s)))


def unread(s: Schema, defs: dict[str, Schema], seen: set[str] | None = None) -> bool:
    """Does nothing read the value of a recursive schema in s, so that it need not be made to tell errors?"""
    seen = set() if seen is None else seen
    if s.kind == "ref" and s.ref not in seen:
        seen.add(s.ref)
        defs = {**s.defs, **defs}
        if s.ref in defs and not unread(defs[s.ref], defs, seen):
            return False
    if (s.kind == "ref" or refers(s)) and (s.to is not None or s.bounds or s.format or s.checks or s.input_checks):
        return False
    return all(unread(x, defs, seen) for x in _children(s))


def brackets(v: Column) -> Column:
    """How many brackets the JSON text of a VARIANT opens, at least: with few of them, those in strings count too."""
    opened = lambda t: F.octet_length(t) - F.octet_length(F.replace(F.replace(t, F.lit("{"), F.lit("")), F.lit("["), F.lit("")))
    outside = lambda t: F.regexp_replace(F.replace(F.replace(t, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit("")), r'"[^"]*+"', "")
    known = bound(F.to_json(v), lambda t: bound(opened(t), lambda n: F.when(n > FEW, opened(outside(t))).otherwise(n)))
    return F.coalesce(known, F.lit(0))


class Walk:
    """The compilation of one recursive schema and those it refers to."""

    def __init__(self, defs: dict[str, Schema], options: Options, values: bool = True) -> None:
        self.defs, self.options, self.values = defs, options, values
        self.nest: list[int] = []  # of each slot: the lists and records around it in its body
        self.slots: list[str] = []  # of each slot: what it refers to
        self.bodies: dict[str, Schema] = {}
        self.numbers: list[Column] = []  # of the items that are being compiled
        self.kids: Column | None = None

    def body(self, name: str) -> None:
        """Number the slots of a body and of all that it refers to."""
        if name in self.bodies:
            return
        if name not in self.defs:
            raise SchemaError(f"no definition of {name}")
        self.bodies[name] = self.defs[name]  # while its slots are numbered
        before = len(self.slots)
        self.bodies[name] = self.numbered(self.defs[name], 0)
        for other in self.slots[before:]:
            self.body(other)

    def numbered(self, s: Schema, nest: int) -> Schema:
        if s.kind == "ref":
            self.defs = {**s.defs, **self.defs}
            self.nest.append(nest)
            self.slots.append(s.ref)
            return replace(s, slot=len(self.slots) - 1)
        if s.kind == "compactColumns" and refers(s):
            raise SchemaError("compact columns hold no recursive schema", "unsupported_decode")
        deeper = nest + (s.kind in ("array", "record"))
        return replace(s, items=tuple(self.numbered(x, deeper) for x in s.items), props=tuple((k, self.numbered(x, nest)) for k, x in s.props),
                       arms=tuple(self.numbered(x, nest) for x in s.arms))

    def place(self, path: tuple) -> Column:
        """The path by which a child is found, where its number alone doesn't tell."""
        return at_path(path) if max(self.nest, default=0) > 1 else none("array<string>")

    def node(self, name: str, slot: int, path: tuple, v: Column) -> Column:
        return F.struct(F.lit(list(self.bodies).index(name)).alias("ref"), F.lit(slot).alias("slot"), self.place(path).alias("path"), v.alias("v"))

    def holes(self, s: Schema, v: Column, path: tuple = (), always: bool = False) -> Column:
        """The nodes at the slots of s, in the order of slots. In lists every item has one, so that numbers find them."""
        empty = F.array().cast(f"array<{_NODE}>")
        if not refers(s):
            return empty
        if s.kind == "ref":
            one = F.array(self.node(s.ref, s.slot, path, v))
            return one if always else F.filter(one, lambda n: n["v"].isNotNull())
        if s.kind in WRAPS:
            return self.holes(s.items[0], v, path, always)
        if s.kind == "array":
            items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
            return F.flatten(F.transform(items, lambda x, i: self.holes(s.items[0], x, (*path, i.cast("string")), True)))
        if s.kind == "record":
            pairs = F.map_entries(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
            return F.flatten(F.transform(pairs, lambda e: self.holes(s.items[0], e["value"], (*path, e["key"]), True)))
        if s.kind in ("object", "tuple"):
            place = lambda n: step(n) if s.kind == "object" else f"$[{label(s, n)}]"
            parts = [self.holes(x, F.try_variant_get(v, place(n), "variant"), (*path, label(s, n)), always) for n, x in fields_of(s) if refers(x)]
        else:
            parts = [self.holes(a, v, path, always) for a in s.arms if refers(a)]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    def of_node(self, n: Column, make) -> Column:  # noqa: ANN001
        """make(name) for the schema that a node is of."""
        names = list(self.bodies)
        return functools.reduce(lambda rest, i: F.when(n["ref"] == i, make(names[i])).otherwise(rest), reversed(range(len(names) - 1)), make(names[-1]))

    def unfolded(self, root: Column, most: Column) -> Column:
        """All nodes from root on, each with its children: parents before children, the children of one side by side."""
        grown = lambda nodes: F.transform(nodes, lambda n: F.struct(n.alias("n"), self.of_node(n, lambda name: self.holes(self.bodies[name], n["v"])).alias("k")))

        def level(all_: Column, _: Column) -> Column:
            last = F.element_at(all_, -1)
            return F.when(F.size(last) == 0, all_).otherwise(F.concat(all_, F.array(grown(F.flatten(last["k"])))))

        return F.flatten(F.aggregate(F.sequence(F.lit(1), (most + 1) * len(self.bodies)), F.array(grown(F.array(root))), level))

    def judged(self, n: Column, kids: Column, kind: str) -> Column:
        """A node's result, by its children's."""
        def make(name: str) -> Column:
            body = self.bodies[name]
            own = [i for i in range(len(self.slots)) if self.slot_in(body, i)]

            def run(by_slot: Column) -> Column:
                compiler = Compiler(self.options, self.defs)
                compiler.walk, self.kids, self.numbers = self, by_slot, []
                out = compiler.parse(body, n["v"], kind)

                def done(o: Out) -> Column:
                    value = F.when(n["v"].isNotNull(), as_type(o.value, type_of(body), "variant")) if self.values else none("variant")
                    return F.struct(n["slot"].alias("slot"), n["path"].alias("path"), n["v"].alias("x"), value.alias("v"), (none() if o.error is None else o.error).alias("e"))

                return done(out) if out.pair is None or not self.values else bound(out.pair, lambda p: done(out.inside(p)))

            if not own:
                return run(kids)
            of_slot = lambda i: kids if len(own) == 1 else F.filter(kids, lambda k: k["slot"] == i)
            by_slot = F.struct(*(of_slot(i).alias(f"s{i}") for i in own))
            return run(by_slot) if len(own) == 1 and self.nest[own[0]] == 0 else bound(by_slot, run)

        return self.of_node(n, make)

    def slot_in(self, s: Schema, i: int) -> bool:
        return s.slot == i or any(self.slot_in(x, i) for x in _children(s))

    def given(self, s: Schema) -> Column | None:
        """What stands at a place that is a slot itself, as its node has it: what is read again is copied again."""
        while s.kind in WRAPS:
            s = s.items[0]
        if s.kind == "ref" and s.slot is not None and self.nest[s.slot] == 0:
            return F.get(self.kids[f"s{s.slot}"], F.lit(0))["x"]
        return None

    def child(self, compiler: Compiler, s: Schema, v: Column, kind: str, path: tuple) -> Out:
        """What has been found at a slot."""
        kids = self.kids[f"s{s.slot}"]
        n = self.nest[s.slot]
        got = F.get(kids, F.lit(0)) if n == 0 else F.get(kids, self.numbers[-1]) if n == 1 else F.get(F.filter(kids, lambda k: k["path"] == at_path(path)), F.lit(0))
        absent = Compiler(self.options, self.defs).parse(_blunt(self.bodies[s.ref]), none("variant"), kind, path).error

        def told(k: Column) -> Column:
            e = k["e"]
            moved = F.when(e.isNotNull(), e.withField("path", F.concat(at_path(path), e["path"])))
            return F.when(k.isNull(), none() if absent is None else absent).otherwise(moved)

        if not self.values:
            return Out(none("variant"), bound(got, told), weight=64)
        return Out(kids, none()).inside(bound(got, lambda k: F.struct(k["v"].alias("v"), told(k).alias("e"))), 64)

    def run(self, s: Schema, v: Column, kind: str, path: tuple) -> Out:
        mark = (id(self.defs.get(s.ref)), s.ref)
        if mark in _compiling:
            raise SchemaError(f"{expression(s)} refers to itself behind a check or a conversion", "unsupported_decode")
        _compiling.append(mark)
        try:
            self.body(s.ref)

            def up(waiting: Column, x: Column) -> Column:
                n = F.size(x["k"])
                made = self.judged(x["n"], F.reverse(F.slice(waiting, F.lit(1), n)), kind)
                return F.concat(F.slice(waiting, n + 1, F.size(waiting)), F.array(made))

            def whole(v: Column) -> Column:
                nodes = self.unfolded(self.node(s.ref, -1, (), v), brackets(v))
                return F.aggregate(F.reverse(nodes), F.array().cast(f"array<{_DONE}>"), up, lambda done: F.get(done, F.lit(0)))

            pair = bound(bound(v, whole), lambda d: F.struct(d["v"].alias("v"), F.when(d["e"].isNotNull(), d["e"].withField("path", F.concat(at_path(path), d["e"]["path"]))).alias("e"), F.lit(True).alias("n")))
            return Out(v, none(), F.lit(True)).inside(pair, 64)
        finally:
            _compiling.pop()


def _blunt(s: Schema) -> Schema:
    """s without recursion: what it says of an absent value."""
    if s.kind == "ref":
        return Schema("unknown")
    return replace(s, items=tuple(map(_blunt, s.items)), props=tuple((k, _blunt(x)) for k, x in s.props), arms=tuple(map(_blunt, s.arms)))
