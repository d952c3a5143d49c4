"""Secrets by inferred grammars: probabilistic automata learned from labelled credentials score all candidates.

Base patterns find what is certain, and their matches label credentials by kind. Of each kind a prefix
tree of character classes is counted, and states whose frequencies are statistically compatible (Hoeffding's
bound, tested down their subtrees) are merged, red states first, until none can be. The result is an
automaton with probabilities of classes and of the end at every state. One more automaton is learned from
ordinary candidates, those that no base match covers.

Every candidate of every whole text (a maximal run of credential characters, `SHORTEST` or more of them) is
scored: the log-likelihood of its best kind less that of the ordinary automaton. It becomes a span if that is
`MARGIN` at least and its likelihood per character is no lower than that of the kind's own credentials that
were held out of the inference. Base spans always stay; a candidate inside one is not added again.

Bounds: the inference is on at most `per_kind` distinct values of each kind and of ordinary candidates, the
ones with the least hashes, of `LONGEST` characters at most; a kind with fewer than `FEWEST` has no automaton.
Everything else covers whole texts; automata have at most a state per character learned from.

Defined cases: a null or empty text has no spans; rows are judged one by one, repeated ones alike; other
columns are carried, one called `spans` is replaced; without labelled credentials only base spans are found; an
empty table gives an empty result. Spans are in code points, ends exclusive, in order of start, then kind.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._util import in_chunks, written

#: Base patterns by kind, in the order of their spans, with the group and length that a match must have.
BASE = (
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 20),
    ("hex", r"[0-9a-f]+", re.ASCII, 0, 24),
)
KINDS = tuple(b[0] for b in BASE)
ORDINARY = "ordinary"
SHORTEST, LONGEST, FEWEST = 12, 256, 20
#: Of two frequencies' equality; natural log of the odds against an ordinary candidate; share of held-out credentials below the floor.
ALPHA, MARGIN, LOST = 0.01, math.log(1e6), 0.02
#: Candidates whose scores a task remembers.
REMEMBERED = 100_000
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

#: Classes of characters: within one, all are equally likely.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
_CLASS = bytes(next((i for i, k in enumerate(CLASSES) if chr(c) in k), 0) for c in range(256))
_WIDE = [math.log(len(k)) for k in CLASSES]
_BASE = [(kind, re.compile(pattern, flags), group, least) for kind, pattern, flags, group, least in BASE]
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, credential) of the base patterns, in order. Matches that are too short are
    dropped after matching, and what they cover is not looked at again."""
    out = []
    for i, (_, pattern, group, least) in enumerate(_BASE):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), i, m.end(), m.group(group)))
    return sorted(out)


def candidates(text: str, spans: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, value) of candidates that lie in no base span; dots and dashes at the ends are punctuation."""
    at, reach = 0, -1
    for m in _CANDIDATE.finditer(text):
        value = m.group().lstrip(".-")
        start = m.end() - len(value)
        value = value.rstrip(".-")
        if len(value) < SHORTEST:
            continue
        while at < len(spans) and spans[at][0] <= start:
            reach, at = max(reach, spans[at][2]), at + 1
        if start + len(value) > reach:
            yield start, start + len(value), value


class Automaton:
    """A probabilistic automaton over classes of characters, inferred from values."""

    def __init__(self, values: list[str], alpha: float = ALPHA) -> None:
        self._tree(sorted(values))
        self._close = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self._freeze()

    def _tree(self, values: list[str]) -> None:
        self.arrived, self.ended, self.kids = [0], [0], [{}]  # kids: class -> [state, times]
        for value in values:
            s = 0
            self.arrived[0] += 1
            for c in value.encode().translate(_CLASS):
                if c not in self.kids[s]:
                    self.kids[s][c] = [len(self.arrived), 0]
                    self.arrived.append(0)
                    self.ended.append(0)
                    self.kids.append({})
                edge = self.kids[s][c]
                edge[1] += 1
                s = edge[0]
                self.arrived[s] += 1
            self.ended[s] += 1

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self._close * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        left = [(a, b)]
        while left:
            a, b = left.pop()
            n, m = self.arrived[a], self.arrived[b]
            if self._differ(self.ended[a], n, self.ended[b], m):
                return False
            for c in self.kids[a].keys() | self.kids[b].keys():
                x, y = self.kids[a].get(c), self.kids[b].get(c)
                if self._differ(x[1] if x else 0, n, y[1] if y else 0, m):
                    return False
                if x and y:
                    left.append((x[0], y[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """The subtree of b, which is a tree still, into a."""
        left = [(a, b)]
        while left:
            a, b = left.pop()
            self.arrived[a] += self.arrived[b]
            self.ended[a] += self.ended[b]
            for c, (kid, times) in self.kids[b].items():
                if edge := self.kids[a].get(c):
                    edge[1] += times
                    left.append((edge[0], kid))
                else:
                    self.kids[a][c] = [kid, times]

    def _merge(self) -> None:
        red = [0]
        while True:
            known = set(red)
            blue = [(r, c, kid) for r in red for c, (kid, _) in self.kids[r].items() if kid not in known]
            if not blue:
                break
            r, c, kid = max(blue, key=lambda x: (self.arrived[x[2]], -x[2]))
            same = next((s for s in red if self._compatible(s, kid)), None)
            if same is None:
                red.append(kid)
            else:
                self.kids[r][c][0] = same
                self._fold(same, kid)
        self.states = red

    def _freeze(self) -> None:
        """Tables by state: costs with half a count added everywhere; one state more for classes never seen."""
        place = {s: i for i, s in enumerate(self.states)}
        lost, k = len(place), len(CLASSES)
        self.next = [[lost] * k for _ in range(lost + 1)]
        self.cost = [[-math.log(k + 1) - w for w in _WIDE] for _ in range(lost + 1)]
        self.end = [-math.log(k + 1)] * (lost + 1)
        for s, i in place.items():
            whole = math.log(self.arrived[s] + 0.5 * (k + 1))
            self.end[i] = math.log(self.ended[s] + 0.5) - whole
            for c in range(k):
                kid, times = self.kids[s].get(c, (None, 0))
                self.cost[i][c] = math.log(times + 0.5) - whole - _WIDE[c]
                if kid is not None:
                    self.next[i][c] = place[kid]
        del self.arrived, self.ended, self.kids, self.states

    def loglikelihood(self, value: str) -> float:
        s, total, step, cost = 0, 0.0, self.next, self.cost
        for c in value.encode().translate(_CLASS):
            total += cost[s][c]
            s = step[s][c]
        return total + self.end[s]


class Formats:
    """Automata of the kinds that have enough credentials, with their floors, and of ordinary candidates."""

    def __init__(self, examples: dict[str, list[str]]) -> None:
        self.kinds: list[tuple[str, Automaton, float]] = []
        for kind in KINDS:
            values = examples.get(kind, [])
            if len(values) < FEWEST:
                continue
            automaton = Automaton([v for i, v in enumerate(values) if i % 5])
            held = sorted(automaton.loglikelihood(v) / (len(v) + 1) for v in values[::5])
            self.kinds.append((f"like_{kind}", automaton, held[int(LOST * len(held))]))
        self.ordinary = Automaton(examples.get(ORDINARY, []) or ["x" * SHORTEST])

    def judge(self, value: str) -> tuple[str, float] | None:
        """The kind that value has the format of, and the log of its odds."""
        best = None
        if self.kinds:
            usual = self.ordinary.loglikelihood(value)
            for kind, automaton, floor in self.kinds:
                said = automaton.loglikelihood(value)
                if said - usual >= MARGIN and said / (len(value) + 1) >= floor and (best is None or said - usual > best[1]):
                    best = kind, said - usual
        return best


def examples(docs: DataFrame, per_kind: int = 1000) -> dict[str, list[str]]:
    """At most per_kind distinct credentials of each kind and ordinary candidates, those with the least hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, list] = {k: [] for k in (*KINDS, ORDINARY)}
        have: dict[str, set] = {k: set() for k in least}

        def offer(kind: str, value: str) -> None:
            if len(value) > LONGEST:
                return
            at, heap = xxhash.xxh64_intdigest(value) >> 1, least[kind]
            if len(heap) == per_kind and -heap[0][0] <= at or value in have[kind]:
                return
            have[kind].add(value)
            if len(heap) < per_kind:
                heapq.heappush(heap, (-at, value))
            else:
                have[kind].discard(heapq.heappushpop(heap, (-at, value))[1])

        for batch in in_chunks(batches, "text", 1 << 22):
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                for _, i, _, value in spans:
                    offer(KINDS[i], value)
                for _, _, value in candidates(text, spans):
                    offer(ORDINARY, value)
        found = [(k, v, -at) for k, heap in least.items() for at, v in heap]
        kinds, values, ats = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(ats, pa.int64())], ["kind", "value", "at"])

    rows, _ = written(docs.filter("text is not null").select(F.col("text").cast("string")).mapInArrow(run, "kind string, value string, at long"))
    rows = rows.dropDuplicates(["kind", "value"])
    return {k: [r.value for r in rows.filter(F.col("kind") == k).orderBy("at", "value").limit(per_kind).collect()] for k in (*KINDS, ORDINARY)}


def found(docs: DataFrame, formats: Formats) -> DataFrame:
    """docs with `spans`: kind, start, end and, for spans that the automata add, the score."""
    held = docs.sparkSession.sparkContext.broadcast(formats)  # bounded by the sample
    carried = [c for c in docs.columns if c != "spans"]
    rows = docs.select(*(f"`{c}`" for c in carried))
    place = carried.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats, known = held.value, {}
        for batch in in_chunks(batches, "text", 1 << 22):
            out = []
            for text in batch.column(place).to_pylist():
                base = base_spans(text or "")
                spans = [(s, i, e, KINDS[i], None) for s, i, e, _ in base]
                for s, e, value in candidates(text or "", base):
                    if value in known:
                        said = known[value]
                    else:
                        said = formats.judge(value)
                        if len(known) < REMEMBERED and len(value) <= LONGEST:
                            known[value] = said
                    if said:
                        spans.append((s, len(KINDS), e, *said))
                out.append([{"kind": k, "start": s, "end": e, "score": x} for s, _, e, k, x in sorted(spans, key=lambda r: r[:4])])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _SPANS)], names=[*batch.schema.names, "spans"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL(f"spans {SPANS}").fields]))


def digest(rows: DataFrame) -> DataFrame:
    """Counts and texts of spans per document."""
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return rows.select("doc_id", *map(count, KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
