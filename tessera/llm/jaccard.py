"""Exact Jaccard self-join of documents on word shingles, by set relations over block-skipped lists.

A set's tokens (64-bit hashes of its shingles) have one global order, rare before frequent: by the
cells of a fixed-size table counted over all documents, ties by hash. Any order is exact; this one
keeps common passages out of the prefixes. Two sets at or over the threshold share a token in the
first n - ceil(t * n) + 1 of both, so only those go to the inverted lists.

Equal sets (size and two 64-bit sums of all tokens) are folded first: the one with the least doc_id
stands for all in every list, so copies are never compared with anything.

Index level: a list is cut into blocks by set size (a factor of 1 / t) and by the share of the set that
stands before the token. A set looks in its lists for sets no larger than itself; its size and position
say which blocks can hold a partner, and only those are joined: all others are skipped unread.

Answer level: a set is first compared with its neighbours in its lists, most often highly similar
sets. A link puts both into one component, whose members are not compared again. What the blocks leave
open between components is answered in two steps. A set that is linked with a similar hub lets the
hub's pair be compared first; then its own shared tokens follow from the hub's to within the tokens in
which the two differ: shared(hub, z) - (n_hub - s) <= shared(y, z) <= shared(hub, z) + (n_y - s), with s
shared by hub and y. Only pairs that these bounds leave open are compared themselves.

A parity sketch has about a bit per token, each the parity of the tokens that fall on it. Two sets
differ in at least as many tokens as their sketches in bits, so a sketch only ever rules out pairs
that are no link. Folded to 128 bits it goes with the entries that are left at the end, and rules out
pairs where lists are joined.

So every link between sets is either verified, derived, or inside a component that such links connect;
no list, partner or candidate is capped.

Words: A-Z lower-cased, `[^\\x20\\x09-\\x0D]+`; with fewer than `shingle` words the whole sequence is the
only shingle. Defined cases: null texts and texts without words have the empty set, linked with
nothing; repeated rows share a node; rows with one doc_id and different texts are one node with the
links of both; a null doc_id is not linked; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import in_chunks, needed, raw, removed, written
from .components import components

#: Cells of the frequency table, a byte each where it is broadcast: its size does not depend on the data.
CELL_BITS = 23
_PARTS = 64
_FOLDS = ("f0", "f1")
_CELL_SHIFT = np.uint64(64 - CELL_BITS)
MEMO = 400_000
#: Position blocks in a size block.
POSITIONS = 2
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Shingler:
    """Sorted distinct token hashes of a text."""

    def __init__(self, shingle: int) -> None:
        self.shingle = shingle
        self.factors = np.array([int(_MIX[i % 5]) * (2 * (i // 5) + 1) % (1 << 64) for i in range(shingle)], np.uint64)

        class Memo(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= MEMO:
                    self.clear()
                h = self[word] = xxhash.xxh3_64_intdigest(word)
                return h

        self.hash = Memo().__getitem__

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else ()
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        if n < self.shingle:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
        own = np.fromiter(map(self.hash, words), np.uint64, n)
        k = n - self.shingle + 1
        h = own[:k] * self.factors[0]
        for i in range(1, self.shingle):
            h += own[i:i + k] * self.factors[i]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return np.unique(h)


def frequencies(docs: DataFrame, shingle: int) -> np.ndarray:
    """Level of frequency of each cell, counted over all documents: twice the binary logarithm."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = Shingler(shingle), np.zeros(1 << CELL_BITS, np.int32)
        for batch in in_chunks(batches, "text", 4 << 20):
            found = [own(t) for t in raw(batch.column(0))]
            cells, counts = np.unique((np.concatenate(found) >> _CELL_SHIFT).astype(np.int64), return_counts=True)
            total[cells] += counts.astype(np.int32)
        for i, part in enumerate(total.reshape(_PARTS, -1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["i", "part"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << CELL_BITS) // _PARTS, np.int64)
        for batch in batches:
            for part in batch.column(1).to_pylist():
                total += np.frombuffer(zlib.decompress(part), np.int32)
        level = (2 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["i", "part"])

    rows = docs.select("text").mapInArrow(run, "i int, part binary").groupBy("i").applyInArrow(add, "i int, part binary").collect()
    level = np.zeros((_PARTS, (1 << CELL_BITS) // _PARTS), np.uint8)
    for r in rows:
        level[r.i] = np.frombuffer(r.part, np.uint8)
    return level.ravel()


def sketch(h: np.ndarray) -> bytes:
    """Parities of the tokens by their low bits, on a power of two of bits, 256 at least."""
    bits = max(256, 1 << (len(h) - 1).bit_length()) if len(h) else 256
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded_sketch(h: np.ndarray) -> list[int]:
    """The sketch folded to 128 bits, as two numbers."""
    bits = np.bincount((h & np.uint64(127)).astype(np.int64), minlength=128) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _near_enough(x: list[Column], z: list[Column], n_x: Column, n_z: Column, percent: int) -> Column:
    """Do the folded sketches leave it open that the sets are linked?"""
    apart = functools.reduce(operator.add, (F.bit_count(a.bitwiseXOR(b)) for a, b in zip(x, z, strict=True)))
    return (100 + percent) * apart <= (100 - percent) * (n_x + n_z)


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer folded to the shorter's size."""
    x, y = (int.from_bytes(s, "little") for s in (a, b))
    size_a, size_b = len(a), len(b)
    while size_a != size_b:
        if size_a > size_b:
            size_a //= 2
            x = (x >> 8 * size_a) ^ (x & ((1 << 8 * size_a) - 1))
        else:
            size_b //= 2
            y = (y >> 8 * size_b) ^ (y & ((1 << 8 * size_b) - 1))
    return (x ^ y).bit_count()


def prefixes(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, str]:
    """doc_id, n, low, high (sums over the whole set), sketch, tokens (of the prefix, in order), as a
    written table; and its path."""
    held = docs.sparkSession.sparkContext.broadcast(frequencies(docs, shingle))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("sketch", pa.binary()), *((f, pa.int64()) for f in _FOLDS), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, level = Shingler(shingle), held.value
        for batch in in_chunks(batches, "text", 4 << 20):
            ns, lows, highs, sketches, folds, tokens, ends = [], [], [], [], [], [], [0]
            for text in raw(batch.column(1)):
                h = own(text)
                n = len(h)
                ns.append(n)
                lows.append(int((h * _MIX[1] ^ (h >> np.uint64(7))).sum().astype(np.int64)) if n else 0)
                highs.append(int(((h ^ (h >> np.uint64(32))) * _MIX[3] ^ (h >> np.uint64(17))).sum().astype(np.int64)) if n else 0)
                sketches.append(sketch(h))
                folds.append(folded_sketch(h))
                if n:
                    first = n - -(-percent * n // 100) + 1
                    keys = level[(h >> _CELL_SHIFT).astype(np.int64)]
                    h = h[np.argsort(keys, kind="stable")[:first]]
                tokens.append(h)
                ends.append(ends[-1] + len(h))
            flat = np.concatenate(tokens).astype(np.int64) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(ns, pa.int64()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64()), pa.array(sketches, pa.binary()), *(pa.array([f[k] for f in folds], pa.int64()) for k in range(len(_FOLDS))),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], schema=schema)

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n long, low long, high long, sketch binary, f0 long, f1 long, tokens array<long>"))


def folded(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, own): doc_id, n, rep of every row, rep being the least doc_id with an equal set; and the
    sets of the representatives. Both written."""
    named = sets.filter("doc_id is not null and n > 0")
    same = named.groupBy("n", "low", "high").agg(F.min("doc_id").alias("rep"))
    same, _ = written(same)
    rows = sets.select("doc_id", "n", "low", "high").join(same, ["n", "low", "high"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"))
    own = named.join(same.withColumnRenamed("rep", "doc_id"), ["doc_id", "n", "low", "high"], "left_semi").select("doc_id", "n", "sketch", *_FOLDS, "tokens")
    return written(rows)[0], written(own)[0]


def listed(own: DataFrame) -> DataFrame:
    """token, doc_id, place (size and position) of all lists with two entries or more, each with its
    neighbour before; written."""
    # Size and position share a number: size first, as the order of a list needs.
    entries = own.select("doc_id", "n", F.posexplode("tokens").alias("at", "token")).select(
        "token", "doc_id", (F.shiftleft("n", 32) + F.col("at")).alias("place"))
    w = Window.partitionBy("token").orderBy(F.shiftright("place", 32), "doc_id")
    beside = entries.select("token", "doc_id", "place", F.lag("doc_id").over(w).alias("before"), F.lag("place").over(w).alias("before_place"), F.lead("doc_id").over(w).alias("after"))
    return written(beside.filter("before is not null or after is not null").drop("after"))[0]


def sifted(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (a, b) that sizes and sketches leave open."""
    pairs, _ = written(pairs)
    own = needed(own.select("doc_id", "n", "sketch"), pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    x, z = (own.select(*(F.col(c).alias(f"{c}_{k}") for c in own.columns)) for k in "ab")
    both = pairs.join(x, F.col("a") == F.col("doc_id_a")).join(z, F.col("b") == F.col("doc_id_b")).filter(
        100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, p, q = (c.to_pylist() for c in batch.columns[2:])
            keep = [(100 + percent) * d <= (100 - percent) * n for d, n in zip(map(differing_bits, p, q), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("sizes"), "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def compared(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """a, b, n_a, n_b, shared, link of the pairs (a, b), from both whole texts; written. Sizes and shared
    are null where a doc_id has more than one row."""
    pairs, _ = written(pairs.select("a", "b"))
    sides = pairs.select("a", "b", F.col("a").alias("doc_id")).union(pairs.select("a", "b", "b"))
    texts = sides.join(needed(docs.select("doc_id", F.col("text").cast("string").alias("text")), sides), "doc_id")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = texts.select("a", "b", (F.col("doc_id") == F.col("b")).alias("second"), "text").repartition(parts, "a", "b").sortWithinPartitions("a", "b", "second")
    kinds = [*[("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("shared", pa.int64()), ("link", pa.bool_())]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(shingle)
        now, sides = None, ({}, {})

        def judged() -> tuple:
            left, right = (list(x.values()) for x in sides)
            link, shared = False, None
            for x in left:
                for h in right:
                    shared = len(np.intersect1d(x, h, assume_unique=True))
                    if link := shared > 0 and 100 * shared >= percent * (len(x) + len(h) - shared):
                        break
                if link:
                    break
            one = len(left) == len(right) == 1
            return (*now, *((len(left[0]), len(right[0]), shared) if one else (None, None, None)), link)

        def sent(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])

        for batch in batches:
            out = []
            for a, b, second, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), raw(batch.column(3)), strict=True):
                if now != (a, b):
                    if now:
                        out.append(judged())
                    now, sides = (a, b), ({}, {})
                sides[second].setdefault(xxhash.xxh3_128_digest(text or b""), own(text))
            yield sent(out)
        if now:
            yield sent([judged()])

    return written(met.mapInArrow(run, "a long, b long, n_a long, n_b long, shared long, link boolean"))[0]


def classes(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    if not 0 < percent < 100:
        raise ValueError("percent is from 1 to 99")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets, path = prefixes(docs, shingle, percent)
    rows, own = folded(sets)
    removed(spark, path)
    lists = listed(own)
    near = lists.filter((F.col("before") != F.col("doc_id")) & (100 * F.shiftright("before_place", 32) >= percent * F.shiftright("place", 32))).select(
        F.least("doc_id", "before").alias("a"), F.greatest("doc_id", "before").alias("b")).distinct()
    answers = compared(sifted(near, own, percent), docs, shingle, percent)
    # A doc_id with rows of several sets links their representatives.
    named = rows.filter("rep is not null").select("doc_id", "rep")
    several = named.groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least < most")
    links = _edges(answers).union(named.join(several, "doc_id").select("least", "rep").distinct())
    member, _ = written(components(links))
    for turn in itertools.count():
        # Neighbours in another order each time, as long as that finds links between components.
        lists = mixed(lists, member, percent, turn)
        pairs = lists.filter("beside is not null").select(F.least("doc_id", "beside").alias("a"), F.greatest("doc_id", "beside").alias("b")).distinct().join(
            answers, ["a", "b"], "left_anti")
        found = compared(sifted(pairs, own, percent), docs, shingle, percent)
        answers = answers.union(found)
        n = found.filter("link").count()
        if n:
            member, _ = written(components(_with(member, _edges(found))))
        if n * 200 <= member.count():  # the rest is left to the exact end
            break
    open_, _ = written(sifted(crossing(mixed(lists, member, percent), own, percent).join(answers, ["a", "b"], "left_anti"), own, percent))
    waits, _ = written(open_.join(hubs(answers), "a").join(
        open_.select(F.col("a").alias("a_2"), F.col("b").alias("b_2")),
        (F.least("hub", "b") == F.col("a_2")) & (F.greatest("hub", "b") == F.col("b_2"))).drop("a_2", "b_2"))
    first = compared(open_.join(waits, ["a", "b"], "left_anti"), docs, shingle, percent)
    left, links = derived(waits, first, percent)
    rest = compared(left, docs, shingle, percent)
    final = components(_with(member, _edges(first).union(_edges(rest)).union(links)))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "rep").join(
        final.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def _edges(answers: DataFrame) -> DataFrame:
    return answers.filter("link").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _with(member: DataFrame, edges: DataFrame) -> DataFrame:
    return member.select(F.col("node").alias("u"), F.col("component").alias("v")).union(edges)


def hubs(answers: DataFrame) -> DataFrame:
    """a, hub, n_a, n_hub, same: of every second set the most similar one with which it is linked, among
    the sets that have no hub themselves."""
    odd = lambda c: F.pmod(F.xxhash64(c), F.lit(2)) == 1
    known = answers.filter("link and shared is not null")
    both = known.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("n_a").alias("n_x"), F.col("n_b").alias("n_y"), "shared").union(
        known.select("b", "a", "n_b", "n_a", "shared"))
    best = F.max_by(F.struct("x", "n_x", "n_y", "shared"), F.struct(F.col("shared") / (F.col("n_x") + F.col("n_y") - F.col("shared")), -F.col("x")))
    return both.filter(odd("y") & ~odd("x")).groupBy("y").agg(best.alias("h")).select(
        F.col("y").alias("a"), F.col("h.x").alias("hub"), F.col("h.n_y").alias("n_a"), F.col("h.n_x").alias("n_hub"), F.col("h.shared").alias("same"))


def derived(waits: DataFrame, first: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs that the hub's answer leaves open, links u, v that it proves) of the pairs that waited."""
    answer = first.select(F.col("a").alias("a_2"), F.col("b").alias("b_2"), "shared", "link",
                          F.col("n_a").alias("n_a_2"), F.col("n_b").alias("n_b_2"))
    both = waits.join(answer, (F.least("hub", "b") == F.col("a_2")) & (F.greatest("hub", "b") == F.col("b_2")), "left")
    n_b = F.when(F.col("b") == F.col("b_2"), F.col("n_b_2")).otherwise(F.col("n_a_2"))
    enough = lambda s: (100 + percent) * s >= percent * (F.col("n_a") + n_b)
    most, least = F.col("shared") + F.col("n_a") - F.col("same"), F.col("shared") - F.col("n_hub") + F.col("same")
    # A hub's link joins the components of both already.
    no = F.coalesce(F.col("link") | ~enough(most), F.lit(False))
    yes = F.coalesce(enough(least) & (least > 0), F.lit(False))
    told = both.select("a", "b", no.alias("no"), yes.alias("yes"))
    return told.filter("not no and not yes").select("a", "b"), told.filter("yes and not no").select(F.col("a").alias("u"), F.col("b").alias("v"))


def mixed(lists: DataFrame, member: DataFrame, percent: int, turn: int | None = None) -> DataFrame:
    """token, doc_id, place, hub (the component) of the lists that hold several components, with a turn
    beside: the neighbour of another component in an order drawn for it; written. No other list is read again."""
    entries = lists.select("token", "doc_id", "place").join(member.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "token", "doc_id", "place", F.coalesce("component", "doc_id").alias("hub"))
    w = Window.partitionBy("token")
    ends = entries.select("*", F.min("hub").over(w).alias("least"), F.max("hub").over(w).alias("most"))
    if turn is not None:
        z, n = F.col("z"), F.shiftright("place", 32)
        n_z = F.shiftright(z["place"], 32)
        ends = ends.withColumn("z", F.lag(F.struct("doc_id", "place", "hub")).over(w.orderBy(F.xxhash64("doc_id", F.lit(turn)), "doc_id"))).withColumn(
            "beside", F.when((F.col("hub") != z["hub"]) & (100 * F.least(n, n_z) >= percent * F.greatest(n, n_z)), z["doc_id"])).drop("z")
    return written(ends.filter("least < most").drop("least", "most"))[0]


def size_block(n: Column, percent: int) -> Column:
    """The size block of n; it never falls as n grows, so a range of sizes is a range of blocks."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent)).cast("int")


def crossing(lists: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a list but no component, as far as sizes, positions and folded sketches
    leave them open."""
    entries = lists.join(own.select("doc_id", *_FOLDS).distinct(), "doc_id").select(
        "token", "doc_id", "hub", *_FOLDS, F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(0xFFFFFFFF).alias("at"))
    # Of a pair the smaller set (of equal sizes the lower id) is the one found. Both share this token and at
    # most what follows it in either; percent / (100 + percent) of both sizes must be shared.
    whole = 100 + percent
    step = F.floor(F.col("at") * F.lit(POSITIONS * whole) / (F.col("n") * (100 - percent))).cast("int")
    found = entries.filter(whole * (F.col("n") - F.col("at")) >= 2 * percent * F.col("n")).select(
        "token", *(F.col(c).alias(f"{c}_z") for c in ("doc_id", "n", "at", "hub", *_FOLDS)), size_block(F.col("n"), percent).alias("block"), F.least(step, F.lit(POSITIONS - 1)).alias("step"))
    low = F.ceil(F.col("n") * percent / 100)
    high = F.least(F.col("n"), F.floor(F.lit(whole) * (F.col("n") - F.col("at")) / percent) - F.col("n"))
    blocks = F.sequence(size_block(low, percent), size_block(high, percent))
    # Sizes in a block are under this; so much of a partner can stand before the token at most.
    top = F.least(F.pow(F.lit(100 / percent), F.col("block") + 1) * 1.000001, F.col("n").cast("double"))
    last = (1 - percent / whole * (1 + F.col("n") / top)) * POSITIONS * whole / (100 - percent)
    looks = entries.filter(low <= high).select("*", F.explode(blocks).alias("block")).select(
        "token", "block", *(F.col(c).alias(f"{c}_x") for c in ("doc_id", "n", "at", "hub", *_FOLDS)),
        F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.floor(last + 1e-6).cast("int"), F.lit(POSITIONS - 1))))).alias("step"))
    most = F.least(F.col("n_x") - F.col("at_x"), F.col("n_z") - F.col("at_z"))
    return looks.join(found, ["token", "block", "step"]).filter(
        (F.col("hub_x") != F.col("hub_z")) & ((F.col("n_z") < F.col("n_x")) | (F.col("n_z") == F.col("n_x")) & (F.col("doc_id_z") < F.col("doc_id_x")))
        & _near_enough(*([F.col(f"{f}_{k}") for f in _FOLDS] for k in "xz"), F.col("n_x"), F.col("n_z"), percent)
        & (100 * F.col("n_z") >= percent * F.col("n_x")) & (whole * most >= percent * (F.col("n_x") + F.col("n_z")))).select(
        F.least("doc_id_x", "doc_id_z").alias("a"), F.greatest("doc_id_x", "doc_id_z").alias("b")).distinct()
