"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of documents of bounded size. Its text is the sequence of its words as numbers;
words that no benchmark text has, and runs too short for any window, are one separator, which no
window can match across. The shard's suffix array gives the Burrows-Wheeler transform, kept as a
wavelet matrix; all benchmark windows are searched backwards at once through its ranks, and their
rows are located by walking to the nearest sampled suffix position. Occurrences become removal spans.

Words: A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window is `window` consecutive words
of an item; a shorter item with a word is one window.

The benchmark is a stated query set: tasks parse it into blocks of bounded bytes, which are searched in every
shard. A block is arrays alone: its vocabulary, its words as numbers, the first place of every distinct window
and lists of items by offset. The driver only passes blocks on, ROUND_BLOCKS broadcasts at once and one block
more: a larger benchmark is searched in rounds, each a table of the spans and items that it found, and a round's
broadcasts are destroyed before the next one's are made. Rounds are merged by document at the end.

Defined cases: null and empty texts have no words; an item without words matches nothing; repeated
rows are searched each; repeated item_ids count once; a null item_id is the string `null`; empty
tables give no hits; other columns are ignored by `hits` and carried by `removed_passages`.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import in_chunks, raw, written

_TO_SPACE = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_COLUMNS = (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()))
#: Bytes of text in a shard, and of benchmark text in a block.
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
#: Blocks of the benchmark in a round.
ROUND_BLOCKS = 16
#: Windows searched at once, and pairs of occurrences and items listed at once.
SEARCHED = 1 << 16
LISTED = 1 << 20
#: Every SAMPLE-th text position of an index keeps its suffix position.
SAMPLE = 8


def words(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_TO_SPACE).split() if text else []


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative numbers by prefix doubling; a suffix that ends first is smaller."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    heads = np.empty(n, bool)
    heads[:1] = True
    heads[1:] = text[order][1:] != text[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    width = 1
    while not heads.all():
        # Only suffixes whose rank is shared are sorted again.
        alone = heads & np.append(heads[1:], True)
        at = np.flatnonzero(~alone)
        pos = order[at]
        after = pos + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[pos]
        again = np.lexsort((second, first))
        pos, first, second = pos[again], first[again], second[again]
        order[at] = pos
        new = np.empty(len(at), bool)
        new[:1] = True
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        heads[at] |= new
        rank[pos] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        width *= 2
    return order


class WaveletMatrix:
    """Ranks and symbols of a sequence, for arrays of queries at once."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            bit = (sequence >> b) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            zeros = len(sequence) - int(ones[-1])
            self.levels.append((ones, zeros))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often symbol stands before end."""
        start = np.zeros_like(end)
        for i, (ones, zeros) in enumerate(self.levels):
            bit = (symbol >> (self.bits - 1 - i)) & 1
            start, end = (np.where(bit, zeros + ones[x], x - ones[x]) for x in (start, end))
        return end - start

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at a place, and how often it stands before it."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for ones, zeros in self.levels:
            bit = ones[at + 1] - ones[at]
            symbol = symbol << 1 | bit
            start, at = (np.where(bit, zeros + ones[x], x - ones[x]) for x in (start, at))
        return symbol, at - start


class FMIndex:
    def __init__(self, text: np.ndarray, bits: int) -> None:
        """text: numbers under 2 ** bits - 1, 0 a separator that no pattern has; the end is less than all."""
        text = np.append(text + 1, 0)
        order = suffix_array(text)
        self.n = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        self.ranks = WaveletMatrix(text[order - 1], bits)
        kept = order % SAMPLE == 0
        self.sampled, self.samples = np.concatenate([[0], np.cumsum(kept)]), order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of every row of patterns, which have one length."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for c in patterns.T[::-1] + 1:
            low, high = (self.first[c] + self.ranks.rank(c, x) for x in (low, high))
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out, left, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(left):
            hit = self.sampled[rows + 1] > self.sampled[rows]
            out[left[hit]] = self.samples[self.sampled[rows[hit]]] + steps
            left, rows = left[~hit], rows[~hit]
            symbol, before = self.ranks.access_rank(rows)
            rows = self.first[symbol] + before
            steps += 1
        return out


class Block:
    """A part of the benchmark as arrays: vocabulary, words by number, distinct windows by length, their items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        split = [words(text) for _, text in items]
        sizes = np.array([len(w) for w in split], np.int64)
        said = pa.array([w for own in split for w in own], pa.binary()).dictionary_encode()
        self.vocabulary = said.dictionary
        self.tokens = said.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1
        named = pa.array([i for i, _ in items], pa.string()).dictionary_encode()
        self.items = named.dictionary
        self.bits = (len(self.vocabulary) + 2).bit_length()
        item, begin = named.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes) - sizes
        #: By length: first places of the distinct windows, where each one's items begin, and these.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths = np.minimum(sizes, window)
        for n in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == n)
            many = sizes[own] - n + 1
            places = np.repeat(begin[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
            order = np.lexsort([self.tokens[places + k] for k in range(n)])
            places, of = places[order], np.repeat(item[own], many)[order]
            new = np.zeros(len(places), bool)
            new[0] = True
            for k in range(n):
                new[1:] |= self.tokens[places[1:] + k] != self.tokens[places[:-1] + k]
            pairs = np.unique((np.cumsum(new) - 1) * len(self.items) + of)
            offsets = np.searchsorted(pairs, np.arange(new.sum() + 1) * len(self.items))
            self.windows[n] = places[new].astype(np.int32), offsets, (pairs % len(self.items)).astype(np.int32)
        self.least = min(self.windows, default=0)

    @property
    def nbytes(self) -> int:
        return self.vocabulary.nbytes + self.items.nbytes + self.tokens.nbytes + sum(a.nbytes for w in self.windows.values() for a in w)


def benchmark_blocks(benchmark: DataFrame, window: int) -> Iterator[bytes]:
    """Pickled blocks of about BLOCK_BYTES of text, or one item, made in tasks and fetched a task at a time."""
    most = BLOCK_BYTES
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[str, bytes]] = []
        held = 0
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if items and held + len(text) > most:
                    yield _pickled(items, window)
                    items, held = [], 0
                items.append((item, text))
                held += len(text)
        if items:
            yield _pickled(items, window)

    parts = -(-size // most)
    spread = rows.coalesce(1) if parts <= 1 else rows.repartition(parts)
    for row in spread.mapInArrow(run, "block binary").toLocalIterator():
        yield bytes(row.block)


def _pickled(items: list[tuple[str, bytes]], window: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Block(items, window))], pa.binary())], names=["block"])


class Shard:
    """The words of a slice of documents, in one row; a separator follows every document."""

    def __init__(self, texts: list[bytes | None]) -> None:
        split = [words(t) for t in texts]
        self.sizes = np.array([len(w) for w in split], np.int64)
        self.begin = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.said = pa.array([w for own in split for w in own], pa.binary())
        self.n = int(self.sizes.sum()) + len(texts)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes + 1)
        #: Starts less ends of occurrences, by place; and the items of every document.
        self.edges = np.zeros(self.n + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in texts]

    def search(self, block: Block) -> None:
        """Mark all occurrences of the block's windows. At a place at most one window of a length occurs."""
        seq = np.zeros(self.n, np.int64)
        is_word = np.ones(self.n, bool)
        is_word[self.begin + self.sizes] = False
        seq[is_word] = pa.compute.index_in(self.said, value_set=block.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        # Separators that follow separators and runs shorter than any window go.
        known = np.concatenate([[False], seq > 0, [False]])
        starts, ends = (np.flatnonzero(x) for x in (known[1:] & ~known[:-1], known[:-1] & ~known[1:]))
        long = ends - starts >= block.least
        keep = np.zeros(self.n + 1, np.int64)
        keep[starts[long]] += 1
        keep[np.minimum(ends[long] + 1, self.n)] -= 1
        kept = np.flatnonzero(np.cumsum(keep)[:self.n] > 0)
        if not len(kept):
            return
        index = FMIndex(seq[kept], block.bits)
        for size, (first, offsets, listed) in block.windows.items():
            for lo in range(0, len(first), SEARCHED):
                low, high = index.search(block.tokens[first[lo:lo + SEARCHED, None] + np.arange(size)].astype(np.int64))
                some = np.flatnonzero(high > low)
                if not len(some):
                    continue
                counts = high[some] - low[some]
                places = kept[index.locate(_ranges(low[some], counts))]
                np.add.at(self.edges, places, 1)
                np.add.at(self.edges, places + size, -1)
                self._named(np.unique(np.repeat(some + lo, counts) * len(self.sizes) + self.doc[places]), offsets, listed, block.items)

    def _named(self, pairs: np.ndarray, offsets: np.ndarray, listed: np.ndarray, names: pa.Array) -> None:
        """Give documents the items of their windows; pairs are window * documents + document."""
        window, doc = pairs // len(self.sizes), pairs % len(self.sizes)
        counts = offsets[window + 1] - offsets[window]
        ends = np.cumsum(counts)
        at = 0
        while at < len(pairs):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] - counts[at] + LISTED, side="right")))
            own = slice(at, upto)
            item = listed[_ranges(offsets[window[own]], counts[own])]
            for d, i in zip(*_distinct(np.repeat(doc[own], counts[own]), item, len(names)), strict=True):
                self.items[d].add(names[i].as_py())
            at = upto

    def spans(self) -> list[list[tuple[int, int]]]:
        """Merged [first, end) word spans of every document."""
        hit = np.concatenate([[False], np.cumsum(self.edges)[:self.n] > 0, [False]])
        starts, ends = (np.flatnonzero(x) for x in (hit[1:] & ~hit[:-1], hit[:-1] & ~hit[1:]))
        out: list[list[tuple[int, int]]] = [[] for _ in self.sizes]
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            d = int(self.doc[a])
            out[d].append((a - int(self.begin[d]), b - int(self.begin[d])))
        return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + count), one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def _distinct(a: np.ndarray, b: np.ndarray, many: int) -> tuple[list[int], list[int]]:
    both = np.unique(a * many + b)
    return (both // many).tolist(), (both % many).tolist()


def _spans(marked: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merged [first, end) word spans of (first, words)."""
    out: list[list[int]] = []
    for first, n in sorted(marked):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], first + n)
        else:
            out.append([first, first + n])
    return [(a, b) for a, b in out]


def _searched(batch: pa.RecordBatch, blocks: list) -> Iterator[tuple[bytes | None, int, list[tuple[int, int]], set[str]]]:
    texts = raw(batch.column(batch.schema.get_field_index("text")))
    shard = Shard(texts)
    for block in blocks:
        shard.search(pickle.loads(block.value))
    yield from zip(texts, shard.sizes.tolist(), shard.spans(), shard.items, strict=True)


def _counted(n_words: int, spans: list[tuple[int, int]], items: set[str]) -> tuple:
    return n_words, sum(b - a for a, b in spans), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_Result = tuple[bytes | None, int, list[tuple[int, int]], set[str]]


def _applied(docs: DataFrame, benchmark: DataFrame, window: int, finish: Callable[[pa.RecordBatch, Iterator[_Result]], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """finish(batch, its texts with words, spans and items) over docs, in one round or after several."""
    sc, blocks = docs.sparkSession.sparkContext, benchmark_blocks(benchmark, window)
    first, ahead = list(itertools.islice(blocks, ROUND_BLOCKS)), list(itertools.islice(blocks, 1))
    if not ahead:
        held = [sc.broadcast(b) for b in first]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_chunks(batches, "text", SHARD_BYTES):
                yield finish(batch, _searched(batch, held))

        return docs.mapInArrow(run, schema)
    own = docs.withColumn("__tessera_mark", F.xxhash64("text"))
    found = None
    while first:
        held = [sc.broadcast(b) for b in first]
        got, _ = written(_round(own, held))
        for block in held:
            block.destroy()
        found = got if found is None else found.union(got)
        first, ahead = ahead + list(itertools.islice(blocks, ROUND_BLOCKS - len(ahead))), []
    merged = found.groupBy("d", "m").agg(F.flatten(F.collect_list("spans")).alias("__tessera_spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("__tessera_items"))
    both = own.join(merged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("__tessera_mark") == F.col("m")), "left").select(*docs.columns, "__tessera_spans", "__tessera_items")

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text", SHARD_BYTES):
            texts = raw(batch.column(batch.schema.get_field_index("text")))
            spans, items = (c.to_pylist() for c in batch.columns[-2:])
            results = ((t, len(words(t)), _spans([(x["first"], x["n"]) for x in s or ()]), set(i or ())) for t, s, i in zip(texts, spans, items, strict=True))
            yield finish(batch.select(batch.schema.names[:-2]), results)

    return both.mapInArrow(end, schema)


def _round(own: DataFrame, blocks: list) -> DataFrame:
    """d, m, spans, items of the documents in which a window of these blocks occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text", SHARD_BYTES):
            found = [(s, sorted(i)) for _, _, s, i in _searched(batch, blocks)]
            keep = pa.array([bool(i) for _, i in found], pa.bool_())
            spans = pa.array([[{"first": a, "n": b - a} for a, b in s] for s, _ in found], pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans, pa.array([i for _, i in found], pa.list_(pa.string()))], names=["d", "m", "spans", "items"]).filter(keep)

    schema = T.StructType([T.StructField("d", own.schema["doc_id"].dataType), T.StructField("m", T.LongType()),
                           T.StructField("spans", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("first", "n")]))), T.StructField("items", T.ArrayType(T.StringType()))])
    return own.select("doc_id", "__tessera_mark", "text").mapInArrow(run, schema)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 of every document."""
    def finish(batch: pa.RecordBatch, results: Iterator[_Result]) -> pa.RecordBatch:
        rows = [_counted(n, spans, items) for _, n, spans, items in results]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(c for c, _ in _COLUMNS)])

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, t) for c, t in _COLUMNS)])
    return _applied(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, window, finish, schema)


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at = [m.span() for m in _WORD.finditer(text.lower())]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end:at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, text[end:]])


def removed_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs with the merged spans of benchmark words cut out of text; whole words go, all else stays."""
    at = docs.columns.index("text")

    def finish(batch: pa.RecordBatch, results: Iterator[_Result]) -> pa.RecordBatch:
        columns = list(batch.columns)
        columns[at] = pa.array([t if not spans else _without(t, spans) for t, _, spans, _ in results], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return _applied(docs, benchmark, window, finish, docs.schema)
