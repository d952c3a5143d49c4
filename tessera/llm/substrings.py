"""Removal of repeated passages with run-length indexes.

Every string of `length` bytes that also starts earlier in the corpus (smaller doc_id, or earlier in
the same document) is covered; the covered bytes go. Strings are judged on the input.

1. Anchors. A string's anchor is the least k-gram hash in it, the leftmost of equals, so equal strings
   have the same anchor at the same place. The starts with one anchor are contiguous; with their
   strings they form a segment. Only hashes of segments are exchanged, and a task settles beforehand
   those that it has seen at an earlier place: copies leave it as merged spans, not as segments.
2. Segments whose anchor stands elsewhere are grouped by it. Of segments with equal bytes all but the
   first are covered as a whole; the first ones, one per distinct content, go on.
3. Blocks of such segments, all of an anchor in one, are indexed: a run-compressed Burrows-Wheeler
   transform (run starts, symbols, counts), suffix positions sampled at the separators and at the
   ends of runs of rows that agree on `length` bytes, each with its earliest segment. All segments
   then stream backwards through the runs in step; a start whose match of `length` bytes has an
   earlier segment is marked. An anchor with over HOT distinct segments is not indexed in one task: its
   strings go one by one, and the earliest of each is found by an aggregation.
4. Marks become merged spans per document.

Equal strings meet in step 2 or 3 always, and no string of one anchor can equal one of another, so the
result is exact (up to equal 64-bit hashes of segments of one anchor and size that differ).

Defined cases: null texts are empty; texts shorter than `length` are kept; rows with one doc_id and
equal text are one document, each returning its result; rows with one doc_id and different texts are
ordered by a hash of the text; a null doc_id comes before all others; empty tables give empty results.
"""

from __future__ import annotations

import functools
import hashlib
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import in_chunks, needed, raw, written

GRAM = 32
#: Bytes of text scanned at once, and of segments in an index.
CHUNK_BYTES = 1 << 20
INDEX_BYTES = 1 << 19
#: Segments that a task looks through for copies at once.
COMBINED = 1 << 18
#: Distinct segments of an anchor that one index takes: under INDEX_BYTES at the default length.
HOT = INDEX_BYTES // 200
#: A text of so many bytes is scanned in parts, as its places need more than 24 bits; and the bytes of a part.
WHOLE_BYTES = 1 << 24
PART_BYTES = 1 << 23
_AT_BITS = np.uint64(24)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
                       F.xxhash64(text).alias("mark"), text.alias("text"))


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, as a number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(hash, place, first start, last start) of the anchors in texts that end at `ends` of data."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    n = len(data) - length + 1
    if n < 1:
        return none
    gram = min(GRAM, length)
    x, h = _eights(data), np.zeros(len(data) - gram + 1, np.uint64)
    for i in range(0, gram - 7, 8):
        h = (h ^ (h >> np.uint64(29))) * _ODD[1] + x[i:i + len(h)] * _ODD[i // 8 % 4]
    h ^= h >> np.uint64(32)
    h *= _ODD[2]
    least = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    window, width = length - gram + 1, 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if window > width:
        least = np.minimum(least[:n], least[window - width:window - width + n])
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    # Starts whose string runs over a text's end do not count.
    valid = np.ones(n + 1, bool)
    valid[n] = False
    for end in ends.tolist():
        valid[max(0, end - length + 1):min(end, n)] = False
    at = np.where(valid[:n], at, -1)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(new[1:], n) - 1
    good = at[new] >= 0
    new, last = new[good], last[good]
    # A run of one anchor never spans texts: between them are starts that do not count.
    return h[at[new]], at[new], new, last


_FOUND = pa.schema([("hash", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()),
                    ("first", pa.int32()), ("last", pa.int32()), ("done", pa.bool_())])


def _combined(parts: list[tuple[np.ndarray, ...]], length: int) -> pa.RecordBatch:
    """Segments (hash, content, doc_id, mark, first, last) of a task without those that an equal one at an
    earlier place covers; these become merged spans, marked as done."""
    h, c, d, m, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((a, m, d, b - a, c, h))
    h, c, d, m, a, b = (x[order] for x in (h, c, d, m, a, b))
    differ = lambda *columns: np.concatenate([[True], np.any([x[1:] != x[:-1] for x in columns], 0)]) if len(h) else np.zeros(0, bool)
    new = differ(h, c, b - a)
    done = ~new & differ(d, m, a)  # one place is met again in repeated rows, which are one document
    dd, dm, da, db = (x[done] for x in (d, m, a, b))
    order = np.lexsort((da, dm, dd))
    dd, dm, da, db = (x[order] for x in (dd, dm, da, db))
    # Segments of a text neither nest nor meet in a start, so their ends rise with their starts.
    head = np.flatnonzero(np.concatenate([[True], (dd[1:] != dd[:-1]) | (dm[1:] != dm[:-1]) | (da[1:] > db[:-1] + length)])) if len(dd) else np.zeros(0, int)
    tail = np.append(head[1:], len(dd)) - 1 if len(dd) else head
    none = np.zeros(len(head), np.int64)
    columns = [(h[new], none), (c[new], none), (d[new], dd[head]), (m[new], dm[head]), (a[new], da[head]), (b[new], db[tail]), (np.zeros(new.sum(), bool), none == 0)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)).cast(f.type) for x, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


def _found(keyed: DataFrame, length: int) -> DataFrame:
    """hash, content, doc_id, mark, first, last, done: every anchor with its segment's starts; or (done)
    merged starts of segments that an earlier place of the same task covers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        parts, size = [], 0
        for batch in in_chunks(batches, "text", CHUNK_BYTES):
            texts = raw(batch.column(2))
            ids, marks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            count = len(texts) if sum(map(len, texts)) < WHOLE_BYTES else 1
            for lo in range(0, max(1, len(texts)), count):
                for part in one(ids[lo:lo + count], marks[lo:lo + count], texts[lo:lo + count], digest):
                    parts.append(part)
                    size += len(part[0])
                    if size > COMBINED:
                        yield _combined(parts, length)
                        parts, size = [], 0
        if parts:
            yield _combined(parts, length)

    def one(ids, marks, texts, digest):  # noqa: ANN001, ANN202
        joined = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        # A text beyond the bits of a place is scanned in overlapping parts. Each has the runs that begin in
        # its step; the byte before it shows which runs began earlier and so are those of the part before.
        step, size = PART_BYTES, len(joined)
        parted = size >= WHOLE_BYTES
        for base in range(0, size, step) if parted else (0,):
            lead = 1 if base else 0
            part = joined[base - lead:base + step + length - 1 + 2 * length] if parted else joined
            at_ends = np.array([len(part)]) if parted else ends
            h, _, first, last = anchors(np.frombuffer(part, np.uint8), at_ends, length)
            if parted:
                keep = (first >= lead) & (first < lead + step)
                h, first, last = h[keep], first[keep], last[keep]
            view = memoryview(part)
            content = np.array([digest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64)
            doc = np.searchsorted(at_ends, first, side="right")
            start = np.concatenate([[0], at_ends])[doc] - (base - lead)
            yield h.astype(np.int64), content.astype(np.int64), ids[doc], marks[doc], first - start, last - start

    return keyed.mapInArrow(run, "hash long, content long, doc_id long, mark long, first int, last int, done boolean")


def shared(keyed: DataFrame, length: int) -> DataFrame:
    """The anchors that stand twice or more, `again` if an equal segment is earlier, with the number k of
    distinct segments of the anchor; written. Repeated rows are one document, so each place counts once."""
    found = _found(keyed, length).withColumns({
        "key": F.when(F.col("done"), F.xxhash64("doc_id", "first")).otherwise(F.col("hash")), "width": F.col("last") - F.col("first")})
    w = Window.partitionBy("key", "done").orderBy("content", "width", "doc_id", "mark", "first")
    place = ("doc_id", "mark", "first")
    beside = found.select(
        "*", F.lag("content").over(w).alias("before"), F.lag("width").over(w).alias("before_width"), F.lead("content").over(w).alias("after"),
        *(F.lag(c).over(w).alias(f"before_{c}") for c in place))
    equal = F.col("before").eqNullSafe(F.col("content")) & F.col("before_width").eqNullSafe(F.col("width"))
    same = functools.reduce(operator.and_, [equal, *(F.col(f"before_{c}").eqNullSafe(F.col(c)) for c in place)])
    judged = beside.filter(F.col("done") | ((F.col("before").isNotNull() | F.col("after").isNotNull()) & ~same)).select(
        "key", "done", "hash", "doc_id", "mark", "first", "last", (F.col("done") | equal).alias("again"))
    return written(judged.withColumn("k", F.sum(F.when(F.col("again"), 0).otherwise(1)).over(Window.partitionBy("key", "done"))).drop("key", "done"))[0]


class RunLengthIndex:
    """Run-compressed transform of segments, each closed by a separator, in order of appearance."""

    def __init__(self, segments: list[bytes], length: int) -> None:
        text = np.frombuffer(b"".join(segments), np.uint8)
        sizes = np.array([len(s) for s in segments])
        n = len(text) + len(segments)
        self.sizes, self.length = sizes, length
        self.closed = np.cumsum(sizes + 1) - 1
        symbols = np.zeros(n, np.uint16)  # 0: separator
        inside = np.ones(n, bool)
        inside[self.closed] = False
        symbols[inside] = text.astype(np.uint16) + 1
        segment = np.repeat(np.arange(len(segments)), sizes + 1)
        order, deep, depth = self._sorted(symbols)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        # Runs of the transform.
        last = symbols[order - 1]
        starts = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        runs = last[starts].astype(np.int64)
        by = np.lexsort((starts, runs))
        lengths = np.diff(np.append(starts, n))[by]
        counts = np.cumsum(lengths) - lengths
        firsts = np.concatenate([[0], np.cumsum(np.bincount(last, minlength=258))])
        self.n, self.starts, self.runs = n, starts, runs
        #: By run in row order: the row that its first row's predecessor has.
        self.to = np.empty(len(starts), np.int64)
        self.to[by] = counts  # counts are over symbols in order, so they hold the symbol's first row too
        assert (self.to >= firsts[runs]).all()
        # Rows that agree on `length` symbols, each run of them with its earliest segment.
        wide = np.append(deep, np.full(length, -1))
        one, two = wide[order], wide[order + (length - depth)]
        heads = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
        self.heads, self.earliest = heads, np.minimum.reduceat(segment[order], heads)
        self.sampled = rank[self.closed]

    def _sorted(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Suffix array, and ranks by the first `depth` symbols, depth <= length < 2 * depth."""
        n, depth = len(symbols), 1
        order = np.argsort(symbols, kind="stable")
        heads = np.concatenate([[True], symbols[order][1:] != symbols[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
        deep = None
        width = 1
        while True:
            if 2 * width > self.length and deep is None:
                deep, depth = rank.copy(), width
            if heads.all():
                break
            at = np.flatnonzero(~(heads & np.append(heads[1:], True)))
            pos = order[at]
            after = pos + width
            second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            again = np.argsort(rank[pos] * (n + 1) + second, kind="stable")
            pos, second, first = pos[again], second[again], rank[pos[again]]
            order[at] = pos
            new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
            heads[at] |= new
            rank[pos] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            width *= 2
        if deep is None:
            deep, depth = rank, self.length
        return order, deep, depth

    def before(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one symbol longer."""
        run = np.searchsorted(self.starts, rows, side="right") - 1
        return self.to[run] + rows - self.starts[run]

    def marks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(segments, starts) whose string an earlier segment has; all segments stream in step."""
        live = np.arange(len(self.sizes))
        rows, left = self.sampled.copy(), self.sizes.copy()
        while len(live):
            rows, left = self.before(rows), left - 1
            full = self.sizes[live] - left >= self.length
            group = np.searchsorted(self.heads, rows[full], side="right") - 1
            hit = self.earliest[group] < live[full]
            yield live[full][hit], left[full][hit]
            more = left > 0
            live, rows, left = live[more], rows[more], left[more]


def _runs(segments: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(segment, first, last) of gapless runs of starts."""
    order = np.lexsort((starts, segments))
    s, a = segments[order], starts[order]
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (a[1:] != a[:-1] + 1)])) if len(s) else np.zeros(0, int)
    return s[new], a[new], a[np.append(new[1:], len(a)) - 1] if len(s) else a


def _indexed(length: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            index = RunLengthIndex([r[4] for r in held], length)
            found = list(index.marks())
            s, a, b = _runs(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
            rows = [(held[i][1], held[i][2], held[i][3] + x, held[i][3] + y + length) for i, x, y in zip(s.tolist(), a.tolist(), b.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                              names=["doc_id", "mark", "start", "end"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > INDEX_BYTES and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield flush()

    return run


def _with_text(keyed: DataFrame, firsts: DataFrame) -> DataFrame:
    """doc_id, mark, text, cuts (the segments to take) of the documents that have any."""
    wanted, _ = written(firsts.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("hash", "first", "last")).alias("cuts")))
    return needed(keyed, wanted).join(wanted, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select("doc_id", "mark", "text", "cuts")


def covered(keyed: DataFrame, length: int) -> DataFrame:
    """doc_id, mark, start, end: spans of bytes to remove, which may overlap."""
    rows = shared(keyed, length)
    again = rows.filter("again").select("doc_id", "mark", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    firsts = rows.filter("not again and k > 1")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text", CHUNK_BYTES):
            out: list[tuple] = []
            for doc_id, mark, text, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                out += [(c["hash"], doc_id, mark, c["first"], text[c["first"]:c["last"] + length]) for c in cuts]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                                             names=["hash", "doc_id", "mark", "first", "segment"])

    found = _with_text(keyed, firsts.filter(F.col("k") <= HOT)).mapInArrow(segments, "hash long, doc_id long, mark long, first int, segment binary")
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = found.repartition(parts, "hash").sortWithinPartitions("hash", "doc_id", "mark", "first")
    spans = again.union(placed.mapInArrow(_indexed(length), "doc_id long, mark long, start int, end int"))
    hot = firsts.filter(F.col("k") > HOT)
    return spans if hot.isEmpty() else spans.union(_by_string(keyed, hot, length))


def _by_string(keyed: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """doc_id, mark, start, end of the strings in segments of hot anchors that start earlier too."""
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text", CHUNK_BYTES):
            for doc_id, mark, text, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                view = memoryview(text)
                starts = [i for c in cuts for i in range(c["first"], c["last"] + 1)]
                for at in range(0, len(starts), COMBINED):
                    own = starts[at:at + COMBINED]
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([xxhash.xxh3_128_digest(view[i:i + length]) for i in own], pa.binary()), pa.array([doc_id] * n, pa.int64()),
                        pa.array([mark] * n, pa.int64()), pa.array(own, pa.int32())], names=["string", "doc_id", "mark", "start"])

    rows, _ = written(_with_text(keyed, firsts).mapInArrow(strings, "string binary, doc_id long, mark long, start int"))
    place = F.struct("doc_id", "mark", "start")
    earliest = rows.groupBy("string").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.join(earliest, "string").filter(place > F.col("earliest")).select("doc_id", "mark", "start", (F.col("start") + length).alias("end"))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _whole(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn in to whole characters."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return out


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, end = [], 0
    for a, b in spans:
        out.append(text[end:a])
        end = b
    return b"".join([*out, text[end:]])


def _with_spans(keyed: DataFrame, length: int) -> DataFrame:
    spans = covered(keyed, length).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return keyed.join(spans, ["doc_id", "mark"], "left")


def digests(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text", CHUNK_BYTES):
            rows = []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), raw(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                spans = _merged(found)
                rows.append((None if doc_id == -(1 << 63) else doc_id, len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(text, spans)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(_keyed(docs), length).select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs with repeated passages cut out of text, in whole characters; rows left empty by that go."""
    keyed = _keyed(docs)
    spans = covered(keyed, length).groupBy(F.col("doc_id").alias("__tessera_d"), F.col("mark").alias("__tessera_m")).agg(F.collect_set(F.struct("start", "end")).alias("__tessera_s"))
    own = docs.withColumns({"__tessera_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__tessera_x": F.xxhash64(F.coalesce("text", F.lit("")))})
    both = own.join(spans, (F.col("__tessera_k") == F.col("__tessera_d")) & (F.col("__tessera_x") == F.col("__tessera_m")), "left").select(*docs.columns, "__tessera_s")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text", CHUNK_BYTES):
            texts = raw(batch.column(at))
            left = [t if not s else _kept(t, _whole(t, _merged(s))) for t, s in zip(texts, batch.column(len(docs_columns)).to_pylist(), strict=True)]
            columns = list(batch.columns)[:len(docs_columns)]
            columns[at] = pa.array(left, pa.binary()).cast(pa.string())
            keep = pa.array([not t or bool(x) for t, x in zip(texts, left, strict=True)])
            yield pa.RecordBatch.from_arrays(columns, names=docs_columns).filter(keep)

    docs_columns = docs.columns
    return both.mapInArrow(run, T.StructType(list(docs.schema)))
