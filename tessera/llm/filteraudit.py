"""Audit of filters applied in any order: a packed bitmap index, counted by prefix subset.

Every document has a bit per filter that it fails. A task packs the rows of an Arrow batch into NumPy
bitsets, one per filter and label, each part in words of its own; for every subset of filters AND-NOT
leaves the documents that the subset keeps, and popcounts give their number per part and label. These
counts are summed over batches and partitions: 2 ** filters rows per part are all that is exchanged.
Every order of filters is read from them, since what a filter removes after a prefix is the difference
between what the prefix keeps and what both keep.

The copy filter fails a document whose text a smaller doc_id has too. Least ids are found by an
aggregation over digests of texts, combined before the exchange, and go back to rows by doc_id and digest,
so a large group of copies never meets in one task. Texts are equal if their SHA-256 is.

Defined cases: a null text is empty; a null part is the empty string; rows of one doc_id and text are judged
alike; of a doc_id labelled twice a label counts once it is 1; a null doc_id has no labels, is no copy and makes
none; a row with a filter that is null passes it; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import written

_COUNTS = pa.schema([("part", pa.string()), ("subset", pa.int32()), ("n", pa.int64()), ("good", pa.int64()), ("toxic", pa.int64())])
_COUNTS_DDL = "part string, subset int, n long, good long, toxic long"
#: The name under which the copy filter stands among the others.
COPIES = "copies"


def text_filters() -> dict[str, Column]:
    """The row-local filters of the audit by letter: true where a document fails. They read columns `text` and `words`."""
    text, words = F.col("text"), F.col("words")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str | None = None) -> DataFrame:
    """part, fails (a bit per filter in order, the copy filter's last), good, toxic of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"),
                       F.array_remove(F.split(text, r"[ \t-\r]+"), "").alias("words"))
    bits = F.lit(0)
    for i, test in enumerate(filters.values()):
        bits = bits + F.when(test, F.lit(1 << i)).otherwise(F.lit(0))
    # Texts are read once: what follows works on rows of a few bytes.
    rows, _ = written(base.select("doc_id", "part", bits.alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest")))
    named = rows.filter("doc_id is not null")
    said = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    out = named.join(said, "doc_id", "left")
    if copies is not None:
        least = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("least", F.lit(True))
        out = out.join(least, ["doc_id", "digest"], "left").withColumn(
            "fails", F.col("fails") + F.when(F.col("least"), F.lit(0)).otherwise(F.lit(1 << len(filters))))
    no = F.lit(False)
    out = out.select("part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return out.union(rows.filter("doc_id is null").select("part", "fails", no, no))


class Bitmaps:
    """The rows of one batch as bitsets; a part's rows fill whole words of their own."""

    def __init__(self, codes: np.ndarray, n_parts: int) -> None:
        sizes = np.bincount(codes, minlength=n_parts)
        words = -(-sizes // 64)
        self.starts = np.concatenate([[0], np.cumsum(words)[:-1]])
        self.n_bits = int(words.sum()) * 64
        order = np.argsort(codes, kind="stable")
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.place = np.empty(len(codes), np.int64)
        self.place[order] = self.starts[codes[order]] * 64 + np.arange(len(codes)) - first[codes[order]]

    def packed(self, flags: np.ndarray) -> np.ndarray:
        bits = np.zeros(self.n_bits, bool)
        bits[self.place[flags]] = True
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def counts(self, bitmap: np.ndarray) -> np.ndarray:
        """Set bits per part."""
        return np.add.reduceat(np.bitwise_count(bitmap).astype(np.int64), self.starts)


def kept_by_subset(rows: DataFrame, n_filters: int) -> DataFrame:
    """part, subset, n, good, toxic: documents that pass every filter of the subset."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(0).dictionary_encode()
            maps = Bitmaps(parts.indices.to_numpy(), len(parts.dictionary))
            fails = batch.column(1).to_numpy(zero_copy_only=False)
            every = maps.packed(np.ones(len(fails), bool))
            chosen = [every, *(maps.packed(batch.column(i).to_numpy(zero_copy_only=False)) for i in (2, 3))]
            failing = [maps.packed(fails >> i & 1 == 1) for i in range(n_filters)]
            gone = [np.zeros_like(every)]
            found = np.empty((len(parts.dictionary), 1 << n_filters, 3), np.int64)
            for subset in range(1 << n_filters):
                if subset:  # one filter more than a subset that came before
                    top = subset.bit_length() - 1
                    gone.append(gone[subset ^ 1 << top] | failing[top])
                for j, bitmap in enumerate(chosen):
                    found[:, subset, j] = maps.counts(bitmap & ~gone[subset])
            for name, table in zip(parts.dictionary.to_pylist(), found, strict=True):
                totals[name] = totals[name] + table if name in totals else table
            if len(totals) > 20_000:  # parts without bound are summed by the exchange
                yield _rows(totals)
                totals = {}
        if totals:
            yield _rows(totals)

    return rows.mapInArrow(run, _COUNTS_DDL).groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def _rows(totals: dict[str, np.ndarray]) -> pa.RecordBatch:
    table = np.concatenate(list(totals.values()))
    each = len(table) // len(totals)
    names = pa.array(np.repeat(np.array(list(totals), object), each), pa.string())
    return pa.RecordBatch.from_arrays([names, pa.array(np.tile(np.arange(each, dtype=np.int32), len(totals))), *(pa.array(table[:, j]) for j in range(3))], schema=_COUNTS)


def orders(counts: DataFrame, names: str) -> DataFrame:
    """A row per part, order of the filters (letters of names) and step."""
    whole = F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic")))  # 2 ** filters rows a part
    steps = len(names)
    bit = lambda i: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(names), F.substring("filter_order", i, F.lit(1))) - 1)
    rows = counts.groupBy("part").agg(whole.alias("kept_by"))
    rows = rows.select("*", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(names)))).alias("filter_order"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, range(1, steps + 1)))).alias("step"))
    prefix = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), lambda a, i: a + F.when(i < F.col("step"), bit(i)).otherwise(F.lit(0)))
    rows = rows.select("*", prefix.alias("before"), bit(F.col("step")).alias("own"))
    at = lambda mask: F.get("kept_by", mask)
    here, after, all_ = at(F.col("before")), at(F.col("before") + F.col("own")), (1 << steps) - 1
    removed = here["n"] - after["n"]
    rows = rows.select(
        "part", "filter_order", "step", "own", after["n"].alias("kept"), removed.alias("removed"),
        (at(F.lit(0))["n"] - at(F.col("own"))["n"] - removed).alias("redundant"),
        (at(F.lit(all_) - F.col("own"))["n"] - at(F.lit(all_))["n"]).alias("unique_fails"),
        (here["good"] - after["good"]).alias("good_lost"), (here["toxic"] - after["toxic"]).alias("toxic_lost"))
    shapley = F.sum("removed").over(Window.partitionBy("part", "own"))  # a row per order
    return rows.select(*[c for c in rows.columns if c != "own"], shapley.alias("shapley"))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to D and of copies, E, in all orders."""
    filters = text_filters()
    rows = failures(docs, labels, filters, copies=COPIES)
    return orders(kept_by_subset(rows, len(filters) + 1), "".join(filters) + "E")
