"""Divergence of the sources of a language: exact sums over all terms, heavy and light terms apart.

Tasks count terms of whole texts per (lang, source) and hand on one row per term; one exchange by (lang,
term) sums them and drops terms in fewer than three documents. Terms are then dealt into blocks by
hash. A block holds its terms for all sources of the language, and its task splits them:

- heavy terms, present in many of the sources, are dense NumPy tiles, terms by sources;
- light terms are posting lists. If a source lacks a term its share is the one of count 0, so a pair's sum
  starts from all terms absent on both sides, gets the counts of one side by their histogram, and a correction
  for each two sources in one list.

Both partial sums are added, and those of all blocks, exactly: shares are integers in billionths, worked out
by long division, and sums are decimals in the exchange.

Terms are maximal runs of A-Z, a-z and all characters beyond ASCII; A-Z alone is lower-cased. Bounds of the
arithmetic: 9e15 occurrences and 2e9 terms per language.

Defined cases: null text, lang and source are empty strings; a group without terms counts every term 0 times;
a language without kept terms has pairs of value 0 and no term rows; repeated rows count each; very long texts
are split at separators piece by piece; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import in_chunks, raw, written

UNIT = 1_000_000_000
LEAST_DOCUMENTS = 3
#: Entries of a task's tables of counts before they are handed on, and bytes of text split at once.
HELD = 400_000
PIECE = 4 << 20
#: Posting rows of a block about, and cells of a tile.
BLOCK_ROWS = 1 << 17
CELLS = 1 << 18
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
_OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())])
_OUT_DDL = "lang string, source string, part string, item binary, value long"

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in lists of about `piece` bytes."""
    text, at = text.translate(_LETTERS), 0
    while len(text) - at > piece:
        cut = text.rfind(b" ", at, at + piece)
        if cut <= at:
            cut = text.find(b" ", at + piece)
            if cut < 0:
                break
        yield text[at:cut].split()
        at = cut
    yield text[at:].split()


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: counts of a task's documents, and a row without term per group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: dict[tuple, Counter] = {}
        having: dict[tuple, Counter] = {}

        def rows() -> pa.RecordBatch:
            sizes = [len(c) + 1 for c in said.values()]
            columns = [pa.array([k[i] for k in said], pa.string()).take(pa.array(np.repeat(np.arange(len(said)), sizes))) for i in (0, 1)]
            term = pa.array([t for c in said.values() for t in (None, *c)], pa.binary())
            n = pa.array([x for c in said.values() for x in (0, *c.values())], pa.int64())
            docs = pa.array([x for k, c in said.items() for x in (0, *map(having[k].__getitem__, c))], pa.int64())
            return pa.RecordBatch.from_arrays([*columns, term, n, docs], schema=_COUNTS)

        held = 0
        for batch in in_chunks(batches, "text", PIECE):
            for text, lang, source in zip(raw(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                key = (lang, source)
                n, d = said.setdefault(key, Counter()), having.setdefault(key, Counter())
                before, seen = len(n), set()
                for words in terms(text):
                    n.update(words)
                    seen.update(words)
                d.update(seen)
                held += len(n) - before
                if held > HELD:
                    yield rows()
                    said.clear()
                    having.clear()
                    held = 0
        if said:
            yield rows()

    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))).mapInArrow(
        run, "lang string, source string, term binary, n long, docs long")


def postings(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, total (over the language), leads (one row of a term does), of kept terms; and a row
    without term per group. Rows of a term meet once: as many as its sources, after one row per task."""
    each = Window.partitionBy("lang", "term")
    rows = counted(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = rows.select("lang", "source", "term", "n", F.sum("n").over(each).alias("total"), F.sum("docs").over(each).alias("docs"),
                       (F.min("source").over(each) == F.col("source")).alias("leads"))
    return rows.filter(F.col("term").isNull() | (F.col("docs") >= LEAST_DOCUMENTS)).drop("docs")


def shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (n + 1) / whole) by long division, three digits at a time."""
    out, rest = np.divmod(n + 1, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def dense(counts: np.ndarray, wholes: np.ndarray, sums: np.ndarray) -> None:
    """Add the terms of a tile (rows) over all sources (columns) to sums[source, item]."""
    step = max(1, CELLS // max(1, len(wholes)))
    for lo in range(0, len(counts), step):
        p = shares(counts[lo:lo + step], wholes[None, :])
        for item in range(len(wholes)):
            sums[:, item] += gain(p, p[:, item:item + 1]).sum(0)


def sparse(term: np.ndarray, source: np.ndarray, n: np.ndarray, wholes: np.ndarray, sums: np.ndarray) -> None:
    """Add the terms of posting lists, sorted by term, to sums[source, item]."""
    if not len(term):
        return
    absent = shares(np.zeros(len(wholes), np.int64), wholes)
    both = gain(absent[:, None], absent[None, :])
    _, first, lengths = np.unique(term, return_index=True, return_counts=True)
    sums += len(first) * both
    # Counts on one side, none on the other.
    seen, times = np.unique(np.stack([source, n]), axis=1, return_counts=True)
    for lo in range(0, seen.shape[1], step := max(1, CELLS // len(wholes))):
        g, k = seen[0, lo:lo + step], times[lo:lo + step, None]
        p = shares(seen[1, lo:lo + step], wholes[g])[:, None]
        np.add.at(sums, g, k * (gain(p, absent[None, :]) - both[g]))
        np.add.at(sums.T, g, k * (gain(absent[None, :], p) - both[:, g].T))
    # Counts on both sides.
    for size in np.unique(lengths[lengths > 1]):
        starts = first[lengths == size]
        for lo in range(0, len(starts), step := max(1, CELLS // int(size * size))):
            at = starts[lo:lo + step, None] + np.arange(size)
            g, p = source[at], shares(n[at], wholes[source[at]])
            i, j = (np.broadcast_to(x, (len(at), size, size)) for x in (g[:, :, None], g[:, None, :]))
            p, q, p0, q0 = p[:, :, None], p[:, None, :], absent[i], absent[j]
            np.add.at(sums, (i, j), gain(p, q) - gain(p, q0) - gain(p0, q) + gain(p0, q0))


def pair_sums(term: np.ndarray, source: np.ndarray, n: np.ndarray, wholes: np.ndarray) -> np.ndarray:
    """sums[source, item] over terms; entries sorted by term, one per source at most."""
    sums = np.zeros((len(wholes), len(wholes)), np.int64)
    if not len(term):
        return sums
    names, ids, lengths = np.unique(term, return_inverse=True, return_counts=True)
    heavy = lengths * 3 > len(wholes)
    own = heavy[ids]
    row = np.cumsum(heavy) - 1
    tile = np.zeros((int(heavy.sum()), len(wholes)), np.int64)
    tile[row[ids[own]], source[own]] = n[own]
    dense(tile, wholes, sums)
    sparse(term[~own], source[~own], n[~own], wholes, sums)
    return sums


def _block(top: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        """A block of a language: partial sums of pairs, and the top terms of every source."""
        group = table.filter(pc.is_null(table["term"]))
        posts = table.filter(pc.is_valid(table["term"]))
        names = group["source"].combine_chunks()
        lang, n_terms, n_all = (group[c][0].as_py() for c in ("lang", "n_terms", "n_lang"))
        wholes = group["n_source"].to_numpy() + n_terms
        source = pc.index_in(posts["source"], names).to_numpy().astype(np.int64)
        words = posts["term"].combine_chunks().dictionary_encode()
        spelled = np.array([*words.dictionary.to_pylist(), None], object)[:-1]
        rank = np.empty(len(spelled), np.int64)
        rank[sorted(range(len(spelled)), key=spelled.__getitem__)] = np.arange(len(spelled))
        term = rank[words.indices.to_numpy()]
        order = np.lexsort((source, term))
        term, source, n, total = term[order], source[order], posts["n"].to_numpy()[order], posts["total"].to_numpy()[order]
        by_rank = np.empty(len(spelled), object)
        by_rank[rank] = spelled
        sums = pair_sums(term, source, n, wholes) if n_terms else np.zeros((len(names), len(names)), np.int64)
        g, h = np.nonzero(~np.eye(len(names), dtype=bool))
        source_of, items, values = [g], [np.array([x.encode() for x in names.to_pylist()] + [None], object)[:-1][h]], [sums[g, h]]
        if len(term):
            p, q = shares(n, wholes[source]), shares(total, np.int64(n_all + n_terms))
            value = gain(p, q)
            order = np.lexsort((term, -value, source))
            order = order[(n[order] > 0) & (p[order] > q[order])]
            s = source[order]
            nth = np.arange(len(s)) - np.searchsorted(s, s)
            order = order[nth < top]
            source_of.append(source[order])
            items.append(by_rank[term[order]])
            values.append(value[order])
        at = np.concatenate(source_of)
        part = pa.array(["pair"] * len(g) + ["term"] * (len(at) - len(g)), pa.string())
        return pa.Table.from_arrays([pa.array([lang] * len(at), pa.string()), names.take(pa.array(at)), part,
                                     pa.array(np.concatenate(items), pa.binary()), pa.array(np.concatenate(values))], schema=_OUT)

    return run


def diverging(docs: DataFrame, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language by divergence, and the terms
    that set a source apart most, `top` of them."""
    posts, _ = written(postings(docs))
    of_lang = Window.partitionBy("lang")  # a row per source
    groups = posts.groupBy("lang", "source").agg(F.sum("n").alias("n_source"), F.sum(F.when(F.col("leads") & F.col("term").isNotNull(), 1).otherwise(0)).alias("own"),
                                                 F.count("term").alias("rows"))
    groups = groups.select("lang", "source", "n_source", F.sum("own").over(of_lang).alias("n_terms"), F.sum("n_source").over(of_lang).alias("n_lang"),
                           F.sum("rows").over(of_lang).alias("rows"), F.count(F.lit(1)).over(of_lang).alias("sources"))
    # No more blocks than keep a block's sums within the size of its terms.
    blocks = F.greatest(F.lit(1), F.least(F.ceil(F.col("rows") / BLOCK_ROWS), F.floor(F.col("n_terms") / F.col("sources")))).cast("int")
    groups, _ = written(groups.withColumn("blocks", blocks).drop("rows", "sources"))
    # Small by its files, this is broadcast by Spark; many languages are joined by an exchange instead.
    per_lang, _ = written(groups.select("lang", "blocks").distinct())
    dealt = posts.filter("term is not null").join(per_lang, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "n", "total",
        *(F.lit(None).cast("long").alias(c) for c in ("n_source", "n_terms", "n_lang")))
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("binary").alias("term"),
                          F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("total"), "n_source", "n_terms", "n_lang")
    partial, _ = written(dealt.unionByName(heads).groupBy("lang", "block").applyInArrow(_block(top), _OUT_DDL))
    pair = partial.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    term = partial.filter("part = 'term'").select("*", rank.alias("rank")).filter(F.col("rank") <= top)
    out = pair.select("*", rank.alias("rank")).unionByName(term)
    return out.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")
