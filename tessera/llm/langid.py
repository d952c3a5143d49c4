"""Language identification by prediction with partial matching.

For every language a byte context tree of order 3 is counted on a bounded sample of labelled texts and
frozen. A byte's code length is read from the longest context that has seen it; every shorter step
costs an escape, whose probability by method C is distinct / (total + distinct) of the context left.
Below order 0 all byte values are equally likely. A text's code length under a language is the sum
over its whole bytes; the language with the shortest code wins, and the score is its share of
2 ** -(bits per byte gained), a number from 0 to 1.

The trees are kept sparse: for every language and order the grams that its sample has, as sorted numbers
with the bits of their last byte, and the contexts with the bits of their escape. Texts are scored in steps
of STEP bytes: the distinct grams of a step are looked up once a language, and every byte takes its gram's bits.

Bounds: `per_language` texts expected per language, drawn by a hash of doc_id, texts over `max_bytes`
not among them; the fit alone is on a sample, every whole text is scored. What the sample has seen is kept
whole, whatever the number of languages; the broadcast trees grow with the distinct grams of the sample (8 bytes
each, and 8 a context), never with the documents.

Defined cases: a null text, or one without a letter (\\p{L}), is `und` with score 0; ties go to the
language first in order; rows with a null lang or text are not learned from; repeated rows are scored
each; an empty table gives an empty result; without a single labelled row every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import in_chunks

_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
_OUT_DDL = "doc_id long, held_out boolean, lang_pred string, score double"
ORDER = 3
#: Bytes of text scored at once.
STEP = 1 << 20


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, per_language: int = 400, max_bytes: int = 65_536) -> dict[str, list[bytes]]:
    """About per_language texts of every language, from documents that are not held out."""
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()
                       & F.col("text").rlike(r"\p{L}") & (F.octet_length("text") <= max_bytes)).select("doc_id", "lang", "text")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) / 1_000_003.0
    found: dict[str, list[bytes]] = {k: [] for k in sorted(counts)}
    for r in rows.filter(drawn < share[F.col("lang")]).orderBy(F.xxhash64("doc_id"), "text").toLocalIterator():
        found[r.lang].append(r.text.encode())
    return {k: v for k, v in found.items() if v}


class Tree:
    """One language's frozen contexts. A gram is a number of up to four bytes, the last one the byte told."""

    def __init__(self, texts: list[bytes]) -> None:
        said = np.frombuffer(b"".join(b"\n" * ORDER + t for t in texts), np.uint8).astype(np.uint32)
        inside = np.ones(max(0, len(said) - ORDER), bool)
        ends = np.cumsum([len(t) + ORDER for t in texts[:-1]], dtype=np.int64)
        for k in range(1, ORDER + 1):  # no window runs on into the next text's line feeds
            inside[ends - k] = False
        codes = said[:-3] << 24 | said[1:-2] << 16 | said[2:-1] << 8 | said[3:]
        whole, counts = np.unique(codes[inside], return_counts=True)
        #: By order, the highest first: mask, grams, their bits, contexts, the bits of their escapes.
        self.orders = []
        for k in range(ORDER, -1, -1):
            mask = np.uint32((1 << 8 * (k + 1)) - 1)
            grams, at = np.unique(whole & mask, return_inverse=True)
            contexts, of = np.unique(grams >> 8, return_inverse=True)
            n, distinct = np.bincount(at, counts, len(grams)), np.bincount(of, minlength=len(contexts))
            total = np.bincount(of, n, len(contexts)) + distinct
            if len(grams):
                self.orders.append((mask, grams, np.log2(total[of] / n).astype(np.float32), contexts, np.log2(total / distinct).astype(np.float32)))

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for order in self.orders for a in order[1:])

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of every gram of four bytes."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for mask, grams, bits, contexts, escapes in self.orders:
            own = codes[left] & mask
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            hit = grams[at] == own
            out[left[hit]] += bits[at[hit]]
            left, own = left[~hit], own[~hit] >> 8
            at = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
            out[left] += np.where(contexts[at] == own, escapes[at], 0)
        out[left] += 8
        return out


class Trees:
    """Frozen statistics of all languages."""

    def __init__(self, samples: dict[str, list[bytes]]) -> None:
        self.languages = sorted(samples)
        self.trees = [Tree(samples[k]) for k in self.languages]

    def lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of the texts data[starts[i]:starts[i + 1]], a column per language; no text is empty."""
        total = np.zeros((len(starts) - 1, len(self.languages)))
        for lo in range(0, len(data), STEP):
            hi, lead = min(lo + STEP, len(data)), min(lo, ORDER)
            s = np.concatenate([np.full(ORDER - lead, 10, np.uint8), data[lo - lead:hi]]).astype(np.uint32)
            i, j = np.searchsorted(starts, lo, side="right") - 1, np.searchsorted(starts, hi, side="left")
            codes = s[ORDER:].copy()
            for k in range(1, ORDER + 1):
                own = s[ORDER - k:len(s) - k].copy()
                for back in range(k):  # each text starts after line feeds
                    at = starts[max(0, i):j] + back
                    own[at[(at >= lo) & (at < np.minimum(starts[max(0, i) + 1:j + 1], hi))] - lo] = 10
                codes |= own << 8 * k
            found = pa.array(codes).dictionary_encode()
            distinct, at = found.dictionary.to_numpy(), found.indices.to_numpy()
            for column, tree in enumerate(self.trees):
                total[i:j, column] += np.add.reduceat(tree.bits(distinct)[at], np.maximum(starts[i:j], lo) - lo)
        return total


def identified(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = held.value
        for batch in in_chunks(batches, "text", 1 << 20):
            text = batch.column(0).cast(pa.binary())
            has = np.array(batch.column(3).to_pylist(), bool) & bool(trees.languages)
            best, score = np.zeros(len(text), int), np.zeros(len(text))
            if has.any():
                own = text.filter(pa.array(has))
                starts = np.concatenate([[0], np.cumsum(pa.compute.binary_length(own).to_numpy(zero_copy_only=False))])
                bits = trees.lengths(np.frombuffer(b"".join(own.to_pylist()), np.uint8), starts)
                best[has] = bits.argmin(1)
                each = (bits - bits.min(1, keepdims=True)) / np.diff(starts)[:, None]
                score[has] = 1 / np.exp2(-each).sum(1)
            names = [trees.languages[i] if h else "und" for i, h in zip(best, has, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(names, pa.string()), pa.array(score)], schema=_OUT)

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long"), held_out().alias("held_out"), has_letter.alias("has")).mapInArrow(run, _OUT_DDL)
