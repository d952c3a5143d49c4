"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie of word-initial and of continuing pieces. Every node has a failure link: the
node reached after giving out the longest pieces of what was read so far, and the number of pieces
given out on the way. A word is then counted in one pass over its characters, without going back and
without building a piece.

A word that the vocabulary cannot spell is one unknown token. Words are `[^\\x20\\x09-\\x0D]+`.

Defined cases: a null or empty text has no words and no tokens; repeated rows are counted each; an
empty table gives an empty result; other columns are carried, those named like a count replaced.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._util import in_chunks, raw

_COUNTS = ("n_words", "n_tokens", "n_unknown")
#: Entries of a task's memo of words, cleared when full.
MEMO = 500_000


class LongestMatch:
    """n_pieces(word), 0 for a word that cannot be spelled."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}, {}]  # node 0: a word's start; node 1: within a word
        ends = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for c in piece:
                    if (to := self.next[node].get(c)) is None:
                        to = self.next[node][c] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    node = to
                ends[node] = node > 1 or ends[node]
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque((to, parent, c) for parent in (0, 1) for c, to in self.next[parent].items())
        while queue:
            node, parent, c = queue.popleft()
            if ends[node]:
                self.fail[node], self.popped[node] = 1, 1
            else:
                at, count = self.fail[parent], self.popped[parent]
                while at >= 0 and c not in self.next[at]:
                    count += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.next[at][c], count
            queue.extend((to, node, x) for x, to in self.next[node].items())

    def n_pieces(self, word: str) -> int:
        step, fail, popped = self.next, self.fail, self.popped
        node = count = 0
        for c in word:
            while (to := step[node].get(c)) is None:
                count += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = to
        while node > 1:
            count += popped[node]
            node = fail[node]
        return count if node == 1 else 0


def sentencepiece_pieces(path: str) -> tuple[list[str], list[str]]:
    """Word-initial and continuing pieces of a sentencepiece vocabulary file: those that its word mark
    starts, without it, and the others; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p[1:] for p in pieces if p[0] == "▁" and len(p) > 1], [p for p in pieces if "▁" not in p]


def token_counts(docs: DataFrame, initial: list[str], continuing: list[str]) -> DataFrame:
    """docs with n_words, n_tokens and n_unknown of every whole text."""
    docs = docs.drop(*_COUNTS)
    held = docs.sparkSession.sparkContext.broadcast((initial, continuing))  # a vocabulary file's pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = LongestMatch(*held.value)

        class Memo(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= MEMO:
                    self.clear()
                n = self[word] = match.n_pieces(word.decode("utf-8", "replace"))
                return n

        count = Memo().__getitem__
        for batch in in_chunks(batches, "text", 4 << 20):
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(raw(batch.column(batch.schema.get_field_index("text")))):
                if text and (words := text.split()):
                    n = list(map(count, words))
                    unknown = n.count(0)
                    out[:, i] = len(n), sum(n) + unknown, unknown
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], names=[*batch.schema.names, *_COUNTS])

    schema = T.StructType([*docs.schema, *(T.StructField(c, T.LongType()) for c in _COUNTS)])
    return docs.mapInArrow(run, schema)
