"""Packing by concatenate and cut.

Pass 1 tokenizes every document once and writes its ids with the partition and the running start in
it. The token totals of the partitions - one number each - become global offsets by a prefix sum.
Pass 2 is row-local: a document's global interval is cut at multiples of the window, so no token
moves between tasks and padding occurs in the last sequence alone. Pieces that a cut bounds carry
`cut_before`/`cut_after`: the boundary records by which `sequences` joins windows across tasks.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed each; an empty
table gives no piece; other columns are ignored. Order: that of the input partitions.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import in_chunks, written

_TOKENS = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_TOKENS_DDL = "part int, start long, doc_id long, n long, ids binary"
_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("cut_before", pa.bool_()), ("cut_after", pa.bool_()), ("ids", pa.binary())])
_PIECES_DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
               "offset long, cut_before boolean, cut_after boolean, ids binary")
_BESIDE = re.compile(r"\s | \s")
#: Entries of a task's memo of words, cleared when full.
MEMO = 300_000


class ByteBPE:
    """Ids of a byte-level BPE vocabulary file, as its own library gives them.

    A space between two other characters always starts a new piece of the file's splitting pattern, so
    texts without runs of white space are cut at spaces and each part's ids are remembered.
    """

    def __init__(self, said: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN

        found = json.loads(said)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {x["content"]: x["id"] for x in found["added_tokens"]}
        ranks = {bytes(back[c] for c in k): i for k, i in found["model"]["vocab"].items() if k not in special}
        self.coder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        coder = self.coder

        class Memo(dict):
            def __missing__(self, part: str) -> bytes:
                if len(self) >= MEMO:
                    self.clear()
                ids = self[part] = np.array(coder.encode_ordinary(f" {part}"), "<u4").tobytes()
                return ids

        self.memo = Memo()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if _BESIDE.search(text) or self.special.search(text):
            return np.array(self.coder.encode(text, allowed_special="all"), "<u4").tobytes()
        first, *parts = text.split(" ")
        head = np.array(self.coder.encode_ordinary(first), "<u4").tobytes() if first else b""
        return head + b"".join(map(self.memo.__getitem__, parts))


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """part, start (in the part), doc_id, n, ids of every document, as a written table."""
    with open(tokenizer, encoding="utf-8") as f:
        said = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, start = ByteBPE(said.value), TaskContext.get().partitionId(), 0
        for batch in in_chunks(batches, "text", 4 << 20):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = coder.encode(text or "") + end
                rows.append((part, start, doc_id, len(ids) // 4, ids))
                start += len(ids) // 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TOKENS.types, strict=True)], schema=_TOKENS)

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _TOKENS_DDL))[0]


def cut(tokens: DataFrame, window: int = 2048, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: the columns of _PIECES."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row per partition
    ends = np.cumsum([r.n for r in totals])
    base = tokens.sparkSession.sparkContext.broadcast({r.part: int(e - r.n) for r, e in zip(totals, ends, strict=True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for part, start, doc_id, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, done = base.value[part] + start, 0
                while done < n:
                    seq, off = divmod(at + done, window)
                    k = min(window - off, n - done)
                    piece = ids[4 * done:4 * (done + k)]
                    out.append((doc_id, done, k, zlib.crc32(piece), n, seq, off, done > 0, done + k < n, piece if with_ids else None))
                    done += k
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECES.types, strict=True)], schema=_PIECES)

    return tokens.select("part", "start", "doc_id", "n", "ids").mapInArrow(run, _PIECES_DDL)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    return cut(tokenized(docs, tokenizer, end_id), window, with_ids)


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (window of them), document_starts: the pieces of a window joined in order.

    A window has at most `window` pieces, so groups are bounded."""
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "cut_before"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    pad = np.array([pad_id], "<u4").tobytes()
    return rows.select(
        "sequence_id",
        F.rpad(joined, 4 * window, F.lit(pad)).alias("ids"),
        F.transform(F.filter("p", lambda x: ~x["cut_before"]), lambda x: x["offset"]).alias("document_starts"))
