"""WARC archives: writing with payload deduplication, reading by boundary-chain verification.

Writing is one Spark plan: payload digests, one response per digest, records as text rows (a record's
last line feed is the row separator), so Spark's own committer places the files in any store.

Reading: tasks scan archives for the record magic at any byte and emit candidate edges, a record's
start to its successor's start, in bytes of the uncompressed archive. A payload can hold the magic too, so
a candidate counts only if a chain of edges leads to it from the start of its file. A chain never leaves
its file, so the offsets of a file meet in one task, which follows it by pointer jumping: reached starts
double with each round, log2 of the records in a file in all.

Defined cases: null html is an empty payload, null url an empty URI (control characters in it become
%XX); payloads under `least` bytes are always responses; of equal payloads the largest page_id is the
response, and repeated rows with that page_id are responses too; a null page_id is read back as null;
empty tables give empty archives; other columns are ignored. An archive that is cut off or damaged
gives the records that the unbroken part of its chain reaches. An archive file is read whole by one
task: `write_warc` bounds a file by FILE_BYTES or one record, and `round_trip` fails if it does not get back
as many records as there are pages.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import removed, written

_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
#: Bytes of uncompressed records in a file, unless a single record has more.
FILE_BYTES = 128 << 20
#: Records in a file at most; so those of FILE_BYTES / RECORDS bytes or less go together.
RECORDS = 4000
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_READ = pa.schema([
    ("file", pa.string()), ("at", pa.int64()), ("next", pa.int64()), ("record_type", pa.string()),
    ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("payload", pa.binary())])
_READ_DDL = ("file string, at long, next long, record_type string, record_id string, uri string, "
             "refers_to string, payload_bytes long, payload_digest string, intact boolean, payload binary")


def planned(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null: a response)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"),
                        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest"))
    # Digests and ids alone meet by digest, partial maxima first; payloads are joined by page, so that copies
    # of one payload do not meet in a task.
    short = rows.filter(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    chosen = (short.groupBy("payload_digest").agg(F.max("page_id").alias("kept_id"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1").drop("n"))
    revisits = short.join(chosen, "payload_digest").filter(~F.col("kept_id").eqNullSafe(F.col("page_id"))).select(
        F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), "kept_id").distinct()
    return rows.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")), "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", F.col("kept_id").alias("refers_to"))


def _record() -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    uri = F.col("url")
    for c in ("\r", "\n", "\t", " "):
        uri = F.replace(uri, F.lit(c), F.lit(f"%{ord(c):02X}"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("refers_to").isNull(), F.concat(http, F.col("html"))).otherwise(http)
    length = F.octet_length(http) + F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(F.lit(0))
    return F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", urn("page_id")), line("WARC-Target-URI", uri),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("refers_to").isNull(), F.lit("")).otherwise(F.concat(
            line("WARC-Refers-To", urn("refers_to")), line("WARC-Profile", F.lit(_PROFILE)))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", length.cast("string")), F.lit("\r\n"), block, F.lit("\r\n\r"))


def write_warc(pages: DataFrame, path: str, least: int = 1000, file_bytes: int = FILE_BYTES, records_per_file: int = RECORDS, compression: str = "gzip") -> None:
    """Archives of all pages under path (one or more files a task; compression gzip or none).

    Pages are written by size class, each with as many records a file as file_bytes has room for."""
    size = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)) + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + 1000
    counts = list(dict.fromkeys((records_per_file, -(-records_per_file // 64), 1)))
    kind = F.lit(len(counts) - 1)
    for i, n in reversed(list(enumerate(counts[:-1]))):
        kind = F.when(size <= file_bytes // n, i).otherwise(kind)
    for (k,) in sorted(pages.select(kind).distinct().collect()) or [(0,)]:  # a row per size class
        planned(pages, least).filter(kind == k).select(_record().alias("value")).write.option("lineSep", "\n").option(
            "maxRecordsPerFile", counts[k]).option("compression", compression).text(f"{path}/size{k}")


def _fields(head: bytes) -> dict[bytes, bytes]:
    found = {}
    for x in head.split(b"\r\n"):
        name, colon, value = x.partition(b":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def _headers(data: bytes) -> Iterator[tuple[int, int, dict[bytes, bytes]]]:
    """(start, end of the header, its fields) of every place with the magic. Those with one end come
    last first, so that their common lines are read once; the fields are valid until the next."""
    end, group = -1, []

    def parsed() -> Iterator[tuple[int, int, dict[bytes, bytes]]]:
        head, to = {}, end
        for start, after in reversed(group):
            head.update(_fields(data[after:to]))  # of lines with one name the first counts
            yield start, end, head
            to = after - 2

    for m in _MAGIC.finditer(data):
        if m.end() - 2 > end:
            yield from parsed()
            end, group = data.find(b"\r\n\r\n", m.end() - 2), []
            if end < 0:
                return
        group.append((m.start(), m.end()))
    yield from parsed()


def _candidates(file: str, data: bytes, payloads: bool) -> Iterator[dict]:
    known = None
    for at, end, head in _headers(data):
        length = head.get(b"content-length", b"")
        if not length.isdigit() or (after := end + 4 + int(length)) + 4 > len(data) or data[after:after + 4] != b"\r\n\r\n":
            continue
        if known != (end, after):
            known, block = (end, after), data[end + 4:after]
            http, _, payload = block.partition(b"\r\n\r\n")
            own = hashlib.sha1(payload).hexdigest()
        said = head.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("latin-1")
        revisit = head.get(b"warc-type") == b"revisit"
        size = _fields(http).get(b"content-length", b"") if revisit else b""
        yield {
            "file": file, "at": at, "next": after + 4, "record_type": head.get(b"warc-type", b"").decode("latin-1"),
            "record_id": head.get(b"warc-record-id", b"").decode("latin-1"),
            "uri": head.get(b"warc-target-uri", b"").decode("utf-8", "replace"),
            "refers_to": head[b"warc-refers-to"].decode("latin-1") if b"warc-refers-to" in head else None,
            "payload_bytes": int(size) if size.isdigit() else len(payload),
            "payload_digest": said if revisit else own, "intact": revisit or not said or said == own,
            "payload": payload if payloads and not revisit else None}


def candidates(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every place that looks like a record, with its successor's offset."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[dict] = []
                size = 0
                plain = data.as_py()
                if plain[:2] == b"\x1f\x8b":
                    plain = gzip.decompress(plain)
                for row in _candidates(file, plain, payloads):
                    rows.append(row)
                    size += len(row["payload"] or b"") + sum(len(row[c] or "") for c in ("record_id", "uri", "refers_to")) + 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _READ)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _READ)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select(
        "path", "content").mapInArrow(scan, _READ_DDL)


def _jumped(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of the sorted places `at` a chain of edges at[i] -> after[i] reaches from 0."""
    n = len(at)
    to = np.searchsorted(at, after)
    to = np.append(np.where((to < n) & (at[np.minimum(to, n - 1)] == after), to, n), n)
    seen = np.append(at == 0, False)
    while (to[:n] < n).any():
        seen[to[seen]] = True
        to = to[to]
    return seen[:n]


def reached(found: DataFrame) -> DataFrame:
    """(file, at) of the records that a chain of edges reaches from offset 0, by pointer jumping. The
    offsets of a file, 16 bytes each, meet in one task."""
    def jump(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        at, after = (np.concatenate(x) for x in zip(*pairs, strict=True))
        order = np.argsort(at, kind="stable")
        at = at[order]
        got = at[_jumped(at, after[order])]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(got), pa.string()), pa.array(got)], names=["file", "at"])

    return found.select("at", "next", "file").groupBy("file").applyInArrow(jump, "file string, at long")


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> tuple[DataFrame, list[str]]:
    """The records of all archives under path; and the scratch tables to remove after use."""
    found, p = written(candidates(spark, path, payloads))
    return found.join(reached(found), ["file", "at"]), [p]


def digest(records: DataFrame) -> DataFrame:
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          page("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write archives of pages under path, read them back, and return a page's row from its record.

    The rows are a table of their own; archives and scratch tables are removed."""
    spark = pages.sparkSession
    write_warc(pages, path)
    records, paths = read_warc(spark, path)
    rows, _ = written(digest(records))
    removed(spark, path, *paths)
    if (got := rows.count()) != (want := pages.count()):
        raise RuntimeError(f"{got} records were read back of {want} pages")
    return rows
