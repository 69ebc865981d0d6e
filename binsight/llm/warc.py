"""WARC archives: a writer with revisit records and a splittable reader (operator 6).

Every record is a gzip member of its own.  A reading task takes a byte range,
looks for gzip's magic, validates a candidate by decoding it as far as a WARC
header, and owns the records that start inside its range; it reads past the
range's end to finish the last one.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.llm.catalog import register
from binsight.llm.common import table, written
from binsight.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A WARC record as a gzip member; ``refers_to``: of a revisit, the response's page_id."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    revisit = refers_to is not None
    block = http.encode() + (b"" if revisit else payload)
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _record_id(page_id),
            "WARC-Date": DATE, "WARC-Target-URI": None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=~"),
            "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Profile": PROFILE if revisit else None,
            "WARC-Refers-To": _record_id(refers_to) if revisit else None,
            "X-Page-Id": page_id, "X-Refers-To-Page-Id": refers_to,
            "Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def _header(raw: bytes) -> dict[str, str] | None:
    """Fields of a WARC header, which begins ``raw``; None if it doesn't."""
    first, _, rest = raw.partition(b"\r\n\r\n")[0].partition(b"\r\n")
    if not first.startswith(b"WARC/1."):
        return None
    fields = dict(x.split(": ", 1) for x in rest.decode("utf-8", "replace").split("\r\n") if ": " in x)
    return fields if "WARC-Type" in fields and "Content-Length" in fields else None


class _Window:
    """Bytes of a file from ``at`` on, read in chunks."""

    def __init__(self, file, at: int, size: int):
        self.file, self.begin, self.size, self.held, self.pos = file, at, size, b"", 0

    @property
    def at(self) -> int:
        return self.begin + self.pos

    def __len__(self) -> int:
        return len(self.held) - self.pos

    def more(self) -> bool:
        begin = self.begin + len(self.held)
        if begin >= self.size:
            return False
        self.file.seek(begin)
        self.begin, self.held, self.pos = self.at, self.held[self.pos:], 0
        self.held += self.file.read(min(CHUNK, self.size - begin))
        return True

    def find(self, what: bytes) -> int:
        found = self.held.find(what, self.pos)
        return found if found < 0 else found - self.pos

    def part(self, lo: int, hi: int) -> bytes:
        return self.held[self.pos + lo:self.pos + hi]

    def drop(self, n: int) -> None:
        self.pos += n


def _member(window: _Window, whole: bool = True) -> tuple[bytes, int] | str | None:
    """The member that begins the window, decoded, and its length; None if it is no WARC
    record, the reason if it begins as one and can't be read to its end.

    ``whole``: if false, only as much is decoded as shows that a record begins.
    """
    unzip, used, first = zlib.decompressobj(31), 0, b""
    try:
        while len(first) < 8 and not unzip.eof:
            given = unzip.unconsumed_tail
            if not given:
                if used == len(window) and not window.more():
                    return None
                given = window.part(used, used + 4096)
                used += len(given)
            first += unzip.decompress(given, 8 - len(first))
    except zlib.error:
        return None
    if not first.startswith(b"WARC/1."):
        return None
    if not whole:
        return first, 0
    out = [first]
    try:
        if unzip.unconsumed_tail:
            out.append(unzip.decompress(unzip.unconsumed_tail))
        while not unzip.eof:
            if used == len(window) and not window.more():
                return "cut off"
            given = window.part(used, used + CHUNK)
            used += len(given)
            out.append(unzip.decompress(given))
    except zlib.error:
        return "damaged"
    raw = b"".join(out)
    head = _header(raw) if b"\r\n\r\n" in raw else None
    if head is None or not head["Content-Length"].isdecimal():
        return "no WARC header"
    if len(raw) < raw.index(b"\r\n\r\n") + 4 + int(head["Content-Length"]):
        return "shorter than stated"
    return raw, used - len(unzip.unused_data)


def scan(file, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str] | None, bytes | str]]:
    """(offset, header, block) of the records that start in [start, end), and
    (offset, None, reason) of each place from which bytes belong to no record.

    A member that begins as a record and breaks off is reported by the range
    that it starts in; bytes behind a record that begin none (a damaged magic,
    strange members) by the range of that record.  So a place is reported
    once, whatever the ranges.  After it, reading goes on with the next record.
    """
    window = _Window(file, start, size)
    expected = 0 if start == 0 and size else None  # where the next record has to begin, if that is known
    while window.at < end:
        found = window.find(MAGIC)
        if found < 0:
            keep = min(len(window), len(MAGIC) - 1)
            window.drop(len(window) - keep)
            if window.more():
                continue
            break
        window.drop(found)
        if window.at >= end:
            break
        member = _member(window)
        if isinstance(member, tuple):
            if expected is not None and expected != window.at:
                yield expected, None, "no WARC record"
            raw, length = member
            head = _header(raw)
            body = raw.index(b"\r\n\r\n") + 4
            yield window.at, head, raw[body:body + int(head["Content-Length"])]
            window.drop(length)
            expected = window.at
            continue
        if member is not None:
            if expected is not None and expected != window.at:
                yield expected, None, "no WARC record"
            yield window.at, None, member
            expected = None
        window.drop(1)
    if expected is not None and expected < size:
        if expected < end:
            yield expected, None, "no WARC record"
        else:  # the next range's first record, which that range can't miss if it begins as one
            after = _Window(file, expected, size)
            while len(after) < len(MAGIC) and after.more():
                pass
            if after.part(0, len(MAGIC)) != MAGIC or _member(after, whole=False) is None:
                yield expected, None, "no WARC record"


def records(file, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, block) of the readable records that start in [start, end)."""
    for offset, head, block in scan(file, start, end, size):
        if head is not None:
            yield offset, head, block


def classified(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) -> with payload, digest, refers_to.

    Of equal payloads of at least ``min_bytes`` bytes the smallest page_id is
    the response and the others refer to it; rows that repeat that page_id are
    responses, too.  A null page_id revisits a response that has one.  Null
    html: an empty payload.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # combined before the shuffle: one row of a digest and task, however many copies there are
    first = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    return (rows.join(first, "digest", "left")
            .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
            .select("page_id", "url", "payload", "digest", "refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes an archive per task under ``folder``; returns their paths and sizes.

    A task attempt writes a file of its own and only finished attempts are in
    the returned table, so a task that is run again leaves nothing twice.
    """
    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        store, base = _store(folder)
        out, size, count = None, 0, 0
        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*(batch[c] for c in batch.schema.names), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                member = record(page_id.as_py(), url.as_py(), payload.as_py(), digest, refers.as_py())
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "size": size, "records": count}])

    return written(rows.mapInArrow(write, "path string, size long, records long"), "archives")


SCHEMA = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
          "path string, offset long, payload binary, reason string")
DAMAGED = "damaged"


def _row(path: str, offset: int, head: dict[str, str] | None, block, payload: bool) -> tuple:
    """A record as a row of SCHEMA; a place without a readable one as a row with its reason."""
    if head is None:
        return None, None, DAMAGED, None, None, None, path, offset, None, block
    http, _, body = block.partition(b"\r\n\r\n")
    digest, kind = head.get("WARC-Payload-Digest"), head["WARC-Type"]
    digest = None if digest is None else digest.removeprefix("sha1:")
    if kind == "response" and digest is not None and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
        return None, None, DAMAGED, None, digest, None, path, offset, None, "payload digest differs"
    stated = re.search(rb"\r\nContent-Length: (\d+)", http)
    page, refers, url = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id"), head.get("WARC-Target-URI")
    return (None if page is None else int(page), None if url is None else unquote(url), kind,
            int(stated[1]) if stated else len(body), digest, None if refers is None else int(refers),
            path, offset, body if payload and kind == "response" else None, None)


def read_archives(spark: SparkSession, archives: DataFrame, split_bytes: int = 4 << 20, payload: bool = True,
                  damaged: str = "fail", task_bytes: int = 128 << 20) -> DataFrame:
    """Reads archives (path, size) in byte ranges; a row per record.

    Ranges of ``split_bytes`` are dealt evenly over tasks: one for about
    ``task_bytes`` of archive, and at least as many as the cluster runs at a time
    if there are that many ranges.

    ``payload``: whether a response's payload is returned, too.  ``damaged``:
    what becomes of a member that can't be read to its end, of bytes that
    belong to no record, and of a response whose payload doesn't have the
    digest in its header: an error that names path and offset ("fail"), or a
    row with path, offset and ``reason`` and record_type "damaged" ("rows").
    """
    if damaged not in ("fail", "rows"):
        raise ValueError(f"damaged: fail or rows, not {damaged}")
    archives = archives.where("size > 0")
    total, count = archives.agg(F.sum("size"), F.sum(F.ceil(F.col("size") / split_bytes))).first()
    tasks = min(int(count or 1), max(spark.sparkContext.defaultParallelism, -(-int(total or 0) // task_bytes)))
    ranges = archives.select("path", "size", F.explode(F.expr(
        f"sequence(0L, size - 1, {split_bytes}L)")).alias("start"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def read(batches):
        for batch in batches:
            for path, size, start in zip(*(batch[c].to_pylist() for c in ("path", "size", "start")), strict=True):
                store, at = _store(path)
                rows, held = [], 0
                with store.open_input_file(at) as file:
                    for offset, head, block in scan(file, start, min(size, start + split_bytes), size):
                        row = _row(path, offset, head, block, payload)
                        if row[2] == DAMAGED and damaged == "fail":
                            raise ValueError(f"{row[-1]} at {path}:{offset}")
                        rows.append(row)
                        held += len(block)
                        if held > 8 << 20:
                            yield _batch(rows, names)
                            rows, held = [], 0
                yield _batch(rows, names)

    return ranges.repartition(tasks).mapInArrow(read, SCHEMA)


def _batch(rows, names):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(),
             pa.binary(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


@register("op6_warc")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(classified(table(spark, sf_dir, "pages")), scratch_path(spark, "warc"))
    return read_archives(spark, archives, payload=False).drop("payload", "path", "offset", "reason")
