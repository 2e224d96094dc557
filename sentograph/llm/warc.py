"""WARC archives: writing with payload deduplication, and reading with boundary-chain verification.

Reading cuts files into ranges. A task looks for record magic in its range and emits each place where a header parses
as a candidate, with the place of the record that its lengths make follow. Within a range the task follows these to
where they leave it; across ranges pointer jumping from the file's start finds the entry of every range in a number of
rounds that grows with the logarithm of the ranges of a file. Only records on that chain are read, so magic inside a
payload, however well formed, is never a record.

Defined results: a null payload is empty; a null page id is written and read back as null; repeated page ids make a
record each; a null or odd URL is written without its line breaks; an empty table makes no archive; records of
WARC/1.0 and WARC/1.1 are read, also in one file; of a truncated file the whole records before the cut are read; a
record that is damaged otherwise, or of another version, is an error or reported, see ``read_archives``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import open_fs, publish, stored

MAGIC = b"WARC/1.1\r\n"
#: Versions that are read, each of as many bytes.
MAGICS = (b"WARC/1.0\r\n", MAGIC)
_ANY_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
#: Bytes of a range, and bytes that are read at once beyond it; a header that is longer is read to its end.
RANGE, HEADER = 16 << 20, 1 << 16
#: Up to so many digests of repeated payloads (some 100 bytes each) are broadcast; more are joined by shuffle.
MOST_HEADS = 200_000
DATE = "2024-01-01T00:00:00Z"


def record_name(page_id: int | None) -> str:
    h = hashlib.sha1(f"page:{page_id}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A whole record; a revisit has the HTTP header with the payload's length and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", url: str = "url", least: int = 0) -> list[dict]:
    """Writes an archive for each task; returns the files (file, records, bytes).

    Of equal payloads of at least ``least`` bytes that with the largest key is the response that the others revisit.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    digests = pages.select(F.col(key).cast("long").alias("key"), F.sha1(body).alias("digest"), F.length(body).alias("size"))
    heads = stored(digests.where(F.col("size") >= least).groupBy("digest").agg(F.max("key").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("__digest"), "head"), "heads")
    if heads.count() <= MOST_HEADS:
        heads = F.broadcast(heads)
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.alias("body"), F.sha1(body).alias("digest"))
    rows = rows.join(heads, F.col("digest") == F.col("__digest"), "left").select("key", "url", "body", "head")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), [0]

        def records():
            for batch in batches:
                for key, url, body, head in zip(*[c.to_pylist() for c in batch.columns]):
                    count[0] += 1
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    yield record(key, url, body, digest, head, head is not None and head != key)

        stream = records()
        first = next(stream, None)
        if first is None:
            return

        def chunks():
            yield first
            yield from stream

        name = f"{folder}/part-{part:06d}.warc"
        size = publish(name, chunks())
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [count[0]], "bytes": [size]})

    return [r.asDict() for r in rows.mapInArrow(write, "file string, records long, bytes long").collect()]


class _Window:
    """Bytes of a file from a place on; more are read as a header needs them."""

    def __init__(self, stream, start: int, stop: int, size: int):
        stream.seek(start)
        self.stream, self.data, self.left, self.end = stream, bytearray(stream.read(stop - start)), size - stop, -1

    def upto(self, length: int) -> None:
        """Reads on until it holds so many bytes, or the file ends."""
        while len(self.data) < length and self.left > 0:
            more = self.stream.read(min(max(length - len(self.data), HEADER), self.left))
            self.left = self.left - len(more) if more else 0
            self.data += more

    def parse(self, at: int):
        """(header lines, start of the block, its length) of a record whose header begins at a place in the bytes; None if it is none."""
        self.upto(at + len(MAGIC))
        if not self.data.startswith(MAGICS, at):
            return None
        line = at + len(MAGIC)
        if self.end < at:  # else the header's end is that found for an earlier place
            seen = at
            while (end := self.data.find(b"\r\n\r\n", seen)) < 0 and self.left > 0:
                # A line without a colon is no header's; what follows need not be read.
                while (stop := self.data.find(b"\r\n", line)) >= 0:
                    if self.data.find(b":", line, stop) < 0:
                        return None
                    line = stop + 2
                seen = max(at, len(self.data) - 3)
                self.upto(2 * len(self.data))
            if end < 0:
                return None
            self.end = end
        if any(self.data.find(b"\r\n" + m, at, self.end) >= 0 for m in MAGICS):  # a line without a colon
            return None
        fields = {}
        for line in bytes(self.data[at + len(MAGIC) : self.end]).split(b"\r\n"):
            name, colon, value = line.partition(b":")
            if not colon:
                return None
            fields[name.strip().lower()] = value.strip()
        length = fields.get(b"content-length", b"")
        return (fields, self.end + 4, int(length)) if length.isdigit() and len(length) < 19 else None


    def cut_off(self, at: int) -> bool:
        """Whether the file ends within a record's header that begins at a place where no record parses."""
        self.upto(at + len(MAGIC))
        rest = bytes(self.data[at : at + len(MAGIC)])
        if len(rest) < len(MAGIC):
            return any(m.startswith(rest) for m in MAGICS)
        return self.data.startswith(MAGICS, at) and self.left == 0 and self.data.find(b"\r\n\r\n", at) < 0


def ranges(spark: SparkSession, files: list[dict], step: int = RANGE) -> DataFrame:
    """(file, bytes, start, stop) of every range: made from one row a file, so the driver holds no more than that."""
    rows = spark.createDataFrame([(f["file"], f["bytes"]) for f in files], "file string, bytes long")
    cut = rows.select("file", "bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(step))).alias("start"))
    return cut.withColumn("stop", F.least(F.col("start") + step, "bytes")).repartition(max(1, sum(-(-f["bytes"] // step) for f in files)), "file", "start")


def candidates(cut: DataFrame) -> DataFrame:
    """(file, at, leaves, bytes): every candidate and where its chain leaves its range; -1 where it breaks off."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, stop, size = row["start"], row["stop"], row["bytes"]
                files, path = open_fs(row["file"])
                with files.open_input_file(path) as stream:
                    window = _Window(stream, start, min(stop + HEADER, size), size)
                    follow, magic = {}, _ANY_MAGIC.search(window.data)
                    while magic and (at := magic.start()) < stop - start:
                        magic = None  # a match holds the bytes, which parse may add to
                        if found := window.parse(at):
                            follow[start + at] = start + found[1] + found[2] + 4
                        magic = _ANY_MAGIC.search(window.data, at + 1)
                leaves = {}
                for at in sorted(follow, reverse=True):
                    to = follow[at]
                    leaves[at] = -1 if to > size else to if to >= stop else leaves.get(to, -1)
                yield pa.RecordBatch.from_pydict({"file": [row["file"]] * len(leaves), "at": pa.array(list(leaves), pa.int64()), "leaves": pa.array(list(leaves.values()), pa.int64())}, schema=pa.schema([("file", pa.string()), ("at", pa.int64()), ("leaves", pa.int64())]))

    return cut.mapInArrow(scan, "file string, at long, leaves long")


def entries(cut: DataFrame, store=stored) -> DataFrame:
    """(file, at): where the chain from the file's start enters each range, by pointer jumping; also where it meets no record."""
    jumps = store(candidates(cut), "candidates")
    reached = store(jumps.where("at = 0").select("file", "at"), "reached")
    known = reached.count()
    while known:
        here = jumps.withColumnsRenamed({"file": "f", "at": "a", "leaves": "to"})
        onward = reached.join(here, [F.col("file") == F.col("f"), F.col("at") == F.col("a")]).select("file", F.col("to").alias("at"))
        reached = store(reached.union(onward.where("at >= 0")).distinct(), "reached")
        if (now := reached.count()) == known:
            break
        known = now
        # Every pointer now goes twice as far; those at the end of their file stay.
        jumps = store(jumps.join(here, [F.col("file") == F.col("f"), F.col("leaves") == F.col("a")], "left").select("file", "at", F.coalesce("to", "leaves").alias("leaves")), "candidates")
    return reached


def read_archives(spark: SparkSession, files: list[dict], step: int = RANGE, store=stored, strict: bool = True) -> DataFrame:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest, digest_ok, file, at) of every record on the chains.

    payload_bytes is that of the full payload, for a revisit too; digest_ok compares a response's payload with its header. Where a chain meets something that is no record, before its
    file ends, nothing that follows can be told from a payload: it is an error, or, if not strict, a row of record_type "broken" with that place and digest_ok false.
    """
    schema = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean, file string, at long"
    if not files:
        return spark.createDataFrame([], schema)
    cut = ranges(spark, files, step)
    found = entries(cut, store).select(F.col("file").alias("f"), F.col("at").alias("entry"))
    # A file is read from its start even if no record is there, to say so.
    todo = cut.join(found, (F.col("file") == F.col("f")) & (F.col("entry") - F.col("entry") % step == F.col("start")), "left").where("entry is not null or start = 0")
    todo = todo.groupBy("file", "bytes", "start", "stop").agg(F.coalesce(F.min("entry"), F.lit(0).cast("long")).alias("entry"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = open_fs(row["file"])
                out = []
                with files.open_input_file(path) as stream:
                    base = at = row["entry"]
                    window = _Window(stream, base, row["stop"], row["bytes"])
                    while at < row["stop"]:
                        parsed = window.parse(at - base)
                        if not parsed:
                            if not window.cut_off(at - base):
                                if strict:
                                    raise ValueError(f"{row['file']}: no record at byte {at} of {row['bytes']}")
                                out.append((None, "broken", None, None, None, False, row["file"], at))
                            break
                        fields, begin, length = parsed
                        if base + begin + length + 4 > row["bytes"]:
                            break
                        window.upto(begin + length + 4)
                        block = bytes(window.data[begin : begin + length])
                        http = block.find(b"\r\n\r\n")
                        sized = re.search(rb"\r\nContent-Length: (\d+)\r\n", block[: http + 2])
                        digest = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode()
                        kind = fields.get(b"warc-type", b"").decode()
                        page, refers = fields.get(b"x-page-id"), fields.get(b"x-refers-to-page")
                        if kind == "response":
                            payload = memoryview(block)[http + 4 :]
                            true = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            out.append((int(page) if page else None, kind, None, len(payload), true, true == digest, row["file"], at))
                        else:
                            out.append((int(page) if page else None, kind, int(refers) if refers else None, int(sized[1]) if sized else None, digest, True, row["file"], at))
                        at = base + begin + length + 4
                columns = list(zip(*out)) if out else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64()))], names=["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "digest_ok", "file", "at"])

    return todo.mapInArrow(read, schema)
