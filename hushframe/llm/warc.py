"""Operator 10: WARC files, written by tasks and read in byte ranges by boundary chains.

Reading a file in ranges needs the places where records begin, but the version line that
begins a record may stand inside a payload as well. So each task emits, for every place in
its range that looks like a record's beginning, the record-to-successor offset that the
header's Content-Length gives. A candidate is a record only if the chain from the file's
start reaches it:

* inside a range the task follows successors itself, so each candidate has one *exit*: the
  first offset past its range that its chain reaches;
* across ranges, exits are chained by pointer jumping: in each round the reached set grows
  by its jumps and every jump is composed with itself, so a file of n ranges takes log2(n)
  rounds of equi-joins, however many records it has;
* each range reached is then parsed from its one entry offset on.

Candidates that no chain reaches, such as whole records quoted in a payload, fall away. Files named
``.warc.gz`` are chained in the same way by their gzip members: a candidate is a place with gzip's
magic that decompresses, with its checksum, to something that begins with a version line, and
its successor is where the member ends.

A version line is recognised by its own ten bytes, and a header is at most ``MAX_HEADER`` bytes long
(a longer one is no header), so hostile payloads cost time in proportion to their length.

Edges: an empty file has no records; a file that doesn't begin with a record has none; a
record that runs past the file's end is not returned, nor what seems to follow it. Null
ids, urls and texts, empty and very long payloads, repeated rows and payloads with version
lines come back as they were written; rows of equal id are records of their own; an empty table
gives no records. Other columns of a table are not written. A gzip member is decompressed whole; its
records share its offset and length.

Files are reached by ``pyarrow.fs`` URIs, so the folder may be any shared file system.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, discard, written

MAGIC = b"WARC/1."
GZIP = b"\x1f\x8b\x08"
MAX_HEADER = 1 << 20
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
VERSION_SIZE = 10
_FIELD = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*(.*)")
_TAIL = b"\r\n\r\n"
FILES = "file string, size long, start long, end long"


def open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(page_id, url: str | None, body: str | None) -> bytes:
    meta = json.dumps({"id": page_id, "url": url, "null": body is None})
    block = (body or "").encode("utf-8", "surrogatepass")
    target = re.sub(rb"[\x00-\x20\x7f-\xff<>]", lambda m: b"%%%02X" % m[0][0], (url or "").encode("utf-8", "surrogatepass"))
    name = uuid.uuid5(uuid.NAMESPACE_URL, meta)
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: text/html\r\nX-Row: {meta}\r\nContent-Length: {len(block)}\r\n"
    return head.encode() + b"WARC-Target-URI: " + target + b"\r\n\r\n" + block + _TAIL


INFO = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Length: 21\r\n\r\nformat: WARC/1.0\r\n\r\n \r\n\r\n"


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", compress: bool = False) -> DataFrame:
    """One file a task, (file, size, records), with a gzip member a record if ``compress``; a repeated task replaces its file by the same bytes."""
    end, packed = (".warc.gz", lambda x: gzip.compress(x, 6, mtime=0)) if compress else (".warc", bytes)

    def run(items):
        task = TaskContext.get()
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}{end}"
        temp, n, size = f"{base}/.{name}.{task.taskAttemptId()}", 0, 0
        with fs.open_output_stream(temp) as out:
            size += out.write(packed(INFO))
            for b in batches(items):
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    data = packed(record(*row))
                    out.write(data)
                    n, size = n + 1, size + len(data)
        fs.move(temp, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "size": [size], "records": [n]}, pa.schema([("file", pa.string()), ("size", pa.int64()), ("records", pa.int64())]))

    return pages.select(*[F.col(f"`{c}`") for c in (id_col, url_col, text_col)]).mapInArrow(run, "file string, size long, records long")


def files_in(spark: SparkSession, folder: str) -> DataFrame:
    """(file, size) of the WARC files of a folder; the driver sees names and sizes only."""
    from pyarrow import fs

    system, base = open_fs(folder)
    found = [(f"{folder}/{i.base_name}", i.size) for i in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.is_file and i.base_name.endswith((".warc", ".warc.gz"))]
    return spark.createDataFrame(sorted(found), "file string, size long")


class Window:
    """Bytes of a file from ``start`` on, read further when asked for."""

    def __init__(self, handle, start: int, end: int, size: int, step: int = 1 << 16) -> None:
        self.handle, self.start, self.size, self.step = handle, start, size, step
        self.data = bytearray(handle.read_at(max(0, min(end, size) - start), start))

    def has(self, upto: int) -> bool:
        """Whether bytes up to this place of the file could be read."""
        if upto > self.size:
            return False
        have = self.start + len(self.data)
        if upto > have:
            self.data += self.handle.read_at(min(self.size, max(upto, have + self.step)) - have, have)
        return True

    def line(self, at: int, limit: int) -> tuple[bytes, int] | None:
        """The line at a place of the file without its end, and where the next one begins; None if it doesn't end before ``limit``."""
        i = seek = at - self.start
        while True:
            k = self.data.find(b"\r\n", seek, limit - self.start)
            if k >= 0:
                return bytes(self.data[i:k]), self.start + k + 2
            have = self.start + len(self.data)
            if have >= min(self.size, limit) or self.data.find(b"\n", seek, limit - self.start) >= 0:
                return None
            seek = max(i, len(self.data) - 1)
            self.has(min(self.size, have + self.step))

    def header(self, at: int) -> tuple[dict[bytes, bytes], int, int] | None:
        """Fields of the record at a place, where its block begins, and its successor."""
        if not self.has(at + VERSION_SIZE) or not _VERSION.match(self.data, at - self.start):
            return None
        fields: dict[bytes, bytes] = {}
        limit, got = at + MAX_HEADER, (b"", at + VERSION_SIZE)
        while True:
            got = self.line(got[1], limit)
            if got is None:
                return None
            if not got[0]:
                break
            m = _FIELD.fullmatch(got[0])
            if not m:
                return None
            fields.setdefault(m[1].lower(), m[2])
        length = fields.get(b"content-length", b"").strip()
        if not length.isdigit() or len(length) > 18:
            return None
        return fields, got[1], got[1] + int(length) + len(_TAIL)

    def member(self, at: int) -> tuple[bytes, int] | None:
        """What the gzip member at a place holds, and where it ends; None if it is broken or isn't WARC."""
        d, parts, here, size = zlib.decompressobj(31), [], at, 0
        try:
            while not d.eof:
                if here >= self.size:
                    return None
                self.has(min(self.size, here + self.step))
                chunk = bytes(self.data[here - self.start : here - self.start + self.step])
                parts.append(d.decompress(chunk))
                here += len(chunk)
                if size < VERSION_SIZE <= (size := size + len(parts[-1])) and not _VERSION.match(b"".join(parts)):
                    return None
        except zlib.error:
            return None
        return (b"".join(parts), here - len(d.unused_data)) if size >= VERSION_SIZE else None


class Memory:
    """A handle on bytes."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def read_at(self, n: int, at: int) -> bytes:
        return self.data[at : at + n]


def splits_of(files: DataFrame, split_bytes: int) -> DataFrame:
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    return files.where("size > 0").select("file", "size", starts.alias("start")).withColumn("end", F.least(F.col("size"), F.col("start") + split_bytes))


def candidates(splits: DataFrame) -> DataFrame:
    """(file, at, next, exit) of every place that looks like a record's beginning; a chain that breaks inside its range exits at -1."""
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("next", pa.int64()), ("exit", pa.int64())])

    def run(items):
        for b in items:
            for file, size, start, end in zip(*(c.to_pylist() for c in b.columns)):
                fs, path = open_fs(file)
                with fs.open_input_file(path) as handle:
                    w = Window(handle, start, min(size, end + VERSION_SIZE), size)
                    packed = file.endswith(".gz")
                    magic = GZIP if packed else MAGIC
                    found, i = {}, w.data.find(magic)
                    while 0 <= i < end - start:
                        head = w.member(start + i) if packed else w.header(start + i)
                        if head and head[-1] <= size:
                            found[start + i] = head[-1]
                        i = w.data.find(magic, i + 1)
                exits: dict[int, int] = {}
                for at in sorted(found, reverse=True):
                    nxt = found[at]
                    exits[at] = nxt if nxt >= end else exits.get(nxt, -1)
                ats = sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(ats), pa.string()), pa.array(ats, pa.int64()), pa.array([found[a] for a in ats], pa.int64()), pa.array([exits[a] for a in ats], pa.int64())], schema=schema)

    return splits.select("file", "size", "start", "end").mapInArrow(run, "file string, at long, next long, exit long")


def reachable(found: DataFrame) -> DataFrame:
    """(file, at): the entries of ranges that the chains from the files' starts reach, by pointer jumping over exits."""
    jumps = found.select("file", "at", F.col("exit").alias("to")).where("to >= 0")
    reached = written(found.where("at = 0").select("file", "at"), "reached")
    count = reached.count()
    while True:
        step = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        before, reached = reached, written(reached.unionByName(step).distinct(), "reached")
        discard(before)
        now = reached.count()
        if now == count:
            return reached
        count = now
        onward = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jumps = written(jumps.join(onward, ["file", "to"]).select("file", "at", F.col("far").alias("to")), "jumps")


def parse(entries: DataFrame) -> DataFrame:
    """Records of ranges (file, size, start, end, at), each walked from its entry on."""
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("meta", pa.string()), ("block", pa.binary())])

    def records(w: Window, at: int, end: int):
        """(offset, length, fields, block) of the records from a place on that begin before ``end``."""
        while at < end:
            head = w.header(at)
            if not head or head[2] > w.size:
                return
            fields, block, nxt = head
            w.has(nxt)
            yield at, nxt - at, fields, bytes(w.data[block - w.start : nxt - len(_TAIL) - w.start])
            at = nxt

    def members(w: Window, at: int, end: int):
        while at < end and (got := w.member(at)):
            data, nxt = got
            for _, _, fields, block in records(Window(Memory(data), 0, len(data), len(data)), 0, len(data)):
                yield at, nxt - at, fields, block
            at = nxt

    def run(items):
        for b in items:
            for file, size, _, end, at in zip(*(c.to_pylist() for c in b.columns)):
                fs, path = open_fs(file)
                rows, held = [], 0
                with fs.open_input_file(path) as handle:
                    for offset, length, fields, data in (members if file.endswith(".gz") else records)(Window(handle, at, end, size), at, end):
                        rows.append((file, offset, length, fields.get(b"warc-type", b"").decode("utf-8", "replace"), fields[b"x-row"].decode() if b"x-row" in fields else None, data))
                        held += len(data)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return entries.select("file", "size", "start", "end", "at").mapInArrow(run, "file string, offset long, length long, kind string, meta string, block binary")


def read_warc(files: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """The records of files (file, size): file, offset, length, kind, meta, block."""
    parts = max(1, files.sparkSession.sparkContext.defaultParallelism)
    total, size = files.agg(F.sum(F.ceil(F.col("size") / split_bytes)), F.sum("size")).first()
    tasks = max(1, min(int(total or 0), max(2 * parts, int(size or 0) // (8 << 20)), 100_000))
    splits = written(splits_of(files, split_bytes).repartition(max(1, tasks // 16)), "splits")
    found = written(candidates(splits.repartition(tasks)), "candidates")
    reached = reachable(found)
    discard(found)
    entries = reached.withColumn("start", F.col("at") - F.col("at") % split_bytes)  # every range is entered at one place
    entries = splits.join(entries, ["file", "start"]).select("file", "size", "start", "end", "at")
    return parse(entries.repartition(tasks, "file", "start"))


def pages_of(records: DataFrame, id_type: str = "long") -> DataFrame:
    """The pages that ``write_warc`` wrote: page_id, url, html."""
    meta = F.from_json("meta", f"id {id_type}, url string, `null` boolean")
    rows = records.where("meta is not null").withColumn("row", meta)
    return rows.select(F.col("row.id").alias("page_id"), F.col("row.url").alias("url"), F.when(~F.col("row.null"), F.col("block").cast("string")).alias("html"))
