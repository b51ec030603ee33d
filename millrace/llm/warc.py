"""WARC archives as a Spark data source, and pages written with revisit records.

``spark.dataSource.register(WarcSource)`` adds the format ``warc`` for ``*.warc`` and ``*.warc.gz``:

* Partitions are planned from file sizes: small files are read together; compressed files longer than
  ``partition_bytes`` are cut, and a task finds the first member in its range by its gzip and record signatures.
  An uncompressed file stays whole: its payloads may hold anything that looks like a record.
* Equality, IN and prefix predicates on header columns are pushed down.  A task inflates the headers of a record
  first; a rejected record, or any with ``payload=false``, is skipped by its length field without being inflated.
* Written members carry their length in the gzip extra field ``sl``; members of others without it are inflated to
  their end.  Files appear under their final names when the job commits, so lost or repeated tasks leave no records.

Paths are whatever ``pyarrow.fs`` opens (``file:``, ``hdfs:``, ``s3:``, ``gs:``).
"""

from __future__ import annotations

import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from millrace.operators.positions import fits_broadcast
from millrace.session import materialize, scratch_path

# The header names of the format.
_HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
}
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_MAGIC = b"\x1f\x8b\x08"
_PART_BYTES = 64 << 20
_CHUNK = 1 << 18


def _columns(options: dict[str, str]) -> dict[str, str]:
    extra = [h.strip() for h in options.get("header_columns", "").split(",") if h.strip()]
    return _HEADERS | {h: h for h in extra}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member that tells its own length in the extra field ``sl``."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    length = 24 + len(body) + len(tail)
    if length > 0xFFFFFFFF or len(record) > 0xFFFFFFFF:
        return _MAGIC + b"\x00\x00\x00\x00\x00\x00\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, length, len(record))
    return _MAGIC + b"\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One record; control characters in header values are percent-encoded."""
    lines = [f"{k}: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', v)}" for k, v in headers.items() if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


class _File:
    """A file read piece by piece at rising positions."""

    def __init__(self, path: str):
        system, name = _open(path)
        self.file = system.open_input_file(name)
        self.size = self.file.size()
        self.at, self.held = 0, b""

    def read(self, position: int, length: int) -> bytes:
        if not (self.at <= position and position + length <= self.at + len(self.held)):
            self.file.seek(position)
            self.at, self.held = position, self.file.read(max(length, _CHUNK))
        return self.held[position - self.at : position - self.at + length]


    def peek(self, position: int, length: int) -> bytes:
        """A few bytes, without reading on."""
        if self.at <= position and position + length <= self.at + len(self.held):
            return self.held[position - self.at : position - self.at + length]
        self.file.seek(position)
        return self.file.read(length)


class _Member:
    """The gzip member at ``position``: inflated as far as asked for."""

    def __init__(self, file: _File, position: int):
        self.file, self.begin = file, position
        self.inflate = zlib.decompressobj(31)
        self.fed, self.out, self.length = position, b"", None
        head = file.peek(position, 24)
        if head[3:4] == b"\x04" and head[12:16] == b"sl\x08\x00":
            self.length = struct.unpack("<I", head[16:20])[0]

    def grow(self, least: int) -> bool:
        """Inflate until ``least`` bytes are there; False if the member ends before."""
        while len(self.out) < least and not self.inflate.eof:
            raw = self.inflate.unconsumed_tail
            if not raw:
                raw = self.file.read(self.fed, 4096 if self.fed == self.begin else _CHUNK)
                self.fed += len(raw)
                if not raw:
                    raise ValueError("a compressed record ends early")
            self.out += self.inflate.decompress(raw, max(4096, least - len(self.out)))
        return len(self.out) >= least

    def end(self) -> int:
        if self.length is not None:
            return self.begin + self.length
        while not self.inflate.eof:
            self.out = b""
            self.grow(_CHUNK)
        return self.fed - len(self.inflate.unused_data)


def _first_member(file: _File, start: int) -> int:
    """The first position from ``start`` on where a record begins, reached from the file's first one by lengths.

    A payload may hold an archive itself, so bytes that look like a record prove nothing.
    """
    at = 0
    while at < min(start, file.size):
        at = _Member(file, at).end()
    return at


def _compressed(file: _File, start: int, stop: int, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    if _Member(file, 0).length is None:  # records that do not tell their lengths: the first range takes all of them
        start, stop = (0, file.size) if start == 0 else (file.size, file.size)
    at = _first_member(file, start)
    while at < min(stop, file.size):
        one = _Member(file, at)
        end = -1
        while end < 0 and one.grow(len(one.out) + 1):
            end = one.out.find(b"\r\n\r\n")
        if end < 0:
            raise ValueError("a record has no end of headers")
        headers = _parsed(one.out[:end])
        if wanted(headers):
            block = None
            if payload:
                length = int(headers["content-length"])
                if not one.grow(end + 4 + length):
                    raise ValueError("a record is shorter than its length")
                block = one.out[end + 4 : end + 4 + length]
            yield headers, block
        at = one.end()


def _plain(file: _File, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    at = 0
    while at < file.size:
        size = 4096
        while (end := (head := file.read(at, size)).find(b"\r\n\r\n")) < 0:
            if len(head) < size:
                if head.strip():
                    raise ValueError("a record has no end of headers")
                return
            size *= 2
        headers = _parsed(head[:end])
        length = int(headers["content-length"])
        if wanted(headers):
            yield headers, file.read(at + end + 4, length) if payload else None
        at += end + 4 + length + 4


@dataclass(frozen=True)
class _Range:
    path: str
    start: int
    stop: int


class _Ranges(InputPartition):
    def __init__(self, ranges: tuple[_Range, ...]):
        super().__init__(None)
        self.ranges = ranges


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema):
        self.path = options["path"]
        self.part_bytes = int(options.get("partition_bytes", _PART_BYTES))
        self.payload = options.get("payload", "true").lower() == "true"
        self.columns, self.schema = _columns(options), schema
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            header = self.columns.get(name, "").lower()
            if header and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.tests.append((header, "in", frozenset([f.value])))
            elif header and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.tests.append((header, "in", frozenset(f.value)))
            elif header and isinstance(f, StringStartsWith):
                self.tests.append((header, "prefix", f.value))
            else:
                yield f

    def partitions(self):
        system, root = _open(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        if not any(f.is_file for f in found) and system.get_file_info(root).is_file:
            found = [system.get_file_info(root)]
        prefix = self.path[: -len(root)] if self.path.endswith(root) else ""
        ranges = []
        for f in sorted(found, key=lambda f: f.path):
            name = posixpath.basename(f.path)
            if not f.is_file or name[0] in "._" or not name.endswith((".warc", ".warc.gz")):
                continue
            step = self.part_bytes if name.endswith(".gz") else max(1, f.size)
            ranges += [_Range(prefix + f.path, s, min(s + step, f.size)) for s in range(0, f.size, step)]
        groups, held = [], 0
        for r in ranges:
            if not groups or held + r.stop - r.start > self.part_bytes:
                groups.append([])
                held = 0
            groups[-1].append(r)
            held += r.stop - r.start
        return [_Ranges(tuple(g)) for g in groups] or [_Ranges(())]

    def _wanted(self, headers: dict[str, str]) -> bool:
        return all(
            (v := headers.get(h)) is not None and (v in value if kind == "in" else v.startswith(value))
            for h, kind, value in self.tests
        )

    def read(self, partition):
        rows, held = [], 0
        for r in partition.ranges:
            file = _File(r.path)
            found = (
                _compressed(file, r.start, r.stop, self._wanted, self.payload)
                if r.path.endswith(".gz")
                else _plain(file, self._wanted, self.payload)
            )
            for headers, block in found:
                http = block is not None and headers.get("content-type", "").startswith("application/http")
                body = block.partition(b"\r\n\r\n")[2] if http else block
                rows.append([*[headers.get(h.lower()) for h in self.columns.values()], int(headers["content-length"]), body])
                held += len(body or b"") + 500
                if held > 4 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.string()] * len(self.columns) + [pa.int64(), pa.binary()]
        cells = zip(*rows, strict=True) if rows else [()] * len(kinds)
        arrays = [pa.array(c, k) for c, k in zip(cells, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [*self.columns, "content_length", "payload"])


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of record_type, record_id, target_uri, date, refers_to, digest, payload and extra header columns."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.columns = options["path"], _columns(options)
        self.roll_bytes = int(options.get("file_bytes", 256 << 20))
        self.level = int(options.get("level", 6))
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        self.overwrite = overwrite

    def write(self, iterator) -> WriterCommitMessage:
        system, root = _open(self.path)
        names, out, size = [], None, 0
        for batch in iterator:
            table = batch.to_pydict()
            for i in range(batch.num_rows):
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{root}/_{names[-1]}", compression=None), 0
                    info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>"}
                    out.write(member(record(info, b"format: WARC File Format 1.1\r\n"), self.level))
                packed = member(self._record({c: table[c][i] for c in table}), self.level)
                out.write(packed)
                size += len(packed)
                if size >= self.roll_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(names)

    def _record(self, row: dict) -> bytes:
        headers = {h: None if row.get(c) is None else str(row[c]) for c, h in self.columns.items()}
        revisit = headers["WARC-Type"] == "revisit"
        if revisit:
            headers["WARC-Profile"] = _REVISIT_PROFILE
        headers["Content-Type"] = "application/http; msgtype=response"
        body = b"" if revisit else row["payload"] or b""
        return record(headers, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body)

    def commit(self, messages) -> None:
        """Earlier files go only now that all new ones are written."""
        system, root = _open(self.path)
        if self.overwrite:
            new = {f"_{name}" for m in messages if m for name in m.names}
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.base_name not in new:
                    (system.delete_file if f.is_file else system.delete_dir)(f.path)
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{root}/_{name}", f"{root}/{name}")

    def abort(self, messages) -> None:
        system, root = _open(self.path)
        for m in messages:
            for name in m.names if m else []:
                system.delete_file(f"{root}/_{name}")


class WarcSource(DataSource):
    """Options: path, header_columns (further headers as columns), payload, partition_bytes, file_bytes, level."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        texts = ", ".join(f"`{c}` string" for c in _columns(self.options))
        return f"{texts}, content_length long, payload binary"

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def _urn(*parts) -> F.Column:
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    cut = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.concat(F.lit("<urn:uuid:"), cut, F.lit(">"))


def page_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """A record for each page: of equal payloads of at least ``least_bytes``, all but the largest page_id are revisits.

    NULL html is an empty payload.  Rows repeated with the same page_id are all responses; a NULL page_id counts as
    the smallest.  Equal payloads are found by digest and length.  The digests that have copies are listed first, in a
    job of their own; while that list is small it is shipped, and no payload leaves its task.
    """
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    keyed = pages.select(
        "page_id",
        F.col("url").alias("target_uri"),
        html.alias("payload"),
        F.octet_length(html).alias("size"),
        F.sha1(html).alias("sha1"),
    )
    copies = (
        keyed.where(F.col("size") >= least_bytes)
        .groupBy("sha1", "size")
        .agg(F.max("page_id").alias("kept_id"), F.count("*").alias("many"))
        .where((F.col("many") > 1) & F.col("kept_id").isNotNull())
        .drop("many")
    )
    copies = materialize(copies)
    many = copies.count()
    if fits_broadcast(many, 64 * many):  # 40 letters of a digest and two numbers
        copies = F.broadcast(copies)
    revisit = F.col("kept_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_id"))
    found = keyed.join(copies, ["sha1", "size"], "left")
    return found.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        _urn(F.coalesce("page_id", F.lit(-1)), F.col("sha1")).alias("record_id"),
        "target_uri",
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.when(revisit, _urn(F.col("kept_id"), F.col("sha1"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), F.col("sha1")).alias("digest"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.col("page_id").cast("string").alias("X-Page-Id"),
    )


def write_pages(pages: DataFrame, path: str) -> None:
    """Write ``page_records`` of ``pages`` as archives under ``path``."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    page_records(pages).write.format("warc").option("header_columns", "X-Page-Id").mode("append").save(path)


def read_pages(spark, path: str) -> DataFrame:
    """The pages of archives: page_id, target_uri, payload_bytes, payload_digest, record_type, refers_to (a page_id).

    Sizes and digests are computed from the payloads read; a revisit takes those of the response that it refers to.
    """
    spark.dataSource.register(WarcSource)
    records = spark.read.format("warc").option("header_columns", "X-Page-Id").load(path)
    responses = materialize(
        records.where(F.col("record_type") == "response").select(
            F.col("X-Page-Id").cast("long").alias("page_id"),
            "target_uri",
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.sha1("payload").alias("payload_digest"),
            "record_type",
            F.lit(None).cast("long").alias("refers_to"),
            "record_id",
        )
    )
    revisits = (
        spark.read.format("warc").option("header_columns", "X-Page-Id").option("payload", "false").load(path)
        .where(F.col("record_type") == "revisit")
        .select(F.col("X-Page-Id").cast("long").alias("page_id"), "target_uri", "record_type", F.col("refers_to").alias("record_id"))
    )
    originals = responses.groupBy("record_id").agg(
        F.first("payload_bytes").alias("payload_bytes"),
        F.first("payload_digest").alias("payload_digest"),
        F.first("page_id").alias("refers_to"),
    )
    columns = ["page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    resolved = revisits.join(originals, "record_id", "left")
    return responses.select(columns).unionByName(resolved.select(columns))


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a fresh folder of the shared scratch area and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_pages(pages, path)
    return read_pages(pages.sparkSession, path)
