"""WARC archives: writing pages, reading archives, and assembling transactions into one nested row per capture.

Writing. Every page gives a response record, or a revisit record where a page with a smaller page_id has the same
payload, and beside it a request and a metadata record whose WARC-Concurrent-To names it; the metadata record holds
the page's id. A revisit names the response record that it repeats (WARC-Refers-To, with its target URI and date).
Responses are therefore written first; their ids are read from the archives, and revisits are written by these.
Every record is a gzip member of its own. Files are closed at FILE_BYTES written. A task's files count only when it
commits: the names are listed in a manifest at the end, so what a lost executor leaves behind is never read.

Reading. Archives are gzip or plain. A gzip file is read in ranges of RANGE_BYTES, each by the task that has the
range: it seeks the first member there that begins a record, and goes on to the first such member beyond. A plain
file, or one of a single member, is read by one task. Records are cut by Content-Length and streamed, so memory
follows neither file nor record size, unless payloads are asked for (those beyond PAYLOAD_BYTES stay null).
Folders are those that pyarrow's file systems reach (local, HDFS, S3, GCS, Azure).

Assembly. Request and metadata records join the capture that they are concurrent to, by its record id; they are
grouped by capture, so each capture is one nested row. An id that more than PART records are concurrent to gives
rows of about PART records each, numbered by `part`; the capture itself is in part 0.

Defined results: null html is an empty payload; pages with the same page_id and payload are each a record, of the same
kind; a null page_id counts as larger than any other; null urls are written as `urn:none`, and white space in urls as
percent escapes; what is malformed in an archive is a row of type `error` with a reason, ends its range, and leaves
the records before it; concurrent records without a capture are a row with no capture; empty tables give empty archives.
Page ids are integers.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from weftable.llm.common import scratch, shared_path, written
from weftable.sources.shared import small_batches

FILE_BYTES, RANGE_BYTES = 256 << 20, 16 << 20
PAYLOAD_BYTES, FIELDS_BYTES, HEADER_BYTES = 1 << 30, 16 << 20, 1 << 20
PART = 10_000
LEVEL = 6
DATE = "2020-01-01T00:00:00Z"
PAGE = "page_id bigint, uri string, html string, digest string, refers_to string, refers_uri string"
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, profile string, payload_bytes bigint, payload_digest string, declared_digest string, fields map<string,string>, payload binary"
_SCHEMA = pa.schema([(n, pa.string()) for n in ("record_id", "type", "concurrent_to", "refers_to", "target_uri", "profile")] + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("declared_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":/", ":///", 1))


# ---- writing -----------------------------------------------------------------------------------------------


def member(kind: str, rid: str, uri: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return zlib.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", LEVEL, 31)


def new_id() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def page_records(page_id: int | None, uri: str, html: bytes, digest: str, refers_to: str | None, refers_uri: str | None) -> Iterator[bytes]:
    """The three records of a page; with refers_to, the first is a revisit."""
    rid = new_id()
    near = ("WARC-Concurrent-To", rid)
    http = [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    if refers_to is None:
        yield member("response", rid, uri, http, head + html)
    else:
        told = [("WARC-Profile", _PROFILE), ("WARC-Refers-To", refers_to), ("WARC-Refers-To-Target-URI", refers_uri or "urn:none"), ("WARC-Refers-To-Date", DATE)]
        yield member("revisit", rid, uri, [*told, *http], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    yield member("request", new_id(), uri, [near, ("Content-Type", "application/http; msgtype=request")], f"GET {uri} HTTP/1.1\r\n\r\n".encode())
    note = f"pageId: {'' if page_id is None else page_id}\r\n"
    yield member("metadata", new_id(), uri, [near, ("Content-Type", "application/warc-fields")], note.encode())


@dataclass
class _Wrote(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, limit: int) -> None:
        self.path, self.limit, self.job = path, limit, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Wrote:
        fs, root = file_system(self.path)
        names: list[str] = []
        out = None
        for batch in iterator:
            html = batch.column("html").cast(pa.large_binary()).to_pylist()
            rest = zip(*(batch.column(c).to_pylist() for c in ("page_id", "uri", "digest", "refers_to", "refers_uri")))
            for (page_id, uri, digest, refers_to, refers_uri), text in zip(rest, html):
                if out is None:
                    names.append(f"{self.job}-{uuid.uuid4().hex}.warc.gz")
                    out = fs.open_output_stream(f"{root}/{names[-1]}", compression=None)
                for m in page_records(page_id, uri, text or b"", base64.b32encode(bytes.fromhex(digest)).decode(), refers_to, refers_uri):
                    out.write(m)
                if out.tell() >= self.limit:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Wrote(names)

    def commit(self, messages) -> None:
        fs, root = file_system(self.path)
        with fs.open_output_stream(f"{root}/_committed-{self.job}.json", compression=None) as f:
            f.write(json.dumps([n for m in messages if m is not None for n in m.names]).encode())

    def abort(self, messages) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            for n in m.names if m is not None else ():
                fs.delete_file(f"{root}/{n}")


def base32(digest):
    """SQL for the base32 of 40 hexadecimal digits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = [F.conv(F.substring(digest, 5 * j + 1, 5), 16, 10).cast("int") for j in range(8)]
    return F.concat(*[F.substr(F.lit(letters), F.shiftright(v, 15 - 5 * i).bitwiseAND(31) + 1, F.lit(1)) for v in five for i in range(4)])


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes pages as archives into the folder. Payloads of fewer than min_payload bytes are always responses."""
    spark = pages.sparkSession
    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(f"`{url_col}`"), "\r", "%0D"), "\n", "%0A"), "\\s", "%20")
    slim = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.coalesce(uri, F.lit("urn:none")).alias("uri"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    slim = slim.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    none = F.lit(None).cast("string")

    def save(df: DataFrame) -> None:
        spark.dataSource.register(Archives)
        with small_batches(spark):
            df.select("page_id", "uri", "html", "digest", "refers_to", "refers_uri").write.format(Archives.name()).option("path", path).option("fileBytes", str(file_bytes)).mode("append").save()

    with scratch(spark):
        # only ids and digests are shuffled for the first page of each payload, pages then by their id
        ids = written(slim.select("page_id", "uri", "digest", F.octet_length("html").alias("size")).filter(F.col("size") >= min_payload), "warc-ids")
        firsts = ids.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null").select("digest", "first_id")
        firsts = written(firsts, "warc-firsts")  # a table of its own, so that the join can split a very common payload
        again = written(ids.join(firsts, "digest").filter("not (page_id <=> first_id)").select("page_id", "uri", "digest"), "warc-again")
        a, b = slim.alias("a"), again.select("page_id", "digest").distinct().alias("b")
        save(a.join(b, F.expr("a.page_id <=> b.page_id and a.digest = b.digest"), "left_anti").withColumns({"refers_to": none, "refers_uri": none}))
        known = firsts.select("digest", base32("digest").alias("payload_digest"))
        said = read(spark, path, payloads=False).filter("type = 'response'").select("payload_digest", "record_id", "target_uri")
        index = said.join(known, "payload_digest").groupBy("digest").agg(F.min(F.struct("record_id", "target_uri")).alias("r"))
        index = written(index.select("digest", F.col("r.record_id").alias("refers_to"), F.col("r.target_uri").alias("refers_uri")), "warc-index")
        save(again.join(index, "digest").withColumn("html", F.lit("")))


# ---- reading -----------------------------------------------------------------------------------------------


class Malformed(Exception):
    """An archive that can't be read on."""


class _Stream:
    """The bytes of an archive from an offset on; gzip members follow one another."""

    def __init__(self, file, at: int, packed: bool) -> None:
        file.seek(at)
        self.file, self.next, self.packed = file, at, packed  # next: offset of the first byte of raw
        self.raw, self.zip, self.buf, self.pos = b"", None, b"", 0
        self.member, self.fresh = at, True  # the member that the next byte is of; whether it is its first

    def _fill(self) -> bool:
        """More bytes into the buffer; False at the end."""
        rest = self.buf[self.pos :]
        while True:
            if not self.raw:
                self.raw = self.file.read(1 << 16)
                if not self.raw:
                    if self.packed and self.zip is not None and not self.zip.eof:
                        raise Malformed("gzip member cut short")
                    return False
            if not self.packed:
                got, self.raw = self.raw, b""
                break
            if self.zip is None or self.zip.eof:
                self.zip, self.member, self.fresh = zlib.decompressobj(31), self.next, not rest
            before = len(self.raw)
            got = self.zip.decompress(self.raw, 1 << 18)
            self.raw = self.zip.unused_data if self.zip.eof else self.zip.unconsumed_tail
            self.next += before - len(self.raw)
            if got:
                break
        self.buf, self.pos = rest + got, 0
        return True

    def line(self, limit: int = HEADER_BYTES) -> bytes:
        while (end := self.buf.find(b"\n", self.pos)) < 0:
            if len(self.buf) - self.pos > limit:
                raise Malformed("header line too long")
            if not self._fill():
                end = len(self.buf) - 1
                break
        out, self.pos = self.buf[self.pos : end + 1], end + 1
        self.fresh = self.fresh and not out
        return out

    def take(self, most: int) -> bytes:
        if self.pos >= len(self.buf) and not self._fill():
            return b""
        out = self.buf[self.pos : self.pos + most]
        self.pos += len(out)
        self.fresh = False
        return out

    def at_member(self) -> bool:
        """Whether a member begins here, blank lines between records left behind."""
        while True:
            if self.pos >= len(self.buf) and not self._fill():
                return False
            if self.buf[self.pos] not in b"\r\n":
                return self.fresh
            self.pos += 1
            self.fresh = False


def _headers(lines) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        k, _, v = line.decode("utf-8", "replace").partition(":")
        out.setdefault(k.strip().lower(), v.strip())
    return out


def sought(file, start: int, end: int) -> int | None:
    """The first gzip member in [start, end) that begins a record."""
    if start == 0:
        return 0
    at, data = start, b""
    while at < end:
        file.seek(at)
        data = file.read(min(1 << 20, end - at) + 1024)
        i = data.find(b"\x1f\x8b\x08")
        while 0 <= i < end - at:
            try:
                if zlib.decompressobj(31).decompress(data[i : i + 1024], 5) == b"WARC/":
                    return at + i
            except zlib.error:
                pass
            i = data.find(b"\x1f\x8b\x08", i + 1)
        at += max(1, len(data) - 1024)
        if len(data) <= 1024:
            return None
    return None


def parsed(file, start: int, end: int | None, payloads: bool) -> Iterator[dict]:
    """Rows of the records of a range; end None: to the end of the file."""
    file.seek(0)
    packed = file.read(2) == b"\x1f\x8b"
    at = sought(file, start, end) if packed and end is not None else start
    if at is None:
        return
    stream = _Stream(file, at, packed)
    try:
        while True:
            if stream.at_member() and end is not None and stream.member >= end:
                return
            line = stream.line()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise Malformed(f"no version line: {line[:80]!r}")
            lines, size = [], 0
            while (line := stream.line()) not in (b"\r\n", b"\n", b""):
                size += len(line)
                if size > HEADER_BYTES:
                    raise Malformed("headers too long")
                lines.append(line)
            yield record(_headers(lines), stream, payloads)
    except (Malformed, OSError, EOFError, zlib.error) as e:
        yield dict.fromkeys(_SCHEMA.names) | {"type": "error", "fields": [("reason", str(e) if isinstance(e, Malformed) else f"{type(e).__name__}: {e}")]}


def record(head: dict[str, str], stream: _Stream, payloads: bool) -> dict:
    size = head.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Malformed(f"no content length: {size[:80]!r}")
    if len(size) > 18:
        raise Malformed(f"content length out of range: {size[:80]!r}")
    kind, left = head.get("content-type", ""), int(size)
    http, fields = kind.startswith("application/http"), kind.startswith("application/warc-fields")
    keep = payloads or (fields and left <= FIELDS_BYTES)
    digest, n, kept, tail, body = hashlib.sha1(), 0, [], b"", not http
    while left:
        piece = stream.take(min(left, 1 << 18))
        if not piece:
            raise Malformed(f"record cut short after {int(size) - left} of {size} bytes")
        left -= len(piece)
        if not body:
            piece = tail + piece
            cut = piece.find(b"\r\n\r\n")
            if cut < 0:
                tail = piece[-3:]
                continue
            body, piece = True, piece[cut + 4 :]
        digest.update(piece)
        n += len(piece)
        if keep and n <= PAYLOAD_BYTES:
            kept.append(piece)
    payload = b"".join(kept) if keep else b""
    named = sorted(_headers(payload.splitlines()).items()) if fields else []
    return {
        "record_id": head.get("warc-record-id"), "type": head.get("warc-type", ""), "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "profile": head.get("warc-profile"),
        "payload_bytes": n, "payload_digest": base64.b32encode(digest.digest()).decode(), "declared_digest": bare_digest(head.get("warc-payload-digest")), "fields": named, "payload": payload if payloads and n <= PAYLOAD_BYTES else None,
    }


def bare_digest(value: str | None) -> str | None:
    """The bare upper-case base32 SHA-1 of a digest header in base32 or hexadecimal; anything else gives null."""
    name, _, v = (value or "").partition(":")
    if name.lower() != "sha1":
        return None
    if re.fullmatch("[0-9A-Fa-f]{40}", v):
        return base64.b32encode(bytes.fromhex(v)).decode()
    return v.upper() if re.fullmatch("[A-Za-z2-7]{32}", v) else None


@dataclass
class _Ranges(InputPartition):
    ranges: list[tuple[str, int, int | None]]


class _Reader(DataSourceReader):
    def __init__(self, path: str, payloads: bool, range_bytes: int) -> None:
        self.path, self.payloads, self.range_bytes = path, payloads, range_bytes

    def partitions(self) -> list[_Ranges]:
        """Ranges of files; small files share a partition."""
        from pyarrow.fs import FileSelector, FileType

        fs, root = file_system(self.path)
        found = fs.get_file_info(FileSelector(root, recursive=True)) if fs.get_file_info(root).type == FileType.Directory else [fs.get_file_info(root)]
        found = [f for f in found if f.type == FileType.File]
        committed: set[str] | None = None
        for f in found:
            if f.base_name.startswith("_committed-"):
                with fs.open_input_stream(f.path) as s:
                    committed = (committed or set()) | set(json.loads(s.read()))
        names = [f for f in found if not f.base_name.startswith(("_", ".")) and (committed is None or f.base_name in committed)]
        out, held = [], 0
        for f in sorted(names, key=lambda f: f.path):
            size = f.size or 0
            if size <= self.range_bytes:
                if not out or held + size > self.range_bytes:
                    out.append(_Ranges([]))
                    held = 0
                out[-1].ranges.append((f.path, 0, None))
                held += size
            else:
                # a range of a plain file but the first finds no member: the first then reads it all
                out += [_Ranges([(f.path, a, a + self.range_bytes)]) for a in range(0, size, self.range_bytes)]
                held = self.range_bytes
        return out or [_Ranges([])]

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        rows, size = [], 0
        for path, start, end in partition.ranges:
            with fs.open_input_file(path) as file:
                if start:
                    if file.read(2) != b"\x1f\x8b":
                        continue
                for row in parsed(file, start, end, self.payloads):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= 2000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


class Archives(DataSource):
    """spark.read.format("weftable-warc").option("path", folder).option("payloads", "false").load()."""

    @classmethod
    def name(cls) -> str:
        return "weftable-warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("payloads", "true") == "true", int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("fileBytes", FILE_BYTES)))


def read(spark: SparkSession, path: str, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record of the archives at path."""
    spark.dataSource.register(Archives)
    return spark.read.format(Archives.name()).option("path", path).option("payloads", str(payloads).lower()).option("rangeBytes", str(range_bytes)).load()


# ---- assembly ----------------------------------------------------------------------------------------------


def assemble(records_: DataFrame, part: int = PART) -> DataFrame:
    """Nested rows of captures: capture_id, part, capture (its response or revisit record), requests, metadata."""
    kinds = ("response", "revisit", "resource", "request", "metadata")
    main = F.col("type").isin("response", "revisit", "resource")
    keyed = records_.filter(F.col("type").isin(*kinds)).withColumn("capture_id", F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")))
    many = keyed.groupBy("capture_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > part)
    many = many.select("capture_id", F.ceil(F.col("_n") / part).alias("_parts"))
    keyed = keyed.join(many, "capture_id", "left").withColumn("part", F.when(main | F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("record_id", "type"), F.col("_parts"))).cast("int"))
    body = F.struct("record_id", "type", "refers_to", "target_uri", "profile", "payload_bytes", "payload_digest", "declared_digest", "fields", "payload")
    out = keyed.groupBy("capture_id", "part").agg(
        F.collect_list(F.when(main, body)).alias("captures"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "request", F.struct("record_id", "target_uri", "payload_bytes", "payload")))).alias("requests"),
        F.collect_list(F.when(F.col("type") == "metadata", F.struct("record_id", "fields"))).alias("metadata"),
    )
    return out.select("capture_id", "part", F.explode_outer("captures").alias("capture"), "requests", "metadata")


def report(pages: DataFrame, id_col: str = "page_id", min_payload: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder, reads them back, and gives what the captures say. What a revisit
    repeats is looked up by the record id that it names."""
    spark = pages.sparkSession
    with scratch(spark) as s:
        path = shared_path(spark, "warc")
        write(pages, path, id_col=id_col, min_payload=min_payload)
        found = written(read(spark, path, payloads=False), "warc-records")
        page = F.nullif(F.try_element_at(F.get("metadata", F.lit(0))["fields"], F.lit("pageid")), F.lit("")).cast("bigint")
        captures = assemble(found).filter("capture is not null").select(page.alias("page"), "capture.*")
        captures = written(captures.select("page", "record_id", "type", "refers_to", "payload_bytes", "payload_digest"), "warc-captures")
        first = captures.filter("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page").alias("first"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"))
        told = captures.filter("type = 'revisit'").join(first, "refers_to", "left").select("page", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "type", "first")
        plain = captures.filter("type <> 'revisit'").select("page", "payload_bytes", "payload_digest", "type", F.lit(None).cast("bigint").alias("first"))
        return s.result(plain.unionByName(told).select(F.col("page").alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("first").alias("refers_to")), "warc-pages")
