"""Monolithic gzip normaliser for WARC files.

A WARC file that was gzipped as a whole can only be read from its start. The
normaliser inflates such a stream once, in chunks, and rewrites every record as a
gzip member of its own, byte for byte, with a sidecar index (``.idx``, one JSON line
a record) of offsets and lengths; afterwards any record can be read by itself. One
file is one task: gzip can't be split. Memory is a few chunks, whatever the block, and
the longest header, which may have any length after its version line.

Files are written under a name that no other attempt uses, index last, and their
paths are returned; what a failed attempt left behind is never referred to.
Paths are those of any file system that pyarrow knows (``file:``, ``hdfs:``, ``s3:``).

Defined results
---------------
* A stream of several members is read on as one stream. An empty file has no records.
* A stream that ends within a record: that record has one index row with status
  ``truncated`` and NULL offset and length, and no member (of a record that compresses
  to more than 32 MB a part may stand behind the last indexed member).
* Bytes that aren't WARC where a record should start, or a header without a whole number as its
  Content-Length: one row with status ``malformed``; reading goes on at the next line that
  starts with ``WARC/`` (for a bad length that may be a line of its block). Bytes that aren't
  gzip can't be passed over: one ``malformed`` row, and the rest of that file is skipped.
  Whole records before are kept.
* Writing pages: NULL html is an empty block, NULL url no target, NULL page_id no id;
  repeated rows are records each. Line breaks in a url are escaped. Other columns are
  ignored. Empty table: no files, no rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import column, materialize, parts_of, scratch_path, table

CHUNK, HOLD = 1 << 18, 1 << 25
INDEX_SCHEMA = "source_file string, warc_file string, record_no bigint, warc_type string, record_id string, target_uri string, offset bigint, length bigint, block_length bigint, block_sha256 string, status string"
_INDEX = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64()}[t]) for n, t in (c.strip().split(" ") for c in INDEX_SCHEMA.split(","))])


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


class Truncated(Exception):
    pass


class Malformed(Exception):
    pass


class NotGzip(Malformed):
    """The stream can't be inflated any further."""


class Inflated:
    """The inflated bytes of a gzip stream, read once and in order."""

    def __init__(self, raw) -> None:
        self.raw, self.inflater, self.held, self.rest, self.over, self.fresh = raw, zlib.decompressobj(31), bytearray(), b"", False, True

    def _more(self) -> bool:
        while not self.over:
            data = self.rest or self.raw.read(CHUNK)
            if not data:
                self.over = True
                if not self.fresh:
                    raise Truncated
                return False
            try:
                out = self.inflater.decompress(data, CHUNK)
            except zlib.error as why:
                raise NotGzip(str(why)) from None
            self.fresh = False
            self.rest = self.inflater.unconsumed_tail
            if self.inflater.eof:
                self.rest, self.inflater, self.fresh = self.inflater.unused_data, zlib.decompressobj(31), True
            if out:
                self.held += out
                return True
        return False

    def header(self) -> bytes | None:
        """The next record's header with its blank line; None at the end of the stream."""
        while not self.held.strip(b"\r\n"):
            self.held.clear()
            if not self._more():
                return None
        while self.held[:1] in (b"\r", b"\n"):
            del self.held[:1]
        seen = 0
        while (at := self.held.find(b"\r\n\r\n", seen)) < 0:
            if (len(self.held) > 1 << 20 and self.held.find(b"\r\n", 0, 1 << 20) < 0) or not b"WARC/".startswith(bytes(self.held[:5])):
                raise Malformed("no WARC header")
            seen = max(len(self.held) - 3, 0)
            if not self._more():
                raise Truncated
        out = bytes(self.held[: at + 4])
        del self.held[: at + 4]
        return out

    def resync(self) -> bool:
        """Pass over bytes up to the next line that starts with ``WARC/``; whether there is one."""
        while (at := self.held.find(b"\nWARC/")) < 0:
            del self.held[: max(len(self.held) - 5, 0)]
            if not self._more():
                return False
        del self.held[: at + 1]
        return True

    def exactly(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self._more():
                raise Truncated
            part = bytes(self.held[:size])
            del self.held[: len(part)]
            size -= len(part)
            yield part


def _fields(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise Malformed("no WARC version line")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def normalize_file(source: str, out_dir: str, name: str) -> Iterator[dict]:
    """Rewrite one file as ``out_dir/name.warc.gz`` and its index; yields the index rows."""
    fs, where = _open(source)
    out_fs, base = _open(out_dir)
    out_fs.create_dir(base, recursive=True)
    target = f"{base}/{name}.warc.gz"
    with fs.open_input_stream(where, compression=None) as raw, out_fs.open_output_stream(target, compression=None) as out, out_fs.open_output_stream(f"{target}.idx", compression=None) as index:
        stream, offset, number = Inflated(raw), 0, 0
        while True:
            row = dict.fromkeys(_INDEX.names) | {"source_file": source, "warc_file": f"{out_dir}/{name}.warc.gz", "record_no": number}
            try:
                header = stream.header()
                if header is None:
                    break
                fields = _fields(header)
                length = fields.get("content-length", "")
                if not (length.isascii() and length.isdigit() and len(length) < 19):
                    raise Malformed("no Content-Length")
                size = int(length)
                row |= {"warc_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "block_length": size}
                member, digest, parts = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha256(), Member(out)
                parts.add(member.compress(header))
                for piece in stream.exactly(size):
                    digest.update(piece)
                    parts.add(member.compress(piece))
                parts.add(member.compress(b"\r\n\r\n"))
                parts.add(member.flush())
            except (Truncated, Malformed) as why:
                yield row | {"status": "truncated" if isinstance(why, Truncated) else "malformed"}
                number += 1
                try:
                    if type(why) is Malformed and stream.resync():
                        continue
                except (Truncated, Malformed):
                    pass  # the damage is reported already
                break
            parts.finish()
            row |= {"offset": offset, "length": parts.size, "block_sha256": digest.hexdigest(), "status": "ok"}
            index.write(json.dumps({k: v for k, v in row.items() if k not in ("source_file", "warc_file")}).encode() + b"\n")
            offset += parts.size
            number += 1
            yield row


class Member:
    """Compressed bytes of one record: held until it is whole, or passed on beyond 32 MB."""

    def __init__(self, out) -> None:
        self.out, self.held, self.size, self.waiting = out, [], 0, 0

    def add(self, data: bytes) -> None:
        if data:
            self.held.append(data)
            self.size += len(data)
            self.waiting += len(data)
            if self.waiting > HOLD:
                self.finish()

    def finish(self) -> None:
        for piece in self.held:
            self.out.write(piece)
        self.held, self.waiting = [], 0


def read_record(path: str, offset: int, length: int) -> bytes:
    """One record of a normalised file, by its place in the index."""
    fs, where = _open(path)
    with fs.open_input_file(where) as f:
        f.seek(offset)
        return zlib.decompress(f.read(length), 31)


def normalize(files: DataFrame, out_dir: str) -> DataFrame:
    """Normalise the WARC files named in column ``path``: the rows of all their indexes.

    One task a file; the rows are a written table, so reading them doesn't rewrite files.
    """
    spark = files.sparkSession
    paths = files.select(column(files, "path", "string").alias("path")).where("path IS NOT NULL")
    tasks = max(spark.sparkContext.defaultParallelism, paths.count())

    def run(batches):
        for part in parts_of(batches, "path"):
            for (path,) in part:
                name = path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".warc") + "-" + uuid.uuid4().hex[:12]
                rows: list[dict] = []
                for row in normalize_file(path, out_dir, name):
                    rows.append(row)
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)

    return materialize(paths.repartition(tasks).mapInArrow(run, INDEX_SCHEMA), "warc-index")


def record(page_id: int | None, url: str | None, html: str | None) -> tuple[bytes, bytes]:
    """Header and block of a page's WARC record."""
    block = (html or "").encode("utf-8", "surrogatepass")
    lines = ["WARC/1.0", "WARC-Type: resource", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: text/html"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").strip())
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass"), block


def write_monolithic(pages: DataFrame, out_dir: str) -> DataFrame:
    """One whole-gzipped WARC file for each partition of ``pages``: (path)."""
    rows = pages.select(column(pages, "page_id", "bigint").alias("page_id"), column(pages, "url", "string").alias("url"), column(pages, "html", "string").alias("html"))

    def write(batches):
        fs, base = _open(out_dir)
        fs.create_dir(base, recursive=True)
        name = f"crawl-{uuid.uuid4().hex[:12]}.warc.gz"
        out = None
        for part in parts_of(batches, "page_id", "url", "html"):
            for page in part:
                if out is None:
                    out, packer = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                header, block = record(*page)
                out.write(packer.compress(header) + packer.compress(block) + packer.compress(b"\r\n\r\n"))
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{out_dir}/{name}"]})

    return materialize(rows.mapInArrow(write, "path string"), "warc-files")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows of all pages, which were first written as whole-gzipped WARC files."""
    here = scratch_path(spark, "warc")
    index = normalize(write_monolithic(table(spark, sf_dir, "pages"), f"{here}/monolithic"), f"{here}/normalised")
    return index.select(F.regexp_extract("record_id", r"urn:page:(-?\d+)", 1).cast("bigint").alias("page_id"), "target_uri", "record_no", "offset", "length", "block_length", "block_sha256", "status", "warc_file")


def op10_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index says of the records, without where the files put them."""
    return op10_warc(spark, sf_dir).select("page_id", "target_uri", "block_length", "block_sha256", "status")


ORACLE = """
SELECT page_id, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS target_uri,
  octet_length(encode(coalesce(html, '')))::BIGINT AS block_length, sha256(coalesce(html, '')) AS block_sha256, 'ok' AS status FROM pages
"""

QUERIES = {"op10_warc": op10_warc, "op10_warc_records": op10_warc_records}
ORACLES = {"op10_warc_records": ORACLE}
