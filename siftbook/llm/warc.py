"""Web archives: pages to WARC files, whole-file gzip to one member a record with an offset index, and back."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftbook.session import stage

#: Bytes read, inflated or written at a time; uncompressed bytes after which a new archive begins.
BLOCK, ARCHIVE = 1 << 18, 64 << 20
_END = b"\r\n\r\n"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file that all executors reach."""
    return fs.FileSystem.from_uri(path)


def _record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"{name}: {value}" for name, value in fields.items() if value is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + _END + block + _END


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit that names the page with the same payload."""
    fields = {
        "WARC-Target-URI": None if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url), "Page-ID": page_id,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(), "Payload-Length": len(payload),
    }
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}".encode() + _END
    if refers_to is None:
        return _record("response", fields | {"Content-Type": "application/http; msgtype=response"}, http + payload)
    fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Refers-To-Page": refers_to}
    return _record("revisit", fields | {"Content-Type": "application/http; msgtype=response"}, http)


def marked(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the largest page_id with an equal payload of ``least_bytes`` or more.

    Payloads are compared by SHA-1 and length; the largest id of each is an aggregate, so many copies
    of one payload are combined before the shuffle. A null payload is empty. Rows that repeat the
    largest id are responses, and so are all copies of a payload none of whose ids is known.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("_sha"), F.octet_length(html).alias("_size"))
    largest = rows.groupBy("_sha", "_size").agg(F.max("page_id").alias("_first"))
    refers = F.when((F.col("_size") >= least_bytes) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return rows.join(largest, ["_sha", "_size"]).select("page_id", "url", "html", refers.alias("refers_to"))


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """Write WARC files, each one gzip stream over all its records; gives their paths.

    Names are new for each attempt of a task, and only those of attempts that succeeded are returned.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base)
        paths, out, gz, size = [], None, None, 0
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                page_id, url, html, refers_to = (v.as_py() for v in row)
                if out is None:
                    paths.append(f"{folder}/{name}-{len(paths):04d}.warc.gz")
                    out, gz, size = system.open_output_stream(f"{base}/{paths[-1].rpartition('/')[2]}", compression=None), zlib.compressobj(1, wbits=31), 0
                    out.write(gz.compress(_record("warcinfo", {"Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))
                record = page_record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to)
                out.write(gz.compress(record))
                size += len(record)
                if size >= ARCHIVE:
                    out.write(gz.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(gz.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return stage(records.select("page_id", "url", "html", "refers_to").mapInArrow(task, "path string"), "archives")


class Inflated:
    """The bytes of a gzip file, inflated once from start to end, whatever members it has."""

    def __init__(self, source):
        self.source, self.held, self.rest, self.inside = source, bytearray(), b"", False
        self.gz = zlib.decompressobj(31)

    def _more(self) -> bool:
        """Some more bytes, false at the end of the file; a file may end behind a member only."""
        self.rest = self.rest or self.source.read(BLOCK)
        while not self.inside and not (rest := self.rest.lstrip(b"\0")):  # zeros may fill up a member's place
            self.rest = self.source.read(BLOCK)
            if not self.rest:
                return False
        if not self.inside:
            self.rest = rest
        made = self.gz.decompress(self.rest, BLOCK)
        if not (made or self.rest or self.gz.eof):
            raise ValueError("the archive ends inside a gzip member")
        self.held += made
        self.inside = not self.gz.eof
        if self.inside:
            self.rest = self.gz.unconsumed_tail
        else:
            self.rest, self.gz = self.gz.unused_data, zlib.decompressobj(31)
        return True

    def header(self) -> bytes | None:
        """Up to the next blank line; None at the end."""
        at = -1
        while at < 0:
            start = max(len(self.held) - 3, 0)
            at = self.held.find(_END)
            if at < 0 and not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record's header")
                return None
            at = at if at >= 0 else self.held.find(_END, start)
        head = bytes(self.held[: at + 4])
        del self.held[: at + 4]
        return head

    def pieces(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, in pieces."""
        while size:
            if not self.held and not self._more():
                raise ValueError("the archive ends inside a record")
            piece = bytes(self.held[:size])
            del self.held[:size]
            size -= len(piece)
            if piece:
                yield piece


def fields_of(header: bytes) -> dict[str, str]:
    """Fields of a record's header, names in lower case."""
    pairs = (line.partition(":") for line in header.decode("utf-8", "surrogatepass").split("\r\n")[1:] if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


INDEX = "path string, offset long, length long, kind string, uri string"


def normalise(files: DataFrame) -> DataFrame:
    """Rewrite archives so that each record is a gzip member of its own; gives the offset index.

    A task inflates one file once, as a stream, and holds a block of it at a time. Beside each new
    file ``x.members.warc.gz`` it writes the index ``x.members.idx``, a line of JSON for each record.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = opened(path)
                own = f".members-{uuid.uuid4().hex[:12]}.warc.gz"
                target, rows, at = path.removesuffix(".warc.gz") + own, [], 0
                new = name.removesuffix(".warc.gz") + own
                sidecar_name = new.removesuffix(".warc.gz") + ".idx"
                raw = {"compression": None}
                with system.open_input_stream(name, **raw) as source, system.open_output_stream(new, **raw) as out, system.open_output_stream(sidecar_name, **raw) as sidecar:
                    stream = Inflated(source)
                    while (header := stream.header()) is not None:
                        fields, gz, start = fields_of(header), zlib.compressobj(1, wbits=31), at
                        at += out.write(gz.compress(header))
                        for piece in stream.pieces(int(fields["content-length"]) + len(_END)):
                            at += out.write(gz.compress(piece))
                        at += out.write(gz.flush())
                        rows.append((target, start, at - start, fields["warc-type"], fields.get("warc-target-uri")))
                        sidecar.write(json.dumps(dict(zip(("offset", "length", "kind", "uri"), rows[-1][1:], strict=True))).encode() + b"\n")
                        if len(rows) == 10_000:
                            yield _table(rows)
                            rows = []
                yield _table(rows)

    return stage(files.repartition(F.col("path")).mapInArrow(task, INDEX), "index")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = ("path", "offset", "length", "kind", "uri"), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_records(index: DataFrame) -> DataFrame:
    """Pages from archives by their index: each record is fetched and inflated alone, and its digest is verified."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            out = []
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if name != path:
                    if source is not None:
                        source.close()
                    system, own = opened(name)
                    path, source = name, system.open_input_file(own)
                source.seek(offset)
                record = zlib.decompress(source.read(length), 31)
                header, _, block = record.partition(_END)
                fields = fields_of(header)
                payload = block[: int(fields["content-length"])].partition(_END)[2]
                digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["payload-length"])
                if fields["warc-type"] == "response" and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (size, digest):
                    raise ValueError(f"{path} at {offset}: the payload differs from its digest")
                ids = [int(fields[f]) if f in fields else None for f in ("page-id", "refers-to-page")]
                out.append((ids[0], fields.get("warc-target-uri"), size, digest, fields["warc-type"], ids[1], payload if fields["warc-type"] == "response" else None))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return index.filter("kind IN ('response', 'revisit')").select("path", "offset", "length").mapInArrow(task, schema)
