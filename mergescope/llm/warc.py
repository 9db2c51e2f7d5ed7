"""Writing and sequential reading of WARC archives with revisit records.

Each page becomes one record in a gzip member of its own. Of records with equal payloads of at least ``least`` bytes the
one with the smallest page_id is a response and the others are revisits that refer to it; smaller payloads are always
responses. A task writes archives below the shared folder under names no other attempt uses, and only archives that the
manifest of successful tasks lists are read, so a lost or repeated task leaves no record twice.

The reader goes through an archive once, member by member: it inflates piece by piece, frames each block by its content
length, and checks block and payload digests on the way, so memory is bounded by one record (by one piece when payloads
are not asked for). ``verified`` is false for a record whose digest or framing fails; a cut archive ends there. A record's head may have any
length: it is one record's, like the rest. ``read_archives`` raises when an archive gives another number of records than
its manifest says, and op2 also when a record is not verified, so no loss stays silent.

Null html is an empty payload, null url has no target header, and control characters in a url are percent-encoded. A
null page_id is kept; it is never the page that others refer to unless all of its group are null, which are then all
responses. Rows that repeat a page_id and its payload are alike in type. An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, new_path

# Bytes of an archive before the next one is begun, and of one read.
ARCHIVE, PIECE = 256 << 20, 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit holds the response's head without its payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if refers_to is None else head
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + made.flush()


class Members:
    """Inflated bytes of an archive's gzip members, one member at a time."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.rest, self.out, self.inflate, self.cut = stream, b"", b"", None, False

    def next_member(self) -> bool:
        self.out = b""
        self.inflate = None
        if not self.rest:
            self.rest = self.stream.read(PIECE)
        if self.rest:
            self.inflate = zlib.decompressobj(31)
        return self.inflate is not None

    def more(self) -> bool:
        """Inflate a further piece of this member; false at its end."""
        while not self.inflate.eof:
            if not self.rest:
                self.rest = self.stream.read(PIECE)
                if not self.rest:
                    self.cut = True
                    return False
            part = self.inflate.decompress(self.rest, PIECE)
            self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if part:
                self.out += part
                return True
        return False

    def line_block(self, mark: bytes) -> bytes | None:
        """What stands before a mark, which is taken off too; none if the member ends before it."""
        held = bytearray(self.out)
        from_ = 0
        while (at := held.find(mark, from_)) < 0:
            from_ = max(len(held) - len(mark) + 1, 0)
            self.out = b""
            if not self.more():
                return None
            held += self.out
        self.out = bytes(held[at + len(mark):])
        return bytes(held[:at])

    def starts(self, mark: bytes) -> bool:
        """Whether the member begins with a mark."""
        while len(self.out) < len(mark) and self.more():
            pass
        return self.out.startswith(mark)

    def take(self, most: int) -> bytes:
        if not self.out:
            self.more()
        got, self.out = self.out[:most], self.out[most:]
        return got


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_records(stream: BinaryIO, payloads: bool = False) -> Iterator[dict]:
    """Records of an archive in order."""
    members = Members(stream)
    while members.next_member():
        out = dict.fromkeys(["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]) | {"verified": False}
        try:
            if not members.starts(b"WARC/") or (head := members.line_block(b"\r\n\r\n")) is None:
                yield out
                return
            fields = _fields(head)
            left = int(fields["content-length"])
            identity = lambda name: next((int(m[1]) for m in [re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))] if m), None)
            out |= {"page_id": identity("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
                    "refers_to": identity("warc-refers-to")}
            block, body, http, size, kept = hashlib.sha1(), hashlib.sha1(), b"", 0, []
            in_body = False
            while left:
                part = members.take(min(left, PIECE))
                if not part:
                    break
                left -= len(part)
                block.update(part)
                if not in_body:
                    http += part
                    end = http.find(b"\r\n\r\n")
                    if end < 0:
                        continue
                    part, http, in_body = http[end + 4:], http[:end], True
                body.update(part)
                size += len(part)
                if payloads:
                    kept.append(part)
            while len(members.out) < 4 and members.more():
                pass
            framed = not left and members.out[:4] == b"\r\n\r\n"
            named = lambda d: "sha1:" + base64.b32encode(d.digest()).decode()
            length = int(_fields(http).get("content-length", -1))
            whole = out["record_type"] == "revisit" and size == 0 or size == length and fields.get("warc-payload-digest") == named(body)
            out |= {"payload_bytes": length, "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                    "payload": b"".join(kept) if payloads and out["record_type"] == "response" else None,
                    "verified": bool(framed and whole and fields.get("warc-block-digest") == named(block))}
            members.out = b""
            while members.more():
                members.out = b""
        except (zlib.error, ValueError, KeyError):
            yield out
            return
        yield out
        if members.cut:
            return


def write_archives(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Write (page_id, url, html) to archives; returns the manifest (path, n_records), itself kept in the shared folder."""
    folder = folder or new_path(pages.sparkSession, "archives")
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload"))
    first = p.where(F.length("payload") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"))
    joined = p.join(first, "sha1", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("first") < F.col("page_id")), F.col("first"))
    records = joined.select("page_id", "url", "payload", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        out, path, n, size = None, "", 0, 0
        done = lambda: pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]}, pa.schema([("path", pa.string()), ("n_records", pa.int64())]))
        for batch in batches:
            for page_id, url, payload, ref in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                if out is None:
                    path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                data = record(page_id, url, payload, ref)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE:
                    out.close()
                    out = None
                    yield done()
        if out is not None:
            out.close()
            yield done()

    manifest = materialise(records.mapInArrow(run, "path string, n_records long"), "manifest")
    return manifest.withColumn("folder", F.lit(folder))


_SCHEMA: list[tuple[str, pa.DataType, str]] = [
    ("page_id", pa.int64(), "long"), ("url", pa.string(), "string"), ("record_type", pa.string(), "string"), ("refers_to", pa.int64(), "long"),
    ("payload_bytes", pa.int64(), "long"), ("payload_digest", pa.string(), "string"), ("payload", pa.binary(), "binary"), ("verified", pa.bool_(), "boolean")]


def read_archives(manifest: DataFrame, payloads: bool = False, strict: bool = False) -> DataFrame:
    """Records of all archives of a manifest, an archive to a task at a time.

    Raises when an archive gives another number of records than the manifest says; if strict, also at one not verified.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, k) for n, k, _ in _SCHEMA])
        for batch in batches:
            for folder, path, expected in zip(*(batch.column(c).to_pylist() for c in ("folder", "path", "n_records"))):
                store, _ = open_folder(folder)
                with store.open_input_stream(path, compression=None) as stream:
                    held, size, n = [], 0, 0
                    for n, r in enumerate(read_records(stream, payloads), 1):
                        if strict and not r["verified"]:
                            raise ValueError(f"record {n} of {path} is not verified")
                        held.append(r)
                        size += 200 + len(r["url"] or "") + len(r["payload"] or b"")
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if n != expected:
                        raise ValueError(f"{path} gives {n} records, not {expected}")
                    yield pa.RecordBatch.from_pylist(held, schema)

    tasks = 4 * manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.repartition(tasks, "path").mapInArrow(run, ", ".join(f"{n} {k}" for n, _, k in _SCHEMA))


# Each five hexadecimal digits of a digest make four base32 characters.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') html, upper(sha1(coalesce(html, ''))) h FROM pages),
f AS (SELECT h, min(page_id) first FROM p GROUP BY h),
b AS (SELECT h, first, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), 'string_agg', '') digest FROM f)
SELECT page_id, octet_length(encode(html))::BIGINT payload_bytes, digest payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END record_type,
    CASE WHEN page_id <> first THEN first END refers_to FROM p JOIN b USING (h)"""
