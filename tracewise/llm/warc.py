"""WARC archives: writing records and the sequential reader (operator 6).

Writers make one gzip member per record.  The reader takes an archive as a
stream: members are inflated piece by piece, the block is framed by its
content length, and block and payload digests are verified on the way, so a
record of any size needs one buffer.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.session import ensure_checkpoint_dir

from .common import record_batch, stored

ARCHIVE_BYTES = 256 << 20
PIECE = 64 << 10
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, as Spark names it (``file:/x`` included)."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record as a gzip member: a revisit without the payload if it refers to another."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    given = url or ""
    target = urllib.parse.quote(given, safe=":/?#[]@!$&'()*+,;=%")  # an IRI as a URI; escapes it has already are kept
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
              ("WARC-Date", date), ("WARC-Target-URI", target),
              ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)), ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
              ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    if target != given:
        fields.append(("X-Given-URL", urllib.parse.quote(given, safe="")))
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", _PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


class _Members:
    """Inflated bytes of the gzip members of a stream, one member after the other."""

    def __init__(self, source):
        self.source, self.raw = source, b""
        self.z = None

    def start(self) -> bool:
        """Begin the next member; False at the end of the stream."""
        self.raw = self.raw or self.source.read(PIECE)
        self.z, self.held = zlib.decompressobj(31), b""
        return bool(self.raw)

    def piece(self) -> bytes:
        """Some more bytes of this member; empty at its end."""
        while not self.z.eof:
            if self.z.unconsumed_tail:
                data = self.z.unconsumed_tail
            else:
                data = self.raw or self.source.read(PIECE)
                self.raw = b""
                if not data:
                    raise ValueError("archive ends inside a gzip member")
            out = self.z.decompress(data, PIECE)
            if self.z.eof:
                self.raw = self.z.unused_data
            if out:
                return out
        return b""

    def upto(self, mark: bytes) -> bytes:
        """What stands before ``mark``: a record's header, as long as its address makes it."""
        seen = bytearray(self.held)
        at = seen.find(mark)
        while at < 0:
            more = self.piece()
            if not more:
                raise ValueError("record header is not ended")
            start = max(0, len(seen) - len(mark) + 1)
            seen += more
            at = seen.find(mark, start)
        self.held = bytes(seen[at + len(mark):])
        return bytes(seen[:at])

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held:
                self.held = self.piece()
                if not self.held:
                    raise ValueError("record is shorter than its content length")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out


def read_records(source, with_payload: bool = False) -> Iterator[dict]:
    """Records of one archive stream in order, framed and verified; raises ValueError on damage."""
    m = _Members(source)
    while m.start():
        lines = m.upto(b"\r\n\r\n").decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block, payload = hashlib.sha1(), hashlib.sha1()
        size, kept, head, in_payload = 0, [], b"", False
        for part in m.exactly(int(fields["Content-Length"])):
            block.update(part)
            if not in_payload:
                head += part
                if b"\r\n\r\n" not in head:
                    continue
                part, in_payload = head.partition(b"\r\n\r\n")[2], True
            payload.update(part)
            size += len(part)
            if with_payload:
                kept.append(part)
        if b"".join(m.exactly(4)) != b"\r\n\r\n" or m.held or m.piece():
            raise ValueError("record does not end where its content length says")
        named = lambda h: "sha1:" + base64.b32encode(h.digest()).decode()
        if fields["WARC-Block-Digest"] != named(block):
            raise ValueError("block digest differs")
        if fields["WARC-Type"] == "response" and (fields["WARC-Payload-Digest"] != named(payload) or int(fields["X-Payload-Length"]) != size):
            raise ValueError("payload digest differs")
        yield fields | {"payload": b"".join(kept) if with_payload else None}


def marked_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(page_id, url, payload, refers_to): the smallest id of an equal payload, null for that page itself.

    Only digests and sizes are grouped and joined by payload; payloads are
    joined by (page id, digest), which no group of copies can skew.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload")).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    keys = stored(p.select("page_id", "sha", F.octet_length("payload").alias("n")).filter(F.col("n") >= min_bytes), "digests")
    firsts = keys.groupBy("sha", "n").agg(F.min("page_id").alias("first"))
    later = (keys.join(firsts, ["sha", "n"]).filter(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")))
             .select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), F.col("first").alias("refers_to")).distinct())
    return p.join(later, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left").select("page_id", "url", "payload", "refers_to")


def write_archives(records: DataFrame, uri: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, payload, refers_to) rows as ``.warc.gz`` files; returns (path, n) of finished ones.

    Each task streams its rows to files of its own, closed at about
    ``archive_bytes``.  Names carry the attempt, and the stored list names only
    files of tasks that succeeded, so a lost executor leaves no half archive in it.
    """
    schema = pa.schema([("path", pa.string()), ("n", pa.int64())])

    def run(batches):
        store, root = open_store(uri)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        stream, paths, counts, size = None, [], [], 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")]):
                if stream is None:
                    paths.append(f"{root}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(paths):03d}.warc.gz")
                    counts.append(0)
                    stream, size = store.open_output_stream(paths[-1], compression=None), 0
                data = record(row[0], row[1], row[2].encode(), row[3])
                stream.write(data)
                size, counts[-1] = size + len(data), counts[-1] + 1
                if size >= archive_bytes:
                    stream.close()
                    stream = None
        if stream is not None:
            stream.close()
        yield record_batch(schema, {"path": paths, "n": counts})

    return stored(records.mapInArrow(run, "path string, n long"), "archives")


def read_archives(archives: DataFrame, uri: str, with_payload: bool = False) -> DataFrame:
    """Rows of the records of the archives (column ``path``), one task per archive at best."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
    number = lambda x: int(x[len("<urn:page:"):-1]) if x and x != "<urn:page:>" else None

    def run(batches):
        store, _ = open_store(uri)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                cols, size = {f.name: [] for f in schema}, 0
                with store.open_input_stream(path, compression=None) as source:
                    for r in read_records(source, with_payload):
                        row = (number(r["WARC-Record-ID"]), int(r["X-Payload-Length"]), r["WARC-Payload-Digest"].removeprefix("sha1:"),
                               r["WARC-Type"], number(r.get("WARC-Refers-To")), urllib.parse.unquote(r["X-Given-URL"]) if "X-Given-URL" in r else r["WARC-Target-URI"], r["payload"])
                        for name, v in zip(cols, row):
                            cols[name].append(v)
                        size += len(r["payload"] or b"") + 100
                        if size > 8 << 20:
                            yield record_batch(schema, cols)
                            cols, size = {f.name: [] for f in schema}, 0
                yield record_batch(schema, cols)

    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0,
                       uri: str | None = None, with_payload: bool = False) -> DataFrame:
    """Write a record per row and read the archives back.

    Of records with equal payloads of at least ``min_bytes`` that with the
    smallest id is a response, the others revisit it; rows that repeat the
    smallest id with that payload are responses as well.  Null payloads are
    empty, a null url is empty, a null id revisits the smallest other id, or
    is a response if there is none.  No rows write no archives.
    """
    uri = uri or f"{ensure_checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(marked_revisits(pages, id_col, url_col, payload_col, min_bytes), uri), uri, with_payload)
