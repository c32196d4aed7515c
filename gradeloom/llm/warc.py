"""WARC archives: a writer with revisit records and a sequential reader.

Each record is a gzip member of its own. The reader goes through an archive from
front to end with incremental decompression, frames each record by its
content-length and verifies its digests; it holds one record at a time. The
writer gives every page a response record, or a revisit record where an equal
payload is stored under a smaller page_id.

Tasks write their archives to the shared folder under a temporary name and
rename them when complete, so a lost or repeated task leaves only whole
archives, of which the manifest names one for each partition.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_folder, local_path

CHUNK = 1 << 16
RECORDS = 2000  # of an archive, at most
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


class WarcError(ValueError):
    pass


@dataclass
class Record:
    """A record: its headers (names lower-cased), its block, and for HTTP blocks the headers and payload."""

    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, payload = self.block.partition(END)
        return _fields(head), payload


def sha1_name(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _fields(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")[1:]
    return {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines) if k}


def member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", "sha1:" + sha1_name(block)), ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + END) + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """A response record, or with ``refers_to`` a revisit that leaves the payload out but keeps its HTTP headers."""
    uri = "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url or "")
    kind = "response" if refers_to is None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if uri:
        headers.append(("WARC-Target-URI", uri))
    headers += [("WARC-Payload-Digest", "sha1:" + digest), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    return member(headers, block + (payload if refers_to is None else b""))


def members(stream) -> Iterator[bytes]:
    """Each gzip member of a stream decompressed, chunk by chunk; a truncated or damaged one raises WarcError."""
    rest = b""
    while True:
        rest = rest or stream.read(CHUNK)
        if not rest:
            return
        unpacker, out = zlib.decompressobj(31), io.BytesIO()
        while not unpacker.eof:
            if not rest:
                raise WarcError("the archive ends inside a record")
            try:
                out.write(unpacker.decompress(rest))
            except zlib.error as e:
                raise WarcError(f"a record can't be decompressed: {e}") from e
            rest = unpacker.unused_data if unpacker.eof else stream.read(CHUNK)
        yield out.getvalue()


def records(stream, verify: bool = True) -> Iterator[Record]:
    """The records of an archive, framed by content-length; with ``verify`` their digests are checked."""
    for data in members(stream):
        head, found, rest = data.partition(END)
        if not found or not head.startswith(b"WARC/"):
            raise WarcError("a record has no WARC header")
        headers = _fields(head)
        length = int(headers.get("content-length", "-1"))
        if length < 0 or len(rest) != length + len(END) or rest[length:] != END:
            raise WarcError("a record's length isn't its content-length")
        record = Record(headers, rest[:length])
        if verify:
            checked = [("warc-block-digest", record.block)]
            if record.kind == "response":
                checked.append(("warc-payload-digest", record.http()[1]))
            for name, body in checked:
                given = headers.get(name, "")
                if given.startswith("sha1:") and given[5:] != sha1_name(body):
                    raise WarcError(f"{name} doesn't fit")
        yield record


def _open(uri: str, how: str):
    """A file of the shared folder, on whatever store it is."""
    if (path := local_path(uri)) is not None:
        return open(path, how)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_stream(path) if "r" in how else store.open_output_stream(path)


def _finish(temporary: str, final: str) -> None:
    if (path := local_path(temporary)) is not None:
        os.replace(path, local_path(final))
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(temporary)
    store.move(path, fs.FileSystem.from_uri(final)[1])


HOT_SHARE = 1000  # a payload of more than one page in so many is hot: there are fewer than that


def with_referrals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the smallest page_id of an equal payload of at least ``min_bytes`` bytes, null for that page itself.

    Only digests and ids are grouped, combined map-side. Hot payloads (an error
    page, say), fewer than HOT_SHARE by their definition, get their page by a
    broadcast join; the other pages join by digest, and the hot ones pass that
    join spread by their own hash, so no task gets a payload's pages alone.
    """
    plain = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.substring(F.unhex(F.sha2(F.col("html").cast("binary"), 256)), 1, 16)
    large = F.octet_length("html") >= min_bytes
    counts = cut(plain.where(large).groupBy(digest.alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "warc-repeated")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.broadcast(counts.where(F.col("n") * HOT_SHARE > total).select(F.col("digest").alias("hot"), F.col("first").alias("hot_first")))
    named = plain.withColumn("digest", digest).join(hot, F.col("digest") == F.col("hot"), "left")
    spread = F.concat(F.lit("hot").cast("binary"), F.unhex(F.hex(F.xxhash64("page_id", "url"))))  # 11 bytes: no digest
    keyed = named.withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(spread))
    joined = keyed.join(counts.select(F.col("digest").alias("key"), "first"), "key", "left")
    first = F.coalesce("hot_first", "first")
    return joined.select("page_id", "url", "html", F.when(large & ~first.eqNullSafe(F.col("page_id")), first).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, per_archive: int = RECORDS) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in ``folder``; returns the manifest (archive, records, bytes), already written.

    Null html is an empty payload. Rows that share the smallest page_id of a
    payload are all responses; rows with a null page_id are responses too where
    no equal payload has an id.
    """
    if (path := local_path(folder)) is not None:
        os.makedirs(path, exist_ok=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, count, size = None, "", 0, 0

        def close():
            out.close()
            _finish(f"{name}.part", name)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["archive", "records", "bytes"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(k) for k in range(4))):
                if out is None:
                    name, count, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open(f"{name}.part", "wb")
                payload = html.as_py().encode("utf-8", "surrogatepass")
                data = page_record(page_id.as_py(), url.as_py(), payload, sha1_name(payload), refers_to.as_py())
                out.write(data)
                count, size = count + 1, size + len(data)
                if count >= per_archive:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return cut(with_referrals(pages, min_bytes).mapInArrow(scan, "archive string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every record of the archives in ``manifest``.

    Every digest is verified. A revisit has no payload; its length is that of
    its HTTP headers' content-length.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def number(uri: str) -> int | None:
        tail = uri.rpartition(":")[2].rstrip(">")
        return int(tail) if tail else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows, held = [], 0
                with _open(archive, "rb") as stream:
                    for record in records(stream):
                        http, payload = record.http()
                        h = record.headers
                        given = h["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((number(h["warc-record-id"]), h.get("warc-target-uri"), record.kind, int(http["content-length"]), given, number(h["warc-refers-to"]) if "warc-refers-to" in h else None, payload if record.kind == "response" else None))
                        held += len(payload)
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    parts = max(1, manifest.count())
    spread = manifest.select("archive").repartition(min(parts, 4096), "archive")
    return spread.mapInArrow(scan, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back, one row per record, without the payloads.

    An empty table gives no rows; other columns are ignored.
    """
    manifest = write_archives(pages, fresh_folder(pages.sparkSession, "warc"), min_bytes)
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, list_transform(range(8), lambda j: CAST('0x' || substr(hex, CAST(5 * j + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x // CAST(pow(2, k) AS BIGINT)) % 32 + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
       CASE WHEN first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM b
"""
