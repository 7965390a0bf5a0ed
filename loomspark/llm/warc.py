"""WARC archives: a writer, and a sequential reader (one gzip member per record, incremental zlib, framing by
Content-Length, digests verified).

Nulls: a null payload is empty, a null url is written as an empty target. Rows with a null id are written as
responses with a numbered record id and read back with a null id. Repeated rows: every row that carries the
largest id of its payload is a response. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir
from .files import open_reader, open_writer

REVISIT_FROM = 1000  # bytes of payload from which equal payloads become revisits
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record that breaks the format or whose digest does not match."""


def sha1_base32(data: bytes) -> str:
    """The digest as WARC headers carry it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(record_id: str, url: str, payload: bytes, refers_to: str | None = None, whole: bytes | None = None) -> bytes:
    """One uncompressed WARC/1.1 record. A revisit (refers_to given) holds the HTTP head of ``whole`` and no payload."""
    body = payload if refers_to is None else b""
    full = payload if whole is None else whole
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(full)
    block = head + body
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: {sha1_base32(block)}",
        f"WARC-Payload-Digest: {sha1_base32(full)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + CRLF + CRLF + block + CRLF + CRLF


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def gzip_members(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """Each gzip member of a stream, decompressed incrementally; memory holds one record and one chunk."""
    z, parts, pending = None, [], b""
    while True:
        data = pending or stream.read(chunk)
        pending = b""
        if not data:
            if z is not None:
                raise WarcError("the archive ends inside a gzip member")
            return
        if z is None:
            z, parts = zlib.decompressobj(31), []
        try:
            parts.append(z.decompress(data))
        except zlib.error as e:
            raise WarcError(f"bad gzip data: {e}") from e
        if z.eof:
            pending = z.unused_data
            z = None
            yield b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one record, framed by its Content-Length; both digests are verified."""
    end = raw.find(CRLF + CRLF)
    if end < 0 or not raw.startswith(b"WARC/1."):
        raise WarcError("no WARC head")
    head: dict[str, str] = {}
    for line in raw[:end].split(CRLF)[1:]:
        k, _, v = line.partition(b":")
        head[k.decode().strip().lower()] = v.decode("utf-8", "replace").strip()
    try:
        size = int(head["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no Content-Length") from e
    block = raw[end + 4 : end + 4 + size]
    if len(block) != size or raw[end + 4 + size :] != CRLF + CRLF:
        raise WarcError("the record's length is not its Content-Length")
    if "warc-block-digest" in head and head["warc-block-digest"] != sha1_base32(block):
        raise WarcError("block digest mismatch")
    http, _, payload = block.partition(CRLF + CRLF)
    length = next((int(x.split(b":")[1]) for x in http.split(CRLF) if x.lower().startswith(b"content-length:")), len(payload))
    kind = head.get("warc-type", "")
    if kind == "response" and (length != len(payload) or head.get("warc-payload-digest") != sha1_base32(payload)):
        raise WarcError("payload digest mismatch")
    return {"head": head, "type": kind, "payload": payload, "length": length}


def read_warc(stream) -> Iterator[dict]:
    """Records of an archive, in order."""
    for raw in gzip_members(stream):
        yield parse_record(raw)


def _urn(page_id: int | None) -> str:
    return f"urn:page:{page_id}" if page_id is not None else f"urn:row:{uuid.uuid4()}"


def _page(urn: str) -> int | None:
    urn = urn.strip("<>")
    return int(urn[9:]) if urn.startswith("urn:page:") else None


MANIFEST = "path string, n_records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = REVISIT_FROM) -> DataFrame:
    """Write one archive per partition under ``folder``; rows (path, n_records) of the archives that tasks committed.

    Digests and sizes are computed in the JVM. Which payloads repeat comes from a pre-aggregated count by digest,
    joined back with only the repeated digests, so a payload shared by a third of all pages is split by the
    adaptive skew join and never gathered in one task.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    repeated = base.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "keep")
    # smaller pages never match, so they get a key of their own in place of the digest that many may share
    own = F.unhex(F.md5(F.concat_ws(":", F.lit("own"), F.col("page_id").cast("string"), F.col("url"))))
    base = base.withColumn("digest", F.when(F.octet_length("html") >= min_bytes, F.col("digest")).otherwise(own))
    rows = base.join(repeated, "digest", "left").select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("keep") == F.col("page_id")), F.lit(None)).otherwise(F.col("keep")).alias("refers_to"))

    def write(batches):
        path, out, n = f"{folder}/part-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            for page_id, url, html, refers in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    out = open_writer(path)
                payload = html.encode()
                out.write(gzip_member(build_record(_urn(page_id), url, payload, None if refers is None else _urn(refers), payload)))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64())})

    return rows.mapInArrow(write, MANIFEST)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of the archives of a manifest: page_id, payload_bytes, payload_digest (hex), record_type, refers_to."""

    def read(batches):
        for b in batches:
            for path, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                seen = 0
                with open_reader(path) as f:
                    for r in read_warc(f):
                        head = r["head"]
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        refers = head.get("warc-refers-to")
                        rows.append((_page(head["warc-record-id"]), r["length"], digest, r["type"], None if refers is None else _page(refers)))
                        if len(rows) >= 5000:
                            seen += len(rows)
                            yield _records(rows)
                            rows = []
                seen += len(rows)
                if seen != want:
                    raise WarcError(f"{path} holds {seen} records, not {want}")
                if rows:
                    yield _records(rows)

    n = max(1, manifest.count())
    return manifest.select("path", "n_records").repartition(min(n, 100_000)).mapInArrow(read, RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d, e = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c), pa.array(d), pa.array(e, pa.int64())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def round_trip(pages: DataFrame, min_bytes: int = REVISIT_FROM) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    manifest = materialize(write_archives(pages, shared_dir(pages.sparkSession, "warc"), min_bytes), "warc-manifest")
    return read_archives(manifest)
