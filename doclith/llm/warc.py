"""WARC archives with an index: every record's file, offset, length, URL and digest are known before anything is read.

Writers stream their partition into files of gzip members, one a record, and return the index. A file that no index row
names, left by a lost or repeated task, is never read. Readers get index rows sorted by file and offset and fetch
neighbouring records with one range read. Records go through :mod:`pyarrow.fs`, so the folder can be any store it opens.

Of records with equal payloads, of ``min_bytes`` at least, the one with the smallest id is a response and the others
are revisits of it, without payload. Equality is that of SHA-1.

Defined cases: a null payload is empty; a null id never is the smallest, and its record is a response; rows with equal
id and payload both are what the id is; further columns are not archived; an empty table gives no file and no rows.
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

from doclith.llm.shared import keep, new_path

FILE_BYTES = 1 << 30  # a writer starts another file beyond
READ_BYTES = 8 << 20  # one range read at most, unless a record is longer
GAP_BYTES = 64 << 10  # ranges so near are read as one
LEVEL = 4
INDEX = "file string, offset long, length long, id long, url string, digest string, record_type string, refers_to long"
RECORD = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
PAGE_ID = "urn:page:"


def base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed: a response, or a revisit if refers_to is given."""
    name = f"{PAGE_ID}{page}" if page is not None else uuid.uuid4().urn
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').replace(chr(13), ' ').replace(chr(10), ' ')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PAGE_ID}{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _writer(folder: str):
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page, url, payload, sha1, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                page, refers_to, digest = page.as_py(), refers_to.as_py(), base32(sha1.as_py())
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                packed = packer.compress(record(page, url.as_py(), payload.as_py(), digest, refers_to)) + packer.flush()
                out.write(packed)
                rows.append((name, at, len(packed), page, url.as_py(), digest, "response" if refers_to is None else "revisit", refers_to))
                at += len(packed)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if out is not None:
            out.close()

    return write


def write(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Archives all rows into the folder, which every machine can reach; returns the index, kept as Parquet beside it.

    The first pass takes digests alone, and only those that occur twice are joined to the payloads: Spark broadcasts
    that table if its file is small, and else shuffles.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.select(F.col(key).cast("long").alias("_id"), F.col(url).cast("string").alias("_url"), body.alias("_body"), F.sha1(body).alias("_sha1"))
    twice = rows.where(F.octet_length("_body") >= min_bytes).groupBy("_sha1").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_sha1", "_first")
    twice = keep(twice, "warc-twice")
    refers = F.when((F.octet_length("_body") >= min_bytes) & (F.col("_first") < F.col("_id")), F.col("_first"))
    joined = rows.join(twice, "_sha1", "left").select("_id", "_url", "_body", "_sha1", refers.alias("_refers"))
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    return keep(joined.mapInArrow(_writer(folder), INDEX), "warc-index")


def _reader(folder: str, payloads: bool):
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Records that one read fetches: of one file, near each other, not too many bytes."""
        block: list[tuple] = []
        for batch in batches:
            for name, offset, length, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block and (name != block[0][0] or offset > block[-1][1] + block[-1][2] + GAP_BYTES or offset + length - block[0][1] > READ_BYTES):
                    yield block
                    block = []
                block.append((name, offset, length, page))
        if block:
            yield block

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        opened, file = "", None
        for block in ranges(batches):
            if block[0][0] != opened:
                opened, file = block[0][0], store.open_input_file(f"{root}/{block[0][0]}")
            first, rows = block[0][1], []
            file.seek(first)
            data = file.read(max(o + n for _, o, n, _ in block) - first)
            for name, offset, length, page in block:
                fields, http, payload = parse(zlib.decompress(data[offset - first : offset - first + length], 31))
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                if kind == "response" and base32(hashlib.sha1(payload).hexdigest()) != digest:
                    raise ValueError(f"{name} at {offset}: the payload does not have its digest")
                refers = fields.get("WARC-Refers-To")
                rows.append((page, fields["WARC-Target-URI"], int(http["Content-Length"]), digest, kind, refers and int(refers.strip("<>").removeprefix(PAGE_ID)), payload if payloads and kind == "response" else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return read


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the index rows name (filter them first): RECORD's columns. Revisits have no payload."""
    wanted = index.select("file", "offset", "length", "id").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(_reader(folder, payloads), RECORD)


def round_trip(df: DataFrame, key: str = "page_id", min_bytes: int = 0) -> DataFrame:
    """Archives the pages in a new shared folder and reads every record back."""
    folder = new_path(df.sparkSession, "warc")
    back = read(write(df, folder, key, min_bytes=min_bytes), folder, payloads=False)
    return back.select(F.col("id").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle_sql(table: str = "pages") -> str:
    """What :func:`round_trip` returns with ``min_bytes`` 0, in DuckDB's SQL; five bits of the digest are a letter."""
    return f"""
WITH p AS (SELECT page_id, coalesce(strlen(html), 0)::BIGINT AS n, sha1(coalesce(html, '')) AS h FROM {table}),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 1 + (5 * i) // 4, 2))::INT >> (3 - (5 * i) % 4)::INT) & 31)), 1)), '') AS payload_digest,
    CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM q"""
