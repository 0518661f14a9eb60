"""Legacy ARC archives to WARC, and back to rows.

An ARC archive opens with a version block that declares its record header line; each record
is that line, then as many bytes as its last field declares. Version 1 lines have five
fields, version 2 lines ten. The converter reads either, and writes for each record a WARC
record with the equivalent identifier, timestamp, type and payload digest.

Of records with equal payloads of LEAST_REVISIT bytes or more, that with the smallest
page_id is a response and the others are revisits: they keep the HTTP head, the digest and
a reference, not the payload. Smallest ids are found by a grouped minimum over digests;
pages then move once, to meet their digest's row, in a join that adaptive execution splits
where one payload is very common. Shorter pages meet nothing and are spread by their ids.

Archives are gzip files of about FILE_BYTES of records each, or one longer record, by Spark's own
writer, under the shared checkpoint folder unless a path is given; the folder is the caller's to
delete. A file is read back as a stream: besides its compressed bytes one record is held at a time.

Record identifiers are version-8 UUIDs that hold the page_id, so references can be read back.

Defined cases: null html is an empty payload, a null url is `unknown:`; a null page_id has an
identifier of its own and never is the smallest; rows that share page_id and payload share an
identifier and are all responses; line breaks and blanks in urls are percent-encoded; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, map_arrow, shared_folder

LEAST_REVISIT = 100
FILE_BYTES = 32 << 20
_EPOCH = datetime(2001, 1, 1)
_SPACE = 0x7E55E4A10000  # the first 48 bits of every identifier
# The header fields that ARC version blocks declare.
V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    bits = 0 if page_id is None else page_id & (2**64 - 1)
    b = (bits >> 62) | (0x800 if page_id is None else 0)
    return f"<urn:uuid:{uuid.UUID(int=_SPACE << 80 | 8 << 76 | b << 64 | 2 << 62 | bits & (2**62 - 1))}>"


def page_of(identifier: str) -> int | None:
    n = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    b = n >> 64 & 0xFFF
    bits = (b & 3) << 62 | n & (2**62 - 1)
    return None if b & 0x800 else bits - (1 << 64) if bits >> 63 else bits


def http_block(page_id: int | None, payload: bytes) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def write_arc(rows: list[tuple[int | None, str, bytes]], version: int) -> bytes:
    """An ARC archive of (page_id, url, payload) rows."""
    fields = V1_FIELDS if version == 1 else V2_FIELDS
    declared = f"{version} 0 tessera\n{fields}\n\n".encode()
    tail = "" if version == 1 else " 200 - - 0 pages.arc"
    out = [f"filedesc://pages.arc 0.0.0.0 {_EPOCH:%Y%m%d%H%M%S} text/plain{tail} {len(declared)}\n".encode(), declared]
    offset = sum(map(len, out))
    for page_id, url, payload in rows:
        block = http_block(page_id, payload)
        date = _EPOCH + timedelta(seconds=(page_id or 0) % 10**9)
        target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "unknown:"
        line = f"{target} 0.0.0.0 {date:%Y%m%d%H%M%S} text/html"
        if version == 2:
            line += f" 200 {hashlib.md5(payload).hexdigest()} - {offset} pages.arc"
        record = f"{line} {len(block)}\n".encode("utf-8", "surrogatepass") + block + b"\n"
        out.append(record)
        offset += len(record)
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, by the version block's declaration and the declared lengths."""
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "surrogatepass").rstrip("\r").split(" ")
        size = int(line[-1])
        block = data[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError("an ARC record is shorter than it declares")
        at = end + 1 + size
        if names is None:
            head = block.decode("utf-8").split("\n")
            if not line[0].startswith("filedesc:") or head[0].split(" ")[0] not in ("1", "2"):
                raise ValueError("not an ARC archive of version 1 or 2")
            names = head[1].split(" ")
            continue
        if len(line) != len(names):
            raise ValueError(f"an ARC header line has {len(line)} fields, not {len(names)}")
        yield dict(zip(names, line)), block


def to_warc(fields: dict[str, str], block: bytes, refers_to: int | None = None) -> bytes:
    """The WARC record equivalent to an ARC record; a revisit if refers_to is given."""
    head, sep, payload = block.partition(b"\r\n\r\n")
    own = re.search(rb"\r\nX-Page-Id: (-?\d+)", head)
    digest = hashlib.sha256(payload).hexdigest()
    date = datetime.strptime(fields["Archive-date"], "%Y%m%d%H%M%S")
    kind, body = ("response", block) if refers_to is None else ("revisit", head + sep)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(int(own[1]) if own else None)}",
        f"WARC-Date: {date:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {fields['URL']}",
        f"WARC-IP-Address: {fields['IP-address']}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode("utf-8", "surrogatepass") + body


def parse_warc(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC file, one record at a time."""
    while first := file.readline():
        if not first.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        headers = {}
        while line := file.readline().rstrip(b"\r\n"):
            name, value = line.decode("utf-8", "surrogatepass").split(": ", 1)
            headers[name] = value
        size = int(headers["Content-Length"])
        block = file.read(size)
        if len(block) < size or file.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record does not end where it declares")
        yield headers, block


def record_types(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for a response, else the response's page_id."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("unknown:")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("_digest", F.when(F.octet_length("html") >= LEAST_REVISIT, F.sha2("html", 256)))
    repeated = rows.where("_digest is not null").groupBy("_digest").agg(F.min("page_id").alias("_least"), F.count("*").alias("_n")).where("_n > 1").select("_digest", "_least")
    spread = F.coalesce("_digest", F.concat(F.lit("short "), F.xxhash64("page_id", "url", "html").cast("string")))
    return rows.withColumn("_digest", spread).join(repeated, "_digest", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_least")), F.col("_least")).alias("refers_to"))


def write(pages: DataFrame, path: str | None = None) -> str:
    """Write one WARC record for each page, through ARC archives of both versions; returns the folder."""
    path = path or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches):
        held: list[bytes] = []  # records of the next file
        size = 0

        def file():
            return pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held)], pa.binary()).cast(pa.string())], ["value"])

        for b in batches:
            for part in chunks([b], "html", FILE_BYTES // 4):
                rows = list(zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("html").cast(pa.large_binary()).to_pylist(), part.column("refers_to").to_pylist()))
                out = []
                for version in (1, 2):
                    own = [r for r in rows if (r[0] or 0) % 2 + 1 == version]
                    arc = write_arc([r[:3] for r in own], version)
                    out += [to_warc(fields, block, r[3]) for (fields, block), r in zip(parse_arc(arc), own, strict=True)]
                for record in out:
                    if held and size + len(record) > FILE_BYTES:
                        yield file()
                        held.clear()
                        size = 0
                    held.append(record)
                    size += len(record)
        if held:
            yield file()

    records = map_arrow(record_types(pages), run, "value string")
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    return path


def read(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri) of every record of the archives in a folder."""

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                out = []
                for h, block in parse_warc(gzip.GzipFile(fileobj=io.BytesIO(b.column("content")[i].as_py()))):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind, refers = h["WARC-Type"], h.get("WARC-Refers-To")
                    declared = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response":
                        size = len(payload)
                        if hashlib.sha256(payload).hexdigest() != declared:
                            raise ValueError("a payload differs from its digest")
                    else:
                        size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                    out.append((page_of(h["WARC-Record-ID"]), size, declared, kind, page_of(refers) if refers else None, h["WARC-Target-URI"]))
                columns = [list(c) for c in zip(*out)] or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
    return map_arrow(spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content"), run, schema)
