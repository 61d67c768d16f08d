"""WARC archives: written by tasks with an index of every record, read back by coalesced byte ranges.

Each task writes archives of its own below one folder of the shared storage, a compressed member per record, and returns
a row per record with file, offset, length, URL and digest. The index a job commits names only files of tasks that
ended well; what a lost executor left behind is never named. Readers sort the selected rows by place, join neighbouring
ranges into one read, and cut the records out of it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import materialize, release, scratch_path

from . import tokens as T
from .sides import narrow

#: Bytes after which a task begins a new file; bytes of one read; the widest gap between ranges read together.
FILE_BYTES = 256 << 20
READ_BYTES = 4 << 20
GAP_BYTES = 64 << 10
_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()),
                    ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_INDEX_SQL = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("payload", pa.binary())])
_RECORD_SQL = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One uncompressed record; a revisit holds the response's header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{'' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _number(uri: str) -> int | None:
    digits = uri.strip("<>").removeprefix(_ID)
    return int(digits) if digits else None


def _writer(root: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(root)
        files.create_dir(base, recursive=True)
        name, out, offset = "", None, 0
        try:
            for batch in (piece for whole in batches for piece in T.slices(whole, "html", 16 << 20)):
                rows = []
                for r in batch.to_pylist():
                    if out is None or offset >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    payload = (r["html"] or "").encode("utf-8")
                    revisit, digest = r["record_type"] == "revisit", base64.b32encode(bytes.fromhex(r["sha"])).decode()
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = pack.compress(record(r["page_id"], r["url"], payload, digest, r["refers_to"], revisit, date)) + pack.flush()
                    out.write(data)
                    rows.append({"file": name, "offset": offset, "length": len(data), "url": r["url"], "digest": digest,
                                 "page_id": r["page_id"], "record_type": r["record_type"], "refers_to": r["refers_to"]})
                    offset += len(data)
                yield pa.RecordBatch.from_pylist(rows, _INDEX)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, root: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """Write a record for each row of ``pages`` (``page_id``, ``url``, ``html``) below ``root``; the index, settled.

    The payload is ``html`` in UTF-8, empty for null. Of records with equal payloads of ``least_bytes`` or more, those
    with the smallest ``page_id`` are responses (repeated rows all), others revisit it; a null id is never the smallest
    beside another. Smaller payloads are all responses. An empty table gives an empty index and no file.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    copies = rows.select("page_id", "sha", F.octet_length("html").alias("size")).filter(f"size >= {least_bytes}")
    copies = copies.groupBy(F.col("sha").alias("copied")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    marked = rows.join(narrow(materialize(copies.drop("n"))), F.col("sha") == F.col("copied"), "left")
    again = F.col("copied").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    marked = marked.select("page_id", "url", "html", "sha", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))
    return materialize(marked.mapInArrow(_writer(root, date), _INDEX_SQL))


def _reader(root: str, keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(root)

        def flush(name: str, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
            start, end = ranges[0][0], max(a + n for a, n in ranges)
            with files.open_input_file(f"{base}/{name}") as source:
                data = source.read_at(end - start, start)
            rows = []
            for a, n in ranges:
                headers, payload = parse(zlib.decompress(data[a - start: a - start + n], 31))
                revisit = headers["warc-type"] == "revisit"
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if not revisit and _digest(payload) != digest:
                    raise ValueError(f"damaged record in {name} at {a}")
                url = headers.get("warc-target-uri")
                rows.append({
                    "page_id": _number(headers["warc-record-id"]), "record_type": headers["warc-type"], "payload_digest": digest,
                    "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
                    "refers_to": _number(headers["warc-refers-to"]) if revisit else None,
                    "payload_bytes": None if revisit else len(payload), "payload": payload if keep_payload and not revisit else None})
            return pa.RecordBatch.from_pylist(rows, _RECORD)

        name, ranges = None, []
        for batch in batches:
            for f, a, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if ranges and (f != name or a - (ranges[-1][0] + ranges[-1][1]) > GAP_BYTES or a + n - ranges[0][0] > READ_BYTES):
                    yield flush(name, ranges)
                    ranges = []
                name = f
                ranges.append((a, n))
        if ranges:
            yield flush(name, ranges)

    return run


def read_records(index: DataFrame, root: str, keep_payload: bool = True) -> DataFrame:
    """The records that rows of an index name, each payload checked against its digest; a revisit has no payload.

    Any selection of rows will do; rows named twice are read twice.
    """
    places = index.select("file", "offset", "length", F.floor(F.col("offset") / (READ_BYTES // 4)).alias("part"))
    return places.repartition("file", "part").sortWithinPartitions("file", "offset").drop("part").mapInArrow(_reader(root, keep_payload), _RECORD_SQL)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` (settled) with ``payload_bytes`` of revisits taken from the response they refer to."""
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes")
    wanted = materialize(revisits.select(F.col("refers_to").alias("page_id"), "payload_digest").distinct())
    # the key columns hold nulls only where no row with that payload has an id
    of = records.filter("record_type = 'response'").join(narrow(wanted), ["page_id", "payload_digest"], "left_semi")
    of = materialize(of.select(F.col("page_id").alias("of_id"), F.col("payload_digest").alias("of_digest"), "payload_bytes").distinct())
    same = F.col("refers_to").eqNullSafe(F.col("of_id")) & (F.col("payload_digest") == F.col("of_digest"))
    return records.filter("record_type = 'response'").unionByName(revisits.join(narrow(of), same, "left").drop("of_id", "of_digest"))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Every page written to archives in the shared folder, read back by its index, and the archives removed."""
    root = scratch_path(pages.sparkSession, "archives")
    index = write_archives(pages, root)
    records = materialize(read_records(index, root, keep_payload=False))
    release(pages.sparkSession, root)
    return resolve_revisits(records)
