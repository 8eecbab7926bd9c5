"""WARC archives: Write, index first, then read selected records by coalesced byte ranges.

Writing: of pages with equal payloads the one with the least id becomes a response record, the others revisit
it. Each task writes its records as gzip members into archives of its own and returns their names; only the
names of committed tasks are saved, so archives of lost or repeated attempts are never read. Indexing: a scan
of each archive writes offset, length, URL, digest and kind for every record. Reading: the selected index
rows are dealt by archive and stretch of the archive, sorted by offset, and neighbours are read together.

Archives lie in the shared folder, opened by URI (local path, ``hdfs://``, ``s3://``, ``gs://``).

Defined results: a null payload is empty; a null id is written without an id and is never revisited while its
payload has another id; repeated rows of the least id are responses each; line breaks in a URL are
percent-encoded; a null URL is left out. An empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import goes_at_exit, mapped, named, saved, scratch_path, spread_join

#: A task begins a new archive when one has so many bytes.
ARCHIVE_BYTES = 256 << 20
#: Records this near to each other are read together, up to so many bytes at once.
GAP_BYTES, RANGE_BYTES = 64 << 10, 8 << 20
#: Index rows of one stretch of an archive are read by one task.
STRETCH_BYTES = 32 << 20

_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "archive string, offset long, length long, record_type string, record_id string, refers_to_record string, page_id string, url string, digest string"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(payload_digest: str, page_id: Any) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{payload_digest}/{page_id}')}>"


def _line(value: Any) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", str(value))


def record(page_id: Any, url: str | None, payload: bytes, payload_digest: str, refers_to: Any, is_revisit: bool, date: str) -> bytes:
    """One record, not compressed."""
    block = _HTTP if is_revisit else _HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_record_id(payload_digest, page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"Page-Id: {_line(page_id)}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest}")
    if is_revisit:
        head += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(payload_digest, refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload, of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2] if "msgtype=response" in headers.get("content-type", "") else block


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_dedup_bytes: int = 0, date: str = "2026-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Writes one record for each row of ``pages`` below ``folder``, which goes when the application ends; returns the saved
    ``(archive, records)``."""
    page_id, url, text = named([id_col, url_col, payload_col])
    given = pages.select(page_id.alias("page_id"), url.alias("url"), F.coalesce(text, F.lit("")).cast("binary").alias("payload"))
    given = given.withColumn("sha", F.unhex(F.sha1("payload")))
    large = F.octet_length("payload") >= min_dedup_bytes
    firsts = given.where(large).groupBy("sha").agg(F.min("page_id").alias("first"))
    # pages with one payload may be any share of all rows: they are dealt to several tasks by their ids
    planned = spread_join(given, firsts, "sha", "page_id", "left").select("page_id", "url", "payload", "sha", "first", (large & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_folder(folder)
        store.create_dir(top, recursive=True)
        names, counts, out, size = [], [], None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    names.append(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                    counts.append(0)
                    out, size = store.open_output_stream(f"{top}/{names[-1].rpartition('/')[2]}", compression=None), 0
                made = record(row["page_id"], row["url"], row["payload"], base64.b32encode(row["sha"]).decode(), row["first"], row["revisit"], date)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(made) + packer.flush()
                out.write(member)
                size += len(member)
                counts[-1] += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["archive", "records"])

    out = saved(mapped(planned, write, "archive string, records long"), "archives")
    goes_at_exit(pages.sparkSession, folder)
    return out


def _members(source: Any, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """``(offset, length, content)`` of each gzip member, reading on in chunks."""
    offset, length, parts = 0, 0, []
    unpacker = zlib.decompressobj(31)
    data = source.read(chunk)
    while data:
        parts.append(unpacker.decompress(data))
        left = unpacker.unused_data
        length += len(data) - len(left)
        if unpacker.eof:
            yield offset, length, b"".join(parts)
            offset, length, parts = offset + length, 0, []
            unpacker = zlib.decompressobj(31)
        data = left or source.read(chunk)


def index(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """A row for every record of ``archives(archive)``, saved as the index."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in INDEX.split(", ")])
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, path = open_folder(archive)
                rows: list[dict[str, Any]] = []
                with store.open_input_stream(path, buffer_size=1 << 20, compression=None) as source:
                    for offset, length, content in _members(source):
                        h, _ = parse(content)
                        rows.append({
                            "archive": archive, "offset": offset, "length": length, "record_type": h["warc-type"], "record_id": h["warc-record-id"], "refers_to_record": h.get("warc-refers-to"),
                            "page_id": h.get("page-id"), "url": h.get("warc-target-uri"), "digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                        })
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, kinds)

    files = archives.select("archive")
    spread = files.repartition(max(1, min(files.count(), 100_000)), "archive")
    return saved(mapped(spread, scan, INDEX), "warc-index")


def read(selected: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the ``selected`` index rows: the index columns, ``payload`` (if asked for), its bytes and digest."""
    names = [c.split()[0] for c in INDEX.split(", ")]
    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    dealt = selected.select(*names).repartition("archive", stretch).sortWithinPartitions("archive", "offset")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, source = None, None
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):  # one range: rows at .. to - 1
                first, to = rows[at], at + 1
                end = first["offset"] + first["length"]
                while to < len(rows) and rows[to]["archive"] == first["archive"] and rows[to]["offset"] <= end + GAP_BYTES and rows[to]["offset"] + rows[to]["length"] <= first["offset"] + RANGE_BYTES:
                    end = max(end, rows[to]["offset"] + rows[to]["length"])
                    to += 1
                if first["archive"] != now:
                    if source is not None:
                        source.close()
                    store, path = open_folder(first["archive"])
                    now, source = first["archive"], store.open_input_file(path)
                source.seek(first["offset"])
                data = source.read(end - first["offset"])
                found = []
                for row in rows[at:to]:
                    start = row["offset"] - first["offset"]
                    headers, payload = parse(zlib.decompress(data[start : start + row["length"]], 31))
                    if headers["warc-record-id"] != row["record_id"]:
                        raise ValueError(f"the index of {now} doesn't fit at {row['offset']}")
                    found.append(payload)
                part = batch.slice(at, to - at)
                more = [pa.array(found, pa.binary())] if payloads else []
                more += [pa.array(list(map(len, found)), pa.int64()), pa.array(list(map(digest, found)), pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*names, *["payload"] * payloads, "bytes", "read_digest"])
                at = to
        if source is not None:
            source.close()

    return mapped(dealt, fetch, INDEX + ", payload binary" * payloads + ", bytes long, read_digest string")


def resolved(records: DataFrame) -> DataFrame:
    """Each of the records that ``read`` gave, with ``payload_bytes``, ``payload_digest`` and ``refers_to`` (a page id): a
    revisit takes them from the response it refers to. Responses pass by the join."""
    known = saved(records.drop("payload"), "records")
    own = known.where("record_type = 'response'")
    answers = own.groupBy(F.col("record_id").alias("refers_to_record")).agg(F.max("bytes").alias("payload_bytes"), F.max("read_digest").alias("payload_digest"), F.max("page_id").alias("refers_to"))
    again = spread_join(known.where("record_type <> 'response'"), answers, "refers_to_record", "record_id", "left")
    return own.select("*", F.col("bytes").alias("payload_bytes"), F.col("read_digest").alias("payload_digest"), F.lit(None).cast("string").alias("refers_to")).unionByName(again)


def archive_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")
