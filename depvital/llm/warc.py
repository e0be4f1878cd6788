"""WARC archives with an index: write records, note where each lies, read selected records by byte ranges.

A record is a gzip member of its own. The task that writes records gives an index row for each: file, offset, length,
address, digest. The index is a Spark table in the archive's folder and names only files of tasks that ended well, so a
file of a lost or repeated attempt is never read. Readers sort the selected index rows, join neighbouring ranges into one
read, and cut the records out of what they have read. The folder is one that all executors share.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depvital.llm.byte_bpe import small_batches
from depvital.llm.common import keep_table, lookup, named

#: Payloads from this size on may be stored once; bytes in an archive file; in one read; between records of one read.
REVISIT_BYTES = 1000
FILE_BYTES = 256 << 20
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string, record_id string"


def record_id(page_id: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest.hex()}')}>"


def _header(value: str) -> str:
    """A header's value on one line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One compressed record; a revisit (refers_to is a page) has the headers without the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
    ]
    lines += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    lines += [] if url is None else [f"WARC-Target-URI: {_header(url)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(stored: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one compressed record."""
    raw = zlib.decompress(stored, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def plan_records(pages: DataFrame, revisit_bytes: int, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is the largest page_id with an equal payload, null for that one."""
    payload = F.coalesce(named(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(named(id_col).cast("long").alias("page_id"), named(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload"), "digest": F.sha2("payload", 256)})
    groups = rows.where(F.col("size") >= revisit_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    groups = keep_table(groups.where("n > 1").select("digest", "size", "refers_to"), "equal-payloads")
    other = F.when(F.col("refers_to").eqNullSafe(F.col("page_id")), F.lit(None)).otherwise(F.col("refers_to"))
    return lookup(rows, groups, ["digest", "size"]).select("page_id", "url", "payload", other.alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """Write one record per row below the folder (a URI that pyarrow.fs opens) and return the index, which is kept there.

    A null payload counts as empty, a null url gives no target header. Of equal payloads of at least `revisit_bytes`
    bytes the one with the largest identifier is a response, the others revisit it; rows that repeat that identifier are
    responses too, and a group with null identifiers only has nothing to revisit. Other columns are not read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, offset = None, "", 0
        for whole in batches:
            for batch in small_batches(whole, 2):
                rows = []
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or offset >= FILE_BYTES:
                        if out:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(posixpath.join(root, name), compression=None)  # records are compressed already
                    digest = hashlib.sha1(payload).digest()
                    record = make_record(page_id, url, payload, digest, refers_to)
                    out.write(record)
                    kind = "response" if refers_to is None else "revisit"
                    rows.append((page_id, url, name, offset, len(record), digest.hex(), kind, record_id(page_id, digest)))
                    offset += len(record)
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
                names = ["page_id", "url", "file", "offset", "length", "payload_digest", "record_type", "record_id"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if out:
            out.close()

    index = plan_records(pages, revisit_bytes, id_col, url_col, payload_col).mapInArrow(write, INDEX)
    path = f"{folder}/index"
    index.write.parquet(path)
    return pages.sparkSession.read.schema(index.schema).parquet(path)


def read_ranges(index: DataFrame) -> DataFrame:
    """(file, start, stop, records): reads that cover the index rows, neighbours joined; records: (offset, length)."""
    order = Window.partitionBy("file").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(order)
    apart = F.col("offset") - before > GAP_BYTES
    crosses = F.floor(F.col("offset") / READ_BYTES) != F.floor(F.lag("offset").over(order) / READ_BYTES)
    starts = (before.isNull() | apart | crosses).cast("int")
    slim = index.select("file", "offset", "length").withColumn("starts", starts)
    slim = slim.withColumn("read", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return slim.groupBy("file", "read").agg(
        F.min("offset").alias("start"),
        F.max(F.col("offset") + F.col("length")).alias("stop"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"),
    )


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, record_type, record_id, refers_to, refers_to_id, payload) of the records that the index rows name."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "record_type", "record_id", "refers_to", "refers_to_id", "payload"]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())

        def give(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for name, start, stop, records in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(posixpath.join(root, name)) as file:
                    span = file.read_at(stop - start, start)
                rows, held = [], 0
                for record in records:
                    at = record["offset"] - start
                    headers, payload = parse_record(span[at : at + record["length"]])
                    page, refers = (None if (x := headers.get(h)) is None else int(x) for h in ("x-page-id", "x-refers-to-page-id"))
                    uri = headers.get("warc-target-uri")
                    rows.append((page, uri, headers["warc-type"], headers["warc-record-id"], refers, headers.get("warc-refers-to"), payload))
                    held += len(payload)
                    if held >= READ_BYTES:
                        yield give(rows)
                        rows, held = [], 0
                if rows:
                    yield give(rows)

    schema = "page_id long, url string, record_type string, record_id string, refers_to long, refers_to_id string, payload binary"
    return read_ranges(index).select("file", "start", "stop", "records").mapInArrow(read, schema)


def archive_digests(pages: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as the archives have them: written, then read back.

    A revisit's size and digest are those of the response it refers to, taken from that record's payload.
    """
    records = read_records(write_archives(pages, folder), folder)
    size, digest = F.octet_length("payload").cast("long"), F.sha1("payload")
    found = records.select("page_id", "record_type", "record_id", "refers_to", "refers_to_id", size.alias("size"), digest.alias("digest"))
    found = keep_table(found, "warc-records")
    responses = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("size").alias("full_size"), F.max("digest").alias("full_digest"))
    meant = found.where("refers_to_id is not null").select("refers_to_id").distinct()
    full = lookup(found, responses.join(meant, "refers_to_id"), ["refers_to_id"])
    return full.select(
        "page_id", F.coalesce("full_size", "size").alias("payload_bytes"), F.coalesce("full_digest", "digest").alias("payload_digest"), "record_type", "refers_to"
    )
