"""WARC archives with an index that is written first, and coalesced reads of byte ranges through it."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmill.llm.common import saved, work_folder

#: Payloads below this many bytes are always written out.
LEAST_REVISIT = 1000
#: Bytes after which a task begins a new archive, and of which a read is made up at most (unless one record is larger).
ARCHIVE_BYTES, READ_BYTES = 1 << 30, 8 << 20
#: Unwanted bytes between two records that are read rather than skipped.
GAP_BYTES = 64 << 10
#: Bytes of records that a task reads, on average.
TASK_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
INDEX = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "archive string, offset long, length long"
)
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!//)", "file:///", path))


def decide(pages: DataFrame, least: int = LEAST_REVISIT, key: str = "page_id", html: str = "html") -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` per page.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest id is the response; the others
    are revisits, which keep no payload. Payloads with few bytes are responses. Digests are counted with partial
    sums; a digest with a third of all pages is split by adaptive execution, since both sides of the join move.
    """
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(f"`{key}`").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    )
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    groups = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest")
    copied = groups.agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).filter("copies > 1 and last is not null")
    revisit = F.coalesce((F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("last")), F.lit(False))
    revisit = revisit & F.col("last").isNotNull()
    return rows.join(copied, "payload_digest", "left").select(
        "page_id",
        "url",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("last")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _name(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _record(row: dict) -> bytes:
    """One record, compressed on its own. A revisit holds the HTTP header alone, with the length of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    block = http.encode() + (row["payload"] or b"")
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_name(row['page_id'])}", f"WARC-Date: {DATE}"]
    if row["url"] is not None:
        uri = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", row["url"])
        head.append(f"WARC-Target-URI: {uri}")
    if row["record_type"] == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_name(row['refers_to'])}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    head.append(f"Content-Length: {len(block)}")
    data = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(data, 1, mtime=0)


def _parse(data: bytes) -> dict:
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    told = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(told["Content-Length"])):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload of its digest")

    def page(name: str | None) -> int | None:
        number = (name or "none").removeprefix("<urn:page:").removesuffix(">")
        return None if number == "none" else int(number)

    return {
        "page_id": page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": int(told["Content-Length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": page(fields.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
    }


def _as_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Write a record per page and return the index: a row per record with its archive, offset, length, URL and digest.

    Each task writes archives of its own in ``folder`` (shared by all executors; any store that Arrow opens), under a
    name that no other attempt has, and reports where its records are. Only the reports of attempts that succeed
    become index rows, so archives of a lost attempt are never read.

    Null payloads are empty; null URLs leave the header out, and characters that a header cannot hold are
    percent-encoded. Pages with a null id are written under the name ``none`` and are never what a revisit refers to.
    Repeated rows with the largest id are responses each. An empty table writes nothing. Other columns are ignored.
    """
    folder = folder or work_folder(pages.sparkSession)
    schema = _arrow(INDEX)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out, path, offset = None, "", 0
        for batch in stream:
            index = []
            for number in range(batch.num_rows):
                row = batch.slice(number, 1).to_pylist()[0]
                if out is None or offset >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, path, offset = store.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}", 0
                data = _record(row)
                out.write(data)
                del row["payload"]
                index.append(row | {"archive": path, "offset": offset, "length": len(data)})
                offset += len(data)
            yield _as_batch(index, schema)
        if out is not None:
            out.close()

    return saved(decide(pages, least).mapInArrow(batches, INDEX))


def read_records(selected: DataFrame) -> DataFrame:
    """The records of index rows: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload``.

    Stretches of ``READ_BYTES`` of an archive are dealt to as many tasks as the records' bytes ask for, whatever the size
    of the index, and sorted there; a task joins neighbouring ranges, with the small gaps between them, to one read of
    at most ``READ_BYTES``. The payload of a response is checked against its digest.
    """
    schema = _arrow(RECORDS)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, pa.NativeFile] | None = None

        def read(archive: str, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
            nonlocal opened
            if opened is None or opened[0] != archive:
                if opened:
                    opened[1].close()
                store, path = _store(archive)
                opened = archive, store.open_input_file(path)
            first, last = ranges[0][0], max(end for _, end in ranges)
            data = opened[1].read_at(last - first, first)
            return _as_batch([_parse(data[a - first : b - first]) for a, b in ranges], schema)

        archive, ranges = None, []
        for batch in stream:
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                far = ranges and (offset - ranges[-1][1] > GAP_BYTES or offset + length - ranges[0][0] > READ_BYTES)
                if ranges and (name != archive or far):
                    yield read(archive, ranges)
                    ranges = []
                archive = name
                ranges.append((offset, offset + length))
        if ranges:
            yield read(archive, ranges)
        if opened:
            opened[1].close()

    places = selected.select("archive", "offset", "length")
    size = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(selected.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    dealt = places.repartition(tasks, "archive", F.floor(F.col("offset") / READ_BYTES))
    ordered = dealt.sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(batches, RECORDS)
