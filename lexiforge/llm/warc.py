"""WARC archives with an index that comes first and coalesced range reads.

Writing gives, besides archives of one gzip member per record, an index with offset, length, URL
and digest of each record. Reading selects index rows, sorts them by archive and offset, joins
neighbouring byte ranges into one read, and parses the records in it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import Decisions, Workspace, bounded_batches, filesystem, hot_join, keyed

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archives end behind the record that passes this size.
ARCHIVE = 256 << 20
#: Ranges at most GAP apart are read together, READ bytes at a time at most (a larger record alone).
GAP, READ = 64 << 10, 8 << 20

INDEX = "archive string, offset long, length long, url string, digest string, page_id {id}, record_type string, refers_to {id}"
RECORD = "page_id {id}, url string, record_type string, refers_to {id}, payload_bytes long, payload_digest string, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(text: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, text)}>"


def _id_text(page_id) -> str:
    """A page's id as a header's value; texts are quoted, so that no id can end a line."""
    return quote(page_id, safe="") if isinstance(page_id, str) else str(page_id)


def record(page_id, url: str | None, payload: bytes, digest: str, name: str, first=None, revisit: bool = False) -> bytes:
    """One record; a revisit has the response's HTTP head, with the payload's length, and no payload.

    A response is named by page and digest, of which there is one, and a revisit by ``name``, its place.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    response = _record_id(f"{_id_text(first if revisit else page_id)}/{digest}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(name) if revisit else response}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    if page_id is not None:
        head.append(f"X-Page-Id: {_id_text(page_id)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {response}"]
        if first is not None:
            head.append(f"X-Refers-To-Page: {_id_text(first)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, the payload's length by its HTTP head, and the payload that the record holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    return headers, length, payload


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(folder: str, look):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            decided = look(batch.column("file"), batch.column("row"))
            is_first, first = decided.field("is_first"), decided.field("first")
            cols = [*(batch.column(c) for c in ("page_id", "url", "html")), is_first, first]
            for values in zip(*cols, strict=True):
                page, url, html, is_response, response = (v.as_py() for v in values)
                payload = (html or "").encode()
                digest = digest32(payload)
                if out is None or at > ARCHIVE:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                data = _gzip(record(page, url, payload, digest, f"{name}/{at}", response, not is_response))
                out.write(data)
                for c, v in zip(rows, (name, at, len(data), digest), strict=True):
                    c.append(v)
                at += len(data)
            kind = pa.compute.if_else(is_first, "response", "revisit")
            refers = pa.compute.if_else(is_first, pa.scalar(None, first.type), first)
            made = [pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), batch.column("url"), pa.array(rows[3], pa.string()), batch.column("page_id"), kind, refers]
            yield pa.RecordBatch.from_arrays(made, ["archive", "offset", "length", "url", "digest", "page_id", "record_type", "refers_to"])
        if out is not None:
            out.close()

    return run


def write_archives(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """pages(page_id, url, html, ...) -> archives in folder/archives and their index, a table in folder/index.

    A null html is an empty payload. Of the rows with equal payloads that with the smallest page_id
    (null last) is the response and the others revisit it; of repeated rows of that page one is the
    response, that with the smallest url. Page ids can be of any type that Spark casts to text and back; other columns
    aren't read. A very long page is one record, held whole by the task that writes it. An empty table gives no
    archive and an empty index. Payloads are read twice and never shuffled.
    """
    ws = Workspace(spark, "warc-digests")
    bounded_batches(spark)
    kind = pages.schema["page_id"].dataType.simpleString()
    table, file, row = keyed(ws, pages)
    rows = table.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.col(file).alias("file"), F.col(row).alias("row"))
    slim = ws.table(rows.select(F.unhex(F.sha1(F.encode("html", "UTF-8"))).alias("sha"), "page_id", "url", "file", "row"), "digests")
    own = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url", "file", "row")
    per = ws.table(slim.groupBy("sha").agg(F.min(own).alias("m"), F.count("*").alias("n")), "least")
    found = hot_join(slim.select("sha", "file", "row"), per.select("sha", F.col("m.page_id").alias("first"), F.col("m.file").alias("f"), F.col("m.row").alias("r"), "n"), "sha", "n")
    is_first = (F.col("file") == F.col("f")) & (F.col("row") == F.col("r"))
    decided = Decisions(ws, found.select("file", "row", F.struct("first", is_first.alias("is_first")).alias("of")), "decided")
    index = rows.mapInArrow(_write(f"{folder}/archives", decided.lookup()), INDEX.format(id=kind))
    index.write.mode("overwrite").parquet(f"{folder}/index")
    ws.close()
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def _read(folder: str, verify: bool, keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        name, source = None, None
        for batch in batches:
            types = batch.column("page_id").type
            cols = [batch.column(c).to_pylist() for c in ("archive", "offset", "length", "url")]
            i, n = 0, batch.num_rows
            while i < n:
                archive, lo = cols[0][i], cols[1][i]
                hi, j = lo + cols[2][i], i + 1
                while j < n and cols[0][j] == archive and cols[1][j] <= hi + GAP and cols[1][j] + cols[2][j] - lo <= READ:
                    hi, j = max(hi, cols[1][j] + cols[2][j]), j + 1
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, fs.open_input_file(f"{path}/{archive}")
                source.seek(lo)
                block = source.read(hi - lo)
                out: list[list] = [[], [], [], [], [], [], []]
                for k in range(i, j):
                    a = cols[1][k] - lo
                    headers, length, payload = parse(zlib.decompress(block[a : a + cols[2][k]], 31))
                    revisit = headers["WARC-Type"] == "revisit"
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and (len(payload) != length or verify and digest32(payload) != digest):
                        raise ValueError(f"a payload in {archive} changed")
                    ids = [unquote(v) if (v := headers.get(h)) is not None else None for h in ("X-Page-Id", "X-Refers-To-Page")]
                    row = (ids[0], cols[3][k], headers["WARC-Type"], ids[1], length, digest, payload if keep_payload and not revisit else None)
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                made = [pa.array(out[0], pa.string()).cast(types), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string()).cast(types), pa.array(out[4], pa.int64()), pa.array(out[5], pa.string()), pa.array(out[6], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
                i = j
        if source is not None:
            source.close()

    return run


def read_archives(spark: SparkSession, folder: str, index: DataFrame, verify: bool = True, payload: bool = True) -> DataFrame:
    """The records that rows of the index name, parsed: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    A revisit's payload is null; its length and digest are those of the full payload.
    """
    kind = index.schema["page_id"].dataType.simpleString()
    ranges = index.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return ranges.select("archive", "offset", "length", "url", "page_id").mapInArrow(_read(f"{folder}/archives", verify, payload), RECORD.format(id=kind))


def write_and_read(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    folder = folder or Workspace(spark, "warc").path
    return read_archives(spark, folder, write_archives(spark, pages, folder), payload=False)
