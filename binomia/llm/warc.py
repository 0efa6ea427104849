"""WARC archives on Spark: an index first, then coalesced byte-range reads.

Writing deals pages by payload digest, so copies become ``revisit`` records of the copy
with the smallest id. Each task appends gzip members to an archive of its own in the
shared folder and returns one index row per record (archive, offset, length, URL, digest).
Archive names are unique per task attempt and only committed index rows name them, so a
task that is run again leaves at most an archive that nothing refers to. Reading takes any
subset of the index, deals it by (archive, offset), and joins neighbouring byte ranges to
single reads.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, sliced, stored

#: Ranges at most so far apart are read at once, up to MAX_READ bytes.
MAX_GAP, MAX_READ = 64 << 10, 8 << 20
#: Bytes of archive that one reading task gets, about.
TASK_BYTES = 32 << 20

INDEX = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, archive string, offset long, length long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if uri.startswith("file:/"):
        return pa.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), uri)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record as a gzip member; with ``refers_to`` a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest32(payload)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    whole = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(whole) + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers, HTTP header and payload of one gzip member."""
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, ""
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for b in sliced(batches):
            rows = []
            for i, url, html, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    fs, path = filesystem(name)
                    out = fs.open_output_stream(path, compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass")
                member = record(i, url, payload, refers, date)
                out.write(member)
                rows.append((i, url, "response" if refers is None else "revisit", refers, digest32(payload), len(payload), name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", folder: str | None = None) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return the index.

    Payload: html in UTF-8, null as empty. Of records with equal payloads of at least
    ``min_bytes`` bytes the one with the smallest page_id is a response, the others
    revisit it; all smaller ones are responses. Rows that repeat the smallest id are
    responses each; rows without id revisit, if any equal row has one. Null URLs leave
    the header out. Other columns are ignored; an empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    html = F.coalesce("html", F.lit(""))
    p = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("size"))
    first = p.filter(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = stored(first.filter("n > 1").drop("n"), "warc_copies")  # a join of its own: a hot payload can be split
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))  # null where a payload is unique
    dealt = p.join(first, ["sha1", "size"], "left").select("page_id", "url", "html", refers.alias("refers_to"))
    return stored(dealt.mapInArrow(_write(folder, date), INDEX), "warc_index")


def _ranges(rows: list[tuple[str, int, int, int]]) -> Iterator[list[tuple[str, int, int, int]]]:
    """Runs of sorted (archive, offset, length, ..) rows that one read covers."""
    run: list[tuple[str, int, int, int]] = []
    for r in rows:
        if run and not (r[0] == run[0][0] and r[1] <= run[-1][1] + run[-1][2] + MAX_GAP and r[1] + r[2] - run[0][1] <= MAX_READ):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, pa.NativeFile] | None = None
        for b in batches:
            for part in _ranges(list(zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))):
                if opened is None or opened[0] != part[0][0]:
                    fs, path = filesystem(part[0][0])
                    opened = part[0][0], fs.open_input_file(path)
                start = part[0][1]
                data = opened[1].read_at(part[-1][1] + part[-1][2] - start, start)
                rows = []
                for _, at, size in part:
                    f, http, payload = parse(data[at - start : at - start + size])
                    said = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = f["WARC-Type"]
                    if kind == "response" and digest32(payload) != said:
                        raise ValueError(f"payload of {f['WARC-Record-ID']} differs from its digest")
                    ids = [f[k][10:-1] if k in f else "" for k in ("WARC-Record-ID", "WARC-Refers-To")]
                    full = len(payload) if kind == "response" else int(http.rpartition(b"Content-Length: ")[2])
                    rows.append((int(ids[0]) if ids[0] else None, f.get("WARC-Target-URI"), kind, int(ids[1]) if ids[1] else None, said, full, payload if with_payload and kind == "response" else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])

    return run


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that rows of ``index`` name, parsed and checked against their digests."""
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-size // TASK_BYTES), min(64, index.sparkSession.sparkContext.defaultParallelism * 2))
    dealt = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(_read(with_payload), "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")
