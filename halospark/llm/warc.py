"""WARC archives with an index: written record by record, read back by merged byte ranges of chosen records.

Writing: payloads are grouped by digest (partial sums, only digests travel) to find which page keeps the payload; each
task then writes one archive into the shared folder, every record its own gzip member, and returns one index row per
record: file, offset, length, URL, digest.  File names carry a fresh id for each attempt, and only files named by the
index count, so a lost executor or a second attempt does no harm.

Reading: the chosen index rows are range-partitioned and sorted by (file, offset); ranges that touch or nearly touch
are fetched in one read.

Cases: a NULL html is an empty payload; of rows with equal payload the one with the largest page_id is the response
(rows repeated under that page_id each are), others are revisits; a row without page_id is a response that nothing
refers to; a NULL url is written as no target URI; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halospark.operators.joins import join_skewed

from .common import pieces, shared_path, shuffle_parts

INDEX = """file string, start bigint, length bigint, page_id bigint, url string, payload_digest string,
    payload_bytes bigint, record_type string, refers_to bigint"""
#: Ranges less than GAP bytes apart are read together, up to SPAN bytes in one read; LEVEL is gzip's effort.
GAP, SPAN, LEVEL = 64 << 10, 8 << 20, 4
DATE = "2020-01-01T00:00:00Z"


def response_ids(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with ``response_id``, the page that keeps an equal payload; NULL where unshared."""
    df = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    key = [F.sha1(F.encode("html", "UTF-8")).alias("sha"), F.octet_length("html").alias("n")]
    keeper = df.where(F.octet_length("html") >= min_bytes).groupBy(*key).agg(F.max("page_id").alias("response_id"), F.count("*").alias("rows"))
    shared = keeper.where("rows > 1").drop("rows")
    # one payload may be that of a third of all pages: its pages are dealt over parts by their id
    return join_skewed(df.withColumns({"sha": key[0], "n": key[1]}), shared, ["sha", "n"], "left", ["page_id"]).drop("sha", "n")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """The bytes of a record, and its payload digest.

    A revisit holds the HTTP head only; its Content-Length there is that of the payload left out.
    """
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: {_urn(page_id) if page_id is not None else f'<urn:uuid:{uuid4()}>'}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head.append(f"WARC-Refers-To: {_urn(refers_to)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(data: bytes) -> dict:
    """A record's fields: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (None: revisit).

    The digest of a response is taken from its payload, not from its head.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"]
    number = lambda urn: int(urn[10:-1]) if urn.startswith("<urn:page:") else None
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": int(length) if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base32_sha1(payload),
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write every page into archives under ``folder``; the index, a table in that folder too."""
    spark = pages.sparkSession

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        file, out, at = f"{uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                for part in pieces(batch, "html"):
                    rows = []
                    for p in part.to_pylist():
                        keeper = p["response_id"]
                        refers = keeper if None not in (keeper, p["page_id"]) and keeper != p["page_id"] else None
                        payload = p["html"].encode()
                        whole, digest = record(p["page_id"], p["url"], payload, refers)
                        packer = zlib.compressobj(LEVEL, wbits=31)
                        member = packer.compress(whole) + packer.flush()
                        if out is None:
                            fs.create_dir(base, recursive=True)
                            out = fs.open_output_stream(f"{base}/{file}", compression=None)
                        out.write(member)
                        rows.append((file, at, len(member), p["page_id"], p["url"], digest, len(payload), "response" if refers is None else "revisit", refers))
                        at += len(member)
                    yield _batch(rows)
        finally:
            if out is not None:
                out.close()

    response_ids(pages, min_bytes).mapInArrow(task, INDEX).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
_NAMES = ("file", "start", "length", "page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to")


def _batch(rows: list[tuple], names=_NAMES, types=_TYPES) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first, end, number of ranges) of the reads that cover ``ranges`` (start, length), sorted by start."""
    reads: list[list[int]] = []
    for start, length in ranges:
        if reads and start - reads[-1][1] <= GAP and start + length - reads[-1][0] <= SPAN:
            reads[-1][1] = max(reads[-1][1], start + length)
            reads[-1][2] += 1
        else:
            reads.append([start, start + length, 1])
    return [tuple(r) for r in reads]


READ = """page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string,
    refers_to bigint"""


def read_records(index: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records of the given index rows, read from their archives; with ``payload``, that too (NULL: revisit)."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = batch.to_pylist()
            while rows:
                file = rows[0]["file"]
                same = next((i for i, r in enumerate(rows) if r["file"] != file), len(rows))
                own, rows = rows[:same], rows[same:]
                with fs.open_input_file(f"{base}/{file}") as source:
                    for first, end, n in merge_ranges([(r["start"], r["length"]) for r in own]):
                        data = memoryview(source.read_at(end - first, first))
                        out = []
                        for r in own[:n]:
                            at = r["start"] - first
                            fields = parse(zlib.decompress(data[at : at + r["length"]], wbits=31))
                            out.append(tuple(fields[k] for k in names))
                        own = own[n:]
                        yield _batch(out, names, types)

    # a fixed number of parts: the rows are small, but each stands for a record to be read
    parts = shuffle_parts(index.sparkSession)
    chosen = index.select("file", "start", "length").repartitionByRange(parts, "file", "start").sortWithinPartitions("file", "start")
    return chosen.mapInArrow(task, READ + (", payload binary" if payload else ""))


def archive_pages(pages: DataFrame, min_bytes: int = 0, chosen: Column | None = None) -> DataFrame:
    """Write the pages to new archives in the shared folder and read the chosen records (all by default) back."""
    folder = shared_path(pages.sparkSession)
    index = write_archives(pages, folder, min_bytes)
    return read_records(index if chosen is None else index.where(chosen), folder)
