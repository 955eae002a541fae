"""WARC archives: written with an index first, read back by coalesced byte ranges.

Each task writes one archive of gzip members, one a record, and returns an index row a record: file,
offset, length, URL and payload digest.  The index is a Parquet table; readers select records there
and then fetch only their bytes, sorted by file and offset, with near ranges joined to one read.

Of records with equal payloads of at least ``min_payload`` bytes, the one with the largest page_id
is the response and the others are revisits that refer to it (WARC 1.1, identical payload digest).
Null html is an empty payload.  A null page_id never is the largest, and such a record revisits the
response if its group has one; rows that repeat the largest page_id and payload are responses all.
Null or unprintable URLs are written percent-encoded, a missing one as the record's own id.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, batches, dropped, shared_path, written
from .files import coalesced, file_uri, opened

INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"
READ_GAP, READ_MOST = 64 << 10, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, place: str) -> str:
    return f"<urn:millrace:page:{page_id}>" if page_id is not None else f"<urn:millrace:row:{place}>"


def warc_record(page_id: int | None, place: str, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: the archived HTTP response, or for a revisit its header only."""
    own = record_id(page_id, place)
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else own[1:-1]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, '')}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed_record(raw: bytes) -> dict:
    """The parts of one record; raises ValueError where its lengths or digest do not hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    block, tail = rest[:n], rest[n:]
    if len(block) != n or tail != b"\r\n\r\n":
        raise ValueError("record length does not match")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("payload does not match its digest")
    page = re.search(r"urn:millrace:page:(-?\d+)", fields.get("warc-refers-to", ""))
    own = re.search(r"urn:millrace:page:(-?\d+)", fields["warc-record-id"])
    return {"page_id": int(own[1]) if own else None, "type": fields["warc-type"], "url": fields["warc-target-uri"], "digest": digest, "size": size, "refers_to": int(page[1]) if page else None, "payload": payload}


def _write(root: str, date: str, level: int):
    def run(rows):
        files, path = opened(root)
        files.create_dir(path, recursive=True)
        name, at, stream = f"part-{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches(rows, 1_000, 16 << 20):
                ids, urls, refers = (batch.column(i).to_pylist() for i in (0, 1, 3))
                out = []
                for i, (page, url, body, to) in enumerate(zip(ids, urls, as_bytes(batch.column(2)), refers, strict=True)):
                    raw = gzip.compress(warc_record(page, f"{name}:{at}:{i}", url, body, to, date), level, mtime=0)
                    stream = stream or files.open_output_stream(f"{path}/{name}", compression=None)
                    stream.write(raw)
                    out.append((page, name, at, len(raw), url, payload_digest(body), "response" if to is None else "revisit"))
                    at += len(raw)
                if out:
                    yield pa.RecordBatch.from_pydict({k: pa.array([x[i] for x in out], pa.int64() if i in (0, 2, 3) else pa.string()) for i, k in enumerate(("page_id", "file", "offset", "length", "url", "digest", "record_type"))})
        finally:
            if stream:
                stream.close()

    return run


def write_archives(pages: DataFrame, root: str, min_payload: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 5) -> DataFrame:
    """Archives of ``pages(page_id, url, html)`` below ``root``; gives the committed index.

    Only groups of equal payloads are looked up: the shuffle by digest carries ids, not html, and
    the rows of one html meet their group's largest id through a join that splits a large group.
    """
    spark = pages.sparkSession
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    hashed = base.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    groups = hashed.where(F.octet_length("html") >= min_payload).groupBy("sha").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 and largest is not null").select("sha", "largest")
    groups = written(groups, "payloads")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    marked = hashed.join(groups, "sha", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    index = written(marked.mapInArrow(_write(root, date, level), INDEX), "warc-index")
    dropped(spark, groups)
    return index


def _read(root: str, parse):
    def run(rows):
        files, path = opened(root)
        for batch in rows:
            wanted = batch.to_pylist()
            by_file: dict[str, list[dict]] = {}
            for x in wanted:
                by_file.setdefault(x["file"], []).append(x)
            for name, own in by_file.items():
                own.sort(key=lambda x: x["offset"])
                with files.open_input_file(f"{path}/{name}") as f:
                    for start, n, inside in coalesced([(x["offset"], x["length"]) for x in own], READ_GAP, READ_MOST):
                        data = f.read_at(n, start)
                        yield parse([gzip.decompress(data[own[i]["offset"] - start :][: own[i]["length"]]) for i in inside])

    return run


def _records(raws: list[bytes]) -> pa.RecordBatch:
    found = [parsed_record(x) for x in raws]
    kinds = {"page_id": pa.int64(), "type": pa.string(), "url": pa.string(), "digest": pa.string(), "size": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_pydict({k: pa.array([x[k] for x in found], t) for k, t in kinds.items()})


def read_records(index: DataFrame, root: str) -> DataFrame:
    """The records that the rows of ``index`` select, parsed and verified.

    Reads are dealt by file and 8 MB of offset, so that a task holds neighbours and no file waits
    for one task.
    """
    # By the archives' bytes: the index rows alone are so small that they would all go to one task.
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // READ_MOST))
    block = F.floor(F.col("offset") / READ_MOST)
    dealt = index.select("file", "offset", "length").repartition(tasks, "file", block).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read(root, _records), "page_id long, type string, url string, digest string, size long, refers_to long, payload binary")


def archived(pages: DataFrame, min_payload: int = 0) -> tuple[DataFrame, str]:
    """Writes ``pages`` to a new folder of the shared root: (index, root)."""
    root = file_uri(shared_path(pages.sparkSession, "warc"))
    return write_archives(pages, root, min_payload), root
