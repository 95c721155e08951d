"""Deterministic sharded WARC writer and reader.

Records are cut into shards of consecutive page ids with about equal payload, from exact counts, so
that the same table gives the same files. Within a shard they are sorted by id; every record is a
gzip member of its own, and a new file begins when the compressed size passes ``roll_bytes``.
Headers, digests and record ids are made anew from the rows.

Of records with equal payloads the one with the largest page id is a response; the others are
revisits of it. This is decided on rows of two numbers; the decisions travel to the writer in the
same range shuffle as the pages and stand before them, so the payload is shuffled once.

A task writes below ``_temporary/<attempt>``; the driver renames the files of the attempts whose
results it has and writes the manifest last, under a temporary name too. A folder without a manifest
is not an archive, and files of lost attempts are never in one.

Null html: empty payload. Null url: ``about:blank``. A null page id sorts first and is never the
response if another id has the same payload. Rows equal in id and payload: the first is as above,
the others revisit it. Control characters in urls are percent-encoded. An empty table gives a
manifest without files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import partitions

MANIFEST = "manifest.json"
CELLS = 1024


@dataclass(frozen=True)
class WarcSpec:
    """``min_bytes``: shorter payloads are never revisits. ``level``: of the compression."""

    prefix: str = "pages"
    shards: int | None = None
    roll_bytes: int = 32_000_000
    min_bytes: int = 0
    date: str = "2000-01-01T00:00:00Z"
    level: int = 6


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that driver and executors reach."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


# --- records -----------------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else "about:blank"


def record(kind: str, headers: list[tuple[str, str]], block: bytes, spec: WarcSpec) -> bytes:
    """One record as a gzip member without a time stamp."""
    digest = "sha1:" + payload_digest(block)
    lines = [("WARC-Type", kind), ("WARC-Date", spec.date), *headers, ("WARC-Block-Digest", digest), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(spec.level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def page_record(page_id: int | None, nth: int, url: str | None, payload: bytes, response: bool, refers_to: int | None, spec: WarcSpec) -> bytes:
    digest = payload_digest(payload)
    headers = [
        ("WARC-Record-ID", _record_id(page_id, digest, nth)),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if response:
        return record("response", [*headers, ("Content-Type", "application/http;msgtype=response")], http + payload, spec)
    headers += [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", _record_id(refers_to, digest, 0)),
        ("WARC-Refers-To-Page-ID", "" if refers_to is None else str(refers_to)),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    return record("revisit", headers, http, spec)


# --- writing -----------------------------------------------------------------------------


def shard_cuts(rows: DataFrame, n: int) -> list[int]:
    """First ids of shards 1, 2, ... from exact weights of cells of ids; ``rows`` has id and weight.

    Cells heavier than a shard are cut again; every step brings at most ``CELLS`` + 1 numbers of a
    cell to the driver, for at most ``n`` cells.
    """
    low, high, total = rows.agg(F.min("id"), F.max("id"), F.sum("weight")).first()
    if low is None or n < 2:
        return []
    share = total / n
    cells = [(low, high + 1, total)]
    while heavy := [c for c in cells if c[2] > share and c[1] - c[0] > 1]:
        fine = []
        number = start = width = F.lit(None).cast("long")
        for i, (a, b, _) in enumerate(heavy):
            inside = (F.col("id") >= a) & (F.col("id") < b)
            number = F.when(inside, F.lit(i)).otherwise(number)
            start = F.when(inside, F.lit(a)).otherwise(start)
            width = F.when(inside, F.lit(-(-(b - a) // CELLS))).otherwise(width)
        at = start + F.floor((F.col("id") - start) / width) * width
        got = rows.filter(number.isNotNull()).groupBy(at.alias("a"), (at + width).alias("b")).agg(F.sum("weight")).collect()
        fine = [(r[0], r[1], r[2]) for r in got]
        cells = sorted([c for c in cells if c not in heavy] + fine)
    cuts, seen = [], 0
    for a, _, w in cells:
        if seen >= share * (len(cuts) + 1) and a > low:
            cuts.append(int(a))
        seen += w
    return cuts


def decisions(pages: DataFrame, spec: WarcSpec) -> DataFrame:
    """page_id, digest, best: the largest page id among equal payloads."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
    keys = keys.filter(F.col("n") >= spec.min_bytes).select("page_id", "digest").distinct()
    best = keys.groupBy("digest").agg(F.max("page_id").alias("best"))
    return keys.join(best, "digest")


def write_archive(pages: DataFrame, folder: str, spec: WarcSpec = WarcSpec()) -> list[dict]:
    """Write ``pages`` (page_id, url, html) below ``folder``; the manifest's entries."""
    fs, path = filesystem(folder)
    if fs.get_file_info(f"{path}/{MANIFEST}").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{folder} holds an archive")
    html = F.coalesce(F.col("html"), F.lit(""))
    weights = pages.select(F.col("page_id").cast("long").alias("id"), (F.octet_length(html) + 500).alias("weight"))
    n = spec.shards or partitions(pages)
    cuts = shard_cuts(weights, n)
    shard: Column = F.lit(0)
    if cuts:
        shard = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("page_id"))), F.lit(0))
    contents = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html.cast("binary")).alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("best"), "url", html.alias("html"))
    verdicts = decisions(pages, spec).select("page_id", "digest", F.lit(0).alias("kind"), "best", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    rows = contents.unionByName(verdicts).withColumn("shard", shard)
    rows = rows.repartitionByRange(len(cuts) + 1, "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    names = ["shard", "page_id", "digest", "kind", "best", "url", "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        temp = f"{root}/_temporary/{TaskContext.get().taskAttemptId()}"
        store.create_dir(temp, recursive=True)
        done: list[tuple[int, int, str, int, int]] = []
        out, state = None, {"shard": -1, "part": 0, "records": 0, "bytes": 0, "name": ""}

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((state["shard"], state["part"], state["name"], state["records"], state["bytes"]))
                out = None

        def begin(number: int) -> None:
            nonlocal out
            state["part"] = state["part"] + 1 if state["shard"] == number else 0
            state["shard"] = number
            state["name"] = f"{spec.prefix}-{number:05d}-{state['part']:05d}.warc.gz"
            out = store.open_output_stream(f"{temp}/{state['name']}", compression=None)
            head = [("WARC-Record-ID", _record_id("info", state["name"])), ("WARC-Filename", state["name"]), ("Content-Type", "application/warc-fields")]
            info = record("warcinfo", head, b"format: WARC File Format 1.1\r\n", spec)
            out.write(info)
            state["records"], state["bytes"] = 0, len(info)

        verdict: tuple = ()
        nth, decided = 0, False
        for batch in batches:
            for number, page, digest, kind, best, url, content in zip(*(batch.column(c).to_pylist() for c in names)):
                if verdict[:2] != (page, digest):
                    verdict, nth, decided = (page, digest, None), 0, False
                if kind == 0:
                    verdict, decided = (page, digest, best), True
                    continue
                if out is None or number != state["shard"] or state["bytes"] >= spec.roll_bytes:
                    close()
                    begin(number)
                response = not decided or (nth == 0 and verdict[2] == page)
                data = page_record(page, nth, url, content.encode(), response, verdict[2], spec)
                out.write(data)
                nth += 1
                state["records"] += 1
                state["bytes"] += len(data)
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))]
            + [pa.array([f"{temp}/{d[2]}" for d in done], pa.string())],
            ["shard", "part", "name", "records", "bytes", "temp"],
        )

    fs.create_dir(path, recursive=True)
    files = rows.select(*names).mapInArrow(run, "shard int, part int, name string, records long, bytes long, temp string").collect()
    entries = []
    for f in sorted(files, key=lambda r: (r.shard, r.part)):  # one row per file
        fs.move(f.temp, f"{path}/{f.name}")
        entries.append({"name": f.name, "shard": f.shard, "records": f.records, "bytes": f.bytes})
    if fs.get_file_info(f"{path}/_temporary").type == pafs.FileType.Directory:
        fs.delete_dir(f"{path}/_temporary")
    with fs.open_output_stream(f"{path}/.{MANIFEST}.tmp", compression=None) as out:
        out.write(json.dumps({"format": "WARC/1.1", "files": entries}, indent=1).encode())
    fs.move(f"{path}/.{MANIFEST}.tmp", f"{path}/{MANIFEST}")
    return entries


# --- reading -----------------------------------------------------------------------------


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record of one compressed file."""
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record: {line[:40]!r}")
            headers = {}
            while (line := f.readline().rstrip(b"\r\n")) != b"":
                name, _, value = line.decode().partition(":")
                headers[name.lower()] = value.strip()
            block = f.read(int(headers["content-length"]))
            if f.read(4) != b"\r\n\r\n" or headers["warc-block-digest"] != "sha1:" + payload_digest(block):
                raise ValueError(f"damaged record {headers['warc-record-id']}")
            yield headers, block


def read_archive(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and the payload of responses)."""
    fs, path = filesystem(folder)
    with fs.open_input_stream(f"{path}/{MANIFEST}", compression=None) as f:
        names = [e["name"] for e in json.loads(f.read())["files"]]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    if not names:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load([f"{folder}/{n}" for n in names]).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for h, block in parse(data.as_py()):
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    response = h["warc-type"] == "response"
                    if response and (payload_digest(payload) != digest or len(payload) != int(h["warc-payload-length"])):
                        raise ValueError(f"payload of {h['warc-record-id']} does not fit its digest")
                    to = h.get("warc-refers-to-page-id", "")
                    page = h["warc-page-id"]
                    rows.append((
                        int(page) if page else None, h["warc-target-uri"], int(h["warc-payload-length"]), digest, h["warc-type"],
                        int(to) if to else None, payload if response else None,
                    ))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                labels = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                k = 7 if with_payload else 6
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(k)], labels[:k])

    return files.mapInArrow(run, schema)
