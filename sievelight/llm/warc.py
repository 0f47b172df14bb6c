"""Deterministic sharded WARC writer and reader.

Records are dealt into ranges of page ids of about ``RANGE_BYTES`` of payload, whose cuts follow from the rows alone, and sorted in
them; each range is written by one task, record by record as gzip members, and a new file starts where the next record would pass
``ROLL_BYTES`` of compressed size. Headers, record ids and digests are made anew from the rows, so the same rows give the same files,
byte for byte, however they are partitioned. A task writes each file under a temporary name of its own and renames it when it's
whole; a task that runs again, or twice, renames an equal file over it. The manifest is written last, by the same steps, and the
temporary names are cleared. Readers go by the manifest.

Of rows with equal payloads the one with the smallest page id is the response, the others are revisits without the payload.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import bounded_batches, cut_blocks, drop, even_cuts, save, shared_dir, spread_join

ROLL_BYTES = 256 << 20
RANGE_BYTES = 64 << 20
REVISIT_LEAST = 0  # payloads of fewer bytes are always responses
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard name space of URLs


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int, digest: str, nth: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page}/{digest}/{nth}')}>"


def record(page: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, nth: int = 0) -> bytes:
    """One gzip member."""
    target = "".join((url or "about:blank").split())
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page, digest, nth)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"X-Page-Id: {page}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + made.flush()


def rename(filesystem: fs.FileSystem, old: str, new: str) -> None:
    """Also over an existing file, where the file system doesn't do that by itself."""
    try:
        filesystem.move(old, new)
    except OSError:
        if filesystem.get_file_info(new).type != fs.FileType.File:
            raise
        filesystem.delete_file(new)
        filesystem.move(old, new)


class RollingFiles:
    """Files of a range, renamed from temporary names when they are whole; ``done`` has (name, records, bytes, sha256)."""

    def __init__(self, root: str, block: int, most: int):
        self.fs, self.dir = fs.FileSystem.from_uri(root)
        self.block, self.most, self.done, self.out = block, most, [], None

    def add(self, data: bytes) -> None:
        if self.out is not None and self.size + len(data) > self.most:
            self.close()
        if self.out is None:
            self.name = f"part-{self.block:06d}-{len(self.done):05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.hash = self.fs.open_output_stream(posixpath.join(self.dir, self.temporary), compression=None), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            rename(self.fs, posixpath.join(self.dir, self.temporary), posixpath.join(self.dir, self.name))
            self.done.append((self.name, self.records, self.size, self.hash.hexdigest()))
            self.out = None


FILES = pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def _write(root: str, most: int):
    """Rows come sorted by block and page, and for each page first who is referred to, then the pages themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, page, known, seen = None, None, {}, {}
        done = []
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("block", "page_id", "kind", "url", "html", "digest", "refers_to")]
            for block, now, kind, url, html, digest, refers_to in zip(*cols, strict=True):
                if files is None or files.block != block:
                    if files is not None:
                        files.close()
                        done += files.done
                    files, page = RollingFiles(root, block, most), None
                if now != page:
                    page, known, seen = now, {}, {}
                if kind == 0:
                    known[digest] = refers_to
                    continue
                payload = (html or "").encode()
                own = base32_sha1(payload)
                nth = seen.get(own, 0)
                seen[own] = nth + 1
                refers = known.get(own)
                if nth and len(payload) >= REVISIT_LEAST:  # a row that repeats id and payload
                    refers = refers if refers is not None else page
                files.add(record(page, url, payload, own, refers, nth))
        if files is not None:
            files.close()
            done += files.done
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], schema=FILES)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        payloads = [(t or "").encode() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([base32_sha1(p) for p in payloads], pa.string()), pa.array([len(p) for p in payloads], pa.int64())], names=["page_id", "digest", "size"])


def write(pages: DataFrame, root: str, roll: int = ROLL_BYTES) -> str:
    """Writes ``pages`` (page_id, url, html) under ``root`` and returns the manifest's path.

    Null html is the empty payload, a null url is about:blank, rows with a null page_id are left out. An empty table gives a
    manifest without files. Of rows that repeat id and payload one is the response. Writing again to the same root replaces
    equal files by equal files. Of rows with one page id and payload but unlike urls the first by the hash of the row is the response.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").where("page_id is not null")
    slim, slim_path = save(rows.select("page_id", "html").mapInArrow(_digests, "page_id long, digest string, size long"), "payloads")
    some = slim.where(f"size >= {REVISIT_LEAST}")
    first = some.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("refers_to < last").drop("last")
    first, first_path = save(first, "first")
    revisits = spread_join(some.select("digest", "page_id"), first, "digest", some.count()).where("refers_to < page_id").select("page_id", "digest", "refers_to").distinct()
    both = (
        revisits.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to")
        .unionByName(rows.select("page_id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to")))
    )
    cuts = even_cuts(slim, "page_id", "size", RANGE_BYTES)
    dealt = cut_blocks(cuts, "page_id")(both).repartitionById(len(cuts) + 1, "block").sortWithinPartitions("block", "page_id", "kind", F.xxhash64("url", "html"))
    filesystem, base = fs.FileSystem.from_uri(root)
    filesystem.create_dir(posixpath.join(base, "_temporary"), recursive=True)
    made = dealt.mapInArrow(_write(root, roll), "name string, records long, bytes long, sha256 string").collect()  # a row per file
    listed = [{k: f[k] for k in ("name", "records", "bytes", "sha256")} for f in sorted(made, key=lambda f: f["name"])]
    with filesystem.open_output_stream(posixpath.join(base, "_temporary/manifest.json"), compression=None) as out:
        out.write(json.dumps({"files": listed}, indent=1).encode())
    rename(filesystem, posixpath.join(base, "_temporary/manifest.json"), posixpath.join(base, "manifest.json"))
    filesystem.delete_dir(posixpath.join(base, "_temporary"))
    drop(spark, slim_path, first_path)
    return posixpath.join(root, "manifest.json")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream of gzip members, one record in memory at a time."""
    held = b""
    while True:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if not held:
                held = stream.read(1 << 20)
                if not held:
                    if parts:
                        raise ValueError("a WARC file ends within a record")
                    return
            parts.append(member.decompress(held))
            held = member.unused_data if member.eof else b""
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        yield headers, rest[: int(headers["Content-Length"])]


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with filesystem.open_input_stream(posixpath.join(base, name), compression=None) as stream:
                    for headers, block in records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and base32_sha1(payload) != digest or base32_sha1(block) != headers["WARC-Block-Digest"].removeprefix("sha1:"):
                            raise ValueError(f"{name}: digest of page {headers['X-Page-Id']} differs")
                        size = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
                        refers = headers.get("X-Refers-To-Page-Id")
                        rows.append((int(headers["X-Page-Id"]), headers["WARC-Target-URI"], size, digest, kind, int(refers) if refers else None))
                        if len(rows) >= 5000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read(spark, root: str) -> DataFrame:
    """The records of the files that the manifest under ``root`` lists, digests verified; files are dealt out to tasks."""
    bounded_batches(spark)
    filesystem, base = fs.FileSystem.from_uri(root)
    with filesystem.open_input_stream(posixpath.join(base, "manifest.json")) as f:
        names = [x["name"] for x in json.loads(f.read())["files"]]
    if not names:
        return spark.createDataFrame([], READ)
    files = spark.createDataFrame(list(enumerate(names)), "nth int, name string").repartitionById(len(names), "nth").select("name")
    return files.mapInArrow(_read(root), READ)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/sievelight/warc-{uuid.uuid4().hex}"
    if "://" not in root:
        root = ("file://" if root.startswith("/") else "file:///") + root.removeprefix("file:")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    out, _ = save(read(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-read")
    drop(spark, root)  # the query returns what the archives have, not the archives
    return out


#: The rows of ``op8_warc``: each five hex digits of a SHA-1 are four base-32 digits.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS one FROM pages),
q AS (SELECT *, sha1(h) AS hex FROM p)
SELECT page_id, strlen(h) AS payload_bytes,
  array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, k // 4 * 5 + 1, 5) AS BIGINT) >> (15 - k % 4 * 5)) & 31 AS INTEGER) + 1, 1)
    for k in range(32)], '') AS payload_digest,
  CASE WHEN one < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN one < page_id THEN one END AS refers_to
FROM q
"""
