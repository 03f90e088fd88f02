"""WARC archives with a two-level capture index.

Captures are written as one gzip member per record. Their keys (reversed host, path, id) are sorted over all
archives and stored in compressed blocks; each index shard ends with a sparse directory of the first key of
every block, and the shards' first keys, of which there are at most `MAX_SHARDS`, are all that is broadcast.
A lookup binary-searches the shards, the directory and the block, and then reads one range of one archive.

Files are written and read through `pyarrow.fs` in the folder of spark.checkpoint.dir. A task writes under a
name of its own and returns where its records lie, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import stored
from cohortspark.session import scratch_path

#: Payloads of fewer bytes are always stored.
SMALLEST_REVISIT = 1000
BLOCK_LINES = 1000
SHARD_LINES = 50_000
MAX_SHARDS = 4096
DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def capture_key(url: str | None, page_id) -> str:
    """Sort key: host labels reversed, then path and query; the id makes it unique. Without a host: `-`."""
    try:
        parts = urlsplit(url or "")
        labels = (parts.hostname or "").split(".")
        rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        labels, rest = [""], ""
    host = ",".join(reversed(labels)) or "-"
    return f"{host}){quote(rest, safe='/?&=%')} {'null' if page_id is None else page_id}"


def _named(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed. A revisit holds the digest of its payload and no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = _HTTP if revisit else _HTTP + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _named(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else None),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", _REVISIT if revisit else None),
        ("WARC-Refers-To", _named(refers_to) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; fails where lengths or the payload's digest do not fit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {headers['WARC-Record-ID']} has another length")
    payload = rest[:size].partition(b"\r\n\r\n")[2]
    digest = f"sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}"
    if headers["WARC-Type"] == "response" and digest != headers["WARC-Payload-Digest"]:
        raise ValueError(f"record {headers['WARC-Record-ID']} has another digest")
    return headers, payload


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _write_archive(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        out, at, name = None, 0, f"{uuid.uuid4().hex}.warc.gz"
        try:
            for batch in batches:
                if out is None and batch.num_rows:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                keys, places, lengths = [], [], []
                for page_id, url, payload, refers, revisit in zip(
                    *(_column(batch, c) for c in ("page_id", "url", "payload", "refers_to", "revisit"))
                ):
                    raw = gzip.compress(record(page_id, url, payload, refers, revisit), 6, mtime=0)
                    out.write(raw)
                    keys.append(capture_key(url, page_id))
                    places.append(at)
                    lengths.append(len(raw))
                    at += len(raw)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.string()),
                        pa.array([name] * len(keys), pa.string()),
                        pa.array(places, pa.int64()),
                        pa.array(lengths, pa.int64()),
                    ],
                    ["key", "file", "offset", "length"],
                )
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write one record per row of `pages` (page_id, url, html); returns (key, file, offset, length)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.concat(F.sha1("payload"), F.md5("payload"))).withColumn(
        "stored", F.length("payload") < SMALLEST_REVISIT
    )
    groups = (
        rows.where("NOT stored")
        .groupBy("digest")
        .agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "latest")
    )
    revisit = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    tagged = rows.join(groups, "digest", "left").select(
        "page_id", "url", "payload", F.when(revisit, F.col("latest")).alias("refers_to"), revisit.alias("revisit")
    )
    return stored(tagged.mapInArrow(_write_archive(folder), "key string, file string, offset long, length long"), "captures")


def _write_index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        out, at, name, first, directory, lines = None, 0, f"{uuid.uuid4().hex}.idx", None, [], []

        def block() -> None:
            nonlocal at
            packed = zlib.compress("\n".join(json.dumps(line) for line in lines).encode())
            directory.append((lines[0][0], at, len(packed)))
            out.write(packed)
            at += len(packed)
            lines.clear()

        try:
            for batch in batches:
                for line in zip(*(_column(batch, c) for c in ("key", "file", "offset", "length"))):
                    if out is None:
                        out, first = fs.open_output_stream(f"{root}/{name}", compression=None), line[0]
                    lines.append(line)
                    if len(lines) == BLOCK_LINES:
                        block()
            if out is not None:
                if lines:
                    block()
                packed = zlib.compress(json.dumps(directory).encode())
                out.write(packed + len(packed).to_bytes(8, "big"))
        finally:
            if out is not None:
                out.close()
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([name])], ["first", "shard"])

    return run


def write_index(captures: DataFrame, folder: str, shard_lines: int = SHARD_LINES) -> DataFrame:
    """Sort the captures into index shards; returns (first, shard), at most `MAX_SHARDS` rows."""
    shards = min(MAX_SHARDS, max(1, -(-captures.count() // shard_lines)))
    ranged = captures.repartitionByRange(shards, "key").sortWithinPartitions("key")
    return stored(ranged.mapInArrow(_write_index(folder), "first string, shard string"), "shards")


class Shard:
    """An open index shard: its directory, and the block read last."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        length = int.from_bytes(self.file.read_at(8, size - 8), "big")
        self.directory = json.loads(zlib.decompress(self.file.read_at(length, size - 8 - length)))
        self.first = [entry[0] for entry in self.directory]
        self.at, self.lines, self.keys = -1, [], []

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """Places of all captures of a key: (file, offset, length)."""
        found, at = [], max(0, bisect.bisect_left(self.first, key) - 1)  # a key may begin in the block before
        while at < len(self.directory) and self.first[at] <= key:
            if at != self.at:
                _, offset, length = self.directory[at]
                self.lines = [json.loads(x) for x in zlib.decompress(self.file.read_at(length, offset)).decode().split("\n")]
                self.at, self.keys = at, [line[0] for line in self.lines]
            for line in self.lines[bisect.bisect_left(self.keys, key) : bisect.bisect_right(self.keys, key)]:
                found.append(tuple(line[1:]))
            at += 1
        return found


def _requests(firsts: list[str], shards: list[str]):
    """Every shard that may hold a key: the one it falls in, and those before that it may have begun in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names = [], []
            for url, page_id in zip(_column(batch, "url"), _column(batch, "page_id")):
                key = capture_key(url, page_id)
                at = max(0, bisect.bisect_left(firsts, key) - 1)
                while at < len(firsts) and firsts[at] <= key:
                    keys.append(key)
                    names.append(shards[at])
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(names, pa.string())], ["key", "shard"])

    return run


def _locate(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name, shard = None, None
        for batch in batches:
            found = []
            for key, of in zip(_column(batch, "key"), _column(batch, "shard")):
                if of != name:
                    name, shard = of, Shard(fs, f"{root}/{of}")
                found += shard.find(key)
            files, offsets, lengths = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                ["file", "offset", "length"],
            )

    return run


def _id_of(name: str | None) -> int | None:
    value = name[len("<urn:x-page:") : -1] if name else "null"
    return None if value == "null" else int(value)


def _read_ranges(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name, archive = None, None
        for batch in batches:
            rows = []
            for of, offset, length in zip(*(_column(batch, c) for c in ("file", "offset", "length"))):
                if of != name:
                    name, archive = of, fs.open_input_file(f"{root}/{of}")
                headers, payload = read_record(gzip.decompress(archive.read_at(length, offset)))
                digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                revisit = headers["WARC-Type"] == "revisit"
                rows.append(
                    (
                        _id_of(headers["WARC-Record-ID"]),
                        None if revisit else len(payload),
                        digest,
                        headers["WARC-Type"],
                        _id_of(headers.get("WARC-Refers-To")),
                    )
                )
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

    return run


def read_captures(requests: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """The records of `requests` (url, page_id), found through the index and read by ranges."""
    directory = sorted((r["first"], r["shard"]) for r in shards.collect())
    firsts, names = [d[0] for d in directory], [d[1] for d in directory]
    wanted = requests.select("url", "page_id").mapInArrow(_requests(firsts, names), "key string, shard string").distinct()
    parts = requests.sparkSession.sparkContext.defaultParallelism * 4
    located = (
        wanted.repartitionByRange(max(parts, len(names)), "shard", "key")
        .sortWithinPartitions("shard", "key")
        .mapInArrow(_locate(folder), "file string, offset long, length long")
    )
    ordered = located.repartitionByRange(max(parts, len(names)), "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(
        _read_ranges(folder),
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write `pages` to archives and an index, and read every capture back through them.

    One row per input row: page_id, payload_bytes, payload_digest, record_type, refers_to. Of records
    with equal payloads of at least `SMALLEST_REVISIT` bytes the one with the largest page_id is a response,
    the others revisit it; rows that repeat that id are responses too, and payloads under null ids only are
    all stored. A revisit's bytes are those of the response it refers to. A null html is an empty payload; a
    null url has no target and sorts first. Other columns are ignored; an empty table writes no record.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    captures = write_archives(pages, folder)
    shards = write_index(captures, folder)
    records = stored(read_captures(pages, shards, folder), "records")
    responses = (
        records.where("record_type = 'response'")
        .groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("digest"))
        .agg(F.max("payload_bytes").alias("of_bytes"))
    )
    resolved = records.join(
        responses, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("digest")), "left"
    )
    return resolved.select(
        "page_id",
        F.coalesce("payload_bytes", "of_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest FROM pages),
r AS (SELECT *, octet_length(encode(h)) >= 1000 AND page_id <> latest AS again FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN latest END AS refers_to
FROM r
"""
