"""WARC archives with a two-level capture index.

Writing: each task writes one archive of gzip members (a member a record) under a name of its own attempt into a
shared folder and returns where each record lies; only files that the manifest names count, so a retried task leaves nothing wrong behind.
Of equal payloads of at least MIN_REVISIT bytes one is stored as a response and the others as revisits that name it.

Index: captures are range-partitioned and sorted by reversed-host URL key; each task writes blocks of BLOCK lines, compressed, into
an index file. The sparse directory has one row a block: first and last key, file, offset, length. A lookup
finds blocks by key range in the directory, decompresses these, searches them by bisection, and reads only the byte ranges found.

A null payload is empty; a null URL has an empty target and key; a record with a null page_id is always a response. Rows that repeat
page_id and payload get a record each, all of the same type. An empty table gives an empty index. Other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.bloom import bitmaps, probed
from loomspark.llm._common import attach_by_key, materialize, safe_text, scratch

MIN_REVISIT = 100
BLOCK = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BAD = re.compile(r"[\x00-\x20\x7f]")


def surt(url: str | None) -> str:
    """Reversed-host key: `https://www.a.org/x` -> `org,a,www)/x`."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:cut].lower(), rest[cut:].split("#", 1)[0]
    name, _, port = host.rpartition("@")[2].partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + (tail or "/")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """An uncompressed WARC record."""
    digest = hashlib.sha256(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url:
        head.append("WARC-Target-URI: " + _BAD.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload (None for a revisit), payload_bytes, payload_digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(x) if (x := x[len("<urn:page:") : -1]) else None
    kind = fields["WARC-Type"]
    told = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != told or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None, "payload_bytes": told, "payload_digest": digest,
    }


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


@dataclass
class Archive:
    """A folder with archives and index files, and the sparse directory as a table."""

    folder: str
    directory: DataFrame

    def lookup(self, urls: list[str]) -> list[dict]:
        """Records of a few URLs, read in the driver: a binary search over the index files' ranges of keys (a row for each), one over the blocks of the file
        found, one within the block, then a range read for each record."""
        fs, root = _open(self.folder)
        files = self.directory.groupBy("file").agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key")).collect()
        out = []
        for key in dict.fromkeys(map(surt, urls)):
            for file in _holding(files, key):
                for block in _holding(self.directory.where(F.col("file") == file.file).collect(), key):
                    lines = _lines(fs, root, block.file, block.offset, block.length)
                    keys = [x[0] for x in lines]
                    for x in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                        with fs.open_input_file(f"{root}/{x[2]}") as f:
                            out.append(parse(zlib.decompress(f.read_at(x[4], x[3]), 31)))
        return out

    def read(self) -> DataFrame:
        """Every record that the index names, in parallel by block."""
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = _open(folder)
            for batch in batches:
                for block in batch.to_pylist():
                    found, name, f = [], None, None
                    for near in _neighbours(sorted(_lines(fs, root, block["file"], block["offset"], block["length"]), key=lambda x: (x[2], x[3]))):
                        if near[0][2] != name:
                            name, f = near[0][2], fs.open_input_file(f"{root}/{near[0][2]}")
                        at = near[0][3]
                        raw = f.read_at(near[-1][3] + near[-1][4] - at, at)
                        for x in near:
                            r = parse(zlib.decompress(raw[x[3] - at : x[3] - at + x[4]], 31))
                            r.pop("payload")
                            found.append(r)
                    yield pa.RecordBatch.from_pylist(found, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

        spread = int(self.directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return self.directory.select("file", "offset", "length").repartition(spread).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


#: Records of a file are read at once if no more than GAP bytes lie between them, up to RANGE bytes.
GAP, RANGE = 16 << 10, 4 << 20


def _neighbours(lines: list[list]) -> Iterator[list[list]]:
    """Runs of index lines, sorted by file and offset, that one range read covers."""
    run: list[list] = []
    for x in lines:
        if run and (x[2] != run[0][2] or x[3] - (run[-1][3] + run[-1][4]) > GAP or x[3] + x[4] - run[0][3] > RANGE):
            yield run
            run = []
        run.append(x)
    if run:
        yield run


def _holding(ranges: list, key: str) -> list:
    """Those of the ranges (first_key, last_key), which follow each other, that a key lies in, by binary search."""
    ranges = sorted(ranges, key=lambda r: (r.first_key, r.last_key))
    end = bisect.bisect_right([r.first_key for r in ranges], key)
    start = bisect.bisect_left([r.last_key for r in ranges], key)
    return ranges[start:end]


def _lines(fs: pafs.FileSystem, root: str, name: str, offset: int, length: int) -> list[list]:
    with fs.open_input_file(f"{root}/{name}") as f:
        return [json.loads(x) for x in zlib.decompress(f.read_at(length, offset)).split(b"\n")]


def _revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, digest, refers_to of the records that repeat the payload of a smaller page_id."""
    narrow = materialize(pages.select("page_id", F.unhex(F.sha2("payload", 256)).alias("digest")).where(F.octet_length("payload") >= min_bytes), "payloads")
    stats = materialize(narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1"), "payload-groups")
    return materialize(attach_by_key(narrow, stats, "digest", "n", narrow.count()).where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits")


def write_archive(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, block: int = BLOCK, date: str = "2024-01-01T00:00:00Z") -> Archive:
    """Writes archives and index of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), safe_text(F.col("html")).cast("binary").alias("payload"))
    again = _revisits(rows, min_revisit).select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "refers_to")
    # a Bloom filter lets through the pages that may be revisits; no other payload is hashed or moved again
    ids = again.select(F.xxhash64("__id").alias("h"))
    tested = probed(rows, F.xxhash64("page_id"), bitmaps(ids, ids.count()), "__again")
    some = tested.where("__again").join(again, (F.col("page_id") == F.col("__id")) & (F.unhex(F.sha2("payload", 256)) == F.col("__digest")), "left").select("page_id", "url", "payload", "refers_to")
    known = tested.where("not __again").select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to")).unionByName(some)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            lines = []
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                squeeze = zlib.compressobj(3, wbits=31)
                raw = squeeze.compress(record(r["page_id"], r["url"], r["payload"], r["refers_to"], date)) + squeeze.flush()
                out.write(raw)
                lines.append({"key": surt(r["url"]), "page_id": r["page_id"], "file": name, "offset": at, "length": len(raw)})
                at += len(raw)
            yield pa.RecordBatch.from_pylist(lines, pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out is not None:
            out.close()

    captures = materialize(known.mapInArrow(put, "key string, page_id long, file string, offset long, length long"), "captures")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        name, out, at = f"{uuid.uuid4().hex}.cdx", None, 0

        def cut(lines: list[dict]) -> dict:
            nonlocal at
            raw = zlib.compress("\n".join(json.dumps([x["key"], x["page_id"], x["file"], x["offset"], x["length"]]) for x in lines).encode())
            out.write(raw)
            at += len(raw)
            return {"first_key": lines[0]["key"], "last_key": lines[-1]["key"], "file": name, "offset": at - len(raw), "length": len(raw)}

        kind = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        waiting: list[dict] = []
        for batch in batches:
            waiting += batch.to_pylist()
            if waiting and out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            made = [cut(waiting[i : i + block]) for i in range(0, len(waiting) - block + 1, block)]
            waiting = waiting[len(made) * block :]
            yield pa.RecordBatch.from_pylist(made, kind)
        if waiting:
            yield pa.RecordBatch.from_pylist([cut(waiting)], kind)
        if out is not None:
            out.close()

    ordered = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    return Archive(folder, materialize(ordered.mapInArrow(build, "first_key string, last_key string, file string, offset long, length long"), "directory"))


def new_folder(spark: SparkSession) -> str:
    """A new folder for archives under the shared one."""
    return scratch(spark, "warc")
