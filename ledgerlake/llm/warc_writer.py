"""Deterministic sharded WARC archives: writing, committing and reading back.

Records are sorted by page_id and cut into shards of about `shard_bytes` of payload, at borders that follow
from the exact sizes in the table, so a rerun writes the same files.  Each shard's task writes its records, each a gzip member of its own, and
rolls to the next file when the compressed size passes `roll_bytes`.  Headers and digests are made anew from the payload.
A file is written under a temporary name that holds the task attempt and is renamed when complete; the manifest, renamed into
place last, names the files with sizes and SHA-256.  A task that runs twice, or on another executor after a loss, replaces a file by the same bytes;
what the manifest does not name is not part of the archive.

Of records with equal payloads of at least `revisit_bytes` bytes, the one with the largest page_id is the response and the others
are revisits that refer to it and carry no payload; they lose it before the sort, so copies are never shuffled.

Defined results: null html is an empty payload; rows without page_id come first, and are revisits of a row with
an id where there is one, and responses where there is none; very long pages are one record, and a shard of their own where they need it; rows that repeat page_id and payload of a response are responses too; an empty
table gives an archive of no files; extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runs import settle, shared_dir
from ._text import to_bytes

REVISIT_BYTES = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _record_id(page_id, digest: str, turn: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{turn}')}>"


def _line(value: str) -> str:
    """A header value: no line breaks."""
    return " ".join((value or "").split())


def record(page_id, url: str, payload: bytes, size: int, digest: str, refers_to, turn: int, date: str) -> bytes:
    """One WARC record; a revisit (refers_to is not None) has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest, turn)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{_b32(digest)}",
        f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).hexdigest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest, 0)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without time or name, so equal data give equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes):
    """(headers, block) of each record of an archive file; digests and lengths are checked."""
    at, step = 0, 1 << 16
    while at < len(data):
        z, parts, begin = zlib.decompressobj(31), [], at
        while not z.eof:
            if at >= len(data):
                raise ValueError("truncated gzip member")
            parts.append(z.decompress(data[at : at + step]))
            at += step
        at = min(at, len(data)) - len(z.unused_data)
        raw = b"".join(parts)
        assert at > begin
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        block = rest[: int(headers["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n" or "sha1:" + _b32(hashlib.sha1(block).hexdigest()) != headers["WARC-Block-Digest"]:
            raise ValueError("damaged record")
        yield headers, block


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Roll:
    """The files of one shard."""

    def __init__(self, uri: str, shard: int, roll_bytes: int, attempt: str):
        self.fs, self.dir = _filesystem(uri)
        self.shard, self.roll_bytes, self.attempt, self.number, self.out = shard, roll_bytes, attempt, 0, None

    def add(self, data: bytes):
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temp = f"{self.dir}/.{self.name}.{self.attempt}.tmp"
            self.out, self.size, self.n, self.hash = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)
        self.n += 1
        if self.size >= self.roll_bytes:
            return self.close()
        return None

    def close(self):
        if self.out is None:
            return None
        self.out.close()
        self.fs.move(self.temp, f"{self.dir}/{self.name}")
        self.out = None
        self.number += 1
        return self.name, self.shard, self.n, self.size, self.hash.hexdigest()


_FILES = pa.schema([("file", pa.string()), ("shard", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def typed(pages: DataFrame, id_col: str, url_col: str, html_col: str, revisit_bytes: int) -> DataFrame:
    """page_id, url, html (null for revisits), size, digest, refers_to."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    copies = base.filter(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response")).filter("n > 1 and response is not null").select("digest", "response")
    joined = base.join(settle(copies, "copies"), "digest", "left")
    refers = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return joined.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "size", "digest", refers.alias("refers_to"))


def _borders(rows: DataFrame, shard_bytes: int) -> list[int]:
    """Smallest id of each shard after the first, from exact sums over ranges of ids.

    Ranges that hold more than a shard are cut into eight, as often as it takes, so skewed ids make no large shard.
    """
    low, high, total = rows.agg(F.min("page_id"), F.max("page_id"), F.sum("size")).first()
    if low is None or (total or 0) <= shard_bytes:
        return []
    rows = settle(rows.filter("page_id is not null").select("page_id", (F.col("size") + 600).alias("b")), "sizes")
    shift = 0
    while (high >> shift) - (low >> shift) >= 4096:
        shift += 3
    leaves, heavy = [], None
    while True:
        own = rows.withColumn("k", F.shiftright("page_id", shift))
        if heavy is not None:
            own = own.join(F.broadcast(heavy), F.shiftright("k", 3) == F.col("parent"), "left_semi")  # fewer rows than shards
        sums = own.groupBy("k").agg(F.sum("b").alias("b")).collect()
        large = {r.k for r in sums if r.b > shard_bytes and shift}
        leaves += [(r.k << shift, r.b) for r in sums if r.k not in large]
        if not large:
            break
        heavy = rows.sparkSession.createDataFrame([(k,) for k in large], "parent long")
        shift -= 3
    borders, held = [], 0
    for first, size in sorted(leaves):
        if held and held + size > shard_bytes:
            borders.append(first)
            held = 0
        held += size
    return borders


def write_archive(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, shard_bytes: int = 64 << 20, roll_bytes: int = 16 << 20, date: str = "2024-01-01T00:00:00Z") -> dict:
    """Write the archive under uri and return its manifest."""
    fs, at = _filesystem(uri)
    fs.create_dir(at, recursive=True)
    rows = typed(pages, id_col, url_col, html_col, revisit_bytes)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.octet_length(F.coalesce(F.col(html_col), F.lit(""))).cast("long").alias("size"))
    borders = _borders(base, shard_bytes)
    edges = np.array(borders, np.int64)  # one number a shard

    @F.pandas_udf("int")
    def shard_of(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(edges, ids.fillna(-(2**63)).astype("int64").to_numpy(), side="right").astype(np.int32))

    placed = rows.withColumn("shard", shard_of("page_id"))
    placed = placed.repartitionById(len(borders) + 1, "shard").sortWithinPartitions("shard", "page_id", "digest", "url", F.col("html").isNull())

    def write(batches):
        from pyspark import TaskContext

        attempt = str(TaskContext.get().taskAttemptId())
        roll, done, last, turn = None, [], None, 0
        for b in batches:
            html = b.column(2)
            cols = [b.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6)]
            for k in range(0, b.num_rows, 256):
                for (page_id, url, size, digest, refers, shard), payload in zip(zip(*(c[k : k + 256] for c in cols)), to_bytes(html.slice(k, 256))):
                    if roll is None or roll.shard != shard:
                        done.append(roll and roll.close())
                        roll = _Roll(uri, shard, roll_bytes, attempt)
                    turn = turn + 1 if last == (page_id, digest) else 0
                    last = page_id, digest
                    done.append(roll.add(member(record(page_id, url, payload, size, digest, refers, turn, date))))
        done.append(roll and roll.close())
        yield pa.RecordBatch.from_pylist([dict(zip(_FILES.names, d)) for d in done if d], schema=_FILES)

    files = placed.select("page_id", "url", "html", "size", "digest", "refers_to", "shard").mapInArrow(write, "file string, shard long, records long, bytes long, sha256 string")
    manifest = {"date": date, "files": [r.asDict() for r in sorted(files.collect(), key=lambda r: r.file)]}  # a row a file
    temp = f"{at}/.manifest.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp) as out:
        out.write(json.dumps(manifest, sort_keys=True, indent=1).encode())
    fs.move(temp, f"{at}/manifest.json")
    return manifest


def read_archive(spark: SparkSession, uri: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, and url and html (null for revisits)."""
    fs, at = _filesystem(uri)
    with fs.open_input_stream(f"{at}/manifest.json") as f:
        manifest = json.loads(f.read())
    schema = f"{_RESULT}, url string, html string"
    if not manifest["files"]:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(x["file"], x["sha256"]) for x in manifest["files"]], "file string, sha256 string").repartition(min(len(manifest["files"]), 10_000))

    def read(batches):
        own, dir_ = _filesystem(uri)
        kind = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string())])
        for b in batches:
            for file, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with own.open_input_stream(f"{dir_}/{file}", compression=None) as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"{file} is not the file of the manifest")
                rows = []
                for h, block in parse(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    sha1 = binascii.hexlify(base64.b32decode(h["WARC-Payload-Digest"][5:])).decode()
                    response = h["WARC-Type"] == "response"
                    if response and (len(payload) != length or hashlib.sha1(payload).hexdigest() != sha1):
                        raise ValueError("damaged payload")
                    page, refers = h["X-Page-Id"], h.get("X-Refers-To-Page")
                    rows.append((int(page) if page else None, length, sha1, h["WARC-Type"], int(refers) if refers else None, h["WARC-Target-URI"], payload.decode() if response else None))
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    return files.mapInArrow(read, schema)


def archive_and_read(pages: DataFrame, **kw) -> DataFrame:
    """Write the pages to a new archive in the shared folder and read it back."""
    uri = f"{shared_dir(pages.sparkSession)}/archive-{uuid.uuid4().hex}"
    write_archive(pages, uri, **kw)
    return read_archive(pages.sparkSession, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
