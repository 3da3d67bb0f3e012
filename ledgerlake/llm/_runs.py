"""Exchange of sorted hash runs between document slabs and hash buckets, and written tables that cut lineage.

A slab is a set of whole documents of bounded size.  Instead of one row per hash, a slab sends each
bucket (a range of hash values) one row with its distinct hashes, sorted, delta coded and compressed:
a few bytes a hash, and a hash that fills a third of the corpus is still sent once a slab.
"""

from __future__ import annotations

import gc
import math
import time
import uuid

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder as shared_dir

U = np.uint64


def distinct(values):
    """The distinct values, sorted: one sort, which is many times faster here than numpy's hashed unique."""
    s = np.sort(values)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def pack(values) -> bytes:
    """Sorted uint64 values as compressed byte planes of their differences."""
    v = np.asarray(values, U)
    d = np.diff(v, prepend=U(0))
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


def split(values, bits: int):
    """(bucket, slice) of sorted uint64 values by their leading bits."""
    if not len(values):
        return
    if not bits:
        yield 0, slice(0, len(values))
        return
    top = (values >> U(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(top)) + 1
    for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]])):
        yield int(top[a]), slice(int(a), int(b))


def bits_for(n: float, per_bucket: float) -> int:
    return max(0, math.ceil(math.log2(max(1.0, n / per_bucket))))


def settle(df: DataFrame, what: str, free: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation.

    free: what was shuffled for it is large and goes at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if free:
        release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def text_size(docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text)))).first()
    return n, size or 0


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name
