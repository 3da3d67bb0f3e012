"""Removal of lines that many documents hold, through a sharded minimal perfect hash of line counts.

A line's key is the line without [\x20\x09-\x0D] at both ends and with A-Z in lower case.  Slabs of
documents send each shard (a range of 64-bit key hashes) one row with their distinct hashes and, for each,
the number of their documents that hold it: the count is aggregated before the shuffle, and a line that
fills the corpus costs one entry a slab.  A shard builds a minimal perfect hash over its distinct hashes,
which indexes an array of 16-bit fingerprints and an array of document counts (held at the threshold, in
one byte or as many as it needs).  These arrays are written as a table, the index.  Each slab's hashes then probe
the arrays of their shard, and the ones to drop return to the slab: lines are never joined.

Defined results: null text is one empty line, as is empty text; keys of fewer than min_chars code points
are always kept; repeated rows of one doc_id count as one document and are each answered; rows without
doc_id count as one document; an empty table gives an empty result; other columns pass through `drop_lines`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runs import bits_for, free_name, pack, settle, split, text_size, unpack
from ._text import U, mix, to_bytes
from .perfect_hash import PerfectHash

_SPACE = b" \t\n\x0b\x0c\r"
SLAB_BYTES = 12 << 20
SHARD_LINES = 2_000_000

_RUN = pa.schema([("shard", pa.int64()), ("slab", pa.int64()), ("run", pa.binary()), ("docs", pa.binary())])
_RUN_DDL = "shard long, slab long, run binary, docs binary"
_INDEX = pa.schema([("shard", pa.int64()), ("n_lines", pa.int64()), ("hash", pa.binary()), ("fingerprints", pa.binary()), ("counts", pa.binary())])
_INDEX_DDL = "shard long, n_lines long, hash binary, fingerprints binary, counts binary"
_BACK = pa.schema([("slab", pa.int64()), ("run", pa.binary())])
_BACK_DDL = "slab long, run binary"


def _table(schema, rows):
    return pa.table({f.name: pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)}, schema=schema)


def _fingerprint(keys):
    return (mix(keys ^ U(0x5851F42D4C957F2D)) >> U(48)).astype(np.uint16)


def _count_type(threshold: int):
    return np.uint8 if threshold < 256 else np.uint16 if threshold < 65536 else np.uint32


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _key_hashes(text: bytes, min_chars: int) -> list[int]:
    """Hash of each line's key; 0 stands for keys that are too short to drop."""
    out = []
    for line in text.split(b"\n"):
        key = line_key(line)
        short = len(key) < min_chars or (min_chars > 1 and len(key.decode()) < min_chars)
        out.append(0 if short else xxhash.xxh3_64_intdigest(key) or 1)
    return out


def _slabbed(docs: DataFrame, id_col: str, text_col: str, slab_bytes: int):
    n, size = text_size(docs, text_col)
    slabs = max(1, -(-size // slab_bytes), -(-n // 200_000))
    name = free_name(docs, "slab")
    return docs.withColumn(name, F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(slabs))), name, size


def _index_runs(placed: DataFrame, slab: str, id_col: str, text_col: str, min_chars: int, bits: int) -> DataFrame:
    def send(key, table):
        ids, texts = table["id"].to_pylist(), to_bytes(table["text"])
        number = {}
        hashes, docs = [], []
        for i, t in zip(ids, texts):
            own = {h for h in _key_hashes(t, min_chars) if h}
            hashes += own
            docs += [number.setdefault(i, len(number))] * len(own)
        if not hashes:
            return _table(_RUN, [])
        h, d = np.array(hashes, U), np.array(docs, np.int64)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])  # repeated rows of one id
        h, n = np.unique(h[fresh], return_counts=True)
        return _table(_RUN, [(b, key[0].as_py(), pack(h[part]), n[part].astype("<u4").tobytes()) for b, part in split(h, bits)])

    thin = placed.select(F.col(slab).alias("slab"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return thin.groupBy("slab").applyInArrow(send, _RUN_DDL)


def build_index(runs: DataFrame, threshold: int) -> DataFrame:
    """One row a shard: the perfect hash, and the fingerprint and count arrays that it indexes."""
    kind = _count_type(threshold)

    def build(key, table):
        parts = [unpack(r) for r in table["run"].to_pylist()]
        count = np.concatenate([np.frombuffer(c, "<u4") for c in table["docs"].to_pylist()]).astype(np.int64)
        lines, back = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(back, count).astype(np.int64)
        ph = PerfectHash.build(lines)
        at = ph.index(lines)
        prints, counts = np.zeros(ph.n, np.uint16), np.zeros(ph.n, kind)
        prints[at], counts[at] = _fingerprint(lines), np.minimum(total, threshold)
        return _table(_INDEX, [(key[0].as_py(), ph.n, ph.to_bytes(), prints.tobytes(), counts.tobytes())])

    return runs.groupBy("shard").applyInArrow(build, _INDEX_DDL)


def _probe(runs: DataFrame, index: DataFrame, threshold: int) -> DataFrame:
    kind = _count_type(threshold)

    def probe(key, sent, shard):
        if not sent.num_rows or not shard.num_rows:
            return _table(_BACK, [])
        ph = PerfectHash.from_bytes(shard["hash"][0].as_py())
        prints = np.frombuffer(shard["fingerprints"][0].as_py(), np.uint16)
        counts = np.frombuffer(shard["counts"][0].as_py(), kind)
        rows = []
        for slab, run in zip(sent["slab"].to_pylist(), sent["run"].to_pylist()):
            h = unpack(run)
            at = ph.index(h)
            drop = h[(at >= 0) & (prints[at] == _fingerprint(h)) & (counts[at] >= threshold)]
            if len(drop):
                rows.append((slab, pack(drop)))
        return _table(_BACK, rows)

    return runs.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(probe, _BACK_DDL)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, min_docs: int = 10, report: bool = False, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """The documents with their frequent lines dropped; with report, instead per document: doc_id, n_lines, n_dropped, kept_sha256.

    A document whose lines all go keeps its row, with an empty text; null text with nothing to drop stays null.
    """
    placed, slab, size = _slabbed(docs, id_col, text_col, slab_bytes)
    bits = bits_for(size / 40, SHARD_LINES)
    runs = settle(_index_runs(placed, slab, id_col, text_col, max(1, min_chars), bits), "line-runs", free=True)
    index = settle(build_index(runs, min_docs), "line-index")
    back = _probe(runs, index, min_docs)
    kept_type = docs.schema
    if report:
        ddl = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
        placed = placed.select(F.col(slab), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
        names, text_name = ["doc_id"], "__text"
        schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
    else:
        ddl, names, text_name, schema = kept_type, docs.columns, text_col, None

    def cut(key, table, returned):
        if not table.num_rows:
            return table.select(names) if schema is None else schema.empty_table()
        drop = set().union(*(unpack(r).tolist() for r in returned["run"].to_pylist()))
        n_lines, n_dropped, digests, out = [], [], [], []
        nulls = table[text_name].is_null().to_pylist()
        for t, null in zip(to_bytes(table[text_name]), nulls):
            lines = t.split(b"\n")
            stay = [x for x, h in zip(lines, _key_hashes(t, max(1, min_chars))) if h not in drop] if drop else lines
            kept = t if len(stay) == len(lines) else b"\n".join(stay)
            if schema is None:
                out.append(None if null else kept.decode())
            else:
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                digests.append(hashlib.sha256(kept).hexdigest())
        if schema is None:
            k = table.schema.get_field_index(text_name)
            return table.set_column(k, table.schema.field(k), pa.chunked_array([pa.array(out, type=table.schema.field(k).type)])).select(names)
        return pa.table([table["doc_id"].cast(pa.int64()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())], schema=schema)

    return placed.groupBy(slab).cogroup(back.groupBy("slab")).applyInArrow(cut, ddl)
