"""Removal of byte strings that an earlier document holds too, by difference-cover suffix names.

A difference cover D of the residues mod v has, for any two positions, a shift below v that takes both
into the cover.  A string of `length` bytes found at two places therefore has a common suffix of at
least length - v + 1 bytes that starts at a sampled position of both.  Sampled positions are named by
triples of 8-byte words, strings of full length by triples of more words.  This is the cover of a
difference-cover suffix sort without its ranks: names are 64-bit fingerprints, so there is no global sort, no
recursion on ranks and no merge of the remaining suffixes, only the question which names are equal.

Distributed form: slabs are ranges of doc_id, so that of two slabs the lower holds the smaller ids.
Sorted runs of sampled names go to buckets (ranges of names), which return to each slab a bit for each name:
whether another slab holds it too.  Only starts that have a shared sampled name within reach are merged: their
full-length names go the same way, and a bucket flags a name for every slab above the lowest that holds it.  Within a slab the same comparison is made directly.  No pairs are made; a string that stands in a
third of all documents is one entry of each slab's run.

Defined results: null text is empty; a row without doc_id counts as larger than every id (it removes
nothing); rows with the same doc_id never match each other, and each is answered; strings shorter than
`length` bytes are kept; a whole text that a smaller doc_id has is recognised by its digest and removed
outright; very long texts are one slab and are taken whole; an empty table gives an empty result; other columns are ignored.

Full-length names are 64 bits and are not compared byte by byte: of m merged starts some m^2 / 2^65 are taken for another's and
their bytes wrongly removed, which is about 3 at 30 GB if all 10^10 starts are merged, and 10^7 at 100 TB.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runs import bits_for, distinct, pack, settle, split, text_size, unpack
from ._text import U, mix, to_bytes

#: Perfect difference sets: modulus and residues.
COVERS = {21: (3, 6, 7, 12, 14), 13: (0, 1, 3, 9), 7: (1, 2, 4), 3: (1, 2)}
SLAB_BYTES = 10 << 20
BUCKET_NAMES = 3_000_000
_K = U(0x9E3779B97F4A7C15)


def _cover(length: int) -> int:
    return next((v for v in COVERS if length - v + 1 >= 24), 3)


def _fold(word, at, offsets):
    h = np.full(len(at), len(offsets), U)
    for o in offsets:
        h ^= word[at + o]
        h *= _K
        h ^= h >> U(29)
    return h


def _triple(word, at, size: int):
    """Name of a sampled suffix by the triple of 8-byte words at the begin, middle and end of its first `size` bytes."""
    return _fold(word, at, (0, (size - 8) // 2, size - 8))


def _full(word, at, size: int):
    """Name of data[at:at + size]: the triples of names again, over words that leave no byte out."""
    offsets = [*range(0, size - 8, 8), size - 8]
    return mix(_fold(word, at, offsets))


class _Slab:
    """The documents of one range of ids, in order of id."""

    def __init__(self, ids, texts: list[bytes], length: int):
        order = np.argsort(ids, kind="stable")
        self.order, self.length = order, length
        texts = [texts[k] for k in order]
        _, self.rank = np.unique(ids[order], return_inverse=True)  # rows of one id share a rank
        self.texts = texts
        size = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(size)])
        data = b"".join(texts) + bytes(length + 8)
        self.word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        self.digest = np.array([hashlib.blake2b(t, digest_size=16).digest() if len(t) >= length else b"" for t in texts], object)
        seen: dict[bytes, int] = {}
        self.copy = np.zeros(len(texts), bool)  # whole text of a smaller id
        for k, d in enumerate(self.digest):
            if d:
                self.copy[k] = seen.setdefault(d, self.rank[k]) < self.rank[k]

    def sampled(self):
        """Sampled positions with their document and name."""
        v = _cover(self.length)
        reach = self.length - v + 1
        room = np.maximum(np.diff(self.starts) - reach + 1, 0)
        turns = -(-room // v)
        first = np.cumsum(turns) - turns
        doc = np.repeat(np.arange(len(room), dtype=np.int32), turns)
        at = (np.arange(len(doc)) - first[doc]) * v
        at = (at[:, None] + np.array(COVERS[v])).ravel()
        doc = np.repeat(doc, len(COVERS[v]))
        fits = at < room[doc]
        doc = doc[fits]
        at = at[fits] + self.starts[doc]
        return at, doc, _triple(self.word, at, reach)

    def merged(self, at, doc, name, shared):
        """Starts with a shared sampled name within reach, their document and full-length name."""
        v = _cover(self.length)
        hit = _in(name, shared)
        hit &= ~self.copy[doc]
        at, doc = at[hit], doc[hit]
        step = np.zeros(int(self.starts[-1]) + 1, np.int32)
        np.add.at(step, np.maximum(at - v + 1, self.starts[doc]), 1)
        np.add.at(step, at + 1, -1)
        start = np.flatnonzero(np.cumsum(step)[:-1] > 0)
        doc = np.searchsorted(self.starts, start, side="right") - 1
        fits = start + self.length <= self.starts[doc + 1]
        start, doc = start[fits], doc[fits]
        return start, doc, _full(self.word, start, self.length)

    def later(self, name, doc):
        """True where a smaller id of this slab has the same name."""
        out = np.zeros(len(name), bool)
        some = np.flatnonzero(_in(name, _twice(name)))
        if len(some):
            sub = name[some]
            order = np.argsort(sub)
            s, r = sub[order], self.rank[doc[some[order]]]
            first = np.concatenate([[True], s[1:] != s[:-1]])
            low = np.minimum.reduceat(r, np.flatnonzero(first))
            out[some[order]] = r > low[np.cumsum(first) - 1]
        return out


def _twice(name):
    """The values that occur more than once, sorted."""
    s = np.sort(name)
    again = s[1:][s[1:] == s[:-1]]
    return again[np.concatenate([[True], again[1:] != again[:-1]])] if len(again) else again


def _in(values, held):
    """Membership in a sorted array, most misses settled by a bitmap that fits the cache."""
    if not len(held) or not len(values):
        return np.zeros(len(values), bool)
    fold = lambda x: (x * U(0xC2B2AE3D27D4EB4F) >> U(40)).astype(np.int64)
    bitmap = np.zeros(1 << 24, bool)
    bitmap[fold(held)] = True
    out = bitmap[fold(values)]
    maybe = np.flatnonzero(out)
    v = values[maybe]
    at = np.minimum(np.searchsorted(held, v), len(held) - 1)
    out[maybe] = held[at] == v
    return out


def _batch(schema, **cols):
    return pa.table({k: pa.array(v, type=schema.field(k).type) for k, v in cols.items()}, schema=schema)


_RUN = pa.schema([("bucket", pa.int64()), ("slab", pa.int64()), ("kind", pa.int32()), ("run", pa.binary())])
_RUN_DDL = "bucket long, slab long, kind int, run binary"
_BACK = pa.schema([("slab", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("flags", pa.binary())])
_BACK_DDL = "slab long, kind int, bucket long, flags binary"


def _digests(slab: _Slab):
    """Distinct digests in order, and their leading 64 bits."""
    d = np.array(sorted({d for d in slab.digest if d}), "S16")
    return d, np.array([int.from_bytes(x.ljust(16, b"\0")[:8], "big") for x in d.tolist()], U)


def _out_runs(slab: int, names, digests, bits: int):
    rows = [(b, slab, 0, pack(names[part])) for b, part in split(names, bits)]
    if digests is not None:
        d, top = digests
        rows += [(b, slab, 1, b"".join(x.ljust(16, b"\0") for x in d[part].tolist())) for b, part in split(top, bits)]
    return _batch(_RUN, **{k: [r[n] for r in rows] for n, k in enumerate(("bucket", "slab", "kind", "run"))})


def _read_slab(table: pa.Table, length: int) -> _Slab:
    return _Slab(np.asarray(table["id"]), to_bytes(table["text"]), length)


def _flagged(values, top, back: pa.Table, kind: int, bits: int):
    """Those of the values that a slab has sent which the buckets have flagged: a bit a value comes back."""
    reply = {b: f for k, b, f in zip(back["kind"].to_pylist(), back["bucket"].to_pylist(), back["flags"].to_pylist()) if k == kind}
    out = np.zeros(len(values), bool)
    for b, part in split(top, bits):
        n = part.stop - part.start
        out[part] = np.unpackbits(np.frombuffer(reply[b], np.uint8), count=n)
    return values[out]


def _meet(first_kind: int):
    """Bucket side: compare neighbours in the order by name, and flag for each slab the names that others hold.

    first_kind 0: sampled names, flagged for every slab of several.  Digests, and full names (first_kind 2), are flagged
    for every slab above the lowest that holds them.
    """

    def meet(table: pa.Table) -> pa.Table:
        rows = []
        slabs, kinds, runs = (table[c].to_pylist() for c in ("slab", "kind", "run"))
        for kind in (0, 1):
            own = [(s, r) for s, k, r in zip(slabs, kinds, runs) if k == kind]
            if not own:
                continue
            own.sort(key=lambda x: x[0])  # by slab, so that a stable order by name has the lowest slab first
            parts = [unpack(r) if kind == 0 else np.frombuffer(r, "S16") for _, r in own]
            name = np.concatenate(parts)
            ends = np.cumsum([len(p) for p in parts])
            del parts
            order = np.argsort(name, kind="stable")
            s = name[order]
            same = s[1:] == s[:-1]
            hit = np.zeros(len(s), bool)
            hit[1:] |= same
            if kind == 0 and first_kind == 0:
                hit[:-1] |= same
            flags = np.zeros(len(s), bool)
            flags[order] = hit
            bucket = table["bucket"][0].as_py()
            for (slab, _), a, b in zip(own, [0, *ends[:-1]], ends):
                rows.append((slab, kind or first_kind, bucket, np.packbits(flags[a:b]).tobytes()))
        return _batch(_BACK, **{k: [r[n] for r in rows] for n, k in enumerate(("slab", "kind", "bucket", "flags"))})

    return meet


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, with_text: bool = False, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, if with_text)."""
    if length < 10:
        raise ValueError("length must be at least 10 bytes")
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, size = text_size(base, "text")
    slabs = max(1, -(-size // slab_bytes))
    edges = sorted(set(base.approxQuantile("id", [k / slabs for k in range(1, slabs)], 0.2 / slabs))) if slabs > 1 and n else []
    edges = [min(int(e), 2**63 - 1) for e in edges]
    cover = COVERS[_cover(length)]
    bits = bits_for(size * len(cover) / _cover(length), BUCKET_NAMES)
    keep = min(64, max(40, int(np.log2(size + 1)) + 13))  # leading bits of a sampled name; a chance hit only costs a comparison
    mask = U(((1 << keep) - 1) << (64 - keep))
    if edges:
        bounds = spark.sparkContext.broadcast(np.array(edges, np.int64))  # one number a slab

        @F.pandas_udf("long")
        def slab_of(ids):
            import pandas as pd

            return pd.Series(np.searchsorted(bounds.value, ids.to_numpy(), side="left").astype(np.int64))

        placed = base.withColumn("slab", slab_of("id"))
    else:
        placed = base.withColumn("slab", F.lit(0).cast("long"))

    def send_samples(key, table):
        s = _read_slab(table, length)
        _, _, name = s.sampled()
        return _out_runs(key[0].as_py(), distinct(name & mask), _digests(s), bits)

    def merged(table, back):
        """The slab with its whole-text copies marked, and the merged starts of its other documents."""
        s = _read_slab(table, length)
        whole = set(_flagged(*_digests(s), back, 1, bits).tolist())
        s.copy |= np.array([bool(d) and d.rstrip(b"\0") in whole for d in s.digest], bool)
        at, doc, name = s.sampled()
        name &= mask
        order = np.sort(name)
        again = np.concatenate([[False], order[1:] == order[:-1]])
        names = order[~again]
        return s, s.merged(at, doc, name, distinct(np.concatenate([_flagged(names, names, back, 0, bits), order[again]])))

    def send_merged(key, table, back):
        _, (_, _, name) = merged(table, back)
        return _out_runs(key[0].as_py(), distinct(name), None, bits)

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        fields.append(("kept", pa.binary()))
        ddl += ", kept binary"
    schema = pa.schema(fields)

    def cut(key, table, back):
        s, (start, doc, name) = merged(table, back)
        names = distinct(name)
        gone = _in(name, _flagged(names, names, back, 2, bits)) | s.later(name, doc)
        step = np.zeros(int(s.starts[-1]) + 1, np.int32)
        np.add.at(step, start[gone], 1)
        np.add.at(step, start[gone] + length, -1)
        covered = np.cumsum(step)[:-1] > 0
        out = {k: [] for k in schema.names}
        ids = table["doc_id"].to_pylist()
        for k, t in enumerate(s.texts):
            c = covered[s.starts[k] : s.starts[k + 1]]
            if s.copy[k]:
                removed, spans, kept = len(t), 1, b""
            else:
                removed = int(c.sum())
                spans = int(c[0]) + int((c[1:] & ~c[:-1]).sum()) if removed else 0
                kept = np.frombuffer(t, np.uint8)[~c].tobytes() if removed else t
            row = (ids[s.order[k]], len(t), removed, spans, hashlib.sha256(kept).hexdigest(), kept)
            for name_, x in zip(schema.names, row):
                out[name_].append(x)
        return _batch(schema, **out)

    shared = settle(placed.groupBy("slab").applyInArrow(send_samples, _RUN_DDL).groupBy("bucket").applyInArrow(_meet(0), _BACK_DDL), "shared-names", free=True)
    full = settle(placed.groupBy("slab").cogroup(shared.groupBy("slab")).applyInArrow(send_merged, _RUN_DDL).groupBy("bucket").applyInArrow(_meet(2), _BACK_DDL), "repeats", free=True)
    back = shared.unionByName(full)
    return placed.groupBy("slab").cogroup(back.groupBy("slab")).applyInArrow(cut, ddl)
