"""Vectorised text primitives shared by the corpus operators.

A chunk is a few megabytes of whole documents laid end to end with one line feed after each, so that
words and lines never cross documents.  Hashes are 64-bit polynomial hashes over a fixed random byte
table, finalised by an avalanche step; equal byte strings have equal hashes in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: [\x20\x09-\x0D]
WS = np.zeros(256, bool)
WS[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x):
    """Avalanche of uint64 values."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


TABLE = mix(np.arange(1, 257, dtype=U) * U(_BASE))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(1 << max(19, (n - 1).bit_length()), base, U)
        p[0] = 1
        have = np.cumprod(p, dtype=U)
        if n <= 2 * CHUNK:
            _powers[name] = have
    return have


class Chunk:
    """Whole documents as one byte array: document k is data[starts[k]:starts[k + 1] - 1]."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)

    def words(self):
        """First byte, end and document of every run of other bytes than white space."""
        ws = WS[self.data]
        edge = np.flatnonzero(ws[1:] != ws[:-1]) + 1
        if not ws[0]:
            edge = np.concatenate([[0], edge])
        begin, end = edge[0::2], edge[1::2]
        return begin, end, self.doc_of(begin)

    def lines(self):
        """First byte, end and document of every \\n-split line; an empty document has one empty line."""
        end = np.flatnonzero(self.data == 10)
        begin = np.concatenate([[0], end[:-1] + 1])
        return begin, end, self.doc_of(begin)

    def doc_of(self, at):
        return np.searchsorted(self.starts, at, side="right") - 1

    def hashes(self, begin, end, lower: bool = False):
        """64-bit hash of each data[begin:end]."""
        n = len(self.data)
        table = TABLE[LOWER] if lower else TABLE
        total = np.concatenate([np.zeros(1, U), np.cumsum(table[self.data] * _power("up", _BASE, n)[:n], dtype=U)])
        raw = (total[end] - total[begin]) * _power("down", _INV, n + 1)[begin]
        return mix(raw + (end - begin).astype(U) * U(0xD6E8FEB86659FD93))

    def per_doc(self, flags):
        """Sum over each document of one number per byte."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.starts[1:]] - total[self.starts[:-1]]


def to_bytes(column) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


#: Rows whose texts are held as Python objects at a time.
ROWS = 1000


def parts_of(batches):
    """The batches in parts of at most ROWS rows."""
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            yield batch.slice(begin, ROWS)


def chunked(batches, text: str, size: int = CHUNK):
    """(rows, Chunk) for runs of rows of about `size` bytes of text; one longer document stands alone."""
    for batch in parts_of(batches):
        texts = to_bytes(batch.column(batch.schema.get_field_index(text)))
        first = held = 0
        for k, t in enumerate(texts):
            if held and held + len(t) > size:
                yield batch.slice(first, k - first), Chunk(texts[first:k])
                first, held = k, 0
            held += len(t) + 1
        if first < len(texts):
            yield batch.slice(first), Chunk(texts[first:])


def first_of(*keys):
    """Order that sorts by keys (first key leads) and, along it, where a new combination begins."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, new


def windows(values, docs, n: int):
    """Hash of each n consecutive values of one document, and the index of the first."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.zeros(m, U)
    for k in range(n):
        h = h * U(_BASE) + values[k : k + m]
    at = np.flatnonzero(docs[:m] == docs[n - 1 :])
    return mix(h[at]), at
