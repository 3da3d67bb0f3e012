import hashlib
import random

import pytest

from ledgerlake.llm.suffix_dedup import COVERS, remove_repeats

SCHEMA = "doc_id long, text string, slab string, id string, bucket int"


def brute(rows, length=50):
    """Every `length`-byte string and the smallest id that holds it."""
    low = {}
    texts = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            low[s] = min(low.get(s, i), i)
    out = []
    for (given, _), (i, t) in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if low[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((given, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in remove_repeats(df, **kw).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("slab_bytes", [1 << 20, 900])
def test_against_brute_force(spark, slab_bytes):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6))) for _ in range(40)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = text(30)
    rows = [(k * 7 % 31, text(rnd.randint(0, 40))) for k in range(31)]
    rows += [(100 + k, text(8) + passage[k : k + 49 + k % 5] + text(5)) for k in range(12)]
    rows += [(200, passage), (201, passage), (201, passage), (3, passage[:50]), (202, passage[:49]), (203, passage[:51])]
    rows += [(None, passage), (None, passage + "q"), (300, None), (301, ""), (302, "ab" * 400), (303, "ba" * 200)]
    assert run(spark, rows, slab_bytes=slab_bytes) == brute(rows)


def test_other_lengths(spark):
    rows = [(1, "abcdefghijklmnopqrstuvwxyz"), (2, "xxcdefghijklmnopyy"), (3, "klmnopqrstuv")]
    for n in (10, 12, 24):
        assert run(spark, rows, length=n) == brute(rows, n)


def test_empty_and_text(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "é" * 40), (2, "z" + "é" * 40)], "doc_id long, text string")
    assert [bytes(r.kept) for r in remove_repeats(df, with_text=True).orderBy("doc_id").collect()] == ["é".encode() * 40, b"z"]


def test_covers():
    for v, d in COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))
