import hashlib
import random
import zlib

import pytest

from ledgerlake.llm import merkle_manifest
from ledgerlake.llm.merkle_manifest import build, checked, leaf_of
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, known string, item int, at int, name string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def levels(nodes):
    """All levels from the leaves to the single top node."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        if (at ^ 1) < len(level):
            out.append((level[at ^ 1], at & 1))
        else:
            out.append((None, 0))
        at //= 2
    return out


def fold(h, path):
    for other, right in path:
        h = H(h) if other is None else H(other, h) if right else H(h, other)
    return h


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, docs = {}, {}
    for lang in langs:
        docs[lang] = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1])))
        trees[lang] = levels([leaf(r[0], r[3], r[2], r[4], r[1]) for r in docs[lang]])
    over = levels([trees[lang][-1][0] for lang in langs])
    root, out = over[-1][0], []
    for k, lang in enumerate(langs):
        for at, (i, text, _, source, n) in enumerate(docs[lang]):
            path = siblings(trees[lang], at) + siblings(over, k)
            mine = trees[lang][0][at]
            hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
            now = fold(leaf(i, source, lang, n + 1, text) if hit else mine, path)
            out.append((i, mine, trees[lang][-1][0], root, H(*(s for s, _ in path if s)), now, now == root))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n, "x", 3, 4, "y") for i, t, lang, s, n in rows], SCHEMA)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


def some(n, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(10**6), rng.choice(["", "a b", "é" * 5, None, f"text {k}"]), rng.choice(["en"] * 8 + ["fr", None, "", "Ä", "zz"]), rng.choice(["s", None]), rng.choice([None, k])) for k in range(n)]


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_against_brute_force(spark, monkeypatch, bits):
    """Blocks of two nodes make as many rounds as there are levels; small ranges make many."""
    monkeypatch.setattr(merkle_manifest, "BLOCK_BITS", bits)
    monkeypatch.setattr(merkle_manifest, "_LEVELS", merkle_manifest._LEVELS.replace("sequence(1, 8)", f"sequence(1, {bits})"))
    monkeypatch.setattr(merkle_manifest, "RANGE_ROWS", 40)
    rows = some(150 if bits == 1 else 700)
    rows += [(7, "same", "en", "s", 1)] * 9 + [(7, "other", "en", "s", 1), (None, "x", "en", "s", 1), (None, None, None, None, None), (5, "long " * 200_000, "de", "s", 10**12)]
    assert got(checked(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_few_rows(spark, n):
    rows = [(k, f"t{k}", "en", "s", k) for k in range(n)]
    assert got(checked(frame(spark, rows))) == brute(rows)


def test_empty(spark):
    assert checked(frame(spark, [(1, "a", "en", "s", 1)]).limit(0)).count() == 0


def test_stored_parents(spark):
    """Every stored preimage is the concatenation of its children, and hashes to its own node of the level above."""
    rows = [(k, f"t{k}", "en" if k % 5 else "fr", "s", k) for k in range(1000)]
    leaves = frame(spark, rows).select("lang", "doc_id", leaf_of(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))).alias("leaf"))
    m = build(leaves, "lang", "doc_id", "leaf")
    found = {(r["name"], r.level, r.node): (r.preimage, r.hash) for r in m.groups.nodes().collect()}
    want = {}
    for lang in ("en", "fr"):
        tree = levels([leaf(i, s, g, n, t) for i, t, g, s, n in rows if g == lang])
        for up, (below, above) in enumerate(zip(tree, tree[1:]), 1):
            want |= {(lang, up, k): ("".join(below[2 * k : 2 * k + 2]), h) for k, h in enumerate(above)}
    assert found == want
