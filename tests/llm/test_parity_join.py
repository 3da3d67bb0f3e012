import random
import re

import numpy as np
import pytest

from ledgerlake.llm.parity_join import Bands, keep_one, link_components

SCHEMA = "doc_id long, text string, rep string, keys int, component string"


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both) or rows[i][0] == rows[j][0]:
                up[root(i)] = root(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return sorted(((i, len(s), None if i is None else low[root(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5)))
    rows, i = [], 0
    for size in (1, 2, 3, 5, 8, 13, 20, 40, 80, 150, 300):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for _ in range(6):
                own = list(base)
                for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
                    own[rnd.randrange(len(own))] = word()
                if rnd.random() < 0.3:
                    own += [word()]
                rows.append((i * 37 % 1009, ("\t " if rnd.random() < 0.5 else "\n").join(own).upper() if rnd.random() < 0.2 else " ".join(own)))
                i += 1
    rows += [(2000, None), (2001, ""), (2002, " \n "), (None, rows[-1][1]), (None, None), (2003, rows[0][1]), (2003, rows[0][1])]
    return rows


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_against_brute_force(spark, n, num, den):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "r", 1, "c") for i, t in rows], SCHEMA)
    assert sorted((tuple(r) for r in link_components(df, n=n, num=num, den=den).collect()), key=str) == brute(rows, n, num, den)


def test_chain_and_one_id_with_two_texts(spark):
    w = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(w[k * 3 : k * 3 + 100])) for k in range(30)] + [(90, " ".join(w[:100])), (90, "quite another text of its own here")]
    rows += [(91, "quite another text of its own here")]
    df = spark.createDataFrame([(i, t, "r", 1, "c") for i, t in rows], SCHEMA)
    assert sorted((tuple(r) for r in link_components(df, n=3, num=90, den=100).collect()), key=str) == brute(rows, 3, 90, 100)


def test_pigeonhole_holds():
    """Any two sets at the limit of similarity have t keys of their band in common."""
    rnd = np.random.default_rng(1)
    for num, den in ((90, 100), (80, 100)):
        bands = Bands(num, den)
        for size in (11, 19, 40, 95, 300, 700):
            for _ in range(20):
                apart = 2 * size * (den - num) // (den + num)
                pool = np.unique(rnd.integers(0, 2**64, size + apart, np.uint64))
                a, b = pool[: size - apart // 2 + 0], pool[apart - apart // 2 :][:size]
                both = len(np.intersect1d(a, b))
                if not len(a) or den * both < num * (len(a) + len(b) - both):
                    continue
                key, place, slack = bands.keys(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]))
                assert slack[0] == slack[2]
                assert len(a) == len(b) == both or np.intersect1d(key[place == 0], key[place == 2]).size >= slack[0]


def test_frequent_parts_lose_no_link(spark):
    """A passage that all documents share fills parts of all of them; near copies among them are still found."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    passage, rows = [word() for _ in range(60)], []
    for k in range(60):
        own = [word() for _ in range(rnd.choice([30, 60, 90]))]
        for j in range(rnd.choice([1, 1, 3])):
            near = list(own)
            near[rnd.randrange(len(near))] = word()
            rows.append((k * 10 + j, " ".join((near if j else own) + passage)))
    for slabs in (10 << 20, 4000):
        patched = pytest.MonkeyPatch()
        patched.setattr("ledgerlake.llm.parity_join.SLAB_BYTES", slabs)
        df = spark.createDataFrame([(i, t, "r", 1, "c") for i, t in rows], SCHEMA)
        assert sorted((tuple(r) for r in link_components(df).collect()), key=str) == brute(rows, 5, 80, 100)
        patched.undo()


def test_keep_one(spark):
    t = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(5, t, "a", 1, "x"), (3, t.upper(), "b", 2, "y"), (3, t.upper(), "b", 2, "y"), (9, None, None, None, None), (None, t, "q", 1, "z"), (None, t, "q", 1, "z")], SCHEMA)
    out = keep_one(df)
    assert out.schema == df.schema
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect()) == [(False, 0), (False, 0), (True, 3), (True, 9)]
    assert keep_one(df.limit(0)).count() == 0 and link_components(df.limit(0)).count() == 0
