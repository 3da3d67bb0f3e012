import random
import re

import pytest

from ledgerlake.operators import clustering as C
from ledgerlake.operators import containment as K
from pyspark.sql import functions as F

SCHEMA = "block long, page long, sents array<string>, sents_of string, rep int"


def usable(sents):
    out = set()
    for s in sents or []:
        s = re.sub(r"\s+", " ", re.sub(r"[^\w\s]+", " ", (s or "").lower())).strip()
        if len(s) >= 25:
            out.add(s)
    return out


def brute_pairs(rows):
    sets = [(b, p, usable(s)) for b, p, s, *_ in rows]
    sets = [x for x in sets if x[2]]
    out = {}
    for i, (b, p, s) in enumerate(sets):
        for c, q, t in sets[:i]:
            if b == c and s & t:
                out[b, min(p, q), max(p, q)] = (len(s & t) / min(len(s), len(t)), len(s & t) / len(s | t))
    return sets, out


def stories(seed=2, n=160):
    r = random.Random(seed)
    pool = [f"Sentence number {k} of a story, told at some length!" for k in range(60)]
    rows = []
    for k in range(n):
        own = r.sample(pool, r.randrange(1, 7)) if r.random() < 0.7 else list(rows[r.randrange(len(rows))][2] or ["x"]) if rows else ["x"]
        rows.append((k % 3, k, [*own, "Too short", None, own[0].upper()], "x", 1))
    return rows + [(1, 900, None, None, None), (1, 901, [], None, None), (2, 902, ["short"], None, None)]


def test_pairs_and_greatest(spark):
    rows = stories()
    sets, want = brute_pairs(rows)
    firsts, members = K.representatives(spark.createDataFrame(rows, SCHEMA), "block", "page", F.col("sents"))
    rep = {(r.block, r.page): r.rep for r in members.collect()}
    assert set(rep) == {(b, p) for b, p, _ in sets}
    for least in (0.1, 0.3, 0.7, 1.0):
        found = {(r.block, r.a, r.b): (r.containment, r.jaccard) for r in K.containment_pairs(firsts, least).collect()}
        pairs = {k: v for k, v in want.items() if v[0] >= least - 1e-9 and rep[k[0], k[1]] == k[1] and rep[k[0], k[2]] == k[2]}
        assert found.keys() == pairs.keys() and all(found[k] == pytest.approx(pairs[k]) for k in pairs)
    best = {}
    for (b, p, q), (c, _) in want.items():
        for x in (p, q):
            best[b, x] = max(best.get((b, x), 0), c)
    got = {(r.block, r.rep): r.containment for r in K.greatest_overlap(firsts, K.containment_pairs(firsts, 0.1)).collect()}
    for (b, p), head in rep.items():
        assert got[b, head] == pytest.approx(best.get((b, p), 0)) or best.get((b, p), 0) < 0.1


def groups(sets, pairs, least):
    low = {(b, p): p for b, p, _ in sets}
    moved = True
    while moved:
        moved = False
        for (b, p, q), (c, _) in pairs.items():
            m = min(low[b, p], low[b, q])
            if c >= least - 1e-9 and (low[b, p] != m or low[b, q] != m):
                low[b, p] = low[b, q] = m
                moved = True
    return low


def test_forest_gives_the_groups_of_every_threshold(spark):
    rows = stories(7)
    sets, want = brute_pairs(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    firsts, members = K.representatives(df, "block", "page", F.col("sents"))
    forest = K.strongest_forest(K.containment_pairs(firsts, 0.3))
    n, nodes = forest.count(), firsts.count()
    assert 0 < n < nodes
    for tenth in (3, 5, 7, 9):
        comp = {(r.block, r.id): r.component for r in K.groups_at(forest, tenth / 10).collect()}
        low = groups(sets, want, tenth / 10)
        for r in members.collect():
            assert low[r.block, comp.get((r.block, r.rep), r.rep)] == low[r.block, r.page]
    marks = {(r.block, r.page): r.kept for r in K.syndicated(df, "block", "page", F.col("sents"), 0.7).collect()}
    assert marks == groups(sets, want, 0.7)
    at = {r.tenth: tuple(r) for r in K.threshold_groups(df, "block", "page", F.col("sents")).collect()}
    for tenth in range(3, 10):
        low = groups(sets, want, tenth / 10)
        sizes = [sum(1 for x in low.items() if x[0][0] == b and x[1] == v) for b, v in {(k[0], v) for k, v in low.items()}]
        assert at[tenth] == (tenth, len(sizes), len(low), len(low) - len(sizes), max(sizes))


def test_many_copies_are_one_row(spark):
    text = ["The very same sentence of a page, long enough.", "And a second one that is long enough too."]
    df = spark.createDataFrame([(1, k, text, None, None) for k in range(500)] + [(1, 1000, text[:1], None, None)], SCHEMA)
    firsts, members = K.representatives(df, "block", "page", F.col("sents"))
    assert firsts.count() == 2 and members.count() == 501 and K.containment_pairs(firsts, 0.7).count() == 1
    got = {(r.measure, r.bin): r.n for r in K.calibration(df, "block", "page", F.col("sents")).collect()}
    assert got == {("containment", 9): 501, ("jaccard", 9): 500, ("jaccard", 5): 1, ("pairs", 7): 500 * 499 // 2 + 500}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert K.calibration(df, "block", "page", F.col("sents")).count() == 0
    assert K.threshold_groups(df, "block", "page", F.col("sents")).count() == 0
    assert K.syndicated(df, "block", "page", F.col("sents")).count() == 0


def test_syndication_keeps_rows_and_columns(spark):
    rows = stories()
    df = spark.createDataFrame(rows, SCHEMA)
    sets, want = brute_pairs(rows)
    low = groups(sets, want, 0.7)
    got = C.syndication(df, "block", "page", F.col("sents"), 0.7)
    assert got.columns == [*df.columns, "origin_rank"]
    assert {(r.block, r.page): r.origin_rank for r in got.collect()} == {(b, p): low.get((b, p), p) for b, p, *_ in rows}


def test_a_pairing_of_pages_is_never_broadcast(spark):
    firsts = spark.createDataFrame([(1, k, 1, [f"a sentence number {j} of some length" for j in range(k, k + 9)]) for k in range(3)], "block long, rep long, members long, sents array<string>")
    plan = K.containment_pairs(firsts, 0.5)
    assert plan.count() == 3 and "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_sets_are_hashes_after_texts_are_read_once(spark):
    df = spark.createDataFrame([(1, k, [f"Sentence number {j} of a page, long enough." for j in range(k, k + 3)], None, None) for k in range(4)], SCHEMA)
    firsts, members = K.representatives(df, "block", "page", F.col("sents"))
    assert dict(firsts.dtypes)["sents"] == "array<bigint>" and firsts.count() == 4
    assert not any("lower" in x._jdf.queryExecution().optimizedPlan().toString() for x in (firsts, members))
