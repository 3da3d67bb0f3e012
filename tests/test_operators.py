"""Operators on tables small enough to compute by hand."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import clustering as C
from ledgerlake.operators import ledger as G
from ledgerlake.operators import log_odds as L
from ledgerlake.operators import metrics as M
from ledgerlake.operators import passages as P
from ledgerlake.operators import relational as J
from ledgerlake.operators import resampling as B
from ledgerlake.operators import sampling as S


def test_thresholds(spark):
    rows = [(float(s), int(s >= 0)) for s in range(-3, 3)]
    pts = L.operating_points(spark.createDataFrame(rows, "score double, y int"))
    got = [L.pick_threshold(pts, b).first()[0] for b in (0.0, 1 / 3, 0.5, 1.0)]
    assert got == [-1.0, 0.0, 0.0, 2.0]
    assert L.pick_threshold(pts.filter("threshold >= 0"), 0.1).first()[0] == float("-inf")
    assert tuple(L.recall_at_fpr(pts, 0.5).first()) == (1.0, 0.0, -1.0)
    assert L.miss_cut(pts, 0.34).first()[0] == -2.0


def test_auc_against_pairs(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 9) / 2, rnd.randint(0, 1)) for _ in range(80)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert L.auc(spark.createDataFrame(rows, "score double, y int")).first().auc == pytest.approx(want)
    s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert B.weighted_auc(s, y, np.ones(80)) == pytest.approx(want)


def test_counts_are_padded(spark):
    claims = spark.createDataFrame([(1, 1), (2, 0)], "claim_id long, y int")
    reads = spark.createDataFrame([(1, "5")] * 11 + [(1, "I")], "claim_id long, flag string")
    got = {(r.claim_id, r.flag): r.n for r in L.flag_counts(claims, reads).collect()}
    assert got[1, "5"] == 11 and got[1, "I"] == 1 and got[2, "I"] == 10 and got[2, "5"] == 0 and len(got) == 14


def test_scored_run(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "g string, p string")
    f = {r["class"]: r.f1 for r in M.class_f1(rows, "g", "p", ["a", "b", "c", "d"]).collect()}
    assert f == {"a": pytest.approx(0.5), "b": pytest.approx(2 / 3), "c": 0.0, "d": 0.0}
    v = spark.createDataFrame([(True, False)] * 8 + [(True, True)], "a boolean, b boolean")
    assert tuple(M.mcnemar(v, "a", "b").first()) == (9, 8, 0, 2 / 2**8)
    assert M.mcnemar(v.filter("b"), "a", "b").first().p == 1.0


def test_components_and_greedy(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 30) if k % 10] + [(50, 40)], "a long, b long")
    got = {r.id: r.component for r in C.components(links).collect()}
    assert got[10] == 1 and got[20] == 11 and got[30] == 21 and got[50] == 40
    texts = ["a b c d e f g h i j", "a b c d e f g h i k", "a b c d e f g h k l", "x y z", "x y z", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    kept, want = [], []
    for t in texts:
        s = set(t.split())
        ok = not any(s and len(s & o) / len(s | o) >= 0.7 for o in kept)
        want.append(ok)
        kept += [s] if ok else []
    assert [r.kept for r in C.greedy_dedup(df, "id", "text", 0.7).orderBy("id").collect()] == want


def test_pairs_grow_with_distinct_texts(spark):
    """Two hundred copies in any order of words are one representative; a dropped representative takes its copies along."""
    texts = ["a b c d e f g h i j"] + ["b a c d e f g h i k"] * 100 + ["k i h g f e d c b a"] * 100 + ["", None, "", "x y", "y x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert [tuple(r) for r in C.similar_pairs(df, "id", "text", 0.7).collect()] == [(0, 1, pytest.approx(9 / 11), 1, 200)]
    _, members = C.token_sets(df, "id", "text")
    assert {r.id: r.rep for r in members.collect()} == {0: 0, **{k: 1 for k in range(1, 201)}, 204: 204, 205: 204}
    kept = {r.id: r.kept for r in C.greedy_dedup(df, "id", "text", 0.7).collect()}
    assert [k for k, v in kept.items() if v] and sorted(k for k, v in kept.items() if v) == [0, 201, 202, 203, 204]


def test_clusters(spark):
    df = spark.createDataFrame([(1, "vaccines contain microchips says doctor"), (2, "doctor says vaccines contain microchips"), (3, "vaccines contain microchips says doctor"), (4, "wholly other thing about turtles"), (5, ""), (6, "")], "id long, norm string")
    got = {r.id: (r.cluster_id, r.cluster_size) for r in C.cluster(df).collect()}
    assert got[3] == got[1] == (1, 3) or got[3][0] == 1
    assert got[4] == (4, 1) and got[5] == got[6] == (5, 2)


def test_clusters_of_common_tokens(spark):
    """Sixty near copies whose words are all in more items than the cap, among others; every pair against brute force."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    base = "doctors were told that vaccines contain microchips since spring"
    texts = [f"{base} {k}" for k in range(60)] + [" ".join(rnd.sample(words, 6)) for _ in range(60)]
    grams = [{t[k : k + 3] for k in range(len(t) - 2)} for t in texts]
    df = {g: sum(g in s for s in grams) for g in set().union(*grams)}
    w = {g: np.log(len(texts) / n) for g, n in df.items()}
    tokens = [{x for x in t.split() if len(x) > 3} for t in texts]
    few = {x for x in set().union(*tokens) if 1 < sum(x in s for s in tokens) <= 15}
    lead = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = tokens[a] & tokens[b]
            if (len(both) >= 2 or both & few) and sum(map(w.get, grams[a] & grams[b])) / sum(map(w.get, grams[a] | grams[b])) >= 0.58:
                old, new = sorted((lead[a], lead[b]))[::-1]
                lead = [new if x == old else x for x in lead]
    got = {r.id: r.cluster_id for r in C.cluster(spark.createDataFrame(list(enumerate(texts)), "id long, norm string")).collect()}
    assert got == dict(enumerate(lead)) and lead[:60] == [0] * 60


def test_clusters_pass_on_a_forest(spark, monkeypatch):
    """Sixty near copies in blocks of ten texts: a task's edges join its texts, they are not a row a pair."""
    from ledgerlake.operators import trigrams

    cut, sizes = C._cut, []

    def counted(x, free=False):
        out = cut(x, free)
        if out.columns[:2] == ["a", "b"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(C, "_cut", counted)
    monkeypatch.setattr(trigrams, "TEXTS", 30)
    texts = [f"doctors were told that vaccines contain microchips since spring {k}" for k in range(60)] + [f"{'z' * k} other" for k in range(1, 20)]
    got = {r.id: r.cluster_id for r in C.cluster(spark.createDataFrame(list(enumerate(texts)), "id long, norm string")).collect()}
    assert all(got[k] == 0 for k in range(60)) and all(got[k] >= 60 for k in range(60, 79))
    assert 59 <= sum(sizes) <= 6 * 60


def test_clusters_by_brute_force(spark, monkeypatch):
    """Texts of any likeness, copies with pages of their own, blocks of twenty: both kinds of edges."""
    from ledgerlake.operators import trigrams

    monkeypatch.setattr(trigrams, "TEXTS", 20)
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(4, 7))) for _ in range(150)]
    texts = [" ".join(rnd.sample(words, rnd.randint(3, 12))) for _ in range(25)]
    for _ in range(95):
        own = rnd.choice(texts).split()
        texts.append(" ".join(w if rnd.random() > 0.35 else rnd.choice(words) for w in own))
    texts += texts[:6] + ["", "", "ab"]
    cited = [set(rnd.sample(["p", "q", "r", "s"], rnd.randint(0, 3))) for _ in texts]
    grams = [{t[k : k + 3] for k in range(len(t) - 2)} if len(t) > 2 else {t} for t in texts]
    w = {g: np.log(len(texts) / sum(g in s for s in grams)) for g in set().union(*grams)}
    tokens = [{x for x in t.split() if len(x) > 3} for t in texts]
    df = {x: sum(x in s for s in tokens) for x in set().union(*tokens)}
    lead, kinds = list(range(len(texts))), set()
    for a in range(len(texts)):
        for b in range(a):
            both, union = tokens[a] & tokens[b], sum(map(w.get, grams[a] | grams[b]))
            sim = round(sum(map(w.get, grams[a] & grams[b])) / union, 9) if union else 0
            few, rare = any(df[x] <= 4 for x in both), [x for x in both if df[x] <= 7]
            near, by_page = sim >= 0.58 and (len(both) >= 2 or few), sim >= 0.25 and len(cited[a] & cited[b]) >= 2 and (few or len(rare) >= 2)
            if texts[a] == texts[b] or near or by_page:
                kinds.add((near, by_page))
                old, new = sorted((lead[a], lead[b]))[::-1]
                lead = [new if x == old else x for x in lead]
    urls = spark.createDataFrame([(k, x) for k, s in enumerate(cited) for x in s], "id long, key string")
    got = {r.id: r.cluster_id for r in C.cluster(spark.createDataFrame(list(enumerate(texts)), "id long, norm string"), urls=urls, ultra=4, cap=7).collect()}
    assert got == dict(enumerate(lead)) and len(set(lead)) > 10 and {(True, False), (False, True)} <= kinds


def test_clusters_cited_together(spark):
    """Fifty notes that cite the same two pages: no hub is needed for an edge."""
    texts = [f"{'x' * k} apples" for k in range(1, 51)]
    texts[20], texts[40] = "harbour closed storm tonight", "harbour closed calm tomorrow"
    df = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    urls = spark.createDataFrame([(k, u) for k in range(50) for u in ("one.example/page", "two.example/page")], "id long, key string")
    got = {r.id: r.cluster_id for r in C.cluster(df, urls=urls).collect()}
    assert got[20] == got[40] == 20


def test_passages():
    assert P.region_starts([5, 5, 5, 5], 10).tolist() == [0, 2] and P.region_starts([50, 5, 5], 10).tolist() == [0, 1] and P.region_starts([], 10).tolist() == []
    assert np.flatnonzero(P.block_mask([50, 8, 60, 60], [0, 1, 0, 0], 90, lede=1, around=0)).tolist() == [1]
    assert np.flatnonzero(P.block_mask([10] * 6, [0, 0, 0, 2, 0, 1], 72, lede=1, around=1)).tolist() == [0, 2, 3, 4]
    assert P.block_mask([10] * 6, None, 40).tolist() == [True] * 2 + [False] * 4 and P.block_mask([], None, 9).tolist() == []
    assert P.mmr([1.0, 0.99, 0.1], [[1, 0], [1, 0], [0, 1]], 2, 0.5) == [0, 2]


def test_sentences_of_a_page(spark):
    def got(scores, sizes, **kw):
        df = spark.createDataFrame([(1, k, "x" * n, float(v)) for k, (v, n) in enumerate(zip(scores, sizes))], "p long, pos int, s string, bm25 double")
        return sorted(r.pos for r in P.selected_sentences(df, "p", "pos", "s", **kw).collect())

    assert got([0, 0, 0, 0, 1, 0], [10] * 6, budget=40) == [0, 1, 2, 4]
    assert got([0] * 6, [10] * 6, budget=60, most=6) == [0, 1, 2, 3, 4, 5]
    assert got([0] * 8, [10] * 8, budget=45) == [0, 1, 2, 3]
    assert got([0] * 9 + [1], [10] * 10, budget=55) == [0, 1, 2, 7, 8]  # the second ring is taken whole, then the cut is in page order
    assert got([0] * 9 + [1], [10] * 10, most=4) == [0, 1, 2, 9]
    regions = spark.createDataFrame([(1, k, "x" * 5, float(v)) for k, v in enumerate([0, 1, 0, 3])], "p long, pos int, s string, bm25 double")
    assert [tuple(r) for r in P.selected_regions(regions, "p", "pos", "s", width=10, top=1).collect()] == [(1, 2, 4)]


def test_ledger(spark):
    base = {"claim_id": 1, "claim": "bridges fall", "claim_type": "assertion", "stance": "supports", "rel": "RELIABLE", "ng": 70.0, "domain": "a.com", "text": "bridges fall", "opinion": False, "republication": False, "snippet_only": False}
    cases = {1: [{"ng": 95.0}], 2: [{}, {"domain": "b.com"}], 3: [{}, {"domain": "x.a.com"}], 4: [{"snippet_only": True, "ng": 95.0}], 5: [{}, {"snippet_only": True, "ng": 95.0, "domain": "b.com"}], 6: [{"stance": "partially-supports", "ng": 95.0}], 7: [{"ng": 95.0, "opinion": True}]}
    rows = [{**base, **e, "claim_id": k} for k, es in cases.items() for e in es]
    got = {r.claim_id: (r.met, r.reason) for r in G.bar(G.qualifying(spark.createDataFrame(pd.DataFrame(rows)), "supported"), "supported").collect()}
    assert got == {1: (True, "strong-source"), 2: (True, "two-voices"), 3: (False, "single-voice"), 4: (False, "no-anchor"), 5: (True, "two-voices"), 6: (False, "no-anchor")}


def test_without_bar(spark):
    rows = [(1, "unsupported", [(1, "close-below-bar", "supported"), (2, "close-unbacked", "refuted")]), (2, "refuted", [])]
    df = spark.createDataFrame(rows, "claim_id long, status string, guard_events array<struct<round:int,guard:string,refused:string>>")
    assert {r.claim_id: r.counterfactual for r in G.without_bar(df).collect()} == {1: "refuted", 2: "refuted"}


def test_draws(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3).withColumn("c", F.col("id") % 97)
    assert {r.id for r in S.draw(df, "id", 20).collect()} == {r.id for r in S.draw(df.repartition(9), "id", 20).collect()}
    alloc = S.largest_remainder(spark.createDataFrame([("a", 3), ("b", 50), ("c", 47)], "g string, size long"), ["g"], "size", 20)
    assert sum(r.alloc for r in alloc.collect()) == 20
    parts = S.split(df, "id", "c", "g", {0: 5, 1: 5, 2: 0})
    assert parts.filter("part = 'val'").count() == 10 and S.overlap(parts.filter("part = 'val'"), parts.filter("part = 'cal'"), "c") == 0
    cyc = {r.g: r.alloc for r in S.largest_remainder(spark.createDataFrame([("a", 1), ("b", 9), ("c", 9)], "g string, size long"), ["g"], "size", 12, cycle=True).collect()}
    assert sum(cyc.values()) == 12 and cyc["a"] <= 1


def test_relational(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(3, 2.5, "z")], "k long, w double, v string")
    assert J.relaxed_union(a, b).schema.simpleString() == "struct<k:bigint,v:string,w:double>"
    assert J.upsert(a, spark.createDataFrame([(2, "n"), (5, "m")], "k int, v string"), "k").count() == 3
    pick = J.budgeted_pick(spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 4)], "g int, o int, c int"), "g", "o", "c", 10)
    assert [r.o for r in pick.orderBy("o").collect()] == [1, 3]


def test_trigram_pairs_by_blocks():
    """The bound of a product of matrices loses no pair; blocks of several products and a block with itself, against plain sets."""
    from ledgerlake.operators import trigrams as T

    rnd = random.Random(7)
    texts = ["", "a", "ab", "abc", "é😀x"] + ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(5, 60))) for _ in range(80)]
    texts += [t[:-2] + rnd.choice("xyz") + t[-1:] for t in texts[20:60]]
    grams = [{t[k : k + 3] for k in range(len(t) - 2)} if len(t) > 2 else {t} for t in texts]
    df = {g: sum(g in s for s in grams) for g in set().union(*grams)}
    w = {g: np.log(len(texts) / n) for g, n in df.items()}
    keys = {g: int(T.gram_keys(g)[0]) for g in df}
    assert len(set(keys.values())) == len(df) and [sorted(map(keys.get, s)) for s in grams] == [T.gram_keys(t).tolist() for t in texts]
    vocabulary = np.array(sorted(keys.values()), np.uint64)
    idf = np.array([w[g] for g, _ in sorted(keys.items(), key=lambda kv: kv[1])])
    sim = lambda a, b: round(sum(map(w.get, grams[a] & grams[b])) / sum(map(w.get, grams[a] | grams[b])), 9)
    T.ROWS, rows = 16, T.ROWS
    x, y = T._Block(texts, vocabulary, idf), T._Block(texts[30:], vocabulary, idf)
    within, across = (sorted(zip(a.tolist(), b.tolist())) for a, b, _ in (T.block_pairs(x, x, 0.5), T.block_pairs(x, y, 0.5)))
    T.ROWS = rows
    assert within == [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sim(a, b) >= 0.5] and len(within) > 20
    assert across == [(a, b) for a in range(len(texts)) for b in range(len(texts) - 30) if sim(a, b + 30) >= 0.5]


def test_budgets_are_streamed(spark):
    """Rows of a group pass in order, none is held: 3 and 2 fit 5, what is too dear or has no cost is skipped, ids may be null."""
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 4), ("a", 3, None), ("a", 4, 2), ("a", 5, 1), ("b", 1, 6), ("b", 2, 5), (None, 1, 5), (None, 2, 1)], "g string, o int, c int")
    got = J.budgeted_pick(df, "g", "o", "c", 5)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1, 3), ("a", 4, 2), ("b", 2, 5), (None, 1, 5)], key=str)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()


def test_best_match_moves_marks_instead_of_texts(spark):
    left = spark.createDataFrame([(1, "k", "a b c"), (2, "k", "a b c"), (3, "k", "x"), (4, "z", "a"), (5, None, "a"), (6, "k", None)], "id int, k string, t string")
    right = spark.createDataFrame([(7, "k", "a b c"), (8, "k", "c b a")], "rid int, k string, r string")
    found = J.best_match(left, right, "k", "id", "rid", "t", "r")
    assert [tuple(r) for r in found.orderBy("id").collect()] == [(1, 7, 1.0, "exact"), (2, 7, 1.0, "exact"), (3, None, 0.0, "claim_mismatch"), (4, None, None, "no_key_match"), (5, None, None, "no_key_match"), (6, None, 0.0, "claim_mismatch")]
    windows = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert windows and not any("ta#" in line for line in windows)


def test_sentences_of_a_page_are_shuffled_once_and_without_text(spark):
    import math

    rows = [(1, 0, "Alpha beta gamma"), (1, 1, "Alpha delta"), (1, 1, "Alpha again"), (1, 2, "of it"), (2, 0, "Beta"), (None, 0, "Alpha")]
    df = spark.createDataFrame(rows, "p int, pos int, s string").repartition(3)
    scored = P.bm25_sentences(df.withColumn("size", F.length("s")), "p", "pos", "s", F.array(F.lit("alpha"), F.lit("beta")))
    assert scored.columns == ["p", "pos", "s", "size", "bm25"]
    part = lambda n, df, size, avg: math.log(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * size / avg))
    two = 2 * part(4, 3, 2, 1.75)
    want = {(1, 0, 16): part(4, 3, 3, 1.75) + part(4, 1, 3, 1.75), (1, 1, 11): two, (1, 2, 5): 0.0, (2, 0, 4): part(1, 1, 1, 1), (None, 0, 5): part(1, 1, 1, 1)}
    got = scored.collect()
    assert len(got) == 6 and all(r.bm25 == pytest.approx(want[r.p, r.pos, r.size]) for r in got)
    plan = P.selected_regions(scored, "p", "pos", F.col("size"))._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInPandas" not in plan


def test_voices_and_nested_scores_are_made_within_a_claims_row(spark):
    rng = random.Random(5)
    claims = spark.createDataFrame([(k, k % 2, k % 7 == 0, k % 3) for k in (*range(60), 4)], "claim_id int, y int, mid boolean, fold int")
    reads = spark.createDataFrame([(rng.randrange(50), rng.choice([*L.FLAGS, "odd"])) for _ in range(400)], "claim_id int, flag string")
    table, counts = L.flag_table(claims, reads), L.flag_counts(claims, reads)
    voices = L.voice_counts(table)
    assert sorted(map(tuple, voices.collect())) == sorted(map(tuple, L.to_voices(counts).collect()))
    assert not any("HashAggregate(keys=[claim_id" in line and "flag" in line.split("functions")[0] for line in voices._jdf.queryExecution().sparkPlan().toString().splitlines())
    nested = L.nested_operating_point(table)
    keys = [line for line in nested._jdf.queryExecution().sparkPlan().toString().splitlines() if "HashAggregate(keys=[" in line]
    assert nested.count() == 3 and keys and not any("claim_id" in line and "outer" in line.split("functions")[0] for line in keys)
