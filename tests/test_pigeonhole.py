"""Candidates of a Jaccard join by equal parts: every similar pair, and few others."""

from __future__ import annotations

import random

import pytest

from ledgerlake.operators import clustering as C
from ledgerlake.operators import pigeonhole as P


def _planted(n: int, vocabulary: int, seed: int = 3) -> list[tuple[int, list[str]]]:
    """Random sets of 1 to 60 tokens, each second one a changed copy of the one before."""
    rng, words, sets = random.Random(seed), [f"w{k}" for k in range(vocabulary)], []
    for k in range(n):
        if k % 2:
            s = set(sets[-1])
            for _ in range(rng.randint(1, 1 + len(s) // 6)):
                s ^= {rng.choice(words)}
            sets.append(s or {"w0"})
        else:
            sets.append(set(rng.sample(words, rng.randint(1, 60))))
    return [(k, sorted(s)) for k, s in enumerate(sets)]


@pytest.mark.parametrize("least", [0.5, 0.7, 0.85, 0.95])
def test_candidates_hold_every_similar_pair(spark, least):
    sets = _planted(300, 150)
    got = {tuple(r) for r in P.candidates(spark.createDataFrame(sets, "id long, s array<string>"), least).collect()}
    held = [(k, set(s)) for k, s in sets]
    want = {(a, b) for i, (a, x) in enumerate(held) for b, y in held[i + 1 :] if x != y and len(x & y) / len(x | y) >= least}
    assert len(want) > 20 and want <= got and all(a < b for a, b in got)


def test_sets_that_share_single_tokens_are_not_met(spark):
    # of a vocabulary of 2,000 any two of these sets share a token, and most share one of their rarest
    rng = random.Random(5)
    sets = [(k, sorted(f"w{x}" for x in rng.sample(range(2000), 300))) for k in range(200)]
    assert P.candidates(spark.createDataFrame(sets, "id long, s array<string>"), 0.85).count() < 20


def test_pairs_and_greedy_against_brute_force(spark):
    sets = _planted(200, 120, seed=8)
    df = spark.createDataFrame([(k, " ".join(s)) for k, s in sets], "id long, text string")
    first: dict[tuple, int] = {}
    for k, s in sets:
        first.setdefault(tuple(s), k)
    reps = sorted((k, set(s)) for s, k in first.items())
    want = {(a, b) for i, (a, x) in enumerate(reps) for b, y in reps[i + 1 :] if round(len(x & y) / len(x | y), 9) >= 0.85}
    assert {(r.a, r.b) for r in C.similar_pairs(df, "id", "text", 0.85).collect()} == want
    kept: set[int] = set()
    for k, _ in reps:
        if not any(a in kept for a, b in want if b == k):
            kept.add(k)
    assert {r.id for r in C.greedy_dedup(df, "id", "text", 0.85).filter("kept").collect()} == kept


def test_pairs_are_scored_in_slices(spark, monkeypatch):
    # 20 sets that differ in one token are 190 pairs; no slice takes the sets of many more pairs along than there are sets
    df = spark.createDataFrame([(k, f"a b c d e f g h i j k l m n o p q r s t u v w x y z w{k}") for k in range(20)], "id long, text string")
    cut, sizes = C._cut, []

    def counted(x, free=False):
        out = cut(x, free)
        if "j" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(C, "_cut", counted)
    assert C.similar_pairs(df, "id", "text", 0.85).count() == 20 * 19 // 2 == sum(sizes)
    assert len(sizes) == 10 and max(sizes) < 50


def test_document_pairs_hold_copies(spark):
    """Copies, texts of one token set and near texts of copies: every pair of documents."""
    sets = _planted(60, 120, seed=5)
    texts = [" ".join(s) for _, s in sets]
    texts += texts[:20] + [t.upper() + "!" for t in texts[5:15]] + [None, "", "?"]
    held = [set((t or "").lower().replace("!", "").replace("?", "").split()) for t in texts]
    want = {(a, b): round(len(x & y) / len(x | y), 9) for a, x in enumerate(held) for b, y in enumerate(held) if a < b and x and y and len(x & y) / len(x | y) >= 0.85}
    got = C.document_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", 0.85).collect()
    assert {(r.a, r.b): r.j for r in got} == want and len(got) == len(want) and sum(j == 1 for j in want.values()) >= 30
    assert any(j < 1 and b >= 60 for (_, b), j in want.items())


def test_near_copies_are_scored_in_one_place(spark, monkeypatch):
    """Forty near copies are 780 pairs: a set is sent to a place once, not once a pair, and places of many pairs are cut up."""
    df = spark.createDataFrame([(k, f"a b c d e f g h i j k l m n o p q r s t u v w x y z w{k}") for k in range(40)], "id long, text string")
    sent = []
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(C, "_sliced", lambda pairs, most, scored: sent.append(pairs) or scored(pairs))
    out = C.similar_pairs(df, "id", "text", 0.85)
    assert out.count() == 780 and sent[0].select("bucket").distinct().count() == 1 and "array_intersect" not in plan(out)
    monkeypatch.setattr(C, "PAIRS", 50)
    assert C.similar_pairs(df, "id", "text", 0.85).count() == 780 and sent[1].groupBy("bucket").count().agg({"count": "max"}).first()[0] < 300
