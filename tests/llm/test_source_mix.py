from collections import defaultdict

import numpy as np
import pytest

from ledgerlake.llm.source_mix import hypergeometric, mixed_documents, plan, split_quota, stratum_quotas, take_blocks, taken, with_targets

SCHEMA = "doc_id long, text string, source string, twin int, place string"


def rows():
    r = [(k, " ".join(f"w{k}_{j}" for j in range(1 + k * 7 % 300)), f"s{k % 5}" if k % 11 else None, 1, "p") for k in range(200)]
    return r + [(500, None, "s0", 1, "p"), (501, "", "s1", 1, "p"), (502, " \n", None, 1, "p"), (503, None, "void", 1, "p"), (7, r[7][1], r[7][2], 1, "p"), (None, "a b c", "s1", 1, "p")]


def targets(size, w, share=1.5, most=2.0):
    """The rule, round by round."""
    size, w = np.array(size, float), np.array(w, float)
    out, live, left = np.zeros(len(size)), np.ones(len(size), bool), share * size.sum()
    while live.any():
        own = left * w / w[live].sum()
        over = live & (own > most * size)
        if not over.any():
            out[live] = own[live]
            break
        out[over] = most * size[over]
        left -= out[over].sum()
        live &= ~over
    return out.tolist()


def test_targets(spark):
    rnd = np.random.default_rng(4)
    for sizes in ([100, 100, 100], [], [0, 0], [10, 1000, 50, 3], (rnd.pareto(0.7, 40) * 50).astype(int).tolist()):
        names = [f"s{k:03d}" for k in range(len(sizes))]
        got = with_targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).orderBy("source").collect()
        assert [r.target for r in got] == pytest.approx(targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))]))


def test_hypergeometric():
    from math import comb

    for good, bad, draw in ((5, 7, 4), (3, 3, 6), (50, 2, 30), (10, 0, 4), (0, 9, 3)):
        n = comb(good + bad, draw)
        got = [hypergeometric((k + 0.5) / 4000, good, bad, draw) for k in range(4000)]
        for x in range(draw + 1):
            assert abs(got.count(x) / 4000 - comb(good, x) * comb(bad, draw - x) / n) < 1e-3
    big = [hypergeometric(u, 4 * 10**10, 6 * 10**10, 10**10) for u in (0.0228, 0.5, 0.9772)]
    sd = (10**10 * 0.4 * 0.6 * 0.9) ** 0.5
    assert big == pytest.approx([4 * 10**9 - 2 * sd, 4 * 10**9, 4 * 10**9 + 2 * sd], abs=0.01 * sd)


def test_tree():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 16, 256):
        counts = rnd.integers(0, 50, n)
        for quota in (0, 1, int(counts.sum()) // 3, int(counts.sum())):
            got = split_quota(counts, quota, [3, 1])
            assert got.sum() == quota and (got >= 0).all() and (got <= counts).all()
            assert (got == split_quota(counts, quota, [3, 1])).all()
    draws = np.array([split_quota(np.array([30, 10, 5, 5]), 20, [k]) for k in range(3000)])
    assert draws.mean(0) == pytest.approx([12, 4, 2, 2], abs=0.15)


def test_quotas_of_lengths():
    words, counts = np.array([16, 3, 5, 1]), np.array([40, 7, 9, 3])
    for rest in (0.0, 10.0, 333.0, 709.0):
        q = stratum_quotas(words, counts, rest)
        assert (q <= counts).all() and abs((q * words).sum() - rest) <= 3


def test_the_tree_decides_what_is_taken(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    one, two = (sorted(map(tuple, taken(df, block_words=16, shard_words=3000, seed=k).collect()), key=str) for k in (7, 8))
    assert one != two and [r[:4] for r in one] == [r[:4] for r in two]
    _, draws = plan(df, block_words=16, shard_words=3000)
    assert draws.select("shard").distinct().count() > 5


def test_report(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = taken(df, block_words=16, shard_words=3000)
    first, again = sorted(map(tuple, got.collect()), key=str), sorted(map(tuple, taken(df.repartition(5), block_words=16, shard_words=3000).collect()), key=str)
    assert first == again and len(first) == len(rows())
    size = defaultdict(int)
    for _, t, s, *_ in rows():
        size[s] += len((t or "").split())
    order = sorted(x for x in size if x is not None) + [None]
    want = dict(zip(order, targets([size[x] for x in order], [(5, 2, 1)[k % 3] for k in range(len(order))])))
    source = {i: s for i, _, s, *_ in rows()}
    sums = defaultdict(int)
    for i, n, total, target, k in first:
        assert total == size[source[i]] and target == pytest.approx(want[source[i]]) and k <= 2 * n
        sums[source[i]] += k
    for s, t in want.items():
        assert abs(sums[s] - t) <= 16


def test_draws_are_disjoint(spark):
    _, draws = plan(spark.createDataFrame(rows(), SCHEMA), block_words=16, shard_words=3000)
    d = draws.toPandas()
    assert not d.duplicated(["doc", "copy", "block"]).any() and d.shard.nunique() > 5
    n = d.groupby("shard").size()
    assert (d.groupby("shard").position.max() == n).all() and d.groupby(["doc", "block"]).shard.nunique().max() == 1


def test_documents(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    out = mixed_documents(df, block_words=16, shard_words=3000)
    assert out.schema == df.schema
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
    report = defaultdict(int)
    for i, _, _, _, k in taken(df, block_words=16, shard_words=3000).collect():
        report[i] += k
    assert {i: k for i, k in report.items() if k} == dict(words)
    assert mixed_documents(df.limit(0)).count() == 0 and taken(df.limit(0)).count() == 0


def test_take_blocks():
    assert take_blocks(b" a  b c\td e ", [0, 1, 3], 1) == b"a  b\nd"
    assert take_blocks(b" a  b ", [0], 2) == b" a  b "
