import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import robust_rules as R

SCHEMA = "doc_id long, text string, lang string, source string, n_words int, kept string"


def base(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    w8 = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = {w for w, n in Counter(w8).items() if n > 1}
    covered = {k + j for k, w in enumerate(w8) if w in often for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def texts():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeéß#") for _ in range(rnd.randint(1, 7)))
    out = [None, "", " \n\t", "one", "a\nb\na\n \n \na b\x0bc", "x " * 40, ("p q r s t u v w " * 3) + "end", "*" * 50]
    for _ in range(60):
        p = [word() for _ in range(rnd.randint(5, 60))]
        out.append((" ".join(p) + "\n") * rnd.randint(1, 3) + " ".join(p[:12]))
    return out


def test_base_counts(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows] + [(None, "word " * 30, None, None, None, None)], SCHEMA)
    got = {r.doc_id: r for r in R.rate(df).collect()}
    for i, t in rows:
        r, want = got[i], base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)
    assert len(got) == len(rows) + 1 and R.rate(df.limit(0)).count() == 0


def mcd(x, support):
    """Concentration steps over all rows, from the same two starts, without bins."""
    q = R.chi2_quantile(support, R.P)
    scale = support / (1 - np.exp(-q / 2) * sum((q / 2) ** i / np.prod(range(1, i + 1)) for i in range(R.P // 2 + 1)))
    med = np.median(x, 0)
    iqr = (np.quantile(x, 0.75, 0) - np.quantile(x, 0.25, 0)) / 1.349
    best = None
    for s in (np.maximum(iqr, R.FLOOR), np.array(R.FLOOR)):
        centre, inverse = med, np.diag(1 / s**2)
        for _ in range(3):
            d = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
            own = x[np.argsort(d)[: int(np.ceil(support * len(x)))]]
            centre = own.mean(0)
            inverse, det = R.scatter_inverse(np.cov(own.T, bias=True) * scale)
        if best is None or det < best[0]:
            best = (det, centre, inverse)
    return best[1:]


def test_estimate_against_brute_force(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(3000, R.P)) @ rnd.normal(size=(R.P, R.P)) * 0.3
    x[:500] += 6  # a sixth of the rows lies elsewhere
    df = spark.createDataFrame([("g", v.tolist()) for v in x], "group string, x array<double>")
    r = R.fit(df).first()
    centre, inverse = mcd(x, 0.75)
    assert np.allclose(r.centre, centre, atol=0.1)
    z = x - np.array(r.centre)
    got = np.einsum("ij,jk,ik->i", z, np.array(r.inverse).reshape(R.P, R.P), z) > R.chi2_quantile(0.99999, R.P)
    z = x - centre
    want = np.einsum("ij,jk,ik->i", z, inverse, z) > R.chi2_quantile(0.99999, R.P)
    assert (got == want).mean() > 0.998 and got[:500].all() and got[500:].mean() < 0.01


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    rated = R.rate(spark.read.parquet(f"{d}/documents.parquet")).filter("not base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in rated.groupBy("quality", "kept").count().collect()}
    assert n[1, True] >= 0.99 * (n[1, True] + n.get((1, False), 0)) and n[0, False] >= 0.95 * (n[0, False] + n.get((0, True), 0))


def test_small_groups_and_columns(spark):
    rnd = random.Random(1)
    words = lambda k: " ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 8))) for _ in range(k))
    rows = [(k, words(80), "en" if k % 2 else None, f"s{k % 40}", 1, "x") for k in range(200)] + [(900, words(80).replace(" ", "*** "), "en", "s1", 1, "x"), (900, words(80).replace(" ", "*** "), "en", "s1", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = R.keep_good(df)
    assert out.schema == df.schema
    kept = {r.doc_id for r in out.collect()}
    assert 900 not in kept and len(kept) >= 198
    few = R.rate(df.limit(10))
    assert few.filter("not kept or distance is null").count() == 0
    assert R.keep_good(df.limit(0)).count() == 0


def test_shrinkage(spark):
    """Each level counts n^2 / (n^2 + prior^2), against the level above."""
    rnd = random.Random(5)
    words = lambda k, w: " ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(w, w + 4))) for _ in range(k))
    rows = [(k, words(60, 3), "en", "large", 1, "x") for k in range(120)] + [(500 + k, words(60, 6), "en", "small", 1, "x") for k in range(3)] + [(700, words(60, 3), None, None, 1, "x")]
    stats = R.statistics(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source")).cache()
    got = {r.own: r for r in R.model_of(stats, prior=60.0).collect()}
    assert len(got) == 3
    x = {r.doc_id: np.array(r.x) for r in stats.select("doc_id", R._vector().alias("x")).collect()}
    lone = R.fit(spark.createDataFrame([(g, v.tolist()) for i, v in x.items() for g in ("all", "en" if i < 700 else "-", "large" if i < 500 else "small" if i < 700 else "lone")], "group string, x array<double>"))
    e = {r.group: r for r in lone.collect()}
    mix = lambda a, b, n: n * n / (n * n + 3600) * np.array(a) + 3600 / (n * n + 3600) * np.array(b)
    en = mix(e["en"].centre, e["all"].centre, 123)
    assert np.allclose(got["=en\x1f=small"].centre, mix(e["small"].centre, en, 3)) and np.allclose(got["=en\x1f=large"].centre, mix(e["large"].centre, en, 120))
    wide = mix(e["all"].cov, np.diag((R.WIDE * np.array(R.FLOOR)) ** 2).ravel(), 124)
    cov = mix(e["small"].cov, mix(e["en"].cov, wide, 123), 3).reshape(R.P, R.P)
    assert np.allclose(np.array(got["=en\x1f=small"].inverse).reshape(R.P, R.P), R.scatter_inverse(cov)[0])
    stats.unpersist()


@pytest.mark.parametrize(("p", "want"), [(0.5, 5.348), (0.95, 12.592), (0.999, 22.458)])
def test_chi_square(p, want):
    assert R.chi2_quantile(p, 6) == pytest.approx(want, abs=2e-3)
