"""Queries of the catalogue on small tables of their own: every row and the whole of every text count."""

import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import text as X
from ledgerlake.operators import clustering as C
from ledgerlake.operators import metrics as M
from ledgerlake.operators import passages as P
from ledgerlake.operators import relational as J
from ledgerlake.operators import resampling as B
from ledgerlake.operators import vectors as V
from ledgerlake.plans import catalogue

QUERIES = catalogue.queries()


def put(spark, at, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_note_clusters_read_whole_pages(spark, tmp_path):
    head = "<p>" + "shared opening words of every page in this archive " * 12
    tails = ["turtles migrate across warm oceans yearly " * 30, "parliament voted against budget amendments " * 30]
    d = put(spark, tmp_path, "pages", [(k, f"https://site.example/{k}", head + tails[k % 2] + f"v{k}</p>") for k in range(4)], "page_id long, url string, html string")
    assert {r.page_id: r.cluster_id for r in QUERIES["note_clusters"](spark, d).collect()} == {0: 0, 1: 1, 2: 0, 3: 1}


def test_note_clusters_by_cited_pages(spark, tmp_path):
    """Pages of a similarity between the two bars are one cluster if they link to the same two pages, and only then."""
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(400)]
    story = words[:40]
    page = lambda k, own, links: " ".join(own + words[60 + 12 * k : 72 + 12 * k]) + " " + " ".join(f"<a href={x}>read</a>" for x in links)
    same = ["'/one/page-of-record?x=1'", '"https://www.other.example/second-page#top"']
    rows = [(0, "http://site.example/en/1", page(0, story[:32], same)), (1, "http://site.example/en/2", page(1, story[:32], same))]
    rows += [(2, "http://site.example/en/3", page(2, story[:32], same[:1])), (3, "http://third.example/en/4", page(3, story[:32], same))]
    rows += [(k, f"http://site.example/{k}", page(k, [], same)) for k in range(4, 25)]
    d = put(spark, tmp_path, "pages", rows, "page_id long, url string, html string")
    got = {x.page_id: x.cluster_id for x in QUERIES["note_clusters"](spark, d).collect()}
    assert got == {k: 0 if k == 1 else k for k in range(25)}


def test_numbered_block_takes_late_keywords(spark, tmp_path):
    text = " ".join("Red foxes often run home." for _ in range(12)) + " " + " ".join(f"Chapter {k} brings " + " ".join(f"word{k}x{j}" for j in range(12)) + "." for k in range(40))
    d = put(spark, tmp_path, "documents", [(1, text)], "doc_id long, text string")
    s = spark.createDataFrame([(text,)], "text string").select(X.sentences("text").alias("s"), X.keywords("text").alias("k"))
    want = s.select(F.length(P.numbered_block("s", "k", F.lit(300)))).first()[0]
    head = s.select(F.length(P.numbered_block("s", X.keywords(F.lit(text[:200])), F.lit(300)))).first()[0]
    assert QUERIES["numbered_block"](spark, d).first().chars == want != head


def test_page_walls_judge_each_page(spark, tmp_path):
    walls = ["", "Please enable JavaScript", "We use cookies. " * 40, "404 not found " * 40, "Sign in to continue. " * 30]
    rows = [(10 + (k + 2) % 5, "u", t) for k, t in enumerate(walls)]
    d = put(spark, tmp_path, "pages", rows, "page_id long, url string, html string")
    want = {r.page_id: r.wall for r in spark.createDataFrame(rows, "page_id long, u string, t string").select("page_id", X.page_wall("t").alias("wall")).collect()}
    got = {r.page_id: r.wall for r in QUERIES["page_walls"](spark, d).collect()}
    assert got == want and got[12] == "empty" and got[13] == "thin" and None not in got.values()


def test_mcnemar_p_over_all_orders(spark, tmp_path):
    rows = [(k, k // 2) for k in range(300, 3000)]
    d = put(spark, tmp_path, "orders", rows, "o_orderkey long, o_custkey long")
    a, b = (sum((x % 3 == 0) > (y % 3 == 0) for x, y in r) for r in (rows, [(y, x) for x, y in rows]))
    r = QUERIES["mcnemar_p"](spark, d).first()
    exact = min(1.0, 2 * sum(math.comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b))
    assert (r.n, r.only_a, r.only_b) == (2700, a, b) and r.p == pytest.approx(exact)
    few, many = pd.Series([470, 900, 1500]), pd.Series([560, 1050, 1500])
    want = [min(1.0, 2 * sum(math.comb(x + y, i) for i in range(x + 1)) / 2 ** (x + y)) for x, y in zip(few, many)]
    assert M.binomial_two_sided.func(few, many).tolist() == pytest.approx(want, rel=1e-9)


def test_passages_of_every_language(spark, tmp_path):
    text = "\n".join(f"Une phrase de taille moyenne avec le mot Zanzibar, numéro {k}." for k in range(60))
    put(spark, tmp_path, "documents", [(1, text, "fr"), (2, text, None), (3, text, "en")], "doc_id long, text string, lang string")
    d = put(spark, tmp_path, "benchmark", [(k, "Zanzibar") for k in range(40)], "item_id long, text string")
    for name in ("bm25_selection", "bm25_regions"):
        out = QUERIES[name](spark, d)
        assert {r.doc_id for r in out.select("doc_id").collect()} == {1, 2, 3}
    assert QUERIES["bm25_selection"](spark, d).groupBy("doc_id").count().filter("count = 60").count() == 3


@pytest.mark.parametrize(("name", "rep", "groups"), [("bootstrap_ci", "rep", 2), ("paired_auc_difference", "rep", 1), ("redrawn_weights", "draw", 7)])
def test_replicates(spark, monkeypatch, name, rep, groups):
    monkeypatch.setattr(B, "interval", lambda draws, *a: draws)
    draws = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert draws.count() == 2000 * groups and draws.select(rep).distinct().count() == 2000


def test_every_document_has_a_row(spark, tmp_path):
    rows = [(1, "a b " * 2000, "fr"), (2, None, None), (3, "", "en"), (4, "12 34", "de"), (5, "Zanzibar the of and\nle la Zanzibar", "fr")]
    put(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string")
    d = put(spark, tmp_path, "benchmark", [(k, "Zanzibar") for k in range(40)], "item_id long, text string")
    trigrams = {r.doc_id: r.n for r in QUERIES["trigrams"](spark, d).collect()}
    assert trigrams == {1: 4, 2: 1, 3: 1, 4: 3, 5: len({t[k : k + 3] for t in ["Zanzibar the of and le la Zanzibar"] for k in range(len(t) - 2)})}
    assert {r.doc_id: r.ok for r in QUERIES["lang_ok"](spark, d).collect()} == {1: False, 2: False, 3: False, 4: False, 5: True}
    assert {(r.doc_id, r.pos): r.bm25 > 0 for r in QUERIES["bm25_sentences"](spark, d).collect()} == {(1, 0): False, (4, 0): False, (5, 0): True, (5, 1): True}


def test_page_store_keeps_whole_pages(spark, tmp_path):
    d = put(spark, tmp_path, "pages", [(2, "u", "late"), (1, "u", "x" * 5000)], "page_id long, url string, html string")
    assert QUERIES["page_store"](spark, d).first().text == "x" * 5000


def test_best_match_statuses(spark):
    left = [(1, "k", "one two three"), (2, "k", "one two three"), (3, "k", "four five"), (4, "n", "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"), (5, "m", "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"), (6, "z", "one"), (7, None, "one"), (8, "c", "same"), (9, "k", None)]
    long = "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"
    right = [(10, "k", "one two three"), (11, "k", "six"), (20, "n", long + " x"), (21, "n", "other"), (30, "m", long + " x"), (31, "m", long + " x"), (32, "m", long + " y"), (41, "c", "same"), (40, "c", "same"), (50, None, "one")]
    a = spark.createDataFrame(left, "id long, key string, t string")
    b = spark.createDataFrame(right, "ref long, key string, u string")
    got = {r.id: (r.status, r.ref) for r in J.best_match(a, b, "key", "id", "ref", "t", "u").collect()}
    want = {1: ("exact", 10), 2: ("exact", 10), 3: ("claim_mismatch", None), 4: ("near", 20), 5: ("ambiguous", None), 6: ("no_key_match", None), 7: ("no_key_match", None), 8: ("exact_multiclaim", 40), 9: ("claim_mismatch", None)}
    assert got == want


def test_places_and_ranks(spark):
    r = random.Random(5)
    rows = [(r.choice([None, *range(30)]), r.randrange(40) + 0.5) for _ in range(700)]
    df = spark.createDataFrame(rows, "a int, b double")
    order = sorted(x for _, x in rows)
    got = {p.value: (p.m, p.below, p.n) for p in M.places(df, "b").collect()}
    assert got == {v: (order.count(v), order.index(v), len(order)) for v in set(order)}
    held = sorted(x for x, _ in rows if x is not None)
    assert tuple(M.index_quantile(df, "a", 0.95).first()) == (len(held), held[int(len(held) * 0.95)])
    cuts = [x.value for x in M.quantiles_exclusive(df, "b", 10).orderBy("k").collect()]
    assert cuts == pytest.approx(statistics.quantiles(order, n=10))
    ranks = pd.DataFrame(rows, columns=["a", "b"]).fillna({"a": -1}).rank()
    got = M.spearman(df, "a", "b").first()
    assert got.n == 700 and got.rho == pytest.approx(ranks.a.corr(ranks.b))
    one = M.spearman(df.limit(1), "a", "b").first()
    assert (one.n, one.rho) == (1, None)


def test_medoids_by_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(3, 8))
    x = centres[rng.integers(0, 3, 60)] + 0.15 * rng.normal(size=(60, 8))
    x[7] = 0.0
    df = spark.createDataFrame([(k, k % 2, [float(v) for v in x[k]]) for k in range(60)], "id int, block int, v array<double>")
    got = {r.id: (r.component, r.is_medoid) for r in V.cosine_components(df, "block", "id", "v", 0.8).collect()}
    size = np.linalg.norm(x, axis=1)
    sim = x @ x.T / np.where(size[:, None] * size > 0, size[:, None] * size, 1)
    comp = list(range(60))
    for _ in range(60):
        comp = [min(comp[j] for j in range(60) if j == i or (i % 2 == j % 2 and size[i] * size[j] > 0 and round(sim[i, j], 9) >= 0.8)) for i in range(60)]
    best = {}
    for c in set(comp):
        members = [i for i in range(60) if comp[i] == c]
        best[c] = max(members, key=lambda i: (round(sum(sim[i, j] for j in members), 6), -i))
    assert got == {i: (comp[i], best[comp[i]] == i) for i in range(60)} and len(best) > 4


def test_leak_tag_by_brute_force(spark):
    r = random.Random(9)
    text = lambda: " ".join(r.choice("abcdef") for _ in range(r.randrange(0, 9)))
    docs, refs = [(k, text() + " common") for k in range(150)] + [(150, None), (151, "")], [(text(),) for _ in range(12)] + [(None,), ("",), ("",)]
    near = lambda a, b: bool(a) and bool(b) and round(len(a & b) / len(a | b), 9) >= 0.6
    words = lambda t: set((t or "").split())
    want = {k: any(near(words(t), words(b)) for (b,) in refs) for k, t in docs}
    got = {x.id: x.leak for x in C.leak_tag(spark.createDataFrame(docs, "id int, t string"), spark.createDataFrame(refs, "ref string"), "id", "t", "ref").collect()}
    assert got == want and 0 < sum(want.values()) < 150


def test_leak_tag_carries_no_sets_to_pairs(spark):
    """At a threshold of 0.3 all items meet all texts: what leaves a task is a row an item at most."""
    r = random.Random(4)
    text = lambda n: " ".join(r.sample([f"w{k}" for k in range(40)], n))
    docs, refs = [(k, text(r.randrange(1, 30))) for k in range(700)], [(text(r.randrange(1, 30)),) for _ in range(600)]
    near = lambda a, b: round(len(a & b) / len(a | b), 9) >= 0.3
    sets = [set(b.split()) for (b,) in refs]
    got = C.leak_tag(spark.createDataFrame(docs, "id int, t string"), spark.createDataFrame(refs, "ref string"), "id", "t", "ref", 0.3)
    assert {x.id: x.leak for x in got.collect()} == {k: any(near(set(t.split()), b) for b in sets) for k, t in docs}
    assert "array_intersect" not in got._jdf.queryExecution().executedPlan().toString()
