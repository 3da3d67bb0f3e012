"""Rules by hand tables, models against numpy and brute force."""

import math

import numpy as np
import pytest

from ledgerlake.operators import rules as R
from pyspark.sql import Observation
from pyspark.sql import functions as F


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}").orderBy("k").select(expr).collect()]


def test_gates_by_hand(spark):
    rows = [("politics", False, False, True), ("politics", True, False, True), ("politics", None, None, None), ("sports", False, False, True), (None, False, False, True), ("politics", False, True, True), ("politics", False, False, False)]
    schema = "topic string, trivial boolean, unresolved boolean, falsifiable boolean"
    plain = R.checkworthy("topic", "trivial", "unresolved", "falsifiable")
    assert column(spark, rows, schema, plain) == [True, True, True, True, True, False, False]
    assert column(spark, rows, schema, R.checkworthy("topic", "trivial", "unresolved", "falsifiable", on_trivial=True, topics=("politics",))) == [True, False, True, False, False, False, False]
    assert column(spark, rows, schema, R.verify_eligible(plain, "topic")) == [True, True, True, False, True, False, False]


def test_routes_by_hand(spark):
    rows = [("HomeTimeline", "me", "said", "paper"), ("HomeTimeline", None, None, "paper"), ("Search", "me", "", "someone"), ("HomeTimeline", "", None, None)]
    schema = "op string, account string, quoted string, handle string"
    assert column(spark, rows, schema, R.frame_of("op", "account", ("HomeTimeline",))) == ["feed", "search_june", None, None]
    assert column(spark, rows, schema, R.voice_of("quoted", "handle", ["paper"])) == ["quote", "outlet", "user", "user"]
    assert column(spark, [("prepped", None), ("prepped", "yes"), (None, "no"), ("prepped", "no")], "status string, echo string", R.leak_kept("status", "echo")) == [True, False, False, True]
    assert column(spark, [(" quote_attribution ",), ("policy_law",), (None,), ("",)], "t string", R.claim_mode("t")) == ["attribution"] + ["assertion"] * 3


def test_texts_by_hand(spark):
    rows = [("The boy believed it", "assertion"), ("A 9-year-old girl hopes", "assertion"), ("The minister believes", "assertion"), (None, None)]
    assert column(spark, rows, "c string, t string", R.private_inner_state("c")) == [True, True, False, False]
    rows = [("Some fans of the club said so", "attribution"), ("Analysts said it rose", "attribution"), ("Fans heard that Smith said so, people claim", "attribution"), ("According to many residents it burned", "attribution"), ("According to residents Smith said so", "attribution"), ("Some fans said so", "assertion"), (None, "attribution")]
    assert column(spark, rows, "c string, t string", R.anonymous_collective("c", "t")) == [True, True, False, True, False, False, False]


def test_post_status_by_hand(spark):
    posts = spark.createDataFrame([(1,), (2,), (3,), (4,)], "post long")
    claims = spark.createDataFrame([(1, None, True, True), (1, "dup", True, True), (2, None, True, False), (2, None, None, None), (3, "dup", True, True), (9, None, True, True)], "post long, removed_reason string, checkworthy boolean, eligible boolean")
    got = {r.post: tuple(r)[1:] for r in R.post_manifest(posts, claims, "post").collect()}
    assert got == {1: (1, 1, 1, 1, "verify"), 2: (2, 1, 0, 0, "skip_none_checkworthy"), 3: (0, 0, 0, 1, "skip_no_claims"), 4: (0, 0, 0, 0, "skip_no_claims")}


def test_binary_variants_by_hand(spark):
    rows = [("Supported", "Supported"), ("Refuted", "Refuted"), ("Refuted", "Supported"), ("Conflicting Evidence/Cherrypicking", "Refuted"), ("Not Enough Evidence", "Refuted"), ("Supported", "Conflicting Evidence/Cherrypicking")]
    got = {r.variant: tuple(r)[1:4] + (round(r.recall, 6), round(r.fpr, 6)) for r in R.binary_variants(spark.createDataFrame(rows, "g string, p string"), "g", "p").collect()}
    assert got == {"A": (6, 4, 2, 0.75, 0.5), "B": (6, 3, 3, 0.666667, 0.333333), "C": (5, 3, 2, 0.666667, 0.5)}


def test_wire_filter_pads_freed_slots(spark):
    docs = [(1, "5", False, None)] * 3 + [(1, "1", True, None), (1, "1", None, 1), (1, "odd", False, None), (2, "1", True, None)] + [(3, "4", False, None)] * 12
    got = {(r.c, r.flag): r.n for r in R.wire_filtered_counts(spark.createDataFrame(docs, "c int, f string, origin_copy boolean, syndicated_of int"), "c", "f", ["5", "4", "I", "1"]).collect()}
    assert got[1, "5"] == 3 and got[1, "I"] == 7 and got[1, "1"] == 0 and got[2, "I"] == 10 and got[3, "4"] == 12 and got[3, "I"] == 0


def test_sample_is_rewritten_only_when_it_grows(spark):
    ids = lambda *x: spark.createDataFrame([(k,) for k in x], "k long")
    take = lambda a, b: sorted(r.k for r in R.pinned(a, b, "k").collect())
    assert take(ids(1, 2, 3), ids(1, 9)) == [1, 2, 3] and take(ids(1, 2), ids(8, 9)) == [8, 9] and take(ids(4), ids(4).limit(0)) == [4]


def test_strata_need_rows_and_both_classes(spark):
    rows = [("a", k / 10, k % 2) for k in range(40)] + [("b", 1.0, 1)] * 30 + [("c", 1.0, k % 2) for k in range(19)] + [("d", 5.0, k % 2) for k in range(20)]
    got = {r.s: (r.n, r.n_true, r.auc) for r in R.stratum_report(spark.createDataFrame(rows, "s string, score double, y int"), "s").collect()}
    want = np.mean([(t > f) + 0.5 * (t == f) for t in range(1, 40, 2) for f in range(0, 40, 2)])
    assert got.keys() == {"a", "d"} and got["a"] == (40, 20, pytest.approx(want)) and got["d"] == (20, 10, 0.5)


def test_regression_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5)) * [1, 1e4, 1e-3, 3, 50] + [0, 1e5, 0, 2, 9]
    y = x @ [2, 1e-4, 300, -1, 0.5] + 7 + rng.normal(size=500)
    names = [f"x{k}" for k in range(5)]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)] + [(None, 1.0, 1.0, 1.0, 1.0, 1.0)], ", ".join(f"{n} double" for n in [*names, "y"]))
    got = {r.term: (r.estimate, r.se) for r in R.regression(df, "y", names).collect()}
    design = np.column_stack([np.ones(500), x])
    beta, rest, *_ = np.linalg.lstsq(design, y, rcond=None)
    se = np.sqrt(rest[0] / 494 * np.diag(np.linalg.inv(design.T @ design)))
    for name, b, s in zip(["intercept", *names], beta, se):
        assert got[name] == (pytest.approx(b, rel=1e-5), pytest.approx(s, rel=1e-5))
    assert R.regression(df.limit(0), "y", names).count() == 0


def brute_merges(true, false, parents=None):
    cells = [[k, t, f] for k, (t, f) in enumerate(zip(true, false))]
    part = lambda x: x * math.log(x)
    out = []
    while len(cells) > 2:
        best = None
        for i in range(len(cells)):
            for j in range(i + 1, len(cells)):
                if parents and parents[cells[i][0]] != parents[cells[j][0]]:
                    continue
                a, b, c, d = cells[i][1] + 0.5, cells[i][2] + 0.5, cells[j][1] + 0.5, cells[j][2] + 0.5
                g = 2 * (part(a) + part(b) + part(c) + part(d) + part(a + b + c + d) - part(a + b) - part(c + d) - part(a + c) - part(b + d))
                if best is None or g < best[0]:
                    best = (g, i, j)
        if best is None:
            break
        g, i, j = best
        out.append((cells[i][0], cells[j][0], g))
        cells[i][1] += cells[j][1]
        cells[i][2] += cells[j][2]
        del cells[j]
    return out


@pytest.mark.parametrize("parents", [None, [k % 4 for k in range(28)]])
def test_merges_against_brute_force(parents):
    rng = np.random.default_rng(3)
    t, f = rng.integers(0, 60, 28).tolist(), rng.integers(0, 60, 28).tolist()
    got, want = R.merge_path(t, f, parents), brute_merges(t, f, parents)
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_scorecard_is_one_scan_and_can_be_observed(spark):
    df = spark.range(100).withColumn("v", F.when(F.col("id") % 10 > 0, F.col("id")))
    rules = {"known": F.col("v").isNotNull(), "small": F.col("v") < 50}
    card = R.scorecard(df, rules)
    assert {r.rule: (r.n, r.broken) for r in card.collect()} == {"known": (100, 10), "small": (100, 55)}
    assert card._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Range (") == 1
    seen = Observation("rules")
    assert R.observed(df, rules, seen).count() == 100 and seen.get == {"n": 100, "known": 10, "small": 55}


def test_functions_for_sql(spark):
    from ledgerlake.functions.registered import register

    register(spark)
    docs = spark.createDataFrame([(1, "one line\ntwo\none line"), (2, None), (3, ""), (1, "zwei Zeilen\none line"), (None, "of nobody")], "key long, body string")
    got = spark.sql("SELECT * FROM line_rows(TABLE(SELECT key, body FROM {docs}), 4)", docs=docs)
    assert got.columns == ["key", "line_no", "line", "n_chars", "repeated"]
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == sorted([(1, 0, "one line", 8, False), (1, 1, "one line", 8, True), (1, 2, "zwei Zeilen", 11, False), (1, 3, "one line", 8, True), (None, 0, "of nobody", 9, False)], key=repr)
    with pytest.raises(Exception, match="takes a table"):
        spark.sql("SELECT * FROM line_rows(TABLE(SELECT key FROM {docs}), 4)", docs=docs).collect()
    values = spark.createDataFrame([(1, 1.0), (1, 100.0), (1, 3.0), (1, 4.0), (2, 5.0), (2, 6.0), (3, None)], "g int, v double")
    assert {r.g: r.m for r in spark.sql("SELECT g, trimmed_mean(v) AS m FROM {values} GROUP BY g", values=values).collect()} == {1: 3.5, 2: 5.5, 3: None}


def test_quantiles_and_places_against_numpy(spark):
    from ledgerlake.operators.metrics import linear_quantiles
    from ledgerlake.operators.relational import minmax_rank

    v = np.random.default_rng(4).integers(0, 50, 999).astype(float)
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)] + [(1000, None)], "k long, v double")
    shares = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    got = {r.k: r.value for r in linear_quantiles(df, "v", shares).collect()}
    assert [got[k] for k in range(6)] == pytest.approx(np.quantile(v, shares).tolist())
    assert linear_quantiles(df.limit(0), "v", [0.5]).count() == 0
    places = {r.k: r.place for r in minmax_rank(df.filter("v is not null").withColumn("likes", F.lit(1)), "v", "likes", "k").collect()}
    order = sorted(range(999), key=lambda k: (-v[k], k))
    assert [places[k] for k in order] == list(range(1, 1000))
