"""Guards of the ledger by hand, and the same ledger as batch and as stream."""

import datetime as dt

import pytest

from ledgerlake.operators import ledger as G
from ledgerlake.plans import evidence as E
from ledgerlake.streaming import ledger as L

FLAGS = [f"{k}_{s}" for k in ("met", "any", "full", "toward", "by_snippet") for s in ("supported", "refuted")]
SCHEMA = "post_id long, round int, claim_ref string, as_text boolean, n_claims int, proposed string, gap string, targeted boolean, final boolean, " + ", ".join(f"{c} boolean" for c in FLAGS)


def row(rnd, proposed, ref="1", post=1, **kw):
    base = {"as_text": False, "n_claims": 2, "gap": None, "targeted": False, "final": False}
    r = {**base, **dict.fromkeys(FLAGS, False), **kw}
    return (post, rnd, ref, r["as_text"], r["n_claims"], proposed, r["gap"], r["targeted"], r["final"], *(r[c] for c in FLAGS))


#: Each row with the status it leaves, its guards and whether it reopens.
HAND = [
    (row(1, "unsupported"), "open", ["unsupported-untargeted"], True),
    (row(2, "unsupported", ref="2", final=True), "unsupported", [], False),
    (row(3, "supported", targeted=True), "open", ["close-unbacked"], True),
    (row(4, "Supported", any_supported=True), "open", ["close-below-bar"], True),
    (row(5, "conflicting", full_supported=True), "open", ["conflict-one-sided"], True),
    (row(6, "odd"), "open", [], False),
    (row(7, None), "open", [], False),
    (row(8, "supported", ref="9"), None, ["cid-invalid"], False),
    (row(9, "supported", ref=None), None, [], False),
    (row(10, "supported", ref=" 1 ", as_text=True, met_supported=True, by_snippet_supported=True), "supported", ["cid-coerced", "snippet-corroboration"], False),
    (row(11, "supported"), "supported", [], False),
    (row(12, "refuted", any_refuted=True), "supported", ["close-below-bar"], False),
    (row(13, "conflicting", full_supported=True, full_refuted=True), "conflicting", [], False),
    (row(14, "open"), "open", [], False),
    (row(15, "supported", ref="x"), None, ["cid-invalid"], False),
]
BAR_OFF = [
    (row(1, "supported"), "supported", ["bar-off-accepted"], False),
    (row(2, "open"), "open", [], False),
    (row(3, "refuted", gap="a record"), "open", ["close-no-direction-evidence"], True),
    (row(4, "refuted", gap="a record", toward_refuted=True), "refuted", ["bar-off-accepted"], False),
    (row(5, "conflicting"), "conflicting", ["bar-off-accepted"], False),
    (row(6, "unsupported", ref="2"), "open", ["unsupported-untargeted"], True),
]


def result(rows):
    return [(r.status, list(r.guards), r.reopened) for r in sorted(rows, key=lambda r: r.round)]


@pytest.mark.parametrize(("hand", "code_bar"), [(HAND, True), (BAR_OFF, False)])
def test_hand_table(spark, hand, code_bar):
    df = spark.createDataFrame([h[0] for h in reversed(hand)], SCHEMA)
    assert result(G.transitions(df, code_bar).collect()) == [tuple(h[1:]) for h in hand]
    assert G.transitions(df.limit(0), code_bar).count() == 0


@pytest.fixture
def streaming(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    L.with_state_store(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def drain(df, name, checkpoint, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_the_stream_gives_what_the_batch_gives(streaming, tmp_path):
    """Conversations in three files of rounds, the second file twice: known rounds are passed over."""
    steps = E.ledger_steps(streaming, "/root/testdata/sf0.001").cache()
    cuts = [(0, 1), (2, 3), (2, 3), (4, 10**6)]
    src = tmp_path / "in"
    for k, (a, b) in enumerate(cuts):
        steps.filter(f"round BETWEEN {a} AND {b}").coalesce(1).write.mode("append").parquet(str(src))
    stream = streaming.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    key = lambda r: repr(tuple(r))
    got = drain(L.ledger_stream(stream), "ledger", tmp_path / "cp")
    want = G.transitions(steps).collect()
    assert len(want) > 20 and sorted(got, key=key) == sorted(want, key=key)


def test_a_ledger_goes_on_from_an_initial_state(streaming, tmp_path):
    steps = streaming.createDataFrame([h[0] for h in HAND], SCHEMA)
    steps.filter("round > 10").coalesce(1).write.parquet(str(tmp_path / "in"))
    begun = streaming.createDataFrame([(1, 1, "supported"), (1, 2, "unsupported")], "post_id long, claim_id int, status string")
    stream = streaming.readStream.schema(steps.schema).parquet(str(tmp_path / "in"))
    assert result(drain(L.ledger_stream(stream, begun), "begun", tmp_path / "cp")) == [tuple(h[1:]) for h in HAND[10:]]


T0 = dt.datetime(2024, 1, 1, 12)
STORED = [("a", 0, "true", 1), ("a", 100, "false", 2), ("a", 100, "mixed", 3), ("b", 50, "true", 4), ("c", 500, "late", 5)]
ASKED = [("a", -1, None), ("a", 0, "true"), ("a", 60, "true"), ("a", 61, None), ("a", 100, "mixed"), ("a", 160, "mixed"), ("a", 161, None), ("b", 40, None), ("b", 110, "true"), ("c", 490, None), ("d", 5, None)]


def tables(spark):
    s = lambda n: T0 + dt.timedelta(seconds=n)
    stored = spark.createDataFrame([(k, s(n), v, q) for k, n, v, q in STORED], "claim_key string, stored_at timestamp, verdict string, seq long")
    asked = spark.createDataFrame([(k, s(n), 100 + q) for q, (k, n, _) in enumerate(ASKED)], "claim_key string, asked_at timestamp, seq long")
    return stored, asked, sorted(((k, s(n), v) for k, n, v in ASKED), key=repr)


def test_stale_verdicts_are_a_miss(spark):
    stored, asked, want = tables(spark)
    assert sorted((tuple(r) for r in G.fresh_verdicts(stored, asked, 60).collect()), key=repr) == want
    assert G.fresh_verdicts(stored.limit(0), asked, 60).filter("verdict IS NOT NULL").count() == 0


def test_stale_verdicts_are_a_miss_in_a_stream_too(streaming, tmp_path):
    """One file a minute: timers clear what is stale between batches, and answers stay the batch's."""
    stored, asked, want = tables(streaming)
    for k, (low, high) in enumerate([(-60, 30), (30, 90), (90, 130), (130, 10**4)]):
        at = lambda df, c: df.filter(f"unix_timestamp({c}) - {int(T0.replace(tzinfo=dt.timezone.utc).timestamp())} >= {low} AND unix_timestamp({c}) - {int(T0.replace(tzinfo=dt.timezone.utc).timestamp())} < {high}")  # noqa: B023, E731
        L._events(at(stored, "stored_at"), at(asked, "asked_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = L._events(stored, asked).schema
    rows = streaming.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    s = rows.filter("NOT is_ask").select("claim_key", rows["at"].alias("stored_at"), "verdict", "seq")
    a = rows.filter("is_ask").select("claim_key", rows["at"].alias("asked_at"), "seq")
    got = drain(L.verdict_stream(s, a, 60, "1 minute"), "verdicts", tmp_path / "cp")
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_snippets_against_a_replay(spark):
    import random
    import re

    r = random.Random(6)
    words = [f"w{k}" for k in range(12)]
    rows = []
    for c in range(20):
        for k in range(12):
            old = [x for x in rows if x[0] == c and x[2]]
            text = r.choice([" ".join(r.choices(words, k=r.randrange(1, 15))), r.choice(old)[2] + r.choice([" more", "", " and yet more words here"]) if old else "a b c d e f", None, " "])
            rows.append((c, k, text))
    want, kept = [], {}
    for c, k, t in rows:
        if not (t or "").strip():
            continue
        w = re.sub(r"\W+", " ", t.lower()).split()
        s = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
        if s and any(o and len(s & o) / min(len(s), len(o)) >= 0.6 for o in kept.get(c, [])):
            continue
        kept.setdefault(c, []).append(s)
        want.append((c, k))
    df = spark.createDataFrame(r.sample(rows, len(rows)), "claim int, at int, snippet string")
    assert sorted(tuple(x) for x in G.distinct_snippets(df, "claim", "at", "snippet").collect()) == want and len(want) < len(rows)
    assert G.distinct_snippets(df.limit(0), "claim", "at", "snippet").count() == 0


@pytest.mark.parametrize("code_bar", [True, False])
def test_posts_stream_through_sorted_rows(spark, code_bar):
    """Posts that go on over slices and batches, one of them without an id: the ledger of each is its own."""
    status = ("supported", "refuted", "open", "conflicting")
    rows = [row(k, status[k * (p or 5) % 4], str(k % 3 + 1), p, targeted=k % 2 == 0, met_supported=k % 3 == 0, any_refuted=True) for p in (None, 1, 2, 3) for k in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = []
    for p in (None, 1, 2, 3):
        want += G.play([r.asDict() for r in df.collect() if r.post_id == p], {}, code_bar)
    out = G.transitions(df, code_bar)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().sparkPlan().toString()
