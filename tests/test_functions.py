"""Function tables with expected values."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import dates as D
from ledgerlake.functions import ratings as R
from ledgerlake.functions import text as X
from ledgerlake.functions import urls as N


def values(spark, rows, *exprs):
    df = spark.createDataFrame(rows)
    return [tuple(r) for r in df.select(*exprs).collect()]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.Example.com/a", "example.com"),
        ("https://web.archive.org/web/2020/https://www.site.org/x", "site.org"),
        ("http://web.archive.org/web/2019id_/http://a.b.net/", "a.b.net"),
        ("https://archive.ph/abc", "archive.ph"),
        ("https://perma.cc/XY", "perma.cc"),
        ("https://web.archive.org/about", "web.archive.org"),
        ("", None),
        ("nonsense", None),
        (None, None),
    ],
)
def test_origin(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(N.origin_domain("u")).first()[0] == want


def test_urls(spark):
    df = spark.createDataFrame(
        [("https://m.news.co.uk/A/b/?utm_source=x&b=2&a=1#f", "https://www.youtube.com/watch?v=AbC-1&t=3", "radio.foxnews.com", "a.gov.fr"), ("http://x.org", "https://youtube.com/watch?t=3", "bbc.co.uk", "academia.edu")],
        "r string, y string, d string, p string",
    )
    got = df.select(N.review_url("r"), N.citation("y"), N.voice_key("d"), N.is_primary("p")).collect()
    assert [tuple(r) for r in got] == [("news.co.uk/a/b?a=1&b=2", "youtube.com/watch?v=abc-1", "foxbusiness.com", True), ("x.org", None, "bbc.co.uk", False)]


def test_dates(spark):
    rows = [("Apr 8, 2026", "2020-02"), ("8 April 2026", "2021"), ("2026-04-08", "2020-01-05"), ("3 days ago", "2020-13"), ("", "x"), (None, None)]
    df = spark.createDataFrame(rows, "d string, p string")
    assert [r[0] for r in df.select(D.hit_date("d")).collect()] == ["2026-04-08"] * 3 + [None] * 3
    assert [r[0] for r in df.select(D.latest_day("p")).collect()] == ["2020-02-29", "2021-12-31", "2020-01-05", None, None, None]
    c = spark.createDataFrame([("2020-05-01", None, "2020-05-03"), ("2020-05-03", "2020-04", "2020-05-03"), (None, None, "2020-05-03"), (None, "2020", "2020-05-03"), (None, None, None), ("2020-05-02", None, "2020-05-03")], "c string, x string, r string")
    got = c.select(D.ceiling("c", "x", "r").alias("k")).select("k.day", "k.source").collect()
    assert [tuple(r) for r in got] == [("2020-05-01", "claim_date"), ("2020-04-30", "x_date"), ("2020-05-02", "review-1"), ("2020-05-02", "x_date+clamped"), ("", "none"), ("2020-05-02", "claim_date+clamped")]
    r = spark.createDataFrame([("3 days ago",), ("2 months ago",), ("1 year ago",), ("soon",)], "d string")
    assert [x[0] for x in r.select(D.relative_date("d", F.lit(dt.date(2020, 3, 10)))).collect()] == ["2020-03-07", "2020-01-10", "2019-03-11", None]


def test_ratings(spark):
    rows = [("False", None), ("True, but missing caveat", None), ("Mostly True", 2.0), ("whatever", 1.0), ("whatever", 4.0), ("whatever", None), ("No evidence", None), ("Faux", 5.0), ("SATIRE", None), ("", None)]
    df = spark.createDataFrame(rows, "t string, v double")
    got = df.select(R.veracity("t", "v").alias("x")).select("x.veracity", "x.subtype").collect()
    assert [tuple(r) for r in got] == [(1, "clear_false"), (None, ""), (4, "mostly_true"), (1, "clear_false"), (4, "mostly_true"), (None, ""), (3, "unprovable"), (5, "clear_true"), (1, "satire"), (None, "")]
    f = spark.createDataFrame([(["5", "2"],), (["4", "I"],), (["2", "X"],), (["3", "X"],), (["I"],), ([],)], "f array<string>")
    assert [r[0] for r in f.select(R.page_flag(F.col("f"))).collect()] == ["3", "4", "2", "3", "I", "I"]


def test_text(spark):
    df = spark.createDataFrame([("Hello.  World again! hello.\nA \"quoted\" End? HELLO.", "&amp;amp; é​"), (None, None)], "t string, h string")
    r = df.select(X.sentences("t").alias("s"), X.clean_text_udf("h").alias("c"), X.char_trigrams(F.lit("abab")).alias("g"), X.norm("t").alias("n")).collect()
    assert r[0].s == ["Hello.", "World again! hello.", 'A "quoted"', "End?"] and r[0].c == "& é" and r[0].g == ["aba", "bab"] and r[1].s == [] and r[1].n == ""
    j = spark.createDataFrame([('x {"a": "}"} y', '[3, "5-7", [1, 2]]'), ("none {", "[true]"), (None, None)], "j string, e string")
    assert [tuple(x) for x in j.select(X.first_json_udf("j"), X.evidence_ids_udf("e")).collect()] == [('{"a": "}"}', [1, 2, 3, 5, 6, 7]), (None, None), (None, None)]


def test_snowflake(spark):
    df = spark.createDataFrame([(1212092628029698048,)], "i long")
    assert df.select(X.snowflake_time("i").cast("string")).first()[0].startswith("2019-12-31")


def test_hosts_by_hand(spark):
    from ledgerlake.functions import urls as U

    hand = {"snopes.com": (False, True, True), "www.politifact.com": (False, True, True), "afp.com": (False, True, False), "factuel.afp.com": (False, True, True), "iaea.org": (True, False, False), "link.springer.com": (True, False, False), "example.com": (False, False, False)}
    df = spark.createDataFrame([(d,) for d in hand], "d string")
    got = {r.d: (r.a, r.b, r.c) for r in df.select("d", U.is_primary("d").alias("a"), U.is_fact_checker("d").alias("b"), U.is_trusted_checker("d").alias("c")).collect()}
    assert got == hand
    row = spark.range(1).select(U.review_url(F.lit("https://m.site.org/a/?via=x&id=7&cmpid=1&SMID=2")).alias("r"), U.post_url(F.lit("https://fb.com/p?id=1&__tn__=R&_rdr=1")).alias("p"), X.word_shingles(F.lit("a b c d e f g h i")).alias("s"), X.word_shingles(F.lit("a b")).alias("n")).first()
    assert row.r == "site.org/a?id=7" and row.p == "https://fb.com/p?id=1" and row.s == ["a b c d e f g h", "b c d e f g h i"] and row.n == []


def test_norms_from_the_beginning_alone(spark):
    """Long texts: what the beginning gives is what the whole gives, also with a URL, blanks or a long word at its end; else the whole is read."""
    word = "Abc, dé'f-g " * 60
    texts = [word * 10, word[:1190] + " https://a.b/" + "x" * 3000 + " " + word, "x" * 4000 + " y", " " * 5000 + word, "!? " * 2000 + word, "Σ" * 3000 + " " + word, "", None, word[:400]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")

    def plain(t, keep, limit):
        t = re.sub(r"https?://\S+", "", (t or "").lower())
        return re.sub(r"\s+", " ", re.sub(rf"[^a-z0-9_\s'{keep}-]", " ", t)).strip()[:limit]

    for r in df.select("id", X.norm("t").alias("n"), X.norm_claim("t").alias("c"), X.norm_template("t").alias("p")).collect():
        t = texts[r.id]
        assert (r.n, r.c) == (plain(t, X.ACCENTED, 500), plain(t, "", 400))
        assert r.p == re.sub(r"[^a-z0-9_]+", " ", (t or "").lower()).strip()[:400]


def test_trigrams_are_counted_without_their_strings(spark):
    from ledgerlake.operators import trigrams as W

    texts = ["", None, "a", "ab", "abc", "aaaa", "  a  b ", "é😀x é😀x", "abcabcabd"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = [tuple(r) for r in df.orderBy("id").select(W.gram_count(X.squeeze("t")), F.size(X.char_trigrams("t"))).collect()]
    assert all(n == m for n, m in got) and got[0][0] == 1 and got[5][0] == 1 and got[8][0] == 4


def test_texts_are_objects_a_few_rows_at_a_time(spark):
    """A batch of Arrow's is cut into slices: results are those of single rows, nulls and empty batches included."""
    import pyarrow as pa

    seen = []
    texts = [None, "", "A &amp; B", *(f"line {k}" for k in range(X.ROWS * 2))]
    got = X.by_rows(lambda a, b: seen.append(1) or (None if a is None else a * b), pa.string(), pa.array(texts), pa.array([2] * len(texts)))
    assert got.to_pylist() == [None if t is None else t * 2 for t in texts] and X.by_rows(str, pa.string(), pa.array([], pa.string())).to_pylist() == []
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    out = df.select("t", X.clean_text_udf("t").alias("c"), X.sentences("t").alias("s")).collect()
    assert [r.c for r in out] == [t and t.replace("&amp;", "&") for t in texts] and [r.s for r in out] == [[t] if t else [] for t in texts]


def test_sentences_keep_the_digits_of_their_place(spark):
    df = spark.createDataFrame([("In year 0\n 1 of 11 \n2 and 2 ",)], "t string")
    assert df.select(X.sentences("t").alias("s")).first().s == ["In year 0", "1 of 11", "2 and 2"]
