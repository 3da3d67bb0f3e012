import pytest
"""Readers, writers, stores and streams on temporary folders."""

import json
import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.sources import files as I
from ledgerlake.sources.paged import PagedSource
from ledgerlake.streaming import flow as W

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.IntegerType()), T.StructField("ok", T.BooleanType())])


def test_records_last_wins(spark, tmp_path):
    (tmp_path / "shard-0.jsonl").write_text('{"id": "a", "v": 1, "ok": true}\n{"id": "b", "v": 1, "ok": false}\n{"id": "a", "v": 2, "ok": true}\n{"torn": ')
    rows, bad = I.read_ndjson(spark, str(tmp_path), SCHEMA, ("id",))
    assert rows.count() == 3 and bad.count() == 1
    got = I.load_records(spark, str(tmp_path), SCHEMA, "id", "ok").collect()
    assert [(r.id, r.v) for r in got] == [("a", 2)]
    I.compact(spark, str(tmp_path), str(tmp_path / "out"), SCHEMA, "id")
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_zipped_tsv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "n.zip", "w") as z:
        z.writestr("a.tsv", "id\tx\tt\n1\tq\té\n2\tr\t\"open\n")
    got = I.read_zipped_tsv(spark, str(tmp_path / "n.zip"), ["t", "id", "none"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("é", "1", None), ('"open', "2", None)]


def test_sinks_and_manifest(spark, tmp_path):
    df = spark.range(40).withColumn("t", F.lit("x"))
    I.write_sharded(df, str(tmp_path / "s"), "id")
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() > 8
    I.write_csv(df, str(tmp_path / "c"))
    I.write_ndjson(df, str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == spark.read.json(str(tmp_path / "j")).count() == 40
    (tmp_path / "f.txt").write_bytes(b"abc")
    m = I.manifest(spark, [str(tmp_path / "f.txt")], [("all", 3)])
    assert m["inputs"][0]["sha256"] == I.file_sha256(b"abc") and m["rules"] == [{"rule": "all", "rows": 3}]


def test_store(spark, tmp_path):
    store = I.Store(spark, str(tmp_path / "kv"))
    asked = spark.createDataFrame([("a", 1, True), ("b", 1, False)], "key string, v int, ok boolean")
    assert store.missing(asked).count() == 2
    store.put(asked, 1, "ok")
    assert [r.key for r in store.missing(asked).collect()] == ["b"]
    store.put(asked.withColumn("v", F.lit(7)), 2)
    assert {r.key: r.v for r in store.read().collect()} == {"a": 7, "b": 7}


def test_captures(spark):
    node = {"data": [{"rest_id": "1", "legacy": {"full_text": "hi"}, "core": {"user_results": {"result": {"legacy": {"screen_name": "u"}}}}}, {"promotedMetadata": {}, "x": {"rest_id": "2", "legacy": {"full_text": "ad"}}}, {"rest_id": "1", "legacy": {"full_text": "again"}}]}
    df = spark.createDataFrame([(json.dumps(node),), ("torn{",), (None,)], "j string")
    got = [r[0] for r in df.select(I.posts_in_json("j")).collect()]
    assert [tuple(x) for x in got[0]] == [("1", "hi", "u", False), ("2", "ad", None, True)] and got[1] == got[2] == []
    m = spark.createDataFrame([([("photo", "p", None), ("video", "low", 1), ("video", "high", 9)],)], "media array<struct<type:string,url:string,bit_rate:bigint>>")
    r = m.select(I.media_urls().alias("m")).select("m.images", "m.video").first()
    assert (r.images, r.video) == (["p"], "high")
    rows = spark.createDataFrame([("1", "t", None, "f", 1), ("1", "u", "x", "f", 2)], "id string, full_text string, retweeted_by string, file string, line long")
    assert tuple(I.merge_captures(rows).first()) == ("1", "t", "x")


def test_pages(spark):
    df = spark.createDataFrame([('<p><script id="d" type="application/json">{"a": 1}</script>',), ("<p>",)], "h string")
    assert [r[0] for r in df.select(I.page_payload(F.col("h"), "d")).collect()] == ['{"a": 1}', None]
    d = spark.createDataFrame([(1, json.dumps({"claimReviews": [{"claimReviewed": ["c", "d"], "url": "u", "reviewRating": {"alternateName": "False"}}, {"claimReviewed": "e"}]}))], "id long, json string")
    assert [(r.pos, r.claimReviewed, r.url, r.rating) for r in I.flatten_reviews(d).orderBy("pos").collect()] == [(0, "c", "u", "False"), (1, "e", None, None)]


def test_paged_source(spark, tmp_path):
    (tmp_path / "a.org-en-0.json").write_text(json.dumps({"claims": [{"text": "t1", "url": "u1", "rating": "r"}], "nextPageToken": "n"}))
    (tmp_path / "a.org-en-n.json").write_text(json.dumps({"claims": [{"text": "t2"}]}))
    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged_claims").option("pages", str(tmp_path)).option("feeds", json.dumps([["a.org", "en"]])).load()
    assert [r.claim_text for r in df.orderBy("claim_text").collect()] == ["t1", "t2"]


def _events(spark, path, n=60):
    rows = [(k, f"2024-01-01 00:00:{k:02d}", "p", k % 4 == 0) for k in range(n)]
    df = spark.createDataFrame(rows, "event_id long, t string, key string, ok boolean").select("event_id", F.to_timestamp("t").alias("ts"), "key", "ok")
    df.coalesce(1).write.parquet(path)
    return df


def test_breaker_stream_equals_batch(spark, tmp_path):
    df = _events(spark, str(tmp_path / "in"))
    stream = W.breaker(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("modes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.event_id: r["mode"] for r in spark.sql("SELECT * FROM modes").collect()}
    assert got == {r.event_id: r["mode"] for r in W.breaker_batch(df).collect()} and set(got.values()) >= {"closed", "open"}


def test_gate_steps():
    s = W.GATE_START
    for k in range(19):
        s = W.gate_step(s, 10.0 + k / 10, True)
    assert s[0] == 160.0  # too few attempts to say anything
    s = W.gate_step(s, 12.0, True)
    assert s == (128.0, [], 12.0, 12.0)
    for k in range(25):
        s = W.gate_step(s, 13.0 + k / 10, True)
    assert s[0] == 128.0  # one cut in half a span
    s = W.gate_step(s, 42.0, True)
    assert s[0] == pytest.approx(102.4)
    for k in range(40):
        s = W.gate_step(s, 60.0 + 31 * k, False)
    assert s[0] == 200.0


def test_breaker_starts_anew_after_a_good_probe():
    s = ("closed", [], 0.0)
    for k in range(10):
        s = W.breaker_step(s, False, float(k))
    assert s == ("open", [], 9.0)
    assert W.breaker_step(s, True, 39.0) == ("closed", [], 9.0) and W.breaker_step(s, False, 39.0) == ("open", [], 39.0)


def test_land_and_upsert(spark, tmp_path):
    df = _events(spark, str(tmp_path / "in"), 20)
    stream = W.land(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "event_id", "ts")
    q = stream.writeStream.foreachBatch(W.upsert_batch(str(tmp_path / "out"), "event_id")).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    write = W.upsert_batch(str(tmp_path / "out"), "event_id")
    write(df, 99)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
