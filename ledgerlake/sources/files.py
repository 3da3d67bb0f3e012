"""Readers and writers: tolerant NDJSON, captures, zipped TSV, embedded payloads, last-wins stores, manifests, shards, caches."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import keep_first, last_wins, upsert


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_ndjson(spark: SparkSession, path, schema: T.StructType, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): rows of a declared schema with `line`, their place by file and line; torn lines and rows without a required field are bad."""
    raw = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line")).filter(F.trim("value") != "")
    parsed = raw.select("value", "file", "line", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    wrong = F.col("r").isNull() | F.col("r._bad").isNotNull()
    for c in required:
        wrong = wrong | F.col(f"r.{c}").isNull()
    marked = parsed.withColumn("wrong", F.coalesce(wrong, F.lit(True)))
    return marked.filter("not wrong").select(*[F.col(f"r.{f.name}") for f in schema], "file", "line"), marked.filter("wrong").select("value", "file", "line")


def load_records(spark: SparkSession, path, schema: T.StructType, key: str, ok: str | None = None) -> DataFrame:
    """Records of sharded NDJSON files: torn lines are skipped, the last line of a key counts."""
    rows, _ = read_ndjson(spark, path, schema, (key,))
    rows = rows.withColumn("__seq", F.struct("file", "line"))
    out = last_wins(rows, [key], "__seq").drop("__seq", "file", "line")
    return out.filter(F.col(ok)) if ok else out


def compact(spark: SparkSession, path: str, out: str, schema: T.StructType, key: str) -> None:
    """Rewrite an append-only store with one line a key."""
    load_records(spark, path, schema, key).write.mode("overwrite").json(out)


def capture_pool(rows: DataFrame, lang: str | None = None) -> DataFrame:
    """Captured posts, the first copy of each id by file and line; with lang, only organic posts of more than 15 characters in it."""
    first = keep_first(rows, ["id"], ["file", "line"])
    return first.filter((F.col("lang") == lang) & (F.length("full_text") > 15) & ~F.coalesce("promoted", F.lit(False))) if lang else first


def merge_captures(rows: DataFrame) -> DataFrame:
    """One row a post: the first copy, with `retweeted_by` from any copy that has it."""
    others = [c for c in rows.columns if c not in ("id", "retweeted_by", "file", "line")]
    return rows.groupBy("id").agg(F.min_by(F.struct(*others), F.struct("file", "line")).alias("r"), F.min_by("retweeted_by", F.when(F.col("retweeted_by").isNotNull(), F.struct("file", "line"))).alias("retweeted_by")).select("id", *[F.col(f"r.{c}") for c in others], "retweeted_by")


def media_urls(media: str = "media"):
    """struct(images, video): photo URLs, and the video with the greatest bit rate."""
    images = F.transform(F.filter(media, lambda m: m["type"] == "photo"), lambda m: m["url"])
    videos = F.transform(F.filter(media, lambda m: m["type"] == "video"), lambda m: F.struct(F.coalesce(m["bit_rate"], F.lit(0)).alias("rate"), m["url"].alias("url")))
    return F.struct(images.alias("images"), F.array_max(videos)["url"].alias("video"))


def read_zipped_tsv(spark: SparkSession, path, fields: list[str]) -> DataFrame:
    """Named columns of tab-separated members of zip files; zip can't be split, so a file is one task, streamed by row."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])

    def rows(batches):
        for b in batches:
            for content in b["content"]:
                held = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        with z.open(name) as f:
                            for r in csv.DictReader(io.TextIOWrapper(f, "utf-8", errors="replace"), delimiter="\t", quoting=csv.QUOTE_NONE):
                                held.append([r.get(c) for c in fields])
                                if len(held) == 5000:
                                    yield pd.DataFrame(held, columns=fields)
                                    held = []
                if held:
                    yield pd.DataFrame(held, columns=fields)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def page_payload(html, id_: str = "", kind: str = "application/json"):
    """The text of the first script of a type (and id) in a page; null without one."""
    want = rf'(?is)<script[^>]*{f"id=.{id_}.[^>]*" if id_ else ""}type=.{re.escape(kind)}.[^>]*>(.*?)</script>'
    return F.nullif(F.regexp_extract(html, want, 1), F.lit(""))


def flatten_reviews(dump: DataFrame, list_col: str = "claimReviews") -> DataFrame:
    """One row a review of a nested dump; fields that are a scalar or a list give their first value."""
    first = lambda c: F.coalesce(F.get_json_object("r", f"$.{c}[0]"), F.get_json_object("r", f"$.{c}"))
    items = dump.select("id", F.posexplode(F.from_json(F.get_json_object("json", f"$.{list_col}"), "array<string>")).alias("pos", "r"))
    return items.select("id", "pos", *[first(c).alias(c) for c in ("claimReviewed", "url", "datePublished")], F.coalesce(F.get_json_object("r", "$.reviewRating.alternateName"), F.get_json_object("r", "$.reviewRating[0].alternateName")).alias("rating"))


@F.udf(T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("author", T.StringType()), T.StructField("promoted", T.BooleanType())])))
def posts_in_json(text):
    """Post-shaped nodes (an id with a legacy text) anywhere in a JSON response, each id once, advertisements marked."""
    try:
        todo, found = [(json.loads(text), False)], {}
    except (TypeError, ValueError):
        return []
    while todo:
        node, ad = todo.pop()
        if isinstance(node, list):
            todo += [(x, ad) for x in reversed(node)]
        elif isinstance(node, dict):
            ad = ad or "promotedMetadata" in node
            legacy = node.get("legacy")
            if "rest_id" in node and isinstance(legacy, dict) and "full_text" in legacy:
                user = (((node.get("core") or {}).get("user_results") or {}).get("result") or {}).get("legacy") or {}
                found.setdefault(str(node["rest_id"]), (str(node["rest_id"]), legacy["full_text"], user.get("screen_name"), ad))
            todo += [(x, ad) for x in reversed(list(node.values()))]
    return list(found.values())


# -- sinks ------------------------------------------------------------------------------------------


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def shard(key, n: int = 16):
    """Shard of a key: its SHA-1 modulo n (n a power of 16 at most 4,096)."""
    digits = {16: 1, 256: 2, 4096: 3}[n]
    return F.conv(F.right(F.sha1(key), F.lit(digits)), 16, 10).cast("int")


def write_sharded(df: DataFrame, path: str, key: str, n: int = 16) -> None:
    df.withColumn("shard", shard(F.col(key).cast("string"), n)).repartition(n, "shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def manifest(spark: SparkSession, inputs: list[str], rules: list[tuple[str, int]]) -> dict:
    """Rule chain with counts, and the SHA-256 of every input file."""
    files = spark.read.format("binaryFile").load(inputs).select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path").collect()
    return {"rules": [{"rule": r, "rows": n} for r, n in rules], "inputs": [{"path": f.path, "bytes": f.length, "sha256": f.sha256} for f in files]}


class Store:
    """Append-only keyed store in Parquet: the last write of a key counts, failures are not kept, done keys are not asked again."""

    def __init__(self, spark: SparkSession, path: str, key: str = "key"):
        self.spark, self.path, self.key = spark, path, key

    def _exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame | None:
        return last_wins(self.spark.read.parquet(self.path), [self.key], "seq").drop("seq") if self._exists() else None

    def missing(self, asked: DataFrame) -> DataFrame:
        have = self.read()
        return asked if have is None else asked.join(have.select(self.key), self.key, "left_anti")

    def put(self, rows: DataFrame, seq: int, ok: str | None = None) -> None:
        (rows.filter(F.col(ok)) if ok else rows).withColumn("seq", F.lit(seq).cast("long")).write.mode("append").parquet(self.path)

    def upsert(self, rows: DataFrame, seq: int) -> DataFrame:
        have = self.read()
        return rows if have is None else upsert(have, rows, self.key)


def page_store(pages: DataFrame, url: str, text: str, order: str) -> DataFrame:
    """Content-addressed pages: one text a URL, the first writer's."""
    return pages.groupBy(F.sha2(F.col(url), 256).alias("page_key")).agg(F.min_by(F.struct(F.col(url).alias("url"), F.col(text).alias("text")), order).alias("p")).select("page_key", "p.url", "p.text")


def file_sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
