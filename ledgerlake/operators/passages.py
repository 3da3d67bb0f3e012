"""Passage selection: BM25 over sentences and chunks, region tiles, context windows, numbered blocks, MMR."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

K1, B = 1.2, 0.75


def sentence_rows(pages: DataFrame, page: str, sents) -> DataFrame:
    """(page, pos from 0, sentence)."""
    return pages.select(page, F.posexplode(sents).alias("pos", "sentence"))


def bm25_sentences(rows: DataFrame, page: str, pos: str, sentence: str, query) -> DataFrame:
    """rows with `bm25`: presence BM25 of a page's sentences for the query terms, with the idf of that page.

    query: a column of the rows with the terms' array.
    """
    # terms are read where the rows are: their number and the shared ones are shuffled, once, by page
    terms = rows.withColumn("__s", X.anchor_terms(sentence)).withColumn("__len", F.size("__s")).withColumn("__hits", F.array_intersect("__s", query)).drop("__s")
    per_page = Window.partitionBy(page)
    sized = terms.withColumn("__row", F.monotonically_increasing_id()).withColumn("__n", F.count(F.lit(1)).over(per_page)).withColumn("__avg", F.greatest(F.avg("__len").over(per_page), F.lit(1.0)))
    hits = sized.select(*rows.columns, "__row", "__n", "__avg", "__len", F.explode_outer("__hits").alias("__t"))
    df = F.count(F.lit(1)).over(Window.partitionBy(page, "__t"))
    idf = F.ln(1 + (F.col("__n") - df + 0.5) / (df + 0.5))
    part = F.when(F.col("__t").isNotNull(), idf * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("__len") / F.col("__avg"))))
    others = [c for c in rows.columns if c not in (page, pos)]
    mass = hits.withColumn("__x", part).groupBy(page, pos, "__row").agg(F.sum("__x").alias("__m"), *[F.first(c).alias(c) for c in others])
    return mass.select(*rows.columns, F.coalesce(F.sum("__m").over(Window.partitionBy(page, pos)), F.lit(0.0)).alias("bm25"))


def chunks(text, words: int = 300, stride: int = 250):
    """Array of word windows."""
    w = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(stride))
    return F.when(F.size(w) > 0, F.transform(starts, lambda k: F.array_join(F.slice(w, k + 1, F.lit(words)), " "))).otherwise(F.array().cast("array<string>"))


def bm25_corpus(docs: DataFrame, doc: str, words, query: list[str]) -> DataFrame:
    """(doc, bm25) over a whole collection, with term frequencies; documents without a query term are left out."""
    held = docs.select(F.col(doc).alias("doc"), F.size(words).alias("len"), words.alias("w"))
    stats = held.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    tf = held.select("doc", "len", F.explode("w").alias("t")).filter(F.col("t").isin(*query)).groupBy("doc", "len", "t").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    both = tf.join(F.broadcast(df), "t").crossJoin(F.broadcast(stats))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return both.groupBy(F.col("doc").alias(doc)).agg(F.sum(part).alias("bm25"))


def _size(sentence) -> Column:
    """Characters of a sentence column by its name, or a column that already holds them."""
    return F.length(sentence) if isinstance(sentence, str) else sentence


def selected_sentences(scored: DataFrame, page: str, pos: str, sentence: str | Column, budget: int = 8000, most: int = 120, lede: int = 3) -> DataFrame:
    """(page, pos) of the sentences that a reader gets.

    A page within the limits is taken whole.  Else the lede and all scored sentences, then rings around the scored ones, each a sentence
    further away (in page order where nothing is scored), as long as what is inside a ring leaves room; what was taken is cut at the limits in page order.
    """
    in_order = Window.partitionBy(page).orderBy(pos)
    size, hit = _size(sentence), F.when(F.col("bm25") > 0, F.col(pos))
    before = F.last(hit, True).over(in_order)
    after = F.first(hit, True).over(in_order.rowsBetween(0, Window.unboundedFollowing))
    away = F.coalesce(F.least(F.col(pos) - before, after - F.col(pos)), F.col(pos))
    rows = scored.select(page, pos, size.alias("__size"), F.when(F.col(pos) < lede, 0).otherwise(away).alias("__ring"))
    whole, inside = Window.partitionBy(page), Window.partitionBy(page).orderBy("__ring").rangeBetween(Window.unboundedPreceding, -1)
    fits = (F.sum("__size").over(whole) <= budget) & (F.count(F.lit(1)).over(whole) <= most)
    room = (F.coalesce(F.sum("__size").over(inside), F.lit(0)) < budget) & (F.count(F.lit(1)).over(inside) < most)
    taken = rows.withColumn("__fits", fits).withColumn("__room", room).filter(F.col("__fits") | F.col("__room"))
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    cut = taken.withColumn("__used", F.sum("__size").over(upto)).withColumn("__n", F.count(F.lit(1)).over(upto))
    return cut.filter((F.col("__used") <= budget) & (F.col("__n") <= most)).select(page, pos)


def region_starts(sizes, width: int):
    """Where stretches of at most `width` characters begin when each takes what fits; a longer sentence is one of its own."""
    ends = np.cumsum(sizes)
    starts, at = [], 0
    while at < len(ends):
        starts.append(at)
        gone = ends[at - 1] if at else 0
        at = max(at + 1, int(np.searchsorted(ends, gone + width, side="right")))
    return np.array(starts, int)


_REGION = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("mass", pa.float64())])


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("mass", T.DoubleType())])))
def page_regions(places: pa.Array, sizes: pa.Array, scores: pa.Array, width: pa.Array) -> pa.Array:
    """The regions of each page that hold a sentence, with their BM25 mass, from its sentences' places, lengths and scores in order."""
    at = places.offsets.to_numpy()
    place, size, score = (x.flatten().to_numpy(zero_copy_only=False) for x in (places, sizes, scores))
    at, firsts, lasts, masses, many = at - at[0], [], [], [], []
    for low, high, w in zip(at[:-1], at[1:], width.to_pylist()):
        first = region_starts(size[low:high], w)
        last = np.append(first[1:], high - low)
        begin, end = np.searchsorted(place[low:high], first), np.searchsorted(place[low:high], last)
        some = end > begin
        firsts.append(first[some])
        lasts.append(last[some])
        masses.append(np.add.reduceat(score[low:high], begin[some]) if some.any() else np.zeros(0))
        many.append(some.sum())
    fields = [np.concatenate(x) if x else np.zeros(0) for x in (firsts, lasts, masses)]
    rows = pa.StructArray.from_arrays([pa.array(x).cast(f.type) for x, f in zip(fields, _REGION)], fields=list(_REGION))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), rows)


def selected_regions(scored: DataFrame, page: str, pos: str, sentence: str | Column, width: int = 8000, top: int = 3) -> DataFrame:
    """(page, first, last) of the regions with the greatest BM25 mass, last exclusive."""
    thin = scored.select(page, F.struct(F.col(pos).alias("pos"), _size(sentence).alias("size"), F.col("bm25").alias("bm25")).alias("__x"))  # without text
    pages = thin.groupBy(page).agg(F.sort_array(F.collect_list("__x")).alias("__x"))
    regions = pages.select(page, page_regions(F.col("__x.pos"), F.col("__x.size"), F.col("__x.bm25"), F.lit(width)).alias("__r"))
    best = F.slice(F.sort_array(F.transform("__r", lambda r: F.struct((-F.round(r["mass"], 9)).alias("m"), r["first"].alias("first"), r["last"].alias("last")))), 1, top)
    return regions.select(page, F.explode(best).alias("__r")).select(page, "__r.first", "__r.last")


@F.arrow_udf(T.StringType())
def context_windows(sents: pa.Array, cited: pa.Array, around: pa.Array) -> pa.Array:
    """Cited sentences (numbers from 1) with their neighbours; stretches that touch are one, cited ones are marked << >>."""

    def show(s, c, k):
        s, c = list(s if s is not None else ()), {int(x) for x in (c if c is not None else ()) if 1 <= x <= len(s)}
        shown = sorted({j for i in c for j in range(max(1, i - k), min(len(s), i + k) + 1)})
        parts, held = [], []
        for j in shown:
            if held and j > held[-1] + 1:
                parts.append(held)
                held = []
            held = [*held, j]
        return " [...] ".join(" ".join(f"<<{s[j - 1]}>>" if j in c else s[j - 1] for j in p) for p in [*parts, held] if p)

    return X.by_rows(show, pa.string(), sents, cited, around)


_STOPWORDS = frozenset(X.STOPWORDS)


def _terms(s: str) -> set:
    return {w for w in re.findall(r"[a-z0-9][a-z0-9'\-]*", s.lower()) if len(w) > 2 and w not in _STOPWORDS}


def block_mask(text_sizes, hits, budget: int, lede: int = 8, around: int = 2, frame: int = 8):
    """Which sentences a block of at most `budget` characters shows; each costs `frame` more than its text.

    hits: shared terms of each sentence, or None without terms.  What fits is taken whole.  Else the lede within a quarter of the
    budget, and each sentence with hits, most hits and latest first, with its neighbours where all that is missing of them still fits.
    """
    size = np.asarray(text_sizes, np.int64)
    cost = size + frame
    if hits is None or cost.sum() <= budget:
        over = np.cumsum(cost) - frame > budget
        over[:1] = False
        return ~np.maximum.accumulate(over) if len(over) else over
    shown = np.zeros(len(size), bool)
    shown[:lede] = np.cumsum(cost[:lede]) <= budget // 4
    left = budget - cost[shown].sum()
    order = np.lexsort((-np.arange(len(size)), -np.asarray(hits)))
    for at in order[: np.count_nonzero(hits)]:
        near = slice(max(0, at - around), at + around + 1)
        missing = np.where(shown[near], 0, cost[near]).sum()
        if missing <= left:
            shown[near] = True
            left -= missing
    return shown


@F.arrow_udf(T.StringType())
def numbered_block(sents: pa.Array, words: pa.Array, tokens: pa.Array) -> pa.Array:
    """Numbered sentences for a reader, four characters a token; gaps are marked [...]."""

    def show(s, w, t):
        if s is None or not len(s):
            return ""
        want = set(w) if w is not None else set()
        at = np.flatnonzero(block_mask([len(x) for x in s], [len(want & _terms(x)) for x in s] if want else None, int(t) * 4))
        gap = np.diff(at, prepend=at[:1]) > 1
        return "\n".join(f"{'[...]' + chr(10) if g else ''}[S{k + 1}] {s[k]}" for k, g in zip(at, gap))

    return X.by_rows(show, pa.string(), sents, words, tokens)


def mmr(relevance, vectors, k: int, weight: float = 0.7) -> list[int]:
    """Places of k items: greatest relevance less similarity to what is taken, ties to the first."""
    x = np.array(vectors, float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rel, near, out = np.array(relevance, float), np.zeros(len(x)), []
    while len(out) < min(k, len(x)):
        value = weight * rel - (1 - weight) * near
        value[out] = -np.inf
        out.append(int(np.argmax(value)))
        near = np.maximum(near, x @ x[out[-1]]) if len(out) > 1 else x @ x[out[-1]]
    return out


def mmr_rows(df: DataFrame, group: str, item: str, relevance: str, vector: str, k: int = 5, weight: float = 0.7) -> DataFrame:
    """(group, item, place) of the k diversified items of each group of candidates."""
    schema = T.StructType([df.schema[group], df.schema[item], T.StructField("place", T.IntegerType())])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([relevance, item], ascending=[False, True])
        at = mmr(pdf[relevance], pdf[vector].tolist(), k, weight)
        return pd.DataFrame({group: pdf[group].iloc[0], item: pdf[item].iloc[at], "place": range(1, len(at) + 1)})

    return df.groupBy(group).applyInPandas(pick, schema)
