"""Entity clustering: blocks, idf-weighted trigram similarity, components, representatives, greedy first-kept dedup."""

from __future__ import annotations

import gc
import time
import uuid
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import shared_folder
from .overlap import near_reference
from .pigeonhole import candidates
from .trigrams import Lists, edges

#: Pairs and sets that a task scores, about.
PAIRS, SETS = 1 << 20, 5000


def _cut(df: DataFrame, free: bool = False) -> DataFrame:
    """Cut lineage: written to the shared folder and read again, so that later plans also know its size.

    free: what was shuffled for it is large and goes at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for _ in range(2 * free):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)
    return spark.read.schema(df.schema).parquet(path)


def _sliced(pairs: DataFrame, most: int, scored) -> DataFrame:
    """scored(pairs) a slice of some `most` pairs (a, b) at a time; what a slice shuffled goes with it."""
    slices = max(1, -(-pairs.count() // max(1, most)))
    if slices == 1:
        return scored(pairs)
    turn = F.pmod(F.xxhash64("a", "b"), F.lit(slices))
    return reduce(DataFrame.unionByName, [_cut(scored(pairs.filter(turn == k)), free=True) for k in range(slices)])


def rows(df: DataFrame) -> DataFrame:
    """A side that grows with the items: sorted and merged, never broadcast, as its files are far smaller than its rows on the driver."""
    return df.hint("merge")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every linked id with the least id that links reach; least labels spread until none changes."""
    both = _cut(links.select(F.col(a).alias("id"), F.col(b).alias("to")).unionByName(links.select(F.col(b).alias("id"), F.col(a).alias("to"))).filter("id <> to").distinct())
    label = _cut(both.groupBy("id").agg(F.least(F.first("id"), F.min("to")).alias("component")))
    while True:
        near = both.join(rows(label.select(F.col("id").alias("to"), "component")), "to").groupBy("id").agg(F.min("component").alias("c"))
        jump = label.select(F.col("id").alias("component"), F.col("component").alias("j"))
        new = label.join(rows(near), "id").join(rows(jump), "component", "left").select("id", F.least("component", "c", F.coalesce("j", "component")).alias("component"), F.col("component").alias("old"))
        new = _cut(new)
        if new.filter("component <> old").isEmpty():
            return new.select("id", "component")
        label = new.select("id", "component")


def cluster(items: DataFrame, item: str = "id", text: str = "norm", urls: DataFrame | None = None, edge: float = 0.58, edge_cited: float = 0.25, cap: int = 40, ultra: int = 15, stop: list[str] | None = None) -> DataFrame:
    """items with cluster_id (its least item), cluster_size.

    Equal texts are one cluster, empty ones too.  A pair is an edge from similarity `edge` on if it shares a token of at most `ultra` items or
    any two; with urls (id, key) it is one from `edge_cited` on with two shared pages and, of its tokens, one of at most `ultra` items or two
    of at most `cap`.  All such pairs are found, however many items have a token or a page.
    """
    items = _cut(items, free=True)  # texts are made once
    same = items.groupBy(text).agg(F.min(item).alias("b"))
    free = items.join(rows(same), text).select(F.col(item).alias("a"), "b").filter("a <> b")
    word = F.filter(F.array_distinct(F.split("norm", " ")), lambda w: (F.length(w) > 3) & ~w.rlike("^[0-9]+$"))
    if stop:
        word = F.array_except(word, F.array(*[F.lit(w) for w in stop]))
    held = items.select(F.col(item).alias("id"), F.col(text).alias("norm"))
    found = edges(held, word, edge, ultra, _cut, urls, None if urls is None else edge_cited, cap)
    comp = components(found.unionByName(free))
    out = items.join(rows(comp.withColumnRenamed("id", item)), item, "left").withColumn("cluster_id", F.coalesce("component", item)).drop("component")
    return out.withColumn("cluster_size", F.count(F.lit(1)).over(Window.partitionBy("cluster_id")))


def representatives(clustered: DataFrame, order: list[Column], text: str = "norm", least: int = 70) -> DataFrame:
    """is_rep (first of its cluster by `order`) and collapsible (the representative's text is long enough to name a claim)."""
    w = Window.partitionBy("cluster_id").orderBy(*order)
    rep_len = F.first(F.length(text)).over(w)
    return clustered.withColumn("is_rep", F.row_number().over(w) == 1).withColumn("collapsible", rep_len >= least)


def token_sets(items: DataFrame, item: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, copies, s) of each distinct token set, id its least item, and the membership (id, rep); texts without tokens have neither."""
    # sort_array is compiled, array_sort calls a comparison for each two tokens
    # a text has a token if it has one of its characters; a filter by the set's size would be pushed down and make each set twice
    some = items.filter(F.lower(text).rlike("[a-z0-9_]"))
    marked = some.select(F.col(item).alias("id"), F.sort_array(X.tokens(text)).alias("s")).withColumn("mark", F.unhex(F.sha2(F.array_join("s", " "), 256)))
    marks = _cut(marked.select("id", "mark"))
    first = marks.groupBy("mark").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = marks.join(rows(first), "mark").select("id", "rep")
    one = first.groupBy(F.col("rep").alias("id")).agg(F.min(F.struct("mark", "copies")).alias("x")).select("id", "x.mark", "x.copies")
    sets = marked.join(rows(one), ["id", "mark"]).dropDuplicates(["id", "mark"]).select("id", "copies", "s")
    return sets, members


def similar_pairs(items: DataFrame, item: str, text: str, least: float) -> DataFrame:
    """(a, b, j, copies_a, copies_b), a before b, of distinct token sets with Jaccard of at least `least`: equal parts, then exact sets.

    Texts of one set are one representative, their least item, with its number of copies: rows grow with distinct texts, not with pairs of
    copies.  Pairs meet their sets a slice at a time, each of no more pairs than there are sets, and what a slice shuffled goes with it:
    the disk needed follows the sets, however many pairs there are.
    """
    return _similar(_cut(token_sets(items, item, text)[0], free=True), least)


def _shared(pairs: pa.Table, held: pa.Table) -> pa.Table:
    """pairs (a, b) with i common tokens and u tokens together, and their copies; held: id, copies and the tokens s of all of them, as numbers."""
    ids = np.asarray(held["id"])
    order = np.argsort(ids, kind="stable")
    at_a, at_b = (order[np.searchsorted(ids[order], np.asarray(pairs[c]))] for c in "ab")
    s = held["s"].combine_chunks()
    known, place = np.unique(s.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    n = s.value_lengths().to_numpy(zero_copy_only=False)
    sets = Lists(np.split(place, np.cumsum(n)[:-1]))
    mark, common = np.zeros(len(known)), np.zeros(len(at_a), np.int64)
    by_a = np.argsort(at_a, kind="stable")
    edge = np.flatnonzero(np.diff(at_a[by_a], prepend=-1, append=-1))
    for low, high in zip(edge[:-1], edge[1:]):
        own = sets[at_a[by_a[low]]]
        mark[own] = 1
        for k in range(low, high, 1000):
            some = by_a[k : min(k + 1000, high)]
            common[some] = sets.sums(at_b[some], mark)
        mark[own] = 0
    copies = np.asarray(held["copies"])
    return pa.table([pairs["a"], pairs["b"], pa.array(common), pa.array(n[at_a].astype(np.int64) + n[at_b] - common), pa.array(copies[at_a]), pa.array(copies[at_b])], names=["a", "b", "i", "u", "copies_a", "copies_b"])


def _similar(sets: DataFrame, least: float) -> DataFrame:
    """Pairs are scored where their sets are: a pair goes to the place of a's least neighbour, so near copies meet in one place and each set is sent there once.

    A place of very many pairs is cut up by a and b.  Tokens are told apart by 64-bit hashes.
    """
    kind = sets.schema["id"].dataType.simpleString()
    pairs = _cut(candidates(sets, least), free=True)
    met = _cut(sets.join(rows(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "id", "left_semi").select("id", "copies", F.transform("s", lambda t: F.xxhash64(t)).alias("s")), free=True)
    placed = pairs.join(rows(pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("place"))), "a", "left").withColumn("place", F.coalesce("place", "a"))
    cuts = placed.groupBy("place").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / PAIRS)).alias("cuts"))
    n_pairs, n_met = pairs.count(), met.count()
    buckets = F.lit(max(1, -(-n_pairs // PAIRS), -(-n_met // SETS)))
    cell = F.xxhash64("place", F.pmod(F.xxhash64("a"), "cuts"), F.pmod(F.xxhash64("b"), "cuts"))
    placed = _cut(placed.join(rows(cuts), "place").select("a", "b", F.pmod(cell, buckets).alias("bucket")), free=True)

    def scored(some: DataFrame) -> DataFrame:
        held = some.select(F.col("bucket").alias("at"), F.explode(F.array("a", "b")).alias("id")).distinct().join(rows(met), "id")
        run = lambda key, x, y: _shared(x, y)
        out = some.groupBy("bucket").cogroup(held.groupBy("at")).applyInArrow(run, f"a {kind}, b {kind}, i long, u long, copies_a long, copies_b long")
        return out.select("a", "b", F.round(F.col("i") / F.col("u"), 9).alias("j"), "copies_a", "copies_b").filter(F.col("j") >= least)

    return _sliced(placed, sets.count(), scored)


def document_pairs(items: DataFrame, item: str, text: str, least: float) -> DataFrame:
    """(a, b, j), a before b, of all items whose token sets have a Jaccard of at least `least`, those of equal sets among them; items without tokens have none."""
    sets, members = token_sets(items, item, text)
    members = _cut(members)
    pairs = _similar(_cut(sets, free=True), least).select("a", "b", "j")
    of = lambda x: members.select(F.col("rep").alias(x), F.col("id").alias(f"id_{x}"))
    apart = pairs.join(rows(of("a")), "a").join(rows(of("b")), "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "j")
    other = members.select("rep", F.col("id").alias("b"))
    equal = members.select("rep", F.col("id").alias("a")).join(rows(other), "rep").filter("a < b").select("a", "b", F.lit(1.0).alias("j"))
    return apart.unionByName(equal)


def greedy_dedup(items: DataFrame, item: str, text: str, least: float = 0.85) -> DataFrame:
    """items with `kept`: in order of item, one is dropped if it is similar to an earlier kept one.

    Not the closure of similarity: a row is decided as soon as all earlier similar rows are, and similar rows are
    only met through their pairs, so each round decides a whole front of every component at once.
    """
    sets, members = token_sets(items, item, text)
    pairs = _cut(_similar(_cut(sets, free=True), least).select("a", "b"), free=True)
    left = _cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    state = None
    while not left.isEmpty():
        # who has no earlier open neighbour stays, its neighbours go, and only pairs of open rows are looked at again
        stays = _cut(left.join(rows(pairs.select(F.col("b").alias("id")).distinct()), "id", "left_anti"))
        goes = pairs.join(rows(stays.withColumnRenamed("id", "a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        ruled = _cut(stays.withColumn("kept", F.lit(True)).unionByName(goes.withColumn("kept", F.lit(False))))
        state = ruled if state is None else state.unionByName(ruled)
        left = _cut(left.join(rows(ruled.select("id")), "id", "left_anti"))
        pairs = _cut(pairs.join(rows(left.withColumnRenamed("id", "a")), "a", "left_semi").join(rows(left.withColumnRenamed("id", "b")), "b", "left_semi"), free=True)
    if state is None:
        state = left.withColumn("kept", F.lit(True))
    # a later copy of a set goes either way: with its first item, or because that one stays
    ruled = members.join(state, "id", "left").select(F.col("id").alias(item), ((F.col("id") == F.col("rep")) & F.coalesce("kept", F.lit(True))).alias("__k")).dropDuplicates([item])
    return items.join(ruled, item, "left").withColumn("kept", F.coalesce("__k", F.lit(True))).drop("__k")


def leak_tag(items: DataFrame, reference: DataFrame, item: str, text: str, ref_text: str, least: float = 0.6) -> DataFrame:
    """items with `leak`: some reference text has a token-set Jaccard of at least `least`."""
    reference = _cut(reference.select(F.array_sort(X.tokens(ref_text)).alias("s")).filter(F.size("s") > 0).distinct().select(F.lit(0).alias("id"), "s"))
    hit = near_reference(items.select(F.col(item).alias("id"), X.tokens(text).alias("s")), reference, least)
    return items.join(rows(hit.select(F.col("id").alias(item), F.lit(True).alias("__l"))), item, "left").withColumn("leak", F.coalesce("__l", F.lit(False))).drop("__l")


def syndication(pages: DataFrame, claim: str, rank: str, sents: Column, least: float = 0.7) -> DataFrame:
    """Pages of a claim with `origin_rank`: the least rank of the group of copies by sentence containment; copies are marked, not deleted."""
    from .containment import syndicated

    found = syndicated(pages, claim, rank, sents, least).select(F.col("block").alias(claim), F.col("page").alias(rank), F.col("kept").alias("__o")).dropDuplicates([claim, rank])
    return pages.join(found, [claim, rank], "left").withColumn("origin_rank", F.coalesce("__o", rank).cast("int")).drop("__o").select(*pages.columns, "origin_rank")


def leader_clusters(items: pd.DataFrame, vectors: list, least: float) -> list[int]:
    """Leader of each item, in order: the first unassigned item absorbs later ones of cosine `least` and more."""
    import numpy as np

    x = np.array(vectors, float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    lead = [-1] * len(x)
    for i in range(len(x)):
        if lead[i] < 0:
            near = np.flatnonzero(x[i:] @ x[i] >= least) + i
            for j in near:
                if lead[j] < 0:
                    lead[j] = i
            lead[i] = i
    return lead
