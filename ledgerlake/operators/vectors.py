"""Vector operators: exact nearest neighbours, cosine components with medoids, k-means, running-mean centroids.

All pairs of two sides are products of matrices, a block of each side at a time; cosines that come out near a bound are then summed term by term, as `cosine` does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clustering import components


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


#: Rows of either side of a block of all pairs within a group, and of a block of a search.
BLOCK, WIDE = 2000, 16_000
#: How far the product of two unit vectors may be from their cosine, rounded to nine places.
SLACK = 1e-8


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows are zero and have no cosine."""
    size = np.sqrt((x * x).sum(1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / size, size[:, 0] == 0


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of all pairs, nearly; -inf without one, inf where a component is not finite and anything may be."""
    (near, no), (far, none) = _directions(x), _directions(y)
    sim = near @ far.T
    sim[np.isnan(sim)] = np.inf
    sim[no], sim[:, none] = -np.inf, -np.inf
    return sim


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first place to the last, as `cosine` is."""

    def dots(a, b):
        total = np.zeros(len(a))
        for k in range(a.shape[1]):
            total = total + a[:, k] * b[:, k]
        return total

    return dots(x, y) / (np.sqrt(dots(x, x)) * np.sqrt(dots(y, y)))


def _rounded(sim: np.ndarray) -> np.ndarray:
    """To nine places, halves away from zero; what is not a number counts as greatest, as in Spark."""
    return np.where(np.isnan(sim), np.inf, np.sign(sim) * np.floor(np.abs(sim) * 1e9 + 0.5) / 1e9)


def _vectors(df: DataFrame, item: str, vector: str, *more: str) -> DataFrame:
    """(more, id, v, dim) of the rows that can have a cosine; vectors of different lengths have none."""
    v = F.transform(vector, lambda x: x.cast("double"))
    return df.select(*more, F.col(item).alias("id"), v.alias("v")).filter("v is not null and not exists(v, x -> x is null) and size(v) > 0").withColumn("dim", F.size("v"))


def _block(n) -> Column:
    return F.pmod(F.xxhash64("id"), n).cast("int")


def nearest(queries: DataFrame, base: DataFrame, item: str, vector: str, k: int, least: float = -1.0) -> DataFrame:
    """(query, item, sim, rank): the k most similar of `base` for each query, itself left out; every query meets all rows.

    Each block of queries meets each block of rows in one product, of which a query takes on its k best only.
    """
    kind = base.schema[item].dataType.simpleString()
    q, rows = _vectors(queries, item, vector), _vectors(base, item, vector)
    parts, n = -(-q.count() // WIDE) or 1, rows.count()
    blocks = max(1, -(-n // WIDE), min(48, n // 1000))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = q.select("dim", _block(F.lit(parts)).alias("part"), every(blocks, "block"), "id", "v")
    right = rows.select("dim", every(parts, "part"), _block(F.lit(blocks)).alias("block"), "id", "v")

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if a.num_rows and b.num_rows:
            qid, ids, x, y = np.asarray(a["id"]), np.asarray(b["id"]), _matrix(a["v"]), _matrix(b["v"])
            step = max(1, (4 << 20) // len(ids))
            for at in range(0, len(qid), step):
                sim = _products(x[at : at + step], y)
                sim[qid[at : at + step, None] == ids[None, :]] = -np.inf
                kth = -np.partition(-sim, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(sim), -np.inf)
                for r, low in enumerate(np.maximum(kth, least) - SLACK):
                    cols = np.flatnonzero((sim[r] > -np.inf) & (sim[r] >= low))
                    exact = _cosines(np.broadcast_to(x[at + r], (len(cols), x.shape[1])), y[cols])
                    pick = np.lexsort((ids[cols], -_rounded(exact)))[:k]
                    out.append((np.full(len(pick), qid[at + r]), ids[cols[pick]], exact[pick]))
        return pa.table([np.concatenate(c) for c in zip(*out)], names=["query", item, "sim"])

    keys = ["dim", "part", "block"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"query {kind}, `{item}` {kind}, sim double")
    scored = scored.withColumn("sim", F.round("sim", 9)).filter(F.col("sim") >= least)
    w = Window.partitionBy("query").orderBy(F.desc("sim"), item)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_per_cluster(hits: DataFrame, cluster: DataFrame, item: str) -> DataFrame:
    """Of hits (query, item, sim), the best of each cluster (item, cluster)."""
    w = Window.partitionBy("query", "cluster").orderBy(F.desc("sim"), item)
    return hits.join(cluster, item).withColumn("turn", F.row_number().over(w)).filter("turn = 1").drop("turn")


def _meet_within(df: DataFrame, block: str, item: str, vector: str, find, schema: str) -> DataFrame:
    """find(ids, vectors, ids, vectors, same) of every two parts of a block, each part of bounded size."""
    rows = _vectors(df, item, vector, block).filter(F.col(block).isNotNull())
    sized = rows.join(rows.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n")), block).withColumn("part", _block(F.col("n")))
    each = F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("other")
    met = sized.select(block, "dim", "part", "id", "v", each).select(block, "dim", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "v")

    def run(t: pa.Table) -> pa.Table:
        ids, x, part = np.asarray(t["id"]), _matrix(t["v"]), np.asarray(t["part"])
        one = part == t["i"][0].as_py()
        same = t["i"][0] == t["j"][0]
        return find(ids[one], x[one], ids[one if same else ~one], x[one if same else ~one])

    return met.groupBy(block, "dim", "i", "j").applyInArrow(run, schema)


def _pairs(ids, x, others, y, least: float):
    """Places (a, b) and cosines of pairs of different items that are at least `least` similar."""
    a, b = np.nonzero(_products(x, y) >= least - SLACK)
    keep = ids[a] != others[b]
    a, b = a[keep], b[keep]
    sim = np.concatenate([np.zeros(0), *(_cosines(x[a[k : k + 100_000]], y[b[k : k + 100_000]]) for k in range(0, len(a), 100_000))])
    keep = _rounded(sim) >= least
    return a[keep], b[keep], sim[keep]


def similar_within(df: DataFrame, block: str, item: str, vector: str, least: float) -> DataFrame:
    """(a, b, sim) of one block and at least `least` similar, a before b."""
    kind = df.schema[item].dataType.simpleString()

    def find(ids, x, others, y):
        a, b, sim = _pairs(ids, x, others, y, least)
        a, b = ids[a], others[b]
        one = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0, return_index=True)[1]
        return pa.table([np.minimum(a, b)[one], np.maximum(a, b)[one], sim[one]], names=["a", "b", "sim"])

    return _meet_within(df, block, item, vector, find, f"a {kind}, b {kind}, sim double").withColumn("sim", F.round("sim", 9))


def _stars(near: np.ndarray, ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): from the least id of what true cells of rows (ids) and columns (others) connect to each other id of it."""
    rows_left, columns_left = near.any(1), near.any(0)
    out = [(ids[:0], ids[:0])]
    for r in range(len(ids)):
        if not rows_left[r]:
            continue
        rows, found = np.array([r]), []
        while len(rows):
            rows_left[rows] = False
            columns = np.flatnonzero(columns_left & near[rows].any(0))
            columns_left[columns] = False
            found += [ids[rows], others[columns]]
            rows = np.flatnonzero(rows_left & near[:, columns].any(1))
        group = np.unique(np.concatenate(found))
        out.append((np.full(len(group) - 1, group[0]), group[1:]))
    return tuple(np.concatenate(c) for c in zip(*out))


def links_within(df: DataFrame, block: str, item: str, vector: str, least: float) -> DataFrame:
    """(a, b): links that connect what the pairs of similar_within connect; at most a row an item of each two parts, however many pairs there are."""
    kind = df.schema[item].dataType.simpleString()

    def find(ids, x, others, y):
        sure = _products(x, y)
        near = sure >= least + SLACK
        a, b = np.nonzero((sure >= least - SLACK) & ~(near & np.isfinite(sure)))
        near[a, b] = _rounded(_cosines(x[a], y[b])) >= least
        return pa.table(list(_stars(near, ids, others)), names=["a", "b"])

    return _meet_within(df, block, item, vector, find, f"a {kind}, b {kind}")


def cosine_components(df: DataFrame, block: str, item: str, vector: str, least: float) -> DataFrame:
    """(item, component, is_medoid): the medoid has the greatest sum of similarities in its component."""
    comp = components(links_within(df, block, item, vector, least))
    rows = df.join(comp.withColumnRenamed("id", item), item, "left").withColumn("component", F.coalesce("component", item))
    # cosines to all members sum to one product with the sum of their unit vectors
    size = F.sqrt(dot(F.col(vector), F.col(vector)))
    unit = F.when(size > 0, F.transform(vector, lambda x: x.cast("double") / size))
    unit = rows.select("component", F.col(item).alias("a"), unit.alias("u"))
    sums = unit.filter("u is not null").groupBy("component").agg(Summarizer.sum(array_to_vector("u")).alias("s"))
    total = unit.join(sums.select("component", vector_to_array("s").alias("s")), "component", "left").select("component", "a", F.round(dot(F.col("u"), F.col("s")), 6).alias("t"))
    best = total.groupBy("component").agg(F.max_by("a", F.struct(F.col("t"), -F.col("a"))).alias("medoid"))
    return rows.join(best, "component").select(item, "component", (F.col(item) == F.col("medoid")).alias("is_medoid"))


def kmeans(df: DataFrame, item: str, vector: str, k: int, seed: int = 7, rounds: int = 30) -> DataFrame:
    """(item, cluster) of cosine k-means."""
    rows = df.select(item, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, distanceMeasure="cosine").fit(rows)
    return model.transform(rows).select(item, F.col("prediction").alias("cluster"))


def update_centroids(old: DataFrame, new: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, n, centroid): running means of old (cluster, n, centroid) with the new members' vectors added."""
    sums = new.select(cluster, F.posexplode(vector).alias("i", "x")).groupBy(cluster, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("m"))
    prior = old.select(cluster, F.col("n"), F.posexplode("centroid").alias("i", "c"))
    both = prior.join(sums, [cluster, "i"], "full")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    mean = (F.coalesce("c", F.lit(0.0)) * n + F.coalesce("s", F.lit(0.0))) / (n + m)
    return both.select(cluster, "i", (n + m).cast("long").alias("n"), mean.alias("x")).groupBy(cluster).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))
