"""Approximate nearest neighbours: inverted file of coarse centroids, product-quantised residuals, exact reranking.

The index is fitted on a bounded sample, taken in the order of a hash of vec_id: 20 vectors a list, 20,000 at least and `most_train` at most. It gives
coarse centroids by k-means, about as many as the root of the number of vectors, and a codebook of 256 centroids for each of the sub-vectors
that residuals are cut into.  Every vector is then indexed: it goes to the list of its nearest centroid and is kept there with the codes of its residual.

A query probes the lists whose centroids have the greatest inner product with it.  How many is measured and not given: up to 500 vectors of the sample
look for their nearest in the sample, and the least number of lists that finds the share `recall` of them is probed by all queries, whatever the size of the table.
Where vectors form clusters that is few lists; where they point everywhere alike, no list can be left out without loss, and it is most of them.
The members of probed lists are estimated by the inner product of the query, which is not quantised, with their centroid and the code words of their
residual (asymmetric distances; a product of matrices for many queries at once adds up what look-up tables would); of each group of lists the best `rerank` are scored exactly in double precision on the
original vectors, and the k best of all groups remain.

An exact check follows, as the sample may not show what other rows are like (copies and near copies beyond `rerank`, long vectors, queries far from what was sampled).  The
k-th score found so far is the bar; a query asks every list whose centroid's product plus its own length times the list's radius reaches the bar, and
keeps what reaches it there.  By Cauchy and Schwarz nothing that belongs to the k nearest is left out.  Where vectors form clusters these are few lists; where they point
everywhere alike they are most of them, and the check is a product of matrices, block by block.

Groups: neighbouring lists form groups of about `block_rows` members (a longer list is cut into blocks, each in a group of its own), and a query goes to a group once, with a bit for each
list that it asks there.  The queries of a group are cut into parts of `block_queries`, so a task's work is bounded whatever a vector's frequency; each group and part is scored on
its own, and its k best per query are all it returns.  Rows shuffled are queries times groups, not queries times lists.

Defined results: a vector that is null, zero, holds null or a non-finite component, or has not the most frequent length of valid ones takes no part,
as query or candidate; rows without vec_id take no part; of rows that repeat a vec_id the vector that sorts
first counts; ties go to the smaller vec_id; with fewer than k candidates all are returned; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._runs import settle

_HIT = "query_id long, vec_id long, score double"
#: Numbers of a matrix of rows and lists, or queries and members, that a task holds at once.
CELLS = 1 << 20


def kmeans(x, k: int, rounds: int, seed: int):
    """Centroids by Lloyd's rounds; a centroid without members moves to the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    c = distinct[rng.choice(len(distinct), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        near, dist = assign(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = n > 0
        c[full] = total[full] / n[full, None]
        empty = np.flatnonzero(~full)
        if len(empty):
            c[empty] = x[np.argsort(-dist, kind="stable")[: len(empty)]]
    return c


def assign(x, c):
    """Nearest centroid of each row and the squared distance."""
    near, dist = np.zeros(len(x), np.int64), np.zeros(len(x), np.float32)
    norm = (c * c).sum(1)
    step = max(1, CELLS // max(1, len(c)))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        d = norm - 2 * part @ c.T
        near[a : a + step] = d.argmin(1)
        dist[a : a + step] = d[np.arange(len(part)), near[a : a + step]] + (part * part).sum(1)
    return near, dist


class Quantiser:
    """Coarse centroids and sub-vector codebooks."""

    def __init__(self, sample, lists: int, sub: int, seed: int = 11, rounds: int = 8):
        self.dim = sample.shape[1]
        self.width = -(-self.dim // sub)
        self.sub = -(-self.dim // self.width)
        self.coarse = kmeans(sample, lists, rounds, seed)
        near, _ = assign(sample, self.coarse)
        parts = self._parts(sample - self.coarse[near])
        self.books = [kmeans(parts[:, j], 256, rounds, seed + 1 + j) for j in range(self.sub)]

    def _parts(self, x):
        pad = self.sub * self.width - self.dim
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), self.sub, self.width)

    def encode(self, x):
        """List of each row and codes of its residual."""
        near, _ = assign(x, self.coarse)
        parts = self._parts(x - self.coarse[near])
        return near, np.stack([assign(np.ascontiguousarray(parts[:, j]), b)[0] for j, b in enumerate(self.books)], 1).astype(np.uint8)

    def away(self, x, near):
        """How far each row (in double precision) is from its centroid."""
        return np.sqrt(((x - self.coarse[near].astype(np.float64)) ** 2).sum(1)) * (1 + 1e-9)

    def decode(self, near, codes):
        """Centroids and code words that stand for rows; a query's product with them is its asymmetric distance."""
        parts = [b[codes[:, j]] for j, b in enumerate(self.books)]
        return self.coarse[near] + np.concatenate(parts, 1)[:, : self.dim]


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part, one row an id."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    some = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).filter("vec_id is not null and vector is not null")
    fine = some.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0))
    size = fine.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1)
    dim = (size.collect() or [(0, 0)])[0][0]
    return fine.filter(F.size("vector") == dim).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _matrix(column, kind=np.float64):
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).astype(kind).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1), kind)


def top(scores, k: int):
    """Columns of the k greatest scores of each row; rows' columns are in order of id, and ties go to the first."""
    n = scores.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(scores), 1))
    bar = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    above = scores > bar
    rank = np.cumsum(scores == bar, axis=1)
    room = k - above.sum(1, keepdims=True)
    return np.nonzero(above | (scores == bar) & (rank <= room))[1].reshape(len(scores), k)


def _sorted(members: pa.Table):
    """vec_id and vector in the order of vec_id, and that order."""
    ids = np.asarray(members["vec_id"])
    order = np.argsort(ids, kind="stable")
    return ids[order], _matrix(members["vector"])[order], order


def _score_block(held, k: int, rerank: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def score(key, members: pa.Table, probes: pa.Table) -> pa.Table:
        if not members.num_rows or not probes.num_rows:
            return schema.empty_table()
        quantiser, groups = held.value[0], held.value[3]
        ids, x, order = _sorted(members)
        codes = np.frombuffer(b"".join(members["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)[order].astype(np.int64)
        lists = np.asarray(members["list"])[order]
        own = groups[key[0].as_py()]
        place = np.searchsorted(own, lists)
        decoded = quantiser.decode(lists, codes)
        qid, q = np.asarray(probes["query_id"]), _matrix(probes["vector"])
        asked = np.frombuffer(b"".join(probes["lists"].to_pylist()), np.uint8).reshape(len(qid), -1)
        asked = np.unpackbits(asked, axis=1, count=len(own)).astype(bool)
        out_q, out_v, out_s = [], [], []
        step = max(1, 2 * CELLS // len(ids))
        for a in range(0, len(qid), step):
            part = q[a : a + step]
            estimate = part.astype(np.float32) @ decoded.T
            estimate[np.isnan(estimate)] = np.inf  # beyond single precision
            estimate[~asked[a : a + step][:, place]] = -np.inf
            estimate[ids[None, :] == qid[a : a + step, None]] = -np.inf
            best = top(estimate, max(rerank, k) + 1)
            for r, cols in enumerate(best):
                cols = cols[(ids[cols] != qid[a + r]) & asked[a + r, place[cols]]]
                exact = (x[cols] * part[r]).sum(1)
                pick = np.lexsort((ids[cols], -exact))[:k]
                out_q.append(np.full(len(pick), qid[a + r]))
                out_v.append(ids[cols[pick]])
                out_s.append(exact[pick])
        return pa.table([np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)], schema=schema)

    return score


def _check_block(k: int):
    """The k best members for each query of a block, of those whose score reaches the query's bar."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def check(members: pa.Table, probes: pa.Table) -> pa.Table:
        if not members.num_rows or not probes.num_rows:
            return schema.empty_table()
        ids, x, _ = _sorted(members)
        qid, q, bar = np.asarray(probes["query_id"]), _matrix(probes["vector"]), np.asarray(probes["bar"])
        # products are rounded otherwise than the score
        low = bar - 1e-12 * np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max())
        out_q, out_v, out_s = [], [], []
        step = max(1, 2 * CELLS // len(ids))
        for a in range(0, len(qid), step):
            may = ~(q[a : a + step] @ x.T < low[a : a + step, None])
            for r in np.flatnonzero(may.any(1)).tolist():
                cols = np.flatnonzero(may[r])
                cols = cols[ids[cols] != qid[a + r]]
                exact = (x[cols] * q[a + r]).sum(1)
                pick = np.lexsort((ids[cols], -exact))[:k]
                out_q.append(np.full(len(pick), qid[a + r]))
                out_v.append(ids[cols[pick]])
                out_s.append(exact[pick])
        return pa.table([np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)], schema=schema) if out_q else schema.empty_table()

    return check


def lists_to_probe(quantiser: Quantiser, x, k: int, recall: float, queries: int = 500) -> int:
    """The least number of lists that hold the share `recall` of the k nearest of some rows of x among the others."""
    q = x[:queries]
    score = q @ x.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near, _ = assign(x, quantiser.coarse)
    best = np.argpartition(-score, min(k, score.shape[1] - 1), axis=1)[:, : min(k, len(x) - 1)]
    order = np.argsort(-(q @ quantiser.coarse.T), axis=1, kind="stable")
    place = np.empty_like(order)
    place[np.arange(len(q))[:, None], order] = np.arange(order.shape[1])
    found = np.sort(place[np.arange(len(q))[:, None], near[best]].ravel())
    return int(found[max(0, math.ceil(recall * len(found)) - 1)]) + 1 if len(found) else 1


def build_index(vectors: DataFrame, n: int, k: int, recall: float, lists: int | None = None, sub: int = 32, most_train: int = 200_000):
    """(quantiser, lists to probe, rows of list, vec_id, vector, codes and how far the vector is from its centroid, away)."""
    wanted = lists or max(1, int(math.sqrt(n)))
    train = min(most_train, max(20_000, 20 * wanted))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(train).select("vector").toPandas()["vector"]  # bounded by most_train
    x = np.array(sample.tolist(), np.float32)
    quantiser = Quantiser(x, min(wanted, max(1, len(x) // 20)), sub)
    probes = lists_to_probe(quantiser, x, k, recall)
    held = vectors.sparkSession.sparkContext.broadcast(quantiser)  # at most most_train / 20 centroids and sub x 256 code words

    def place(batches):
        for b in batches:
            x = _matrix(b.column(1))
            near, codes = held.value.encode(x.astype(np.float32))
            codes = pa.array([r.tobytes() for r in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(near), b.column(0), b.column(1), codes, pa.array(held.value.away(x, near))], names=["list", "vec_id", "vector", "codes", "away"])

    return quantiser, probes, vectors.select("vec_id", "vector").mapInArrow(place, "list long, vec_id long, vector array<double>, codes binary, away double")


def grouped(coarse, count, block_rows: int):
    """(groups of each list, one a block; lists of each group, in order): lists near each other, of some `block_rows` members together."""
    near, _ = assign(coarse, kmeans(coarse, max(1, int(count.sum()) // block_rows), 4, 5))
    of_list, groups, room = [[] for _ in count], [], 0.0
    for j in np.argsort(near, kind="stable").tolist():
        blocks = max(1, -(-int(count[j]) // block_rows))
        for _ in range(blocks):
            if not groups or count[j] / blocks > room:
                groups.append([])
                room = float(block_rows)
            groups[-1].append(j)
            of_list[j].append(len(groups) - 1)
            room -= count[j] / blocks
    return of_list, [np.unique(g) for g in groups]


def search(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, recall: float = 0.98, rerank: int = 100, lists: int | None = None, sub: int = 32, most_train: int = 200_000, block_rows: int = 20_000, block_queries: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest of each vector whose id is divisible by `every`."""
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = settle(valid_vectors(table, id_col, vector_col), "vectors")
    n = vectors.count()
    if n == 0:
        return empty
    quantiser, probes_of, placed = build_index(vectors, n, k, recall, lists, sub, most_train)
    placed = settle(placed, "index")
    count, radius = np.zeros(len(quantiser.coarse), np.int64), np.zeros(len(quantiser.coarse))
    for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect():  # a row a list
        count[r.list], radius[r.list] = r.n, r.radius
    in_groups, groups = grouped(quantiser.coarse, count, block_rows)
    held = spark.sparkContext.broadcast((quantiser, count, radius, groups))

    def asking(batches, take, extra: list[str]):
        """A row for each query and group of lists that it takes, with a bit for each list of the group."""
        own = held.value[3]
        for b in batches:
            step = max(1, CELLS // len(held.value[1]))
            for at in range(0, b.num_rows, step):
                rows = b.slice(at, step)
                taken = take(rows)
                for g, lists in enumerate(own):
                    some = taken[:, lists]
                    row = np.flatnonzero(some.any(1))
                    if len(row):
                        bits = [r.tobytes() for r in np.packbits(some[row], axis=1)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), g)), *(c.take(pa.array(row)) for c in rows.columns[:2]), pa.array(bits, pa.binary()), *(c.take(pa.array(row)) for c in rows.columns[2:])], names=["group", "query_id", "vector", "lists", *extra])

    def probe(batches):
        q, size = held.value[:2]

        def take(rows):
            order = np.argsort(-(_matrix(rows.column(1), np.float32) @ q.coarse.T), axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            filled = size[order] > 0
            taken = np.zeros(order.shape, bool)
            np.put_along_axis(taken, order, filled & ((np.cumsum(filled, axis=1) <= probes_of) | (before <= k)), 1)
            return taken

        return asking(batches, take, [])

    def check(batches):
        q, size, wide = held.value[:3]
        centre = q.coarse.astype(np.float64)
        room = wide + 1e-9 * np.sqrt((centre * centre).sum(1))

        def take(rows):
            x = _matrix(rows.column(1))
            return (size > 0) & ~(x @ centre.T + np.sqrt((x * x).sum(1))[:, None] * room < np.asarray(rows.column(2))[:, None])

        return asking(batches, take, ["bar"])

    def best(probes: DataFrame, score, columns: list[str]) -> DataFrame:
        probes = settle(probes, "probes", free=True)
        asked = {r.group: r["count"] for r in probes.groupBy("group").count().collect()}  # a row a group
        parts = [max(1, -(-asked.get(g, 0) // block_queries)) for g in range(len(groups))]
        of_list = spark.createDataFrame([(j, g, [parts[x] for x in g]) for j, g in enumerate(in_groups)], "list long, groups array<int>, parts array<int>")  # a row a list
        of_group = spark.createDataFrame(list(enumerate(parts)), "group long, n_parts int")
        block = F.pmod(F.xxhash64("vec_id"), F.size("groups")).cast("int")
        members = placed.join(F.broadcast(of_list), "list").select("list", F.get("groups", block).cast("long").alias("group"), F.explode(F.sequence(F.lit(0), F.get("parts", block) - 1)).alias("part"), *columns)
        asks = probes.join(F.broadcast(of_group), "group").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("n_parts")).cast("int")).drop("n_parts")
        hits = members.groupBy("group", "part").cogroup(asks.groupBy("group", "part")).applyInArrow(score, _HIT)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    queries = vectors.filter(F.col("vec_id") % every == 0).select("vec_id", "vector")
    found = best(queries.mapInArrow(probe, "group long, query_id long, vector array<double>, lists binary"), _score_block(held, k, rerank), ["vec_id", "vector", "codes"])
    bars = settle(found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bar")), "bars")
    open_ = queries.join(bars, "vec_id", "left").select("vec_id", "vector", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"))
    return best(open_.mapInArrow(check, "group long, query_id long, vector array<double>, lists binary, bar double"), _check_block(k), ["vec_id", "vector"])
