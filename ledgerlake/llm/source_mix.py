"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

Every document is cut into blocks of `block_words` words (the last one shorter).  A source's target gives a number of
whole passes over its blocks and a part of one more.  Blocks of one source and length are a stratum; the part gives each stratum an
exact quota of blocks, chosen so that the quotas add up to the wanted number of words.

Output shards own disjoint sets of blocks, by the leading bits of a block's hash.  The quotas are split among them by
a tree: the left half of a node's shards gets as many of a stratum's quota as the hypergeometric distribution draws from the exact numbers of blocks
that both halves own, with a generator seeded by the stratum and the node, and so on down to single shards.  All
strata together are split by the multivariate hypergeometric distribution over the shards, as one uniform draw
without replacement would split them.  A shard then takes its quota from its own blocks in a pseudo-random order and shuffles what it has.
A rerun gives the same mix.

The tree is grown by Spark in levels of `LEVEL_BITS` bits: a level counts blocks of each node (summed map-side) and splits each parent's quota among at most
2 ** LEVEL_BITS children.  Nothing is ordered but the blocks of one stratum in one shard, whose size is fixed, and no table of sources or shards
comes to the driver.

Defined results: null and empty texts have size 0 and are never taken; null is a source of its own, last in
order; a source of size 0 has target 0; rows that repeat a doc_id, text and source count as documents of their own; rows
without doc_id take part; very long texts are cut into blocks like others; a mix of nothing is empty; other columns pass through `mixed_documents`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runs import bits_for, settle
from ._text import Chunk, chunked, to_bytes

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 128
SHARD_WORDS = 1 << 22
LEVEL_BITS = 8


def with_targets(per: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The sources (source, source_size) with target: `share` of all sizes by weight, none above `most` times its size, the excess reshared.

    The sources that stop are those with the smallest size for their weight: with them in order, each
    source's turn asks whether what is left, by weight, is more than its limit.
    """
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # over a row a source
    w = settle(per.withColumn("w", F.get(weights, F.pmod(number - 1, F.lit(len(WEIGHTS))))), "weights")
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    limit = F.lit(most) * F.col("source_size")
    sums = w.agg(F.sum("source_size"), F.sum("w")).first()
    total, w_all = share * (sums[0] or 0), sums[1] or 0.0
    turns = w.withColumn("left", F.lit(total) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))).withColumn("w_left", F.lit(w_all) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    turns = settle(turns.withColumn("stops", F.col("left") * F.col("w") / F.col("w_left") > limit), "turns")
    first = turns.filter(~F.col("stops")).agg(F.max("left"), F.max("w_left")).first()  # of the first that doesn't stop
    left, w_left = (first[0] or 0.0), (first[1] or 1.0)
    return turns.select("source", "source_size", F.when(F.col("stops"), limit).otherwise(F.lit(left) * F.col("w") / F.lit(w_left)).alias("target"))


def hypergeometric(u: float, good: int, bad: int, draw: int) -> int:
    """How many of `draw` things are good, of good + bad, by inversion at u of the exact probabilities within 12 standard deviations of the mode; any size."""
    low, high = max(0, draw - bad), min(good, draw)
    n = good + bad
    if low == high:
        return low
    mode = min(high, max(low, (draw + 1) * (good + 1) // (n + 2)))
    sd = math.sqrt(draw * (good / n) * (bad / n) * max(n - draw, 1) / max(n - 1, 1))
    reach = 20 + int(12 * sd)
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=float)
    step = np.log(good - k) + np.log(draw - k) - np.log(k + 1) - np.log(bad - draw + k + 1)
    p = np.concatenate([[0.0], np.cumsum(step)])
    p = np.cumsum(np.exp(p - p.max()))
    return a + int(np.searchsorted(p, u * p[-1], side="right"))


def split_quota(counts, quota: int, seed: list[int]):
    """The quota of each of 2 ** m children with these numbers of blocks, by halving down to single ones."""
    out = np.zeros(len(counts), np.int64)
    todo = [(0, len(counts), quota)]
    total = np.concatenate([[0], np.cumsum(counts)]).astype(object)
    while todo:
        a, b, q = todo.pop()
        if b - a == 1 or q == 0:
            out[a] = q
            continue
        mid = (a + b) // 2
        u = np.random.Generator(np.random.PCG64([*seed, a, b])).random()
        left = hypergeometric(u, int(total[mid] - total[a]), int(total[b] - total[mid]), q)
        todo += [(a, mid, left), (mid, b, q - left)]
    return out


def stratum_quotas(words, counts, rest: float):
    """Blocks to draw of each length so that they add up to about `rest` words: the same share of each, what rounding leaves over passed on to shorter ones."""
    order = np.argsort(-words)
    total = float((words * counts).sum())
    out, due, had = np.zeros(len(words), np.int64), 0.0, 0.0
    for k in order:
        due += float(words[k]) * float(counts[k]) * rest / total
        out[k] = min(int(counts[k]), max(0, math.floor((due - had) / float(words[k]) + 1e-9)))
        had += float(words[k]) * float(out[k])
    for k in order:
        while out[k] < counts[k] and rest - had >= words[k] / 2:
            out[k] += 1
            had += float(words[k])
    return out


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, text_hash, size (words [^\\x20\\x09-\\x0D]+), one row a document."""

    def run(batches):
        for rows, chunk in chunked(batches, "text"):
            begin, _, doc = chunk.words()
            h = chunk.hashes(chunk.starts[:-1], chunk.starts[1:] - 1)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(h.view(np.int64)), pa.array(np.bincount(doc, minlength=chunk.n).astype(np.int64))], names=["doc_id", "source", "text_hash", "size"])

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return thin.mapInArrow(run, "doc_id long, source string, text_hash long, size long")


def _halver(seed: int, done: int, step: int):
    def halve(pdf):  # the children of one node for one stratum: at most 2 ** step rows
        n = np.zeros(1 << step, np.int64)
        at = pdf["child"].to_numpy() & ((1 << step) - 1)
        n[at] = pdf["n"].to_numpy()
        own = [seed, done, int(pdf["node"].iloc[0]), int(pdf["stratum"].iloc[0]) & (2**64 - 1)]
        pdf["quota"] = split_quota(n, int(pdf["quota"].iloc[0]), own)[at]
        pdf["node"] = pdf["child"]
        return pdf[["source", "n_words", "node", "quota"]]

    return halve


def _draw_quotas(blocks: DataFrame, aims: DataFrame, bits: int, seed: int) -> DataFrame:
    """(source, n_words, shard, quota): how many blocks of each stratum each shard draws."""
    key = ["source", "n_words"]
    strata = blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    strata = strata.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).filter("rest > 0").select(*key, "n", "rest")

    def aim(pdf):  # at most block_words rows a source
        pdf["quota"] = stratum_quotas(pdf["n_words"].to_numpy(), pdf["n"].to_numpy(), float(pdf["rest"].iloc[0]))
        return pdf[["source", "n_words", "node", "quota"]]

    node = settle(strata.withColumn("node", F.lit(0).cast("long")).groupBy("source").applyInPandas(aim, "source string, n_words long, node long, quota long"), "quotas")
    done = 0
    while done < bits:
        step = min(LEVEL_BITS, bits - done)
        done += step
        child = F.shiftrightunsigned("h", 64 - done)
        counts = blocks.groupBy(*key, child.alias("child")).agg(F.count(F.lit(1)).alias("n"))
        counts = counts.withColumn("node", F.shiftrightunsigned("child", step)).join(node.filter("quota > 0").select(F.col("source").alias("s"), F.col("n_words").alias("w"), F.col("node").alias("p"), "quota"), F.col("source").eqNullSafe(F.col("s")) & (F.col("n_words") == F.col("w")) & (F.col("node") == F.col("p")))
        stratum = F.xxhash64("source", "n_words").alias("stratum")
        node = settle(counts.select(*key, "node", "child", "n", "quota", stratum).groupBy(*key, "node").applyInPandas(_halver(seed, done, step), "source string, n_words long, node long, quota long"), "quotas")
    return node.select(*key, F.col("node").alias("shard"), "quota")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, seed: int = 7, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS):
    """(documents, draws): documents with source_size, target and doc; draws with shard, position, doc, copy, block, n_words."""
    table = sizes(docs, id_col, text_col, source_col).groupBy("doc_id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("rows"))
    table = settle(table.select("doc_id", "source", "text_hash", "size", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("twin")), "sizes")
    known = settle(with_targets(table.groupBy("source").agg(F.sum("size").alias("source_size")), share, most), "targets")
    table = table.join(known.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    table = settle(table.withColumn("doc", F.xxhash64("doc_id", "text_hash", "source", "twin")), "documents")

    passes = F.floor(F.col("target") / F.col("source_size") + 1e-12)
    blocks = table.filter("size > 0").select("source", "doc", "size", passes.cast("int").alias("passes"), F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / block_words).cast("int"))).alias("block"))
    blocks = blocks.select("source", "doc", "passes", "block", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block").cast("long") * block_words).alias("n_words"), F.xxhash64(F.lit(seed), "doc", "block").alias("h"))
    blocks = settle(blocks, "blocks")
    aims = known.filter("source_size > 0").select("source", (F.col("target") - passes * F.col("source_size")).alias("rest"))
    total = known.agg(F.sum("target")).first()[0] or 0.0
    bits = bits_for(total, shard_words)
    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")

    quotas = _draw_quotas(blocks, aims, bits, seed).select(F.col("source").alias("qs"), F.col("n_words").alias("qw"), F.col("shard").alias("qn"), "quota").filter("quota > 0")
    turn = F.row_number().over(Window.partitionBy("source", "n_words", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "h"), "doc", "block"))
    own = blocks.withColumn("shard", shard).withColumn("turn", turn)
    own = own.join(quotas, F.col("source").eqNullSafe(F.col("qs")) & (F.col("n_words") == F.col("qw")) & (F.col("shard") == F.col("qn")), "left")
    times = F.col("passes") + F.when(F.col("turn") <= F.col("quota"), 1).otherwise(0)
    draws = own.withColumn("times", times).filter("times > 0").select("shard", "doc", "block", "n_words", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))
    draws = settle(draws, "draws")
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc", "block", "copy"), "doc", "block", "copy")
    return table, draws.select("shard", F.row_number().over(order).alias("position"), "doc", "copy", "block", "n_words", F.lit(block_words).alias("block_words"))


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source), taken (words, repeats counted)."""
    table, draws = plan(docs, id_col, text_col, source_col, **kw)
    words = draws.groupBy("doc").agg(F.sum("n_words").alias("taken"))
    return table.join(words, "doc", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mix as documents: a row for each document and copy, with the blocks that the copy has, in the order of the text.

    A copy that has all blocks is the whole text unchanged; of another, each run of neighbouring blocks keeps its white space,
    and runs are joined by one line feed.  Rows of one doc_id, source and text are one row here, with the copies of all.
    """
    table, draws = plan(docs, id_col, text_col, source_col, **kw)
    copies = draws.groupBy("doc", "copy").agg(F.sort_array(F.collect_list("block")).alias("blocks"), F.max("block_words").alias("block_words"))
    copies = copies.join(table.select("doc", "doc_id", "text_hash", "source"), "doc")
    row, have = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), docs.columns

    def hash_text(batches):
        for rows, chunk in chunked(batches, "text"):
            h = chunk.hashes(chunk.starts[:-1], chunk.starts[1:] - 1)
            yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in range(3)], pa.array(h.view(np.int64))], names=["row", "doc_id", "source", "text_hash"])

    kind = docs.schema.simpleString()
    keyed = docs.select(row, F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    keyed = keyed.mapInArrow(hash_text, f"row {kind}, doc_id long, source string, text_hash long")
    keyed = keyed.groupBy("doc_id", "text_hash", "source").agg(F.min_by("row", F.xxhash64(*[F.col(f"row.`{f.name}`") for f in docs.schema if f.name != text_col and not f.dataType.typeName() == "map"], F.lit(0))).alias("row"))
    on = keyed["doc_id"].eqNullSafe(copies["doc_id"]) & (keyed["text_hash"] == copies["text_hash"]) & keyed["source"].eqNullSafe(copies["source"])
    joined = keyed.join(copies, on).select(keyed["row"], copies["blocks"], copies["block_words"])
    at = have.index(text_col)

    def cut(batches):
        for b in batches:
            rows = b.column(0)
            texts = to_bytes(rows.field(at))
            out = [take_blocks(t, k, w) for t, k, w in zip(texts, b.column(1).to_pylist(), b.column(2).to_pylist())]
            arrays = [rows.field(k) for k in range(len(have))]
            arrays[at] = pa.array([x.decode() for x in out], type=rows.type.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([rows.type.field(k) for k in range(len(have))]))

    return joined.mapInArrow(cut, docs.schema)


def take_blocks(text: bytes, blocks: list[int], block_words: int) -> bytes:
    begin, end, _ = Chunk([text]).words()
    if len(blocks) == -(-len(begin) // block_words):
        return text
    out, k = [], 0
    while k < len(blocks):
        last = k
        while last + 1 < len(blocks) and blocks[last + 1] == blocks[last] + 1:
            last += 1
        a, b = blocks[k] * block_words, min(len(begin), (blocks[last] + 1) * block_words) - 1
        out.append(text[begin[a] : end[b]])
        k = last + 1
    return b"\n".join(out)
