"""Similarity join of documents on word n-gram sets by parity sketches.

A document's set is its distinct n-word shingles, as 64-bit hashes.  With Jaccard similarity of num/den
or more, sets of a and b shingles differ in at most d = (a + b)(den - num)/(den + num) of them.  A sketch
has P parts; each shingle is dealt to one part by hash and XORed into that part's 64 bits.  A shingle that
only one of two sets holds changes one part, so the number of parts that differ is at most the symmetric
difference: with P = d + t parts, two similar sets have at least t equal parts (the pigeonhole).

Sizes are cut into bands such that a similar pair lies in one band or in two neighbours; every document
sketches itself for its own band and the one below, with that band's d, and documents that have an equal
part may meet.  Parts of few shingles, and those that only hold shingles of a passage that many documents share, are
equal in very many documents.  As t equal parts are certain, a document leaves out the t - 1 parts of a band that most slabs
have (ties by key): of the t or more that a similar pair has in common, the rarest is among what both keep.  So no
similar pair is lost, and frequent parts bring no pairs.  t is larger than the number of parts of at most one shingle that a document nearly always has.

Equal sets are one representative from the start.  Documents that meet at a part are compared with the
part's smallest member, never all with all.  Only members that stay outside the component of that smallest member
are then compared with the other members of their parts: any two members still apart include such a one.
Pairs are held against bit sketches: every shingle flips one of about 8 d bits, so the Hamming distance of two sketches is at most
the symmetric difference.  With smallest members that is done when the pairs are distinct; in the second join it is done inside it, with the sketch of the
part's band beside each member, so that near documents that don't link are tested there and never become rows.  Every link is verified by exact intersection of the shingle sets.

Defined results: null or empty text, or text without words, has no shingles and no links; text with
fewer than n words is one shingle; rows of one doc_id are one node; rows without doc_id take no part and
get a null component; an empty table gives an empty result; other columns pass through `keep_one`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._components import components
from ._runs import bits_for, distinct, free_name, settle, split, text_size, unpack
from ._text import U, chunked, first_of, mix, windows
from .suffix_dedup import _RUN_DDL as RUN_DDL
from .suffix_dedup import _out_runs as out_runs

#: A worker holds one slab of texts with some 12 bytes a key, or the names of one bucket: 100 to 200 MB.
SLAB_BYTES = 6 << 20
BUCKET_NAMES = 1_000_000


class Bands:
    """Size bands and their sketches for a similarity of num/den."""

    def __init__(self, num: int, den: int):
        if not 0 < num < den:
            raise ValueError("similarity must lie between 0 and 1")
        self.num, self.den = num, den
        self.edges, self.parts, self.slack, self.width = [1], [], [], []

    def _grow(self, size: int) -> None:
        while self.edges[-1] <= size:
            self.edges.append(self.edges[-1] * self.den // self.num + 1)
        while len(self.parts) < len(self.edges):
            low = self.edges[len(self.parts)]
            small = low * self.den // self.num
            large = small * self.den // self.num
            d = (small + large) * (self.den - self.num) // (self.den + self.num)
            t = 1
            if d:
                rate = low / (d + 1)
                t = 2 + math.ceil(2 * (d + 1) * math.exp(-rate) * (1 + rate))
            self.parts.append(d + t if d else 0)
            self.slack.append(t)
            self.width.append(-(-8 * d // 64))

    def of(self, sizes):
        """Band of each size of at least 1."""
        self._grow(int(sizes.max(initial=1)))
        return np.searchsorted(np.array(self.edges), sizes, side="right") - 1

    def keys(self, starts, shingles):
        """Keys of each set shingles[starts[k]:starts[k + 1]], their place (2 k for the own band, 2 k + 1 for the one below), and t of each place."""
        sizes = np.diff(starts)
        own = self.of(sizes)
        doc_of = np.repeat(np.arange(len(sizes)), sizes)
        spread = mix(shingles ^ U(0xA0761D6478BD642F))
        filled = mix(shingles)
        found, whose, slack = [], [], np.ones(2 * len(sizes), np.int64)
        for lower, band in enumerate((own, own - 1)):
            parts = np.where(band >= 0, np.array(self.parts)[band], 0)
            slack[lower::2] = np.array(self.slack)[band]
            first = np.concatenate([[0], np.cumsum(parts)])
            live = parts[doc_of] > 0
            doc = doc_of[live]
            slot = first[doc] + (spread[live] % parts[doc].astype(U)).astype(np.int64)
            word = np.zeros(first[-1], U)
            np.bitwise_xor.at(word, slot, filled[live])
            owner = np.repeat(np.arange(len(sizes)), parts)
            part = np.arange(first[-1]) - first[owner]
            found.append(mix(word ^ mix(part.astype(U) * U(0xE7037ED1A0B428DB) + band[owner].astype(U))))
            whose.append(2 * owner + lower)
        return np.concatenate(found), np.concatenate(whose), slack

    def sketches(self, starts, shingles, lower: int):
        """Bit sketch of each set for its own band (lower 0) or the one below (1): where each begins, and the 64-bit words."""
        sizes = np.diff(starts)
        band = self.of(sizes) - lower
        width = np.where(band >= 0, np.array(self.width)[band], 0)
        first = np.concatenate([[0], np.cumsum(width)])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        live = width[doc] > 0
        doc = doc[live]
        bit = mix(shingles[live] ^ U(0x8EBC6AF09C88C6E3)) % (64 * width[doc]).astype(U)
        word = np.zeros(first[-1], U)
        np.bitwise_xor.at(word, first[doc] + (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
        return first, word


def shingle_sets(chunk, n: int):
    """Where each document's set begins, and the sets' hashes."""
    begin, end, doc = chunk.words()
    word = chunk.hashes(begin, end, lower=True)
    h, at = windows(word, doc, n)
    count = np.bincount(doc, minlength=chunk.n)
    owner = doc[at]
    for m in range(1, n):  # the whole sequence of a text of fewer words
        few = (count == m)[doc]
        hm, am = windows(word[few], doc[few], m)
        h, owner = np.concatenate([h, mix(hm + U(m))]), np.concatenate([owner, doc[few][am]])
    order, new = first_of(owner, h)
    h, owner = h[order][new], owner[order][new]
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=chunk.n))]).astype(np.int64), h


def _list(starts, values):
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def sketch(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128-bit identity of the set), band, own and low (bit sketches)."""

    def run(batches):
        bands = Bands(num, den)
        for rows, chunk in chunked(batches, "text"):
            starts, h = shingle_sets(chunk, n)
            size = np.diff(starts)
            total = lambda x, op: op.reduceat(np.append(x, U(0)), np.minimum(starts[:-1], len(x)))  # noqa: B023, E731
            a, b = total(mix(h ^ U(0x1D8E4E27C47D124F)), np.add), total(mix(h + U(0xEB44ACCAB455D165)), np.bitwise_xor)
            a[size == 0] = b[size == 0] = 0
            filled = size > 0
            some = np.concatenate([[0], np.cumsum(size[filled])])
            band = np.full(chunk.n, -1)
            band[filled] = bands.of(size[filled])

            def spread(at, values):
                count = np.zeros(chunk.n, np.int64)  # noqa: B023
                count[filled] = np.diff(at)  # noqa: B023
                return _list(np.concatenate([[0], np.cumsum(count)]), values)

            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(size.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(band.astype(np.int32)), spread(*bands.sketches(some, h, 0)), spread(*bands.sketches(some, h, 1))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "band", "own", "low"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, band int, own array<long>, low array<long>")


def _sets(docs: DataFrame, id_col: str, text_col: str, n: int, wanted: DataFrame) -> DataFrame:
    def run(batches):
        for rows, chunk in chunked(batches, "text"):
            starts, h = shingle_sets(chunk, n)
            yield pa.RecordBatch.from_arrays([rows.column(0), _list(starts, h)], names=["id", "shingles"])

    some = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    return some.mapInArrow(run, "id long, shingles array<long>")


_BACK_DDL = "slab long, bucket long, often binary"


def _often(table: pa.Table) -> pa.Table:
    """Bucket side: how many slabs have each key, on a logarithmic scale in one byte (0: only this slab), for each slab in the order of its run."""
    slabs, runs = table["slab"].to_pylist(), [unpack(r) for r in table["run"].to_pylist()]
    name = np.concatenate(runs)
    order = np.argsort(name)
    s = name[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    count = np.diff(np.append(np.flatnonzero(new), len(s)))
    scale = np.minimum(np.ceil(8 * np.log2(count)), 255).astype(np.uint8)
    often = np.zeros(len(s), np.uint8)
    often[order] = scale[np.cumsum(new) - 1]
    ends = np.cumsum([len(r) for r in runs])
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return pa.table({"slab": slabs, "bucket": pa.repeat(table["bucket"][0].as_py(), len(slabs)), "often": pa.array([squeeze(often[a:b].tobytes()) for a, b in zip([0, *ends[:-1]], ends)], pa.binary())})


def _keyed(table, n: int, num: int, den: int):
    """Of a slab: keys and their places, and of each place t, the document and its set size; of documents with equal sets only the smallest id."""
    bands, keys, places, slacks, owners, sizes = Bands(num, den), [], [], [], [], []
    found: dict[tuple, int] = {}
    begun = 0
    order = np.argsort(np.asarray(table["id"]), kind="stable")
    for batch in table.take(pa.array(order)).combine_chunks().to_batches():
        for part, chunk in chunked([batch], "text", SLAB_BYTES // 4):
            ids = np.asarray(part.column(0))
            starts, h = shingle_sets(chunk, n)
            total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(0x1D8E4E27C47D124F)), dtype=U)])
            marks = list(zip(np.diff(starts).tolist(), (total[starts[1:]] - total[starts[:-1]]).tolist()))
            live = np.array([m[0] > 0 and found.setdefault(m, i) == i for m, i in zip(marks, ids.tolist())], bool)
            count = np.diff(starts)
            key, place, slack = bands.keys(np.concatenate([[0], np.cumsum(count[live])]), h[np.repeat(live, count)])
            keys.append(key)
            places.append((place + begun).astype(np.int32))
            slacks.append(slack)
            owners.append(np.repeat(ids[live], 2))
            sizes.append(np.repeat(count[live], 2))
            begun += len(slack)
    kinds = ((keys, U), (places, np.int32), (slacks, np.int64), (owners, np.int64), (sizes, np.int64))
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in kinds)


def shared_keys(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    """(key, rep, n, lower): the keys that several documents have and that these documents don't leave out, with the documents, their set
    sizes, and whether the key's band is the one below their own.

    Nearly all keys are of one document, so they are not sent as rows: slabs of documents send buckets sorted runs of their distinct
    keys, get a byte back for each, and only then give the rows of the shared ones.  A key of a third of all documents
    is one entry a slab.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    rows, size = text_size(thin, "text")
    slabs = max(1, -(-size // SLAB_BYTES), -(-rows // 200_000))
    placed = thin.withColumn("slab", F.pmod(F.xxhash64("id"), F.lit(slabs)))
    bits = bits_for(size / 6, BUCKET_NAMES)

    def send(key, table):
        return out_runs(key[0].as_py(), distinct(_keyed(table, n, num, den)[0]), None, bits)

    def give(key, table, back):
        schema = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("lower", pa.bool_())])
        k, place, slack, owner, size_ = _keyed(table, n, num, den)
        order = np.argsort(k)
        s = k[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        kind = np.cumsum(new, dtype=np.int32) - 1
        times = np.diff(np.append(np.flatnonzero(new), len(s)))
        reply = dict(zip(back["bucket"].to_pylist(), back["often"].to_pylist()))
        often = np.zeros(len(times), np.uint8)
        for b, part in split(s[new], bits):
            often[part] = np.frombuffer(zstandard.ZstdDecompressor().decompress(reply[b]), np.uint8)
        shared = ((often > 0) | (times > 1))[kind]
        some, often = order[shared], often[kind[shared]]
        # shared keys of each place, the most frequent first; the others of the place are rarer than all of them
        turned = np.lexsort((k[some], 255 - often, place[some]))
        some = some[turned]
        p = place[some]
        turn = np.arange(len(p)) - np.searchsorted(p, p)
        some = some[turn >= slack[p] - 1]
        p = place[some]
        return pa.table([pa.array(k[some].view(np.int64)), pa.array(owner[p]), pa.array(size_[p]), pa.array(p % 2 == 1)], schema=schema)

    back = settle(placed.groupBy("slab").applyInArrow(send, RUN_DDL).groupBy("bucket").applyInArrow(_often, _BACK_DDL), "shared-keys", free=True)
    return placed.groupBy("slab").cogroup(back.groupBy("slab")).applyInArrow(give, "key long, rep long, n long, lower boolean")


def _may_link(a: str, b: str, num: int, den: int):
    """The Hamming distance of two sketches (structs n, band, own, low) leaves room for a link."""
    low = F.least(f"{a}.band", f"{b}.band")
    side = lambda x: F.when(F.col(f"{x}.band") == low, F.col(f"{x}.own")).otherwise(F.col(f"{x}.low"))
    apart = F.aggregate(F.zip_with(side(a), side(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = F.lit(den) * F.least(f"{a}.n", f"{b}.n") >= F.lit(num) * F.greatest(f"{a}.n", f"{b}.n")
    return near & (F.lit(den + num) * apart <= F.lit(den - num) * (F.col(f"{a}.n") + F.col(f"{b}.n")))


def _near(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of representatives whose bit sketches leave room for a link."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    marks = settle(nodes.join(wanted, "rep", "left_semi").select("rep", F.struct(F.col("n_shingles").alias("n"), "band", "own", "low").alias("k")), "marks")
    mark = lambda x: marks.select(F.col("rep").alias(x), F.col("k").alias(f"k{x}"))
    return pairs.join(mark("a"), "a").join(mark("b"), "b").filter(_may_link("ka", "kb", num, den)).select("a", "b").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are similar by exact intersection."""
    wanted = settle(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    sets = settle(_sets(docs, id_col, text_col, n, wanted), "sets", free=True)
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(right, "b").join(left, "a").filter(F.lit(den) * both >= F.lit(num) * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    drawn = settle(sketch(docs, id_col, text_col, n, num, den), "sketches")
    nodes = drawn.filter("n_shingles > 0 and doc_id is not null")
    same = nodes.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    first = nodes.withColumnRenamed("doc_id", "rep").join(same, ["n_shingles", "set_a", "set_b", "rep"], "left_semi")
    held = settle(shared_keys(docs, id_col, text_col, n, num, den).join(first.select("rep").distinct(), "rep", "left_semi").distinct(), "held", free=True)
    meets = held.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).filter("head < last").select("key", "head")
    heads = meets.join(held.select("key", F.col("rep").alias("head"), F.col("n").alias("n_head")).distinct(), ["key", "head"])
    members = settle(held.join(heads, "key").filter("rep > head").distinct(), "members", free=True)
    size_fits = lambda x, y: F.lit(den) * F.least(x, y) >= F.lit(num) * F.greatest(x, y)
    star = members.filter(size_fits("n", "n_head")).select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    links = settle(_verified(settle(_near(settle(star, "star"), first, num, den), "near"), docs, id_col, text_col, n, num, den), "links")
    # rows of one doc_id are one node: an id with several sets links their representatives
    ids = nodes.join(same, ["n_shingles", "set_a", "set_b"]).select("doc_id", "rep")
    several = ids.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("doc_id")
    own = ids.join(several, "doc_id").filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = settle(links.unionByName(own), "links")
    comp = settle(components(links, "a", "b"), "components")

    named = lambda df, col, out: df.join(comp.select(F.col("id").alias(col), F.col("component").alias("c")), col, "left").withColumn(out, F.coalesce("c", col)).drop("c")
    placed = settle(named(named(members.select("key", "head", "rep", "n", "lower"), "rep", "rep_in"), "head", "head_in"), "placed")
    apart = settle(placed.filter("rep_in <> head_in").select("key", "rep"), "apart")
    if not apart.isEmpty():
        both = placed.join(apart.select("key").distinct(), "key", "left_semi")
        marks = first.join(both.select("rep").distinct(), "rep", "left_semi").select("rep", "own", "low")
        both = settle(both.join(marks, "rep").select("key", "rep", "rep_in", "n", (F.col("rep_in") != F.col("head_in")).alias("apart"), F.when(F.col("lower"), F.col("low")).otherwise(F.col("own")).alias("bits")), "apart-bits", free=True)
        one = both.filter("apart").select("key", F.col("rep").alias("b"), F.col("rep_in").alias("b_in"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
        other = both.select("key", F.col("rep").alias("a"), F.col("rep_in").alias("a_in"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
        differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        fits = (F.col("b_in") != F.col("a_in")) & size_fits("na", "nb") & (F.lit(den + num) * differ <= F.lit(den - num) * (F.col("na") + F.col("nb")))
        pairs = one.join(other.withColumnRenamed("key", "key2"), (F.col("key") == F.col("key2")) & fits)
        pairs = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs", free=True)
        more = settle(_verified(pairs, docs, id_col, text_col, n, num, den), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            comp = settle(components(links, "a", "b"), "components")

    rep = drawn.select("doc_id", "n_shingles", "set_a", "set_b").join(same, ["n_shingles", "set_a", "set_b"], "left")
    out = rep.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without those that a smaller doc_id of their component stands for; of rows with one doc_id one stays, and rows without doc_id stay."""
    found = link_components(docs, id_col, text_col, n, num, den)
    gone, mark, turn = (free_name(docs, x) for x in ("gone", "mark", "turn"))
    later = found.filter("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    stay = docs.join(later, docs[id_col] == later[gone], "left_anti")
    order = Window.partitionBy(id_col, mark).orderBy(*[F.col(c) for c in docs.columns if c != id_col and not dict(docs.dtypes)[c].startswith("map")], F.lit(0))
    with_mark = stay.withColumn(mark, F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()))
    return with_mark.withColumn(turn, F.row_number().over(order)).filter(F.col(turn) == 1).select(docs.columns)
