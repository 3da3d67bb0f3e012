"""A Merkle manifest of a dataset: a tree of hashes by group of rows, a tree over the groups, and for each row the path that proves it.

A row's leaf is the hash of its columns.  In a group leaves ascend by id, and every two consecutive nodes become one parent, the hash
of their hex digests laid end to end.  What is stored for a parent is this concatenation, its preimage.  A row joins the
preimages of its ancestors; from each it cuts its own 64 characters, which leaves the siblings, and to fold a
changed leaf it puts the new hash in their place and hashes on.

On Spark: positions come from a sort by ranges, with counts of (range, group) added up, so a group that holds most rows is many tasks.
Levels are made BLOCK_BITS at a time: a task groups at most 2^BLOCK_BITS consecutive nodes into one row that holds the preimages of all
their ancestors in the block, and the next round works on the blocks' top nodes, 2^BLOCK_BITS times fewer.  On the way
down each block joins the path of its top node, so the rows themselves are shuffled twice (sort, blocks), at any height.

Defined results: null columns are `-` in a leaf; null groups come first and are a group of their own; null ids come first in
their group; rows of one id are ordered by leaf, and equal rows are interchangeable, each with its own place; a lone row
of a group has no siblings there; an empty table gives an empty result; other columns are not read.  Texts of any length are
hashed whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._runs import settle

BLOCK_BITS = 8
#: Rows of a range of the sort.
RANGE_ROWS = 200_000
_HEX = 64
_GROUP = ["known", "name"]


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*columns: Column) -> Column:
    """Lowercase hex sha256 of the columns: each `-` if null, else byte count, colon, value."""
    return F.sha2(F.concat(*map(_field, columns)), 256)


def _placed(items: DataFrame, order: list[str], what: str) -> DataFrame:
    """items (a written table) with at, the place of each in its group by order, and n, the size of its group."""
    keys = [F.col(c).asc_nulls_first() for c in (*_GROUP, *order)]
    ranges = -(-items.count() // RANGE_ROWS) or 1
    ranged = items.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    ranged = settle(ranged.withColumn("row", F.monotonically_increasing_id()), what).withColumn("range", F.shiftright("row", 33))
    runs = ranged.groupBy(*_GROUP, "range").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("held"))
    group = Window.partitionBy(*_GROUP)
    before = F.coalesce(F.sum("held").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*_GROUP, "range", (before - F.col("first")).alias("shift"), F.sum("held").over(group).alias("n"))  # a row a range and group
    return ranged.join(runs, [*_GROUP, "range"]).withColumn("at", F.col("row") + F.col("shift")).drop("row", "range", "shift")


def _height(n: Column) -> Column:
    """Levels above n leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


_LEVELS = f"""
aggregate(slice(sequence(1, {BLOCK_BITS}), 1, levels), named_struct('now', transform(items, x -> x.hash), 'made', cast(array() as array<array<string>>)),
  (up, level) -> named_struct(
    'now', transform(sequence(0, cast((size(up.now) - 1) div 2 as int)), i -> sha2(concat(get(up.now, 2 * i), coalesce(get(up.now, 2 * i + 1), '')), 256)),
    'made', concat(up.made, array(transform(sequence(0, cast((size(up.now) - 1) div 2 as int)), i -> concat(get(up.now, 2 * i), coalesce(get(up.now, 2 * i + 1), '')))))))"""


def _blocks(items: DataFrame, done: int) -> DataFrame:
    """A row a block of items (known, name, at, n, hash, item): its items, the preimages that it makes level by level, its top node."""
    grouped = items.groupBy(*_GROUP, F.shiftright("at", BLOCK_BITS).alias("block")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "hash", "item"))).alias("items")  # at most 2^BLOCK_BITS
    )
    levels = F.least(F.lit(BLOCK_BITS), F.greatest(F.lit(0), _height(F.col("n")) - done)).cast("int")
    made = grouped.withColumn("levels", levels).withColumn("up", F.expr(_LEVELS))
    return made.select(*_GROUP, "block", "n", "items", F.col("up.made").alias("made"), F.expr("get(up.now, 0)").alias("top"))


@dataclass
class Tree:
    """Written tables of blocks, the lowest first; in the last each group is one block."""

    rounds: list[DataFrame]

    def tops(self) -> DataFrame:
        return self.rounds[-1].select(*_GROUP, F.col("top").alias("hash"))

    def nodes(self) -> DataFrame:
        """known, name, level (from 1), node, preimage, hash: the stored parents."""
        out = None
        for k, blocks in enumerate(self.rounds):
            at = blocks.select(*_GROUP, "block", F.posexplode("made").alias("level", "parents")).select(*_GROUP, "block", "level", F.posexplode("parents").alias("node", "preimage"))
            level = F.col("level") + 1 + k * BLOCK_BITS
            node = F.expr(f"shiftright(shiftleft(block, {BLOCK_BITS}), level + 1)")
            part = at.select(*_GROUP, level.alias("level"), (node + F.col("node")).alias("node"), "preimage", F.sha2("preimage", 256).alias("hash"))
            out = part if out is None else out.unionByName(part)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """known, name, item, hash, path of every item, and the columns of above (known, name, path, ...), whose paths lead on from the groups' tops.

        A path is an array of (pre, slot): an ancestor's preimage and which of its 64-character slots is the own one.
        """
        own = "transform(made, (parents, level) -> named_struct('pre', get(parents, cast(shiftright(x.at & {mask}, level + 1) as int)), 'slot', cast(shiftright(x.at, level) & 1 as int)))"
        own = own.format(mask=(1 << BLOCK_BITS) - 1)
        carried = [c for c in above.columns if c not in (*_GROUP, "path")]
        upper = above.withColumn("block", F.lit(0).cast("long"))
        for blocks in reversed(self.rounds):
            items = blocks.select(*_GROUP, "block", F.expr(f"transform(items, x -> named_struct('at', x.at, 'hash', x.hash, 'item', x.item, 'own', {own}))").alias("items"))
            both = items.join(upper, [*_GROUP, "block"]).select(*_GROUP, *carried, "path", F.explode("items").alias("x"))
            found = both.select(*_GROUP, *carried, "x.at", "x.hash", "x.item", F.concat("x.own", "path").alias("path"))
            upper = found.select(*_GROUP, *carried, "path", F.col("at").alias("block"))
        return found.drop("at")


def _tree(items: DataFrame, order: list[str], what: str) -> Tree:
    """items: known, name, hash, item and the columns of order, written."""
    placed = _placed(items, order, f"{what}-places")
    rounds = [settle(_blocks(placed, 0), f"{what}-blocks")]
    while rounds[-1].where(f"n > {1 << (BLOCK_BITS * len(rounds))}").limit(1).count():
        done = BLOCK_BITS * len(rounds)
        tops = rounds[-1].select(*_GROUP, F.col("block").alias("at"), "n", F.col("top").alias("hash"), F.lit(None).cast("int").alias("item"))
        rounds.append(settle(_blocks(tops, done), f"{what}-blocks"))
    return Tree(rounds)


@dataclass
class Manifest:
    """The tree of each group and the tree over the groups, whose top is the root."""

    groups: Tree
    over: Tree

    def proofs(self) -> DataFrame:
        """known, name, item, hash, path (to the root), subroot, root."""
        root = self.over.tops().select(*_GROUP, F.col("hash").alias("root"), F.expr("cast(array() as array<struct<pre: string, slot: int>>)").alias("path"))
        tops = self.over.paths(root).select("item.*", F.col("hash").alias("subroot"), "root", "path")
        return self.groups.paths(tops)


def build(leaves: DataFrame, group: str, order: str, leaf: str) -> Manifest:
    """The manifest of a table of leaves; its other columns go along in `item`."""
    rest = [c for c in leaves.columns if c not in (group, leaf)]
    items = leaves.select(
        F.col(group).isNotNull().alias("known"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("name"), F.col(leaf).alias("hash"),
        F.struct(*rest).alias("item"), F.col(order).alias("by"), F.monotonically_increasing_id().alias("tie"),
    )
    items = settle(items, "leaves")
    groups = _tree(items.select(*_GROUP, "hash", "item", "by", "tie"), ["by", "hash", "tie"], "groups")
    tops = groups.tops().select(F.lit(True).alias("known"), F.lit("").alias("name"), "hash", F.struct(*_GROUP).alias("item"), *(F.col(c).alias(f"by_{c}") for c in _GROUP))
    return Manifest(groups, _tree(settle(tops, "tops"), [f"by_{c}" for c in _GROUP], "over"))


def siblings(path: str = "path") -> Column:
    """The other hashes under a row's ancestors, level by level, left to right, without the row's own."""
    return F.expr(f"array_join(transform({path}, x -> concat(left(x.pre, x.slot * {_HEX}), substr(x.pre, x.slot * {_HEX} + {_HEX + 1}))), '')")


def folded(leaf: str, path: str = "path") -> Column:
    """The root that a leaf gives: into each ancestor's preimage the hash so far is put in the own slot."""
    return F.expr(f"aggregate({path}, {leaf}, (h, x) -> sha2(concat(left(x.pre, x.slot * {_HEX}), h, substr(x.pre, x.slot * {_HEX} + {_HEX + 1})), 256))")


def checked(docs: DataFrame, tampered_every: int = 7) -> DataFrame:
    """Per row of documents: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Of rows whose id's crc32 tampered_every divides, n_chars is one more when the leaf is made anew for the folding; 0 for none.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("n_chars", "long"), ("text", "string"))))
    leaf = leaf_of(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    other = leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % tampered_every == 0, F.lit(False)) if tampered_every else F.lit(False)
    leaves = d.select("lang", "doc_id", leaf.alias("leaf"), F.when(hit & F.col("n_chars").isNotNull(), other).alias("changed"))
    proofs = build(leaves, "lang", "doc_id", "leaf").proofs()
    out = proofs.select(
        F.col("item.doc_id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root",
        F.sha2(siblings(), 256).alias("proof_sha256"), F.coalesce("item.changed", "hash").alias("now"), "path",
    )
    out = out.withColumn("folded_root", folded("now")).drop("path", "now")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
