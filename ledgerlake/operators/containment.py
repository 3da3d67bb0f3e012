"""Copies among the pages of a claim: containment of sentence sets, the forest of their strongest links, groups at every threshold.

|A n B| / min(|A|, |B|) does not punish a copy that was cut or got an introduction, as Jaccard does.  It has no symmetric prefix
filter: the smaller set may lie anywhere in the larger one.  So only the smaller set is cut to a prefix of its rarest sentences, and
is looked up in an inverted index of all sentences of the block; a pair that reaches the threshold shares one of the first
n - ceil(least n) + 1 sentences of its smaller set.  Pages with equal sets are one representative with a number of members, so copies
of one page, however many, are one row and no pairs.

Defined results: sets without a usable sentence are linked with nothing and have no row; null text is no text; equal sets have
containment and Jaccard 1; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clustering import _cut, components, rows

#: Shorter ones are page furniture, which must not make an overlap.
LEAST_CHARS = 25


def usable_sentences(sents) -> Column:
    """Distinct sentences in lower case, punctuation and space runs as one space, without short ones."""
    plain = lambda s: F.btrim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_\s]+", " "), r"\s+", " "))
    return F.array_distinct(F.filter(F.transform(sents, plain), lambda s: F.length(s) >= LEAST_CHARS))


def representatives(pages: DataFrame, block: str, page: str, sents: Column) -> tuple[DataFrame, DataFrame]:
    """(block, rep, members, sents) of each distinct set, rep its least page; and (block, page, rep).

    sents holds sentences as 64-bit hashes: texts are read once, and no later step carries them.  Only sentences of one block meet, so of a block with k
    sentences some k^2 / 2^65 pairs are taken for equal that are not.
    """
    hashed = F.sort_array(F.transform(usable_sentences(sents), lambda s: F.xxhash64(s)))
    sets = _cut(pages.select(F.col(block).alias("block"), F.col(page).alias("page"), hashed.alias("sents"))).filter(F.size("sents") > 0)
    kept = sets.groupBy("block", "sents").agg(F.min("page").alias("rep"), F.count(F.lit(1)).alias("members"))
    firsts = _cut(kept.groupBy("block", "rep").agg(F.min(F.struct("sents", "members")).alias("x")).select("block", "rep", "x.members", "x.sents"))
    members = sets.select("block", "page", F.min("page").over(Window.partitionBy("block", "sents")).alias("rep"))
    return firsts, members


def containment_pairs(firsts: DataFrame, least: float) -> DataFrame:
    """(block, a, b, containment, jaccard), a < b, of representatives with containment of at least `least`."""
    if not 0 < least <= 1:
        raise ValueError("least must lie above 0, up to 1")
    held = firsts.select("block", "rep", F.size("sents").alias("n"), F.explode("sents").alias("s"))
    often = held.groupBy("block", "s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = _cut(held.join(rows(often), ["block", "s"]))
    # sentences of one page only are the rarest: they fill the front of the prefix without a partner
    turn = F.row_number().over(Window.partitionBy("block", "rep").orderBy("df", "s"))
    known = F.count(F.lit(1)).over(Window.partitionBy("block", "rep"))
    front = shared.withColumn("turn", turn + F.col("n") - known).filter(F.col("turn") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    small = front.select("block", "s", F.col("rep").alias("x"), F.col("n").alias("nx"))
    large = shared.select("block", "s", F.col("rep").alias("y"), F.col("n").alias("ny"))
    inner = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    met = small.join(rows(large), ["block", "s"]).filter(inner).select("block", "x", "y").distinct()
    sets = firsts.select("block", "rep", "sents")
    both = met.join(rows(sets.select("block", F.col("rep").alias("x"), F.col("sents").alias("sx"))), ["block", "x"]).join(rows(sets.select("block", F.col("rep").alias("y"), F.col("sents").alias("sy"))), ["block", "y"])
    common = F.size(F.array_intersect("sx", "sy"))
    found = both.select("block", "x", "y", common.alias("i"), F.size("sx").alias("nx"), F.size("sy").alias("ny"))
    scored = found.select("block", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("i") / F.col("nx")).alias("containment"), (F.col("i") / (F.col("nx") + F.col("ny") - F.col("i"))).alias("jaccard"))
    return scored.filter(F.col("containment") >= least - 1e-9)


def strongest_forest(links: DataFrame, weight: str = "containment") -> DataFrame:
    """(block, a, b, weight) of a maximum spanning forest of links (block, a, b, weight).

    In each round every component takes its best link to another one, ties by (a, b), so no circle closes; components at least
    halve.  Two pages are in one group at a threshold exactly if the forest joins them by links that reach it.
    """
    edges = _cut(links.select("block", "a", "b", F.col(weight).alias("weight")))
    part = _cut(edges.select("block", F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("part", F.col("id")))
    forest = None
    while True:
        named = lambda x: part.select("block", F.col("id").alias(x), F.col("part").alias(f"p{x}"))  # noqa: B023, E731
        open_ = edges.join(rows(named("a")), ["block", "a"]).join(rows(named("b")), ["block", "b"]).filter("pa <> pb")
        ends = open_.select("block", "a", "b", "weight", F.explode(F.array(F.struct(F.col("pa").alias("own"), F.col("pb").alias("other")), F.struct(F.col("pb").alias("own"), F.col("pa").alias("other")))).alias("e"))
        best = F.min(F.struct((-F.col("weight")).alias("w"), "a", "b", F.col("e.other").alias("other")))
        taken = _cut(ends.groupBy("block", "e.own").agg(best.alias("x")).select("block", "own", "x.other", "x.a", "x.b", (-F.col("x.w")).alias("weight")))
        if taken.isEmpty():
            break
        new = taken.select("block", "a", "b", "weight").distinct()
        forest = new if forest is None else forest.unionByName(new)
        moved = part.join(rows(_heads(taken).select("block", F.col("id").alias("part"), "head")), ["block", "part"], "left")
        part = _cut(moved.select("block", "id", F.coalesce("head", "part").alias("part")))
    return edges.limit(0) if forest is None else _cut(forest)


def _heads(taken: DataFrame) -> DataFrame:
    """(block, id, head): where the links that the components took lead.

    Under one order of links the only circles are two components that took each other; the smaller one of them is the head.  Paths are walked
    in doubled steps.
    """
    back = taken.select("block", F.col("own").alias("other"), F.col("other").alias("own"), F.lit(True).alias("mutual"))
    head = F.col("mutual") & (F.col("own") < F.col("other"))
    now = _cut(taken.join(rows(back), ["block", "own", "other"], "left").select("block", F.col("own").alias("id"), F.when(head, F.col("own")).otherwise(F.col("other")).alias("head")))
    while True:
        on = now.select("block", F.col("id").alias("head"), F.col("head").alias("onward"))
        step = _cut(now.join(rows(on), ["block", "head"]).select("block", "id", F.col("onward").alias("head"), (F.col("onward") != F.col("head")).alias("moved")))
        if step.filter("moved").isEmpty():
            return now
        now = step.drop("moved")


def _components(links: DataFrame) -> DataFrame:
    """(block, id, component) of links (block, a, b) between whole numbers."""
    node = lambda c: F.struct(F.col("block").alias("block"), F.col(c).alias("id"))
    found = components(links.select(node("a").alias("a"), node("b").alias("b")))
    return found.select(F.col("id.block").alias("block"), F.col("id.id").alias("id"), F.col("component.id").alias("component"))


def groups_at(forest: DataFrame, least: float) -> DataFrame:
    """(block, id, component): the groups that links of at least `least` make, from the forest alone."""
    return _components(forest.filter(F.col("weight") >= least - 1e-9))


def greatest_overlap(firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(block, rep, members, containment, jaccard): the greatest of each distinct set with another page, 0 where no pair is known."""
    ends = pairs.select("block", F.explode(F.array("a", "b")).alias("rep"), "containment", "jaccard").groupBy("block", "rep").agg(F.max("containment").alias("c"), F.max("jaccard").alias("j"))
    copied = F.col("members") > 1
    both = firsts.select("block", "rep", "members").join(ends, ["block", "rep"], "left")
    return both.select("block", "rep", "members", F.when(copied, 1.0).otherwise(F.coalesce("c", F.lit(0.0))).alias("containment"), F.when(copied, 1.0).otherwise(F.coalesce("j", F.lit(0.0))).alias("jaccard"))


def calibration(pages: DataFrame, block: str, page: str, sents: Column) -> DataFrame:
    """(measure, bin, n): pages by their greatest containment and Jaccard in ten bins, and pairs of pages in the bands 3 to 7 tenths and above.

    Copies count with their numbers, without being paired: n members of one set are n (n - 1) / 2 pairs of containment 1.
    """
    firsts, _ = representatives(pages, block, page, sents)
    # below a tenth all is one bin, but Jaccard of a pair is never above its containment, so no greater value is lost
    pairs = _cut(containment_pairs(firsts, 0.1))
    best = _cut(greatest_overlap(firsts, pairs))
    tenth = lambda c: F.least(F.floor(F.col(c) * 10 + 1e-9), F.lit(9)).cast("int")
    bins = best.select(F.explode(F.array(F.struct(F.lit("containment").alias("measure"), tenth("containment").alias("bin")), F.struct(F.lit("jaccard").alias("measure"), tenth("jaccard").alias("bin")))).alias("x"), "members")
    counted = bins.groupBy("x.measure", "x.bin").agg(F.sum("members").alias("n"))
    size = firsts.select("block", "rep", "members")
    weighed = pairs.join(size.select("block", F.col("rep").alias("a"), F.col("members").alias("ma")), ["block", "a"]).join(size.select("block", F.col("rep").alias("b"), F.col("members").alias("mb")), ["block", "b"])
    banded = weighed.filter("containment >= 0.3 - 1e-9").select(F.when(F.col("containment") > 0.7 + 1e-9, 7).otherwise(3).alias("bin"), (F.col("ma") * F.col("mb")).alias("n"))
    own = firsts.filter("members > 1").select(F.lit(7).alias("bin"), (F.col("members") * (F.col("members") - 1) / 2).cast("long").alias("n"))
    return counted.unionByName(banded.unionByName(own).groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit("pairs").alias("measure"), "bin", "n"))


def threshold_groups(pages: DataFrame, block: str, page: str, sents: Column, tenths=range(3, 10)) -> DataFrame:
    """(tenth, groups, pages, copies, largest): the groups of pages at each threshold, all from one forest."""
    firsts, _ = representatives(pages, block, page, sents)
    forest = strongest_forest(containment_pairs(firsts, min(tenths) / 10))
    each = F.explode(F.array(*map(F.lit, tenths))).alias("tenth")
    at = F.struct("tenth", "block").alias("block")
    reached = forest.select("block", "a", "b", "weight", each).filter(F.col("weight") >= F.col("tenth") / 10 - 1e-9).select(at, "a", "b")
    comp = _components(reached)
    size = firsts.select("block", F.col("rep").alias("id"), "members", each).select(at, "id", "members")
    grouped = size.join(rows(comp), ["block", "id"], "left").groupBy("block", F.coalesce("component", "id").alias("g")).agg(F.sum("members").alias("n"))
    return grouped.groupBy("block.tenth").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("pages"), F.sum(F.col("n") - 1).alias("copies"), F.max("n").alias("largest"))


def syndicated(pages: DataFrame, block: str, page: str, sents: Column, least: float = 0.7) -> DataFrame:
    """(block, page, kept): for each page with a usable sentence the least page of its group at the threshold."""
    firsts, members = representatives(pages, block, page, sents)
    comp = _components(containment_pairs(firsts, least).select("block", "a", "b"))
    return members.join(comp.withColumnRenamed("id", "rep"), ["block", "rep"], "left").select("block", "page", F.coalesce("component", "rep").alias("kept"))
