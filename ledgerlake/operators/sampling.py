"""Deterministic draws and splits: rows are ranked by a hash of their key, so a draw depends on neither order nor partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(key: str, salt: str):
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(salt)))


def draw(df: DataFrame, key: str, n: int, salt: str = "0") -> DataFrame:
    return df.orderBy(hash_rank(key, salt), key).limit(n)


def draw_per_group(df: DataFrame, group: list[str], key: str, n: int, salt: str = "0") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(hash_rank(key, salt), key)
    return df.withColumn("__t", F.row_number().over(w)).filter(F.col("__t") <= n).drop("__t")


def largest_remainder(strata: DataFrame, stratum: list[str], size: str, n: int, weight: str | None = None, cycle: bool = False) -> DataFrame:
    """(stratum, alloc): n places by size (times weight), floors first, capped at size; one pass over the largest remainders, or cycling until n or all is given.

    strata has one row a stratum, so the window over all of them is small.
    """
    w = F.col(size) * (F.col(weight) if weight else F.lit(1.0))
    all_ = Window.partitionBy()
    share = F.lit(float(n)) * w / F.sum(w).over(all_)
    base = strata.select(*stratum, F.col(size).alias("cap"), share.alias("share")).withColumn("floor", F.least(F.floor("share"), F.col("cap")))
    order = Window.orderBy(F.desc(F.round(F.col("share") - F.floor("share"), 9)), *stratum)
    left = F.lit(n) - F.sum("floor").over(all_)
    if not cycle:
        room = F.col("cap") > F.col("floor")
        turn = F.sum(room.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
        return base.withColumn("left", left).withColumn("turn", turn).select(*stratum, (F.col("floor") + F.when(room & (F.col("turn") <= F.col("left")), 1).otherwise(0)).cast("long").alias("alloc"))
    # place k of a stratum comes in cycle k - floor, in the order of remainders within the cycle
    numbered = base.withColumn("left", left).withColumn("o", F.row_number().over(order))
    more = numbered.filter("cap > floor").select(*stratum, "left", "o", F.explode(F.sequence(F.lit(1), F.least(F.col("cap") - F.col("floor"), F.greatest("left", F.lit(1))).cast("int"))).alias("cycle"))
    given = more.withColumn("t", F.row_number().over(Window.orderBy("cycle", "o"))).filter(F.col("t") <= F.col("left")).groupBy(*stratum).agg(F.count(F.lit(1)).alias("extra"))
    return base.join(given, stratum, "left").select(*stratum, (F.col("floor") + F.coalesce("extra", F.lit(0))).cast("long").alias("alloc"))


def stratified(df: DataFrame, stratum: list[str], key: str, n: int, weight=None, salt: str = "404", cycle: bool = False) -> DataFrame:
    """n rows by largest remainder over strata; weight is a column of the stratum."""
    sizes = df.groupBy(*stratum).agg(F.count(F.lit(1)).alias("size")).withColumn("w", weight if weight is not None else F.lit(1.0))
    alloc = largest_remainder(sizes, stratum, "size", n, "w", cycle)
    w = Window.partitionBy(*stratum).orderBy(hash_rank(key, salt), key)
    return df.join(F.broadcast(alloc), stratum).withColumn("__t", F.row_number().over(w)).filter(F.col("__t") <= F.col("alloc")).drop("__t", "alloc")


def fold(key: str, k: int = 5):
    """Fold of a key by the first four hex digits of its MD5."""
    return (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("int") % k).cast("int")


def split(df: DataFrame, key: str, cluster: str, group: str, per_group: dict, salt: str = "val") -> DataFrame:
    """`part`: val for the drawn rows of each group, dropped for other rows of their clusters, cal for the rest: the two share no cluster."""
    want = F.coalesce(*[F.when(F.col(group) == g, n) for g, n in per_group.items()], F.lit(0))
    w = Window.partitionBy(group).orderBy(hash_rank(key, salt), key)
    marked = df.withColumn("__val", F.row_number().over(w) <= want)
    touched = F.max(F.col("__val").cast("int")).over(Window.partitionBy(cluster)) == 1
    return marked.withColumn("part", F.when(F.col("__val"), "val").when(touched, "dropped").otherwise("cal")).drop("__val")


def overlap(a: DataFrame, b: DataFrame, col: str) -> int:
    """Values that two parts share: 0 where a split must be disjoint."""
    return a.select(col).intersect(b.select(col)).count()
