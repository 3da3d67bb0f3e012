"""Joins, unions, rankings and de-duplication with every tie settled by named columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .metrics import places


def _order(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def keep_first(df: DataFrame, keys, order, keep: int = 1) -> DataFrame:
    """The first `keep` rows of each key; `order` must end in a column that is unique within a key."""
    turn = F.row_number().over(Window.partitionBy(*_order(keys)).orderBy(*_order(order)))
    return df.withColumn("__turn", turn).filter(F.col("__turn") <= keep).drop("__turn")


def last_wins(df: DataFrame, keys, seq: str) -> DataFrame:
    return keep_first(df, keys, [F.desc(seq)])


def mark_repeats(df: DataFrame, keys, order, out: str = "repeat") -> DataFrame:
    """True for the second and later rows of a key."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*_order(keys)).orderBy(*_order(order))) > 1)


def earliest_per_cluster(df: DataFrame, cluster: str, dates: list[str], last: str) -> DataFrame:
    """One row a cluster: the first known of some dates, unknown last."""
    return keep_first(df, [cluster], [F.coalesce(*dates, F.lit("9999")), last])


def relaxed_union(*parts: DataFrame) -> DataFrame:
    """Union by name; missing columns are null, differing types become strings unless they are numbers."""
    kinds: dict[str, set] = {}
    for p in parts:
        for f in p.schema:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    number = {"tinyint": 1, "smallint": 2, "int": 3, "bigint": 4, "float": 5, "double": 6}

    def common(types: set) -> str:
        if len(types) == 1:
            return next(iter(types))
        return max(types, key=number.__getitem__) if types <= set(number) else "string"

    cast = [p.select(*[F.col(c).cast(common(kinds[c])).alias(c) for c in p.columns]) for p in parts]
    out = cast[0]
    for p in cast[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def union_first(key: str, *parts: DataFrame) -> DataFrame:
    """Union in which the row of the earliest part counts for each key."""
    tagged = [p.withColumn("__part", F.lit(k)) for k, p in enumerate(parts)]
    others = [c for c in parts[0].columns if c != key]
    return keep_first(relaxed_union(*tagged), [key], ["__part", *others]).drop("__part")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `old`, and those of `new` whose key is not there yet."""
    return relaxed_union(old, new.join(old.select(key), key, "left_anti"))


def fill_null(left: DataFrame, right: DataFrame, key: str, col: str, source: str) -> DataFrame:
    """Fill `col` from right where left has null or ""; `source` says where a value is from."""
    r = right.select(key, F.col(col).alias("__r"))
    own = F.nullif(F.col(col), F.lit(""))
    joined = left.join(r, key, "left")
    return joined.withColumn(source, F.when(own.isNotNull(), "native").when(F.col("__r").isNotNull(), "filled")).withColumn(col, F.coalesce(own, "__r")).drop("__r")


def overlay(base: DataFrame, new: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Values of `new` where it has the key, else the old ones."""
    return base.join(new.select(*keys, F.col(col).alias("__n")), keys, "left").withColumn(col, F.coalesce("__n", col)).drop("__n")


def rebuild(base: DataFrame, old: DataFrame, new: DataFrame, keys: list[str], claim: str, col: str) -> DataFrame:
    """Rows of `old`, those of `base` for claims that `old` lacks, and over both the values of `new`."""
    missing = base.join(old.select(claim).distinct(), claim, "left_anti")
    return overlay(old.unionByName(missing.select(old.columns)), new, keys, col)


def best_match(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, left_text: str, right_text: str, near: float = 0.9) -> DataFrame:
    """left_id, right_id, jaccard, status of the best candidate with the same key.

    exact: equal texts, exact_multiclaim if several are; near: similarity of `near` and more; ambiguous: several share the
    greatest of those; claim_mismatch: candidates, none near; no_key_match: none.  Only the first three name a right_id.
    """
    a = left.select(F.col(left_id).alias("a"), F.col(key).alias("k"), F.sha2(left_text, 256).alias("mark"))
    # tokens are taken once a text; what follows carries marks and numbers, and copies of a text are one row of each pair
    texts = left.select(F.col(key).alias("k"), F.col(left_text).alias("ta"), F.sha2(left_text, 256).alias("mark"), X.tokens(left_text).alias("sa")).filter("k is not null")
    b = right.groupBy(F.col(key).alias("k"), F.col(right_text).alias("tb")).agg(F.min(right_id).alias("b"), F.count(F.lit(1)).alias("n")).withColumn("sb", X.tokens("tb"))
    met = texts.join(b, "k").select("k", "mark", "b", "n", F.coalesce(F.col("ta") == F.col("tb"), F.lit(False)).alias("same"), F.round(X.jaccard(F.col("sa"), F.col("sb")), 9).alias("j"))
    pairs = met.groupBy("k", "mark", "b").agg(F.max("n").alias("n"), F.max("same").alias("same"), F.max("j").alias("j"))
    w = Window.partitionBy("k", "mark")
    ranked = pairs.select("*", F.row_number().over(w.orderBy(F.desc("same"), F.desc("j"), "b")).alias("turn"), F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).over(w).alias("n_same"), F.max("j").over(w).alias("top"))
    tied = F.sum(F.when(F.col("j") == F.col("top"), F.col("n")).otherwise(0)).over(w)
    top = ranked.withColumn("tied", tied).filter("turn = 1").select(F.col("k").alias("tk"), F.col("mark").alias("tm"), "b", "j", "n_same", "tied")
    status = F.when(F.col("b").isNull(), "no_key_match").when(F.col("n_same") > 1, "exact_multiclaim").when(F.col("n_same") == 1, "exact").when(F.col("j") < near, "claim_mismatch").when(F.col("tied") > 1, "ambiguous").otherwise("near")
    out = a.join(top, (F.col("k") == F.col("tk")) & F.col("mark").eqNullSafe(F.col("tm")), "left").withColumn("status", status)
    good = F.col("status").isin("exact", "exact_multiclaim", "near")
    return out.select(F.col("a").alias(left_id), F.when(good, F.col("b")).alias(right_id), F.col("j").alias("jaccard"), "status")


def prefix_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str, n: int = 80, how: str = "left") -> DataFrame:
    """Join on the first n characters; a left row without a match keeps nulls."""
    return left.withColumn("__p", F.substring(left_text, 1, n)).join(right.withColumn("__p", F.substring(right_text, 1, n)), "__p", how).drop("__p")


def first_failing(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """`dropped_by`: the first rule that a row fails, null if it passes all; a null test is a failure."""
    out = F.lit(None).cast("string")
    for name, test in reversed(rules):
        out = F.when(~F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(out)
    return df.withColumn("dropped_by", out)


def funnel(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(step, rule, dropped, left): the cascade of the rules, counted in one pass."""
    marked = first_failing(df, rules).agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("dropped_by") == n).alias(f"d{k}") for k, (n, _) in enumerate(rules)])
    steps, gone = [], F.lit(0)
    for k, (n, _) in enumerate(rules):
        gone = gone + F.col(f"d{k}")
        steps.append(F.struct(F.lit(k + 1).alias("step"), F.lit(n).alias("rule"), F.col(f"d{k}").alias("dropped"), (F.col("all") - gone).alias("left")))
    return marked.select(F.explode(F.array(*steps)).alias("s")).select("s.*")


def quota(df: DataFrame, group: str, key: str, order, most: Column) -> DataFrame:
    """At most `most` rows of each key in a group, in the given order."""
    return df.withColumn("__t", F.row_number().over(Window.partitionBy(group, key).orderBy(*_order(order)))).filter(F.col("__t") <= most).drop("__t")


def mirror_flag(df: DataFrame, group: str, voice: str, order) -> DataFrame:
    """True if the voice was seen before in the group."""
    return mark_repeats(df, [group, voice], order, "mirror")


def capped_union_arm(docs: DataFrame, claim: str, arm: str, rank: str, url: str, keep: Column, cap: int = 20) -> DataFrame:
    """Pages of arms in order, first of each URL, at most `cap` seen per claim, and only then those to keep."""
    seen = keep_first(docs, [claim, url], [arm, rank])
    at = F.row_number().over(Window.partitionBy(claim).orderBy(arm, rank, url))
    return seen.withColumn("place", at).filter((F.col("place") <= cap) & keep)


def domain_suffix_semi(df: DataFrame, host_col: str, names: DataFrame, anti: bool = False) -> DataFrame:
    from ..functions.urls import host_suffixes

    keyed = df.select(F.col(host_col).alias("h")).distinct().select("h", F.explode(host_suffixes(F.col("h"))).alias("domain"))
    hit = keyed.join(names.select("domain").distinct(), "domain", "left_semi").select("h").distinct()
    return df.join(hit, df[host_col] == hit["h"], "left_anti" if anti else "left_semi")


def budgeted_pick(df: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """Rows taken in order while they fit the budget of their group; one that does not fit is skipped, and a later one may.

    Rows stream through a task sorted by group and order, with what is left of one budget at hand: no group is held, however large.
    """

    def pick(batches):
        at, left = object(), budget
        for batch in batches:
            take = []
            for g, c in zip(batch.column(group).to_pylist(), batch.column(cost).to_pylist()):
                if g != at:
                    at, left = g, budget
                fits = c is not None and c <= left
                take.append(fits)
                left -= c if fits else 0
            yield batch.filter(pa.array(take, pa.bool_()))

    return df.repartition(group).sortWithinPartitions(F.col(group), F.col(order).asc_nulls_last()).mapInArrow(pick, df.schema)


def minmax_rank(df: DataFrame, recency: str, likes: str, key: str) -> DataFrame:
    """Score of equal parts recency and logarithm of likes, each scaled to 0..1, and its rank (greatest first)."""
    span = df.agg(F.min(recency).alias("r0"), F.max(recency).alias("r1"), F.min(F.log1p(likes)).alias("l0"), F.max(F.log1p(likes)).alias("l1"))
    part = lambda x, lo, hi: F.when(F.col(hi) > F.col(lo), (x - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(0.0)
    scored = df.crossJoin(F.broadcast(span)).withColumn("score", F.round(0.5 * part(F.col(recency), "r0", "r1") + 0.5 * part(F.log1p(likes), "l0", "l1"), 9)).drop("r0", "r1", "l0", "l1")
    # numbered by ranges: the order is made within ranges, and no task sees all rows
    order = scored.withColumn("by", F.struct((-F.col("score")).alias("less"), F.col(key)))
    return order.join(places(order, "by").select(F.col("value").alias("by"), (F.col("below") + 1).cast("int").alias("place")), "by").drop("by")
