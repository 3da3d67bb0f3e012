"""Log-odds count model: flag counts per claim, Laplace-smoothed weights, out-of-fold scores, operating points.

Counts are kept long, (claim, bucket, n) with every bucket present, so fits are one aggregation and a
fold's weights come from totals minus the fold's own counts.  A table of weights has one row a bucket, or one a
(fold, bucket): it is small whatever the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import linear_quantiles

#: The flags of a read page, from clear support to clear refutation, with two silent ones.
FLAGS = ("5", "4", "3", "X", "I", "2", "1")
VOICES = {"5": "t", "4": "t", "1": "f", "2": "f"}


def flag_table(claims: DataFrame, reads: DataFrame, slots: int | None = 10, flags=FLAGS, silent: str = "I") -> DataFrame:
    """(claims' columns, n) for every claim: its counts in the order of flags; missing reads up to `slots` count as silent ones.

    Claims without reads stay; reads above `slots` count and are not padded.
    """
    seen = reads.groupBy("claim_id").agg(*[F.count_if(F.col("flag") == f).alias(f"n{k}") for k, f in enumerate(flags)], F.count(F.lit(1)).alias("n_reads"))
    wide = claims.join(seen, "claim_id", "left")
    pad = F.greatest(F.lit(0), F.lit(slots or 0) - F.coalesce("n_reads", F.lit(0)))
    return wide.select(*claims.columns, F.array(*[(F.coalesce(f"n{k}", F.lit(0)) + (pad if f == silent and slots else 0)).cast("long") for k, f in enumerate(flags)]).alias("n"))


def _spread(table: DataFrame, names, n) -> DataFrame:
    """(others, flag, n): a row for each name and its number."""
    others = [c for c in table.columns if c != "n"]
    return table.select(*others, F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), x.alias("n")) for f, x in zip(names, n)])).alias("x")).select(*others, "x.flag", "x.n")


def _merged(table: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, n): rows of one claim are one; a row a claim is grouped, not one a flag or fold."""
    return table.groupBy(*keys).agg(F.array(*[F.sum(F.col("n")[k]) for k in range(size)]).alias("n"))


def flag_counts(claims: DataFrame, reads: DataFrame, slots: int | None = 10, flags=FLAGS, silent: str = "I") -> DataFrame:
    """(claims' columns, flag, n) for every claim and flag: flag_table with a row a flag."""
    return _spread(flag_table(claims, reads, slots, flags, silent), flags, [F.col("n")[k] for k in range(len(flags))])


def voice_counts(table: DataFrame, flags=FLAGS) -> DataFrame:
    """(claims' columns, flag, n) of flag_table with three voices: t (supports), f (refutes), e (neither); added up within a claim's row."""
    table = _merged(table, [c for c in table.columns if c != "n"], len(flags))
    part = lambda v: reduce(Column.__add__, [F.col("n")[k] for k, f in enumerate(flags) if VOICES.get(f, "e") == v])
    return _spread(table, "tfe", [part(v) for v in "tfe"])


def to_voices(counts: DataFrame) -> DataFrame:
    """Seven flags folded to three voices: t (supports), f (refutes), e (neither)."""
    voice = reduce(lambda acc, kv: F.when(F.col("flag") == kv[0], kv[1]).otherwise(acc), VOICES.items(), F.lit("e"))
    keys = [c for c in counts.columns if c not in ("flag", "n")]
    return counts.withColumn("flag", voice).groupBy(*keys, "flag").agg(F.sum("n").alias("n"))


def _weight(true: str, false: str, k: Column, total_true: Column, total_false: Column) -> Column:
    return F.ln(((F.col(true) + 1) / (total_true + k)) / ((F.col(false) + 1) / (total_false + k)))


def fit(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, flag, weight): Laplace-smoothed log ratio of the flag's share among true and false claims; mid claims are out."""
    side = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    sums = counts.filter("not mid").groupBy(*by, "flag").agg(side(1).alias("t"), side(0).alias("f"))
    w = Window.partitionBy(*by)
    return sums.select(*by, "flag", _weight("t", "f", F.count("flag").over(w), F.sum("t").over(w), F.sum("f").over(w)).alias("weight"))


def fit_empty_safe(counts: DataFrame) -> DataFrame:
    """fit(), with weight 0 where one side has no reads at all."""
    side = lambda y: F.sum(F.when((F.col("y") == y) & ~F.col("mid"), F.col("n")).otherwise(0))
    some = counts.agg(side(1).alias("all_t"), side(0).alias("all_f"))
    return fit(counts).crossJoin(F.broadcast(some)).select("flag", F.when((F.col("all_t") == 0) | (F.col("all_f") == 0), 0.0).otherwise(F.col("weight")).alias("weight"))


def score(counts: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("claim_id",), on: tuple[str, ...] = ("flag",)) -> DataFrame:
    """(keys, score): sum of count times weight."""
    return counts.join(F.broadcast(weights), list(on)).groupBy(*keys).agg(F.sum(F.col("n") * F.col("weight")).alias("score"))


def fold_weights(counts: DataFrame) -> DataFrame:
    """(fold, flag, weight): fitted without the fold, from totals minus the fold's own counts in one pass."""
    side = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    own = counts.filter("not mid").groupBy("fold", "flag").agg(side(1).alias("t"), side(0).alias("f"))
    all_ = Window.partitionBy("flag")
    rest = own.select("fold", "flag", (F.sum("t").over(all_) - F.col("t")).alias("t"), (F.sum("f").over(all_) - F.col("f")).alias("f"))
    w = Window.partitionBy("fold")
    return rest.select("fold", "flag", _weight("t", "f", F.count("flag").over(w), F.sum("t").over(w), F.sum("f").over(w)).alias("weight"))


def out_of_fold(counts: DataFrame, keys: tuple[str, ...] = ("claim_id", "y", "fold")) -> DataFrame:
    """(keys, score): each claim scored by the weights fitted on the other folds."""
    return score(counts, fold_weights(counts), keys, ("fold", "flag"))


def auc(scores: DataFrame, digits: int = 9) -> DataFrame:
    """(n_true, n_false, auc): Mann-Whitney with ties counting half, from counts per distinct score."""
    per = scores.groupBy(F.round("score", digits).alias("s")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    below = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    wins = per.select("p", "q", (F.col("p") * (F.coalesce(F.sum("q").over(below), F.lit(0)) + F.col("q") / 2)).alias("u"))
    return wins.agg(F.sum("p").alias("n_true"), F.sum("q").alias("n_false"), (F.sum("u") / (F.sum("p") * F.sum("q"))).alias("auc"))


def operating_points(scores: DataFrame, by: tuple[str, ...] = (), digits: int = 9) -> DataFrame:
    """(by, threshold, fpr, recall) for each distinct score: claims at or below the threshold are flagged."""
    s = scores.withColumn("threshold", F.round("score", digits))
    per = s.groupBy(*by, "threshold").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    upto = Window.partitionBy(*by).orderBy("threshold").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*by)
    return per.select(*by, "threshold", (F.sum("p").over(upto) / F.sum("p").over(all_)).alias("fpr"), (F.sum("q").over(upto) / F.sum("q").over(all_)).alias("recall"))


def recall_at_fpr(points: DataFrame, budget: float | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, recall, fpr, threshold): the lowest threshold with the greatest recall whose FPR is within budget; minus infinity if none."""
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    fine = (F.col("fpr") <= limit) & (F.col("recall") > 0)
    best = F.max_by(F.struct("recall", "fpr", "threshold"), F.when(fine, F.struct(F.col("recall"), -F.col("threshold")))).alias("b")
    found = points.groupBy(*by).agg(best)
    return found.select(*by, F.coalesce("b.recall", F.lit(0.0)).alias("recall"), F.coalesce("b.fpr", F.lit(0.0)).alias("fpr"), F.coalesce("b.threshold", F.lit(float("-inf"))).alias("threshold"))


def pick_threshold(points: DataFrame, budget: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, threshold): the largest one whose FPR is within budget; minus infinity if none."""
    return points.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("fpr") <= budget, F.col("threshold"))), F.lit(float("-inf"))).alias("threshold"))


def miss_cut(points: DataFrame, budget: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, threshold): the smallest one that misses at most `budget` of the false claims."""
    return points.groupBy(*by).agg(F.min(F.when(1 - F.col("recall") <= budget, F.col("threshold"))).alias("threshold"))


def nested_operating_point(table: DataFrame, budget: float = 0.02, flags=FLAGS) -> DataFrame:
    """(fold, threshold, n_true, n_false, flagged_true, flagged_false) of flag_table: thresholds from inner folds, applied to the outer one.

    For outer fold k and inner fold j, weights come from the totals without folds k and j.  A claim is scored within its row, once for each
    outer fold.
    """
    counts = _spread(table, flags, [F.col("n")[k] for k in range(len(flags))])
    side = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    own = counts.filter("not mid").groupBy("fold", "flag").agg(side(1).alias("t"), side(0).alias("f"))
    all_ = own.groupBy("flag").agg(F.sum("t").alias("at"), F.sum("f").alias("af"))
    k, j = own.select(F.col("fold").alias("outer"), "flag", F.col("t").alias("kt"), F.col("f").alias("kf")), own.select(F.col("fold").alias("inner"), "flag", F.col("t").alias("jt"), F.col("f").alias("jf"))
    pairs = k.join(j, "flag").join(all_, "flag")  # folds x folds x flags: a fixed number of rows
    same = F.col("outer") == F.col("inner")
    pairs = pairs.select("outer", "inner", "flag", (F.col("at") - F.col("kt") - F.when(same, 0).otherwise(F.col("jt"))).alias("t"), (F.col("af") - F.col("kf") - F.when(same, 0).otherwise(F.col("jf"))).alias("f"))
    w = Window.partitionBy("outer", "inner")
    weights = pairs.select("outer", "inner", "flag", _weight("t", "f", F.count("flag").over(w), F.sum("t").over(w), F.sum("f").over(w)).alias("weight"))
    beside = weights.groupBy("inner", "outer").agg(*[F.max(F.when(F.col("flag") == f, F.col("weight"))).alias(f"w{k}") for k, f in enumerate(flags)])
    total = reduce(Column.__add__, [F.col("n")[k] * F.coalesce(f"w{k}", F.lit(0.0)) for k in range(len(flags))])
    scored = _merged(table, ["claim_id", "y", "fold"], len(flags)).withColumnRenamed("fold", "inner").join(F.broadcast(beside), "inner").select("claim_id", "y", "inner", "outer", total.alias("score"))
    inner = operating_points(scored.filter("inner <> outer"), ("outer",))
    cut = recall_at_fpr(inner, budget, ("outer",)).select("outer", "threshold")
    held = scored.filter("inner = outer").join(F.broadcast(cut), "outer")
    flag = F.round("score", 9) <= F.col("threshold")
    return held.groupBy(F.col("outer").alias("fold"), "threshold").agg(F.count_if(F.col("y") == 1).alias("n_true"), F.count_if(F.col("y") == 0).alias("n_false"), F.count_if(flag & (F.col("y") == 1)).alias("flagged_true"), F.count_if(flag & (F.col("y") == 0)).alias("flagged_false"))


def nested_fixed(scores: DataFrame, budget: float = 0.02) -> DataFrame:
    """nested_operating_point for fixed scores: the threshold of a fold is picked on the other folds."""
    folds = scores.select(F.col("fold").alias("outer")).distinct()
    cut = recall_at_fpr(operating_points(scores.join(F.broadcast(folds), scores["fold"] != folds["outer"]), ("outer",)), budget, ("outer",)).select(F.col("outer").alias("fold"), "threshold")
    flag = F.round("score", 9) <= F.col("threshold")
    return scores.join(F.broadcast(cut), "fold").groupBy("fold", "threshold").agg(F.count_if(F.col("y") == 1).alias("n_true"), F.count_if(F.col("y") == 0).alias("n_false"), F.count_if(flag & (F.col("y") == 1)).alias("flagged_true"), F.count_if(flag & (F.col("y") == 0)).alias("flagged_false"))


def threshold_table(points: DataFrame, budgets=(0.005, 0.01, 0.02, 0.05)) -> DataFrame:
    """(budget, recall, fpr, threshold) for each FPR budget."""
    each = points.select("*", F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget"))
    return recall_at_fpr(each, F.col("budget"), ("budget",))


def demix(mixed: Column, other: Column, share: float) -> Column:
    """Share of a bucket in the pure population of a mixture that holds `share` of another; null when not above zero."""
    p = (mixed - F.lit(share) * other) / F.lit(1 - share)
    return F.when(p > 0, p)


def demixed_weights(counts: DataFrame, share: float) -> DataFrame:
    """(flag, weight) where the true side is a mixture with `share` false claims; Laplace-smoothed shares."""
    side = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    sums = counts.filter("not mid").groupBy("flag").agg(side(1).alias("t"), side(0).alias("f"))
    w = Window.partitionBy()
    k = F.count("flag").over(w)
    shares = sums.select("flag", ((F.col("t") + 1) / (F.sum("t").over(w) + k)).alias("pm"), ((F.col("f") + 1) / (F.sum("f").over(w) + k)).alias("pf"))
    return shares.select("flag", F.ln(demix(F.col("pm"), F.col("pf"), share) / F.col("pf")).alias("weight"))


def shrunk_cells(cells: DataFrame, least: int = 200, soft: bool = False) -> DataFrame:
    """(flag, tier, weight) of the flag x tier cells of (flag, tier, t, f).

    Hard: a cell of fewer than `least` reads takes its flag's weight.  Soft: the cell's weight and the flag's are blended by n / (n + least).
    """
    all_, flag = Window.partitionBy(), Window.partitionBy("flag")
    k, kf = F.count("flag").over(all_), F.size(F.collect_set("flag").over(all_))
    tt, tf = F.sum("t").over(all_), F.sum("f").over(all_)
    own = F.ln(((F.col("t") + 1) / (tt + k)) / ((F.col("f") + 1) / (tf + k)))
    marginal = F.ln(((F.sum("t").over(flag) + 1) / (tt + kf)) / ((F.sum("f").over(flag) + 1) / (tf + kf)))
    n = F.col("t") + F.col("f")
    share = n / (n + F.lit(least))
    return cells.select("flag", "tier", (own * share + marginal * (1 - share) if soft else F.when(n < least, marginal).otherwise(own)).alias("weight"))


def decile_calibration(scores: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, share_false) over bins between exact quantiles of the score (linear interpolation)."""
    s = scores.withColumn("score", F.round("score", 9))
    cuts = linear_quantiles(s, "score", [k / bins for k in range(1, bins)])
    edges = cuts.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("edges"))  # bins - 1 numbers
    placed = s.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: F.round(e, 9) < F.col("score"))))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg((F.col("y") == 0).cast("double")).alias("share_false"))


def true_threshold_grid(scores: DataFrame, low: float = -4.0, high: float = 10.0, step: float = 0.5) -> DataFrame:
    """(threshold, kept, precision, retention): claims above each threshold of a grid."""
    per = scores.groupBy(F.round("score", 9).alias("score")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    grid = per.select("*", F.explode(F.array(*[F.lit(low + k * step) for k in range(int((high - low) / step) + 1)])).alias("threshold"))
    up = F.col("score") >= F.col("threshold")
    sums = grid.groupBy("threshold").agg(F.sum(F.when(up, F.col("p")).otherwise(0)).alias("p"), F.sum(F.when(up, F.col("q")).otherwise(0)).alias("q"), F.sum("p").alias("all_p"))
    return sums.select("threshold", (F.col("p") + F.col("q")).alias("kept"), F.when(F.col("p") + F.col("q") > 0, F.col("p") / (F.col("p") + F.col("q"))).alias("precision"), (F.col("p") / F.col("all_p")).alias("retention"))
