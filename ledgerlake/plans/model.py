"""Log-odds model and metrics.  Stand-ins: line items are reads, orders are claims, customers are clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ratings as R
from ..operators import log_odds as L
from ..operators import metrics as M
from ..operators import resampling as B
from ..operators.sampling import fold
from .registry import query, table

# Published weights of the seven flags and their boundary.
WEIGHTS = {"5": 2.9021826255604424, "4": 1.3629323720579885, "3": -0.6931815737036756, "X": 0.28924941664528264, "I": -0.18739017138309824, "2": -0.7388948123686282, "1": -2.4642482971670145}
BOUNDARY = -4.011463855527319

_KEYS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_PAIRS = {("R", "F"): "1", ("A", "F"): "2", ("N", "F"): "3", ("N", "O"): "4", ("R", "O"): "5", ("A", "O"): "X"}


def reads(spark: SparkSession, d: str) -> DataFrame:
    flag = F.lit("I")
    for (a, b), f in _PAIRS.items():
        flag = F.when((F.col("l_returnflag") == a) & (F.col("l_linestatus") == b), f).otherwise(flag)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), flag.alias("flag"), "l_partkey", "l_suppkey", "l_quantity", "l_discount", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_KEYS)).cast("long").alias("rank"))


def flags_only(spark: SparkSession, d: str) -> DataFrame:
    """Reads without ranks: no sort, two columns read."""
    flag = F.lit("I")
    for (a, b), f in _PAIRS.items():
        flag = F.when((F.col("l_returnflag") == a) & (F.col("l_linestatus") == b), f).otherwise(flag)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), flag.alias("flag"))


def claims(spark: SparkSession, d: str) -> DataFrame:
    v = F.substring("o_orderpriority", 1, 1).cast("int")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("cluster_id"), v.alias("veracity"))
    return o.select("claim_id", "cluster_id", (F.col("veracity") >= 4).cast("int").alias("y"), (F.col("veracity") == 3).alias("mid"), fold("cluster_id").alias("fold"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    return L.flag_counts(claims(spark, d), flags_only(spark, d))


def counted(spark: SparkSession, d: str) -> DataFrame:
    """Counts as one row a claim."""
    return L.flag_table(claims(spark, d), flags_only(spark, d))


def scores(spark: SparkSession, d: str) -> DataFrame:
    return L.out_of_fold(counts(spark, d))


FLAG_SQL = "CASE l_returnflag || l_linestatus " + " ".join(f"WHEN '{a}{b}' THEN '{f}'" for (a, b), f in _PAIRS.items()) + " ELSE 'I' END"
_FLAGS_SQL = ", ".join(f"('{f}')" for f in L.FLAGS)
READS_SQL = f"reads AS (SELECT l_orderkey AS claim_id, {FLAG_SQL} AS flag, l_partkey, l_suppkey, l_quantity, l_discount, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_KEYS)}) AS rank FROM lineitem)"
CLAIMS_SQL = """claims AS (SELECT o_orderkey AS claim_id, o_custkey AS cluster_id, CASE WHEN cast(substr(o_orderpriority, 1, 1) AS INT) >= 4 THEN 1 ELSE 0 END AS y,
  substr(o_orderpriority, 1, 1) = '3' AS mid, cast(('0x' || substr(md5(cast(o_custkey AS VARCHAR)), 1, 4)) AS INT) % 5 AS fold FROM orders)"""
COUNTS_SQL = f"""{READS_SQL}, {CLAIMS_SQL}, flags(flag) AS (VALUES {_FLAGS_SQL}),
seen AS (SELECT claim_id, flag, count(*) AS n FROM reads GROUP BY ALL), total AS (SELECT claim_id, count(*) AS n FROM reads GROUP BY ALL),
counts AS (SELECT c.*, f.flag, coalesce(s.n, 0) + CASE WHEN f.flag = 'I' THEN greatest(0, 10 - coalesce(t.n, 0)) ELSE 0 END AS n
  FROM claims c CROSS JOIN flags f LEFT JOIN seen s ON s.claim_id = c.claim_id AND s.flag = f.flag LEFT JOIN total t ON t.claim_id = c.claim_id)"""
FIT_SQL = "ln(((t + 1) / (sum(t) OVER w + count(*) OVER w)) / ((f + 1) / (sum(f) OVER w + count(*) OVER w)))"
SCORES_SQL = f"""{COUNTS_SQL},
own AS (SELECT fold, flag, sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS t, sum(CASE WHEN y = 0 THEN n ELSE 0 END) AS f FROM counts WHERE NOT mid GROUP BY ALL),
rest AS (SELECT a.fold, a.flag, sum(b.t) AS t, sum(b.f) AS f FROM own a JOIN own b ON a.flag = b.flag AND a.fold <> b.fold GROUP BY ALL),
fw AS (SELECT fold, flag, {FIT_SQL} AS weight FROM rest WINDOW w AS (PARTITION BY fold)),
scores AS (SELECT claim_id, y, fold, round(sum(n * weight), 9) AS score FROM counts JOIN fw USING (fold, flag) GROUP BY ALL)"""
POINTS_SQL = f"""{SCORES_SQL},
per AS (SELECT score AS threshold, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM scores GROUP BY ALL),
points AS (SELECT threshold, sum(p) OVER u / sum(p) OVER () AS fpr, sum(q) OVER u / sum(q) OVER () AS recall FROM per WINDOW u AS (ORDER BY threshold ROWS UNBOUNDED PRECEDING))"""
_WEIGHTS_SQL = ", ".join(f"('{f}', cast({w} AS DOUBLE))" for f, w in WEIGHTS.items())


@query(f"""
    WITH {COUNTS_SQL}, w(flag, weight) AS (VALUES {_WEIGHTS_SQL})
    SELECT claim_id, round(sum(n * weight), 6) AS score, round(sum(n * weight), 9) <= {BOUNDARY} AS flagged FROM counts JOIN w USING (flag) GROUP BY claim_id""")
def flag_score(spark, d):
    weights = spark.createDataFrame(list(WEIGHTS.items()), "flag string, weight double")
    s = L.score(counts(spark, d), weights)
    return s.select("claim_id", F.round("score", 6).alias("score"), (F.round("score", 9) <= BOUNDARY).alias("flagged"))


@query(f"""
    WITH {READS_SQL}, w(flag, weight) AS (VALUES {_WEIGHTS_SQL})
    SELECT claim_id, round(sum(weight), 6) AS score FROM reads JOIN w USING (flag) GROUP BY claim_id""")
def frozen_score(spark, d):
    """Scores without padding: claims with reads only."""
    weights = spark.createDataFrame(list(WEIGHTS.items()), "flag string, weight double")
    return flags_only(spark, d).join(F.broadcast(weights), "flag").groupBy("claim_id").agg(F.round(F.sum("weight"), 6).alias("score"))


@query(f"WITH {COUNTS_SQL} SELECT claim_id, flag, cast(n AS BIGINT) AS n FROM counts")
def flag_counts(spark, d):
    return counts(spark, d).select("claim_id", "flag", "n")


@query(f"""
    WITH {COUNTS_SQL} SELECT claim_id, CASE WHEN flag IN ('5', '4') THEN 't' WHEN flag IN ('1', '2') THEN 'f' ELSE 'e' END AS voice, cast(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL""")
def voice_counts(spark, d):
    return L.voice_counts(counted(spark, d)).select("claim_id", F.col("flag").alias("voice"), "n")


_SIDES = "SELECT flag, sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS t, sum(CASE WHEN y = 0 THEN n ELSE 0 END) AS f FROM counts WHERE NOT mid GROUP BY flag"


@query(f"WITH {COUNTS_SQL}, s AS ({_SIDES}) SELECT flag, round({FIT_SQL}, 6) AS weight FROM s WINDOW w AS ()")
def graded_fit(spark, d):
    return L.fit(counts(spark, d)).select("flag", F.round("weight", 6).alias("weight"))


@query(f"""
    WITH {COUNTS_SQL}, v AS (SELECT CASE WHEN flag IN ('5', '4') THEN 't' WHEN flag IN ('1', '2') THEN 'f' ELSE 'e' END AS flag, y, n FROM counts WHERE NOT mid),
    s AS (SELECT flag, sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS t, sum(CASE WHEN y = 0 THEN n ELSE 0 END) AS f FROM v GROUP BY flag)
    SELECT flag, round({FIT_SQL}, 6) AS weight FROM s WINDOW w AS ()""")
def three_voice_fit(spark, d):
    return L.fit_empty_safe(L.voice_counts(counted(spark, d))).select("flag", F.round("weight", 6).alias("weight"))


@query(f"""
    WITH {COUNTS_SQL}, s AS ({_SIDES}), p AS (SELECT flag, (t + 1) / (sum(t) OVER () + count(*) OVER ()) AS pm, (f + 1) / (sum(f) OVER () + count(*) OVER ()) AS pf FROM s)
    SELECT flag, round(CASE WHEN (pm - 0.1 * pf) / 0.9 > 0 THEN ln((pm - 0.1 * pf) / 0.9 / pf) END, 6) AS weight FROM p""")
def demix_weights(spark, d):
    return L.demixed_weights(counts(spark, d), 0.1).select("flag", F.round("weight", 6).alias("weight"))


@query(f"WITH {SCORES_SQL} SELECT claim_id, y, cast(fold AS INT) AS fold, round(score, 6) AS score FROM scores")
def oof_scores(spark, d):
    return scores(spark, d).select("claim_id", "y", "fold", F.round(F.round("score", 9), 6).alias("score"))


@query(f"""
    WITH {SCORES_SQL}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM scores)
    SELECT count(*) FILTER (y = 1) AS n_true, count(*) FILTER (y = 0) AS n_false,
           round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r""")
def auc_ties(spark, d):
    return L.auc(scores(spark, d)).select("n_true", "n_false", F.round("auc", 6).alias("auc"))


@query(f"WITH {POINTS_SQL} SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(recall, 6) AS recall FROM points")
def roc_points(spark, d):
    return L.operating_points(scores(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("threshold", "fpr", "recall")])


@query(f"""
    WITH {POINTS_SQL} SELECT round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(threshold, 6) AS threshold FROM points WHERE fpr <= 0.02 ORDER BY recall DESC, threshold LIMIT 1""")
def recall_at_fpr(spark, d):
    return L.recall_at_fpr(L.operating_points(scores(spark, d)), 0.02).select(*[F.round(c, 6).alias(c) for c in ("recall", "fpr", "threshold")])


@query(f"WITH {POINTS_SQL} SELECT round(max(threshold), 6) AS threshold FROM points WHERE fpr <= 0.02")
def pick_threshold(spark, d):
    return L.pick_threshold(L.operating_points(scores(spark, d)), 0.02).select(F.round("threshold", 6).alias("threshold"))


@query(f"WITH {POINTS_SQL} SELECT round(min(threshold), 6) AS threshold FROM points WHERE 1 - recall <= 0.1")
def miss_cut(spark, d):
    return L.miss_cut(L.operating_points(scores(spark, d)), 0.1).select(F.round("threshold", 6).alias("threshold"))


@query(f"""
    WITH {POINTS_SQL}, b(budget) AS (VALUES (0.005::DOUBLE), (0.01), (0.02), (0.05))
    SELECT budget, round(recall, 6) AS recall, round(threshold, 6) AS threshold FROM b, points WHERE fpr <= budget QUALIFY row_number() OVER (PARTITION BY budget ORDER BY recall DESC, threshold) = 1""")
def threshold_table(spark, d):
    return L.threshold_table(L.operating_points(scores(spark, d))).select("budget", F.round("recall", 6).alias("recall"), F.round("threshold", 6).alias("threshold"))


_NESTED = f"""{COUNTS_SQL},
own AS (SELECT fold, flag, sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS t, sum(CASE WHEN y = 0 THEN n ELSE 0 END) AS f FROM counts WHERE NOT mid GROUP BY ALL),
folds AS (SELECT DISTINCT fold FROM own),
rest AS (SELECT k.fold AS outr, j.fold AS innr, o.flag, sum(o.t) AS t, sum(o.f) AS f FROM folds k, folds j, own o WHERE o.fold NOT IN (k.fold, j.fold) GROUP BY ALL),
w2 AS (SELECT outr, innr, flag, {FIT_SQL} AS weight FROM rest WINDOW w AS (PARTITION BY outr, innr)),
sc AS (SELECT claim_id, y, innr, outr, round(sum(n * weight), 9) AS score FROM counts JOIN w2 ON innr = fold AND w2.flag = counts.flag GROUP BY ALL),
per AS (SELECT outr, score AS threshold, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM sc WHERE innr <> outr GROUP BY ALL),
pts AS (SELECT outr, threshold, sum(p) OVER u / sum(p) OVER a AS fpr, sum(q) OVER u / sum(q) OVER a AS recall FROM per WINDOW u AS (PARTITION BY outr ORDER BY threshold ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY outr)),
cut AS (SELECT outr, threshold FROM pts WHERE fpr <= 0.02 AND recall > 0 QUALIFY row_number() OVER (PARTITION BY outr ORDER BY recall DESC, threshold) = 1)"""


@query(f"""
    WITH {_NESTED} SELECT cast(s.outr AS INT) AS fold, round(threshold, 6) AS threshold, count(*) FILTER (y = 1) AS n_true, count(*) FILTER (y = 0) AS n_false,
      count(*) FILTER (y = 1 AND score <= threshold) AS flagged_true, count(*) FILTER (y = 0 AND score <= threshold) AS flagged_false
    FROM sc s JOIN cut c ON s.outr = c.outr WHERE innr = s.outr GROUP BY s.outr, threshold""")
def nested_threshold(spark, d):
    return L.nested_operating_point(counted(spark, d)).withColumn("threshold", F.round("threshold", 6))


@query(f"""
    WITH {SCORES_SQL}, per AS (SELECT k.fold AS outr, score AS threshold, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM scores s, (SELECT DISTINCT fold FROM scores) k WHERE s.fold <> k.fold GROUP BY ALL),
    pts AS (SELECT outr, threshold, sum(p) OVER u / sum(p) OVER a AS fpr, sum(q) OVER u / sum(q) OVER a AS recall FROM per WINDOW u AS (PARTITION BY outr ORDER BY threshold ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY outr)),
    cut AS (SELECT outr, threshold FROM pts WHERE fpr <= 0.02 AND recall > 0 QUALIFY row_number() OVER (PARTITION BY outr ORDER BY recall DESC, threshold) = 1)
    SELECT cast(s.fold AS INT) AS fold, round(threshold, 6) AS threshold, count(*) FILTER (y = 1) AS n_true, count(*) FILTER (y = 0) AS n_false,
      count(*) FILTER (y = 1 AND score <= threshold) AS flagged_true, count(*) FILTER (y = 0 AND score <= threshold) AS flagged_false FROM scores s JOIN cut ON s.fold = outr GROUP BY s.fold, threshold""")
def nested_fixed(spark, d):
    return L.nested_fixed(scores(spark, d)).withColumn("threshold", F.round("threshold", 6))


_TIER = "CASE WHEN l_suppkey % 4 = 0 THEN 'primary' WHEN l_suppkey % 4 = 1 THEN 'high' WHEN l_suppkey % 4 = 2 THEN 'unknown' ELSE 'low' END"
_CELLS = f"""{READS_SQL}, {CLAIMS_SQL}, cells AS (SELECT flag, {_TIER} AS tier, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS t, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS f
  FROM reads JOIN claims USING (claim_id) WHERE NOT mid GROUP BY ALL)"""


def _cells(spark, d) -> DataFrame:
    k = F.col("l_suppkey") % 4
    tier = F.when(k == 0, "primary").when(k == 1, "high").when(k == 2, "unknown").otherwise("low")
    both = reads(spark, d).join(claims(spark, d), "claim_id").filter("not mid")
    return both.groupBy("flag", tier.alias("tier")).agg(F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") == 0).alias("f"))


@query(f"WITH {_CELLS} SELECT flag, tier, cast(t AS BIGINT) AS t, cast(f AS BIGINT) AS f FROM cells")
def cell_counts(spark, d):
    return _cells(spark, d)


_SHRINK = """own AS (SELECT *, ln(((t + 1) / (sum(t) OVER () + count(*) OVER ())) / ((f + 1) / (sum(f) OVER () + count(*) OVER ()))) AS cw,
  ln(((sum(t) OVER g + 1) / (sum(t) OVER () + (SELECT count(DISTINCT flag) FROM cells))) / ((sum(f) OVER g + 1) / (sum(f) OVER () + (SELECT count(DISTINCT flag) FROM cells)))) AS fw FROM cells WINDOW g AS (PARTITION BY flag))"""


@query(f"WITH {_CELLS}, {_SHRINK} SELECT flag, tier, round(CASE WHEN t + f < 400 THEN fw ELSE cw END, 6) AS weight FROM own")
def hard_shrink(spark, d):
    return L.shrunk_cells(_cells(spark, d), 400).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_CELLS}, {_SHRINK} SELECT flag, tier, round(cw * ((t + f) / (t + f + 400)) + fw * (1 - (t + f) / (t + f + 400)), 6) AS weight FROM own")
def soft_shrink(spark, d):
    return L.shrunk_cells(_cells(spark, d), 400, True).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_CELLS} SELECT tier, flag, cast(sum(t + f) AS BIGINT) AS n FROM cells GROUP BY GROUPING SETS ((tier, flag), (tier), ())")
def cell_rollup(spark, d):
    """Cells folded to coarser levels."""
    return _cells(spark, d).rollup("tier", "flag").agg(F.sum(F.col("t") + F.col("f")).alias("n"))


@query(f"""
    WITH {SCORES_SQL}, e AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM scores)
    SELECT cast(len(list_filter(e, lambda x: round(x, 9) < score)) AS INT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(1 - y), 6) AS share_false FROM scores, e GROUP BY ALL""")
def decile_calibration(spark, d):
    return L.decile_calibration(scores(spark, d)).select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("share_false", 6).alias("share_false"))


@query(f"""
    WITH {SCORES_SQL}, g AS (SELECT cast(-1 + k * 0.25 AS DOUBLE) AS threshold FROM range(0, 9) t(k))
    SELECT threshold, count(*) FILTER (score >= threshold) AS kept, round(count(*) FILTER (score >= threshold AND y = 1) / nullif(count(*) FILTER (score >= threshold), 0), 6) AS "precision",
      round(count(*) FILTER (score >= threshold AND y = 1) / count(*) FILTER (y = 1), 6) AS retention FROM scores, g GROUP BY threshold""")
def true_threshold_grid(spark, d):
    return L.true_threshold_grid(scores(spark, d), -1.0, 1.0, 0.25).select("threshold", "kept", F.round("precision", 6).alias("precision"), F.round("retention", 6).alias("retention"))


def _verdicts(spark, d) -> DataFrame:
    """Gold by the claim's priority, prediction by its part of the price: four classes."""
    o = table(spark, d, "orders")
    gold = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    return o.select("o_orderkey", F.when(gold > 3, 3).otherwise(gold).alias("gold"), F.floor(F.col("o_totalprice") % 4).cast("int").alias("pred"))


_VERDICTS = "v AS (SELECT o_orderkey, least(cast(substr(o_orderpriority, 1, 1) AS INT) - 1, 3) AS gold, cast(floor(o_totalprice % 4) AS INT) AS pred FROM orders), k(c) AS (VALUES (0), (1), (2), (3), (4))"


@query(f"WITH {_VERDICTS} SELECT g.c AS gold, p.c AS pred, count(v.gold) AS n FROM k g CROSS JOIN k p LEFT JOIN v ON v.gold = g.c AND v.pred = p.c GROUP BY ALL")
def confusion(spark, d):
    return M.confusion(_verdicts(spark, d), "gold", "pred", [0, 1, 2, 3, 4])


@query(f"""
    WITH {_VERDICTS}, n AS (SELECT c AS class, count(*) FILTER (gold = c AND pred = c) AS hit, count(*) FILTER (pred = c) AS called, count(*) FILTER (gold = c) AS there FROM k, v GROUP BY c),
    r AS (SELECT class, hit / greatest(called, 1) AS p, hit / greatest(there, 1) AS r FROM n)
    SELECT class, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r""")
def class_f1(spark, d):
    return M.class_f1(_verdicts(spark, d), "gold", "pred", [0, 1, 2, 3, 4]).select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""
    WITH v AS (SELECT o_orderstatus AS slice, substr(o_orderpriority, 1, 1) < '3' AS g, o_totalprice < 150000 AS f FROM orders WHERE substr(o_orderpriority, 1, 1) <> '3')
    SELECT slice, count(*) AS n, round(count(*) FILTER (g = f) / count(*), 6) AS accuracy, round(count(*) FILTER (g AND f) / count(*) FILTER (g), 6) AS recall,
      round(count(*) FILTER (NOT g AND f) / count(*) FILTER (NOT g), 6) AS fpr, round(count(*) FILTER (g AND f) / count(*) FILTER (f), 6) AS "precision" FROM v GROUP BY slice""")
def binary_slices(spark, d):
    p = F.substring("o_orderpriority", 1, 1)
    v = table(spark, d, "orders").filter(p != "3").select(F.col("o_orderstatus").alias("slice"), (p < "3").alias("g"), (F.col("o_totalprice") < 150000).alias("f"))
    return M.binary_report(v, "g", "f", ("slice",)).select("slice", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "recall", "fpr", "precision")])


@query("""
    WITH v AS (SELECT o_orderkey % 3 = 0 AS a, o_custkey % 3 = 0 AS b FROM orders)
    SELECT count(*) AS n, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM v""")
def mcnemar_counts(spark, d):
    v = table(spark, d, "orders").select((F.col("o_orderkey") % 3 == 0).alias("a"), (F.col("o_custkey") % 3 == 0).alias("b"))
    return M.mcnemar(v, "a", "b").drop("p")


@query()
def mcnemar_p(spark, d):
    v = table(spark, d, "orders").select((F.col("o_orderkey") % 3 == 0).alias("a"), (F.col("o_custkey") % 3 == 0).alias("b"))
    return M.mcnemar(v, "a", "b")


@query("""
    WITH g AS (SELECT lang, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang),
    c AS (SELECT lang, k, n, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS m, 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) AS h FROM g)
    SELECT lang, k, n, round(greatest(0, m - h), 6) AS low, round(least(1, m + h), 6) AS high FROM c""")
def wilson(spark, d):
    g = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("w", M.wilson(F.col("k"), F.col("n"))).select("lang", "k", "n", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query("""
    WITH v AS (SELECT quality AS a, toxic AS b FROM labels), t AS (SELECT count(*) AS t, count(*) FILTER (a = b) AS s, sum(a) AS a1, sum(b) AS b1 FROM v)
    SELECT t AS n, round(s / t, 6) AS agreement, round((a1 * b1 + (t - a1) * (t - b1)) / (t * t), 6) AS expected,
      round((s / t - (a1 * b1 + (t - a1) * (t - b1)) / (t * t)) / (1 - (a1 * b1 + (t - a1) * (t - b1)) / (t * t)), 6) AS kappa FROM t""")
def cohen(spark, d):
    return M.cohen_kappa(table(spark, d, "labels"), "quality", "toxic").select("n", *[F.round(c, 6).alias(c) for c in ("agreement", "expected", "kappa")])


@query(f"""
    WITH {READS_SQL}, p AS (SELECT claim_id, flag, count(*) AS n FROM reads GROUP BY ALL), i AS (SELECT claim_id, sum(n) AS m, sum(n * n) AS sq FROM p GROUP BY 1 HAVING sum(n) > 1),
    o AS (SELECT count(*) AS items, avg((sq - m) / (m * (m - 1))) AS po, sum(m) AS votes FROM i), s AS (SELECT sum(n * n) AS sq FROM (SELECT flag, sum(n) AS n FROM p JOIN i USING (claim_id) GROUP BY flag))
    SELECT items, round(po, 6) AS agreement, round(sq / (votes * votes), 6) AS expected, round((po - sq / (votes * votes)) / (1 - sq / (votes * votes)), 6) AS kappa FROM o, s""")
def fleiss(spark, d):
    return M.fleiss_kappa(flags_only(spark, d), "claim_id", "flag").select("items", *[F.round(c, 6).alias(c) for c in ("agreement", "expected", "kappa")])


_TWO = f"""{READS_SQL}, two AS (SELECT a.flag AS fa, b.flag AS fb FROM reads a JOIN reads b ON a.claim_id = b.claim_id AND a.rank = 1 AND b.rank = 2),
side AS (SELECT fa, fb, CASE WHEN fa IN ('5','4') THEN 1 WHEN fa IN ('1','2') THEN -1 ELSE 0 END AS sa, CASE WHEN fb IN ('5','4') THEN 1 WHEN fb IN ('1','2') THEN -1 ELSE 0 END AS sb FROM two)"""


@query(f"WITH {_TWO} SELECT count(*) AS n, count(*) FILTER (fa = fb) AS exact, count(*) FILTER (sa = sb) AS polarity, count(*) FILTER (sa * sb = -1) AS inversions FROM side")
def reader_agreement(spark, d):
    r = reads(spark, d).filter("rank <= 2").groupBy("claim_id").agg(F.max(F.when(F.col("rank") == 1, F.col("flag"))).alias("fa"), F.max(F.when(F.col("rank") == 2, F.col("flag"))).alias("fb"))
    return M.reader_agreement(r.filter("fb is not null"), "fa", "fb")


@query("SELECT round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.9), 6) AS p90 FROM orders")
def quantiles_linear(spark, d):
    q = M.linear_quantiles(table(spark, d, "orders"), "o_totalprice", [0.5, 0.9])
    return q.agg(*(F.round(F.max(F.when(F.col("k") == k, F.col("value"))), 6).alias(name) for k, name in enumerate(("p50", "p90"))))


@query("""
    WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
    SELECT n, value FROM s WHERE i = least(floor(n * 0.95), n - 1)""")
def quantile_index(spark, d):
    return M.index_quantile(table(spark, d, "events"), "value", 0.95)


@query("""
    WITH s AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), k AS (SELECT *, k * (n + 1) AS a, greatest(1, least(k * (n + 1) // 10, n - 1)) AS j FROM s, range(1, 10) t(k))
    SELECT cast(k AS INT) AS k, round(sum(CASE WHEN i = j THEN value * (10 - (a - j * 10)) / 10 WHEN i = j + 1 THEN value * (a - j * 10) / 10 END), 6) AS value FROM k GROUP BY k""")
def quantiles_exclusive(spark, d):
    return M.quantiles_exclusive(table(spark, d, "events"), "value", 10).select("k", F.round("value", 6).alias("value"))


_CONF = "v AS (SELECT (o_totalprice % 1000) / 1000 AS c, o_orderkey % 3 = 0 AS r FROM orders), b AS (SELECT least(floor(c * 10), 9) AS b, count(*) AS n, avg(c) AS c, avg(r::INT) AS a FROM v GROUP BY 1)"


@query(f"WITH {_CONF} SELECT cast(sum(n) AS BIGINT) AS n, round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b")
def calibration_error(spark, d):
    v = table(spark, d, "orders").select(((F.col("o_totalprice") % 1000) / 1000).alias("c"), (F.col("o_orderkey") % 3 == 0).alias("r"))
    return M.expected_calibration_error(v, "c", "r").select("n", F.round("ece", 6).alias("ece"))


@query(f"WITH {_CONF} SELECT cast(b AS BIGINT) AS bin, n FROM b")
def histogram(spark, d):
    return M.histogram(table(spark, d, "orders").select(((F.col("o_totalprice") % 1000) / 1000).alias("c")), "c")


@query("""
    WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS ra, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2 AS rb FROM orders)
    SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r""")
def spearman(spark, d):
    return M.spearman(table(spark, d, "orders"), "o_totalprice", "o_custkey").select("n", F.round("rho", 6).alias("rho"))


@query(f"""
    WITH {READS_SQL}, s AS (SELECT claim_id, list(DISTINCT flag) AS fl FROM reads GROUP BY 1)
    SELECT claim_id, CASE WHEN (list_contains(fl, '5') OR list_contains(fl, '4')) AND (list_contains(fl, '1') OR list_contains(fl, '2')) THEN '3' WHEN list_contains(fl, '5') THEN '5' WHEN list_contains(fl, '4') THEN '4'
      WHEN list_contains(fl, '1') THEN '1' WHEN list_contains(fl, '2') THEN '2' WHEN list_contains(fl, '3') THEN '3' WHEN list_contains(fl, 'X') THEN 'X' ELSE 'I' END AS flag FROM s""")
def page_flags(spark, d):
    return flags_only(spark, d).groupBy("claim_id").agg(F.collect_set("flag").alias("f")).select("claim_id", R.page_flag(F.col("f")).alias("flag"))


@query()
def bootstrap_ci(spark, d):
    """Percentile intervals of the out-of-fold AUC for cluster and row draws."""
    return B.interval(B.bootstrap_auc(counts(spark, d), L.FLAGS, 2000), ["design"], "auc")


@query()
def paired_auc_difference(spark, d):
    rows = scores(spark, d).withColumn("other", F.col("claim_id") % 17 + 0.0)
    return B.interval(B.paired_difference(rows, "claim_id", "y", "score", "other", 2000).withColumn("g", F.lit("all")), ["g"], "difference")


@query()
def rate_interval(spark, d):
    """Interval of the share of claims that are false, customers drawn whole."""
    c = claims(spark, d).withColumn("hit", F.col("y") == 0)
    return B.interval(B.rate_draws(c, "cluster_id", "hit", 2000).withColumn("g", F.lit("all")), ["g"], "rate")


@query()
def redrawn_weights(spark, d):
    both = flags_only(spark, d).join(claims(spark, d).filter("not mid").select("claim_id", "y"), "claim_id")
    mixed = {"1": {"1": 0.9, "2": 0.1}, "5": {"5": 0.9, "4": 0.1}}
    return B.interval(B.redrawn_weights(both, mixed, L.FLAGS, 2000), ["flag"], "weight")
