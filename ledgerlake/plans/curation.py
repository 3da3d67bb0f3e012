"""Curation: filters, remaps, joins, rankings, samples, unions, sources, flow.  Stand-ins: orders are claims, customers publishers, events a call log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import ratings as R
from ..functions import text as X
from ..operators import ledger as G
from ..operators import metrics as M
from ..operators import relational as J
from ..operators import sampling as S
from ..sources import files as I
from ..streaming import flow as W
from .registry import query, table

# -- filters and remaps -----------------------------------------------------------------------------


@query("""
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'supported' WHEN 'O' THEN 'refuted' ELSE 'conflicting' END AS label, lower(o_orderpriority) AS rating
    FROM orders WHERE o_orderpriority IS NOT NULL AND trim(o_orderpriority) <> '' AND o_orderstatus IN ('F', 'O', 'P')""")
def label_remap(spark, d):
    o = table(spark, d, "orders").filter(F.col("o_orderpriority").isNotNull() & (F.trim("o_orderpriority") != "") & F.col("o_orderstatus").isin("F", "O", "P"))
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "supported").when(F.col("o_orderstatus") == "O", "refuted").otherwise("conflicting").alias("label"), F.lower("o_orderpriority").alias("rating"))


@query("""
    SELECT o_orderkey, o_custkey FROM orders WHERE (strftime(o_orderdate, '%Y-%m-%d') >= '1998' OR o_totalprice >= 400000) AND o_custkey % 10 IN (1, 3, 7)""")
def window_filter(spark, d):
    o = table(spark, d, "orders")
    return o.filter(((D.iso(F.col("o_orderdate")) >= "1998") | (F.col("o_totalprice") >= 400000)) & (F.col("o_custkey") % 10).isin(1, 3, 7)).select("o_orderkey", "o_custkey")


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND substr(o_orderpriority, 1, 1) = '3' THEN 3 WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 1 WHEN o_totalprice < 50000 AND substr(o_orderpriority, 1, 1) = '5' THEN 4
      ELSE cast(substr(o_orderpriority, 1, 1) AS INT) END AS veracity,
      CASE WHEN o_orderstatus = 'P' AND substr(o_orderpriority, 1, 1) = '3' THEN 'R1' WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'R2' WHEN o_totalprice < 50000 AND substr(o_orderpriority, 1, 1) = '5' THEN 'R3' END AS rule FROM orders""")
def veracity_remap(spark, d):
    p = F.substring("o_orderpriority", 1, 1)
    rules = [("R1", (F.col("o_orderstatus") == "P") & (p == "3"), F.lit(3)), ("R2", p.isin("1", "2"), F.lit(1)), ("R3", (F.col("o_totalprice") < 50000) & (p == "5"), F.lit(4))]
    value, name = p.cast("int"), F.lit(None).cast("string")
    for n, test, v in reversed(rules):
        value, name = F.when(test, v).otherwise(value), F.when(test, n).otherwise(name)
    return table(spark, d, "orders").select("o_orderkey", value.alias("veracity"), name.alias("rule"))


@query("""
    SELECT p_partkey, CASE WHEN f < 0.2 THEN 1 WHEN f < 0.4 THEN 2 WHEN f <= 0.6 THEN 3 WHEN f < 0.8 THEN 4 ELSE 5 END AS veracity,
      CASE WHEN f < 0.2 THEN 'clear_false' WHEN f < 0.4 THEN 'mostly_false' WHEN f <= 0.6 THEN 'mixed' WHEN f < 0.8 THEN 'mostly_true' ELSE 'clear_true' END AS subtype,
      CASE WHEN f < 0.4 THEN 'refuted' WHEN f <= 0.6 THEN 'conflicting' ELSE 'supported' END AS label FROM (SELECT p_partkey, (cast(p_size AS DOUBLE) - 1) / 49 AS f FROM part)""")
def numeric_veracity(spark, d):
    v = R.numeric_veracity("p_size", F.lit(50), F.lit(1))
    return table(spark, d, "part").withColumn("v", v).select("p_partkey", "v.veracity", "v.subtype", R.numeric_label("p_size", F.lit(50), F.lit(1)).alias("label"))


@query()
def text_veracity(spark, d):
    """Verdict texts of every kind, as made up from names, to a veracity and an axis."""
    words = F.array(*[F.lit(x) for x in ("False", "Mostly true", "No evidence", "Partly misleading", "True, but needs caution", "Satire", "Altered photo", "Research in progress", "Fake quote", "Plutôt faux", "odd words")])
    p = table(spark, d, "part").select("p_partkey", F.get(words, (F.col("p_partkey") % 11).cast("int")).alias("rating"))
    return p.withColumn("v", R.veracity("rating")).select("p_partkey", "rating", "v.veracity", "v.subtype", R.judged_axis("rating").alias("axis"))


@query("""
    WITH r(site, k, label) AS (VALUES (0, 'brand#1', 'refuted'), (0, 'brand#2', 'supported'), (1, 'brand#1', 'conflicting'))
    SELECT p_partkey, label FROM part LEFT JOIN r ON site = p_partkey % 2 AND k = lower(trim(p_brand))""")
def rule_map(spark, d):
    rules = spark.createDataFrame([(0, "brand#1", "refuted"), (0, "brand#2", "supported"), (1, "brand#1", "conflicting")], "site long, k string, label string")
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 2).alias("site"), R.rule_key("p_brand").alias("k"))
    return p.join(F.broadcast(rules), ["site", "k"], "left").select("p_partkey", "label")


@query("SELECT event_id, CASE WHEN value <= 5 THEN '1' WHEN value <= 20 THEN '2' WHEN value > 60 THEN 'supported' ELSE 'middle' END AS band FROM events")
def rating_band(spark, d):
    return table(spark, d, "events").select("event_id", R.band("value", 5.0, 20.0, 60.0).alias("band"))




@query("""
    WITH m AS (SELECT median(o_totalprice) AS m FROM orders), f AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 1 WHEN NOT o_totalprice >= m THEN 2 WHEN o_custkey % 7 = 0 THEN 3 WHEN substr(o_orderpriority, 1, 1) = '3' THEN 4 END AS k FROM orders, m)
    SELECT cast(s AS INT) AS step, CASE s WHEN 1 THEN 'status' WHEN 2 THEN 'views' WHEN 3 THEN 'date' ELSE 'forecast' END AS rule, count(*) FILTER (k = s) AS dropped, count(*) FILTER (k IS NULL OR k > s) AS "left" FROM f, range(1, 5) t(s) GROUP BY s""")
def rule_cascade(spark, d):
    o = table(spark, d, "orders")
    o = o.crossJoin(F.broadcast(M.linear_quantiles(o, "o_totalprice", [0.5]).select(F.col("value").alias("m"))))  # one number
    rules = [("status", F.col("o_orderstatus") != "P"), ("views", F.col("o_totalprice") >= F.col("m")), ("date", F.col("o_custkey") % 7 != 0), ("forecast", F.substring("o_orderpriority", 1, 1) != "3")]
    return J.funnel(o, rules)


@query("""
    SELECT event_id, event_type = 'click' AS helpful, CASE WHEN event_type = 'click' THEN 'media' WHEN event_type = 'view' THEN 'old' WHEN event_type = 'error' AND value > 50 THEN 'context' ELSE 'none' END AS class FROM events""")
def note_class(spark, d):
    t = F.col("event_type")
    e = table(spark, d, "events").withColumns({"media": (t == "click").cast("string"), "old": (t == "view").cast("int").cast("string"), "context": ((t == "error") & (F.col("value") > 50)).cast("int").cast("string")}).withColumn("media", (t == "click").cast("int").cast("string"))
    return e.select("event_id", (t == "click").alias("helpful"), R.note_class(["media", "old", "context"]).alias("class"))


@query("""
    SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 90) THEN false WHEN bool_or(event_type = 'purchase' OR (event_type = 'view' AND value < 1)) THEN true END AS label FROM events GROUP BY user_id""")
def quasi_label(spark, d):
    t, v = F.col("event_type"), F.col("value")
    g = table(spark, d, "events").groupBy("user_id").agg(F.bool_or((t == "error") & (v > 90)).alias("a"), F.bool_or((t == "purchase") | ((t == "view") & (v < 1))).alias("b"))
    return g.select("user_id", R.quasi_label(F.col("a"), F.col("b")).alias("label"))


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN flag <> 'I' AND c = 0 THEN 'X' ELSE flag END AS flag, CASE WHEN flag <> 'I' AND c = 0 THEN 'empty-directional' WHEN flag IN ('5','4','3','2','1') AND n >= 15 AND c >= 0.9 * n THEN 'blanket-citation' ELSE '' END AS qc
    FROM (SELECT *, l_returnflag AS rf, CASE l_returnflag WHEN 'R' THEN '1' WHEN 'A' THEN 'I' ELSE '4' END AS flag, l_partkey % 20 AS c, cast(l_quantity AS INT) AS n FROM lineitem)""")
def checked_reads(spark, d):
    l = table(spark, d, "lineitem")
    f = F.when(F.col("l_returnflag") == "R", "1").when(F.col("l_returnflag") == "A", "I").otherwise("4")
    return l.withColumn("v", R.checked_read(f, F.col("l_partkey") % 20, F.col("l_quantity").cast("int"))).select("l_orderkey", "l_linenumber", "v.flag", "v.qc")


# -- dates ------------------------------------------------------------------------------------------

_ORDER_DATES = "o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate + to_days(cast(o_custkey % 5 - 3 AS INT)), '%Y-%m-%d') END AS cd, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN NULL ELSE strftime(o_orderdate - to_days(9), '%Y-%m-%d') END AS xd, strftime(o_orderdate, '%Y-%m-%d') AS rd FROM orders)"


def _order_dates(spark, d) -> DataFrame:
    k, o = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    cd = F.when(k % 3 != 0, D.iso(F.date_add(o, (F.col("o_custkey") % 5 - 3).cast("int"))))
    xd = F.when(k % 4 == 0, F.date_format(o, "yyyy")).when(k % 4 == 1, F.date_format(o, "yyyy-MM")).when(k % 4 == 3, D.iso(F.date_sub(o, 9)))
    return table(spark, d, "orders").select("o_orderkey", cd.alias("cd"), xd.alias("xd"), D.iso(o).alias("rd"))


@query(f"""
    WITH {_ORDER_DATES}, x AS (SELECT *, CASE length(xd) WHEN 4 THEN xd || '-12-31' WHEN 7 THEN strftime(last_day(cast(xd || '-01' AS DATE)), '%Y-%m-%d') ELSE xd END AS xl, CASE WHEN cd < rd THEN cd END AS c, strftime(cast(rd AS DATE) - 1, '%Y-%m-%d') AS cap FROM o),
    p AS (SELECT *, coalesce(c, xl, cap) AS p, CASE WHEN c IS NOT NULL THEN 'claim_date' WHEN xl IS NOT NULL THEN 'x_date' ELSE 'review-1' END AS s FROM x)
    SELECT o_orderkey, CASE WHEN p >= cap THEN cap ELSE p END AS day, CASE WHEN p >= cap AND s <> 'review-1' THEN s || '+clamped' ELSE s END AS source FROM p""")
def ceiling_chain(spark, d):
    return _order_dates(spark, d).withColumn("c", D.ceiling("cd", "xd", "rd")).select("o_orderkey", "c.day", "c.source")


@query(f"""
    WITH {_ORDER_DATES} SELECT o_orderkey, CASE length(xd) WHEN 4 THEN xd || '-12-31' WHEN 7 THEN strftime(last_day(cast(xd || '-01' AS DATE)), '%Y-%m-%d') ELSE xd END AS latest FROM o""")
def partial_dates(spark, d):
    return _order_dates(spark, d).select("o_orderkey", D.latest_day("xd").alias("latest"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed, CASE WHEN o_orderkey % 5 = 4 THEN false ELSE strftime(o_orderdate, '%Y-%m-%d') > '1998-01-01' END AS leak FROM orders""")
def hit_dates(spark, d):
    """Result dates in four formats and relative ones."""
    o, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.date_format(o, "yyyy-MM-dd")).when(k == 1, F.date_format(o, "MMM d, yyyy")).when(k == 2, F.date_format(o, "MMMM d, yyyy")).when(k == 3, F.date_format(o, "d MMM yyyy")).otherwise("3 days ago")
    t = table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))
    return t.select("o_orderkey", D.hit_date("raw").alias("parsed"), D.is_leak("raw", F.lit("1998-01-01")).alias("leak"))


@query("""
    SELECT event_id, strftime(cast(ts AS DATE) - CASE event_type WHEN 'view' THEN n WHEN 'click' THEN 7 * n WHEN 'error' THEN 30 * n WHEN 'signup' THEN 365 * n ELSE 0 END, '%Y-%m-%d') AS day, 'cdr:1,cd_min:1/1/1900,cd_max:' || month(ts) || '/' || day(ts) || '/' || year(ts) AS bound
    FROM (SELECT *, cast(user_id % 9 + 1 AS INT) AS n FROM events)""")
def relative_dates(spark, d):
    t = F.col("event_type")
    unit = F.when(t == "view", "day").when(t == "click", "weeks").when(t == "error", "months").when(t == "signup", "year").otherwise("hours")
    e = table(spark, d, "events").select("event_id", "ts", F.concat_ws(" ", (F.col("user_id") % 9 + 1).cast("string"), unit, F.lit("ago")).alias("raw"))
    return e.select("event_id", D.relative_date("raw", F.col("ts").cast("date")).alias("day"), D.date_bound(D.iso(F.col("ts"))).alias("bound"))


# -- joins ------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20 WHERE o_totalprice > 300000")
def chained_joins(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 300000").select("o_orderkey", "o_custkey")
    c, n = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), table(spark, d, "nation").filter("n_nationkey < 20").select("n_nationkey", "n_name")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey, "left").select("o_orderkey", "c_name", "n_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45)")
def semi_population(spark, d):
    keys = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(keys, "o_orderkey", "left_semi")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_split(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left_anti")


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 12) ON c_nationkey = n_nationkey WHERE n_name <> 'NATION_3'")
def left_null_drop(spark, d):
    """A comparison after a left join drops unmatched rows too."""
    n = table(spark, d, "nation").filter("n_nationkey < 12").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(n, "c_nationkey", "left").filter("n_name <> 'NATION_3'").select("c_custkey", "n_name")


@query("""
    WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE c_mktsegment END AS v FROM customer), r AS (SELECT o_custkey AS k, min(o_orderpriority) AS v FROM orders GROUP BY 1)
    SELECT c_custkey, coalesce(nullif(l.v, ''), r.v) AS v, CASE WHEN nullif(l.v, '') IS NOT NULL THEN 'native' WHEN r.v IS NOT NULL THEN 'filled' END AS source FROM l LEFT JOIN r ON k = c_custkey""")
def coalesce_fill(spark, d):
    k = F.col("c_custkey") % 3
    left = table(spark, d, "customer").select("c_custkey", F.when(k == 1, "").when(k == 2, F.col("c_mktsegment")).alias("v"))
    right = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("v"))
    return J.fill_null(left, right, "c_custkey", "v", "source")


_RANKED = "k AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rank, l_returnflag, l_suppkey FROM lineitem)"


def _ranked(spark, d) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(w).cast("long").alias("rank"), "l_returnflag", "l_suppkey")


@query(f"WITH {_RANKED} SELECT l_orderkey, rank, CASE WHEN rank % 2 = 0 AND l_orderkey % 3 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS l_returnflag FROM k")
def overlay_reads(spark, d):
    base = _ranked(spark, d).select("l_orderkey", "rank", "l_returnflag")
    new = base.filter("rank % 2 = 0 and l_orderkey % 3 = 0").withColumn("l_returnflag", F.lower("l_returnflag"))
    return J.overlay(base, new, ["l_orderkey", "rank"], "l_returnflag")


@query(f"WITH {_RANKED} SELECT l_orderkey, rank, CASE WHEN rank = 1 AND l_orderkey % 5 = 0 THEN 'Z' WHEN l_orderkey % 2 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS l_returnflag FROM k")
def repair_join(spark, d):
    """A newer pass holds some claims only; the others come from the base, and a still newer one overlays both."""
    base = _ranked(spark, d).select("l_orderkey", "rank", "l_returnflag")
    old = base.filter("l_orderkey % 2 = 0").withColumn("l_returnflag", F.lower("l_returnflag"))
    new = base.filter("rank = 1 and l_orderkey % 5 = 0").withColumn("l_returnflag", F.lit("Z"))
    return J.rebuild(base, old, new, ["l_orderkey", "rank"], "l_orderkey", "l_returnflag").select("l_orderkey", "rank", "l_returnflag")


@query("""
    SELECT d.doc_id, coalesce(min(b.item_id), -1) AS item_id FROM documents d LEFT JOIN benchmark b ON substr(d.text, 1, 8) = substr(b.text, 1, 8) GROUP BY d.doc_id""")
def prefix_join(spark, d):
    docs, b = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("ref"))
    return J.prefix_join(docs, b, "text", "ref", 8).groupBy("doc_id").agg(F.coalesce(F.min("item_id"), F.lit(-1)).alias("item_id"))


@query("""
    WITH a AS (SELECT c_custkey, coalesce(o.s, n.n_name) AS tier, CASE WHEN o.s IS NOT NULL THEN 'order' WHEN n.n_name IS NOT NULL THEN 'nation' END AS source
      FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS s FROM orders WHERE o_totalprice > 400000 GROUP BY 1) o ON o_custkey = c_custkey LEFT JOIN nation n ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0) SELECT * FROM a""")
def priority_coalesce(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("s"))
    n = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    j = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(o, "c_custkey", "left").join(n, "c_nationkey", "left")
    return j.select("c_custkey", F.coalesce("s", "n_name").alias("tier"), F.when(F.col("s").isNotNull(), "order").when(F.col("n_name").isNotNull(), "nation").alias("source"))


@query("""
    WITH a AS (SELECT o_orderkey AS claim_id, o_totalprice AS s FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT l_orderkey AS claim_id FROM lineitem WHERE l_returnflag = 'A')
    SELECT claim_id, s FROM a JOIN b USING (claim_id)""")
def paired_alignment(spark, d):
    a = table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("claim_id"), F.col("o_totalprice").alias("s"))
    b = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("claim_id")).distinct()
    return a.join(b, "claim_id")


@query("""
    SELECT coalesce(c_custkey, o_custkey) AS custkey, c_acctbal IS NOT NULL AS known, coalesce(n, 0) AS n FROM (SELECT * FROM customer WHERE c_custkey % 4 <> 0) FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def full_outer(spark, d):
    c = table(spark, d, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("custkey"), "c_acctbal")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("n"))
    return c.join(o, "custkey", "full").select("custkey", F.col("c_acctbal").isNotNull().alias("known"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""
    SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN 'gate-media' WHEN o_orderstatus = 'P' AND o_totalprice < 100000 THEN 'needs-article-no-context' END AS reason FROM orders""")
def exclusion_gate(spark, d):
    gate = table(spark, d, "customer").filter("c_custkey % 11 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("media").alias("kind"))
    o = table(spark, d, "orders").join(gate, "o_custkey", "left")
    reason = F.when(F.col("kind").isNotNull(), F.concat(F.lit("gate-"), "kind")).when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 100000), "needs-article-no-context")
    return o.select("o_orderkey", reason.alias("reason"))


# -- aggregates and rankings ------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def multi_aggregate(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_f, bool_and(o_totalprice > 20000) AS all_big, bool_and(NOT o_orderstatus = 'F') AS none_f FROM orders GROUP BY o_custkey")
def any_all(spark, d):
    f = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(f).alias("any_f"), F.bool_and(F.col("o_totalprice") > 20000).alias("all_big"), F.bool_and(~f).alias("none_f"))


@query("""
    SELECT c_nationkey, year(o_orderdate) AS y1, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey), 6) AS share FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey, year(o_orderdate)""".replace("year(o_orderdate) AS y1", "cast(year(o_orderdate) AS INT) AS y1"))
def crosstab_share(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    g = j.groupBy("c_nationkey", F.year("o_orderdate").alias("y1")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("c_nationkey")), 6))


@query("""
    SELECT o_orderstatus, count(*) FILTER (substr(o_orderpriority, 1, 1) = '1') AS p1, count(*) FILTER (substr(o_orderpriority, 1, 1) = '3') AS p3, count(*) FILTER (substr(o_orderpriority, 1, 1) = '5') AS p5 FROM orders GROUP BY o_orderstatus""")
def pivot_counts(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("p"))
    return o.groupBy("o_orderstatus").pivot("p", ["p1", "p3", "p5"]).agg(F.count(F.lit(1))).fillna(0)


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 5")
def top_strata(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand").limit(5)


@query("""
    SELECT l_orderkey, arg_min(l_returnflag, (l_quantity, l_extendedprice, l_partkey)) AS worst_flag, list_sort(list(DISTINCT l_linestatus)) AS statuses, count(*) AS n FROM lineitem GROUP BY l_orderkey""".replace("arg_min(l_returnflag, (l_quantity, l_extendedprice, l_partkey))", "first(l_returnflag ORDER BY l_quantity, l_extendedprice, l_partkey, l_returnflag)"))
def worst_per_post(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_quantity", "l_extendedprice", "l_partkey", "l_returnflag")).alias("w"), F.array_sort(F.collect_set("l_linestatus")).alias("statuses"), F.count(F.lit(1)).alias("n"))
    return g.select("l_orderkey", F.col("w.l_returnflag").alias("worst_flag"), "statuses", "n")


@query("""
    SELECT user_id, event_type AS category FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def mode_category(spark, d):
    """The most frequent category, ties to the one seen first."""
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("f"))
    return J.keep_first(g, ["user_id"], [F.desc("n"), "f"]).select("user_id", F.col("event_type").alias("category"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_totalprice DESC, o_orderkey) = 1")
def one_per_key(spark, d):
    return J.keep_first(table(spark, d, "orders"), ["o_custkey"], [F.desc(F.col("o_orderstatus") == "F"), F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query(f"WITH {_ORDER_DATES}, j AS (SELECT o.*, o_custkey FROM o JOIN orders USING (o_orderkey)) SELECT o_custkey, o_orderkey FROM j QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(cd, xd, '9999'), o_orderkey) = 1")
def earliest_per_cluster(spark, d):
    j = _order_dates(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return J.earliest_per_cluster(j, "o_custkey", ["cd", "xd"], "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) > 1 AS repeat FROM orders")
def mark_repeats(spark, d):
    return J.mark_repeats(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderkey"]).select("o_orderkey", "repeat")


@query(f"WITH {_RANKED} SELECT l_orderkey, rank, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 7 ORDER BY rank) > 1 AS mirror FROM k")
def mirror_flag(spark, d):
    return J.mirror_flag(_ranked(spark, d).withColumn("voice", F.col("l_suppkey") % 7), "l_orderkey", "voice", ["rank"]).select("l_orderkey", "rank", "mirror")


@query(f"WITH {_RANKED} SELECT l_orderkey, rank FROM k QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY rank) <= CASE WHEN l_suppkey % 3 = 0 THEN 2 ELSE 1 END")
def domain_quota(spark, d):
    k = _ranked(spark, d).withColumn("domain", F.col("l_suppkey") % 3)
    return J.quota(k, "l_orderkey", "domain", ["rank"], F.when(F.col("domain") == 0, 2).otherwise(1)).select("l_orderkey", "rank")


@query(f"""
    WITH {_RANKED}, a AS (SELECT l_orderkey % 200 AS claim, l_orderkey % 2 AS arm, rank, l_suppkey AS url, l_returnflag, l_orderkey FROM k),
    s AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY claim, url ORDER BY arm, rank, l_orderkey) = 1), p AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY arm, rank, url) AS place FROM s)
    SELECT claim, url, cast(place AS INT) AS place FROM p WHERE place <= 20 AND l_returnflag <> 'A'""")
def capped_union_arm(spark, d):
    k = _ranked(spark, d).select((F.col("l_orderkey") % 200).alias("claim"), F.struct((F.col("l_orderkey") % 2).alias("arm")).alias("x"), "rank", F.col("l_suppkey").alias("url"), "l_returnflag", "l_orderkey")
    k = J.keep_first(k.withColumn("arm", F.col("x.arm")).drop("x"), ["claim", "url"], ["arm", "rank", "l_orderkey"])
    return J.capped_union_arm(k, "claim", "arm", "rank", "url", F.col("l_returnflag") != "A").select("claim", "url", "place")


@query("SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 10")
def topk_by_class(spark, d):
    return J.keep_first(table(spark, d, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), "c_custkey"], 10).select("c_mktsegment", "c_custkey")


@query("""
    WITH s AS (SELECT o_orderkey, epoch(o_orderdate) AS r, ln(1 + o_totalprice) AS l FROM orders), q AS (SELECT o_orderkey, round(0.5 * (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()) + 0.5 * (l - min(l) OVER ()) / (max(l) OVER () - min(l) OVER ()), 9) AS score FROM s)
    SELECT o_orderkey, cast(row_number() OVER (ORDER BY score DESC, o_orderkey) AS INT) AS place FROM q""")
def recency_rank(spark, d):
    o = table(spark, d, "orders").withColumn("r", F.unix_timestamp("o_orderdate"))
    return J.minmax_rank(o.select("o_orderkey", "r", "o_totalprice"), "r", "o_totalprice", "o_orderkey").select("o_orderkey", "place")


@query()
def budgeted_pick(spark, d):
    """Posts in rank order while their claims fit the budget; one that does not fit is skipped."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.ceil(F.col("o_totalprice") / 50000).alias("cost"))
    return J.budgeted_pick(o, "o_custkey", "o_orderkey", "cost", 12)


@query("""
    WITH e AS (SELECT user_id, event_id, event_type, cast(value AS INT) % 3 AS t FROM events) SELECT event_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'click' DESC, CASE WHEN event_type = 'click' THEN -event_id END NULLS LAST, event_id) AS INT) AS walk FROM e""")
def triage_walk(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "click").alias("picked"), (-F.col("event_id")).alias("pos"))
    return G.triage_walk(e, "user_id", "picked", "pos", "event_id").select("event_id", "walk")


# -- samples and splits -----------------------------------------------------------------------------


@query("SELECT doc_id FROM documents ORDER BY md5(concat_ws('|', cast(doc_id AS VARCHAR), '7')), doc_id LIMIT 50")
def hash_sample(spark, d):
    return S.draw(table(spark, d, "documents").select("doc_id"), "doc_id", 50, "7")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', cast(doc_id AS VARCHAR), '0')), doc_id) <= 4")
def group_sample(spark, d):
    return S.draw_per_group(table(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id", 4)


_STRATA = """s AS (SELECT year(o_orderdate) AS y, count(*) AS cap, CASE WHEN year(o_orderdate) >= 1998 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM orders GROUP BY 1), f AS (SELECT y, cap, 300.0::DOUBLE * (cap * w) / sum(cap * w) OVER () AS share FROM s),
g AS (SELECT y, cap, share, least(floor(share), cap) AS fl FROM f), t AS (SELECT *, 300 - sum(fl) OVER () AS rest, sum((cap > fl)::INT) OVER (ORDER BY round(share - floor(share), 9) DESC, y ROWS UNBOUNDED PRECEDING) AS turn FROM g),
a AS (SELECT y, cast(fl + CASE WHEN cap > fl AND turn <= rest THEN 1 ELSE 0 END AS BIGINT) AS alloc FROM t)"""


@query(f"WITH {_STRATA} SELECT o_orderkey FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders) JOIN a USING (y) QUALIFY row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('|', cast(o_orderkey AS VARCHAR), '404')), o_orderkey) <= max(alloc) OVER (PARTITION BY y)")
def strat_sample(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return S.stratified(o, ["y"], "o_orderkey", 300, F.when(F.col("y") >= 1998, 2.0).otherwise(1.0)).select("o_orderkey")


@query()
def balanced_draw(spark, d):
    """Two-key strata with cycling remainders: status by priority."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("v"))
    return S.stratified(o, ["o_orderstatus", "v"], "o_orderkey", 240, cycle=True).groupBy("o_orderstatus", "v").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH v AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat_ws('|', cast(o_orderkey AS VARCHAR), 'val')), o_orderkey) <= CASE o_orderstatus WHEN 'F' THEN 40 WHEN 'O' THEN 60 ELSE 0 END AS v FROM orders)
    SELECT o_orderkey, CASE WHEN v THEN 'val' WHEN bool_or(v) OVER (PARTITION BY o_custkey) THEN 'dropped' ELSE 'cal' END AS part FROM v""")
def split_disjoint(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return S.split(o, "o_orderkey", "o_custkey", "o_orderstatus", {"F": 40, "O": 60}).select("o_orderkey", "part")


@query("""
    SELECT o_orderkey, CASE WHEN o_custkey % 13 = 0 THEN 'prior-sample' WHEN o_totalprice < 20000 THEN 'small' WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 THEN 'pending' END AS dropped_by FROM orders""")
def ordered_drops(spark, d):
    rules = [("prior-sample", F.col("o_custkey") % 13 != 0), ("small", F.col("o_totalprice") >= 20000), ("pending", ~((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 2 == 0)))]
    return J.first_failing(table(spark, d, "orders"), rules).select("o_orderkey", "dropped_by")


@query("SELECT c_custkey, cast(('0x' || substr(md5(cast(c_custkey AS VARCHAR)), 1, 4)) AS INT) % 5 AS fold FROM customer")
def md5_fold(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.fold("c_custkey").alias("fold"))


@query()
def blake_fold(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.blake_fold_udf(F.col("c_custkey").cast("string")).alias("fold"))


# -- set operations ---------------------------------------------------------------------------------


@query("""
    SELECT c_name AS name, c_acctbal AS bal, c_mktsegment AS segment, CAST(-1 AS BIGINT) AS suppkey FROM customer UNION ALL SELECT s_name, s_acctbal, NULL, s_suppkey FROM supplier""")
def relaxed_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("suppkey"))
    return J.relaxed_union(c, s).withColumn("suppkey", F.coalesce("suppkey", F.lit(-1)))


@query("SELECT k, src FROM (SELECT c_nationkey AS k, 'customer' AS src, 0 AS p FROM customer UNION ALL SELECT s_nationkey, 'supplier', 1 FROM supplier UNION ALL SELECT n_nationkey, 'nation', 2 FROM nation) QUALIFY row_number() OVER (PARTITION BY k ORDER BY p) = 1")
def registry_union(spark, d):
    parts = [table(spark, d, t).select(F.col(c).alias("k"), F.lit(t).alias("src")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return J.union_first("k", *parts)


@query("SELECT page_id, url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, url FROM pages p WHERE page_id % 2 = 1 AND url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def page_merge(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return J.upsert(p.filter("page_id % 2 = 0"), p.filter("page_id % 2 = 1"), "url").select("page_id", "url")


@query("(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_algebra(spark, d):
    k = lambda s: table(spark, d, "orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return k("F").intersect(k("O")).subtract(k("P"))


# -- sources, stores, flow --------------------------------------------------------------------------


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def last_wins(spark, d):
    return J.last_wins(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 10)")
def manifest_resume(spark, d):
    """Claims that no finished record names."""
    done = table(spark, d, "lineitem").filter("l_quantity < 10").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("SELECT o_orderkey, sha256(concat_ws(chr(31), cast(o_orderkey AS VARCHAR), o_orderpriority)) AS key, substr(sha1(concat_ws('||', o_orderpriority, cast(o_custkey AS VARCHAR))), 1, 16) AS id, substr(sha256(o_orderpriority), 1, 12) AS prompt FROM orders")
def keys(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.cache_key(F.col("o_orderkey").cast("string"), "o_orderpriority").alias("key"), X.stable_id("o_orderpriority", F.col("o_custkey").cast("string")).alias("id"), X.prompt_hash("o_orderpriority").alias("prompt"))


@query("SELECT o_orderkey, cast('0x' || right(sha1(cast(o_orderkey AS VARCHAR)), 1) AS INT) AS shard FROM orders")
def hash_shard(spark, d):
    return table(spark, d, "orders").select("o_orderkey", I.shard(F.col("o_orderkey").cast("string")).alias("shard"))


@query("SELECT event_id, cast((event_id * 4194304 * 1000 + 7) // 4194304 + 1288834974657 AS BIGINT) AS ms FROM events")
def snowflake_time(spark, d):
    return table(spark, d, "events").select("event_id", F.unix_millis(X.snowflake_time(F.col("event_id") * 4194304 * 1000 + 7)).alias("ms"))


@query("SELECT sha256(url) AS page_key, url, text FROM (SELECT url, first(html ORDER BY page_id) AS text FROM pages GROUP BY url)")
def page_store(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.col("html").alias("text"))
    return I.page_store(p, "url", "text", "page_id")


@query("""
    SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (cast(json_extract(props, '$.k') AS INT) > 50) AS cached, round(sum(value), 2) AS cost FROM events GROUP BY user_id""")
def search_ledger(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(k > 50).alias("cached"), F.round(F.sum("value"), 2).alias("cost"))


@query("""
    WITH w AS (SELECT epoch(ts) // 900 * 900 - k * 900 AS s, event_type FROM events, range(0, 4) t(k)) SELECT cast(s AS BIGINT) AS start_s, count(*) AS attempts, count(*) FILTER (event_type = 'error') AS limited FROM w GROUP BY s""".replace("epoch(ts) // 900", "floor(epoch(ts) / 900)"))
def sliding_429(spark, d):
    e = table(spark, d, "events").withColumn("limited", F.col("event_type") == "error")
    return W.limited_share(e, "ts", "limited", "1 hour", "15 minutes").select(F.unix_timestamp("start").alias("start_s"), "attempts", "limited")


@query()
def breaker_modes(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), (~F.col("event_type").isin("error", "view")).alias("ok"), "ts", "event_id")
    return W.breaker_batch(e)


@query()
def rate_gate(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 8).cast("string").alias("key"), (F.col("event_type") == "error").alias("limited"), "ts", "event_id")
    return W.gate_batch(e, "key", "limited", "ts", "event_id")


# -- ledger -----------------------------------------------------------------------------------------

_STATUS = "CASE role WHEN 'user' THEN 'refuted' WHEN 'assistant' THEN CASE WHEN turn % 3 = 0 THEN 'conflicting' ELSE 'supported' END ELSE 'unsupported' END"


def _turns(spark, d) -> DataFrame:
    status = F.when(F.col("role") == "user", "refuted").when(F.col("role") == "assistant", F.when(F.col("turn") % 3 == 0, "conflicting").otherwise("supported")).otherwise("unsupported")
    return table(spark, d, "conversations").select("conv_id", "turn", status.alias("status"), F.when(F.length("text") % 2 == 0, "attribution").otherwise("assertion").alias("type"), (F.length("text") % 3).alias("g"), "text")


@query(f"""
    WITH c AS (SELECT conv_id, {_STATUS} AS s FROM conversations), n AS (SELECT conv_id, count(*) FILTER (s = 'refuted') AS r, count(*) FILTER (s = 'conflicting') AS c, count(*) FILTER (s = 'unsupported') AS u FROM c GROUP BY 1)
    SELECT conv_id, r >= 2 AS nudge, CASE WHEN r > 0 THEN 'FALSE' WHEN c > 0 THEN 'CONFLICTING' WHEN u > 0 THEN 'UNSUPPORTED' ELSE 'NONE' END AS verdict FROM n""")
def code_verdict(spark, d):
    return G.code_verdict(_turns(spark, d), "conv_id", "status", 2)


@query(f"""
    SELECT conv_id, cast(length(text) % 3 AS INT) AS g, string_agg(CASE WHEN length(text) % 2 = 0 THEN 'attribution' ELSE 'assertion' END || ':' || {_STATUS}, ',' ORDER BY turn) AS outcomes FROM conversations GROUP BY ALL HAVING count(*) > 1""")
def pair_matrix(spark, d):
    return G.pair_matrix(_turns(spark, d), "conv_id", "g", "turn", "type", "status")


def _evidence(spark, d) -> DataFrame:
    l = table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    s = F.col("l_returnflag")
    return l.select(
        F.col("l_orderkey").alias("claim_id"), F.row_number().over(w).alias("pos"), F.lit("large orders were shipped late").alias("claim"),
        F.when(F.col("l_orderkey") % 2 == 0, "assertion").otherwise("attribution").alias("claim_type"), F.when(s == "R", "refutes").when(s == "A", "supports").otherwise("partially-refutes").alias("stance"),
        F.when(F.col("l_suppkey") % 4 == 0, "PRIMARY").when(F.col("l_suppkey") % 4 == 1, "RELIABLE").when(F.col("l_suppkey") % 4 == 2, "UNRATED").otherwise("UNRELIABLE").alias("rel"),
        (F.col("l_quantity") * 2).alias("ng"), F.concat(F.lit("site"), (F.col("l_suppkey") % 9).cast("string"), F.lit(".org")).alias("domain"), F.lit("orders shipped").alias("text"),
        (F.col("l_partkey") % 5 == 0).alias("opinion"), (F.col("l_partkey") % 7 == 0).alias("republication"), (F.col("l_partkey") % 4 == 0).alias("snippet_only"), F.lit("src").alias("src"), F.lit("2020-01-01").alias("date"),
    )


@query("""
    WITH e AS (SELECT l_orderkey AS claim_id, CASE l_returnflag WHEN 'R' THEN 'refutes' WHEN 'A' THEN 'supports' ELSE 'partially-refutes' END AS stance, l_suppkey % 4 AS rel, l_quantity * 2 AS ng, l_suppkey % 9 AS dom, l_partkey % 4 = 0 AS snip FROM lineitem
      WHERE l_partkey % 7 <> 0 AND (l_partkey % 5 <> 0 OR l_orderkey % 2 <> 0)),
    q AS (SELECT * FROM e WHERE (snip AND (rel = 0 OR (rel = 1 AND ng >= 90))) OR (NOT snip AND stance <> 'supports')),
    g AS (SELECT claim_id, coalesce(bool_or(NOT snip AND stance = 'refutes'), false) AS anchor, bool_or(NOT snip AND rel = 1 AND ng >= 90) AS strong, count(DISTINCT dom) FILTER (NOT snip AND rel < 2) AS nf,
      len(list_filter(list(DISTINCT dom) FILTER (snip), lambda x: NOT coalesce(list_contains(list(DISTINCT dom) FILTER (NOT snip AND rel < 2), x), false))) AS ns FROM q GROUP BY 1)
    SELECT claim_id, anchor AND (strong OR (nf > 0 AND nf + coalesce(ns, 0) >= 2)) AS met, CASE WHEN NOT anchor THEN 'no-anchor' WHEN strong THEN 'strong-source' WHEN nf > 0 AND nf + coalesce(ns, 0) >= 2 THEN 'two-voices' WHEN nf > 0 THEN 'single-voice' ELSE 'snippets-only' END AS reason FROM g""")
def ledger_bar(spark, d):
    return G.bar(G.qualifying(_evidence(spark, d), "refuted"), "refuted")


@query()
def evidence_diet(spark, d):
    return G.evidence_diet(_evidence(spark, d), "claim_id", "pos", 4).select("claim_id", "pos")


@query()
def dossiers(spark, d):
    return G.dossier(_evidence(spark, d), "claim_id", "pos")


@query("""
    WITH e AS (SELECT l_orderkey AS c, l_suppkey AS u, min(CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%d') END) AS dt, bool_or(l_suppkey % 10 = 0) AS f FROM lineitem GROUP BY ALL)
    SELECT count(*) AS docs, count(*) FILTER (dt > '1998-06-01') AS after, count(*) FILTER (dt IS NULL) AS undated, count(*) FILTER (f) AS fact_check FROM e""")
def leak_shares(spark, d):
    date = F.when(F.col("l_partkey") % 6 != 0, D.iso(F.col("l_shipdate")))
    return G.leak_shares(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", date, F.lit("1998-06-01"), F.col("l_suppkey") % 10 == 0)
