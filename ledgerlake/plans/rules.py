"""Queries over selection rules, votes, reports of runs and small models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.registered import register
from ..operators import rules as R
from .registry import query, table

# -- posts and claims: conversations are posts, their turns claims ------------------------------------

_CLAIMS = """c AS (SELECT conv_id AS post_id, turn, text, ['politics', 'sports', 'health', 'lifestyle'][length(text) % 4 + 1] AS topic, length(text) % 5 = 0 AS trivial, length(text) % 7 = 0 AS unresolved,
      CASE WHEN length(text) % 11 = 0 THEN NULL ELSE length(text) % 3 > 0 END AS falsifiable, CASE WHEN role = 'user' THEN 'assertion' ELSE 'attribution' END AS type, length(text) % 2 = 0 AS paired,
      CASE WHEN length(text) % 13 = 0 THEN 'duplicate' END AS removed_reason FROM conversations)"""


def _claims(spark, d):
    n = F.length("text")
    topic = F.element_at(F.array(*map(F.lit, ("politics", "sports", "health", "lifestyle"))), n % 4 + 1)
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("post_id"), "turn", "text", topic.alias("topic"), (n % 5 == 0).alias("trivial"), (n % 7 == 0).alias("unresolved"), F.when(n % 11 != 0, n % 3 > 0).alias("falsifiable"),
        F.when(F.col("role") == "user", "assertion").otherwise("attribution").alias("type"), (n % 2 == 0).alias("paired"), F.when(n % 13 == 0, "duplicate").alias("removed_reason"),
    )


@query(f"""
    WITH {_CLAIMS}, g AS (SELECT *, coalesce(falsifiable, true) AND NOT unresolved AND NOT trivial AS gate FROM c)
    SELECT post_id, turn, gate, gate AND topic IN ('politics', 'health') AS gate_topics, gate AND topic NOT IN ('lifestyle', 'entertainment', 'sports') AS eligible FROM g""")
def checkworthy_gate(spark, d):
    gate = R.checkworthy("topic", "trivial", "unresolved", "falsifiable", on_trivial=True)
    topics = R.checkworthy("topic", "trivial", "unresolved", "falsifiable", on_trivial=True, topics=("politics", "health"))
    return _claims(spark, d).select("post_id", "turn", gate.alias("gate"), topics.alias("gate_topics"), R.verify_eligible(gate, "topic").alias("eligible"))


@query(f"WITH {_CLAIMS} SELECT post_id, turn FROM c WHERE type = 'assertion' AND coalesce(falsifiable, false) AND NOT paired")
def assertion_slice(spark, d):
    return R.assertion_slice(_claims(spark, d).withColumn("checkworthy", F.col("falsifiable"))).select("post_id", "turn")


@query(f"""
    WITH {_CLAIMS}, n AS (SELECT post_id, count(*) FILTER (removed_reason IS NULL) AS n_claims, count(*) FILTER (removed_reason IS NULL AND falsifiable) AS n_checkworthy,
      count(*) FILTER (removed_reason IS NULL AND falsifiable AND topic NOT IN ('sports', 'lifestyle', 'entertainment')) AS n_verify_eligible, count(removed_reason) AS n_removed FROM c WHERE turn > 0 GROUP BY 1),
    p AS (SELECT DISTINCT post_id FROM c), m AS (SELECT p.post_id, coalesce(n_claims, 0) AS n_claims, coalesce(n_checkworthy, 0) AS n_checkworthy, coalesce(n_verify_eligible, 0) AS n_verify_eligible, coalesce(n_removed, 0) AS n_removed FROM p LEFT JOIN n USING (post_id))
    SELECT *, CASE WHEN n_verify_eligible > 0 THEN 'verify' WHEN n_claims > 0 THEN 'skip_none_checkworthy' ELSE 'skip_no_claims' END AS status FROM m""")
def post_status(spark, d):
    """Every post has a row; first turns are the posts' own texts and no claims."""
    c = _claims(spark, d)
    claims = c.filter("turn > 0").select("post_id", "removed_reason", F.col("falsifiable").alias("checkworthy"), R.verify_eligible(F.col("falsifiable"), "topic").alias("eligible"))
    return R.post_manifest(c.select("post_id").distinct(), claims, "post_id")


@query(f"""
    WITH {_CLAIMS} SELECT post_id, turn, regexp_matches(text, '{R.INNER_STATE}') AND regexp_matches(text, '{R.GENERIC_PERSON}') AS inner_state,
      type = 'attribution' AND ((regexp_matches(text, '(?i){R.COLLECTIVE_REVERSED}') AND NOT regexp_matches(text, '{R.NAMED_SPEAKER.replace("'", "''")}')) OR (regexp_matches(text, '(?i){R.COLLECTIVE}')
        AND (NOT regexp_matches(text, '{R.NAMED_SPEAKER.replace("'", "''")}') OR regexp_matches(regexp_extract(text, '{R.NAMED_SPEAKER.replace("'", "''")}'), '^(?i){R.COLLECTIVE}')))) AS collective FROM c""")
def unaskable_claims(spark, d):
    return _claims(spark, d).select("post_id", "turn", R.private_inner_state("text").alias("inner_state"), R.anonymous_collective("text", "type").alias("collective"))


@query("""
    SELECT event_id, CASE WHEN k > 20 AND event_type IN ('view', 'click') THEN 'feed' WHEN k <= 20 THEN 'search_june' END AS frame FROM (SELECT event_id, event_type, cast(json_extract(props, '$.k') AS INT) AS k FROM events)""")
def feed_frames(spark, d):
    e = table(spark, d, "events").withColumn("account", F.when(F.get_json_object("props", "$.k").cast("int") > 20, F.col("user_id").cast("string")))
    return e.select("event_id", R.frame_of("event_type", "account", ("view", "click")).alias("frame"))


@query("SELECT page_id, CASE WHEN html LIKE '%blockquote%' THEN 'quote' WHEN split_part(split_part(url, '//', 2), '/', 1) IN (SELECT split_part(split_part(url, '//', 2), '/', 1) FROM pages GROUP BY 1 HAVING count(*) > 20) THEN 'outlet' ELSE 'user' END AS voice FROM pages")
def voice_route(spark, d):
    """Hosts of more than 20 pages stand for the curated outlets, a list of bounded length."""
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    p = table(spark, d, "pages").select("page_id", host.alias("host"), F.when(F.col("html").contains("blockquote"), "x").alias("quoted"))
    outlets = p.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter("n > 20").select("host", F.lit(True).alias("is_outlet"))
    marked = p.join(outlets, "host", "left")
    return marked.withColumn("handle", F.when(F.col("is_outlet"), "outlet")).select("page_id", R.voice_of("quoted", "handle", ["outlet"]).alias("voice"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey % 2 = 0 AND l_partkey % 3 <> 0 AND l_suppkey % 5 <> 0 AND l_suppkey % 7 <> 0 AND l_linenumber % 4 <> 0")
def fit_eligibility(spark, d):
    tags = {"checkworthy": F.col("l_partkey") % 2 == 0, "attribution": F.col("l_partkey") % 3 == 0, "media": F.col("l_suppkey") % 5 == 0, "dup": F.col("l_suppkey") % 7 == 0, "leak": F.col("l_linenumber") % 4 == 0}
    return table(spark, d, "lineitem").withColumns(tags).filter(R.fit_eligible(*tags)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus = 'F' AND l_returnflag <> 'R') AS kept FROM lineitem GROUP BY 1")
def leak_controlled(spark, d):
    l = table(spark, d, "lineitem").withColumn("read_status", F.when(F.col("l_linestatus") == "F", "prepped")).withColumn("echo", F.when(F.col("l_returnflag") == "R", "yes"))
    return l.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(R.leak_kept("read_status", "echo")).alias("kept"))


_FOUR = "['Supported', 'Refuted', 'Not Enough Evidence', 'Conflicting Evidence/Cherrypicking']"


@query(f"""
    WITH o AS (SELECT {_FOUR}[o_orderkey % 4 + 1] AS gold, {_FOUR}[o_custkey % 4 + 1] AS pred FROM orders),
    x AS (SELECT v, gold, pred, gold <> 'Supported' AND NOT (v = 'B' AND gold LIKE 'Conf%') AS g, pred <> 'Supported' AND NOT (v = 'B' AND pred LIKE 'Conf%') AS p FROM o, (VALUES ('A'), ('B'), ('C')) t(v) WHERE NOT (v = 'C' AND gold LIKE 'Conf%'))
    SELECT v AS variant, count(*) AS n, count(*) FILTER (g) AS n_gold_flag, count(*) FILTER (NOT g) AS n_gold_pass, round(avg(CASE WHEN g = p THEN 1.0 ELSE 0 END), 9) AS accuracy, round(count(*) FILTER (g AND p) / count(*) FILTER (g), 9) AS recall, round(count(*) FILTER (NOT g AND p) / count(*) FILTER (NOT g), 9) AS fpr FROM x GROUP BY v""")
def binary_variants(spark, d):
    classes = F.array(*map(F.lit, ("Supported", "Refuted", "Not Enough Evidence", "Conflicting Evidence/Cherrypicking")))
    o = table(spark, d, "orders").select(F.element_at(classes, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("gold"), F.element_at(classes, (F.col("o_custkey") % 4 + 1).cast("int")).alias("pred"))
    return R.binary_variants(o, "gold", "pred").withColumns({c: F.round(c, 9) for c in ("accuracy", "recall", "fpr")})


@query("""
    SELECT o_orderkey, coalesce(subtype = 'unprovable', false) AS nee, coalesce(v = 3 AND subtype = 'mixed', false) AS contested
    FROM (SELECT o_orderkey, cast(left(o_orderpriority, 1) AS INT) AS v, CASE o_custkey % 4 WHEN 0 THEN 'unprovable' WHEN 1 THEN 'mixed' WHEN 2 THEN 'false' END AS subtype FROM orders)""")
def derived_booleans(spark, d):
    k = F.col("o_custkey") % 4
    o = table(spark, d, "orders").withColumn("veracity", F.substring("o_orderpriority", 1, 1).cast("int")).withColumn("subtype", F.when(k == 0, "unprovable").when(k == 1, "mixed").when(k == 2, "false"))
    return R.derived_flags(o).select("o_orderkey", "nee", "contested")


_BOXES = {"media": 2, "satire": 3, "context": 4, "error": 5, "unverified": 6}


@query("""
    WITH b AS (SELECT *, """ + ", ".join(f"CASE WHEN o_custkey % {n} = 0 THEN 1 ELSE 0 END AS b_{k}" for k, n in _BOXES.items()) + """ FROM orders), t AS (SELECT *, b_media + b_satire + b_context + b_error + b_unverified AS n_flags FROM b)
    SELECT o_orderkey, n_flags, b_media = 1 AND n_flags = 1 AS media_only, b_satire = 1 AND n_flags = 1 AS satire_only, b_context = 1 AND b_error = 0 AND b_unverified = 0 AS mixed_signal, cast(o_orderdate AS DATE) > DATE '1998-08-02' - INTERVAL 30 DAY AS too_young FROM t""")
def checkbox_marks(spark, d):
    boxes = {f"b_{k}": F.when(F.col("o_custkey") % n == 0, "1").otherwise(F.when(F.col("o_custkey") % 2 == 1, "x")) for k, n in _BOXES.items()}
    o = table(spark, d, "orders").withColumns(boxes).withColumn("day", F.to_date("o_orderdate"))
    out = R.checkbox_marks(o, list(boxes), {"media_only": "b_media", "satire_only": "b_satire"}, "b_context", "b_error", "b_unverified", "day", "1998-08-02")
    return out.select("o_orderkey", "n_flags", "media_only", "satire_only", "mixed_signal", "too_young")


@query("SELECT o_orderkey, s.score, s.score IS NOT NULL AS covered FROM orders LEFT JOIN (SELECT c_custkey, max(c_acctbal) AS score FROM customer WHERE c_acctbal > 0 GROUP BY 1) s ON c_custkey = o_custkey")
def covered_rows(spark, d):
    scores = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("score"))
    return R.covered(table(spark, d, "orders").select("o_orderkey", "o_custkey"), scores, "o_custkey", "score").select("o_orderkey", "score", "covered")


@query("""
    SELECT 'edit' AS kind, count(*) AS n, sum(p.page_id) AS pages FROM pages e JOIN (SELECT url, page_id FROM pages WHERE length(html) % 2 = 0) p ON e.url = p.url WHERE e.page_id % 3 > 0
    UNION ALL SELECT 'warning', count(*), sum(page_id) FROM pages WHERE page_id % 3 > 0 AND url NOT IN (SELECT url FROM pages WHERE length(html) % 2 = 0)""")
def edit_join(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", "html")
    locked = p.filter(F.length("html") % 2 == 0).select("url", F.col("page_id").alias("post"))
    edits, warned = R.edits_and_warnings(p.filter("page_id % 3 > 0").select("url", "page_id"), locked, "url")
    total = lambda df, kind, c: df.agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("pages")).select(F.lit(kind).alias("kind"), "n", "pages")
    return total(edits, "edit", "post").unionByName(total(warned, "warning", "page_id"))


@query("SELECT l_orderkey, count(*) FILTER (l_quantity > 25) AS k, count(*) FILTER (l_quantity > 25) >= 2 AS majority, count(*) FILTER (l_quantity > 25) = 3 AS unanimous FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1")
def judge_votes(spark, d):
    return R.voted(table(spark, d, "lineitem").filter("l_linenumber <= 3"), "l_orderkey", F.col("l_quantity") > 25)


@query("SELECT event_id, CASE WHEN event_type = 'signup' THEN 'attribution' ELSE 'assertion' END AS mode FROM events")
def claim_modes(spark, d):
    kind = F.when(F.col("event_type") == "signup", " quote_attribution ").when(F.col("event_type") == "view", "event_occurrence").when(F.col("event_type") == "click", "odd")
    return table(spark, d, "events").withColumn("kind", kind).select("event_id", R.claim_mode("kind").alias("mode"))


# -- reports ----------------------------------------------------------------------------------------

_EDGES = [-999.0, 0.0, 2000.0, 4000.0, 6000.0, 8000.0]


@query("""
    WITH b AS (SELECT *, (SELECT max(e) FROM (VALUES (-999.0), (0.0), (2000.0), (4000.0), (6000.0), (8000.0)) t(e) WHERE c_acctbal > e) AS low FROM customer), k AS (SELECT *, CASE c_custkey % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'unclear' ELSE 'true' END AS v FROM b WHERE low IS NOT NULL AND c_acctbal NOT IN (0, 2000, 4000, 6000, 8000))
    SELECT CAST(low AS DOUBLE) AS low, count(*) AS n, round(count(*) FILTER (v = 'false') / count(*), 9) AS share_false, round(count(*) FILTER (v = 'unclear') / count(*), 9) AS share_unclear, round(count(*) FILTER (v = 'true') / count(*), 9) AS share_true, round(avg(c_nationkey), 9) AS nation FROM k GROUP BY low""")
def score_bins(spark, d):
    k = F.col("c_custkey") % 3
    c = table(spark, d, "customer").withColumn("v", F.when(k == 0, "false").when(k == 1, "unclear").otherwise("true"))
    out = R.score_bins(c, "c_acctbal", "v", _EDGES, {"nation": F.col("c_nationkey")})
    return out.select("low", "n", *(F.round(x, 9).alias(x) for x in ("share_false", "share_unclear", "share_true", "nation")))


@query("""
    WITH r AS (SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'refuted' WHEN 2 THEN 'conflicting' ELSE 'unsupported' END AS status, o_orderkey % 9 = 0 AS esc, o_orderkey % 3 = 0 AS bar, o_orderkey % 5 AS ev, o_orderpriority < '3' AS gold, o_totalprice FROM orders)
    SELECT status, count(*) FILTER (gold) AS gold_false, count(*) FILTER (NOT gold) AS gold_true, count(*) FILTER (status = 'unsupported' AND bar) AS bar_refusal, count(*) FILTER (status = 'unsupported' AND NOT bar AND ev = 0) AS no_evidence,
      count(*) FILTER (status = 'unsupported' AND NOT bar AND ev > 0) AS other, round(count(*) FILTER (esc) / count(*), 9) AS share_escalated, round(avg(ev), 9) AS mean_n_evidence FROM r GROUP BY 1""")
def loop_anatomy(spark, d):
    k = F.col("o_custkey") % 4
    r = table(spark, d, "orders").select(
        F.when(k == 0, "supported").when(k == 1, "refuted").when(k == 2, "conflicting").otherwise("unsupported").alias("status"), F.when(F.col("o_orderkey") % 9 == 0, "exa-final").otherwise("resolved").alias("stopped"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("close-below-bar"), F.lit("budget-exhausted"))).otherwise(F.array(F.lit("seg-coerced"))).alias("guards"), (F.col("o_orderkey") % 5).alias("n_evidence"), (F.col("o_orderpriority") < "3").alias("gold"),
    )
    out = R.loop_anatomy(r, "gold", ["n_evidence"])
    return out.withColumns({c: F.round(c, 9) for c in ("share_escalated", "mean_n_evidence")})


@query("""
    WITH k AS (SELECT l_orderkey, ['5', '4', '3', 'X', 'I', '2', '1'][l_partkey % 7 + 1] AS flag, l_suppkey % 6 <> 0 AND l_partkey % 10 <> 0 AS kept FROM lineitem), f AS (SELECT unnest(['5', '4', '3', 'X', 'I', '2', '1']) AS flag), o AS (SELECT DISTINCT l_orderkey FROM k),
    n AS (SELECT o.l_orderkey, f.flag, (SELECT count(*) FROM k WHERE k.l_orderkey = o.l_orderkey AND k.flag = f.flag AND kept) AS n FROM o, f), t AS (SELECT l_orderkey, sum(n) AS total FROM n GROUP BY 1)
    SELECT n.l_orderkey, flag, CAST(n + CASE WHEN flag = 'I' THEN greatest(0, 10 - total) ELSE 0 END AS BIGINT) AS n FROM n JOIN t USING (l_orderkey)""")
def wire_filtered(spark, d):
    """Flags of a claim without copies; freed slots are silent."""
    flags = ["5", "4", "3", "X", "I", "2", "1"]
    flag = F.element_at(F.array(*map(F.lit, flags)), (F.col("l_partkey") % 7 + 1).cast("int"))
    docs = table(spark, d, "lineitem").select("l_orderkey", flag.alias("f"), (F.col("l_suppkey") % 6 == 0).alias("origin_copy"), F.when(F.col("l_partkey") % 10 == 0, 1).alias("syndicated_of"))
    return R.wire_filtered_counts(docs, "l_orderkey", "f", flags)


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN f IN ('1', '2') AND old THEN 'X' ELSE f END AS flag FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['1', '2', '4', 'I'][l_partkey % 4 + 1] AS f,
      coalesce(date_diff('day', CASE WHEN l_suppkey % 9 > 0 THEN cast(l_shipdate AS DATE) END, cast(o_orderdate AS DATE)) > 7, false) AS old FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""")
def selection_floor(spark, d):
    flag = F.element_at(F.array(*map(F.lit, ("1", "2", "4", "I"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    j = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("claimed")), "l_orderkey")
    j = j.withColumn("f", flag).withColumn("shown", F.when(F.col("l_suppkey") % 9 > 0, F.to_date("l_shipdate")))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.floored("f", "claimed", "shown").alias("flag"))


@query("SELECT l_orderkey, count(*) FILTER (l_suppkey % 8 > 0 AND l_shipdate > o_orderdate) AS post, count(*) FILTER (l_suppkey % 8 = 0) AS undated FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def ceiling_counts(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return R.post_ceiling_counts(j.withColumn("shown", F.when(F.col("l_suppkey") % 8 > 0, F.col("l_shipdate"))), "l_orderkey", "shown", "o_orderdate")


@query("SELECT event_type, count(*) AS calls, round(sum(value), 4) AS cost, CAST(sum(length(props)) AS BIGINT) AS tokens FROM events GROUP BY 1")
def run_totals(spark, d):
    e = table(spark, d, "events").withColumn("tokens", F.length("props"))
    return R.run_totals(e, "event_type", "value", ["tokens"]).withColumn("cost", F.round("cost", 4))


@query("""
    WITH c AS (SELECT o_custkey AS k, count(*) AS n, avg(o_totalprice) / 1e6 AS per FROM orders GROUP BY 1), w AS (SELECT *, n * per AS cost, n * 1.1 AS serial, n * 20.0 / (1 + k % 32) AS parallel FROM c)
    SELECT k, round(cost * 0.8, 10) AS cost_low, round(cost, 10) AS cost_mid, round(cost * 1.25, 10) AS cost_high, round(greatest(serial, parallel) * 0.9, 10) AS wall_low, round(greatest(serial, parallel), 10) AS wall_mid, round(greatest(serial, parallel) * 1.6, 10) AS wall_high,
      CASE WHEN serial >= parallel THEN 'search' ELSE 'read' END AS bottleneck FROM w""")
def cost_model(spark, d):
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), (F.avg("o_totalprice") / 1e6).alias("per"))
    out = c.select("k", *R.cost_bands(F.col("n"), F.col("per"), F.lit(1.1).cast("double"), F.lit(20.0).cast("double"), 1 + F.col("k") % 32))
    return out.select("k", *(F.round(x, 10).alias(x) for x in ("cost_low", "cost_mid", "cost_high", "wall_low", "wall_mid", "wall_high")), "bottleneck")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND (SELECT count(*) FROM orders WHERE o_totalprice > 150000) > (SELECT count(*) FROM orders WHERE o_totalprice > 250000) UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND (SELECT count(*) FROM orders WHERE o_totalprice > 150000) <= (SELECT count(*) FROM orders WHERE o_totalprice > 250000)")
def sample_pinning(spark, d):
    o = table(spark, d, "orders")
    return R.pinned(o.filter("o_totalprice > 150000").select("o_orderkey"), o.filter("o_totalprice > 250000").select("o_orderkey"), "o_orderkey")


@query("""
    WITH s AS (SELECT c_nationkey AS stratum, round(c_acctbal, -2) AS score, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS y FROM customer), g AS (SELECT stratum, score, sum(y) AS t, sum(1 - y) AS f FROM s GROUP BY ALL),
    w AS (SELECT stratum, t, f, t * (coalesce(sum(f) OVER (PARTITION BY stratum ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + f / 2) AS won FROM g)
    SELECT stratum, CAST(sum(t) + sum(f) AS BIGINT) AS n, CAST(sum(t) AS BIGINT) AS n_true, round(sum(won) / sum(t) / sum(f), 9) AS auc FROM w GROUP BY 1 HAVING sum(t) + sum(f) >= 20 AND sum(t) > 0 AND sum(f) > 0""")
def stratum_report(spark, d):
    s = table(spark, d, "customer").select(F.col("c_nationkey").alias("stratum"), F.round("c_acctbal", -2).alias("score"), (F.col("c_custkey") % 3 == 0).cast("int").alias("y"))
    return R.stratum_report(s, "stratum").withColumn("auc", F.round("auc", 9))


@query("SELECT p_size, round(sqrt(1 / (count(*) FILTER (p_partkey % 2 = 0) + 1) + 1 / (count(*) FILTER (p_partkey % 2 = 1) + 1)), 9) AS se FROM part GROUP BY 1")
def analytic_se(spark, d):
    n = lambda r: F.count_if(F.col("p_partkey") % 2 == r)
    return table(spark, d, "part").groupBy("p_size").agg(F.round(R.log_ratio_se(n(0), n(1)), 9).alias("se"))


def _rules():
    return {
        "discount_in_range": F.col("l_discount").between(0, 0.1),
        "whole_quantity": F.col("l_quantity") == F.floor("l_quantity"),
        "shipped_late": F.year("l_shipdate") >= 1995,
        "open_is_not_returned": ~((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")),
    }


@query("""
    SELECT 'discount_in_range' AS rule, count(*) AS n, count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.1) AS broken FROM lineitem UNION ALL SELECT 'whole_quantity', count(*), count(*) FILTER (l_quantity <> floor(l_quantity)) FROM lineitem
    UNION ALL SELECT 'shipped_late', count(*), count(*) FILTER (year(l_shipdate) < 1995) FROM lineitem UNION ALL SELECT 'open_is_not_returned', count(*), count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'R') FROM lineitem""")
def run_scorecard(spark, d):
    return R.scorecard(table(spark, d, "lineitem"), _rules())


@query("""
    WITH r AS (SELECT o_totalprice AS y, CAST(year(o_orderdate) AS DOUBLE) AS a, CAST(o_custkey AS DOUBLE) AS b FROM orders), m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, regr_sxx(y, a) AS saa, regr_sxx(y, b) AS sbb, regr_sxy(a, b) AS sab, regr_sxy(y, a) AS say, regr_sxy(y, b) AS sby FROM r),
    c AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ba, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS bb FROM m)
    SELECT 'year' AS term, round(ba, 3) AS estimate FROM c UNION ALL SELECT 'customer', round(bb, 3) FROM c""")
def regression(spark, d):
    """Least squares on two predictors; years are taken from 1995 on, which only moves the intercept."""
    r = table(spark, d, "orders").select(F.col("o_totalprice").alias("y"), (F.year("o_orderdate") - 1995).alias("year"), F.col("o_custkey").alias("customer"))
    return R.regression(r, "y", ["year", "customer"]).filter("term <> 'intercept'").select("term", F.round("estimate", 3).alias("estimate"))


@query()
def bucket_merges(spark, d):
    """Order in which sizes of parts merge, by the least loss; the counts are one aggregation."""
    c = table(spark, d, "part").groupBy("p_size").agg(F.count_if(F.col("p_partkey") % 2 == 0).alias("t"), F.count_if(F.col("p_partkey") % 2 == 1).alias("f")).orderBy("p_size").collect()  # a row a cell
    path = R.merge_path([r.t for r in c], [r.f for r in c])
    rows = [(k + 1, int(c[i].p_size), int(c[j].p_size), round(float(g), 9)) for k, (i, j, g) in enumerate(path)]
    return spark.createDataFrame(rows, "step int, kept int, gone int, loss double")


# -- functions for SQL ------------------------------------------------------------------------------

_LINES = "l AS (SELECT doc_id, i, string_split(text, chr(10))[i + 1] AS line FROM (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE length(string_split(text, chr(10))[i + 1]) >= 5)"


@query(f"WITH {_LINES} SELECT doc_id, row_number() OVER w - 1 AS line_no, length(line) AS n_chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS repeated FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)")
def line_rows(spark, d):
    """A table function in SQL over a partitioned table."""
    register(spark)
    return spark.sql("SELECT doc_id, line_no, n_chars, repeated FROM line_rows(TABLE(SELECT doc_id, text FROM {docs}), 5)", docs=table(spark, d, "documents"))


@query(f"WITH {_LINES}, n AS (SELECT doc_id, length(line) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY length(line), i) AS k, count(*) OVER (PARTITION BY doc_id) AS m FROM l) SELECT doc_id, round(avg(c), 6) AS mean FROM n WHERE m < 3 OR (k > 1 AND k < m) GROUP BY doc_id")
def trimmed_lines(spark, d):
    """An aggregate in Python over the lines of each document, in SQL."""
    return line_rows(spark, d).sparkSession.sql("SELECT doc_id, round(trimmed_mean(CAST(n_chars AS DOUBLE)), 6) AS mean FROM {lines} GROUP BY doc_id", lines=line_rows(spark, d))
