"""Selection rules of the sourcing step, votes and small reports: plain column algebra, so that all of it fuses into the scan it stands on.

Null handling, unless a function says otherwise: a null flag is false, a null text is empty, a null key joins nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Results depend on them.
SOFT_TOPICS = ("lifestyle", "entertainment", "sports")
FEED_FRAMES = ("feed", "search_june")
VARIANTS = {
    "A": (("Supported",), ()),
    "B": (("Supported", "Conflicting Evidence/Cherrypicking"), ()),
    "C": (("Supported",), ("Conflicting Evidence/Cherrypicking",)),
}
ATTRIBUTION_TYPES = ("quote_attribution",)
INNER_STATE = r"(?i)\b(believed?|believes|felt|feels|feared?|fears|hoped?|hopes|thought|thinks|wanted?|wants|dreamed|loves?|loved)\b"
GENERIC_PERSON = r"(?i)\b(a|an|the)\s+(\d+[- ]year[- ]old\s+)?(boy|girl|man|woman|child|kid|mother|father|mom|dad|teen\w*|student|couple|family)\b"
COLLECTIVE_NOUNS = "(vets?|veterans|volunteers|residents|fans|supporters|users|workers|soldiers|locals|critics|activists|analysts|experts|witnesses|protesters|insiders|people)"
COLLECTIVE = rf"\b{COLLECTIVE_NOUNS}\b[^.]{{0,30}}?\b(say|says|said|claims?|claimed|told|tell|allege[sd]?)\b"
COLLECTIVE_REVERSED = rf"\baccording to\b[^.]{{0,30}}?\b{COLLECTIVE_NOUNS}\b"
NAMED_SPEAKER = r"\b[A-Z][\w.'-]+\s+(?:said|says|claim(?:s|ed)?|told|wrote|writes|argu(?:es|ed)|stated|announc(?:es|ed)|deni(?:es|ed)|confirm(?:s|ed)|warn(?:s|ed)|urg(?:es|ed)|accus(?:es|ed)|testif(?:ies|ied)|report(?:s|ed))\b"


def _yes(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def checkworthy(topic, trivial, unresolved, falsifiable, on_trivial: bool = False, topics: tuple[str, ...] | None = None) -> Column:
    """Falsifiable and not unresolved; where these are asked for, also not trivial and of one of the topics."""
    out = F.coalesce(F.col(falsifiable), F.lit(True)) & ~_yes(unresolved)
    if on_trivial:
        out = out & ~_yes(trivial)
    return out if topics is None else out & F.coalesce(F.col(topic).isin(*topics), F.lit(False))


def verify_eligible(gate: Column, topic) -> Column:
    """Soft topics keep their flag and are not verified."""
    return gate & ~F.coalesce(F.col(topic).isin(*SOFT_TOPICS), F.lit(False))


def assertion_slice(claims: DataFrame) -> DataFrame:
    return claims.filter((F.col("type") == "assertion") & _yes("checkworthy") & ~_yes("paired"))


def frame_of(operation, account, feeds: tuple[str, ...]) -> Column:
    """feed: an operation of a feed with an account; search_june: no account; else null."""
    has = F.col(account).isNotNull() & (F.col(account) != "")
    return F.when(has & F.col(operation).isin(*feeds), "feed").when(F.col(account).isNull(), "search_june")


def voice_of(quoted_text, handle, outlets: list[str]) -> Column:
    """One voice a post: quote before outlet before user."""
    return F.when(F.coalesce(F.col(quoted_text), F.lit("")) != "", "quote").when(F.coalesce(F.col(handle).isin(outlets), F.lit(False)), "outlet").otherwise("user")


def fit_eligible(*tags: str) -> Column:
    """Checkworthy (the first tag) with none of the other tags."""
    out = _yes(tags[0])
    for t in tags[1:]:
        out = out & ~_yes(t)
    return out


def leak_kept(status, echo) -> Column:
    return (F.coalesce(F.col(status), F.lit("")) == "prepped") & (F.coalesce(F.col(echo), F.lit("")) != "yes")


def post_manifest(posts: DataFrame, claims: DataFrame, post: str) -> DataFrame:
    """A row a post, with or without claims: n_claims, n_checkworthy, n_verify_eligible, n_removed and status.

    claims: post, removed_reason, checkworthy, eligible.
    """
    kept = F.col("removed_reason").isNull()
    n = claims.groupBy(post).agg(F.count_if(kept).alias("n_claims"), F.count_if(kept & _yes("checkworthy")).alias("n_checkworthy"), F.count_if(kept & _yes("eligible")).alias("n_verify_eligible"), F.count_if(~kept).alias("n_removed"))
    out = posts.join(n, post, "left").fillna(0, ["n_claims", "n_checkworthy", "n_verify_eligible", "n_removed"])
    return out.withColumn("status", F.when(F.col("n_verify_eligible") > 0, "verify").when(F.col("n_claims") > 0, "skip_none_checkworthy").otherwise("skip_no_claims"))


def binary_variants(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """(variant, n, n_gold_flag, n_gold_pass, accuracy, recall, fpr) of the three ways to make two classes of four; C drops rows."""
    variants = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), (~F.col(gold).isin(*ok)).alias("g"), (~F.col(pred).isin(*ok)).alias("p"), (~F.col(gold).isin(*drop) if drop else F.lit(True)).alias("keep")) for v, (ok, drop) in VARIANTS.items()))).alias("x")
    x = rows.select(variants).select("x.variant", F.col("x.g").alias("g"), F.col("x.p").alias("p"), F.col("x.keep").alias("keep")).filter("keep")
    c = x.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count_if("g").alias("n_gold_flag"), F.count_if(~F.col("g")).alias("n_gold_pass"), F.count_if(F.col("g") == F.col("p")).alias("r"), F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(~F.col("g") & F.col("p")).alias("fp"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return c.select("variant", "n", "n_gold_flag", "n_gold_pass", share("r", "n").alias("accuracy"), share("tp", "n_gold_flag").alias("recall"), share("fp", "n_gold_pass").alias("fpr"))


def derived_flags(rows: DataFrame) -> DataFrame:
    """nee and contested of a rating's subtype and veracity; false where these are null."""
    return rows.withColumn("nee", F.coalesce(F.col("subtype") == "unprovable", F.lit(False))).withColumn("contested", F.coalesce((F.col("veracity") == 3) & (F.col("subtype") == "mixed"), F.lit(False)))


def checkbox_marks(notes: DataFrame, flags: list[str], alone: dict[str, str], context: str, error: str, unverified: str, date: str, snapshot, days: int = 30) -> DataFrame:
    """notes with n_flags, each name of alone (its flag is the only one), mixed_signal and too_young; boxes that are no number count as not ticked."""
    box = lambda c: F.coalesce(F.col(c).cast("string").try_cast("int"), F.lit(0))
    total = sum((box(c) for c in flags[1:]), box(flags[0]))
    out = notes.withColumn("n_flags", total)
    for name, c in alone.items():
        out = out.withColumn(name, (box(c) == 1) & (F.col("n_flags") == 1))
    out = out.withColumn("mixed_signal", (box(context) == 1) & (box(error) == 0) & (box(unverified) == 0))
    return out.withColumn("too_young", F.coalesce(F.col(date) > F.date_sub(F.lit(snapshot).cast("date"), days), F.lit(False)))


def covered(gold: DataFrame, scores: DataFrame, key: str, score: str) -> DataFrame:
    """gold with the score of its key and `covered`; repeated gold rows all inherit it, of repeated scores the greatest counts."""
    one = scores.groupBy(key).agg(F.max(score).alias(score))
    return gold.join(one, key, "left").withColumn("covered", F.col(score).isNotNull())


def edits_and_warnings(edits: DataFrame, locked: DataFrame, url: str) -> tuple[DataFrame, DataFrame]:
    """Edits of locked posts with the posts' columns, and the edits whose post is not locked."""
    return edits.join(locked, url), edits.join(locked.select(url).distinct(), url, "left_anti")


def voted(votes: DataFrame, item: str, yes: Column, judges: int = 3) -> DataFrame:
    """(item, k, majority, unanimous): votes for out of `judges` judges; a judge without a row has not voted for."""
    return votes.groupBy(item).agg(F.count_if(yes).alias("k")).select(item, "k", (F.col("k") * 2 > judges).alias("majority"), (F.col("k") == judges).alias("unanimous"))


def claim_mode(type_) -> Column:
    """attribution or assertion; unknown and null types are assertions."""
    return F.when(F.trim(F.coalesce(F.col(type_), F.lit(""))).isin(*ATTRIBUTION_TYPES), "attribution").otherwise("assertion")


def private_inner_state(text) -> Column:
    c = F.coalesce(F.col(text), F.lit(""))
    return c.rlike(INNER_STATE) & c.rlike(GENERIC_PERSON)


def anonymous_collective(text, type_) -> Column:
    """An attribution to a collective nobody could ask; a named speaker clears it, unless the name is only the collective at the start of a sentence."""
    c = F.coalesce(F.col(text), F.lit(""))
    name = F.regexp_extract(c, NAMED_SPEAKER, 0)
    forward = c.rlike(f"(?i){COLLECTIVE}") & ((name == "") | name.rlike(f"^(?i){COLLECTIVE}"))
    return (F.coalesce(F.col(type_), F.lit("")) == "attribution") & ((c.rlike(f"(?i){COLLECTIVE_REVERSED}") & (name == "")) | forward)


def score_bins(rows: DataFrame, score: str, verdict: str, edges: list[float], means: dict[str, Column]) -> DataFrame:
    """(low, n, false, unclear, true shares, means) of scores strictly between neighbouring edges; the last bin is open. One pass, no join."""
    low = F.lit(None).cast("double")
    for k, a in enumerate(edges):
        inside = F.col(score) > a
        if k + 1 < len(edges):
            inside = inside & (F.col(score) < edges[k + 1])
        low = F.when(inside, float(a)).otherwise(low)
    n = F.count(F.lit(1))
    shares = [(F.count_if(F.col(verdict) == v) / n).alias(f"share_{v}") for v in ("false", "unclear", "true")]
    return rows.withColumn("low", low).filter("low IS NOT NULL").groupBy("low").agg(n.alias("n"), *shares, *(F.avg(c).alias(name) for name, c in means.items()))


def loop_anatomy(runs: DataFrame, gold: str, means: list[str]) -> DataFrame:
    """(status, gold_false, gold_true, bar_refusal, no_evidence, other, share_escalated, mean_...) of verified claims.

    runs: status, stopped, guards array<string>, n_evidence.  The three reasons are of unsupported claims.
    """
    un = F.col("status") == "unsupported"
    bar = F.array_contains("guards", "close-below-bar")
    return runs.groupBy("status").agg(
        F.count_if(gold).alias("gold_false"), F.count_if(~F.col(gold)).alias("gold_true"), F.count_if(un & bar).alias("bar_refusal"), F.count_if(un & ~bar & (F.col("n_evidence") == 0)).alias("no_evidence"),
        F.count_if(un & ~bar & (F.col("n_evidence") > 0)).alias("other"), (F.count_if(F.col("stopped") == "exa-final") / F.count(F.lit(1))).alias("share_escalated"), *(F.avg(m).alias(f"mean_{m}") for m in means),
    )


def wire_filtered_counts(docs: DataFrame, claim: str, flag: str, flags: list[str], pad: int = 10, silent: str = "I") -> DataFrame:
    """(claim, flag, n) without origin copies and syndicated pages; slots that are freed are silent, up to `pad`.

    docs: claim, flag, origin_copy, syndicated_of.  A claim whose pages all go is silent throughout.
    """
    kept = ~_yes("origin_copy") & F.col("syndicated_of").isNull() & F.coalesce(F.col(flag).isin(*flags), F.lit(False))
    n = docs.groupBy(claim).agg(*(F.count_if(kept & (F.col(flag) == f)).alias(f"n_{f}") for f in flags))
    total = sum((F.col(f"n_{f}") for f in flags[1:]), F.col(f"n_{flags[0]}"))
    n = n.withColumn(f"n_{silent}", F.col(f"n_{silent}") + F.greatest(F.lit(0), F.lit(pad) - total))
    return n.select(claim, F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f"n_{f}").alias("n")) for f in flags))).alias("x")).select(claim, "x.flag", "x.n")


def floored(direction, claim_date, doc_date, days: int = 7) -> Column:
    """A refuting flag of a page older than `days` before the claim is silenced to X."""
    old = F.datediff(F.col(claim_date), F.col(doc_date)) > days
    return F.when(F.col(direction).isin("1", "2") & F.coalesce(old, F.lit(False)), "X").otherwise(F.col(direction))


def post_ceiling_counts(hits: DataFrame, claim: str, date: str, ceiling: str) -> DataFrame:
    """(claim, post, undated) of a claim's hits: dated strictly after the ceiling, without a date."""
    return hits.groupBy(claim).agg(F.count_if(F.col(date) > F.col(ceiling)).alias("post"), F.count_if(F.col(date).isNull()).alias("undated"))


def run_totals(calls: DataFrame, source: str, cost: str, tokens: list[str]) -> DataFrame:
    return calls.groupBy(source).agg(F.count(F.lit(1)).alias("calls"), F.sum(cost).alias("cost"), *(F.sum(t).alias(t) for t in tokens))


def cost_bands(claims: Column, per_claim: Column, search_s: Column, read_s: Column, workers: Column) -> list[Column]:
    """cost low, mid, high, and wall seconds low, mid, high with what bounds them: searches one by one, or reads by many workers."""
    cost, serial, parallel = claims * per_claim, claims * search_s, claims * read_s / workers
    wall = F.greatest(serial, parallel)
    return [
        (cost * 0.80).alias("cost_low"), cost.alias("cost_mid"), (cost * 1.25).alias("cost_high"), (wall * 0.90).alias("wall_low"), wall.alias("wall_mid"), (wall * 1.60).alias("wall_high"),
        F.when(serial >= parallel, "search").otherwise("read").alias("bottleneck"),
    ]


def pinned(drawn: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """The pinned sample after a draw: the draw where it has grown, else what was kept."""
    a, b = (x.agg(F.count(F.lit(1)).alias("n")) for x in (drawn, kept))
    grown = a.select(F.col("n").alias("n_drawn")).crossJoin(b.select(F.col("n").alias("n_kept")))  # two rows of one number
    marked = drawn.select(key, F.lit(True).alias("new")).unionByName(kept.select(key, F.lit(False).alias("new"))).crossJoin(F.broadcast(grown))
    return marked.filter(F.col("new") == (F.col("n_drawn") > F.col("n_kept"))).select(key)


def stratum_report(scores: DataFrame, stratum: str, least: int = 20) -> DataFrame:
    """(stratum, n, n_true, auc) of strata with at least `least` rows and both classes; scores: stratum, score, y.

    Ranks run over distinct scores of a stratum, which are counted first.
    """
    from pyspark.sql import Window

    by = scores.groupBy(stratum, "score").agg(F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") == 0).alias("f"))
    below = F.coalesce(F.sum("f").over(Window.partitionBy(stratum).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = by.withColumn("won", F.col("t") * (below + F.col("f") / 2)).groupBy(stratum).agg(F.sum("t").alias("n_true"), F.sum("f").alias("n_false"), F.sum("won").alias("won"))
    ok = c.filter((F.col("n_true") + F.col("n_false") >= least) & (F.col("n_true") > 0) & (F.col("n_false") > 0))
    return ok.select(stratum, (F.col("n_true") + F.col("n_false")).alias("n"), "n_true", (F.col("won") / F.col("n_true") / F.col("n_false")).alias("auc"))


def log_ratio_se(true: Column, false: Column) -> Column:
    """Standard error of a smoothed log-likelihood ratio by the delta method."""
    return F.sqrt(1 / (true + 1) + 1 / (false + 1))


def scorecard(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n, broken): declared invariants, all counted in one aggregation over one scan; an unknown outcome counts as broken."""
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(~_yes(rule)).alias(f"b{k}") for k, rule in enumerate(rules.values())))
    return counts.select("n", F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"b{k}").alias("broken")) for k, name in enumerate(rules)))).alias("x")).select("x.rule", "n", "x.broken")


def observed(rows: DataFrame, rules: dict[str, Column], observation) -> DataFrame:
    """rows as they are, with the scorecard's counts observed while a job runs over them."""
    return rows.observe(observation, F.count(F.lit(1)).alias("n"), *(F.count_if(~_yes(rule)).alias(name) for name, rule in rules.items()))


def regression(rows: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(term, estimate, se, t) of least squares with an intercept.

    One aggregation makes the Gram matrix of (1, xs, y), whose size is that of the columns; the normal equations, scaled to unit diagonal, are
    then solved on the driver by QR.  Rows with a null are left out; fewer rows than terms give no rows.
    """
    import numpy as np

    whole = rows.select(F.lit(1.0).alias("one"), *(F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate([*xs, y]))).dropna()
    names = ["one", *(f"v{k}" for k in range(len(xs) + 1))]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = whole.agg(*(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in pairs)).first()
    schema = "term string, estimate double, se double, t double"
    gram = np.zeros((len(names),) * 2)
    for i, j in pairs:
        gram[i, j] = gram[j, i] = got[f"g{i}_{j}"] or 0.0
    n, k = gram[0, 0], len(xs) + 1
    if n < k:
        return rows.sparkSession.createDataFrame([], schema)
    a, b = gram[:k, :k], gram[:k, k]
    scale = 1 / np.sqrt(np.diag(a))
    q, r = np.linalg.qr(a * np.outer(scale, scale))
    beta = np.linalg.solve(r, q.T @ (b * scale)) * scale
    spare = gram[k, k] - beta @ b
    inverse = np.linalg.solve(r, q.T) * np.outer(scale, scale)
    se = np.sqrt(np.maximum(spare, 0) / max(n - k, 1) * np.diag(inverse))
    return rows.sparkSession.createDataFrame([(t, float(e), float(s), float(e / s) if s else None) for t, e, s in zip(["intercept", *xs], beta, se)], schema)


def merge_path(true: list[int], false: list[int], parents: list | None = None) -> list[tuple[int, int, float]]:
    """(kept, gone, loss) of each merge of the least G2, down to two buckets: counts of a few cells, which Spark has made.

    Pairs lie on a heap; after a merge only the pairs of the merged bucket are made anew.  With parents only cells of one parent merge.
    """
    import heapq
    import math

    def part(x: float) -> float:
        return x * math.log(x)

    def loss(a, b):
        (t, f), (u, g) = ((x + 0.5, y + 0.5) for x, y in (a, b))
        return 2 * (part(t) + part(f) + part(u) + part(g) + part(t + f + u + g) - part(t + f) - part(u + g) - part(t + u) - part(f + g))

    cells = {k: (t, f) for k, (t, f) in enumerate(zip(true, false))}
    home = dict(enumerate(parents)) if parents else dict.fromkeys(cells, 0)
    mark = dict.fromkeys(cells, 0)
    heap = [(loss(cells[i], cells[j]), i, j, 0, 0) for i in cells for j in cells if i < j and home[i] == home[j]]
    heapq.heapify(heap)
    out = []
    while len(cells) > 2 and heap:
        g, i, j, mi, mj = heapq.heappop(heap)
        if i not in cells or j not in cells or mark[i] != mi or mark[j] != mj:
            continue
        out.append((i, j, g))
        cells[i] = (cells[i][0] + cells[j][0], cells[i][1] + cells[j][1])
        del cells[j]
        mark[i] += 1
        for k in cells:
            if k != i and home[k] == home[i]:
                a, b = sorted((i, k))
                heapq.heappush(heap, (loss(cells[a], cells[b]), a, b, mark[a], mark[b]))
    return out
