"""Quality rules: base rules on word statistics, then robust multivariate outliers per language and source.

Statistics of each document (over its whole text) are transformed to a vector that is close to normal
and steady for short texts.  For each (lang, source) the minimum-covariance-determinant estimate gives
centre and scatter: `steps` concentration steps start from two robust guesses (spread by quartiles, and the least spread), each keeps the share `support` of rows
with the smallest Mahalanobis distances and estimates again; the guess that ends with the smaller determinant stands.
A document is rejected when its squared distance is above the chi-square quantile of `certainty`, whichever way it lies from the centre; the
estimate covers all rows that pass the base rules.

A group of few rows says little by itself, so estimates are shrunk, at every size by the same rule: the same estimate is made for each language
and for all rows, and with n rows a group's centre and scatter count n^2 / (n^2 + `prior`^2) and those of its language the rest; a language's
are shrunk to those of all rows likewise, and the scatter of all rows to a wide spread of five times FLOOR.  A source with a third of
all rows stands for itself; a source of one row is held against its language.

Scale: a concentration step is one aggregation.  Squared distances are cut to bins of about 10 %, and counts, sums and
products of each (group, start, bin) are summed map-side, so a source with a third of all rows sends a few
hundred rows a task; the bins up to the wanted share are then added up, so the kept share is met to one bin.

Defined results: null text has no words and fails the base rules; null lang or source is a group of its own;
a scatter below FLOOR in a direction is raised to it, so a statistic that hardly varies rejects nobody for a trifle; very long texts are
counted whole; an empty table gives an empty result; repeated rows are each answered; other columns pass through `keep_good`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runs import free_name, settle
from ._text import U, WS, chunked, first_of, mix, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[k for k in range(33, 127) if not chr(k).isalnum()]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_punct", "n_upper", "n_echoes")
VECTOR = ("word_length", "symbols", "dup_lines", "echoes", "punctuation", "upper")
P = len(VECTOR)
#: Standard deviation below which a component counts as this wide.
FLOOR = (0.05, 0.06, 0.12, 0.10, 0.06, 0.05)
WIDE = 5.0
BINS, BIN_STEP = 160, 0.1


def document_statistics(chunk):
    """The counts of BASE and EXTRA for each document of a chunk."""
    begin, end, doc = chunk.words()
    words = np.bincount(doc, minlength=chunk.n)
    data = chunk.data
    solid = ~WS[data]
    chars = chunk.per_doc(((data & 0xC0) != 0x80) & solid)
    counts = [chunk.per_doc(t[data]) for t in (SYMBOLS, _PUNCT, _UPPER)]

    lb, le, ld = chunk.lines()
    seen = np.concatenate([[0], np.cumsum(solid)])
    with_word = seen[le] > seen[lb]
    lb, le, ld = lb[with_word], le[with_word], ld[with_word]
    lines = np.bincount(ld, minlength=chunk.n)
    order, new = first_of(ld, chunk.hashes(lb, le))
    dup = lines - np.bincount(ld[order][new], minlength=chunk.n)

    word = chunk.hashes(begin, end)
    echo = doc[1:][(word[1:] == word[:-1]) & (doc[1:] == doc[:-1])]
    h, at = windows(word, doc, 8)
    order, new = first_of(mix(h + mix(doc[at].astype(U))))
    group = np.cumsum(new) - 1
    twice = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    first = at[order][twice]
    step = np.zeros(len(begin) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + 8, -1)
    repeat = np.bincount(doc[np.cumsum(step)[:-1] > 0], minlength=chunk.n)
    return {"n_words": words, "word_chars": chars, "n_symbols": counts[0], "n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": lines, "n_punct": counts[1], "n_upper": counts[2], "n_echoes": np.bincount(echo, minlength=chunk.n)}


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table's other columns with the statistics of its texts beside them."""
    others = [c for c in docs.columns if c != text_col]
    text = free_name(docs, "whole_text")
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + [f"{c} long" for c in (*BASE, *EXTRA)])

    def run(batches):
        for rows, chunk in chunked(batches, text):
            found = document_statistics(chunk)
            kept = [rows.column(k) for k in range(len(others))]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(found[c].astype(np.int64)) for c in (*BASE, *EXTRA)], names=[*others, *BASE, *EXTRA])

    return docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`").alias(text)).mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vector():
    """Transformed statistics; the constants keep short texts near the usual values."""
    c = {k: F.col(k).cast("double") for k in (*BASE, *EXTRA)}
    share = lambda x, n, k: F.sqrt(x / (n + k))
    return F.array(
        F.log((c["word_chars"] + 100.0) / (c["n_words"] + 20.0)),
        share(c["n_symbols"], c["n_words"], 20.0),
        share(c["n_dup_lines"], c["n_lines"], 10.0),
        share(c["n_echoes"], c["n_words"], 20.0),
        share(c["n_punct"], c["n_words"], 20.0),
        share(c["n_upper"], c["word_chars"], 100.0),
    )


def chi2_quantile(p: float, k: int) -> float:
    """Quantile of the chi-square distribution (even k: closed tail sum, by bisection)."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > 1 - p else (lo, mid)
    return lo


def _distance(x, centre, inverse):
    """Squared Mahalanobis distance from arrays: x, centre (P) and inverse (P x P, row by row)."""
    z = [x[i] - centre[i] for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        total = total + z[i] * z[i] * inverse[i * P + i]
        for j in range(i):
            total = total + F.lit(2.0) * z[i] * z[j] * inverse[i * P + j]
    return total


def scatter_inverse(cov):
    """Inverse and log-determinant of a covariance whose spread is at least FLOOR in each component, and a tenth of it in any direction."""
    cov = np.array(cov, float)
    wide = np.maximum(np.diag(cov), np.square(FLOOR))
    cov = cov + np.diag(wide - np.diag(cov))
    size, axes = np.linalg.eigh(cov / np.outer(FLOOR, FLOOR))
    size = np.maximum(size, 0.01)
    return (axes / size) @ axes.T / np.outer(FLOOR, FLOOR), float(np.log(size).sum() + 2 * np.log(FLOOR).sum())


def _estimate_from_bins(pdf, support: float, scale: float):
    """Centre, covariance, inverse and log-determinant of each (group, start) from its distance bins."""
    import pandas as pd

    rows = []
    for (group, start), part in pdf.groupby(["group", "start"], sort=False):
        part = part.sort_values("bin")
        n = part["n"].to_numpy()
        upto = int(np.searchsorted(np.cumsum(n), support * n.sum() - 1e-9)) + 1
        n, s = n[:upto].sum(), np.vstack(part["s"].to_numpy()[:upto]).sum(0)
        centre = s[:P] / n
        cov = np.zeros((P, P))
        cov[np.tril_indices(P)] = s[P:] / n
        cov = cov + np.tril(cov, -1).T - np.outer(centre, centre)
        inverse, det = scatter_inverse(cov * scale)
        rows.append((group, start, centre.tolist(), inverse.ravel().tolist(), det, (cov * scale).ravel().tolist()))
    return pd.DataFrame(rows, columns=["group", "start", "centre", "inverse", "det", "cov"])


_STATE = "group string, start int, centre array<double>, inverse array<double>, det double, cov array<double>"


def fit(vectors: DataFrame, support: float = 0.75, steps: int = 3) -> DataFrame:
    """(group, n, centre, inverse, cov): the minimum-covariance-determinant estimate of each group of vectors (group, x)."""
    q = chi2_quantile(support, P)
    inside = 1 - math.exp(-q / 2) * sum((q / 2) ** i / math.factorial(i) for i in range(P // 2 + 1))
    scale = support / inside  # consistency at the normal distribution

    med = vectors.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), *[F.percentile_approx(F.col("x")[i], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(f"q{i}") for i in range(P)])
    centre = F.array(*[F.col(f"q{i}")[1] for i in range(P)])
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOOR[i])) for i in range(P)]
    narrow = F.array(*[1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(P) for j in range(P)])
    wide = F.array(*[F.lit(1.0 / FLOOR[i] ** 2) if i == j else F.lit(0.0) for i in range(P) for j in range(P)])
    med = settle(med, "mcd-quartiles")
    state = med.select("group", F.lit(0).alias("start"), centre.alias("centre"), narrow.alias("inverse"), F.lit(0.0).alias("det"))
    state = settle(state.unionByName(med.select("group", F.lit(1).alias("start"), centre.alias("centre"), wide.alias("inverse"), F.lit(0.0).alias("det"))), "mcd-start")
    x = F.col("x")
    products = [x[i] for i in range(P)] + [x[i] * x[j] for i in range(P) for j in range(i + 1)]
    for _ in range(steps):
        dist = _distance(x, F.col("centre"), F.col("inverse"))
        # bins even in the logarithm: about 10 % of a squared distance each
        bin_ = F.least(F.greatest(F.floor(F.log(dist + 1e-3) / BIN_STEP) + 70, F.lit(0)), F.lit(BINS)).cast("int")
        binned = vectors.join(state, "group").select("group", "start", bin_.alias("bin"), "x")
        sums = binned.groupBy("group", "start", "bin").agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(f"s{k}") for k, p in enumerate(products)])
        sums = sums.select("group", "start", "bin", "n", F.array(*[f"s{k}" for k in range(len(products))]).alias("s"))
        state = settle(sums.groupBy("group").applyInPandas(lambda pdf: _estimate_from_bins(pdf, support, scale), _STATE), "mcd-state")
    best = state.groupBy("group").agg(F.min_by(F.struct("centre", "inverse", "cov"), F.struct("det", "start")).alias("e"))
    return best.join(med.select("group", F.col("rows").alias("n")), "group").select("group", "n", "e.centre", "e.inverse", "e.cov")


def _part(c: str):
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))


def _mixed(n, own, other, prior: float):
    """Of two arrays, own for the share n^2 / (n^2 + prior^2) and other for the rest."""
    square = F.col(n).cast("double") * F.col(n)
    w = square / (square + F.lit(prior * prior))
    return F.zip_with(own, other, lambda x, y: w * x + (1 - w) * y)


def model_of(stats: DataFrame, support: float = 0.75, prior: float = 60.0) -> DataFrame:
    """(own, centre, inverse): the estimate that each (lang, source) is held against, fitted on all rows that pass the base rules."""
    good = stats.filter(~base_failed()).select(F.concat_ws("\x1f", _part("lang"), _part("source")).alias("own"), _part("lang").alias("own_lang"), _vector().alias("x"))
    good = settle(good, "vectors")
    levels = F.array(F.concat(F.lit("s"), "own"), F.concat(F.lit("l"), "own_lang"), F.lit("a"))
    model = settle(fit(good.select(F.explode(levels).alias("group"), "x"), support).drop("inverse"), "mcd-levels")
    level = lambda x, *more: model.filter(F.col("group").startswith(x)).select(F.substring("group", 2, 1 << 30).alias(f"{x}_key"), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "centre", "cov")], *more)
    wide = F.array(*[F.lit((WIDE * FLOOR[i]) ** 2 if i == j else 0.0) for i in range(P) for j in range(P)])
    every = level("a").select(F.col("a_centre"), _mixed("a_n", F.col("a_cov"), wide, prior).alias("a_cov"))
    langs = level("l").join(F.broadcast(every)).select("l_key", _mixed("l_n", F.col("l_centre"), F.col("a_centre"), prior).alias("l_centre"), _mixed("l_n", F.col("l_cov"), F.col("a_cov"), prior).alias("l_cov"))  # every: one row
    own = level("s", F.substring_index(F.substring("group", 2, 1 << 30), "\x1f", 1).alias("lang")).join(langs, F.col("lang") == F.col("l_key"))
    own = own.select(F.col("s_key").alias("own"), _mixed("s_n", F.col("s_centre"), F.col("l_centre"), prior).alias("centre"), _mixed("s_n", F.col("s_cov"), F.col("l_cov"), prior).alias("cov"))

    def invert(batches):
        for pdf in batches:  # a row a group
            pdf["inverse"] = [scatter_inverse(np.reshape(c, (P, P)))[0].ravel() for c in pdf["cov"]]
            yield pdf[["own", "centre", "inverse"]]

    return settle(own.mapInPandas(invert, "own string, centre array<double>, inverse array<double>"), "mcd")


def judge(stats: DataFrame, model: DataFrame, certainty: float = 0.99999) -> DataFrame:
    """The statistics with base_failed, distance (null where the base rules failed) and kept."""
    held = stats.withColumn("own", F.concat_ws("\x1f", _part("lang"), _part("source"))).join(model, "own", "left").withColumn("x", _vector()).withColumn("base_failed", base_failed())
    distance = F.when(F.col("centre").isNotNull() & ~F.col("base_failed"), _distance(F.col("x"), F.col("centre"), F.col("inverse")))
    out = held.withColumn("distance", distance).withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= chi2_quantile(certainty, P)))
    return out.select(*stats.columns, "base_failed", "distance", "kept")


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", source: str = "source", support: float = 0.75, prior: float = 60.0, certainty: float = 0.99999) -> DataFrame:
    """Per document: doc_id, the counts of BASE, base_failed, kept, distance."""
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    stats = settle(statistics(thin), "statistics")
    return judge(stats, model_of(stats, support, prior), certainty).select("doc_id", *BASE, "base_failed", "kept", "distance")


def keep_good(docs: DataFrame, text_col: str = "text", lang: str = "lang", source: str = "source", support: float = 0.75, prior: float = 60.0, certainty: float = 0.99999) -> DataFrame:
    """The documents that pass, with all their columns.  Texts are read twice, and never shuffled."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    model = model_of(settle(statistics(rows.drop("row")), "statistics"), support, prior)
    return judge(statistics(rows), model, certainty).filter("kept").select("row.*")
