"""Rating columns: raw verdicts to a five-step veracity, subtypes, axes, bands and read flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verdict patterns, tested in this order.
UNRATED = r"(?i)research in progress|what we know|viet spam|^developing|^investigating"
QUALIFIED = r"(?i)^(?:true|vrai|correct|legit|real|accurate)\b.{0,80}?\b(?:but|however|although|though|caution|consideration|caveat)\b|^accurate with"
SATIRE = r"(?i)\b(?:satire|parody)\b"
ALTERED = r"(?i)ai[ -]?gener|artificial intelligence|miscaption|\baltered\b|doctored|manipul|deepfake|g[ée]n[ée]r[ée]e par ia|fabricat|is\W*n.?t real|not real and was made"
MOSTLY_TRUE, MOSTLY_FALSE = r"(?i)\bmostly true\b|plut[oô]t vrai", r"(?i)\bmostly false\b|plut[oô]t faux"
NO_EVIDENCE = r"(?i)no (?:evidence|proof|record|reports?|sign|trace|basis|confirmation)|unproven|unsubstantiated|unsupported|unverified|unfounded|baseless|\bdisputed\b|\boutdated\b|infond"
MIXED = r"(?i)misleading|partly|partial|half[ -]?true|mixture|missing context|needs? context|out of context|close,? but|manque de contexte|exaggerat|distort|not the whole story|nuanced|trompeur|partiellement|en partie|bait\s*&\s*switch"
TRUE = r"(?i)^(?:true|vrai|correct|legit|real|accurate)\b|\bcorrect attribution"
FALSE = r"(?i)\bfalse\b|\bfaux\b|\bfake\b|scam|pants on fire|did\W*n.?t happen|made[ -]?up|no such|not genuine|hoax|incorrect attribution|misattribut|debunked|^legend$"
ATTRIBUTION = r"(?i)\battribut|misattribut|misquot|never said|did\W*n.?t say|fake quote|quote[^.]{0,24}(?:fake|fabricat|never)"
ARTIFACT = r"(?i)miscaption|\baltered\b|ai[ -]?gener|deepfake|doctored|digitally|g[ée]n[ée]r[ée]e par ia|manipul|fabricat(?:ed)?\s*(?:photo|image|video)|(?:photo|image|video|footage|clip)[^.]{0,18}(?:is(?:n.?t)? real|fake|altered)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _pair(v, s: str) -> Column:
    return F.struct(F.lit(v).cast("int").alias("veracity"), F.lit(s).alias("subtype"))


def _place(value, best, worst) -> Column:
    v, hi, lo = (_c(x).try_cast("double") for x in (value, best, worst))
    return F.when(hi != lo, (v - lo) / (hi - lo))


def numeric_label(value, best=5, worst=1) -> Column:
    """refuted, conflicting or supported by the place between worst and best; null if unparsable."""
    p = _place(value, best, worst)
    return F.when(p < 0.4, "refuted").when(p <= 0.6, "conflicting").when(p.isNotNull(), "supported")


def numeric_veracity(value, best=5, worst=1) -> Column:
    """struct(veracity, subtype) in five steps."""
    p = _place(value, best, worst)
    return F.when(p < 0.2, _pair(1, "clear_false")).when(p < 0.4, _pair(2, "mostly_false")).when(p <= 0.6, _pair(3, "mixed")).when(p < 0.8, _pair(4, "mostly_true")).when(p.isNotNull(), _pair(5, "clear_true")).otherwise(_pair(None, ""))


def refined_numeric(text, value, best=5, worst=1) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    nei = r"(?i)\bno (?:evidence|proof|record|reports?|sign|trace|basis)\b|unverified|unproven|unsubstantiated|baseless|no confirmation"
    ce = r"(?i)nuanced|close,? but|partly|partially|mixture|misleading|missing context|out of context|needs context|half[- ]?true"
    return F.when(t.rlike(nei), "not enough evidence").when(t.rlike(ce), "conflicting").otherwise(numeric_label(value, best, worst))


def veracity(rating, value=None) -> Column:
    """struct(veracity, subtype) of a raw verdict: finer tests first, then the number, else nothing."""
    t = F.trim(F.coalesce(_c(rating), F.lit("")))
    v = F.lit(None) if value is None else _c(value)
    text_only = v.isNull()
    out = F.when(t.rlike(UNRATED), _pair(None, "unrated")).when(t.rlike(QUALIFIED), _pair(None, "")).when(t.rlike(SATIRE), _pair(1, "satire")).when(t.rlike(ALTERED), _pair(1, "altered_media"))
    out = out.when(text_only & t.rlike(r"(?i)^(?:false|faux)\b"), _pair(1, "clear_false")).when(text_only & t.rlike(r"(?i)^(?:true|vrai)\b"), _pair(5, "clear_true"))
    out = out.when(t.rlike(MOSTLY_TRUE), _pair(4, "mostly_true")).when(t.rlike(MOSTLY_FALSE), _pair(2, "mostly_false")).when(t.rlike(NO_EVIDENCE), _pair(3, "unprovable")).when(t.rlike(MIXED), _pair(3, "mixed"))
    out = out.when(text_only & t.rlike(TRUE), _pair(5, "clear_true")).when(text_only & t.rlike(FALSE), _pair(1, "clear_false"))
    return out.otherwise(numeric_veracity(v))


def judged_axis(rating) -> Column:
    t = F.coalesce(_c(rating), F.lit(""))
    return F.when(t.rlike(ATTRIBUTION), "attribution").when(t.rlike(ARTIFACT), "artifact")


def rule_key(rating) -> Column:
    """Key of a verdict in a publisher's rule table."""
    return F.regexp_replace(F.lower(F.trim(_c(rating))), r"\.+$", "")


def band(score, low: float, mid: float, high: float) -> Column:
    """1, 2, middle or supported: at or below a cut is the lower side."""
    s = _c(score)
    return F.when(s <= low, "1").when(s <= mid, "2").when(s > high, "supported").otherwise("middle")


def page_flag(flags: Column) -> Column:
    """Flag of a page of several read regions: both sides are 3, else the strongest of the side, else 3, X, I."""
    has = lambda f: F.array_contains(flags, f)
    sup, ref = has("5") | has("4"), has("1") | has("2")
    return F.when(sup & ref, "3").when(has("5"), "5").when(has("4"), "4").when(has("1"), "1").when(has("2"), "2").when(has("3"), "3").when(has("X"), "X").otherwise("I")


def checked_read(flag, n_cited, n_shown) -> Column:
    """struct(flag, qc): a directional flag without a citation is context; one that cites nearly all of a long page is marked."""
    f, c, n = _c(flag), _c(n_cited), _c(n_shown)
    bare = (f != "I") & (c == 0)
    blanket = f.isin("5", "4", "3", "2", "1") & (n >= 15) & (c >= 0.9 * n)
    return F.struct(F.when(bare, "X").otherwise(f).alias("flag"), F.when(bare, "empty-directional").when(blanket, "blanket-citation").otherwise("").alias("qc"))


def note_class(boxes: list[str]) -> Column:
    """The first ticked box of a note, in order of priority; null boxes are not ticked."""
    return F.coalesce(*[F.when(F.coalesce(F.col(b).try_cast("int"), F.lit(0)) == 1, F.lit(b)) for b in boxes], F.lit("none"))


def quasi_label(helpful_misleading: Column, fine_or_rejected: Column) -> Column:
    return F.when(helpful_misleading, F.lit(False)).when(fine_or_rejected, F.lit(True))
