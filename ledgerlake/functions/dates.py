"""Date columns: dates stay ISO strings that compare as text; a parsed DATE stands beside them where arithmetic needs it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats that search results use.
FORMATS = ("yyyy-MM-dd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iso(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def hit_date(raw) -> Column:
    """ISO date of a free-text date; null when it does not parse, as relative dates never do."""
    s = F.trim(_c(raw))
    return iso(F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("date") for f in FORMATS]))


def date_bound(day) -> Column:
    """ISO day as a search engine's upper bound; empty on a bad date."""
    d = F.try_to_timestamp(_c(day), F.lit("yyyy-MM-dd"))
    return F.coalesce(F.concat(F.lit("cdr:1,cd_min:1/1/1900,cd_max:"), F.date_format(d, "M/d/yyyy")), F.lit(""))


def is_leak(raw, ceiling) -> Column:
    """Dated after the ceiling; an unknown date is no leak."""
    return F.coalesce(hit_date(raw) > _c(ceiling), F.lit(False))


def relative_date(raw, crawled) -> Column:
    """ "3 days ago" counted back from the crawl day, a month as 30 and a year as 365 days."""
    n = F.regexp_extract(F.lower(_c(raw)), r"^(\d+) (?:minute|hour|day|week|month|year)s? ago$", 1).try_cast("int")
    unit = F.regexp_extract(F.lower(_c(raw)), r"^\d+ (minute|hour|day|week|month|year)s? ago$", 1)
    days = reduce(lambda acc, kv: F.when(unit == kv[0], kv[1]).otherwise(acc), {"day": 1, "week": 7, "month": 30, "year": 365}.items(), F.lit(0))
    return iso(F.date_sub(_c(crawled).cast("date"), n * days))


def latest_day(partial) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD as its latest day; null if it is none or not a date."""
    s = F.trim(_c(partial).cast("string"))
    y, m, d = (F.regexp_extract(s, r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?", k) for k in (1, 2, 3))
    day = F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-MM-dd")).cast("date")
    month = F.last_day(F.try_to_timestamp(F.concat_ws("-", y, m, F.lit("01")), F.lit("yyyy-MM-dd")).cast("date"))
    return F.when(d != "", iso(day)).when(m != "", iso(month)).when(y != "", F.concat(y, F.lit("-12-31")))


def ceiling(claim_date, extracted, review_date) -> Column:
    """struct(day, source): the latest day that evidence may bear.

    The claim's own date, unless it is not before the review; else the extracted date at its latest; else the day before the review.
    Never later than the day before the review.
    """
    cd, rd = F.substring(_c(claim_date), 1, 10), F.substring(_c(review_date), 1, 10)
    cd = F.when((_c(claim_date) != "") & ~F.coalesce(cd >= rd, F.lit(False)), cd)
    xd, cap = latest_day(extracted), iso(F.date_sub(rd.try_cast("date"), 1))
    day, source = F.coalesce(cd, xd, cap), F.when(cd.isNotNull(), "claim_date").when(xd.isNotNull(), "x_date").when(cap.isNotNull(), "review-1").otherwise("none")
    late = F.coalesce(day >= cap, F.lit(False))
    return F.struct(F.coalesce(F.when(late, cap).otherwise(day), F.lit("")).alias("day"), F.when(late & (source != "review-1"), F.concat(source, F.lit("+clamped"))).otherwise(source).alias("source"))


def after_claim(entry, claim) -> Column:
    a, b, shape = F.substring(_c(entry), 1, 10), F.substring(_c(claim), 1, 10), r"^\d{4}-\d{2}-\d{2}"
    return F.coalesce(a.rlike(shape) & b.rlike(shape) & (a > b), F.lit(False))
