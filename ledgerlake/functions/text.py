"""Text columns: normalisation, tokens, shingles, similarity, quality and page tests.  JVM-side expressions unless a name ends in _udf."""

from __future__ import annotations

import html
import json
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Word lists and patterns that results depend on.
STOPWORDS = (
    "a an the of to in on at for and or nor but vs with without is are was were be been being by from as that this these those it its their his her "
    "they them he she we you our your has have had do does did will would can could should shall may might must not no than then there here what which "
    "who whom whose when where why how new more most other some any all both each such only own same so too very just said says say according before "
    "after over under about into out up down off again"
).split()
QUERY_STOPWORDS = "a an the of to in on at for and or nor but vs with without is are was were be been by from as that this these those how why what who whom when where which new".split()
DEIXIS = r"(?i)^(?:this|that|these|those|he|she|they|it|here|there)\b"
QUESTION = r"\?\s*$"
ATTRIBUTION_VERB = r"(?i)\b(?:said|says|told|claimed|claims|stated|states|tweeted|posted|announced|warned|admitted|confirmed)\b"
WALLS = (
    ("consent", r"(?i)\b(?:accept (?:all )?cookies|cookie (?:policy|preferences|settings)|we (?:use|and our partners use) cookies|manage (?:your )?preferences|consent to the use of cookies|gdpr)\b"),
    ("botcheck", r"(?i)\b(?:enable javascript|javascript is (?:required|disabled)|verify (?:you are|you're) (?:a )?human|are you a robot|checking your browser|unusual traffic|access denied|request blocked|cloudflare|captcha|403 forbidden|permission denied)\b"),
    ("login", r"(?i)\b(?:sign in to (?:continue|read)|log ?in to (?:continue|read)|create (?:a free )?account to|subscribe to (?:continue|read)|this (?:content|article) is for subscribers|register to (?:continue|read))\b"),
    ("error", r"(?i)\b(?:404 not found|page not found|this page (?:has moved|no longer exists)|the requested url was not found|service unavailable|we can't find the page)\b"),
    ("placeholder", r"(?i)\blorem ipsum\b"),
)
JUNK = r"(?i)(?:not authorized to access|access denied|page not found|problem finding that (?:article|page)|enable (?:javascript|cookies)|subscribe to (?:continue|read)|to continue reading|are you a robot|verify you are (?:a )?human|tollbit|captcha|log in to continue)"
BOILERPLATE = r"(?i)^(?:sign up|subscribe|read more|related(?: articles| stories)?:?|share this|follow us|advertisement|newsletter|click here|watch:|read:|more:|support (?:our|independent))"
ACCENTED = "àâçéèêëîïôùûüœæ"


#: Rows whose texts are Python objects at a time; a batch of Arrow's holds 10,000.
ROWS = 250


def by_rows(f, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """f of each row, ROWS rows at a time as Python objects: what a worker holds does not grow with the rows of a batch, but for their texts themselves."""
    made = [pa.array([f(*row) for row in zip(*(c.slice(at, ROWS).to_pylist() for c in columns))], kind) for at in range(0, len(columns[0]), ROWS)]
    return pa.concat_arrays(made) if made else pa.array([], kind)


def _text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def squeeze(c) -> Column:
    return F.trim(F.regexp_replace(_text(c), r"\s+", " "))


def _leading(c, limit: int, whole) -> Column:
    """The first `limit` characters of whole(text), from the text's beginning alone where that is enough.

    The beginning ends at white space, so that no word or URL is cut; what whole() makes of it is then how the whole comes out too.
    """
    t = _text(c)
    if limit > 10_000:
        return F.substring(whole(t), 1, limit)
    head = whole(F.regexp_extract(F.substring(t, 1, 3 * limit), r"(?s)^(.*)\s", 1))
    return F.when(F.length(head) >= limit, F.substring(head, 1, limit)).otherwise(F.substring(whole(t), 1, limit))


def norm(c, limit: int = 500, keep: str = ACCENTED) -> Column:
    """Lower case, no URLs, ASCII word characters with ' and - (and `keep`), single spaces, cut to `limit` characters."""
    plain = lambda t: squeeze(F.regexp_replace(F.regexp_replace(F.lower(t), r"https?://\S+", ""), rf"[^a-z0-9_\s'{keep}-]", " "))
    return _leading(c, limit, plain)


def norm_claim(c) -> Column:
    return norm(c, 400, "")


def norm_template(c) -> Column:
    """Only word characters and single spaces, cut to 400 characters."""
    return _leading(c, 400, lambda t: F.trim(F.regexp_replace(F.lower(t), r"[^a-z0-9_]+", " ")))


def content_tokens(c, least: int = 4) -> Column:
    """Distinct ASCII tokens of at least `least` characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(_text(c)), F.lit(r"([a-z0-9][a-z0-9'\-]*)"), 1), lambda w: F.length(w) >= least))


def keywords(c) -> Column:
    """Distinct tokens of more than two characters without stop words."""
    words = F.regexp_extract_all(F.lower(_text(c)), F.lit(r"([a-z0-9][a-z0-9'\-]*)"), 1)
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2)), F.array(*[F.lit(w) for w in STOPWORDS]))


def keyword_hits(text, words: Column) -> Column:
    return F.size(F.array_intersect(keywords(text), words))


def anchor_terms(c) -> Column:
    """Numbers, short upper-case tokens and words of more than three characters, lower-cased."""
    words = F.regexp_extract_all(_text(c), F.lit(r"([A-Za-z0-9][A-Za-z0-9'\-]*)"), 1)
    # most words are long: patterns are only asked for short ones
    good = F.filter(words, lambda w: (F.length(w) > 3) | w.rlike("[0-9]|^[^a-z]*[A-Z][^a-z]*$"))
    return F.array_distinct(F.transform(good, F.lower))


def redundant_query(query, past: Column) -> Column:
    """True if the query has no content token beyond the earlier queries (an array); false without earlier ones."""
    seen = F.flatten(F.transform(past, content_tokens))
    return (F.size(past) > 0) & (F.size(F.array_except(content_tokens(query), seen)) == 0)


def on_topic(text, claim, share: float = 0.15) -> Column:
    want = content_tokens(claim)
    return (F.size(want) > 0) & (F.size(F.array_intersect(want, content_tokens(text))) >= share * F.size(want))


def anchored(claim, pool, share: float = 0.6) -> Column:
    """At least `share` of the claim's content tokens are in the pool."""
    want = content_tokens(claim)
    return (F.size(want) == 0) | (F.size(F.array_intersect(want, content_tokens(pool))) >= share * F.size(want))


def char_trigrams(c) -> Column:
    """Distinct three-character substrings; a shorter text is its own."""
    t = squeeze(c)
    # arrays are zipped, as a lambda that names the text would squeeze it anew for each character
    each, end = F.filter(F.split(t, ""), lambda x: x != ""), 2**30
    pairs = F.zip_with(each, F.slice(each, 2, end), lambda x, y: F.concat(x, y))
    many = F.array_distinct(F.array_compact(F.zip_with(pairs, F.slice(each, 3, end), lambda x, y: F.concat(x, y))))
    return F.when(F.length(t) >= 3, many).otherwise(F.array(t))


def word_shingles(c, n: int = 8, span: int = 5000) -> Column:
    """Distinct runs of n words over the first `span` characters; none for fewer words."""
    w = F.filter(F.split(F.regexp_replace(F.lower(F.substring(_text(c), 1, span)), r"[^a-z0-9_]+", " "), " "), lambda x: x != "")
    # the words are bound once, by a lambda over an array of one; a lambda that names the text would split it anew at each place
    each = lambda ww: F.transform(F.sequence(F.lit(1), F.size(ww) - n + 1), lambda k: F.array_join(F.slice(ww, k, F.lit(n)), " "))
    empty = F.array().cast("array<string>")
    return F.element_at(F.transform(F.array(w), lambda ww: F.when(F.size(ww) >= n, F.array_distinct(each(ww))).otherwise(empty)), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 when both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Shared values over the smaller array; 0 when one is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(0.0)


def tokens(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_text(c)), F.lit(r"([a-z0-9_]+)"), 1))


def latin_ratio(c) -> Column:
    """Latin letters over letters; 0 without letters."""
    letters = F.length(F.regexp_replace(_text(c), r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(_text(c), rf"[^a-zA-Z{ACCENTED}{ACCENTED.upper()}]", ""))
    return F.when(letters > 0, latin / letters).otherwise(0.0)


def language_ok(c, words: Column, least: int = 2, ratio: float = 0.9) -> Column:
    """Mostly Latin letters, and at least `least` of some frequent words."""
    return (latin_ratio(c) >= ratio) & (F.size(F.array_intersect(tokens(c), words)) >= least)


def quality_flags(c) -> Column:
    """deixis, question, fragment, non-latin, short: those that apply."""
    t = _text(c)
    tests = [("deixis", t.rlike(DEIXIS)), ("question", t.rlike(QUESTION)), ("fragment", t.rlike(r"^[a-z]")), ("non-latin", latin_ratio(c) < 0.9), ("short", F.length(t) < 25)]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in tests]))


def page_wall(c, thin: int = 400, most: int = 2500) -> Column:
    """Why a text is not a readable page (empty, thin, a wall, nav_shell), or null."""
    t = F.trim(_text(c), F.lit(" \t\n\r"))
    out = F.when(F.length(_text(c)) == 0, F.lit("empty")).when(F.length(t) < thin, F.lit("thin"))
    for name, pattern in WALLS:
        out = out.when((F.length(t) <= most) & t.rlike(pattern), F.lit(name))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    short = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) < 45))
    stops = (F.length(t) - F.length(F.replace(t, F.lit(". "), F.lit("")))) / 2
    return out.when((F.size(lines) >= 12) & (short > 0.85 * F.size(lines)) & (stops < 0.08 * F.size(lines)), F.lit("nav_shell"))


def is_junk(c, words: Column, substance: int = 3) -> Column:
    """A wall phrase near the begin and too few of the claim's terms."""
    return F.substring(_text(c), 1, 600).rlike(JUNK) & (keyword_hits(c, words) < substance)


def article_lines(c) -> Column:
    """Cleaned lines: plain quotes and dashes, no boilerplate, no short line without an end mark, no repeats."""
    t = F.translate(_text(c), "‘’“”–— ", "''\"\"-- ")
    lines = F.transform(F.split(t, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    good = F.filter(lines, lambda x: (x != "") & ~x.rlike(BOILERPLATE) & ((F.length(x) >= 25) | x.rlike(r"[.!?]$")))
    return F.array_distinct(good)


@F.arrow_udf(T.ArrayType(T.StringType()))
def first_of_each_udf(s: pa.Array) -> pa.Array:
    """The first of strings that differ only in case or spacing."""

    def first(x):
        seen: dict[str, str] = {}
        for t in x if x is not None else ():
            seen.setdefault(" ".join(t.split()).lower(), t)
        return list(seen.values())

    return by_rows(first, pa.list_(pa.string()), s)


def sentences(c) -> Column:
    """Sentences by end mark and capital, line by line, first of those that differ only in case or spacing."""
    parts = F.flatten(F.transform(F.split(_text(c), "\n"), lambda p: F.split(p, r"(?<=[.!?\"])\s+(?=[A-Z\"'0-9(])")))
    # trim by a lambda of its own: F.trim takes a second column, and transform() would hand it the place, whose digits it then strips
    return first_of_each_udf(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda s: s != ""))


def sentences_capped(c, most: int = 800) -> Column:
    """struct(kept, dropped): units of more than two characters; those longer than `most` are dropped and counted."""
    parts = F.filter(F.transform(F.split(_text(c), r"(?<=[.!?。！？])\s+|\n+"), F.trim), lambda s: F.length(s) > 2)
    return F.struct(F.filter(parts, lambda s: F.length(s) <= most).alias("kept"), F.size(F.filter(parts, lambda s: F.length(s) > most)).alias("dropped"))


def byline_zone(c) -> Column:
    """The first three sentences, at most 400 characters."""
    return F.substring(F.array_join(F.slice(sentences(c), 1, 3), " "), 1, 400)


def wire_copy(c, wire: str) -> Column:
    """A byline of the agency in the byline zone."""
    return byline_zone(c).rlike(rf"(?i)(?:\({wire}\)|\b{wire}\s*[-–—:]|\bby {wire}\b|\bvia {wire}\b)")


def attribution(c, type_: Column) -> Column:
    return (type_ == "attribution") & _text(c).rlike(ATTRIBUTION_VERB)


def repaired_type(type_: Column, c) -> Column:
    """Attributions to nobody in particular, or of amplification, are assertions."""
    bare = F.regexp_replace(_text(c), "[\"“][^\"”]*[\"”]", " ")
    return F.when((type_ == "attribution") & bare.rlike(r"(?i)\b(?:sources?|reports?|people|users?|some|many) (?:say|said|claim|claimed|suggest)|\b(?:shared|reposted|amplified|viral)\b"), F.lit("assertion")).otherwise(type_)


def segment_id(c) -> Column:
    """3, "3" and "S3" are 3; anything else is null."""
    return F.regexp_extract(F.trim(F.col(c) if isinstance(c, str) else c), r"(?i)^s?(\d+)$", 1).try_cast("int")


def stable_id(text, url) -> Column:
    return F.substring(F.sha1(F.concat_ws("||", _text(text), _text(url))), 1, 16)


def cache_key(*parts) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def prompt_hash(c) -> Column:
    return F.substring(F.sha2(_text(c), 256), 1, 12)


def snowflake_time(c) -> Column:
    return F.timestamp_millis(F.shiftright(F.col(c) if isinstance(c, str) else c, 22) + F.lit(1288834974657))


# -- what the JVM has no function for ---------------------------------------------------------------


def _clean(s):
    if s is None:
        return None
    for _ in range(3):
        u = html.unescape(s)
        if u == s:
            break
        s = u
    return unicodedata.normalize("NFC", s).replace("\xa0", " ").replace("​", "")


@F.arrow_udf(T.StringType())
def clean_text_udf(s: pa.Array) -> pa.Array:
    """Character references decoded (up to three times), NFC, no-break spaces as spaces, no zero-width spaces."""
    return by_rows(_clean, pa.string(), s)


@F.arrow_udf(T.StringType())
def join_text_udf(s: pa.Array) -> pa.Array:
    """Text as a join key: unescaped twice, NFKC, plain quotes, single spaces, trimmed of quotes and stops, lower case."""
    table = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "\xa0": " "})
    key = lambda t: "" if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", html.unescape(html.unescape(t))).translate(table)).strip().strip("\"'. ").lower()
    return by_rows(key, pa.string(), s)


@F.arrow_udf(T.StringType())
def markdown_prose_udf(s: pa.Array) -> pa.Array:
    """Prose lines of a page in Markdown: no images, link targets or URLs; sentences, terse verdicts and CJK lines stay."""

    def prose(t):
        t = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", re.sub(r"!\[[^\]]*\]\([^)]*\)", " ", t or ""))
        out = []
        for line in re.sub(r"https?://\S+|www\.\S+", " ", t).splitlines():
            line, w = line.strip(), line.split()
            if not w:
                continue
            share = sum(sum(c.isalpha() for c in x) >= 2 for x in w) / len(w)
            cjk = len(re.findall(r"[぀-ヿ㐀-鿿가-힯]", line))
            if len(w) >= 4 and share >= 0.6 or line[-1] in ".!?”\"'" and len(w) >= 2 and share >= 0.5 or cjk >= 10 and cjk >= 0.3 * len(line):
                out.append(line)
        return "\n".join(out)

    return by_rows(prose, pa.string(), s)


@F.pandas_udf(T.StringType())
def first_json_udf(s: pd.Series) -> pd.Series:
    """The first balanced JSON object of a text; null if there is none."""

    def first(t):
        decode, at = json.JSONDecoder(), -1
        while t and (at := t.find("{", at + 1)) >= 0:
            try:
                return json.dumps(decode.raw_decode(t, at)[0], sort_keys=True)
            except ValueError:
                continue
        return None

    return s.map(first)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def evidence_ids_udf(s: pd.Series) -> pd.Series:
    """Sorted ids of a JSON list of integers, "a-b" strings and nested pairs; null when it has anything else."""

    def add(x, out):
        if isinstance(x, bool):
            raise ValueError
        if isinstance(x, int):
            out.add(x)
        elif isinstance(x, str) and (m := re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", x)):
            out.update(range(int(m[1]), int(m[2] or m[1]) + 1))
        elif isinstance(x, list) and len(x) == 2 and all(type(k) is int for k in x):
            out.update(range(min(x), max(x) + 1))
        elif isinstance(x, list):
            for k in x:
                add(k, out)
        else:
            raise ValueError

    def ids(t):
        try:
            out: set[int] = set()
            for x in json.loads(t):
                add(x, out)
            return sorted(out)
        except (TypeError, ValueError):
            return None

    return s.map(ids)


@F.pandas_udf(T.IntegerType())
def blake_fold_udf(s: pd.Series) -> pd.Series:
    """Unsigned 64-bit BLAKE2b of a key, modulo five."""
    import hashlib

    return s.map(lambda k: None if k is None else int.from_bytes(hashlib.blake2b(str(k).encode(), digest_size=8).digest(), "big") % 5).astype("Int32")
