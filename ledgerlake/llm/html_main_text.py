"""Main text of web pages by the maximum-scoring contiguous run of tokens.

A page is read as one sequence of words and tags.  Words score positive and tags negative; the weights are
log-odds of lying inside the main text, estimated from labelled pages (pages that mark their main text
with a single <article> or <main>, or labels that are passed in), and one linear scan finds the contiguous run with the greatest
sum.  Words inside containers that by element, role, class or id hold menus, headers, footers, sidebars, notices,
adverts, forms or reader comments, and words outside <article> and <main> on a page that has them,
score negative, and are left out of a run that spans them.  Scripts,
styles, comments and the head are not text.

The classifier is fitted on at most `max_labelled` pages, taken in the order of a hash of page_id; every
page is then extracted whole.

Defined results: null or empty html, and html without words outside such containers, give an empty text;
character references are decoded; white space inside a block becomes one space, a block is trimmed, empty blocks vanish and blocks are
joined by one \\n; tags that never close end with their container or the page; an empty table gives an empty
result; repeated rows are each answered; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import to_bytes

# Element names of HTML and words in class, id and role.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
RAW = frozenset("script style noscript template textarea select title iframe svg math object video audio canvas datalist xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav footer aside form menu dialog button label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
MARKS = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|adsense|adslot|adbox|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar|side|aside|rail|footer|foot|masthead|topbar|"
    r"cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|paywall|share|sharing|social|related|recommend\w*|"
    r"widget|toolbar|pagination|pager|comments?|commentlist|respond|replies|reply|disqus|form|search|skip|legal|copyright|tagcloud)(?![a-z])"
)
MAIN = frozenset(("article", "main"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


def _chrome(name: str, attrs: str, inside_main: bool) -> bool:
    if name in CHROME or (name == "header" and not inside_main):
        return True
    if name in ("body", "html") or name in MAIN and "comment" not in attrs.lower():
        return False
    if attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
                return True
            if key in ("class", "id") and MARKS.search(value.replace("_", "-")):
                return True
    return False


def tokens(page: str):
    """(kind, name or text, chrome, main, link) in page order; kind is "tag" or "text"."""
    stack: list[tuple[str, bool, bool]] = []  # name, chrome, main
    at, end = 0, len(page)
    depth = {"chrome": 0, "main": 0, "a": 0}

    def pop_to(k: int) -> None:
        while len(stack) > k:
            name, chrome, main = stack.pop()
            depth["chrome"] -= chrome
            depth["main"] -= main
            depth["a"] -= name == "a"

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            text = m[0]
            if text[0] == "<" and len(text) > 1:
                continue
            yield "text", text, depth["chrome"] > 0, depth["main"] > 0, depth["a"] > 0
            continue
        name, closing, attrs = name.lower(), bool(m[1] or m[4]), (m[3] or m[6] or "")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
                if stack[k][0] in MAIN or stack[k][0] in CHROME and name not in BLOCK:
                    break
            yield "tag", name, depth["chrome"] > 0, depth["main"] > 0, False
            continue
        if name in RAW or name == "head":
            if not attrs.endswith("/"):
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                body = re.compile(r"<body[\s>]", re.I).search(page, at) if name == "head" and not close else None
                at = close.end() if close else body.start() if body else at if name == "head" else end
            yield "tag", name, depth["chrome"] > 0, depth["main"] > 0, False
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name in BLOCK:  # a block ends an open paragraph
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] == name and name in ("li", "dt", "dd", "tr", "td", "th"):
                    pop_to(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        yield "tag", name, depth["chrome"] > 0, depth["main"] > 0, False
        if name not in VOID and not attrs.endswith("/"):
            chrome, main = _chrome(name, attrs, depth["main"] > 0), name in MAIN
            stack.append((name, chrome, main))
            depth["chrome"] += chrome
            depth["main"] += main
            depth["a"] += name == "a"


def features(page: str):
    """(feature, count, inside main text) for labelled pages."""
    for kind, x, chrome, main, link in tokens(page):
        if kind == "tag":
            yield f"tag {x}", 1, main
        elif n := len(x.split()):
            yield ("chrome" if chrome else "link" if link else "word"), n, main and not chrome


PRIOR = {"word": 3.0, "link": 0.5, "chrome": -1.0, "tag": -0.5}


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Scores by log-odds of lying inside the main text: words above, tags below zero."""
    names = {f for f, _ in counts}
    total = {side: sum(n for (f, s), n in counts.items() if s == side and not f.startswith("tag ")) + 1 for side in (True, False)}
    out = dict(PRIOR)
    for f in names:
        odds = math.log((counts.get((f, True), 0) + 1) / total[True]) - math.log((counts.get((f, False), 0) + 1) / total[False])
        if f in ("word", "link"):
            out[f] = min(3.0, max(0.1, odds))
        elif f == "chrome":
            out[f] = max(-3.0, min(-0.1, odds))
        else:
            out[f] = max(-1.5, min(-0.1, odds - 1.0))
    return out


def extract(page: str, weight: dict[str, float]) -> str:
    """The main text of one page."""
    scores: list[tuple[float, tuple[int, str] | None]] = []  # score of a token; block and text of what a run would keep
    block = 0
    default_tag = weight["tag"]
    read = list(tokens(page))
    marked = any(kind == "text" and main and not chrome and not x.isspace() for kind, x, chrome, main, _ in read)
    for kind, x, chrome, main, link in read:
        chrome = chrome or marked and not main
        if kind == "tag":
            scores.append((weight.get(f"tag {x}", default_tag), None))
            if x in BLOCK:
                block += 1
            elif x == "br" and not chrome:
                scores.append((0.0, (block, " ")))
        elif not x.isspace():
            text = _html.unescape(x) if "&" in x else x
            n = len(text.split())
            scores.append((n * weight["chrome" if chrome else "link" if link else "word"], None if chrome else (block, text)))
        elif not chrome:
            scores.append((0.0, (block, " ")))
    best = total = 0.0
    begin = first = last = 0
    for k, (s, _) in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, k
        total += s
        if total > best:
            best, first, last = total, begin, k + 1
    pieces = [p for _, p in scores[first:last] if p]
    out, held, now = [], [], None
    for number, text in pieces:
        if number != now:
            out.append("".join(held))
            held, now = [], number
        held.append(text)
    out.append("".join(held))
    return "\n".join(t for t in (_SPACE.sub(" ", b).strip() for b in out) if t)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_labelled: int = 2000) -> dict[str, float]:
    """Weights from at most max_labelled pages that mark their main text."""
    marked = pages.filter(F.size(F.split(F.lower(html_col), r"<(?:article|main)[\s>]")) == 2)
    some = marked.select(F.col(id_col), F.col(html_col).alias("html")).orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(max_labelled)

    def count(batches):
        found: Counter = Counter()
        for b in batches:
            for page in b.column(1).to_pylist():
                for f, n, inside in features(page or ""):
                    found[f if len(f) < 40 else "tag other", inside] += n
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.bool_()), pa.array([found[k] for k in keys], pa.int64())], names=["feature", "inside", "n"])

    common = {f"tag {x}" for x in BLOCK | RAW | VOID | CHROME | {"a", "b", "i", "em", "strong", "span", "head"}} | {"word", "link", "chrome"}
    rows = some.mapInArrow(count, "feature string, inside boolean, n long").filter(F.col("feature").isin(sorted(common))).groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()
    return weights({(r.feature, r.inside): r.n for r in rows})


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weight: dict[str, float] | None = None, max_labelled: int = 2000) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    weight = fit(pages, id_col, html_col, max_labelled) if weight is None else weight

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                text = [extract(x.decode(), weight) for x in to_bytes(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    thin = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return thin.mapInArrow(run, "page_id long, url string, text string, n_chars long")
