"""One query per corpus operator, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .html_main_text import main_text
from .ivf_pq import search
from .license_scan import licenses
from .line_dedup import drop_lines
from .merkle_manifest import checked
from .parity_join import link_components
from .piece_lattice import segment
from .robust_rules import rate
from .source_mix import taken
from .spelling_variants import spelling_variants
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .warc_writer import archive_and_read


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_robust_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(_read(spark, sf_dir, "documents"))


def op3_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_read(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(_read(spark, sf_dir, "documents"), min_chars=1, min_docs=10, report=True)


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_read(spark, sf_dir, "pages"))


def op6_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(_read(spark, sf_dir, "pages"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(_read(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(_read(spark, sf_dir, "documents"))


def op9_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(_read(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op10_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(_read(spark, sf_dir, "documents"), n=3)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(_read(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), limit=1024)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_read(spark, sf_dir, "documents"), min_chars=6, min_count=5, ratio=5, typo_every=199)


_TRIMMED = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_CRC_BYTE = "list_reduce([{}::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)"


def _leaf(n_chars: str) -> str:
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0} END"
    return f"sha256({' || '.join(map(field.format, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


def _climb(name: str, start: str) -> str:
    """A tree's nodes, level by level."""
    return f"""{name}(g, level, pos, hash, n) AS (
            {start} UNION ALL
            SELECT g, level + 1, pos // 2, sha256(hash || coalesce(right_one, '')), (n + 1) // 2
            FROM (SELECT *, lead(hash) OVER (PARTITION BY g ORDER BY pos) AS right_one FROM {name} WHERE n > 1) x WHERE pos % 2 = 0)"""


def _walk(name: str, tree: str, start: str) -> str:
    """Rows on their way up a tree, with the siblings passed and the hash so far."""
    return f"""{name}(r, g, level, pos, n, others, now) AS (
            {start} UNION ALL
            SELECT w.r, w.g, w.level + 1, w.pos // 2, (w.n + 1) // 2, w.others || coalesce(t.hash, ''),
                   sha256(CASE WHEN w.pos % 2 = 0 THEN w.now || coalesce(t.hash, '') ELSE t.hash || w.now END)
            FROM {name} w LEFT JOIN {tree} t ON t.g = w.g AND t.level = w.level AND t.pos = xor(w.pos, 1) WHERE w.n > 1)"""


SQL = {
    "op6_warc_writer": """
        WITH page AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        last AS (SELECT html, max(page_id) AS response, count(*) AS copies FROM page WHERE n >= 1000 GROUP BY html)
        SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN response IS NOT NULL AND page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to
        FROM page LEFT JOIN last USING (html)""",
    "op4_line_dedup": f"""
        WITH doc AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        line AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS at FROM doc),
        keyed AS (SELECT *, {_LOWER.format(_TRIMMED.format("line"))} AS key FROM line),
        often AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 10)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
               sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.at) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
        FROM keyed k LEFT JOIN often o ON k.key = o.key GROUP BY k.r""",
    "op11_merkle_manifest": f"""
        WITH RECURSIVE doc AS (
            SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '+' || lang END AS g, {_leaf("n_chars")} AS leaf,
                   CASE WHEN xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT), lambda c, b: {_CRC_BYTE.format("xor(c, b)")}), 4294967295) % 7 = 0
                        THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS now
            FROM documents),
        placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM doc),
        {_climb("tree", "SELECT g, 0, pos, leaf, n FROM placed")},
        top AS (SELECT g, hash, row_number() OVER (ORDER BY g <> '-', encode(g)) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
        {_climb("crown", "SELECT '', 0, pos, hash, n FROM top")},
        {_walk("low", "tree", "SELECT r, g, 0, pos, n, '', now FROM placed")},
        {_walk("high", "crown", "SELECT l.r, '', 0, t.pos, t.n, l.others, l.now FROM low l JOIN top t ON l.g = t.g WHERE l.n = 1")}
        SELECT d.doc_id, d.leaf, t.hash AS subroot, c.hash AS root, sha256(h.others) AS proof_sha256, h.now AS folded_root, h.now = c.hash AS verified
        FROM doc d JOIN top t ON d.g = t.g JOIN high h ON h.r = d.r AND h.n = 1 JOIN crown c ON c.n = 1""",
    "op13_spelling_variants": f"""
        WITH RECURSIVE crc AS (SELECT list({_CRC_BYTE.format("b")} ORDER BY b) AS step FROM range(256) x(b)),
        run AS (SELECT r, coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' AS front, word, count(*) AS k
                FROM (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-zÀ-ÿ]{{6,}}')) AS word FROM documents) GROUP BY ALL),
        summed AS (SELECT word, k, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(front || word, ''),
                              lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 | unicode(c)::BIGINT >> 6, 128 | unicode(c)::BIGINT & 63] END)),
                          lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM run, crc),
        typed AS (SELECT CASE WHEN h % 199 = 0 THEN left(word, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, k FROM summed),
        lexicon AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
        less AS (SELECT word, n, pos, left(word, pos - 1) || substr(word, pos + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS pos FROM lexicon)),
        pair AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
                 UNION SELECT a.word, b.word, b.n FROM less a JOIN lexicon b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN lexicon b ON a.rest = b.word),
        best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM pair GROUP BY word),
        found AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM lexicon LEFT JOIN best USING (word)),
        walk AS (SELECT word, word AS here, form AS onward FROM found UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN found f ON f.word = w.onward)
        SELECT f.word, f.form, w.here AS root, f.n, f.n_near, f.form_n FROM found f JOIN walk w ON f.word = w.word AND w.onward IS NULL""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
