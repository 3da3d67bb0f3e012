import random
import re

from ledgerlake.llm.license_scan import TEMPLATES, WORDS, licenses, scan


def shingles(t):
    w = [x for x in re.split(r"[^\w]+|_", t.lower()) if x]
    return [tuple(w[k : k + WORDS]) for k in range(len(w) - WORDS + 1)]


def brute(rows, share=0.8):
    """Every template against every stretch of a text that is twice as long."""
    out = set()
    for i, t in rows:
        own = shingles(t or "")
        for (lic, _), text in TEMPLATES.items():
            want = set(shingles(text))
            for k in range(max(1, len(own))):
                if len(want & set(own[k : k + 2 * len(want) + 10])) >= share * len(want):
                    out.add((i, lic))
                    break
    return out


def test_against_brute_force(spark):
    rnd = random.Random(2)
    filler = lambda n: " ".join("".join(rnd.choice("abcdef") for _ in range(4)) for _ in range(n))
    rows = [(0, None), (1, ""), (2, "too few words here"), (3, filler(3000)), (4, filler(500).upper())]
    for k, t in enumerate(TEMPLATES.values()):
        w = t.split()
        rows.append((10 + k, f"{filler(rnd.randint(0, 400))}\n{t.upper()} {filler(50)}"))
        if len(w) > 30:
            cut = list(w)
            cut[7] = "changed"
            rows.append((100 + k, f"{filler(333)} {' '.join(cut)} {filler(9)}"))
            rows.append((200 + k, f"{filler(5)} {' '.join(w[: len(w) // 2])} {filler(9)}"))
    rows.append((300, filler(100) + " " + " ".join(TEMPLATES.values()) + filler(2)))
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows] + [(None, TEMPLATES["MIT", "notice"], "w", 1), (10, rows[5][1], "w", 1)], "doc_id long, text string, window string, shingle int")
    assert {(r.doc_id, r.license) for r in licenses(df).collect()} == brute(rows)
    assert licenses(df.limit(0)).count() == 0
    assert scan(df.filter("doc_id = 300")).count() >= len(TEMPLATES)


def test_corpus_notices(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.license) for r in licenses(docs).collect()}
    want = set()
    for r in docs.collect():
        for lic in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0"):
            if TEMPLATES[lic, "notice"] in (r.text or ""):
                want.add((r.doc_id, lic))
    assert want and got >= want and not any(x not in want for x in got)


def test_short_notice_beside_long_ones(spark):
    """A short template in a window that the shingles of others fill."""
    short = [k for k, t in TEMPLATES.items() if len(shingles(t)) <= 4]
    long = [k for k, t in TEMPLATES.items() if len(shingles(t)) > 20]
    cases = [(s, a, b) for s in short for a in long for b in long if a < b]
    df = spark.createDataFrame([(i, "\n".join(TEMPLATES[k] for k in c)) for i, c in enumerate(cases)], "doc_id long, text string")
    got = {(r.doc_id, r.license, r.part): r.containment for r in scan(df).collect()}
    assert all(got.get((i, *k)) == 1.0 for i, c in enumerate(cases) for k in c)
