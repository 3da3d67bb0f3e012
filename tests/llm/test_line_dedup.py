import hashlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerlake.llm.line_dedup import drop_lines
from ledgerlake.llm.perfect_hash import PerfectHash

SCHEMA = "doc_id long, text string, shard string, run int, slab int"


def brute(rows, min_chars=1, min_docs=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holds = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holds[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < min_chars or len(holds[key(x)]) < min_docs]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    r = [(k, f"unique {k}\n  Common LINE\t\nother {k % 7}\n\nÀ shared É") for k in range(24)]
    r += [(100 + k, "common line\r\nx\nx") for k in range(3)]
    r += [(200, None), (201, ""), (None, "common line\nonly"), (None, "common line"), (202, "a" * 300_000 + "\ncommon line")]
    r += [(300, "rare")] * 12 + [(301 + k, "nine") for k in range(9)] + [(400 + k, "à") for k in range(10)]
    return r


@pytest.mark.parametrize("kw", [{}, {"min_chars": 2}, {"min_docs": 25}, {"slab_bytes": 200}])
def test_against_brute_force(spark, kw):
    df = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows()], SCHEMA)
    got = sorted((tuple(r) for r in drop_lines(df, report=True, **kw).collect()), key=str)
    assert got == brute(rows(), **{k: v for k, v in kw.items() if k != "slab_bytes"})


def test_documents_keep_their_columns(spark):
    df = spark.createDataFrame([(k, f"keep {k}\nGONE", "s", 1, 2) for k in range(10)] + [(50, None, None, None, None), (51, "gone", "t", 3, 4)], SCHEMA)
    out = drop_lines(df)
    assert out.schema == df.schema
    got = {r.doc_id: tuple(r) for r in out.collect()}
    assert got[3] == (3, "keep 3", "s", 1, 2) and got[50] == (50, None, None, None, None) and got[51] == (51, "", "t", 3, 4)
    assert drop_lines(df.limit(0)).count() == 0 and drop_lines(df.limit(0), report=True).count() == 0


def test_perfect_hash():
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, np.uint64))
        ph = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
        assert sorted(ph.index(keys).tolist()) == list(range(len(keys))) and ph.n == len(keys)
