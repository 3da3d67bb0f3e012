import math
import random

from ledgerlake.operators import vectors as V

SCHEMA = "id long, g int, v array<float>"


def cosine(a, b):
    if a is None or b is None or len(a) != len(b):
        return None
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    size = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
    return round(dot(a, b) / size, 9) if size > 0 else None


def odd_rows():
    """Copies, opposite and zero vectors, nulls, none and vectors of another length."""
    rnd = random.Random(3)
    rows = [(k, k % 3, [float(rnd.randint(-2, 2)) for _ in range(3)]) for k in range(150)]
    return rows + [(200 + k, 0, [1.0, 0.0, 2.0]) for k in range(40)] + [(300, 0, [0.0] * 3), (301, 0, None), (302, 1, [1.0, 2.0]), (303, 1, [2.0, 4.0]), (304, None, [1.0, 0.0, 2.0])]


def test_nearest_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "WIDE", 40)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.query, r["rank"], r.id, r.sim) for r in V.nearest(df.filter("id % 4 = 2"), df, "id", "v", 7, 0.1).collect())
    want = []
    for q, _, x in rows:
        if q % 4 == 2:
            near = sorted((-s, i) for i, _, y in rows if i != q and (s := cosine(x, y)) is not None and s >= 0.1)[:7]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert got == sorted(want)


def test_links_connect_what_pairs_connect(spark, monkeypatch):
    """Forty-one copies are 820 pairs; the links of each two parts are no more than their items."""
    monkeypatch.setattr(V, "BLOCK", 20)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = {(i, j): cosine(x, y) for i, g, x in rows for j, h, y in rows if i < j and g is not None and g == h and (cosine(x, y) or -2) >= 0.9}
    assert {(r.a, r.b): r.sim for r in V.similar_within(df, "g", "id", "v", 0.9).collect()} == pairs
    lead = {i: i for i, _, _ in rows}
    while any(lead[i] != lead[j] for i, j in pairs):
        for i, j in pairs:
            lead[i] = lead[j] = min(lead[i], lead[j])
    assert {r.id: r.component for r in V.cosine_components(df, "g", "id", "v", 0.9).collect()} == lead
    monkeypatch.setattr(V, "BLOCK", 2000)
    assert V.links_within(df, "g", "id", "v", 0.9).count() < len(rows) < len(pairs)


def test_no_product_of_rows_in_the_plan(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    assert "Cartesian" not in (plan := V.nearest(df, df, "id", "v", 3)._jdf.queryExecution().optimizedPlan().toString()) and "Join Cross" not in plan
