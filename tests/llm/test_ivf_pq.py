import numpy as np
import pytest

from ledgerlake.llm.ivf_pq import kmeans, search, top


def brute(ids, x, every=20, k=20):
    out = {}
    for i, v in zip(ids, x):
        if i % every == 0:
            s = (x * v).sum(1)
            out[i] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    t = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = t.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got, want = found(search(t)), brute(ids, x)
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    assert recall(got, want) >= 0.95
    at = {int(i): v for i, v in zip(ids, x)}
    assert all(s == pytest.approx(at[q] @ at[i], abs=1e-12) for q, g in got.items() for i, s in g)


@pytest.mark.parametrize("spread", [0.3, 100.0])
def test_recall_of_50000(spark, spread):
    """At the query's own settings: vectors in clusters, where few lists are probed, and vectors without any."""
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(400, 32))[rnd.integers(0, 400, 50_000)] + spread * rnd.normal(size=(50_000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    import pyarrow as pa

    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(50_000)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = found(search(df.filter("vec_id % 20 <> 0 or vec_id % 1000 = 0"), every=1000))
    some = (np.arange(50_000) % 20 != 0) | (np.arange(50_000) % 1000 == 0)
    assert recall(got, brute(np.flatnonzero(some), x[some].astype(float), every=1000)) >= 0.9
    if spread < 1:
        from ledgerlake.llm.ivf_pq import Quantiser, lists_to_probe

        assert lists_to_probe(Quantiser(x[:20_000], 223, 32), x[:20_000], 20, 0.98) < 50


def test_hot_vector_blocks_and_norms(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(1500, 12)) * rnd.uniform(0.3, 3, size=(1500, 1))
    x[:500] = x[0]
    df = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(x)], "vec_id long, embedding array<double>, codes string")
    want = brute(np.arange(1500), x)
    got = found(search(df, block_rows=100, block_queries=5))
    assert recall(got, want) >= 0.9
    assert [i for i, _ in found(search(df, recall=1.0, lists=1, rerank=2000))[0]] == [i for i, _ in want[0]]


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, vector int"
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (3, [0.5, 0.5], 1), (4, None, 1), (5, [0.0, 0.0], 1), (40, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (10, [], 1)]
    got = found(search(spark.createDataFrame(rows, schema)))
    assert got == {0: [(20, 1.0), (3, 0.5)], 20: [(0, 1.0), (3, 0.5)]}
    assert search(spark.createDataFrame([], schema)).count() == 0
    assert found(search(spark.createDataFrame([(20, [1.0], 1)], schema))) == {}


def test_parts():
    assert top(np.array([[1.0, 3, 3, 2, 3]]), 2).tolist() == [[1, 2]]
    assert len(kmeans(np.ones((50, 3), np.float32), 8, 3, 1)) == 1


def test_rows_that_a_sample_does_not_show(spark):
    """Near copies that share their codes, far beyond what is reranked, and long vectors away from all others."""
    rnd = np.random.default_rng(12)
    x = np.concatenate([rnd.normal(size=(3, 16))[rnd.integers(0, 3, 4000)] + 1e-4 * rnd.normal(size=(4000, 16)), rnd.normal(size=(2000, 16)), 50 * rnd.normal(size=(40, 16))])
    x = x[rnd.permutation(len(x))]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = found(search(df)), brute(np.arange(len(x)), x)
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}


def test_queries_go_to_groups_of_lists(spark, monkeypatch):
    """Vectors without clusters ask nearly all lists: a query is a row a group and not a row a list, and matrices of rows and lists are cut."""
    from ledgerlake.llm import ivf_pq

    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(6000, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    settle, sizes = ivf_pq.settle, []

    def counted(table, what, free=False):
        out = settle(table, what, free)
        if what == "probes":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(ivf_pq, "settle", counted)
    got, want = found(search(df, block_rows=2000)), brute(np.arange(6000), x)
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}
    assert len(sizes) == 2 and max(sizes) <= 300 * 5  # 77 lists in some four groups
    monkeypatch.setattr(ivf_pq, "CELLS", 500)
    near, dist = ivf_pq.assign(x[:200].astype(np.float32), x[200:300].astype(np.float32))
    assert near.tolist() == [int(((x[200:300] - v) ** 2).sum(1).argmin()) for v in x[:200]]
