import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from ledgerlake.llm.piece_lattice import decoded

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(k, text(rnd.randint(40, 200)) + ("\nShared footer line" if k % 3 == 0 else ""), "en", f"s{k % 3}") for k in range(150)]
    rows += [(200 + k, rows[k][1] + " tail", "en", "s0") for k in range(20)]
    rows += [(300, "junk*** " * 60, "en", "s1"), (301, "too short", "en", "s1"), (302, None, None, None)]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).cache()


def test_each_stage(spark, docs, tmp_path):
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, "").write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        a, b = {r.doc_id: r for r in before.collect()}, after.collect()
        if name == "quality_rules":
            assert set(a) - {r.doc_id for r in b} == {300, 301, 302}
        elif name == "line_dedup":
            assert len(b) == len(a) and not any("Shared footer line" in (r.text or "").split("\n") for r in b)
            assert all((r.text or "") == "\n".join(x for x in a[r.doc_id].text.split("\n") if x != "Shared footer line") for r in b if r.doc_id < 200)
        elif name == "near_duplicates":
            sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, r.text.split()) for i, r in a.items())}
            gone = {i for i in a if any(j < i and len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]) for j in a)}
            assert {r.doc_id for r in b} == set(a) - gone and gone
        elif name == "source_mix":
            total = sum(len(r.text.split()) for r in a.values())
            taken = defaultdict(int)
            for r in b:
                taken[r.doc_id] += len(r.text.split())
            assert abs(sum(taken.values()) - 1.5 * total) <= 3 * 128 and all(n <= 2 * len(a[i].text.split()) for i, n in taken.items())
        if k + 1 < len(corpus_pipeline.STAGES):
            assert after.columns == docs.columns
        before = after
    back = decoded(before.selectExpr("doc_id", "segmentations[0].pieces as p"), "doc_id", "p")
    want = sorted((r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "source_mix")).collect())
    assert sorted((r.id, r.text) for r in back.collect()) == want


def test_run_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "source_mix", "sentence_pieces"]
    assert corpus_pipeline.ORACLE_SQL is None and re.match("Corpus|The corpus", corpus_pipeline.__doc__)


def test_run_end_to_end(spark, docs, tmp_path):
    """Nulls in any column, repeated rows and ids, a text of a megabyte and columns named like the stages' own."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("klmnopqrst") for _ in range(rnd.randint(2, 9)))
    long = " ".join(word() for _ in range(170_000))
    base = [tuple(r) for r in docs.collect()]
    odd = [(400, long, "en", "s1", len(long)), (None, base[5][1] + " of nobody", "en", "s1", 9), (401, base[6][1] + " elsewhere", None, None, None), (402, "", "en", "s1", 0), (None, None, None, None, None)]
    rows = [(*r, "x", 1, True) for r in [*base, *odd, base[7], base[7], (base[8][0], base[9][1] + " under another id", "en", "s0", 1)]]
    spark.createDataFrame(rows, SCHEMA + ", pieces string, gone long, slab boolean").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert out.columns == ["doc_id", "n_pieces", "segmentations"]
    ids = {r.doc_id for r in got}
    assert len(long) > 1_000_000 and 400 in ids and not ids & {300, 301, 302, 402} and ids <= {r[0] for r in rows}
    words = defaultdict(set)
    for r in rows:
        words[r[0]] |= set((r[1] or "").split())
    for r in decoded(out.selectExpr("doc_id", "segmentations[0].pieces AS p"), "doc_id", "p").collect():
        assert "Shared footer line" not in r.text.split("\n") and set(r.text.split()) <= words[r.id]


def test_empty(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_last_stage_runs_the_whole_method(spark):
    """Viterbi alone finds the best segmentation; A-star backward gives the ones after it."""
    df = spark.createDataFrame([(1, "thantnteres ouening of internationalisation")], "doc_id long, text string")
    (row,) = corpus_pipeline.sentence_pieces(spark, df, "").collect()
    scores = [s.score for s in row.segmentations]
    assert len({tuple(s.pieces) for s in row.segmentations}) == 3 and scores == sorted(scores, reverse=True)
