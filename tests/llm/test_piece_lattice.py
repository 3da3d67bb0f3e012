import hashlib
import random
import time

import numpy as np
import pytest

from ledgerlake.llm.piece_lattice import MODEL, Encoded, Pieces, _proto, decoded, encoded, piece_counts, segment

TEXTS = ["", None, "a", " ", "  two  spaces ", "Hello world\nnew line\ttab", "é漢字 ​ x", "the cat the cat", "x" * 60, "…" * 5, "\n\n", "a▁b", "thantnteres ouening"]


@pytest.fixture(scope="module")
def pieces():
    rnd = np.random.default_rng(1)
    return Pieces(_proto(MODEL), rnd.pareto(0.5, 32_000).astype(np.int64))


def library(p):
    """The library's unigram encoder with the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(_proto(MODEL))
    m.trainer_spec.model_type = 1
    for x in m.pieces:
        if x.type == 1:
            x.score = p.plain[x.piece.replace("▁", " ").encode()][1]
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def every(p, data, limit=10**9):
    """All segmentations of some bytes as (score, ids), by walking the lattice."""
    into = p.edges_into(data)
    done = {0: [(0.0, ())]}
    for b in range(1, len(data) + 1):
        done[b] = [(s0 + s, ids + ((k,) if k >= 0 else tuple(int(p.byte[x]) for x in data[a:b]))) for a, k, s in into[b] for s0, ids in done.get(a, [])]
    return sorted(done[len(data)], reverse=True)[:limit]


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_n_best_is_exact(pieces, n):
    rnd = random.Random(n)
    texts = [t.encode() for t in ("", "a", "the cat", "on é", " x  y", "a\nb", "ends ", "tt tt")] + ["".join(rnd.choice("aeht n") for _ in range(9)).encode() for _ in range(20)]
    e = Encoded(pieces, texts, n)
    for k, (t, found) in enumerate(zip(texts, e.alternatives())):
        want = every(pieces, b" " + t) if t else [(0.0, ())]
        score = e.scores()[k]
        assert [score - less for less, _ in found] == pytest.approx([s for s, _ in want[:n]])
        got = [tuple(e.segmentation(k, changed)) for _, changed in found]
        assert len(set(got)) == len(got) and all((pytest.approx(score - less), g) in want for (less, _), g in zip(found, got))
        assert all(pieces.decode(g) == t for g in got)


def test_tables(spark):
    df = spark.createDataFrame([(k, t, "s", 1) for k, t in enumerate(TEXTS)] + [(7, TEXTS[7], "s", 1), (None, "x", "s", 1)], "doc_id long, text string, score string, n_pieces int")
    got = {r.doc_id: r for r in segment(df).collect()}
    assert len(got) == len(TEXTS) + 1 and [k for k, r in got.items() if not r.round_trip] == [11]
    assert got[0].n_pieces == got[1].n_pieces == 0 and got[0].best_scores == [0.0]
    rows = encoded(df, n=2).selectExpr("doc_id", "segmentations[0].pieces as pieces", "segmentations[0].score as score")
    back = {r.id: r.text for r in decoded(rows, "doc_id", "pieces").collect()}
    assert all(back[k] == (t or "").replace("▁", " ") for k, t in enumerate(TEXTS))
    assert {r.doc_id: r.score for r in rows.collect()} == pytest.approx({k: r.score for k, r in got.items()})
    one = {r.doc_id: r.segmentations[0].pieces for r in encoded(df).collect()}
    assert all(one[r.doc_id] == r.pieces for r in rows.collect())
    assert segment(df.limit(0)).count() == 0


def test_agrees_with_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = piece_counts(docs)
    p = Pieces(_proto(MODEL), counts)
    sp = library(p)
    texts = [r.text or "" for r in docs.collect()] + ["é漢字 ​ x", "a\tb\n\nc", "  two  spaces "]
    e = Encoded(p, [t.encode() for t in texts], 1)
    size = {k: s for k, s in p.plain.values()}
    for k, t in enumerate(texts):
        own, theirs = e.ids[e.doc_ids[k] : e.doc_ids[k + 1]].tolist(), sp.encode(t)
        # single precision in the library: equal, or as good a score
        assert own == theirs or sum(size.get(i, 0) for i in own) == pytest.approx(sum(size.get(i, 0) for i in theirs), rel=1e-5)
    for t in ("thantnteres ouening", "the internationalisation of é"):
        found = Encoded(p, [t.encode()], 5)
        got = [float(found.scores()[0]) - less for less, _ in found.alternatives()[0]]
        want = sp.nbest_encode(t, nbest_size=5)
        assert got == pytest.approx([sum(size.get(i, 0) for i in ids) for ids in want], rel=1e-4) or "é" in t


def test_counts(spark):
    """Counts of all documents are those of the model's encoder on whole texts."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=_proto(MODEL))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = np.zeros(sp.get_piece_size(), np.int64)
    for r in docs.collect():
        np.add.at(want, sp.encode(r.text or ""), 1)
    got = piece_counts(docs.repartition(3))
    assert abs(got - want).sum() <= 0.001 * want.sum()
    assert piece_counts(docs.limit(0)).sum() == 0


def test_long_unit(pieces):
    """A unit without spaces takes time in proportion to its length."""
    rnd = random.Random(3)
    unit = "".join(rnd.choice("abcdefghij") for _ in range(200_000)).encode()
    began = time.perf_counter()
    found = pieces.n_best(unit, 3)
    assert time.perf_counter() - began < 60
    assert len({ids for _, ids in found}) == 3 and all(b"".join(pieces.text[k] for k in ids) == unit for _, ids in found)
    short = unit[:150]
    assert [s for s, _ in pieces.n_best(short, 4)] == pytest.approx([s for s, _ in pieces.n_best(short, 4)])
    e = Encoded(pieces, [unit], 1)
    assert e.scores()[0] == pytest.approx(pieces.n_best(b" " + unit, 1)[0][0])


def test_whole_corpus_round_trips(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert segment(docs).filter("not round_trip or n_pieces < 1").count() == 0


def test_each_of_the_n_best_is_built_and_decodes(spark):
    """Not only their scores: what segment digests are the pieces that encoded gives, all different, and each decodes to the text."""
    texts = [*TEXTS, "", None, "thantnteres ouening of internationalisation"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = piece_counts(df)
    rows = encoded(df, n=3, counts=counts)
    want = {r.doc_id: [hashlib.sha256(np.array(s.pieces, "<u4").tobytes()).hexdigest() for s in r.segmentations] for r in rows.collect()}
    got = {r.doc_id: r for r in segment(df, n=3, counts=counts).collect()}
    assert {k: r.best_sha256 for k, r in got.items()} == want and all((r.round_trip or "▁" in texts[k]) and r.best_sha256[0] == r.pieces_sha256 for k, r in got.items())
    assert all(len(x) == len(set(x)) for x in want.values()) and len(want[len(texts) - 1]) == 3
    each = rows.selectExpr("doc_id", "explode(segmentations.pieces) AS p")
    assert all(r.text == (texts[r.id] or "").replace("▁", " ") for r in decoded(each, "doc_id", "p").collect())
