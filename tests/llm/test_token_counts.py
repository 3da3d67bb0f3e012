import json
import random

import pytest
import regex

from ledgerlake.llm import token_counts as tc

SCHEMA = "doc_id long, text string, n_tokens int, n_bytes string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tc._file(tc.MODEL))


def texts():
    rng = random.Random(3)
    out = [None, "", " ", "\n", "  \n\n  x", "don't We'll 'tis I'd've", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "naïve œuvre — “quoted” 😀👩‍👩‍👧", "日本語のテキスト 12345678 ٣٤٥ Ⅷ ½", "\x00\x1c\x1d\x85\xa0 　end  ", "tab\tand\rreturn\x0b"]
    out += ["ᲊ \U000105c0 known", "\U00010940\U0001e6c0 ՘ newer letters ࢏", "\U00011de0\U00011de1 newer numbers"]
    out += ["x" * 50_000, "ab " * 500_000, " " * 3000 + "z", "é" * 20_000]
    alphabet = ["a", "b", " ", " ", "\n", "'", "s", "t", "1", "é", "×", "ª", "²", "…", "\xa0", "́", "Ж", "中", "😀", "-", "_", "the", " of", "ing"]
    return out + ["".join(rng.choices(alphabet, k=rng.randrange(1, 200))) for _ in range(400)]


def want(library, text):
    n = len(library.encode(text or "", add_special_tokens=False))
    return len((text or "").encode()), n, n > 1024


def test_against_the_library(spark, library):
    rows = [(k, t, 5, "x") for k, t in enumerate(texts())] + [(0, "again", 1, None), (None, "no id", 1, None)]
    got = sorted((tuple(r) for r in tc.token_counts(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == sorted(((i, *want(library, t)) for i, t, *_ in rows), key=repr)
    assert tc.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(docs).collect()}
    assert got == {r.doc_id: want(library, r.text) for r in docs.collect()}


def test_whole_tokens_are_one_token_in_any_place(library):
    """A whole token that is one pre-token counts one between other words too."""
    whole = tc.whole_tokens(tc._file(tc.MODEL))
    assert 49_000 < len(whole) <= 50_256 and "<|endoftext|>" not in whole
    words = [w for w in whole if regex.fullmatch(r" \p{L}+", w)]
    assert len(words) > 20_000
    text = "".join(words)
    assert len(library.encode(text, add_special_tokens=False)) == len(words) == tc.Counter(tc._file(tc.MODEL), tuple(whole), tc.newer_than_python())(text)


def test_bounded_memory(monkeypatch, library):
    monkeypatch.setattr(tc, "HELD", 10)
    count = tc.Counter(tc._file(tc.MODEL), tuple(tc.whole_tokens(tc._file(tc.MODEL))), tc.newer_than_python())
    text = " ".join(f"qzx{k}jvw" for k in range(1000))
    assert count(text) == want(library, text)[1] and len(count.counts) <= count.counts.most


@pytest.mark.parametrize("around", ["\n{}x", "\n{}1", "\n{}!"])
def test_letters_numbers_and_spaces_are_the_library_s(library, around):
    """Every code point of the first two planes falls into the same class, but for those that go to the library anyway."""
    newer = regex.compile(tc.newer_than_python())
    pattern = regex.compile(tc.PATTERN)
    points = [chr(c) for c in range(256, 0x20000) if not 0xD800 <= c < 0xE000]
    text = "".join(around.format(c) for c in points if not newer.match(c))
    assert [s for _, s in library.pre_tokenizer.pre_tokenize_str(text)] == [m.span() for m in pattern.finditer(text)]
    text = "".join(around.format(chr(c)) for c in range(256))
    assert [s for _, s in library.pre_tokenizer.pre_tokenize_str(text)] == [m.span() for m in tc.latin_pattern().finditer(text)]


def test_other_kinds_are_refused():
    spec = json.loads(tc._file(tc.MODEL))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        with pytest.raises(ValueError):
            tc.check_kind({**spec, **change})
