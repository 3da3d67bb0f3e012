"""Tokens of each text by a byte-level merge vocabulary, most of them without a merge.

Which strings of the vocabulary are one token by themselves is proved once, on the driver, by encoding every string of
the vocabulary with the library; the strings that come out as a single token are sent to the tasks (one entry a
vocabulary string at most).  A merge sees one pre-token at a time, so a pre-token of a text that is such a string is one token
wherever it stands, and is counted by a look-up.  Only other pre-tokens are merged, and a task remembers short ones.

Texts are split into pre-tokens by the vocabulary's own pattern.  Unicode versions of the pattern's engine and of the
library differ in letters and numbers that are newer than Python's own tables; a text that holds such a code point
is split by the library itself.  Strings of special tokens inside texts are taken as these tokens, the library's default.

Defined results: null and empty texts have no tokens; each row is answered by itself, so repeated ids and ties need no rule; an empty table
gives an empty result; other columns are not read.  Long texts are split in pieces of a bounded number of pre-tokens and read whole.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How pre-tokens are found where the vocabulary's pre-tokeniser uses the common byte-level pattern; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The classes of that pattern up to U+00FF, where letters, numbers and spaces do not change any more.
LATIN = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": "\t-\r \x85\xa0"}
MODEL = "byte_bpe_50k.json"
#: Merged pre-tokens that a task remembers, and the longest of them in code points.
HELD, HELD_CHARS = 400_000, 40
LONG = 1 << 20


def _file(model: str) -> str:
    """A name without a folder is one of the public tokenizers."""
    if "/" not in model:
        import public_tokenizers

        model = public_tokenizers.path(model)
    with open(model, encoding="utf-8") as f:
        return f.read()


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def latin_pattern() -> re.Pattern:
    """The pattern for texts without code points beyond U+00FF, for the plainer and faster engine."""
    letter, number, space = LATIN
    out = PATTERN.replace(rf"[^{space}{letter}{number}]", f"[^{''.join(LATIN.values())}]").replace(r"\S", f"[^{LATIN[space]}]")
    for name, members in LATIN.items():
        out = out.replace(name, f"[{members}]")
    return re.compile(out)


@lru_cache(1)
def newer_than_python() -> str:
    """A class of the letters and numbers that the pattern's engine knows and Python's own tables do not."""
    import regex

    ends: list[list[int]] = []
    for letter in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, range(256, sys.maxunicode + 1)))):
        if unicodedata.category(letter) == "Cn":
            if ends and ends[-1][1] == ord(letter) - 1:
                ends[-1][1] += 1
            else:
                ends.append([ord(letter)] * 2)
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ends) + "]" if ends else ""


def check_kind(spec: dict) -> list[str]:
    """The strings of the special tokens, the longest first; a vocabulary of another kind is refused."""
    pre = spec.get("pre_tokenizer") or {}
    plain = spec["model"].get("type") == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = spec.get("added_tokens") or []
    if not plain or spec["model"].get("dropout") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("not a plain byte-level merge vocabulary")
    return sorted((t["content"] for t in added), key=len, reverse=True)


def whole_tokens(spec_json: str) -> list[str]:
    """The vocabulary's strings that the library encodes as exactly one token, out of those that are text."""
    from tokenizers import Tokenizer

    letters = _byte_letters()
    special = set(check_kind(json.loads(spec_json)))
    library = Tokenizer.from_str(spec_json)
    texts = []
    for piece in library.get_vocab(with_added_tokens=False):
        try:
            texts.append(bytes(letters[c] for c in piece).decode())
        except (KeyError, UnicodeDecodeError):
            continue  # part of a code point: no pre-token
    texts = [t for t in texts if t and t not in special]
    return sorted(t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)) if len(e) == 1)


class Counts(dict):
    """Tokens of each pre-token: 1 for whole tokens, merged on first sight for others."""

    def __init__(self, whole: tuple[str, ...], model):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.model = whole, model
        self.letter = {b: c for c, b in _byte_letters().items()}
        self.most = len(self) + HELD

    def __missing__(self, word: str) -> int:
        n = len(self.model.tokenize("".join(map(self.letter.__getitem__, word.encode()))))
        if len(word) <= HELD_CHARS:
            if len(self) >= self.most:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[word] = n
        return n


class Counter:
    """Counts the tokens of texts in one task."""

    def __init__(self, spec_json: str, whole: tuple[str, ...], newer: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec_json)
        special = check_kind(json.loads(spec_json))
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.latin, self.unsure = latin_pattern(), re.compile(newer) if newer else None
        self.counts = Counts(whole, self.library.model)

    def _plain(self, text: str) -> int:
        try:
            text.encode("latin-1")
            pattern = self.latin
        except UnicodeEncodeError:
            if self.unsure and self.unsure.search(text):
                return sum(len(self.library.model.tokenize(word)) for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text))
            pattern = self.pattern
        tokens = self.counts.__getitem__
        if len(text) <= LONG:
            return sum(map(tokens, pattern.findall(text)))
        found, n = (m.group() for m in pattern.finditer(text)), 0
        while part := list(islice(found, 100_000)):
            n += sum(map(tokens, part))
        return n

    def __call__(self, text: str) -> int:
        if not self.special or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, filter(None, parts)))


@lru_cache(1)
def _counter(*what) -> Counter:
    """Kept by the worker for its next task."""
    return Counter(*what)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, limit: int = 1024) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than limit)."""
    spec = _file(model)
    sent = docs.sparkSession.sparkContext.broadcast((spec, tuple(whole_tokens(spec)), newer_than_python()))

    def run(batches):
        count = _counter(*sent.value)
        for b in batches:
            texts = b.column(1)
            n = pa.array([count(t.as_py() or "") for t in texts], pa.int64())
            size = pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n, pc.greater(n, pa.scalar(limit, pa.int64()))], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return thin.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
