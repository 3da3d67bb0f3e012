"""SentencePiece encoding and decoding with the N best segmentations of each text.

All segmentations of a text into pieces form a lattice; a segmentation's score is the sum of its pieces'
scores.  A forward Viterbi pass gives the best score from the begin to every node, and these scores are
the exact heuristic of a backward A-star search, which takes segmentations from the lattice in order of score.

No piece has a space after another character, so the lattice of a text falls apart at the begin of every
run of spaces (and around characters that no piece holds) into units that are segmented on their own.  Equal units of a chunk are
scored once, all of them in the same array operations, together with the gap between their best and
second-best score.  Of the N best segmentations of a whole text, those after the first differ from it only
in the N - 1 units with the smallest gaps; only for these the A-star search is run, and the N best sums of their
alternatives are taken in order.

The pieces are those of a public model; it is a merge model, whose scores are ranks of merges and not probabilities.  So each piece gets a unigram
score, the logarithm of its share of all pieces when the model's own encoder segments the whole corpus (one is added to each count): `piece_counts` sums
the counts over all documents, and the scores grow with the input as counts do.

Texts are encoded as SentencePiece's unigram encoder does it with these scores: a space is put in front, spaces count as
U+2581, a character without a piece of its own becomes byte pieces (score: 10 below the least piece).  Ties: the longer
last piece first.  A text that holds U+2581 itself comes back with spaces.

Defined results: null and empty texts have no pieces, score 0 and one segmentation; every text is encoded whole, and one long unit takes
time and memory in proportion to its length; repeated rows are each answered; an empty table gives an empty result; other columns are ignored or pass through `encoded`.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import TABLE, U, Chunk, _power, mix, parts_of, to_bytes

MODEL = "piece_bpe_32k.model"
CHUNK_BYTES = 500_000
_SPACE = "▁".encode()
#: Appended to a model, this sets add_dummy_prefix of its normalizer to false.
_NO_SPACE_IN_FRONT = b"\x1a\x02\x18\x00"


def _range_hash(total, down, begin, size: int):
    return mix((total[begin + size] - total[begin]) * down[begin] + U(size * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))


class Pieces:
    """The pieces of a model and what is needed to find them in bytes."""

    def __init__(self, proto: bytes, counts=None):
        """counts: how often each piece stands in the corpus; without them the model's own scores stand."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.text: list[bytes] = [b""] * n
        self.byte = np.zeros(256, np.int64)
        plain: dict[bytes, tuple[int, float]] = {}
        for k in range(n):
            if sp.is_byte(k):
                b = int(sp.id_to_piece(k)[3:5], 16)
                self.byte[b], self.text[k] = k, bytes([b])
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                t = sp.id_to_piece(k).encode().replace(_SPACE, b" ")
                self.text[k] = t
                plain.setdefault(t, (k, sp.get_score(k)))
        if counts is not None:
            whole = math.log(sum(int(counts[k]) for k, _ in plain.values()) + len(plain))
            plain = {t: (k, math.log(int(counts[k]) + 1) - whole) for t, (k, _) in plain.items()}
        self.plain = plain
        self.unknown = min((s for _, s in plain.values() if s > -1e8), default=0.0) - 10
        self.longest = max(map(len, plain), default=1)
        self.splits = not any(b" " in t.lstrip(b" ") for t in plain)
        held = set(b"".join(plain))
        self.lone = np.array([b < 128 and b not in held for b in range(256)])
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.text) + b"\0", np.uint8)
        keys = list(plain)
        h = self._hash(keys)
        order = np.argsort(h)
        self.hash, self.id = h[order], np.array([plain[keys[k]][0] for k in order], np.int64)
        self.score = np.array([plain[keys[k]][1] for k in order], float)
        self.start_map = np.zeros(1 << 22, bool)
        prefixes = list({t[:k] for t in keys for k in range(1, len(t) + 1)})
        self.start_map[self._slot(self._hash(prefixes))] = True

    @staticmethod
    def _slot(h):
        return (h >> U(42)).astype(np.int64)

    @staticmethod
    def _hash(strings: list[bytes]):
        c = Chunk(strings)
        return c.hashes(c.starts[:-1], c.starts[1:] - 1)

    def decode(self, ids) -> bytes:
        out = b"".join(self.text[k] for k in ids)
        return out[1:] if out[:1] == b" " else out

    def edges_into(self, unit: bytes):
        """For each position of a unit: (begin, id or -1, score) of the edges that end there."""
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(len(unit) + 1)]
        for a in range(len(unit)):
            if unit[a] & 0xC0 == 0x80:
                continue
            wide = 1
            while a + wide < len(unit) and unit[a + wide] & 0xC0 == 0x80:
                wide += 1
            for b in range(a + 1, min(len(unit), a + self.longest) + 1):
                if found := self.plain.get(unit[a:b]):
                    into[b].append((a, *found))
            if unit[a : a + wide] not in self.plain:
                into[a + wide].append((a, -1, self.unknown))
        return into

    def n_best(self, unit: bytes, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a unit: Viterbi forward, A-star backward."""
        if len(unit) > 200:  # edges as arrays, which long units need
            u = _Units(self, np.frombuffer(unit, np.uint8), np.array([0, len(unit)]))
            ends = np.searchsorted(u.end, np.arange(len(unit) + 2))
            alpha = u.best_at
            edges = lambda at: zip(*(x[ends[at] : ends[at + 1]].tolist() for x in (u.begin, u.ids, u.score)))
        else:
            into = self.edges_into(unit)
            alpha = [0.0] + [-np.inf] * len(unit)
            for b in range(1, len(unit) + 1):
                for a, _, s in into[b]:
                    alpha[b] = max(alpha[b], alpha[a] + s)
            edges = into.__getitem__
        # What a path loses against the best one is the sum of what each edge loses at its end, which is exactly 0 along the best:
        # ties are followed to the begin one after the other.  A path is a chain of (begin, end, id, the rest of the path),
        # so that a step costs the same wherever it is taken.
        agenda, turn, out = [(0.0, len(unit), 0, None)], 0, []
        while agenda and len(out) < n:
            loss, at, _, path = heapq.heappop(agenda)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    a, b, k, path = path
                    ids += [k] if k >= 0 else [int(self.byte[x]) for x in unit[a:b]]
                out.append((float(alpha[len(unit)]) - loss, tuple(ids)))
                continue
            for a, k, s in sorted(edges(at)):
                turn += 1
                heapq.heappush(agenda, (loss + float(alpha[at]) - (float(alpha[a]) + s), a, turn, (a, at, k, path)))
        return out


@lru_cache(maxsize=1)
def pieces_of(proto: bytes, counts: bytes | None = None) -> Pieces:
    return Pieces(proto, None if counts is None else np.frombuffer(counts, np.int64))


class _Units:
    """Best and second-best segmentation of many distinct units at once."""

    def __init__(self, p: Pieces, data, starts):
        self.p, self.data, self.starts = p, data, starts
        n, units = len(data), len(starts) - 1
        self.unit = np.repeat(np.arange(units, dtype=np.int32), np.diff(starts))
        total = np.concatenate([np.zeros(1, U), np.cumsum(TABLE[data] * _power("up", 0x9E3779B97F4A7C15, n)[:n], dtype=U)])
        down = _power("down", pow(0x9E3779B97F4A7C15, -1, 1 << 64), n + 1)
        head = (data & 0xC0) != 0x80
        at = np.flatnonzero(head)
        end = starts[1:][self.unit]
        wide = np.diff(np.append(at, n))
        lone = np.ones(n, bool)
        found = []
        for size in range(1, p.longest + 1):
            at = at[at + size <= end[at]]
            if not len(at):
                break
            h = _range_hash(total, down, at, size)
            live = p.start_map[p._slot(h)]
            at, h = at[live], h[live]
            k = np.minimum(np.searchsorted(p.hash, h), len(p.hash) - 1)
            hit = p.hash[k] == h
            found.append((at[hit], at[hit] + size, p.id[k[hit]], p.score[k[hit]]))
        at = np.flatnonzero(head)
        for a, b, _, _ in found:
            own = np.searchsorted(at, a)
            lone[a[wide[own] == b - a]] = False
        alone = lone[at]
        found.append((at[alone], (at + wide)[alone], np.full(alone.sum(), -1), np.full(alone.sum(), p.unknown)))
        begin, end, ids = (np.concatenate([f[k] for f in found]).astype(np.int32) for k in range(3))
        score = np.concatenate([f[3] for f in found])
        del found, total, h, live, k, hit
        u = self.unit[begin]
        tail = end + u  # node numbers: a unit has one node more than bytes
        depth = end - starts.astype(np.int32)[u]
        order = np.lexsort((begin, tail, depth))
        self.begin, self.end, self.ids, score, u, tail, depth = (x[order] for x in (begin, end, ids, score, u, tail, depth))
        source = self.begin + u
        best, second = np.full(n + units, -np.inf), np.full(n + units, -np.inf)
        best[starts[:-1] + np.arange(units)] = 0.0
        self.chosen = np.full(n + units, -1)
        group = np.flatnonzero(np.concatenate([[True], tail[1:] != tail[:-1]])) if len(tail) else np.zeros(0, np.int64)
        level = np.flatnonzero(np.concatenate([[True], np.diff(depth[group]) != 0])) if len(group) else group
        bounds = np.append(group, len(tail))
        for g0, g1 in zip(level, np.append(level[1:], len(group))):
            a, b = bounds[g0], bounds[g1]
            cut = group[g0:g1] - a
            s, t = source[a:b], tail[group[g0:g1]]
            cand = best[s] + score[a:b]
            top = np.maximum.reduceat(cand, cut)
            size = np.diff(np.append(cut, b - a))
            is_top = np.flatnonzero(cand == np.repeat(top, size))
            which = np.repeat(np.arange(len(cut)), size)[is_top]
            pick = is_top[np.concatenate([[True], which[1:] != which[:-1]])]
            best[t] = top
            self.chosen[t] = a + pick
            cand[pick] = -np.inf
            second[t] = np.maximum.reduceat(np.maximum(cand, second[s] + score[a:b]), cut)
        last = starts[1:] + np.arange(units)
        self.best_at, self.score = best, score
        self.best, self.gap = best[last], best[last] - second[last]
        # back along the chosen edges, all units together
        now, live, steps = last.copy(), np.arange(units), []
        while len(live):
            e = self.chosen[now]
            steps.append((live, e))
            a = self.begin[e]
            more = a > starts[live]
            live, now = live[more], (a + live)[more]
        unit = np.concatenate([x for x, _ in steps]) if steps else np.zeros(0, np.int64)
        edge = np.concatenate([x for _, x in steps]) if steps else np.zeros(0, np.int64)
        order = np.lexsort((self.begin[edge], unit))
        unit, edge = unit[order], edge[order]
        width = np.where(self.ids[edge] < 0, self.end[edge] - self.begin[edge], 1)
        flat = np.repeat(self.ids[edge], width)
        inner = np.arange(len(flat)) - np.repeat(np.cumsum(width) - width, width)
        raw = flat < 0
        flat[raw] = p.byte[data[(np.repeat(self.begin[edge], width) + inner)[raw]]]
        self.flat = flat
        self.count = np.bincount(np.repeat(unit, width), minlength=units)
        self.first = np.cumsum(self.count) - self.count


def _gather(first, count):
    """Indices first[k] .. first[k] + count[k] - 1, one after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Encoded:
    """Segmentations of the documents of one chunk."""

    def __init__(self, p: Pieces, texts: list[bytes], n: int):
        self.p, self.n, self.texts = p, n, texts
        docs = [b" " + t.replace(_SPACE, b" ") if t else b"" for t in texts]
        size = np.array([len(d) for d in docs], np.int64)
        self.doc_starts = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(docs), np.uint8)
        self.data = data
        if not len(data):
            self.doc_ids = np.zeros(len(docs) + 1, np.int64)
            self.ids, self.occ_doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        begin, end, first, self.kind = _units_of(p, data, self.doc_starts)
        width = (end - begin)[first]
        self.units = _Units(p, data[_gather(begin[first], width)], np.concatenate([[0], np.cumsum(width)]))
        self.begin, self.end = begin, end
        self.occ_doc = np.searchsorted(self.doc_starts, begin, side="right") - 1
        count = self.units.count[self.kind]
        self.ids = self.units.flat[_gather(self.units.first[self.kind], count)]
        self.occ_ids = np.concatenate([[0], np.cumsum(count)])
        per_doc = np.bincount(self.occ_doc, count, minlength=len(docs)).astype(np.int64)
        self.doc_ids = np.concatenate([[0], np.cumsum(per_doc)])

    def scores(self):
        if not len(self.occ_doc):
            return np.zeros(len(self.texts))
        return np.bincount(self.occ_doc, self.units.best[self.kind], minlength=len(self.texts))

    def _narrow(self) -> list[list[int]]:
        """For each document the n - 1 occurrences of units with the smallest gaps, in the order of the text."""
        out: list[list[int]] = [[] for _ in self.texts]
        if not len(self.occ_doc):
            return out
        gap = self.units.gap[self.kind].copy()
        at = np.flatnonzero(np.concatenate([[True], self.occ_doc[1:] != self.occ_doc[:-1]]))
        size = np.diff(np.append(at, len(gap)))
        which = np.repeat(np.arange(len(at)), size)
        for _ in range(self.n - 1):
            low = np.minimum.reduceat(gap, at)
            hit = np.flatnonzero((gap == low[which]) & np.isfinite(gap))
            if not len(hit):
                break
            hit = hit[np.concatenate([[True], which[hit][1:] != which[hit][:-1]])]
            for k in hit.tolist():
                out[self.occ_doc[k]].append(k)
            gap[hit] = np.inf
        return [sorted(x) for x in out]

    def alternatives(self):
        """For each document its n best as (score below the best, {occurrence: ids})."""
        cache: dict[int, list] = {}
        data = self.units.data if len(self.occ_doc) else None
        out = []
        for chosen in self._narrow():
            lists = []
            for k in chosen:
                u = int(self.kind[k])
                if u not in cache:
                    cache[u] = _cached_n_best(self.p, data[self.units.starts[u] : self.units.starts[u + 1]].tobytes(), self.n)
                lists.append(cache[u])
            agenda, seen, found = [(0.0, (0,) * len(lists))], {(0,) * len(lists)}, []
            while agenda and len(found) < self.n:
                less, at = heapq.heappop(agenda)
                found.append((less, {chosen[k]: lists[k][x][1] for k, x in enumerate(at) if x}))
                for k, x in enumerate(at):
                    if x + 1 < len(lists[k]):
                        then = (*at[:k], x + 1, *at[k + 1 :])
                        if then not in seen:
                            seen.add(then)
                            heapq.heappush(agenda, (less + lists[k][x][0] - lists[k][x + 1][0], then))
            out.append(found)
        return out

    def segmentation(self, doc: int, changed: dict):
        """The ids of a document with some units segmented otherwise."""
        out, at = [], int(self.doc_ids[doc])
        for k in sorted(changed):
            out += [self.ids[at : self.occ_ids[k]], np.array(changed[k], self.ids.dtype)]
            at = int(self.occ_ids[k + 1])
        return np.concatenate([*out, self.ids[at : self.doc_ids[doc + 1]]])

    def decodes(self, changed: dict) -> bool:
        """Whether units that are segmented otherwise decode to what they are; the other units are those of the best segmentation."""
        return all(b"".join(self.p.text[x] for x in ids) == self.data[self.begin[k] : self.end[k]].tobytes() for k, ids in changed.items())

    def round_trips(self) -> list[bool]:
        """Whether the pieces of each document decode to its text."""
        size = self.p.size[self.ids]
        back = self.p.flat[_gather(self.p.first[self.ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[self.doc_ids]
        return [back[a + 1 : b] == t if t else a == b for a, b, t in zip(ends[:-1].tolist(), ends[1:].tolist(), self.texts)]


_BEST: dict[tuple[bytes, int], list] = {}


def _cached_n_best(p: Pieces, unit: bytes, n: int) -> list:
    if len(unit) > 200:
        return p.n_best(unit, n)
    if (unit, n) not in _BEST:
        if len(_BEST) > 20_000:
            _BEST.clear()
        _BEST[unit, n] = p.n_best(unit, n)
    return _BEST[unit, n]


def _chunks(batches, column: int):
    for b in parts_of(batches):
        texts = to_bytes(b.column(column))
        first = held = 0
        for k, t in enumerate(texts):
            if held and held + len(t) > CHUNK_BYTES:
                yield b.slice(first, k - first), texts[first:k]
                first, held = k, 0
            held += len(t) + 1
        if first < len(texts):
            yield b.slice(first), texts[first:]


def _proto(model: str) -> bytes:
    """The model's bytes, a few hundred kilobytes, read once on the driver; a name without a folder is one of the public tokenizers."""
    if "/" not in model:
        import public_tokenizers

        model = public_tokenizers.path(model)
    with open(model, "rb") as f:
        return f.read()


def _units_of(p: Pieces, data, doc_starts):
    """Where the units of some documents begin and end, and a number for each that equal units share, with the first of each."""
    cut = np.zeros(len(data), bool)
    if p.splits:
        space = data == 32
        cut[1:] = space[1:] & ~space[:-1]
    lone = p.lone[data]
    cut |= lone
    cut[1:] |= lone[:-1]
    cut[doc_starts[:-1][np.diff(doc_starts) > 0]] = True
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(data))
    total = np.concatenate([np.zeros(1, U), np.cumsum(TABLE[data] * _power("up", 0x9E3779B97F4A7C15, len(data))[: len(data)], dtype=U)])
    h = mix((total[end] - total[begin]) * _power("down", pow(0x9E3779B97F4A7C15, -1, 1 << 64), len(data) + 1)[begin] + (end - begin).astype(U) * U(0xD6E8FEB86659FD93))
    _, first, kind = np.unique(h, return_index=True, return_inverse=True)
    return begin, end, first, kind


def piece_counts(docs: DataFrame, text_col: str = "text", model: str = MODEL, held: int = 100_000):
    """How often each piece stands in all documents by the model's own encoder; equal units of a task are encoded once."""
    import sentencepiece

    proto = _proto(model)
    sent = docs.sparkSession.sparkContext.broadcast(proto)

    def run(batches):
        sp = sentencepiece.SentencePieceProcessor(model_proto=sent.value + _NO_SPACE_IN_FRONT)  # the units have it
        p = pieces_of(sent.value)
        total = np.zeros(sp.get_piece_size(), np.int64)
        found: dict[bytes, int] = {}

        def encode():
            ids = sp.encode([u.decode("utf-8", "replace") for u in found], num_threads=1)
            times = np.repeat(np.fromiter(found.values(), np.int64), np.fromiter(map(len, ids), np.int64))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, len(times))
            total[:] += np.bincount(flat, times, len(total)).astype(np.int64)  # sums of whole numbers, exact below 2^53
            found.clear()

        for _, texts in _chunks(batches, 0):
            whole = [b" " + t.replace(_SPACE, b" ") if t else b"" for t in texts]
            joined = b"".join(whole)
            if not joined:
                continue
            begin, end, first, kind = _units_of(p, np.frombuffer(joined, np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in whole])]))
            for a, b, n in zip(begin[first].tolist(), end[first].tolist(), np.bincount(kind).tolist()):
                u = joined[a:b]
                found[u] = found.get(u, 0) + n
            if len(found) > held:
                encode()
        encode()
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], names=["piece", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # at most a row a piece
    out = np.zeros(sentencepiece.SentencePieceProcessor(model_proto=proto).get_piece_size(), np.int64)
    for r in rows:
        out[r.piece] = r.n
    return out


def _sent(docs: DataFrame, text_col: str, model: str, counts):
    counts = piece_counts(docs, text_col, model) if counts is None else counts
    return docs.sparkSession.sparkContext.broadcast((_proto(model), np.asarray(counts, np.int64).tobytes()))


def segment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, model: str = MODEL, counts=None) -> DataFrame:
    """Per document: doc_id, n_pieces, pieces_sha256 (of the ids as little-endian uint32), score, best_scores (up to n, best first), best_sha256 (of each of them), round_trip (of all)."""
    if n < 1:
        raise ValueError("n must be at least 1")
    sent = _sent(docs, text_col, model, counts)

    def run(batches):
        p = pieces_of(*sent.value)
        _BEST.clear()  # of other scores, where a task of this worker did not end
        for rows, texts in _chunks(batches, 1):
            e = Encoded(p, texts, n)
            score = e.scores()
            best, digests, fine = [], [], e.round_trips()
            for doc, found in enumerate(e.alternatives()):
                each = [e.segmentation(doc, changed) for _, changed in found]
                best.append([float(score[doc]) - less for less, _ in found])
                digests.append([hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in each])
                fine[doc] = fine[doc] and all(e.decodes(changed) for _, changed in found)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(e.doc_ids)), pa.array([x[0] for x in digests]), pa.array(score), pa.array(best, pa.list_(pa.float64())), pa.array(digests, pa.list_(pa.string())), pa.array(fine)],
                names=["doc_id", "n_pieces", "pieces_sha256", "score", "best_scores", "best_sha256", "round_trip"],
            )
        _BEST.clear()  # the worker lives on

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return thin.mapInArrow(run, "doc_id long, n_pieces long, pieces_sha256 string, score double, best_scores array<double>, best_sha256 array<string>, round_trip boolean")


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 1, model: str = MODEL, counts=None) -> DataFrame:
    """doc_id, n_pieces and segmentations: up to n arrays of ids with their scores, best first."""
    sent = _sent(docs, text_col, model, counts)
    kind = pa.list_(pa.struct([("score", pa.float64()), ("pieces", pa.list_(pa.int32()))]))

    def run(batches):
        p = pieces_of(*sent.value)
        _BEST.clear()  # of other scores, where a task of this worker did not end
        for rows, texts in _chunks(batches, 1):
            e = Encoded(p, texts, n)
            found = e.alternatives()
            each = [e.segmentation(doc, changed) for doc, ways in enumerate(found) for _, changed in ways]
            less = np.array([x for ways in found for x, _ in ways], float)
            ways = np.array([len(x) for x in found], np.int64)
            ends = np.cumsum([0, *map(len, each)])
            pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *each]), pa.int32()))
            one = pa.StructArray.from_arrays([pa.array(np.repeat(e.scores(), ways) - less), pieces], fields=list(kind.value_type))
            out = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *ways]), pa.int32()), one)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(e.doc_ids)), out.cast(kind)], names=["doc_id", "n_pieces", "segmentations"])
        _BEST.clear()  # the worker lives on

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return thin.mapInArrow(run, "doc_id long, n_pieces long, segmentations array<struct<score: double, pieces: array<int>>>")


def decoded(rows: DataFrame, id_col: str, pieces_col: str, model: str = MODEL) -> DataFrame:
    """id and text of arrays of ids; null gives null."""
    proto = rows.sparkSession.sparkContext.broadcast(_proto(model))

    def run(batches):
        p = pieces_of(proto.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else p.decode(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    thin = rows.select(F.col(id_col).cast("long").alias("id"), F.col(pieces_col).alias("pieces"))
    return thin.mapInArrow(run, "id long, text string")
