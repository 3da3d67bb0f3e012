"""Greatest Jaccard of items with the texts of a reference, whatever the threshold: what they share is counted block by block, no pair is written.

At a low threshold nearly every item shares one of its rarer tokens with nearly every text of the reference, so an index of tokens meets all pairs and
carries both sets along for each.  Here a slab of items, one row of hashes, meets a block of the reference, and only items' greatest similarities leave the
task.  The work is the number of (token of an item, text that holds it), a task holds one slab and one block.  Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sets of a slab or block, and what is counted of a slab at once.
SETS, COUNTED = 500, 1 << 22


def _packed(batches, names: tuple[str, str, str]):
    """A row for each SETS sets (id, s): their ids, sizes and tokens, one after the other."""
    for batch in batches:
        for at in range(0, batch.num_rows, SETS):
            rows = batch.slice(at, SETS)
            n = np.diff(rows.column("s").offsets.to_numpy()).astype(np.int32)
            tokens = rows.column("s").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column("id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array([n.tobytes()], pa.binary()), pa.array([tokens.tobytes()], pa.binary())], names=list(names))


def packed(sets: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", F.transform("s", lambda t: F.xxhash64(t)).alias("s")).mapInArrow(lambda batches: _packed(batches, names), f"{names[0]} array<{kind}>, {names[1]} binary, {names[2]} binary")


def greatest(n: np.ndarray, tokens: np.ndarray, m: np.ndarray, held: np.ndarray, least: float) -> np.ndarray:
    """Of each set its greatest Jaccard with a set of the block; 0 where none can reach `least`."""
    best = np.zeros(len(n))
    order = np.argsort(held, kind="stable")
    owner = np.repeat(np.arange(len(m)), m)[order]
    known, first, often = np.unique(held[order], return_index=True, return_counts=True)
    row = np.repeat(np.arange(len(n)), n)
    place = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    there = known[place] == tokens
    # a set shares at most its known tokens, and the union is never below its size
    some = (np.bincount(row[there], minlength=len(n)) >= least * n - 1e-6) & (n > 0)
    there &= some[row]
    row, place = row[there], place[there]
    chosen = np.flatnonzero(some)
    size = often[place]
    upto = np.concatenate([[0], np.cumsum(np.bincount(row, size, len(n))[chosen] + len(m))])
    begin = 0
    while begin < len(chosen):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + COUNTED, side="right")) - 1)
        low, high = np.searchsorted(row, [chosen[begin], chosen[end - 1] + 1])
        each = size[low:high]
        start = np.cumsum(each) - each
        texts = owner[np.repeat(first[place[low:high]] - start, each) + np.arange(each.sum())]
        at = np.repeat(np.searchsorted(chosen[begin:end], row[low:high]), each)
        shared = np.bincount(at * len(m) + texts, minlength=(end - begin) * len(m)).reshape(end - begin, len(m))
        best[chosen[begin:end]] = (shared / (n[chosen[begin:end], None] + m[None, :] - shared)).max(1)
        begin = end
    return best


def _met(batches, least: float):
    for batch in batches:
        for k in range(batch.num_rows):
            n, m = (np.frombuffer(batch.column(c)[k].as_py(), np.int32) for c in ("n", "m"))
            tokens, held = (np.frombuffer(batch.column(c)[k].as_py(), np.int64) for c in ("tokens", "held"))
            best = greatest(n, tokens, m, held, least)
            near = np.flatnonzero((best > 0) & (best >= least - 1e-6))
            yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values.take(pa.array(near)), pa.array(best[near])], names=["id", "j"])


def near_reference(sets: DataFrame, reference: DataFrame, least: float) -> DataFrame:
    """(id) of the sets (id, s) whose Jaccard with some set (id, s) of the reference is at least `least`; all sets are of distinct tokens, none of the reference is empty."""
    kind = sets.schema["id"].dataType.simpleString()
    slabs = packed(sets, ("ids", "n", "tokens"))
    blocks = packed(reference.coalesce(1), ("refs", "m", "held")).drop("refs")
    met = slabs.crossJoin(blocks).mapInArrow(lambda batches: _met(batches, least), f"id {kind}, j double")
    return met.filter(F.round("j", 9) >= least).select("id").distinct()
