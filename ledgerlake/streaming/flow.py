"""Streams: landing with de-duplication, keyed upserts, a circuit breaker and a rate gate as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.relational import upsert


def land(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """First copy of each key within the time that state is held."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def upsert_batch(path: str, key: str):
    """foreachBatch function: rows whose key is new are appended; a batch that is run twice adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates([key])
        try:
            have = spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            have = None
        (batch if have is None else batch.join(have.select(key), key, "left_anti")).write.mode("append").parquet(path)

    return write


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return upsert(old, new, key)


def breaker_step(state: tuple, ok: bool, t: float, window: int = 30, least: int = 10, share: float = 0.5, rest: float = 30.0) -> tuple:
    """Next (mode, recent outcomes, opened at) of a circuit breaker after one outcome at second t.

    closed -> open when at least `least` of the last `window` outcomes are known and `share` failed; open -> half after `rest`
    seconds; the next outcome closes or opens it.
    """
    mode, recent, opened = state
    if mode == "open" and t - opened >= rest:
        mode = "half"
    if mode == "half":
        return ("closed", [], opened) if ok else ("open", [], t)
    if mode == "open":
        return mode, recent, opened
    recent = [*recent, ok][-window:]
    if len(recent) >= least and recent.count(False) >= share * len(recent):
        return "open", [], t
    return "closed", recent, opened


GATE_START = (160.0, [], None, None)


def gate_step(state: tuple, t: float, limited: bool, ceiling: float = 200.0, floor: float = 32.0, span: float = 60.0, worst: float = 0.05, least: int = 20, calm: float = 30.0) -> tuple:
    """Next (allowed, attempts of the last `span` seconds, last change, last cut) of a gate after one attempt.

    Cut by a fifth where more than the share `worst` of at least `least` attempts was limited, at most once in half a span, and the attempts start anew;
    grow by a tenth after `calm` seconds without a change, unless that many attempts say otherwise.
    """
    allowed, tries, changed, cut = state
    changed = t if changed is None else changed
    tries = [*(x for x in tries if t - x[0] <= span), (t, limited)]
    known, rate = len(tries) >= least, sum(x[1] for x in tries) / len(tries)
    if known and rate > worst and allowed > floor and (cut is None or t - cut >= span / 2):
        return max(floor, allowed * 0.8), [], t, t
    if allowed < ceiling and t - changed >= calm and not (known and rate > worst):
        return min(ceiling, allowed * 1.1), tries, t, cut
    return allowed, tries, changed, cut


def breaker(events: DataFrame, key: str = "key", ok: str = "ok", time: str = "ts", seq: str = "event_id") -> DataFrame:
    """(key, event_id, mode) after each event, exact by count of events; events of a batch are taken in order of time and id."""

    def run(k, parts: Iterator[pd.DataFrame], state: GroupState):
        mode, recent, opened = state.get if state.exists else ("closed", [], 0.0)
        now = (mode, [bool(x) for x in recent], opened)
        rows = pd.concat(list(parts)).sort_values([time, seq])
        out = []
        for t, o, s in zip(rows[time], rows[ok], rows[seq]):
            now = breaker_step(now, bool(o), t.timestamp())
            out.append((k[0], s, now[0]))
        state.update((now[0], [bool(x) for x in now[1]], float(now[2])))
        yield pd.DataFrame(out, columns=["key", "event_id", "mode"])

    return events.groupBy(key).applyInPandasWithState(run, "key string, event_id long, mode string", "mode string, recent array<boolean>, opened double", "append", GroupStateTimeout.NoTimeout)


def breaker_batch(events: DataFrame, key: str = "key", ok: str = "ok", time: str = "ts", seq: str = "event_id") -> DataFrame:
    """breaker() over a table that is at rest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        now, out = ("closed", [], 0.0), []
        for k, t, o, s in pdf.sort_values([time, seq])[[key, time, ok, seq]].itertuples(index=False):
            now = breaker_step(now, bool(o), t.timestamp())
            out.append((k, s, now[0]))
        return pd.DataFrame(out, columns=["key", "event_id", "mode"])

    return events.groupBy(key).applyInPandas(run, "key string, event_id long, mode string")


def gate_batch(events: DataFrame, key: str, limited: str, time: str, seq: str) -> DataFrame:
    """(key, event_id, allowed) of the rate gate after each attempt."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        now, out = GATE_START, []
        for k, t, x, s in pdf.sort_values([time, seq])[[key, time, limited, seq]].itertuples(index=False):
            now = gate_step(now, t.timestamp(), bool(x))
            out.append((k, s, now[0]))
        return pd.DataFrame(out, columns=["key", "event_id", "allowed"])

    return events.groupBy(key).applyInPandas(run, "key string, event_id long, allowed double")


def limited_share(events: DataFrame, time: str = "ts", limited: str = "limited", span: str = "60 seconds", slide: str = "15 seconds", late: str = "2 minutes") -> DataFrame:
    """(start, attempts, limited) in sliding windows; on a stream, late events within `late` still count."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    w = marked.groupBy(F.window(time, span, slide).alias("w")).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col(limited)).alias("limited"))
    return w.select(F.col("w.start").alias("start"), "attempts", "limited")
