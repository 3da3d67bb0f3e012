"""The evidence ledger of posts as keyed state of a stream, and verdicts that go stale.

Both run with the RocksDB state store, which `with_state_store` sets: transformWithState keeps map, list and value states there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import STEPPED, in_order, play

COLUMNS = [c.split()[0] for c in STEPPED.split(", ")]


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LedgerProcessor(StatefulProcessor):
    """Map of claim to status, the last whole round, and the list of claims that a refusal reopened."""

    def __init__(self, code_bar: bool = True):
        self.code_bar = code_bar

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ledger = handle.getMapState("ledger", "claim_id int", "status string")
        self.last = handle.getValueState("last", "round int")
        self.reopened = handle.getListState("reopened", "claim_id int, round int")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for cid, status in zip(initialState["claim_id"], initialState["status"]):
            self.ledger.updateValue((int(cid),), (status,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        new = [r for r in in_order(pd.concat(list(rows))) if last is None or r["round"] > last]
        if not new:
            return  # rounds that are known already
        ledger = {k[0]: v[0] for k, v in self.ledger.iterator()} if self.ledger.exists() else {}
        out = play(new, ledger, self.code_bar)
        for cid, status in ledger.items():
            self.ledger.updateValue((cid,), (status,))
        again = [(r[3], int(r[1])) for r in out if r[6]]
        if again:
            self.reopened.appendList(again)
        self.last.update((int(max(r["round"] for r in new)),))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def ledger_stream(steps: DataFrame, initial: DataFrame | None = None, code_bar: bool = True) -> DataFrame:
    """`transitions` over a stream whose batches hold whole rounds; rounds that come again are passed over.

    initial: post_id, claim_id, status of ledgers that were begun before.
    """
    return steps.groupBy("post_id").transformWithStateInPandas(
        LedgerProcessor(code_bar), outputStructType=STEPPED, outputMode="Append", timeMode="None", initialState=None if initial is None else initial.groupBy("post_id")
    )


ANSWERED = "claim_key string, asked_at timestamp, verdict string"


class VerdictCache(StatefulProcessor):
    """The last verdict of a claim, while it is fresh; a timer at the end of its time clears it, and a stale one counts as a miss anyway."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "verdict string, stored_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["at", "is_ask", "seq"], kind="stable")
        held = self.held.get() if self.held.exists() else None
        out = []
        for at, is_ask, verdict in zip(pdf["at"], pdf["is_ask"], pdf["verdict"]):
            ms = int(at.timestamp() * 1000)
            if is_ask:
                out.append((key[0], at, held[0] if held is not None and ms - held[1] <= self.ttl_ms else None))
            else:
                held = (verdict, ms)
        if held is not None:
            self.held.update(held)
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(held[1] + self.ttl_ms + 1)
        if out:
            yield pd.DataFrame(out, columns=["claim_key", "asked_at", "verdict"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def _events(stored: DataFrame, asked: DataFrame) -> DataFrame:
    a = stored.select("claim_key", F.col("stored_at").alias("at"), F.lit(False).alias("is_ask"), "verdict", "seq")
    return a.unionByName(asked.select("claim_key", F.col("asked_at").alias("at"), F.lit(True).alias("is_ask"), F.lit(None).cast("string").alias("verdict"), "seq"))


def verdict_stream(stored: DataFrame, asked: DataFrame, ttl_seconds: int, late: str = "10 minutes") -> DataFrame:
    """(claim_key, asked_at, verdict): the last verdict stored at or before a question and at most ttl_seconds old; null is a miss.

    stored: claim_key, stored_at, verdict, seq.  asked: claim_key, asked_at, seq.
    """
    events = _events(stored, asked).withWatermark("at", late)
    return events.groupBy("claim_key").transformWithStateInPandas(VerdictCache(ttl_seconds * 1000), outputStructType=ANSWERED, outputMode="Append", timeMode="EventTime")
