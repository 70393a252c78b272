"""A circuit breaker for the whole cluster: a stream of call results in, decisions and states out.

Each key (a provider, say) has one state, kept by Spark between batches and restored from the checkpoint: closed;
open after `after` failures in a row, when nothing passes for `pause` seconds; half-open after that, when one probe passes and
decides. A timer of the event time tells when a pause is over, without waiting for the next call.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.session import ship

AFTER, PAUSE = 5, 60.0
STATE = "failures int, since timestamp"
OUT = "key string, event_id long, ts timestamp, phase string, allowed boolean, failures int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BreakerProcessor(StatefulProcessor):
    """Folds results in order of (ts, event_id): phase and allowed say what met a call, failures what it left."""

    def __init__(self, after: int, pause: float):
        self.after, self.pause = after, timedelta(seconds=pause)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, since = self.state.get() if self.state.exists() else (0, None)
        since = None if since is None or pd.isna(since) else pd.Timestamp(since)
        found = pd.concat(list(rows)).sort_values(["ts", "event_id"])  # a key's calls of one batch
        out = []
        for event, ts, ok in zip(found["event_id"], found["ts"], found["ok"]):
            failures, since, phase, allowed = step(failures, since, ts, bool(ok), self.after, self.pause)
            out.append((key[0], event, ts, phase, allowed, failures))
        self.state.update((failures, since))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if since is not None:
            self.handle.registerTimer(int((since + self.pause).timestamp() * 1000))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, _ = self.state.get()
        yield _frame([(key[0], None, pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), "half_open", True, failures)])

    def close(self) -> None:
        pass


def step(failures: int, since, ts, ok: bool, after: int, pause):
    """(failures, since, phase, allowed) after one call: what met it, and the state that it leaves."""
    if since is not None and ts - since < pause:
        return failures, since, "open", False
    phase = "closed" if since is None else "half_open"
    failures = after - 1 if since is not None else failures  # the probe: one more failure opens it again
    if ok:
        return 0, None, phase, True
    return failures + 1, ts if failures + 1 >= after else None, phase, True


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "event_id", "ts", "phase", "allowed", "failures"])
    return out.astype({"event_id": "Int64", "failures": "int32"})


def decisions(calls: DataFrame, *, after: int = AFTER, pause: float = PAUSE, late: str = "0 seconds") -> DataFrame:
    """OUT for a stream of calls(key, event_id, ts, ok): a row for each call, and a half_open row without event_id as a pause ends.

    Calls of a key in one batch are taken in order; those more than `late` behind the batches before are dropped by the watermark.
    Null keys are one key.
    """
    spark = calls.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # timers and typed state need it
    rows = calls.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("ok").cast("boolean").alias("ok"))
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(BreakerProcessor(after, pause), OUT, outputMode="Append", timeMode="EventTime")


def states(decided: DataFrame, *, after: int = AFTER) -> DataFrame:
    """key, phase, since: the last state of each key of the rows that decisions() gave."""
    call = F.col("event_id").isNotNull()
    failed = call & F.col("allowed") & (F.col("failures") >= after)
    last = decided.groupBy("key").agg(F.max_by("failures", F.when(call, F.struct("ts", "event_id"))).alias("left"), F.max(F.when(failed, F.col("ts"))).alias("since"), F.max(F.when(~call, F.col("ts"))).alias("ended"))
    phase = F.when(F.col("left") < after, "closed").when(F.col("ended") > F.col("since"), "half_open").otherwise("open")
    return last.select("key", phase.alias("phase"), F.when(F.col("left") >= after, F.col("since")).alias("since"))


def admitted(calls: DataFrame, known: DataFrame, now: Column, *, order: list[str], pause: float = PAUSE) -> DataFrame:
    """calls(key, ...) with admitted: all of closed keys, none of open ones, and one probe of those whose pause is over.

    known(key, phase, since) as states() gives it; keys that it lacks are closed.
    """
    of = known.select(F.col("key").alias("_key"), "phase", "since")
    rows = calls.join(of, calls["key"].eqNullSafe(of["_key"]), "left")
    over = (F.col("phase") == "half_open") | (now >= F.col("since") + F.make_dt_interval(secs=F.lit(pause)))
    first = F.row_number().over(W.partitionBy("key").orderBy(*order)) == 1
    ok = F.when(F.coalesce("phase", F.lit("closed")) == "closed", True).when(over, first).otherwise(False)
    return rows.select(*(calls[c] for c in calls.columns), ok.alias("admitted"))
