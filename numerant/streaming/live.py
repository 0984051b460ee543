"""Checks as they come in: attempts per question in keyed state, and the store they are added to, each once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from numerant.operators.denials import MOST_ATTEMPTS
from numerant.sources.versions import appended

#: The state store that such operators need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Attempts(StatefulProcessor):
    """Of each question the attempts so far and whether one was denied. A timer forgets a question that is quiet."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "attempts long, denied boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts, denied = self.seen.get() if self.seen.exists() else (0, False)
        checks = pd.concat(list(rows)).sort_values("check_id")
        made = checks["decision"] != "not_checked"  # what was not checked is no attempt
        deny = (checks["decision"] == "deny") & made
        before = deny.cumsum() - deny > 0
        tries = (attempts + made.cumsum()).where(made)
        yield pd.DataFrame({
            "question": key[0], "check_id": checks["check_id"], "decision": checks["decision"], "attempt": tries.astype("Int64"), "denied_before": before | denied, "final": (tries >= MOST_ATTEMPTS).fillna(False).astype(bool),
        })
        self.seen.update((int(attempts + made.sum()), bool(denied or deny.any())))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


RESULT = "question string, check_id long, decision string, attempt long, denied_before boolean, final boolean"


def live_attempts(checks: DataFrame, quiet: str = "1 day") -> DataFrame:
    """``checks`` (question, check_id long, decision), a stream: question, check_id, decision, attempt (null if it was not
    checked), denied_before and final (the last attempt that is allowed). A question that is quiet for so long starts
    again. The session needs ``STATE_STORE``."""
    milliseconds = int(pd.Timedelta(quiet).total_seconds() * 1000)
    return checks.groupBy("question").transformWithStateInPandas(statefulProcessor=Attempts(milliseconds), outputStructType=RESULT, outputMode="Append", timeMode="processingTime")


def into_store(results: DataFrame, path: str, checkpoint: str, ends: bool = True) -> StreamingQuery:
    """Adds every batch of a stream to the table at ``path`` as one version; a batch that runs again after a failure is
    known by its number and not added twice. With ``ends`` what is there now is read in batches, then the query ends; its
    timers then wait for the next one. Else it goes on, and timers fire without new data too."""

    def add(batch: DataFrame, number: int) -> None:
        appended(batch, path, batch=number)

    writer = results.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    if not ends:
        return writer.start()
    conf, name = results.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")  # keyed timers would ask for one batch after another
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
