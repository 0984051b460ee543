"""Attempts per question over a stream of checks: state is one counter per question."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST_ATTEMPTS = 4


def counted_attempts(checks: DataFrame, expire: str = "1 day") -> DataFrame:
    """``checks`` (question, check_id long, decision) as a stream: question, check_id, attempt and final (the last that is
    allowed). A question that is quiet for ``expire`` starts again."""
    milliseconds = int(pd.Timedelta(expire).total_seconds() * 1000)

    def count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done = state.get[0] if state.exists else 0
        for part in parts:
            part = part.sort_values("check_id")
            tries = range(done + 1, done + len(part) + 1)
            done += len(part)
            yield pd.DataFrame({"question": key[0], "check_id": part["check_id"], "attempt": list(tries), "final": [t >= MOST_ATTEMPTS for t in tries]})
        state.update((done,))
        state.setTimeoutDuration(milliseconds)

    return checks.groupBy("question").applyInPandasWithState(count, "question string, check_id long, attempt long, final boolean", "done long", "append", GroupStateTimeout.ProcessingTimeTimeout)
