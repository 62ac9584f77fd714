"""Job state as a stream: events by job, state with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, Settings

OUTPUT = "job_id long, status string, percent long, last_seq long, expired boolean"
STATE = "status string, percent long, last_seq long"
TERMINAL = ("complete", "error")


def job_states(events: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Streaming ``job_events`` -> one row per job and micro-batch in which it changed.

    Events may come in any order within a batch; ``seq`` decides. A finished job's state is dropped once its time to live has passed.
    """
    ttl = max(60, settings.job_ttl_seconds) * 1000

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, percent, seq = state.get
            state.remove()
            yield pd.DataFrame([(key[0], status, percent, seq, True)], columns=["job_id", "status", "percent", "last_seq", "expired"])
            return
        status, percent, seq = state.get if state.exists else (None, None, -1)
        events = pd.concat(list(parts)).sort_values("seq")
        for row in events[events["seq"] > seq].itertuples():
            seq = int(row.seq)
            if not pd.isna(row.percent):
                percent = int(row.percent)
            status = "running" if row.state == "progress" else row.state
        state.update((status, percent, seq))
        if status in TERMINAL:
            state.setTimeoutDuration(ttl)
        shown = 100 if status == "complete" else 1 if status == "queued" else max(2, percent or 2)
        yield pd.DataFrame([(key[0], status, shown, seq, False)], columns=["job_id", "status", "percent", "last_seq", "expired"])

    return events.groupBy("job_id").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
