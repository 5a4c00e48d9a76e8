"""Accept and withdraw events folded by a stateful query, and last-status tables kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG = "id string, line long, event string, payload string"
OUT = "id string, active boolean, payload string, conflict boolean, line long"
STATE = "active boolean, payload string, conflict boolean, line long"


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key's events in order of their lines, on top of what is known; a line that isn't newer is skipped."""
    active, payload, conflict, last = state.get if state.exists else (False, None, False, -1)
    rows = pd.concat(list(batches)).sort_values("line")
    for event, value, line in zip(rows["event"], rows["payload"], rows["line"], strict=True):
        if line <= last:
            continue
        last = int(line)
        if event == "withdraw":
            active, payload, conflict = False, None, False
        elif active:
            conflict = conflict or payload != value
        else:
            active, payload, conflict = True, value, False
    state.update((active, payload, conflict, last))
    yield pd.DataFrame({"id": [key[0]], "active": [active], "payload": [payload], "conflict": [conflict], "line": [last]})


def acceptances(log: DataFrame) -> DataFrame:
    """The running state of every id as updates: its last row is what ``events.active_acceptances`` gives."""
    return log.groupBy("id").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def read_log(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """A journal of JSON lines as a stream; files come in order of their times, as a journal is appended to."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_a_batch).json(path)
