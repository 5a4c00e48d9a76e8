"""Spending under a limit that many callers share: reservations are held, settled, released by a timer, or refused.

Each delegation's account is a fold over its events in order of their lines. The same fold runs as a stateful query over
a growing journal and, for a journal that is whole, over sorted partitions; amounts are whole numbers of the smallest unit.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG = "delegation string, line long, at timestamp, event string, id string, amount long"
OUT = "delegation string, line long, id string, decision string, held long, spent long"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


class Account:
    """One delegation: a limit, what is spent, and what is held by open reservations until their deadlines."""

    def __init__(self, hold_ms: int | None, saved: str | None = None):
        self.hold_ms = hold_ms
        self.limit, self.spent, self.line, self.open = json.loads(saved) if saved else (None, 0, -1, {})

    def saved(self) -> str:
        return json.dumps([self.limit, self.spent, self.line, self.open])

    @property
    def held(self) -> int:
        return sum(a for a, _ in self.open.values())

    def due(self) -> int | None:
        """When the next reservation is released."""
        return min((d for _, d in self.open.values() if d is not None), default=None)

    def release(self, upto: int) -> Iterator[tuple]:
        """Reservations whose deadline has come no longer count."""
        for d, i in sorted((d, i) for i, (_, d) in self.open.items() if d is not None and d <= upto):
            del self.open[i]
            yield (None, i, "released", self.held, self.spent)

    def step(self, line: int, at: int, event: str, ident: str | None, amount: int | None) -> Iterator[tuple]:
        """(line, id, decision, held, spent) of an event, after what its time releases. A line that isn't newer is skipped."""
        if line <= self.line:
            return
        self.line = line
        yield from self.release(at)
        amount = amount or 0
        if event == "limit":
            self.limit, decision = amount, "limit"
        elif event == "reserve":
            if ident in self.open:
                decision = "repeated"
            elif self.limit is None or self.spent + self.held + amount > self.limit:
                decision = "refused"
            else:
                self.open[ident] = amount, None if self.hold_ms is None else at + self.hold_ms
                decision = "granted"
        elif event == "settle":
            decision = "settled" if self.open.pop(ident, None) else "late"  # what was released is paid all the same
            self.spent += amount
        else:
            decision = "unknown"
        yield (line, ident, decision, self.held, self.spent)


def spending(log: DataFrame, hold_ms: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """Decisions on the events of a journal as it grows, in append mode; ``held`` and ``spent`` are those after each.

    With ``hold_ms`` an open reservation is released that long after it was made, by a later event or, if none comes, once
    the watermark (``delay`` behind the latest time of all delegations) has passed. Without, it counts until it is settled.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        account, out = Account(hold_ms, state.get[0] if state.exists else None), []
        if state.hasTimedOut:
            out += account.release(state.getCurrentWatermarkMs())
        else:
            rows = pd.concat(list(batches)).sort_values("line")
            ids, amounts = rows["id"].astype(object).where(rows["id"].notna(), None), rows["amount"].fillna(0)
            for line, ms, event, ident, amount in zip(rows["line"], rows["ms"], rows["event"], ids, amounts, strict=True):
                out += account.step(int(line), int(ms), event, ident, int(amount))
        state.update((account.saved(),))
        if account.due() is not None:
            state.setTimeoutTimestamp(max(account.due(), state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=COLUMNS[1:]).astype({"line": "Int64", "held": "int64", "spent": "int64"})
        frame.insert(0, "delegation", key[0])
        yield frame

    rows = log.withWatermark("at", delay).withColumn("ms", F.unix_millis("at"))
    return rows.groupBy("delegation").applyInPandasWithState(fold, OUT, "saved string", "append", GroupStateTimeout.EventTimeTimeout)


def replayed(log: DataFrame, hold_ms: int | None = None) -> DataFrame:
    """The same decisions on a whole journal. Reservations that are open at the end of a delegation's events stay open.

    A delegation's events come one after the other in sorted partitions; only its open reservations are held.
    """
    rows = log.withColumn("ms", F.unix_millis("at")).repartition("delegation").sortWithinPartitions("delegation", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, account = None, None
        for b in batches:
            out = []
            for key, *event in zip(*(b.column(c).to_pylist() for c in ("delegation", "line", "ms", "event", "id", "amount")), strict=True):
                if account is None or key != now:
                    now, account = key, Account(hold_ms)
                out += [(key, *said) for said in account.step(*event)]
            cols = list(zip(*out, strict=True)) or [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("line", "held", "spent") else pa.string()) for n, c in zip(COLUMNS, cols, strict=True)], COLUMNS)

    return rows.mapInArrow(run, OUT)
