"""Streams that resume: each key's used budget is held as state (OP-006, 14C, 114)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

#: Keyed state of this kind is held in RocksDB.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Budget(StatefulProcessor):
    """State of a key: the ids that were handed on, at most ``cap``."""

    def __init__(self, ident: str, cap: int):
        self.ident, self.cap = ident, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getMapState("done", "id long", "n int")

    def _ids(self) -> set[int]:
        return {int(k[0]) for k in self.done.keys()} if self.done.exists() else set()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        held = len(self._ids())
        for i in initialState[self.ident].tolist()[: max(0, self.cap - held)]:
            self.done.updateValue((int(i),), (1,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done = self._ids()
        left = self.cap - len(done)
        best: list[tuple] = []  # the rows of the least ids so far: (-id, row), at most the budget that is left
        taken: set[int] = set()
        for batch in rows:
            if left <= 0:
                continue
            for row in batch.itertuples(index=False):
                i = int(getattr(row, self.ident))
                if i in done or i in taken or (len(best) == left and -best[0][0] < i):
                    continue
                taken.add(i)
                if len(best) == left:
                    taken.discard(-heapq.heappushpop(best, (-i, tuple(row)))[0])
                else:
                    heapq.heappush(best, (-i, tuple(row)))
                columns = batch.columns
        if best:
            best.sort(key=lambda x: -x[0])
            for i, _ in best:
                self.done.updateValue((-i,), (1,))
            yield pd.DataFrame([row for _, row in best], columns=columns)

    def close(self) -> None:
        pass


def within_budget(rows: DataFrame, key: str, ident: str, cap: int, done: DataFrame | None = None) -> DataFrame:
    """Of a stream, the first ``cap`` rows of each key, each id once; what is held back is dropped.

    ``ident`` is a column of longs that orders a key's rows. Over micro-batches,
    and over restarts with the same checkpoint, a key's budget is what earlier
    batches left of it, and an id that was handed on isn't handed on again. If
    ids arrive in their order, any cut into batches gives the same rows. ``done``
    (key, ident) is what was produced before the stream began and counts; it is
    read by the first batch only. A null key is a key like others; rows with a
    null id are left out. State and memory are ``cap`` ids a key.
    """
    rows = rows.where(f"`{ident}` IS NOT NULL")
    grouped = None if done is None else done.select(key, ident).where(f"`{ident}` IS NOT NULL").distinct().groupBy(key)
    schema: StructType = rows.schema
    return rows.groupBy(key).transformWithStateInPandas(_Budget(ident, cap), schema, "Append", "None", initialState=grouped)


def append_within_budget(rows: DataFrame, key: str, ident: str, cap: int, target: str, checkpoint: str, done: DataFrame | None = None) -> StreamingQuery:
    """Append what the budgets allow to JSON lines at ``target``; the target is never read, and a restart goes on where the last run ended."""
    spark: SparkSession = rows.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, STATE_STORE)  # a query keeps the settings that it was started with
    try:
        made = within_budget(rows, key, ident, cap, done)
        return made.writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
