"""Keyed state of the streams: typed values, maps and timers in a RocksDB store, restored from the checkpoint when a stream starts again."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State of streams that start from now on lives in RocksDB, on the executors' disks and in the checkpoint; typed state needs it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class FirstSeen(StatefulProcessor):
    """One value for each (board, item): when it was first seen, in microseconds.  A row goes out when the value is set, and never again."""

    def __init__(self, forget_hours: int | None = None):
        self.ttl = forget_hours and forget_hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "first long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = min((r.us for r in rows), default=None)
        if first is not None and not self.first.exists():
            self.first.update((first,))
            yield Row(board=key[0], content_hash=key[1], us=first)

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, forget_hours: int | None = None) -> DataFrame:
    """Emits (board, content_hash, first_seen) once for every item of a board; rows without a time count for nothing.

    State holds a time for each item ever seen, so it grows with distinct items.  With ``forget_hours`` an item is forgotten that
    long (by the clock) after it was first seen, which bounds the state and calls a returning item new."""
    use_rocksdb(stream.sparkSession)
    rows = stream.where("observed_at is not null").select("board", "content_hash", F.unix_micros("observed_at").alias("us"))
    out = rows.groupBy("board", "content_hash").transformWithState(FirstSeen(forget_hours), "board string, content_hash string, us long", "Append", "ProcessingTime" if forget_hours else "None")
    return out.select("board", "content_hash", F.timestamp_micros("us").alias("first_seen"))


class DripCursor(StatefulProcessor):
    """For each queue its cursor (value), how often each unit was confirmed (map), and a timer for when the queue is due again."""

    def __init__(self, due_hours: int | None = None):
        self.due = due_hours and timedelta(hours=due_hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", "pos long, unit_id string, due_ms long")
        self.printed = handle.getMapState("printed", "unit_id string", "times long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        prints = pd.concat(list(rows))
        again = 0
        for unit, times in prints.groupby("unit_id").size().items():
            before = self.printed.getValue((unit,))[0] if self.printed.containsKey((unit,)) else 0
            again += times - (before == 0)
            self.printed.updateValue((unit,), (int(before + times),))
        best = prints.sort_values("pos").iloc[-1]
        held = self.cursor.get() if self.cursor.exists() else None
        moved = held is None or int(best["pos"]) > held[0]
        pos, unit = (int(best["pos"]), best["unit_id"]) if moved else (held[0], held[1])
        due_ms = held[2] if held else 0
        if self.due:
            if due_ms:
                self.handle.deleteTimer(due_ms)
            due_ms = max(due_ms, int((prints["printed_at"].max() + self.due).timestamp() * 1000))
            self.handle.registerTimer(due_ms)
        self.cursor.update((pos, unit, due_ms))
        if moved or again or self.due:
            yield self._row(key, pos, unit, "printed", again)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pos, unit, _ = self.cursor.get()
        yield self._row(key, pos, unit, "due", 0)

    @staticmethod
    def _row(key, pos: int, unit: str, state: str, again: int) -> pd.DataFrame:
        return pd.DataFrame({"queue_id": [key[0]], "unit_id": [unit], "pos": [pos], "state": [state], "again": [int(again)]})

    def close(self) -> None:
        pass


def drip(stream: DataFrame, due_hours: int | None = None, late: str = "1 hour") -> DataFrame:
    """(queue_id, unit_id, pos, state, again): the cursor of each queue after confirmed prints (queue_id, unit_id, pos, printed_at).

    It never goes back; ``again`` says how many of a batch's prints were of units that had been printed before.  With ``due_hours`` a
    row with state ``due`` follows when the watermark, ``late`` behind the greatest time, passes that many hours after a queue's last
    print; another print puts that off.  Prints without a unit or a place are no prints."""
    use_rocksdb(stream.sparkSession)
    rows = stream.where("unit_id is not null and pos is not null").select("queue_id", "unit_id", F.col("pos").cast("long").alias("pos"), *(["printed_at"] if due_hours else []))
    if due_hours:
        rows = rows.where("printed_at is not null").withWatermark("printed_at", late)
    out = "queue_id string, unit_id string, pos long, state string, again long"
    return rows.groupBy("queue_id").transformWithStateInPandas(DripCursor(due_hours), out, "Update", "EventTime" if due_hours else "None")
