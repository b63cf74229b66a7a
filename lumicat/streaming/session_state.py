"""Sessions as keyed state with timers: each event goes to its key's state once, no state is ever rewritten as a whole.

A session goes on while events follow each other within ``gap`` seconds. A reset event, or one behind a longer gap,
closes it and opens the next. A session without events is closed by an event-time timer once the watermark has passed its gap,
and its state is dropped, so the state holds open sessions only. Each batch appends the sessions that it changed to a log;
``current`` reads the newest row of each session.

Events of a key are folded in the order of time and id within a batch. What arrives behind the watermark is dropped by the engine; events without a
key or a time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumicat.operators.sync import latest
from lumicat.session import folder_exists

EVENT = "key long, id long, ts timestamp, amount long, reset boolean"
SESSION = "key long, start long, last long, n long, amount long, closed boolean, version long"
_CHANGE = Row("key", "start", "last", "n", "amount", "closed", "version")
#: RocksDB keeps the state on disk beside the executors and its changes in the checkpoint folder.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """State of a key: microseconds of begin and end, events, amount, changes so far.

    A key with state has one timer. Events don't move it, as each call costs a round trip to the JVM; where it is early, it is set again.
    """

    def __init__(self, gap: int):
        self.gap = gap * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "start long, last long, n long, amount long, version long")

    def _row(self, key, s: tuple, closed: bool) -> Row:
        return _CHANGE(key[0], *s[:4], closed, s[4])

    def _due(self, last: int) -> int:
        return (last + self.gap) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.state.get()
        now = tuple(known) if known is not None else None
        version = now[4] if now else 0
        for _, _, _, at, amount, reset in sorted(rows, key=lambda r: (r[3], r[1], r[4], r[5])):
            version += 1
            if now is not None and (reset or at - now[1] > self.gap):
                yield self._row(key, (*now[:4], version), True)
                now = None
            now = (at, at, 1, int(amount), version) if now is None else (now[0], max(at, now[1]), now[2] + 1, now[3] + int(amount), version)
        self.state.update(now)
        if known is None:
            self.handle.registerTimer(self._due(now[1]))
        yield self._row(key, now, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self.state.get()
        if now is not None and self._due(now[1]) > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(self._due(now[1]))  # events came since it was set
        elif now is not None:
            self.state.clear()
            yield self._row(key, (*now[:4], now[4] + 1), True)

    def close(self) -> None:
        pass


def run(events: DataFrame, out: str, checkpoint: str, gap: int, late: str = "0 seconds") -> None:
    """Folds what a stream of events (key, id, ts, amount, reset) holds into sessions, then stops."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    marked = events.where("key is not null and ts is not null").select("key", F.coalesce("id", F.lit(0)).alias("id"), "ts", F.unix_micros("ts").alias("at"), F.coalesce("amount", F.lit(0)).alias("amount"), F.coalesce("reset", F.lit(False)).alias("reset")).withWatermark("ts", late)
    changes = marked.groupBy("key").transformWithState(Sessions(gap), SESSION, outputMode="Update", timeMode="EventTime")

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch writes the same

    changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, out: str) -> DataFrame:
    """key, start, last, n, amount, closed: every session as the log has it last."""
    if not folder_exists(spark, out):
        rows = spark.createDataFrame([], SESSION)
    else:
        rows = latest(spark.read.schema(SESSION + ", batch long").parquet(out), ["key", "start"], ["batch", "version"])
    return rows.select("key", *[F.timestamp_micros(c).alias(c) for c in ("start", "last")], "n", "amount", "closed")
