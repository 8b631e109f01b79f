"""Debounced file-change events and throttled progress, as streams and as the same queries over tables."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.filters import is_watched

# Quiet time that ends a burst, and least time between shown progress rows.
DEBOUNCE, THROTTLE_MS = "100 milliseconds", 140


def watched(events: DataFrame) -> DataFrame:
    return events.where(is_watched("path"))


def debounce(events: DataFrame, *, quiet: str = DEBOUNCE, late: str = "10 seconds", time: str = "ts", key: str = "path") -> DataFrame:
    """One row per burst of a key: key, first, last, n.  A burst ends when the key is quiet; events later than `late` are dropped."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    bursts = rows.groupBy(F.session_window(time, quiet).alias("w"), F.col(key)).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"))
    return bursts.select(key, "first", "last", "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there now, appending to a Parquet folder."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def index_changes(stream: DataFrame, index: Callable[[DataFrame], None], checkpoint: str):
    """Hands each micro-batch's distinct watched paths to index(); the checkpoint resumes after a restart."""
    return watched(stream).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: index(batch.select("path").distinct())).start()


def latest_run_only(events: DataFrame, run: str = "run_id") -> DataFrame:
    """Rows of the latest run."""
    return events.join(F.broadcast(events.agg(F.max(run).alias(run))), run)


def throttle(events: DataFrame, *, key: str = "run_id", time: str = "ts", phase: str = "phase", least_ms: int = THROTTLE_MS) -> DataFrame:
    """Rows of a key at least least_ms after the row shown before, and all complete ones, in time order.

    A fold over each key's rows, streamed in order through one task per key.
    """
    at = [events.columns.index(c) for c in (key, time, phase)]

    def run(batches):
        held, last = None, None
        for batch in batches:
            keys, phases = batch.column(at[0]).to_pylist(), batch.column(at[2]).to_pylist()
            times = batch.column(at[1]).cast(pa.timestamp("us", batch.column(at[1]).type.tz)).cast(pa.int64()).to_pylist()
            keep = []
            for k, t, p in zip(keys, times, phases):
                show = k != held or last is None or p == "complete" or (t is not None and t - last >= least_ms * 1000)
                keep.append(show)
                held = k
                last = t if show else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    return events.repartition(F.col(key)).sortWithinPartitions(key, time, phase).mapInArrow(run, events.schema)


def throttle_stream(events: DataFrame, *, key: str = "run_id", time: str = "ts", phase: str = "phase", least_ms: int = THROTTLE_MS, late: str = "10 seconds") -> DataFrame:
    """throttle() over a stream: the same rows, each once the watermark has passed it.

    A key's state is the time of the row shown last and the rows that the watermark has not passed yet, which a timer takes
    up in time order; so rows that come out of order within `late` are judged as throttle() judges them, and a restart goes on
    from the checkpoint.  Rows later than that are dropped.  Needs the RocksDB state store, which this sets for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    fields = ", ".join(f"`{f.name}` {'long' if f.name == time else f.dataType.simpleString()}" for f in rows.schema.fields)
    processor = _Throttle(rows.columns.index(time), rows.columns.index(phase), rows.columns, least_ms * 1000, fields)
    return rows.groupBy(key).transformWithStateInPandas(processor, rows.schema, "Append", "EventTime")


class _Throttle(StatefulProcessor):
    """One key's rows in time order, behind the watermark."""

    def __init__(self, time: int, phase: int, columns: list[str], least: int, fields: str):
        self.time, self.phase, self.columns, self.least, self.fields = time, phase, columns, least, fields

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.waiting = handle.getListState("waiting", self.fields)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        name = self.columns[self.time]
        for part in rows:
            part = part[part[name].notna()]
            if len(part):
                at = part[name].astype("datetime64[us]").astype("int64")
                part = part.assign(**{name: at}).astype(object).where(part.notna(), None)
                self.waiting.appendList([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in part.itertuples(index=False, name=None)])
                for ms in {t // 1000 + 1 for t in at.tolist()}:
                    self.handle.registerTimer(int(ms))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        edge = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = list(self.waiting.get())
        due = sorted((r for r in held if r[self.time] < edge), key=lambda r: (r[self.time], r[self.phase] is not None, r[self.phase] or ""))
        last = self.last.get()[0] if self.last.exists() else None
        shown = []
        for row in due:
            if last is None or row[self.phase] == "complete" or row[self.time] - last >= self.least:
                shown.append(row)
                last = row[self.time]
        if due:
            self.waiting.clear()
            if rest := [tuple(r) for r in held if r[self.time] >= edge]:
                self.waiting.appendList(rest)
        if shown:
            self.last.update((last,))
        found = pd.DataFrame([tuple(r) for r in shown], columns=self.columns)
        name = self.columns[self.time]
        yield found.assign(**{name: pd.to_datetime(found[name].astype("int64"), unit="us")})

    def close(self) -> None:
        pass


def replace_messages(log: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """A message log after the batch: equal ids replaced in place, new ones appended."""
    return batch.select(*log.columns).unionByName(log.join(batch.select(key).distinct(), key, "left_anti"))
