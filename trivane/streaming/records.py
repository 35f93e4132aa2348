"""Records that are measured piece by piece: arbitrary state by record, with a deadline after which what there is gets out.

Events give the value of one metric of one record. A record is complete when every expected metric has a value (the
first one counts); a record whose deadline passes before is sent out partial, with what it has. Deadlines are event time: a timer
fires when the watermark has passed it, so results don't depend on how events are cut into batches, and a query that was stopped
goes on from its checkpoint with the state of each record and metric."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from trivane.session import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "record string, status string, metrics string, total double, events long, missing string"


def row_of(record: str, got: dict[str, float], events: int, expected: tuple[str, ...]) -> dict:
    """A record as it is sent out: its metrics and those that are missing by name, and the sum of the values."""
    missing = [m for m in expected if m not in got]
    known = sorted(got)
    return {"record": record, "status": "partial" if missing else "complete", "metrics": ",".join(known), "total": float(sum(got[m] for m in known)), "events": events, "missing": ",".join(sorted(missing))}


class Measured(StatefulProcessor):
    """State of a record: the first value of each metric, how many events came, and whether it has been sent out."""

    def __init__(self, expected: tuple[str, ...]):
        self.expected = expected

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "metric string", "value double")
        self.record = handle.getValueState("record", "events long, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["time", "seq"])
        events, done = self.record.get() if self.record.exists() else (0, False)
        if not events:
            self.handle.registerTimer(int(new["deadline"].iloc[0]))
        if not done:
            got = {k[0]: v[0] for k, v in self.values.iterator()}
            for metric, value in zip(new["metric"], new["value"], strict=True):
                events += 1
                if metric in self.expected and metric not in got:
                    got[metric] = float(value)
                    self.values.updateValue((metric,), (float(value),))
                    if len(got) == len(self.expected):
                        done = True
                        yield pd.DataFrame([row_of(key[0], got, events, self.expected)])
                        break
        self.record.update((events, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events, done = self.record.get()
        if not done:
            got = {k[0]: v[0] for k, v in self.values.iterator()}
            yield pd.DataFrame([row_of(key[0], got, events, self.expected)])
        self.values.clear()
        self.record.clear()

    def close(self) -> None:
        pass


def measured(events: DataFrame, record: str, metric: str, value: str, time: str, seq: str, deadline, expected: list[str], late: str = "0 seconds") -> DataFrame:
    """Rows by OUTPUT from a stream of events; deadline is a timestamp column that depends on the record alone.

    Events of a batch are taken in the order of time and seq. Events of a record that come after its deadline would open
    it anew, so late is what the watermark waits for them. Rows without a record only move time on."""
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # The condition names the time, or the optimizer would put it before the watermark, which then wouldn't see these rows.
    cols = events.withWatermark(time, late).where(F.when(F.col(time).isNotNull(), F.col(record).isNotNull()))
    millis = F.unix_millis(deadline)
    cols = cols.select(F.col(record).cast("string").alias("record"), F.col(metric).alias("metric"), F.col(value).cast("double").alias("value"), F.col(time).alias("time"), F.col(seq).alias("seq"), millis.alias("deadline"))
    return cols.groupBy("record").transformWithStateInPandas(Measured(tuple(sorted(expected))), OUTPUT, "Append", "EventTime")


def start(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write each batch under its number, so that a repeated one replaces itself; runs until the available input is done."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
