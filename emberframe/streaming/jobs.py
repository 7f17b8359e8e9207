"""Incremental versions of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberframe.operators.filters import hot_cell
from emberframe.sources.shared import stored


def timed(df: DataFrame, time: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def cell_labels_stream(hot: DataFrame, threshold: float = 30.0, late: str = "2 days", time: str = "ts", conf: str = "conf") -> DataFrame:
    """Labels per day and cell once the day is closed; rows later than `late` are left out."""
    kept = timed(hot, time).filter(hot_cell(F.col(conf), threshold)).withWatermark(time, late)
    out = kept.groupBy(F.window(time, "1 day").alias("w"), "cell_id").agg(F.count("*").cast("int").alias("firms_n_pixels"), F.max(conf).alias("firms_max_confidence"))
    return out.select(F.to_date("w.start").alias("day"), "cell_id", "firms_n_pixels", "firms_max_confidence", F.lit(1).cast("tinyint").alias("y_fire"))


def daily_stream(obs: DataFrame, value: str = "value", late: str = "2 days", time: str = "ts", window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Tumbling (or, with slide, overlapping) windows of a reading per cell: mean, extremes, sum and count."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    v = F.col(value)
    out = timed(obs, time).withWatermark(time, late).groupBy(w.alias("w"), "cell_id").agg(F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.sum(v).alias("sum"), F.count("*").alias("n"))
    return out.select(F.to_date("w.start").alias("window_start"), F.to_date("w.end").alias("window_end"), "cell_id", "mean", "max", "min", "sum", "n")


#: Rows given out at a time, microseconds of event time whose waiting readings one state entry holds, and groups of cells.
PIECE, BUCKET, GROUPS = 10_000, 7 * 86_400_000_000, 1024
READING = np.dtype([("cell", "<i8"), ("us", "<i8"), ("event", "<i8"), ("value", "<f8")])
LAST = np.dtype([("cell", "<i8"), ("value", "<f8")])


class LastReading(StatefulProcessor):
    """Gives each reading its cell's last known value at its time, as the batch operator does, however readings are dealt to
    batches. Readings wait in map state, by the week of their event time, until the watermark has passed them; then they are
    given out in order of time and id. No reading can come any more that belongs before them, so the only other state are the
    last known values. State is kept for groups of cells (by hash; rows without a cell are group -1), as each use of it has
    its price. A group has one timer, at its earliest waiting reading; what it gives out leaves the state. Input
    is taken by its chunks, and output made week by week."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "cells binary")
        self.waiting = handle.getMapState("waiting", "bucket long", "readings binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for x in rows:
            own = np.empty(len(x), READING)
            own["cell"] = 0 if key[0] < 0 else x["cell_id"]
            own["us"], own["event"], own["value"] = x["us"], x["event_id"], x["value"].to_numpy(float, na_value=np.nan)
            bucket = own["us"] // BUCKET
            for b in np.unique(bucket).tolist():
                before = bytes(self.waiting.getValue((b,))[0]) if self.waiting.containsKey((b,)) else b""
                self.waiting.updateValue((b,), (before + own[bucket == b].tobytes(),))
            earliest = min(int(own["us"].min()), earliest if earliest is not None else np.iinfo(np.int64).max)
        if earliest is not None:
            self.handle.registerTimer(earliest // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000 + 999  # watermarks are whole milliseconds
        known = np.frombuffer(bytes(self.last.get()[0]), LAST) if self.last.exists() else np.empty(0, LAST)
        for b in sorted(k[0] for k in list(self.waiting.keys())):
            if b * BUCKET > now:
                self.handle.registerTimer(b * BUCKET // 1000)  # no reading of the week is earlier
                break
            own = np.frombuffer(bytes(self.waiting.getValue((b,))[0]), READING)
            ready, rest = np.sort(own[own["us"] <= now], order=("cell", "us", "event")), own[own["us"] > now]
            carried, known = carried_on(ready, known)
            for i in range(0, len(ready), PIECE):
                part = slice(i, i + PIECE)
                cells = pd.array([None] * len(ready[part]) if key[0] < 0 else ready["cell"][part], dtype="Int64")
                yield pd.DataFrame({"event_id": ready["event"][part], "cell_id": cells, "us": ready["us"][part], "carried": carried[part]})
            if len(rest):
                self.waiting.updateValue((b,), (rest.tobytes(),))
                self.handle.registerTimer(int(rest["us"].min()) // 1000)
                break
            self.waiting.removeKey((b,))
        if len(known):
            self.last.update((known.tobytes(),))

    def close(self) -> None:
        pass


def carried_on(ready: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last known values at readings sorted by cell, time and id, and those of all cells after them. known: one row a cell, sorted."""
    cells, start, n = np.unique(ready["cell"], return_index=True, return_counts=True)
    before = np.full(len(cells), np.nan)
    if len(known):
        place = np.minimum(np.searchsorted(known["cell"], cells), len(known) - 1)
        before = np.where(known["cell"][place] == cells, known["value"][place], np.nan)
    at = np.maximum.accumulate(np.where(np.isnan(ready["value"]), -1, np.arange(len(ready))))
    carried = np.where(at >= np.repeat(start, n), ready["value"][at], np.repeat(before, n))
    after = np.empty(len(cells), LAST)
    after["cell"], after["value"] = cells, carried[start + n - 1]
    after = np.concatenate([known[~np.isin(known["cell"], cells)], after[~np.isnan(after["value"])]])
    return carried, np.sort(after, order="cell")


def carry_forward_stream(readings: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(event_id, cell_id, ts, carried) for readings (event_id, cell_id, ts, value). A reading is given out once the watermark,
    `late` behind the latest time seen (in whole milliseconds), has reached it, and equals the batch operator's row; one that
    comes after that is left out, as are readings without a time. Needs the RocksDB state store."""
    group = F.when(F.col("cell_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("cell_id"), F.lit(GROUPS))).cast("long").alias("group")
    keyed = timed(readings).filter("ts IS NOT NULL").withWatermark("ts", late).select(group, "event_id", F.col("cell_id").cast("long"), "ts", F.unix_micros("ts").alias("us"), "value").groupBy("group")
    out = keyed.transformWithStateInPandas(LastReading(), "event_id long, cell_id long, us long, carried double", "append", "EventTime")
    return out.select("event_id", "cell_id", F.timestamp_micros("us").alias("ts"), F.when(~F.isnan("carried"), F.col("carried")).alias("carried"))


def alerts_sink(path: str, k: int = 25, day: str = "label_date", cell: str = "cell_id") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps the top k cells of each day over all batches, however a day's cells are dealt to them.

    A batch's rows join the days' rows that the table has, each with the number of its batch; of a cell that comes again
    the later batch counts. The merged days are written to the shared folder first, then replace their partitions. A batch
    that runs again, whole or after a failure between the two, finds its own rows and changes nothing. The table holds
    k rows a day and no more: if a later batch lowers a cell, cells that it had displaced don't come back. `score` is the
    probability before it is cut to a float, by which rows of all batches are ranked."""
    from emberframe.operators.metrics import alerts
    from emberframe.sources.tables import write_table

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = stored(batch.withColumn("batch_id", F.lit(number).cast("long")).withColumn("score", F.col("p_fire").cast("double")), "alert-batch")
        try:
            before = spark.read.schema(alerts(rows, k, day=day).schema).parquet(path)
        except AnalysisException:  # the first batch: there is no table yet
            before = None
        if before is not None:
            kept = before.join(rows.select(day).distinct(), day, "left_semi").withColumn("p_fire", F.col("score").cast(rows.schema["p_fire"].dataType)).select(*rows.columns)
            last = Window.partitionBy(day, cell).orderBy(F.col("batch_id").desc(), F.col("score").desc())
            rows = rows.unionByName(kept).withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")
        write_table(stored(alerts(rows, k, day=day), "alerts"), path, [day])

    return write


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and ends; run again, it goes on where it ended."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
