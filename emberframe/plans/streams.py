"""Queries that run a stream over all events there are, and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.plans.views import table
from emberframe.sources.shared import shared_dir
from emberframe.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream of readings; every eleventh has no value."""
    path = f"{d}/events.parque[t]"  # a pattern: a stream takes a single file only so
    e = s.readStream.schema(table(s, d, "events").schema).parquet(path)
    return e.select("event_id", F.col("user_id").alias("cell_id"), "ts", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"))


def drained(s: SparkSession, out: DataFrame, name: str) -> DataFrame:
    base = shared_dir(s, name)
    jobs.run_available(out, f"{base}/out", f"{base}/checkpoint")
    return s.read.schema(out.schema).parquet(f"{base}/out")


def labels(s, d):
    hot = events(s, d).withColumn("conf", F.least("value", F.when(F.col("value").isNotNull(), 100.0)))
    return drained(s, jobs.cell_labels_stream(hot, 60.0, "6 hours"), "label-stream")


def daily(window, slide):
    def run(s, d):
        return drained(s, jobs.daily_stream(events(s, d), late="6 hours", window=window, slide=slide), "daily-stream")

    return run


def carried(s, d):
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return drained(s, jobs.carry_forward_stream(events(s, d)), "carry-stream").select("event_id", "cell_id", "carried")


def alert_batches(s, d):
    """Each closed day's top cells by the day's mean, written batch by batch."""
    base = shared_dir(s, "alert-stream")
    day = jobs.daily_stream(events(s, d), late="6 hours").select(F.col("window_start").alias("label_date"), "cell_id", (F.round("mean", 6) / 1000).alias("p_fire"))
    day.writeStream.foreachBatch(jobs.alerts_sink(f"{base}/out", 3)).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/out").select(F.col("label_date").cast("date").alias("label_date"), "cell_id", "rank")


_EV = "e AS (SELECT event_id, user_id AS cell_id, ts, CAST(ts AS DATE) AS day, CASE WHEN event_id % 11 <> 0 THEN value END AS value FROM events)"
_AGG = "round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(min(value), 6) AS min, round(sum(value), 6) AS sum, count(*) AS n"
_DAYS = f"WITH {_EV}, a AS (SELECT day AS window_start, day + 1 AS window_end, cell_id, {_AGG} FROM e GROUP BY day, cell_id), t AS (SELECT * FROM a WHERE CAST(window_end AS TIMESTAMP) <= (SELECT max(ts) FROM e) - INTERVAL 6 HOURS)"

QUERIES = {
    "t1_label_stream": (labels, f"WITH {_EV}, h AS (SELECT * FROM e WHERE value >= 60) SELECT day, cell_id, CAST(count(*) AS INT) AS firms_n_pixels, round(max(least(value, 100)), 6) AS firms_max_confidence, CAST(1 AS TINYINT) AS y_fire FROM h WHERE CAST(day + 1 AS TIMESTAMP) <= (SELECT max(ts) FROM h) - INTERVAL 6 HOURS GROUP BY day, cell_id"),
    "t2_daily_stream": (daily("1 day", None), f"{_DAYS} SELECT * FROM t"),
    "t2_sliding_stream": (daily("10 days", "5 days"), f"WITH {_EV}, w AS (SELECT *, unnest([0, 5]) AS back, CAST(floor(date_diff('day', DATE '1970-01-01', day) / 5) * 5 AS INT) AS k FROM e) SELECT DATE '1970-01-01' + (k - back) AS window_start, DATE '1970-01-01' + (k - back + 10) AS window_end, cell_id, {_AGG} FROM w WHERE CAST(DATE '1970-01-01' + (k - back + 10) AS TIMESTAMP) <= (SELECT max(ts) FROM e) - INTERVAL 6 HOURS GROUP BY k - back, cell_id"),
    "t3_carry_stream": (carried, f"WITH {_EV} SELECT event_id, cell_id, round(last_value(value IGNORE NULLS) OVER (PARTITION BY cell_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS carried FROM e"),
    "t4_alert_batches": (alert_batches, f"{_DAYS}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY window_start ORDER BY mean DESC NULLS LAST, cell_id) AS INT) AS rank FROM t) SELECT window_start AS label_date, cell_id, rank FROM k WHERE rank <= 3"),
}
