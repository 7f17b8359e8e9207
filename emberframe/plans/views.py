"""Tables in the shapes that the operators expect, as SQL that Spark and DuckDB both take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_obs": "SELECT event_id, user_id AS cell_id, ts, CAST(ts AS DATE) AS day, value, event_type FROM {events}",
    "v_day": "SELECT user_id AS cell_id, CAST(ts AS DATE) AS day, max(value) AS t_max, min(value) AS t_min, avg(value) AS t_mean, sum(value) AS p_sum, count(*) AS n FROM {events} GROUP BY user_id, CAST(ts AS DATE)",
    "v_static": "SELECT c_custkey AS cell_id, c_acctbal AS elevation, CAST(c_nationkey AS DOUBLE) * 2 AS slope, CAST((c_custkey * 37) % 360 AS DOUBLE) AS aspect FROM {customer}",
    "v_hot": "SELECT event_id, CAST(ts AS DATE) AS day, user_id AS cell_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE least(value, 100) END AS conf, 300 + value / 4 AS t21, CASE WHEN event_type IN ('error', 'signup') THEN 1 END AS flag FROM {events}",
    "v_ras": "SELECT CAST(floor(event_id / 100) AS INT) AS row, CAST(event_id % 100 AS INT) AS col, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value, CASE WHEN value > 220 THEN 1 ELSE 0 END AS fire FROM {events}",
    "v_pts": "SELECT c_custkey AS pt_id, CAST(32.53 AS DOUBLE) + ((c_custkey * 7919) % 948) / CAST(100 AS DOUBLE) AS lat, CAST(-124.41 AS DOUBLE) + ((c_custkey * 104729) % 1028) / CAST(100 AS DOUBLE) AS lon FROM {customer}",
    "v_win": "SELECT cell_id, DATE '2024-01-01' + CAST(5 * k AS INT) AS window_start, DATE '2024-01-01' + CAST(5 * k + 4 AS INT) AS window_end, avg(value) AS f1, max(value) AS f2 FROM (SELECT user_id AS cell_id, CAST(floor((day(ts) - 1) / 5) AS INT) AS k, value FROM {events}) t WHERE (cell_id + k) % 3 <> 0 GROUP BY cell_id, k",
    "v_score": "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, l_partkey % 50 AS cell_id, l_discount * 10 AS p, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM {lineitem}",
    "v_iv": "SELECT o_orderkey AS iv_id, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 10 - 1 AS INT) END AS e FROM {orders}",
    "v_status": "SELECT o_orderkey AS task_key, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'submitted' ELSE 'failed' END AS status FROM {orders}",
    "v_tasks": "SELECT l_orderkey AS task_key, l_linenumber AS seq, CASE l_returnflag WHEN 'A' THEN 'COMPLETED' WHEN 'R' THEN 'FAILED' ELSE 'RUNNING' END AS state FROM {lineitem} WHERE l_orderkey % 3 <> 0",
    # Hourly weather: 14 variables made of the reading.
    "v_wx": "SELECT user_id AS cell_id, ts AS time, 280 + value / 10 AS t2m, 275 + value / 21 AS d2m, 90000 + value AS sp, value / 30 - 2 AS u10, 3 - value / 41 AS v10, value / 12 AS i10fg, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 100000 END AS tp, value / 503 AS swvl1, value / 700 AS swvl2, value / 307 AS cvh, value / 401 AS cvl, value / 61 AS lai_hv, value / 83 AS lai_lv, value * 5 AS blh FROM {events}",
    # Samples: one row per cell and day with a label of the next day and a split by date.
    "v_smp": "SELECT concat(CAST(d.cell_id AS VARCHAR(20)), '_', CAST(d.day AS VARCHAR(10))) AS sample_id, d.cell_id, d.day, d.t_max, d.t_min, d.t_mean, CASE WHEN h.n IS NULL THEN 0 ELSE 1 END AS y_fire, CASE WHEN d.day <= DATE '2024-01-18' THEN 'train' WHEN d.day <= DATE '2024-01-24' THEN 'val' ELSE 'test' END AS split FROM (SELECT user_id AS cell_id, CAST(ts AS DATE) AS day, max(value) AS t_max, CASE WHEN user_id % 13 = 0 THEN NULL ELSE min(value) END AS t_min, avg(value) AS t_mean FROM {events} GROUP BY user_id, CAST(ts AS DATE)) d LEFT JOIN (SELECT user_id AS cell_id, CAST(ts AS DATE) AS day, count(*) AS n FROM {events} WHERE value > 150 GROUP BY user_id, CAST(ts AS DATE)) h ON h.cell_id = d.cell_id AND h.day = d.day + CAST(1 AS INT)",
}


class _Names(dict):
    def __missing__(self, key: str) -> str:
        return self["__form"].format(key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name].format_map(_Names(__form=f"parquet.`{sf_dir}/{{}}.parquet`")))


def sql(text: str) -> str:
    """DuckDB text with the views that it names in front."""
    used = [n for n in VIEWS if n in text]
    parts = [f"{n} AS ({VIEWS[n].format_map(_Names(__form='{}'))})" for n in used]
    text = text.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join([*parts, text[15:]])}"
    if text.upper().startswith("WITH "):
        return f"WITH {', '.join([*parts, text[5:]])}"
    return f"WITH {', '.join(parts)} {text}" if parts else text


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Fractions to fixed digits, so that engines that add in other orders agree; no negative zeros."""
    from pyspark.sql import functions as F

    return df.select(*((F.round(F.col(f"`{c}`").cast("double"), digits) + 0.0).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))
