"""Queries of filters, scalar functions, samples, splits, sources and progress."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from emberframe import functions as fn
from emberframe.operators import filters, joins_space, joins_time, quality, sampling
from emberframe.plans.views import table, view
from emberframe.sources import tables

#: Hash of the SQL twins: the same number as functions.hash_int gives.
H = "CAST(('0x' || substr(md5({0} || '|{1}'), 1, 8)) AS BIGINT)"
U = "((" + H + " + 0.5) / 4294967296)"
#: A triangle in the area of interest.
TRIANGLE = [(-124.0, 33.0, -115.0, 34.0), (-115.0, 34.0, -119.0, 41.5), (-119.0, 41.5, -124.0, 33.0)]
_CROSS = " + ".join(f"CAST((({y1} > lat) <> ({y2} > lat)) AND lon < ({x2} - ({x1})) * (lat - {y1}) / ({y2} - {y1}) + ({x1}) AS INT)" for x1, y1, x2, y2 in TRIANGLE)
#: A point on an edge is inside, too, as the operator says.
_ON = " OR ".join(f"abs((lon - ({x1})) * ({y2} - {y1}) - (lat - {y1}) * ({x2} - ({x1}))) < 1e-12 AND lon BETWEEN {min(x1, x2)} AND {max(x1, x2)} AND lat BETWEEN {min(y1, y2)} AND {max(y1, y2)}" for x1, y1, x2, y2 in TRIANGLE)
PATHS = "SELECT o_orderkey AS id, concat('x/s2_', lpad(CAST(year(o_orderdate) AS VARCHAR(4)), 4, '0'), '_', lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0'), lpad(CAST((o_orderkey % 2) * 9472 AS VARCHAR(10)), 10, '0'), '-', lpad(CAST((o_custkey % 2) * 9472 AS VARCHAR(10)), 10, '0'), CASE WHEN o_orderkey % 5 = 0 THEN '.txt.s2' ELSE '.tif' END) AS path FROM {}"


def paths(s, d):
    return s.sql(PATHS.format(f"parquet.`{d}/orders.parquet`"))


def with_ranks(s, d):
    return sampling.pct_rank(view(s, d, "v_smp"), "t_min", ["split"], "rank")


def weather_functions(s, d):
    w = view(s, d, "v_wx")
    u, v, t, dew = F.col("u10"), F.col("v10"), F.col("t2m"), F.col("d2m")
    return w.select("cell_id", "time", fn.rel_humidity(t, dew).alias("rh"), fn.vpd(fn.celsius(t), fn.celsius(dew)).alias("vpd"), fn.wind_speed(u, v).alias("speed"), fn.wind_dir_from(u, v).alias("dir_from"), fn.wind_dir_math(u, v).alias("dir_math"), fn.soil_moisture_index(F.col("swvl1"), F.col("swvl2")).alias("smi"), fn.celsius(t).alias("t_c"), fn.millimetres(F.col("tp")).alias("tp_mm"), fn.thermal_celsius(F.col("sp")).alias("thermal"), fn.sigmoid(u).alias("sig"), fn.pixel_metres(0.25, F.col("t2m") / 10).alias("metres"))


def terrain_functions(s, d):
    a, sl, e = F.col("aspect"), F.col("slope"), F.col("elevation")
    return view(s, d, "v_static").select("cell_id", fn.aspect_sin(a).alias("aspect_sin"), fn.aspect_cos(a).alias("aspect_cos"), fn.orographic_index(e, sl).alias("orographic"), fn.ridge_flag(sl, 20.0).alias("ridge"), fn.wind_exposure(sl, a).alias("exposure"))


def index_functions(s, d):
    a, b, c = (F.col(x) for x in ("value", "n1", "n2"))
    e = table(s, d, "events").select("event_id", "value", (F.col("event_id") % 97).cast("double").alias("n1"), (F.col("event_id") % 41).cast("double").alias("n2"))
    return e.select("event_id", fn.ndvi(a, b).alias("ndvi"), fn.nbr(a, c).alias("nbr"), fn.ndwi(b, a).alias("ndwi"), fn.ndmi(b, c).alias("ndmi"), fn.evi(a, b, c).alias("evi"), fn.savi(a, b).alias("savi"), fn.scale_reflectance(a * 30, F.lit(9000.0)).alias("scaled"))


def key_functions(s, d):
    p = view(s, d, "v_pts")
    la, lo = fn.snap(F.col("lat")), fn.snap(F.col("lon"))
    day = F.date_add(F.lit("2024-01-01"), (F.col("pt_id") % 400).cast("int"))
    return p.select("pt_id", fn.cell_id(la, lo).alias("cell_id"), fn.sample_id(fn.cell_id(la, lo), day).alias("sample_id"), fn.region(fn.cell_id(la, lo), la, lo).alias("region"), fn.day_label(day).alias("label"), F.dayofyear(day).alias("doy"), F.last_day(day).alias("month_end"), fn.pixel_index(F.col("lon"), -125.0, 12.0, 48).alias("px"), fn.pixel_centre(fn.pixel_index(F.col("lon"), -125.0, 12.0, 48), -125.0, 12.0, 48).alias("centre"))


def perimeters(s, d):
    raw = view(s, d, "v_iv").select("iv_id", F.date_format(F.col("s").cast("timestamp"), "M/d/yyyy h:mm:ss a").alias("Alarm Date"), F.when(F.col("iv_id") % 7 == 0, "bad").otherwise(F.date_format(F.col("e").cast("timestamp"), "M/d/yyyy h:mm:ss a")).alias("cont date"))
    return tables.perimeters(raw).select(F.col("IV_ID").alias("iv_id"), F.col("ALARM_DATE").alias("alarm"), F.col("CONT_DATE").alias("cont"))


def balanced(hard):
    def run(s, d):
        return sampling.balanced_sample(view(s, d, "v_smp"), 1.0, 42, {"train": 300, "val": 120, "test": 10_000}, ("t_max", "t_min") if hard else None).select("sample_id", "split", "y_fire")

    return run


def balanced_sql(hard):
    rank = lambda c: f"coalesce((rank() OVER (PARTITION BY split ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY split, {c}) - 1) / 2.0) / nullif(count({c}) OVER (PARTITION BY split), 0), 0.5)"
    fixed = lambda c: f"CASE WHEN {c} IS NULL THEN 0.5 ELSE {rank(c)} END"
    u = U.format("sample_id", 42)
    key = f"-ln({u}) / greatest({fixed('t_max')} + 1 - {fixed('t_min')}, 1e-6)" if hard else u
    return f"""WITH sz AS (SELECT split, count(*) FILTER (y_fire = 1) AS np, count(*) FILTER (y_fire <> 1) AS nn FROM v_smp GROUP BY split),
    neg AS (SELECT *, {key} AS k FROM v_smp WHERE y_fire <> 1), rk AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY k, sample_id) AS rn FROM neg),
    un AS (SELECT sample_id, split, y_fire FROM v_smp WHERE y_fire = 1 UNION ALL SELECT sample_id, rk.split, y_fire FROM rk JOIN sz ON rk.split = sz.split WHERE rn <= least(nn, floor(np * 1.0))),
    cp AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY y_fire DESC, {U.format('sample_id', 43)}, sample_id) AS rn FROM un)
    SELECT sample_id, split, y_fire FROM cp WHERE rn <= CASE split WHEN 'train' THEN 300 WHEN 'val' THEN 120 ELSE 10000 END"""


_RANKED = "r AS (SELECT day, row_number() OVER (ORDER BY day) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM v_day) x)"

QUERIES = {
    "s2_path_keys": (lambda s, d: tables.with_path_keys(paths(s, d), "optical"), "SELECT id, path, TRY_CAST(regexp_extract(path, 's2_(\\d{4})_(\\d{2})(\\d+)-(\\d+)\\.tif$', 1) AS INT) AS year, TRY_CAST(regexp_extract(path, 's2_(\\d{4})_(\\d{2})(\\d+)-(\\d+)\\.tif$', 2) AS INT) AS month, TRY_CAST(regexp_extract(path, 's2_(\\d{4})_(\\d{2})(\\d+)-(\\d+)\\.tif$', 3) AS INT) AS y_offset, TRY_CAST(regexp_extract(path, 's2_(\\d{4})_(\\d{2})(\\d+)-(\\d+)\\.tif$', 4) AS INT) AS x_offset FROM (" + PATHS.format("orders") + ") p"),
    "s3_tile_index": (lambda s, d: tables.tile_index(paths(s, d).select("path").distinct(), "optical"), "SELECT DISTINCT path, split_part(path, '/', 2) AS filename, CAST(substr(path, 6, 4) AS INT) AS year, CAST(substr(path, 11, 2) AS INT) AS month, CAST(substr(path, 13, 10) AS INT) AS y_offset, CAST(substr(path, 24, 10) AS INT) AS x_offset FROM (" + PATHS.format("orders") + ") p WHERE path LIKE '%.tif'"),
    "s4_merge_members": (lambda s, d: quality.merge_members(view(s, d, "v_obs").filter("event_id % 10 <> 0").select("event_id", "cell_id", F.col("value").alias("instant")), view(s, d, "v_obs").filter("event_id % 8 <> 0").select("event_id", "cell_id", (F.col("value") * 2).alias("total")), ["event_id", "cell_id"], "outer"), "SELECT event_id, cell_id, CASE WHEN event_id % 10 <> 0 THEN round(value, 6) END AS instant, CASE WHEN event_id % 8 <> 0 THEN round(value * 2, 6) END AS total FROM v_obs WHERE event_id % 10 <> 0 OR event_id % 8 <> 0"),
    "s4_merge_exact": (lambda s, d: quality.merge_members(view(s, d, "v_obs").select("event_id", F.col("value").alias("instant")), view(s, d, "v_obs").select("event_id", "cell_id"), ["event_id"], "exact"), "SELECT event_id, round(value, 6) AS instant, cell_id FROM v_obs"),
    "s8_perimeters": (perimeters, "SELECT iv_id, s AS alarm, CASE WHEN iv_id % 7 = 0 THEN s ELSE coalesce(e, s) END AS cont FROM v_iv"),
    "s12_metadata": (lambda s, d: quality.dataset_metadata(view(s, d, "v_smp"), ["t_max", "t_min"], day="day"), "SELECT split, count(*) AS n, count(*) FILTER (y_fire = 1) AS n_pos, '2024' AS years, 't_max,t_min' AS features FROM v_smp GROUP BY split"),
    "s13_pending": (lambda s, d: joins_time.pending(view(s, d, "v_day"), view(s, d, "v_day").filter("cell_id % 2 = 0"), ["cell_id", "day"]).select("cell_id", "day", "n"), "SELECT cell_id, day, n FROM v_day WHERE cell_id % 2 <> 0"),
    "s15_reconcile_status": (lambda s, d: quality.reconcile_status(view(s, d, "v_status"), view(s, d, "v_tasks"), [F.col("seq").desc(), F.col("state")]), "WITH l AS (SELECT *, row_number() OVER (PARTITION BY task_key ORDER BY seq DESC, state) AS rn FROM v_tasks) SELECT v_status.task_key, CASE WHEN status = 'submitted' AND state = 'COMPLETED' THEN 'done' WHEN status = 'submitted' AND state = 'FAILED' THEN 'failed' ELSE status END AS status FROM v_status LEFT JOIN l ON l.task_key = v_status.task_key AND rn = 1"),
    "s16_status_counts": (lambda s, d: quality.status_counts(view(s, d, "v_status")), "SELECT status, count(*) AS n FROM v_status GROUP BY status"),
    "p1_bbox": (lambda s, d: filters.in_bbox(view(s, d, "v_pts"), -122.0, 34.0, -118.0, 38.5), "SELECT pt_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM v_pts WHERE lon BETWEEN -122 AND -118 AND lat BETWEEN 34 AND 38.5"),
    "p3_season": (lambda s, d: filters.in_season(view(s, d, "v_iv"), "s").select("iv_id", "s"), "SELECT iv_id, s FROM v_iv WHERE month(s) BETWEEN 5 AND 11"),
    "p4_dates": (lambda s, d: filters.in_dates(view(s, d, "v_day"), "day", date(2024, 1, 5), date(2024, 1, 20)).select("cell_id", "day", "n"), "SELECT cell_id, day, n FROM v_day WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"),
    "p5_hot_cell": (lambda s, d: view(s, d, "v_hot").filter(filters.hot_cell(F.col("conf"), 60)).select("event_id", "conf"), "SELECT event_id, round(conf, 6) AS conf FROM v_hot WHERE conf >= 60"),
    "p6_hot_pixel": (lambda s, d: view(s, d, "v_hot").select("event_id", filters.hot_pixel(F.col("flag"), F.col("conf"), 60).alias("fire")), "SELECT event_id, CAST(CASE WHEN conf < 60 THEN 0 WHEN flag IS NOT NULL THEN 1 ELSE 0 END AS INT) AS fire FROM v_hot"),
    "p7_qa_bits": (lambda s, d: table(s, d, "events").filter(fn.bits_clear(F.col("event_id")) & fn.scl_keep(F.col("event_id") % 12) & fn.bits_clear(F.col("event_id"), (1, 3))).select("event_id"), "SELECT event_id FROM events WHERE event_id & 3072 = 0 AND event_id & 10 = 0 AND event_id % 12 IN (4, 5, 6, 7)"),
    "p8_nodata": (lambda s, d: filters.null_nodata(view(s, d, "v_ras").select("row", "col", F.when(F.col("col") % 9 == 0, -32768.0).when(F.col("col") % 7 == 0, float("nan")).otherwise(F.col("value")).alias("value")), ["value"]), "SELECT row, col, CASE WHEN col % 9 = 0 OR col % 7 = 0 THEN NULL ELSE round(value, 6) END AS value FROM v_ras"),
    "p9_cloud": (lambda s, d: filters.cloud_below(table(s, d, "events").select("event_id", F.col("value").alias("cloud_pct")), 30.0), "SELECT event_id, round(value, 6) AS cloud_pct FROM events WHERE value < 30"),
    "p10_complete": (lambda s, d: filters.complete_rows(view(s, d, "v_hot"), ["conf", "flag"]).select("event_id"), "SELECT event_id FROM v_hot WHERE conf IS NOT NULL AND flag IS NOT NULL"),
    "f1_weather_functions": (weather_functions, "SELECT cell_id, time, round(greatest(least(100 * (6.112 * exp(17.67 * (d2m - 273.15) / (d2m - 273.15 + 243.5))) / (6.112 * exp(17.67 * (t2m - 273.15) / (t2m - 273.15 + 243.5))), 100), 0), 6) AS rh, round(0.6108 * exp(17.27 * (t2m - 273.15) / (t2m - 273.15 + 237.3)) - 0.6108 * exp(17.27 * (d2m - 273.15) / (d2m - 273.15 + 237.3)), 6) AS vpd, round(sqrt(u10 * u10 + v10 * v10), 6) AS speed, round(degrees(atan2(u10, v10)) + 180, 6) AS dir_from, round(atan2(v10, u10), 6) AS dir_math, round((swvl1 + swvl2) / 2, 6) AS smi, round(t2m - 273.15, 6) AS t_c, round(tp * 1000, 6) AS tp_mm, round(sp * 0.00341802 + 149.0 - 273.15, 6) AS thermal, round(1 / (1 + exp(-u10)), 6) AS sig, round(111320 * 0.25 * cos(radians(t2m / 10)), 6) AS metres FROM v_wx"),
    "f7_terrain_functions": (terrain_functions, "SELECT cell_id, round(sin(radians(aspect)), 6) + 0 AS aspect_sin, round(cos(radians(aspect)), 6) + 0 AS aspect_cos, round(elevation * slope, 6) + 0 AS orographic, CAST(slope > 20 AS INT) AS ridge, round(slope * sin(radians(aspect)), 6) + 0 AS exposure FROM v_static"),
    "f8_spectral_indices": (index_functions, "WITH b AS (SELECT event_id, value AS a, CAST(event_id % 97 AS DOUBLE) AS b, CAST(event_id % 41 AS DOUBLE) AS c FROM events) SELECT event_id, round((a - b) / nullif(a + b + 1e-8, 0), 6) AS ndvi, round((a - c) / nullif(a + c + 1e-8, 0), 6) AS nbr, round((b - a) / nullif(b + a + 1e-8, 0), 6) AS ndwi, round((b - c) / nullif(b + c, 0), 6) AS ndmi, round(2.5 * (a - b) / nullif(a + 6 * b - 7.5 * c + 1, 0), 6) AS evi, round(1.5 * (a - b) / nullif(a + b + 0.5, 0), 6) AS savi, round(least(greatest(a * 30, 0), 10000) / 10000, 6) AS scaled FROM b"),
    "f9_keys_and_dates": (key_functions, "WITH g AS (SELECT pt_id, lon, round_even(lat / 0.25, 0) * 0.25 AS la, round_even(lon / 0.25, 0) * 0.25 AS lo, DATE '2024-01-01' + CAST(pt_id % 400 AS INT) AS d FROM v_pts), k AS (SELECT *, printf('%.2f_%.2f', la, lo) AS cell FROM g) SELECT pt_id, cell AS cell_id, cell || '_' || strftime(d, '%Y%m%d') AS sample_id, 'cell:' || cell || printf(' (%.2f,%.2f)', la, lo) AS region, strftime(d, '%Y_%m_%d') AS label, CAST(dayofyear(d) AS INT) AS doy, last_day(d) AS month_end, CAST(floor((lon + 125) * 4) AS INT) AS px, round(-125 + (floor((lon + 125) * 4) + 0.5) * 0.25, 6) AS centre FROM k"),
    "w3_pct_rank": (lambda s, d: with_ranks(s, d).select("sample_id", "rank"), "SELECT sample_id, round(CASE WHEN t_min IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY split ORDER BY t_min NULLS LAST) + (count(*) OVER (PARTITION BY split, t_min) - 1) / 2.0) / count(t_min) OVER (PARTITION BY split) END, 6) AS rank FROM v_smp"),
    "w6_split_quantile": (lambda s, d: sampling.split_by_quantile(view(s, d, "v_day")).select("cell_id", "day", "split"), f"WITH {_RANKED} SELECT cell_id, v_day.day, CASE WHEN r <= floor(n_ * 0.70) THEN 'train' WHEN r <= floor(n_ * 0.85) THEN 'val' ELSE 'test' END AS split FROM v_day JOIN (SELECT day, r, n AS n_ FROM r) q ON q.day = v_day.day"),
    "w7_split_fraction": (lambda s, d: sampling.split_by_fraction(view(s, d, "v_day")).select("cell_id", "day", "split"), f"WITH {_RANKED} SELECT cell_id, v_day.day, CASE WHEN r <= floor(n_ * 0.70) THEN 'train' WHEN r <= floor(n_ * 0.70) + floor(n_ * 0.15) THEN 'val' ELSE 'test' END AS split FROM v_day JOIN (SELECT day, r, n AS n_ FROM r) q ON q.day = v_day.day"),
    "w8_split_dates": (lambda s, d: sampling.split_by_date(view(s, d, "v_day"), "2024-01-15", "2024-01-22", "day").select("cell_id", "day", "split"), "SELECT cell_id, day, CASE WHEN day <= DATE '2024-01-15' THEN 'train' WHEN day <= DATE '2024-01-22' THEN 'val' ELSE 'test' END AS split FROM v_day"),
    "w9_back_windows": (lambda s, d: view(s, d, "v_day").select("cell_id", "day", joins_time.back_window_of(F.col("day"), "2024-01-30", 7).alias("window_last")).join(joins_time.back_windows(s, "2024-01-01", "2024-01-30", 7), F.expr("window_end = date_add(window_last, 1)")).select("cell_id", "day", "window_start", "window_end", "label"), "WITH w AS (SELECT cell_id, day, DATE '2024-01-30' - CAST(floor(date_diff('day', day, DATE '2024-01-30') / 7) * 7 AS INT) AS l FROM v_day) SELECT cell_id, day, greatest(l - 6, DATE '2024-01-01') AS window_start, l + 1 AS window_end, strftime(l, '%Y_%m_%d') AS label FROM w"),
    "w10_lookback_windows": (lambda s, d: joins_time.with_lookback(view(s, d, "v_obs"), "day", "2024-01-30", "2024-01-01").groupBy("cell_id", "window_end").agg(F.avg("value").alias("mean"), F.count("*").alias("n")), "WITH e AS (SELECT DATE '2024-01-30' - CAST(5 * k AS INT) AS window_end FROM range(0, 6) t(k)) SELECT cell_id, window_end, round(avg(value), 6) AS mean, count(*) AS n FROM v_obs JOIN e ON day >= window_end - 10 AND day < window_end GROUP BY cell_id, window_end"),
    "l2_balanced_sample": (balanced(False), balanced_sql(False)),
    "l2_hard_sample": (balanced(True), balanced_sql(True)),
    "l3_cap_per_split": (lambda s, d: sampling.cap_per_split(view(s, d, "v_smp"), {"train": 700, "test": 90}).select("sample_id", "split", "y_fire"), f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY y_fire DESC, {U.format('sample_id', 43)}, sample_id) AS rn FROM v_smp) SELECT sample_id, split, y_fire FROM r WHERE rn <= CASE split WHEN 'train' THEN 700 WHEN 'test' THEN 90 ELSE rn END"),
    "j21_split_years": (lambda s, d: sampling.split_years(table(s, d, "orders").select(F.col("o_orderdate").alias("day"), F.col("o_orderstatus").alias("split"))).select("split", F.array_join("years", ",").alias("years")), "SELECT o_orderstatus AS split, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR(4)), ',' ORDER BY CAST(year(o_orderdate) AS VARCHAR(4))) AS years FROM orders GROUP BY o_orderstatus"),
    "l4_hash_sample": (lambda s, d: sampling.hash_sample(view(s, d, "v_smp"), 500, "sample_id").select("sample_id"), f"SELECT sample_id FROM v_smp ORDER BY {H.format('sample_id', 42)}, sample_id LIMIT 500"),
    "l5_cap_negatives": (lambda s, d: sampling.cap_negatives(view(s, d, "v_smp"), 1000, "sample_id").select("sample_id", "y_fire"), f"SELECT sample_id, y_fire FROM v_smp WHERE y_fire = 1 UNION ALL SELECT sample_id, y_fire FROM (SELECT sample_id, y_fire, row_number() OVER (ORDER BY {H.format('sample_id', 42)}, sample_id) AS rn FROM v_smp WHERE y_fire <> 1) x WHERE rn <= greatest(0, 1000 - (SELECT count(*) FROM v_smp WHERE y_fire = 1))"),
    "l6_union": (lambda s, d: filters.union_all([view(s, d, "v_day").select("cell_id", "t_max"), view(s, d, "v_day").select("cell_id", "t_min")]), "SELECT cell_id, round(t_max, 6) AS t_max, CAST(NULL AS DOUBLE) AS t_min FROM v_day UNION ALL SELECT cell_id, NULL, round(t_min, 6) FROM v_day"),
    "l7_distinct": (lambda s, d: filters.distinct_keys(view(s, d, "v_obs"), ["cell_id", "event_type"]), "SELECT DISTINCT cell_id, event_type FROM v_obs"),
    "l8_date_sets": (lambda s, d: view(s, d, "v_day").select("day").intersect(view(s, d, "v_win").select(F.col("window_start").alias("day"))).withColumn("in_both", F.lit(1)).unionByName(view(s, d, "v_day").select("day").subtract(view(s, d, "v_win").select(F.col("window_start").alias("day"))).withColumn("in_both", F.lit(0))), "SELECT DISTINCT day, CAST(day IN (SELECT window_start FROM v_win) AS INT) AS in_both FROM v_day"),
    "j21_overlapping_dates": (lambda s, d: sampling.overlapping_dates(view(s, d, "v_smp").withColumn("split", F.when(F.col("cell_id") % 50 == 0, "val").otherwise(F.col("split")))), "SELECT day, count(DISTINCT CASE WHEN cell_id % 50 = 0 THEN 'val' ELSE split END) AS n_splits FROM v_smp GROUP BY day HAVING count(DISTINCT CASE WHEN cell_id % 50 = 0 THEN 'val' ELSE split END) > 1"),
    "p2_polygon": (lambda s, d: joins_space.in_polygon(view(s, d, "v_pts"), TRIANGLE).select("pt_id"), f"SELECT pt_id FROM v_pts WHERE ({_CROSS}) % 2 = 1 OR {_ON}"),
    "r11_make_cells": (lambda s, d: view(s, d, "v_pts").join(joins_space.make_cells(s, TRIANGLE).select("cell_id"), fn.cell_id(fn.snap(F.col("lat")), fn.snap(F.col("lon"))) == F.col("cell_id")).select("pt_id", "cell_id"), f"WITH g AS (SELECT pt_id, round_even(lat / 0.25, 0) * 0.25 AS lat, round_even(lon / 0.25, 0) * 0.25 AS lon FROM v_pts) SELECT pt_id, printf('%.2f_%.2f', lat, lon) AS cell_id FROM g WHERE ({_CROSS}) % 2 = 1 OR (lat = 33 AND lon = -124) OR (lat = 34 AND lon = -115) OR (lat = 41.5 AND lon = -119) OR abs((lon + 124) * (34 - 33) - (lat - 33) * 9) < 1e-12 AND lon BETWEEN -124 AND -115 OR abs((lon + 115) * 7.5 - (lat - 34) * -4) < 1e-12 AND lon BETWEEN -119 AND -115 OR abs((lon + 119) * -8.5 - (lat - 41.5) * -5) < 1e-12 AND lon BETWEEN -124 AND -119"),
}
