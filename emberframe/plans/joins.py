"""Queries of joins over time and space, sequences and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe import functions as fn
from emberframe.operators import joins_space, joins_time, ml, sampling
from emberframe.plans.views import table, view

COVER = "WITH m AS (SELECT s.cell_id, s.day, w.window_start, w.window_end, f1, f2, row_number() OVER (PARTITION BY s.cell_id, s.day ORDER BY CASE WHEN window_start <= day AND window_end >= day THEN 0 ELSE 1 END, window_end DESC, window_start DESC) AS rn FROM v_day s JOIN v_win w ON w.cell_id = s.cell_id AND (window_end <= day OR (window_start <= day AND window_end >= day)){extra}) SELECT v_day.cell_id, v_day.day, CASE WHEN {fresh} THEN round(f1, 6) END AS f1, CASE WHEN {fresh} THEN round(f2, 6) END AS f2, CAST(coalesce({fresh}, FALSE) AS INT) AS available, CAST(date_diff('day', window_end, v_day.day) AS INT) AS lag_days FROM v_day LEFT JOIN m ON m.cell_id = v_day.cell_id AND m.day = v_day.day AND rn = 1"


def windows(max_lag=None, causal=False):
    def run(s, d):
        return joins_time.attach_windows(view(s, d, "v_day").select("cell_id", "day"), view(s, d, "v_win"), ["f1", "f2"], max_lag, causal=causal)

    return run


def cells(s, d):
    """The cells of all points, and as many two degrees further north, of which most have no point."""
    p = joins_space.snap_cell(view(s, d, "v_pts")).select("cell_lat", "cell_lon")
    both = p.unionByName(p.withColumn("cell_lat", F.col("cell_lat") + 2)).distinct()
    return both.select(fn.cell_id(F.col("cell_lat"), F.col("cell_lon")).alias("cell_id"), F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon"))


CELLS = "c AS (SELECT DISTINCT printf('%.2f_%.2f', a + k, b) AS cell_id, a + k AS clat, b AS clon FROM (SELECT round_even(lat / 0.25, 0) * 0.25 AS a, round_even(lon / 0.25, 0) * 0.25 AS b FROM v_pts) x, (VALUES (0), (2)) y(k)), p AS (SELECT * FROM v_pts), i AS (SELECT cell_id, pt_id FROM c JOIN p ON lat >= clat - 0.125 AND lat < clat + 0.125 AND lon >= clon - 0.125 AND lon < clon + 0.125), n AS (SELECT cell_id, pt_id, row_number() OVER (PARTITION BY cell_id ORDER BY (lat - clat) * (lat - clat) + (lon - clon) * (lon - clon), pt_id) AS rn FROM c, p WHERE cell_id NOT IN (SELECT cell_id FROM i)), g AS (SELECT cell_id, pt_id, 'in_cell' AS how FROM i UNION ALL SELECT cell_id, pt_id, 'nearest' FROM n WHERE rn = 1)"


def grid_map(s, d):
    return joins_space.map_grid_to_cells(cells(s, d), view(s, d, "v_pts"))


def windows_to_cells(s, d):
    win = view(s, d, "v_win").withColumnRenamed("cell_id", "pt_id")
    return joins_space.windows_to_cells(win, grid_map(s, d), ["f1", "f2"])


def months(s, d):
    return table(s, d, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).filter("month % 3 <> 0").distinct()


MONTHS = "m AS (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS mo FROM orders WHERE month(o_orderdate) % 3 <> 0)"


def tiles(s, d):
    """Four quadrant tiles in each of two months, less one; bounds overlap on purpose."""
    q = s.range(8).select((F.col("id") % 2 + 1).cast("int").alias("month"), F.floor(F.col("id") / 2).cast("int").alias("k")).filter("NOT (month = 1 AND k = 3)")
    return q.select(F.concat(F.lit("t"), F.col("month").cast("string"), F.lit("_"), F.col("k").cast("string")).alias("filename"), F.lit(2024).alias("year"), "month", F.when(F.col("k") < 2, 0).otherwise(9472).alias("y_offset"), F.when(F.col("k") % 2 == 0, 0).otherwise(9472).alias("x_offset"), F.lit(-124.5).alias("west"), F.lit(32.0).alias("south"), (F.lit(-116.0) + F.col("k")).alias("east"), F.lit(42.0).alias("north"))


def tile_pick(s, d):
    p = view(s, d, "v_pts").select("pt_id", "lat", "lon", F.lit(2024).alias("year"), (F.col("pt_id") % 3 + 1).cast("int").alias("month"))
    return joins_space.pick_tile(p, tiles(s, d)).select("pt_id", "filename")


TILES = "t AS (SELECT concat('t', CAST(m AS VARCHAR(2)), '_', CAST(k AS VARCHAR(2))) AS filename, m, k, -116.0 + k AS east FROM range(1, 3) a(m), range(0, 4) b(k) WHERE NOT (m = 1 AND k = 3)), p AS (SELECT pt_id, lat, lon, pt_id % 3 + 1 AS m, CASE WHEN lat >= 33.616754562320736 THEN 0 ELSE 2 END + CASE WHEN lon < -115.90153627238479 THEN 0 ELSE 1 END AS q FROM v_pts)"


def seqs(s, d):
    days = view(s, d, "v_day").select("cell_id", "day", "t_max", F.when(F.col("cell_id") % 11 != 0, F.col("p_sum")).alias("p_sum"))
    smp = view(s, d, "v_smp").select("sample_id", "cell_id", "day")
    q = joins_time.sequences(smp, days, view(s, d, "v_static").filter("cell_id % 5 <> 0"), ["t_max", "p_sum"], ["elevation", "slope"], 3)
    return q.select("sample_id", F.posexplode("sequence").alias("t", "x")).select("sample_id", "t", *(F.round(F.col("x")[i].cast("double"), 2).alias(f"x{i}") for i in range(4)))


def scene_days(s, d):
    days = view(s, d, "v_day").select("day").distinct()
    scenes = view(s, d, "v_win").groupBy(F.col("window_end").alias("scene")).agg(F.max("f2").alias("f2"))
    return joins_time.asof_latest(days, scenes, "day", "scene", ["f2"], out="scene_day")


def tree_samples(s, d):
    return view(s, d, "v_smp").select("sample_id", "day", "split", "t_max", "t_min", "t_mean", F.col("y_fire"))


def trees(s, d):
    """Trees on the training days, calibrated on the validation days; the test scores and their mean label."""
    x = tree_samples(s, d)
    model = ml.train_trees(x, ["t_max", "t_min", "t_mean"], iterations=5, depth=3)
    scored = ml.score_trees(x, model)
    return ml.calibrate(scored.filter("split = 'val'"), scored.filter("split = 'test'")).select("sample_id", "p_raw", "p_fire", "y_fire")


COARSE = ("t_max", "t_min", "t_mean")


def first_split(s, d):
    """The first tree's root over values in steps of 20, few enough for every cut to be tried: its feature and threshold,
    and the mean of the weighted labels (-1 and 1) on each side."""
    x = tree_samples(s, d).select("split", "y_fire", *(F.floor(F.col(c) / 20).cast("double").alias(c) for c in COARSE))
    nodes = ml.tree_nodes(s, ml.train_trees(x, list(COARSE), iterations=1, depth=1)).filter("tree = 0")
    side = lambda n: F.max(F.when(F.col("node") == n, F.col("prediction")))
    return nodes.agg(F.max("feature").alias("feature"), F.max("threshold").alias("threshold"), side(2).alias("low"), side(3).alias("high"))


#: The cut with the largest gain in variance: the sum of squared weighted sums over weights of its sides.
FIRST_SPLIT = """WITH t AS (SELECT 2 * y_fire - 1 AS l, CASE WHEN y_fire = 1 THEN (SELECT greatest(1.0, sum(1 - y_fire) / greatest(1, sum(y_fire))) FROM v_smp WHERE split = 'train') ELSE 1 END AS w, t_max, t_min, t_mean FROM v_smp WHERE split = 'train'),
 x AS (SELECT l, w, unnest(['t_max', 't_min', 't_mean']) AS feature, coalesce(floor(unnest([t_max, t_min, t_mean]) / 20), -1e9) AS v FROM t), g AS (SELECT feature, v, sum(w) AS w, sum(w * l) AS s FROM x GROUP BY feature, v),
 c AS (SELECT feature, v, lead(v) OVER o AS v2, sum(w) OVER o AS wl, sum(s) OVER o AS sl, sum(w) OVER (PARTITION BY feature) AS wt, sum(s) OVER (PARTITION BY feature) AS st FROM g WINDOW o AS (PARTITION BY feature ORDER BY v))
 SELECT feature, (v + v2) / 2 AS threshold, round(sl / wl, 6) AS low, round((st - sl) / (wt - wl), 6) AS high FROM c WHERE v2 IS NOT NULL ORDER BY sl * sl / wl + (st - sl) * (st - sl) / (wt - wl) DESC, feature, v LIMIT 1"""


def isotonic(s, d):
    """Fitted on all scores and applied to all of them, stretched so that they lie between and beyond the fitted ones."""
    v = view(s, d, "v_score").select((F.col("p") / 10).alias("p_raw"), F.col("y").alias("y_fire"))
    other = view(s, d, "v_score").select("l_orderkey", "l_linenumber", (F.col("p") * 1.3 - 1).alias("p_raw"))
    return ml.calibrate(v, other).select("l_orderkey", "l_linenumber", "p_fire")


#: The rising fit at each distinct score is the largest over starts, of the least over ends, of the mean between them.
ISOTONIC = """WITH g AS (SELECT p / 10 AS x, sum(y) AS s, count(*) AS n FROM v_score GROUP BY p), m AS (SELECT a.x AS a, b.x AS b, sum(g.s) / sum(g.n) AS v FROM g a JOIN g b ON b.x >= a.x JOIN g ON g.x BETWEEN a.x AND b.x GROUP BY a.x, b.x),
 w AS (SELECT g.x, m.a, min(m.v) AS v FROM g JOIN m ON m.a <= g.x AND m.b >= g.x GROUP BY g.x, m.a), f AS (SELECT x, max(v) AS v FROM w GROUP BY x),
 k AS (SELECT x, v, lead(x) OVER (ORDER BY x) AS x2, lead(v) OVER (ORDER BY x) AS v2 FROM f), q AS (SELECT l_orderkey, l_linenumber, p * 1.3 - 1 AS z FROM v_score)
 SELECT l_orderkey, l_linenumber, round(CASE WHEN z <= (SELECT min(x) FROM f) THEN (SELECT arg_min(v, x) FROM f) WHEN z >= (SELECT max(x) FROM f) THEN (SELECT arg_max(v, x) FROM f) ELSE (SELECT min(v + (v2 - v) * (z - x) / (x2 - x)) FROM k WHERE x <= z AND z < x2) END, 6) AS p_fire FROM q"""


def sequence_stats(s, d):
    """Mean and deviation of each feature over all samples and steps of the sequences."""
    days = view(s, d, "v_day").select("cell_id", "day", "t_max", "p_sum")
    q = joins_time.sequences(view(s, d, "v_smp").select("sample_id", "cell_id", "day"), days, view(s, d, "v_static"), ["t_max", "p_sum"], ["slope"], 3)
    return sampling.sequence_stats(q).select("feature", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"))


QUERIES = {
    "j1_attach_static": (lambda s, d: joins_space.attach_static(view(s, d, "v_day").select("cell_id", "day", "n"), view(s, d, "v_static")), "SELECT v_day.cell_id, day, n, round(elevation, 6) AS elevation, round(slope, 6) AS slope, round(aspect, 6) AS aspect FROM v_day JOIN v_static ON v_static.cell_id = v_day.cell_id"),
    "j3_snap_cell": (lambda s, d: joins_space.snap_cell(view(s, d, "v_pts")).select("pt_id", "cell_id"), "SELECT pt_id, printf('%.2f_%.2f', round_even(lat / 0.25, 0) * 0.25, round_even(lon / 0.25, 0) * 0.25) AS cell_id FROM v_pts"),
    "j4_grid_to_cells": (grid_map, f"WITH {CELLS} SELECT cell_id, pt_id, how FROM g"),
    "j5_windows_to_cells": (windows_to_cells, f"WITH {CELLS} SELECT g.cell_id, window_start, window_end, round(avg(f1), 6) AS f1, round(avg(f2), 6) AS f2 FROM g JOIN v_win ON v_win.cell_id = g.pt_id GROUP BY g.cell_id, window_start, window_end"),
    "j6_attach_windows": (windows(), COVER.format(extra="", fresh="window_end IS NOT NULL")),
    "j6_attach_max_lag": (windows(2), COVER.format(extra="", fresh="date_diff('day', window_end, v_day.day) <= 2")),
    "j6_attach_causal": (windows(None, True), COVER.format(extra=" AND window_end <= day", fresh="window_end IS NOT NULL")),
    "j7_resolve_month": (lambda s, d: joins_time.resolve_month(view(s, d, "v_iv").select("iv_id", "s"), months(s, d), "s"), f"WITH {MONTHS}, k AS (SELECT iv_id, s, max(y * 12 + mo) AS k FROM v_iv JOIN m ON y * 12 + mo <= year(s) * 12 + month(s) GROUP BY iv_id, s) SELECT iv_id, s, CAST((k - 1) // 12 AS INT) AS used_year, CAST((k - 1) % 12 + 1 AS INT) AS used_month FROM k"),
    "j8_pick_tile": (tile_pick, f"WITH {TILES} SELECT pt_id, coalesce((SELECT filename FROM t WHERE t.m = p.m AND t.k = p.q), (SELECT min(filename) FROM t WHERE t.m = p.m AND lon BETWEEN -124.5 AND east AND lat BETWEEN 32 AND 42)) AS filename FROM p"),
    "j9_asof_scene": (scene_days, "WITH w AS (SELECT window_end AS scene, max(f2) AS f2 FROM v_win GROUP BY window_end), d AS (SELECT DISTINCT day FROM v_day) SELECT d.day, scene AS scene_day, round(f2, 6) AS f2 FROM d ASOF LEFT JOIN w ON d.day >= w.scene"),
    "j11_prev_day": (lambda s, d: joins_time.prev_day(view(s, d, "v_hot").groupBy("cell_id", "day").agg(F.max((F.coalesce("flag", F.lit(0)) > 0).cast("int")).alias("fire")), ["cell_id"], "day", "fire", "prev_fire"), "WITH f AS (SELECT cell_id, day, CAST(max(coalesce(flag, 0)) AS INT) AS fire FROM v_hot GROUP BY cell_id, day) SELECT f.cell_id, f.day, f.fire, coalesce(b.fire, 0) AS prev_fire FROM f LEFT JOIN f b ON b.cell_id = f.cell_id AND b.day = f.day - 1"),
    "j15_two_key_lookup": (lambda s, d: joins_space.attach_static(joins_space.snap_cell(view(s, d, "v_pts")).select("pt_id", "cell_lat", "cell_lon"), joins_space.snap_cell(view(s, d, "v_pts")).groupBy("cell_lat", "cell_lon").agg(F.count("*").alias("n")), on=["cell_lat", "cell_lon"]), "WITH g AS (SELECT pt_id, round_even(lat / 0.25, 0) * 0.25 AS cell_lat, round_even(lon / 0.25, 0) * 0.25 AS cell_lon FROM v_pts), k AS (SELECT cell_lat, cell_lon, count(*) AS n FROM g GROUP BY cell_lat, cell_lon) SELECT pt_id, g.cell_lat, g.cell_lon, n FROM g JOIN k ON k.cell_lat = g.cell_lat AND k.cell_lon = g.cell_lon"),
    "j16_map_values": (lambda s, d: joins_time.map_values(view(s, d, "v_smp").select("sample_id", "split"), view(s, d, "v_smp").filter("cell_id % 2 = 0").select("sample_id", F.col("t_max").alias("scalar"))), "SELECT sample_id, split, CASE WHEN cell_id % 2 = 0 THEN round(t_max, 6) END AS scalar FROM v_smp"),
    "j19_full_history": (lambda s, d: joins_time.with_full_history(view(s, d, "v_day").filter("dayofmonth(day) <> 12").select("day"), 7, "day"), "WITH d AS (SELECT DISTINCT day FROM v_day WHERE day(day) <> 12) SELECT day FROM d WHERE (SELECT count(*) FROM d e WHERE e.day BETWEEN d.day - 7 AND d.day - 1) = 7"),
    "w5_sequences": (seqs, "WITH f AS (SELECT cell_id, day, t_max, p_sum FROM v_day WHERE cell_id % 11 <> 0), e AS (SELECT v_smp.sample_id, CAST(2 - date_diff('day', f.day, v_smp.day) AS INT) AS t, f.t_max, f.p_sum, elevation, slope, count(*) OVER (PARTITION BY v_smp.sample_id) AS n FROM v_smp JOIN f ON f.cell_id = v_smp.cell_id AND f.day BETWEEN v_smp.day - 2 AND v_smp.day JOIN v_static ON v_static.cell_id = v_smp.cell_id AND v_static.cell_id % 5 <> 0) SELECT sample_id, t, round(CAST(CAST(t_max AS FLOAT) AS DOUBLE), 2) AS x0, round(CAST(CAST(p_sum AS FLOAT) AS DOUBLE), 2) AS x1, round(CAST(CAST(elevation AS FLOAT) AS DOUBLE), 2) AS x2, round(CAST(CAST(slope AS FLOAT) AS DOUBLE), 2) AS x3 FROM e WHERE n = 3"),
    "w5_sequence_stats": (sequence_stats, "WITH e AS (SELECT v_smp.sample_id, f.t_max, f.p_sum, slope, count(*) OVER (PARTITION BY v_smp.sample_id) AS n FROM v_smp JOIN v_day f ON f.cell_id = v_smp.cell_id AND f.day BETWEEN v_smp.day - 2 AND v_smp.day JOIN v_static ON v_static.cell_id = v_smp.cell_id), a AS (SELECT unnest([0, 1, 2]) AS feature, unnest([CAST(CAST(t_max AS FLOAT) AS DOUBLE), CAST(CAST(p_sum AS FLOAT) AS DOUBLE), CAST(CAST(slope AS FLOAT) AS DOUBLE)]) AS x FROM e WHERE n = 3) SELECT CAST(feature AS INT) AS feature, round(avg(x), 3) AS mean, round(CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END, 3) AS std FROM a GROUP BY feature"),
    "m1_trees": (trees, None),
    "m1_first_split": (first_split, FIRST_SPLIT),
    "m2_isotonic": (isotonic, ISOTONIC),
}
