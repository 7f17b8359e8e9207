"""Queries of raster operators on pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.operators import raster
from emberframe.plans.views import view
from emberframe.sources.tables import grid

DX, DY = 30.0, 20.0
GRAD = """g AS (SELECT *, CASE WHEN lag(1) OVER c IS NULL AND lead(1) OVER c IS NULL THEN NULL WHEN lag(1) OVER c IS NULL THEN (lead(value) OVER c - value) / 20 WHEN lead(1) OVER c IS NULL THEN (value - lag(value) OVER c) / 20 ELSE (lead(value) OVER c - lag(value) OVER c) / 40 END AS dy,
 CASE WHEN lag(1) OVER r IS NULL AND lead(1) OVER r IS NULL THEN NULL WHEN lag(1) OVER r IS NULL THEN (lead(value) OVER r - value) / 30 WHEN lead(1) OVER r IS NULL THEN (value - lag(value) OVER r) / 30 ELSE (lead(value) OVER r - lag(value) OVER r) / 60 END AS dx FROM v_ras WINDOW c AS (PARTITION BY col ORDER BY row), r AS (PARTITION BY row ORDER BY col))"""
H = "(SELECT max(row) + 1 FROM v_ras)"
AREA = grid(-124.5, 32.4, -114.0, 42.1, 0.1)


def pixels(s, d):
    return view(s, d, "v_ras")


def height(s, d):
    """Rows of the grid."""
    return int(pixels(s, d).agg(F.max("row")).first()[0]) + 1


def months(s, d):
    return pixels(s, d).select((F.col("row") % 3).alias("month"), (F.col("row") % 50).alias("row"), "col", "value", F.floor(F.col("row") / 50).cast("int").alias("tile"))


MONTHS = "t AS (SELECT row % 3 AS month, row % 50 AS row, col, value, CAST(floor(row / 50) AS INT) AS tile FROM v_ras)"


def points(s, d):
    return view(s, d, "v_pts").select("pt_id", "lat", "lon", F.when(F.col("pt_id") % 9 != 0, F.col("lat") * 3).alias("v"))


def sampled(s, d):
    """Layers over the area of interest from the pixel table, at the points."""
    lay = pixels(s, d).select(F.concat(F.lit("l"), (F.col("row") % 2).cast("string")).alias("layer"), F.floor(F.col("row") / 2).cast("int").alias("row"), "col", "value")
    return raster.sample_at(view(s, d, "v_pts"), lay, AREA, ["l0", "l1"], strict=False).select("pt_id", "l0", "l1")


def patches(s, d):
    pts = pixels(s, d).filter("fire = 1").select((F.col("row") * 100 + F.col("col")).alias("sample_id"), "row", "col")
    return raster.extract_patches(pts, pixels(s, d), height(s, d), 100, 4)


def clusters(s, d):
    return raster.fire_clusters(pixels(s, d), height(s, d), 100, 1, 5)


DILATED = f"m AS (SELECT DISTINCT CAST(row + a AS BIGINT) AS r, CAST(col + b AS BIGINT) AS c FROM v_ras, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(a, b) WHERE fire = 1 AND row + a BETWEEN 0 AND {H} - 1 AND col + b BETWEEN 0 AND 99)"


#: The three largest clusters (components of DILATED), their squares, and the first square without fire away from them.
DAY_PATCHES = f"""WITH RECURSIVE {DILATED}, w AS (SELECT r, c, r * 100 + c AS root FROM m UNION SELECT m.r, m.c, w.root FROM w JOIN m ON abs(m.r - w.r) + abs(m.c - w.c) = 1 WHERE w.root < m.r * 100 + m.c),
 k AS (SELECT r, c, min(root) AS root FROM w GROUP BY r, c), z AS (SELECT CAST(floor(avg(r)) AS INT) AS r, CAST(floor(avg(c)) AS INT) AS c FROM k GROUP BY root ORDER BY count(*) DESC, root LIMIT 3),
 g AS (SELECT t, l FROM (SELECT unnest(range(0, greatest(1, CAST({H} AS BIGINT) - 16))) AS t) a, range(0, 84) b(l)),
 f AS (SELECT t, l FROM g WHERE NOT EXISTS (SELECT 1 FROM v_ras v WHERE fire = 1 AND v.row BETWEEN t AND t + 15 AND v.col BETWEEN l AND l + 15)),
 o AS (SELECT t, l FROM f ORDER BY CAST(EXISTS (SELECT 1 FROM z WHERE sqrt((t + 8 - r) * (t + 8 - r) + (l + 8 - c) * (l + 8 - c)) < 8) AS INT), CAST(('0x' || substr(md5(concat(CAST(t AS VARCHAR(9)), '|', CAST(l AS VARCHAR(9)), '|42')), 1, 8)) AS BIGINT), t, l LIMIT 1)
 SELECT CAST(least(greatest(r - 8, 0), {H} - 16) AS INT) AS top, CAST(least(greatest(c - 8, 0), 84) AS INT) AS "left", 'fire' AS kind FROM z UNION ALL SELECT CAST(t AS INT), CAST(l AS INT), 'background' FROM o"""


def background(s, d):
    p = pixels(s, d)
    h = height(s, d)
    cands = p.filter(f"row < {h} - 4 AND col < 96").select(F.col("row").alias("top"), F.col("col").alias("left"))
    cen = p.filter("value > 280").select(F.col("row").alias("centre_row"), F.col("col").alias("centre_col"))
    return raster.background(cands, p.filter("fire = 1"), cen, 6.0, 4, 20)


def fused(s, d):
    """Days are groups of pixel rows; optical scenes and aerosol are missing on some of them."""
    p = pixels(s, d).select(F.expr("date_add(DATE '2024-01-01', CAST(row % 10 AS INT))").alias("date"), F.floor(F.col("row") / 10).cast("int").alias("row"), "col", "value", "fire")
    opt = p.filter("dayofmonth(date) IN (1, 4, 8)").select("date", "row", "col", F.col("value").alias("o1"))
    aer = p.filter("dayofmonth(date) IN (3, 6)").select("date", "row", "col", (F.col("value") * 2).alias("a1"))
    wx = p.select("date", "row", "col", (F.col("value") + 1).alias("w1"))
    ter = p.filter("dayofmonth(date) = 1").select("row", "col", (F.col("value") + 2).alias("t1"))
    days = p.filter("dayofmonth(date) > 1").select("date").distinct()
    return raster.fuse_channels(days, opt, wx, aer, ter, p.select("date", "row", "col", "fire"), {"optical": ["o1"], "weather": ["w1"], "aerosol": ["a1"], "terrain": ["t1"]})


def regridded(s, d):
    """The whole grid on a coarser one that lies within it."""
    h = height(s, d)
    return raster.regrid_bilinear(pixels(s, d), {"west": 0.0, "north": float(h), "dx": 1.0, "dy": 1.0, "height": h, "width": 100}, {"west": 3.0, "north": h - 2.0, "dx": 1.5, "dy": 1.25, "height": h * 3 // 4, "width": 62})


def back_patches(s, d):
    return raster.day_patches(pixels(s, d), height(s, d), 100, 16, 1, 8.0)


QUERIES = {
    "r1_slope_aspect": (lambda s, d: raster.slope_aspect(pixels(s, d), DX, DY).select("row", "col", "slope", "aspect"), f"WITH {GRAD} SELECT row, col, CASE WHEN value IS NOT NULL THEN round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) END AS slope, CASE WHEN value IS NOT NULL THEN round((360 + degrees(atan2(dx, -dy))) % 360, 6) END AS aspect FROM g"),
    "r2_hillshade": (lambda s, d: raster.hillshade(pixels(s, d), DX, DY).select("row", "col", "hillshade"), f"WITH {GRAD} SELECT row, col, CASE WHEN value IS NOT NULL AND dx IS NOT NULL AND dy IS NOT NULL THEN round(greatest(least(255 * (cos(radians(45)) * cos(atan(sqrt(dx * dx + dy * dy))) + sin(radians(45)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(radians(135) - atan2(dx, -dy))), 255), 0), 6) END AS hillshade FROM g"),
    "r3_tri_wrap": (lambda s, d: raster.tri(pixels(s, d), height(s, d), 100), f"WITH o AS (SELECT a, b FROM range(-1, 2) x(a), range(-1, 2) y(b) WHERE a <> 0 OR b <> 0) SELECT p.row, p.col, round(sqrt(sum((p.value - coalesce(q.value, 0)) * (p.value - coalesce(q.value, 0))) / 8), 6) AS tri FROM v_ras p, o JOIN v_ras q ON q.row = (p.row + a + {H}) % {H} AND q.col = (p.col + b + 100) % 100 WHERE p.value IS NOT NULL GROUP BY p.row, p.col"),
    "r3_tri_drop": (lambda s, d: raster.tri(pixels(s, d), height(s, d), 100, edge="drop"), "WITH o AS (SELECT a, b FROM range(-1, 2) x(a), range(-1, 2) y(b) WHERE a <> 0 OR b <> 0) SELECT p.row, p.col, round(sqrt(avg((p.value - q.value) * (p.value - q.value))), 6) AS tri FROM v_ras p, o JOIN v_ras q ON q.row = p.row + a AND q.col = p.col + b WHERE p.value IS NOT NULL GROUP BY p.row, p.col"),
    "r4_tpi": (lambda s, d: raster.tpi(pixels(s, d), 2).select("row", "col", "tpi"), f"WITH o AS (SELECT a, b FROM range(-2, 3) x(a), range(-2, 3) y(b)) SELECT p.row, p.col, CASE WHEN p.value IS NOT NULL THEN round(p.value - sum(q.value) / count(q.value), 6) + 0 END AS tpi FROM v_ras p, o JOIN v_ras q ON q.row = least(greatest(p.row + a, 0), {H} - 1) AND q.col = least(greatest(p.col + b, 0), 99) GROUP BY p.row, p.col, p.value"),
    "r5_sample_at": (sampled, "WITH l AS (SELECT row % 2 AS k, CAST(floor(row / 2) AS INT) AS r, col, value FROM v_ras), i AS (SELECT pt_id, CAST(floor((42.1 - lat) / 0.1) AS INT) AS r, CAST(floor((lon - -124.5) / 0.1) AS INT) AS c FROM v_pts) SELECT pt_id, round(max(value) FILTER (k = 0), 6) AS l0, round(max(value) FILTER (k = 1), 6) AS l1 FROM i LEFT JOIN l ON l.r = i.r AND l.col = i.c GROUP BY pt_id"),
    "r6_extract_patches": (patches, f"WITH o AS (SELECT row * 100 + col AS sample_id, least(greatest(row - 2, 0), {H} - 4) AS t, least(greatest(col - 2, 0), 96) AS l FROM v_ras WHERE fire = 1) SELECT sample_id, CAST(row - t AS INT) AS dr, CAST(col - l AS INT) AS dc, round(coalesce(value, 0), 6) AS value FROM o JOIN v_ras ON row BETWEEN t AND t + 3 AND col BETWEEN l AND l + 3"),
    "r7_rasterize": (lambda s, d: raster.rasterize(points(s, d), AREA, ["v"], "pt_id").select("row", "col", "v"), "WITH i AS (SELECT CAST(floor((42.1 - lat) / 0.1) AS INT) AS row, CAST(floor((lon - -124.5) / 0.1) AS INT) AS col, pt_id, CASE WHEN pt_id % 9 <> 0 THEN lat * 3 END AS v FROM v_pts) SELECT row, col, round(arg_max(v, pt_id) FILTER (v IS NOT NULL), 6) AS v FROM i WHERE row BETWEEN 0 AND 96 AND col BETWEEN 0 AND 104 GROUP BY row, col"),
    "r8_fire_clusters": (clusters, f"WITH RECURSIVE {DILATED}, w AS (SELECT r, c, r * 100 + c AS root FROM m UNION SELECT m.r, m.c, w.root FROM w JOIN m ON abs(m.r - w.r) + abs(m.c - w.c) = 1 WHERE w.root < m.r * 100 + m.c), k AS (SELECT r, c, min(root) AS root FROM w GROUP BY r, c) SELECT count(*) AS size, CAST(floor(avg(r)) AS INT) AS centre_row, CAST(floor(avg(c)) AS INT) AS centre_col, root AS first_pixel FROM k GROUP BY root ORDER BY size DESC, root LIMIT 5"),
    "r9_day_patches": (back_patches, DAY_PATCHES),
    "r10_regrid_bilinear": (regridded, "WITH h AS (SELECT CAST(max(row) + 1 AS BIGINT) AS h FROM v_ras), t AS (SELECT r, c, (h - ((h - 2.0) - (r + 0.5) * 1.25)) - 0.5 AS fr, (3.0 + (c + 0.5) * 1.5) - 0.5 AS fc FROM h, range(0, 62) b(c), (SELECT unnest(range(0, h * 3 // 4)) AS r FROM h) a), k AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, floor(fr) + a AS sr, floor(fc) + b AS sc, CASE a WHEN 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END * CASE b WHEN 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END AS w FROM t, range(0, 2) x(a), range(0, 2) y(b)) SELECT k.row, k.col, CASE WHEN count(*) = count(value) THEN round(CAST(sum(value * w) AS DOUBLE), 6) END AS value FROM k LEFT JOIN v_ras v ON v.row = sr AND v.col = sc WHERE w > 0 GROUP BY k.row, k.col"),
    "r12_last_day_rows": (lambda s, d: raster.last_day_rows(pixels(s, d).withColumn("t", F.col("row") % 7), ["value"]).select("row", "col", "value"), "SELECT row, col, round(value, 6) AS value FROM v_ras WHERE row % 7 = 6 AND value IS NOT NULL"),
    "a9_mosaic_mean": (lambda s, d: raster.mosaic_mean(months(s, d)), f"WITH {MONTHS} SELECT month, row, col, round(avg(value), 6) AS value FROM t GROUP BY month, row, col"),
    "a10_mosaic_first": (lambda s, d: raster.mosaic_first(months(s, d), "tile"), f"WITH {MONTHS} SELECT row, col, round(arg_min(value, tile) FILTER (value IS NOT NULL), 6) AS value FROM t GROUP BY row, col"),
    "a11_composite_median": (lambda s, d: raster.composite(months(s, d), "median", ("month", "col"), mask=F.col("value") < 200), f"WITH {MONTHS} SELECT month, col, round(quantile_cont(value, 0.5) FILTER (value < 200), 6) AS value, count(*) AS n_scenes FROM t GROUP BY month, col"),
    "a11_composite_max": (lambda s, d: raster.composite(months(s, d), "max", ("month", "row")), f"WITH {MONTHS} SELECT month, row, round(max(value), 6) AS value, count(*) AS n_scenes, CAST(count(value) > 0 AS INT) AS label FROM t GROUP BY month, row"),
    "a11_multi_product": (lambda s, d: raster.multi_product(months(s, d).withColumn("product", F.concat(F.lit("p"), (F.col("tile") % 2).cast("string"))), ["p0", "p1"], ("month", "row")), f"WITH {MONTHS} SELECT month, row, round(avg(value) FILTER (tile % 2 = 0), 6) AS p0, round(avg(value) FILTER (tile % 2 = 1), 6) AS p1 FROM t GROUP BY month, row"),
    "a14_coarsen": (lambda s, d: raster.coarsen(pixels(s, d), 7), "SELECT CAST(floor(row / 7) AS INT) AS row, CAST(floor(col / 7) AS INT) AS col, round(avg(value), 6) AS value FROM v_ras GROUP BY floor(row / 7), floor(col / 7)"),
    "a33_patch_points": (lambda s, d: raster.patch_points(pixels(s, d).select(F.floor(F.col("row") / 10).cast("int").alias("patch"), "row", "col", (F.col("value") / 300).alias("p"), "fire"), -124.0, 42.0, 0.01, 0.02), "SELECT CAST(floor(row / 10) AS INT) AS patch, round(avg(value / 300), 6) AS mean_p, CAST(max(CAST(fire > 0 AS INT)) AS INT) AS any_fire, round(-124 + (min(col) + max(col) + 1) / 2.0 * 0.01, 6) AS lon, round(42 - (min(row) + max(row) + 1) / 2.0 * 0.02, 6) AS lat FROM v_ras GROUP BY floor(row / 10)"),
    "j17_fuse_channels": (fused, "WITH p AS (SELECT DATE '2024-01-01' + CAST(row % 10 AS INT) AS date, CAST(row % 10 AS INT) + 1 AS k, CAST(floor(row / 10) AS INT) AS row, col, value, fire FROM v_ras) SELECT p.date, p.row, p.col, round(o.value, 6) AS o1, round(p.value + 1, 6) AS w1, round(a.value * 2, 6) AS a1, round(t.value + 2, 6) AS t1, coalesce(f.fire, 0) AS prev_fire FROM p LEFT JOIN p o ON o.row = p.row AND o.col = p.col AND o.k = CASE WHEN p.k >= 8 THEN 8 WHEN p.k >= 4 THEN 4 ELSE 1 END LEFT JOIN p a ON a.row = p.row AND a.col = p.col AND a.k = CASE WHEN p.k >= 6 THEN 6 WHEN p.k >= 3 THEN 3 END LEFT JOIN p t ON t.row = p.row AND t.col = p.col AND t.k = 1 LEFT JOIN p f ON f.row = p.row AND f.col = p.col AND f.k = p.k - 1 WHERE p.k > 1"),
    "j20_background": (background, f"WITH c AS (SELECT row AS t, col AS l FROM v_ras WHERE row < {H} - 4 AND col < 96), f AS (SELECT t, l FROM c WHERE NOT EXISTS (SELECT 1 FROM v_ras v WHERE fire = 1 AND v.row BETWEEN t AND t + 3 AND v.col BETWEEN l AND l + 3)), z AS (SELECT row AS r, col AS c FROM v_ras WHERE value > 280) SELECT t AS top, l AS \"left\" FROM f ORDER BY CAST(EXISTS (SELECT 1 FROM z WHERE sqrt((t + 2 - r) * (t + 2 - r) + (l + 2 - c) * (l + 2 - c)) < 6) AS INT), CAST(('0x' || substr(md5(concat(CAST(t AS VARCHAR(9)), '|', CAST(l AS VARCHAR(9)), '|42')), 1, 8)) AS BIGINT), t, l LIMIT 20"),
}
