"""Queries that write a table in the layout of a source and read it again."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.operators import joins_space, quality
from emberframe.plans.views import view
from emberframe.sources import tables
from emberframe.sources.shared import shared_dir, stored


def feature_windows(s, d):
    """V_win as year=/month=/window= files, read with chosen columns and partitions."""
    path = shared_dir(s, "feature-windows")
    w = view(s, d, "v_win").select(F.col("cell_id").cast("string").alias("grid_id"), (F.col("cell_id") % 10 + 32.0).alias("latitude"), (F.lit(-120.0) + F.col("cell_id") % 7).alias("longitude"), "window_start", "window_end", F.round("f1", 6).alias("f1"), F.round("f2", 6).alias("f2"), F.year("window_start").alias("year"), F.month("window_start").alias("month"), F.format_string("%03d", F.dayofmonth("window_start")).alias("window"))
    w.write.partitionBy("year", "month", "window").option("header", True).csv(path)
    got = tables.read_feature_windows(s, path, ["f1"], [2024], [1])
    return got.select("grid_id", "window_start", "window_end", "f1", "year", "month", "window")


def daily_cache(s, d):
    """V_day as a cache by year and month, read with five days of warm-up."""
    path = shared_dir(s, "daily-cache")
    tables.write_table(view(s, d, "v_day").withColumns({"date": F.col("day"), "year": F.year("day"), "month": F.month("day")}), path, ["year", "month"])
    return tables.read_daily(s, path, "2024-01-12", "2024-01-20", 5).select("cell_id", "date", "n")


def splits(s, d):
    """V_smp as a dataset by split; one split is written again, which replaces that partition alone."""
    path = shared_dir(s, "splits")
    smp = view(s, d, "v_smp").select("sample_id", "y_fire", "split")
    tables.write_table(smp, path, ["split"])
    tables.write_table(smp.filter("split = 'val'").withColumn("y_fire", F.lit(9)), path, ["split"])
    return tables.load_splits(s, path, ())


def csv_sink(s, d):
    path = shared_dir(s, "csv")
    tables.write_csv(view(s, d, "v_day").select("cell_id", "day", "n"), path)
    return s.read.option("header", True).schema("cell_id long, day date, n long").csv(path)


def boundary(s, d):
    """The inner half of the points' box as a GeoJSON file; the points that the boundary read from it holds."""
    path = shared_dir(s, "boundary")
    p = view(s, d, "v_pts")
    ends = p.agg(*((F.round(F.min(c) * a + F.max(c) * (1 - a), 3) + 0.0005).alias(n) for c, n, a in (("lon", "w", 0.75), ("lon", "e", 0.25), ("lat", "s", 0.75), ("lat", "n", 0.25))))
    ring = F.array(*(F.array(*(F.col(c) for c in xy)) for xy in ("ws", "es", "en", "wn", "ws")))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry")))
    ends.select(feature.alias("value")).write.text(path)
    return joins_space.in_polygon(p, tables.read_boundary(s, path)).select("pt_id")


def file_audit(s, d):
    """V_day as one file a cell; a manifest of them in which some sizes and digests are wrong, some files are not listed,
    and some listed ones do not exist."""
    path = shared_dir(s, "audited")
    tables.write_csv_by(view(s, d, "v_day").select("cell_id", "day", "n"), path, "cell_id")
    cell = F.regexp_extract("path", "cell_id=([0-9]+)", 1).cast("long")
    with tables.many_files(s):
        files = tables.with_content(tables.list_files(s, path))
        seen = stored(files.select(cell.alias("cell_id"), tables.file_name("path", 2).alias("name"), "length", F.base64(F.unhex(F.md5("content"))).alias("md5")), "audit-files")
    kind = F.col("cell_id") % 5
    listed = seen.filter(kind != 3).select("name", F.when(kind == 1, F.col("length") + 1).when(kind != 4, F.col("length")).alias("size"), F.when(kind == 2, "no such digest").when(kind != 4, F.col("md5")).alias("md5"))
    gone = seen.filter(kind == 0).select(F.concat(F.lit("gone-"), F.col("cell_id").cast("string")).alias("name"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("string").alias("md5"))
    got = tables.audit_files(s, path, listed.unionByName(gone), 2).join(seen.select("name", "cell_id").hint("merge"), "name", "left")
    return got.select(F.coalesce("cell_id", F.regexp_extract("name", "gone-([0-9]+)", 1).cast("long")).alias("cell_id"), "status")


def metadata_sink(s, d):
    path = shared_dir(s, "metadata")
    tables.write_metadata(quality.dataset_metadata(view(s, d, "v_smp"), ["t_max"], day="day"), path)
    return s.read.schema("split string, n long, n_pos long, years string, features string").json(path)


QUERIES = {
    "s7_boundary": (boundary, "WITH b AS (SELECT round(min(lon) * 0.75 + max(lon) * 0.25, 3) + 0.0005 AS w, round(min(lon) * 0.25 + max(lon) * 0.75, 3) + 0.0005 AS e, round(min(lat) * 0.75 + max(lat) * 0.25, 3) + 0.0005 AS s, round(min(lat) * 0.25 + max(lat) * 0.75, 3) + 0.0005 AS n FROM v_pts) SELECT pt_id FROM v_pts, b WHERE lon BETWEEN w AND e AND lat BETWEEN s AND n"),
    "s14_file_audit": (file_audit, "WITH c AS (SELECT DISTINCT cell_id FROM v_day) SELECT cell_id, CASE cell_id % 5 WHEN 1 THEN 'mismatched' WHEN 2 THEN 'mismatched' WHEN 3 THEN 'unlisted' ELSE 'verified' END AS status FROM c UNION ALL SELECT cell_id, 'missing' FROM c WHERE cell_id % 5 = 0"),
    "s12_metadata_sink": (metadata_sink, "SELECT split, count(*) AS n, count(*) FILTER (y_fire = 1) AS n_pos, '2024' AS years, 't_max' AS features FROM v_smp GROUP BY split"),
    "s1_feature_windows": (feature_windows, "SELECT CAST(cell_id AS VARCHAR) AS grid_id, window_start, window_end, round(f1, 6) AS f1, CAST(2024 AS INT) AS year, CAST(1 AS INT) AS month, printf('%03d', day(window_start)) AS window FROM v_win WHERE year(window_start) = 2024 AND month(window_start) = 1"),
    "s6_daily_cache": (daily_cache, "SELECT cell_id, day AS date, n FROM v_day WHERE day BETWEEN DATE '2024-01-07' AND DATE '2024-01-20'"),
    "s9_splits": (splits, "SELECT sample_id, CASE WHEN split = 'val' THEN 9 ELSE y_fire END AS y_fire, split FROM v_smp"),
    "s11_csv_sink": (csv_sink, "SELECT cell_id, day, n FROM v_day"),
}
