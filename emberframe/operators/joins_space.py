"""Joins between points, cells, tiles and polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberframe.functions import cell_id, snap
from emberframe.sources.shared import stored

#: Where the mosaic's tiles meet, and the offset of the far ones, fixed values.
LAT_SPLIT, LON_SPLIT, FAR_OFFSET = 33.616754562320736, -115.90153627238479, 9472


def snap_cell(df: DataFrame, res: float = 0.25, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.withColumns({"cell_lat": snap(F.col(lat), res), "cell_lon": snap(F.col(lon), res)}).withColumn("cell_id", cell_id(F.col("cell_lat"), F.col("cell_lon")))


def _bin(x: str, res: float) -> Column:
    return F.floor(F.col(x) / res).cast("int")


def map_grid_to_cells(cells: DataFrame, pts: DataFrame, res: float = 0.25) -> DataFrame:
    """(cell_id, pt_id, how): grid points inside each cell's half-open box; a cell without any gets its nearest point
    (squared degrees, ties to the smaller id), however far it is. Rows without a place take no part.

    Points are keyed by boxes of the cell size, of which a cell's box meets at most four; the rest is `nearest_points`."""
    p = placed(pts).select("pt_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"), _bin("lat", res).alias("by"), _bin("lon", res).alias("bx"))
    c = placed(cells).select("cell_id", F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    half = res / 2
    own = c.select("*", F.explode(F.array_distinct(F.array(*(F.struct(F.floor((F.col("clat") + dy) / res).cast("int").alias("by"), F.floor((F.col("clon") + dx) / res).cast("int").alias("bx")) for dy in (-half, half) for dx in (-half, half))))).alias("b")).select("cell_id", "clat", "clon", "b.*")
    inside = own.join(p, ["by", "bx"]).filter((F.col("plat") >= F.col("clat") - half) & (F.col("plat") < F.col("clat") + half) & (F.col("plon") >= F.col("clon") - half) & (F.col("plon") < F.col("clon") + half)).select("cell_id", "pt_id", F.lit("in_cell").alias("how"))
    out = stored(inside, "cells-inside")
    rest = placed(cells).join(out.select("cell_id").distinct(), "cell_id", "left_anti")
    return out.unionByName(nearest_points(rest, pts, res).select("cell_id", "pt_id", F.lit("nearest").alias("how")))


def placed(df: DataFrame) -> DataFrame:
    return df.filter("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")


#: Places that a finest box may hold before boxes get finer, how often they may, and the boxes of a level that are broadcast.
FULL, FINER, FEW = 32, 12, 10_000


def pyramid(pts: DataFrame, res: float) -> tuple[DataFrame, DataFrame, list[int]]:
    """(places, boxes, rows of each level): the different places of points with their smallest id, and the boxes that hold
    any: (level, by, bx, south, north, west, east), each level four times as coarse as the one below, up to a few boxes. The sides
    are those of the places inside, so that each of them touches one. Level 0 has the side `res`, or finer ones where more
    than FULL places lie in one box."""
    spots = placed(pts).groupBy(F.col("lat").alias("plat"), F.col("lon").alias("plon")).agg(F.min("pt_id").alias("pt_id"))
    spots = stored(spots, "places")
    side = res
    for finer in range(FINER + 1):
        at = spots.groupBy(F.floor(F.col("plat") / side).alias("by"), F.floor(F.col("plon") / side).alias("bx")).count()
        found = at.agg(F.max("count").alias("most"), (F.max("by") - F.min("by")).alias("high"), (F.max("bx") - F.min("bx")).alias("wide")).first()
        if finer == FINER or (found["most"] or 0) <= FULL:
            break
        side /= 4
    keyed = spots.select("*", F.floor(F.col("plat") / side).alias("by"), F.floor(F.col("plon") / side).alias("bx"))
    top = 0
    while max(found["high"] or 0, found["wide"] or 0) >> (2 * top) > 4:
        top += 1
    up = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("by", 2 * k).alias("by"), F.shiftright("bx", 2 * k).alias("bx")) for k in range(top + 1)))
    each = keyed.select(F.inline(up), "plat", "plon")
    boxes = stored(each.groupBy("level", "by", "bx").agg(F.min("plat").alias("south"), F.max("plat").alias("north"), F.min("plon").alias("west"), F.max("plon").alias("east")), "pyramid")
    sizes = {r["level"]: r["count"] for r in boxes.groupBy("level").count().collect()}
    return keyed, boxes, [sizes.get(k, 0) for k in range(top + 1)]


def _least(at: str, low: str, high: str) -> Column:
    return F.greatest(F.col(low) - F.col(at), F.col(at) - F.col(high), F.lit(0.0))


def _most() -> Column:
    """Squared distance within which a box surely holds a point: one lies on its nearer side, at the far end at worst."""
    near = lambda at, low, high: F.least(F.abs(F.col(at) - F.col(low)), F.abs(F.col(at) - F.col(high)))
    far = lambda at, low, high: F.greatest(F.abs(F.col(at) - F.col(low)), F.abs(F.col(at) - F.col(high)))
    y, x = ("clat", "south", "north"), ("clon", "west", "east")
    return F.least(near(*y) ** 2 + far(*x) ** 2, near(*x) ** 2 + far(*y) ** 2)


def descent(cells: DataFrame, boxes: DataFrame, sizes: list[int]) -> list[DataFrame]:
    """For each level from the top: (cell_id, clat, clon, by, bx), the boxes that may hold the cell's nearest point. A box
    stays if its least distance is within the smallest distance by which some box surely has a point."""
    c, by = cells.select("cell_id", F.col("lat").alias("clat"), F.col("lon").alias("clon")).distinct(), ["cell_id", "clat", "clon"]
    out: list[DataFrame] = []
    for level in range(len(sizes) - 1, -1, -1):
        own = boxes.filter(F.col("level") == level).drop("level")
        own = F.broadcast(own) if sizes[level] <= FEW else own
        if out:  # up to 16 boxes inside each box of the level above
            met = out[-1].withColumnsRenamed({"by": "py", "bx": "px"}).join(own.withColumns({"py": F.shiftright("by", 2), "px": F.shiftright("bx", 2)}), ["py", "px"])
        else:  # the top level has 36 boxes at most, as constants
            names = ("by", "bx", "south", "north", "west", "east")
            met = c.select("*", F.inline(F.array(*(F.struct(*(F.lit(r[n]).alias(n) for n in names)) for r in own.collect()))))
        bound = F.min(_most()).over(Window.partitionBy(*by))
        met = met.withColumn("bound", bound).filter(_least("clat", "south", "north") ** 2 + _least("clon", "west", "east") ** 2 <= F.col("bound") * (1 + 1e-9) + 1e-15)
        out.append(met.select(*by, "by", "bx"))
    return out


def nearest_points(cells: DataFrame, pts: DataFrame, res: float = 0.25) -> DataFrame:
    """(cell_id, pt_id, d): the nearest point of each cell's middle and its squared distance, ties to the smaller id; nothing
    if there are no points. Cells descend a pyramid of boxes and meet the points of the boxes that are left: a few rows a
    cell, wherever the points are."""
    spots, boxes, sizes = pyramid(pts, res)
    if not sizes[0]:
        return cells.select("cell_id", F.lit(None).cast(pts.schema["pt_id"].dataType).alias("pt_id"), F.lit(None).cast("double").alias("d")).limit(0)
    met = descent(placed(cells), boxes, sizes)[-1].join(spots, ["by", "bx"])
    dist = (F.col("plat") - F.col("clat")) ** 2 + (F.col("plon") - F.col("clon")) ** 2
    return met.groupBy("cell_id").agg(F.min(F.struct(dist.alias("d"), F.col("pt_id").alias("pt_id"))).alias("m")).select("cell_id", "m.pt_id", "m.d")


def windows_to_cells(win: DataFrame, mapping: DataFrame, cols: list[str], grid: str = "pt_id") -> DataFrame:
    """Mean of each window's grid values over the points of a cell."""
    return win.join(mapping.select("cell_id", grid), grid).groupBy("cell_id", "window_start", "window_end").agg(*(F.avg(c).alias(c) for c in cols))


def attach_static(df: DataFrame, dim: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Inner join with one row per key of a dimension table. Spark broadcasts it if it is under the session's limit."""
    keys = on or ["cell_id"]
    return df.join(dim.dropDuplicates(keys), keys)


def quadrant(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.when(lat >= LAT_SPLIT, 0).otherwise(FAR_OFFSET), F.when(lon < LON_SPLIT, 0).otherwise(FAR_OFFSET)


def pick_tile(df: DataFrame, tiles: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Tile of the row's month and quadrant; without one, the first tile of the month (by name) whose bounds hold the
    point; else null. tiles: filename, year, month, y_offset, x_offset, west, south, east, north."""
    y, x = quadrant(F.col(lat), F.col(lon))
    keyed = df.withColumns({"y_offset": y, "x_offset": x})
    first = tiles.groupBy("year", "month", "y_offset", "x_offset").agg(F.min("filename").alias("by_quadrant"))
    bounds = tiles.groupBy("year", "month").agg(F.sort_array(F.collect_list(F.struct("filename", "west", "south", "east", "north"))).alias("__tiles"))  # a few a month
    holds = F.filter("__tiles", lambda t: F.col(lon).between(t["west"], t["east"]) & F.col(lat).between(t["south"], t["north"]))
    out = keyed.join(first, ["year", "month", "y_offset", "x_offset"], "left").join(bounds, ["year", "month"], "left")
    return out.withColumn("filename", F.coalesce("by_quadrant", F.get(holds, F.lit(0))["filename"])).drop("by_quadrant", "__tiles", "y_offset", "x_offset")


EDGE = ("x1", "y1", "x2", "y2")


def edge_table(spark: SparkSession, edges: DataFrame | list[tuple[float, float, float, float]]) -> DataFrame:
    """Edges (x1, y1, x2, y2) of closed rings as a table."""
    return edges if isinstance(edges, DataFrame) else spark.createDataFrame([tuple(map(float, e)) for e in edges], ", ".join(f"{c} double" for c in EDGE))


def _straddles(e: Column, y: Column) -> Column:
    return (e["y1"] > y) != (e["y2"] > y)


def _cut_at(e: Column, y: Column) -> Column:
    """Where the line of an edge is at height y."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(e["y2"] == e["y1"], 1.0).otherwise(e["y2"] - e["y1"]) + e["x1"]


def polygon_index(edges: DataFrame) -> tuple[DataFrame, dict | None]:
    """(cells, grid) of closed rings: the cells (cy, cx, odd, edges) of a square grid that hold anything of the inside. `odd`
    tells whether the cell's lower right corner is inside, `edges` holds the edges that pass through the cell, null if none
    does: then all of the cell is like its corner. The grid has about four cells for each edge, a million at most, and its
    lines lie where no coordinate of a map is likely to be. Without edges, no grid."""
    e = F.struct(*EDGE)
    low, high = (lambda a, b: F.least(F.min(a), F.min(b))), (lambda a, b: F.greatest(F.max(a), F.max(b)))
    box = edges.agg(low("x1", "x2").alias("west"), high("x1", "x2").alias("east"), low("y1", "y2").alias("south"), high("y1", "y2").alias("north"), F.count("*").alias("n")).first()
    if not box["n"]:
        return edges.sparkSession.createDataFrame([], "cy int, cx int, odd int, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"), None
    n = 1
    while n < min(1000, 2 * box["n"] ** 0.5):
        n *= 2
    step = max(box["east"] - box["west"], box["north"] - box["south"], 1e-9) / n
    g = {"x0": box["west"] - step * 0.3819660112501051, "y0": box["south"] - step * 0.2360679774997898, "step": step, "n": n + 2, **{k: box[k] for k in ("west", "east", "south", "north")}}
    of = lambda x, at, slack=0.0: F.floor((x - g[at]) / step + slack).cast("int")
    rows = edges.select(*EDGE, e.alias("e"), F.explode(F.sequence(of(F.least("y1", "y2"), "y0", -1e-6), of(F.greatest("y1", "y2"), "y0", 1e-6))).alias("cy"))
    floor = F.col("cy") * step + g["y0"]
    inside = lambda y: F.least(F.greatest(y, F.least("y1", "y2")), F.greatest("y1", "y2"))
    cut = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(_cut_at(F.col("e"), inside(y)))
    other = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x2")).otherwise(_cut_at(F.col("e"), inside(y)))
    span = rows.withColumns({"__a": cut(floor - step * 1e-6), "__b": other(floor + step * (1 + 1e-6))})
    met = span.select("e", "cy", F.explode(F.sequence(of(F.least("__a", "__b"), "x0", -1e-6), of(F.greatest("__a", "__b"), "x0", 1e-6))).alias("cx"))
    held = met.groupBy("cy", "cx").agg(F.collect_list("e").alias("edges"))
    crossed = rows.filter(_straddles(F.col("e"), floor)).select("cy", (F.ceil((_cut_at(F.col("e"), floor) - g["x0"]) / step) - 2).cast("int").alias("cx")).groupBy("cy", "cx").agg(F.count("*").alias("k"))
    grid = edges.sparkSession.range(g["n"] * g["n"]).select(F.floor(F.col("id") / g["n"]).cast("int").alias("cy"), (F.col("id") % g["n"]).cast("int").alias("cx"))
    right = Window.partitionBy("cy").orderBy(F.col("cx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    odd = grid.join(crossed, ["cy", "cx"], "left").withColumn("odd", (F.coalesce(F.sum("k").over(right), F.lit(0)) % 2).cast("int")).drop("k")
    return odd.join(held, ["cy", "cx"], "left").filter("odd = 1 OR edges IS NOT NULL"), g


def in_polygon(df: DataFrame, edges: DataFrame | list[tuple[float, float, float, float]], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points inside the rings, or on an edge. Points meet the cell of the polygon's index that holds them: they take over
    what is known of its corner, and change it by the edges of the cell that lie between: those that cross the way from
    the corner up to the point's height, and from there to the point. Points in cells without edges test none."""
    cells, g = polygon_index(edge_table(df.sparkSession, edges))
    if g is None:
        return df.filter("false")
    x, y = F.col(lon), F.col(lat)
    near = df.filter(x.between(g["west"], g["east"]) & y.between(g["south"], g["north"]))
    keyed = near.withColumns({"__cy": F.floor((y - g["y0"]) / g["step"]).cast("int"), "__cx": F.floor((x - g["x0"]) / g["step"]).cast("int")})
    met = keyed.join(cells.select(F.col("cy").alias("__cy"), F.col("cx").alias("__cx"), F.col("odd").alias("__odd"), F.col("edges").alias("__edges")), ["__cy", "__cx"])
    right, floor = (F.col("__cx") + 1) * g["step"] + g["x0"], F.col("__cy") * g["step"] + g["y0"]

    def across(e: Column) -> Column:
        at = _cut_at(e, y)
        return _straddles(e, y) & (x < at) & ~(right < at)

    def up(e: Column) -> Column:
        at = (e["y2"] - e["y1"]) * (right - e["x1"]) / F.when(e["x2"] == e["x1"], 1.0).otherwise(e["x2"] - e["x1"]) + e["y1"]
        return ((e["x1"] > right) != (e["x2"] > right)) & (floor < at) & (at <= y)

    def on(e: Column) -> Column:
        cross = (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
        return (F.abs(cross) < 1e-12) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    times = F.col("__odd") + F.size(F.filter("__edges", across)) + F.size(F.filter("__edges", up))
    inside = F.when(F.col("__edges").isNull(), F.col("__odd") == 1).otherwise((times % 2 == 1) | F.exists("__edges", on))
    return met.filter(inside).select(*df.columns)


def make_cells(spark: SparkSession, edges: DataFrame | list[tuple[float, float, float, float]], res: float = 0.25) -> DataFrame:
    """Grid cells whose centres lie inside the boundary."""
    table = edge_table(spark, edges)
    box = table.select(F.least("x1", "x2").alias("x"), F.least("y1", "y2").alias("y"), F.greatest("x1", "x2").alias("x_"), F.greatest("y1", "y2").alias("y_")).agg(F.min("x"), F.min("y"), F.max("x_"), F.max("y_")).first()
    x0, y0 = math.floor(box[0] / res), math.floor(box[1] / res)
    nx, ny = math.ceil(box[2] / res) - x0 + 1, math.ceil(box[3] / res) - y0 + 1
    grid = spark.range(nx * ny).select(((F.col("id") % nx + x0) * res).alias("lon"), ((F.floor(F.col("id") / nx) + y0) * res).alias("lat"))
    return in_polygon(grid, table).select(cell_id(F.col("lat"), F.col("lon")).alias("cell_id"), "lat", "lon")


def density(df: DataFrame, step: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.groupBy((F.floor(F.col(lat) / step) * step).alias("lat_bin"), (F.floor(F.col(lon) / step) * step).alias("lon_bin")).agg(F.count("*").alias("n"))


def intersect_bounds(bounds: DataFrame) -> DataFrame:
    """Area common to all sources: each source's tiles are joined first. Raises if nothing is common."""
    per = source_bounds(bounds)
    out = per.agg(F.max("west").alias("west"), F.max("south").alias("south"), F.min("east").alias("east"), F.min("north").alias("north"))
    empty = (F.col("west") >= F.col("east")) | (F.col("south") >= F.col("north"))
    return out.select(*(F.when(empty, F.raise_error(F.lit("the sources have no common area")).cast("double")).otherwise(F.col(c)).alias(c) for c in ("west", "south", "east", "north")))


def source_bounds(bounds: DataFrame) -> DataFrame:
    return bounds.groupBy("source").agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


def binding_edges(bounds: DataFrame) -> DataFrame:
    """(edge, sources): which sources set each edge of the common area."""
    per = source_bounds(bounds)
    edges = per.select("source", F.inline(F.array(*(F.struct(F.lit(e).alias("edge"), (F.col(e) * s).alias("v")) for e, s in (("west", 1), ("south", 1), ("east", -1), ("north", -1))))))
    top = F.max("v").over(Window.partitionBy("edge"))
    return edges.withColumn("top", top).filter("v = top").groupBy("edge").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
