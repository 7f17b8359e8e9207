"""Rasters as pixel tables: (row, col, value), or (layer, row, col, value).

Neighbourhoods are windows along rows and columns, or equal joins on shifted integer keys; never a distance join.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.operators.graph import components
from emberframe.sources.shared import stored

def _gradient(value: str, along: str, across: list[str], step: float) -> Column:
    """Central difference, one-sided at the ends of the line; null if a neighbour that is used is missing."""
    w = Window.partitionBy(*across).orderBy(along)
    before, after, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    return F.when(first & last, F.lit(None)).when(first, (after - v) / step).when(last, (v - before) / step).otherwise((after - before) / (2 * step))


def gradients(pix: DataFrame, dx: float, dy: float, value: str = "value", by: tuple[str, ...] = (), row: str = "row", col: str = "col") -> DataFrame:
    """Adds dz_dx and dz_dy. The table must hold every pixel of its grid, missing ones with null."""
    out = pix.withColumn("dz_dy", _gradient(value, row, [*by, col], dy))
    return out.withColumn("dz_dx", _gradient(value, col, [*by, row], dx))


def slope_aspect(pix: DataFrame, dx: float, dy: float, value: str = "value", by: tuple[str, ...] = (), row: str = "row", col: str = "col") -> DataFrame:
    g = gradients(pix, dx, dy, value, by, row, col)
    x, y, known = F.col("dz_dx"), F.col("dz_dy"), F.col(value).isNotNull()
    slope = F.degrees(F.atan(F.sqrt(x * x + y * y)))
    return g.withColumns({"slope": F.when(known, slope), "aspect": F.when(known, F.pmod(F.lit(360.0) + F.degrees(F.atan2(x, -y)), F.lit(360.0)))}).drop("dz_dx", "dz_dy")


def hillshade(pix: DataFrame, dx: float, dy: float, azimuth: float = 315.0, altitude: float = 45.0, value: str = "value", by: tuple[str, ...] = (), row: str = "row", col: str = "col") -> DataFrame:
    g = gradients(pix, dx, dy, value, by, row, col)
    x, y = F.col("dz_dx"), F.col("dz_dy")
    zenith, light = F.radians(F.lit(90.0 - altitude)), F.radians(F.lit(450.0 - azimuth))
    slope = F.atan(F.sqrt(x * x + y * y))
    shade = F.cos(zenith) * F.cos(slope) + F.sin(zenith) * F.sin(slope) * F.cos(light - F.atan2(x, -y))
    return g.withColumn("hillshade", F.when(F.col(value).isNotNull() & shade.isNotNull(), F.greatest(F.least(shade * 255.0, F.lit(255.0)), F.lit(0.0)))).drop("dz_dx", "dz_dy")


def _beside(value: str, along: str, across: str, step: int, size: int | None) -> Column:
    """The value of the pixel one step further along a line, null if there is none; with a size, lines are closed."""
    line = Window.partitionBy(across).orderBy(along)
    ends = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pixel = F.struct(F.col(along).alias("at"), F.col(value).alias("v"))
    next_one, first = (F.lead, F.first) if step > 0 else (F.lag, F.last)
    found = next_one(pixel).over(line)
    want = F.col(along) + step
    if size is not None:
        found, want = F.coalesce(found, first(pixel).over(ends)), F.pmod(want, F.lit(size))
    return F.when(found["at"] == want, found["v"])


def tri(pix: DataFrame, height: int, width: int, edge: str = "wrap", value: str = "value", row: str = "row", col: str = "col") -> DataFrame:
    """Root mean square difference to the eight neighbours. edge='wrap' joins opposite edges and takes missing as 0;
    edge='drop' leaves out neighbours that are missing or outside. A pixel that the table doesn't hold is missing. Pixels get
    their neighbours of the row by one window, and those of the rows above and below, with their neighbours, by another:
    each is shuffled a few times, not eight."""
    wrap = edge == "wrap"
    grid = pix.sparkSession.range(height * width).select(F.floor(F.col("id") / width).cast(pix.schema[row].dataType).alias(row), (F.col("id") % width).cast(pix.schema[col].dataType).alias(col))
    own = grid.join(pix.select(row, col, value), [row, col], "left").select(row, col, F.col(value).alias("__v"), (F.coalesce(value, F.lit(0.0)) if wrap else F.col(value)).alias("__n"))
    near = own.withColumns({"__a": _beside("__n", col, row, -1, width if wrap else None), "__b": _beside("__n", col, row, 1, width if wrap else None)})
    three = near.withColumn("__three", F.array("__a", "__n", "__b")).select(row, col, "__v", "__a", "__b", "__three")
    tall = three.withColumns({"__up": _beside("__three", row, col, -1, height if wrap else None), "__down": _beside("__three", row, col, 1, height if wrap else None)})
    none = F.array().cast("array<double>")
    eight = F.filter(F.concat(F.coalesce("__up", none), F.array("__a", "__b"), F.coalesce("__down", none)), lambda x: x.isNotNull())
    total = F.aggregate(eight, F.lit(0.0), lambda s, x: s + (F.col("__v") - x) ** 2)
    rms = F.sqrt(total / 8.0) if wrap else F.sqrt(F.try_divide(total, F.size(eight).cast("double")))
    return tall.filter("__v IS NOT NULL").select(row, col, rms.alias("tri"))


def tpi(pix: DataFrame, radius: int = 1, value: str = "value", by: tuple[str, ...] = (), row: str = "row", col: str = "col") -> DataFrame:
    """Value less the mean of the known values of the square around it; beyond an edge, the edge pixel repeats.

    Separable: sums along columns, then along rows; repeats at the ends are the end's sum times the overhang."""
    out = pix.withColumns({"__s": F.coalesce(value, F.lit(0.0)), "__n": F.col(value).isNotNull().cast("double")})
    for along, across in ((row, col), (col, row)):
        line = Window.partitionBy(*by, across)
        near = line.orderBy(along).rowsBetween(-radius, radius)
        place, size = F.row_number().over(line.orderBy(along)), F.count("*").over(line)
        low, high = F.greatest(radius + 1 - place, F.lit(0)), F.greatest(place + radius - size, F.lit(0))
        for c in ("__s", "__n"):
            ends = line.orderBy(along).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            out = out.withColumn(c + "2", F.sum(c).over(near) + low * F.first(c).over(ends) + high * F.last(c).over(ends))
        out = out.drop("__s", "__n").withColumnsRenamed({"__s2": "__s", "__n2": "__n"})
    return out.withColumn("tpi", F.when(F.col(value).isNotNull(), F.col(value) - F.try_divide(F.col("__s"), F.col("__n")))).drop("__s", "__n")


def sample_at(pts: DataFrame, pix: DataFrame, grid: dict, layers: list[str], strict: bool = True, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Value of each layer in the pixel that holds the point; missing where there is none. Points outside the grid raise
    an error, or get nothing if not strict. grid: west, north, dx, dy, height, width; pix: layer, row, col, value."""
    r, c = F.floor((F.lit(grid["north"]) - F.col(lat)) / grid["dy"]).cast("int"), F.floor((F.col(lon) - grid["west"]) / grid["dx"]).cast("int")
    outside = ~(r.between(0, grid["height"] - 1) & c.between(0, grid["width"] - 1))
    checked = F.when(outside, F.raise_error(F.lit("point outside the grid")).cast("int")).otherwise(r) if strict else r
    wide = pix.groupBy("row", "col").agg(*(F.max(F.when(F.col("layer") == name, F.col("value"))).alias(name) for name in layers))
    return pts.withColumns({"row": checked, "col": c}).join(wide, ["row", "col"], "left")


def patch_origin(centre: Column, size: int, extent: int) -> Column:
    return F.least(F.greatest(centre - size // 2, F.lit(0)), F.lit(extent - size))


def extract_patches(pts: DataFrame, pix: DataFrame, height: int, width: int, size: int = 64, key: str = "sample_id", row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """(key, dr, dc, value) of the square around each point, moved inside the grid; missing becomes 0, and a grid
    smaller than the square gives nothing. Pixels and squares meet by blocks of the square's size: at most four each."""
    if height < size or width < size:
        return pts.sparkSession.createDataFrame([], "sample_id string, dr int, dc int, value double").withColumnRenamed("sample_id", key)
    top = pts.select(key, patch_origin(F.col(row), size, height).alias("top"), patch_origin(F.col(col), size, width).alias("left"))
    b = lambda x: F.floor(x / size).cast("int")
    corners = F.array_distinct(F.array(*(F.struct(b(F.col("top") + a).alias("br"), b(F.col("left") + c).alias("bc")) for a in (0, size - 1) for c in (0, size - 1))))
    keyed = top.select("*", F.inline(corners))
    own = pix.select(F.col(row).alias("__r"), F.col(col).alias("__c"), F.coalesce(value, F.lit(0.0)).alias("value"), b(F.col(row)).alias("br"), b(F.col(col)).alias("bc"))
    inside = F.col("__r").between(F.col("top"), F.col("top") + size - 1) & F.col("__c").between(F.col("left"), F.col("left") + size - 1)
    return keyed.join(own, ["br", "bc"]).filter(inside).select(key, (F.col("__r") - F.col("top")).cast("int").alias("dr"), (F.col("__c") - F.col("left")).cast("int").alias("dc"), "value")


def rasterize(pts: DataFrame, grid: dict, cols: list[str], order: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points to pixels; of several in one, the last known value by `order`, for each column apart."""
    r, c = F.floor((F.lit(grid["north"]) - F.col(lat)) / grid["dy"]).cast("int"), F.floor((F.col(lon) - grid["west"]) / grid["dx"]).cast("int")
    keyed = pts.withColumns({"row": r, "col": c}).filter(F.col("row").between(0, grid["height"] - 1) & F.col("col").between(0, grid["width"] - 1))
    return keyed.groupBy("row", "col").agg(*(F.max_by(x, F.when(F.col(x).isNotNull(), F.col(order))).alias(x) for x in cols))


def fire_runs(fire: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    """(row, first, last): maximal runs of a mask's pixels along the rows. Repeated pixels do no harm."""
    return merged_runs(fire.select(F.col(row).alias("row"), F.col(col).alias("first"), F.col(col).alias("last")))


def merged_runs(runs: DataFrame) -> DataFrame:
    """(row, first, last) with runs of a row that overlap or touch as one."""
    line = Window.partitionBy("row").orderBy("first")
    before = F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1))
    fresh = runs.withColumn("fresh", (before.isNull() | (F.col("first") > before + 1)).cast("int"))
    numbered = fresh.withColumn("run", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("row", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def dilated_runs(runs: DataFrame, steps: int, height: int, width: int) -> DataFrame:
    """Runs of the pixels within `steps` moves along rows and columns of a run's pixels: each run spreads to 2 * steps + 1 rows,
    whatever its length."""
    rows = F.array(*(F.struct((F.col("row") + a).alias("row"), F.greatest(F.col("first") - (steps - abs(a)), F.lit(0)).alias("first"), F.least(F.col("last") + (steps - abs(a)), F.lit(width - 1)).alias("last")) for a in range(-steps, steps + 1)))
    return merged_runs(runs.select(F.inline(rows)).filter(F.col("row").between(0, height - 1)))


def touching_runs(runs: DataFrame, width: int) -> DataFrame:
    """(a, b): runs of neighbouring rows that share a column, named by their first pixels. Of two such runs, the one that
    starts later starts within the other, which is the last of its row to start by then: one pass over each pair of rows
    finds them, with two edges a run at most."""
    run = F.named_struct(F.lit("name"), F.col("row").cast("long") * width + F.col("first"), F.lit("last"), F.col("last"))
    pairs = runs.select(F.explode(F.array(F.col("row"), F.col("row") - 1)).alias("upper"), "row", "first", run.alias("run"))
    so_far = Window.partitionBy("upper").orderBy("first").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    above, below = (F.last(F.when(F.col("row") == F.col("upper") + k, F.col("run")), ignorenulls=True).over(so_far).alias(n) for k, n in ((0, "above"), (1, "below")))
    met = pairs.select("first", "run", F.when(F.col("row") == F.col("upper"), below).otherwise(above).alias("other"))
    return met.filter(F.col("other.last") >= F.col("first")).select(F.col("run.name").alias("a"), F.col("other.name").alias("b"))


#: Rows of a band, whose runs one task joins: at most BAND * width / 2 of them.
BAND = 256


def _band_roots(runs: pd.DataFrame, width: int) -> pd.DataFrame:
    """The runs of neighbouring rows with the first pixel of the component that they have among themselves."""
    runs = runs.sort_values(["row", "first"], ignore_index=True)
    row, first, last = (runs[c].tolist() for c in ("row", "first", "last"))
    parent = list(range(len(row)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    above = 0  # the first run of the row above that may reach this one
    for i in range(len(row)):
        while row[above] < row[i] - 1 or (row[above] == row[i] - 1 and last[above] < first[i]):
            above += 1
        j = above
        while row[j] == row[i] - 1 and first[j] <= last[i]:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
            j += 1
    root = [find(i) for i in range(len(row))]
    return runs.assign(local=[int(row[k]) * width + int(first[k]) for k in root])[["row", "first", "last", "local"]]


def cluster_runs(pix: DataFrame, height: int, width: int, steps: int = 8, fire: str = "fire", row: str = "row", col: str = "col") -> DataFrame:
    """(row, first, last, root): the dilated fire mask in runs, with the first pixel (row * width + col) of each run's
    4-connected component. Bands of rows are joined within themselves first, so that only runs on both sides of a border
    between bands become edges."""
    runs = dilated_runs(fire_runs(pix.filter(F.col(fire) > 0), row, col), steps, height, width)
    local = stored(runs.groupBy(F.floor(F.col("row") / BAND).alias("band")).applyInPandas(lambda pdf: _band_roots(pdf[["row", "first", "last"]], width), "row int, first int, last int, local long"), "fire-runs")
    names = local.select((F.col("row").cast("long") * width + F.col("first")).alias("name"), "local")
    border = touching_runs(local.filter(F.pmod("row", F.lit(BAND)).isin(0, BAND - 1)), width).filter(F.floor(F.col("a") / width / BAND) != F.floor(F.col("b") / width / BAND))
    edges = border.join(names.withColumnRenamed("name", "a"), "a").select("b", F.col("local").alias("x")).join(names.withColumnRenamed("name", "b"), "b").select("x", F.col("local").alias("y"))
    roots = components(edges, "x", "y").withColumnRenamed("node", "local")
    return local.join(roots, "local", "left").select("row", "first", "last", F.coalesce("root", "local").alias("root"))


def label_pixels(pix: DataFrame, runs: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    """Adds `root`, the component of the run (row, first, last, root) that holds the pixel, else null."""
    at = runs.select(F.col("row").alias(row), F.col("first").alias(col), F.struct("last", "root").alias("__run"))
    line = Window.partitionBy(row).orderBy(col, F.col("__own").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = pix.withColumn("__own", F.lit(1)).unionByName(at, allowMissingColumns=True).withColumn("__last", F.last("__run", ignorenulls=True).over(line))
    return both.filter("__own = 1").withColumn("root", F.when(F.col("__last.last") >= F.col(col), F.col("__last.root"))).drop("__own", "__run", "__last")


def fire_clusters(pix: DataFrame, height: int, width: int, steps: int = 8, k: int | None = 3, fire: str = "fire", row: str = "row", col: str = "col") -> DataFrame:
    """The k largest 4-connected components of the dilated fire mask: size and truncated mean row and column. Equal
    sizes: the one with the smaller first pixel. Pixels become runs before anything is dilated or joined."""
    size = F.col("last") - F.col("first") + 1
    long = cluster_runs(pix, height, width, steps, fire, row, col).select("root", size.cast("long").alias("n"), (F.col("row") * size.cast("long")).alias("r"), ((F.col("first") + F.col("last")) * size.cast("long") / 2).cast("long").alias("c"))
    out = long.groupBy(F.col("root").alias("first_pixel")).agg(F.sum("n").alias("size"), F.expr("CAST(sum(r) div sum(n) AS INT)").alias("centre_row"), F.expr("CAST(sum(c) div sum(n) AS INT)").alias("centre_col"))
    out = out.select("size", "centre_row", "centre_col", "first_pixel")
    return out if k is None else out.orderBy(F.col("size").desc(), "first_pixel").limit(k)


def _spread(runs: DataFrame, reach: dict[int, tuple[int, int]]) -> DataFrame:
    """Runs spread to other rows: for each offset of the row, the columns that are added before and after."""
    rows = F.array(*(F.struct((F.col("row") + k).alias("row"), (F.col("first") - a).alias("first"), (F.col("last") + b).alias("last")) for k, (a, b) in reach.items()))
    return merged_runs(runs.select(F.inline(rows)))


def background(cands: DataFrame, fire: DataFrame, centres: DataFrame, min_dist: float = 32.0, size: int = 64, n: int = 1, seed: int = 42) -> DataFrame:
    """Candidate origins (top, left) whose square has no fire pixel and whose middle is at least min_dist from every
    centre (centre_row, centre_col); the first n by hash. If none is far enough, the first without fire.

    The origins whose square meets a run of fire are runs themselves: they are spread along the row first, after which they are at least
    `size` long, and then to `size` rows, so there are about as many as origins even if everything burns. Around
    centres, runs are spread to the rows of a disk. A candidate looks up the last run of its row that starts at or before it."""
    from emberframe.functions import hash_int

    wide = _spread(fire_runs(fire), {0: (size - 1, 0)})
    burnt = _spread(wide, {-k: (0, 0) for k in range(size)}).withColumn("root", F.lit(1))
    clean = label_pixels(cands, burnt, "top", "left").filter("root IS NULL").drop("root")
    disk, far = {}, math.ceil(min_dist)
    for k in range(-far, far + 1):
        width = max((x for x in range(far + 1) if math.sqrt(k * k + x * x) < min_dist), default=None)
        if width is not None:
            disk[k] = (width, width)
    middle = clean.withColumns({"__r": F.col("top") + size // 2, "__c": F.col("left") + size // 2})
    around = fire_runs(centres, "centre_row", "centre_col")
    near = label_pixels(middle, _spread(around, disk).withColumn("root", F.lit(1)), "__r", "__c") if disk else middle.withColumn("root", F.lit(None))
    ranked = near.orderBy(F.when(F.col("root").isNull(), 0).otherwise(1), hash_int(F.col("top"), F.col("left"), seed=seed), "top", "left")
    return ranked.limit(n).select("top", "left")


def day_patches(pix: DataFrame, height: int, width: int, size: int = 64, steps: int = 8, min_dist: float = 32.0, seed: int = 42) -> DataFrame:
    """(top, left, kind): squares around the largest clusters, moved inside the grid, and one background square."""
    spark = pix.sparkSession
    centres = fire_clusters(pix, height, width, steps)
    fire = pix.filter("fire > 0").select("row", "col")
    grid = spark.range(max(1, (height - size)) * max(1, (width - size))).select(F.floor(F.col("id") / max(1, width - size)).cast("int").alias("top"), (F.col("id") % max(1, width - size)).cast("int").alias("left"))
    squares = centres.select(patch_origin(F.col("centre_row"), size, height).alias("top"), patch_origin(F.col("centre_col"), size, width).alias("left"), F.lit("fire").alias("kind"))
    return squares.unionByName(background(grid, fire, centres, min_dist, size, 1, seed).withColumn("kind", F.lit("background")))


def regrid_bilinear(pix: DataFrame, src: dict, dst: dict, value: str = "value", row: str = "row", col: str = "col") -> DataFrame:
    """Values of the source grid at the centres of a target grid of the same projection, from four corners each; null
    where a corner is missing. Grids: west, north, dx, dy, height, width."""
    n = dst["height"] * dst["width"]
    target = pix.sparkSession.range(n).select(F.floor(F.col("id") / dst["width"]).cast("int").alias("row"), (F.col("id") % dst["width"]).cast("int").alias("col"))
    fr = (F.lit(src["north"]) - (F.lit(dst["north"]) - (F.col("row") + 0.5) * dst["dy"])) / src["dy"] - 0.5
    fc = ((F.lit(dst["west"]) + (F.col("col") + 0.5) * dst["dx"]) - src["west"]) / src["dx"] - 0.5
    at = target.withColumns({"fr": fr, "fc": fc}).withColumns({"r0": F.floor("fr").cast("int"), "c0": F.floor("fc").cast("int")})
    wr, wc = F.col("fr") - F.col("r0"), F.col("fc") - F.col("c0")
    corners = [F.struct((F.col("r0") + a).alias("sr"), (F.col("c0") + b).alias("sc"), ((wr if a else 1 - wr) * (wc if b else 1 - wc)).alias("weight")) for a in (0, 1) for b in (0, 1)]
    keyed = at.select("row", "col", F.inline(F.array(*corners))).filter("weight > 0")
    own = pix.select(F.col(row).alias("sr"), F.col(col).alias("sc"), F.col(value).alias("__v"))
    got = keyed.join(own, ["sr", "sc"], "left").groupBy("row", "col").agg(F.count("*").alias("n"), F.count("__v").alias("k"), F.sum(F.col("__v") * F.col("weight")).alias("value"))
    return got.select("row", "col", F.when(F.col("n") == F.col("k"), F.col("value")).alias("value"))


def mosaic_mean(pix: DataFrame, keys: tuple[str, ...] = ("month", "row", "col"), value: str = "value") -> DataFrame:
    return pix.groupBy(*keys).agg(F.avg(value).alias(value))


def mosaic_first(pix: DataFrame, order: str, keys: tuple[str, ...] = ("row", "col"), value: str = "value") -> DataFrame:
    """The first known value by `order`."""
    return pix.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def composite(pix: DataFrame, how: str, keys: tuple[str, ...] = ("window", "row", "col"), value: str = "value", mask: Column | None = None) -> DataFrame:
    """Per pixel and window: 'median' or 'mean' of the unmasked values, or 'max' with a 0/1 label; with scene counts.
    A window without rows gives none."""
    v = F.col(value) if mask is None else F.when(mask, F.col(value))
    f = {"median": F.median, "mean": F.avg, "max": F.max}[how]
    extra = [(F.count(v) > 0).cast("int").alias("label")] if how == "max" else []
    return pix.groupBy(*keys).agg(f(v).alias(value), F.count("*").alias("n_scenes"), *extra)


def multi_product(pix: DataFrame, products: list[str], keys: tuple[str, ...] = ("window", "row", "col")) -> DataFrame:
    """Mean of each product as a column, missing where it has no scene; windows without any product give none."""
    return pix.groupBy(*keys).agg(*(F.avg(F.when(F.col("product") == p, F.col("value"))).alias(p) for p in products))


def coarsen(pix: DataFrame, k: int, value: str = "value", row: str = "row", col: str = "col") -> DataFrame:
    """Mean of the known values of each k x k block."""
    return pix.groupBy(F.floor(F.col(row) / k).cast("int").alias(row), F.floor(F.col(col) / k).cast("int").alias(col)).agg(F.avg(value).alias(value))


def patch_points(pix: DataFrame, west: float, north: float, dx: float, dy: float, patch: str = "patch", p: str = "p", fire: str = "fire") -> DataFrame:
    """One map point per patch: mean probability, any fire, and the middle in lon and lat. pix: patch, row, col, p, fire."""
    mid = lambda c: (F.min(c) + F.max(c) + 1) / 2.0
    return pix.groupBy(patch).agg(F.avg(p).alias("mean_p"), F.max((F.coalesce(fire, F.lit(0)) > 0).cast("int")).alias("any_fire"), (F.lit(west) + mid("col") * dx).alias("lon"), (F.lit(north) - mid("row") * dy).alias("lat"))



def fuse_channels(days: DataFrame, optical: DataFrame, weather: DataFrame, aerosol: DataFrame, terrain: DataFrame, fire: DataFrame, channels: dict[str, list[str]]) -> DataFrame:
    """One row per (date, row, col) of `fire`'s grid and the given days, with all channels in order: optical of the
    latest scene at or before the day (none: error), weather of the day, aerosol carried forward, terrain, and fire of
    the day before. Scenes are matched per day before pixels are joined, so pixels meet by equal keys only."""
    from emberframe.operators.joins_time import asof_latest, prev_day

    px = ["row", "col"]
    base = prev_day(fire.select("date", *px, "fire"), px, "date", "fire", "prev_fire").join(days.select("date").distinct(), "date")
    scene = asof_latest(days.select("date").distinct(), optical.select(F.col("date").alias("scene")).distinct(), "date", "scene", [], out="scene")
    scene = scene.withColumn("scene", F.when(F.col("scene").isNull(), F.raise_error(F.concat(F.lit("no optical scene for "), F.col("date").cast("string"))).cast("date")).otherwise(F.col("scene")))
    air = asof_latest(days.select("date").distinct(), aerosol.select(F.col("date").alias("air")).distinct(), "date", "air", [], out="air")
    out = base.join(scene, "date").join(optical.withColumnRenamed("date", "scene"), ["scene", *px], "left")
    out = out.join(weather, ["date", *px], "left").join(air, "date").join(aerosol.withColumnRenamed("date", "air"), ["air", *px], "left").join(terrain, px, "left")
    return out.select("date", *px, *(c for group in ("optical", "weather", "aerosol", "terrain") for c in channels[group]), "prev_fire")


def last_day_rows(df: DataFrame, cols: list[str], t: str = "t", last: int = 6) -> DataFrame:
    """Pixels of the last day of each sequence that have all values."""
    return df.filter(F.col(t) == last).dropna(subset=cols)
