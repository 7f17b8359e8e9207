"""Nearest points by a pyramid of boxes, clusters by runs: brute force on small grids, and how much they compare."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from emberframe.operators import joins_space, raster
from emberframe.plans import catalog

CELLS, POINTS = "cell_id string, lat double, lon double", "pt_id long, lat double, lon double"


def far_apart(spark, n):
    """n cells, and as many points, half of them on one line, 80 degrees away."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000_003)) / 1_000_003
    cells = spark.range(n).select(F.concat(F.lit("c"), "id").alias("cell_id"), (F.rint(u(1) * 1200) / 40 - 50).alias("lat"), (u(2) * 30).alias("lon"))
    pts = spark.range(n).select(F.col("id").alias("pt_id"), F.when(F.col("id") % 2 == 0, 40.0).otherwise(40 + u(3) * 20).alias("lat"), (u(4) * 30).alias("lon"))
    return cells, pts


@pytest.mark.parametrize("n", [900, 8_100, 81_000])
def test_cells_meet_few_candidates(spark, n):
    cells, pts = far_apart(spark, n)
    spots, boxes, sizes = joins_space.pyramid(pts, 0.25)
    met = joins_space.descent(cells, boxes, sizes)
    compared = met[-1].join(spots, ["by", "bx"]).count()
    assert sum(x.count() for x in met) + compared <= 50 * n


def test_nearest_equals_brute_force(spark):
    rng = random.Random(5)
    cells = [(f"c{i}", rng.choice([rng.uniform(-80, 80), 12.5]), rng.uniform(-170, 170)) for i in range(150)]
    for pts in (
        [(i, rng.uniform(-60, 60), rng.uniform(-160, 160)) for i in range(200)],
        [(i, 10 + rng.randrange(40) / 1e4, 20 + rng.randrange(40) / 1e4) for i in range(3000)],  # one dense place, with repeats
        [(i, float(i % 7), 0.0) for i in range(70)] + [(500, 80.0, 170.0)],
        [(3, 1.0, 1.0)],
    ):
        got = {r["cell_id"]: r["pt_id"] for r in joins_space.nearest_points(spark.createDataFrame(cells, CELLS), spark.createDataFrame(pts, POINTS)).collect()}
        for c, a, b in cells:
            assert got[c] == min(pts, key=lambda p: ((p[1] - a) ** 2 + (p[2] - b) ** 2, p[0]))[0]
    assert joins_space.nearest_points(spark.createDataFrame(cells, CELLS), spark.createDataFrame([(1, None, 2.0)], POINTS)).count() == 0


def slow_clusters(fire, steps, height, width):
    mask = {(r + a, c + b) for r, c in fire for a in range(-steps, steps + 1) for b in range(abs(a) - steps, steps - abs(a) + 1) if 0 <= r + a < height and 0 <= c + b < width}
    root = {}
    for p in sorted(mask):
        if p not in root:
            todo = [p]
            root[p] = p
            while todo:
                r, c = todo.pop()
                for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if q in mask and q not in root:
                        root[q] = p
                        todo.append(q)
    return root


@pytest.mark.parametrize(("share", "steps", "band"), [(0.02, 2, 256), (0.3, 0, 3), (0.45, 0, 5), (0.6, 0, 1), (0.05, 1, 4)])
def test_clusters_equal_flood_fill(spark, monkeypatch, share, steps, band):
    monkeypatch.setattr(raster, "BAND", band)
    height, width, rng = 37, 41, random.Random(int(share * 100))
    fire = [(r, c) for r in range(height) for c in range(width) if rng.random() < share]
    pix = spark.createDataFrame([(r, c, int((r, c) in set(fire))) for r in range(height) for c in range(width)] + [(*fire[0], 1)], "row int, col int, fire int")
    root = slow_clusters(fire, steps, height, width)
    sizes = {}
    for p, q in root.items():
        sizes.setdefault(q, []).append(p)
    want = sorted((len(x), sum(r for r, _ in x) // len(x), sum(c for _, c in x) // len(x), q[0] * width + q[1]) for q, x in sizes.items())
    assert sorted(tuple(r) for r in raster.fire_clusters(pix, height, width, steps, None).collect()) == want
    runs = raster.cluster_runs(pix, height, width, steps)
    got = {(r["row"], r["col"]): r["root"] for r in raster.label_pixels(pix.distinct(), runs).collect()}
    assert got == {(r, c): root[r, c][0] * width + root[r, c][1] if (r, c) in root else None for r in range(height) for c in range(width)}


def test_clusters_of_a_dense_mask_have_few_edges(spark):
    pix = spark.range(512 * 600).select(F.floor(F.col("id") / 512).cast("int").alias("row"), (F.col("id") % 512).cast("int").alias("col"), (F.pmod(F.xxhash64("id"), F.lit(100)) < 30).cast("int").alias("fire"))
    runs = raster.dilated_runs(raster.fire_runs(pix.filter("fire > 0")), 1, 600, 512)
    pixels = runs.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0]
    assert raster.touching_runs(runs, 512).count() <= 0.5 * pixels
    assert raster.fire_clusters(pix, 600, 512, 8, None).collect() == raster.fire_clusters(pix, 600, 512, 9, None).collect()
    assert raster.fire_clusters(pix.filter("fire = 2"), 600, 512).count() == 0


def slow_inside(x, y, edges):
    odd = False
    for x1, y1, x2, y2 in edges:
        if abs((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)) < 1e-12 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def ring(*corners):
    return [(*a, *b) for a, b in zip(corners, (*corners[1:], corners[0]))]


def test_polygon_equals_crossing_parity(spark):
    rng = random.Random(9)
    star = []
    for k in range(400):
        r, a = 3 + rng.random() * 2, k * 6.283185307179586 / 400
        star.append((round(r * math.cos(a), 4), round(r * math.sin(a), 4)))
    shapes = {
        "star": ring(*star),
        "square with a hole": ring((0, 0), (8, 0), (8, 8), (0, 8)) + ring((2, 2), (6, 2), (6, 6), (2, 6)),
        "comb": ring(*((x, y) for k in range(40) for x, y in ((k / 5 - 4, -4), (k / 5 - 4, 4), (k / 5 - 3.9, 4), (k / 5 - 3.9, -3.99))), (4, -4)),
        "two far ones": ring((-5, -5), (-4, -5), (-4.5, -4)) + ring((5, 5), (5.5, 5), (5.25, 5.25)),
        "needle": ring((-5, 0), (5, 1e-6), (5, -1e-6)),
    }
    pts = [(i, rng.uniform(-6, 9), rng.uniform(-6, 9)) for i in range(800)]
    pts += [(1000 + i, float(rng.randrange(-5, 9)), float(rng.randrange(-5, 9))) for i in range(300)]  # on corners and edges
    pts += [(2000 + i, star[i][1], star[i][0] - 0.5) for i in range(100)] + [(3000, None, 1.0), (3001, 1.0, None)]  # at a corner's height
    df = spark.createDataFrame(pts, "pt_id long, lat double, lon double")
    for name, edges in shapes.items():
        want = {i for i, y, x in pts if x is not None and y is not None and slow_inside(x, y, edges)}
        assert {r["pt_id"] for r in joins_space.in_polygon(df, edges).collect()} == want, name


def test_a_cell_of_a_long_boundary_holds_few_edges(spark):
    n = 50_000
    a = F.col("id") * (2 * math.pi / n)
    at = lambda k, f: ((5 + 2 * F.sin(7 * (a + k * 2 * math.pi / n)) + F.sin(300 * (a + k * 2 * math.pi / n)) / 9) * f(a + k * 2 * math.pi / n))
    edges = spark.range(n).select(at(0, F.cos).alias("x1"), at(0, F.sin).alias("y1"), at(1, F.cos).alias("x2"), at(1, F.sin).alias("y2"))
    cells, grid = joins_space.polygon_index(edges)
    size = cells.agg(F.max(F.size("edges")), F.avg(F.size("edges")), F.count("*")).first()
    assert size[0] < 300 and size[1] < 50 and size[2] < grid["n"] ** 2 <= 1030**2


@pytest.mark.parametrize(("fires", "size", "dist"), [(0.01, 5, 4.0), (0.004, 8, 6.5), (0.3, 3, 2.0), (0.0, 4, 0.0)])
def test_background_equals_brute_force(spark, fires, size, dist):
    rng, height, width = random.Random(size), 30, 34
    fire = [(r, c) for r in range(height) for c in range(width) if rng.random() < fires]
    centres = [(r, c) for r in range(height) for c in range(width) if rng.random() < 0.01] + [(3, 3), (3, 3)]
    cands = [(t, c) for t in range(height - size) for c in range(width - size)]
    table = lambda rows, names: spark.createDataFrame(rows, names)
    got = raster.background(table(cands, "top int, left int"), table(fire, "row int, col int"), table(centres, "centre_row int, centre_col int"), dist, size, len(cands))
    clean = {(t, c) for t, c in cands if not any(t <= r < t + size and c <= x < c + size for r, x in fire)}
    near = {(t, c) for t, c in clean if any(math.hypot(t + size // 2 - r, c + size // 2 - x) < dist for r, x in centres)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(clean) and set(rows) == clean and set(rows[: len(clean) - len(near)]) == clean - near


def test_background_of_a_burning_grid_is_linear(spark):
    """Everything burns: runs, not pixels times squares."""
    height, width, size = 300, 400, 64
    pix = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    wide = raster._spread(raster.fire_runs(pix), {0: (size - 1, 0)})
    assert wide.count() * size <= 10 * (height - size) * (width - size)
    checker = raster._spread(raster.fire_runs(pix.filter("(row + col) % 2 = 0")), {0: (size - 1, 0)})
    assert checker.count() == height
    assert raster.background(pix.select(F.col("row").alias("top"), F.col("col").alias("left")).filter(f"top < {height - size} AND left < {width - size}"), pix, pix.limit(1).select(F.col("row").alias("centre_row"), F.col("col").alias("centre_col"))).count() == 0


@pytest.mark.parametrize("edge", ["wrap", "drop"])
def test_ruggedness_equals_brute_force(spark, edge):
    rng, height, width = random.Random(3), 7, 9
    full = {(r, c): None if rng.random() < 0.2 else round(rng.uniform(-5, 9), 2) for r in range(height) for c in range(width)}
    for held in (full, {k: v for k, v in full.items() if rng.random() < 0.8}):
        got = {(r["row"], r["col"]): r["tri"] for r in raster.tri(spark.createDataFrame([(*k, v) for k, v in held.items()], "row int, col int, value double"), height, width, edge).collect()}
        assert got.keys() == {k for k, v in held.items() if v is not None}
        for (r, c), tri in got.items():
            near = [((r + a) % height, (c + b) % width) if edge == "wrap" else (r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
            x = [(held.get(k) or 0.0) if edge == "wrap" else held[k] for k in near if edge == "wrap" or held.get(k) is not None]
            want = math.sqrt(sum((held[r, c] - v) ** 2 for v in x) / len(x)) if x else None
            assert (tri is None) == (want is None) and (want is None or abs(tri - want) < 1e-9)


def test_polygon_query_and_its_sql_take_points_on_edges(spark):
    data = "/root/testdata/sf0.1"  # four of its points lie on edges
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{data}/customer.parquet'")
    want = {r[0] for r in con.execute(catalog.oracle_sql()["p2_polygon"]).fetchall()}
    assert {r["pt_id"] for r in catalog.queries()["p2_polygon"](spark, data).collect()} == want >= {3669, 5493, 7545, 14673}
