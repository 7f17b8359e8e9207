"""Hand cases for the traps: ties, gaps, NaN, edges, empty splits; and checks of plans."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from emberframe.functions import snap
from emberframe.operators import filters, graph, joins_space, joins_time, labels, metrics, quality, raster, rules, sampling, weather
from emberframe.sources import tables

D = date


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_snap_is_half_even(spark):
    got = [r[0] for r in spark.createDataFrame([(33.125,), (33.375,), (-0.125,)], "x double").select(snap(F.col("x"))).collect()]
    assert got == [33.0, 33.5, 0.0]


def test_nan_and_nodata_become_null(spark):
    df = spark.createDataFrame([(float("nan"),), (-32768.0,), (None,), (5.0,)], "x double")
    assert sorted((r[0] is None, r[0] or 0) for r in filters.null_nodata(df, ["x"]).collect()) == [(False, 5.0)] + [(True, 0)] * 3


def test_hot_rules_differ_on_missing_confidence(spark):
    df = spark.createDataFrame([(1, None), (1, 20.0), (None, 90.0), (1, 30.0)], "flag int, conf double")
    got = df.select(filters.hot_cell(F.col("conf")).alias("c"), filters.hot_pixel(F.col("flag"), F.col("conf")).alias("p")).collect()
    assert [tuple(r) for r in got] == [(False, 1), (False, 0), (True, 0), (True, 1)]


def test_rolling_counts_rows_or_days(spark):
    df = spark.createDataFrame([("a", D(2024, 1, i), float(i)) for i in (1, 2, 4, 5)], "cell_id string, date date, v double")
    spec = {"m": ("v", "max")}
    rows = {r["date"].day: r["m"] for r in weather.rolling_history(df, spec, 3).collect()}
    days = {r["date"].day: r["m"] for r in weather.rolling_history(df, spec, 3, calendar=True).collect()}
    assert rows == {1: None, 2: None, 4: 4.0, 5: 5.0} and set(days.values()) == {None}


def test_empty_rain_is_zero_but_other_means_stay_missing(spark):
    cols = ["t2m", *weather.MEANS, "i10fg", "tp"]
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", *[None] * len(cols))], "cell_id string, time string, " + ", ".join(f"{c} double" for c in cols))
    r = weather.daily_weather(df.withColumn("time", F.to_timestamp("time"))).first()
    assert r["tp_sum_mm"] == 0.0 and r["t2m_mean"] is None and r["rh_mean"] is None


WIN = [("a", D(2024, 1, 1), D(2024, 1, 5), 1.0), ("a", D(2024, 1, 3), D(2024, 1, 9), 2.0), ("a", D(2024, 1, 2), D(2024, 1, 9), 3.0)]


def attach(spark, days, **k):
    smp = spark.createDataFrame([("a", d) for d in days] + [("b", days[0])], "cell_id string, day date")
    win = spark.createDataFrame(WIN, "cell_id string, window_start date, window_end date, f double")
    return {(r["cell_id"], r["day"]): (r["f"], r["available"], r["lag_days"]) for r in joins_time.attach_windows(smp, win, ["f"], **k).collect()}


def test_windows_cover_then_prior_then_none(spark):
    days = [D(2023, 12, 31), D(2024, 1, 1), D(2024, 1, 4), D(2024, 1, 10), D(2024, 1, 12)]
    got = attach(spark, days)
    assert got[("a", days[0])] == (None, 0, None) and got[("b", days[0])] == (None, 0, None)
    assert got[("a", days[1])] == (1.0, 1, -4)  # a window that ends later
    assert got[("a", days[2])] == (2.0, 1, -5)  # two equal ends: the later start
    assert got[("a", days[3])] == (2.0, 1, 1)


def test_windows_max_lag_and_causal(spark):
    days = [D(2024, 1, 4), D(2024, 1, 11), D(2024, 1, 12)]
    got = attach(spark, days, max_lag=2)
    assert got[("a", days[1])] == (2.0, 1, 2) and got[("a", days[2])] == (None, 0, 3)  # the lag stays
    causal = attach(spark, [D(2024, 1, 4), D(2024, 1, 8)], causal=True)
    assert causal[("a", D(2024, 1, 4))] == (None, 0, None) and causal[("a", D(2024, 1, 8))] == (1.0, 1, 3)


def test_joins_by_keys_only(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        smp = spark.createDataFrame([("a", D(2024, 1, 4))], "cell_id string, day date")
        win = spark.createDataFrame(WIN, "cell_id string, window_start date, window_end date, f double")
        cells = spark.createDataFrame([("c", 33.0, -118.0)], "cell_id string, lat double, lon double")
        pts = spark.createDataFrame([(1, 33.1, -118.0)], "pt_id int, lat double, lon double")
        pix = spark.range(64).select(F.floor(F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"), F.lit(1.0).alias("value"))
        for df in (joins_time.attach_windows(smp, win, ["f"]), joins_space.map_grid_to_cells(cells, pts), raster.extract_patches(pix.withColumn("sample_id", F.lit("x")), pix, 8, 8, 4), raster.tri(pix, 8, 8)):
            assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cell_box_is_half_open_and_far_cells_get_their_nearest(spark):
    cells = spark.createDataFrame([("c", 33.0, -118.0), ("far", 50.0, -100.0)], "cell_id string, lat double, lon double")
    pts = spark.createDataFrame([(1, 32.875, -118.125), (2, 33.125, -118.0), (3, 33.0, -117.875), (4, 49.0, -100.0), (5, 51.0, -100.0)], "pt_id int, lat double, lon double")
    got = {tuple(r) for r in joins_space.map_grid_to_cells(cells, pts).collect()}
    assert got == {("c", 1, "in_cell"), ("far", 4, "nearest")}  # two equally near: the smaller id


def test_polygon_takes_edges_and_corners(spark):
    square = [(0.0, 0.0, 4.0, 0.0), (4.0, 0.0, 4.0, 4.0), (4.0, 4.0, 0.0, 4.0), (0.0, 4.0, 0.0, 0.0)]
    pts = spark.createDataFrame([(1, 2.0, 2.0), (2, 0.0, 2.0), (3, 4.0, 4.0), (4, 5.0, 2.0), (5, 2.0, -0.1)], "pt_id int, lat double, lon double")
    assert {r["pt_id"] for r in joins_space.in_polygon(pts, square).collect()} == {1, 2, 3}
    assert joins_space.in_polygon(pts, []).count() == 0
    geo = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [1, 1]]]}}]}
    text = spark.createDataFrame([(json.dumps(geo),)], "value string")
    assert [tuple(r) for r in tables.boundary_edges(text).collect()] == [(0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 4), (0, 4, 0, 0)]


def test_interval_that_ends_before_it_starts(spark):
    iv = spark.createDataFrame([(D(2024, 1, 5), D(2024, 1, 3)), (D(2024, 1, 5), None), (None, D(2024, 1, 3)), (D(2024, 1, 4), D(2024, 1, 6))], "s date, e date")
    assert {r[0].day: r[1] for r in joins_time.active_per_day(iv).collect()} == {4: 1, 5: 3, 6: 1}


def test_scores_of_one_class(spark):
    for y in (0, 1):
        df = spark.createDataFrame([(y, 0.2), (y, 0.7), (y, float("nan"))], "y int, p double")
        assert metrics.roc_auc(df).first()[0] is None
        assert metrics.avg_precision(df).first()[0] == (1.0 if y else None)
        assert metrics.binary_metrics(df).first()["accuracy"] == pytest.approx(0.5)


def test_auc_and_precision_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, p double")
    assert metrics.roc_auc(df).first()[0] == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    assert metrics.avg_precision(df).first()[0] == pytest.approx((0.5 + 2 / 3) / 2)


def test_top_k_tie_at_the_cut(spark):
    df = spark.createDataFrame([("d", 3, 0.5), ("d", 1, 0.5), ("d", 2, 0.9)], "day string, cell_id int, p double")
    assert [r["cell_id"] for r in sampling.top_k(df, 2, "p", "day", "cell_id").orderBy("rank").collect()] == [2, 1]


def test_sample_of_a_split_without_positives(spark):
    df = spark.createDataFrame([(f"n{i}", "val", 0, float(i)) for i in range(9)] + [(f"p{i}", "train", 1, 0.0) for i in range(3)] + [(f"q{i}", "train", 0, 1.0) for i in range(20)], "sample_id string, split string, y_fire int, x double")
    got = sampling.balanced_sample(df, 2.0, hard=("x", "x"))
    assert {(r["split"], r["y_fire"]): r["count"] for r in got.groupBy("split", "y_fire").count().collect()} == {("train", 1): 3, ("train", 0): 6}
    capped = sampling.balanced_sample(df, 2.0, caps={"train": 2})
    assert [r["y_fire"] for r in capped.collect()] == [1, 1]


def test_hard_sample_prefers_heavy_rows(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("sample_id"), F.lit("t").alias("split"), (F.col("id") % 5 == 0).cast("int").alias("y_fire"), F.col("id").cast("double").alias("hot"), (-F.col("id")).cast("double").alias("dry"))
    drawn = sampling.balanced_sample(df, 1.0, hard=("hot", "dry")).filter("y_fire = 0")
    assert drawn.count() == 400 and drawn.agg(F.avg("hot")).first()[0] > 1150


def test_splits_do_not_share_dates(spark):
    df = spark.createDataFrame([(D(2024, 1, i),) for i in range(1, 12)], "day date")
    for f in (sampling.split_by_quantile, sampling.split_by_fraction):
        sampling.assert_disjoint(f(df))
    with pytest.raises(Exception, match="five dates"):
        sampling.split_by_quantile(df.limit(4)).collect()
    bad = df.withColumn("split", F.lit("a")).unionByName(df.limit(1).withColumn("split", F.lit("b")))
    with pytest.raises(ValueError, match="share"):
        sampling.assert_disjoint(bad)
    sampling.assert_split_years(bad, {"a": {2024}, "b": {2024}})
    with pytest.raises(ValueError, match="expected"):
        sampling.assert_split_years(bad, {"a": {2023}})


def test_rules_equal_plain_counting(spark):
    rows = [(i % 3, (i * 7) % 5, i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "a int, b int, y int")
    for r in rules.search_rules(df, "y", ("a", "b"), (("a", "b"),)).collect():
        if r["rule_type"] == "single":
            i = "ab".index(r["feature_1"])
            hit = [x[i] >= r["threshold_1"] for x in rows]
        else:
            op = any if r["rule_type"] == "or" else all
            hit = [op((x[0] >= r["threshold_1"], x[1] >= r["threshold_2"])) for x in rows]
        assert (r["tp"], r["fp"]) == (sum(h and x[2] for h, x in zip(hit, rows)), sum(h and not x[2] for h, x in zip(hit, rows)))


def test_patch_is_moved_inside_the_grid(spark):
    pix = spark.range(100).select(F.floor(F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    pts = spark.createDataFrame([("corner", 0, 9), ("middle", 5, 5)], "sample_id string, row int, col int")
    got = {(r["sample_id"], r["dr"], r["dc"]): r["value"] for r in raster.extract_patches(pts, pix, 10, 10, 4).collect()}
    assert len(got) == 32 and got[("corner", 0, 0)] == 6.0 and got[("middle", 0, 0)] == 33.0
    assert raster.extract_patches(pts, pix, 3, 10, 4).count() == 0


def test_diagonal_fires_are_two_clusters(spark):
    pix = spark.createDataFrame([(0, 0, 1), (1, 1, 1), (1, 2, 1), (5, 5, 0)], "row int, col int, fire int")
    got = [tuple(r) for r in raster.fire_clusters(pix, 8, 8, 0, 3).collect()]
    assert got == [(2, 1, 1, 9), (1, 0, 0, 0)]
    assert raster.fire_clusters(pix.filter("fire = 0"), 8, 8, 2, 3).count() == 0


def test_components_do_not_depend_on_row_order(spark):
    edges = spark.createDataFrame([(i, (i * 5) % 17) for i in range(17)] + [(30, 31), (31, 32)], "a long, b long")
    one = sorted(map(tuple, graph.components(edges).collect()))
    two = sorted(map(tuple, graph.components(edges.orderBy(F.rand(3)).repartition(5).select(F.col("b").alias("a"), F.col("a").alias("b"))).collect()))
    assert one == two


def test_errors_that_must_be_raised(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, x double")
    b = spark.createDataFrame([(2, 3.0)], "k int, y double")
    with pytest.raises(Exception, match="different times"):
        quality.merge_members(a, b, ["k"]).collect()
    assert quality.merge_members(a, b, ["k"], "outer").count() == 2
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 2.0, 0.0, 3.0, 1.0)], "source string, west double, south double, east double, north double")
    with pytest.raises(Exception, match="no common area"):
        joins_space.intersect_bounds(boxes).collect()
    with pytest.raises(ValueError, match="no optical"):
        tables.tile_index(spark.createDataFrame([("x.txt",)], "path string"))
    grid = tables.grid(0.0, 0.0, 2.0, 2.0, 1.0)
    pix = spark.createDataFrame([("l", 0, 0, 1.0)], "layer string, row int, col int, value double")
    with pytest.raises(Exception, match="outside"):
        raster.sample_at(spark.createDataFrame([(5.0, 5.0)], "lat double, lon double"), pix, grid, ["l"]).collect()


def test_labels_of_days_without_a_source_are_unknown(spark):
    smp = spark.createDataFrame([(D(2024, 1, 1), 0), (D(2024, 1, 2), 1)], "label_date date, y_fire int")
    days = spark.createDataFrame([(D(2024, 1, 2),)], "d date")
    assert {r[0].day: r[1] for r in labels.labels_with_coverage(smp, days).collect()} == {1: None, 2: 1}


def test_running_sums_ranks_and_percentiles_over_ranges(spark):
    from emberframe.operators import ordered

    rows = [(None if i % 4 == 3 else f"g{i % 4}", (i * 37) % 101, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, k int")
    got = {(r["g"], r["k"]): (r["s"], r["s_total"]) for r in ordered.running_sums(df, ["g"], ["v", "k"], {"s": "k"}).collect()}
    ranks = {(r["g"], r["k"]): r["__rank"] for r in ordered.ranked(df, ["g"], ["v", "k"]).collect()}
    for g in {r[0] for r in rows}:
        own = sorted((v, k) for x, v, k in rows if x == g)
        upto = 0
        for i, (_, k) in enumerate(own):
            upto += k
            assert got[g, k] == (upto, sum(k for _, k in own)) and ranks[g, k] == i + 1
    q = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}
    want = {r["g"]: r["w"] for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, q.values()))).alias("w")).collect()}
    assert {r["g"]: pytest.approx([r[c] for c in q]) for r in ordered.percentiles(df, ["g"], "v", q).collect()} == want
    assert ordered.ranked(df.limit(0), [], ["v"]).count() == 0
    one = ordered.percentiles(df.limit(0), [], "v", {"m": 0.5}).collect()
    assert len(one) == 1 and one[0]["m"] is None


def test_no_window_over_a_whole_group(spark):
    """Windows of ranks, curves, samples and imputation are within ranges or over one row a range."""
    df = spark.range(1000).selectExpr("cast(id as string) as sample_id", "id % 7 as y_fire", "'train' as split", "rand(1) as p", "id % 2 as y")
    df = df.withColumn("y_fire", (F.col("y_fire") == 0).cast("int"))
    for out in (metrics.roc_auc(df), metrics.pr_curve(df), sampling.pct_rank(df, "p", ["split"], "r"), sampling.hash_sample(df, 100, "sample_id"), sampling.balanced_sample(df, 2.0), sampling.impute_median(df, ["p"])):
        text = plan(out)
        windows = [line for line in text.splitlines() if "Window [" in line]
        assert all("__range" in line for line in windows), windows
    assert sampling.hash_sample(df, 100, "sample_id").count() == 100


def test_nearest_point_however_far(spark):
    cells = spark.createDataFrame([("far", 0.0, 0.0), ("near", 10.0, 40.25), ("none", None, 1.0), ("nan", float("nan"), 1.0), ("tie", 10.0, 80.0)], "cell_id string, lat double, lon double")
    pts = spark.createDataFrame([(1, 10.0, 40.0), (2, 10.0, 120.0), (3, 10.0, 120.0), (4, None, 1.0), (5, 10.0, 40.25)], "pt_id long, lat double, lon double")
    got = {(r["cell_id"], r["pt_id"], r["how"]) for r in joins_space.map_grid_to_cells(cells, pts).collect()}
    assert got == {("near", 5, "in_cell"), ("far", 1, "nearest"), ("tie", 5, "nearest")}
    assert joins_space.map_grid_to_cells(cells, pts.limit(0)).count() == 0
    import random

    rng = random.Random(3)
    cs = [(f"c{i}", rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(60)]
    ps = [(i, rng.uniform(-20, 20), rng.uniform(-20, 20)) for i in range(80)]
    near = joins_space.map_grid_to_cells(spark.createDataFrame(cs, "cell_id string, lat double, lon double"), spark.createDataFrame(ps, "pt_id long, lat double, lon double")).filter("how = 'nearest'")
    where = {c: (a, b) for c, a, b in cs}
    for r in near.collect():
        a, b = where[r["cell_id"]]
        assert r["pt_id"] == min(ps, key=lambda p: ((p[1] - a) ** 2 + (p[2] - b) ** 2, p[0]))[0]


def test_trees_split_by_value_and_by_absence(spark):
    """A label that follows one column, or its absence, is learnt; calibrated scores rise with raw ones."""
    from emberframe.operators import ml

    rows = [(i, "val" if i % 7 == 0 else "test" if i % 7 == 1 else "train", float(i % 10) if i % 3 else None, 1.0 * (i % 7), int((i % 10 > 6) if i % 3 else i % 2 == 0)) for i in range(600)]
    rows = [(i, s, x, z, y if x is not None else 1) for i, s, x, z, y in rows]
    df = spark.createDataFrame(rows, "k long, split string, x double, z double, y_fire int")
    scored = ml.score_trees(df, ml.train_trees(df, ["x", "z"], iterations=5, depth=3))
    got = ml.calibrate(scored.filter("split = 'val'"), scored.filter("split = 'test'")).collect()
    assert all((r["p_fire"] >= 0.5) == bool(r["y_fire"]) for r in got)
    order = sorted((r["p_raw"], r["p_fire"]) for r in got)
    assert all(a[1] <= b[1] for a, b in zip(order, order[1:]))


def test_components_of_a_hub_and_a_long_chain(spark):
    edges = [(0, i) for i in range(1, 1500)] + [(5000 + i, 5001 + i) for i in range(40)] + [(9000, 9001), (9001, 9000), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1500), 0), **dict.fromkeys(range(5000, 5041), 5000), 9000: 9000, 9001: 9000}


def test_frequent_keys_are_looked_up_in_a_broadcast_table(spark):
    from emberframe.sources.shared import looked_up

    rows = spark.createDataFrame([(1, i) for i in range(3000)] + [(2 + i % 40, i) for i in range(80)] + [(None, 1)], "k long, v long")
    table = rows.filter("k is not null").groupBy("k").count().withColumnRenamed("count", "n").withColumn("x", F.col("k") * 2)
    got = looked_up(rows, table, "k", "n", 3081)
    assert sorted(map(tuple, got.collect())) == sorted((k, v, 2 * k) for k, v in map(tuple, rows.collect()) if k is not None)
    assert "BroadcastHashJoin" in plan(got)


def test_no_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from emberframe.sources import shared

    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)), "x")
    assert shared.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]")), "x")


def test_stored_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    from itertools import count

    from emberframe.sources import shared

    n = count()
    monkeypatch.setattr(shared, "shared_dir", lambda spark, name: f"file://{tmp_path}/shared/{name}-{next(n)}")
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "a long, b long")
    with shared.dropped_after(spark):
        graph.components(edges).write.parquet(str(tmp_path / "out"))
        assert any((tmp_path / "shared").iterdir())
    assert not any((tmp_path / "shared").iterdir())
    kept = shared.stored(edges, "kept")
    assert kept.count() == 3 and any((tmp_path / "shared").iterdir())
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}


def test_first_rows_equal_a_sort(spark, monkeypatch):
    """Cuts through counts: ties, parts of one value, null parts, values far apart, more wanted than there are."""
    import random

    from emberframe.operators import ordered

    monkeypatch.setattr(ordered, "BUCKETS", 8)
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.choice([0.0, 1.0, -5.5, 1e300, rng.random(), rng.random() * 1e-9]), float(rng.randrange(3)), f"k{i % 350}") for i in range(700)]
    rows += [("d", 2.0, 1.0, f"d{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "part string, x double, y double, k string")
    for want in ({("a",): 17, (None,): 60, ("c",): 10_000, ("d",): 7, ("e",): 3}, {("a",): 1, ("b",): 0}, {("b",): 90, ("d",): 40}):
        got = [tuple(r) for r in ordered.first_rows(df, ["part"], ["x", "y", "k"], want).collect()]
        expect = [r for (p,), n in want.items() for r in sorted((r for r in rows if r[0] == p), key=lambda r: r[1:])[:n]]
        assert sorted(map(str, got)) == sorted(map(str, expect))
    cuts = ordered.cut_values(df, ["part"], "x", {("a",): 17, ("d",): 7})
    own = sorted(r[1] for r in rows if r[0] == "a")
    assert cuts[("a",)] == (own[16], sum(v < own[16] for v in own), own.count(own[16])) and cuts[("d",)] == (2.0, 0, 40)
    assert ordered.cut_values(df, [], "x", {(): 350})[()][0] == sorted(r[1] for r in rows)[349]


def test_samples_sort_nothing(spark):
    df = spark.range(3000).select(F.concat(F.lit("s"), "id").alias("sample_id"), F.when(F.col("id") % 3 == 0, "train").otherwise("val").alias("split"), (F.col("id") % 10 == 0).cast("int").alias("y_fire"))
    for out in (sampling.hash_sample(df, 100, "sample_id"), sampling.balanced_sample(df, 2.0, caps={"train": 90}), sampling.cap_per_split(df, {"train": 50, "val": 60})):
        assert "Sort" not in plan(out) and "Window" not in plan(out)
