"""Readers and writers on small files, and streams against their batch twins."""

import base64
import hashlib
import json

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from emberframe.operators import labels, weather
from emberframe.plans import stores
from emberframe.plans.views import view
from emberframe.sources import tables
from emberframe.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_feature_windows(spark, tmp_path):
    for y, m, w, v in ((2023, 1, "007", 1.5), (2024, 1, "002", 2.5), (2024, 2, "003", 3.5)):
        d = tmp_path / f"year={y}/month={m}/window={w}"
        d.mkdir(parents=True)
        (d / "features.csv").write_text(f"grid_id,latitude,longitude,window_start,window_end,f1,f2\ng1,33.0,-118.0,{y}-01-01,{y}-01-05,{v},9\n")
    df = tables.read_feature_windows(spark, str(tmp_path), ["f1"], [2024], [1])
    rows = df.collect()
    assert [(r["f1"], r["window"], str(r["window_end"])) for r in rows] == [(2.5, "002", "2024-01-05")] and "f2" not in df.columns
    assert "PartitionFilters: [isnotnull(year" in df._jdf.queryExecution().executedPlan().toString().replace("\n", " ")
    with pytest.raises(ValueError, match="nope"):
        tables.read_feature_windows(spark, str(tmp_path), ["nope"])


def test_perimeter_file(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Alarm Date,Cont Date,x\n7/4/2021 12:00:00 AM,7/9/2021 12:00:00 AM,1\n7/5/2021 1:30:00 PM,soon,2\n,7/9/2021 12:00:00 AM,3\n")
    got = [(str(r["ALARM_DATE"]), str(r["CONT_DATE"])) for r in tables.read_perimeters(spark, str(tmp_path / "p.csv")).collect()]
    assert got == [("2021-07-04", "2021-07-09"), ("2021-07-05", "2021-07-05")]


def test_boundary_file(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [0, 0]]], [[[5, 5], [6, 5], [5, 5]]]]}}))
    edges = tables.read_boundary(spark, str(tmp_path / "b.json"))
    assert sorted(tuple(r) for r in edges.collect()) == [(0, 0, 1, 0), (1, 0, 0, 0), (5, 5, 6, 5), (6, 5, 5, 5)]
    ring = [[0, 0, 9], [4, 0, 9], [4, 4, 9], [0, 0, 9]]
    for geo in ({"type": "Polygon", "coordinates": [ring, [[1, 0.5], [2, 0.5], [2, 1], [1, 0.5]]]}, {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}}]}):
        (tmp_path / "c.json").write_text(json.dumps(geo, indent=1))
        assert sorted(tuple(r) for r in tables.read_boundary(spark, str(tmp_path / "c.json")).collect()) == [(0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 0)]


def test_audit(spark, tmp_path):
    for n, b in (("a", b"xyz"), ("b", b"12"), ("d", b"?")):
        (tmp_path / n).write_bytes(b)
    md5 = base64.b64encode(hashlib.md5(b"xyz").digest()).decode()
    manifest = spark.createDataFrame([("a", 3, md5), ("b", 3, None), ("c", 1, None)], "name string, size long, md5 string")
    assert {r[0]: r[1] for r in tables.audit_files(spark, str(tmp_path), manifest).collect()} == {"a": "verified", "b": "mismatched", "c": "missing", "d": "unlisted"}


def test_partitions_are_overwritten_one_by_one(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.createDataFrame([("train", 1), ("val", 2)], "split string, x int"), path, ["split"])
    tables.write_table(spark.createDataFrame([("val", 3)], "split string, x int"), path, ["split"])
    assert sorted((r["split"], r["x"]) for r in tables.load_splits(spark, path).collect()) == [("train", 1), ("val", 3)]
    with pytest.raises(ValueError, match="empty"):
        tables.load_splits(spark, path + "/split=train", ()).filter("false").write.parquet(str(tmp_path / "e"))
        tables.load_splits(spark, str(tmp_path / "e"))


def test_daily_cache_with_warm_up(spark, tmp_path):
    path = str(tmp_path / "daily")
    df = spark.sql("SELECT explode(sequence(DATE '2023-11-01', DATE '2024-03-31')) AS date").withColumns({"year": F.year("date"), "month": F.month("date")})
    tables.write_table(df, path, ["year", "month"])
    got = tables.read_daily(spark, path, "2024-02-10", "2024-02-20").agg(F.min("date"), F.max("date"), F.count("*")).first()
    assert (str(got[0]), str(got[1]), got[2]) == ("2024-01-01", "2024-02-20", 51)


@pytest.fixture
def events(spark, tmp_path):
    view(spark, SF, "v_obs").select("event_id", "cell_id", F.col("ts").cast("timestamp").alias("ts"), "value").repartition(3).write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in")), lambda: spark.readStream.schema("event_id long, cell_id long, ts timestamp, value double").parquet(str(tmp_path / "in")), tmp_path


def closed(rows, key, top):
    return {k: v for k, v in ((key(r), tuple(r)) for r in rows) if k < top}


def test_label_stream_equals_batch(spark, events):
    batch, stream, tmp = events
    hot = lambda df: df.withColumn("conf", F.least("value", F.lit(100.0)))
    jobs.run_available(jobs.cell_labels_stream(hot(stream()), 60.0, "40 days"), str(tmp / "out"), str(tmp / "cp"))
    jobs.run_available(jobs.cell_labels_stream(hot(stream()), 60.0, "40 days"), str(tmp / "out"), str(tmp / "cp"))  # goes on, adds nothing
    want = {(r["day"], r["cell_id"]): tuple(r) for r in labels.cell_labels(hot(batch).withColumn("day", F.to_date("ts")), 60.0).collect()}
    got = [tuple(r) for r in spark.read.schema("day date, cell_id long, firms_n_pixels int, firms_max_confidence double, y_fire tinyint").parquet(str(tmp / "out")).collect()]
    assert len(got) == len({g[:2] for g in got}) and all(want[g[:2]] == g for g in got)  # days stay open for 40 days


def test_daily_stream_equals_batch(spark, events):
    batch, stream, tmp = events
    jobs.run_available(jobs.daily_stream(stream(), late="1 hours"), str(tmp / "out"), str(tmp / "cp"))
    want = {(r[0], r[1]): r for r in batch.groupBy(F.to_date("ts"), "cell_id").agg(F.count("*"), F.max("value")).collect()}
    got = spark.read.parquet(str(tmp / "out")).collect()
    last = max(k[0] for k in want)
    assert len(got) == sum(k[0] < last for k in want)
    assert all((r["n"], r["max"]) == tuple(want[(r["window_start"], r["cell_id"])])[2:] for r in got)


def test_alerts_sink_can_run_again(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", i, i / 10) for i in range(6)], "label_date string, cell_id int, p_fire double")
    write = jobs.alerts_sink(str(tmp_path / "a"), 2)
    for _ in range(2):
        write(df, 0)
    assert sorted(r["cell_id"] for r in spark.read.parquet(str(tmp_path / "a")).collect()) == [4, 5]


def test_alerts_of_a_day_over_three_batches(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 2}", i, ((i * 37) % 101) / 101) for i in range(60)]
    df = spark.createDataFrame(rows, "label_date string, cell_id int, p_fire double")
    write = jobs.alerts_sink(str(tmp_path / "a"), 5)
    for number in (0, 1, 1, 2, 0, 2):  # some run again
        write(df.filter(f"cell_id % 3 = {number}"), number)
    got = sorted((str(r["label_date"]), r["rank"], r["cell_id"]) for r in spark.read.parquet(str(tmp_path / "a")).collect())
    want = [(d, n + 1, c) for d in ("2024-01-01", "2024-01-02") for n, (c, _) in enumerate(sorted(((c, p) for x, c, p in rows if x == d), key=lambda r: (-r[1], r[0]))[:5])]
    assert got == want
    write(spark.createDataFrame([("2024-01-01", got[0][2], 0.0), ("2024-01-01", 99, 1.0)], df.schema), 3)  # the later batch counts
    top = spark.read.parquet(str(tmp_path / "a")).filter("label_date = '2024-01-01'").collect()
    assert {r["cell_id"] for r in top if r["rank"] == 1} == {99} and all(r["p_fire"] == 0 for r in top if r["cell_id"] == got[0][2])


def test_audit_names_and_sizes(spark, tmp_path, monkeypatch):
    for k in (1, 2, 3):
        (tmp_path / f"k={k}").mkdir()
        (tmp_path / f"k={k}" / "part.csv").write_text("x" * k)
    rows = [("k=1/part.csv", 1, base64.b64encode(hashlib.md5(b"x").digest()).decode()), ("k=2/part.csv", 2, None), ("k=9/part.csv", 1, None)]
    manifest = spark.createDataFrame(rows, "name string, size long, md5 string")
    ask = lambda: {r["name"]: r["status"] for r in tables.audit_files(spark, str(tmp_path), manifest, 2).collect()}
    assert ask() == {"k=1/part.csv": "verified", "k=2/part.csv": "verified", "k=3/part.csv": "unlisted", "k=9/part.csv": "missing"}
    monkeypatch.setattr(tables, "WHOLE", 0)
    assert ask()["k=1/part.csv"] == "verified" and ask()["k=2/part.csv"] == "verified"


def test_audit_of_a_file_that_no_row_can_hold(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in" / "large one.bin", "wb") as f:
        f.truncate(3 << 30)
        f.write(b"")
    (tmp_path / "in" / "bad.bin").write_bytes(b"abc")
    digest = hashlib.md5()
    for _ in range(3 << 6):
        digest.update(bytes(1 << 24))
    rows = [("large one.bin", 3 << 30, base64.b64encode(digest.digest()).decode()), ("bad.bin", 3, "AAAA")]
    got = {r["name"]: r["status"] for r in tables.audit_files(spark, str(tmp_path / "in"), spark.createDataFrame(rows, "name string, size long, md5 string")).collect()}
    assert got == {"large one.bin": "verified", "bad.bin": "mismatched"}


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 4), (3, 7)])
def test_carry_stream_equals_batch_for_any_batches(spark, tmp_path, monkeypatch, seed, parts):
    """Readings dealt to batches out of order, but never later than the bound: the same rows as the batch operator's, each
    once, and nothing but the last values left in wait when the watermark has passed all."""
    import random

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    monkeypatch.setattr(jobs, "PIECE", 3)
    rng = random.Random(seed)
    minutes = sorted(rng.randrange(3000) for _ in range(240))
    rows = [(i, rng.choice([7, 7, 7, 8, 9]), m, None if rng.random() < 0.4 else round(rng.random(), 3)) for i, m in enumerate(minutes)]
    held = sorted(rows, key=lambda r: r[2] + rng.randrange(110))  # up to 110 minutes late
    cuts = [0, *sorted(rng.sample(range(1, len(held)), parts - 1)), len(held)]
    batches = [held[a:b] for a, b in zip(cuts, cuts[1:])] + [[(1000 + k, k, 99_999, None) for k in (7, 8, 9)], [(2000, 7, 200_000, None)]]
    schema = "event_id long, cell_id long, minute long, value double"
    timed = lambda df: df.selectExpr("event_id", "cell_id", "timestamp_seconds(1704067200 + 60 * minute) as ts", "value")
    for i, own in enumerate(batches):
        timed(spark.createDataFrame(own, schema)).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        src = spark.readStream.schema("event_id long, cell_id long, ts timestamp, value double").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        jobs.run_available(jobs.carry_forward_stream(src, "2 hours"), str(tmp_path / "out"), str(tmp_path / "check"))
    batch = weather.carry_forward(timed(spark.createDataFrame(rows, schema)).withColumn("at", F.struct("ts", "event_id")), "cell_id", "at", "value", "carried")
    want = sorted((r["event_id"], r["cell_id"], r["ts"], r["carried"]) for r in batch.collect())
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [g for g in got if g[0] < 1000] == want
    assert {g[0] for g in got} == {r[0] for own in batches[:-1] for r in own}


def test_carry_stream_drops_what_is_too_late(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t = lambda h: f"2024-01-01 {h:02d}:00:00"
    batches = [[(1, 7, t(1), 1.0), (2, 7, t(3), None), (3, 8, t(3), None)], [(4, 7, t(2), 5.0), (5, 7, t(4), None), (6, 7, None, 3.0)], [(7, 7, t(4), 9.0), (8, 7, t(5), None)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id long, cell_id long, ts string, value double").selectExpr("event_id", "cell_id", "cast(ts as timestamp_ntz) as ts", "value").write.parquet(str(tmp_path / "in" / str(i)))
        src = spark.readStream.schema("event_id long, cell_id long, ts timestamp_ntz, value double").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        jobs.run_available(jobs.carry_forward_stream(src), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {r["event_id"]: r["carried"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: None, 5: 1.0, 8: 1.0}


def test_carry_stream_keeps_state_by_groups(spark, tmp_path, monkeypatch):
    """Uses of the state grow with the groups, not with the cells; cells of a group, and rows without a cell, stay apart."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    monkeypatch.setattr(jobs, "GROUPS", 2, raising=False)
    schema = "event_id long, cell_id long, ts timestamp_ntz, value double"
    row = lambda i, c, h, v: (i, c, f"2024-01-01 {h:02d}:00:00", v)
    rows = [row(i, c, i // 9, None if i % 3 else float(i)) for i in range(90) for c in [(None, 1, 2, 3, 4, 5, 6, 7, 8)[i % 9]]] + [row(90, 1, 20, None)]
    table = spark.createDataFrame(rows, "event_id long, cell_id long, ts string, value double").selectExpr("event_id", "cell_id", "cast(ts as timestamp_ntz) as ts", "value")
    table.write.parquet(str(tmp_path / "in"))
    jobs.run_available(jobs.carry_forward_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check"))
    want, last = {}, {}
    for i, c, _, v in rows:
        last[c] = want[i] = last.get(c) if v is None else v
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["event_id"]: r["carried"] for r in got} == want and {r["event_id"]: r["cell_id"] for r in got} == {r[0]: r[1] for r in rows}
    plan = jobs.carry_forward_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))._jdf.queryExecution().analyzed().toString()
    assert "pmod(xxhash64(cell_id" in plan


def test_audit_joins_digests_not_contents(spark, tmp_path, monkeypatch):
    plans, stored = {}, getattr(tables, "stored", lambda df, name: df)
    monkeypatch.setattr(tables, "stored", lambda df, name: (plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}), stored(df, name))[1], raising=False)
    (tmp_path / "a").write_bytes(b"xyz")
    kept = spark.conf.get("spark.sql.files.openCostInBytes")
    manifest = spark.createDataFrame([("a", 3, base64.b64encode(hashlib.md5(b"xyz").digest()).decode())], "name string, size long, md5 string")
    assert [tuple(r) for r in tables.audit_files(spark, str(tmp_path), manifest).collect()] == [("a", "verified")]
    at = plans["audit-digests"].splitlines()
    assert "LeftSemi" in at[0] and "md5(content" in at[1] and spark.conf.get("spark.sql.files.openCostInBytes") == kept


def test_csv_by_key_as_spark_writes_it(spark, tmp_path, monkeypatch):
    """The tasks' own files hold what Spark's writer writes, in the same folders: null, empty and odd keys, quotes, line ends."""
    rows = [(k, d, v) for k in (None, "", "a", "b/c=d", "é x%") for d, v in (("2024-01-02", None), ("2024-01-01", 'say "x",\nor y'), (None, ""))]
    df = spark.createDataFrame(rows, "key string, day string, v string").withColumn("day", F.to_date("day"))
    tables.write_csv_by(df, str(tmp_path / "own"), "key")
    with monkeypatch.context() as m:
        m.setattr(tables, "local_path", lambda s, path: None)
        tables.write_csv_by(df, str(tmp_path / "spark"), "key")
    got, want = (sorted((tuple(r) for r in spark.read.schema("day date, v string, key string").option("multiLine", True).csv(str(tmp_path / n)).collect()), key=str) for n in ("own", "spark"))
    assert got == want and len(got) == 15
    folders = lambda n: sorted(p.name for p in (tmp_path / n).iterdir() if p.is_dir())
    assert folders("own") == folders("spark") and len(folders("own")) == 4
    assert all([p.name for p in f.iterdir()] == ["part.csv"] for f in (tmp_path / "own").iterdir())


def test_file_audit_makes_one_file_a_cell_and_broadcasts_none(spark, tmp_path, monkeypatch):
    """One file a cell and none beside it (Spark's local writer adds a .crc, and starts a process for either); no name goes
    through the driver."""
    monkeypatch.setattr(stores, "shared_dir", lambda s, name: str(tmp_path / name))
    got = stores.file_audit(spark, SF)
    statuses = {(r["cell_id"], r["status"]) for r in got.collect()}
    cells = {r[0] for r in view(spark, SF, "v_day").select("cell_id").distinct().collect()}
    status = {1: "mismatched", 2: "mismatched", 3: "unlisted"}
    assert statuses == {(c, status.get(c % 5, "verified")) for c in cells} | {(c, "missing") for c in cells if c % 5 == 0}
    assert sorted(p.parent.name for p in (tmp_path / "audited").rglob("*") if p.is_file()) == sorted(f"cell_id={c}" for c in cells)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "binaryFile" not in plan


@pytest.mark.parametrize("small", [1 << 24, 4, 0])
def test_local_files_are_listed_in_tasks(spark, tmp_path, monkeypatch, small):
    """Folders of all levels, empty files, links; hidden names are left out. The driver makes no index of the files."""
    plans, stored = [], tables.stored
    monkeypatch.setattr(tables, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stored(df, name))[1])
    monkeypatch.setattr(tables, "SMALL", small, raising=False)
    root = tmp_path / "in"
    texts = {"a/b/c/deep one.csv": b"12345678", "a/top": b"abc", "e/empty": b"", "_k=1/x": b"q"}
    for name, text in {**texts, ".hidden/x": b"1", "_logs/x": b"1", "a/.x.crc": b"1", "a/y._COPYING_": b"1"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text)
    (root / "none").mkdir()
    (root / "link").symlink_to(root / "a/top")
    (root / "broken").symlink_to(root / "gone")
    texts["link"] = b"abc"
    ends = {n.split("/")[-1]: b for n, b in texts.items()}
    manifest = spark.createDataFrame([(n, len(b), base64.b64encode(hashlib.md5(b).digest()).decode()) for n, b in ends.items()], "name string, size long, md5 string")
    got = {r["name"]: r["status"] for r in tables.audit_files(spark, str(root), manifest).collect()}
    assert got == dict.fromkeys(ends, "verified") and not any("binaryFile" in p for p in plans)
    one = tables.audit_files(spark, str(root / "a/top"), manifest.filter("name = 'top'")).collect()  # a file, and a pattern: by Spark's reader
    assert [tuple(r) for r in one] == [("top", "verified")]
    assert {r["name"]: r["status"] for r in tables.audit_files(spark, str(root / "a/t*"), manifest).collect()}["top"] == "verified"
