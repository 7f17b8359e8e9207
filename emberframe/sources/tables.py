"""Readers and writers."""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import math
import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.sources.shared import stored

#: Bytes of the largest file whose content one row can hold, and of the pieces in which larger ones are read.
WHOLE, PIECE = (1 << 31) - (1 << 20), 1 << 20

#: Bytes of the largest file that a task reads whole from a local folder, and about those it hands on at once.
SMALL = 1 << 24


def read_feature_windows(spark: SparkSession, path: str, values: list[str], years: list[int] | None = None, months: list[int] | None = None, keys: tuple[str, ...] = ("grid_id", "latitude", "longitude")) -> DataFrame:
    """Columns of year=/month=/window=/ CSV files. Partition filters reach the listing, unread columns are pruned."""
    kind = {"grid_id": T.StringType()}
    head = spark.read.option("header", True).csv(path).columns
    dates = ("window_start", "window_end")
    fields = [T.StructField(c, T.StringType() if c in dates else kind.get(c, T.DoubleType())) for c in head if c not in ("year", "month", "window")]
    schema = T.StructType([*fields, T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()), T.StructField("window", T.StringType())])
    if missing := {*keys, *dates, *values} - set(schema.names):
        raise ValueError(f"missing columns: {sorted(missing)}")
    df = spark.read.schema(schema).option("header", True).csv(path)
    if years:
        df = df.filter(F.col("year").isin(*years))
    if months:
        df = df.filter(F.col("month").isin(*months))
    return df.select(*keys, *(F.to_date(c).alias(c) for c in dates), *values, "year", "month", "window")


#: Patterns of the name-derived keys, fixed values.
PATH_KEYS = {
    "day": (r"(?:^|/)(\d{4}-\d{2}-\d{2})\.tif$", ("date",)),
    "weather": (r"era5_(\d{4})_(\d{2})\.nc$", ("year", "month")),
    "optical": (r"s2_(\d{4})_(\d{2})(\d+)-(\d+)\.tif$", ("year", "month", "y_offset", "x_offset")),
    "aerosol": (r"s5p_(\d{4})_(\d{2})\.tif$", ("year", "month")),
}


def with_path_keys(df: DataFrame, kind: str, path: Column | str = "path") -> DataFrame:
    """Keys from a file name; null where the name doesn't fit."""
    pattern, names = PATH_KEYS[kind]
    p = F.col(path) if isinstance(path, str) else path
    found = {n: F.nullif(F.regexp_extract(p, pattern, i + 1), F.lit("")) for i, n in enumerate(names)}
    return df.withColumns({n: c.cast("date") if n == "date" else c.cast("int") for n, c in found.items()})


def tile_index(files: DataFrame, kind: str = "optical", path: str = "path") -> DataFrame:
    """One row per matching object, by year, month and offsets; an empty index raises an error."""
    keys = list(PATH_KEYS[kind][1])
    out = with_path_keys(files, kind, path).dropna(subset=keys).withColumn("filename", F.element_at(F.split(path, "/"), -1))
    if out.isEmpty():
        raise ValueError(f"no {kind} objects")
    return out.orderBy(*keys, "filename")


def read_daily(spark: SparkSession, path: str, start: str, end: str, warm_up: int = 40, day: str = "date") -> DataFrame:
    """Daily rows from `warm_up` days before start to end, from a dataset partitioned by year and month."""
    first, last = F.date_sub(F.lit(start).cast("date"), warm_up), F.lit(end).cast("date")
    months = F.col("year") * 12 + F.col("month")
    near = months.between(F.year(first) * 12 + F.month(first), F.year(last) * 12 + F.month(last))
    return spark.read.parquet(path).filter(near & F.col(day).between(first, last))


def read_boundary(spark: SparkSession, path: str) -> DataFrame:
    """(x1, y1, x2, y2): edges of the outer rings of a GeoJSON boundary (Feature, FeatureCollection or geometry)."""
    return boundary_edges(spark.read.text(path, wholetext=True))


def boundary_edges(texts: DataFrame, text: str = "value") -> DataFrame:
    """Edges of the outer rings of GeoJSON texts, one a row."""
    shape = "struct<type:string,coordinates:string>"
    doc = F.from_json(text, f"struct<type:string,coordinates:string,geometry:{shape},features:array<struct<geometry:{shape}>>>")
    own = F.when(doc["type"] == "FeatureCollection", F.transform(doc["features"], lambda f: f["geometry"])).when(doc["type"] == "Feature", F.array(doc["geometry"]))
    geometry = F.explode(F.coalesce(own, F.array(F.struct(doc["type"].alias("type"), doc["coordinates"].alias("coordinates")))))
    rings = "array<array<array<double>>>"
    g = texts.select(geometry.alias("g"))
    one, many = F.from_json("g.coordinates", rings), F.from_json("g.coordinates", f"array<{rings}>")
    ring = g.select(F.explode(F.when(F.col("g.type") == "Polygon", F.array(one)).when(F.col("g.type") == "MultiPolygon", many)).alias("p")).select(F.col("p")[0].alias("r")).filter("size(r) > 1")
    edge = F.transform(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.struct(*(F.get(F.get("r", i - 1 + k), F.lit(j)).alias(f"{'xy'[j]}{k + 1}") for k in (0, 1) for j in (0, 1))))
    return ring.select(F.inline(edge))


def read_perimeters(spark: SparkSession, path: str) -> DataFrame:
    return perimeters(spark.read.option("header", True).csv(path))


def perimeters(raw: DataFrame) -> DataFrame:
    """Upper-case names with underscores, dates parsed (bad ones null), a missing end is the start, no start: no row."""
    df = raw.toDF(*(c.replace(" ", "_").upper() for c in raw.columns))
    if "ALARM_DATE" not in df.columns:
        raise ValueError("ALARM_DATE is missing")
    parse = lambda c: F.coalesce(F.to_date(F.try_to_timestamp(c, F.lit("M/d/yyyy h:mm:ss a"))), F.try_to_date(F.col(c), "yyyy-MM-dd"))
    start = parse("ALARM_DATE")
    end = parse("CONT_DATE") if "CONT_DATE" in df.columns else F.lit(None).cast("date")
    return df.withColumns({"ALARM_DATE": start, "CONT_DATE": F.coalesce(end, start)}).filter(F.col("ALARM_DATE").isNotNull())


def load_splits(spark: SparkSession, path: str, days: tuple[str, ...] = ("label_date",)) -> DataFrame:
    """All splits of a dataset partitioned by `split`, days normalised; no rows raise an error."""
    df = spark.read.parquet(path)
    df = df.withColumns({d: F.to_date(d) for d in days if d in df.columns})
    if df.isEmpty():
        raise ValueError("all splits are empty")
    return df


def write_table(df: DataFrame, path: str, parts: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet; with parts, only the partitions that df holds are replaced."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*parts) if parts else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path in a file system that all machines mount; None for other systems and for patterns, which Spark opens."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" and not re.search(r"[*?{}\[\]\\]", path) else None


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def escaped(name: str) -> str:
    """A key or a value as Spark writes it in names of folders."""
    return re.sub(r"""["#%'*/:=?\\{\[\]^\x00-\x1f\x7f]""", lambda m: f"%{ord(m[0]):02X}", name)


def write_csv_by(df: DataFrame, path: str, key: str) -> None:
    """CSV in a new folder, one file a value of `key`, in Spark's folders key=value. Rows are few, but files many, so the
    tasks are of a fixed number. For a local file Spark's writer starts processes that set permissions, which take most of its
    time; there, tasks write the files themselves, and put each in place when it is whole, so that they can run again."""
    parts = df.withColumn(key, F.nullif(F.col(key).cast("string"), F.lit(""))).repartition(tasks(df.sparkSession), key)
    if (root := local_path(df.sparkSession, path)) is None:  # tasks put their files in place themselves, as the path is new
        parts.write.partitionBy(key).option("mapreduce.fileoutputcommitter.algorithm.version", 2).csv(path)
        return

    def write(rows: Iterator[Row]) -> None:
        for value, own in itertools.groupby(rows, key=lambda r: r[0]):
            folder = f"{root}/{escaped(key)}={'__HIVE_DEFAULT_PARTITION__' if value is None else escaped(value)}"
            os.makedirs(folder, exist_ok=True)
            hidden = f"{folder}/.{uuid.uuid4().hex}"
            with open(hidden, "w", encoding="utf-8", newline="") as f:
                f.writelines(f"{r[1]}\n" for r in own)
            os.replace(hidden, f"{folder}/part.csv")

    line = F.to_csv(F.struct(*(c for c in df.columns if c != key))).alias("line")
    os.makedirs(root)
    parts.select(key, line).sortWithinPartitions(key, "line").foreachPartition(write)


def write_metadata(meta: DataFrame, path: str) -> None:
    meta.write.mode("overwrite").json(path)


def file_name(path: str = "path", depth: int = 1) -> Column:
    """The last `depth` elements of a path."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - depth + 1, F.lit(1)), F.lit(depth)), "/")


def streamed_md5(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, __md5): base64 md5 of whole files, read by pieces. Takes what Arrow's file systems open: local, hdfs, s3, gs."""
    from pyarrow import fs

    for pdf in batches:
        for path in pdf["path"]:
            local = re.sub("^file:/+", "/", path)
            system, at = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
            digest = hashlib.md5()
            with system.open_input_stream(at) as f:
                while piece := f.read(PIECE):
                    digest.update(piece)
            yield pd.DataFrame({"path": [path], "__md5": [base64.b64encode(digest.digest()).decode()]})


def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, length): what local folders hold, without what Spark's readers hide; folders have no length."""

    def entries(folder: str) -> Iterator[tuple[str, int | None]]:
        with os.scandir(folder) as found:
            for e in found:
                if e.name[0] == "." or e.name[0] == "_" and "=" not in e.name or e.name.endswith("._COPYING_"):
                    continue
                try:
                    yield e.path, None if e.is_dir() else e.stat().st_size
                except FileNotFoundError:  # a link to nothing
                    continue

    rows = (row for pdf in batches for folder in pdf["path"] for row in entries(folder))
    while some := list(itertools.islice(rows, 10_000)):
        yield pd.DataFrame({"path": [p for p, _ in some], "length": pd.array([n for _, n in some], dtype="Int64")})


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files in a folder and all below it. Local folders are listed in tasks, those of a level at once,
    and stored, so that the driver holds no file's name; others by Spark's reader, whose rows have their content, too, and
    which leaves out empty files."""
    if (root := local_path(spark, path)) is None or not os.path.isdir(root):
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files, folders = [], spark.createDataFrame([(root,)], "path string")
    while not files or not folders.isEmpty():
        level = stored(folders.repartition(tasks(spark), "path").mapInPandas(listed, "path string, length long"), "file-names")
        files.append(level.filter("length IS NOT NULL"))
        folders = level.filter("length IS NULL").select("path")
    return functools.reduce(DataFrame.unionByName, files)


def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, length, content) of whole local files, some SMALL bytes at a time."""
    for pdf in batches:
        for _, some in pdf.groupby((pdf["length"].cumsum() // SMALL).to_numpy()):
            yield some.assign(content=[Path(p).read_bytes() for p in some["path"]])


def with_content(files: DataFrame) -> DataFrame:
    """Rows of `list_files` with the files' content."""
    if "content" in files.columns:
        return files
    return files.repartition(tasks(files.sparkSession), "path").mapInPandas(contents, "path string, length long, content binary")


#: Bytes that opening a file counts as where there are many small ones, and the most tasks that list folders.
OPEN_COST, LISTERS = "65536", "256"


@contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """Lists and reads files inside the block in tasks of up to some 2,000 small files, instead of 32, and folders by up to
    LISTERS tasks instead of 10,000. Both take place where a reader is made and where its table is stored."""
    wanted = {"spark.sql.files.openCostInBytes": OPEN_COST, "spark.sql.sources.parallelPartitionDiscovery.parallelism": LISTERS}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def audit_files(spark: SparkSession, path: str, manifest: DataFrame, depth: int = 1) -> DataFrame:
    """(name, status): verified, mismatched (size or md5), missing or unlisted. manifest: name, size, md5 (base64); names are
    the last `depth` elements of a path, one row each.

    Sizes come from the listing, whose join with the manifest is stored. Contents are read once, and each becomes its digest
    before anything is joined: whole up to WHOLE bytes, which a row can hold (SMALL in local folders); larger files, only those
    with a matching size and an md5 to compare, by pieces of PIECE bytes, each file in one task, as an md5 is one pass.
    Joins merge, as stored names are so compressible that tables of any number of files would be broadcast."""
    with many_files(spark):
        files = list_files(spark, path)
        whole = WHOLE if "content" in files.columns else min(WHOLE, SMALL)
        seen = files.select("path", file_name("path", depth).alias("name"), F.col("length").alias("__n"))
        j = stored(manifest.withColumn("__listed", F.lit(True)).join(seen, "name", "full_outer"), "audit-names")
        sized = F.col("size").isNull() | (F.col("size") == F.col("__n"))
        wanted = j.filter(sized & F.col("md5").isNotNull() & F.col("path").isNotNull()).select("path", "__n").distinct()
        digests = with_content(files.filter(F.col("length") <= whole)).select("path", F.base64(F.unhex(F.md5("content"))).alias("__md5"))
        opened = stored(digests.join(wanted.select("path").hint("merge"), "path", "left_semi"), "audit-digests")
    large = wanted.filter(F.col("__n") > whole).select("path").repartition(tasks(spark), "path")
    opened = opened.unionByName(large.mapInPandas(streamed_md5, "path string, __md5 string"))
    status = (
        F.when(F.col("__listed").isNull(), "unlisted")
        .when(F.col("__n").isNull(), "missing")
        .when(~sized, "mismatched")
        .when(F.col("md5").isNull() | (F.col("md5") == F.col("__md5")), "verified")
        .otherwise("mismatched")
    )
    return j.join(opened.hint("merge"), "path", "left").select("name", status.alias("status"))


def grid(west: float, south: float, east: float, north: float, step: float) -> dict:
    """A grid over an area, for the raster operators."""
    return {"west": west, "north": north, "dx": step, "dy": step, "width": math.ceil((east - west) / step - 1e-9), "height": math.ceil((north - south) / step - 1e-9)}
