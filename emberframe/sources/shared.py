"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Where none is configured, a local one in local mode, and an error on a cluster,
    whose machines could not read each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        base = tempfile.mkdtemp(prefix="emberframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: For each open `dropped_after`, the paths of the tables stored since.
_open: list[list[str]] = []


@contextmanager
def dropped_after(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that operators store inside the block when it ends. Their results are read from these tables, so
    results have to be written inside the block, too."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    for paths in _open:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key that more than one row in MANY has counts as frequent, so there are fewer than MANY of them.
MANY = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of rows with a table of one row a key, `n` of the `total` rows having it. Frequent keys are looked
    up in a broadcast table of fewer than MANY rows, so that no task has to take all rows of one; the others are joined."""
    often = F.col(n) * MANY > total
    few = F.broadcast(table.filter(often).drop(n))
    rest = rows.join(few.select(key), key, "left_anti").join(table.filter(~often).drop(n), key)
    return rows.join(few, key).unionByName(rest)
