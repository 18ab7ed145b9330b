"""Tables written between the phases of a study."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_opened: list[list[str]] = []


def staging_folder(spark: SparkSession) -> str:
    """Shared folder the cluster names for intermediate data.

    Where none is set, a local session gets one of its own; on a cluster, whose executors
    would each write to their own disks, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sensorloom-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, prefix: str = "staged") -> str:
    """Unused path in the staging folder."""
    return f"{staging_folder(spark)}/{prefix}-{uuid.uuid4().hex}"


def stage(df: DataFrame, layout: Sequence[str] = ()) -> DataFrame:
    """Write the table once and read it back.

    What follows starts from files that outlive executors, with a short plan.
    With `layout` the rows are range-partitioned and sorted by those columns:
    partitions stay even when one key dominates, and a later filter on the
    first column skips the row groups of all other keys.
    """
    path = fresh_path(df.sparkSession)
    if layout:
        df = df.repartitionByRange(*layout).sortWithinPartitions(*layout)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[table] = path
    for paths in _opened:
        paths.append(path)
    return table


def release(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more; other tables are left alone."""
    for table in tables:
        if path := _paths.pop(table, None):
            delete(table.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of all tables staged inside the block, for `delete` once their last reader is done."""
    paths: list[str] = []
    _opened.append(paths)
    try:
        yield paths
    finally:
        _opened[:] = [p for p in _opened if p is not paths]


def union_in_batches(
    names: Sequence[str], build: Callable[[Sequence[str]], list[DataFrame]], batch: int = 50
) -> DataFrame:
    """Union of one table per name, built `batch` names at a time.

    Beyond one batch each finished batch is staged, so the plan stays short
    however many names there are.
    """
    tables = []
    for start in range(0, len(names), batch):
        part = reduce(DataFrame.unionByName, build(names[start : start + batch]))
        tables.append(part if len(names) <= batch else stage(part))
    return reduce(DataFrame.unionByName, tables)
