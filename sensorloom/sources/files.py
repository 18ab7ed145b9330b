"""Readers and writers of sensor files."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions.columns import missing_if_nan, parse_time, reading_time
from sensorloom.operators.sizing import checked_broadcast

# Time of day stays text: inference would attach today's date to it.
LONG_SCHEMA = T.StructType(
    [
        T.StructField("asset", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("time", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def infer_schema(spark: SparkSession, path: str) -> T.StructType:
    """Schema found by scanning the files, for a first look at unknown data."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path).schema


def read_long_csv(spark: SparkSession, path: str | Sequence[str], lenient: bool = False) -> DataFrame:
    """Long telemetry file or directory as (asset, variable, timestamp, value)."""
    raw = spark.read.schema(LONG_SCHEMA).option("header", True).csv(path)
    return raw.select(
        "asset",
        "variable",
        reading_time(F.col("date"), F.col("time"), lenient).alias("timestamp"),
        missing_if_nan(F.col("value")).alias("value"),
    )


def read_wide_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Wide table with a text `timestamp` and one double column per series."""
    reader = spark.read.option("header", True)
    if schema is None:
        names = reader.csv(path).columns
        kinds = [T.StringType() if n == "timestamp" else T.DoubleType() for n in names]
        schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    wide = reader.schema(schema).csv(path)
    return wide.withColumn("timestamp", parse_time(F.col("timestamp")))


def list_files(spark: SparkSession, directory: str, suffix: str = ".csv") -> list[str]:
    """Paths of the data files of a directory on any file system Spark can reach."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(directory).select("path")
    return sorted(r["path"] for r in found.collect())


def read_csv_by_name(spark: SparkSession, directory: str, types: dict[str, str], suffix: str = ".csv") -> DataFrame:
    """All CSV files of a directory with columns matched by name.

    Files whose header lists the columns in another order are read separately, one read per
    distinct header, and united by name; a column that a file lacks is NULL there. Columns
    are double unless `types` says otherwise. One pass finds the headers of all files, so the
    number of jobs follows that of distinct headers, not of files.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in file_headers(spark, directory, suffix).collect():
        groups.setdefault(tuple(next(csv.reader([r["header"]]))), []).append(r["path"])
    if not groups:
        raise FileNotFoundError(f"no {suffix} file in {directory}")
    out = None
    for header, paths in sorted(groups.items()):
        schema = ", ".join(f"`{c}` {types.get(c, 'double')}" for c in header)
        part = spark.read.schema(schema).option("header", True).csv(sorted(paths))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def file_headers(spark: SparkSession, directory: str, suffix: str = ".csv") -> DataFrame:
    """path, header: the first line of every file of a directory that has one."""
    lines = spark.read.option("pathGlobFilter", f"*{suffix}").text(directory)
    first = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"))
    # The ids of one task grow with its rows, so the first block's smallest one is the first line.
    first = first.where("_start = 0").withColumn("_at", F.monotonically_increasing_id())
    return first.groupBy("path").agg(F.min_by("value", "_at").alias("header"))


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """(src, dest) pairs of an XML dictionary; two different targets for one name fail the job."""
    pairs = (
        spark.read.format("xml").option("rowTag", "translation").schema("src string, dest string").load(path).distinct()
    )
    message = F.concat(F.lit("conflicting translations of "), F.col("src"))
    return pairs.groupBy("src").agg(
        F.when(F.count(F.lit(1)) > 1, F.raise_error(message).cast("string")).otherwise(F.max("dest")).alias("dest")
    )


def read_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of all days written by `write_daily_csv`."""
    schema = "asset string, range bigint, pred_WTURPower double, fcast_day date"
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists") -> None:
    """CSV with header. `single_file` funnels the last stage through one task; leave it off for large tables."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).csv(path)


def write_daily_csv(
    df: DataFrame, path: str, day: str = "fcast_day", columns: Sequence[str] = ("asset", "range", "pred_WTURPower"),
    rows_per_file: int = 1_000_000, mode: str = "errorifexists",
) -> None:
    """A folder per day, with as many even files as its rows need; one for a day of up to `rows_per_file` rows.

    The days are counted first, so a day that holds most of the rows is several tasks.
    """
    placed = df.select(F.col(day).cast("date").alias(day), *columns)
    counts = placed.groupBy(day).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("_files"))
    large = counts.where("_files > 1")
    if large.isEmpty():
        spread = placed.repartition(day)
    else:
        numbered = placed.join(checked_broadcast(large), day, "left")
        # Dealt out by content, so a task that runs again writes the same rows.
        part = F.pmod(F.xxhash64(*columns), F.coalesce("_files", F.lit(1)))
        spread = numbered.withColumn("_part", part).repartition(day, "_part").drop("_files", "_part")
    spread.write.mode(mode).partitionBy(day).option("header", True).option("maxRecordsPerFile", rows_per_file).csv(path)


def write_translations(pairs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(src, dest) pairs as an XML dictionary."""
    pairs.select("src", "dest").write.mode(mode).format("xml").option("rootTag", "assets").option("rowTag", "translation").save(path)
