"""Generic event and order tables read as sensor telemetry and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators.reshape import pivot_wide

ASSETS = ["A001", "A002", "A003", "A004", "A005"]
VARIABLES = ["click", "error", "purchase", "signup", "view"]
# `signup` has no entry on purpose: the unmatched case of the dictionary.
TRANSLATIONS = {"click": "WindSpeed", "view": "AmbTemp", "purchase": "Power", "error": "Press"}
SENSORS = {
    "click": "WNACWindSpeed",
    "view": "WNACAmbTemp",
    "purchase": "WTURPower",
    "error": "WGENPress",
    "signup": "WGENAngle",
}
SENSOR_COLUMNS = sorted(SENSORS.values())
HOUR = 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as long telemetry (asset, variable, timestamp, value, event_id)."""
    events = table(spark, sf_dir, "events")
    number = (F.col("user_id") % 5 + 1).cast("string")
    return events.select(
        F.concat(F.lit("A"), F.lpad(number, 3, "0")).alias("asset"),
        F.col("event_type").alias("variable"),
        F.col("ts").alias("timestamp"),
        "value",
        "event_id",
    )


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRANSLATIONS.items()), "src string, dest string")


def hourly(spark: SparkSession, sf_dir: str, reused: bool = False) -> DataFrame:
    """Mean per (asset, variable, hour); hours without a reading are absent.

    `reused` keeps it for queries that read it several times, so that the
    telemetry behind it is scanned once; lost blocks are recomputed from it.
    """
    hour = F.date_trunc("hour", F.col("timestamp")).cast("timestamp_ntz")
    means = (
        telemetry(spark, sf_dir)
        .select("asset", "variable", hour.alias("timestamp"), "value")
        .groupBy("asset", "variable", "timestamp")
        .agg(F.avg("value").alias("value"))
    )
    return means.persist() if reused else means


def sensor_names(df: DataFrame) -> DataFrame:
    pairs = [F.lit(x) for pair in SENSORS.items() for x in pair]
    return df.withColumn("sensor", F.try_element_at(F.create_map(*pairs), F.col("variable")))


def raw_history(means: DataFrame) -> DataFrame:
    """Wide telemetry per (asset, hour) with `day` and the day it is used to predict."""
    long = sensor_names(means)
    wide = pivot_wide(long, ["asset", "timestamp"], "sensor", "value", SENSOR_COLUMNS, how="mean")
    day = F.to_date("timestamp")
    return wide.withColumns({"day": day, "fcast_day": F.date_add(day, 1)})


def forecasts(means: DataFrame) -> DataFrame:
    """Persistence forecasts: the hourly means of a day are issued for the next day."""
    used = means.filter(F.col("variable").isin("click", "view"))
    wide = pivot_wide(sensor_names(used), ["asset", "timestamp"], "sensor", "value", ["WNACAmbTemp", "WNACWindSpeed"], how="mean")
    issued = F.date_add(F.to_date("timestamp"), 1)
    seconds = (F.hour("timestamp") * HOUR).cast("bigint")
    return wide.select(
        "asset",
        issued.alias("fcast_day"),
        seconds.alias("range"),
        (F.col("timestamp") + F.expr("INTERVAL 1 DAY")).alias("fcast_time"),
        F.col("WNACWindSpeed").alias("WNACWindSpeed_fcast"),
        F.col("WNACAmbTemp").alias("WNACAmbTemp_fcast"),
    )
