"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.session import apply_settings
from sensorloom.sources.staging import release, stage

__all__ = ["arrow_map", "cells", "connected_components", "draw", "mix64", "only", "prepare", "read", "release", "stage"]

#: White space of the corpus operators: blank and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"


def prepare(spark: SparkSession, rows_per_batch: int = 1000) -> None:
    """Session options of the corpus operators: those of the library and small Arrow batches.

    Long texts make a batch of the default 10,000 rows too large for a worker.
    """
    apply_settings(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_per_batch))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def only(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Just the named columns; whatever else the table carries cannot clash with an operator's own names."""
    return df.select(*(F.col(c).alias(name) if isinstance(c, str) else c.alias(name) for name, c in columns.items()))


def cells(column: pa.Array | pa.ChunkedArray) -> list:
    """Python values of an Arrow column."""
    return column.to_pylist()


def arrow_map(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """mapInArrow for a function of one batch; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator: a bijection that spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draw(rows: DataFrame, total: int) -> tuple[DataFrame, dict]:
    """At most `total` different texts, as many of each label: (label, h), and the number of different ones by label.

    Those with the smallest hashes are drawn. `rows` has label and h, the hash of a text, and any number of copies. Hashes that cannot be
    among the smallest go before any label's rows meet, so no task sees more than about
    twice the wanted number of a label. There must be few labels.
    """
    counted = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count_distinct("h").alias("n")).collect()}
    if not counted:
        return rows, counted
    per_label = max(1, total // len(counted))
    span = 1 << 30
    # Twice the wanted share leaves too few only by a chance below e^-200 for a thousand wanted ones.
    limit = {k: span if n <= 4 * per_label + 100 else int(span * 2 * per_label / n) for k, n in counted.items()}
    limits = F.create_map(*(F.lit(x) for pair in limit.items() for x in pair))
    small = rows.where(F.pmod("h", F.lit(span)) <= limits[F.col("label")]).distinct()
    order = Window.partitionBy("label").orderBy(F.pmod("h", F.lit(span)), "h")
    return small.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_label).drop("place"), counted


def connected_components(edges: DataFrame, columns: Sequence[str] = ("a", "b"), rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an undirected graph: columns node, component.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): every step
    links the neighbours of a node to the smallest of them, so the graph keeps its
    components while paths shrink; no task holds more than running minima. Each round is
    written to the shared folder. Fails if `rounds` do not suffice; their number grows
    with the logarithm of the longest path.
    """
    a, b = columns
    links = stage(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    )
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        # Large star: neighbours above a node move to the smallest node of its neighbourhood.
        low = both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("low"))
        large = (
            both.where("lo > hi")
            .join(low, "hi")
            .select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
            .distinct()
        )
        # Small star: neighbours below a node, and the node itself, move to the smallest of them.
        floor = large.groupBy("hi").agg(F.min("lo").alias("low"))
        joined = large.join(floor, "hi")
        small = joined.select(F.col("lo").alias("hi"), F.col("low").alias("lo")).unionByName(
            floor.select("hi", F.col("low").alias("lo"))
        )
        after = stage(small.where("hi <> lo").distinct())
        # Done when a round leaves every link as it was: both have distinct links, so none new and as many says so.
        done = after.count() == links.count() and after.join(links, ["hi", "lo"], "left_anti").isEmpty()
        release(links)
        links = after
        if done:
            break
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    roots = links.select(F.col("lo").alias("node")).distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
