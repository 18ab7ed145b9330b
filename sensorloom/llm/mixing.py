"""Mixing sources to target weights: budgets down a tree, then a token prefix of each leaf.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import stage
from sensorloom.llm.quality import words_of

MISSING = "unknown"


def word_count(text: Column) -> Column:
    """Tokens of a text as this module counts them: words, 0 for NULL."""
    return F.size(words_of(text)).cast("long")


def weight_of(name: Column, weights: Mapping[str, int]) -> Column:
    """Weight of a node among its siblings: as given, else that of "*", else 1."""
    rest = F.lit(int(weights.get("*", 1)))
    return reduce(lambda out, kv: F.when(name == kv[0], F.lit(int(kv[1]))).otherwise(out), [kv for kv in weights.items() if kv[0] != "*"], rest).cast("long")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, int]], total: Column, epochs: int) -> DataFrame:
    """Budget of every leaf, in tokens: the levels, supply, budget.

    `leaves` has the levels and supply. A leaf can take `epochs` times its supply, nothing if
    it or a node above has weight 0; a node can take what its children can. From the root down every node's budget goes to its children by weight; what a child
    cannot take goes to its siblings first. Since a node is never given more than its
    children can take, a shortage reaches an ancestor's siblings only when all siblings
    are full. Parts are rounded down to whole tokens. Children of one node are filled in order of capacity per weight: once all
    children before one are full, the others share the rest at one rate. Children of
    weight 0 get nothing.
    """
    reached = reduce(Column.__and__, [weight_of(F.col(name), weights[i]) > 0 for i, name in enumerate(levels)])
    nodes = leaves.select(*levels, "supply", F.when(reached, F.col("supply") * epochs).otherwise(0).alias("capacity"))
    given = nodes.agg(F.sum("capacity").alias("capacity"), total.cast("long").alias("wanted")).select(
        F.least("capacity", "wanted").alias("given")
    )
    for depth in range(1, len(levels) + 1):
        own, above = list(levels[:depth]), list(levels[: depth - 1])
        level = nodes.groupBy(*own).agg(F.sum("supply").alias("supply"), F.sum("capacity").alias("capacity"))
        level = level.withColumn("weight", weight_of(F.col(own[-1]), weights[depth - 1]))
        level = level.join(given, above) if above else level.crossJoin(F.broadcast(given))
        ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(-1.0)
        siblings = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        before = siblings.orderBy("ratio", own[-1]).rowsBetween(Window.unboundedPreceding, -1)
        level = (
            level.withColumn("ratio", ratio)
            .withColumn("full", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
            .withColumn("open", F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
            .withColumn("rate", F.try_divide((F.col("given") - F.col("full")).cast("double"), F.col("open")))
        )
        # The first child that the common rate does not fill sets it; later ones would give less.
        level = level.withColumn("level_rate", F.max(F.when((F.col("weight") > 0) & (F.col("rate") < F.col("ratio")), F.col("rate"))).over(siblings))
        part = F.when(F.col("weight") <= 0, 0).otherwise(
            F.least(F.col("capacity"), F.floor(F.coalesce(F.col("level_rate"), F.col("ratio") + 1) * F.col("weight"))).cast("long")
        )
        given = level.select(*own, "supply", part.cast("long").alias("given"))
        if depth < len(levels):
            given = given.drop("supply")
    return given.withColumnRenamed("given", "budget")


def mix(docs: DataFrame, key: str, tokens: Column, levels: Mapping[str, Column], weights: Sequence[Mapping[str, int]], share: float, epochs: int, seed: str = "mix") -> DataFrame:
    """`docs` with the levels' names, n_tokens, n_copies (how often the mixture takes a row; 0 for the others).

    Columns of `docs` with one of these names give way to the operator's; `chosen` keeps them.

    The mixture has `share` of all tokens of `docs`, dealt out by `budgets`. A leaf's rows
    come in seeded epochs, each an order of its own by a hash of seed, epoch and key; as
    many whole epochs as fit are taken, and of the next one the rows whose running total
    stays within the rest. Rows that share key and tokens tie and go together. NULL names
    are the node `unknown`, rows without tokens are taken with the epoch in which their
    place lies. An empty table gives an empty mixture.

    Scale: rows are summed into 4,096 hash ranges per leaf before the running totals, which
    then need one row per range; only the range in which a leaf's budget ends is ordered
    row by row, so a leaf with a third of all rows is one task's work in a 4,096th only.
    """
    names = list(levels)
    taken = _taken(docs, key, tokens, levels, weights, share, epochs, seed)
    own = [c for c in docs.columns if c not in (*names, "n_tokens", "n_copies")]
    return taken.select(*(F.col("doc")[c].alias(c) for c in own), *names, F.col("tokens").alias("n_tokens"), "n_copies")


def chosen(docs: DataFrame, key: str, tokens: Column, levels: Mapping[str, Column], weights: Sequence[Mapping[str, int]], share: float, epochs: int, seed: str = "mix") -> DataFrame:
    """The rows of `docs` that `mix` takes at least once, with their own columns whatever these are called."""
    taken = _taken(docs, key, tokens, levels, weights, share, epochs, seed).where("n_copies > 0")
    return taken.select(*(F.col("doc")[c].alias(c) for c in docs.columns))


def _taken(docs: DataFrame, key: str, tokens: Column, levels: Mapping[str, Column], weights: Sequence[Mapping[str, int]], share: float, epochs: int, seed: str) -> DataFrame:
    """doc (a row of `docs`), the levels' names, tokens, n_copies."""
    names = list(levels)
    named = [F.coalesce(c.cast("string"), F.lit(MISSING)).alias(n) for n, c in levels.items()]
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(key).alias("key"), tokens.alias("tokens"), *named)
    light = stage(rows.select("key", "tokens", *names))
    leaves = light.groupBy(*names).agg(F.sum("tokens").alias("supply"))
    total = F.floor(F.sum("supply") * share)
    budget = stage(budgets(leaves, names, weights, total, epochs))
    plan = budget.select(
        *names,
        F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(0).cast("long").alias("whole"),
        F.when(F.col("supply") > 0, F.col("budget") % F.col("supply")).otherwise(0).cast("long").alias("rest"),
    )
    spot = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"))
    placed = light.join(plan, names).withColumn("spot", spot).withColumn("range", F.substring("spot", 1, 3))
    leaf = Window.partitionBy(*names)
    ranges = (
        placed.groupBy(*names, "whole", "rest", "range")
        .agg(F.sum("tokens").alias("tokens"))
        .withColumn("upto", F.sum("tokens").over(leaf.orderBy("range")))
        .withColumn("before", F.col("upto") - F.col("tokens"))
    )
    border = ranges.where("before <= rest and upto > rest").groupBy(*names).agg(F.min_by("range", "before").alias("range"), F.min("before").alias("before"))
    inner = placed.join(border, [*names, "range"])
    running = F.sum("tokens").over(Window.partitionBy(*names, "range").orderBy("spot", "key", "tokens"))
    last = (
        inner.withColumn("running", F.col("before") + running)
        .where("running <= rest")
        .groupBy(*names)
        .agg(F.max(F.struct("spot", F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"))).alias("last"))
    )
    # A row is in the prefix if its range ends within the rest, or its place is no later than the last one taken.
    cut = stage(
        plan.join(border.withColumnRenamed("range", "border"), names, "left").join(last, names, "left").select(*names, "whole", "border", "last")
    )
    out = rows.join(cut, names).withColumn("spot", spot)
    inside = F.when(F.col("border").isNull(), False).otherwise(
        (F.substring("spot", 1, 3) < F.col("border"))
        | F.coalesce(
            (F.substring("spot", 1, 3) == F.col("border")) & (F.struct("spot", F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key")) <= F.col("last")),
            F.lit(False),
        )
    )
    return out.select("doc", *names, "tokens", (F.col("whole") + inside.cast("long")).alias("n_copies"))
