"""Exact top-k inner products as a Voronoi kNN join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import only, stage

#: Rounding of the bounds, relative to the largest product, so that none is too tight.
SLACK = 1e-9


def _numbers(lists: pa.Array, scale: int, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors that take part, and the vectors as whole numbers in doubles."""
    at, rows = [], []
    for i, v in enumerate(lists.to_pylist()):
        if v is None or any(x is None for x in v):
            continue
        x = np.floor(np.array(v, np.float64) * scale)
        if np.isfinite(x).all():
            at.append(i)
            rows.append(x)
    width = width or max(map(len, rows), default=0)
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return np.array(at, np.int64), out


def _assigned(vectors: DataFrame, pivots: np.ndarray, scale: int) -> DataFrame:
    """id, cell (nearest pivot), radius (distance to it), norm, vec (doubles) of every vector that takes part."""
    half = (pivots**2).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _numbers(batch.column(1), scale, pivots.shape[1])
            if not len(at):
                continue
            cell = (x @ pivots.T - half).argmax(1)
            radius = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(cell.astype(np.int32)),
                    pa.array(radius),
                    pa.array(np.sqrt((x**2).sum(1))),
                    pa.array([row.tobytes() for row in x], pa.binary()),
                ],
                ["id", "cell", "radius", "norm", "vec"],
            )

    return vectors.mapInArrow(run, "id long, cell int, radius double, norm double, vec binary")


def _pivots(vectors: DataFrame, n: int, scale: int) -> np.ndarray:
    """`n` vectors with the smallest hashes of their ids, whole-numbered, padded to the longest vector of the table."""
    width = vectors.agg(F.max(F.size("vec"))).first()[0] or 1
    drawn = vectors.orderBy(F.xxhash64("id"), "id").limit(n).select("vec").toArrow()
    _, x = _numbers(drawn.column(0).combine_chunks() if drawn.num_rows else pa.array([], pa.list_(pa.float64())), scale, max(width, 1))
    return np.unique(x, axis=0) if len(x) else np.zeros((1, max(width, 1)))


def _summary(table: DataFrame, n: int) -> dict[str, np.ndarray]:
    """Distinct ids and largest radius of every cell: one small row each. A repeated row must not count twice for a threshold."""
    out = {"n": np.zeros(n), "radius": np.zeros(n)}
    for row in table.groupBy("cell").agg(F.count_distinct("id").alias("n"), F.max("radius").alias("radius")).collect():
        out["n"][row["cell"]], out["radius"][row["cell"]] = row["n"], row["radius"]
    return out


def _thresholds(pivots: np.ndarray, queries: dict, data: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query cell a score that its k-th best reaches; per pair of cells whether the data cell can matter.

    With q and x in the cells of p and r, |q - p| <= a and |x - r| <= b, the product q.x
    lies within a|r| + b|p| + ab of p.r. Taking data cells by falling lower bound, the one
    with which k + 1 vectors are counted (one may be the query itself) gives the threshold.
    """
    norm = np.sqrt((pivots**2).sum(1))
    middle = pivots @ pivots.T
    a, b = queries["radius"][:, None], data["radius"][None, :]
    spread = a * norm[None, :] + b * norm[:, None] + a * b + SLACK * (1 + np.abs(middle).max())
    low, high = middle - spread, middle + spread
    low[:, data["n"] == 0] = -np.inf
    order = np.argsort(-low, axis=1)
    counted = np.cumsum(data["n"][order], axis=1) >= k + 1
    first = counted.argmax(1)
    theta = np.where(counted.any(1), np.take_along_axis(low, order, 1)[np.arange(len(low)), first], -np.inf)
    return theta, (high >= theta[:, None]) & (data["n"] > 0)[None, :]


def _groups(counts: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """Query cells in groups of about `size` queries, and into how many parts each group is split."""
    out, held, n = [], [], 0
    for cell in np.flatnonzero(counts):
        if held and n + counts[cell] > size:
            out.append((held, 1))
            held, n = [], 0
        if counts[cell] > size:
            out.append(([int(cell)], int(-(-counts[cell] // size))))
        else:
            held, n = [*held, int(cell)], n + counts[cell]
    return [*out, (held, 1)] if held else out


def _best(queries: pa.Table, data: pa.Table, k: int) -> pa.Table:
    """The k best of `data` for each query, ties to smaller ids; exact for whole numbers."""
    stack = lambda t: np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float64).reshape(t.num_rows, -1 if t.num_rows else 0)
    # Repeated rows count once, before the k best are looked for.
    q_ids, at = np.unique(queries.column("id").to_numpy(), return_index=True)
    q = stack(queries)[at]
    x_ids, at = np.unique(data.column("id").to_numpy(), return_index=True)
    x = stack(data)[at]
    # Doubles hold the sums exactly below 2**53; beyond, Python's integers do.
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= 2.0**53:
        q, x = (m.astype(np.int64).astype(object) for m in (q, x))
    out: list[list] = [[], [], []]
    for start in range(0, len(q) if len(x) else 0, 256):
        scores = q[start : start + 256] @ x.T
        for own, row in zip(q_ids[start : start + 256], scores, strict=True):
            other = x_ids != own
            ids, row = x_ids[other], row[other]
            if len(row) > k and row.dtype != object:
                near = row >= np.partition(row, len(row) - k)[len(row) - k]
                ids, row = ids[near], row[near]
            top = sorted(range(len(row)), key=lambda i: (-row[i], ids[i]))[:k]
            out[0] += [int(own)] * len(top)
            out[1] += [int(ids[i]) for i in top]
            out[2] += [int(row[i]) for i in top]
    return pa.table([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, key: str, vector: str, every: int, k: int, scale: int = 256, pivots: int = 64, group_queries: int = 2000, block_rows: int = 20_000) -> DataFrame:
    """Each query's k best vectors by inner product: query_id, rank, vec_id, score.

    Components become floor(scale * x). Queries are the rows whose key is divisible by
    `every`, candidates all rows with another key; ties go to the smaller key. Vectors
    that are NULL or hold NULL or non-finite components, and rows without a key, take no
    part; shorter vectors count as padded with zeros; repeated rows count once. With
    fewer than k candidates all are returned.

    1. A bounded draw of `pivots` vectors deals all others out to Voronoi cells.
    2. Counts and radii of the cells (one row each) bound every product between two cells,
       and so the k-th best score of each query cell from below.
    3. Query cells form groups of about `group_queries`; a vector is copied to those groups
       alone for which its own bound (q.x <= p.x + radius * |x|) can reach the threshold.
    4. A group meets its vectors in blocks of about `block_rows` by hash, so neither a crowded
       cell nor one repeated vector makes a long task; blocks' best rows are merged.
    """
    rows = only(vectors, id=F.col(key).cast("long"), vec=F.col(vector)).where("id is not null")
    centres = _pivots(rows, pivots, scale)
    table = stage(_assigned(rows, centres, scale))
    asked = table.where(F.col("id") % every == 0)
    data, queries = _summary(table, len(centres)), _summary(asked, len(centres))
    theta, needed = _thresholds(centres, queries, data, k)
    groups = _groups(queries["n"], group_queries)
    blocks = max(1, round(data["n"].sum() / block_rows))

    number = {cell: g for g, (own, _) in enumerate(groups) for cell in own}
    parts = [n for _, n in groups]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, norm = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            x = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float64).reshape(len(cell), -1)
            # Bound of each vector for each query cell: product with its pivot and the cell's radius.
            bound = x @ centres.T + norm[:, None] * queries["radius"][None, :] + SLACK * (1 + norm[:, None] * np.abs(centres).max() * len(centres))
            wanted = needed.T[cell] & (bound >= theta[None, :])
            for g, (own, n) in enumerate(groups):
                take = np.flatnonzero(wanted[:, own].any(1))
                for part in range(n):
                    if len(take):
                        to = pa.array(np.full(len(take), g * 100_000 + part, np.int64))
                        rows = batch.take(pa.array(take))
                        yield pa.RecordBatch.from_arrays([to, rows.column(0), rows.column(4)], ["grp", "id", "vec"])

    copies = table.mapInArrow(routed, "grp long, id long, vec binary").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    to_group = F.lit(0).cast("long")
    if number:
        pairs = [F.lit(v) for cell, g in number.items() for v in (int(cell), g)]
        split = [F.lit(v) for g, n in enumerate(parts) for v in (g, n)]
        g = F.create_map(*pairs)[F.col("cell")]
        to_group = g.cast("long") * 100_000 + F.pmod(F.xxhash64("id"), F.create_map(*split)[g].cast("long"))
    sent = asked.select(to_group.alias("grp"), "id", "vec", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = (
        sent.groupBy("grp", "block")
        .cogroup(copies.groupBy("grp", "block"))
        .applyInArrow(lambda q, x: _best(q, x, k), "query_id long, vec_id long, score long")
        .distinct()
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
