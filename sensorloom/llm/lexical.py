"""Ranked lexical search of many items at once: partial scores that items share are summed once per document."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import arrow_map, only, stage

#: Terms are runs of ASCII letters and digits and of all code points from U+0080 on; A-Z become lower case.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split into terms at a time.
CHUNK = 1 << 20
#: Documents whose accumulators a task holds at a time.
ROWS = 256


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, with repeats, in runs of about CHUNK bytes."""
    raw = text.encode().translate(_TERM_BYTES) if text else b""
    start = 0
    while start < len(raw):
        end = raw.find(b" ", start + CHUNK)
        end = len(raw) if end < 0 else end
        yield raw[start:end].split()
        start = end


class Sharing(NamedTuple):
    """A query-sharing graph: terms are its first nodes, shared sums the next ones, items its results.

    `levels` has for each level of shared nodes the first node, the parts of all its nodes
    in a row and where each node's parts start; a level's parts lie on earlier levels.
    """

    n_nodes: int
    levels: list[tuple[int, np.ndarray, np.ndarray]]
    items: np.ndarray
    item_parts: np.ndarray
    item_starts: np.ndarray

    def scores(self, acc: np.ndarray) -> np.ndarray:
        """Scores, items x documents. `acc` (nodes x documents) has the terms' scores in its first rows and is filled."""
        for first, parts, starts in self.levels:
            acc[first : first + len(starts)] = np.add.reduceat(acc[parts], starts, axis=0)
        return np.add.reduceat(acc[self.item_parts], self.item_starts, axis=0)


def mine(uses: np.ndarray, least: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """Shared term sets of a block of items, from its incidence (terms x items).

    Returns the parts of every shared node (numbered behind the terms) and the incidence
    (nodes x items) of what each item adds up in the end. Terms in the same items are one
    node first. Then, in rounds, nodes that are each other's most frequent companion, in
    `least` or more items, are joined to a new one, which takes their place in these items.
    """
    n_terms, n_items = uses.shape
    parts: list[np.ndarray] = []
    _, same = np.unique(np.packbits(uses, axis=1), axis=0, return_inverse=True)
    same = same.ravel()
    order = np.argsort(same, kind="stable")
    rest = uses.astype(np.float32)
    joined = []
    for members in np.split(order, np.flatnonzero(np.diff(same[order])) + 1):
        if len(members) > 1 and uses[members[0]].sum() >= least:
            parts.append(np.sort(members))
            joined.append(rest[members[0]].copy())
            rest[members] = 0
    rows = [rest, *([np.array(joined)] if joined else [])]
    rest = np.concatenate(rows)
    while True:
        active = np.flatnonzero(rest.sum(1) >= least)
        if len(active) < 2:
            break
        use = rest[active]
        best, often = np.empty(len(active), np.int64), np.empty(len(active))
        for start in range(0, len(active), 512):
            both = use[start : start + 512] @ use.T
            both[np.arange(len(both)), np.arange(start, start + len(both))] = 0
            best[start : start + 512], often[start : start + 512] = both.argmax(1), both.max(1)
        here = np.arange(len(active))
        left = here[(best[best] == here) & (often >= least) & (here < best)]
        if not len(left):
            break
        a, b = active[left], active[best[left]]
        both = rest[a] * rest[b]
        rest[a] -= both
        rest[b] -= both
        parts += list(np.stack([a, b], 1))
        rest = np.concatenate([rest, both])
    return parts, rest > 0


def _shared(table: pa.Table) -> pa.Table:
    """Graph of one block of items: a row per term, shared node and item, with the parts of each."""
    item, at_item = np.unique(table.column("item").to_numpy(), return_inverse=True)
    names = table.column("term").combine_chunks().dictionary_encode()
    uses = np.zeros((len(names.dictionary), len(item)), bool)
    uses[names.indices.to_numpy(), at_item] = True
    parts, rest = mine(uses)
    n_terms, n_shared = len(uses), len(parts)
    by_item = [np.flatnonzero(column).tolist() for column in rest.T]
    total = n_terms + n_shared + len(item)
    return pa.table(
        {
            "block": pa.array([table.column("block")[0].as_py()] * total, pa.int32()),
            "node": pa.array([*range(n_terms + n_shared), *[-1] * len(item)], pa.int32()),
            "term": pa.array([*names.dictionary.to_pylist(), *[None] * (n_shared + len(item))], pa.string()),
            "item": pa.array([*[None] * (n_terms + n_shared), *item.tolist()], pa.int64()),
            "parts": pa.array([*[None] * n_terms, *[p.tolist() for p in parts], *by_item], pa.list_(pa.int32())),
        }
    )


def _graph(rows: list) -> tuple[list[str], Sharing]:
    """Terms and graph of one block from its rows; shared nodes are renumbered by level."""
    nodes = sorted((r for r in rows if r.node >= 0), key=lambda r: r.node)
    names = [r.term for r in nodes if r.term is not None]
    items = sorted((r for r in rows if r.node < 0), key=lambda r: r.item)
    level = [0] * len(nodes)
    for r in nodes[len(names) :]:
        level[r.node] = 1 + max(level[p] for p in r.parts)
    order = sorted(range(len(nodes)), key=lambda i: (level[i], i))
    number = np.empty(len(nodes), np.int64)
    number[order] = np.arange(len(nodes))
    cut = lambda lists: np.cumsum([0, *map(len, lists[:-1])])
    flat = lambda lists: number[np.concatenate([np.asarray(x, np.int64) for x in lists])]
    levels = []
    for depth in range(1, max(level, default=0) + 1):
        own = [nodes[i].parts for i in order if level[i] == depth]
        levels.append((int(np.searchsorted([level[i] for i in order], depth)), flat(own), cut(own)))
    lists = [r.parts for r in items]
    return names, Sharing(len(nodes), levels, np.array([r.item for r in items], np.int64), flat(lists), cut(lists))


def _counted(docs: DataFrame, names: list[str]) -> DataFrame:
    """id, n (terms with repeats), terms and tfs (numbers and occurrences of the wanted ones, 32-bit) of documents with a term."""
    number = {x.encode(): i for i, x in enumerate(names)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, ns, terms, tfs = [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n, found = 0, Counter()
            for words in terms_of(text):
                n += len(words)
                seen = Counter(words)
                for x in seen.keys() & number.keys():
                    found[number[x]] += seen[x]
            if n:
                ids.append(key)
                ns.append(n)
                terms.append(np.fromiter(found.keys(), np.int32, len(found)).tobytes())
                tfs.append(np.fromiter(found.values(), np.int32, len(found)).tobytes())
        arrays = [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["id", "n", "terms", "tfs"])

    return arrow_map(docs, run, "id long, n long, terms binary, tfs binary")


def _holders(counted: DataFrame, n_terms: int) -> np.ndarray:
    """Number of documents that hold each wanted term; a batch sends one row per term it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=n_terms)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df)), pa.array(df[df > 0])], ["term", "df"])

    table = counted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(n_terms, np.int64)
    df[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return df


def _scored(counted: DataFrame, graph: Sharing, weights: np.ndarray, n_docs: int, n_terms_all: int, k: int) -> DataFrame:
    """item, id, score: the k best documents of every partition for each item."""
    n_items = len(graph.items)

    def best(item: np.ndarray, score: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((key, -score, item))
        item, score, key = item[order], score[order], key[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        return item[place < k], score[place < k], key[place < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0, np.int64),) * 3]
        size, floor = 0, np.ones(n_items, np.int64)
        acc = np.zeros((graph.n_nodes, ROWS), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                key = part.column(0).to_numpy()
                packed = part.column(2).to_pylist()
                doc = np.repeat(np.arange(len(packed)), [len(x) // 4 for x in packed])
                term = np.frombuffer(b"".join(packed), np.int32)
                tf = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int32).astype(np.int64)
                m = np.array([50 + 50 * n * n_docs // n_terms_all for n in part.column(1).to_pylist()], np.int64)
                acc[: len(weights)] = 0
                acc[term, doc] = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                scores = graph.scores(acc)[:, : len(key)]
                # A later equal score may still win by its smaller id.
                item, at = np.nonzero(scores >= floor[:, None])
                held.append((item, scores[item, at], key[at]))
                size += len(item)
                if size > 20 * k * n_items:
                    held = [best(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    counts = np.bincount(held[0][0], minlength=n_items)
                    lowest = np.minimum.reduceat(held[0][1], np.cumsum(counts)[counts > 0] - 1)
                    floor[counts > 0] = np.where(counts[counts > 0] == k, lowest, 1)
        item, score, key = best(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(graph.items[item]), pa.array(key), pa.array(score)], ["item", "id", "score"])

    return counted.select("id", "n", "terms", "tfs").mapInArrow(run, "item long, id long, score long")


def _top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank(
    docs: DataFrame,
    key: str,
    text: str,
    items: DataFrame,
    item_key: str,
    item_text: str,
    k: int = 50,
    block_terms: int = 20_000,
    block_items: int = 500,
) -> DataFrame:
    """The k best documents of every item: item_id, rank, doc_id, score (column names are fixed).

    Terms are those of `terms_of`. With N documents that have a term, L terms with repeats
    in all, n in one document, df documents that hold a term, tf its occurrences in one:
    w = floor(1000 * ln((2N + 2) / (2df + 1))), m = 50 + (50 * n * N) div L, and a score is
    the sum over an item's distinct terms of w * ((10**9 * tf) div (1000 * tf + 20 * m)).
    Scores of 0 are left out; equal scores go by ascending id.

    Items are dealt by hash to blocks of about `block_items` items and `block_terms` terms,
    so what the driver and a task hold of them is bounded however many there are. Per
    block: term sets that several items share are mined; one pass counts the wanted terms
    of every document; then a task sums every shared set once per document, and the sums
    along the graph to the items' scores. Partitions keep the k best of each item, which
    are merged in two steps.

    Rows that share an item key are one item; every row of `docs` is a document, repeated
    ones too. NULL or empty texts have no term; rows without a key take no part. Empty
    tables and items whose terms no document holds give no row. Other columns play no part.
    """
    spark = docs.sparkSession
    docs = only(docs, id=F.col(key).cast("long"), text=F.col(text)).where("id is not null")
    asked = only(items, id=F.col(item_key).cast("long"), text=F.col(item_text)).where("id is not null")

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [{x for words in terms_of(t) for x in words} for t in batch.column(1).to_pylist()]
        keys = [i for i, s in zip(batch.column(0).to_pylist(), sets, strict=True) for _ in s]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([x.decode() for s in sets for x in s], pa.string())], ["item", "term"])

    wanted = stage(arrow_map(asked, split, "item long, term string").distinct())
    n_terms, n_items = wanted.agg(F.count("*"), F.count_distinct("item")).first()
    n_blocks = max(1, math.ceil(n_terms / block_terms), math.ceil(n_items / block_items))
    blocks = wanted.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int"))
    graphs = stage(blocks.groupBy("block").applyInArrow(_shared, "block int, node int, term string, item long, parts array<int>"))

    found = []
    n_docs = n_terms_all = None
    for block in range(n_blocks):
        rows = graphs.where(F.col("block") == block).collect()
        if not rows:
            continue
        names, graph = _graph(rows)
        counted = stage(_counted(docs, names))
        if n_docs is None:
            n_docs, n_terms_all = counted.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in _holders(counted, len(names))], np.int64)
        part = _scored(counted, graph, weights, n_docs, n_terms_all, k)
        found.append(part if n_blocks == 1 else stage(part))
    rows = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "item long, id long, score long")
    # First among a share of the documents each, so no task sees what all partitions kept for one item.
    shares = _top(rows.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(16))), ["item", "share"], k).drop("rank", "share")
    return _top(shares, ["item"], k).select(
        F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score"
    )
