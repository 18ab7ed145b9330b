"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import arrow_map, draw, only

#: Buckets of the hashed words, bins of a statistic, and factors of a feature.
BUCKETS = 1 << 13
BINS = 8
FACTORS = 8
#: Bytes of a text whose characters are counted at a time.
CHUNK = 1 << 20
#: Statistics of a text, in the order of `statistics`; the last one is metadata.
STATISTICS = ("words", "word_length", "upper", "lower", "digit", "space", "symbol", "mark", "stop", "beyond_ascii", "distinct", "commonest", "echo", "lines", "line_length", "distinct_lines", "n_chars")

_byte = np.arange(256)
_CLASSES = np.array(
    [
        (_byte >= 65) & (_byte <= 90),
        (_byte >= 97) & (_byte <= 122),
        (_byte >= 48) & (_byte <= 57),
        np.isin(_byte, list(b" \t\n\x0b\x0c\r")),
        np.isin(_byte, list(b"#*$%&|<>@^~_=+/\\{}[]")),
        np.isin(_byte, list(b"!?")),
        np.isin(_byte, list(b".,;:")),
        _byte >= 128,
    ]
).astype(float)


def statistics(raw: bytes, words: list[bytes], counts: Counter, n_chars: int | None) -> list[float]:
    """Numbers that describe a text's structure, and the logarithm of the size its metadata give (-1 if missing)."""
    held = np.zeros(256)
    for start in range(0, len(raw), CHUNK):
        held += np.bincount(np.frombuffer(raw[start : start + CHUNK], np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, n_lines = max(1, len(words)), max(1, len(lines))
    return [
        np.log2(1 + len(words)),
        sum(map(len, words)) / n,
        *(_CLASSES @ held / max(1, len(raw))).tolist(),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        np.log2(1 + len(lines)),
        np.log2(1 + len(raw) / n_lines),
        len(set(lines)) / n_lines,
        -1.0 if n_chars is None else np.log2(1 + max(0, n_chars)),
    ]


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Buckets of a text's lower-cased words, their values (square roots of the counts, of unit length), and its statistics."""
    raw = text.encode() if text else b""
    counts = Counter(raw.lower().split())
    held = np.zeros(0), np.zeros(0)
    if counts:
        at = np.fromiter((zlib.crc32(w) & (BUCKETS - 1) for w in counts), np.int64, len(counts))
        sums = np.bincount(at, np.fromiter(counts.values(), float, len(counts)), BUCKETS) if len(counts) > 500 else None
        if sums is None:
            at, inverse = np.unique(at, return_inverse=True)
            value = np.bincount(inverse, np.fromiter(counts.values(), float, len(counts)))
        else:
            at = np.flatnonzero(sums)
            value = sums[at]
        value = np.sqrt(value / value.sum())
        held = at, value
    return held[0].astype(np.int32), held[1].astype(np.float32), statistics(raw, raw.split(), counts, n_chars)


class Rows(NamedTuple):
    """Sparse rows: the features of all rows one after the other, their values, and where each row starts."""

    at: np.ndarray
    value: np.ndarray
    start: np.ndarray


class Model(NamedTuple):
    """A factorisation machine; bins of the statistics lie between `edges`."""

    edges: np.ndarray  # statistic by edge
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def rows(self, at: list[np.ndarray], value: list[np.ndarray], stats: np.ndarray) -> Rows:
        return _rows(self.edges, at, value, stats)

    def score(self, rows: Rows) -> np.ndarray:
        """Probability of label 1, in time linear in features and factors.

        The sum over all pairs of features of x_i x_j <v_i, v_j> is, factor by factor, half of
        the square of the sum of x_i v_i less the sum of their squares.
        """
        out, _ = _margin(self.bias, self.weights, self.factors, rows)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _rows(edges: np.ndarray, at: list[np.ndarray], value: list[np.ndarray], stats: np.ndarray) -> Rows:
    """Every row's words, then one bin per statistic; the bins together have unit length as the words have."""
    n = stats.shape[1]
    bins = np.stack([np.searchsorted(edges[s], stats[:, s], side="right") for s in range(n)], 1)
    own = BUCKETS + np.arange(n) * BINS + bins
    each = np.full(n, n**-0.5, np.float32)
    all_at = np.concatenate([x for words, row in zip(at, own, strict=True) for x in (words, row)])
    all_value = np.concatenate([x for words in value for x in (words, each)])
    return Rows(all_at.astype(np.int64), all_value, np.cumsum([0, *(len(x) + n for x in at[:-1])]))


def _margin(bias: float, weights: np.ndarray, factors: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of every row, and its sums of x_i v_i."""
    each = factors[rows.at] * rows.value[:, None]
    sums = np.add.reduceat(each, rows.start, axis=0)
    squares = np.add.reduceat(each * each, rows.start, axis=0)
    linear = np.add.reduceat(weights[rows.at] * rows.value, rows.start)
    return bias + linear + 0.5 * (sums * sums - squares).sum(1), sums


def _learned(edges: np.ndarray, rows: Rows, y: np.ndarray, importance: np.ndarray, steps: int, seed: int) -> Model:
    """Logistic loss by Adam steps over all rows; weights and factors decay a little."""
    size = BUCKETS + len(edges) * BINS
    rng = np.random.default_rng(seed)
    state = [np.zeros(1, np.float32), np.zeros(size, np.float32), rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32)]
    mean, spread = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state]
    of = np.repeat(np.arange(len(y)), np.diff([*rows.start, len(rows.at)]))
    order = np.argsort(rows.at, kind="stable")
    used, first = np.unique(rows.at[order], return_index=True)
    importance = (importance / importance.sum()).astype(np.float32)
    for step in range(1, steps + 1):
        bias, weights, factors = state
        margin, sums = _margin(bias[0], weights, factors, rows)
        miss = importance * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        each = miss[of] * rows.value
        toward = each[:, None] * (sums[of] - rows.value[:, None] * factors[rows.at])
        slope = [miss.sum(keepdims=True), 1e-5 * weights, 1e-4 * factors]
        slope[1][used] += np.add.reduceat(each[order], first)
        slope[2][used] += np.add.reduceat(toward[order], first, axis=0)
        for k, g in enumerate(slope):
            mean[k] = 0.9 * mean[k] + 0.1 * g
            spread[k] = 0.99 * spread[k] + 0.01 * g * g
            state[k] = state[k] - 0.1 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.99**step)) + 1e-8)
    return Model(edges, float(state[0][0]), state[1], state[2])


def fit(docs: DataFrame, key: str, text: str, size: Column, labels: DataFrame, label_key: str, label: str, sample_texts: int = 3000, steps: int = 60, seed: int = 3) -> Model | None:
    """Learn from at most `sample_texts` different labelled texts; None if there are none.

    The bound is `sample_texts`, shared evenly by the labels (0 and 1), and holds whatever the number
    of copies: among different texts of a label those with the smallest hashes are drawn,
    whole. Learning weighs the labels by their numbers of different texts. `size` is the
    metadata's size of a document, in any unit. Rows without key, text or label teach
    nothing; repeated labels of a document count once, contradicting ones both. Word buckets
    and statistics of the sample come to the driver, no texts.
    """
    rows = only(docs, id=F.col(key), text=F.col(text), size=size.cast("long")).where("id is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    known = only(labels, id=F.col(label_key), label=F.col(label).cast("int")).where("label in (0, 1)").distinct()
    drawn, counted = draw(rows.select("id", "h").join(known, "id").select("label", "h"), sample_texts)
    if not counted:
        return None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        kinds = (pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], ["label", "at", "value", "stats"])

    chosen = rows.join(F.broadcast(drawn), "h").groupBy("label", "h").agg(F.first("text").alias("text"), F.min("size").alias("size"))
    sample = arrow_map(chosen.select("label", "text", "size"), run, "label int, at array<int>, value array<float>, stats array<double>").toArrow()
    if not sample.num_rows:
        return None
    lists = lambda c: [x.values.to_numpy(zero_copy_only=False) for x in sample.column(c)]
    y = sample.column("label").to_numpy().astype(np.float32)
    stats = np.stack(lists("stats"))
    # Rows arrive in any order; sorted, they give the same model every time.
    order = np.lexsort((*stats.T, y))
    at, value = ([c[i] for i in order] for c in (lists("at"), lists("value")))
    y, stats = y[order], stats[order]
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    share = np.array([counted.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)])
    return _learned(edges, _rows(edges, at, value, stats), y, share[y.astype(int)], steps, seed)


def classify(docs: DataFrame, key: str, text: str, size: Column, model: Model | None) -> DataFrame:
    """Score of every row: key, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5, else 0).

    Whole texts are read; NULL and empty ones have no words and are scored by their
    statistics. Without a model every score is 0.5. Repeated rows are scored alike, empty
    tables give no row, other columns play no part.
    """
    rows = only(docs, id=F.col(key), text=F.col(text), size=size.cast("long"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            for start in range(0, batch.num_rows if model else 0, 200):
                part = batch.slice(start, 200)
                found = [features(t, s) for t, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                at, value, stats = zip(*found, strict=True)
                scores[start : start + len(found)] = model.score(model.rows(list(at), list(value), np.array(stats)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    return rows.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", key)


def held_out(key: Column) -> Column:
    """A third of all documents, by the checksum of their key as text: never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
