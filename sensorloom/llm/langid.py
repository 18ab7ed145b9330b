"""Language identification by error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import arrow_map, draw, only

#: Buckets of the hashed character n-grams, and the longest n-gram.
BUCKETS = 1 << 12
LONGEST = 3
#: Characters of the short piece that each training text adds, so that short texts are learned too.
PIECE = 60
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams (1 to LONGEST letters) of a whole text; None without a letter.

    Lower case; every run of other characters counts as one blank. Long texts are taken in stretches.
    """
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))].astype(np.uint64)
    counts = np.zeros(BUCKETS)
    for start in range(0, len(codes), 1 << 20):
        part = codes[start : start + (1 << 20) + LONGEST - 1]
        hashed = np.zeros(len(part), np.uint64)
        for n in range(1, min(LONGEST, len(part)) + 1):
            hashed = (hashed[: len(part) - n + 1] + part[n - 1 :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(31)
            counts += np.bincount((hashed >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS)
    return counts


def _scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares: a unit vector, whatever the text's length."""
    return np.sqrt(counts / counts.sum(-1, keepdims=True))


def codewords(labels: int, seed: int = 11) -> np.ndarray:
    """Rows of +1 and -1, one per label, far apart.

    Up to five labels get every way to split them in two; more get the best of 50 seeded
    random codes of ten bits a doubling, by its smallest distance.
    """
    if labels == 1:
        return np.ones((1, 1))
    if labels <= 5:
        bits = range(1, 1 << (labels - 1))
        return np.array([[1 if label and b >> (label - 1) & 1 else -1 for b in bits] for label in range(labels)], float)
    rng = np.random.default_rng(seed)
    length = int(np.ceil(10 * np.log2(labels)))
    best, apart = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (labels, length))
        code = code[:, np.abs(code.sum(0)) < labels]
        d = (code.shape[1] - code @ code.T) / 2 + np.eye(labels) * length
        if d.min() > apart:
            best, apart = code, d.min()
    return best


class Model(NamedTuple):
    labels: list[str]
    code: np.ndarray  # label by bit
    weights: np.ndarray  # bucket by bit
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability-like scores of all labels by loss-weighted decoding, and the bits' outputs.

        A codeword's loss is the sum over bits of log(1 + exp(-bit * output)), each weighted
        by how far the bit's classifier is better than chance.
        """
        out = _scaled(counts) @ self.weights + self.bias
        loss = (self.trust * np.logaddexp(0, -self.code[None] * out[:, None])).sum(2)
        score = np.exp(loss.min(1, keepdims=True) - loss)
        return score / score.sum(1, keepdims=True), out


def fit(docs: DataFrame, text: str, label: str, sample_texts: int = 1600, steps: int = 120) -> Model | None:
    """Learn one classifier per bit from at most `sample_texts` different labelled texts; None if there are none.

    The bound on the sample is `sample_texts`, shared out evenly over the labels, whatever
    the number of copies; within a label the different texts with the smallest hashes are
    drawn, whole. Texts without a letter and NULL labels teach nothing. The n-gram counts
    of the sample, no texts, come to the driver.
    """
    rows = only(docs, text=F.col(text), label=F.col(label).cast("string")).where("label is not null and text is not null")
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    wanted, counted = draw(rows.select("label", "h"), sample_texts)
    if not counted:
        return None
    labels = sorted(counted)
    drawn = rows.join(F.broadcast(wanted), ["label", "h"]).groupBy("label", "h").agg(F.first("text").alias("text")).select("text", "label")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out: list[list] = [[], [], []]
        for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            start = (len(text) * 7919) % max(1, len(text) - PIECE + 1)
            for piece in (text, text[start : start + PIECE]):
                if (counts := grams(piece)) is not None:
                    at = np.flatnonzero(counts)
                    out[0].append(label)
                    out[1].append(at.astype(np.int32))
                    out[2].append(counts[at].astype(np.float32))
        kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["label", "at", "n"])

    found = arrow_map(drawn, run, "label string, at array<int>, n array<float>").toArrow()
    if not found.num_rows:
        return None
    x = np.zeros((found.num_rows, BUCKETS), np.float32)
    for i, (at, n) in enumerate(zip(found.column("at"), found.column("n"), strict=True)):
        x[i, at.values.to_numpy()] = n.values.to_numpy()
    x /= x.sum(1, keepdims=True)
    np.sqrt(x, out=x)
    y = np.array([labels.index(v) for v in found.column("label").to_pylist()])
    del found
    # Rows arrive in any order; sorted, they give the same model every time.
    order = np.lexsort((*x[:, x.any(0)].T[:64], y))
    x, y = x[order], y[order]
    code = codewords(len(labels))
    target = code[y]
    weight = 1.0 / np.bincount(y, minlength=len(labels))[y]
    weight = (weight / weight.sum())[:, None].astype(np.float32)
    # Logistic regression of all bits together, by gradient steps with momentum.
    w, bias = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(bias)
    for _ in range(steps):
        miss = (weight * target / (1 + np.exp(np.clip(target * (x @ w + bias), -30, 30)))).astype(np.float32)
        speed_w = 0.9 * speed_w + 4.0 * (x.T @ miss - 1e-5 * w)
        speed_b = 0.9 * speed_b + 1.0 * miss.sum(0)
        w, bias = w + speed_w, bias + speed_b
    right = (weight * (np.sign(x @ w + bias) == target)).sum(0)
    trust = np.clip(2 * right - 1, 0.05, 1)
    return Model(labels, code, w.astype(np.float64), bias.astype(np.float64), trust)


def identify(docs: DataFrame, text: str, model: Model | None, margin: float = 0.1) -> DataFrame:
    """`docs` with lang_pred, score (0 to 1), ambiguous.

    Every whole text is read. NULL texts and texts without a letter are `und` with score 0
    and ambiguous false; so is everything without a model. A text is ambiguous if the
    two nearest codewords' scores lie less than `margin` apart. Rows never change otherwise;
    columns of these names are replaced.
    """
    docs = docs.drop(*(c for c in ("lang_pred", "score", "ambiguous") if c != text))
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous")).schema
    names, index = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            labels, scores, unsure = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
            held: list[tuple[int, np.ndarray]] = []

            def settle(held=held, labels=labels, scores=scores, unsure=unsure) -> None:
                if held:
                    at = [i for i, _ in held]
                    p, _ = model.decode(np.stack([c for _, c in held]))
                    best = p.argmax(1)
                    ranked = np.sort(p, axis=1)
                    scores[at] = ranked[:, -1]
                    if p.shape[1] > 1:
                        unsure[at] = ranked[:, -1] - ranked[:, -2] < margin
                    for i, b in zip(at, best, strict=True):
                        labels[i] = model.labels[b]
                    held.clear()

            if model is not None:
                for i, value in enumerate(batch.column(index)):
                    if (counts := grams(value.as_py())) is not None:
                        held.append((i, counts))
                    if len(held) == 200:
                        settle()
                settle()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels), pa.array(scores), pa.array(unsure)], [*names, "lang_pred", "score", "ambiguous"]
            )

    return docs.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """A quarter of all documents, by the checksum of their key as text: never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
