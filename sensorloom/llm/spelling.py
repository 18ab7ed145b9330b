"""Spelling variants by permuterm rotations: words one inserted, deleted or replaced code point apart."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import only, stage

#: One byte a code point: letters (A-Z as a-z) stay, all else separates. Code points above U+00FF come as "?".
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Different words a task counts before it passes their counts on.
HELD = 200_000
#: Code points of a text that are split at a time.
CHUNK = 1 << 20
#: Ends a word in its rotations; no word holds it.
END = "$"


def runs_of(text: str | None) -> Iterator[list[bytes]]:
    """Lower-cased runs of [A-Za-z\\u00C0-\\u00FF] of a text in Latin-1, with repeats, some CHUNK at a time."""
    raw = text.encode("latin-1", "replace").translate(_LETTERS) if text else b""
    start = 0
    while start < len(raw):
        end = raw.find(b" ", start + CHUNK)
        end = len(raw) if end < 0 else end
        yield raw[start:end].split()
        start = end


def slipped(run: bytes, seed: int, every: int) -> bytes:
    """The run, less one code point where `every` divides the crc32 of `<doc_id>:<run>`; `seed` is that of `<doc_id>:`."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    return run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]


def words(docs: DataFrame, key: str, text: str, least_length: int = 6, least_count: int = 5, every: int | None = 199) -> DataFrame:
    """Words of a corpus: word, n (occurrences), of `least_length` code points and `least_count` occurrences at least.

    With `every`, runs are read with slips: where it divides crc32("<key>:<run>"), the code
    point at that number modulo the length is left out. Rows without a key have no slips.
    NULL texts have no words.
    """

    def flush(counts: Counter) -> pa.RecordBatch:
        names = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([names, pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed = zlib.crc32(f"{doc}:".encode())
                for found in runs_of(value):
                    for x, n in Counter(found).items():
                        if len(x) >= least_length:
                            counts[x if doc is None or every is None else slipped(x, seed, every)] += n
                    if len(counts) > HELD:
                        yield flush(counts)
                        counts = Counter()
        yield flush(counts)

    rows = only(docs, key=key, text=F.col(text))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def rotations(table: DataFrame) -> DataFrame:
    """rotation, whole, first, word, n: what the words' rotations have in common with those of near words.

    A word a + c + b, ended by "$", has the rotation b + "$" + a + c. Words that differ in c
    alone share it up to there, and a word a + b has just that as a rotation of its own. So
    each word sends every rotation with its last code point skipped, and every rotation
    whole. `first` marks the first of equal code points in a row: deleting any of them gives the same word.
    """
    at = F.col("i")
    before, skipped, after = (F.expr(x) for x in ("substring(word, 1, i)", "substring(word, i + 1, 1)", "substring(word, i + 2)"))
    skip = table.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("i")).select(
        F.concat(after, F.lit(END), before).alias("rotation"),
        F.lit(False).alias("whole"),
        ((at == 0) | (F.expr("substring(word, i, 1)") != skipped)).alias("first"),
        "word",
        "n",
    )
    rest = F.expr("substring(word, i + 1)")
    whole = table.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i")).select(
        F.concat(rest, F.lit(END), before).alias("rotation"), F.lit(True).alias("whole"), F.lit(True).alias("first"), "word", "n"
    )
    return skip.unionByName(whole)


def _best(rows: list[tuple]) -> tuple[tuple | None, tuple | None]:
    """The two first of (word, n) by falling n, then word."""
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))[:2]
    return tuple((*ordered, None, None)[:2])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per member of a group of equal rotations: word, n_near (near words found here), near_n and near (the commonest of them).

    Rows come sorted by rotation. A group has one whole rotation at most, and one row per
    code point skipped, so the alphabet bounds it; its members are never paired with each other.
    """
    rest = None
    schema = ["word", "n_near", "near_n", "near"]
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())

    def groups(table: pa.Table) -> pa.RecordBatch:
        out: list[tuple] = []
        key = table.column("rotation").combine_chunks()
        new = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
        # Rows that have a neighbour with the same rotation.
        starts = [0, *(new.nonzero()[0] + 1).tolist(), len(key)]
        shared = [(a, b) for a, b in zip(starts, starts[1:], strict=False) if b - a > 1]
        if shared:
            take = pa.array([i for a, b in shared for i in range(a, b)])
            columns = [table.column(c).take(take).to_pylist() for c in ("whole", "first", "word", "n")]
            rows = list(zip(*columns, strict=True))
            at = 0
            for a, b in shared:
                group = rows[at : at + b - a]
                at += b - a
                short = next(((w, n) for whole, _, w, n in group if whole), None)
                skips = [(w, n, first) for whole, first, w, n in group if not whole]
                longer = [r for r in skips if r[2]]
                if short and longer:
                    out.append((short[0], len(longer), *_best(longer)[0][1::-1]))
                best, second = _best(skips)
                for r in skips:
                    near = second if r is best else best
                    count = len(skips) - 1
                    if short and r[2]:
                        count += 1
                        near = _best([x for x in (near, short) if x])[0]
                    if near:
                        out.append((r[0], count, near[1], near[0]))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], schema)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        # The last group may go on in the next batch.
        key = rest.column("rotation")
        last = key[len(key) - 1]
        cut = pc.index(key, last).as_py()
        if cut:
            yield groups(rest.slice(0, cut))
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield groups(rest)


def variants(table: DataFrame, factor: int = 5) -> DataFrame:
    """Spelling variants among words: word, form, root, n, n_near, form_n, one row per word.

    `table` has one row per word: word, n. Near words are exactly one inserted, deleted or
    replaced code point apart. A word's form is its near word of largest n (ties: smallest
    in code-point order), if that n is `factor` times its own or more, else NULL; its root
    is found by following forms, the word itself if it has none.

    All rotations are range-partitioned and sorted once, groups of equal ones are scanned;
    a word of L code points costs 2 L + 1 rows whatever the others are. Forms grow in n
    by `factor` at each step, so pointer doubling settles the roots in a few joins.
    """
    table = stage(table)
    sorted_rotations = rotations(table).repartitionByRange("rotation").sortWithinPartitions("rotation")
    found = sorted_rotations.mapInArrow(_scan, "word string, n_near long, near_n long, near string")
    near = found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    )
    joined = table.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")
    )
    is_form = F.col("near_n") >= factor * F.col("n")
    formed = stage(
        joined.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    )
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("above"))
        step = stage(roots.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        roots = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group(
    docs: DataFrame, key: str, text: str, least_length: int = 6, least_count: int = 5, every: int | None = 199, factor: int = 5
) -> DataFrame:
    """Spelling variants of a corpus: word, form, root, n, n_near, form_n, by `words` and `variants`.

    NULL and empty texts, and empty tables, have no words. Repeated rows count as often as
    they stand there. Other columns play no part.
    """
    return variants(words(docs, key, text, least_length, least_count, every), factor)
