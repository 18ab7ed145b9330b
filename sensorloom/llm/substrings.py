"""Exact removal of long repeated byte strings by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import arrow_map, mix64, stage

#: Bytes of the strings that deal windows out to blocks.
SEED = 16
#: Low bits of a ranked seed that hold its place, so that the leftmost of equal seeds wins.
PLACE = 24
#: Rows of one block that are expanded together; a larger block is split by window hashes.
ROWS = 40_000


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every place of `data`, as one little-endian number."""
    out = np.empty(len(data) - 7, np.uint64)
    for shift in range(8):
        every = data[shift : shift + (len(data) - shift) // 8 * 8].view("<u8")
        out[shift::8] = every
    return out


def blocks_of(raw: bytes, length: int) -> tuple[np.ndarray, ...]:
    """Deal the windows of `length` bytes out to blocks: seed hash, place of the seed, first and last window start.

    A window belongs to the block of its smallest seed (the leftmost, if there are more),
    so equal windows meet in one block, at the same distance from the seed, wherever they
    stand. Windows in a row with the same seed are one segment.
    """
    n = len(raw) - length + 1
    if n < 1:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    data = np.frombuffer(raw, np.uint8)
    eight = _words(data)
    seeds = mix64(eight[: len(raw) - SEED + 1] * np.uint64(0x9E3779B97F4A7C15) ^ (eight[8:] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93))
    keep = np.uint64(~((1 << PLACE) - 1) & (2**64 - 1))
    span = length - SEED + 1
    places = np.empty(n, np.int64)
    # Pieces of at most 2**PLACE places, so that a place fits; they overlap by one window.
    step = (1 << PLACE) - span
    for start in range(0, n, step):
        end = min(n, start + step)
        part = seeds[start : end + span - 1]
        ranked = (part & keep) | np.arange(len(part), dtype=np.uint64)
        places[start:end] = start + (_sliding_min(ranked, span) & ~keep).astype(np.int64)
    first = np.flatnonzero(np.diff(places, prepend=-1))
    last = np.append(first[1:], n) - 1
    at = places[first]
    return seeds[at].view(np.int64), at, first, last


def collapsed(block: np.ndarray, content: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which segments of a text to keep, and the last window start of each.

    Of segments in a row with one block and content, as in a run of one letter or of a
    short period, the first stays as it is and the second reaches to the end of the row:
    all of these windows are repeated, and two segments say so.
    """
    same = np.zeros(len(block), bool)
    same[1:] = (block[1:] == block[:-1]) & (content[1:] == content[:-1])
    head = np.flatnonzero(~same)
    if len(head) == len(block):
        return head, last
    number = np.arange(len(block)) - head[np.cumsum(~same) - 1]
    keep = np.flatnonzero(number <= 1)
    ends = last.copy()
    tail = np.append(head[1:], len(block)) - 1
    second = head[tail > head] + 1
    ends[second] = last[tail[tail > head]]
    return keep, ends[keep]


def _sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every run of `span` values, by running minima from both ends of pieces of that length."""
    n = len(x) - span + 1
    padded = np.full(-(-len(x) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])


def expand(blocks: np.ndarray, lefts: np.ndarray, segments: list[bytes], length: int) -> np.ndarray:
    """Which window starts of which segments hold a string that another segment of the block has at the same distance.

    `blocks` is sorted; `lefts` are the seed's places in the segments. The segments'
    suffixes are kept in order, block by block, with the common prefix of neighbours.
    Breadth first, all intervals go one byte to the left at once: the byte before each
    suffix is the Burrows-Wheeler transform, and a stable sort by it inside a block is the
    backward step. Common prefixes so grow from 0 up, one at a time, and are cut off at
    `length`; neighbours that reach it lie in one interval of a repeated string.
    Returns a boolean matrix, segment by column; column `lefts.max()` is the seed.
    """
    m, pad = len(segments), int(lefts.max())
    sizes = np.fromiter(map(len, segments), np.int64, m)
    begin = pad - lefts
    width = int((begin + sizes).max())
    # Letters are bytes + 1. Before its begin a segment has a letter of no byte; behind its
    # end it has none (0), so that an ended suffix comes first and agrees with nothing.
    text = np.zeros((m, width), np.uint16)
    for i, s in enumerate(segments):
        text[i, : begin[i]] = 257
        text[i, begin[i] : begin[i] + sizes[i]] = np.frombuffer(s, np.uint8)
        text[i, begin[i] : begin[i] + sizes[i]] += 1
    text = np.ascontiguousarray(text.T)
    order = np.arange(m)
    group = blocks  # of the suffix in each place of the order; a block's places never change
    new_block = np.diff(group, prepend=group[0] - 1) != 0
    common = np.zeros(m, np.int16)  # with the suffix one place before
    number = np.cumsum(new_block) - 1
    starts = np.flatnonzero(new_block)
    repeated = np.zeros((m, width), bool)
    inner = ~new_block
    for column in range(width - 1, -1, -1):
        letter = text[column, order]
        # Blocks whose letters are not all one are sorted anew; the others keep their order.
        change = inner & (letter != np.roll(letter, 1))
        if change.any():
            touched = np.logical_or.reduceat(change, starts)[number]
            rows = np.flatnonzero(touched)
            by = np.argsort((number[rows] << 9) | letter[rows], kind="stable")
            moved = rows[by]
            new_letter = letter[moved]
            same = np.zeros(len(rows), bool)
            same[1:] = (new_letter[1:] == new_letter[:-1]) & (number[moved[1:]] == number[moved[:-1]])
            fresh = np.zeros(len(rows), np.int16)
            where = np.flatnonzero(same)
            if len(where):
                low, high = moved[where - 1] + 1, moved[where] + 1
                least = common[high - 1].copy()
                far = np.flatnonzero(high - low > 1)
                if len(far):
                    # Smallest common prefix over the places that lay between the two.
                    cuts = np.stack([low[far], np.minimum(high[far], m - 1)], 1).ravel()
                    inside = np.minimum.reduceat(common, cuts)[::2]
                    least[far] = np.minimum(inside, least[far])
                fresh[where] = least + 1
            keep = ~touched
            common[keep] += 1
            order[rows] = order[moved]
            common[rows] = fresh
        else:
            common += 1
        np.minimum(common, length, out=common)
        common[new_block] = 0
        absent = text[column, order] == 0
        if absent.any():
            common[absent] = 0
            common[1:][absent[:-1]] = 0
        full = common >= length
        if full.any():
            hit = full.copy()
            hit[:-1] |= full[1:]
            found = order[hit]
            repeated[found, column] = begin[found] <= column
    return repeated


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of every run of true cells."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _identity(text: Column) -> tuple[Column, Column]:
    """A text's name: two 64-bit hashes."""
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")


def _dealt(texts: DataFrame, length: int) -> DataFrame:
    """key, t1, t2, n_bytes, sha256, segs array<struct<block, content, at, first, last>> of every row."""
    schema = "key long, t1 long, t2 long, n_bytes long, sha256 string, segs array<struct<block: long, content: long, at: int, first: int, last: int>>"
    seg = pa.struct([("block", pa.int64()), ("content", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, sizes, parts, ends = [], [], [], [0]
        hashed = xxhash.xxh3_64_intdigest
        for text in batch.column(3).to_pylist():
            raw = text.encode("utf-8", "replace")
            digests.append(hashlib.sha256(raw).hexdigest())
            sizes.append(len(raw))
            block, at, first, last = blocks_of(raw, length)
            content = np.fromiter(
                (hashed(raw[a : b + length], p - a) for p, a, b in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)), np.uint64, len(at)
            ).view(np.int64)
            keep, last = collapsed(block, content, last)
            parts.append((block[keep], content[keep], at[keep], first[keep], last))
            ends.append(ends[-1] + len(keep))
        columns = [np.concatenate([p[i] for p in parts]) for i in range(5)]
        cells = pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(columns, seg, strict=True)], fields=list(seg))
        segs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests), segs], ["key", "t1", "t2", "n_bytes", "sha256", "segs"]
        )

    return arrow_map(texts, run, schema)


def _cut(chosen: DataFrame, length: int) -> DataFrame:
    """block, content, left, large, bytes: the segments named in `chosen` (text, digest, segs), cut out of their texts, once each per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, segs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "replace")
                # Of equal segments the shortest: a longer one stands for several in a row.
                for s in {(s["block"], s["content"]): s for s in sorted(segs, key=lambda s: s["first"] - s["last"])}.values():
                    out[0].append(s["block"])
                    out[1].append(s["content"])
                    out[2].append(s["at"] - s["first"])
                    out[3].append(s["large"])
                    out[4].append(raw[s["first"] : s["last"] + length])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["block", "content", "left", "large", "bytes"])

    return chosen.select("text", "segs").mapInArrow(run, "block long, content long, left int, large boolean, bytes binary")


def _expanded(segments: DataFrame, length: int) -> DataFrame:
    """block, content, lo, hi: runs of repeated window starts, as distances from the seed.

    Rows come sorted by block and content, so whole blocks are expanded some ten thousand
    segments at a time; of repeated rows one counts.
    """

    def solve(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        ids = [r[0] for r in rows]
        _, number = np.unique(np.array(ids, np.int64), return_inverse=True)
        lefts = np.array([r[2] for r in rows], np.int64)
        row, first, last = _runs(expand(number.astype(np.int64), lefts, [r[3] for r in rows], length))
        pad = lefts.max()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(ids, np.int64)[row]),
                pa.array(np.array([r[1] for r in rows], np.int64)[row]),
                pa.array((first - pad).astype(np.int32)),
                pa.array((last - pad).astype(np.int32)),
            ],
            ["block", "content", "lo", "hi"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] == held[-1][:2]:
                    continue
                if len(held) >= ROWS // 4 and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return segments.mapInArrow(run, "block long, content long, lo int, hi int")


def _by_window_hash(segments: DataFrame, length: int) -> DataFrame:
    """The same for blocks too large for one task: one row per window, counted by its hash.

    Costs a row per window instead of a byte, but no task holds a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, content, left, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(raw) - length + 1
                found = [xxhash.xxh3_64_intdigest(raw[i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, block, np.int64)),
                        pa.array(np.full(n, content, np.int64)),
                        pa.array(np.arange(n, dtype=np.int32) - left),
                        pa.array(np.array(found, np.uint64).view(np.int64)),
                    ],
                    ["block", "content", "at", "window"],
                )

    windows = segments.dropDuplicates(["block", "content"]).mapInArrow(run, "block long, content long, at int, window long")
    often = windows.groupBy("block", "at", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return windows.join(often, ["block", "at", "window"]).select("block", "content", F.col("at").alias("lo"), F.col("at").alias("hi"))


def _removed(found: DataFrame, length: int) -> DataFrame:
    """t1, t2, n_removed, n_spans, kept_sha256 from (text, marks of repeated window starts)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        for text, marks in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            raw = text.encode("utf-8", "replace")
            spans = merged((m["lo"], m["hi"] + length) for m in marks)
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            out[0].append(sum(b - a for a, b in spans))
            out[1].append(len(spans))
            out[2].append(kept.hexdigest())
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2])],
            ["t1", "t2", "n_removed", "n_spans", "kept_sha256"],
        )

    return arrow_map(found.select("t1", "t2", "text", "marks"), run, "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string")


def merged(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges [a, b) as maximal ones."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_bytes(docs: DataFrame, key: str, text: str, length: int = 400, block_rows: int = ROWS) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts anywhere else.

    Returns key, n_bytes, n_removed, n_spans, kept_sha256 for every row. Texts are UTF-8
    bytes, NULL is empty; matches do not cross rows; overlapping occurrences count, in
    one row too. Repeated rows are occurrences of each other. Keys are integers and may be NULL.

    1. One pass deals the windows of all texts out to blocks, in segments (see `blocks_of`).
       Equal segments need no comparison: two occurrences repeat every window in them.
       A long run of one letter or period is two segments per text (see `collapsed`).
    2. Blocks with two or more different segments get these, once each, and are expanded
       (see `expand`); a block above `block_rows` segments goes through window hashes.
    3. The repeated windows go back to the texts that hold their segments.

    Only texts with a segment in such a block move, once in each direction. Blocks and
    segments are told apart by 64-bit hashes of both the seed and the content.
    """
    if length < 2 * SEED:
        raise ValueError(f"strings of at least {2 * SEED} bytes only")
    name = ["t1", "t2"]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), *_identity(body), body.alias("text"))
    dealt = stage(_dealt(rows, length))
    each = dealt.select(*name, F.explode("segs").alias("s")).select(*name, "s.*")
    blocks = (
        each.groupBy("block")
        .agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"))
        .where("n > 1")
        .select("block", (F.col("lo") != F.col("hi")).alias("mixed"))
    )
    busy = stage(each.join(blocks, "block"))
    contents = stage(busy.groupBy("block", "content", "mixed").agg(F.count("*").alias("n"), F.min("t1").alias("source")))
    # Large blocks are told by names of segments, so that their bytes move once.
    crowds = contents.where("mixed").groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select("block", F.lit(True).alias("large"))
    some_large = crowds.limit(1).count() > 0
    contents = contents.join(crowds, "block", "left") if some_large else contents.withColumn("large", F.lit(None).cast("boolean"))
    marked = busy.drop("mixed").join(contents.withColumn("large", F.coalesce("large", F.lit(False))), ["block", "content"])

    # One row of `docs` stands for all copies of its text.
    lowest = F.lit(-(2**63)).cast("long")
    texts = dealt.where(F.col("n_bytes") >= length).groupBy(*name).agg(F.min(F.coalesce("key", lowest)).alias("own"))
    needed = marked.groupBy(*name).agg(
        F.collect_list(F.when(F.col("mixed") & (F.col("source") == F.col("t1")), F.struct("block", "content", "at", "first", "last", "large"))).alias("segs")
    )
    moved = stage(
        rows.withColumn("own", F.coalesce("key", lowest))
        .select(*name, "own", "text")
        .join(needed.join(texts, name), [*name, "own"])
        .select(*name, "text", "segs")
    )

    cut = _cut(moved.where(F.size("segs") > 0), length)
    runs = _expanded(cut.where("not large").drop("large").repartition("block").sortWithinPartitions("block", "content"), length)
    if some_large:
        runs = runs.unionByName(_by_window_hash(cut.where("large").drop("large"), length))
    runs = stage(runs)

    # A segment found twice is repeated as a whole; of the others the expanded runs are.
    mark = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")).alias("mark")
    whole = marked.where("n > 1").select(*name, mark(F.col("first"), F.col("last")))
    parts = marked.where("n = 1").join(runs, ["block", "content"]).select(*name, mark(F.col("at") + F.col("lo"), F.col("at") + F.col("hi")))
    marks = whole.unionByName(parts).groupBy(*name).agg(F.collect_set("mark").alias("marks"))
    done = _removed(moved.select(*name, "text").join(marks, name), length).dropDuplicates(name)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        dealt.drop("segs")
        .join(done, name, "left")
        .select(F.col("key").alias(key), "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))
    )
