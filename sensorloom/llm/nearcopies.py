"""Near-duplicate documents by HyperMinHash registers, banding and verification on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import arrow_map, connected_components, mix64, only, release, stage

#: Registers of a sketch; a power of two. The top bits of a shingle's hash choose its register.
REGISTERS = 128
#: Registers in a band. A pair at similarity s is missed with probability (1 - s**4)**32: 4e-8 at 0.8.
BAND = 4
#: Mantissa bits kept behind the leading-zero count.
MANTISSA = 10
EMPTY = 0xFFFF
#: Shingles in one block of a bucket that is compared inside tasks.
BLOCK = 150_000
#: Words whose hashes a worker remembers.
REMEMBERED = 250_000

_known: dict[bytes, int] = {}


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    A-Z become lower case; words are [^\\x20\\x09-\\x0D]+. A text of fewer words is one
    shingle; NULL and blank texts have none.
    """
    split = text.encode("utf-8", "replace").lower().split() if text else []
    if not split:
        return np.empty(0, np.uint64)
    if len(_known) > REMEMBERED:
        _known.clear()
    try:
        ids = np.fromiter(map(_known.__getitem__, split), np.uint64, len(split))
    except KeyError:
        for w in split:
            if w not in _known:
                _known[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.fromiter(map(_known.__getitem__, split), np.uint64, len(split))
    n = min(words, len(ids))
    hashed = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        hashed = (hashed ^ ids[i : len(ids) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
    if n < words:
        hashed ^= np.uint64(n)
    return np.unique(mix64(hashed))


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash sketch: per register the smallest hash that falls into it, as leading zeros and mantissa.

    The set is sorted, so a register's smallest hash is the first one at or above the register's lower bound.
    """
    shift = np.uint64(64 - REGISTERS.bit_length() + 1)
    bounds = np.arange(REGISTERS, dtype=np.uint64) << shift
    at = np.searchsorted(shingles, bounds)
    found = shingles[np.minimum(at, len(shingles) - 1)] if len(shingles) else np.zeros(REGISTERS, np.uint64)
    full = (at < len(shingles)) & ((found >> shift) == np.arange(REGISTERS, dtype=np.uint64))
    rest = (found - bounds).astype(np.uint64)
    width = int(shift)
    # Leading zeros from the exponent of the number as a double; hashes are far below its rounding here.
    zeros = width - 1 - np.frexp(np.maximum(rest, 1).astype(np.float64))[1].astype(np.int64) + 1
    zeros = np.clip(zeros, 0, 62)
    below = np.maximum(width - 1 - zeros - MANTISSA, 0).astype(np.uint64)
    mantissa = (rest >> below) & np.uint64((1 << MANTISSA) - 1)
    packed = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    return np.where(full, packed, np.uint16(EMPTY))


#: For each register, the order in which an empty one looks for a full one to copy.
_PROBES = np.random.default_rng(7).integers(0, REGISTERS, (64, REGISTERS))


def densified(sketches: np.ndarray) -> np.ndarray:
    """Sketches (one per row) whose empty registers copy full ones, found along fixed random probes.

    Two sets agree in a copied register as often as in one of their own, so small sets
    keep the banding's recall. What 64 probes do not fill takes the nearest full register to the right.
    """
    out = sketches.copy()
    for probe in _PROBES:
        empty = out == EMPTY
        if not empty.any():
            return out
        out = np.where(empty, sketches[:, probe], out)
    for shift in range(1, REGISTERS):
        out = np.where(out == EMPTY, np.roll(sketches, -shift, axis=1), out)
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band of `BAND` registers."""
    dense = densified(sketches).astype(np.uint64).reshape(len(sketches), -1, BAND)
    keys = np.zeros(dense.shape[:2], np.uint64)
    for i in range(BAND):
        keys = mix64(keys + dense[:, :, i] + np.uint64(1 + i))
    return mix64(keys ^ (np.arange(dense.shape[1], dtype=np.uint64) << np.uint64(40)))


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of pairs of sketches, corrected for registers that agree by chance.

    Agreement among registers that are full on either side is j + (1 - j) * c, where c is
    the chance that two unrelated minima share leading zeros and mantissa; it follows
    from the number of hashes per register on either side.
    """
    either = (a != EMPTY) | (b != EMPTY)
    agree = ((a == b) & either).sum(1) / np.maximum(either.sum(1), 1)
    edges = 2.0 ** -np.arange(0, 24)
    survive = lambda n: np.exp(-np.outer(n / REGISTERS, edges))
    at_level = lambda n: np.diff(survive(n), axis=1)
    chance = (at_level(n_a) * at_level(n_b)).sum(1) / 2.0**MANTISSA
    return (agree - chance) / (1 - chance)


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """id, n (distinct shingles), digest of the set (NULL if empty), sketch."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, digests, sketches = [], [], []
        for text in batch.column(1).to_pylist():
            own = shingle_set(text, words)
            n.append(len(own))
            digests.append(hashlib.md5(own.tobytes(), usedforsecurity=False).digest() if len(own) else None)
            sketches.append(registers(own).tobytes() if len(own) else None)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())],
            ["id", "n", "digest", "sketch"],
        )

    return arrow_map(docs, run, "id long, n long, digest binary, sketch binary")


def _matrix(column: pa.Array, width: int = REGISTERS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, width)


def _bands(classes: DataFrame) -> DataFrame:
    """band, rep, n: one row for every class and band."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = band_keys(_matrix(batch.column(2)))
        each = keys.shape[1]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys.view(np.int64).ravel()),
                pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), each)),
                pa.array(np.repeat(batch.column(1).to_numpy(zero_copy_only=False), each).astype(np.int32)),
            ],
            ["band", "rep", "n"],
        )

    return arrow_map(classes.select("rep", "n", "sketch"), run, "band long, rep long, n int")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches do not rule out the wanted similarity.

    Pairs with half of all registers full or more go if their estimate is five of its
    standard deviations below the bound; smaller sets are left to the verification.
    """
    own = lambda c: classes.select(F.col("rep").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("n").alias(f"n_{c}"))
    joined = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    bound = percent / 100

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_a, n_b = (batch.column(i).to_numpy() for i in (2, 3))
        a, b = (_matrix(batch.column(i)) for i in (4, 5))
        full = ((a != EMPTY) | (b != EMPTY)).sum(1)
        floor = bound - 5 * np.sqrt(bound * (1 - bound) / np.maximum(full, 1))
        keep = pa.array((full < REGISTERS // 2) | (estimated(a, b, n_a, n_b) >= floor))
        return pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return arrow_map(joined, run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id, shingles (sorted 64-bit hashes) of the wanted ids; written once, as several steps read it.

    The ids grow with the corpus, so they are never broadcast; texts move once, and repeated
    ids go while the rows still lie by id.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [shingle_set(t, words).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "shingles"])

    chosen = docs.join(wanted.hint("merge"), "id", "left_semi").select("id", "text").dropDuplicates(["id"])
    return stage(arrow_map(chosen, run, "id long, shingles binary"))


def _common(sets: DataFrame) -> DataFrame:
    """id, common: how many shingles of each set are found in any other of the sets.

    A set shares no more than these with another one, which bounds every similarity.
    Counted by shingle with partial sums, however many sets hold it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                each = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
                ids = np.repeat(part.column(0).to_numpy(), [len(x) for x in each])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(each))], ["id", "shingle"])

    alone = (
        sets.mapInArrow(run, "id long, shingle long")
        .groupBy("shingle")
        .agg(F.count("*").alias("holders"), F.min("id").alias("id"))
        .where("holders = 1")
        .groupBy("id")
        .agg(F.count("*").alias("alone"))
    )
    size = (F.octet_length("shingles") / 8).cast("long")
    return sets.join(alone, "id", "left").select("id", (size - F.coalesce("alone", F.lit(0))).alias("common"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                place = np.searchsorted(x, y)
                place[place == len(x)] = 0
                both = int((x[place] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(compare, "a long, b long")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component."""
    several = rows.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    return rows.join(several.select("band"), "band", "left_semi")


def _across(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of one bucket and different components.

    A bucket is cut into blocks of about BLOCK shingles by hash; each two blocks, and each
    block with itself, are one group. A group forms no rows of pairs: intersections come
    from products of incidence matrices, and of the links found those leave it that
    join parts not joined before.
    """
    sizes = left.groupBy("band").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (
        left.join(sizes, "band")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "part", F.col("rep").alias("id"))
        .join(sets, "id")
    )

    def links(table: pa.Table) -> pa.Table:
        ids, part, block = (table.column(c).to_numpy() for c in ("id", "part", "own"))
        within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        order = np.lexsort((ids, part, block))
        ids, part, block = ids[order], part[order], block[order]
        packed = table.column("shingles").to_pylist()
        each = [np.frombuffer(packed[k], np.uint64) for k in order]
        size = np.array([len(x) for x in each])
        root = {p: p for p in set(part.tolist())}

        def find(p: int) -> int:
            while root[p] != p:
                root[p] = p = root[root[p]]
            return p

        out: list[tuple[int, int]] = []
        starts = range(0, len(ids), 128)
        for x in starts:
            for y in starts:
                a, b = slice(x, x + 128), slice(y, y + 128)
                if y < x or (part[a].min() == part[b].max() and part[a].max() == part[b].min()):
                    continue
                if not within and block[a].min() == block[b].max() and block[a].max() == block[b].min():
                    continue
                both = _intersections(each[a], each[b])
                close = 100 * both >= percent * (size[a][:, None] + size[b][None, :] - both)
                close &= part[a][:, None] != part[b][None, :]
                for k, m in zip(*np.nonzero(close), strict=True):
                    p, q = find(int(part[x + k])), find(int(part[y + m]))
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        out.append((int(ids[x + k]), int(ids[y + m])))
        return pa.table([pa.array([o[c] for o in out], pa.int64()) for c in (0, 1)], ["a", "b"])

    return dealt.groupBy("band", "i", "j").applyInArrow(links, "a long, b long")


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set in `a` with every one in `b`."""
    shared = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)

    def incidence(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(shared)), np.float32)
        for k, x in enumerate(sets):
            at = np.minimum(np.searchsorted(shared, x), len(shared) - 1)
            out[k, at[shared[at] == x]] = 1
        return out

    if not len(shared):
        return np.zeros((len(a), len(b)))
    return incidence(a) @ incidence(b).T


def _parted(rows: DataFrame, settled: DataFrame) -> DataFrame:
    """`rows` with the component of every class, itself if it has no link."""
    joined = rows.join(settled.withColumnRenamed("node", "rep"), "rep", "left")
    return joined.withColumn("part", F.coalesce("component", "rep")).drop("component")


def _close_in_size(a: str, b: str, percent: int) -> Column:
    """A pair can only reach the similarity if the smaller set has that share of the larger one."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def components(docs: DataFrame, key: str, text: str, words: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate components: key, n_shingles, component_id, kept for every row of `docs`.

    Two documents are linked when 100 * intersection >= percent * union of their sets of
    distinct `words`-word shingles. component_id is the smallest key reachable over links,
    kept is key = component_id. Documents without words are linked with nothing. Keys are
    integers; rows that share a key count as one document; rows with a NULL key take no
    part, their component_id is NULL and kept is true.

    1. One pass over the texts makes a sketch and a digest of every set. Equal sets are one
       class, of which the smallest key goes on, so exact copies cost one row.
    2. In each band's bucket every class is paired with one leader, drawn by hash, which is
       linear in the bucket; leaders differ by band, so groups of near copies hang together.
    3. Sketches, then full sets decide about the pairs; components follow.
    4. In buckets that still hold classes of different components, those go that can have no
       partner: too many of their shingles are in no other set of such buckets. The rest is
       compared on full sets inside tasks, block by block; only links leave them. Every
       pair that shares a bucket is so in one component already, compared, or ruled out.

    Nothing is dropped at any bucket size; no table of pairs or links reaches the driver.
    """
    rows = only(docs, id=F.col(key).cast("long"), text=F.col(text))
    sketched = stage(_sketched(rows, words))
    known = rows.where("id is not null")
    classes = stage(
        sketched.where("digest is not null and id is not null")
        .groupBy("digest")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    )
    bands = _bands(classes)
    leaders = (
        bands.groupBy("band")
        .agg(F.count("*").alias("members"), F.min_by(F.struct("rep", "n"), F.xxhash64("rep", "band")).alias("leader"))
        .where("members > 1")
        .select("band", F.col("leader.rep").alias("leader"), F.col("leader.n").alias("n_leader"))
    )
    # Only rows of buckets with company; what follows reads these alone.
    shared = stage(bands.join(leaders, "band"))
    ordered = (F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b"))
    stars = (
        shared.where("leader <> rep")
        .where(_close_in_size("n", "n_leader", percent))
        .select(*ordered)
        .distinct()
    )
    likely = stage(_likely(stars, classes, percent))
    # Whatever is compared below lies in a bucket with company.
    sets = _sets(known, shared.select(F.col("rep").alias("id")).distinct(), words)
    first = stage(_confirmed(likely, sets, percent))
    settled = stage(connected_components(first))

    mixed_left = stage(_mixed(_parted(shared.select("band", "rep", "n"), settled)))
    left = mixed_left
    mixed = sets.join(left.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    # At best a set has its common shingles in a partner of just that size, or of the smallest size in the bucket.
    common = stage(left.join(_common(mixed).withColumnRenamed("id", "rep"), "rep"))
    least = common.groupBy("band").agg(F.min("n").alias("least"))
    able = F.col("common") * 100 >= (F.col("n") + F.greatest("least", "common") - F.col("common")) * percent
    left = stage(_mixed(common.join(least, "band").where(able).drop("least")))

    second = stage(_across(left, sets, percent))
    found = stage(connected_components(first.unionByName(second)))
    # What follows reads the sketches, classes and components alone.
    release(shared, likely, sets, first, settled, mixed_left, common, left, second)

    by_class = (
        classes.select("digest", "rep")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("digest", F.coalesce("component", "rep").alias("component_id"))
    )
    out = sketched.join(by_class, "digest", "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
