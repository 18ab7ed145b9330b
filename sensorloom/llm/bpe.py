"""Byte-level BPE: encoding with offsets, decoding by the reversed byte table."""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import only

#: Characters of the pieces whose ids a worker remembers; beyond that it starts afresh.
REMEMBERED = 4_000_000


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves; the other bytes, in order, for the
    characters from U+0100 on.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in visible)
    moved = {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return {b: moved.get(b, chr(b)) for b in range(256)}


class Pieces(dict):
    """Ids of the pieces met, and the ids as decimal text; a new piece is encoded when it is asked for."""

    def __init__(self, merge: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.merge = merge
        self.held = 0

    def __missing__(self, piece: str) -> tuple[tuple[int, ...], str]:
        ids = self.merge(piece)
        found = ids, " ".join(map(str, ids))
        if len(piece) <= REMEMBERED:
            if self.held + len(piece) > REMEMBERED:
                self.clear()
                self.held = 0
            self.held += len(piece)
            self[piece] = found
        return found


class Codec:
    """Encoder and decoder for one rank file and one split pattern.

    The vocabulary is the rank file's; a token's merge is the split of its bytes into two
    tokens that lower-ranked merges reach.
    """

    def __init__(self, ranks_path: str, pattern: str):
        from tokenizers import Tokenizer, models

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.letters = byte_characters()
        spelled = {token: "".join(map(self.letters.__getitem__, token)) for token in ranks}
        merges = [
            tuple(spelled[part] for part in _last_merge(token, ranks))
            for token in sorted(ranks, key=ranks.__getitem__)
            if len(token) > 1
        ]
        self.tokenizer = Tokenizer(models.BPE({spelled[t]: r for t, r in ranks.items()}, merges))
        # Decoding starts from the tokens' characters; each token's are turned back into bytes once.
        back = {ord(c): b for b, c in self.letters.items()}
        self.bytes_of = {i: token.translate(back).encode("latin-1") for token, i in self.tokenizer.get_vocab().items()}
        self.split = regex.compile(pattern).findall
        self.table = str.maketrans({chr(b): c for b, c in self.letters.items()})
        self.known = Pieces(self.merge)

    def merge(self, piece: str) -> tuple[int, ...]:
        """The library's ids of one piece. Each of its bytes becomes one character, so the library merges bytes."""
        mapped = piece.encode("utf-8", "replace").decode("latin-1").translate(self.table)
        return tuple([token.id for token in self.tokenizer.model.tokenize(mapped)])

    def encode(self, text: str) -> tuple[list[int], str]:
        """The text's ids, and the ids in decimal, joined by one blank."""
        found = list(map(self.known.__getitem__, self.split(text)))
        return list(itertools.chain.from_iterable([ids for ids, _ in found])), " ".join([decimal for _, decimal in found])

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """Characters [start, end) of the text that each token touches; a split character counts for all its tokens."""
        owner = [i for i, c in enumerate(text) for _ in range(len(c.encode("utf-8", "replace")))]
        spans, at = [], 0
        for i in ids:
            end = at + len(self.bytes_of[i])
            spans.append((owner[at], owner[end - 1] + 1))
            at = end
        return spans

    def decode(self, ids: list[int]) -> bytes:
        """The tokens' characters through the reversed byte table; a character split between tokens is whole again once they are joined."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The two parts that are left when only merges of lower rank have been done."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        pairs = [(ranks.get(a + b), i) for i, (a, b) in enumerate(itertools.pairwise(parts))]
        _, i = min((r, i) for r, i in pairs if r is not None and r < ranks[token])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@cache
def codec(ranks_path: str, pattern: str) -> Codec:
    """One per worker."""
    return Codec(ranks_path, pattern)


def _slices(texts: list[str | None], size: int) -> Iterator[list[str]]:
    """Runs of texts of about `size` characters; a longer text stands alone."""
    held, n = [], 0
    for text in texts:
        if held and n + len(text or "") > size:
            yield held
            held, n = [], 0
        held.append(text or "")
        n += len(text or "")
    if held:
        yield held


def encode(docs: DataFrame, key: str, text: str, ranks_path: str, pattern: str, with_ids: bool = True, with_offsets: bool = False) -> DataFrame:
    """Token ids of every text.

    Returns `key`, ids array<int> (unless they are not wanted), n_tokens, ids_sha256 (of the decimal ids joined by one
    blank), decoded_sha256 (of the bytes that the ids decode to) and, if asked for,
    offsets array<struct<start, end>> in code points. A NULL text counts as empty: no
    ids, digests of nothing. Repeated rows each keep their row; NULL keys stay. Each
    match of `pattern` is encoded by itself, without special tokens, so a text of any
    length needs memory in proportion to its own length only.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"key {kind}, {'ids array<int>, ' if with_ids else ''}n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", offsets array<struct<start: int, end: int>>" if with_offsets else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            keys, at = batch.column(0), 0
            for texts in _slices(batch.column(1).to_pylist(), 1_000_000):
                rows: dict[str, list] = {k: [] for k in ("ids", "n", "digest", "decoded", "offsets")}
                for t in texts:
                    ids, decimal = own.encode(t)
                    if with_ids:
                        rows["ids"].append(pa.array(ids, pa.int32()))
                    rows["n"].append(len(ids))
                    rows["digest"].append(hashlib.sha256(decimal.encode()).hexdigest())
                    rows["decoded"].append(hashlib.sha256(own.decode(ids)).hexdigest())
                    if with_offsets:
                        rows["offsets"].append([{"start": a, "end": b} for a, b in own.offsets(t, ids)])
                out = [keys.slice(at, len(texts)), pa.array(rows["n"], pa.int64()), pa.array(rows["digest"]), pa.array(rows["decoded"])]
                names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = list(itertools.accumulate(rows["n"], initial=0))
                    out.insert(1, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(rows["ids"])))
                    names.insert(1, "ids")
                if with_offsets:
                    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                    out, names = [*out, pa.array(rows["offsets"], pair)], [*names, "offsets"]
                yield pa.RecordBatch.from_arrays(out, names)
                at += len(texts)

    return only(docs, key=key, text=text).mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(encoded: DataFrame, key: str, ids: str, ranks_path: str, pattern: str) -> DataFrame:
    """The text of every array of ids: `key`, text. NULL ids give NULL; broken UTF-8 becomes U+FFFD."""
    kind = dict(encoded.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            texts = [None if x is None else own.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return only(encoded, key=key, ids=F.col(ids)).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def rank_file(path: str | None = None) -> tuple[str, str]:
    """Rank file and split pattern of the installed public vocabulary, or of `path`."""
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
