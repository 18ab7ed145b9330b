"""Secret scan: candidates by pattern, judged by how widely each value is owned.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import only, stage


class Kind(NamedTuple):
    """A kind of candidate: what it is called, its pattern, which group is its value, least length of that value.

    A `wrapped` value may be broken into lines in several ways: it is compared without
    spaces and line breaks, and the whole match stands for one that is empty.
    """

    name: str
    pattern: str
    value: int
    least: int
    groups: int
    wrapped: bool = False


#: Base kinds (fixed patterns), in the order in which spans with one start are listed.
BASE = (
    Kind("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, 2),
    Kind("access", "AKIA[A-Z0-9]+", 0, 18, 0),
    Kind("hex", "[0-9a-f]{16,}", 0, 16, 0),
)
#: A break inside a key: white space, or one written as an escape in a string.
BREAK = "(?:\\s|\\\\[nr])"
#: What stands between the two lines around a key: all of it where the second line follows; otherwise its
#: own two header fields, its lines of base64, and a shorter last line that holds nothing else.
KEY_END = "-----END [A-Z ]*PRIVATE KEY-----"
KEY_BODY = (
    f"(?:(?!-----)(?s:.))*+(?={KEY_END})"
    f"|(?:{BREAK}*+(?:Proc-Type|DEK-Info):\\x20?[A-Z0-9,-]++)*+(?:{BREAK}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+"
    f"(?:[\\x20\\t]*+(?:[\\r\\n]|\\\\[nr])++[\\x20\\t]*+[A-Za-z0-9+/]++={{0,2}}+(?=[\\x20\\t]*+(?:[\\r\\n\"']|\\\\[nr]|\\z)))?+"
)
#: Further kinds: vendor tokens, signed web tokens, private keys, credentials in addresses.
ADDED = (
    Kind("vendor", "(?:gh[pousr]_|sk_live_|xox[abprs]-)[A-Za-z0-9-]+", 0, 20, 0),
    Kind("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 30, 0),
    Kind("keyblock", f"-----BEGIN [A-Z ]*PRIVATE KEY-----({KEY_BODY})(?:{KEY_END})?+", 1, 1, 1, wrapped=True),
    Kind("address", "[a-z][a-z0-9+.-]{1,20}://[^\\x20\\x09-\\x0D/:@]*+:([^\\x20\\x09-\\x0D/@]++)@", 1, 6, 1),
)


def spans_of(text: Column, kind: Kind) -> Column:
    """Array of (start, end, kind, value) of the kind's leftmost non-overlapping matches, in code points.

    Each match is taken with the text since the last one, so its place is a sum of
    lengths. The anchor keeps the search from starting anew behind the last match, which
    would be quadratic in a long text.
    """
    anchored = rf"\G(?s:(.*?))({kind.pattern})"
    gaps = F.regexp_extract_all(text, F.lit(anchored), F.lit(1))
    whole = F.regexp_extract_all(text, F.lit(anchored), F.lit(2))
    values = F.regexp_extract_all(text, F.lit(anchored), F.lit(2 + kind.value)) if kind.value else whole
    found = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>").alias("spans"))

    def step(state: Column, match: Column) -> Column:
        begin = state["at"] + F.length(match["gap"])
        end = begin + F.length(match["whole"])
        value = match["value"]
        if kind.wrapped:
            value = F.coalesce(F.nullif(F.regexp_replace(value, BREAK, ""), F.lit("")), match["whole"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind.name).alias("kind"), value.alias("value"))
        kept = F.when(F.length(value) >= kind.least, F.array(span)).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>"))
        return F.struct(end.alias("at"), F.concat(state["spans"], kept).alias("spans"))

    return F.aggregate(found, start, step, lambda state: state["spans"])


SPAN = "array<struct<start:int,end:int,kind:string,value:string>>"


def candidates(docs: DataFrame, key: str, text: str, owner: Column, repository: Column, kinds: Sequence[Kind] = BASE + ADDED, carry: bool = False) -> DataFrame:
    """One row per row of `docs`: key, row, owner, repository, spans (by start, then kind as listed).

    With `carry` the columns of `docs` come along in a struct `doc`. NULL text counts as
    empty and has no spans; NULL owners and repositories stand for themselves, as one
    unknown owner each. A text without a match of a kind is read once for it.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    empty = F.array().cast(SPAN)
    found = [F.when(body.rlike(k.pattern), spans_of(body, k)).otherwise(empty) for k in kinds]
    rows = docs.select(
        F.col(key).alias("key"),
        F.col(text).alias("text"),
        owner.cast("string").alias("owner"),
        repository.cast("string").alias("repository"),
        *([F.struct(*docs.columns).alias("doc")] if carry else []),
    )
    names = F.array(*(F.lit(k.name) for k in kinds))
    ranked = F.array_sort(
        F.transform(F.concat(*found), lambda s: F.struct(s["start"].alias("start"), F.array_position(names, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    )
    spans = F.transform(ranked, lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"]).cast("struct<start:int,end:int,kind:string,value:string>"))
    return rows.select("key", F.monotonically_increasing_id().alias("row"), "owner", "repository", spans.alias("spans"), *(["doc"] if carry else []))


def ownership(found: DataFrame) -> DataFrame:
    """How widely each candidate value is held: hash, n_owners, n_repositories, n_found.

    Counted in two steps, so that a value found everywhere never meets in one task: first
    one row per value, owner and repository (partial sums before the shuffle), then per value.
    """
    each = found.select("owner", "repository", F.explode(F.array_distinct(F.transform("spans", lambda s: F.sha2(s["value"], 256)))).alias("hash"))
    pairs = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(
        F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_found")
    )


def hashes(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: F.sha2(s["value"].cast("binary"), 256)))


def widely_copied(owners: int, repositories: int) -> Column:
    """Whether a value is an example that is handed around.

    Many owners hold it, or more than one do and many repositories. However many
    repositories of one owner share a value, it may well be that owner's own.
    """
    return (F.col("n_owners") >= owners) | ((F.col("n_owners") > 1) & (F.col("n_repositories") >= repositories))


def judged(found: DataFrame, copied: Column) -> DataFrame:
    """`found` with a field `live` in every span: its value is not `copied`, a condition on the columns of `ownership`.

    Only rows with spans are joined; the counts come to them by value, and a value held
    by any number of rows is one row on its side, so adaptive execution can split it.
    """
    some, none = found.where(F.size("spans") > 0), found.where(F.size("spans") == 0)
    live = (
        some.select("row", F.explode(hashes(F.col("spans"))).alias("hash"))
        .join(ownership(found).where(~copied).select("hash"), "hash")
        .groupBy("row")
        .agg(F.collect_list("hash").alias("live"))
    )
    kind = "array<struct<start:int,end:int,kind:string,value:string,live:boolean>>"
    is_live = lambda s: F.array_contains(F.coalesce("live", F.array().cast("array<string>")), F.sha2(s["value"].cast("binary"), 256))
    marked = F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"], is_live(s))).cast(kind)
    return (
        some.join(live, "row", "left")
        .withColumn("spans", marked)
        .drop("live")
        .unionByName(none.withColumn("spans", F.array().cast(kind)))
    )


def scan(docs: DataFrame, key: str, text: str, owner: Column, repository: Column, copied_from: int = 3, copied_in: int = 6) -> DataFrame:
    """Secrets of every row, with a verdict on each: key, row, owner, repository, spans.

    spans is array<struct<start, end, kind, value, live>>. A value held by at least
    `copied_from` owners, or by several in at least `copied_in` repositories, is a widely
    copied example (live false); any other is an owner's own, live-looking credential. An
    owner's repositories are told apart by owner and repository. Repeated rows keep one row each and an empty table
    gives none. The candidates are written once to the shared folder, so the texts are
    searched once.
    """
    found = stage(candidates(docs, key, text, owner, repository))
    return judged(found, widely_copied(copied_from, copied_in)).withColumnRenamed("key", key)


def digest(scanned: DataFrame, key: str) -> DataFrame:
    """Counts of the base kinds, digest of the base spans, all spans as text, and the verdicts' counts."""
    names = [k.name for k in BASE]
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(names))
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return scanned.select(
        key,
        *(count(name) for name in names),
        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


def redact(docs: DataFrame, key: str, text: str, owner: Column, repository: Column, copied_from: int = 3, copied_in: int = 6) -> DataFrame:
    """`docs` with every live span of `text` replaced by its kind in angle brackets.

    Where spans overlap, the first covers its stretch and the next only what is left.
    Copied examples, other columns and texts without spans stay as they are; every row
    stays. The rows are written once with their candidates; only those with spans move.
    """
    found = stage(candidates(docs, key, text, owner, repository, carry=True))
    body = F.coalesce(F.col("doc")[text], F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(body, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        shown = F.concat(state["out"], gap, F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), F.when(s["end"] > state["at"], shown).otherwise(state["out"]).alias("out"))

    live = F.filter("spans", lambda s: s["live"])
    rest = lambda state: F.concat(state["out"], F.substring(body, state["at"] + 1, F.length(body)))
    clean = F.when(F.size(live) > 0, F.aggregate(live, start, step, rest)).otherwise(F.col("doc")[text])
    return judged(found, widely_copied(copied_from, copied_in)).withColumn("clean", clean).select(
        *(F.col("clean").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns)
    )
