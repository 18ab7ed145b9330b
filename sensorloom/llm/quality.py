"""Quality rules as a short-circuit cascade, ordered by measured rejection per cost.

DataFrame functions only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import SPACE, stage

#: Characters counted as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; NULL and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, however often the body names it.

    Inside a lambda an outer expression is evaluated for every element; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of `window` words that are found twice or more in the text.

    Windows are compared by a 64-bit hash. Where all hashes differ, as in most texts, the
    answer is 0 at once. Otherwise sorting brings equal windows together; a repeated
    window covers its words up to where the next repeated one begins.
    """
    none = F.lit(0).cast("long")
    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    keys = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))

    def places(pairs: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))
        marked = F.transform(pairs, lambda p, i: F.when(same(i, i - 1) | same(i, i + 1), p["i"]))
        return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

    def covered(keys: Column) -> Column:
        pairs = F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        counted = F.aggregate(
            bound(pairs, places),
            F.struct(F.lit(-window).alias("last"), none.alias("n")),
            lambda state, i: F.struct(i.alias("last"), (state["n"] + F.least(i - state["last"], F.lit(window))).alias("n")),
            lambda state: state["n"],
        )
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), none).otherwise(counted)

    return F.when(F.size(words) < window + 1, none).otherwise(bound(keys, covered))


def measure(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with the measures of every whole text in a struct `q`.

    n_words, word_chars, n_symbols, n_lines and n_dup_lines (lines that hold a word; those
    equal to an earlier one), n_repeat_words. NULL and empty texts measure 0 throughout.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: F.length(F.translate(line, SPACE, "")) > 0)
    n = lambda c, name: c.cast("long").alias(name)
    by_words = bound(words_of(body), lambda w: F.struct(n(F.size(w), "n"), repeated_words(w).alias("repeated")))
    by_lines = bound(lines, lambda x: F.struct(n(F.size(x), "n"), n(F.size(x) - F.size(F.array_distinct(x)), "repeated")))
    measured = bound(
        F.struct(by_words.alias("words"), by_lines.alias("lines")),
        lambda m: F.struct(
            m["words"]["n"].alias("n_words"),
            n(F.length(F.translate(body, SPACE, "")), "word_chars"),
            n(F.length(body) - F.length(F.translate(body, SYMBOLS, "")), "n_symbols"),
            m["lines"]["n"].alias("n_lines"),
            m["lines"]["repeated"].alias("n_dup_lines"),
            m["words"]["repeated"].alias("n_repeat_words"),
        ),
    )
    return docs.withColumn("q", measured)


class Rule(NamedTuple):
    """What fails a text: an expression over the measures `q`, or over the text itself, then evaluated only where it is asked."""

    name: str
    fails: Column


def rules(text: str = "text") -> list[Rule]:
    """The base rules and those that the cascade adds.

    Added rules reject only what is far outside prose of any language: over half of all
    non-blank characters symbols, words of over 40 characters on average, four fifths of all
    lines repeated, four fifths of all letters A-Z, more than one `!` or `?` a word, or
    every other word equal to the one before it. The last three read the text anew.
    """
    q = lambda name: F.col(f"q.{name}")
    body = F.coalesce(F.col(text), F.lit(""))
    found = lambda characters: F.length(body) - F.length(F.translate(body, characters, ""))
    upper = "".join(map(chr, range(65, 91)))
    echoes = bound(words_of(body), lambda w: F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: x == y), lambda same: same)))
    return [
        Rule("few_words", q("n_words") < 20),
        Rule("repeated_words", 100 * q("n_repeat_words") > 30 * q("n_words")),
        Rule("symbols", 2 * q("n_symbols") > q("word_chars")),
        Rule("long_words", q("word_chars") > 40 * q("n_words")),
        Rule("repeated_lines", 5 * q("n_dup_lines") > 4 * q("n_lines")),
        Rule("capitals", bound(found(upper), lambda n: (n > 0) & (5 * n > 4 * (n + found(upper.lower()))))),
        Rule("marks", found("!?") > q("n_words")),
        Rule("echoes", 2 * echoes > q("n_words")),
    ]


BASE_RULES = ("few_words", "repeated_words")


def order_rules(docs: DataFrame, key: str, text: str, given: Sequence[Rule], sample_rows: int = 2000) -> list[Rule]:
    """The rules by falling rejection per cost, both measured on about `sample_rows` rows chosen by a hash of their key.

    The sample is measured and written once; a rule's cost is the time of one pass over it
    that evaluates the rule alone, less that of a pass that evaluates none. Times differ
    from run to run, so the order may; which rows are kept does not depend on it. One number
    per rule comes to the driver. An empty sample keeps the given order; ties keep it too.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    sample = stage(measure(docs.where(drawn).select(text), text))

    def timed(failing: Column) -> tuple[float, int]:
        begun = time.perf_counter()
        rejected = sample.agg(F.sum(F.coalesce(failing, F.lit(False)).cast("long"))).first()[0]
        return time.perf_counter() - begun, rejected or 0

    timed(F.lit(False))
    idle, _ = timed(F.lit(False))
    told = {r.name: timed(r.fails) for r in given}
    worth = {name: rejected / max(seconds - idle, 0.001) for name, (seconds, rejected) in told.items()}
    return sorted(given, key=lambda r: -worth[r.name])


def cascade(measured: DataFrame, ordered: Sequence[Rule]) -> DataFrame:
    """`measured` with rejected_by: the first rule in the given order that fails, NULL for kept rows.

    A conditional expression stops at its first true branch, so later rules, and the
    measures that only they need, are not evaluated for rejected rows; the order never
    changes which rows are kept.
    """
    verdict = F.lit(None).cast("string")
    for rule in reversed(ordered):
        verdict = F.when(F.coalesce(rule.fails, F.lit(False)), F.lit(rule.name)).otherwise(verdict)
    return measured.withColumn("rejected_by", verdict)


def judge(docs: DataFrame, key: str, text: str, sample_rows: int = 2000) -> DataFrame:
    """key, the measures, base_failed, kept and rejected_by for every row of `docs`.

    Every whole text is measured; NULL and empty texts have no words and fail. Rows are
    never merged or dropped; NULL keys stay.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    ordered = order_rules(rows, "key", "text", rules(), sample_rows)
    by_name = {r.name: r for r in ordered}
    failed = by_name[BASE_RULES[0]].fails | by_name[BASE_RULES[1]].fails
    return cascade(measure(rows, "text"), ordered).select(
        F.col("key").alias(key),
        *(F.col(f"q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed.alias("base_failed"),
        F.col("rejected_by").isNull().alias("kept"),
        "rejected_by",
    )
