"""Training corpus from raw documents: five stages, each one corpus operator.

Every function in STAGES takes (spark, docs, sf_dir) and returns a table; it is written
as Parquet and read again as the `docs` of the next. All but the last return the columns
of `documents`, whatever further columns these have and however they are called.

What a stage staged for itself is deleted when the next stage function is called, so a
stage's result must have been written by then. An empty table gives an empty table in
every stage; repeated rows go through all stages but near_duplicates, which keeps one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import bpe, langid, mixing, nearcopies, secrets
from sensorloom.llm.common import prepare, read, stage
from sensorloom.llm.queries import WEIGHTS, mixture_levels, secret_owner
from sensorloom.sources.staging import delete, recorded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left_behind: list[str] = []


def own_files(function: Stage) -> Stage:
    """Delete what the stage before staged for itself, and note what this one does."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        while _left_behind:
            delete(spark, _left_behind.pop())
        with recorded() as paths:
            out = function(spark, docs, sf_dir)
        _left_behind.extend(paths)
        return out

    return run_stage


@own_files
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter (NULL and empty ones too) or between two languages.

    The classifier learns from labelled documents outside the held-out quarter. Where no
    document has a label there is no classifier, and only those without a letter go.
    """
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))), "text", "lang")
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # Columns that are called like the operator's own stay as they are.
    aside = {c: f"own {c}" for c in docs.columns if c in ("lang_pred", "score", "ambiguous")}
    found = langid.identify(docs.withColumnsRenamed(aside), "text", model)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous"))
    return kept.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


@own_files
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Five-word shingles, similarity 0.8. A document is its id and text: equal rows of both are
    one, different texts under one id are compared like any others. Rows without an id all
    stay; so do documents without words, each once.
    """
    key = F.xxhash64("doc_id", "text")
    named = docs.where("doc_id is not null").withColumns({"document key": key})
    found = nearcopies.components(named, "document key", "text", words=5, percent=80)
    ids = named.select("document key", "doc_id").distinct()
    groups = found.select("document key", "component_id").distinct().join(ids, "document key")
    first = F.min(F.struct("doc_id", F.col("document key").alias("key"))).alias("first")
    kept = stage(groups.groupBy("component_id").agg(first).select(F.col("first.key").alias("document key")))
    # The ids grow with the corpus: never broadcast, the same join at every size.
    out = named.join(kept.hint("merge"), "document key", "left_semi")
    if found.groupBy("document key").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["document key"])
    return out.select(*docs.columns).unionByName(docs.where("doc_id is null"))


@own_files
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are replaced by their kind; examples copied by many owners and all rows stay."""
    owner, repository = secret_owner()
    clean = secrets.redact(docs, "doc_id", "text", owner, repository)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@own_files
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of all tokens, by the target weights, each document at most once."""
    return mixing.chosen(docs, "doc_id", mixing.word_count(F.col("text")), mixture_levels(), WEIGHTS, share=0.9, epochs=1)


@own_files
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their count and digests."""
    return bpe.encode(docs, "doc_id", "text", *bpe.rank_file())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Sketches and learned classifiers are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written to the shared folder first."""
    docs = read(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
