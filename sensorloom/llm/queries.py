"""Registered queries of the corpus operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import bpe, factors, html_paths, langid, lexical, mixing, nearcopies, quality, secrets, spelling, substrings, voronoi, warc
from sensorloom.llm.common import prepare, read
from sensorloom.sources.staging import fresh_path


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    model = langid.fit(docs.where("not held_out"), "text", "lang")
    found = langid.identify(docs.drop("lang"), "text", model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


#: Target mixture: weights of domains, languages and sources among their siblings.
WEIGHTS = ({"d0": 4, "d1": 3, "d2": 2, "d3": 1}, {"en": 4, "*": 2}, {"*": 1})


def mixture_levels() -> dict:
    """Tree of the documents: domain (sources by number, modulo four), language, source."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    domain = F.when(number != "", F.concat(F.lit("d"), (F.substring(number, -9, 9).cast("long") % 4).cast("string")))
    return {"domain": domain, "language": F.col("lang"), "site": F.col("source")}


def op2_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.select("doc_id", "lang", "source", mixing.word_count(F.col("text")).alias("n_words")), "doc_id", F.col("n_words"), mixture_levels(), WEIGHTS, share=0.8, epochs=3)
    return mixed.where("n_copies > 0").select("doc_id", "domain", F.col("language").alias("lang"), F.col("site").alias("source"), "n_tokens", "n_copies")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return html_paths.extract(read(spark, sf_dir, "pages"), "page_id", "url", "html")


def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = substrings.repeated_bytes(read(spark, sf_dir, "documents"), "doc_id", "text", length=400)
    return found.select("*", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), (F.col("n_removed") > 0).alias("repeats"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    encoded = bpe.encode(read(spark, sf_dir, "documents"), "doc_id", "text", *bpe.rank_file(), with_ids=False)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def secret_owner() -> tuple:
    """Owner and repository of a document: its source, and the source's part in one language."""
    return F.col("source"), F.concat_ws("/", "source", "lang")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    owner, repository = secret_owner()
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents"), "doc_id", "text", owner, repository), "doc_id")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return nearcopies.components(read(spark, sf_dir, "documents"), "doc_id", "text", words=4, percent=80)


def op8_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return warc.round_trip(read(spark, sf_dir, "pages"), fresh_path(spark, "archive"), min_bytes=0)


def op9_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return voronoi.top_k(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=50, k=5)


def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    # Which rule rejects a row depends on the sample's order of rules; what is kept does not.
    return quality.judge(read(spark, sf_dir, "documents"), "doc_id", "text").drop("rejected_by")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return lexical.rank(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "benchmark"), "item_id", "text", k=50)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spelling.group(read(spark, sf_dir, "documents"), "doc_id", "text", least_length=6, least_count=5, every=199, factor=5)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, size = read(spark, sf_dir, "documents"), F.col("n_chars")
    model = factors.fit(docs.where(~factors.held_out(F.col("doc_id"))), "doc_id", "text", size, read(spark, sf_dir, "labels"), "doc_id", "quality")
    scored = factors.classify(docs, "doc_id", "text", size, model)
    return scored.select("doc_id", factors.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_language_id,
        op2_source_mixture,
        op3_main_text,
        op4_repeated_substrings,
        op5_byte_bpe,
        op6_secret_scan,
        op7_near_duplicates,
        op8_web_archive,
        op9_voronoi_knn,
        op10_quality_cascade,
        op11_lexical_search,
        op12_spelling_variants,
        op13_quality_classifier,
    ]
    return {f.__name__: f for f in own}
