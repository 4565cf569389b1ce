"""A corpus from raw documents: language ID, exact dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a DataFrame
that is written as Parquet and read again as the next one's docs. All but the last return the columns
of documents, and any others that docs has.

Rows are told apart by where they stand (with_row_key), not by their id: a row without an id, or with an
id that others have too, is a document of its own, and what is decided of one row drops no other. Of
copies with equal ids one stays. An empty table passes through as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm.common import drop_keys, free_name, join_hot, stage, with_row_key
from spanveil.llm.decontaminate import decontaminate
from spanveil.llm.exact_dedup import exact_dedup
from spanveil.llm.langid import UNDETERMINED, predict, train
from spanveil.llm.minhash import near_duplicates
from spanveil.llm.mixing import mix_sources

#: A document whose language is undetermined, or less probable than this, goes.
LEAST_SCORE = 0.5
#: Near duplicates share at least so many hundredths of their 5-word shingles.
NEAR_PERCENT = 80


def without(keyed: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """keyed without the rows whose key is in gone, and without the key."""
    return drop_keys(keyed, stage(gone.select(key), "pipeline-dropped"), key).drop(key)


def by_id(key: str) -> Column:
    """Orders rows by id, those without one last, then by where they stand."""
    return F.struct(F.col("doc_id").isNull().alias("lacking"), F.col("doc_id").alias("id"), F.col(key).alias("key"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language. Learns from the rows with a lang, see langid.train."""
    keyed, key = with_row_key(docs)
    found = predict(keyed, train(docs), key)
    return without(keyed, found.filter((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < LEAST_SCORE)), key)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest id stays."""
    keyed, key = with_row_key(docs)
    rank = free_name("_rank", keyed)
    found = exact_dedup(keyed.withColumn(rank, by_id(key)), rank)
    return without(keyed, found.filter("not kept").select(F.col(rank)["key"].alias(key)), key)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the one with the smallest id stays."""
    key = free_name("_row", docs)
    keyed = stage(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-rows")
    found = near_duplicates(keyed, key, percent=NEAR_PERCENT).select(key, "component_id")
    groups = found.groupBy("component_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    grouped = stage(join_hot(found, groups, "component_id", "_n", found.count(), key).select(key, "component_id"), "pipeline-grouped")
    ranked = keyed.select(key, "doc_id").join(grouped, key).select("component_id", by_id(key).alias("_rank"))
    stays = ranked.groupBy("component_id").agg(F.min("_rank").alias("_first")).select(F.col("_first.key").alias(key))
    return without(keyed, grouped.join(stays, key, "left_anti"), key)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a phrase of a benchmark item."""
    keyed, key = with_row_key(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(keyed, decontaminate(keyed, items, id_col=key).filter("contaminated"), key)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", clean),
    ("mixing", mix),
]

#: A trained model decides in the first stage, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
