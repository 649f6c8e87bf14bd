"""A training corpus in four stages: quality, toxicity, near duplicates, packing.

Each stage reads what the one before has kept, as a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelway.llm import neardup, packing, quality, toxicity
from labelway.llm.common import table
from labelway.session import ship_package, stage_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs`` that pass the base rules and the likelihood ratio of ``docs``."""
    ship_package(spark)
    cfg = quality.QualityConfig()
    weights = quality.ngram_weights(docs, table(spark, sf_dir, "labels"), cfg)
    return quality.score(docs, weights, cfg).filter("quality.kept").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs`` that the tagger, trained on labelled rows of ``docs``, finds clean."""
    ship_package(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates of ``docs``."""
    ship_package(spark)
    return neardup.deduplicate(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows of ``docs`` in training sequences."""
    ship_package(spark)
    return packing.pack_documents(docs, keep_ids=False).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Hashes, a trained tagger and a tokenizer are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
