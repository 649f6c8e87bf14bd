"""Accuracy and stage counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelway.functions.arrays import best_class, in_top_k
from labelway.functions.labels import is_good_grade
from labelway.functions.text import has_words

SPLITS = ("val", "test")


def share(hit: Column, where: Column | None = None) -> Column:
    """Share of rows with ``hit``; 0 for an empty set."""
    where = F.lit(True) if where is None else where
    n = F.count_if(where)
    return F.count_if(where & hit) / F.greatest(F.lit(1), n)


def with_hits(df: DataFrame, proba: str, label: str, k: int = 3) -> DataFrame:
    """Adds ``hit1`` and ``hitk`` for the true class in ``label``."""
    return df.withColumn("hit1", best_class(F.col(proba)) == F.col(label)).withColumn(
        "hitk", in_top_k(F.col(proba), F.col(label), k)
    )


def topk_accuracy(df: DataFrame, proba: str, label: str, k: int = 3, by: str | None = None) -> DataFrame:
    hits = with_hits(df, proba, label, k)
    grouped = hits.groupBy(by) if by else hits.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("n_rows"),
        share(F.col("hit1")).alias("top1_acc"),
        share(F.col("hitk")).alias(f"top{k}_acc"),
    )


def head_stats(hits: DataFrame, by: list[str], split: str = "split") -> DataFrame:
    """Four accuracies per model from rows with ``hit1``, ``hitk`` and a split."""
    columns = []
    for name in SPLITS:
        here = F.col(split).isin(name, "both")
        columns.append(share(F.col("hit1"), here).alias(f"{name}_top1_acc"))
        columns.append(share(F.col("hitk"), here).alias(f"{name}_top3_acc"))
    return hits.groupBy(*by).agg(*columns)


def stage_counts(rows: DataFrame, grade: str, text: str, max_rows: int | None = None) -> DataFrame:
    """Rows after each filter stage, in one scan."""
    good = is_good_grade(F.col(grade))
    filled = good & has_words(F.col(text))
    kept = F.col("filled") if max_rows is None else F.least(F.col("filled"), F.lit(max_rows))
    counts = rows.agg(
        F.count(F.lit(1)).alias("loaded"),
        F.count_if(good).alias("graded"),
        F.count_if(filled).alias("filled"),
    ).withColumn("sampled", kept.cast("bigint"))
    pairs = [
        F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), F.col(s).alias("n_rows"))
        for i, s in enumerate(("loaded", "graded", "filled", "sampled"))
    ]
    return counts.select(F.inline(F.array(*pairs)))
