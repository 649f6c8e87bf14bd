"""Class dictionaries: sorted distinct labels and their indices.

A class dictionary is as long as the model that is trained on it (one weight
row per class), so it is small by construction and ranked per model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelway.config import SINGLE_LABEL
from labelway.operators.joins import attach
from labelway.session import stage_table


def class_table(rows: DataFrame, label: str, group: str | None = None) -> DataFrame:
    """(group, label, cnt, class_idx); indices follow the code points of the labels."""
    keys = [group, label] if group else [label]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
    order = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(label)
    return counts.withColumn("class_idx", (F.row_number().over(order) - 1).cast("int"))


def encode_labels(
    rows: DataFrame,
    classes: DataFrame,
    label: str,
    out_col: str,
    id_col: str,
    group: str | None = None,
) -> DataFrame:
    """Adds the class index; null for labels that are not in the dictionary."""
    keys = [group, label] if group else [label]
    table = classes.select(*keys, "cnt", F.col("class_idx").alias(out_col))
    return attach(rows, table, keys, "cnt", [id_col])


def decode_labels(
    rows: DataFrame, classes: DataFrame, idx_col: str, label: str, id_col: str, group: str | None = None
) -> DataFrame:
    """Adds the label of a class index."""
    keys = [group, idx_col] if group else [idx_col]
    table = classes.withColumnRenamed("class_idx", idx_col).select(*keys, "cnt", label)
    return attach(rows, table, keys, "cnt", [id_col])


def label_sizes(rows: DataFrame, cat: str, label: str) -> DataFrame:
    """Rows per (category, label)."""
    return rows.groupBy(cat, label).agg(F.count(F.lit(1)).alias("cnt"))


def head_training_rows(rows: DataFrame, cat: str, label: str, id_col: str) -> DataFrame:
    """Rows whose label has at least two rows inside its category."""
    kept = stage_table(label_sizes(rows, cat, label).where("cnt >= 2"), "head-labels")
    return attach(rows, kept, [cat, label], "cnt", [id_col], how="inner")


def head_plan(sizes: DataFrame, cat: str, label: str) -> DataFrame:
    """What to train per category: ``none`` below 2 rows, ``single`` below 2
    usable labels, else ``trained``. ``only_label`` keeps a single usable label."""
    usable = F.col("cnt") >= 2
    return (
        sizes.groupBy(cat)
        .agg(
            F.sum("cnt").alias("n_rows"),
            F.count_if(usable).alias("n_labels"),
            F.coalesce(F.sum(F.when(usable, F.col("cnt"))), F.lit(0)).alias("train_rows"),
            F.max(F.when(usable, F.col(label))).alias("__one"),
        )
        .withColumn(
            "kind",
            F.when(F.col("n_rows") < 2, "none").when(F.col("n_labels") < 2, "single").otherwise("trained"),
        )
        .withColumn(
            "only_label", F.when((F.col("kind") == "single") & (F.col("n_labels") == 1), F.col("__one"))
        )
        .drop("__one")
    )


def label_codes(sizes: DataFrame) -> DataFrame:
    """One row per (category, label) with everything training needs to know:
    ``cat_idx``, ``cat_rows``, ``before`` (rows of earlier categories), the
    kind of head and ``head_idx`` (null where the label trains no head).

    Categories are numbered on a table of one row per category, labels inside
    their category. ``sizes`` should be staged: it is read twice.
    """
    usable = F.col("cnt") >= 2
    by_name = Window.orderBy("category")
    earlier = by_name.rowsBetween(Window.unboundedPreceding, -1)
    categories = (
        head_plan(sizes, "category", "label")
        .withColumn("cat_idx", (F.row_number().over(by_name) - 1).cast("int"))
        .withColumn("before", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)))
        .select("category", "kind", "cat_idx", F.col("n_rows").alias("cat_rows"), "before")
    )
    number = F.count_if(usable).over(Window.partitionBy("category").orderBy("label")) - 1
    return sizes.join(categories, "category").withColumn(
        "head_idx", F.when((F.col("kind") == "trained") & usable, number).cast("int")
    )


def head_classes(sizes: DataFrame, plan: DataFrame, cat: str, label: str) -> DataFrame:
    """Class dictionary of every head: usable labels, or one ``__single__`` class."""
    order = Window.partitionBy(cat).orderBy(label)
    trained = (
        sizes.where("cnt >= 2")
        .join(plan.where("kind = 'trained'").select(cat), cat)
        .withColumn("class_idx", (F.row_number().over(order) - 1).cast("int"))
        .select(cat, label, "cnt", "class_idx", F.lit(None).cast("string").alias("only_label"))
    )
    single = plan.where("kind = 'single'").select(
        cat,
        F.lit(SINGLE_LABEL).alias(label),
        F.col("n_rows").alias("cnt"),
        F.lit(0).alias("class_idx"),
        "only_label",
    )
    return trained.unionByName(single)
