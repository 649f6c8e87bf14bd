"""Curation of the label tree.

The rows are aggregated once to cells (category, issue, subissue, count). All
decisions are made on cells, which are as many as there are labels, and reach
the rows through one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelway.config import OTHERS, HierConfig
from labelway.functions.labels import or_nan, with_issue
from labelway.operators.joins import attach
from labelway.session import stage_table


def count_cells(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))


def label_counts(rows: DataFrame, cat: str, issue: str, sub: str) -> DataFrame:
    """Rows per (category, issue, label); rows without category or issue are not counted."""
    known = rows.where(F.col(cat).isNotNull() & F.col(issue).isNotNull())
    return count_cells(known, cat, issue, sub)


def ambiguous_labels(rows: DataFrame, issue: str, sub: str) -> DataFrame:
    """Names that occur under more than one issue, over the whole table."""
    return (
        rows.where(F.col(sub).isNotNull())
        .groupBy(sub)
        .agg(F.count_distinct(F.col(issue)).alias("n_issues"))
        .where("n_issues > 1")
    )


def _unique_names(cells: DataFrame, cfg: HierConfig) -> DataFrame:
    """Adds ``subissue_unique`` and ``suffixed`` to cells.

    A name is ambiguous if its least and greatest issue differ, which tasks find out
    before the shuffle. The cells look the answer up, those of a name with very many in salts.
    """
    issue, name = F.col(cfg.issue_col), F.col(cfg.sub_col)
    names = (
        cells.where(name.isNotNull())
        .groupBy(name.alias("__name"))
        .agg(F.min(issue).alias("lo"), F.max(issue).alias("hi"), F.count(F.lit(1)).alias("__cells"))
        .where("lo <> hi")
        .select("__name", "__cells", F.lit(True).alias("__amb"))
    )
    shown = or_nan(name)
    suffixed = F.coalesce(F.col("__amb"), F.lit(False))
    named = attach(
        cells.withColumn("__name", shown), stage_table(names, "ambiguous-names"), ["__name"], "__cells", [cfg.issue_col]
    )
    return (
        named.withColumn("suffixed", suffixed)
        .withColumn("subissue_unique", F.when(suffixed, with_issue(name, issue)).otherwise(shown))
        .drop("__name", "__amb")
    )


def disambiguate_labels(rows: DataFrame, cfg: HierConfig) -> DataFrame:
    """Adds ``subissue_unique``: ``sub ⟨issue⟩`` for ambiguous names."""
    cells = stage_table(count_cells(rows, cfg.issue_col, cfg.sub_col), "name-cells")
    table = stage_table(
        _unique_names(cells, cfg).select(cfg.issue_col, cfg.sub_col, "cnt", "subissue_unique"),
        "unique-names",
    )
    salt = [c for c in rows.columns if c not in (cfg.issue_col, cfg.sub_col)] or [cfg.sub_col]
    return attach(rows, table, [cfg.issue_col, cfg.sub_col], "cnt", salt)


def top_keep_labels(counts: DataFrame, cat: str, issue: str, sub: str, k: int) -> DataFrame:
    """The k most frequent names of each (category, issue), ties by name.

    The rank filter sits on the window, so each task passes on at most k cells
    per pair and a huge pair never meets in one task.
    """
    order = Window.partitionBy(cat, issue).orderBy(F.desc("cnt"), F.asc(sub))
    return (
        counts.where(F.col(cat).isNotNull() & F.col(issue).isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def _flag_rare(counts: DataFrame, cfg: HierConfig, sub: str) -> DataFrame:
    """Adds ``__kept`` and ``__known`` to counted cells."""
    keys = [cfg.cat_col, cfg.issue_col, sub]
    kept = top_keep_labels(counts, *keys, cfg.top_keep).select(*keys, F.lit(True).alias("__kept"))
    known = F.col(cfg.cat_col).isNotNull() & F.col(cfg.issue_col).isNotNull()
    return (
        counts.join(kept, keys, "left")
        .withColumn("__kept", F.coalesce(F.col("__kept"), F.lit(False)))
        .withColumn("__known", known)
    )


def _is_rare(threshold: Column | int) -> Column:
    return F.col("__known") & ~F.col("__kept") & (F.col("cnt") < threshold)


def _rare_totals(flagged: DataFrame, cfg: HierConfig) -> DataFrame:
    """One row: rows in all, rows below each threshold, and the choice made."""
    rare = lambda k: F.coalesce(F.sum(F.when(_is_rare(k), F.col("cnt"))), F.lit(0))
    first_share = F.col("rare_first") / F.greatest(F.lit(1), F.col("total"))
    relaxed = (first_share > cfg.max_share) & F.lit(cfg.min_count > cfg.min_floor)
    rows = F.when(F.col("relaxed"), F.col("rare_floor")).otherwise(F.col("rare_first"))
    return (
        flagged.agg(
            F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"),
            rare(cfg.min_count).alias("rare_first"),
            rare(cfg.min_floor).alias("rare_floor"),
        )
        .withColumn("relaxed", relaxed)
        .withColumn("others_rows", rows)
        .withColumn("others_share", F.col("others_rows") / F.greatest(F.lit(1), F.col("total")))
        .withColumn(
            "threshold", F.when(F.col("relaxed"), cfg.min_floor).otherwise(cfg.min_count)
        )
    )


def decide_others(counts: DataFrame, cfg: HierConfig, sub: str) -> DataFrame:
    """Adds ``final_label``: the name, or ``others`` where it is too rare.

    The share of rare rows is over the whole table; above ``max_share`` the
    threshold falls to ``min_floor``. The choice is a scalar subquery, so it
    stays inside the plan.
    """
    flagged = _flag_rare(counts, cfg, sub)
    threshold = _rare_totals(flagged, cfg).select("threshold").scalar()
    return flagged.withColumn(
        "final_label", F.when(_is_rare(threshold), F.lit(OTHERS)).otherwise(F.col(sub))
    ).drop("__kept", "__known")


def group_lowfreq(rows: DataFrame, cfg: HierConfig, sub: str = "subissue_unique") -> DataFrame:
    """Rewrites rare names of ``sub`` to ``others``."""
    keys = [cfg.cat_col, cfg.issue_col, sub]
    counts = stage_table(count_cells(rows, *keys), "label-cells")
    table = stage_table(decide_others(counts, cfg, sub), "label-decisions")
    salt = [c for c in rows.columns if c not in keys] or [sub]
    joined = attach(rows, table, keys, "cnt", salt)
    return joined.withColumn(sub, F.col("final_label")).drop("final_label")


def relabel_table(cells: DataFrame, cfg: HierConfig) -> DataFrame:
    """(category, issue, subissue) → names after both curation steps.

    ``cells`` must be staged: it is read several times.
    """
    keys = [cfg.cat_col, cfg.issue_col, "subissue_unique"]
    named = _unique_names(cells, cfg)
    counts = named.groupBy(*keys).agg(F.sum("cnt").alias("cnt"))
    decided = decide_others(counts, cfg, "subissue_unique").select(
        *[F.col(k).alias(f"__{k}") for k in keys], "final_label"
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return named.join(decided, cond, "left").drop(*[f"__{k}" for k in keys])


def curate(rows: DataFrame, cfg: HierConfig) -> DataFrame:
    """Both curation steps in one aggregation and one join."""
    keys = [cfg.cat_col, cfg.issue_col, cfg.sub_col]
    cells = stage_table(count_cells(rows, *keys), "cells")
    table = relabel_table(cells, cfg).select(
        *keys, "cnt", F.col("final_label").alias("subissue_unique")
    )
    salt = [c for c in rows.columns if c not in keys] or keys[-1:]
    return attach(rows, stage_table(table, "relabel"), keys, "cnt", salt)


def curation_report(rows: DataFrame, cfg: HierConfig) -> DataFrame:
    """One row with the counters of both curation steps."""
    keys = [cfg.cat_col, cfg.issue_col, cfg.sub_col]
    cells = stage_table(count_cells(rows, *keys), "cells")
    named = _unique_names(cells, cfg)
    counts = named.groupBy(cfg.cat_col, cfg.issue_col, "subissue_unique").agg(
        F.sum("cnt").alias("cnt")
    )
    rare = _rare_totals(_flag_rare(counts, cfg, "subissue_unique"), cfg)
    note = F.when(
        F.col("relaxed"),
        F.format_string(
            f"auto-relaxed threshold {cfg.min_count}->{cfg.min_floor}, share=%.4f",
            F.col("others_share"),
        ),
    ).otherwise(F.lit(""))
    return (
        rare.withColumn(
            "duplicates_detected",
            ambiguous_labels(cells, cfg.issue_col, cfg.sub_col).agg(F.count(F.lit(1))).scalar(),
        )
        .withColumn(
            "rows_appended_suffix",
            named.agg(
                F.coalesce(F.sum(F.when(F.col("suffixed"), F.col("cnt"))), F.lit(0))
            ).scalar(),
        )
        .select(
            "duplicates_detected",
            "rows_appended_suffix",
            F.lit(cfg.min_count).alias("min_count"),
            F.lit(cfg.top_keep).alias("top_keep_per_issue"),
            F.col("others_rows").alias("final_others_rows"),
            F.round("others_share", 6).alias("final_others_share"),
            note.alias("note"),
        )
    )
