"""Seeded choices of exact size: samples and stratified splits.

Rows are ordered by ``md5(seed|row_id)``. The first n of a group are found as
a threshold: a histogram over hash prefixes shows in which bucket the n-th row
lies, only the rows of that bucket are ranked, and the choice itself is a
comparison with the threshold. No group is ever sorted or gathered as a whole.
``row_id`` must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelway.operators.joins import attach
from labelway.session import stage_table

# Aim for the rows of one bucket; prefixes grow with the size of the group.
BUCKET_ROWS = 1 << 16
# Hash digits counted at a time.
LEVEL_DIGITS = 3


def rank_hash(id_col: str, seed: int | str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")).cast("binary"))


def at_or_below(id_col: str, seed: int | str, cut_hash: Column, cut_id: Column) -> Column:
    """Whether the row is among those a cut selects; false without a cut."""
    h = rank_hash(id_col, seed)
    return F.coalesce((h < cut_hash) | ((h == cut_hash) & (F.col(id_col) <= cut_id)), F.lit(False))


def hash_cuts(
    rows: DataFrame,
    id_col: str,
    quotas: DataFrame,
    groups: list[str],
    seed: int | str,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(groups, cut_hash, cut_id): the ``quota``-th row of each group in hash order.

    ``quotas`` has the group columns (not null), the group's rows ``cnt`` and
    ``quota``; groups with quota 0 or with fewer rows than that have no cut.

    The cut is found digit by digit: a level counts the rows by their next ``LEVEL_DIGITS``
    digits, at most 16 ** LEVEL_DIGITS counts a group, and goes on inside the one prefix in which
    the quota lies, until that has about ``bucket_rows`` rows to be ranked.
    """
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("cnt") / bucket_rows))).cast("int")
    state = quotas.where("quota > 0").select(
        *groups, "cnt", F.col("cnt").alias("__rows"), F.col("quota").alias("__need"),
        F.lit("").alias("__prefix"), digits.alias("__digits"),
    )
    deepest = state.agg(F.max("__digits")).first()[0] or 0
    keyed = rows.select(*groups, rank_hash(id_col, seed).alias("__h"), F.col(id_col).alias("__id"))

    def inside(state: DataFrame) -> DataFrame:
        found = attach(keyed, state, groups, "cnt", ["__id"], how="inner")
        return found.where(F.startswith("__h", "__prefix"))

    for level in range(max(1, -(-deepest // LEVEL_DIGITS))):
        taken = F.least(F.col("__digits"), F.lit(LEVEL_DIGITS * (level + 1)))
        histogram = (
            inside(state)
            .groupBy(*groups, F.substr("__h", F.lit(1), taken).alias("__p"), "__need", "__rows", "__digits")
            .agg(F.count(F.lit(1)).alias("__n"))
        )
        running = Window.partitionBy(*groups).orderBy("__p")
        upto = histogram.withColumn("__upto", F.sum("__n").over(running))
        before = F.col("__upto") - F.col("__n")
        crossing = upto.where((F.col("__upto") >= F.col("__need")) & (before < F.col("__need")))
        state = stage_table(
            crossing.select(
                *groups, F.col("__rows").alias("cnt"), "__rows", (F.col("__need") - before).alias("__need"),
                F.col("__p").alias("__prefix"), "__digits",
            ),
            "crossing",
        )
    ranked = Window.partitionBy(*groups).orderBy("__h", "__id")
    return (
        inside(state)
        .withColumn("__rank", F.row_number().over(ranked))
        .where(F.col("__rank") == F.col("__need"))
        .select(*groups, F.col("__h").alias("cut_hash"), F.col("__id").alias("cut_id"))
    )


def sample_rows(
    rows: DataFrame, id_col: str, n: int, seed: int, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Exactly n rows if there are more, else all rows."""
    keyed = rows.select(F.col(id_col), F.lit(0).alias("__all"))
    quotas = keyed.agg(F.count(F.lit(1)).alias("cnt")).select(
        F.lit(0).alias("__all"), "cnt", F.lit(n).cast("bigint").alias("quota")
    )
    cuts = stage_table(
        hash_cuts(keyed, id_col, stage_table(quotas, "sample-quota"), ["__all"], seed, bucket_rows),
        "sample-cut",
    )
    cut_hash = cuts.select("cut_hash").scalar()
    cut_id = cuts.select("cut_id").scalar()
    # without a cut the table has fewer than n rows
    return rows.where(cut_hash.isNull() | at_or_below(id_col, seed, cut_hash, cut_id))


def split_quotas(
    classes: DataFrame, group: str | None, label: str, val_size: float, test_size: float
) -> DataFrame:
    """Adds ``hold_n`` per class and ``test_n``, ``hold_all`` per group to a class table.

    ``ceil((val+test)·N)`` rows per group are held out, in proportion to the
    classes by largest remainder, ties by label. Classes of one row stay in
    training. The class table of a group is as long as its model has rows.
    """
    part = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
    hold_size = val_size + test_size
    n = F.col("cnt").cast("decimal(19,0)")
    single = F.col("cnt") == 1
    draws = F.col("__draws").cast("decimal(19,0)")
    pool = F.col("__pool").cast("decimal(19,0)")
    d = (
        classes.withColumn("__total", F.sum("cnt").over(part))
        .withColumn("__pool", F.sum(F.when(single, 0).otherwise(F.col("cnt"))).over(part))
        .withColumn(
            "__draws",
            F.greatest(
                F.lit(0).cast("bigint"),
                F.col("__pool") - F.ceil(F.lit(hold_size) * F.col("__total")).cast("bigint"),
            ),
        )
        .withColumn("__exact", n * draws)
        .withColumn(
            "__base",
            F.when(single, F.col("cnt")).otherwise(F.floor(F.expr("__exact div __pool"))),
        )
        .withColumn(
            "__rest", F.when(~single, (F.col("__exact") % pool).cast("decimal(19,0)"))
        )
        .withColumn("__short", F.col("__draws") - F.sum(F.when(~single, F.col("__base"))).over(part))
        .withColumn(
            "__rank", F.row_number().over(part.orderBy(F.desc_nulls_last("__rest"), F.asc(label)))
        )
        .withColumn(
            "hold_n",
            F.when(single, F.lit(0)).otherwise(
                F.col("cnt")
                - F.col("__base")
                - F.when(F.col("__rank") <= F.col("__short"), 1).otherwise(0)
            ).cast("bigint"),
        )
        .withColumn("hold_all", F.sum("hold_n").over(part))
    )
    shared = (F.col("hold_all") < 2) | F.lit(val_size <= 0 or test_size <= 0)
    return d.withColumn("shared", shared).withColumn(
        "test_n",
        F.when(F.col("shared"), F.lit(0).cast("bigint")).otherwise(
            F.ceil(F.lit(test_size / hold_size) * F.col("hold_all")).cast("bigint")
        ),
    ).drop("__total", "__pool", "__draws", "__exact", "__base", "__rest", "__short", "__rank")


def split_table(
    rows: DataFrame,
    id_col: str,
    group: str | None,
    label: str,
    val_size: float,
    test_size: float,
    seed: int,
    bucket_rows: int = BUCKET_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """One row per (group, label) with all that ``split_column`` needs.

    Models are per ``group``; rows with a null ``label`` take no part.
    ``sizes`` (group, label, cnt) saves counting them again.
    """
    keys = [group, label] if group else [label]
    narrow = rows.select(id_col, *keys).where(F.col(label).isNotNull())
    if sizes is None:
        sizes = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
    classes = stage_table(split_quotas(sizes, group, label, val_size, test_size), "split-classes")
    hold_cuts = hash_cuts(
        narrow, id_col, classes.select(*keys, "cnt", F.col("hold_n").alias("quota")), keys, seed, bucket_rows
    )
    table = stage_table(classes.join(hold_cuts, keys, "left"), "split-cuts")

    outer = [group] if group else ["__all"]
    cut = table.select(*keys, "cnt", "cut_hash", "cut_id")
    held = attach(narrow, cut, keys, "cnt", [id_col]).where(
        at_or_below(id_col, seed, F.col("cut_hash"), F.col("cut_id"))
    )
    held = held.select(id_col, *keys, F.lit(0).alias("__all"))
    table = table.withColumn("__all", F.lit(0))
    quotas = table.groupBy(*outer).agg(
        F.max("hold_all").alias("cnt"), F.max("test_n").alias("quota")
    )
    test_cuts = hash_cuts(held, id_col, quotas, outer, f"{seed}-test", bucket_rows).select(
        *outer, F.col("cut_hash").alias("test_hash"), F.col("cut_id").alias("test_id")
    )
    return stage_table(
        table.join(test_cuts, outer, "left").select(
            *keys, "cnt", F.struct("shared", "cut_hash", "cut_id", "test_hash", "test_id").alias("cuts")
        ),
        "split-table",
    )


def split_column(id_col: str, seed: int, label: Column, cuts: Column) -> Column:
    """train, val, test, or both where val and test are the same rows."""
    in_hold = at_or_below(id_col, seed, cuts["cut_hash"], cuts["cut_id"])
    in_test = at_or_below(id_col, f"{seed}-test", cuts["test_hash"], cuts["test_id"])
    return (
        F.when(label.isNull(), F.lit(None).cast("string"))
        .when(~in_hold, "train")
        .when(cuts["shared"], "both")
        .when(in_test, "test")
        .otherwise("val")
    )


def stratified_split(
    rows: DataFrame,
    id_col: str,
    group: str | None,
    label: str,
    val_size: float,
    test_size: float,
    seed: int,
    out_col: str = "split",
) -> DataFrame:
    """Adds ``out_col`` to all rows; null for rows with a null ``label``."""
    keys = [group, label] if group else [label]
    table = split_table(rows, id_col, group, label, val_size, test_size, seed)
    out = attach(rows, table, keys, "cnt", [id_col])
    column = split_column(id_col, seed, F.col(label), F.col("cuts"))
    return out.withColumn(out_col, column).drop("cuts")


def one_row_per_split(rows: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows that are in both val and test appear once for each."""
    both = F.col(split_col) == "both"
    return rows.withColumn(
        split_col,
        F.explode(
            F.when(both, F.array(F.lit("val"), F.lit("test"))).otherwise(F.array(split_col))
        ),
    )
