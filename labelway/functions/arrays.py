"""Array expressions over class probabilities. Array index = class index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def best_class(proba: Column) -> Column:
    """Class of the largest probability, lowest index on ties."""
    return (F.array_position(proba, F.array_max(proba)) - 1).cast("int")


def top_classes(proba: Column, k: Column | int) -> Column:
    """The k best ``(proba, class_idx)`` structs, best first, ties by class."""
    k = F.lit(k) if isinstance(k, int) else k
    keyed = F.transform(
        proba, lambda p, i: F.struct((-p).alias("neg"), i.cast("int").alias("class_idx"))
    )
    best = F.slice(F.array_sort(keyed), 1, F.greatest(k, F.lit(1)))
    return F.transform(
        best,
        lambda s: F.struct((-s["neg"]).alias("proba"), s["class_idx"].alias("class_idx")),
    )


def class_rank(proba: Column, class_idx: Column) -> Column:
    """0-based position of a class in the best-first order, without sorting."""
    own = F.element_at(proba, (class_idx + 1).cast("int"))
    ahead = F.filter(proba, lambda p, i: (p > own) | ((p == own) & (i < class_idx)))
    return F.size(ahead)


def in_top_k(proba: Column, class_idx: Column, k: int) -> Column:
    return class_rank(proba, class_idx) < k
