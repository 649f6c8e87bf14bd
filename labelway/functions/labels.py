"""Composite labels and small predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelway.config import LABEL_SEP, NULL_LABEL, SINGLE_LABEL

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def or_nan(col: Column) -> Column:
    """A missing name is the literal class ``nan``."""
    return F.coalesce(col, F.lit(NULL_LABEL))


def compose_label(issue: Column, sub: Column) -> Column:
    return F.concat_ws(LABEL_SEP, or_nan(issue), or_nan(sub))


def split_label(label: Column) -> tuple[Column, Column]:
    """(issue, subissue) of a label: first separator splits, ``__single__`` has neither."""
    has_sep = F.contains(label, F.lit(LABEL_SEP))
    parts = F.split(label, LABEL_SEP, 2)
    issue = F.when(has_sep, parts[0])
    sub = F.when(has_sep, parts[1]).when(label != SINGLE_LABEL, label)
    return issue, sub


def with_issue(sub: Column, issue: Column) -> Column:
    return F.concat(or_nan(sub), F.lit(" ⟨"), or_nan(issue), F.lit("⟩"))


def is_good_grade(grade: Column) -> Column:
    """Grade 4 or 5; anything that is not a number fails the test."""
    text = grade.cast("string")
    number = F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    return F.coalesce(number.isin(4.0, 5.0), F.lit(False))
