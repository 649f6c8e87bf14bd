"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelway.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def packed(df: DataFrame, *extra: Column) -> DataFrame:
    """The whole row as one struct ``row`` plus computed columns, so that column
    names of the input never clash with those an operator adds."""
    return df.select(F.struct("*").alias("row"), *extra)


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")
