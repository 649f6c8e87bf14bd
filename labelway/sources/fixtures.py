"""Ticket-shaped views over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelway.session import spread_small


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


def tickets_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full input schema over documents; category is learnable from the text."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality").isNull(), "n/a").otherwise(
        (F.lit(4) + F.col("quality") - 2 * F.col("toxic")).cast("string")
    )
    size = F.floor(F.log2(F.col("n_chars"))).cast("int").cast("string")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"),
        F.col("text").alias("text_obr"),
        F.col("lang").alias("category"),
        F.col("source").alias("issue"),
        F.concat(F.lit("len"), size).alias("subissue"),
        grade.alias("grade"),
    )


def tickets_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories with a learnable second level."""
    group = F.regexp_replace("source", "src", "").cast("int") % 4
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"),
        F.col("text").alias("text_obr"),
        F.concat(F.lit("grp"), group.cast("string")).alias("category"),
        F.col("lang").alias("issue"),
        F.col("lang").alias("subissue"),
        F.lit("5").alias("grade"),
    )


def tickets_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label tree at volume; order and line number only spread hot labels."""
    items, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return items.join(part, items.l_partkey == part.p_partkey).select(
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("issue"),
        F.col("p_name").alias("subissue"),
        "l_orderkey",
        "l_linenumber",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a category and a label, two labels per category."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.floor(F.col("label") / 2).cast("int").alias("category"),
        F.col("label").cast("int").alias("label"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload strings, one per conversation turn: most valid, some bad or odd."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.to_json(F.struct("text")).alias("json"),
        F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(20)).alias("kind"),
    )
    text, kind = F.col("json"), F.col("kind")
    body = F.substr(text, F.lit(2))
    valid = F.concat(
        F.lit('{"topk_cat":'), (1 + F.col("turn") % 3).cast("string"),
        F.lit(',"topk_sub":'), (1 + F.col("turn") % 5).cast("string"), F.lit(","), body,
    )
    with_field = lambda field: F.concat(F.lit("{" + field + ","), body)
    value = (
        F.when(kind == 0, F.concat(F.lit("not a json "), F.col("role")))
        .when(kind == 1, F.concat(F.lit("["), text, F.lit("]")))
        .when(kind == 2, F.concat(F.lit('{"role":"'), F.col("role"), F.lit('"}')))
        .when(kind == 3, F.lit('{"text":"  "}'))
        .when(kind == 4, F.concat(F.lit('{"text":'), F.col("turn").cast("string"), F.lit("}")))
        .when(kind == 5, with_field('"art_dir":"no_such_model"'))
        .when(kind == 6, with_field('"topk_cat":"zz"'))
        .when(kind == 7, with_field('"topk_sub":null'))
        .when(kind == 8, with_field('"topk_cat":"7"'))
        .when(kind == 9, with_field('"topk_cat":2.7,"topk_sub":true'))
        .when(kind == 10, with_field('"topk_cat":-3,"art_dir":""'))
        .when(kind == 11, F.lit('{"text":"123"}'))
        .when(kind == 12, with_field('"topk_cat":99999999999999999999'))
        .when(kind == 13, with_field('"topk_sub":"-99999999999999999999"'))
        .when(kind == 14, with_field('"topk_cat":1e999'))
        .when(kind == 15, with_field('"topk_sub":NaN'))
        .otherwise(valid)
    )
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("req_id"), value.alias("value")
    )
