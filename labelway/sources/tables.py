"""Reading the training table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelway.sources.csv_records import csv_records

# Cell texts that mean "missing" in a delimited table.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def _ddl(df: DataFrame) -> str:
    return ", ".join("`" + c.replace("`", "``") + "` string" for c in df.columns)


def load_table(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header, or Parquet, by suffix; all CSV columns are strings.

    ``multi_line`` allows line breaks inside quotes. Files are split all the same: a first
    pass finds where records begin. Without it a record is a line, in one pass.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in ("csv", "parquet"):
        raise ValueError(f"Unsupported format: .{suffix}")
    try:
        if suffix == "parquet":
            return spark.read.parquet(path)
        raw = spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"')
        if multi_line:
            fields = F.from_csv("record", _ddl(raw), {"quote": '"', "escape": '"'})
            records = csv_records(spark, path).where("not first and record <> ''")
            raw = records.select(fields.alias("fields")).select("fields.*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            raise FileNotFoundError(path) from e
        raise
    return raw.select(
        *[F.when(~F.col(f"`{c}`").isin(MISSING_TEXTS), F.col(f"`{c}`")).alias(c) for c in raw.columns]
    )
