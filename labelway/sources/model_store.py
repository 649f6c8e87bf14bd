"""Models as Parquet tables under one root, partitioned by model and version.

Tables: weights, classes, stats, mapping, meta. ``category`` is a column and
null for the router; raw names are not safe as paths. Every save is a new version.
Its ``meta`` is written last: a version without it is incomplete and never read.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, fields

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelway.functions.vectors import to_matrix
from labelway.operators import linear
from labelway.operators.blocks import ClassRange, HeadKey, Piece
from labelway.operators.linear import Weights

TABLES = ("weights", "classes", "stats", "mapping", "meta")


@dataclass
class ModelTables:
    weights: DataFrame
    classes: DataFrame
    stats: DataFrame
    mapping: DataFrame
    meta: DataFrame


@dataclass
class Head:
    """Weights and the parts of each class label, in class order."""

    weights: Weights
    labels: list[str]
    issues: list[str | None] = field(default_factory=list)
    subs: list[str | None] = field(default_factory=list)


@dataclass
class HierModel:
    """A loaded model: the router and the heads it has."""

    model_id: str
    encoder_id: str
    encoder_weights: list[float] | None
    router: Head
    heads: dict[str, Head]

    @property
    def dim(self) -> int:
        return self.router.weights[0].shape[1]

    def nbytes(self) -> int:
        parts = [self.router, *self.heads.values()]
        return sum(p.weights[0].nbytes + p.weights[1].nbytes for p in parts)

    def sizes(self) -> dict[str | None, int]:
        """Classes by category; the router's under None."""
        return {None: len(self.router.labels)} | {c: len(h.labels) for c, h in sorted(self.heads.items())}

    def pieces(self, ranges: list[ClassRange]) -> list[tuple[HeadKey, Piece]]:
        found = []
        for r in ranges:
            head = self.router if r.key[1] is None else self.heads[r.key[1]]
            part = slice(r.first, r.end)
            n = r.end - r.first
            names = [(v or [None] * len(head.labels))[part] for v in (head.labels, head.issues, head.subs)]
            assert all(len(v) == n for v in names)
            found.append((r.key, Piece(r.first, tuple(a[part] for a in head.weights), *names)))
        return found


@dataclass
class StoredModel:
    """A model of any size whose weights stay in its tables; the driver holds one number per head."""

    model_id: str
    encoder_id: str
    encoder_weights: list[float] | None
    dim: int
    tables: ModelTables
    classes: dict[str | None, int]

    def nbytes(self) -> int:
        return sum(self.classes.values()) * (self.dim + 1) * 8

    def sizes(self) -> dict[str | None, int]:
        return self.classes

    def pieces(self, ranges: list[ClassRange]) -> list[tuple[HeadKey, Piece]]:
        """Reads the classes of ``ranges``, whose size the caller has bounded."""
        spark = self.tables.weights.sparkSession
        wanted = spark.createDataFrame(
            [(r.key[1], r.first, r.end) for r in ranges], "category string, first int, end int"
        )
        found = []
        for category, first, head in _read_heads(self.tables, F.broadcast(wanted)):
            names = (head.labels, head.issues, head.subs)
            found.append(((self.model_id, category), Piece(first, head.weights, *names)))
        return found


def next_version(last: int | None) -> int:
    """Microseconds of the clock, and greater than the last one."""
    return max(time.time_ns() // 1000, (last or 0) + 1)


def save_model(tables: ModelTables, root: str) -> int:
    """Adds a version of this model; older ones stay. Returns its number.

    The tables of one save can hold several models, which get the same version.
    """
    spark = tables.meta.sparkSession
    last = max([0, *(version for versions in _versions(spark, root).values() for version in versions)])
    version = next_version(last)
    for name in TABLES:
        (
            getattr(tables, name)
            .withColumn("version", F.lit(version))
            .write.mode("append")
            .partitionBy("model_id", "version")
            .parquet(f"{root}/{name}")
        )
    return version


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    try:
        found = spark.read.parquet(f"{root}/{name}")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(f"Model table not found: {root}/{name}") from e
        raise
    # names such as 7 or 2024-01-01 are read as other types
    return found.withColumn("model_id", F.col("model_id").cast("string"))


def _versions(spark: SparkSession, root: str) -> dict[str, list[int]]:
    """All complete versions of all models, one short row each."""
    try:
        meta = _table(spark, root, "meta")
    except FileNotFoundError:
        return {}
    found: dict[str, list[int]] = {}
    for r in meta.select("model_id", "version").distinct().collect():
        found.setdefault(r["model_id"], []).append(r["version"])
    return {m: sorted(v) for m, v in sorted(found.items())}


def newest_versions(spark: SparkSession, root: str) -> dict[str, int]:
    """The newest complete version of every model under ``root``."""
    return {m: v[-1] for m, v in _versions(spark, root).items()}


def open_tables(spark: SparkSession, root: str, model_id: str, version: int | None = None) -> ModelTables:
    """The tables of one model, in its newest complete version or the given one.

    Only the partitions of that version are read.
    """
    found = {name: _table(spark, root, name) for name in TABLES}
    if version is None:
        version = newest_versions(spark, root).get(model_id)
    if version is None:
        raise FileNotFoundError(f"Artifacts directory not found: {model_id}")
    mine = (F.col("model_id") == model_id) & (F.col("version") == version)
    tables = ModelTables(**{name: t.where(mine).drop("version") for name, t in found.items()})
    if tables.meta.isEmpty():
        raise FileNotFoundError(f"Artifacts directory not found: {model_id}")
    return tables


def prune_versions(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes all but the ``keep`` newest complete versions of each model; how many.

    ``meta`` goes first, so a reader never takes a half deleted version for complete.
    """
    gone = [(m, v) for m, versions in _versions(spark, root).items() for v in versions[: -max(1, keep)]]
    for name in reversed(TABLES):
        paths = _partition_paths(spark, f"{root}/{name}", gone)
        for path in paths:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def _partition_paths(spark: SparkSession, folder: str, versions: list[tuple[str, int]]) -> list:
    """Folders of versions; file names come from Spark, so escaped names are right."""
    wanted = spark.createDataFrame(versions, "model_id string, version long")
    files = spark.read.parquet(folder).select(
        F.col("model_id").cast("string").alias("model_id"),
        "version",
        F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder"),
    )
    files = files.join(F.broadcast(wanted), ["model_id", "version"], "left_semi").select("folder").distinct()
    return [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(r["folder"])) for r in files.collect()]


def _read_heads(tables: ModelTables, wanted: DataFrame | None = None):
    """(category, first class, head) of all heads, or of the class ranges ``wanted``."""
    weights = tables.weights.select("category", "class_idx", "weights", "bias")
    if wanted is not None:
        weights = (
            weights.alias("w")
            .join(
                wanted.alias("r"),
                F.col("w.category").eqNullSafe(F.col("r.category"))
                & (F.col("w.class_idx") >= F.col("r.first"))
                & (F.col("w.class_idx") < F.col("r.end")),
            )
            .select("w.*")
        )
    rows = (
        weights.alias("w")
        .join(
            tables.classes.alias("c"),
            F.col("w.category").eqNullSafe(F.col("c.category"))
            & (F.col("w.class_idx") == F.col("c.class_idx")),
        )
        .select("w.category", "w.class_idx", "w.weights", "w.bias", "c.label", "c.issue", "c.subissue_unique")
        .orderBy("category", "class_idx")
        .toArrow()
    )
    if not rows.num_rows:
        return []
    category = rows.column("category").to_pylist()
    index = rows.column("class_idx").to_pylist()
    w = to_matrix(rows.column("weights").combine_chunks())
    b = rows.column("bias").to_numpy()
    label, issue, sub = (rows.column(c).to_pylist() for c in ("label", "issue", "subissue_unique"))
    # sorted by category and class: a new head, or a gap between two ranges of one
    cuts = [
        i for i, c in enumerate(category) if not i or c != category[i - 1] or index[i] != index[i - 1] + 1
    ]
    return [
        (category[lo], index[lo], Head((w[lo:hi], b[lo:hi]), label[lo:hi], issue[lo:hi], sub[lo:hi]))
        for lo, hi in zip(cuts, [*cuts[1:], len(category)])
    ]


def open_model(tables: ModelTables) -> StoredModel:
    """A model to be served from its tables, whatever its size."""
    counts = tables.weights.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("weights")).alias("dim")
    )
    rows = sorted(counts.collect(), key=lambda r: (r["category"] is not None, r["category"] or ""))
    if not rows or rows[0]["category"] is not None:
        raise FileNotFoundError("Router not found in the weights table")
    meta = tables.meta.first()
    return StoredModel(
        str(meta["model_id"]), meta["encoder_id"], meta["encoder_weights"],
        max(r["dim"] for r in rows), tables, {r["category"]: r["n"] for r in rows},
    )


def load_model(tables: ModelTables, limit: int | None = None) -> HierModel | StoredModel:
    """One model, in memory if its weights are at most ``limit`` bytes (``MODEL_BYTES``), else as stored."""
    stored = open_model(tables)
    if stored.nbytes() > (linear.MODEL_BYTES if limit is None else limit):
        return stored
    heads = {category: head for category, _, head in _read_heads(tables)}
    router = heads.pop(None)
    return HierModel(stored.model_id, stored.encoder_id, stored.encoder_weights, router, heads)


assert tuple(f.name for f in fields(ModelTables)) == TABLES
