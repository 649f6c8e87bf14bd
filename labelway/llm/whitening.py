"""Whitening of vectors by a covariance that counts repeated vectors.

Entries become integers on a fixed grid, so equal vectors can be grouped exactly.
The distinct vectors carry their count (or one) as weight of the fit. Sums are
exact integers; the covariance is a weighted matrix product of centred rows, added
up per task and then by Spark. Each distinct vector is whitened once, and the
result is joined back to the rows by a digest of the vector.

The driver holds the covariance (dimension squared), never vectors.

Defined cases: null vectors and vectors with a null or non-finite entry are dropped,
as are entries beyond 2^62 on the grid (no long holds them) and vectors of another length
than the commonest one (ties: the longer). Repeated rows and null ids stay. Without rows, or
with vectors of length 0, the result is empty. A component without variance has
no direction of its own: ``whitened`` is null there, and ``identity_error`` is taken over the
others (null if there are none); ``explained`` is null if nothing varies at all. A
``deviation`` beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelway.llm.common import table
from labelway.operators.joins import attach
from labelway.session import stage_table

LONG = 1 << 62
SLICE = 1024
FAN_IN = 64


@dataclass(frozen=True)
class Whitening:
    """``x = floor(scale * entry) + shift``; ``counted`` weighs a vector by its rows, else by one."""

    components: int = 8
    scale: float = 1024.0
    shift: int = 100_000
    counted: bool = True


def _grid(vectors: pa.Array, cfg: Whitening) -> tuple[np.ndarray, pa.Array]:
    """Which vectors have grid coordinates, and these as little-endian longs."""
    n = len(vectors)
    has = vectors.is_valid().to_numpy(zero_copy_only=False)
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    with np.errstate(over="ignore", invalid="ignore"):
        cells = np.floor(cfg.scale * entries)
        fits = np.abs(cells) < LONG
    owner = np.repeat(np.arange(n), lengths)
    kept = has & (np.bincount(owner, ~fits, minlength=n) == 0)
    x = np.where(fits, cells, 0).astype("<i8") + cfg.shift
    offsets = np.r_[0, np.cumsum(8 * lengths)].astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])
    return kept, packed


def grid_vectors(rows: DataFrame, id_col: str, vector_col: str, cfg: Whitening) -> DataFrame:
    """(id, x): rows whose vector lies on the grid, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                kept, x = _grid(part.column(1), cfg)
                mask = pa.array(kept)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), x.filter(mask)], ["id", "x"])

    ids = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return ids.mapInArrow(run, f"id {ids.schema['id'].dataType.simpleString()}, x binary")


def _matrix(x: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), "<i8").reshape(len(x), -1)


def _parts(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[pa.Array]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield [part.column(name) for name in names]


def _peak(x: np.ndarray) -> int:
    return int(np.abs(x).max(initial=0))


def exact_sums(distinct: DataFrame, weight: str, dim: int) -> list[int]:
    """Weighted sum of every coordinate, exact at any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for x, w in _parts(batches, "x", weight):
            x, w = _matrix(x), w.to_numpy(zero_copy_only=False).astype(np.int64)
            wide = int(w.sum()) * _peak(x) >= LONG
            sums = w.astype(object) @ x.astype(object) if wide else w @ x
            total = [a + int(b) for a, b in zip(total, sums)]
        if any(total):
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dim), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))],
                ["dim", "total"],
            )

    sums = distinct.select("x", weight).mapInArrow(run, "dim int, total decimal(38,0)")
    found = {r["dim"]: int(r["total"]) for r in sums.groupBy("dim").agg(F.sum("total").alias("total")).collect()}
    return [found.get(i, 0) for i in range(dim)]


def from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums`` as exact integers."""
    if n * _peak(x) + max(map(abs, sums)) < LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(gap: np.ndarray) -> list[int | None]:
    """Squared length of each row of integers; None beyond 64 bits."""
    peak = max(map(abs, gap.reshape(-1).tolist()), default=0) if gap.dtype == object else _peak(gap)
    if gap.shape[1] * peak * peak < LONG:
        return (gap * gap).sum(axis=1).tolist()
    wide = gap.astype(object)
    return [v if v < 1 << 63 else None for v in (wide * wide).sum(axis=1)]


def covariance(distinct: DataFrame, weight: str, n: int, sums: list[int]) -> np.ndarray:
    """Weighted covariance, divisor ``n``. Tasks add up products of their centred rows,
    Spark adds the tasks' matrices row by row, in two steps."""
    dim = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for x, w in _parts(batches, "x", weight):
            centred = (from_mean(_matrix(x), n, sums) / n).astype(np.float64)
            total += (centred * w.to_numpy(zero_copy_only=False)[:, None]).T @ centred
        if total.any():
            offsets = np.arange(0, dim * dim + 1, dim, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dim), pa.int32()), pa.ListArray.from_arrays(offsets, total.reshape(-1))],
                ["dim", "products"],
            )

    def add_up(df: DataFrame, *keys: str) -> DataFrame:
        total = vector_to_array(Summarizer.sum(array_to_vector(F.col("products"))))
        return df.groupBy("dim", *keys).agg(total.alias("products"))

    parts = distinct.select("x", weight).mapInArrow(run, "dim int, products array<double>")
    parts = add_up(parts.withColumn("part", F.spark_partition_id() % FAN_IN), "part")
    result = np.zeros((dim, dim))
    for r in add_up(parts).toLocalIterator():
        result[r["dim"]] = r["products"]
    return (result + result.T) / (2 * n)


@dataclass(frozen=True)
class Projection:
    """Unit eigenvectors as columns, by falling eigenvalue; ``scales`` is 0 without variance."""

    axes: np.ndarray
    scales: np.ndarray
    explained: list[float | None]


def projection(cov: np.ndarray, components: int) -> Projection:
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])] < 0, -1.0, 1.0)
    flat = values <= len(cov) * np.finfo(float).eps * values.max(initial=0.0)
    scales = np.where(flat, 0.0, 1 / np.sqrt(np.where(flat, 1.0, values)))
    trace = float(np.trace(cov))
    return Projection(axes, scales, [max(float(v), 0.0) / trace if trace > 0 else None for v in values])


def whitened(distinct: DataFrame, weight: str, n: int, sums: list[int], to: Projection) -> DataFrame:
    """(key, copies, weight, deviation, y) of each distinct vector."""
    use = to.scales > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, copies, fit, x in _parts(batches, "key", "copies", "fit", "x"):
            gap = from_mean(_matrix(x), n, sums)
            y = ((gap / n).astype(np.float64) @ to.axes) * to.scales
            offsets = np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)
            values = pa.array(y.reshape(-1), mask=np.tile(~use, len(y)))
            yield pa.RecordBatch.from_arrays(
                [key, copies, fit, pa.array(deviations(gap), pa.int64()), pa.ListArray.from_arrays(offsets, values)],
                ["key", "copies", "fit", "deviation", "y"],
            )

    rows = distinct.select("key", "copies", F.col(weight).alias("fit"), "x")
    return rows.mapInArrow(run, "key binary, copies long, fit long, deviation long, y array<double>")


def identity_error(done: DataFrame, n: int, to: Projection) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    use = [int(i) for i in np.flatnonzero(to.scales)]
    if not use:
        return None
    fit = F.col("fit")
    means = done.agg(*[(F.sum(fit * F.col("y")[i]) / n).alias(f"m{i}") for i in use]).first()
    gap = {i: F.col("y")[i] - F.lit(means[f"m{i}"]) for i in use}
    pairs = [(i, j) for i in use for j in use if i <= j]
    found = done.agg(*[(F.sum(fit * gap[i] * gap[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cfg: Whitening = Whitening()
) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) of each row and component."""
    spark = rows.sparkSession
    placed = grid_vectors(rows, id_col, vector_col, cfg)
    kind = placed.schema["id"].dataType.simpleString()
    columns = (
        f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double,"
        " identity_error double"
    )
    digest = F.unhex(F.md5("x"))
    groups = placed.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    distinct = stage_table(
        groups.select(digest.alias("key"), "x", "copies", F.lit(1).cast("long").alias("one")), "vectors"
    )
    weight = "copies" if cfg.counted else "one"
    lengths = distinct.groupBy((F.octet_length("x") / 8).cast("int").alias("dim")).agg(
        F.sum("copies").alias("rows"), F.sum(weight).alias("n")
    )
    common = lengths.orderBy(F.desc("rows"), F.desc("dim")).first()
    if common is None or not common["dim"]:
        return spark.createDataFrame([], columns)
    dim, n = common["dim"], common["n"]
    distinct = distinct.filter(F.octet_length("x") == 8 * dim)
    sums = exact_sums(distinct, weight, dim)
    to = projection(covariance(distinct, weight, n, sums), min(cfg.components, dim))
    done = stage_table(whitened(distinct, weight, n, sums, to), "whitened")
    error = identity_error(done, n, to)
    # one narrow row per input row meets its vector's result; frequent vectors are salted
    found = attach(
        placed.select("id", digest.alias("key")), done.drop("fit"), ["key"], "copies", ["id"], how="inner"
    )
    explained = F.array(*[F.lit(v).cast("double") for v in to.explained])
    return found.select("id", "deviation", F.posexplode("y").alias("at", "whitened")).select(
        F.col("id").alias(id_col),
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("at")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def q_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector of ``embeddings``."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
