"""Multinomial linear models: training in shared passes, and scoring.

Spark keeps and moves the rows; Python sees Arrow batches and does matrix
products. Models that fit ``MODEL_BYTES`` are trained together, their weights broadcast.
A larger model is trained in blocks of its classes: its weights and optimiser
state are table rows, the driver and the workers hold one block at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.core.broadcast import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelway.functions.vectors import PACKED, as_bytes, chunks, logits, packed, softmax, to_matrix
from labelway.operators.blocks import ClassRange, Piece, merged_scores, partial_scores, plan_blocks
from labelway.session import drop_table, scratch_path, stage_table

# Weights trained or broadcast at one time.
MODEL_BYTES = 256 << 20

# From this many partitions on, gradients are added in two stages.
FAN_IN_PARTS = 1024

Weights = tuple[np.ndarray, np.ndarray]  # [classes, dim], [classes]


@dataclass(frozen=True)
class LinearTask:
    """A family of models on one label column.

    ``classes`` maps the model's group (0 without ``group_col``) to its number
    of classes. Rows with a null label are not trained on.
    """

    name: str
    label_col: str
    classes: dict[int, int]
    group_col: str | None = None
    epochs: int = 60
    lr: float = 0.05
    weight_decay: float = 1e-4

    def rate(self, step: int, updates: int) -> float:
        """Cosine learning rate over all steps."""
        return 0.5 * self.lr * (1 + math.cos(math.pi * step / max(1, self.epochs * updates)))


def adamw(w: np.ndarray, m: np.ndarray, v: np.ndarray, grad: np.ndarray, step: int, rate: float, decay: float):
    """New (w, m, v): decoupled weight decay, moments 0.9 and 0.999."""
    m = 0.9 * m + 0.1 * grad
    v = 0.999 * v + 0.001 * grad * grad
    move = (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.999 ** (step + 1))) + 1e-8)
    return w * (1 - rate * decay) - rate * move, m, v


@dataclass
class _Fit:
    """AdamW state of one model; the bias is the last column."""

    task: LinearTask
    w: np.ndarray
    m: np.ndarray = field(init=False)
    v: np.ndarray = field(init=False)
    loss: float = math.inf
    done: bool = False

    def __post_init__(self) -> None:
        self.m, self.v = np.zeros_like(self.w), np.zeros_like(self.w)

    def step(self, step: int, updates: int, grad: np.ndarray) -> None:
        rate = self.task.rate(step, updates)
        self.w, self.m, self.v = adamw(self.w, self.m, self.v, grad, step, rate, self.task.weight_decay)

    def settle(self, loss: float, tolerance: float) -> None:
        """Done when a pass lowers the mean loss by less than ``tolerance`` of it."""
        self.done = tolerance > 0 and self.loss - loss < tolerance * abs(loss)
        self.loss = loss


@F.arrow_udf(T.BinaryType())
def _pack(x: pa.Array) -> pa.Array:
    if len(x) == 0:
        return pa.array([], pa.binary())
    valid = np.asarray(x.is_valid())
    lengths = np.asarray(x.value_lengths().fill_null(0), np.int64)
    values = x.flatten()  # without the null vectors
    if values.null_count or len(np.unique(lengths[valid])) > 1:
        raise ValueError("vectors must have one length and no null entries")
    return as_bytes(_values(values, "<f4"), lengths, valid)


def _values(values: pa.Array, kind: str) -> np.ndarray:
    return np.ascontiguousarray(values.to_numpy(zero_copy_only=False), dtype=kind)


def pack_vectors(x: Column) -> Column:
    """Vectors of one length as little-endian float32 bytes: the dense training format.

    A null vector stays null; differing lengths and null entries are an error.

    Moving a byte string through Arrow on every pass is a memory copy; moving
    an array goes element by element.
    """
    return _pack(x)


@F.arrow_udf(PACKED)
def _pack_sparse(index: pa.Array, value: pa.Array) -> pa.Array:
    valid = np.asarray(index.is_valid()) & np.asarray(value.is_valid())
    parts = []
    for x, kind in ((index, "<i4"), (value, "<f4")):
        x = x.filter(pa.array(valid))
        lengths = np.zeros(len(valid), np.int64)
        lengths[valid] = np.asarray(x.value_lengths(), np.int64)
        parts.append((_values(x.flatten(), kind), lengths))
    if (parts[0][1] != parts[1][1]).any():
        raise ValueError("a sparse vector needs as many indices as values")
    return packed(parts[0][0], parts[1][0], lengths, valid)


def pack_sparse(x: Column) -> Column:
    """``struct<indices:array<int>,values:array<float>>`` as bytes: 8 for each entry.

    Indices are different and from 0 on; a null vector stays null.
    """
    return _pack_sparse(x["indices"], x["values"])


def row_block(row_id: Column, blocks: int) -> Column:
    """A fixed block of rows by hash of the id: the mini-batch of an update."""
    head = F.conv(F.substring(F.md5(row_id.cast("string").cast("binary")), 1, 8), 16, 10)
    return F.pmod(head.cast("bigint"), F.lit(blocks)).cast("int")


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)


def _logits(x: np.ndarray, columns: np.ndarray | None, w: np.ndarray) -> np.ndarray:
    """Products with weights whose last column is the bias."""
    own = w[:, :-1] if columns is None else w[:, columns]
    return x @ own.T + w[:, -1]


def _add_gradient(total: np.ndarray, gap: np.ndarray, x: np.ndarray, columns: np.ndarray | None) -> None:
    total[:, slice(0, -1) if columns is None else columns] += gap.T @ x
    total[:, -1] += gap.sum(axis=0)


_PARTIAL = "task int, grp int, class_idx int, grad array<double>, n long, loss double"


def _gradient_rows(task: int, grp: int, first: int, grad: np.ndarray, n: int, loss: float) -> pa.RecordBatch:
    k, width = grad.shape
    offsets = np.arange(0, k * width + 1, width, dtype=np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(k, task, np.int32)),
            pa.array(np.full(k, grp, np.int32)),
            pa.array(np.arange(first, first + k, dtype=np.int32)),
            pa.ListArray.from_arrays(offsets, grad.reshape(-1)),
            pa.array(np.full(k, n, np.int64)),
            pa.array(np.full(k, loss)),
        ],
        names=["task", "grp", "class_idx", "grad", "n", "loss"],
    )


def _add_up(sums: DataFrame, fan_in: int) -> DataFrame:
    """Sums of the tasks' rows; with very many tasks in two stages of ``fan_in``."""

    def add_up(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy("task", "grp", "class_idx", *keys).agg(
            vector_to_array(Summarizer.sum(array_to_vector(F.col("grad")))).alias("grad"),
            F.sum("n").alias("n"),
            F.sum("loss").alias("loss"),
        )

    if fan_in > 1:
        sums = add_up(sums.withColumn("part", F.spark_partition_id() % fan_in), "part")
    return add_up(sums)


def gradient_sums(
    rows: DataFrame, x_col: str, tasks: list[LinearTask], weights, fan_in: int = 1
) -> DataFrame:
    """Sum of (P − Y)ᵀ[X 1], row count and sum of losses per (task, group, class).

    Each task of the job adds up its own rows, so only partitions × classes
    short rows are shuffled, however large a group is. Count and loss are the group's, on each row.
    """
    shared = weights if isinstance(weights, Broadcast) else rows.sparkSession.sparkContext.broadcast(weights)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            labels = [_ints(batch, task.label_col) for task in tasks]
            groups = [_ints(batch, t.group_col) if t.group_col else np.zeros_like(y) for t, y in zip(tasks, labels)]
            for part, columns, x in chunks(batch.column(x_col)):
                for t, (y, g) in enumerate(zip(labels, groups)):
                    y, g = y[part], g[part]
                    for grp in np.unique(g[y >= 0]):
                        w = shared.value.get((t, int(grp)))
                        if w is None:
                            continue
                        pick = np.flatnonzero((g == grp) & (y >= 0))
                        xs = x if len(pick) == len(x) else x[pick]
                        z = _logits(xs, columns, w)
                        top = z.max(axis=1)
                        p = np.exp(z - top[:, None])
                        total = p.sum(axis=1)
                        p /= total[:, None]
                        at = np.arange(len(pick)), y[pick]
                        entry = sums.setdefault((t, int(grp)), [np.zeros_like(w), 0, 0.0])
                        entry[1] += len(pick)
                        entry[2] += float((top + np.log(total) - z[at]).sum())
                        p[at] -= 1.0
                        _add_gradient(entry[0], p, xs, columns)
        for (t, grp), (grad, n, loss) in sums.items():
            yield _gradient_rows(t, grp, 0, grad, n, loss)

    return _add_up(rows.mapInArrow(partial, _PARTIAL), fan_in)


def _part(data: DataFrame, block_col: str | None, updates: int, update: int) -> DataFrame:
    return data if updates == 1 else data.where(F.col(block_col) == update)


def _epochs(
    data: DataFrame, x_col: str, wave: list[LinearTask], fits: dict, fan_in: int,
    updates: int, block_col: str | None, tolerance: float, after_pass,
) -> None:
    """One pass per epoch with an update for each row block; each update's copy of the
    weights is released when it ends."""
    sc = data.sparkSession.sparkContext
    for epoch in range(max(task.epochs for task in wave)):
        active = [key for key, f in fits.items() if epoch < f.task.epochs and not f.done]
        if not active:
            return
        seen = {key: [0, 0.0] for key in active}
        for update in range(updates):
            shared = sc.broadcast({key: fits[key].w for key in active})
            try:
                part = _part(data, block_col, updates, update)
                sums = gradient_sums(part, x_col, wave, shared, fan_in).toArrow()
            finally:
                shared.destroy()
            grads, counts = {}, {}
            for part in sums.to_batches():
                keys = zip(*(part.column(c).to_pylist() for c in ("task", "grp", "class_idx", "n", "loss")))
                for (t, grp, c, n, loss), g in zip(keys, to_matrix(part.column("grad"))):
                    grads.setdefault((t, grp), np.zeros_like(fits[t, grp].w))[c] = g
                    counts[t, grp] = (n, loss)
            for key, grad in grads.items():
                n, loss = counts[key]
                fits[key].step(epoch * updates + update, updates, grad / n)
                seen[key][0] += n
                seen[key][1] += loss
        for key, (n, loss) in seen.items():
            if n:
                fits[key].settle(loss / n, tolerance)
        if after_pass:
            models = {wave[t].name: (f.w[:, :-1], f.w[:, -1]) for (t, _), f in fits.items()}
            gone = after_pass(epoch + 1, models)
            for (t, _), f in fits.items():
                f.done = f.done or wave[t].name in gone


# --- models larger than a block of weights ------------------------------------

_STATE = "class_idx int, w array<double>, m array<double>, v array<double>"


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(rows).reshape(-1))


def _zero_state(spark: SparkSession, block: ClassRange, dim: int) -> DataFrame:
    zeros = F.array_repeat(F.lit(0.0), dim + 1)
    return spark.range(block.first, block.end).select(
        F.col("id").cast("int").alias("class_idx"), zeros.alias("w"), zeros.alias("m"), zeros.alias("v")
    )


def _normalisers(data: DataFrame, x_col: str, label_col: str, first: int, shared: Broadcast) -> DataFrame:
    """(__row, m, s, own) of one class block: greatest logit, sum of exponentials below it, and
    the logit of the row's own class if it is in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            y = _ints(batch, label_col) - first
            for part, columns, x in chunks(batch.column(x_col)):
                z, own = _logits(x, columns, w), y[part]
                m = z.max(axis=1)
                inside = (own >= 0) & (own < len(w))
                mine = np.where(inside, z[np.arange(len(z)), np.where(inside, own, 0)], 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("__row").slice(part.start, len(z)),
                        pa.array(m),
                        pa.array(np.exp(z - m[:, None]).sum(axis=1)),
                        pa.array(mine, mask=~inside),
                    ],
                    ["__row", "m", "s", "own"],
                )

    return data.select("__row", x_col, label_col).mapInArrow(run, "__row long, m double, s double, own double")


def _block_gradients(data: DataFrame, x_col: str, label_col: str, first: int, shared: Broadcast, fan_in: int) -> DataFrame:
    """Sums of (P − Y)ᵀ[X 1] of one class block, given each row's log-normaliser ``lz``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        grad, n = np.zeros_like(w), 0
        for batch in batches:
            y, lz = _ints(batch, label_col) - first, batch.column("lz").to_numpy(zero_copy_only=False)
            for part, columns, x in chunks(batch.column(x_col)):
                p = np.exp(_logits(x, columns, w) - lz[part][:, None])
                own = y[part]
                inside = np.flatnonzero((own >= 0) & (own < len(w)))
                p[inside, own[inside]] -= 1.0
                _add_gradient(grad, p, x, columns)
                n += len(x)
        if n:
            yield _gradient_rows(0, 0, first, grad, n, 0.0)

    return _add_up(data.select(x_col, label_col, "lz").mapInArrow(run, _PARTIAL), fan_in)


def _stepped(state: DataFrame, grads: DataFrame, task: LinearTask, step: int, updates: int) -> DataFrame:
    """The state after one update, class by class."""
    rate, decay = task.rate(step, updates), task.weight_decay

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w, m, v, grad = (to_matrix(batch.column(c)) for c in ("w", "m", "v", "grad"))
            n = batch.column("n").to_numpy(zero_copy_only=False)
            new = adamw(w, m, v, grad / n[:, None], step, rate, decay)
            yield pa.RecordBatch.from_arrays([batch.column("class_idx"), *map(_lists, new)], ["class_idx", "w", "m", "v"])

    rows = state.join(grads.select("class_idx", "grad", "n"), "class_idx")
    return rows.select("class_idx", "w", "m", "v", "grad", "n").mapInArrow(run, _STATE)


def _fit_in_class_blocks(
    data: DataFrame, x_col: str, dim: int, task: LinearTask, blocks: list[ClassRange], fan_in: int,
    updates: int, block_col: str | None, tolerance: float,
) -> DataFrame:
    """(class_idx, w) of one model that does not fit ``MODEL_BYTES``.

    Each update takes two steps over the class blocks. The first gives every row its
    log-normaliser: per block a greatest logit and a sum, merged over the blocks. The
    second adds up gradients block by block and moves the block's weights, which are
    table rows like the optimiser's state. Vectors lie by row key in the cache, so only
    normalisers are shuffled.
    """
    spark = data.sparkSession
    sc = spark.sparkContext
    parts = max(data.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = stage_table(data.withColumn("__row", F.monotonically_increasing_id()), "class-block-rows")
    rows = keyed.repartition(parts, "__row").persist(StorageLevel.MEMORY_AND_DISK)
    paths = [scratch_path(spark, "weights-state") for _ in blocks]
    for block, path in zip(blocks, paths):
        _zero_state(spark, block, dim).write.parquet(path)

    def weights(path: str) -> Broadcast:
        found = spark.read.schema(_STATE).parquet(path).select("class_idx", "w").orderBy("class_idx").toArrow()
        return sc.broadcast(to_matrix(found.column("w").combine_chunks()))

    last = math.inf
    try:
        for epoch in range(task.epochs):
            seen, total = 0, 0.0
            for update in range(updates):
                step, mine = epoch * updates + update, _part(rows, block_col, updates, update)
                found = None
                for block, path in zip(blocks, paths):
                    shared = weights(path)
                    try:
                        one = stage_table(_normalisers(mine, x_col, task.label_col, block.first, shared), "normalisers")
                    finally:
                        shared.destroy()
                    found = one if found is None else found.unionByName(one)
                merged = found.groupBy("__row").agg(
                    F.max("m").alias("top"), F.sort_array(F.collect_list(F.struct("m", "s"))).alias("all"), F.max("own").alias("own")
                )
                sums = F.aggregate("all", F.lit(0.0), lambda a, e: a + e["s"] * F.exp(e["m"] - F.col("top")))
                lz = stage_table(merged.select("__row", "own", (F.col("top") + F.log(sums)).alias("lz")), "log-normalisers")
                n, loss = lz.agg(F.count(F.lit(1)), F.sum(F.col("lz") - F.col("own"))).first()
                if not n:
                    continue
                joined = mine.join(lz.drop("own"), "__row")
                for at, (block, path) in enumerate(zip(blocks, paths)):
                    shared = weights(path)
                    try:
                        grads = _block_gradients(joined, x_col, task.label_col, block.first, shared, fan_in)
                        new = scratch_path(spark, "weights-state")
                        state = spark.read.schema(_STATE).parquet(path)
                        _stepped(state, grads, task, step, updates).write.parquet(new)
                    finally:
                        shared.destroy()
                    drop_table(spark, path)
                    paths[at] = new
                seen, total = seen + n, total + loss
            if not seen:
                break
            loss, before = total / seen, last
            last = loss
            if tolerance > 0 and before - loss < tolerance * abs(loss):
                break
    finally:
        rows.unpersist()
    return spark.read.schema(_STATE).parquet(*paths).select("class_idx", "w")


# --- training --------------------------------------------------------------------


@dataclass
class Fitted:
    """Trained models as a table (name, grp, class_idx, weights, bias), one row per class."""

    rows: DataFrame
    dim: int
    classes: dict[tuple[str, int], int]

    def nbytes(self, name: str) -> int:
        return sum(n for (task, _), n in self.classes.items() if task == name) * (self.dim + 1) * 8

    def load(self, *names: str) -> dict[tuple[str, int], Weights]:
        """Weights of the named families, or of all, in memory: for those of checked size."""
        picked = self.rows.where(F.col("name").isin(list(names))) if names else self.rows
        table = picked.orderBy("name", "grp", "class_idx").toArrow()
        keys = list(zip(table.column("name").to_pylist(), table.column("grp").to_pylist()))
        w = to_matrix(table.column("weights").combine_chunks()) if keys else np.zeros((0, self.dim))
        b = table.column("bias").to_numpy()
        cuts = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
        return {keys[lo]: (w[lo:hi], b[lo:hi]) for lo, hi in zip(cuts, [*cuts[1:], len(keys)])}


_FITTED = "name string, grp int, class_idx int, weights array<double>, bias double"


def weights_rows(spark: SparkSession, weights: dict[tuple[str, int], Weights]) -> DataFrame:
    """Weights in memory as the rows of ``Fitted``."""
    names, grp, cls, flat, bias = [], [], [], [], []
    for (name, g), (w, b) in sorted(weights.items()):
        names += [name] * len(b)
        grp += [g] * len(b)
        cls += range(len(b))
        flat.append(w)
        bias.append(b)
    if not names:
        return spark.createDataFrame([], _FITTED)
    return spark.createDataFrame(
        pa.table(
            {
                "name": pa.array(names, pa.string()),
                "grp": pa.array(grp, pa.int32()),
                "class_idx": pa.array(cls, pa.int32()),
                "weights": _lists(np.concatenate(flat)),
                "bias": pa.array(np.concatenate(bias)),
            }
        )
    )


def softmax_fit(
    rows: DataFrame,
    x_col: str,
    dim: int,
    tasks: list[LinearTask],
    updates: int = 1,
    block_col: str | None = None,
    tolerance: float = 0.0,
    after_pass: Callable[[int, dict[str, Weights]], list[str]] | None = None,
) -> Fitted:
    """Trains all models of all tasks from zero weights.

    One pass over ``rows`` per epoch serves every model of a wave; models with
    fewer epochs drop out. ``rows`` should be staged: it is read once per pass. With
    ``updates`` above 1 a pass moves the weights once for each row block 0, 1, ... of
    ``block_col`` (see ``row_block``). A model whose mean loss falls by less than ``tolerance`` of it
    in a pass is done. ``after_pass(passes, models by task)`` can name tasks that stop, for tasks of one
    model each that fit in a wave. Waves are written as they end; what the driver holds is one wave.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col(x_col).isNotNull())
    parts = rows.rdd.getNumPartitions()
    fan_in = math.isqrt(parts) if parts >= FAN_IN_PARTS else 1
    sizes = {(t, grp): k for t, task in enumerate(tasks) for grp, k in sorted(task.classes.items())}
    planned = plan_blocks(sizes, dict.fromkeys(range(len(tasks)), (dim + 1) * 8), MODEL_BYTES)
    cut = {r.key for block in planned for r in block if r.end - r.first < sizes[r.key]}
    found = []
    blocks = [block_col] if updates > 1 else []
    waves = [[r.key for r in block if r.key not in cut] for block in planned]
    waves = [wave for wave in waves if wave]
    for wave in waves:
        mine = sorted({t for t, _ in wave})
        some = [replace_classes(tasks[t], {g: sizes[t, g] for u, g in wave if u == t}) for t in mine]
        fits = {
            (i, grp): _Fit(task, np.zeros((k, dim + 1))) for i, task in enumerate(some) for grp, k in task.classes.items()
        }
        used = sorted({c for task in some for c in (task.label_col, task.group_col) if c})
        data = rows.select(x_col, *used, *blocks)
        if (len(waves) > 1 or cut) and all(task.group_col for task in some):
            keep = F.lit(False)
            for task in some:
                keep = keep | F.col(task.group_col).between(min(task.classes), max(task.classes))
            data = data.where(keep)
        if blocks:
            data = data.sortWithinPartitions(block_col)  # the cache skips the other blocks' batches
        # read from shared storage once; lost blocks are read again
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            _epochs(data, x_col, some, fits, fan_in, updates, block_col, tolerance, after_pass)
        finally:
            data.unpersist()
        trained = {(some[i].name, grp): (f.w[:, :-1], f.w[:, -1]) for (i, grp), f in fits.items()}
        found.append(stage_table(weights_rows(spark, trained), "weights"))
    for t, grp in sorted(cut):
        task = tasks[t]
        data = rows.where(F.col(task.label_col).isNotNull())
        if task.group_col:
            data = data.where(F.col(task.group_col) == grp)
        ranges = [r for block in planned for r in block if r.key == (t, grp)]
        data = data.select(x_col, task.label_col, *blocks)
        state = _fit_in_class_blocks(data, x_col, dim, task, ranges, fan_in, updates, block_col, tolerance)
        found.append(
            state.select(
                F.lit(task.name).alias("name"), F.lit(grp).alias("grp"), "class_idx",
                F.slice("w", 1, dim).alias("weights"), F.col("w")[dim].alias("bias"),
            )
        )
    union = found[0] if found else spark.createDataFrame([], _FITTED)
    for part in found[1:]:
        union = union.unionByName(part)
    return Fitted(union, dim, {(tasks[t].name, grp): n for (t, grp), n in sizes.items()})


def replace_classes(task: LinearTask, classes: dict[int, int]) -> LinearTask:
    return LinearTask(task.name, task.label_col, classes, task.group_col, task.epochs, task.lr, task.weight_decay)


# --- scoring ---------------------------------------------------------------------


def _group_scores(weights: dict[int, Weights], x: pa.Array, grp: pa.Array, finish) -> pa.Array:
    """Applies each row's model; null without vector or model."""
    g = grp.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    has_x = x.is_valid().to_numpy(zero_copy_only=False)
    width = np.zeros(len(x), np.int64)
    groups = [int(v) for v in np.unique(g[has_x]) if int(v) in weights]
    blocks = []
    for v in groups:
        pick = np.flatnonzero(has_x & (g == v))
        w, b = weights[v]
        blocks.append((pick, finish(logits(x.take(pa.array(pick)), w, b))))
        width[pick] = len(b)
    starts = np.concatenate([[0], np.cumsum(width)])
    flat = np.zeros(starts[-1])
    for pick, z in blocks:
        flat[(starts[pick][:, None] + np.arange(z.shape[1])).reshape(-1)] = z.reshape(-1)
    return pa.ListArray.from_arrays(
        pa.array(starts.astype(np.int32)), pa.array(flat), mask=pa.array(width == 0)
    )


def _score_udf(df: DataFrame, weights: dict[int, Weights], finish):
    shared = df.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("array<double>")
    def score(x: pa.Array, grp: pa.Array) -> pa.Array:
        return _group_scores(shared.value, x, grp, finish)

    return score


def _scored_whole(df: DataFrame, weights: dict[int, Weights], key: Column, out: str, finish) -> DataFrame:
    """One group whose classes need several broadcasts: their logits in one array."""
    (grp, (w, b)), parts = next(iter(weights.items())), []
    most = max(1, MODEL_BYTES // (8 * (w.shape[1] + 1)))
    for at in range(0, len(b), most):
        part = {grp: (w[at : at + most], b[at : at + most])}
        parts.append(_score_udf(df, part, _same)(F.col("x"), key))
    scored = df.withColumn(out, F.concat(*parts))
    if finish is softmax:
        powers = F.transform(F.col(out), lambda z: F.exp(z - F.col("__by")))
        scored = scored.withColumn("__by", F.array_max(out)).withColumn(out, powers)
        scored = scored.withColumn("__by", F.aggregate(F.col(out), F.lit(0.0), lambda a, z: a + z))
        scored = scored.withColumn(out, F.transform(F.col(out), lambda z: z / F.col("__by"))).drop("__by")
    return scored


def _by_chunks(df: DataFrame, weights: dict[int, Weights], group: str | None, out: str, finish) -> DataFrame:
    """One broadcast for a model of checked size; larger families of groups
    are scored in chunks that each fit, one branch of a union per chunk."""
    key = F.col(group) if group else F.lit(0)
    chunks: list[dict[int, Weights]] = [{}]
    free = MODEL_BYTES
    for grp, (w, b) in sorted(weights.items()):
        if w.nbytes + b.nbytes > free and chunks[-1]:
            chunks.append({})
            free = MODEL_BYTES
        free -= w.nbytes + b.nbytes
        chunks[-1][grp] = (w, b)

    def scored(part: DataFrame, chunk: dict[int, Weights]) -> DataFrame:
        if sum(w.nbytes + b.nbytes for w, b in chunk.values()) > MODEL_BYTES:
            return _scored_whole(part, chunk, key, out, finish)
        return part.withColumn(out, _score_udf(part, chunk, finish)(F.col("x"), key))

    parts, lows = [], [min(c, default=0) for c in chunks]
    for i, chunk in enumerate(chunks):
        if len(chunks) == 1:
            return scored(df, chunk)
        mine = F.coalesce(key, F.lit(-1))
        inside = mine >= lows[i] if i else F.lit(True)
        if i + 1 < len(chunks):
            inside = inside & (mine < lows[i + 1])
        parts.append(scored(df.where(inside), chunk))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def _same(z: np.ndarray) -> np.ndarray:
    return z


def linear_scores(
    df: DataFrame, weights: dict[int, Weights], group: str | None = None, out: str = "scores"
) -> DataFrame:
    """Adds the logits of vector column ``x``; array index = class."""
    return _by_chunks(df, weights, group, out, _same)


def softmax_proba(
    df: DataFrame, weights: dict[int, Weights], group: str | None = None, out: str = "proba"
) -> DataFrame:
    """Adds class probabilities of vector column ``x``; array index = class."""
    return _by_chunks(df, weights, group, out, softmax)


def centroid_weights(df: DataFrame, label: str, group: str | None = None) -> dict[int, Weights]:
    """Nearest-centroid model in linear form: class mean and −½‖mean‖²."""
    keys = [F.lit(0).alias("__g") if group is None else F.col(group).alias("__g"), F.col(label).alias("__y")]
    means = (
        df.select(*keys, array_to_vector(F.col("x")).alias("__x"))
        .groupBy("__g", "__y")
        .agg(vector_to_array(Summarizer.mean(F.col("__x"))).alias("mean"))
        .orderBy("__g", "__y")
        .toArrow()
    )
    result: dict[int, Weights] = {}
    g = np.asarray(means.column("__g").to_pylist())
    mean = np.asarray(means.column("mean").to_pylist(), dtype=np.float64)
    for v in np.unique(g):
        w = mean[g == v]
        result[int(v)] = (w, -0.5 * (w * w).sum(axis=1))
    return result


def best_classes(rows: DataFrame, fitted: Fitted, name: str, group: str | None, k: int) -> DataFrame:
    """Adds ``best``, the k best ``(class_idx, proba)`` of family ``name``, of any size.

    The classes come in blocks, one broadcast at a time; partial results of a row are merged.
    """
    spark = rows.sparkSession
    staged = stage_table(rows.withColumn("__row", F.monotonically_increasing_id()), "rows-to-score")
    key = (F.col(group) if group else F.lit(0)).cast("string")
    asked = staged.where(F.col("x").isNotNull() & key.isNotNull()).select(
        "__row", F.lit(0).alias("__pos"), F.lit(name).alias("__model"), key.alias("__category"), "x", F.lit(k).alias("__k")
    )
    sizes = {(name, str(g)): n for (task, g), n in fitted.classes.items() if task == name}
    found = None
    for block in plan_blocks(sizes, {name: (fitted.dim + 1) * 8}, MODEL_BYTES):
        wanted = spark.createDataFrame([(name, int(r.key[1]), r.first, r.end) for r in block], "name string, grp int, first int, end int")
        mine = fitted.rows.join(F.broadcast(wanted), ["name", "grp"]).where("class_idx >= first and class_idx < end")
        part = Fitted(mine.select("name", "grp", "class_idx", "weights", "bias"), fitted.dim, {}).load()
        none = lambda b: [None] * len(b)
        pieces = [
            (r.key, Piece(r.first, (w, b), none(b), none(b), none(b))) for r in block for w, b in [part[name, int(r.key[1])]]
        ]
        shared = spark.sparkContext.broadcast(pieces)
        try:
            one = stage_table(partial_scores(asked, "x", shared), "partial-scores")
        finally:
            shared.destroy()
        found = one if found is None else found.unionByName(one)
    best = F.transform("best", lambda b: F.struct(b["class_idx"].alias("class_idx"), b["proba"].alias("proba")))
    merged = merged_scores(found, asked).select("__row", best.alias("best"))
    return staged.join(merged, "__row", "left").drop("__row")
