"""Models in blocks of classes, and softmax results that merge across blocks.

A block holds consecutive classes of heads and is bounded in bytes, whatever a
model's size. Scoring rows with one block gives, per row, the greatest logit, the sum of
exponentials below it, and the best classes. These merge to the result of the whole model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelway.functions.vectors import logits

#: A head: a model, and a category of it (None for the router).
HeadKey = tuple


@dataclass(frozen=True)
class ClassRange:
    """Classes ``first`` to ``end - 1`` of a head."""

    key: HeadKey
    first: int
    end: int


@dataclass
class Piece:
    """Weights and label parts of a class range."""

    first: int
    weights: tuple[np.ndarray, np.ndarray]
    labels: list[str | None]
    issues: list[str | None]
    subs: list[str | None]


def plan_blocks(sizes: dict[HeadKey, int], row_bytes: dict, limit: int) -> list[list[ClassRange]]:
    """Class ranges of all heads in blocks of at most ``limit`` bytes, or of one class.

    A head that fits in a block is not cut.
    """
    blocks: list[list[ClassRange]] = []
    free = 0
    for key, n in sizes.items():
        size = row_bytes[key[0]]
        most, first = max(1, limit // size), 0
        while first < n:
            take = min(n - first, most)
            if take * size > free:
                blocks.append([])
                free = limit
            blocks[-1].append(ClassRange(key, first, first + take))
            free -= take * size
            first += take
    return blocks


def best_logits(z: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat (row, class) of the k[row] greatest logits, best first, ties by class."""
    k = np.clip(k, 1, z.shape[1])
    order = np.argsort(-z, axis=1, kind="stable")[:, : k.max(initial=1)]
    take = np.arange(order.shape[1])[None, :] < k[:, None]
    return np.repeat(np.arange(len(z)), k), order[take]


_TOP = pa.struct(
    [("z", pa.float64()), ("class_idx", pa.int32()), ("label", pa.string()), ("issue", pa.string()), ("sub", pa.string())]
)
_PARTIAL = (
    "__row long, __pos int, m double, s double,"
    " top array<struct<z:double,class_idx:int,label:string,issue:string,sub:string>>"
)


def _scored(piece: Piece, x: pa.Array, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(greatest logit, sum of exponentials, best classes) of each row."""
    w, b = piece.weights
    z = logits(x, w, b)
    m = z.max(axis=1)
    row, cls = best_logits(z, k)
    offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(z)))].astype(np.int32)
    pick = pa.array(cls)
    top = pa.StructArray.from_arrays(
        [
            pa.array(z[row, cls]),
            pa.array((cls + piece.first).astype(np.int32)),
            *[pa.array(v, pa.string()).take(pick) for v in (piece.labels, piece.issues, piece.subs)],
        ],
        fields=list(_TOP),
    )
    return m, np.exp(z - m[:, None]).sum(axis=1), pa.ListArray.from_arrays(pa.array(offsets), top)


def partial_scores(rows: DataFrame, x_col: str, shared: Broadcast) -> DataFrame:
    """(__row, __pos, m, s, top) of those ``rows`` (__row, __pos, model, category, x, k) whose
    head has classes in the block ``shared``, a list of (head key, piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = batch.column("__model").dictionary_encode()
            names = models.dictionary.to_pylist()
            cats = batch.column("__category").dictionary_encode()
            codes = {v: i for i, v in enumerate(cats.dictionary.to_pylist())}
            model = models.indices.to_numpy(zero_copy_only=False)
            category = cats.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            want = batch.column("__k").to_numpy(zero_copy_only=False)
            for (model_id, name), piece in shared.value:
                code = -1 if name is None else codes.get(name)
                if model_id not in names or code is None:
                    continue
                pick = np.flatnonzero((model == names.index(model_id)) & (category == code))
                if not len(pick):
                    continue
                at = pa.array(pick)
                m, s, top = _scored(piece, batch.column(x_col).take(at), want[pick])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__row").take(at), batch.column("__pos").take(at), pa.array(m), pa.array(s), top],
                    ["__row", "__pos", "m", "s", "top"],
                )

    use = rows.select("__row", "__pos", "__model", "__category", x_col, "__k")
    return use.mapInArrow(run, _PARTIAL)


def merged_scores(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(__row, __pos, best): the best classes over all blocks with their probabilities.

    ``wanted`` has (__row, __pos, __k). Blocks add up as sums relative to the greatest
    logit of all. One row gathers one short list per block of its head.
    """
    sums = parts.groupBy("__row", "__pos").agg(
        F.max("m").alias("m"),
        F.sort_array(F.collect_list(F.struct("m", "s"))).alias("sums"),
        F.flatten(F.collect_list("top")).alias("top"),
    )
    total = F.aggregate("sums", F.lit(0.0), lambda a, e: a + e["s"] * F.exp(e["m"] - F.col("m")))
    keyed = F.transform(
        "top", lambda t: F.struct((F.lit(0.0) - t["z"]).alias("neg"), t["class_idx"].alias("class_idx"), t.alias("t"))
    )  # best first, ties by class
    best = F.slice(F.array_sort(keyed), F.lit(1), F.col("__k").cast("int"))
    scored = sums.join(wanted.select("__row", "__pos", "__k"), ["__row", "__pos"]).select(
        "__row", "__pos", "m", total.alias("total"), best.alias("best")
    )
    return scored.select(
        "__row",
        "__pos",
        F.transform(
            "best",
            lambda e: F.struct(
                e["class_idx"].alias("class_idx"),
                e["t"]["label"].alias("label"),
                e["t"]["issue"].alias("issue"),
                e["t"]["sub"].alias("sub"),
                (F.exp(e["t"]["z"] - F.col("m")) / F.col("total")).alias("proba"),
            ),
        ).alias("best"),
    )
