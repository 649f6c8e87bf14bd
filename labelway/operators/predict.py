"""Hierarchical prediction: best categories, and best labels inside each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelway.config import PREDICTIONS_TYPE
from labelway.functions.vectors import chunks, softmax, to_matrix
from labelway.operators import linear
from labelway.operators.blocks import ClassRange, best_logits, merged_scores, partial_scores, plan_blocks
from labelway.operators.joins import BROADCAST_BYTES
from labelway.session import planned_bytes, stage_table
from labelway.sources.model_store import Head, HierModel, StoredModel

# Sparse vectors of one step of prediction.
SPARSE_ROWS = 512


def _best(z: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat (row, class, proba) of the k[row] best classes, best first, ties by class."""
    row, cls = best_logits(z, k)
    return row, cls, softmax(z)[row, cls]


def _strings(parts: list[tuple[Head, np.ndarray]], values: str, order: np.ndarray) -> pa.Array:
    if not parts:
        return pa.array([], pa.string())
    chunks = [pa.array(getattr(h, values), pa.string()).take(pa.array(c)) for h, c in parts]
    return pa.concat_arrays(chunks).take(pa.array(order))


def _offsets(owner: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)


def _predict(model: HierModel, x: pa.Array, k_cat: np.ndarray, k_sub: np.ndarray) -> pa.Array:
    """One list of category predictions per vector, packed sparse ones part by part."""
    if not pa.types.is_struct(x.type):
        return _predict_rows(model, to_matrix(x), slice(None), k_cat, k_sub)
    parts = chunks(x, SPARSE_ROWS)
    return pa.concat_arrays([_predict_rows(model, matrix, columns, k_cat[p], k_sub[p]) for p, columns, matrix in parts])


def _predict_rows(
    model: HierModel, x: np.ndarray, columns: np.ndarray | slice, k_cat: np.ndarray, k_sub: np.ndarray
) -> pa.Array:
    """``x`` holds the ``columns`` of the vectors, all others are 0."""
    w, b = model.router.weights
    row, cat, cat_p = _best(x @ w[:, columns].T + b, k_cat)
    owners, probas, parts = [], [], []
    for c in np.unique(cat):
        head = model.heads.get(model.router.labels[c])
        if head is None:
            continue
        pairs = np.flatnonzero(cat == c)
        hw, hb = head.weights
        own, cls, p = _best(x[row[pairs]] @ hw[:, columns].T + hb, k_sub[row[pairs]])
        owners.append(pairs[own])
        probas.append(p)
        parts.append((head, cls))
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    proba = np.concatenate(probas) if probas else np.zeros(0)
    order = np.argsort(owner, kind="stable")
    subs = pa.StructArray.from_arrays(
        [
            _strings(parts, "labels", order),
            _strings(parts, "issues", order),
            _strings(parts, "subs", order),
            pa.array(proba[order]),
        ],
        names=["label", "issue", "subissue_unique", "proba"],
    )
    sub_lists = pa.ListArray.from_arrays(pa.array(_offsets(owner, len(row))), subs)
    cats = pa.StructArray.from_arrays(
        [pa.array(model.router.labels, pa.string()).take(pa.array(cat)), pa.array(cat_p), sub_lists],
        names=["category", "proba", "subissues"],
    )
    return pa.ListArray.from_arrays(pa.array(_offsets(row, len(x))), cats)


def hier_predict(
    df: DataFrame,
    models: list[HierModel | StoredModel],
    x_col: str = "x",
    model_col: str = "model_id",
    k_cat: str = "topk_cat",
    k_sub: str = "topk_sub",
    out: str = "predictions",
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Adds nested predictions; null where the vector or the model is missing. The columns
    ``drop`` are left out, such as the vectors.

    Models in memory that fit ``MODEL_BYTES`` together are broadcast: a narrow
    step without shuffle or state, the same on batches and on streams. All
    others are served in blocks of their classes, see ``predict_by_blocks``.
    """
    loaded = all(isinstance(m, HierModel) for m in models)
    if not loaded or sum(m.nbytes() for m in models) > linear.MODEL_BYTES:
        if df.isStreaming:
            raise ValueError("models beyond MODEL_BYTES score a stream batch by batch: use serve_stream")
        return predict_by_blocks(df, models, x_col, model_col, k_cat, k_sub, out).drop(*drop)
    shared = df.sparkSession.sparkContext.broadcast({m.model_id: m for m in models})
    keep = [c for c in df.columns if c not in (out, *drop)]

    # a step of its own, not a function in a projection: Spark fails to extract Python
    # functions whose arguments hold lambdas, as encoders do
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [batch.column(c) for c in (x_col, model_col, "__kc", "__ks")]
            found = _predict_batch(shared.value, *asked)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], [*keep, out])

    kept = df.select(*keep).schema.fields
    predicted = T.StructField(out, T.DataType.fromDDL(PREDICTIONS_TYPE))
    needed = dict.fromkeys([*keep, x_col, model_col])
    limits = [_at_least_one(c, name) for c, name in ((k_cat, "__kc"), (k_sub, "__ks"))]
    return df.select(*needed, *limits).mapInArrow(run, T.StructType([*kept, predicted]))


def _predict_batch(models: dict[str, HierModel], x: pa.Array, model_id: pa.Array, kc: pa.Array, ks: pa.Array) -> pa.Array:
    names = model_id.dictionary_encode()
    code = {v: i for i, v in enumerate(names.dictionary.to_pylist())}
    ids = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    has_x = x.is_valid().to_numpy(zero_copy_only=False)
    want_c, want_s = (k.fill_null(1).to_numpy(zero_copy_only=False) for k in (kc, ks))
    found, picks = [], []
    for name, model in models.items():
        pick = np.flatnonzero(has_x & (ids == code.get(name, -2)))
        if len(pick) == len(x) and len(x):
            return _predict(model, x, want_c, want_s)
        if len(pick):
            found.append(_predict(model, x.take(pa.array(pick)), want_c[pick], want_s[pick]))
            picks.append(pick)
    if not found:
        return pa.nulls(len(x), _predict_type())
    where = np.full(len(x), -1, np.int64)
    where[np.concatenate(picks)] = np.arange(sum(len(p) for p in picks))
    return pa.concat_arrays(found).take(pa.array(where, mask=where < 0))


def _scored_by(rows: DataFrame, x_col: str, blocks: list[list[ClassRange]], models: dict, pruned: bool) -> DataFrame:
    """Partial results of all blocks. One block at a time is in the driver and in the
    workers; its rows are written before the next one comes."""
    sc = rows.sparkSession.sparkContext
    found = None
    for at, block in enumerate(blocks):
        mine = rows.where(F.col("__block") == at) if pruned else rows
        pieces = []
        for model_id in dict.fromkeys(r.key[0] for r in block):
            pieces += models[model_id].pieces([r for r in block if r.key[0] == model_id])
        shared = sc.broadcast(pieces)
        try:
            part = stage_table(partial_scores(mine, x_col, shared), "partial-scores")
        finally:
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def _at_least_one(k: str, name: str = "__k") -> Column:
    """A limit as a small number: no head has 2^30 classes."""
    return F.least(F.greatest(F.coalesce(F.col(k), F.lit(1)), F.lit(1)), F.lit(1 << 30)).cast("long").alias(name)


def predict_by_blocks(
    df: DataFrame,
    models: list[HierModel | StoredModel],
    x_col: str = "x",
    model_col: str = "model_id",
    k_cat: str = "topk_cat",
    k_sub: str = "topk_sub",
    out: str = "predictions",
    limit: int | None = None,
) -> DataFrame:
    """``hier_predict`` for models of any size, in blocks of ``limit`` bytes (``MODEL_BYTES``); batch only.

    Rows get a key of their own and are written once, so rows without a vector or
    model and repeated rows all come back. Every row meets each block of routers;
    each of its chosen categories meets the blocks of that head only. A head of
    more than one block is merged from partial results; what moves are the vectors of
    chosen categories and those results.
    """
    spark, limit = df.sparkSession, linear.MODEL_BYTES if limit is None else limit
    by_id = {m.model_id: m for m in models}
    row_bytes = {m.model_id: (m.dim + 1) * 8 for m in models}
    rows = stage_table(df.withColumn("__row", F.monotonically_increasing_id()), "asked")
    asked = rows.where(F.col(x_col).isNotNull() & F.col(model_col).isin(list(by_id))).select(
        "__row",
        F.lit(0).alias("__pos"),
        F.col(model_col).alias("__model"),
        F.lit(None).cast("string").alias("__category"),
        F.col(x_col).alias("__x"),
        _at_least_one(k_cat),
        _at_least_one(k_sub).alias("__ks"),
    )
    routers = {(m.model_id, None): m.sizes()[None] for m in models}
    blocks = plan_blocks(routers, row_bytes, limit)
    cats = merged_scores(_scored_by(asked, "__x", blocks, by_id, False), asked).select(
        "__row", F.posexplode("best").alias("__pos", "cat")
    )
    cats = stage_table(
        cats.select("__row", "__pos", F.col("cat.label").alias("__category"), F.col("cat.proba").alias("proba")), "chosen"
    )
    heads = {(m.model_id, c): n for m in models for c, n in m.sizes().items() if c is not None}
    no_subs = F.array().cast("array<struct<label:string,issue:string,subissue_unique:string,proba:double>>")
    if heads:
        blocks = plan_blocks(heads, row_bytes, limit)
        places = spark.createDataFrame(
            [(*r.key, at) for at, block in enumerate(blocks) for r in block], "__model string, __category string, __block int"
        )
        places = stage_table(places, "head-blocks")  # one row per head, or per block of a large one
        if planned_bytes(places) <= BROADCAST_BYTES:
            places = F.broadcast(places)
        chosen = asked.drop("__pos", "__category", "__k").withColumnRenamed("__ks", "__k")
        pairs = chosen.join(cats.drop("proba"), "__row").join(places, ["__model", "__category"])
        # sorted by block: each block's pass reads its own stretch, and parts stay equal
        pairs = stage_table(pairs.repartitionByRange("__block", "__row").sortWithinPartitions("__block"), "pairs")
        wanted = pairs.select("__row", "__pos", "__k").distinct()
        found = merged_scores(_scored_by(pairs, "__x", blocks, by_id, True), wanted)
        subs = F.transform(
            "best",
            lambda s: F.struct(s["label"].alias("label"), s["issue"].alias("issue"), s["sub"].alias("subissue_unique"), s["proba"].alias("proba")),
        )
        cats = cats.join(found.select("__row", "__pos", subs.alias("subs")), ["__row", "__pos"], "left")
    else:
        cats = cats.withColumn("subs", no_subs)
    one = F.struct(
        "__pos", F.struct(F.col("__category").alias("category"), "proba", F.coalesce("subs", no_subs).alias("subissues")).alias("c")
    )
    lists = cats.groupBy("__row").agg(F.sort_array(F.collect_list(one))["c"].cast(PREDICTIONS_TYPE).alias(out))
    return rows.drop(out).join(lists, "__row", "left").drop("__row")


def _predict_type() -> pa.DataType:
    sub = pa.struct(
        [("label", pa.string()), ("issue", pa.string()), ("subissue_unique", pa.string()), ("proba", pa.float64())]
    )
    return pa.list_(
        pa.struct([("category", pa.string()), ("proba", pa.float64()), ("subissues", pa.list_(sub))])
    )
