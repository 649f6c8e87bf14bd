"""Hyper-parameter search for the router, as a tournament.

Every trial is one more model of the same training passes over one training
table: texts are embedded once and rows are never multiplied. After some passes
the worse part of the trials stops. The parameters of the configuration are trial 0, which
always runs to its end, so the best finished trial is never worse than they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelway.config import HierConfig
from labelway.functions.vectors import logits
from labelway.operators import linear
from labelway.plans import hierarchy
from labelway.sources.model_store import ModelTables


@dataclass(frozen=True)
class TuneSpace:
    """Log-uniform learning rate and uniform whole epochs, both ends included."""

    lr_low: float = 5e-3
    lr_high: float = 0.5
    epochs_low: int = 10
    epochs_high: int = 80


def _uniform(seed: int, trial: Column, name: str) -> Column:
    """A number in [0, 1) from a hash of seed, trial and parameter name."""
    text = F.concat(F.lit(f"{seed}|"), trial.cast("string"), F.lit(f"|{name}"))
    head = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10)
    return head.cast("bigint") / float(1 << 32)


def trial_table(
    spark: SparkSession, n_trials: int, seed: int, cfg: HierConfig, space: TuneSpace = TuneSpace()
) -> DataFrame:
    """(trial, router_lr, router_epochs, head_lr, head_epochs): trial 0 is ``cfg``, the others are a
    seeded random search; the score never sees the heads, so their parameters are constant."""
    trial, given = F.col("id"), F.col("id") == 0
    low, high = math.log(space.lr_low), math.log(space.lr_high)
    span = space.epochs_high - space.epochs_low + 1
    return spark.range(n_trials).select(
        trial.cast("int").alias("trial"),
        F.when(given, F.lit(cfg.router_lr))
        .otherwise(F.exp(F.lit(low) + _uniform(seed, trial, "router_lr") * (high - low)))
        .alias("router_lr"),
        F.when(given, F.lit(cfg.router_epochs))
        .otherwise(space.epochs_low + F.floor(_uniform(seed, trial, "router_epochs") * span))
        .cast("int")
        .alias("router_epochs"),
        F.lit(cfg.head_lr).alias("head_lr"),
        F.lit(cfg.head_epochs).alias("head_epochs"),
    )


def best_trial(trials: DataFrame, score: str = "score") -> DataFrame:
    """The trial of the highest score, lowest number on ties."""
    columns = [c for c in trials.columns if c != "trial"]
    order = F.struct(F.col(score), (-F.col("trial")).alias("first"))
    row = F.struct("trial", *columns)
    return trials.agg(F.max_by(row, order).alias("best")).select("best.*")


def trial_scores(held: DataFrame, label: str, weights: list[linear.Weights]) -> DataFrame:
    """(trial, score): top-1 accuracy of each model on the same rows; the models fit one broadcast.

    One projection gives the best class of every model as an array; only that
    array is unfolded, and counted before the shuffle.
    """
    shared = held.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def best_per_model(x: pa.Array) -> pa.Array:
        best = [np.argmax(logits(x, w, b), axis=1) for w, b in shared.value]
        flat = np.stack(best, axis=1).astype(np.int32)
        offsets = np.arange(0, flat.size + 1, len(shared.value), dtype=np.int32)
        return pa.ListArray.from_arrays(offsets, flat.reshape(-1))

    return (
        held.select(F.col(label), F.posexplode(best_per_model(F.col("x"))).alias("trial", "best"))
        .groupBy("trial")
        .agg((F.count_if(F.col("best") == F.col(label)) / F.count(F.lit(1))).alias("score"))
    )


def _scores(held: DataFrame, label: str, fitted: linear.Fitted, names: list[str]) -> dict[str, float]:
    """Top-1 accuracy by trial: as many trials at a time as fit one broadcast, a larger one by blocks."""
    found, chunk = {}, []

    def close() -> None:
        if chunk:
            weights = fitted.load(*chunk)
            scores = trial_scores(held, label, [weights[name, 0] for name in chunk]).collect()
            found.update({chunk[r["trial"]]: r["score"] for r in scores})
            chunk.clear()

    for name in names:
        if fitted.nbytes(name) > linear.MODEL_BYTES:
            best = linear.best_classes(held, fitted, name, None, 1)
            hit = F.col("best")[0]["class_idx"] == F.col(label)
            found[name] = best.agg(F.count_if(hit) / F.greatest(F.lit(1), F.count(F.lit(1)))).first()[0]
            continue
        if sum(map(fitted.nbytes, [*chunk, name])) > linear.MODEL_BYTES:
            close()
        chunk.append(name)
    close()
    return found


def run_trials(
    data: hierarchy.TrainingSet,
    cfg: HierConfig,
    n_trials: int,
    seed: int = 42,
    space: TuneSpace = TuneSpace(),
    rungs: tuple[int, ...] | None = None,
    keep: float = 0.5,
) -> DataFrame:
    """The trial table with the router's validation top-1 as ``score`` and whether it ``finished``.

    After each number of passes in ``rungs`` (a quarter and a half of the most a trial has)
    the best ``keep`` of the trials trained together go on, ties by number, and trial 0 anyway. A stopped
    trial keeps its score of that time.
    """
    spark = data.rows.sparkSession
    trials = trial_table(spark, n_trials, seed, cfg, space)
    tasks = [
        hierarchy.router_task(data, str(t["trial"]), t["router_epochs"], t["router_lr"], cfg.weight_decay)
        for t in trials.orderBy("trial").toLocalIterator()
    ]
    longest = max(task.epochs for task in tasks)
    rungs = (longest // 4, longest // 2) if rungs is None else rungs
    rows = hierarchy.train_rows(data, cfg.updates).where("y_router is not null")
    held = data.rows.where(F.col("router_split").isin("val", "both")).select("x", "cat_idx")
    stopped: dict[str, float] = {}

    def prune(passes: int, models: dict[str, linear.Weights]) -> list[str]:
        """Names of the trials that stop now."""
        if passes not in rungs:
            return []
        names = [name for name in models if name not in stopped]
        scores = trial_scores(held, "cat_idx", [models[name] for name in names]).collect()
        score = {names[r["trial"]]: r["score"] for r in scores}
        order = sorted(names, key=lambda name: (-score.get(name, 0.0), int(name)))
        out = [name for name in order[math.ceil(keep * len(names)) :] if name != "0"]
        stopped.update({name: score.get(name, 0.0) for name in out})
        return out

    fitted = linear.softmax_fit(
        rows, "x", data.dim, tasks, cfg.updates, "block", cfg.tolerance, after_pass=prune
    )
    left = [task.name for task in tasks if task.name not in stopped]
    scores = {**stopped, **_scores(held, "cat_idx", fitted, left)}
    found = spark.createDataFrame(
        [(int(name), float(score), name not in stopped) for name, score in scores.items()],
        "trial int, score double, finished boolean",
    )
    joined = trials.join(F.broadcast(found), "trial", "left")  # one row per trial
    return joined.withColumns({"score": F.coalesce("score", F.lit(0.0)), "finished": F.coalesce("finished", F.lit(True))})


def tune_hierarchy(
    rows: DataFrame,
    cfg: HierConfig,
    n_trials: int = 20,
    seed: int = 42,
    space: TuneSpace = TuneSpace(),
    encoder=None,
) -> tuple[DataFrame, ModelTables]:
    """Search, then train router and heads with the best trial's parameters."""
    prepared = hierarchy.prepare_rows(rows, cfg)
    encoder, embedded = hierarchy.embed_rows(prepared, cfg, encoder)
    data = hierarchy.build_training_set(embedded, F.col("x"), encoder.dim, cfg)
    trials = hierarchy.stage_table(run_trials(data, cfg, n_trials, seed, space), "trials")
    best = best_trial(trials.where("finished")).first()
    final = replace(cfg, router_lr=best["router_lr"], router_epochs=best["router_epochs"])
    return trials, hierarchy.model_tables(data, hierarchy.fit_weights(data, final), final, encoder)
