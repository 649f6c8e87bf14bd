"""Scoring requests, in batch or as a stream.

With models that fit one broadcast all steps are narrow: validation, cleaning,
encoding and prediction keep no state and move no rows, so the same plan runs on
both. ``serve_stream`` answers a stream batch by batch instead, with models of any
size and with those that were saved after it started.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelway.config import PREDICTIONS_TYPE
from labelway.functions.text import clean_text
from labelway.operators import linear
from labelway.operators.embedding import HashedTfIdf
from labelway.operators.predict import hier_predict
from labelway.operators.requests import validate_requests
from labelway.sources.model_store import HierModel, StoredModel, load_model, newest_versions, open_tables

Model = HierModel | StoredModel


def encoder_of(model: Model, encoders: dict | None = None):
    """The encoder a model was trained with; fails if it is not the same one."""
    encoder = (encoders or {}).get(model.encoder_id)
    if encoder is None and model.encoder_weights is not None:
        encoder = HashedTfIdf(model.encoder_weights)
    if encoder is None or encoder.encoder_id != model.encoder_id:
        raise ValueError(f"encoder {model.encoder_id} of model {model.model_id} is not available")
    return encoder


def score_requests(
    requests: DataFrame,
    models: list[Model],
    default_model: str,
    encoders: dict | None = None,
    value: str = "value",
) -> DataFrame:
    """Adds status, error and the JSON response to payload rows.

    Models that share an encoder are served by one projection; each further
    encoder adds one.
    """
    ids = [m.model_id for m in models]
    keep = [c for c in requests.columns if c != value]
    df = validate_requests(requests, ids, default_model, value)
    df = df.withColumn("__text", clean_text(F.col("text"))).withColumn(
        "predictions", F.lit(None).cast(PREDICTIONS_TYPE)
    )
    families: dict[str, list[Model]] = {}
    for model in models:
        families.setdefault(model.encoder_id, []).append(model)
    for at, family in enumerate(families.values(), 1):
        encoder = encoder_of(family[0], encoders)
        mine = F.col("model_id").isin([m.model_id for m in family])
        encode = getattr(encoder, "encode_packed", encoder.encode)
        df = encode(df, "__text", "__vec").withColumn("__x", F.when(mine, F.col("__vec")))
        # after the last encoder no step needs the texts
        texts = ("text", "__text") if at == len(families) else ()
        df = hier_predict(df, family, "__x", out="__found", drop=("__vec", "__x", *(c for c in texts if c not in keep)))
        df = df.withColumn("predictions", F.coalesce("__found", "predictions")).drop("__found")
    names = F.create_map(*[F.lit(v) for m in models for v in (m.model_id, m.encoder_id)]).cast("map<string,string>")
    answer = F.struct(
        F.col("model_id").alias("art_dir"),
        F.col("device").alias("device_requested"),
        F.lit("cpu").alias("device_effective"),
        names[F.col("model_id")].alias("st_model_name"),
        F.col("topk_cat").alias("router_topk"),
        F.col("topk_sub").alias("sub_topk"),
        "predictions",
    )
    # null fields are written out, as issue and subissue can be null
    keep_null = {"ignoreNullFields": "false"}
    response = F.when(F.col("status") == 200, F.to_json(answer, keep_null)).otherwise(
        F.to_json(F.struct("error"), keep_null)
    )
    return df.select(*keep, "status", "error", "predictions", response.alias("response"))


def write_scored(scored: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """One file sink, a folder per status; exactly once by the sink's log."""
    return (
        scored.writeStream.format("parquet")
        .partitionBy("status")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def route_scored(
    scored: DataFrame, ok_path: str, error_path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Two sinks: answers, and rejected requests with status and message.

    A batch that is run again replaces its own folders, so a restart neither
    loses nor doubles rows.
    """
    return (
        scored.writeStream.foreachBatch(_two_sinks(ok_path, error_path))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _two_sinks(ok_path: str, error_path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for path, rows in (
                (ok_path, batch.where("status = 200").drop("error")),
                (error_path, batch.where("status <> 200").drop("predictions")),
            ):
                rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return write


def pinned_versions(spark: SparkSession, root: str, path: str) -> dict[str, int]:
    """The model versions a batch answers with: the newest complete ones when it first ran.

    They are written under ``path`` before anything is scored; a repeated batch reads them.
    """
    schema = "model_id string, version long"
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        newest = list(newest_versions(spark, root).items())
        spark.createDataFrame(newest, schema).coalesce(1).write.mode("overwrite").parquet(path)
        found = spark.read.schema(schema).parquet(path)
    return {r["model_id"]: r["version"] for r in found.collect()}


class ModelCache:
    """Models by version. Those that fit ``MODEL_BYTES`` together are held in memory,
    the rest are served from their tables."""

    def __init__(self, root: str) -> None:
        self.root, self.held = root, {}

    def models(self, spark: SparkSession, versions: dict[str, int]) -> list[Model]:
        self.held = {key: m for key, m in self.held.items() if versions.get(key[0]) == key[1]}
        room = linear.MODEL_BYTES - sum(m.nbytes() for m in self.held.values() if isinstance(m, HierModel))
        for key in versions.items():
            if key not in self.held:
                model = load_model(open_tables(spark, self.root, *key), max(room, 0))
                self.held[key] = model
                room -= model.nbytes() if isinstance(model, HierModel) else 0
        return [self.held[key] for key in versions.items()]


def serve_stream(
    requests: DataFrame,
    root: str,
    default_model: str,
    ok_path: str,
    error_path: str,
    checkpoint: str,
    encoders: dict | None = None,
    value: str = "value",
    **trigger,
) -> StreamingQuery:
    """Answers a stream with the models saved under ``root``, whatever their size.

    Each batch looks for the newest complete versions, so models saved or
    replaced while the stream runs are served from the next batch on. A batch that is run again
    answers with the versions of its first run and replaces its own folders.
    Versions that ``prune_versions`` deletes must be older than any open batch.
    """
    cache = ModelCache(root)

    def answer(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = pinned_versions(spark, root, f"{checkpoint}/models/{batch_id}")
        scored = score_requests(batch, cache.models(spark, versions), default_model, encoders, value)
        _two_sinks(ok_path, error_path)(scored, batch_id)

    return (
        requests.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
