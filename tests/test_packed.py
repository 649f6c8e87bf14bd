"""Texts pass between Spark and Python as bytes of what they hold, never as whole vectors."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelway.config import HierConfig
from labelway.functions import vectors
from labelway.operators import linear
from labelway.operators.embedding import HashedTfIdf
from labelway.operators.predict import _predict
from labelway.plans import hierarchy
from labelway.sources.model_store import Head, HierModel
from labelway.streaming.requests import score_requests

TEXTS = ["b a  b", "ключ 한 b", " ", "", None, "a", "é a"]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "row_id int, text string")


def head(rng, labels, dim):
    none = [None] * len(labels)
    return Head((rng.normal(size=(len(labels), dim)), rng.normal(size=len(labels))), labels, none, none)


def test_packed_counts_fit_and_encode_alike(texts):
    counts = texts.select(
        "row_id", HashedTfIdf.slot_counts(F.col("text"), 32).alias("s"), HashedTfIdf.packed_counts(F.col("text"), 32).alias("p")
    )
    encoder = HashedTfIdf.fit(counts, "p", 32)
    assert encoder.weights == HashedTfIdf.fit(counts, "s", 32).weights
    assert [r["s"] is None for r in counts.collect()] == [r["p"] is None for r in counts.collect()]
    sparse = encoder.encode_sparse(texts, "text", "x").withColumn("x", linear.pack_sparse(F.col("x")))
    want = [r["x"] for r in sparse.orderBy("row_id").collect()]
    for df, col in ((texts, "text"), (counts, "s"), (counts, "p")):
        assert [r["x"] for r in encoder.encode_packed(df, col, "x").orderBy("row_id").collect()] == want
    assert encoder.encode_packed(texts.limit(0), "text", "x").count() == 0


def test_requests_are_scored_without_whole_vectors(spark, texts, monkeypatch):
    def whole(*_):
        raise AssertionError("a whole vector per request")

    rng, encoder = np.random.default_rng(0), HashedTfIdf.fit(texts, "text", 16)
    heads = {"x": head(rng, ["p", "q"], 16), "y": head(rng, ["r"], 16)}
    model = HierModel("m", encoder.encoder_id, encoder.weights, head(rng, ["x", "y"], 16), heads)
    requests = spark.createDataFrame([('{"text":"a ключ b"}',), ('{"text":"  "}',)], "value string")
    vector = encoder.encode(spark.createDataFrame([("a ключ b",)], "text string"), "text", "x").first()["x"]
    monkeypatch.setattr(HashedTfIdf, "encode", whole)
    rows = score_requests(requests, [model], "m").orderBy("status").collect()
    assert [r["status"] for r in rows] == [200, 400]
    w, b = model.router.weights
    z = np.exp(w @ np.asarray(vector) + b)
    got = {p["category"]: p["proba"] for p in rows[0]["predictions"]}
    np.testing.assert_allclose([got["x"], got["y"]], z / z.sum(), atol=1e-6)


def test_packed_vectors_predict_as_whole_ones():
    rng = np.random.default_rng(1)
    dense = np.where(rng.random((1200, 24)) < 0.1, rng.normal(size=(1200, 24)), 0).astype("<f4")
    row, index = np.nonzero(dense)
    lengths = np.bincount(row, minlength=len(dense))
    assert (lengths == 0).any()
    x = vectors.packed(index.astype("<i4"), dense[row, index], lengths, np.ones(len(dense), bool))
    model = HierModel("m", "e", None, head(rng, ["x", "y"], 24), {"x": head(rng, ["p", "q", "r"], 24)})
    k = rng.integers(1, 4, (2, len(dense)))
    lists = pa.FixedSizeListArray.from_arrays(pa.array(dense.reshape(-1)), 24).cast(pa.list_(pa.float32()))
    got, want = (_predict(model, v, *k).to_pylist() for v in (x, lists))
    assert len(got) == len(want) == 1200
    for g, w in zip(got, want):
        assert [[s["label"] for s in c["subissues"]] for c in g] == [[s["label"] for s in c["subissues"]] for c in w]
        np.testing.assert_allclose([c["proba"] for c in g], [c["proba"] for c in w])


def test_training_rows_fill_whole_rounds_of_tasks(spark, monkeypatch):
    rows = spark.range(600).select(
        F.col("id").alias("row_id"), F.concat(F.lit("c"), F.col("id") % 2).alias("category"),
        F.concat(F.lit("l"), F.col("id") % 3).alias("label"), F.lit("a b").alias("text"),
    )
    encoder = HashedTfIdf([1.0] * 8)
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(hierarchy, "PART_BYTES", 600 * 8 * 4 // (cores + 1))
    data = hierarchy.build_training_set(encoder.encode_packed(rows, "text", "x"), F.col("x"), 8, HierConfig())
    assert len(data.rows.inputFiles()) == 2 * cores
    assert len({(r["x"]["i"], r["x"]["v"]) for r in data.rows.collect()}) == 1 and data.rows.count() == 600


def test_columns_of_sparse_rows():
    for index in ([], [5, 2, 5, 0], [1 << 30, 3]):
        columns, place = vectors._columns(np.asarray(index, "<i4"))
        assert list(columns) == sorted(set(index)) and [columns[p] for p in place] == index
