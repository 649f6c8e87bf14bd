import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from labelway.functions.arrays import best_class, class_rank, top_classes
from labelway.operators import linear, metrics

DIM = 6


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def brute_fit(x, y, k, epochs, lr, wd=1e-4):
    x = np.hstack([x, np.ones((len(x), 1))])
    w, m, v = (np.zeros((k, x.shape[1])) for _ in range(3))
    hot = np.eye(k)[y]
    for t in range(epochs):
        g = (softmax(x @ w.T) - hot).T @ x / len(x)
        rate = lr / 2 * (1 + math.cos(math.pi * t / epochs))
        w = w * (1 - rate * wd)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w - rate * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(v / (1 - 0.999 ** (t + 1))) + 1e-8)
    return w[:, :-1], w[:, -1]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    grp = np.where(np.arange(600) % 3 > 0, 0, 1 + np.arange(600) % 4)  # group 0 is hot
    sizes = {g: 2 + g for g in range(5)}
    y = np.array([rng.integers(sizes[g]) for g in grp])
    x = (rng.normal(size=(600, DIM)) + y[:, None] * np.linspace(-1, 1, DIM)).astype(np.float32).astype(float)
    rows = [(i, int(grp[i]), int(y[i]), x[i].tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, grp int, y int, x array<double>")
    return df.repartition(4, "row_id").cache(), grp, y, x, sizes


def packed(df):
    return df.withColumn("x", linear.pack_vectors(F.col("x")))


def test_all_groups_in_shared_passes(data):
    df, grp, y, x, sizes = data
    tasks = [
        linear.LinearTask("all", "y", {0: 6}, None, epochs=6, lr=0.05),
        linear.LinearTask("each", "y", sizes, "grp", epochs=4, lr=0.1, weight_decay=1e-2),
    ]
    fitted = linear.softmax_fit(packed(df), "x", DIM, tasks).load()
    assert len(fitted) == 6
    for key, (w, b) in fitted.items():
        mine = grp == key[1] if key[0] == "each" else np.full(len(grp), True)
        args = (sizes[key[1]], 4, 0.1, 1e-2) if key[0] == "each" else (6, 6, 0.05)
        want_w, want_b = brute_fit(x[mine], y[mine], *args)
        np.testing.assert_allclose(w, want_w, atol=1e-10)
        np.testing.assert_allclose(b, want_b, atol=1e-10)


def test_waves_and_two_stage_sums_change_nothing(data, monkeypatch):
    df, _, _, _, sizes = data
    tasks = [
        linear.LinearTask("all", "y", {0: 6}, None, epochs=2),
        linear.LinearTask("each", "y", sizes, "grp", epochs=3),
    ]
    want = linear.softmax_fit(packed(df), "x", DIM, tasks).load()
    monkeypatch.setattr(linear, "MODEL_BYTES", 6 * (DIM + 1) * 8)
    monkeypatch.setattr(linear, "FAN_IN_PARTS", 2)
    got = linear.softmax_fit(packed(df), "x", DIM, tasks).load()
    assert got.keys() == want.keys()
    for key in want:
        np.testing.assert_allclose(got[key][0], want[key][0], atol=1e-12)


@pytest.mark.parametrize("classes, updates", [(4, 1), (3, 2)])
def test_model_larger_than_a_block_of_weights(data, monkeypatch, classes, updates):
    """Class blocks that exchange log-normalisers train the same weights."""
    df, _, _, _, sizes = data
    df = packed(df).withColumn("block", linear.row_block(F.col("row_id"), updates))
    tasks = [
        linear.LinearTask("all", "y", {0: 6}, None, epochs=2),
        linear.LinearTask("each", "y", {g: sizes[g] for g in (0, 4)}, "grp", epochs=2),
    ]
    want = linear.softmax_fit(df, "x", DIM, tasks, updates, "block").load()
    held = []
    context = type(df.sparkSession.sparkContext)
    real = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: held.append(value) or real(self, value))
    monkeypatch.setattr(linear, "MODEL_BYTES", classes * (DIM + 1) * 8)
    fitted = linear.softmax_fit(df, "x", DIM, tasks, updates, "block")
    monkeypatch.undo()
    arrays = [w for v in held for w in (v.values() if isinstance(v, dict) else [v])]
    assert arrays and max(w.nbytes for w in arrays) <= classes * (DIM + 1) * 8
    got = fitted.load()
    assert got.keys() == want.keys() and fitted.classes == {("all", 0): 6, ("each", 0): 2, ("each", 4): 6}
    for key in want:
        np.testing.assert_allclose(got[key][0], want[key][0], atol=1e-10)
        np.testing.assert_allclose(got[key][1], want[key][1], atol=1e-10)


def test_best_classes_of_a_large_family(data, monkeypatch):
    df, _, _, _, sizes = data
    rng = np.random.default_rng(6)
    weights = {("f", g): (rng.normal(size=(k, DIM)), rng.normal(size=k)) for g, k in sizes.items()}
    spark = df.sparkSession
    fitted = linear.Fitted(linear.weights_rows(spark, weights), DIM, {key: len(b) for key, (_, b) in weights.items()})
    want = linear.softmax_proba(df, {g: w for (_, g), w in weights.items()}, "grp")
    want = {r["row_id"]: r["p"] for r in want.select("row_id", top_classes(F.col("proba"), 3).alias("p")).collect()}
    monkeypatch.setattr(linear, "MODEL_BYTES", 4 * (DIM + 1) * 8)
    got = linear.best_classes(df, fitted, "f", "grp", 3).collect()
    assert len(got) == 600
    for r in got:
        assert [b["class_idx"] for b in r["best"]] == [b["class_idx"] for b in want[r["row_id"]]]
        np.testing.assert_allclose([b["proba"] for b in r["best"]], [b["proba"] for b in want[r["row_id"]]], rtol=1e-9)


def sparse(df):
    """The same vectors with zeros, sparse and dense."""
    kept = F.transform("x", lambda v, i: F.when((i + F.col("row_id")) % 3 == 0, v).otherwise(0.0))
    df = df.withColumn("x", kept)
    entries = F.filter(F.transform("x", lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: e["v"] != 0)
    pair = F.struct(entries["i"].alias("indices"), entries["v"].cast("array<float>").alias("values"))
    return df.withColumn("s", pair)


def test_sparse_rows_train_and_score_the_same(data):
    df, _, _, _, sizes = data
    df = sparse(df)
    tasks = [
        linear.LinearTask("all", "y", {0: 6}, None, epochs=3),
        linear.LinearTask("each", "y", sizes, "grp", epochs=3),
    ]
    want = linear.softmax_fit(packed(df.drop("s")), "x", DIM, tasks).load()
    rows = df.withColumn("x", linear.pack_sparse(F.col("s")))
    got = linear.softmax_fit(rows, "x", DIM, tasks).load()
    for key in want:
        np.testing.assert_allclose(got[key][0], want[key][0], atol=1e-10)
    weights = {g: want["each", g] for g in sizes}
    a = {r["row_id"]: r["proba"] for r in linear.softmax_proba(packed(df.drop("s")), weights, "grp").collect()}
    b = {r["row_id"]: r["proba"] for r in linear.softmax_proba(rows, weights, "grp").collect()}
    for k in a:
        np.testing.assert_allclose(a[k], b[k], atol=1e-9)


def test_bytes_of_a_sparse_row(spark):
    entries = [([3, 70, 900], [0.5, 0.25, 2.0]), ([], []), (None, None)]
    df = spark.createDataFrame([(e if e[0] is not None else None,) for e in entries], "s struct<indices:array<int>,values:array<float>>")
    rows = df.select(linear.pack_sparse(F.col("s")).alias("p")).collect()
    assert [r["p"] and len(r["p"]["i"]) + len(r["p"]["v"]) for r in rows] == [24, 0, None]
    assert np.frombuffer(rows[0]["p"]["i"], "<i4").tolist() == [3, 70, 900]


def test_steps_on_row_blocks_need_fewer_passes(data):
    df, _, y, x, _ = data
    blocks = packed(df).withColumn("block", linear.row_block(F.col("row_id"), 4))

    def accuracy(fitted):
        w, b = fitted.load()["t", 0]
        return ((x @ w.T + b).argmax(axis=1) == y).mean()

    whole = accuracy(linear.softmax_fit(blocks, "x", DIM, [linear.LinearTask("t", "y", {0: 6}, epochs=20, lr=0.1)]))
    some = accuracy(linear.softmax_fit(blocks, "x", DIM, [linear.LinearTask("t", "y", {0: 6}, epochs=5, lr=0.1)], 4, "block"))
    few = accuracy(linear.softmax_fit(blocks, "x", DIM, [linear.LinearTask("t", "y", {0: 6}, epochs=5, lr=0.1)]))
    assert some >= whole - 0.02 > few


def test_stops_when_converged(data, monkeypatch):
    df, *_ = data
    passes = []
    real = linear.gradient_sums
    monkeypatch.setattr(linear, "gradient_sums", lambda *a: passes.append(1) or real(*a))
    task = linear.LinearTask("t", "y", {0: 6}, epochs=40, lr=0.1)
    linear.softmax_fit(packed(df), "x", DIM, [task], tolerance=0.05)
    assert 1 < len(passes) < 20


def test_null_labels_do_not_train(data):
    df, _, y, x, _ = data
    half = df.withColumn("y", F.when(F.col("row_id") < 300, F.col("y")))
    w, _ = linear.softmax_fit(packed(half), "x", DIM, [linear.LinearTask("t", "y", {0: 6}, epochs=3)]).load()[("t", 0)]
    np.testing.assert_allclose(w, brute_fit(x[:300], y[:300], 6, 3, 0.05)[0], atol=1e-10)


def test_scores_and_probabilities(data, monkeypatch):
    df, grp, _, x, sizes = data
    rng = np.random.default_rng(1)
    weights = {g: (rng.normal(size=(k, DIM)), rng.normal(size=k)) for g, k in sizes.items() if g != 3}
    # a group without a model and a row without a vector get null
    df = df.withColumn("x", F.when(F.col("row_id") != 7, F.col("x")))

    def check():
        rows = linear.softmax_proba(linear.linear_scores(df, weights, "grp"), weights, "grp").collect()
        assert len(rows) == 600
        for r in rows:
            if r["grp"] == 3 or r["row_id"] == 7:
                assert r["scores"] is None and r["proba"] is None
                continue
            w, b = weights[r["grp"]]
            z = w @ x[r["row_id"]] + b
            np.testing.assert_allclose(r["scores"], z, atol=1e-9)
            np.testing.assert_allclose(r["proba"], softmax(z[None])[0], atol=1e-12)
            assert abs(sum(r["proba"]) - 1) < 1e-9

    check()
    monkeypatch.setattr(linear, "MODEL_BYTES", 6 * (DIM + 1) * 8)  # forces chunks
    check()


def test_packed_vectors_score_the_same(data):
    df, _, _, _, sizes = data
    weights = {0: (np.ones((3, DIM)), np.zeros(3))}
    a = {r["row_id"]: r["scores"] for r in linear.linear_scores(df, weights).collect()}
    b = {r["row_id"]: r["scores"] for r in linear.linear_scores(packed(df), weights).collect()}
    assert a.keys() == b.keys()
    for k in a:
        np.testing.assert_allclose(a[k], b[k], atol=1e-9)


def test_array_functions(spark):
    rows = [([0.2, 0.5, 0.3],), ([0.4, 0.2, 0.4],), ([1.0],)]
    df = spark.createDataFrame(rows, "p array<double>")
    got = df.select(
        best_class(F.col("p")).alias("best"),
        F.transform(top_classes(F.col("p"), 2), lambda s: s["class_idx"]).alias("top"),
        class_rank(F.col("p"), F.lit(0)).alias("rank0"),
    ).collect()
    assert [tuple(r) for r in got] == [(1, [1, 2], 2), (0, [0, 2], 0), (0, [0], 0)]


def test_accuracy(spark):
    rows = [([0.1, 0.9], 1), ([0.5, 0.5], 1), ([0.8, 0.2], 0)]
    df = spark.createDataFrame(rows, "p array<double>, y int")
    assert metrics.topk_accuracy(df, "p", "y", 3).first().asDict() == {
        "n_rows": 3, "top1_acc": 2 / 3, "top3_acc": 1.0,
    }
    assert metrics.topk_accuracy(df.where("false"), "p", "y", 1).first()["top1_acc"] == 0.0


def test_converges_to_the_mllib_optimum(spark):
    """Overlapping classes: the optimum has moderate weights."""
    rng = np.random.default_rng(11)
    y = rng.integers(3, size=500)
    x = (rng.normal(size=(500, DIM)) + 0.7 * np.eye(3, DIM)[y]).astype(np.float32).astype(float)
    rows = [(int(c), v.tolist()) for c, v in zip(y, x)]
    df = spark.createDataFrame(rows, "y int, x array<double>").repartition(4).cache()
    task = linear.LinearTask("t", "y", {0: 3}, epochs=80, lr=0.1, weight_decay=0.0)
    w, b = linear.softmax_fit(packed(df), "x", DIM, [task]).load()[("t", 0)]
    vec = df.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))
    model = LogisticRegression(family="multinomial", maxIter=200).fit(vec)
    theirs = x @ model.coefficientMatrix.toArray().T + model.interceptVector.toArray()
    np.testing.assert_allclose(softmax(x @ w.T + b), softmax(theirs), atol=0.02)


def test_pack_keeps_null_vectors_and_refuses_other_lengths(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [3.0, 4.0])], "id int, x array<double>").coalesce(1)
    packed = {r["id"]: r["p"] for r in rows.select("id", linear.pack_vectors(F.col("x")).alias("p")).collect()}
    assert packed[1] is None
    assert np.frombuffer(packed[0], "<f4").tolist() == [1, 2] and np.frombuffer(packed[2], "<f4").tolist() == [3, 4]
    ragged = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "x array<double>").coalesce(1)
    with pytest.raises(Exception, match="one length"):
        ragged.select(linear.pack_vectors(F.col("x"))).collect()
