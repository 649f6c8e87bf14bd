import hashlib
import json
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelway.operators import embedding, linear, predict
from labelway.operators.blocks import plan_blocks
from labelway.operators.embedding import HashedTfIdf, PluginEncoder
from labelway.operators.predict import hier_predict
from labelway.operators.requests import (
    BAD_INT, BAD_JSON, BAD_TEXT, INF_INT, NAN_INT, NO_MODEL, NOT_INT, NOT_OBJECT, TOO_LONG, validate_requests,
)
from labelway.sources import model_store
from labelway.sources.model_store import Head, HierModel
from labelway.streaming.requests import route_scored, score_requests, serve_stream, write_scored

DIM = 8


def head(rng, labels):
    parts = [l.split("__SEP__", 1) if "__SEP__" in l else [None, None] for l in labels]
    return Head(
        (rng.normal(size=(len(labels), DIM)), rng.normal(size=len(labels))),
        labels, [p[0] for p in parts], [p[1] for p in parts],
    )


@pytest.fixture(scope="module")
def models():
    rng = np.random.default_rng(3)
    encoder = HashedTfIdf(np.linspace(0.5, 2, DIM))
    one = HierModel(
        "one", encoder.encoder_id, encoder.weights, head(rng, ["a", "b", "c"]),
        {"a": head(rng, ["i__SEP__x", "i__SEP__y", "j__SEP__z"]), "b": head(rng, ["__single__"])},
    )
    two = HierModel("two", encoder.encoder_id, encoder.weights, head(rng, ["p", "q"]), {})
    return [one, two]


CASES = [
    ('{"text":"x"}', 200, None, 2, 5),
    ('{"text":"x","topk_cat":"7"}', 200, None, 7, 5),
    ('{"text":"x","topk_cat":" +1_0 "}', 200, None, 10, 5),
    ('{"text":"x","topk_cat":2.7,"topk_sub":-2.7}', 200, None, 2, -2),
    ('{"text":"x","topk_cat":-3,"topk_sub":0}', 200, None, 1, 0),
    ('{"text":"x","topk_cat":true,"topk_sub":false}', 200, None, 1, 0),
    ('{"text":"x","topk_cat":1e1}', 200, None, 10, 5),
    ('{"text":"x","topk_cat":"99999999999999999999"}', 200, None, 99999999999999999999, 5),
    ('{"text":"x","topk_cat":99999999999999999999,"topk_sub":-12345678901234567890}', 200, None, 99999999999999999999, -12345678901234567890),
    ('{"text":"x","topk_cat":9223372036854775807,"topk_sub":"-0_9"}', 200, None, 9223372036854775807, -9),
    ('{"text":"x","topk_cat":1e20,"topk_sub":-1.2345678901234567e30}', 200, None, int(1e20), int(-1.2345678901234567e30)),
    ('{"text":"x","topk_cat":12345678901234567890.5,"topk_sub":9007199254740993.0}', 200, None, int(12345678901234567890.5), int(9007199254740993.0)),
    ('{"text":"x","topk_cat":1e37}', 200, None, int(1e37), 5),
    ('{"text":"NaN, -Infinity","topk_cat":3}', 200, None, 3, 5),
    ('{"text":"123"}', 200, None, 2, 5),
    ('{"text":"x","art_dir":null}', 200, None, 2, 5),
    ('{"text":"x","art_dir":""}', 200, None, 2, 5),
    ('{"text":"x","art_dir":0}', 200, None, 2, 5),
    ('{"text":"x","art_dir":false}', 200, None, 2, 5),
    ('{"text":"a","text":"b"}', 200, None, 2, 5),
    ("not a json", 400, BAD_JSON, None, None),
    ("", 400, BAD_JSON, None, None),
    (None, 400, BAD_JSON, None, None),
    ('"not a json"', 400, NOT_OBJECT, None, None),
    ("[1]", 400, NOT_OBJECT, None, None),
    ("null", 400, NOT_OBJECT, None, None),
    ("{}", 400, BAD_TEXT, None, None),
    ('{"text":""}', 400, BAD_TEXT, None, None),
    ('{"text":" \\u001c\\u00a0 "}', 400, BAD_TEXT, None, None),
    ('{"text":5}', 400, BAD_TEXT, None, None),
    ('{"text":null}', 400, BAD_TEXT, None, None),
    ('{"text":"","topk_cat":"zz"}', 400, BAD_TEXT, None, None),
    ('{"text":"x","topk_cat":"zz"}', 500, BAD_INT + "zz'", None, None),
    ('{"text":"x","topk_cat":"2.7"}', 500, BAD_INT + "2.7'", None, None),
    ('{"text":"x","topk_sub":null}', 500, NOT_INT.format("NoneType"), None, None),
    ('{"text":"x","topk_sub":[1]}', 500, NOT_INT.format("list"), None, None),
    ('{"text":"x","topk_cat":{},"topk_sub":"q"}', 500, NOT_INT.format("dict"), None, None),
    ('{"text":"x","art_dir":"nope","topk_sub":"q"}', 500, BAD_INT + "q'", None, None),
    ('{"text":"x","topk_cat":NaN}', 500, NAN_INT, None, None),
    ('{"text":"\\" NaN \\\\", "topk_sub" : -Infinity }', 500, INF_INT, None, None),
    ('{"text":"x","topk_sub":Infinity}', 500, INF_INT, None, None),
    ('{"text":"x","topk_sub":1e999}', 500, INF_INT, None, None),
    ('{"text":"x","topk_cat":1e50}', 500, TOO_LONG + "topk_cat", None, None),
    ('{"text":"x","topk_cat":"1' + "0" * 40 + '"}', 500, TOO_LONG + "topk_cat", None, None),
    ('{"text":NaN}', 400, BAD_TEXT, None, None),
    ('{"text":"x","art_dir":NaN}', 404, NO_MODEL + "nan", None, None),
    ('{"text":"x","art_dir":"nope"}', 404, NO_MODEL + "nope", None, None),
    ('{"text":"x","art_dir":5}', 404, NO_MODEL + "5", None, None),
]


def test_validation(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "req_id int, value string")
    got = {r["req_id"]: r for r in validate_requests(df, ["one"], "one").collect()}
    for i, (_, status, error, k_cat, k_sub) in enumerate(CASES):
        r = got[i]
        assert (r["status"], r["error"], r["topk_cat"], r["topk_sub"]) == (status, error, k_cat, k_sub), CASES[i]
    assert got[next(i for i, c in enumerate(CASES) if '"b"}' in c[0])]["text"] == "b"


def softmax(z):
    e = np.exp(z - z.max())
    return e / e.sum()


def brute(model, x, k_cat, k_sub):
    w, b = model.router.weights
    p = softmax(w @ x + b)
    out = []
    for c in np.argsort(-p, kind="stable")[: max(1, k_cat)]:
        subs, own = [], model.heads.get(model.router.labels[c])
        if own is not None:
            q = softmax(own.weights[0] @ x + own.weights[1])
            subs = [(own.labels[s], own.issues[s], own.subs[s], q[s]) for s in np.argsort(-q, kind="stable")[: max(1, k_sub)]]
        out.append((model.router.labels[c], p[c], subs))
    return out


def test_prediction_matches_brute_force(spark, models):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(200):
        model = ["one", "two", "none", None][i % 4 if i % 7 == 0 else i % 2]
        x = None if i % 13 == 0 else rng.normal(size=DIM).tolist()
        rows.append((i, x, model, i % 5 - 1, i % 4))
    schema = "row_id int, x array<double>, model_id string, topk_cat int, topk_sub int"
    df = spark.createDataFrame(rows, schema).repartition(3)
    by_id = {m.model_id: m for m in models}
    got = {r["row_id"]: r["predictions"] for r in hier_predict(df, models).collect()}
    for i, x, model, k_cat, k_sub in rows:
        if x is None or model not in by_id:
            assert got[i] is None
            continue
        want = brute(by_id[model], np.asarray(x), k_cat, k_sub)
        assert [c["category"] for c in got[i]] == [c[0] for c in want]
        for g, (_, p, subs) in zip(got[i], want):
            assert abs(g["proba"] - p) < 1e-12
            assert [(s["label"], s["issue"], s["subissue_unique"]) for s in g["subissues"]] == [s[:3] for s in subs]
            np.testing.assert_allclose([s["proba"] for s in g["subissues"]], [s[3] for s in subs], atol=1e-12)


def close(a, b):
    """Equal predictions but for the last digits of probabilities."""
    if a is None or b is None:
        assert a is None and b is None
        return
    assert [c["category"] for c in a] == [c["category"] for c in b]
    np.testing.assert_allclose([c["proba"] for c in a], [c["proba"] for c in b], rtol=1e-12)
    for c, d in zip(a, b):
        assert [(s["label"], s["issue"], s["subissue_unique"]) for s in c["subissues"]] == [
            (s["label"], s["issue"], s["subissue_unique"]) for s in d["subissues"]
        ]
        np.testing.assert_allclose([s["proba"] for s in c["subissues"]], [s["proba"] for s in d["subissues"]], rtol=1e-12)


@pytest.fixture(scope="module")
def large(spark, models, tmp_path_factory):
    """Two models, in memory and as stored tables."""
    rng = np.random.default_rng(4)
    heads = {c: head(rng, [f"i__SEP__{c}{k}" for k in range(7 if c == "b" else 3)]) for c in "abcd" if c != "c"}
    big = HierModel("one", models[0].encoder_id, models[0].encoder_weights, head(rng, list("abcd")), heads)
    root = str(tmp_path_factory.mktemp("store"))
    for model in (big, models[1]):
        model_store.save_model(tables_of(spark, model), root)
    stored = [model_store.open_model(model_store.open_tables(spark, root, m)) for m in ("one", "two")]
    return [big, models[1]], stored, root


def tables_of(spark, model):
    parts = [(None, model.router), *model.heads.items()]
    rows = [
        (model.model_id, c, i, h.weights[0][i].tolist(), float(h.weights[1][i]), h.labels[i], h.issues[i], h.subs[i])
        for c, h in parts for i in range(len(h.labels))
    ]
    df = spark.createDataFrame(
        rows,
        "model_id string, category string, class_idx int, weights array<double>, bias double, label string,"
        " issue string, subissue_unique string",
    )
    meta = spark.createDataFrame(
        [(model.model_id, model.encoder_id, list(model.encoder_weights))],
        "model_id string, encoder_id string, encoder_weights array<double>",
    )
    none = spark.createDataFrame([(model.model_id, 0)], "model_id string, x int")
    return model_store.ModelTables(df.drop("label", "issue", "subissue_unique"), df.drop("weights", "bias"), none, none, meta)


@pytest.mark.parametrize("classes, kind", [(1, "memory"), (4, "stored")])
def test_blocks_predict_the_same(spark, large, monkeypatch, classes, kind):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(90):
        x = None if i % 11 == 0 else rng.normal(size=DIM).tolist()
        model = ["one", "one", "two", "none", None][i % 5]
        # repeated rows, ids and null limits
        rows += [(i // 3, x, model, [None, -1, 0, 2, 9][i % 5], i % 4)] * (1 + (i % 7 == 0))
    df = spark.createDataFrame(rows, "id int, x array<double>, model_id string, topk_cat int, topk_sub int").repartition(3)
    key = lambda r: (r["id"], str(r["x"]), str(r["model_id"]), str(r["topk_cat"]), r["topk_sub"])
    want = sorted(predict.hier_predict(df, large[0]).collect(), key=key)
    monkeypatch.setattr(linear, "MODEL_BYTES", classes * (DIM + 1) * 8 + 7)
    got = sorted(predict.hier_predict(df, large[kind == "stored"]).collect(), key=key)
    assert len(got) == len(want) == len(rows)
    for g, w in zip(got, want):
        assert key(g) == key(w)
        close(g["predictions"], w["predictions"])


def test_plan_of_blocks():
    sizes = {("m", None): 5, ("m", "a"): 2, ("m", "b"): 3, ("n", None): 1}
    blocks = plan_blocks(sizes, {"m": 10, "n": 100}, 30)
    assert [[(r.key, r.first, r.end) for r in b] for b in blocks] == [
        [(("m", None), 0, 3)], [(("m", None), 3, 5)], [(("m", "a"), 0, 2)], [(("m", "b"), 0, 3)], [(("n", None), 0, 1)],
    ]
    assert sum(r.end - r.first for b in blocks for r in b) == sum(sizes.values())


def test_requests_of_large_models(spark, large, monkeypatch):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(PAYLOADS)], "req_id int, value string")
    want = {r["req_id"]: r for r in score_requests(df, large[0], "one").collect()}
    monkeypatch.setattr(linear, "MODEL_BYTES", 2 * (DIM + 1) * 8)
    for models in large[1:2]:
        got = {r["req_id"]: r for r in score_requests(df, models, "one").collect()}
        assert got.keys() == want.keys()
        for i, w in want.items():
            assert (got[i]["status"], got[i]["error"]) == (w["status"], w["error"])
            close(got[i]["predictions"], w["predictions"])


def test_versions_of_models(spark, large):
    *_, root = large
    first = model_store.newest_versions(spark, root)
    second = model_store.save_model(tables_of(spark, HierModel("two", "e", [1.0], head(np.random.default_rng(1), ["new"]), {})), root)
    assert model_store.newest_versions(spark, root) == {"one": first["one"], "two": second} and second > first["two"]
    assert model_store.load_model(model_store.open_tables(spark, root, "two")).router.labels == ["new"]
    old = model_store.open_tables(spark, root, "two", first["two"])
    assert model_store.load_model(old).router.labels == ["p", "q"]
    # a save that never wrote its last table is not seen
    tables = tables_of(spark, HierModel("two", "e", [1.0], head(np.random.default_rng(1), ["half"]), {}))
    tables.weights.withColumn("version", F.lit(second + 5)).write.mode("append").partitionBy("model_id", "version").parquet(f"{root}/weights")
    assert model_store.newest_versions(spark, root)["two"] == second
    assert model_store.prune_versions(spark, root, keep=1) == 1
    with pytest.raises(FileNotFoundError):
        model_store.open_tables(spark, root, "two", first["two"])
    assert model_store.load_model(model_store.open_tables(spark, root, "two")).router.labels == ["new"]
    assert model_store.newest_versions(spark, str(root) + "-none") == {}


@pytest.mark.parametrize("classes", [3])
def test_stream_serves_models_saved_meanwhile(spark, models, tmp_path, monkeypatch, classes):
    monkeypatch.setattr(linear, "MODEL_BYTES", classes * (DIM + 1) * 8)
    source, root, check = tmp_path / "in", str(tmp_path / "models"), str(tmp_path / "c")
    ok, bad = str(tmp_path / "ok"), str(tmp_path / "bad")
    source.mkdir()

    def run(name, lines):
        (source / f"{name}.txt").write_text("\n".join(lines) + "\n")
        query = serve_stream(spark.readStream.text(str(source)), root, "one", ok, bad, check)
        assert query.awaitTermination(180) and query.exception() is None

    def labels(batch):
        rows = spark.read.parquet(f"{ok}/batch_id={batch}").collect()
        return [[c["category"] for c in r["predictions"]] for r in rows]

    run("a", ['{"text":"x"}', "no json"])
    assert {r["status"] for r in spark.read.parquet(bad).collect()} == {400, 404}
    model_store.save_model(tables_of(spark, models[0]), root)
    run("b", ['{"text":"y","topk_cat":9}'])
    assert [sorted(c) for c in labels(1)] == [["a", "b", "c"]]
    newer = HierModel("one", models[0].encoder_id, models[0].encoder_weights, head(np.random.default_rng(2), ["n1", "n2"]), {})
    model_store.save_model(tables_of(spark, newer), root)
    run("c", ['{"text":"y","topk_cat":9}'])
    assert [sorted(c) for c in labels(2)] == [["n1", "n2"]]
    # batch 1 again, as after a crash before its commit: the versions of its first run
    for log in (f"{check}/commits/2", f"{check}/commits/1", f"{check}/offsets/2"):
        for path in (Path(log), Path(log).with_name(f".{Path(log).name}.crc")):
            path.unlink(missing_ok=True)
    query = serve_stream(spark.readStream.text(str(source)), root, "one", ok, bad, check)
    assert query.awaitTermination(180) and query.exception() is None
    assert [sorted(c) for c in labels(1)] == [["a", "b", "c"]]


PAYLOADS = [c[0] for c in CASES] + ['{"text":"Как дела на дороге","art_dir":"two","topk_cat":1}']


def test_response_document(spark, models):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(PAYLOADS)], "req_id int, value string")
    rows = {r["req_id"]: r for r in score_requests(df, models, "one").collect()}
    for i, v in enumerate(PAYLOADS):
        doc = json.loads(rows[i]["response"])
        if rows[i]["status"] != 200:
            assert doc == {"error": rows[i]["error"]}
            continue
        asked = json.loads(v)
        assert doc["art_dir"] == (asked.get("art_dir") or "one")
        n = {"one": 3, "two": 2}[doc["art_dir"]]
        assert len(doc["predictions"]) == min(doc["router_topk"], n)
        for c in doc["predictions"]:
            probas = [s["proba"] for s in c["subissues"]]
            assert probas == sorted(probas, reverse=True)
            if c["category"] == "b" and doc["art_dir"] == "one":
                assert c["subissues"] == [{"label": "__single__", "issue": None, "subissue_unique": None, "proba": 1.0}]
    assert "predictions" in rows[len(PAYLOADS) - 1]["response"]


def test_stream_equals_batch(spark, models, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [p for p in PAYLOADS if p]
    for n in range(3):
        (source / f"{n}.txt").write_text("\n".join(lines[n::3]) + "\n", encoding="utf-8")
    batch = score_requests(spark.read.text(str(source)), models, "one")
    want = sorted((r["status"], r["response"]) for r in batch.collect())

    def stream():
        lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))
        return score_requests(lines, models, "one")

    path = str(tmp_path / "single")
    query = write_scored(stream(), path, str(tmp_path / "c1"))
    assert query.awaitTermination(120)
    got = spark.read.parquet(path)
    assert sorted((r["status"], r["response"]) for r in got.collect()) == want

    ok, bad = str(tmp_path / "ok"), str(tmp_path / "bad")
    query = route_scored(stream(), ok, bad, str(tmp_path / "c2"))
    assert query.awaitTermination(120)
    good, errors = spark.read.parquet(ok), spark.read.parquet(bad)
    both = [(r["status"], r["response"]) for df in (good, errors) for r in df.collect()]
    assert sorted(both) == want
    assert {r["status"] for r in errors.collect()} == {400, 404, 500}
    assert errors.where(F.col("error").isNull()).isEmpty()


def test_encoder_must_match(spark, models):
    other = HierModel("x", "some-encoder", None, models[0].router, {})
    df = spark.createDataFrame([('{"text":"x"}',)], "value string")
    with pytest.raises(ValueError, match="not available"):
        score_requests(df, [other], "x")


def test_plugin_encoder(spark, models):
    def load():
        return lambda texts: np.array([[len(t)] + [1.0] * (DIM - 1) for t in texts])

    plugin = PluginEncoder("lengths", DIM, load, batch_size=3)
    df = spark.createDataFrame([("a" * i,) for i in range(10)] + [(None,)], "t string")
    got = plugin.encode(df, "t", "x").collect()
    assert [r["x"][0] for r in got] == [float(i) for i in range(10)] + [1.0]
    model = HierModel("m", "lengths", None, models[0].router, {})
    reqs = spark.createDataFrame([('{"text":"Hello"}',)], "value string")
    doc = json.loads(score_requests(reqs, [model, models[1]], "m", {"lengths": plugin}).first()["response"])
    assert doc["st_model_name"] == "lengths" and len(doc["predictions"]) == 2


def test_hashed_tfidf(spark):
    texts = ["a b a", "b c", " ", "a d e f", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id int, text string")
    encoder = HashedTfIdf.fit(df, "text", 64)
    tf = np.zeros((6, 64))
    for i, t in enumerate(texts):
        for token in (t or "").split():
            tf[i, int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 64] += 1
    idf = np.log(7 / ((tf > 0).sum(axis=0) + 1))
    np.testing.assert_allclose(encoder.weights, idf)
    want = tf * idf
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    want = want / np.where(norm == 0, 1, norm)
    rows = encoder.encode_sparse(encoder.encode(df, "text", "x"), "text", "s").collect()
    for r in rows:
        if texts[r["row_id"]] is None:
            assert r["x"] is None and r["s"] is None
            continue
        np.testing.assert_allclose(r["x"], want[r["row_id"]], atol=1e-6)
        dense = np.zeros(64)
        dense[r["s"]["indices"]] = r["s"]["values"]
        np.testing.assert_allclose(dense, want[r["row_id"]], atol=1e-6)
        assert r["s"]["indices"] == sorted(set(r["s"]["indices"]))


def test_counted_texts_fit_and_encode_alike(spark):
    """Texts are counted once: the counts serve fit and both encodings."""
    texts = ["b a  b", "ключ 한 b", " ", "", None, "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id int, text string")
    counts = df.select("*", HashedTfIdf.slot_counts(F.col("text"), 32).alias("s"))
    slot = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 32
    for r in counts.collect():
        want = None if r["text"] is None else sorted(Counter(map(slot, r["text"].split())).items())
        assert (None if r["s"] is None else [tuple(s) for s in r["s"]]) == want
    encoder = HashedTfIdf.fit(counts, "s", 32)
    assert encoder.weights == HashedTfIdf.fit(df, "text", 32).weights
    for encode in (encoder.encode, encoder.encode_sparse):
        got = [r["x"] for r in encode(counts, "s", "x").orderBy("row_id").collect()]
        assert got == [r["x"] for r in encode(df, "text", "x").orderBy("row_id").collect()]
    assert encoder.encode(df.limit(0), "text", "x").count() == 0


def test_slices_of_texts_keep_all(monkeypatch):
    monkeypatch.setattr(embedding, "SLICE_BYTES", 4)
    texts = pa.array(["aa", None, "bb", "", "a long one", "c", "d"])
    parts = list(embedding._slices(texts))
    assert pa.concat_arrays(parts).equals(texts) and [len(p) for p in parts] == [4, 1, 2]
    whole = embedding._slot_counts(texts, 16)
    assert pa.concat_arrays([embedding._slot_counts(p, 16) for p in parts]).equals(whole)
