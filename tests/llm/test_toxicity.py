import random
from itertools import product

import numpy as np

from labelway.llm import toxicity as T


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(400)}" for _ in range(400)]
    out = []
    for i in range(n):
        text = [rng.choice(words) + rng.choice(["", "", "", "."]) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                text[rng.randrange(60)] = "zorg" + rng.choice(["a", "en", "ish", "um", "ox"])
        out.append((" ".join(text), int(i % 4 == 0)))
    return out


def test_messages_equal_enumeration():
    rng = np.random.default_rng(0)
    chain = np.array([0, 0, 0, 1, 2, 2, 2, 2])
    e, start, trans = rng.normal(size=8), 0.3, ((0.2, -0.4), (0.7, -0.1))
    forward, backward = T.messages(e, chain, start, trans)
    got = T.sigmoid(forward + backward)
    for c in (0, 1, 2):
        at = np.flatnonzero(chain == c)
        mass, total = np.zeros(len(at)), 0.0
        for y in product((0, 1), repeat=len(at)):
            s = start * y[0] + sum(e[i] for i, v in zip(at, y) if v) + sum(trans[a][b] for a, b in zip(y, y[1:]))
            total += np.exp(s)
            mass += np.exp(s) * np.array(y)
        assert np.allclose(got[at], mass / total)


def test_held_out_texts_and_spans():
    model = T.fit(corpus(400, 1))
    held = corpus(200, 2)
    found = list(T.tag(model, [t for t, _ in held]))
    assert np.mean([(s >= 0.5) == bool(y) for (s, _), (_, y) in zip(found, held)]) > 0.97
    text = "w1 w2 zorgen w3."
    ((score, spans),) = T.tag(model, [text])
    assert score >= 0.5 and [text[s["start"] : s["end"]] for s in spans] == ["zorgen"]


def test_odd_rows(spark, odd_docs):
    model = T.fit(corpus(200, 3))
    found = T.score(odd_docs, model).collect()
    assert len(found) == odd_docs.count() and all(0 <= r.score < 0.5 for r in found)
    assert {r.row.score for r in found} == {0.25}
    assert T.score(odd_docs.limit(0), model).count() == 0


def test_nothing_to_learn(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    model = T.learn(odd_docs, labels)
    assert all(s < 1e-9 for s, _ in T.tag(model, ["x", None]))


def test_query_ignores_held_out_labels(spark, sf):
    got = T.q_toxicity_crf(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = T.learn(spark.read.parquet(f"{sf}/documents.parquet"), labels.filter("crc32(cast(doc_id as string)) % 5 != 0"))
    again = {r.row.doc_id: r.score for r in T.score(spark.read.parquet(f"{sf}/documents.parquet"), model).collect()}
    assert {r.doc_id: r.score for r in got.collect()} == again
