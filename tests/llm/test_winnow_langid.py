import hashlib

import numpy as np
import pytest

from labelway.llm import langid as L
from labelway.llm import winnow as W
from labelway.llm.common import table


def slow(text, cfg):
    k = min(cfg.k, len(text))
    codes = [ord(c) for c in text]
    grams = [int(W.rolling(np.array(codes[i : i + k], np.uint64), k)[0]) >> 32 for i in range(len(text) - k + 1)] if k else []
    w, places = min(cfg.window, len(grams)), []
    for i in range(len(grams) - w + 1 if grams else 0):
        least = min(grams[i : i + w])
        at = max(j for j in range(i, i + w) if grams[j] == least)
        if not places or places[-1] != at:
            places.append(at)
    return [grams[p] for p in places], places


@pytest.mark.parametrize("text", ["", "a", "abc" * 50, "héllo wörld 日本" * 9, "x" * 300, "the quick brown fox"])
@pytest.mark.parametrize("cfg", [W.WinnowConfig(), W.WinnowConfig(k=5, window=4), W.WinnowConfig(k=7, window=7)])
def test_winnow_equals_brute_force(text, cfg):
    hashes, places = W.winnow(text, cfg)
    assert (hashes.tolist(), places.tolist()) == slow(text, cfg)


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        changed = W.edited(text, following)
        a, b, c = (np.unique(W.winnow(t)[0]) for t in (text, changed, following))
        out.append((str(doc_id), len(text), hashlib.sha256(changed.encode()).hexdigest(), W.likeness(a, b), W.likeness(a, c)))
    return sorted(out)


@pytest.mark.parametrize("per_range", [3, 1000])
def test_next_documents(spark, sf, odd_docs, per_range):
    cfg = W.WinnowConfig(rows_per_range=per_range)
    for docs in (table(spark, sf, "documents"), odd_docs, odd_docs.limit(1), odd_docs.limit(0)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = W.fingerprints(docs, cfg).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == expected(rows)


def test_shared_passage_is_found():
    passage = "".join(chr(97 + i * 7 % 26) for i in range(63))
    a, b = W.winnow("1" * 200 + passage + "2" * 99), W.winnow("3" * 77 + passage + "4" * 150)
    assert set(a[0].tolist()) & set(b[0].tolist())


def test_languages_held_out(spark, sf):
    got = L.q_language_id(spark, sf).join(table(spark, sf, "documents"), "doc_id")
    held = got.filter("held_out").selectExpr("avg(cast(lang = lang_pred as int))").first()[0]
    assert held > 0.95


def test_language_odd_rows(spark, odd_docs):
    train = spark.createDataFrame(
        [("the dog and the fox", "en"), ("der hund und der fuchs", "de"), (None, "en"), ("x", None)], "text string, lang string"
    )
    model = L.learn(train)
    found = {(r.row.doc_id, r.row.text): (r.lang_pred, r.score) for r in L.predict(odd_docs, model).collect()}
    assert found[(3, None)] == found[(4, "")] == found[(8, "12 34 !!")] == ("und", 0.0)
    assert found[(1, odd_docs.first().text)][0] == "en"
    assert model.predict("hundert")[0] == "de"  # unseen word, by its n-grams
    empty = L.learn(train.limit(0))
    assert empty.predict("the dog") == ("und", 0.0)
    assert L.predict(odd_docs.limit(0), model).count() == 0
