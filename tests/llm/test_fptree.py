import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from labelway.llm import fptree as T
from labelway.llm.common import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=50):
    """Scores every document for every item."""
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    sizes = [c.total() for _, c in counted]
    big_n, big_l = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        asked = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) for t in set(terms_of(text))}
        rows = []
        for (i, c), n in zip(counted, sizes):
            if n:
                m = 50 + (50 * n * big_n) // big_l
                score = sum(w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in asked.items() if c[t])
                if score:
                    rows.append((-score, i is None, i, score))
        out += [(item_id, at + 1, i, s) for at, (_, _, i, s) in enumerate(sorted(rows, key=str_free)[:best])]
    return sorted(out, key=repr)


def str_free(row):
    return row[0], row[1], row[2] or 0


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert rows_of(T.q_lexical_search(spark, sf)) == brute(docs, items)


@pytest.mark.parametrize("cfg", [T.LexicalSearch(best=3), T.LexicalSearch(best=2, leaf=1, tree_terms=4, block_bytes=20)])
def test_odd_rows(spark, odd_docs, cfg):
    asked = [(1, "the QUICK fox, home"), (1, "the QUICK fox, home"), (2, None), (3, " -- "), (None, "word5 a B 12"), (4, "no id HERE"), (5, "absent")]
    items = spark.createDataFrame([(i, t, 7) for i, t in asked], "item_id long, text string, rank int")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows_of(T.ranked(odd_docs, items, cfg)) == brute(docs, asked, cfg.best)
    assert T.ranked(odd_docs.limit(0), items, cfg).collect() == []
    assert T.ranked(odd_docs, items.limit(0), cfg).collect() == []


def random_rows(seed, n_docs, n_terms):
    """(path, tfs, m, doc_id, null) with many equal and nested vectors."""
    rng = random.Random(seed)
    rows = []
    for i in range(n_docs):
        terms = sorted({min(int(rng.paretovariate(0.7)) - 1, n_terms - 1) for _ in range(rng.randrange(1, 12))})
        terms = list(range(rng.randrange(1, n_terms))) if i % 7 == 0 else terms
        rows.append((terms, [rng.randrange(1, 4) for _ in terms], rng.choice([50, 60, 140]), rng.randrange(n_docs)))
    return sorted(rows)


@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_tree_finds_the_best(leaf):
    n_terms, rng = 30, random.Random(leaf)
    rows = random_rows(leaf, 400, n_terms)
    weights = np.arange(1, n_terms + 1)
    pack = lambda values, kind: np.array(values, kind).tobytes()
    tree = T.Tree(
        [pack(t, ">u4") for t, *_ in rows], [pack(f, "<u4") for _, f, *_ in rows],
        np.array([m for *_, m, _ in rows]), np.array([i for *_, i in rows]), np.zeros(len(rows), bool), n_terms, leaf,
    )
    for _ in range(30):
        asked = np.array(sorted(rng.sample(range(n_terms), rng.randrange(1, 9))))
        best = T.Best.none()
        tree.search(asked, weights[asked], best, 10)
        scores = [
            (-sum(int(weights[t]) * ((10**9 * f) // (1000 * f + 20 * m)) for t, f in zip(terms, tfs) if t in asked), i)
            for terms, tfs, m, i in rows
        ]
        want = sorted(s for s in scores if s[0])[:10]
        assert [(-s, i) for s, i in zip(best.score.tolist(), best.doc_id.tolist())] == want


def test_bounds_leave_out_subtrees():
    """Rare term: only its path is looked into."""
    rows = [([0, 1, 2 + i % 40], [1, 1, 1], 50, i) for i in range(4000)]
    rows.sort()
    pack = lambda values, kind: np.array(values, kind).tobytes()
    tree = T.Tree(
        [pack(t, ">u4") for t, *_ in rows], [pack(f, "<u4") for _, f, *_ in rows],
        np.full(4000, 50), np.array([i for *_, i in rows]), np.zeros(4000, bool), 42, 32,
    )
    best = T.Best.none()
    looked = tree.search(np.array([0, 7]), np.array([1, 900]), best, 10)
    assert looked <= 4 and best.doc_id.tolist() == list(range(5, 405, 40))


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"Ab{i % 50}é-x" for i in range(500))
    whole = T.term_counts(text.encode())
    assert whole == Counter(t.encode() for t in terms_of(text))
    monkeypatch.setattr("labelway.llm.words.BLOCK", 5)
    assert T.term_counts(text.encode()) == whole
