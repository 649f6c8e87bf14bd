import random
from itertools import combinations

import numpy as np

from labelway.llm import neardup as N
from labelway.llm.common import table


def brute(rows, cfg=N.OrderMinHash()):
    """Least doc_id of the class of each row, by comparing all pairs."""
    grams = [N.kmers(t, cfg.words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if N.alignment(grams[i], grams[j], cfg.similarity) > 0:
            root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [least.get(find(i)) for i in range(len(rows))]


def slow_alignment(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i, j] = best[i - 1, j - 1] + 1 if x == y else max(best[i - 1, j], best[i, j - 1])
    n = best[-1, -1]
    return n / (len(a) + len(b) - n)


def test_alignment_equals_full_table():
    rng = random.Random(4)
    for _ in range(60):
        a = [f"w{rng.randrange(12)}" for _ in range(rng.randrange(5, 60))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b)), "x") if rng.random() < 0.5 else b.pop(rng.randrange(len(b)))
        x, y = N.kmers(" ".join(a)), N.kmers(" ".join(b))
        want = slow_alignment(x.tolist(), y.tolist())
        assert N.alignment(x, y, 0.8) == (want if want >= 0.8 - 1e-9 else 0.0)


def test_query_against_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = {r.doc_id: r.class_id for r in N.q_order_minhash(spark, sf).collect()}
    assert [got[i] for i, _ in rows] == brute(rows)


def group(n, seed):
    """Near copies of one text, and texts that share a passage or a phrase only."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(900)}" for _ in range(150)]
    passage = [f"p{i}" for i in range(60)]
    out = []
    for i in range(n):
        copy = list(base)
        copy[rng.randrange(150)] = f"new{i}"
        out.append(copy)
        out.append([f"u{rng.randrange(10**6)}" for _ in range(90)] + passage)
        out.append([f"v{rng.randrange(10**6)}" for _ in range(25)] + ["so", "it", "is."] * rng.randrange(25, 40))
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_hot_groups_against_all_pairs(spark):
    rows = group(40, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.node: r.class_id for r in N.classes(docs).collect()}
    nodes = {r.doc_id: r.node for r in docs.select("doc_id", N.node_of(docs.text).alias("node")).collect()}
    assert [got[bytes(nodes[i])] for i, _ in rows] == brute(rows)


def check_all_pairs(spark, texts):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {bytes(r.node): r.class_id for r in N.classes(docs).collect()}
    nodes = docs.select("doc_id", N.node_of(docs.text).alias("node")).collect()
    want = brute(rows)
    assert [got[bytes(r.node)] for r in sorted(nodes)] == want
    return want


def edited(words, changes, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"e{rng.randrange(10**9)}"
    return out


def test_star_of_one_original(spark):
    rng = random.Random(7)
    original = [f"o{i}" for i in range(400)]
    copies = [edited(original, 6, rng) for _ in range(250)]
    assert set(check_all_pairs(spark, map(" ".join, [*copies, original]))) == {0}


def test_links_between_settled_texts(spark):
    """Many small stars around one text: a leg is alike to the middle of its star only."""
    rng = random.Random(11)
    base, texts = [f"c{i}" for i in range(300)], []
    for _ in range(40):
        middle = edited(base, 4, rng)
        texts += [middle, *(edited(middle, 5, rng) for _ in range(4))]
    rng.shuffle(texts)
    check_all_pairs(spark, map(" ".join, texts))


def test_one_row_of_each_class_stays(spark, odd_docs):
    kept = N.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    # blank texts are one class; the row without an id stands alone
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 6, 7, 8]
    assert N.deduplicate(odd_docs.limit(0)).count() == 0


def test_batches_of_kmers_equal_single_texts():
    texts = [None, "", " \n", "a b", "a b c d e", "a b a b a b a b a", "x\ty\x0bz\x1fw  v u t", "한 글 " * 9, "a b c d e f"]
    many = N.kmers_of(N.pa.array(texts, N.pa.string()))
    for text, grams in zip(texts, many):
        assert np.array_equal(grams, N.kmers(text)) and len(np.unique(grams)) == len(grams)
    assert [len(g) for g in many] == [0, 0, 0, 1, 1, 5, 2, 14, 2]


def test_digests_of_texts_are_made_once(spark):
    """What follows reads the staged rows, with the digest in them."""
    docs = spark.createDataFrame([(i, f"one two three four five six {i % 2}") for i in range(6)], "doc_id long, text string")
    rows = N.keyed(docs, "doc_id")
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (N.sketches(rows, N.OrderMinHash()), rows)]
    assert not any("md5" in p or "regexp_replace" in p for p in plans)
    assert rows.count() == 6 and rows.select("node").distinct().count() == 2


def copies_at_the_bound(n, seed):
    """A text and copies with 1 to 9 changed words: half of them are just too far from it."""
    rng = random.Random(seed)
    base, new = [f"b{i}" for i in range(150)], [f"n{i}" for i in range(60)]
    texts = [base]
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 10)):
            copy[at] = rng.choice(new)
        texts.append(copy)
    return list(dict.fromkeys(map(" ".join, texts)))


def test_pairs_of_one_original_grow_with_texts(spark, monkeypatch):
    pairs = []

    def counted(found, *args, run=N._linked):
        pairs.append(N.compared(found).count())
        return run(found, *args)

    monkeypatch.setattr(N, "_linked", counted)
    texts = copies_at_the_bound(300, 3)
    classes = check_all_pairs(spark, texts)
    far = len(set(classes)) - 1
    assert 100 < far < 250
    # after the sketches; 57 a text before, as each far text met most others
    assert sum(pairs[1:]) < 5 * len(texts)


def test_similar_texts_share_a_difference_from_any_pivot(spark):
    rng, cfg = random.Random(5), N.OrderMinHash()
    texts = []
    for size in (9, 33, 64, 120, 300, 500):
        base = [f"b{rng.randrange(size)}" for _ in range(size)]
        for _ in range(14):
            copy = list(base)
            for at in rng.sample(range(size), rng.randrange(1 + size // 40 + 1)):
                copy[at : at + 1] = rng.choice([[], ["x"], ["y", "z"], [f"e{rng.randrange(99)}"]])
            texts.append(" ".join(copy))
    grams = {i: N.kmers(t, cfg.words) for i, t in enumerate(dict.fromkeys(texts))}
    nodes = [(i.to_bytes(2), t) for i, t in enumerate(dict.fromkeys(texts))]
    pivots = rng.sample(range(len(nodes)), 3)
    rows = [(node, nodes[p][0], len(grams[i]), 0, node) for i, (node, _) in enumerate(nodes) for p in pivots]
    asked = spark.createDataFrame(rows, "node binary, pivot binary, n long, own long, root binary")
    stored = spark.createDataFrame(nodes, "node binary, text string")
    similar = {(i, j) for i, j in combinations(grams, 2) if N.alignment(grams[i], grams[j], cfg.similarity) > 0}
    assert len(similar) > 50
    for p in pivots:
        met = {}
        for r in N.differences(asked.filter(asked.pivot == nodes[p][0]), stored, cfg).collect():
            met.setdefault(r.bucket, []).append((int.from_bytes(r.node), r.side))
        assert similar <= {(i, j) for rows in met.values() for i, x in rows for j, y in rows if i < j and x * y <= 0}


def with_own_passages(n, seed):
    """Texts of one body of different lengths, each with a passage of its own; some are alike but for two words."""
    rng = random.Random(seed)
    body, texts = ["so", "it", "is."] * 80, []
    for i in range(n):
        own = [f"o{i}_{j}" for j in range(30)]
        texts.append([*own, *body[: 3 * rng.randrange(60, 80)]])
        if i % 4 == 0:
            texts.append(edited(texts[-1], 2, rng))
    return list(map(" ".join, texts))


def test_differences_are_few_where_texts_have_passages_of_their_own(spark, monkeypatch):
    staged = {}

    def kept(df, name, run=N.stage_table):
        staged[name] = run(df, name)
        return staged[name]

    monkeypatch.setattr(N, "stage_table", kept)
    texts = with_own_passages(60, 2)
    check_all_pairs(spark, texts)
    rows = staged["differences"]
    assert rows.count() >= len(texts)
    # what one text has alone, and what the pivot has and most do not, is not listed
    listed = rows.select(N.F.explode("grams")).count() if "grams" in rows.columns else rows.count()
    assert listed < 60 * len(texts)
