import math
import re
from collections import Counter

import xxhash

from labelway.llm import quality as Q
from labelway.llm.common import table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def failed(b):
    return b[0] < 20 or 100 * b[4] > 30 * b[0]


def buckets(text, n):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORDS.findall(text or "")]
    data = [x.to_bytes(8, "little") for x in h]

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    pairs = [xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42)) for a, b in zip(data, data[1:])]
    return [signed(x) % n for x in h + pairs]


def verdicts(docs, good_ids, cfg):
    """Plain Python version of the whole operator."""
    raw, good = Counter(), Counter()
    for i, t in docs:
        found = buckets(t, cfg.buckets)
        raw.update(found)
        if i in good_ids:
            good.update(found)
    n_raw, n_good, prior = sum(raw.values()), sum(good.values()), cfg.smoothing * cfg.buckets
    out = []
    for i, t in docs:
        total, found = 0.0, buckets(t, cfg.buckets)
        for x in found:
            p = (raw[x] + cfg.smoothing) / (n_raw + prior)
            total += round(math.log((good[x] + prior * p) / (n_good + prior) / p), 4)
        llr, b = total / max(len(found), 1), base(t)
        out.append((i, *b, failed(b), llr, not failed(b) and llr >= cfg.threshold))
    return out


def test_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    good = {r.doc_id for r in table(spark, sf, "labels").filter("quality = 1").collect()}
    want = sorted(verdicts(rows, good, Q.QualityConfig()))
    got = sorted(tuple(r) for r in Q.q_quality_rules(spark, sf).collect())
    for g, w in zip(got, want, strict=True):
        assert g[:6] == w[:6] and abs(g[6] - w[7]) < 1e-3 and g[7] == w[6]
        assert g[8] == w[8] or abs(w[7] - Q.QualityConfig().threshold) < 1e-3


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = Q.score(odd_docs, Q.ngram_weights(odd_docs, labels, Q.QualityConfig())).collect()
    assert len(found) == odd_docs.count()
    for r in found:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == base(r.row.text)
        assert q.llr == 0 and r.row.row == "mine" and r.row.kept is True


def test_empty_table(spark, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = odd_docs.limit(0)
    assert Q.score(none, Q.ngram_weights(none, labels, Q.QualityConfig())).count() == 0
