import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from labelway.llm import simhash as S
from labelway.llm import words
from labelway.llm.common import table
from labelway.operators import joins


def slow_fingerprint(text):
    out, lower = [], "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in " \t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    parts = [w for w in lower.split(" ") if w]
    out = [" ".join(parts[i : i + 3]) for i in range(max(1, len(parts) - 2))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in out]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    return {f: find(f) for f in root}


def brute(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    roots = slow_roots(set(fps))
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    return sorted(((i, f"{f:016x}", least.get(roots[f])) for (i, _), f in zip(rows, fps)), key=str)


def test_query_against_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, S.q_simhash(spark, sf).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("broadcast", [True, False])
def test_odd_rows(spark, odd_docs, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = S.placed(odd_docs).collect()
    assert sorted(((r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in got), key=str) == brute(rows)
    assert S.placed(odd_docs.limit(0)).collect() == []


def test_blocks_of_long_texts(monkeypatch):
    rng = random.Random(3)
    text = " ".join(f"W{rng.randrange(300)}é" for _ in range(4000)) + "\x1c \x0bEnd"
    whole = S.fingerprint(text.encode())
    assert whole == slow_fingerprint(text)
    monkeypatch.setattr(words, "BLOCK", 7)
    assert S.fingerprint(text.encode()) == whole


def flipped(rng, f, n):
    for b in rng.sample(range(64), n):
        f ^= 1 << b
    return f


def crowd(n, seed):
    """Distant fingerprints, chains of links, and a dense group around one fingerprint."""
    rng = random.Random(seed)
    out = {rng.randrange(1 << 64) for _ in range(n)}
    for f in rng.sample(sorted(out), n // 4):
        for _ in range(4):
            f = flipped(rng, f, rng.randrange(1, 5))
            out.add(f)
    hub = rng.randrange(1 << 64)
    out |= {flipped(rng, hub, rng.randrange(1, 6)) for _ in range(n)}
    return sorted(out)


@pytest.mark.parametrize("limit", [4, 1024])
def test_components_of_fingerprints(spark, limit):
    fps = crowd(300, limit)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    found = S.links(df, S.SimHash(list_limit=limit)).collect()
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in found]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in pairs)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in pairs:
        root[find(a)] = find(b)
    want = slow_roots(fps)
    group = lambda at: sorted(sorted(f for f in fps if at(f) == r) for r in {at(f) for f in fps})
    assert group(find) == group(want.get)


def test_any_two_near_ones_share_a_list():
    for bad in combinations(range(8), 3):
        assert any(not set(t) & set(bad) for t in S.TRIPLES)


def test_large_lists_are_probed(monkeypatch):
    rng = np.random.default_rng(1)
    fps = np.unique((rng.integers(0, 1 << 24, 3000, dtype=np.uint64) << np.uint64(16)) | np.uint64(7 << 56 | 9))
    slow = S.forest_links(fps)
    monkeypatch.setattr(S, "PROBED", 50)
    fast = S.forest_links(fps)
    assert len(slow[0]) == len(fast[0]) > 100
    assert all((np.bitwise_count(a ^ b) <= 3).all() for a, b in (slow, fast))


def test_links_grow_with_members():
    rng = random.Random(8)
    hub = rng.randrange(1 << 64)
    fps = np.array(sorted({flipped(rng, hub, rng.randrange(1, 3)) for _ in range(900)}), np.uint64)
    assert len(S.forest_links(fps)[0]) == len(fps) - 1
