import heapq
import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from labelway.llm import packing as P
from labelway.llm.common import table
from labelway.llm.tokens import WordEncoder


def check(pieces, texts):
    """All contract rules of a packing of (doc_id, text)."""
    library = Tokenizer.from_file(P.PackingConfig().tokenizer)
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in texts)
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        docs[(str(p.doc_id), p.doc_tokens)].append(p)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    ids = {(i, len(x)): x for i, x in want}
    for key, parts in docs.items():
        whole = ids[key]
        copies = sum(k == key for k in ((i, len(x)) for i, x in want))
        assert sum(p.length for p in parts) == copies * len(whole)
        for p in parts:
            data = np.array(whole[p.start : p.start + p.length], "<u4").tobytes()
            assert zlib.crc32(data) == p.ids_crc32
    assert set(docs) == set(ids)
    return sequences


def test_query(spark, sf):
    texts = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    sequences = check(P.q_packing(spark, sf).collect(), texts)
    used = sum(n for parts in sequences.values() for _, n in parts)
    assert used > 0.97 * 4096 * len(sequences)


def test_odd_rows(spark, odd_docs):
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check(P.pack_documents(odd_docs).collect(), texts)
    assert P.pack_documents(odd_docs.limit(0)).count() == 0


def test_windows_hand_over_what_is_left():
    cfg = P.PackingConfig(capacity=10)
    pieces, left, used = P.pack([(0, 0, 17), (1, 0, 3), (2, 0, 4)], cfg, False)
    assert used == 2 and sum(p.length for p in pieces) == 20 and sum(n for *_, n in left) == 4
    pieces, left, used = P.pack([(0, 0, 17), (1, 0, 3), (2, 0, 4)], cfg, True)
    assert used == 3 and not left


def test_costs_are_balanced():
    cfg = P.PackingConfig(capacity=100)
    pieces, *_ = P.pack([(i, 0, 50) for i in range(10)] + [(i, 0, 10) for i in range(10, 60)], cfg, True)
    held = defaultdict(list)
    for p in pieces:
        held[p.sequence].append(p.length)
    assert all(x.count(50) == 1 for x in held.values())


def test_nothing_is_cut_that_fits_somewhere():
    """Against a search through all sequences."""
    rng = random.Random(2)
    lengths = [(i, 0, rng.choice([1, 7, 30, 90, 240, rng.randrange(1, 256)])) for i in range(1500)]
    cfg = P.PackingConfig(capacity=256)
    pieces, left, count = P.pack(lengths, cfg, True)
    room, cost, want = [256] * count, [0.0] * count, []
    entries = [(-n, doc, start) for doc, start, n in lengths]
    heapq.heapify(entries)
    while entries:
        n, doc, start = heapq.heappop(entries)
        fits = [s for s in range(count) if room[s] >= -n] or [s for s in range(count) if room[s]]
        s = min(fits, key=lambda x: (cost[x], x))
        take = min(-n, room[s])
        want.append((doc, start, take, s, 256 - room[s]))
        room[s] -= take
        cost[s] += cfg.linear * take + cfg.quadratic * take * take
        if -n > take:
            heapq.heappush(entries, (n + take, doc, start + take))
    assert [(p.doc, p.start, p.length, p.sequence, p.offset) for p in pieces] == want and not left


def test_cache_equals_library():
    encoder = WordEncoder.of(P.PackingConfig().tokenizer)
    odd = [
        "", "  a b c", "́x éÉ", "ΑΣ ΑΣ,b ΣΑΣ½²Ⅻ", "<|endoftext|> x", "a\x1cb\x85c​d", "İI A'S İ'LL",
        "日本 x\x01y \x01", "x" * 3000, "don't  we'll 12 3²½ ﬁ a_b-c", "\r\n\v\f a",
    ]
    want = [encoder.library(t) for t in odd]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(odd)] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(odd)] == want
