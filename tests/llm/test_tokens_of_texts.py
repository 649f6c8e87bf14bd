import random
import zlib

import numpy as np
import pytest

from labelway.llm import attribution as A
from labelway.llm import pieces as S
from labelway.llm.common import table

PARTS = ["the ", "ing", "  ", "é", "日本", "a", "aaaa", "b", "\n", "er", "!!", "xyz", " ", "▁", "\n\n", "😀"]


@pytest.fixture(scope="module")
def codec():
    return S.Codec.of(S.PieceConfig().model)


def by_chunks(codec, text, size):
    s = codec.symbols(text)
    cuts = [(i, min(i + size, len(s))) for i in range(0, len(s), size)]
    found = [S.transfer(codec, s, a, b, b == len(s)) for a, b in cuts]
    states = S.boundary_states([m for *_, m in found])
    pairs = [found[i][1][k] for i, k in enumerate(states)]
    parts = zip(cuts, [None, *pairs], [*pairs, None])
    return np.frombuffer(b"".join(S.chunk_ids(codec, s, a, b, x, y) for (a, b), x, y in parts), "<u4").tolist()


def test_pieces_equal_library(codec):
    rng = random.Random(1)
    for _ in range(120):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 60)))
        want = codec.library.encode(text)
        ids = np.frombuffer(codec.encode(text), "<u4")
        assert ids.tolist() == want
        assert codec.decode(ids) == text.replace(S.MARK, " ")
        for size in (5, 17, 40):
            assert by_chunks(codec, text, size) == want


def test_max_plus_products_associate():
    rng = np.random.default_rng(2)
    m = [rng.integers(-9, 9, (3, 3)).astype(float) for _ in range(9)]
    want = m[0]
    for i, got in enumerate(S.scan(m)):
        want = want if not i else S.combine(want, m[i])
        assert np.array_equal(got, want)


def test_giant_documents_in_spark(spark, codec, odd_docs):
    cfg = S.PieceConfig(chunk_chars=1000)
    rows = S.encode_documents(odd_docs, cfg).collect()
    assert len(rows) == odd_docs.count() and max(r.n_chunks for r in rows) > 100
    assert all(np.frombuffer(r.ids, "<u4").tolist() == codec.library.encode(r.text) for r in rows)
    assert S.encode_documents(odd_docs.limit(0), cfg).count() == 0


def test_pieces_query(spark, sf, codec):
    want = {
        r.doc_id: zlib.crc32(np.array(codec.library.encode(r.text), "<u4").tobytes())
        for r in table(spark, sf, "documents").collect()
    }
    got = S.q_sentencepiece(spark, sf).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == want and all(r.round_trip for r in got)


def slow_spans(encoder, text):
    out, at = [], 0
    data = text.encode()
    chars = [i for i, c in enumerate(text) for _ in c.encode()]
    for i in encoder.library.encode_ordinary(text):
        n = len(encoder.library.decode_single_token_bytes(i))
        out.append((chars[at], chars[at + n - 1] + 1))
        at += n
    assert at == len(data)
    return out


def slow_owner(span, sections):
    sizes = [max(0, min(span[1], b) - max(span[0], a)) for a, b in sections]
    return sizes.index(max(sizes)) if sizes and max(sizes) else -1


def test_attribution_equals_brute_force():
    encoder, rng = A.OffsetEncoder.of(A.AttributionConfig().ranks), random.Random(3)
    for _ in range(80):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 60)))
        start, end = encoder.spans(text)
        assert list(zip(start.tolist(), end.tolist())) == slow_spans(encoder, text)
        cuts = sorted({rng.randrange(len(text) + 1) for _ in range(6)})
        sections = list(zip(cuts, cuts[1:]))[:: rng.choice([1, 2])]
        a, b = (np.array(x, np.int64) for x in (zip(*sections) if sections else ([], [])))
        owner, _ = A.assign(start, end, a, b)
        assert owner.tolist() == [slow_owner(s, sections) for s in zip(start.tolist(), end.tolist())]


def test_counts_add_up(spark, sf, odd_docs):
    encoder = A.OffsetEncoder.of(A.AttributionConfig().ranks)
    for docs in (table(spark, sf, "documents").select("doc_id", "text"), odd_docs):
        for r in A.attribute(docs).collect():
            assert sum(c.n_tokens for c in r.counts) == len(encoder.library.encode_ordinary(r.row.text or ""))
    assert A.attribute(odd_docs.limit(0)).count() == 0
