"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline as C
from labelway.llm import quality, toxicity
from labelway.llm.common import crc_mod, table
from pyspark.sql import functions as F

from .test_neardup import brute
from .test_packing import check
from .test_quality import verdicts


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, labels = docs.columns, table(spark, sf, "labels")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    kept = C.keep_quality(spark, docs, sf).cache()
    want = {v[0]: v for v in verdicts(rows, good, quality.QualityConfig())}
    got = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns
    assert all((i in got) == v[8] for i, v in want.items() if abs(v[7] + 0.15) > 1e-3)

    clean = C.drop_toxic(spark, kept, sf).cache()
    cfg = toxicity.ToxicityConfig()
    model = toxicity.fit(toxicity.training_rows(kept, labels, cfg, crc_mod(F.col("doc_id"), 5) != 0), cfg)
    texts = {r.doc_id: r.text for r in kept.collect()}
    score = {i: next(toxicity.tag(model, [t]))[0] for i, t in texts.items()}
    assert {r.doc_id for r in clean.collect()} == {i for i, s in score.items() if s < 0.5}
    assert clean.columns == columns

    single = C.drop_near_duplicates(spark, clean, sf).cache()
    left = [(r.doc_id, r.text) for r in clean.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(brute(left)))
    assert single.columns == columns

    pieces = C.pack_sequences(spark, single, sf).collect()
    check(pieces, [(r.doc_id, r.text) for r in single.collect()])
    check(C.run(spark, sf).collect(), [(r.doc_id, r.text) for r in single.collect()])
    for d in (kept, clean, single):
        d.unpersist()


def test_odd_rows(spark, sf, odd_docs):
    for _, stage in C.STAGES:
        stage(spark, odd_docs, sf).count()
        assert stage(spark, odd_docs.limit(0), sf).count() == 0
