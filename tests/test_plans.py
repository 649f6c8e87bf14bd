"""What the optimizer makes of the operators."""

import pytest
from pyspark.sql import functions as F

from labelway.config import HierConfig
from labelway.functions.labels import is_good_grade
from labelway.operators import encoding, linear, sampling, taxonomy
from labelway.operators.predict import hier_predict
from labelway.plans import hierarchy
from labelway.sources import fixtures
from labelway.sources.model_store import Head, HierModel
from labelway.streaming.requests import score_requests

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def prepared(spark):
    cfg = HierConfig()
    rows = hierarchy.prepare_rows(fixtures.tickets_docs(spark, SF_DIR), cfg)
    return hierarchy.embed_rows(rows, cfg)


def test_label_passes_do_not_read_texts(prepared):
    text = plan(encoding.label_sizes(prepared[1], "category", "label"))
    assert "text_obr" not in text and "UDF" not in text


def test_texts_are_cleaned_once(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    text = plan(hierarchy.drop_empty_texts(docs, "text"))
    assert text.count("lower(") == 1


def test_sampling_reads_ids_only(prepared):
    rows = prepared[1].select("row_id")
    text = plan(sampling.sample_rows(rows, "row_id", 10, 1))
    assert "text_obr" not in text and "Exchange hash" not in text and "Sort" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    counts = taxonomy.label_counts(fixtures.tickets_items(spark, SF_DIR), "category", "issue", "subissue")
    text = plan(taxonomy.top_keep_labels(counts, "category", "issue", "subissue", 5))
    assert "row_number(), 5, Partial" in text


def test_relabelling_does_not_move_rows(spark):
    items = fixtures.table(spark, SF_DIR, "part").select(
        F.col("p_type").alias("category"), F.col("p_brand").alias("issue"), F.col("p_name").alias("subissue"), "p_partkey"
    )
    text = plan(taxonomy.curate(items, HierConfig()))
    assert "BroadcastHashJoin" in text and "Exchange hash" not in text
    for bad in ("CartesianProduct", "NestedLoop"):
        assert bad not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(fixtures.tickets_docs(spark, SF_DIR).where(is_good_grade(F.col("grade"))).select("row_id"))
    assert "ReadSchema: struct<doc_id:bigint>" in text


def test_scoring_is_narrow(spark, prepared):
    encoder, rows = prepared
    import numpy as np

    head = Head((np.ones((2, encoder.dim)), np.zeros(2)), ["a", "b"], [None] * 2, [None] * 2)
    model = HierModel("m", encoder.encoder_id, encoder.weights, head, {"a": head})
    asked = rows.select("x", F.lit("m").alias("model_id"), F.lit(2).alias("topk_cat"), F.lit(2).alias("topk_sub"))
    assert "Exchange hash" not in plan(hier_predict(asked, [model]))
    reqs = spark.read.text(f"{SF_DIR}/conversations.parquet")
    assert "Exchange" not in plan(score_requests(reqs, [model], "m"))
    scores = linear.softmax_proba(rows.select("x"), {0: head.weights})
    assert "ArrowEvalPython" in plan(scores) and "BatchEvalPython" not in plan(scores)


def test_slots_are_counted_once(prepared):
    """The rows to embed read staged counts: one Python step, which weighs them."""
    text = plan(prepared[1].select("x"))
    assert text.count("ArrowEvalPython") == 1 and "md5" not in text and "count(" not in text
