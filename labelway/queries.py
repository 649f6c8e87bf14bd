"""One query per operator over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelway.config import HierConfig
from labelway.functions.arrays import top_classes
from labelway.functions.labels import compose_label, is_good_grade, or_nan, split_label
from labelway.functions.text import clean_text, safe_key
from labelway.operators import encoding, linear, metrics, sampling, taxonomy
from labelway.operators.embedding import HashedTfIdf
from labelway.operators.predict import hier_predict, predict_by_blocks
from labelway.operators.requests import validate_requests
from labelway.plans import hierarchy, tune
from labelway.session import scratch_path, ship_package, stage_table
from labelway.sources import fixtures, model_store
from labelway.sources.model_store import Head, HierModel
from labelway.sources.tables import load_table
from labelway.streaming.requests import score_requests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GROUPED = HierConfig(min_count=30, top_keep=5)
RELAXED = HierConfig(min_count=50, top_keep=2)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__.removeprefix("q_")] = run
    return run


# --- text and labels -------------------------------------------------------


@query
def q_clean_text(spark, sf):
    docs = fixtures.table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("row_id"), clean_text(F.col("text")).alias("text_clean"))


@query
def q_grade_filter(spark, sf):
    return fixtures.tickets_docs(spark, sf).where(is_good_grade(F.col("grade"))).select("row_id", "grade")


@query
def q_drop_empty_texts(spark, sf):
    pages = fixtures.table(spark, sf, "pages").select(
        F.col("page_id").alias("row_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text_obr")
    )
    turns = fixtures.table(spark, sf, "conversations").select(
        (-1 - (F.col("conv_id") * 1000 + F.col("turn"))).alias("row_id"), F.col("text").alias("text_obr")
    )
    return hierarchy.drop_empty_texts(pages.unionByName(turns), "text_obr")


@query
def q_safe_key(spark, sf):
    name = F.concat("p_type", F.lit("  "), "p_name", F.lit(" / "), "p_brand", F.lit(" "))
    parts = fixtures.table(spark, sf, "part").select("p_partkey", name.alias("name"))
    return parts.withColumn("dir_name", safe_key(F.col("name")))


def _labelled(spark, sf) -> DataFrame:
    return fixtures.tickets_docs(spark, sf).select(
        "row_id",
        or_nan(F.col("category")).alias("category"),
        compose_label(F.col("issue"), F.col("subissue")).alias("label"),
    )


def _fine_labels(spark, sf) -> DataFrame:
    """Many small categories: all kinds of heads occur."""
    return fixtures.tickets_docs(spark, sf).select(
        "row_id", F.concat_ws("/", "category", "issue", "subissue").alias("category"), F.col("grade").alias("label")
    )


@query
def q_compose_label(spark, sf):
    return _labelled(spark, sf).select("row_id", "label")


@query
def q_decompose_label(spark, sf):
    label, kind = F.col("label"), F.col("row_id") % 4
    odd = (
        F.when(kind == 0, "__single__")
        .when(kind == 1, F.replace(label, F.lit("__SEP__"), F.lit("-")))
        .when(kind == 2, F.concat(label, F.lit("__SEP__x")))
        .otherwise(label)
    )
    rows = _labelled(spark, sf).select("row_id", odd.alias("label"))
    issue, sub = split_label(F.col("label"))
    return rows.select("row_id", "label", issue.alias("issue"), sub.alias("subissue_unique"))


@query
def q_stage_counts(spark, sf):
    return metrics.stage_counts(fixtures.tickets_docs(spark, sf), "grade", "text_obr", max_rows=200)


@query
def q_load_table(spark, sf):
    path = scratch_path(spark, "tickets") + ".csv"
    fixtures.tickets_docs(spark, sf).write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    return load_table(spark, path)


# --- label tree ------------------------------------------------------------


@query
def q_ambiguous_labels(spark, sf):
    return taxonomy.ambiguous_labels(fixtures.tickets_items(spark, sf), "issue", "subissue")


@query
def q_label_counts(spark, sf):
    return taxonomy.label_counts(fixtures.tickets_items(spark, sf), "category", "issue", "subissue")


def _cell_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category", "issue", "subissue_unique").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def q_disambiguate_labels(spark, sf):
    return _cell_counts(taxonomy.disambiguate_labels(fixtures.tickets_items(spark, sf), GROUPED))


@query
def q_top_keep_labels(spark, sf):
    named = taxonomy.disambiguate_labels(fixtures.tickets_items(spark, sf), GROUPED)
    counts = taxonomy.label_counts(named, "category", "issue", "subissue_unique")
    return taxonomy.top_keep_labels(counts, "category", "issue", "subissue_unique", 5)


@query
def q_group_lowfreq(spark, sf):
    named = taxonomy.disambiguate_labels(fixtures.tickets_items(spark, sf), GROUPED)
    return _cell_counts(taxonomy.group_lowfreq(named, GROUPED))


@query
def q_group_lowfreq_relaxed(spark, sf):
    named = taxonomy.disambiguate_labels(fixtures.tickets_items(spark, sf), RELAXED)
    return _cell_counts(taxonomy.group_lowfreq(named, RELAXED))


@query
def q_curate(spark, sf):
    return _cell_counts(taxonomy.curate(fixtures.tickets_items(spark, sf), GROUPED))


@query
def q_curation_report(spark, sf):
    return taxonomy.curation_report(fixtures.tickets_items(spark, sf), GROUPED)


# --- dictionaries, splits, samples -----------------------------------------


@query
def q_head_label_counts(spark, sf):
    return encoding.label_sizes(_labelled(spark, sf), "category", "label")


@query
def q_head_training_rows(spark, sf):
    return encoding.head_training_rows(_labelled(spark, sf), "category", "label", "row_id")


@query
def q_head_plan(spark, sf):
    sizes = encoding.label_sizes(_fine_labels(spark, sf), "category", "label")
    return encoding.head_plan(sizes, "category", "label")


@query
def q_model_manifest(spark, sf):
    sizes = encoding.label_sizes(_fine_labels(spark, sf), "category", "label")
    plan = encoding.head_plan(sizes, "category", "label")
    mapping = hierarchy.head_mapping(plan, HierConfig(model_id="manifest"))
    return mapping.select("model_id", "category", "head_saved", "dir_name")


def _encoded(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = _labelled(spark, sf)
    sizes = stage_table(encoding.label_sizes(rows, "category", "label"), "sizes")
    cats = stage_table(encoding.class_table(rows, "category"), "categories")
    heads = encoding.head_classes(sizes, encoding.head_plan(sizes, "category", "label"), "category", "label")
    coded = encoding.encode_labels(rows, cats, "category", "cat_idx", "row_id")
    return encoding.encode_labels(coded, stage_table(heads, "heads"), "label", "head_idx", "row_id", "category"), cats


@query
def q_encode_labels(spark, sf):
    return _encoded(spark, sf)[0].select("row_id", "cat_idx", "head_idx")


@query
def q_decode_labels(spark, sf):
    coded, cats = _encoded(spark, sf)
    return encoding.decode_labels(coded.select("row_id", "cat_idx"), cats, "cat_idx", "category", "row_id").select(
        "row_id", "category"
    )


@query
def q_stratified_split(spark, sf):
    rows = fixtures.tickets_docs(spark, sf).select("row_id", "category")
    return sampling.stratified_split(rows, "row_id", None, "category", 0.05, 0.05, 42)


@query
def q_val_test_split(spark, sf):
    rows = _labelled(spark, sf)
    split = sampling.stratified_split(rows, "row_id", "category", "label", 0.05, 0.05, 42)
    return sampling.one_row_per_split(split)


@query
def q_sample_rows(spark, sf):
    return sampling.sample_rows(fixtures.tickets_docs(spark, sf), "row_id", 500, 42).select("row_id")


# --- vectors and models ----------------------------------------------------


@query
def q_embed_texts(spark, sf):
    docs = fixtures.table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), clean_text(F.col("text")).alias("text")
    )
    counts = stage_table(docs.select("row_id", HashedTfIdf.slot_counts(F.col("text"), 1024).alias("slots")), "slot-counts")
    encoder = HashedTfIdf.fit(counts, "slots", 1024)
    entries = encoder.encode_sparse(counts, "slots", "x").select(
        "row_id", F.inline(F.arrays_zip(F.col("x.indices").alias("slot"), F.col("x.values").alias("value")))
    )
    return entries.select("row_id", "slot", F.round(F.col("value").cast("double"), 5).alias("value"))


def _long(df: DataFrame, array: str, name: str) -> DataFrame:
    return df.select("row_id", F.posexplode(array).alias("class_idx", name)).withColumn(name, F.round(name, 6))


@query
def q_linear_scores(spark, sf):
    rows = fixtures.vectors(spark, sf)
    weights = linear.centroid_weights(rows, "label")
    return _long(linear.linear_scores(rows, weights), "scores", "score")


def _label_proba(spark, sf) -> DataFrame:
    rows = fixtures.vectors(spark, sf)
    return linear.softmax_proba(rows, linear.centroid_weights(rows, "label"))


@query
def q_softmax_proba(spark, sf):
    return _long(_label_proba(spark, sf), "proba", "proba")


@query
def q_topk_classes(spark, sf):
    best = _label_proba(spark, sf).select(
        "row_id", F.posexplode(top_classes(F.col("proba"), 3)).alias("pos", "best")
    )
    return best.select(
        "row_id",
        (F.col("pos") + 1).alias("rank"),
        F.col("best.class_idx").alias("class_idx"),
        F.round("best.proba", 6).alias("proba"),
    )


@query
def q_topk_accuracy(spark, sf):
    out = metrics.topk_accuracy(_label_proba(spark, sf), "proba", "label", 3)
    return out.select("n_rows", F.round("top1_acc", 6).alias("top1_acc"), F.round("top3_acc", 6).alias("top3_acc"))


def _vector_set(spark, sf) -> hierarchy.TrainingSet:
    rows = fixtures.vectors(spark, sf).select(
        "row_id",
        F.concat(F.lit("c"), F.col("category").cast("string")).alias("category"),
        F.concat(F.lit("l"), F.col("label").cast("string")).alias("label"),
        "x",
    )
    return hierarchy.build_training_set(rows, F.col("x"), 64, HierConfig())


@query
def q_head_stats(spark, sf):
    rows = fixtures.vectors(spark, sf)
    data = _vector_set(spark, sf)
    codes = data.rows.drop("x")
    full = codes.join(rows.select("row_id", "x"), "row_id")
    train = stage_table(full, "vectors-with-splits")
    router = linear.centroid_weights(train.where("router_split = 'train'"), "cat_idx")
    heads = linear.centroid_weights(train.where("head_split = 'train'"), "head_idx", "cat_idx")
    weights = {("router", 0): router[0], **{("heads", g): w for g, w in heads.items()}}
    fitted = linear.Fitted(
        linear.weights_rows(spark, weights), 64, {key: len(b) for key, (_, b) in weights.items()}
    )
    return hierarchy.evaluate(data, fitted).select(
        F.coalesce("cat_idx", F.lit(-1)).alias("model"),
        *["val_top1_acc", "val_top3_acc", "test_top1_acc", "test_top3_acc"],
    )


def _vector_model(rows: DataFrame) -> HierModel:
    """Centroid router and heads; category 4 has no head."""
    router = linear.centroid_weights(rows, "category")[0]
    heads = linear.centroid_weights(rows, "label", "category")
    names = lambda g: [2 * g, 2 * g + 1][: len(heads[g][1])]
    return HierModel(
        "vectors",
        "given",
        None,
        Head(router, [f"c{c}" for c in range(len(router[1]))], [None] * len(router[1]), [None] * len(router[1])),
        {
            f"c{g}": Head(
                w,
                [f"i{c % 2}__SEP__l{c}" for c in names(g)],
                [f"i{c % 2}" for c in names(g)],
                [f"l{c}" for c in names(g)],
            )
            for g, w in heads.items()
            if g != 4
        },
    )


def _asked(rows: DataFrame) -> DataFrame:
    return rows.select(
        "row_id", "x", F.lit("vectors").alias("model_id"), F.lit(2).alias("topk_cat"), F.lit(5).alias("topk_sub")
    )


def _predictions_long(predicted: DataFrame) -> DataFrame:
    cats = predicted.select("row_id", F.posexplode("predictions").alias("cp", "c"))
    subs = cats.select("row_id", "cp", "c", F.posexplode_outer("c.subissues").alias("sp", "s"))
    return subs.select(
        "row_id",
        (F.col("cp") + 1).alias("cat_rank"),
        F.col("c.category").alias("category"),
        F.round("c.proba", 6).alias("cat_proba"),
        (F.col("sp") + 1).alias("sub_rank"),
        F.col("s.label").alias("label"),
        F.col("s.issue").alias("issue"),
        F.col("s.subissue_unique").alias("subissue_unique"),
        F.round("s.proba", 6).alias("sub_proba"),
    )


@query
def q_hier_predict(spark, sf):
    rows = fixtures.vectors(spark, sf)
    return _predictions_long(hier_predict(_asked(rows), [_vector_model(rows)]))


@query
def q_hier_predict_blocks(spark, sf):
    """The same from blocks of one class: every head and the router are merged from several."""
    rows = fixtures.vectors(spark, sf)
    return _predictions_long(predict_by_blocks(_asked(rows), [_vector_model(rows)], limit=1))


@query
def q_softmax_gradient_step(spark, sf):
    rows = fixtures.vectors(spark, sf).select(linear.pack_vectors(F.col("x")).alias("x"), "label")
    k = rows.select("label").distinct().count()
    task = linear.LinearTask("one", "label", {0: k})
    sums = linear.gradient_sums(rows, "x", [task], {(0, 0): np.zeros((k, 65))})
    grad = sums.select("class_idx", "n", F.posexplode("grad").alias("dim", "g")).where("dim < 64")
    return grad.select("class_idx", "dim", F.round(F.col("g") / F.col("n"), 9).alias("grad"))


def _weights_long(fitted: linear.Fitted) -> DataFrame:
    return hierarchy.weights_frame(fitted).select(
        F.coalesce("cat_idx", F.lit(-1)).alias("model"),
        "class_idx",
        F.posexplode(F.concat("weights", F.array("bias"))).alias("dim", "weight"),
    ).withColumn("weight", F.round("weight", 6))


@query
def q_softmax_fit(spark, sf):
    rows = stage_table(
        fixtures.vectors(spark, sf).select(
            linear.pack_vectors(F.col("x")).alias("x"), "category", (F.col("label") % 2).alias("sub")
        ),
        "packed",
    )
    groups = [r[0] for r in rows.select("category").distinct().toLocalIterator()]
    tasks = [
        linear.LinearTask("router", "category", {0: len(groups)}, epochs=3),
        linear.LinearTask("heads", "sub", dict.fromkeys(groups, 2), "category", epochs=3),
    ]
    return _weights_long(linear.softmax_fit(rows, "x", 64, tasks))


@query
def q_softmax_fit_blocks(spark, sf):
    """Three steps in each of two passes, on fixed blocks of rows."""
    rows = stage_table(
        fixtures.vectors(spark, sf).select(
            linear.pack_vectors(F.col("x")).alias("x"), "category", linear.row_block(F.col("row_id"), 3).alias("block")
        ),
        "packed",
    )
    n = rows.select("category").distinct().count()
    task = linear.LinearTask("router", "category", {0: n}, epochs=2)
    return _weights_long(linear.softmax_fit(rows, "x", 64, [task], 3, "block"))


@query
def q_train_router(spark, sf):
    data = _vector_set(spark, sf)
    weights = hierarchy.fit_weights(data, HierConfig(router_epochs=5), heads=False)
    return hierarchy.evaluate(data, weights).drop("cat_idx")


@query
def q_train_heads(spark, sf):
    data = _vector_set(spark, sf)
    weights = hierarchy.fit_weights(data, HierConfig(head_epochs=4), router=False)
    stats = metrics.head_stats(hierarchy.head_hits(data, weights), ["cat_idx"])
    return data.categories.select("category", "cat_idx").join(stats, "cat_idx").drop("cat_idx")


def _scored_trials(spark, sf) -> DataFrame:
    """Trials of a centroid router whose bias the learning rate scales."""
    rows = fixtures.vectors(spark, sf)
    w, b = linear.centroid_weights(rows, "category")[0]
    trials = tune.trial_table(spark, 12, 42, HierConfig())
    rates = [t["router_lr"] for t in trials.orderBy("trial").toLocalIterator()]
    scores = tune.trial_scores(rows, "category", [(w, b * rate * 200) for rate in rates])
    return trials.join(scores, "trial").select(
        "trial", F.round("router_lr", 12).alias("router_lr"), "router_epochs", F.round("score", 6).alias("score")
    )


@query
def q_trial_table(spark, sf):
    return _scored_trials(spark, sf)


@query
def q_best_trial(spark, sf):
    return tune.best_trial(_scored_trials(spark, sf))


@query
def q_tune_router(spark, sf):
    """Five trials of the router in the same passes; after two of them the better half goes on."""
    cfg = HierConfig(router_epochs=4)
    space = tune.TuneSpace(epochs_low=2, epochs_high=6)
    trials = tune.run_trials(_vector_set(spark, sf), cfg, 5, space=space, rungs=(2,))
    return trials.select("trial", "router_epochs", F.round("score", 6).alias("score"), "finished")


@query
def q_train_summary(spark, sf):
    data = _vector_set(spark, sf)
    cfg = HierConfig(model_id="vectors", router_epochs=3, head_epochs=2)
    given = type("Given", (), {"encoder_id": "given", "weights": None})
    tables = hierarchy.model_tables(data, hierarchy.fit_weights(data, cfg), cfg, given)
    out = hierarchy.train_summary(tables)
    return out.withColumns({c: F.array_join(c, "|") for c in ("kept_categories", "heads_saved")})


# --- whole jobs ------------------------------------------------------------


@query
def q_fit_hierarchy(spark, sf):
    """Four passes of four steps each."""
    cfg = HierConfig(model_id="docs", router_epochs=4, head_epochs=4, updates=4)
    return hierarchy.fit_hierarchy(fixtures.tickets_heads(spark, sf), cfg).stats


@query
def q_validate_requests(spark, sf):
    checked = validate_requests(fixtures.requests(spark, sf), ["default"], "default").drop("device")
    return checked.withColumns({c: F.col(c).cast("string") for c in ("topk_cat", "topk_sub")})


@query
def q_score_requests(spark, sf):
    cfg = HierConfig(router_epochs=10, head_epochs=10)
    tables = hierarchy.fit_hierarchy(fixtures.tickets_heads(spark, sf), cfg)
    root = scratch_path(spark, "models")
    model_store.save_model(tables, root)
    model = model_store.load_model(model_store.open_tables(spark, root, cfg.model_id))
    scored = score_requests(fixtures.requests(spark, sf), [model], cfg.model_id)
    answer = F.from_json("response", "predictions array<struct<category:string,proba:double>>")
    best_first = F.sort_array(F.col("a.predictions.proba"), asc=False) == F.col("a.predictions.proba")
    return scored.withColumn("a", F.when(F.col("status") == 200, answer)).select(
        "req_id",
        "status",
        F.get_json_object("response", "$.error").alias("error"),
        F.when(F.col("status") == 200, F.size("a.predictions")).alias("n_categories"),
        best_first.alias("best_first"),
    )
