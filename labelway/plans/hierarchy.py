"""The training job: labelled texts in, model tables out.

Text is cleaned once and written as its slot counts (as text for a user's encoder). Curation, class dictionaries and splits read
only the narrow columns of that table. Vectors are computed once into a
training table, laid out by category in equal parts; every training pass
serves the router and all heads together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelway.config import UNIQUE_RULE, HierConfig
from labelway.functions.labels import compose_label, is_good_grade, or_nan, split_label
from labelway.functions.text import clean_text, has_words, safe_key
from labelway.operators import encoding, linear, metrics, sampling, taxonomy
from labelway.operators.embedding import HashedTfIdf
from labelway.operators.joins import attach
from labelway.session import stage_table
from labelway.sources.model_store import ModelTables

PART_BYTES = 128 << 20


def graded_rows(rows: DataFrame, cfg: HierConfig) -> DataFrame:
    if cfg.use_grade_filter and cfg.grade_col in rows.columns:
        return rows.where(is_good_grade(F.col(cfg.grade_col)))
    return rows


def drop_empty_texts(rows: DataFrame, text_col: str) -> DataFrame:
    """Replaces the text by its cleaned form and drops blank ones.

    A filter on the cleaned text would be pushed down and clean everything
    twice, so blank texts are told by the cheaper test.
    """
    return rows.where(has_words(F.col(text_col))).withColumn(text_col, clean_text(F.col(text_col)))


def prepare_rows(rows: DataFrame, cfg: HierConfig, features: int | None = None) -> DataFrame:
    """Filtered, cleaned and curated rows: id, text, category, label parts.

    With ``features`` the text is replaced by its counts in so many slots as it is cleaned, so
    it is never written.
    """
    keys = [cfg.cat_col, cfg.issue_col, cfg.sub_col]
    graded = graded_rows(rows, cfg).select(
        *[c for c in [cfg.id_col] if c in rows.columns], cfg.text_col, *keys
    )
    if cfg.id_col not in rows.columns:
        # fixed by the write below
        graded = graded.withColumn(cfg.id_col, F.monotonically_increasing_id())
    texts = drop_empty_texts(graded, cfg.text_col)
    if features:
        texts = texts.withColumn(cfg.text_col, HashedTfIdf.packed_counts(F.col(cfg.text_col), features))
    cleaned = stage_table(texts, "cleaned")
    curated = taxonomy.curate(cleaned, cfg)
    if cfg.max_rows:
        curated = sampling.sample_rows(curated, cfg.id_col, cfg.max_rows, cfg.seed)
    return curated.select(
        F.col(cfg.id_col).alias("row_id"),
        F.col(cfg.text_col).alias("text"),
        or_nan(F.col(cfg.cat_col)).alias("category"),
        or_nan(F.col(cfg.issue_col)).alias("issue"),
        "subissue_unique",
        compose_label(F.col(cfg.issue_col), F.col("subissue_unique")).alias("label"),
    )


@dataclass
class TrainingSet:
    """A staged training table and the dictionaries of its models.

    ``rows``: row_id, cat_idx, head_idx (null when the row's label trains no
    head), router_split, head_split, x (packed vector).
    """

    rows: DataFrame
    categories: DataFrame
    plan: DataFrame
    head_classes: DataFrame
    dim: int

    def router_classes(self) -> dict[int, int]:
        return {0: self.categories.count()}

    def head_sizes(self) -> dict[int, int]:
        """Classes per trained head, by category index."""
        trained = self.plan.where("kind = 'trained'").select("category", "n_labels")
        pairs = trained.join(self.categories, "category").select("cat_idx", "n_labels")
        return {r["cat_idx"]: r["n_labels"] for r in pairs.toLocalIterator()}


def build_training_set(rows: DataFrame, x: Column, dim: int, cfg: HierConfig) -> TrainingSet:
    """``rows`` has row_id, category, label and whatever ``x`` needs: a dense array, or
    a sparse ``struct<indices,values>``, packed or not, of which a row stores 8 bytes an entry.

    Label columns are joined from small dictionaries, so no row moves before
    the one exchange that lays out the training table.
    """
    label_sizes = stage_table(encoding.label_sizes(rows, "category", "label"), "label-sizes")
    codes = stage_table(encoding.label_codes(label_sizes), "label-codes")
    total = codes.agg(F.sum("cnt")).first()[0] or 0
    sc = rows.sparkSession.sparkContext
    cores = sc.defaultParallelism
    # whole rounds of tasks: a pass waits for its last round
    parts = cores * max(1, math.ceil(total * dim * 4 / PART_BYTES / cores))

    coded = attach(rows, codes.drop("kind"), ["category", "label"], "cnt", ["row_id"])
    # Both levels are split in the same passes: model -1 is the router.
    roles = stage_table(
        coded.select(
            "row_id",
            F.inline(
                F.array(
                    F.struct(F.lit(-1).alias("model"), F.col("cat_idx").alias("cls")),
                    F.struct(F.col("cat_idx").alias("model"), F.col("head_idx").alias("cls")),
                )
            ),
        ).where("cls is not null"),
        "roles",
    )
    categories = codes.select("category", "cat_idx", F.col("cat_rows").alias("cnt")).distinct()
    sizes = categories.select(F.lit(-1).alias("model"), F.col("cat_idx").alias("cls"), "cnt").unionByName(
        codes.where("head_idx is not null").select(
            F.col("cat_idx").alias("model"), F.col("head_idx").alias("cls"), "cnt"
        )
    )
    cuts = sampling.split_table(
        roles, "row_id", "model", "cls", cfg.val_size, cfg.test_size, cfg.seed, sizes=sizes
    )
    router_cuts = cuts.where("model = -1").select(
        F.col("cls").alias("cat_idx"), "cnt", F.col("cuts").alias("router_cuts")
    )
    head_cuts = cuts.where("model >= 0").select(
        F.col("model").alias("cat_idx"), F.col("cls").alias("head_idx"), "cnt", F.col("cuts").alias("head_cuts")
    )
    split = attach(coded, router_cuts, ["cat_idx"], "cnt", ["row_id"])
    split = attach(split, head_cuts, ["cat_idx", "head_idx"], "cnt", ["row_id"])
    # Equal parts, ordered by category: part = position of the row's category
    # in the table plus a hash of the row inside it.
    inside = F.pmod(F.xxhash64("row_id"), F.lit(1 << 20)) / float(1 << 20)
    part = F.floor((F.col("before") + inside * F.col("cat_rows")) * parts / max(total, 1)).cast("int")
    column = sampling.split_column
    kind = rows.select(x.alias("x")).schema["x"].dataType
    if kind == linear.PACKED:
        packed = x
    else:
        packed = linear.pack_sparse(x) if isinstance(kind, T.StructType) else linear.pack_vectors(x)
    table = (
        split.select(
            "row_id",
            "cat_idx",
            "head_idx",
            column("row_id", cfg.seed, F.col("cat_idx"), F.col("router_cuts")).alias("router_split"),
            column("row_id", cfg.seed, F.col("head_idx"), F.col("head_cuts")).alias("head_split"),
            packed.alias("x"),
            F.least(part, F.lit(parts - 1)).alias("__part"),
        )
        .repartitionById(parts, F.col("__part"))
        .drop("__part")
    )
    plan = encoding.head_plan(codes, "category", "label")
    heads = encoding.head_classes(codes, plan, "category", "label")
    return TrainingSet(stage_table(table, "training-set"), categories, plan, heads, dim)


def router_task(data: TrainingSet, name: str, epochs: int, lr: float, wd: float) -> linear.LinearTask:
    return linear.LinearTask(name, "y_router", data.router_classes(), None, epochs, lr, wd)


def train_rows(data: TrainingSet, updates: int = 1) -> DataFrame:
    return data.rows.select(
        "x",
        "cat_idx",
        F.when(F.col("router_split") == "train", F.col("cat_idx")).alias("y_router"),
        F.when(F.col("head_split") == "train", F.col("head_idx")).alias("y_head"),
        linear.row_block(F.col("row_id"), updates).alias("block"),
    ).where("y_router is not null or y_head is not null")


def fit_weights(data: TrainingSet, cfg: HierConfig, router: bool = True, heads: bool = True) -> linear.Fitted:
    """Router and heads in the same passes, ``cfg.updates`` steps in each."""
    tasks = []
    if router:
        tasks.append(router_task(data, "router", cfg.router_epochs, cfg.router_lr, cfg.weight_decay))
    sizes = data.head_sizes() if heads else {}
    if sizes:
        tasks.append(
            linear.LinearTask(
                "heads", "y_head", sizes, "cat_idx", cfg.head_epochs, cfg.head_lr, cfg.weight_decay
            )
        )
    rows = train_rows(data, cfg.updates)
    return linear.softmax_fit(rows, "x", data.dim, tasks, cfg.updates, "block", cfg.tolerance)


def _hits(rows: DataFrame, fitted: linear.Fitted, name: str, label: str, group: str | None) -> DataFrame:
    """``rows`` with hit1 and hitk (3); a family that fits one broadcast gives whole
    probabilities, a larger one its best classes, merged over blocks."""
    if fitted.nbytes(name) <= linear.MODEL_BYTES:
        own = {grp: w for (_, grp), w in fitted.load(name).items()}
        return metrics.with_hits(linear.softmax_proba(rows, own, group), "proba", label)
    best = linear.best_classes(rows, fitted, name, group, 3)
    right = lambda b: b["class_idx"] == F.col(label)
    return best.withColumn("hit1", right(F.col("best")[0])).withColumn("hitk", F.exists("best", right))


def router_hits(data: TrainingSet, fitted: linear.Fitted) -> DataFrame:
    held = data.rows.where("router_split <> 'train'").select("x", "cat_idx", F.col("router_split").alias("split"))
    return _hits(held, fitted, "router", "cat_idx", None).select(
        F.lit(None).cast("int").alias("cat_idx"), "split", "hit1", "hitk"
    )


def head_hits(data: TrainingSet, fitted: linear.Fitted) -> DataFrame:
    held = data.rows.where("head_split <> 'train'").select(
        "x", "cat_idx", "head_idx", F.col("head_split").alias("split")
    )
    return _hits(held, fitted, "heads", "head_idx", "cat_idx").select("cat_idx", "split", "hit1", "hitk")


def evaluate(data: TrainingSet, fitted: linear.Fitted) -> DataFrame:
    """(cat_idx, four accuracies): null for the router, one row per trained head."""
    hits = router_hits(data, fitted)
    if any(name == "heads" for name, _ in fitted.classes):
        hits = hits.unionByName(head_hits(data, fitted))
    return metrics.head_stats(hits, ["cat_idx"])


def weights_frame(fitted: linear.Fitted) -> DataFrame:
    """Weights as rows, one per class; ``cat_idx`` is null for the router."""
    cat_idx = F.when(F.col("name") != "router", F.col("grp")).alias("cat_idx")
    return fitted.rows.select(cat_idx, "class_idx", "weights", "bias")


def model_tables(
    data: TrainingSet,
    fitted: linear.Fitted,
    cfg: HierConfig,
    encoder,
) -> ModelTables:
    """The five tables of a trained model."""
    spark = data.rows.sparkSession
    model_id = F.lit(cfg.model_id).alias("model_id")
    names = data.categories.select("category", "cat_idx")
    zero = F.array_repeat(F.lit(0.0), data.dim)

    single = data.plan.where("kind = 'single'").select(
        model_id, "category", F.lit(0).alias("class_idx"), zero.alias("weights"), F.lit(0.0).alias("bias")
    )
    weights = (
        weights_frame(fitted)
        .join(names, "cat_idx", "left")
        .select(model_id, "category", "class_idx", "weights", "bias")
    )
    no_text = F.lit(None).cast("string")
    issue, sub = split_label(F.col("label"))
    router_classes = data.categories.select(
        model_id, no_text.alias("category"), F.col("cat_idx").alias("class_idx"),
        F.col("category").alias("label"), no_text.alias("issue"), no_text.alias("subissue_unique"),
        "cnt", no_text.alias("only_label"),
    )
    head_classes = data.head_classes.select(
        model_id, "category", "class_idx", "label", issue.alias("issue"),
        sub.alias("subissue_unique"), "cnt", "only_label",
    )
    stats = (
        evaluate(data, fitted)
        .join(names, "cat_idx", "left")
        .select(
            model_id, "category", "val_top1_acc", "val_top3_acc", "test_top1_acc", "test_top3_acc",
            F.lit("").alias("note"),
        )
    )
    single_stats = data.plan.where("kind = 'single'").select(
        model_id, "category", *[F.lit(None).cast("double").alias(c) for c in stats.columns[2:6]],
        F.lit("single-class head").alias("note"),
    )
    mapping = head_mapping(data.plan, cfg)
    encoder_weights = getattr(encoder, "weights", None)
    meta = spark.range(1).select(
        model_id,
        F.lit(encoder.encoder_id).alias("encoder_id"),
        (F.lit(None) if encoder_weights is None else F.array(*map(F.lit, encoder_weights)))
        .cast("array<double>")
        .alias("encoder_weights"),
        F.lit(data.dim).alias("dim"),
        F.lit(cfg.min_count).alias("min_subissue_count"),
        F.lit(cfg.top_keep).alias("top_keep_per_issue"),
        F.lit(UNIQUE_RULE).alias("subissue_unique_rule"),
    )
    return ModelTables(
        stage_table(weights.unionByName(single), "weights"),
        router_classes.unionByName(head_classes),
        stage_table(stats.unionByName(single_stats), "stats"),
        mapping,
        meta,
    )


def head_mapping(plan: DataFrame, cfg: HierConfig) -> DataFrame:
    """(model_id, category, head_saved, dir_name); ``n_same_dir`` counts
    categories whose display keys collide."""
    saved = F.col("kind") != "none"
    same = Window.partitionBy("__key")
    return (
        plan.select("category", saved.alias("head_saved"))
        .withColumn("__key", safe_key(F.col("category")))
        .withColumn("n_same_dir", F.count(F.lit(1)).over(same))
        .select(
            F.lit(cfg.model_id).alias("model_id"),
            "category",
            "head_saved",
            F.when(F.col("head_saved"), F.col("__key")).alias("dir_name"),
            "n_same_dir",
        )
    )


def train_summary(tables: ModelTables) -> DataFrame:
    """One row: router metrics, all categories, and those with a head."""
    router = tables.stats.where("category is null")
    cats = tables.mapping.groupBy("model_id").agg(
        F.sort_array(F.collect_list("category")).alias("kept_categories"),
        F.sort_array(F.collect_list(F.when(F.col("head_saved"), F.col("category")))).alias("heads_saved"),
    )
    return router.join(cats, "model_id").select(
        "model_id",
        F.col("val_top1_acc").alias("router_val_top1"),
        F.col("val_top3_acc").alias("router_val_top3"),
        F.col("test_top1_acc").alias("router_test_top1"),
        F.col("test_top3_acc").alias("router_test_top3"),
        "kept_categories",
        "heads_saved",
    )


def embed_rows(prepared: DataFrame, cfg: HierConfig, encoder=None):
    """(encoder, rows with ``x``); the default encoder is fitted on the rows.

    ``x`` is sparse if the encoder can give it so. For the default encoder the texts are
    counted once, here or by ``prepare_rows``; the rows come without them.
    """
    if encoder is None and HashedTfIdf.is_counted(prepared, "text"):
        encoder = HashedTfIdf.fit(prepared, "text", cfg.features)
        return encoder, encoder.encode_packed(prepared, "text", "x").drop("text")
    if encoder is None:
        slots = HashedTfIdf.packed_counts(F.col("text"), cfg.features)
        counts = stage_table(prepared.withColumn("slots", slots).drop("text"), "slot-counts")
        encoder = HashedTfIdf.fit(counts, "slots", cfg.features)
        return encoder, encoder.encode_packed(counts, "slots", "x").drop("slots")
    encode = getattr(encoder, "encode_sparse", encoder.encode)
    return encoder, encode(prepared, "text", "x")


def fit_hierarchy(rows: DataFrame, cfg: HierConfig, encoder=None) -> ModelTables:
    """The whole training job."""
    # of a sample, only its own texts are counted
    counted = cfg.features if encoder is None and not cfg.max_rows else None
    prepared = prepare_rows(rows, cfg, counted)
    encoder, embedded = embed_rows(prepared, cfg, encoder)
    data = build_training_set(embedded, F.col("x"), encoder.dim, cfg)
    return model_tables(data, fit_weights(data, cfg), cfg, encoder)
