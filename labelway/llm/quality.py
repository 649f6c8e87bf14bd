"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, in SQL functions only.

Two multinomials over hashed word unigrams and bigrams are counted: the raw
corpus (every document) and the trusted target (documents labelled good). A
document's score is the mean over its n-grams of ``log p_target - log p_raw``;
the document is kept if it passes the base rules and the score reaches a fixed
threshold.

Defined cases: a null text is an empty one (no words, base rules fail). Without
trusted documents both distributions are flat against each other, the score is 0
and only the base rules decide. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelway.llm.common import let, packed, table

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 8


@dataclass(frozen=True)
class QualityConfig:
    """``buckets`` bounds the model (8 bytes each); ``trusted_rows`` bounds the
    labelled sample that the target is counted on (the raw counts cover all rows)."""

    buckets: int = 1 << 16
    smoothing: float = 0.5
    trusted_rows: int = 20_000
    threshold: float = -0.15
    min_words: int = 20
    repeat_percent: int = 30


def word_hashes(text: Column) -> Column:
    """One 64-bit hash per word, in text order."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def ngram_buckets(hashes: Column, buckets: int) -> Column:
    """Buckets of all unigrams and bigrams of a materialised hash array."""
    unigrams = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    pairs = F.zip_with(
        hashes,
        F.slice(hashes, 2, F.greatest(F.size(hashes), F.lit(1))),
        lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"),
    )
    return F.concat(unigrams, F.slice(pairs, 1, F.greatest(F.size(hashes) - 1, F.lit(0))))


def repeat_words(hashes: Column) -> Column:
    """Words inside windows of eight words that occur twice or more.

    Windows are compared by 64-bit hash. Starts of repeated windows, in order,
    each cover the words up to the next start, eight at most.
    """

    def covered(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.filter(
                s,
                lambda x, i: x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"]),
            )
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(
                p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))
            )
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            let(let(pairs, starts), total)
        )

    windows = F.transform(
        F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)),
        lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW))),
    )
    return F.when(F.size(hashes) < WINDOW, F.lit(0).cast("long")).otherwise(let(windows, covered))


def base_columns(text: Column, hashes: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    n_words = F.size(hashes).cast("long")
    return [
        n_words.alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeat_words(hashes).alias("n_repeat_words"),
    ]


def ngram_weights(docs: DataFrame, labels: DataFrame, cfg: QualityConfig) -> str:
    """The log ratio of every bucket, in order, as one text of ``buckets`` numbers.

    It is the whole model: its size is the parameter ``buckets``, not the data's.

    The trusted ids are a bounded sample in hash order, so the join is a
    broadcast of at most ``trusted_rows`` ids and texts never move. Counting is a
    map-side hash aggregation over ``buckets`` keys.
    """
    trusted = (
        labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("trusted_id"))
        .distinct()
        .orderBy(F.xxhash64("trusted_id"), "trusted_id")
        .limit(cfg.trusted_rows)
    )
    grams = (
        docs.select(F.col("doc_id"), word_hashes(F.col("text")).alias("h"))
        .join(F.broadcast(trusted), F.col("doc_id") == F.col("trusted_id"), "left")
        .select(
            F.col("trusted_id").isNotNull().cast("long").alias("good"),
            F.explode(ngram_buckets(F.col("h"), cfg.buckets)).alias("bucket"),
        )
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good"))
    )
    counts = (
        docs.sparkSession.range(cfg.buckets)
        .select(F.col("id").cast("int").alias("bucket"))
        .join(grams, "bucket", "left")
        .select(
            "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good")
        )
    )
    rows = F.array_sort(F.collect_list(F.struct("bucket", "raw", "good")))
    prior = cfg.smoothing * cfg.buckets

    def ratio(x: Column, raw: Column, good: Column) -> Column:
        # the target backs off to the raw distribution: no trusted rows, no opinion
        p_raw = (x["raw"] + cfg.smoothing) / (raw + prior)
        p_good = (x["good"] + prior * p_raw) / (good + prior)
        return F.round(F.log(p_good / p_raw), 4).cast("string")

    total = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"), rows.alias("rows"))
    weights = F.array_join(F.transform("rows", lambda x: ratio(x, F.col("raw"), F.col("good"))), ",")
    return total.select(weights.alias("weights")).first()["weights"]


def score(docs: DataFrame, weights: str, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """``row`` (the input row) and ``quality``: the base columns, ``llr``, ``base_failed``, ``kept``."""
    log_ratio = F.split(F.lit(weights), ",").cast("array<double>")  # folded once by the optimizer

    def verdict(q: Column) -> Column:
        failed = (q["n_words"] < cfg.min_words) | (
            100 * q["n_repeat_words"] > cfg.repeat_percent * q["n_words"]
        )
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"]
        return F.struct(
            *[q[n].alias(n) for n in names],
            failed.alias("base_failed"),
            (~failed & (q["llr"] >= cfg.threshold)).alias("kept"),
        )

    def measured(h: Column) -> Column:
        llr = let(
            ngram_buckets(h, cfg.buckets),
            lambda b: F.aggregate(
                b,
                F.lit(0.0),
                lambda acc, x: acc + F.get(log_ratio, x),
                lambda acc: acc / F.greatest(F.size(b), F.lit(1)),
            ),
        )
        return let(F.struct(*base_columns(F.col("text"), h), llr.alias("llr")), verdict)

    # one expression per row, bound step by step: a filter on it never repeats its parts
    return packed(docs, let(word_hashes(F.col("text")), measured).alias("quality"))


def q_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    cfg = QualityConfig()
    found = score(docs.select("doc_id", "text"), ngram_weights(docs, labels, cfg), cfg)
    return found.select("row.doc_id", "quality.*")
