"""Language identification: words first, character n-grams for unseen words.

Per-language log frequencies of words and of character n-grams are counted over
all training rows in Spark. A known word scores its log frequency in each
language; for a word never seen, each position scores the longest known n-gram
that starts there (three characters, then two, then one), and the word the mean
over its positions. The language of the largest sum wins, ties by name.

The model keeps the most frequent words, n-grams and languages up to bounds that
are parameters; it is broadcast, so texts are read once and never shuffled.

Defined cases: null texts and texts without a letter are ``und`` with score 0.
Without any training row every text is ``und``. Rows with a null id are not
learned from. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelway.llm.common import crc_mod, packed, table
from labelway.session import stage_table

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageConfig:
    known_words: int = 100_000
    known_grams: int = 100_000
    languages: int = 256
    longest: int = 3
    smoothing: float = 0.5


@dataclass
class LanguageModel:
    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    longest: int

    def backoff(self, words: list[str]) -> np.ndarray:
        """For each word the mean, over its positions, of the longest known n-gram's scores."""
        get, parts = self.grams.get, [np.zeros((0, len(self.languages)))]
        for at in range(0, len(words), PART // 10):
            rows, starts = [], []
            for word in words[at : at + PART // 10]:
                padded = f"<{word}>"
                keys = [padded[i : i + self.longest] for i in range(len(padded) - 1)]
                found = list(map(get, keys))
                if None in found:
                    found = [self.shorter(key) if k is None else k for key, k in zip(keys, found)]
                    found = [k for k in found if k is not None] or [len(self.grams)]  # a row of zeros
                starts.append(len(rows))
                rows += found
            sizes = np.diff([*starts, len(rows)])[:, None]
            parts.append(np.add.reduceat(self.gram_scores[rows], starts) / sizes)
        return np.concatenate(parts)

    def shorter(self, key: str) -> int | None:
        return next((k for n in range(len(key) - 1, 0, -1) if (k := self.grams.get(key[:n])) is not None), None)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known, unseen, indices = len(self.words), {}, []
        for text in texts:
            words = WORD.findall((text or "").lower())
            index = list(map(self.words.get, words))
            if None in index:
                index = [unseen.setdefault(w, known + len(unseen)) if k is None else k for w, k in zip(words, index)]
            indices.append(np.array(index if any(c.isalpha() for w in words for c in w) else [], int))
        extra = self.backoff(list(unseen)) if self.languages else None
        return [self.decide(x[x < known], x[x >= known] - known, extra) for x in indices]

    def decide(self, known: np.ndarray, unseen: np.ndarray, extra: np.ndarray) -> tuple[str, float]:
        if not self.languages or not len(known) + len(unseen):
            return UNKNOWN, 0.0
        total = summed(self.word_scores, known) + summed(extra, unseen)
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def summed(scores: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of those rows, some thousands at a time."""
    return sum((scores[rows[at : at + PART]].sum(0) for at in range(0, len(rows), PART)), np.zeros(scores.shape[1]))


PART = 20_000
SLICE = 100
HELD_WORDS = 300_000


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, lang, n) of all rows of (lang, text). Each task adds up what it reads, and
    passes its sums on whenever it holds more than ``HELD_WORDS`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, Counter[str]] = defaultdict(Counter)

        def sums() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                columns = [pa.array(list(own)), pa.array([lang] * len(own)), pa.array(list(own.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["word", "lang", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if words := WORD.findall(text.as_py().lower()):
                    held[lang].update(words)
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from sums()
        yield from sums()

    found = rows.select("lang", "text").mapInArrow(run, "word string, lang string, n long")
    return found.groupBy("word", "lang").agg(F.sum("n").alias("n"))


def per_language(counts: DataFrame, key: str, limit: int, least: int) -> tuple[list[str], pa.Array]:
    """The most frequent keys, at most ``limit``, with their counts by language as maps.

    The cut is a total, found in the histogram of totals, so only kept keys reach
    the driver; keys of the total at which the limit would be passed stay out.
    """
    by = F.map_from_entries(F.collect_list(F.struct("lang", "n")))
    sums = stage_table(
        counts.groupBy(key).agg(F.sum("n").alias("total"), by.alias("by")).filter(F.col("total") >= least), "sums"
    )
    histogram = sums.groupBy("total").agg(F.count(F.lit(1)).alias("keys")).orderBy(F.desc("total")).limit(limit)
    cut, room = None, limit
    for row in histogram.collect():
        room -= row["keys"]
        if room < 0:
            break
        cut = row["total"]
    kept = sums.filter(F.col("total") >= F.lit(cut)).select(key, "by").orderBy(key).toArrow()
    return kept.column(key).to_pylist(), kept.column("by").combine_chunks()


def learn(train: DataFrame, cfg: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Model of the rows of ``train`` (text, lang)."""
    rows = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = stage_table(word_counts(rows), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(cfg.languages)
    totals = {r["lang"]: r["n"] for r in totals.collect()}
    languages = sorted(totals)
    counts = counts.filter(F.col("lang").isin(languages))
    # n-grams of word types, each as often as it has languages: rare words are what backoff is for
    padded = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    each = [
        F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i, n=n: F.substring(padded, i, F.lit(n)))
        for n in range(1, cfg.longest + 1)
    ]
    grams = counts.select("lang", F.explode(F.concat(*each)).alias("gram"))
    grams = grams.groupBy("gram", "lang").agg(F.count(F.lit(1)).alias("n"))
    words, words_by = per_language(counts, "word", cfg.known_words, 2)
    known_grams, grams_by = per_language(grams, "gram", cfg.known_grams, 1)

    number = {x: i for i, x in enumerate(languages)}

    def scores(by: pa.Array) -> np.ndarray:
        out = np.full((len(by), len(languages)), cfg.smoothing)
        rows = np.repeat(np.arange(len(by)), np.diff(by.offsets.to_numpy()))
        out[rows, [number[x] for x in by.keys.to_pylist()]] += by.items.to_numpy()
        return np.log(out / np.maximum(out.sum(0), 1.0))

    return LanguageModel(
        languages,
        {w: i for i, w in enumerate(words)},
        scores(words_by),
        {g: i for i, g in enumerate(known_grams)},
        np.vstack([scores(grams_by), np.zeros(len(languages))]),
        cfg.longest,
    )


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``row`` (the input row), ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                found = own.predict_all(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([x for x, _ in found], pa.string()),
                        pa.array([s for _, s in found], pa.float64()),
                    ],
                    ["row", "lang_pred", "score"],
                )

    source = packed(docs, F.col(text_col).alias("text"))
    kind = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(run, f"row {kind}, lang_pred string, score double")


def q_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = learn(docs.filter(~held).select("text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select(
        "row.doc_id",
        F.coalesce(crc_mod(F.col("row.doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )
