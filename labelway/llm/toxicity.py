"""Toxic spans by a linear-chain conditional random field.

Labels exist per document only, so tokens are labelled first: in toxic training
documents a token is toxic if its word, or a prefix of it, occurs in many more
toxic than clean training documents. A two-state CRF over sentences is trained
on these labelled tokens: emissions are weights of the lower-case word, its
prefixes and its suffix, transitions are free. Every text is then tagged
as a whole: forward-backward gives each token's toxic marginal; the document's
score is a logistic function of the log odds of the largest, and runs of tokens
with a marginal of at least one half are the offending spans (code point offsets).

Training rows are a sample whose bounds are parameters; the model is a table of
weights bounded by ``max_features`` and broadcast. Scoring reads every row.

Defined cases: null, empty and wordless texts have no token and get the score of
a least marginal. If one of the two labels has no training row, nothing can be
learned and every score is 0. Repeated labels of one document: the largest
counts. Repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelway.llm.common import crc_mod, packed, table

TOKENS = re.compile(r"[^\W_]+|[.!?\n]")
ENDS = frozenset(".!?\n")
WORDS = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"[.!?\n]")
WIDTH = 6  # features of a word, at most
FLOOR = 1e-6


@dataclass(frozen=True)
class ToxicityConfig:
    toxic_rows: int = 1_000
    clean_rows: int = 2_500
    max_training_chars: int = 20_000
    max_features: int = 300_000
    min_ratio: float = 10.0
    rounds: int = 2
    steps: int = 45
    rate: float = 0.2
    decay: float = 0.02
    seed: int = 7


@dataclass
class Crf:
    """State 1 is toxic; scores are relative to state 0."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    start: float = 0.0
    trans: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    slope: float = 0.0
    shift: float = -50.0  # an untrained model: score 0
    cache: dict[str, float] = field(default_factory=dict)

    def emission(self, word: str) -> float:
        get = self.weights.get
        value = self.bias + sum(get(f, 0.0) for f in features(word.lower()))
        if len(self.cache) > 400_000:
            self.cache.clear()
        self.cache[word] = value
        return value


def features(word: str) -> list[str]:
    """The word, prefixes of 3 to 6 characters and the last 3, each marked by kind."""
    return [f"w{word}", *[f"p{word[:n]}" for n in range(3, min(6, len(word)) + 1)], f"s{word[-3:]}"]


def sentences(text: str) -> tuple[list[str], list[int]]:
    """Words, and how many of them each sentence has."""
    parts = list(map(WORDS.findall, SENTENCE_END.split(text)))
    return list(chain.from_iterable(parts)), list(map(len, parts))


class Lexicon:
    """Different words by number, each with the numbers of its features (-1: none)."""

    def __init__(self, words: list[str]):
        own = [features(w) for w in words]
        self.names = sorted({f for x in own for f in x})
        number = {f: i for i, f in enumerate(self.names)}
        self.table = np.full((len(words), WIDTH), -1)
        for row, x in zip(self.table, own):
            row[: len(x)] = [number[f] for f in x]

    def emissions(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.append(weights, 0.0)[self.table].sum(1)

    def totals(self, by_word: np.ndarray) -> np.ndarray:
        """Sums over the words that have each feature."""
        return np.bincount(self.table.ravel() + 1, np.repeat(by_word, WIDTH), len(self.names) + 1)[1:]


def messages(emission: np.ndarray, sentence: np.ndarray, start: float, trans) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages as log odds (toxic over clean) of each token.

    Tokens of a chain are adjacent and in order. All chains advance together:
    step ``t`` handles the t-th token of each chain that has one; chains are
    sorted by falling length, so the active ones are a prefix.
    """
    n = len(emission)
    forward, backward = np.zeros(n), np.zeros(n)
    if not n:
        return forward, backward
    first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    length = np.diff(np.r_[first, n])
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    (t00, t01), (t10, t11) = trans
    state = emission[first] + start
    forward[first] = state
    for t in range(1, length[0]):
        at = first[: active[t]] + t
        s = state[: active[t]]
        state = emission[at] + np.logaddexp(t01, s + t11) - np.logaddexp(t00, s + t10)
        forward[at] = state
    for t in range(length[0] - 1, 0, -1):
        at = first[: active[t]] + t
        s = backward[at] + emission[at]
        backward[at - 1] = np.logaddexp(t10, s + t11) - np.logaddexp(t00, s + t01)
    return forward, backward


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def edge_counts(emission, forward, backward, trans, inner) -> np.ndarray:
    """Expected counts of the transitions 00, 01, 10 and 11 into the tokens ``inner``."""
    (t00, t01), (t10, t11) = trans
    left, right = forward[inner - 1], emission[inner] + backward[inner]
    scores = np.stack([np.full(len(inner), t00), t01 + right, t10 + left, t11 + left + right])
    q = np.exp(scores - scores.max(0))
    return (q / q.sum(0)).sum(1)


def marking_words(docs: list[tuple[np.ndarray, int]], lexicon: Lexicon, cfg: ToxicityConfig) -> np.ndarray:
    """Words that are, or begin with, a feature that marks toxic documents."""
    seen = np.zeros((2, len(lexicon.names) + 1))
    for words, label in docs:
        seen[label, np.unique(lexicon.table[np.unique(words)])] += 1
    clean, toxic = seen[:, :-1]
    n_toxic = sum(label for _, label in docs)
    n_clean = len(docs) - n_toxic
    long = np.array([f[0] == "w" or f[0] == "p" and len(f) > 4 for f in lexicon.names], bool)
    least = max(4, round(0.015 * n_toxic))
    marks = long & (toxic >= least) & (toxic / n_toxic >= cfg.min_ratio * (clean + 0.5) / max(n_clean, 1))
    return np.append(marks, False)[lexicon.table].any(1)


def distinct_texts(rows: Iterable[tuple[str, int]]) -> list[tuple[str, int]]:
    """One row of each group of near copies, found by the least hash of eight-word windows."""
    kept = {}
    for text, label in sorted(rows):
        words = text.split()
        windows = [" ".join(words[i : i + 8]) for i in range(max(1, len(words) - 7))]
        kept.setdefault((min(windows, key=lambda w: (xxhash.xxh64_intdigest(w), w)), label), (text, label))
    return list(kept.values())


def fit(rows: Iterable[tuple[str, int]], cfg: ToxicityConfig = ToxicityConfig()) -> Crf:
    """Trains on a bounded list of (text, label).

    All sentences with a toxic token count, and a sample of the others. After
    each training the other sentences that the model finds most toxic join it.
    """
    number: dict[str, int] = {}
    docs, sizes = [], []
    for text, label in distinct_texts(rows):
        words, own = sentences(text)
        docs.append((np.array([number.setdefault(w, len(number)) for w in map(str.lower, words)], int), int(label)))
        sizes += own
    model = Crf()
    labels = np.array([y for _, y in docs])
    if len(set(labels.tolist())) < 2 or not number:
        return model
    lexicon = Lexicon(list(number))
    ends = np.cumsum([len(w) for w, _ in docs])
    word = np.concatenate([w for w, _ in docs])
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    y = marking_words(docs, lexicon, cfg)[word] & np.repeat(labels == 1, np.diff(ends, prepend=0))
    toxic = np.bincount(sentence, y, len(sizes)) > 0
    plain = np.flatnonzero(~toxic & (np.array(sizes) > 0))
    if not toxic.any():
        return model
    rng = np.random.default_rng(cfg.seed)
    chosen = toxic.copy()
    chosen[plain[rng.permutation(len(plain))[: 4 * toxic.sum() + 2_000]]] = True

    def learned() -> np.ndarray:
        use = chosen[sentence]
        weights = train(model, lexicon, word[use], sentence[use], y[use], cfg)
        e = lexicon.emissions(weights, model.bias)[word]
        return sigmoid(np.add(*messages(e, sentence, model.start, model.trans)))

    for _ in range(cfg.rounds):
        mass = np.bincount(sentence, learned(), len(sizes))[plain]
        hard = np.argsort(-mass, kind="stable")[: 2 * toxic.sum() + 1_000]
        chosen[plain[hard[mass[hard] > 0.01]]] = True
    found = [evidence(own) for own in np.split(learned(), ends[:-1])]
    model.slope, model.shift = calibrate(np.array(found), labels.astype(float))
    return model


def train(model: Crf, lexicon: Lexicon, word: np.ndarray, sentence: np.ndarray, y: np.ndarray, cfg: ToxicityConfig) -> np.ndarray:
    """Full-batch Adam on the negative log likelihood of labelled sentences; returns the feature weights."""
    n = len(lexicon.names)
    counts = lexicon.totals(np.bincount(word, minlength=len(lexicon.table)))
    used = np.ones(n + 6)  # then bias, start, four transitions
    used[np.argsort(-counts, kind="stable")[cfg.max_features :]] = 0
    first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    inner = np.flatnonzero(sentence[1:] == sentence[:-1]) + 1
    w, m, v = np.zeros(n + 6), np.zeros(n + 6), np.zeros(n + 6)
    w[-6] = -2.0
    real = np.bincount(2 * y[inner - 1] + y[inner], minlength=4)
    for step in range(1, cfg.steps + 1):
        trans = ((w[-4], w[-3]), (w[-2], w[-1]))
        e = lexicon.emissions(w[:n], w[-6])[word]
        forward, backward = messages(e, sentence, w[-5], trans)
        off = sigmoid(forward + backward) - y
        g = np.empty(n + 6)
        g[:n] = lexicon.totals(np.bincount(word, off, len(lexicon.table)))
        g[-6], g[-5] = off.sum(), off[first].sum()
        g[-4:] = edge_counts(e, forward, backward, trans, inner) - real
        g = (g + cfg.decay * w) * used
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= cfg.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights = {lexicon.names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w[:n]) > 1e-3)}
    model.bias, model.start = float(w[-6]), float(w[-5])
    model.trans = ((float(w[-4]), float(w[-3])), (float(w[-2]), float(w[-1])))
    model.cache = {}
    return np.where(np.abs(w[:n]) > 1e-3, w[:n], 0.0)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by damped Newton steps."""
    spread, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(40):
        p = sigmoid(spread @ w)
        grad = spread.T @ (p - y) + 0.1 * w * [1, 0]
        hess = (spread * (p * (1 - p))[:, None]).T @ spread + np.diag([0.1, 1e-6])
        w -= np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1])


def token_marginals(model: Crf, docs: list[tuple[list[str], list[int]]]) -> list[np.ndarray]:
    """For each document (words, words of each sentence) its tokens' toxic marginals."""
    words = list(chain.from_iterable(d[0] for d in docs))
    values = list(map(model.cache.get, words))
    if None in values:
        values = [model.emission(w) if x is None else x for w, x in zip(words, values)]
    sizes = list(chain.from_iterable(d[1] for d in docs))
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    found = sigmoid(np.add(*messages(np.array(values, float), sentence, model.start, model.trans)))
    return np.split(found, np.cumsum([len(d[0]) for d in docs])[:-1])


def evidence(marginal: np.ndarray) -> float:
    """Log odds of the most toxic token: a long clean text gathers no evidence by its length."""
    top = np.clip(marginal.max() if len(marginal) else 0.0, FLOOR, 1 - FLOOR)
    return float(np.log(top / (1 - top)))


def tag(model: Crf, texts: list[str | None]) -> Iterator[tuple[float, list[dict]]]:
    """Score and offending spans of each text."""
    docs = [sentences(t or "") for t in texts]
    for text, own in zip(texts, token_marginals(model, docs)):
        logit = model.slope * evidence(own) + model.shift
        yield float(sigmoid(logit)), spans(text or "", own)


def spans(text: str, marginal: np.ndarray) -> list[dict]:
    """Runs of toxic tokens as start and end offsets with their largest marginal."""
    if not len(marginal) or marginal.max() < 0.5:
        return []
    out, last, i = [], -2, -1
    for match in TOKENS.finditer(text):
        if match[0] in ENDS:
            continue
        i += 1
        if marginal[i] >= 0.5:
            if last == i - 1:
                out[-1]["end"] = match.end()
                out[-1]["marginal"] = max(out[-1]["marginal"], float(marginal[i]))
            else:
                out.append({"start": match.start(), "end": match.end(), "marginal": float(marginal[i])})
            last = i
    return out


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])
SLICE = 200


def score(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """``row`` (the input row), ``score`` and ``spans``; one map over the input, no shuffle."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                results = list(tag(own, batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([s for s, _ in results], pa.float64()),
                        pa.array([x for _, x in results], pa.list_(SPAN)),
                    ],
                    ["row", "score", "spans"],
                )

    source = packed(docs, F.col(text_col).alias("text"))
    kind = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(
        run,
        f"row {kind}, score double, spans array<struct<start:bigint,end:bigint,marginal:double>>",
    )


def training_rows(
    docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig, usable: Column
) -> list[tuple[str, int]]:
    """A bounded labelled sample in hash order: at most ``toxic_rows`` and
    ``clean_rows`` texts of at most ``max_training_chars`` characters.

    The ids are chosen first, with room for texts that are too long; they are
    few, so they are broadcast and no text is shuffled.
    """
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & usable)
        .groupBy(F.col("doc_id").alias("labelled_id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    order = [F.xxhash64("labelled_id"), F.col("labelled_id")]
    ids = (
        known.filter("toxic = 1").orderBy(*order).limit(cfg.toxic_rows)
        .unionAll(known.filter("toxic = 0").orderBy(*order).limit(cfg.clean_rows))
    )
    rows = (
        docs.filter(F.col("text").isNotNull() & (F.length("text") <= cfg.max_training_chars))
        .select("doc_id", "text")
        .join(F.broadcast(ids), F.col("doc_id") == F.col("labelled_id"))
        .groupBy("labelled_id")
        .agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    )
    return [(r["text"], int(r["toxic"])) for r in rows.collect()]


def learn(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> Crf:
    """Model of the labels whose crc32(doc_id) mod 5 is not 0."""
    return fit(training_rows(docs, labels, cfg, crc_mod(F.col("doc_id"), 5) != 0), cfg)


def q_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    doc_id = F.col("row.doc_id")
    return score(docs, model).select(
        doc_id,
        F.coalesce(crc_mod(doc_id, 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )
