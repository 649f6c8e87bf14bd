"""Document fingerprints by winnowing, and the likeness of edited and following texts.

Hashes of all k-grams of code points; of each window of ``window`` consecutive
hashes the least is chosen, the rightmost of equals, with its position. Any
passage of ``k + window - 1`` code points that two texts share yields a common
fingerprint. Likeness is the share of common ones among the different hashes of both.

The following document is the next one in descending id. Ranges of ids are cut
at quantiles, each is one ordered run in some task, and the first document of a
range is sent to the range before it as well. Texts are shuffled once.

Defined cases: a null or empty text has an empty fingerprint; two empty ones are
alike (1), an empty and another are not (0). A text shorter than k is one k-gram.
Rows of one id are ordered by text; null ids come last. A single document
follows itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelway.llm.common import table


@dataclass(frozen=True)
class WinnowConfig:
    """``rows_per_range`` and ``max_ranges`` lay out the work; they never change a result."""

    k: int = 16
    window: int = 48
    rows_per_range: int = 1_000
    max_ranges: int = 10_000


def winnow(text: str | None, cfg: WinnowConfig = WinnowConfig()) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (uint32) and their positions, in text order."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    grams = rolling(codes, min(cfg.k, len(codes)))
    n = len(grams)
    # hash above, reversed position below: a minimum is the rightmost of equals
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    least, width, window = keys, 1, min(cfg.window, n)
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: n - window + 1], least[window - width :])
    chosen = least[np.r_[True, least[1:] != least[:-1]]]
    return (chosen >> np.uint64(32)).astype(np.uint32), (
        np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))
    ).astype(np.int64)


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every k-gram, mixed; grams double in width."""
    base, out, done, part, width = 0x100000001B3, None, 0, codes, 1
    while True:
        if k & width:
            n = len(codes) - (done + width) + 1
            tail = part[done : done + n]
            factor = np.uint64(pow(base, width, 1 << 64))
            out = tail if out is None else out[:n] * factor + tail
            done += width
        if done == k:
            break
        part = part[:-width] * np.uint64(pow(base, width, 1 << 64)) + part[width:]
        width *= 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted arrays of different hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _firsts(docs: DataFrame, cfg: WinnowConfig) -> tuple[np.ndarray, dict[int | None, tuple[int, int]]]:
    """Cuts between ranges, and for the first id of each range (its range, the range before)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    ranges = max(1, min(cfg.max_ranges, ids.count() // cfg.rows_per_range))
    cuts = np.zeros(0, np.int64)
    if ranges > 1:
        marks = [i / ranges for i in range(1, ranges)]
        found = ids.approxQuantile("doc_id", marks, 0.25 / ranges)
        cuts = np.unique(np.array(found, float).astype(np.int64))
    kind = _range_udf(cuts)
    first = ids.groupBy(kind("doc_id").alias("r")).agg(F.max("doc_id").alias("first")).orderBy("r").collect()
    order = [(r["r"], r["first"]) for r in first]
    return cuts, {top: (own, order[i - 1][0]) for i, (own, top) in enumerate(order)}


def _ranges(ids: pa.Array, cuts: np.ndarray) -> np.ndarray:
    """Range of each id: 0 holds the largest ids, the last one the nulls."""
    null = np.array(ids.is_null())
    values = np.array(ids.fill_null(0), dtype=np.int64)
    return np.where(null, len(cuts) + 1, len(cuts) - np.searchsorted(cuts, values, side="right")).astype(np.int32)


def _range_udf(cuts: np.ndarray):
    @F.arrow_udf("int")
    def of(ids: pa.Array) -> pa.Array:
        return pa.array(_ranges(ids, cuts), pa.int32())

    return of


def fingerprints(docs: DataFrame, cfg: WinnowConfig = WinnowConfig()) -> DataFrame:
    """Fingerprints with positions of each text and of its edited text, and both likenesses."""
    cuts, firsts = _firsts(docs, cfg)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _ranges(batch.column(0), cuts)
            ids = batch.column(0).to_pylist()
            at = [i for i, x in enumerate(ids) if x in firsts and firsts[x][0] == own[i]]
            columns = [pa.array(own, pa.int32()), pa.array(np.zeros(len(own), bool))]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns], ["r", "guest", "doc_id", "text"])
            if at:
                copy = batch.take(pa.array(at))
                before = pa.array([firsts[ids[i]][1] for i in at], pa.int32())
                columns = [before, pa.array(np.ones(len(at), bool))]
                yield pa.RecordBatch.from_arrays([*columns, *copy.columns], ["r", "guest", "doc_id", "text"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # range, id, text, fingerprint of the row that waits for its next one
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                rows = []
                for r, guest, doc_id, text in zip(*(c.to_pylist() for c in whole.slice(at, 512).columns)):
                    text = text or ""
                    if before is None and guest:
                        continue
                    hashes, places = winnow(text, cfg)
                    own = (r, doc_id, text, hashes, places, np.unique(hashes))
                    if before is not None:
                        rows.append(finish(before, own))
                    before = None if guest else own
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, (_, t) in zip(zip(*rows), FIELDS)], [n for n, _ in FIELDS]
                    )

    def finish(own, following):
        _, doc_id, text, hashes, places, different = own
        changed = edited(text, following[2])
        new, new_places = winnow(changed, cfg)
        return (
            doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
            as_text(hashes), as_text(new), likeness(different, np.unique(new)),
            likeness(different, following[5]), places, new_places,
        )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    dealt = source.mapInArrow(deal, "r int, guest boolean, doc_id long, text string")
    ordered = dealt.repartition("r").sortWithinPartitions(
        "r", "guest", F.col("doc_id").desc_nulls_last(), F.coalesce("text", F.lit(""))
    )
    return ordered.mapInArrow(
        scan,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, positions array<long>, edited_positions array<long>",
    )


FIELDS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("positions", pa.list_(pa.int64())), ("edited_positions", pa.list_(pa.int64())),
]


def q_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents")).drop("positions", "edited_positions")
