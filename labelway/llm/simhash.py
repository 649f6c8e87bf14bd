"""SimHash near duplicates through an index of byte positions with count filtering.

A fingerprint holds, bit by bit, what over half of a text's shingle hashes hold.
Fingerprints that differ in at most 3 bits differ in at most 3 of 8 bytes, so they share
at least 5 bytes at the same positions: the guaranteed minimum of matches. A list per single
position and byte would hold 1/256 of all fingerprints, and tallies would grow
with its square. So the lists are keyed by three positions, taken inside the lower or inside
the upper half: of 5 shared positions at least 3 lie in one half, so such a pair meets in at
least one of these 8 lists. Inside a list the shared bytes of each pair are tallied,
pairs with 5 or more are retained, and their bits are compared.

Copies collapse to one fingerprint first. Longer lists (``list_limit``) are split by
two more positions, all ten choices of them; then 5 bytes are fixed, a list has at most 2^24
fingerprints, and each has 2,324 places where a partner can be. A list gives the links
of a spanning forest, not all its pairs, so links grow with fingerprints whatever the size of
a group, and no link between components is lost. Components are found by Spark.

Defined cases: null and empty texts have no words and the fingerprint zero; fewer words
than a shingle are one shingle. Repeated rows are rows. ``component_id`` is the
least doc_id of the component, null if it has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelway.llm.common import table
from labelway.llm.components import components
from labelway.llm.words import word_blocks
from labelway.operators.joins import attach
from labelway.session import stage_table

# 64-bit fingerprints, links at 3 differing bits, hash seed.
BYTES = 8
DISTANCE = 3
SHARED = BYTES - DISTANCE
SEED = 42

#: Of any 5 of 8 positions, 3 lie in one half.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]

# Lists up to this length are compared as a whole, in one vector operation per shift.
SHORT = 8
# Rows of a comparison matrix and, beyond it, probing of all places 1 to 3 bits away.
BLOCK = 256
PROBED = 4096


@dataclass(frozen=True)
class SimHash:
    words: int = 3
    list_limit: int = 1024


def fingerprint(text: bytes, words: int = 3) -> int:
    """Majority bits of the XXH64 of all shingles, repeats included; 0 without words."""
    counts, total, tail = np.zeros(64, np.int64), 0, []
    for block in word_blocks(text):
        block = tail + block
        shingles = map(b" ".join, zip(*(block[i:] for i in range(words))))
        total += _tally(counts, [xxhash.xxh64_intdigest(s, SEED) for s in shingles])
        tail = block[max(0, len(block) - words + 1) :]
    if not total and tail:
        total = _tally(counts, [xxhash.xxh64_intdigest(b" ".join(tail), SEED)])
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _tally(counts: np.ndarray, hashes: list[int]) -> int:
    if hashes:
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return len(hashes)


def fingerprints(docs: DataFrame, cfg: SimHash = SimHash()) -> DataFrame:
    """(doc_id, fp) of every row; the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [fingerprint(t.as_py() or b"", cfg.words) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def list_key(fp: Column, positions: tuple[int, ...]) -> Column:
    """The bytes at ``positions`` and which positions these are, as one long."""
    key = F.lit(sum(1 << p for p in positions)).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8) + F.shiftright(fp, 8 * p).bitwiseAND(F.lit(255))
    return key


def index_rows(fps: DataFrame) -> DataFrame:
    """(list, fp): eight lists of three positions for each fingerprint."""
    keys = F.array(*[list_key(F.col("fp"), t) for t in TRIPLES])
    return fps.select(F.explode(keys).alias("list"), "fp")


def split_rows(rows: DataFrame) -> DataFrame:
    """Rows of too long lists, keyed by the list's three positions and any two more."""
    mask = F.shiftright("list", 24)
    finer = F.lit(None).cast("array<long>")
    for t in TRIPLES:
        others = [p for p in range(BYTES) if p not in t]
        keys = F.array(*[list_key(F.col("fp"), tuple(sorted((*t, *two)))) for two in combinations(others, 2)])
        finer = F.when(mask == sum(1 << p for p in t), keys).otherwise(finer)
    return rows.select(F.explode(finer).alias("list"), "fp")


def comparable(fps: DataFrame, cfg: SimHash) -> DataFrame:
    """(list, fp) of lists with two fingerprints or more, long lists split.

    The lengths are counted with map-side combine and looked up by a checked
    broadcast or a salted join, so no long list is ever dealt to one task here.
    """
    index = index_rows(fps)
    length = index.groupBy("list").agg(F.count(F.lit(1)).alias("weight")).filter("weight > 1")
    length = stage_table(length.withColumn("length", F.col("weight")), "lists")
    rows = attach(index, length, ["list"], "weight", ["fp"], how="inner")
    short = rows.filter(F.col("length") <= cfg.list_limit).select("list", "fp")
    return short.unionAll(split_rows(rows.filter(F.col("length") > cfg.list_limit)))


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs share enough positional bytes and, of those, few bits differ."""
    differ = np.ascontiguousarray(a ^ b)
    shared = (differ.reshape(-1).view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= SHARED
    near = np.zeros(differ.size, bool)
    near[shared] = np.bitwise_count(differ.reshape(-1)[shared]) <= DISTANCE
    return near.reshape(differ.shape)


def short_links(lists: np.ndarray, fps: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """All links of sorted short lists: each row against those 1, 2, ... places on."""
    left, right = [], []
    for d in range(1, longest):
        same = np.flatnonzero(lists[d:] == lists[:-d])
        a, b = fps[same], fps[same + d]
        hit = _near(a, b) & (a != b)
        left.append(a[hit])
        right.append(b[hit])
    return np.concatenate(left), np.concatenate(right)


def _by_matrix(front: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """For each of ``rest`` the index of a linked one of ``front``, or -1."""
    by = np.full(len(rest), -1)
    for at in range(0, len(front), BLOCK):
        todo = np.flatnonzero(by < 0)
        for lo in range(0, len(todo), 4 * BLOCK):
            some = todo[lo : lo + 4 * BLOCK]
            near = _near(rest[some][:, None], front[at : at + BLOCK][None, :])
            hit = near.any(axis=1)
            by[some[hit]] = at + near[hit].argmax(axis=1)
    return by


def _flips() -> np.ndarray:
    bits = [1 << i for i in range(8 * DISTANCE)]
    return np.array([sum(c) for k in range(1, DISTANCE + 1) for c in combinations(bits, k)], np.int64)


class _Probe:
    """Looks up all places 1 to 3 bits away among fingerprints that share five bytes."""

    def __init__(self, fps: np.ndarray) -> None:
        differ = np.bitwise_or.reduce(fps ^ fps[0])
        free = [p for p in range(BYTES) if int(differ) >> 8 * p & 255]
        self.free, self.flips = (free + [p for p in range(BYTES) if p not in free])[:DISTANCE], _flips()
        self.at = np.full(1 << 8 * DISTANCE, -1, np.int32)

    def code(self, fps: np.ndarray) -> np.ndarray:
        parts = [((fps >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64) << 8 * i for i, p in enumerate(self.free)]
        return sum(parts)

    def __call__(self, front: np.ndarray, rest: np.ndarray) -> np.ndarray:
        codes, by = self.code(rest), np.full(len(rest), -1)
        self.at[codes] = np.arange(len(rest))
        for lo in range(0, len(front), BLOCK):
            places = self.at[self.code(front[lo : lo + BLOCK])[:, None] ^ self.flips[None, :]]
            row, col = np.nonzero(places >= 0)
            by[places[row, col]] = lo + row
        self.at[codes] = -1
        return by


def forest_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of different fingerprints of one list.

    Components grow from one fingerprint outward; each is compared once, with
    those that are in no component yet.
    """
    left, right, rest = [fps[:0]], [fps[:0]], fps
    probe = _Probe(fps) if len(fps) > PROBED else None
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            by = probe(front, rest) if probe and len(rest) > PROBED else _by_matrix(front, rest)
            hit = by >= 0
            left.append(rest[hit])
            right.append(front[by[hit]])
            front, rest = rest[hit], rest[~hit]
    return np.concatenate(left), np.concatenate(right)


def list_links(lists: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of all lists of sorted rows."""
    starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
    sizes = np.diff(np.r_[starts, len(lists)])
    short = np.repeat(sizes <= SHORT, sizes)
    found = [short_links(lists[short], fps[short], SHORT)] if short.any() else []
    found += [forest_links(np.unique(fps[s : s + n])) for s, n in zip(starts, sizes) if n > SHORT]
    return tuple(np.concatenate(side) for side in zip(*found))


def links(fps: DataFrame, cfg: SimHash = SimHash()) -> DataFrame:
    """Links (a, b) between different fingerprints, enough to connect each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(lists: list[np.ndarray], fps: list[np.ndarray]) -> pa.RecordBatch:
            a, b = list_links(np.concatenate(lists), np.concatenate(fps))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        # rows of the last list, which the next batch may go on with
        open_lists, open_fps = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0).to_numpy()
            fps = batch.column(1).to_numpy().view(np.uint64)
            cut = int(np.searchsorted(lists, lists[-1]))
            if cut or (open_lists and open_lists[0][0] != lists[0]):
                yield found([*open_lists, lists[:cut]], [*open_fps, fps[:cut]])
                open_lists, open_fps = [], []
            open_lists.append(lists[cut:])
            open_fps.append(fps[cut:])
        if open_lists:
            yield found(open_lists, open_fps)

    rows = comparable(fps, cfg).repartition("list").sortWithinPartitions("list")
    return rows.mapInArrow(run, "a long, b long")


def placed(docs: DataFrame, cfg: SimHash = SimHash()) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text)."""
    rows = stage_table(fingerprints(docs, cfg), "fingerprints")
    fps = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))
    fps = stage_table(fps, "copies")
    roots = components(stage_table(links(fps, cfg), "links"))
    root = F.coalesce("root", "fp").alias("root")
    rooted = stage_table(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "copies", "first_id", root), "rooted")
    least = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.min("first_id").alias("component_id"))
    named = attach(rooted, stage_table(least, "least"), ["root"], "nodes", ["fp"])
    named = stage_table(named.select("fp", "copies", "component_id"), "named")
    return attach(rows, named, ["fp"], "copies", ["doc_id"])


def q_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return placed(docs).select("doc_id", shown, "component_id")
