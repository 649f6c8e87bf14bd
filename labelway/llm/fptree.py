"""Ranked lexical search with branch and bound over FP-trees of documents.

A document is reduced to the terms that the stated items ask for, ordered by document
frequency, most frequent first. Documents in the order of these vectors form a
trie: those that begin with the same terms share a path. Every node keeps, for each
child, the greatest term frequency of each term in the child's subtree and the
least ``m``. A score grows with term frequencies and falls with ``m``, so these bound all scores
below the child. For each item a depth-first search takes the best bound first and
leaves out subtrees whose bound cannot reach the best ``best`` documents found so far; what
it leaves out cannot be in the result, so the result is exact.

Spark counts terms, deals the short vectors out by range of their path (ties by id, so equal
vectors spread too) and merges the best of all tasks in two steps. A task holds one tree of
bounded size at a time and keeps its best scores from tree to tree.

Items are searched in blocks of bounded text size: the documents are read once a block.
Equal item texts are searched once.

Defined cases: null and empty texts have no terms: as documents they match nothing and do not
count for ``N``; as items they have no rows. Repeated documents are ranked each by itself,
repeated items have the same rows each. A null doc_id comes after all others at equal scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelway.llm.common import table
from labelway.llm.words import term_blocks
from labelway.session import stage_table

LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class LexicalSearch:
    """``block_bytes`` bounds the item texts searched at a time (held by the driver and
    broadcast), ``tree_terms`` the vector entries of one tree, ``leaf`` the documents below
    which a node is not split; none of them changes a result."""

    best: int = 50
    block_bytes: int = 4 << 20
    tree_terms: int = 2_000_000
    leaf: int = 32


# --- weights and scores, in 64-bit integers ---------------------------------


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def shares(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


# --- vectors ------------------------------------------------------------------


def term_counts(text: bytes) -> Counter:
    counts: Counter = Counter()
    for block in term_blocks(text):
        counts.update(block)
    return counts


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): all terms counted, and those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, terms, tfs, ends = [], [], [], [0]
                for text in part.column(1):
                    counts = term_counts(text.as_py() or b"")
                    sizes.append(counts.total())
                    for term, tf in counts.items():
                        if term in known:
                            terms.append(known[term])
                            tfs.append(tf)
                    ends.append(len(terms))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32())),
                    ],
                    ["doc_id", "n", "terms", "tfs"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), sizes


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(4 * sizes)].astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())]
    )


def paths(found: DataFrame, ranks: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """(path, tfs, m, doc_id): vectors in frequency order, as bytes that sort like their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, sizes = _flat(batch.column("terms"))
            tfs, _ = _flat(batch.column("tfs"))
            ranked = ranks[terms]
            order = np.lexsort((ranked, np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays(
                [
                    _packed(ranked[order].astype(">u4"), sizes),
                    _packed(tfs[order].astype("<u4"), sizes),
                    batch.column("m"),
                    batch.column("doc_id"),
                ],
                ["path", "tfs", "m", "doc_id"],
            )

    m = F.expr(f"100L - 50L + (50L * n * {n_docs}L) div {n_terms}L").alias("m")
    some = found.filter(F.size("terms") > 0).select("doc_id", m, "terms", "tfs")
    return some.mapInArrow(run, "path binary, tfs binary, m long, doc_id long")


# --- the tree -------------------------------------------------------------------


@dataclass
class Best:
    """The best documents so far of one item: score, id, whether the id is null."""

    score: np.ndarray
    doc_id: np.ndarray
    null: np.ndarray

    @staticmethod
    def none() -> Best:
        return Best(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def floor(self, best: int) -> tuple[int, int]:
        """What a document must beat: a higher score, or the same and a lesser id."""
        return (int(self.score[-1]), int(self.doc_id[-1])) if len(self.score) >= best else (0, -LAST - 1)

    def add(self, score: np.ndarray, doc_id: np.ndarray, null: np.ndarray, best: int) -> None:
        score, doc_id = np.r_[self.score, score], np.r_[self.doc_id, doc_id]
        null = np.r_[self.null, null]
        order = np.lexsort((null, doc_id, -score))[:best]
        self.score, self.doc_id, self.null = score[order], doc_id[order], null[order]


class Tree:
    """Documents in path order as a trie; children of a node are documents or nodes.

    Children 0, 1, ... are the documents, then come the nodes. For each node and
    term there is an entry for each child that has the term below it, with its greatest frequency.
    """

    def __init__(self, paths: list[bytes], tfs: list[bytes], m: np.ndarray, doc_id: np.ndarray, null: np.ndarray, n_ranks: int, leaf: int) -> None:
        self.docs, self.ranks, self.doc_id, self.null = len(paths), n_ranks, doc_id, null
        sizes = np.array([len(p) // 4 for p in paths])
        terms = np.frombuffer(b"".join(paths), ">u4").astype(np.int64)
        counts = np.frombuffer(b"".join(tfs), "<u4").astype(np.int64)
        lo, hi, parent, level, doc_parent = self._nodes(self._common(terms, sizes), leaf)
        self.m = np.r_[m, [m[a:b].min() for a, b in zip(lo, hi)]]
        self.least_id = np.r_[doc_id, [doc_id[a:b].min() for a, b in zip(lo, hi)]]
        owner = np.repeat(np.arange(self.docs), sizes)
        self._entries(doc_parent[owner], terms, owner, counts, np.array(parent), np.array(level))

    @staticmethod
    def _common(terms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Length of the path that each document shares with the next."""
        starts = np.r_[0, np.cumsum(sizes)][:-1]
        common = np.zeros(max(0, len(sizes) - 1), np.int64)
        alive, depth = np.arange(len(common)), 0
        while len(alive):
            alive = alive[np.minimum(sizes[alive], sizes[alive + 1]) > depth]
            alive = alive[terms[starts[alive] + depth] == terms[starts[alive + 1] + depth]]
            depth += 1
            common[alive] = depth
        return common

    @staticmethod
    def _nodes(common: np.ndarray, leaf: int):
        """Ranges of documents below each node, top down: the next split is where least is shared."""
        lo, hi, parent, level = [0], [len(common) + 1], [-1], [0]
        doc_parent = np.zeros(len(common) + 1, np.int64)
        node = 0
        while node < len(lo):
            a, b = lo[node], hi[node]
            doc_parent[a:b] = node
            if b - a > leaf:
                inside = common[a : b - 1]
                cuts = [a, *(a + 1 + np.flatnonzero(inside == inside.min())).tolist(), b]
                for x, y in zip(cuts, cuts[1:]):
                    if y - x > 1:
                        lo.append(x)
                        hi.append(y)
                        parent.append(node)
                        level.append(level[node] + 1)
            node += 1
        return lo, hi, parent, level, doc_parent

    def _entries(self, node, term, child, tf, parent: np.ndarray, level: np.ndarray) -> None:
        """Entries from the deepest level up; the maxima of a node are an entry of its parent."""
        by_level = np.argsort(level[node], kind="stable")
        node, term, child, tf = node[by_level], term[by_level], child[by_level], tf[by_level]
        cuts = np.searchsorted(level[node], np.arange(level.max() + 2))
        keys, children, tfs = [], [], []
        up = [np.zeros(0, np.int64)] * 3
        for depth in range(level.max(), -1, -1):
            own = slice(cuts[depth], cuts[depth + 1])
            key = np.r_[node[own] * self.ranks + term[own], up[0]]
            order = np.argsort(key, kind="stable")
            key = key[order]
            keys.append(key)
            children.append(np.r_[child[own], up[1]][order])
            tfs.append(np.r_[tf[own], up[2]][order])
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            most = np.maximum.reduceat(tfs[-1], first) if len(first) else np.zeros(0, np.int64)
            of, what = key[first] // self.ranks, key[first] % self.ranks
            up = [parent[of] * self.ranks + what, self.docs + of, most]
        # levels number their nodes upwards, so the reverse is the order of keys
        key = np.concatenate(keys[::-1])
        order = np.argsort(key, kind="stable")
        key = key[order]
        self.child, self.tf = np.concatenate(children[::-1])[order], np.concatenate(tfs[::-1])[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.key, self.start = key[first], np.r_[first, len(key)]

    def _children(self, node: int, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of a node that hold any of the terms, and score (documents) or bound (nodes)."""
        want = node * self.ranks + terms
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        hit = self.key[at] == want
        at, weights = at[hit], weights[hit]
        lengths = self.start[at + 1] - self.start[at]
        ends = np.cumsum(lengths)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - lengths), lengths)
        child = self.child[take]
        parts = np.repeat(weights, lengths) * shares(self.tf[take], self.m[child])
        order = np.argsort(child, kind="stable")
        child, parts = child[order], parts[order]
        first = np.flatnonzero(np.r_[True, child[1:] != child[:-1]]) if len(child) else np.zeros(0, np.int64)
        return child[first], np.add.reduceat(parts, first) if len(first) else parts

    def search(self, terms: np.ndarray, weights: np.ndarray, found: Best, best: int) -> int:
        """Adds this tree's documents to ``found``; how many nodes it looked into."""
        stack, looked = [(LAST, -LAST - 1, 0)], 0
        while stack:
            bound, least_id, node = stack.pop()
            score, last = found.floor(best)
            if bound < score or (bound == score and least_id >= last):
                continue
            looked += 1
            child, points = self._children(node, terms, weights)
            ids = self.least_id[child]
            use = (points > score) | ((points == score) & (ids < last) & (points > 0))
            child, points, ids = child[use], points[use], ids[use]
            doc = child < self.docs
            if doc.any():
                found.add(points[doc], ids[doc], self.null[child[doc]], best)
            if not doc.all():
                below = ~doc
                order = np.lexsort((-ids[below], points[below]))
                stack += zip(
                    points[below][order].tolist(), ids[below][order].tolist(), (child[below][order] - self.docs).tolist()
                )
        return looked


def best_of_task(
    rows: Iterator[pa.RecordBatch], items: list[tuple[str, np.ndarray, np.ndarray]], n_ranks: int, cfg: LexicalSearch
) -> list[Best]:
    """The best documents of each item among sorted (path, tfs, m, doc_id) rows."""
    found = [Best.none() for _ in items]
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not held:
            return
        batch = pa.Table.from_batches(held).combine_chunks()
        ids = batch.column("doc_id").combine_chunks()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        tree = Tree(
            batch.column("path").to_pylist(), batch.column("tfs").to_pylist(), batch.column("m").to_numpy(),
            ids.fill_null(LAST).to_numpy(zero_copy_only=False), null, n_ranks, cfg.leaf,
        )
        for (_, terms, weights), best in zip(items, found):
            tree.search(terms, weights, best, cfg.best)
        held.clear()
        size = 0

    for batch in rows:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            held.append(part)
            size += pc.sum(pc.binary_length(part.column("path"))).as_py() // 4
            if size >= cfg.tree_terms:
                flush()
    flush()
    return found


# --- the search -------------------------------------------------------------------


def search_block(docs: DataFrame, texts: list[tuple[bytes, bytes]], cfg: LexicalSearch) -> DataFrame | None:
    """(key, doc_id, score): the best of every task for each (key, text) of one block."""
    asked = {key: list(term_counts(text)) for key, text in texts}
    vocabulary: dict[bytes, int] = {}
    for terms in asked.values():
        for term in terms:
            vocabulary.setdefault(term, len(vocabulary))
    found = stage_table(vectors(docs, vocabulary), "vectors")
    total = found.filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    # at most one row for each term of the block
    counts = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = {r["term"]: r["df"] for r in counts.collect()}
    if not df:
        return None
    order = sorted(df, key=lambda t: (-df[t], t))
    ranks = np.full(len(vocabulary), -1, np.int64)
    ranks[order] = np.arange(len(order))
    weights = np.array([term_weight(total["docs"], df[t]) for t in order], np.int64)
    items = []
    for key, terms in asked.items():
        known = [vocabulary[t] for t in terms]
        rank = np.sort(ranks[[t for t in known if ranks[t] >= 0]]) if known else np.zeros(0, np.int64)
        if len(rank):
            items.append((key, rank, weights[rank]))
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _, _), best in zip(shared.value, best_of_task(batches, shared.value, len(order), cfg)):
            if len(best.score):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * len(best.score), pa.binary()),
                        pa.array(best.doc_id, mask=best.null),
                        pa.array(best.score),
                    ],
                    ["key", "doc_id", "score"],
                )

    rows = paths(found, ranks, total["docs"], total["terms"])
    rows = rows.repartitionByRange("path", "doc_id").sortWithinPartitions("path", "doc_id")
    return rows.mapInArrow(run, "key binary, doc_id long, score long")


def _ranked(rows: DataFrame, best: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def ranked(docs: DataFrame, items: DataFrame, cfg: LexicalSearch = LexicalSearch()) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``cfg.best`` best rows of ``docs`` (doc_id, text)
    for each row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    keyed = items.filter("text is not null").select("item_id", F.unhex(F.md5("text")).alias("key"), "text")
    texts = stage_table(keyed.groupBy("key").agg(F.first("text").alias("text")), "items")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // cfg.block_bytes)
    found = spark.createDataFrame([], "key binary, doc_id long, score long")
    for block in range(blocks):
        mine = texts.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)
        part = search_block(docs, [(bytes(r["key"]), r["text"].encode()) for r in mine.collect()], cfg)
        if part is not None:
            found = found.unionAll(stage_table(part, "best"))
    # first the best of groups of tasks, so that no item gathers a row list of all tasks
    part = F.pmod(F.xxhash64("doc_id"), F.lit(32))
    found = _ranked(found.withColumn("part", part), cfg.best, "key", "part").drop("rank")
    found = _ranked(found, cfg.best, "key")
    return keyed.drop("text").join(found, "key").select("item_id", "rank", "doc_id", "score")


def q_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best rows of ``documents`` for each row of ``benchmark``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


LEXICAL_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), sized AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0
), total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sized
), tfs AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term
), dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM dfs, total
), items AS (
    SELECT row_number() OVER () AS i, item_id,
        list_distinct(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms
    FROM benchmark
), asked AS (SELECT i, item_id, unnest(terms) AS term FROM items
), scored AS (
    SELECT a.i, a.item_id, s.r, s.doc_id,
        CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (100 - 50 + (50 * s.n * big_n) // big_l)))) AS BIGINT)
            AS score
    FROM asked a JOIN weights w USING (term) JOIN tfs t USING (term) JOIN sized s USING (r), total
    GROUP BY a.i, a.item_id, s.r, s.doc_id
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
    FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 50
"""
