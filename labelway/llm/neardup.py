"""Near duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its five-word k-mers, each labelled with the number of
its occurrence. A sketch of a text is, for one hash order, the few least labelled
k-mers put back in text order; texts of equal sketch meet in a bucket. Such a
sketch is sensitive to the order of the text, as edit similarity is.

Two texts are linked if their aligned k-mers (longest common subsequence, inside
the band that the bound allows) are at least 0.8 of all k-mers of both:
``l / (n + m - l)``. Classes are the connected components of links.

Texts with the same words are copies: they share a node (digest of the words)
and are collapsed first. Each bucket compares its members with its least and its
greatest node only. Texts of buckets that are still of two components after that,
linked ones included, are joined exactly: in the
order of rarity any two similar ones share a k-mer in a short prefix. Those of a large
bucket are alike in most k-mers, so they meet again by how they differ from one pivot: similar ones
must share many of these differences, too (``differences``). Buckets are then
compared in rounds with more and more chosen nodes, until the members
not yet compared with all others of their bucket are of one component. So pairs grow with members, not with their
square, for copies of one text however many, and there is no cap.

Defined cases: null, empty and blank texts have the same (no) words and form one
class. Texts of fewer than five words are one k-mer: only copies match. Repeated
rows are members of the same class.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelway.llm.common import packed, table
from labelway.llm.components import components
from labelway.session import stage_table

SPACE = r"[\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class OrderMinHash:
    """``sketches`` sketches of ``least`` k-mers each; short texts use their own pair.

    At similarity 0.8 a pair misses all sketches with probability below 1e-5
    (0.41 and 0.64 are the chances of one).
    """

    words: int = 5
    similarity: float = 0.8
    least: int = 4
    sketches: int = 24
    short: int = 40
    short_least: int = 2
    short_sketches: int = 14


def node_of(text: Column) -> Column:
    """Digest of the words: 16 bytes, equal for texts of equal words."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.unhex(F.md5(words))


# Texts whose words are in memory at one time.
SLICE = 256


def kmers(text: str | None, k: int = 5) -> np.ndarray:
    """Labelled k-mer hashes (uint64) in text order, all different."""
    return kmers_of(pa.array([text], pa.string()), k)[0]


def kmers_of(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """``kmers`` of each text. Words stand between ASCII blanks, other white space is part of
    a word; each different word is hashed once."""
    for blank in BLANK[1:]:
        texts = pc.replace_substring(texts, blank, " ")
    words = pc.split_pattern(texts.fill_null(""), " ")
    coded = words.flatten().dictionary_encode()
    known = coded.dictionary.to_pylist()
    ids = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)[np.asarray(coded.indices)]
    ends = np.cumsum(np.asarray(words.value_lengths()))
    if "" in known:
        solid = np.asarray(coded.indices) != known.index("")
        ends = np.r_[0, np.cumsum(solid)][ends]
        ids = ids[solid]
    full = _hashed(ids, k) if len(ids) >= k else None
    out, start = [], 0
    for end in ends.tolist():
        n = end - start
        out.append(_numbered(full[start : end - k + 1] if n >= k else _hashed(ids[start:end], n)) if n else ids[:0])
        start = end
    return out


def _hashed(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` neighbouring words."""
    n = len(ids) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n])
    return out


def _numbered(grams: np.ndarray) -> np.ndarray:
    """Repeated k-mers with the number of their occurrence."""
    ordered = np.sort(grams)
    if not (ordered[1:] == ordered[:-1]).any():
        return grams.copy()
    n = len(grams)
    order = np.argsort(grams, kind="stable")
    again = ordered[1:] == ordered[:-1]
    start = np.maximum.accumulate(np.where(np.r_[True, ~again], np.arange(n), 0))
    number = np.empty(n, np.uint64)
    number[order] = np.arange(n) - start
    return np.where(number > 0, mix(grams + number * np.uint64(0xD6E8FEB86659FD93)), grams)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sketch(grams: np.ndarray, cfg: OrderMinHash) -> list[int]:
    """Bucket keys of one text; texts near the limit of ``short`` are in both families."""
    out: list[int] = []
    n = len(grams)
    if n <= cfg.short:
        out += _family(grams, cfg.short_least, cfg.short_sketches, 1 << 20)
    if n > cfg.similarity * cfg.short:
        out += _family(grams, cfg.least, cfg.sketches, 1 << 21)
    return out


# Hashes of one text in memory at one time.
HASHES_AT_ONCE = 1 << 18


def _family(grams: np.ndarray, least: int, count: int, base: int) -> list[int]:
    n, least, keys = len(grams), min(least, len(grams)), []
    seeds = np.array([(base + j) * 0x9E3779B97F4A7C15 % (1 << 64) for j in range(count)], np.uint64)
    at_once = max(1, HASHES_AT_ONCE // n)
    for lo in range(0, count, at_once):
        hashed = (grams ^ seeds[lo : lo + at_once, None]) * np.uint64(0xFF51AFD7ED558CCD)
        hashed ^= hashed >> np.uint64(32)
        hashed *= np.uint64(0xC4CEB9FE1A85EC53)
        if least < n:
            picked = np.sort(np.argpartition(hashed, least - 1, axis=1)[:, :least], axis=1)
        else:
            picked = np.broadcast_to(np.arange(n), hashed.shape)
        for j, one in enumerate(grams[picked], base + lo):
            keys.append(xxhash.xxh64_intdigest(one.tobytes(), seed=j) - (1 << 63))
    return keys


def alignment(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Share of k-mers aligned in order, or 0 if it is below ``least``.

    Labelled k-mers are unique in a text, so the alignment is the longest rising
    run of positions among common ones. ``d`` insertions and deletions are all
    the bound allows, so only matches at most ``d`` off the diagonal count.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    need = least * (n + m) / (1 + least)
    if min(n, m) < need - 1e-9:
        return 0.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = np.abs(at_a - at_b) <= n + m - 2 * need + 1e-9
    at_a, at_b = at_a[band], at_b[band]
    if len(at_a) < need - 1e-9:
        return 0.0
    path = at_b[np.argsort(at_a)]
    if (path[1:] > path[:-1]).all():
        length = len(path)
    else:
        tails: list[int] = []
        for x in path.tolist():
            i = bisect_left(tails, x)
            if i == len(tails):
                tails.append(x)
            else:
                tails[i] = x
        length = len(tails)
    return length / (n + m - length) if length >= need - 1e-9 else 0.0


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """(node, text, ``more``) of each row, written once: the digest is made in one pass only."""
    return stage_table(docs.select(node_of(F.col("text")).alias("node"), F.col("text").alias("text"), *more), "keyed")


def sketches(rows: DataFrame, cfg: OrderMinHash) -> DataFrame:
    """(node, n, keys) of each different text of ``rows`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                grams = kmers_of(part.column(1), cfg.words)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(g) for g in grams], pa.int64()),
                        pa.array([sketch(g, cfg) if len(g) else [] for g in grams], pa.list_(pa.int64())),
                    ],
                    ["node", "n", "keys"],
                )

    found = rows.select("node", "text").mapInArrow(run, "node binary, n long, keys array<long>")
    return found.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))


def bucket_members(rows: DataFrame, cfg: OrderMinHash, ends: int) -> DataFrame:
    """Members (bucket, node, n, root, own, side) of buckets with two roots or more, each with the
    nodes ``others`` to compare it with, and whether it is ``chosen`` itself. Members of side -1
    and 1 are compared with the other side only, those of 0 with all.

    A bucket chooses at most ``ends`` nodes: the one with the fewest k-mers of its own
    (the original among edited copies) and the greatest one of each of ``ends / 2``
    parts of all nodes, so overlapping buckets choose the same ones.
    """
    part = F.pmod(F.xxhash64("node", F.lit(ends)), F.lit(ends // 2))
    whole = F.struct("node", "n", "root", "side")
    chosen = (
        rows.groupBy("bucket", part.alias("part"))
        .agg(
            F.min_by(whole, F.struct("own", "node")).alias("lo"), F.max(whole).alias("hi"),
            F.min("root").alias("first"), F.max("root").alias("last"),
            F.min("side").alias("low"), F.max("side").alias("high"),
        )
        .groupBy("bucket")
        .agg(
            F.array_distinct(F.flatten(F.collect_list(F.array("lo", "hi")))).alias("all"),
            F.min("first").alias("first"), F.max("last").alias("last"),
            F.min("low").alias("low"), F.max("high").alias("high"),
        )
        .filter("first < last and (low < high or low = 0)")
    )
    size, least = F.col("n"), cfg.similarity
    partners = F.filter(
        "all",
        lambda x: (x["root"] != F.col("root"))
        & (x["side"] * F.col("side") <= 0)
        & (F.least(size, x["n"]) >= least * F.greatest(size, x["n"])),
    )
    own = F.exists("all", lambda x: x["node"] == F.col("node"))
    return rows.join(chosen.select("bucket", "all"), "bucket").select(
        "bucket", "node", "n", "root", "own", "side", own.alias("chosen"), partners["node"].alias("others")
    )


CACHED_KMERS = 4_000_000


def verified(pairs: DataFrame, texts: DataFrame, cfg: OrderMinHash) -> DataFrame:
    """(node, pivot, similarity) of those pairs whose alignment reaches the bound.

    A pivot can stand in very many pairs, a member in few: texts of pivots come
    first, so after the second join the pairs lie spread by member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, grams in kmers_of_pairs(batches, cfg.words):
            found = [alignment(x, y, cfg.similarity) for x, y in grams]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:2], pa.array(found, pa.float64())], ["node", "pivot", "similarity"]
            )

    full = with_texts(pairs, texts)
    return full.mapInArrow(run, "node binary, pivot binary, similarity double").filter("similarity > 0")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, pivot, text, pivot_text) of ``pairs``."""
    pivots = texts.select(F.col("node").alias("pivot"), F.col("text").alias("pivot_text"))
    return pairs.join(pivots, "pivot").join(texts, "node").select("node", "pivot", "text", "pivot_text")


def kmers_of_pairs(
    batches: Iterator[pa.RecordBatch], k: int
) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Slices of rows of ``with_texts`` and the k-mers of both texts of each row."""
    cache: dict[bytes, np.ndarray] = {}
    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            a, b, text_a, text_b = part.columns
            pairs = list(zip(a.to_pylist(), b.to_pylist()))
            if held > CACHED_KMERS:
                cache.clear()
                held = 0
            new: dict[bytes, tuple[int, int]] = {}
            for i, pair in enumerate(pairs):
                for side, node in enumerate(pair):
                    if node not in cache:
                        new.setdefault(node, (side, i))
            for side, column in enumerate((text_a, text_b)):
                mine = [node for node, (where, _) in new.items() if where == side]
                for node, grams in zip(mine, kmers_of(column.take(pa.array([new[x][1] for x in mine], pa.int64())), k)):
                    cache[node] = grams
                    held += len(grams) + 100
            yield part, [(cache[x], cache[y]) for x, y in pairs]


def compared(pairs: DataFrame) -> DataFrame:
    """Different pairs, each once whichever of the two was chosen."""
    a, b = F.least("node", "pivot"), F.greatest("node", "pivot")
    once = pairs.groupBy(a.alias("a"), b.alias("b")).agg(F.max(F.col("pivot") == a).alias("first"))
    pivot = F.when(F.col("first"), F.col("a")).otherwise(F.col("b"))
    node = F.when(F.col("first"), F.col("b")).otherwise(F.col("a"))
    return once.select(node.alias("node"), pivot.alias("pivot"))


def links(docs: DataFrame, cfg: OrderMinHash = OrderMinHash()) -> DataFrame:
    """Verified links (a, b) between nodes, enough of them to connect each class."""
    return _links(keyed(docs), cfg)[0]


def _links(docs: DataFrame, cfg: OrderMinHash) -> tuple[DataFrame, DataFrame]:
    """``links`` of rows (node, text), and the components (node, root) they make."""
    base = stage_table(sketches(docs, cfg), "sketches")
    rows = base.select(F.explode("keys").alias("bucket"), "node", "n")
    # most buckets hold one text: they go before anything is chosen
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    rows = stage_table(rows.join(shared, "bucket", "left_semi"), "shared-buckets")
    rows = rows.select("*", F.col("node").alias("root"), F.lit(0).cast("long").alias("own"), F.lit(0).alias("side"))
    members = stage_table(bucket_members(rows, cfg, 2), "members")
    # one text of each node in a bucket, written once for all rounds
    in_bucket = docs.select("node", "text").join(members.select("node").distinct(), "node", "left_semi")
    texts = stage_table(in_bucket.groupBy("node").agg(F.first("text").alias("text")), "texts")
    pairs = members.select("bucket", "node", "chosen", F.explode("others").alias("pivot"))
    found = _linked(pairs, texts, cfg)
    roots = components(found)
    # buckets whose members are still of two components: their texts, linked or not, are joined exactly
    rest = _rooted(members.select("bucket", "node"), roots)
    open_buckets = rest.groupBy("bucket").agg(F.min("root").alias("first"), F.max("root").alias("last"))
    rest = rest.join(open_buckets.filter("first < last"), "bucket", "left_semi").select("node").distinct()
    shared = shared_kmers(texts.join(rest, "node", "left_semi"), cfg)
    rows = stage_table(prefixes(shared, cfg), "prefixes")
    rows = _narrowed(_rooted(rows, roots).withColumn("side", F.lit(0)), texts, cfg, shared)
    ends = 2
    while not rows.isEmpty():
        members = bucket_members(rows, cfg, ends)
        each = members.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others"))
        new = _linked(each.select("node", F.explode("others").alias("pivot")), texts, cfg)
        found = found.unionAll(new)
        # a chosen node was compared with all of its bucket; others stay until one component is left
        left = members.filter("not chosen").select("bucket", "node", "n", "own", "root", "side")
        if not new.isEmpty():
            roots = components(roots.toDF("a", "b").unionAll(new))
            left = _rooted(left.drop("root"), roots)
        rows = stage_table(left, "rest")
        ends *= 4
    return found, roots


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` of each node; nodes without a link are their own."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


# Buckets of more texts are narrowed first.
FEW = 8


def _narrowed(rows: DataFrame, texts: DataFrame, cfg: OrderMinHash, shared: DataFrame) -> DataFrame:
    """``rows`` (bucket, node, n, root, own, side) of buckets with two roots, and ``differences`` in place of
    the buckets of more than ``FEW`` texts.

    The pivot of a bucket is the text with the fewest k-mers of its own that its members
    meet in any bucket, so overlapping buckets have the same one, the original of edited copies.
    """
    rank = F.struct("own", (-F.col("n")).alias("less"), "node")
    sized = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("texts"), F.min("root").alias("first"), F.max("root").alias("last"), F.min(rank).alias("hub")
    )
    sized = sized.filter("first < last").drop("first", "last")
    rows = stage_table(rows.join(sized, "bucket"), "open-buckets")
    few, many = rows.filter(F.col("texts") <= FEW), rows.filter(F.col("texts") > FEW)
    if many.isEmpty():
        return few.drop("texts", "hub")
    best = many.groupBy("node").agg(F.min("hub").alias("best"))
    pivots = many.join(best, "node").groupBy("bucket").agg(F.min("best")["node"].alias("pivot"))
    asked = many.join(pivots, "bucket").select("node", "pivot", "n", "own", "root").distinct()
    found = differences(stage_table(asked, "asked-pivots"), texts, cfg, shared)
    return stage_table(few.drop("texts", "hub").unionByName(found), "narrowed")


def differences(asked: DataFrame, texts: DataFrame, cfg: OrderMinHash, shared: DataFrame | None = None) -> DataFrame:
    """(bucket, node, n, root, own, side): texts with a pivot that can be similar, by what they differ in.

    ``d`` of a text are the k-mers that it or the middle of its pivot has alone. The middle are those k-mers of
    the pivot that are in more texts than half of its members; any other set would give the same pairs, this one
    is near most members. K-mers of one text only (not in ``shared``) are counted and not listed. Two texts of ``n`` and ``m`` k-mers
    differ in ``d + e - 2 * o`` if ``o`` of these are the same, and similar ones in at most
    ``c * (n + m)``, where ``c = (1 - s) / (1 + s)``. So ``o`` is at least the sum of both weights ``(d - c * n) / 2``.
    Each text goes, for each class of weights a partner can have, to the buckets of its rarest
    differences, as many as any such partner must share one of. Differences of one text come first and
    make no bucket. Where the sum can be 0, the class itself is a bucket. The side tells the class of less
    weight from that of more: only texts of both can be partners.
    """

    shared = shared_kmers(texts, cfg) if shared is None else shared
    sizes = asked.groupBy("pivot").agg(F.count(F.lit(1)).alias("members"))
    usual = F.filter("shared", lambda x: 2 * x["texts"] > F.col("members"))["gram"]
    middles = stage_table(
        sizes.join(shared.select(F.col("node").alias("pivot"), "shared"), "pivot").select("pivot", usual.alias("middle")),
        "middles",
    )
    none = F.array().cast("array<long>")
    mine, middle = F.coalesce(F.col("shared")["gram"], none), F.coalesce("middle", none)
    each = (
        asked.join(middles, "pivot", "left")
        .join(shared.select("node", "shared"), "node", "left")
        .select("node", "pivot", "n", "root", "own", mine.alias("mine"), middle.alias("middle"))
        .withColumn("grams", F.concat(F.array_except("mine", "middle"), F.array_except("middle", "mine")))
    )
    d = F.col("n") - F.size("mine") + F.size("grams")
    each = stage_table(each.select("node", "pivot", "n", "root", "own", d.alias("d"), "grams"), "differences")
    grams = each.select("node", "pivot", F.explode("grams").alias("gram"))
    common = grams.groupBy("pivot", "gram").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    met_by = (
        grams.join(common, ["pivot", "gram"])
        .groupBy("node", "pivot")
        .agg(F.array_sort(F.collect_list(F.struct("texts", "gram")))["gram"].alias("shared"))
    )
    ranked = each.drop("grams").join(met_by, ["node", "pivot"], "left").withColumn("shared", F.coalesce("shared", none))
    c, s, n = (1 - cfg.similarity) / (1 + cfg.similarity), cfg.similarity, F.col("n")
    level = lambda x: F.floor(F.log2(x) + 1e-9).cast("int")
    # pairs meet at the level of the longer text
    ranked = ranked.withColumn("weight", (F.col("d") - c * n) / 2).withColumn(
        "level", F.explode(F.sequence(level(n), level(n / s)))
    )
    unit = F.greatest(F.pow(F.lit(2.0), F.col("level")) / 32, F.lit(1.0))
    ranked = ranked.withColumn("unit", unit).withColumn("mine", F.floor(F.col("weight") / unit))
    weight, shared = F.col("weight"), F.size("shared")
    # a partner differs by c * (n + m) at most, so does its distance from the pivot
    least = F.greatest(weight - c * n / s, -c * n / s / 2) - 1e-6
    most = F.least(weight + c * n, shared - weight) + 1e-6
    least, most = F.floor(least / F.col("unit")), F.floor(most / F.col("unit"))
    ranked = ranked.withColumn("other", F.explode(F.when(least <= most, F.sequence(least, most))))
    need = F.ceil(weight + F.col("other") * F.col("unit") - 1e-6)
    taken = F.slice("shared", 1, F.greatest(shared - F.greatest(need, F.lit(1)) + 1, F.lit(0)).cast("int"))
    alone = F.array(F.lit(None).cast("long"))
    met = ranked.withColumn("gram", F.explode(F.when(F.col("mine") + F.col("other") <= 0, alone).otherwise(taken)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    met = stage_table(
        met.select(
            F.xxhash64("pivot", "level", low, high, "gram").alias("bucket"),
            "node", "n", "root", "own", F.signum(F.col("mine") - F.col("other")).cast("int").alias("side"),
        ),
        "met",
    )
    both = met.groupBy("bucket").agg(
        F.min("root").alias("first"), F.max("root").alias("last"), F.min("side").alias("low"), F.max("side").alias("high")
    )
    both = both.filter("first < last and (low < high or low = 0)")
    return met.join(both, "bucket", "left_semi")


def _ordered() -> list[Column]:
    return [F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")]


def _linked(pairs: DataFrame, texts: DataFrame, cfg: OrderMinHash) -> DataFrame:
    return stage_table(verified(compared(pairs), texts, cfg).select(*_ordered()), "links")


def shared_kmers(texts: DataFrame, cfg: OrderMinHash) -> DataFrame:
    """(node, n, shared): the k-mers of each text that others have, too, as (texts, gram), the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                grams = [g.view(np.int64) for g in kmers_of(part.column(1), cfg.words)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(grams, pa.list_(pa.int64()))], ["node", "grams"]
                )

    grams = texts.select("node", "text").mapInArrow(run, "node binary, grams array<long>")
    each = stage_table(
        grams.select("node", F.size("grams").cast("long").alias("n"), F.explode("grams").alias("gram")), "grams"
    )
    common = each.groupBy("gram").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    found = each.join(common, "gram").groupBy("node", "n")
    return stage_table(
        found.agg(F.array_sort(F.collect_list(F.struct("texts", "gram"))).alias("shared")), "shared-kmers"
    )


def prefixes(shared: DataFrame, cfg: OrderMinHash) -> DataFrame:
    """(bucket, node, n, own): the rarest k-mers of each text, as many as any partner must share one of.

    Texts of similarity ``s`` have at least ``s * n`` common k-mers, so in one
    order of all k-mers two such texts meet within their first ``n - s * n + 1``.
    With rare k-mers first, passages and phrases of many texts cause no buckets.
    ``own`` is the number of k-mers that no other text has.
    """
    # k-mers of one text come first and make no bucket: they only use up the prefix
    own = F.col("n") - F.size("shared")
    taken = F.col("n") - F.ceil(F.lit(cfg.similarity) * F.col("n") - 1e-9) + 1 - own
    prefix = F.slice(F.col("shared")["gram"], 1, F.greatest(taken, F.lit(0)).cast("int"))
    return shared.select(F.explode(prefix).alias("bucket"), "node", "n", own.alias("own"))


def classes(docs: DataFrame, cfg: OrderMinHash = OrderMinHash()) -> DataFrame:
    """(node, class_id, class_size, copies, first_id): class of each different text.

    ``class_id`` is the least doc_id of the class, null if it has none.
    """
    return _classes(keyed(docs, "doc_id"), cfg)


def _classes(docs: DataFrame, cfg: OrderMinHash) -> DataFrame:
    """``classes`` of rows (node, text, doc_id)."""
    ids = docs.select("node", F.col("doc_id").cast("long").alias("doc_id"))
    nodes = ids.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    _, roots = _links(docs, cfg)
    placed = stage_table(
        nodes.join(roots, "node", "left").select(
            "node", "first_id", "copies", F.coalesce("root", "node").alias("root")
        ),
        "placed",
    )
    sums = placed.groupBy("root").agg(
        F.min("first_id").alias("class_id"),
        F.sum("copies").alias("class_size"),
        # the text that stays: the one of the least id, ties by digest
        F.min(F.struct(F.col("first_id").isNull(), "first_id", "node"))["node"].alias("keeper"),
    )
    return stage_table(placed.join(sums, "root").drop("root"), "classes")


def deduplicate(docs: DataFrame, cfg: OrderMinHash = OrderMinHash()) -> DataFrame:
    """One row of each class, that of the least id (null last), with its own columns."""
    keep = classes(docs, cfg).filter("node = keeper").select("node", "first_id")

    def key(doc_id: Column, node: Column) -> Column:
        return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.hex(node))

    kept = keep.select(key(F.col("first_id"), F.col("node")).alias("key"))
    rows = packed(docs, key(F.col("doc_id").cast("long"), node_of(F.col("text"))).alias("key"))
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def q_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class, the size of the class, and copies of its own text."""
    docs = keyed(table(spark, sf_dir, "documents"), "doc_id")
    return docs.select("doc_id", "node").join(_classes(docs, OrderMinHash()), "node").select("doc_id", "class_id", "class_size", "copies")
