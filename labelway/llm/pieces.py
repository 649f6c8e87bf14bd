"""SentencePiece encoding and decoding, giant documents by a max-plus scan over chunks.

The vocabulary at hand is a BPE model, so the lattice scores whether neighbours fit
instead of adding piece scores: two adjacent pieces fit (0) if the merges keep
them apart, else they don't (minus infinity). A chain of pieces is the encoding
exactly if all neighbours fit, so the best path of the lattice is the library's
encoding. (The Viterbi sum of piece scores is another, unigram, segmentation.)

A boundary state is the piece that covers the last character before a chunk's
end. Each chunk yields a matrix from the states at its start to those at its
end; matrices are combined by max-plus products, forwards and backwards, which
gives the one finite state at each boundary; then every chunk is traced back on
its own. Where no piece can cross (before a space mark that follows another
character) a chunk needs one state only, and words between such places come
from the library through a cache.

Defined cases: a null or empty text has no ids. The space mark U+2581 in a text is
decoded as a space, as the library does. Repeated rows are encoded each.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelway.llm.common import table

MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
RESET = re.compile(f"(?<=[^{MARK}]){MARK}")
# Entries of one generation of a cache, about 200 bytes each.
CACHE = 120_000
# Rows and chunks that a task turns into Python values at a time.
SLICE_ROWS = 256
SLICE_CHUNKS = 32
_codecs: dict[str, Codec] = {}


class Cache:
    """What was met lately, in two generations of bounded size: a full one becomes the old one,
    and what is met there again moves on."""

    def __init__(self, limit: int = CACHE) -> None:
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and key in self.old:
            found = self.old[key]
            self.put({key: found})
        return found

    def get_all(self, keys: list) -> list:
        found = list(map(self.young.get, keys))
        if None in found and self.old:
            found = [self.get(k) if x is None else x for k, x in zip(keys, found)]
        return found

    def put(self, new: dict) -> None:
        if len(self.young) + len(new) > self.limit:
            self.old, self.young = self.young, {}
        self.young.update(new)


@dataclass(frozen=True)
class PieceConfig:
    model: str = public_tokenizers.path("piece_bpe_32k.model")
    chunk_chars: int = 1 << 15


class Codec:
    """A BPE model of the library with caches, one per worker process and file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.vocab_size()
        self.names = [self.library.id_to_piece(i) for i in range(n)]
        special = [self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.names) if not special[i]}
        self.scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        if any(RESET.search(p) for p in self.ids):
            raise ValueError("pieces that hold a space mark after other characters are not supported")
        self.data = [
            bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else b"" if self.library.is_control(i) else p.encode()
            for i, p in enumerate(self.names)
        ]
        self.known = Cache()
        self.fits = Cache()

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in _codecs:
            _codecs[path] = cls(path)
        return _codecs[path]

    def symbols(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def words(self, symbols: str) -> bytes:
        """Ids (little-endian uint32) of a text that begins and ends where no piece crosses."""
        words = WORDS.findall(symbols)
        found = self.known.get_all(words)
        if None in found:
            missing = list({w for w, x in zip(words, found) if x is None})
            # the library puts a mark before each text itself
            new = {
                w: np.array(ids, "<u4").tobytes()
                for w, ids in zip(missing, self.library.encode([w[1:] if w != MARK else " " for w in missing], num_threads=1))
            }
            if MARK in new:
                new[MARK] = np.array([self.ids[MARK]], "<u4").tobytes()
            self.known.put(new)
            found = [new[w] if x is None else x for w, x in zip(words, found)]
        return b"".join(found)

    def fit(self, a: str, b: str) -> bool:
        """Whether the merges of ``a + b`` end in the pieces ``a`` and ``b``."""
        found = self.fits.get((a, b))
        if found is None:
            found = self.merge(a + b) == [a, b]
            self.fits.put({(a, b): found})
        return found

    def merge(self, text: str) -> list[str]:
        """The model's merges of a short text: best score first, leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def piece_ids(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.library.piece_to_id(f"<0x{b:02X}>") for b in piece.encode("utf-8", "surrogatepass")]

    def from_position(self, s: str, at: int) -> list[tuple[int, int]]:
        """Pieces of ``s`` that begin at ``at``; single characters always."""
        return [
            (at, e) for e in range(at + 1, min(at + self.longest, len(s)) + 1) if e == at + 1 or s[at:e] in self.ids
        ]

    def states(self, s: str, at: int) -> list[tuple[int, int]]:
        """Boundary states: pieces that cover the character before ``at``."""
        return [p for b in range(max(0, at - self.longest), at) for p in self.from_position(s, b) if p[1] >= at]

    def lattice(self, s: str, sources: list[tuple[int, int]] | None, begin: int, stop: int):
        """Pieces that begin before ``stop`` and are reached, as bits of the sources that
        reach them, with their predecessors. Without sources, all start at ``begin``."""
        reach: dict[tuple[int, int], int] = {}
        before: dict[tuple[int, int], list] = defaultdict(list)
        ending: dict[int, list] = defaultdict(list)
        for i, p in enumerate(sources or []):
            reach[p] = 1 << i
            ending[p[1]].append(p)
        for at in range(begin, stop):
            here = ending.pop(at, [])
            if not here and (sources is not None or at > begin):
                continue
            for q in self.from_position(s, at):
                bits = 1 if sources is None and at == begin else 0
                for p in here:
                    if self.fit(s[p[0] : p[1]], s[q[0] : q[1]]):
                        bits |= reach[p]
                        before[q].append(p)
                if bits:
                    reach[q] = reach.get(q, 0) | bits
                    ending[q[1]].append(q)
        return reach, before

    def trace(self, before, last, first) -> list[tuple[int, int]]:
        """The path to ``last`` after ``first`` (None: from the beginning)."""
        path, p = [], last
        while p != first:
            path.append(p)
            if not before[p]:
                break
            p = before[p][0]
        return path[::-1]

    def encode(self, text: str | None) -> bytes:
        return self.words(self.symbols(text or ""))

    def decode(self, ids: np.ndarray) -> str:
        data = self.data
        text = b"".join([data[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def transfer(codec: Codec, s: str, a: int, b: int, end: bool) -> tuple[list, list, np.ndarray]:
    """States at ``a``, states at ``b`` and the max-plus matrix between them.

    ``s`` is the chunk [a, b) with the context that pieces at its ends can cover.
    ``a`` = 0 has the one state of the beginning, ``end`` the one of the end.
    """
    entering = codec.states(s, a) if a else [(0, 0)]
    leaving = [(b, b)] if end else codec.states(s, b)
    matrix = np.full((len(entering), len(leaving)), -np.inf)
    resets = [m.start() for m in RESET.finditer(s, a + 1, b + 1) if a < m.start() <= b - 1]

    def into(reach, target) -> int:
        if target[0] == target[1]:  # the end: any piece that ends there
            return sum(bits for p, bits in [(0, 0)]) or _union(bits for p, bits in reach.items() if p[1] == b)
        return reach.get(target, 0)

    if resets:
        first, last = resets[0], resets[-1]
        head, _ = codec.lattice(s, entering if a else None, a if a else 0, first)
        bits = _union(x for p, x in head.items() if p[1] == first)
        tail, _ = codec.lattice(s, None, last, b)
        for i in range(len(entering)):
            for j, target in enumerate(leaving):
                if bits >> i & 1 and into(tail, target):
                    matrix[i, j] = 0.0
        return entering, leaving, matrix
    reach, _ = codec.lattice(s, entering if a else None, a if a else 0, b)
    for j, target in enumerate(leaving):
        bits = into(reach, target)
        for i in range(len(entering)):
            if bits >> i & 1:
                matrix[i, j] = 0.0
    return entering, leaving, matrix


def _union(bits) -> int:
    out = 0
    for x in bits:
        out |= x
    return out


def chunk_ids(codec: Codec, s: str, a: int, b: int, source, target) -> bytes:
    """Ids of the pieces after the state at ``a`` up to the state at ``b``."""
    resets = [m.start() for m in RESET.finditer(s, a + 1, b + 1) if a < m.start() <= b - 1]
    begin = source is None

    def close(reach, before, last, first):
        if last is None:
            ends = [p for p in reach if p[1] == b]
            last = ends[0] if ends else first
        return codec.trace(before, last, first)

    def as_ids(path) -> bytes:
        return np.array([i for x, y in path for i in codec.piece_ids(s[x:y])], "<u4").tobytes()

    if not resets:
        reach, before = codec.lattice(s, None if begin else [source], a if begin else a, b)
        return as_ids(close(reach, before, target, source))
    first, last = resets[0], resets[-1]
    if begin:
        out = codec.words(s[a:first])
    else:
        reach, before = codec.lattice(s, [source], a, first)
        ends = [p for p in reach if p[1] == first]
        out = as_ids(codec.trace(before, ends[0], source))
    out += codec.words(s[first:last])
    reach, before = codec.lattice(s, None, last, b)
    return out + as_ids(close(reach, before, target, None))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by doubling."""
    out, step = list(matrices), 1
    while step < len(out):
        out = out[:step] + [combine(out[i - step], out[i]) for i in range(step, len(out))]
        step *= 2
    return out


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """State at each inner boundary: the one on the best whole path."""
    forward = scan(matrices)
    backward = [m.T for m in scan([m.T for m in reversed(matrices)])][::-1]
    return [int(np.argmax(forward[i][0] + backward[i + 1][:, 0])) for i in range(len(matrices) - 1)]


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode_documents(docs: DataFrame, cfg: PieceConfig = PieceConfig()) -> DataFrame:
    """(doc_id, text, ids, n_chunks): ids of every row, little-endian uint32."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(cfg.model)
        for batch in sliced(batches, SLICE_ROWS):
            ids = [codec.encode(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.binary()), pa.array([1] * len(ids), pa.int64())],
                ["doc_id", "text", "ids", "n_chunks"],
            )

    schema = "doc_id long, text string, ids binary, n_chunks long"
    small = rows.filter(size <= cfg.chunk_chars).mapInArrow(whole, schema)
    return small.unionAll(_giant(rows.filter(size > cfg.chunk_chars), cfg))


def _giant(rows: DataFrame, cfg: PieceConfig) -> DataFrame:
    """Encodes long texts chunk by chunk; equal rows are encoded once and repeated."""
    chunk, context = cfg.chunk_chars, 64
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5("text"))
    docs = rows.withColumn("key", key).groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")
    )
    marked = F.concat(F.lit(MARK), F.translate("text", " ", MARK))
    cut = F.col("chunk") * chunk
    cuts = (
        docs.select("key", marked.alias("s"))
        .select("key", "s", F.length("s").alias("n"), F.explode(F.sequence(F.lit(0), F.ceil(F.length("s") / chunk) - 1)).alias("chunk"))
        .select(
            "key", F.col("chunk").cast("int").alias("chunk"),
            F.least(cut, F.lit(context)).cast("int").alias("a"),
            (F.least(cut, F.lit(context)) + F.least(F.col("n") - cut, F.lit(chunk))).cast("int").alias("b"),
            (cut + chunk >= F.col("n")).alias("last"),
            F.substring(F.col("s"), F.greatest(cut - context, F.lit(0)).cast("int") + 1, F.lit(chunk + 2 * context)).alias("s"),
        )
        .repartition("key", "chunk")
    )

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(cfg.model)
        for batch in sliced(batches, SLICE_CHUNKS):
            out = []
            for row in batch.to_pylist():
                entering, leaving, m = transfer(codec, row["s"], row["a"], row["b"], row["last"])
                flat = lambda states, at: [x - at for p in states for x in p]
                out.append(
                    {"key": row["key"], "chunk": row["chunk"], "entering": flat(entering, row["a"]),
                     "leaving": flat(leaving, row["b"]), "matrix": m.ravel().tolist()}
                )
            yield pa.RecordBatch.from_pylist(out, MATRIX)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        shapes = [
            np.asarray(m, float).reshape(len(e) // 2, len(x) // 2)
            for m, e, x in zip(group["matrix"], group["entering"], group["leaving"])
        ]
        states = boundary_states(shapes)
        pairs = [list(np.asarray(x)[2 * i : 2 * i + 2]) for i, x in zip(states, group["leaving"])]
        return pd.DataFrame(
            {"key": group["key"], "chunk": group["chunk"], "source": [None, *pairs], "target": [*pairs, None]}
        )

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(cfg.model)
        for batch in sliced(batches, SLICE_CHUNKS):
            out = []
            for row in batch.to_pylist():
                at = lambda pair, base: pair and (pair[0] + base, pair[1] + base)
                a, b = row["a"], row["b"]
                ids = chunk_ids(codec, row["s"], a, b, at(row["source"], a), at(row["target"], b))
                out.append({"key": row["key"], "chunk": row["chunk"], "ids": ids})
            yield pa.RecordBatch.from_pylist(
                out, pa.schema([("key", pa.string()), ("chunk", pa.int32()), ("ids", pa.binary())])
            )

    found = cuts.mapInArrow(
        matrices, "key string, chunk int, entering array<int>, leaving array<int>, matrix array<double>"
    )
    states = found.groupBy("key").applyInPandas(
        choose, "key string, chunk int, source array<int>, target array<int>"
    )
    traced = cuts.join(states, ["key", "chunk"]).mapInArrow(trace, "key string, chunk int, ids binary")
    ids = F.array_sort(F.collect_list(F.struct("chunk", "ids")))["ids"]
    whole = traced.groupBy("key").agg(ids.alias("ids"))
    joined = F.aggregate("ids", F.lit(b"").cast("binary"), lambda x, y: F.concat(x, y))
    return docs.join(whole, "key").select(
        "doc_id", "text", joined.alias("ids"), F.size("ids").cast("long").alias("n_chunks"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


MATRIX = pa.schema(
    [
        ("key", pa.string()), ("chunk", pa.int32()), ("entering", pa.list_(pa.int32())),
        ("leaving", pa.list_(pa.int32())), ("matrix", pa.list_(pa.float64())),
    ]
)


def decode_documents(encoded: DataFrame, cfg: PieceConfig = PieceConfig()) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, n_chunks, n_chars, round_trip): texts decoded again and compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(cfg.model)
        for batch in sliced(batches, SLICE_ROWS):
            out = defaultdict(list)
            for text, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                decoded = codec.decode(np.frombuffer(ids, "<u4"))
                out["n_tokens"].append(len(ids) // 4)
                out["ids_crc32"].append(zlib.crc32(ids))
                out["n_chars"].append(len(decoded))
                out["same"].append(decoded == text.replace(MARK, " "))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_crc32"], pa.int64()),
                 batch.column(3), pa.array(out["n_chars"], pa.int64()), pa.array(out["same"], pa.bool_())],
                ["doc_id", "n_tokens", "ids_crc32", "n_chunks", "n_chars", "round_trip"],
            )

    return encoded.select("doc_id", "text", "ids", "n_chunks").mapInArrow(
        run, "doc_id long, n_tokens long, ids_crc32 long, n_chunks long, n_chars long, round_trip boolean"
    )


def q_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_documents(encode_documents(table(spark, sf_dir, "documents")))
