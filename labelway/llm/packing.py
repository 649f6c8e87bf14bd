"""Cost-balanced packing of documents into training sequences.

A piece of ``n`` tokens costs ``linear * n + quadratic * n * n`` (attention stays
within a document). Documents in descending length go to the sequence of lowest
cost with remaining capacity; what does not fit is cut off and assigned again,
so sequences fill up. Each input partition packs on its own in windows of a
bounded number of tokens: a window makes as many full sequences as it has tokens
for and hands the rest to the next one. Only the last window of a partition pads,
by less than one sequence. One map over the input, no shuffle.

Sequence ids are the partition number times 2^40 plus a running number: unique,
and the same again if a lost task is repeated over the same split.

Defined cases: a null or empty text is the end token alone. Repeated rows are
packed each. An empty table gives no piece.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from labelway.llm.common import table
from labelway.llm.tokens import WordEncoder


@dataclass(frozen=True)
class PackingConfig:
    tokenizer: str = public_tokenizers.path("word_bpe_49k.json")
    capacity: int = 4096
    end_id: int = 2
    linear: float = 4096.0
    quadratic: float = 1.0
    #: tokens held at once; a single longer document makes a window of its own
    window_tokens: int = 1 << 20


@dataclass(frozen=True)
class Piece:
    doc: int
    start: int
    length: int
    sequence: int
    offset: int


class Rooms:
    """Sequences by remaining room: the cheapest one with enough room, in the logarithm of the capacity.

    A heap per room, and a tree of their least (cost, sequence, room) over ranges of rooms.
    """

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int, int]]] = [[] for _ in range(capacity + 1)]
        self.least: list[tuple[float, int, int] | None] = [None] * (2 * self.size)

    def add(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence, room))
        self._update(room)

    def cheapest(self, n: int) -> tuple[float, int, int] | None:
        """Takes out the sequence of least cost, ties by number, that has room for ``n``."""
        if n >= len(self.heaps):
            return None
        best, at, end = None, n + self.size, 2 * self.size
        while at < end:
            if at & 1:
                best = _lesser(best, self.least[at])
                at += 1
            at, end = at // 2, end // 2
        if best is not None:
            heapq.heappop(self.heaps[best[2]])
            self._update(best[2])
        return best

    def _update(self, room: int) -> None:
        at, least = room + self.size, self.least
        least[at] = self.heaps[room][0] if self.heaps[room] else None
        while at > 1:
            at //= 2
            least[at] = _lesser(least[2 * at], least[2 * at + 1])


def _lesser(a, b):
    return b if a is None or (b is not None and b < a) else a


def pack(
    lengths: Iterable[tuple[int, int, int]], cfg: PackingConfig, last: bool
) -> tuple[list[Piece], list[tuple[int, int, int]], int]:
    """Packs (document, start, length) entries; pieces, what is left, sequences used.

    Unless ``last``, only full sequences are made and the rest is returned.
    """
    entries = [(-n, doc, start) for doc, start, n in lengths if n]
    total = -sum(e[0] for e in entries)
    count = -(-total // cfg.capacity) if last else total // cfg.capacity
    heapq.heapify(entries)
    rooms = Rooms(cfg.capacity)
    for s in range(count):
        rooms.add(cfg.capacity, 0.0, s)
    pieces: list[Piece] = []
    while entries:
        n, doc, start = heapq.heappop(entries)
        n = -n
        found = rooms.cheapest(n) or rooms.cheapest(1)
        if found is None:
            heapq.heappush(entries, (-n, doc, start))
            break
        cost, s, room = found
        take = min(n, room)
        pieces.append(Piece(doc, start, take, s, cfg.capacity - room))
        if room > take:
            rooms.add(room - take, cost + cfg.linear * take + cfg.quadratic * take * take, s)
        if n > take:
            heapq.heappush(entries, (take - n, doc, start + take))
    return pieces, [(doc, start, -n) for n, doc, start in sorted(entries)], count


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)
FIELDS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
]


def packer(cfg: PackingConfig, partition: Callable[[], int], keep_ids: bool = True):
    """The task: batches of (doc_id, text) to batches of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base, used = WordEncoder.of(cfg.tokenizer), partition() << 40, 0
        end = np.uint32(cfg.end_id).astype("<u4").tobytes()
        held: dict[int, tuple[int | None, bytes]] = {}
        waiting: list[tuple[int, int, int]] = []
        tokens = number = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal waiting, used, tokens
            pieces, waiting, count = pack(waiting, cfg, last)
            rows = []
            for p in pieces:
                doc_id, ids = held[p.doc]
                data = ids[4 * p.start : 4 * (p.start + p.length)]
                rows.append(
                    (doc_id, p.start, p.length, zlib.crc32(data), len(ids) // 4, base + used + p.sequence, p.offset,
                     data if keep_ids else None)
                )
            used += count
            left = {doc for doc, _, _ in waiting}
            for doc in [d for d in held if d not in left]:
                del held[doc]
            tokens = sum(n for _, _, n in waiting)
            columns = zip(*rows) if rows else [[]] * len(FIELDS)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, (_, t) in zip(columns, FIELDS)], [n for n, _ in FIELDS]
            )

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts)):
                    held[number] = (doc_id, ids + end)
                    waiting.append((number, 0, len(ids) // 4 + 1))
                    tokens += len(ids) // 4 + 1
                    number += 1
                    if tokens >= cfg.window_tokens:
                        yield flush(False)
        if waiting:
            yield flush(True)

    return run


def pack_documents(docs: DataFrame, cfg: PackingConfig = PackingConfig(), keep_ids: bool = True) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text): place, checksum and ids (little-endian uint32)."""
    task = packer(cfg, lambda: TaskContext.get().partitionId(), keep_ids)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(task, SCHEMA)


def q_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
