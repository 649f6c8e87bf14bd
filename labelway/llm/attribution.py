"""Token counts of sections: whole documents are encoded once, tokens carry offsets.

A token covers the characters that its bytes touch. Token spans are joined to
section spans by interval: a token belongs to the section that holds most of its
characters, to the earlier one on a tie, and to no section (number -1) if it
touches none. So counts of a document's sections add up to its tokens.

Defined cases: a null or empty text has the one empty section and no token.
Sections must be in order and disjoint; repeated rows are counted each.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelway.llm.common import packed, table

PRETOKENS = regex.compile(public_tokenizers.PATTERN)
CACHE = 500_000
_encoders: dict[str, OffsetEncoder] = {}


@dataclass(frozen=True)
class AttributionConfig:
    ranks: str = public_tokenizers.path("byte_bpe_50k.tiktoken")


class OffsetEncoder:
    """Character spans of the tokens of whole texts; pretokens are encoded once per worker."""

    def __init__(self, path: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.library = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.sizes = {i: len(token) for token, i in ranks.items()}
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> OffsetEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def learn(self, part: str) -> bytes:
        """Start and end of each token of a pretoken, relative to it."""
        sizes = list(map(self.sizes.__getitem__, self.library.encode_ordinary(part)))
        ends = list(accumulate(sizes))
        starts = [0, *ends[:-1]]
        if not part.isascii():
            owner = [i for i, c in enumerate(part) for _ in c.encode("utf-8", "surrogatepass")]
            starts, ends = [owner[x] for x in starts], [owner[x - 1] + 1 for x in ends]
        if len(self.known) > CACHE:
            self.known.clear()
        both = [x for pair in zip(starts, ends) for x in pair]
        self.known[part] = spans = struct.pack(f"<{len(both)}i", *both)
        return spans

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last character of each token."""
        parts = PRETOKENS.findall(text)
        found = list(map(self.known.get, parts))
        if None in found:
            found = [self.learn(p) if x is None else x for p, x in zip(parts, found)]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        tokens = np.fromiter(map(len, found), np.int64, len(parts)) // 8
        both = np.frombuffer(b"".join(found), np.int32).reshape(-1, 2) + np.repeat(np.cumsum(sizes) - sizes, tokens)[:, None]
        return both[:, 0], both[:, 1]


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their line break."""
    cuts = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10) + 1
    starts = np.r_[0, cuts]
    ends = np.r_[cuts, len(text)]
    if len(starts) > 1 and starts[-1] == len(text):
        starts, ends = starts[:-1], ends[:-1]
    return starts, ends


def assign(
    token_start: np.ndarray, token_end: np.ndarray, start: np.ndarray, end: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none), and whether it touches anything else."""
    n = len(start)
    if not n or not len(token_start):
        return np.full(len(token_start), -1), np.zeros(len(token_start), bool)
    first = np.searchsorted(end, token_start, side="right")  # first section that ends after the token's start
    last = np.searchsorted(start, token_end, side="left") - 1  # last section that begins before its end
    best, most = np.full(len(token_start), -1), np.zeros(len(token_start), np.int64)
    step = 0
    while True:  # as many rounds as the longest token touches sections
        at = first + step
        live = at <= last
        if not live.any():
            break
        k = np.minimum(at, n - 1)
        size = np.where(live, np.minimum(token_end, end[k]) - np.maximum(token_start, start[k]), 0)
        more = size > most
        best, most = np.where(more, k, best), np.where(more, size, most)
        step += 1
    return best, most < token_end - token_start


def attribute(docs: DataFrame, cfg: AttributionConfig = AttributionConfig(), sections: str | None = None) -> DataFrame:
    """``row`` with ``counts``: section, start, end, tokens, and those of them that cross its bounds.

    ``sections`` names a column of array<struct<start:bigint,end:bigint>>; without
    it, sections are lines. One map over the input, no shuffle.
    """
    bounds = F.col(sections) if sections else F.array().cast("array<struct<start:bigint,end:bigint>>")
    source = packed(docs, F.col("text").alias("text"), bounds.alias("sections"))
    own_bounds = sections is not None

    def counts(encoder: OffsetEncoder, text: str, given: list[dict] | None) -> list[dict]:
        if own_bounds:
            start = np.array([s["start"] for s in given or []], np.int64)
            end = np.array([s["end"] for s in given or []], np.int64)
        else:
            start, end = line_sections(text)
        owner, crossing = assign(*encoder.spans(text), start, end)
        total = np.bincount(owner + 1, minlength=len(start) + 1)
        across = np.bincount(owner + 1, crossing, len(start) + 1).astype(np.int64)
        out = [
            {"section": i, "start": a, "end": b, "n_tokens": t, "n_crossing": c}
            for i, (a, b, t, c) in enumerate(zip(start.tolist(), end.tolist(), total[1:].tolist(), across[1:].tolist()))
        ]
        if total[0]:
            out.append({"section": -1, "start": None, "end": None, "n_tokens": int(total[0]), "n_crossing": int(across[0])})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = OffsetEncoder.of(cfg.ranks)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [
                    counts(encoder, t.as_py() or "", s.as_py()) for t, s in zip(batch.column(1), batch.column(2))
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, COUNTS)], ["row", "counts"])

    kind = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(
        run,
        f"row {kind}, counts array<struct<section:bigint,start:bigint,end:bigint,n_tokens:bigint,n_crossing:bigint>>",
    )


COUNTS = pa.list_(
    pa.struct([(n, pa.int64()) for n in ("section", "start", "end", "n_tokens", "n_crossing")])
)


def q_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = attribute(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", F.explode("counts").alias("c")).select("doc_id", "c.*")
