"""Texts to fixed-size vectors.

An encoder has ``encoder_id``, ``dim`` and ``encode(df, text_col, out_col)``,
which adds an ``array<float>`` column, on batches and on streams.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelway.functions.vectors import PACKED, binary_parts, entries, packed

class HashedTfIdf:
    """Hashed token counts times inverse document frequency, unit length.

    A token's slot is its MD5 modulo the size, so any engine finds the same. The
    fitted state is one weight per slot. ``encode_sparse`` gives what a
    text holds (``struct<indices:array<int>,values:array<float>>``), ``encode_packed`` the same as bytes
    (see ``linear.pack_sparse``), ``encode`` the whole vector.

    Instead of cleaned text all take a column of ``slot_counts`` or ``packed_counts``, of the same size. Texts
    that are both fitted on and encoded are best counted once, in a staged table; packed counts pass
    between Spark and Python as they are, an array goes element by element.
    """

    def __init__(self, weights: list[float]):
        self.weights = [float(w) for w in weights]
        self.dim = len(self.weights)
        digest = hashlib.md5(np.asarray(self.weights, dtype="<f8").tobytes()).hexdigest()
        self.encoder_id = f"hashed-tfidf-{self.dim}-{digest[:8]}"

    @staticmethod
    def slot_counts(text: Column, dim: int) -> Column:
        """Sorted ``(slot, n)`` structs: the tokens of a cleaned text in each slot; null for null."""

        @F.arrow_udf("array<struct<slot:int,n:int>>")
        def count(texts: pa.Array) -> pa.Array:
            parts = [_slot_counts(part, dim) for part in _slices(texts)]
            return pa.concat_arrays(parts) if parts else pa.array([], _COUNTS)

        return count(text)

    @staticmethod
    def packed_counts(text: Column, dim: int) -> Column:
        """``slot_counts`` as bytes: slots and numbers of 4 bytes each."""

        @F.arrow_udf(PACKED)
        def count(texts: pa.Array) -> pa.Array:
            parts = [_packed_counts(part, dim) for part in _slices(texts)]
            return pa.concat_arrays(parts) if parts else _packed_counts(texts, dim)

        return count(text)

    @classmethod
    def fit(cls, df: DataFrame, text_col: str, dim: int = 1024) -> "HashedTfIdf":
        """``text_col`` holds cleaned text. Weights are ``ln((texts + 1) / (texts with the slot + 1))``."""
        counts = df.select(cls._counted(df, text_col, dim).alias("s"))

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(dim + 1, np.int64)  # the number of texts comes last, as slot -1
            for batch in batches:
                n[:-1] += np.bincount(_pairs(batch.column(0))[2], minlength=dim)
                n[-1] += batch.num_rows
            slots = pa.array(np.r_[0:dim, -1].astype(np.int32))
            yield pa.RecordBatch.from_arrays([slots, pa.array(n)], ["slot", "n"])

        found = counts.mapInArrow(tally, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        texts = {r["slot"]: r["n"] for r in found.collect()}
        return cls([math.log((texts.get(-1, 0) + 1) / (texts.get(i, 0) + 1)) for i in range(dim)])

    @classmethod
    def _counted(cls, df: DataFrame, text_col: str, dim: int) -> Column:
        return F.col(text_col) if cls.is_counted(df, text_col) else cls.packed_counts(F.col(text_col), dim)

    @staticmethod
    def is_counted(df: DataFrame, text_col: str) -> bool:
        return isinstance(df.schema[text_col].dataType, (T.ArrayType, T.StructType))

    def encode_sparse(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        weights = np.asarray(self.weights)

        @F.arrow_udf("struct<indices:array<int>,values:array<float>>")
        def unit(counts: pa.Array) -> pa.Array:
            valid, row, slot, value = _unit(counts, weights)
            ends = pa.array(np.searchsorted(row, np.arange(len(counts) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (slot, value)]
            return pa.StructArray.from_arrays(lists, names=["indices", "values"], mask=pa.array(~valid))

        return df.withColumn(out_col, unit(self._counted(df, text_col, self.dim)))

    def encode_packed(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        weights = np.asarray(self.weights)

        @F.arrow_udf(PACKED)
        def unit(counts: pa.Array) -> pa.Array:
            valid, row, slot, value = _unit(counts, weights)
            return packed(slot, value, np.bincount(row, minlength=len(counts)), valid)

        return df.withColumn(out_col, unit(self._counted(df, text_col, self.dim)))

    def encode(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        weights, dim = np.asarray(self.weights), self.dim
        most = max(1, DENSE_VALUES // dim)

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                for counts in (batch.slice(at, most) for at in range(0, max(len(batch), 1), most)):
                    valid, row, slot, value = _unit(counts, weights)
                    place = np.cumsum(valid) - 1
                    dense = np.zeros((int(valid.sum()), dim), np.float32)
                    dense[place[row], slot] = value
                    ends = pa.array(np.r_[0, np.cumsum(valid * dim)].astype(np.int32))
                    yield pa.ListArray.from_arrays(ends, pa.array(dense.reshape(-1)), mask=pa.array(~valid))

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return df.withColumn(out_col, F.arrow_udf(run, "array<float>")(self._counted(df, text_col, self.dim)))


_COUNTS = pa.list_(pa.struct([("slot", pa.int32()), ("n", pa.int32())]))

# Bytes of text whose tokens, and values of whole vectors that are in memory at one time.
SLICE_BYTES = 8 << 20
DENSE_VALUES = 4 << 20


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about ``SLICE_BYTES``; a longer text is alone."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64))
    at = 0
    while at < len(texts):
        limit = SLICE_BYTES + (ends[at - 1] if at else 0)
        end = max(at + 1, int(np.searchsorted(ends, limit, "right")))
        yield texts.slice(at, end - at)
        at = end


def _counted_slots(texts: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and number of each count. Each different token is hashed once."""
    words = pc.split_pattern(texts, " ")
    lengths = np.asarray(words.value_lengths().fill_null(0), np.int64)
    coded = words.flatten().dictionary_encode()
    slots = _slots(coded.dictionary, dim)
    codes = np.asarray(coded.indices)
    row = np.repeat(np.arange(len(texts)), lengths)
    solid = slots[codes] >= 0
    if not solid.all():
        codes, row = codes[solid], row[solid]
    keys, n = np.unique(row * dim + slots[codes], return_counts=True)
    return keys // dim, keys % dim, n


def _slots(tokens: pa.Array, dim: int) -> np.ndarray:
    """MD5 modulo ``dim`` of each token; -1 for the empty one."""
    ends, flat = binary_parts(tokens)
    flat, at, md5 = flat.tobytes(), ends.tolist(), hashlib.md5
    heads = b"".join([md5(flat[lo:hi]).digest()[:4] for lo, hi in zip(at, at[1:])])
    return np.where(np.diff(ends) > 0, np.frombuffer(heads, ">u4").astype(np.int64) % dim, -1)


def _slot_counts(texts: pa.Array, dim: int) -> pa.Array:
    row, slot, n = _counted_slots(texts, dim)
    ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n.astype(np.int32))], names=["slot", "n"])
    return pa.ListArray.from_arrays(pa.array(ends), pairs, mask=texts.is_null())


def _packed_counts(texts: pa.Array, dim: int) -> pa.Array:
    row, slot, n = _counted_slots(texts, dim)
    lengths = np.bincount(row, minlength=len(texts))
    return packed(slot.astype("<i4"), n.astype("<i4"), lengths, np.asarray(texts.is_valid()))


def _pairs(counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which counts are not null; row, slot and number of each entry."""
    if pa.types.is_struct(counts.type):
        ends, slot, n = entries(counts, "<i4")
        lengths = np.diff(ends)
    else:
        lengths = np.asarray(counts.value_lengths().fill_null(0), np.int64)
        slot, n = (np.asarray(x) for x in counts.flatten().flatten())
    return np.asarray(counts.is_valid()), np.repeat(np.arange(len(counts)), lengths), slot, n


def _unit(counts: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which counts are not null; row, slot and value of each entry other than 0."""
    valid, row, slot, n = _pairs(counts)
    value = n * weights[slot]
    some = value != 0
    value, row, slot = value[some], row[some], slot[some]
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(counts)))
    return valid, row, slot.astype(np.int32), (value / norm[row]).astype(np.float32)


_loaded: dict[str, Callable] = {}


class PluginEncoder:
    """A user's model. ``load()`` runs once per Python worker and returns a
    function from a list of texts to a float array [n, dim]."""

    def __init__(self, encoder_id: str, dim: int, load: Callable[[], Callable], batch_size: int = 128):
        self.encoder_id, self.dim, self.load, self.batch_size = encoder_id, dim, load, batch_size

    def encode(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        encoder_id, dim, load, size = self.encoder_id, self.dim, self.load, self.batch_size

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            if encoder_id not in _loaded:
                _loaded[encoder_id] = load()
            model = _loaded[encoder_id]
            for texts in batches:
                texts = texts.fill_null(" ").to_pylist()
                parts = [
                    np.asarray(model(texts[i : i + size]), dtype=np.float32)
                    for i in range(0, len(texts), size)
                ]
                flat = np.concatenate(parts).reshape(-1) if parts else np.zeros(0, np.float32)
                offsets = np.arange(0, len(flat) + 1, dim, dtype=np.int32)
                yield pa.ListArray.from_arrays(offsets, flat)

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return df.withColumn(out_col, F.arrow_udf(run, "array<float>")(F.col(text_col)))
