"""Tokens of a batch of texts under any set of single-byte separators, in numpy.

Separators are ASCII bytes, which in UTF-8 never occur inside another
character, so tokens are cut on the raw bytes of an Arrow string column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = U(0x9E3779B97F4A7C15)       # odd multipliers
_FOLD = U(0xA0761D6478BD642F)


def byte_set(chars: str | bytes) -> np.ndarray:
    """Membership table over byte values."""
    table = np.zeros(256, bool)
    table[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return table


class Tokens:
    """Maximal runs of bytes outside ``separators``: ``start``, ``end``, ``row`` of each, ``first`` of each row."""

    def __init__(self, column, separators: np.ndarray, lower: bool = False):
        data, off = C.text_buffer(column)
        self.data, self.off, self.rows = (_LOWER[data] if lower else data), off, len(off) - 1
        inside = np.zeros(len(data) + 2, bool)
        np.logical_not(separators[data], out=inside[1:-1])
        edge = inside[1:] != inside[:-1]                # edge[i]: byte i and the byte before it differ
        bound = np.zeros(len(data) + 1, bool)
        bound[off] = True                               # a row's first byte never continues the row before it
        self.start = np.flatnonzero(inside[1:] & (edge | bound))
        self.end = np.flatnonzero(inside[:-1] & (edge | bound))
        self.row = np.searchsorted(off, self.start, "right") - 1
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))
        self.outside = ~inside[1:-1]

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        """Tokens of each row."""
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each token's bytes."""
        return run_hashes(self.data, self.start, self.end)

    def row_sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a mask or number per byte over each row."""
        total = np.zeros(len(per_byte) + 1, np.int64)
        np.cumsum(per_byte, out=total[1:])
        return np.diff(total[self.off])

    def row_counts(self, per_token: np.ndarray) -> np.ndarray:
        """Number of marked tokens of each row."""
        return np.bincount(self.row[per_token], minlength=self.rows)

    def joined(self, first: np.ndarray, n: int) -> pa.Array:
        """Strings of the ``n`` tokens from each of ``first`` on, one space between them."""
        at = first[:, None] + np.arange(n)
        begin, length = self.start[at].ravel(), (self.end - self.start)[at].ravel()
        room = length + 1                               # a space before every token; the first one is cut off
        place = np.concatenate(([0], np.cumsum(room)))
        flat = np.full(int(place[-1]), 0x20, np.uint8)
        skip = np.cumsum(length) - length
        inner = np.arange(int(length.sum()))
        flat[inner + np.repeat(place[:-1] + 1 - skip, length)] = self.data[inner + np.repeat(begin - skip, length)]
        keep = np.ones(len(flat), bool)
        keep[place[:-1:n]] = False
        size = room.reshape(len(first), n).sum(axis=1) - 1 if len(first) else np.zeros(0, np.int64)
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(flat[keep])).cast(pa.string())


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; ranges ascend, don't overlap and are not empty."""
    if not len(start):
        return np.zeros(0, U)
    length = (end - start).astype(np.int32)
    flat = np.repeat((start - (np.cumsum(length) - length)).astype(np.int64), length) + np.arange(int(length.sum()))
    value = data[flat].astype(U)
    value += U(1)
    begin = np.concatenate(([0], np.cumsum(length)[:-1])).astype(np.int32)
    place = np.arange(len(flat), dtype=np.int32) - np.repeat(begin, length)
    del flat
    value *= np.cumprod(np.full(int(length.max()), _STEP, U))[place]
    return C.mix(np.add.reduceat(value, begin) + length.astype(U))


def run_of(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` hashes (``len(h) - n + 1`` of them)."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, U)
    out = np.full(size, U(n))
    for j in range(n):
        out = out * _FOLD + h[j:j + size]
    return C.mix(out)


# ---------------------------------------------------------------- a filter of fixed size

def key_filter(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bloom filter of 2^bits bits (two a key) of a long column; at most 2^bits / 64 words reach the driver."""
    low = F.lit((1 << bits) - 1)
    spots = F.array(F.shiftrightunsigned(F.col(column), 64 - bits), F.col(column).bitwiseAND(low))
    at = keys.select(F.explode(spots).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("mask"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column("word").to_numpy()] = batch.column("mask").to_numpy()
    return out.view(U)


def in_filter(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = U(len(table).bit_length() - 1 + 6)

    def hit(at):
        return (table[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1)
    return (hit(keys >> (U(64) - bits)) & hit(keys & ((U(1) << bits) - U(1)))).astype(bool)
