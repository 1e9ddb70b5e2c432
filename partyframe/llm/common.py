"""Helpers shared by the operators: checkpoint folder, blocks of rows, words and hashes in numpy.

Words are ``[^\\x20\\x09-\\x0D]+``.  In UTF-8 the six separators are single
bytes and never occur inside another character, so words can be cut on the raw
bytes of an Arrow string column, a whole batch at a time, without a Python
string per word.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

U = np.uint64
_VALUE = np.arange(1, 257, dtype=U)         # separators add nothing to a word's hash
_VALUE[list(SPACES)] = 0
_P = U(0x9E3779B97F4A7C15)      # odd multipliers of the polynomial hashes
_Q = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared checkpoint folder (never a local one)."""
    free_shuffles(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps.

    It does so once the driver's garbage collector finds their plans unused.
    Python lets go of them first; two passes are needed, as the gateway hears
    of it on its next call.  The last query's plan may stay known until the
    next query, so one that runs no job goes first.
    """
    spark.sql("SELECT 1").collect()
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def fold_of(id_col: str | Column, folds: int = 5) -> Column:
    """``crc32(id as text) mod folds``; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts (one scan of one column)."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0)


def row_struct(docs: DataFrame, *without: str) -> Column:
    """All columns but ``without`` as one struct, so that no name of theirs can clash with internal ones."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in without]
    return F.struct(*keep) if keep else F.struct(F.lit(0).alias("none"))


# ---------------------------------------------------------------- Arrow and numpy, inside tasks

def slices(batch: pa.RecordBatch | pa.Table, text: str = "text", max_bytes: int = 4 << 20) -> Iterator[pa.Table]:
    """The batch in slices of at most ``max_bytes`` of text (a longer text is a slice of its own)."""
    t = batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
    t = t.combine_chunks()
    if t.num_rows == 0:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(t.column(text)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < t.num_rows:
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + max_bytes, "right")))
        yield t.slice(at, to - at)
        at = to


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, row offsets); null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = (np.frombuffer(arr.buffers()[2], np.uint8)[off[0]:off[-1]] if arr.buffers()[2] is not None
            else np.zeros(0, np.uint8))
    return data, off - off[0]


class Words:
    """Words of a batch of texts: byte ranges ``start``/``end``, ``row`` of each, first word of each row."""

    def __init__(self, column, lower: bool = False):
        data, off = text_buffer(column)
        self.data = _LOWER[data] if lower else data
        self.off, self.rows = off, len(off) - 1
        n = len(data)
        space = _IS_SPACE[data]
        first = np.zeros(n + 1, bool)
        first[off] = True                       # a row's first byte never continues the word before it
        left = np.empty(n, bool)
        right = np.empty(n, bool)
        if n:
            left[0], right[-1] = True, True
            left[1:] = space[:-1]
            right[:-1] = space[1:]
            left |= first[:-1]
            right |= first[1:]
        word = ~space
        self.start = np.flatnonzero(word & left)
        self.end = np.flatnonzero(word & right) + 1
        self.row = np.searchsorted(off, self.start, "right") - 1
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))
        self.space = space

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word (polynomial over its bytes, then mixed)."""
        if not len(self):
            return np.zeros(0, U)
        n = len(self.data)
        length = (self.end - self.start).astype(np.int32)
        begin = self.start.astype(np.int32)
        place = np.zeros(n, np.int32)           # of each byte in its word, counting on through the separators
        place[begin[0]:] = np.arange(begin[0], n, dtype=np.int32) - np.repeat(begin, np.diff(begin, append=n))
        power = np.cumprod(np.full(int(place.max()) + 1, _P, U))
        value = _VALUE[self.data]
        value *= power[place]
        return mix(np.add.reduceat(value, self.start) + length.astype(U))

    def strings(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start.tolist(), self.end.tolist())]


def spelled(words: Words, which: np.ndarray, close: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of some words, each behind a space and, if ``close``, before one."""
    start, length = words.start[which], words.end[which] - words.start[which]
    off = np.concatenate(([0], np.cumsum(length + 1 + close)))
    flat = np.full(int(off[-1]), 0x20, np.uint8)
    inner = np.arange(int(length.sum()))
    skip = np.cumsum(length) - length
    flat[inner + np.repeat(off[:-1] + 1 - skip, length)] = words.data[inner + np.repeat(start - skip, length)]
    return flat, off


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def window_hash(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` word hashes (length ``len(h) - k + 1``, 0 rows if shorter)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out *= _Q[which]
        out += h[j:j + n]
    return mix(out)


def windows_in_row(row: np.ndarray, k: int) -> np.ndarray:
    """True where the window of ``k`` words that starts here lies in one row."""
    n = len(row) - k + 1
    return row[:n] == row[k - 1:] if n > 0 else np.zeros(0, bool)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def contains(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a sorted table: (is x in it, where)."""
    if not len(table):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x, at


def frame(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else
                                       (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c)
                                       for c, f in zip(columns, schema)], schema=schema)
