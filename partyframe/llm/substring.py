"""Exact removal of repeated passages, found through difference-cover anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C
from . import counts as K
from .sharding import cut_points

# A perfect difference set: every residue modulo 13 is a difference of two of its members.
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR, PLACE = 0, 1
RESULT = ("n_words", "n_removed", "changed")
SLICE = 1 << 20             # bytes of text that are cut into words at a time


def _anchors(words: C.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each anchor window, its hash), at cover positions of each row only."""
    h = words.hashes()
    ok = C.windows_in_row(words.row, width)
    place = np.arange(len(ok)) - words.first[words.row[:len(ok)]]
    at = np.flatnonzero(ok & np.isin(place % PERIOD, COVER))
    return at, C.window_hash(h, width)[at]


def _candidates(words: C.Words, window: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows that hold a shared anchor."""
    at, h = _anchors(words, window - PERIOD + 1)
    at = at[C.contains(shared, h)[0]]
    ok = C.windows_in_row(words.row, window)
    edge = np.zeros(len(words) + 1, np.int64)       # an anchor is held by the windows from PERIOD - 1 words before it
    np.add.at(edge, np.maximum(at - PERIOD + 1, words.first[words.row[at]]), 1)
    np.add.at(edge, at + 1, -1)
    pick = np.flatnonzero(ok & (np.cumsum(edge)[:len(ok)] > 0))
    return pick, C.window_hash(words.hashes(), window)[pick] if len(pick) else np.zeros(0, np.uint64)


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = 4 << 20, as_is: bool = False) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts earlier.

    Earlier: a smaller id, or the same row at an earlier start (null ids come
    first; rows that share an id go by the crc32 of their text, then the text).
    Any two equal runs of ``window`` words share an anchor: at some offset
    below ``PERIOD`` both places fall on cover positions, and the anchor window
    of ``window - PERIOD + 1`` words from there lies inside both.

    Blocks of text are ranges of that order, cut at equal bytes.

    1. Each block asks which of its anchors occur twice (:mod:`.counts`).
    2. The windows around those are the candidates.  Each block asks, once per
       distinct window, whether an earlier block has it (64-bit key and 16
       check bits).
    3. Each block marks the covered words: windows that an earlier block has,
       and all but the first of those that it has twice.

    A passage that a third of all rows share is one entry per block, and no
    pairs are made.

    Returns the input columns with the text replaced by the kept words joined
    by one space (null text: empty; with ``as_is``, texts that lose nothing
    stay as they are), and n_words, n_removed, changed; input
    columns of these three names are replaced.  Texts of fewer than ``window``
    words lose nothing.  An empty table gives no rows.
    """
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD} words")
    n_blocks, n_shards = K.plan_sizes(docs, text_col, block_bytes)
    points = cut_points(docs, n_blocks, id_col, text_col) if n_blocks > 1 else []
    carried = [c for c in docs.columns if c != text_col and c not in RESULT]
    row = C.row_struct(docs, text_col, *RESULT)
    out_type = T.StructType([T.StructField("row", docs.select(row.alias("row")).schema["row"].dataType),
                             T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()),
                             T.StructField("n_removed", T.LongType()), T.StructField("changed", T.BooleanType())])
    # one exchange of the texts, read by all three passes
    blocks = K.pack_docs(docs, id_col, text_col, n_blocks, row, points).groupBy("block")

    def ask_anchors(left: pa.Table) -> pa.Table:
        got = [_anchors(C.Words(t.column("text")), window - PERIOD + 1)[1] for t in C.slices(K.unpack_docs(left), max_bytes=SLICE)]
        keys, n = np.unique(np.concatenate(got), return_counts=True)
        return K.ask(ANCHOR, left.column("block")[0].as_py(), keys, n_shards, np.minimum(n, 2).astype(np.uint8))

    def twice(kind, keys, sums):
        return [(sums[0] > 1).astype(np.uint8)]

    def shared_anchors(t: pa.Table, right: pa.Table) -> np.ndarray:
        got = K.answers(right, ANCHOR)
        if not got:
            return np.zeros(0, np.uint64)
        keys = np.unique(np.concatenate([_anchors(C.Words(s.column("text")), window - PERIOD + 1)[1]
                                         for s in C.slices(t, max_bytes=SLICE)]))
        return keys[got[0] == 1]

    def ask_places(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return K.ROWS.empty_table()
        t = K.unpack_docs(left)
        shared = shared_anchors(t, right)
        keys, bits = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
        for s in C.slices(t, max_bytes=SLICE):
            words = C.Words(s.column("text"))
            pick, h = _candidates(words, window, shared)
            if len(pick):
                keys.append(h)
                bits.append(C.window_hash(words.hashes(), window, 1)[pick].astype(np.uint16))
        distinct, first = np.unique(np.concatenate(keys), return_index=True)
        return K.ask(PLACE, left.column("block")[0].as_py(), distinct, n_shards, np.concatenate(bits)[first])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return to_arrow_schema(out_type).empty_table()
        t = K.unpack_docs(left)
        shared = shared_anchors(t, right)
        keep = [(s, C.Words(s.column("text"))) for s in C.slices(t, max_bytes=SLICE)]
        found = [_candidates(w, window, shared) for _, w in keep]
        h = np.concatenate([x[1] for x in found])
        distinct, first, at = np.unique(h, return_index=True, return_inverse=True)
        got = K.answers(right, PLACE)
        again = np.ones(len(h), bool)               # later places of a window inside the block
        again[first] = False
        if got:
            again |= got[0][at] == 0                # an earlier block has it
        parts, done = [], 0
        for (s, words), (pick, _) in zip(keep, found):
            here = pick[again[done:done + len(pick)]]
            done += len(pick)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, here, 1)
            np.add.at(edge, here + window, -1)
            gone = np.cumsum(edge)[:len(words)] > 0
            removed = np.bincount(words.row[gone], minlength=words.rows)
            kept = _joined(words, ~gone)
            if as_is:
                kept = pc.if_else(pa.array(removed > 0), kept, s.column("text").combine_chunks())
            parts.append(pa.table([s.column("row"), kept, pa.array(words.counts, pa.int64()),
                                   pa.array(removed, pa.int64()), pa.array(removed > 0)],
                                  names=["row", "text", *RESULT]))
        return pa.concat_tables(parts)

    anchors = K.answer(blocks.applyInArrow(ask_anchors, K.ROWS_DDL), twice)
    places = K.answer(blocks.cogroup(anchors.groupBy("block")).applyInArrow(ask_places, K.ROWS_DDL),
                      lambda kind, keys, sums: [], check=True)
    done = blocks.cogroup(anchors.unionByName(places).groupBy("block")).applyInArrow(
        cut, out_type)
    return done.select(*[F.col("row").getField(c).alias(c) for c in carried], F.col("text").alias(text_col), *RESULT)


def _joined(words: C.Words, keep: np.ndarray) -> pa.Array:
    """Kept words of each row, joined by one space."""
    at = np.flatnonzero(keep)
    rows = words.row[at]
    length = words.end[at] - words.start[at]
    lead = np.ones(len(at), np.int64)               # a space before each word but a row's first
    if len(at):
        lead[np.concatenate(([True], rows[1:] != rows[:-1]))] = 0
    size = np.bincount(rows, weights=length + lead, minlength=words.rows).astype(np.int64)
    off = np.concatenate(([0], np.cumsum(size)))
    out = np.full(int(off[-1]), 0x20, np.uint8)
    if len(at):
        to = np.cumsum(length + lead) - length
        src = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) \
            + np.repeat(words.start[at], length)
        out[src + np.repeat(to - words.start[at], length)] = words.data[src]
    arr = pa.LargeStringArray.from_buffers(words.rows, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(out))
    return arr.cast(pa.string())
