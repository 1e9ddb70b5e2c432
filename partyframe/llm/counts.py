"""Count tables that are sharded by key and joined with blocks of text.

Text stays in *blocks* (about 8 MB each).  A block asks for the counts of its
distinct keys (64-bit hashes) once, not once per occurrence: its sorted keys
are cut into ranges, one compressed row per *shard* of the key space.  The
shard sums what all blocks sent and answers each block with arrays in the same
order, so an answer carries no keys.  A key that stands in every document is
one entry per block, so no shard is hot, and shards grow in number with the
input, not in size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK_BYTES = 8 << 20
ROWS_DDL = "kind int, shard int, block int, n int, cols array<binary>"
ROWS = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int32()), ("n", pa.int32()),
                  ("cols", pa.list_(pa.binary()))])


# ---------------------------------------------------------------- packing

def pack(a: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, then zstd: small numbers and sorted keys shrink well."""
    a = np.ascontiguousarray(a)
    raw = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return a.dtype.char.encode() + pa.compress(raw, codec="zstd", asbytes=True) if len(a) else a.dtype.char.encode()


def unpack(b: bytes, n: int) -> np.ndarray:
    dtype = np.dtype(b[:1].decode())
    if n == 0:
        return np.zeros(0, dtype)
    raw = pa.decompress(b[1:], decompressed_size=n * dtype.itemsize, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T.copy().view(dtype).reshape(n)


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(b, n), dtype=np.uint64)


def cuts(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Where sorted keys pass from one shard's range to the next (``n_shards + 1`` places)."""
    bounds = [np.uint64((s << 64) // n_shards) for s in range(1, n_shards)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(bounds, np.uint64)), [len(keys)])).astype(np.int64)


# ---------------------------------------------------------------- blocks of documents

def pack_docs(docs: DataFrame, id_col: str, text_col: str, n_blocks: int, row: Column,
              cut_points: list[tuple[int, int]] | None = None) -> DataFrame:
    """(block, docs): the documents of each block, in compressed runs, ready for ``groupBy("block")``.

    ``row`` travels along.  A block is a function of the row alone, so that
    every pass agrees on it: a hash of id and text, or, with ``cut_points``
    (n_blocks - 1 pairs of id and crc32 of the text, see
    :func:`.sharding.cut_points`), a range of them.
    """
    text = F.col(text_col)
    cols = [F.col(id_col).cast("long").alias("id"), text.alias("text"), row.alias("row"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("crc")]
    if cut_points is None:
        cols.append(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(n_blocks)).cast("int").alias("block"))
    bounds = None if cut_points is None else place_key(np.array([p[0] for p in cut_points], np.int64),
                                                       np.array([p[1] for p in cut_points], np.int64))

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for batch in batches:
            for t in C.slices(batch, max_bytes=32 << 20):
                if bounds is None:
                    block = t.column("block").to_numpy()
                else:
                    block = np.searchsorted(bounds, place_key(ids(t), t.column("crc").to_numpy()), "right")
                order = np.argsort(block, kind="stable")
                t, block = t.select(["id", "crc", "text", "row"]).take(pa.array(order)), block[order]
                first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
                for a, b in zip(first, np.append(first[1:], len(block))):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, t.schema, options=options) as w:
                        w.write_table(t.slice(a, b - a).combine_chunks())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block[a]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                        names=["block", "docs"])

    return docs.select(*cols).mapInArrow(run, "block int, docs binary")


def ids(t: pa.Table) -> np.ndarray:
    """Ids with null below every number."""
    return t.column("id").fill_null(NULL_ID).to_numpy()


NULL_ID = int(np.iinfo(np.int64).min)


def place_key(i: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Fixed-width bytes that sort as (id, crc)."""
    out = np.empty((len(i), 12), np.uint8)
    out[:, :8] = (i.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8:] = crc.astype(">u4").view(np.uint8).reshape(-1, 4)
    return np.ascontiguousarray(out).view("S12").reshape(-1)


def unpack_docs(packed: pa.Table) -> pa.Table:
    """(id, crc, text, row) of one block, in order of (id, crc, text), null ids first."""
    t = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in packed.column("docs").to_pylist()])
    keys = t.select(["crc", "text"]).append_column("id", pa.array(ids(t)))
    return t.take(pc.sort_indices(keys, [("id", "ascending"), ("crc", "ascending"), ("text", "ascending")],
                                  null_placement="at_start"))


# ---------------------------------------------------------------- questions and answers

def ask(kind: int, block: int, keys: np.ndarray, n_shards: int, *cols: np.ndarray) -> pa.Table:
    """The block's sorted distinct keys and their columns, one row per shard."""
    at = cuts(keys, n_shards)
    rows = [(s, a, b) for s, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
    return pa.Table.from_arrays(
        [pa.array([kind] * len(rows), pa.int32()), pa.array([s for s, _, _ in rows], pa.int32()),
         pa.array([block] * len(rows), pa.int32()), pa.array([b - a for _, a, b in rows], pa.int32()),
         pa.array([[pack_keys(keys[a:b])] + [pack(c[a:b]) for c in cols] for _, a, b in rows],
                  pa.list_(pa.binary()))], schema=ROWS)


def answer(asked: DataFrame, reply: Callable[[int, np.ndarray, list[np.ndarray]], list[np.ndarray]],
           stats: Callable[[int, np.ndarray, list[np.ndarray]], np.ndarray] | None = None,
           check: bool = False) -> DataFrame:
    """Sum the columns of each key over all blocks and send every block its part.

    ``reply(kind, keys, sums)`` gives the columns to send, one value per key.
    After them comes a column that is 1 for the first block of a key and 0 for
    the others, by which exactly one block speaks for a key.  ``stats``, if
    given, returns an int64 array for the whole shard, sent as block -1.  With
    ``check`` the only column is not summed: it holds further bits of the key,
    and a block in which they differ counts as the first of its key.
    """

    def one(t: pa.Table) -> pa.Table:
        kind, shard = t.column("kind")[0].as_py(), t.column("shard")[0].as_py()
        t = t.sort_by("block")
        sizes = t.column("n").to_numpy()
        got = t.column("cols").to_pylist()
        keys = np.concatenate([unpack_keys(c[0], n) for c, n in zip(got, sizes)])
        distinct, first, at = np.unique(keys, return_index=True, return_inverse=True)
        sums = []
        own = np.zeros(len(keys), np.uint8)
        own[first] = 1
        if check:
            bits = np.concatenate([unpack(c[1], n) for c, n in zip(got, sizes)])
            own[bits != bits[first][at]] = 1
        for j in range(1, 1 if check else len(got[0])):
            col = np.concatenate([unpack(c[j], n) for c, n in zip(got, sizes)])
            total = np.bincount(at, weights=col, minlength=len(distinct))
            sums.append(total if col.dtype.kind == "f" else total.astype(np.int64))     # exact below 2^53
        del got
        out = reply(kind, distinct, sums)
        ends = np.cumsum(sizes)
        rows = [[pack(c[at[b - n:b]]) for c in out] + [pack(own[b - n:b])] for b, n in zip(ends, sizes)]
        blocks = t.column("block").to_pylist()
        if stats is not None:
            s = stats(kind, distinct, sums)
            rows.append([pack(s)])
            blocks.append(-1)
            sizes = np.append(sizes, len(s))
        return pa.Table.from_arrays(
            [pa.array([kind] * len(rows), pa.int32()), pa.array([shard] * len(rows), pa.int32()),
             pa.array(blocks, pa.int32()), pa.array(sizes, pa.int32()), pa.array(rows, pa.list_(pa.binary()))],
            schema=ROWS)

    return asked.groupBy("kind", "shard").applyInArrow(one, ROWS_DDL)


def answers(t: pa.Table, kind: int) -> list[np.ndarray]:
    """Columns of one kind that a block got back, in the order of its sorted keys."""
    rows = sorted((s, n, c) for k, s, n, c in zip(*(t.column(x).to_pylist() for x in ("kind", "shard", "n", "cols")))
                  if k == kind)
    if not rows:
        return []
    return [np.concatenate([unpack(c[j], n) for _, n, c in rows]) for j in range(len(rows[0][2]))]


def collect_stats(answered: DataFrame) -> dict[int, np.ndarray]:
    """Sum of the shards' statistics by kind (a few numbers per shard, summed before they reach the driver)."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, n, c in zip(*(b.column(x).to_pylist() for x in ("kind", "n", "cols"))):
                s = unpack(c[0], n)
                total[k] = total.get(k, 0) + s
        for k, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(s), pa.int32()), pa.array(range(len(s)), pa.int32()),
                                              pa.array(s, pa.int64())], names=["kind", "place", "value"])
    rows = (answered.filter("block = -1").select("kind", "n", "cols").mapInArrow(run, "kind int, place int, value long")
            .groupBy("kind", "place").agg(F.sum("value").alias("value")).collect())
    out: dict[int, np.ndarray] = {}
    for k in {r["kind"] for r in rows}:
        mine = sorted((r["place"], r["value"]) for r in rows if r["kind"] == k)
        out[k] = np.array([v for _, v in mine], np.int64)
    C.free_shuffles(answered.sparkSession)
    return out


def plan_sizes(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES,
               shard_bytes: int = 12 << 20) -> tuple[int, int]:
    """(blocks, shards), both in proportion to the text."""
    size = C.text_bytes(docs, text_col)
    return max(1, math.ceil(size / block_bytes)), max(1, math.ceil(size / shard_bytes))


# ---------------------------------------------------------------- word pairs of a block

END = C.mix(np.array([1], np.uint64))[0]        # one end token per document
START = C.mix(np.array([2], np.uint64))[0]      # the context of its first token


class Pairs:
    """Tokens of a block: distinct words and distinct (previous, token) pairs, by index.

    ``words`` are sorted hashes with START among them; ``first``/``second`` are
    indexes into them for each distinct pair, ``pair`` the pair's key (sorted).
    ``of`` gives for each token its pair, ``row`` its document.
    """

    def __init__(self, docs: pa.Table, lower: bool, slice_bytes: int = 4 << 20):
        n_docs = docs.num_rows
        hashes, rows, done = [], [], 0
        for t in C.slices(docs, max_bytes=slice_bytes):
            w = C.Words(t.column("text"), lower)
            # the row's end after its words, and the start before them, in one sequence
            at = np.arange(len(w)) + 2 * w.row + 1
            seq = np.empty(len(w) + 2 * w.rows, np.uint64)
            seq[at] = w.hashes()
            lead = w.first[:-1] + 2 * np.arange(w.rows)
            seq[lead] = START
            seq[w.first[1:] + 2 * np.arange(w.rows) + 1] = END
            hashes.append(seq)
            rows.append(np.repeat(np.arange(w.rows, dtype=np.int32) + np.int32(done), w.counts + 2))
            done += w.rows
        seq = np.concatenate(hashes)
        row = np.concatenate(rows)
        del hashes, rows
        self.words, at = np.unique(seq, return_inverse=True)
        del seq
        at = at.astype(np.int32)
        token = row[1:] == row[:-1]                 # (START, w1), (w1, w2), ..., (wn, END)
        a, b = at[:-1][token], at[1:][token]
        self.row = row[1:][token]
        local = a.astype(np.int64) * len(self.words) + b
        local, of = np.unique(local, return_inverse=True)
        first, second = local // len(self.words), local % len(self.words)
        key = C.mix(self.words[first] * np.uint64(0xA0761D6478BD642F) + C.mix(self.words[second]))
        order = np.argsort(key, kind="stable")
        self.pair, self.first, self.second = key[order], first[order].astype(np.int32), second[order].astype(np.int32)
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        self.of = back[of]
        self.n_docs = n_docs

    @property
    def token(self) -> np.ndarray:
        """Index of each token in ``words``."""
        return self.second[self.of]

    def counts(self, take: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens per word, occurrences per word as a context, per pair) in the documents ``take`` marks."""
        of = self.of[take[self.row]]
        pair = np.bincount(of, minlength=len(self.pair))
        word = np.bincount(self.second, weights=pair, minlength=len(self.words)).astype(np.int64)
        context = np.bincount(self.first, weights=pair, minlength=len(self.words)).astype(np.int64)
        return word.astype(np.int32), context.astype(np.int32), pair.astype(np.int32)
