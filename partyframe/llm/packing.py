"""Best-fit packing of documents into sequences of a fixed length, by length patterns."""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

END_ID = 2
# Latin text, in which both libraries split words alike (tested); all other text goes through `tokenizers`
_PLAIN = re.compile("[\t\n\r\x20-\x7eªµº¿-ɏ]*")
_SPECIAL = "<|endoftext|>"


# ---------------------------------------------------------------- tokens

class Tokens:
    """Token ids of a text by the vocabulary file ``byte_bpe_50k``."""

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        import base64
        import os

        import tiktoken
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.quick = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                       special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text) and _SPECIAL not in text:
            ids = self.quick.encode_ordinary(text)
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.array([*ids, END_ID], "<u4")


def pieces(docs: DataFrame, max_len: int = 1024, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(id, piece, start, length, crc[, ids], part, rank): the texts' tokens, cut where longer than ``max_len``.

    The first piece of a long document takes what is over, the others are
    full.  ``rank`` numbers the pieces of one length within the input
    partition ``part``.
    """
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("crc", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())]
                       + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches):
        tokens, part, seen = Tokens(json_path, ranks_path), TaskContext.get().partitionId(), [0] * (max_len + 1)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids = tokens(text.as_py() or "")
                n = len(ids)
                cuts = [0, *range(n % max_len or max_len, n + 1, max_len)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, seen[b - a])
                                + ((ids[a:b].astype(np.int32),) if with_ids else ()))
                    seen[b - a] += 1
            columns = list(zip(*rows)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    ddl = ("id long, piece int, start long, length long, crc long, part int, rank long"
           + (", ids array<int>" if with_ids else ""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


# ---------------------------------------------------------------- the plan: patterns of lengths

def patterns(lengths: np.ndarray, max_len: int) -> np.ndarray:
    """All ways to fill ``max_len`` exactly with two or three of ``lengths`` (rows a >= b >= c, c = 0 for two)."""
    present = np.zeros(max_len + 1, bool)
    present[lengths] = True
    out = []
    for a in lengths[lengths < max_len]:
        b = np.arange((max_len - a + 1) // 2, min(a, max_len - a) + 1)
        c = max_len - a - b
        ok = (b > 0) & present[b] & ((c == 0) | present[c]) & (c <= b)
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros((0, 3), np.int64)


def fit(hist: np.ndarray, pats: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared distance between the patterns' lengths and ``hist``.

    Multiplicative updates: each keeps x non-negative and never raises the
    error.  Place 0 of the histogram stands for "no third piece" and has no weight.
    """
    weight = np.ones(len(hist))
    weight[0] = 0

    def used(x):
        return sum(np.bincount(pats[:, j], weights=x, minlength=len(hist)) for j in range(3)) * weight

    def gather(h):
        return sum(h[pats[:, j]] for j in range(3))

    want = gather(hist * weight)
    x = want / max(want.sum(), 1) * hist.sum() / 3
    for _ in range(steps):
        x = x * want / np.maximum(gather(used(x)), 1e-12)
    return x


def plan(hist: np.ndarray, max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, how many such sequences) that use up ``hist`` exactly.

    ``hist[n]`` is the number of pieces of length n.  Patterns of up to three
    pieces that fill a sequence are fitted to the histogram by non-negative
    least squares and rounded, passing each rounding error on to the next
    pattern; what they leave is packed best fit, longest first, on the histogram.
    """
    left = hist.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[max_len]:
        out.append(((max_len,), int(left[max_len])))
        left[max_len] = 0
    pats = patterns(np.flatnonzero(left), max_len)
    if len(pats):
        x = fit(left.astype(float), pats)
        total = np.cumsum(x)
        n = np.diff(np.floor(total + 0.5), prepend=0).astype(np.int64)
        for j in np.argsort(-n, kind="stable"):
            if n[j] <= 0:
                break
            need = np.bincount(pats[j][pats[j] > 0], minlength=max_len + 1)
            some = need > 0
            k = int(min(n[j], (left[some] // need[some]).min()))        # never more than there are
            if k > 0:
                left -= k * need
                out.append((tuple(int(v) for v in pats[j] if v), k))
    return out + best_fit(left, max_len)


def best_fit(hist: np.ndarray, max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: equal bins are filled together."""
    bins: dict[int, list[list]] = {}            # space left -> [[pieces, bins], ...]
    spaces: list[int] = []                      # its keys, in order

    def put(space: int, got: tuple[int, ...], n: int) -> None:
        if space not in bins:
            bins[space] = []
            bisect.insort(spaces, space)
        bins[space].append([got, n])

    for length in range(max_len, 0, -1):
        n = int(hist[length])
        while n:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                space, got, m = max_len, (), n
            else:
                space = spaces[at]
                got, m = bins[space].pop()
                if not bins[space]:
                    del bins[space]
                    spaces.pop(at)
            each = space // length
            full = min(m, n // each)
            if full:
                put(space - each * length, got + (length,) * each, full)
                n -= full * each
            rest = m - full
            if rest and n and n < each:
                put(space - n * length, got + (length,) * n, 1)
                n, rest = 0, rest - 1
            if rest and got:
                put(space, got, rest)
    return [(got, n) for group in bins.values() for got, n in group]


# ---------------------------------------------------------------- the operator

_RANK_BITS = 48


def pack(docs: DataFrame, max_len: int = 1024, id_col: str = "doc_id", text_col: str = "text",
         json_path: str | None = None, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most ``max_len`` tokens as the patterns allow.

    Only the histogram of piece lengths (``max_len`` numbers) and the plan
    made from it (bounded by the number of patterns) pass through the driver.
    Pieces of one length are numbered over all partitions; the plan gives each
    range of numbers its sequences and offsets.

    Returns id_col, piece, start, length, ids_crc32[, ids], sequence_id,
    offset, one row per piece.  A null text is empty: one token, the end.
    Repeated rows are packed each on their own.  An empty table gives no rows.
    """
    made = C.checkpointed(pieces(docs, max_len, id_col, text_col, with_ids, json_path, ranks_path))
    counts = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    hist = np.zeros(max_len + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():      # at most max_len rows
        hist[r["length"]] = r["n"]
    ranges, sequence = [], 0
    used = np.zeros(max_len + 1, np.int64)
    for got, n in plan(hist, max_len):
        offset = 0
        for length in got:
            ranges.append((length, int(used[length]), sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    ranges.sort()
    lengths, lows, sequences, offsets = (np.array(c, np.int64) for c in (zip(*ranges) if ranges else [[]] * 4))
    keys = (lengths << _RANK_BITS) + lows

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << _RANK_BITS) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequences[at] + rank - lows[at]), pa.array(offsets[at])],
                names=[*batch.schema.names, "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = (made.join(starts, ["part", "length"])
              .withColumn("rank", F.col("rank") + F.col("first")).drop("first", "part"))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema)
    placed = ranked.mapInArrow(place, ddl + ", sequence_id long, offset long")
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
                         *(["ids"] if with_ids else []), "sequence_id", "offset")
