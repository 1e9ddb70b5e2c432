"""Ranked lexical search: documents grouped by the mask of matched terms, masks evaluated from the highest bound down."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C
from .terms import Tokens

#: Bytes between terms: all ASCII but digits and letters.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Fixed values of the score.
ONE, TF_UNIT, NORM_UNIT, BASE, SLOPE = 10**9, 1000, 12, 75, 25
NO_ID = np.iinfo(np.int64).min              # a null id sorts first


class Items(NamedTuple):
    """Some of the items: values of the id column; per item its distinct terms (indexes) and how often it holds each."""

    ids: list
    vocabulary: np.ndarray                  # sorted term hashes
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[Items]:
    """Distinct (id, text) items, as many at a time as ``block_bytes`` of text hold (a longer one is a block)."""
    ids, texts, size = [], [], 0
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropDuplicates(["id", "text"])
    for r in rows.toLocalIterator():
        n = len((r["text"] or "").encode())
        if ids and size + n > block_bytes:
            yield _items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r["id"])
        texts.append(r["text"])
        size += n
    if ids:
        yield _items(ids, texts)


def _items(ids: list, texts: list) -> Items:
    t = Tokens(pa.array(texts, pa.string()), BETWEEN, lower=True)
    vocabulary, at = np.unique(t.hashes(), return_inverse=True)
    parts = [np.unique(at[a:b], return_counts=True) for a, b in zip(t.first, t.first[1:])]
    return Items(ids, vocabulary, [p[0] for p in parts], [p[1] for p in parts])


class Corpus(NamedTuple):
    """What holds for all documents: N, L and the df of each term of a vocabulary."""

    n: int
    length: int
    df: np.ndarray

    def weights(self) -> np.ndarray:
        return np.floor(1000 * np.log((2 * self.n + 2) / (2 * self.df + 1))).astype(np.int64)

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        return BASE + (SLOPE * lengths * self.n) // max(1, self.length)


def _postings(t: Tokens, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, occurrences) of the vocabulary's terms, by term, then row."""
    found, at = C.contains(vocabulary, t.hashes())
    key, tf = np.unique(at[found] * np.int64(max(1, t.rows)) + t.row[found], return_counts=True)
    return key // max(1, t.rows), key % max(1, t.rows), tf


def count_corpus(docs: DataFrame, vocabulary: np.ndarray, text_col: str) -> Corpus:
    """N, L and df in one pass; every task sends sums only, added up by Spark."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        df, n, length = np.zeros(len(sent.value), np.int64), 0, 0
        for batch in batches:
            for s in C.slices(batch, max_bytes=2 << 20):
                t = Tokens(s.column("text"), BETWEEN, lower=True)
                term, _, _ = _postings(t, sent.value)
                df += np.bincount(term, minlength=len(df))
                n += int(np.count_nonzero(t.counts))
                length += len(t)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((seen, [-1, -2])), pa.int64()),
             pa.array(np.concatenate((df[seen], [n, length])), pa.int64())], names=["term", "n"])

    sums = (docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term long, n long")
            .groupBy("term").agg(F.sum("n").alias("n")).toArrow())
    got = dict(zip(sums.column("term").to_pylist(), sums.column("n").to_pylist()))
    n, length = got.pop(-1, 0), got.pop(-2, 0)
    df = np.zeros(len(vocabulary), np.int64)
    df[list(got)] = list(got.values())
    return Corpus(n, length, df)


# ---------------------------------------------------------------- one group of documents

class Best:
    """The k highest (score, then smaller id) of each item so far."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n

    def least(self, item: int) -> int:
        """A document below this score cannot enter."""
        s = self.score[item]
        return int(s[-1]) if len(s) == self.k else 1

    def add(self, item: int, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.least(item)
        score, ids = np.concatenate((self.score[item], score[good])), np.concatenate((self.id[item], ids[good]))
        order = np.lexsort((ids, -score))[:self.k]
        self.score[item], self.id[item] = score[order], ids[order]


def masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each document, one document of each group) for a terms x documents presence matrix.

    Bits are packed to bytes, 64 terms to a word; documents with equal words
    form a group.
    """
    packed = np.packbits(present, axis=0, bitorder="little")
    words = np.zeros((-(-len(packed) // 8) * 8, present.shape[1]), np.uint8)
    words[:len(packed)] = packed
    group = np.zeros(present.shape[1], np.int64)
    for at in range(0, len(words), 8):
        word = np.ascontiguousarray(words[at:at + 8].T).view(np.uint64).reshape(-1)
        _, of = np.unique(word, return_inverse=True)
        _, group = np.unique(group * (int(of.max()) + 1) + of, return_inverse=True)
    one = np.zeros(int(group.max()) + 1, np.int64)
    one[group] = np.arange(len(group))
    return group, one


def search_group(items: Items, weights: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray],
                 norm: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Enter a group of documents into ``best``; returns how many documents were scored.

    Per item: a mask's bound is the sum of its terms' weights times the
    highest impact each has in this group of documents.  Masks are scored from
    the highest bound down, in growing steps; those below the item's k-th
    score can hold nothing that enters.
    """
    term, doc, tf = postings
    impact = (ONE * tf) // (TF_UNIT * tf + NORM_UNIT * norm[doc])
    place = np.searchsorted(term, np.arange(len(weights) + 1))
    scored = 0
    for q, (terms, repeats) in enumerate(zip(items.terms, items.repeats)):
        terms, factor = terms[place[terms + 1] > place[terms]], (repeats * weights[terms])[place[terms + 1] > place[terms]]
        if not len(terms):
            continue
        at = np.zeros((len(terms), len(ids)), np.int64)
        for j, x in enumerate(terms):
            at[j, doc[place[x]:place[x + 1]]] = impact[place[x]:place[x + 1]]
        present = at > 0
        group, one = masks(present)
        bound = (factor * at.max(axis=1)) @ present[:, one]
        order = np.argsort(-bound, kind="stable")
        members = np.argsort(group, kind="stable")
        first = np.searchsorted(group[members], np.arange(len(one) + 1))
        done, step = 0, 8
        while done < len(order) and bound[order[done]] >= best.least(q):
            take = order[done:done + step]
            take = take[bound[take] >= best.least(q)]
            rows = np.concatenate([members[first[g]:first[g + 1]] for g in take])
            best.add(q, factor @ at[:, rows], ids[rows])
            scored += len(rows)
            done, step = done + step, step * 2
    return scored


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", block_bytes: int = 1 << 20,
           group_rows: int = 4096) -> DataFrame:
    """The ``k`` highest-scoring documents of every item.

    Terms are maximal runs of ASCII digits and letters (A-Z in lower case) and
    all characters beyond ASCII.  With N documents that hold a term, L terms
    in all, n in this document, df documents with the term and tf of it here:
    weight w = floor(1000 ln((2N+2)/(2df+1))), m = 75 + 25 n N div L, score =
    sum over the item's terms, repeats included, of
    w * (10^9 tf div (1000 tf + 12 m)).

    Items are searched in blocks of at most ``block_bytes`` of text, the only
    thing that is broadcast; each block takes two passes over the documents,
    one for N, L and df, one for the search.  In the second, groups of at most
    ``group_rows`` documents are kept as postings of the block's terms; each
    task hands on ``k`` rows an item, which are ranked once more.

    Returns item_col, rank (from 1, highest first, equal scores by ascending
    id), id_col, score; only scores above 0.  Items that repeat (id and text)
    count once; one id with several texts is ranked for each text.  Rows of
    documents that repeat are documents of their own; null texts hold no
    term; null ids sort first.  Empty tables give no rows, extra columns are
    ignored.
    """
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType
    out = T.StructType([T.StructField("item", kind), T.StructField("query", T.LongType()),
                        T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])
    found, before = [spark.createDataFrame([], out)], 0
    for block in item_blocks(items, item_col, item_text, block_bytes):
        corpus = count_corpus(docs, block.vocabulary, text_col)
        found.append(_search_block(docs, block, corpus, before, k, id_col, text_col, out, group_rows))
        before += len(block.ids)
    every = found[0]
    for f in found[1:]:
        every = every.unionAll(f)
    w = Window.partitionBy("query", "item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_first())
    ranked = every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search_block(docs: DataFrame, block: Items, corpus: Corpus, before: int, k: int, id_col: str, text_col: str,
                  out: T.StructType, group_rows: int) -> DataFrame:
    schema, weights = to_arrow_schema(out), corpus.weights()
    sent = docs.sparkSession.sparkContext.broadcast(block)
    widest = max((len(t) for t in block.terms), default=1)
    rows = int(np.clip((1 << 22) // max(1, widest), 64, group_rows))        # an item's matrix stays below 32 MB

    def run(batches):
        items = sent.value
        best, held, n_held = Best(len(items.ids), k), [], 0

        def flush():
            base = np.cumsum([0, *(len(h[0]) for h in held)])
            term = np.concatenate([h[2][0] for h in held])
            doc = np.concatenate([h[2][1] + b for h, b in zip(held, base)])
            tf = np.concatenate([h[2][2] for h in held])
            order = np.lexsort((doc, term))
            search_group(items, weights, (term[order], doc[order], tf[order]),
                         corpus.norms(np.concatenate([h[1] for h in held])), np.concatenate([h[0] for h in held]), best)

        for batch in batches:
            for s in C.slices(batch, max_bytes=2 << 20):
                for part in (s.slice(a, rows) for a in range(0, s.num_rows, rows)):
                    if held and n_held + part.num_rows > rows:
                        flush()
                        held, n_held = [], 0
                    t = Tokens(part.column("text"), BETWEEN, lower=True)
                    held.append((part.column("id").fill_null(NO_ID).to_numpy(), t.counts, _postings(t, items.vocabulary)))
                    n_held += part.num_rows
        if held:
            flush()
        q = np.repeat(np.arange(len(items.ids)), [len(x) for x in best.score])
        ids = np.concatenate(best.id) if best.id else np.zeros(0, np.int64)
        score = np.concatenate(best.score) if best.score else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([items.ids[x] for x in q], schema.field("item").type), pa.array(q + before, pa.int64()),
             pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(score, pa.int64())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out)
