"""Katz backoff scoring of whole texts by a bigram model with Good-Turing discounts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import counts as K

WORD, PAIR, BACK = 0, 1, 2
TOP = 5                     # counts above this are trusted as they are (Katz's k)


def discounts(n: np.ndarray, top: int = TOP) -> np.ndarray:
    """Katz's discount factor for counts 0..top+1 (index = count; the last stands for all above ``top``).

    ``n[r]`` is the number of types seen r times.  Where the counts of counts
    give no factor in (0, 1], the count is left as it is.
    """
    d = np.ones(top + 2)
    if n[1] <= 0:
        return d
    tail = (top + 1) * n[top + 1] / n[1]
    for r in range(1, top + 1):
        if n[r] > 0 and tail < 1:
            x = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
            if 0 < x <= 1:
                d[r] = x
    return d


class Model:
    """The few numbers that hold for all tokens: N, V and the discounts of both orders."""

    def __init__(self, word_stats: np.ndarray, pair_stats: np.ndarray):
        self.types, self.tokens = int(word_stats[0]), int(word_stats[1])
        n1, n2 = word_stats[2:], pair_stats[2:]
        self.d_word, self.d_pair = discounts(n1), discounts(n2)
        kept = self.tokens - sum(r * int(n1[r]) * (1 - self.d_word[r]) for r in range(1, TOP + 1))
        # what the discounts free goes to the one class of unknown words; never nothing
        free = max(1 - kept / self.tokens, 0.5 / (self.tokens + 1)) if self.tokens else 1.0
        self.unknown, self.share = free, (1 - free) / kept if kept else 0.0

    def p_word(self, c: np.ndarray) -> np.ndarray:
        """p(w) by its count; all unknown words are one class."""
        return np.where(c > 0, c * self.d_word[np.minimum(c, TOP + 1)] * self.share, self.unknown)

    def p_pair(self, c: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Discounted p(w|v) of pairs that were seen."""
        return c * self.d_pair[np.minimum(c, TOP + 1)] / np.maximum(context, 1)


def backoff(context: np.ndarray, seen: np.ndarray, seen_below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale of the seen pairs, weight of p(w)) per context, so that its probabilities sum to exactly 1.

    ``seen``: sum of the discounted p(w|v); ``seen_below``: sum of p(w) over
    the same words.  A context whose counts are all above ``TOP`` frees
    nothing; then as much is freed as one more, unseen, occurrence would take.
    """
    most = 1 - 1 / (context + 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(seen > most, most / seen, 1.0)
        weight = (1 - scale * seen) / np.maximum(1 - seen_below, 1e-300)
    none = seen <= 0
    return np.where(none, 1.0, scale), np.where(none, 1.0, weight)


def katz_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = 16 << 20) -> DataFrame:
    """Base-10 log probability of every text under a Katz bigram model of the rows ``train`` marks.

    Tokens are the words (A-Z in lower case) and one end; the first token's
    context is a start mark.  p(w|v) is the Good-Turing discounted share where
    (v, w) was seen, else the backoff weight of v times p(w); p(w) is the
    discounted unigram, in which all unknown words share one class.  Weights
    are normalised exactly for every context.

    Counts of words and pairs live in tables sharded by key (see
    :mod:`.counts`); each block of text asks once for each distinct key, and
    one block per seen pair adds it to its context's backoff sums.  Only counts
    of counts reach the driver.

    Returns id_col, train, n_tokens, n_known, train_tokens, base_score, score:
    one row per input row.  Null texts are empty (one token, the end); a null
    ``train`` counts as false.  With no training rows every token is unknown.
    ``base_score`` is the add-half unigram of the same counts.
    """
    n_blocks, n_shards = K.plan_sizes(docs, text_col, block_bytes)
    packed = K.pack_docs(docs, id_col, text_col, n_blocks, F.coalesce(train, F.lit(False))).groupBy("block")

    def flags(t: pa.Table) -> np.ndarray:
        return t.column("row").to_numpy(zero_copy_only=False).astype(bool)

    def ask(left: pa.Table) -> pa.Table:
        t = K.unpack_docs(left)
        p = K.Pairs(t, lower=True)
        word, context, pair = p.counts(flags(t))
        block = left.column("block")[0].as_py()
        return pa.concat_tables([K.ask(WORD, block, p.words, n_shards, word, context),
                                 K.ask(PAIR, block, p.pair, n_shards, pair)])

    def reply(kind, keys, sums):
        return [_small(s) for s in sums]

    def stats(kind, keys, sums):
        c = sums[0]
        return np.concatenate(([np.count_nonzero(c), c.sum()], np.bincount(np.minimum(c, TOP + 2), minlength=TOP + 3)))

    counted = C.checkpointed(K.answer(packed.applyInArrow(ask, K.ROWS_DDL), reply, stats))
    found = K.collect_stats(counted)
    empty = np.zeros(TOP + 5, np.int64)
    model = Model(found.get(WORD, empty), found.get(PAIR, empty))
    mine = counted.filter("block >= 0").groupBy("block")

    def known(left: pa.Table, right: pa.Table):
        t = K.unpack_docs(left)
        p = K.Pairs(t, lower=True)
        c_word, c_context, _ = (x.astype(np.int64) for x in K.answers(right, WORD))
        c_pair, owner = K.answers(right, PAIR)
        return t, p, c_word, c_context, c_pair.astype(np.int64), owner

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return K.ROWS.empty_table()
        t, p, c_word, c_context, c_pair, owner = known(left, right)
        mine = np.flatnonzero((owner == 1) & (c_pair > 0))
        first = p.first[mine]
        seen = np.bincount(first, weights=model.p_pair(c_pair[mine], c_context[first]), minlength=len(p.words))
        below = np.bincount(first, weights=model.p_word(c_word)[p.second[mine]], minlength=len(p.words))
        asks = c_context > 0            # every asking block sends the count, which is the same in all of them
        return K.ask(BACK, left.column("block")[0].as_py(), p.words[asks], n_shards, c_context[asks],
                     np.ones(int(asks.sum()), np.int32), seen[asks], below[asks])

    def weights(kind, keys, sums):
        context, senders, seen, below = sums
        scale, weight = backoff(context / senders, seen, below)
        return [scale, weight]

    out_type = ("id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    out_schema = pa.schema([("id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()),
                            ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    base_unit = model.tokens + 0.5 * (model.types + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out_schema.empty_table()
        t, p, c_word, c_context, c_pair, _ = known(left, right)
        scale, weight = np.ones(len(p.words)), np.ones(len(p.words))
        back = K.answers(right, BACK)
        if back:
            asks = c_context > 0
            scale[asks], weight[asks] = back[0], back[1]
        below = model.p_word(c_word)[p.second]
        prob = np.where(c_pair > 0, scale[p.first] * model.p_pair(c_pair, c_context[p.first]),
                        weight[p.first] * below)
        logs = np.log10(prob)[p.of]
        c = c_word[p.token]
        base = np.log10((c + 0.5) / base_unit)
        n = t.num_rows

        def total(x):
            return np.bincount(p.row, weights=x, minlength=n)

        return pa.table([t.column("id"), pa.array(flags(t)), pa.array(total(np.ones(len(c))).astype(np.int64)),
                         pa.array(total(c > 0).astype(np.int64)), pa.array(total(base)), pa.array(total(logs))],
                        schema=out_schema)

    # a job of its own, so that its shuffle files are gone before the last exchange
    backs = C.checkpointed(K.answer(packed.cogroup(mine).applyInArrow(sums, K.ROWS_DDL), weights))
    given = counted.filter("block >= 0").unionByName(backs).groupBy("block")
    scored = packed.cogroup(given).applyInArrow(score, out_type)
    return scored.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known",
                         F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _small(c: np.ndarray) -> np.ndarray:
    return c.astype(np.uint32) if len(c) == 0 or c.max() < 1 << 32 else c.astype(np.uint64)
