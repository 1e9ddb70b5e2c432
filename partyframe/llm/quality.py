"""Quality: perplexity under an interpolated modified Kneser-Ney bigram model of trusted text."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C
from . import counts as K

PAIR, WORD, TRAINED = 0, 1, 2
SLICE = 1 << 20             # bytes of text that are cut into words at a time
BITS = 26                   # size of the filter of trained pairs and words (2^26 bits, 8 MB)
GROUPS, RANGES = 4, 4       # jobs a round: of the blocks that ask, of the shards that answer


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3 and more, from numbers of types seen 1 to 4 times.

    Where a number is missing, 0.5, 0.75 and 1 stand in; no discount passes its count.
    """
    n1, n2, n3, n4 = (float(x) for x in n[1:5])
    d = np.array([0.0, 0.5, 0.75, 1.0])
    if n1 > 0 and n2 > 0:
        y = n1 / (n1 + 2 * n2)
        d[1] = 1 - 2 * y * n2 / n1
        if n3 > 0:
            d[2] = 2 - 3 * y * n3 / n2
            if n4 > 0:
                d[3] = 3 - 4 * y * n4 / n3
    return np.clip(d, 0.0, [0, 0.999, 1.999, 2.999])


class Model:
    """The numbers that hold for all words: discounts of both orders, pair types and words."""

    def __init__(self, pair_stats: np.ndarray, word_stats: np.ndarray):
        self.d = discounts(pair_stats)
        self.d_low = discounts(word_stats)
        self.words, self.types = int(word_stats[5:].sum() + word_stats[1:5].sum()), int(pair_stats[1:].sum())
        spare = self.d_low[1] * word_stats[1] + self.d_low[2] * word_stats[2] + self.d_low[3] * word_stats[3:].sum()
        self.low_rest = spare / self.types if self.types else 1.0

    def p_low(self, cont: np.ndarray) -> np.ndarray:
        """Share of the distinct contexts a word was seen after, discounted; the rest is even over all words and one
        for the unknown."""
        seen = np.maximum(cont - self.d_low[np.minimum(cont, 3)], 0) / max(1, self.types)
        return seen + self.low_rest / (self.words + 1)

    def p(self, c: np.ndarray, context: np.ndarray, ones: np.ndarray, twos: np.ndarray, more: np.ndarray,
          low: np.ndarray) -> np.ndarray:
        """p(w|v) = discounted share + the context's freed mass x p_low(w)."""
        total = np.maximum(context, 1)
        rest = (self.d[1] * ones + self.d[2] * twos + self.d[3] * more) / total
        high = np.maximum(c - self.d[np.minimum(c, 3)], 0) / total
        return np.where(context > 0, high + rest * low, low)


def perplexity(docs: DataFrame, trained: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang", block_bytes: int = K.BLOCK_BYTES) -> DataFrame:
    """Perplexity per token of every text under a model of the texts that ``trained`` (id, h) names.

    ``h`` is the xxhash64 of id and text.  Tokens are the words as they are and
    one end.  Any number of texts may be named: their hashes are dealt to the
    blocks of text that hold them.  Count tables are sharded by key (see
    :mod:`.counts`): blocks ask for the counts of their distinct pairs, then
    for the context and continuation counts of their words.  Pairs and words
    that are not in a Bloom filter of the trained ones (of fixed size; when
    full it only lets more through) are not asked for: their counts are 0.
    A round asks and scores in ``GROUPS`` jobs, each for a part of the blocks,
    and answers in ``RANGES`` jobs, each for a part of the shards, so that the
    shuffle files of all texts and of all questions never lie on disk together.

    ``left_out`` is the perplexity under the model without the text itself:
    for a trained text its own counts are taken off every count, context and
    continuation (the discounts and the number of pair types stay); for others
    it is the perplexity.

    Returns (id, h, lang, trained, n_tokens, perplexity, left_out), one row
    per input row.
    """
    n_blocks, n_shards = K.plan_sizes(docs, text_col, block_bytes)
    h = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.col(lang_col).cast("string").alias("lang"), h.alias("h"))
    rows = rows.select("id", "text", "h", F.struct("h", "lang").alias("carry"))
    known = trained.select("h").dropna().distinct()

    sent = docs.sparkSession.sparkContext.broadcast(_trained_filter(rows.join(known, "h", "left_semi").select("text")))
    # a block is a function of h alone, so the trained ones reach it without a join of the texts
    marks = C.checkpointed(known.select(F.pmod("h", F.lit(n_blocks)).cast("int").alias("block"), "h")
                           .groupBy("block").applyInArrow(_marks, K.ROWS_DDL))

    def met(texts: DataFrame, right: DataFrame, run, kind) -> DataFrame:
        """``run`` on each block of the texts and what it was sent."""
        return (K.pack_docs(texts, "id", "text", n_blocks, F.col("carry")).groupBy("block")
                .cogroup(right.groupBy("block")).applyInArrow(run, kind))

    def in_groups(right: DataFrame, run, kind) -> DataFrame:
        n = min(GROUPS, n_blocks)
        own = F.pmod(F.pmod("h", F.lit(n_blocks)), F.lit(n))
        return reduce(DataFrame.unionByName, [
            C.checkpointed(met(rows.filter(own == g), right.filter(F.pmod("block", F.lit(n)) == g), run, kind))
            for g in range(n)])

    def in_ranges(questions: DataFrame, reply, stats) -> DataFrame:
        n = min(RANGES, n_shards)
        return reduce(DataFrame.unionByName, [
            C.checkpointed(K.answer(questions.filter(F.pmod("shard", F.lit(n)) == r), reply, stats))
            for r in range(n)])

    def asked(p: K.Pairs) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs, and which words, the block asks for."""
        return _in_filter(sent.value, p.pair), _in_filter(sent.value, p.words)

    def flags(t: pa.Table, right: pa.Table) -> np.ndarray:
        got = K.answers(right, TRAINED)
        h = t.column("row").combine_chunks().field("h").to_numpy()
        return np.isin(h, got[0]) if got else np.zeros(len(h), bool)

    def ask_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return K.ROWS.empty_table()
        t = K.unpack_docs(left)
        p = K.Pairs(t, lower=False, slice_bytes=SLICE)
        _, _, n = p.counts(flags(t, right))
        pairs, _ = asked(p)
        return K.ask(PAIR, left.column("block")[0].as_py(), p.pair[pairs], n_shards, n[pairs])

    def pair_stats(kind, keys, sums):
        return np.bincount(np.minimum(sums[0][sums[0] > 0], 5), minlength=6)

    # the shuffle files of each job are gone when the next one begins
    counted = in_ranges(in_groups(marks, ask_pairs, K.ROWS_DDL),
                        lambda kind, keys, sums: [sums[0].astype(np.uint32)], pair_stats)
    by_pair = K.collect_stats(counted).get(PAIR, np.zeros(6, np.int64))

    def pair_counts(p: K.Pairs, right: pa.Table, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, owner = np.zeros(len(p.pair), np.int64), np.zeros(len(p.pair), bool)
        got = K.answers(right, PAIR)
        if got:
            c[pairs], owner[pairs] = got[0], got[1] == 1
        return c, owner

    def ask_words(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return K.ROWS.empty_table()
        p = K.Pairs(K.unpack_docs(left), lower=False, slice_bytes=SLICE)
        pairs, words = asked(p)
        c, owner = pair_counts(p, right, pairs)
        mine = owner & (c > 0)

        def total(index, weight):
            return np.bincount(index[mine], weights=weight[mine], minlength=len(p.words))[words].astype(np.int32)

        one = np.ones(len(c))
        return K.ask(WORD, left.column("block")[0].as_py(), p.words[words], n_shards, total(p.first, c),
                     total(p.first, c == 1), total(p.first, c == 2), total(p.first, c > 2), total(p.second, one))

    def word_stats(kind, keys, sums):
        return np.bincount(np.minimum(sums[4], 5), minlength=6)

    words = in_ranges(in_groups(counted.filter("block >= 0"), ask_words, K.ROWS_DDL),
                      lambda kind, keys, sums: [s.astype(np.uint32) for s in sums], word_stats)
    by_word = K.collect_stats(words).get(WORD, np.zeros(6, np.int64))
    by_word[0] = 0
    model = Model(by_pair, by_word)

    out_type = T.StructType([T.StructField("id", T.LongType()), T.StructField("carry", rows.schema["carry"].dataType),
                             T.StructField("trained", T.BooleanType()),
                             T.StructField("n_tokens", T.LongType()), T.StructField("perplexity", T.DoubleType()),
                             T.StructField("left_out", T.DoubleType())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return to_arrow_schema(out_type).empty_table()
        t = K.unpack_docs(left)
        p = K.Pairs(t, lower=False, slice_bytes=SLICE)
        pairs, asks = asked(p)
        c, _ = pair_counts(p, right, pairs)
        stats = np.zeros((5, len(p.words)), np.int64)
        got = K.answers(right, WORD)
        if got:
            stats[:, asks] = np.stack([g.astype(np.int64) for g in got[:5]])
        context, ones, twos, more, cont = stats
        f = p.first
        prob = model.p(c, context[f], ones[f], twos[f], more[f], model.p_low(cont)[p.second])
        logs = np.bincount(p.row, weights=np.log(prob)[p.of], minlength=t.num_rows)
        n = np.bincount(p.row, minlength=t.num_rows)
        mine = flags(t, right)
        alone = np.where(mine, _without_itself(model, p, c, stats, mine), logs)
        return pa.table([t.column("id"), t.column("row"), pa.array(mine), pa.array(n.astype(np.int64)),
                         *(pa.array(np.exp(np.minimum(-x / np.maximum(n, 1), 700))) for x in (logs, alone))],
                        names=["id", "carry", "trained", "n_tokens", "perplexity", "left_out"])

    return in_groups(counted.unionByName(words).filter("block >= 0").unionByName(marks), score, out_type).select(
        "id", "carry.h", "carry.lang", "trained", "n_tokens", "perplexity", "left_out")


def _marks(t: pa.Table) -> pa.Table:
    """The trained hashes of one block as one row that travels with its answers."""
    h = t.column("h").to_numpy()
    return pa.Table.from_arrays([pa.array([x], pa.int32()) for x in (TRAINED, 0, t.column("block")[0].as_py(), len(h))]
                                + [pa.array([[K.pack(np.sort(h))]], pa.list_(pa.binary()))], schema=K.ROWS)


def _without_itself(model: Model, p: K.Pairs, c: np.ndarray, stats: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Log probability of each row that ``mine`` marks, with its own occurrences taken off all counts."""
    token = mine[p.row]
    wide = np.int64(len(p.pair))
    key, k = np.unique(p.row[token].astype(np.int64) * wide + p.of[token], return_counts=True)
    row, pair = key // wide, key % wide
    before, after = c[pair], np.maximum(c[pair] - k, 0)

    def taken(word, change):
        """What the row itself adds to a word's numbers, for each of its pairs."""
        _, at = np.unique(row * np.int64(len(p.words)) + word, return_inverse=True)
        return [np.bincount(at, weights=x).astype(np.int64)[at] for x in change]

    def moved(low, high):
        return ((before >= low) & (before <= high)).astype(int) - ((after >= low) & (after <= high))

    first, second = p.first[pair], p.second[pair]
    most = np.iinfo(np.int64).max
    context, ones, twos, more = (stats[i][first] - x for i, x in enumerate(
        taken(first, [before - after, moved(1, 1), moved(2, 2), moved(3, most)])))
    cont = stats[4][second] - taken(second, [moved(1, most)])[0]
    prob = model.p(after, context, ones, twos, more, model.p_low(np.maximum(cont, 0)))
    return np.bincount(row, weights=k * np.log(prob), minlength=len(mine))


def _trained_filter(texts: DataFrame) -> np.ndarray:
    """A Bloom filter (two bits each) of the pairs and words in the texts.

    Each task fills a filter of its own; 8 maps at most merge them, and the driver merges what those give.
    """
    size = 1 << BITS

    def sent(bits):
        yield pa.RecordBatch.from_arrays([pa.array([pa.compress(bits.tobytes(), codec="zstd", asbytes=True)],
                                                   pa.binary())], names=["bits"])

    def bits_of(packed: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(packed, decompressed_size=size // 8, codec="zstd", asbytes=True), np.uint8)

    def fill(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for t in C.slices(batch, max_bytes=SLICE):
                p = K.Pairs(t, lower=False, slice_bytes=SLICE)
                for keys in (p.pair, p.words):
                    for at in _places(keys):
                        np.bitwise_or.at(bits, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        yield from sent(bits)

    def merge(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for packed in batch.column("bits"):
                bits |= bits_of(packed.as_py())
        yield from sent(bits)

    out = np.zeros(size // 8, np.uint8)
    for r in texts.mapInArrow(fill, "bits binary").repartition(8).mapInArrow(merge, "bits binary").toLocalIterator():
        out |= bits_of(bytes(r["bits"]))
    return out


def _places(keys: np.ndarray) -> list[np.ndarray]:
    low = np.uint64((1 << BITS) - 1)
    return [(keys >> np.uint64(64 - BITS)).astype(np.int64), (keys & low).astype(np.int64)]


def _in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = [(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1 for at in _places(keys)]
    return hit[0] & hit[1]


def rate_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang", quantile: float = 0.99, slack: float = 1.25,
                 block_bytes: int = 4 << 20) -> DataFrame:
    """Perplexity of every text and whether it is kept: at most ``slack`` times its language's threshold.

    The model is trained on all texts of ``trusted`` (ids).  Every trained
    text is rated by the model without it (cross-fitting with one text a
    fold), so all trusted rows of a language set its threshold, the
    ``quantile`` of their perplexities, however few they are.  Languages
    without trusted text are not judged: all their rows are kept.

    Returns id_col, text_hash (xxhash64 of id and text), lang_col, n_tokens,
    perplexity (of trained texts: without the text itself), n_trusted (rows
    behind the threshold), threshold (null where there is none) and kept: one
    row per input row.  A null text is empty (one token, the end) and is
    judged like the others; a null language is one of its own.  Null ids are
    never trusted.  Rows that repeat (id and text) count each and share one
    block.  Extra columns are ignored.
    """
    h = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    ids = trusted.select(F.col(id_col).cast("long").alias("id")).dropna().distinct()
    trust = docs.select(F.col(id_col).cast("long").alias("id"), h.alias("h")).join(ids, "id").distinct()
    trust = C.checkpointed(trust)
    rows = perplexity(docs, trust, id_col, text_col, lang_col, block_bytes)
    limits = rows.filter("trained").groupBy(F.col("lang").alias("limit_lang")).agg(
        F.percentile_approx("left_out", quantile, 10_000).alias("own"), F.count(F.lit(1)).alias("n_trusted"))
    judged = (rows.join(F.broadcast(limits), rows["lang"].eqNullSafe(F.col("limit_lang")), "left")
              .withColumn("threshold", F.col("own") * slack))
    return judged.select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), F.col("lang").alias(lang_col),
                         "n_tokens", F.col("left_out").alias("perplexity"), "n_trusted", "threshold",
                         F.coalesce(F.col("left_out") <= F.col("threshold"), F.lit(True)).alias("kept"))
