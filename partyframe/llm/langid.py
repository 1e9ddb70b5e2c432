"""Language of whole texts and of their spans: scripts, word scores, Viterbi with a switching penalty."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 1 << 16           # as many as 64 - 48 bits tell apart
ORDERS = (1, 2, 3, 4)
# First code points of runs of one script (Unicode blocks), fixed values; 0 is no letter, 1 is any other script.
SCRIPTS = (
    (0x0000, 0), (0x0041, 2), (0x005B, 0), (0x0061, 2), (0x007B, 0), (0x00AA, 2), (0x00AB, 0), (0x00BA, 2),
    (0x00BB, 0), (0x00C0, 2), (0x00D7, 0), (0x00D8, 2), (0x00F7, 0), (0x00F8, 2), (0x0250, 2), (0x02B0, 1),
    (0x0370, 3), (0x0400, 4), (0x0530, 5), (0x0590, 6), (0x0600, 7), (0x0700, 1), (0x0900, 8), (0x0980, 9),
    (0x0A00, 10), (0x0A80, 11), (0x0B00, 1), (0x0B80, 12), (0x0C00, 13), (0x0C80, 14), (0x0D00, 15), (0x0D80, 1),
    (0x0E00, 16), (0x0E80, 1), (0x10A0, 17), (0x1100, 18), (0x1200, 19), (0x1380, 1), (0x1E00, 2), (0x1F00, 3),
    (0x2000, 0), (0x2C00, 1), (0x2E00, 0), (0x2E80, 20), (0x3000, 0), (0x3040, 21), (0x3100, 1), (0x3130, 18),
    (0x3190, 1), (0x3400, 20), (0x4DC0, 0), (0x4E00, 20), (0xA000, 1), (0xAC00, 18), (0xD7B0, 1), (0xE000, 0),
    (0xF900, 20), (0xFB00, 1), (0xFE00, 0), (0xFE70, 7), (0xFF00, 0), (0xFF21, 2), (0xFF3B, 0), (0xFF41, 2),
    (0xFF5B, 0), (0xFF66, 21), (0xFFA0, 1), (0xFFE0, 0), (0x10000, 1), (0x1F000, 0), (0x20000, 20), (0xE0000, 0),
)
_FROM = np.array([s[0] for s in SCRIPTS])
_SCRIPT = np.array([s[1] for s in SCRIPTS], np.uint8)
N_SCRIPTS = 22


def _scripts(data: np.ndarray) -> np.ndarray:
    """Script of the character that starts at each byte (0 inside characters)."""
    out = np.zeros(len(data), np.uint8)
    low = data < 0x80
    out[low] = _SCRIPT[np.searchsorted(_FROM, np.arange(128), "right") - 1][data[low]]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        lead = data[at].astype(np.int32)
        after = [(data[np.minimum(at + j, len(data) - 1)] & 0x3F).astype(np.int32) for j in (1, 2, 3)]
        cp = np.where(lead < 0xE0, (lead & 0x1F) << 6 | after[0],
                      np.where(lead < 0xF0, (lead & 0x0F) << 12 | after[0] << 6 | after[1],
                               (lead & 0x07) << 18 | after[0] << 12 | after[1] << 6 | after[2]))
        out[at] = _SCRIPT[np.searchsorted(_FROM, cp, "right") - 1]
    return out


def _grams(flat: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Per order, the bucket of the n-gram that ends at each byte of spaced words (see :func:`.common.spelled`).

    An n-gram reaches back to the space before its word at most; other places
    hold ``BUCKETS``, the bucket of nothing.
    """
    n = len(flat)
    place = np.arange(n, dtype=np.int32) - np.repeat(off[:-1].astype(np.int32), np.diff(off))
    value = flat.astype(np.uint64) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    out = []
    for k in ORDERS:
        h[1:] = h[:-1] * np.uint64(0x9E3779B97F4A7C15)      # the hash of the k - 1 bytes before
        h[:1] = 0
        h += value
        bucket = ((h + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)).astype(np.int32)
        bucket[(place < k - 1) | (place == 0)] = BUCKETS
        out.append(bucket)
    return out


@dataclass
class Model:
    """``log_p``: buckets x languages; ``allowed``: scripts x languages, by what the training texts use."""

    langs: list[str]
    log_p: np.ndarray
    allowed: np.ndarray


def training_sample(docs: DataFrame, lang_col: str = "lang", text_col: str = "text",
                    max_rows: int = 20_000) -> DataFrame:
    """(lang, text): about ``max_rows`` of the distinct texts of each language, all of them in smaller tables.

    Languages share ``max_rows`` evenly; what a language has no texts for goes
    to the others.  So those with fewer texts than the even share keep them
    all, and larger ones keep about their part, by the smallest hashes of
    their texts.  Every language keeps at least the text of smallest hash.
    The driver gets one count per language.
    """
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna().withColumn(
        "h", F.xxhash64("text"))
    have = labelled.select("lang", "h").distinct().groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.min("h").alias("low")).collect()
    left, part = max_rows, {}
    for i, r in enumerate(sorted(have, key=lambda r: r["n"])):
        part[r["lang"]] = min(float(r["n"]), left / (len(have) - i))
        left -= part[r["lang"]]
    shares = docs.sparkSession.createDataFrame([(r["lang"], part[r["lang"]] / r["n"], r["low"]) for r in have],
                                               "lang string, part double, low long")
    unit = F.col("h").cast("double") / F.lit(2.0 ** 64) + 0.5
    return (labelled.join(F.broadcast(shares), "lang").filter((unit <= F.col("part")) | (F.col("h") == F.col("low")))
            .groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text"))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least_share: float = 0.01,
          max_rows: int = 20_000) -> Model:
    """Byte n-gram counts per language over a bounded sample of the rows with a language and a text.

    The sample is that of :func:`training_sample`.
    Counts are summed in tasks and then per (language, bucket); the driver gets
    at most ``BUCKETS + N_SCRIPTS`` numbers per language, whatever the input.
    A script is a language's own if at least ``least_share`` of its letters use it.
    """
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for lang in pc.unique(t.column("lang")).to_pylist():
                mine = t.filter(pc.equal(t.column("lang"), lang))
                have = total.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                for s in C.slices(mine):
                    words = C.Words(s.column("text"), lower=True)
                    _, sample, n = np.unique(words.hashes(), return_index=True, return_counts=True)
                    flat, off = C.spelled(words, sample, False)
                    weight = np.repeat(n.astype(float), np.diff(off))
                    for grams in _grams(flat, off):
                        have[:BUCKETS] += np.bincount(grams, weights=weight,
                                                      minlength=BUCKETS + 1)[:BUCKETS].astype(np.int64)
                    have[BUCKETS:] += np.bincount(_scripts(words.data), minlength=N_SCRIPTS)
        for lang, have in total.items():
            at = np.flatnonzero(have)
            yield C.frame(schema, [lang] * len(at), at.astype(np.int32), have[at])

    sample = training_sample(docs, lang_col, text_col, max_rows)
    rows = (sample.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket")
            .agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS + N_SCRIPTS, len(langs)))
    if langs:
        where = pc.index_in(rows.column("lang"), pa.array(langs)).to_numpy()
        counts[rows.column("bucket").to_numpy(), where] = rows.column("n").to_numpy()
    grams, scripts = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
    scripts[0] = 0
    allowed = scripts >= np.maximum(least_share * scripts.sum(axis=0), 1)
    allowed[:2] = True                                   # no letter, or a script not told apart: all languages
    allowed[~allowed.any(axis=1)] = True
    return Model(langs, np.log(grams / grams.sum(axis=0)).astype(np.float32), allowed)


def word_scores(words: C.Words, model: Model, strange: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(words x languages log scores, letters per word).  Words without letters score 0 for all, unless ``strange``."""
    n_langs = len(model.langs)
    if not len(words):
        return np.zeros((0, n_langs), np.float32), np.zeros(0, np.int64)
    _, sample, at = np.unique(words.hashes(), return_index=True, return_inverse=True)
    flat, off = C.spelled(words, sample, False)
    scripts = _scripts(flat)
    letters = np.add.reduceat((scripts > 0).astype(np.int32), off[:-1])
    grams = _grams(flat, off)
    out = np.empty((len(sample), n_langs), np.float32)
    for j in range(n_langs):
        table = np.append(model.log_p[:, j], np.float32(0))
        out[:, j] = np.add.reduceat(sum(table[g] for g in grams), off[:-1])
    # a word with letters of several scripts goes by the last of them in the table above
    script = np.maximum.reduceat(scripts, off[:-1])
    out[~model.allowed[script]] -= np.float32(1e6)
    if not strange:
        out[letters == 0] = 0
    return out[at], letters[at]


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word, where each change of language inside a row costs ``penalty``.

    All rows advance together, one word a step; rows go by length, so that
    those still running are the first ones.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    start, count = first[:-1][order], counts[order]
    n, steps = len(order), int(count[0]) if len(count) else 0
    value = np.zeros((n, scores.shape[1]), np.float32)
    came = np.zeros(scores.shape, np.int16)
    running = np.searchsorted(-count, -np.arange(steps), "left")       # rows with more than t words
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(steps):
        m = running[t]
        at = start[:m] + t
        v = value[:m]
        if t:
            best = v.argmax(axis=1)
            jump = v[np.arange(m), best] - np.float32(penalty)
            stay = v >= jump[:, None]
            came[at] = np.where(stay, own, best[:, None])
            v = np.maximum(v, jump[:, None])
        value[:m] = v + scores[at]
    out = np.zeros(len(scores), np.int16)
    now = value.argmax(axis=1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        m = running[t]
        at = start[:m] + t
        out[at] = now[:m]
        if t:
            now[:m] = came[at, now[:m]]
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             penalty: float = 12.0) -> DataFrame:
    """Language of every text and of its spans, from the text alone.

    Returns id_col, lang_pred, score, spans: one row per input row.  ``spans``
    is an array of (lang, first word, words); ``lang_pred`` is the language
    with the most letters, and ``score`` its share of the text's letters
    (0 to 1); equal shares go to the first name.  A text whose only letters
    are of no script in the table goes by its n-grams, with the score of a
    guess (1 / languages).  ``und`` with score 0 and no
    spans where the text is null or empty or has no letter, or the model has
    no language.  Extra columns are ignored.
    """
    langs = model.langs
    shared = docs.sparkSession.sparkContext.broadcast((langs, model.log_p, model.allowed))
    span = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())])

    def run(batches):
        m = Model(*shared.value)
        names = pa.array([*langs, "und"])
        for batch in batches:
            for t in C.slices(batch):
                words = C.Words(t.column("text"), lower=True)
                first, row, n = words.first, words.row, words.rows
                scores, letters = word_scores(words, m)
                best = viterbi(scores, first, penalty) if langs else np.zeros(len(words), np.int16)
                del scores
                share = np.zeros((n, max(1, len(langs))))
                np.add.at(share, (row, best), letters)
                some = _has_letter(t.column("text")) & bool(langs)
                strange = np.flatnonzero(some & (share.sum(axis=1) == 0))       # letters of no script in the table
                for r in strange:
                    own = C.Words(t.column("text").slice(r, 1), lower=True)
                    best[first[r]:first[r + 1]] = pick = word_scores(own, m, True)[0].sum(axis=0).argmax()
                    share[r, pick] = 1
                total = share.sum(axis=1)
                lang = np.where(some, share.argmax(axis=1), len(langs))
                score = np.where(some, share.max(axis=1) / np.maximum(total, 1), 0.0)
                score[strange] = 1 / max(1, len(langs))
                new = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (row[1:] != row[:-1])))
                                     & some[row]) if len(best) else np.zeros(0, np.int64)
                end = np.append(new[1:], len(best))
                end = np.minimum(end, first[row[new] + 1]) if len(new) else end[:0]
                spans = pa.StructArray.from_arrays(
                    [names.take(pa.array(best[new].astype(np.int32))),
                     pa.array((new - first[row[new]]).astype(np.int32)), pa.array((end - new).astype(np.int32))],
                    fields=list(span))
                off = np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=n)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [t.column("id").combine_chunks(), names.take(pa.array(lang.astype(np.int32))), pa.array(score),
                     pa.ListArray.from_arrays(pa.array(off), spans)], names=["id", "lang_pred", "score", "spans"])

    ddl = ("id long, lang_pred string, score double, "
           "spans array<struct<lang: string, first_word: int, n_words: int>>")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, ddl).withColumnRenamed("id", id_col)


def _has_letter(texts) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
