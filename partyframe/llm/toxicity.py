"""Toxicity: logistic regression on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from . import common as C

BITS = 18
ORDERS = (3, 4, 5)


def _counts(words: C.Words, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, log(1 + n)), sorted: n distinct words of the row have an n-gram in the bucket.

    ``wanted``: leave out the buckets where it is 0.
    """
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)
    distinct, sample, at = np.unique(words.hashes(), return_index=True, return_inverse=True)
    pair = np.unique(words.row.astype(np.int64) * len(distinct) + at)
    first, grams = _grams(words, sample)
    if wanted is not None:
        keep = wanted[grams] != 0
        first, grams = np.concatenate(([0], np.cumsum(keep)))[first], grams[keep]
    row, word = pair // len(distinct), pair % len(distinct)
    size = first[word + 1] - first[word]
    place = np.arange(int(size.sum())) + np.repeat(first[word] - (np.cumsum(size) - size), size)
    key, n = np.unique((np.repeat(row, size) << BITS) + grams[place], return_counts=True)
    return key >> BITS, (key & ((1 << BITS) - 1)).astype(np.int32), np.log1p(n)


def _grams(words: C.Words, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first gram of each sampled word, buckets): byte n-grams of the words with a space at either end."""
    flat, off = C.spelled(words, sample, True)
    value = flat.astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(sample)), np.diff(off))
    left = off[1:][owner] - np.arange(len(flat))        # bytes to the word's end, this one included
    out, who = [], []
    for k in ORDERS:
        at = np.flatnonzero(left >= k)
        h = np.full(len(at), k, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + value[at + j]
        out.append((C.mix(h) & np.uint64((1 << BITS) - 1)).astype(np.int32))
        who.append(owner[at])
    out, who = np.concatenate(out), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return np.searchsorted(who[order], np.arange(len(sample) + 1)), out[order]


@dataclass
class Model:
    """One weight per bucket (ratio times fitted weight) and the intercept."""

    weight: np.ndarray
    intercept: float


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_rows: int = 20_000, smoothing: float = 10.0, least_ratio: float = 0.5,
          reg: float = 1e-2, rounds: int = 4, steps: int = 25, rate: float = 0.1, part_rows: int = 3_000) -> Model:
    """Fit on at most ``max_rows`` labelled texts: those with the smallest hash of id and text.

    Labels other than 0 and 1, null ids and null texts are left out; of several
    labels of one id the largest counts.  The features of a text are its
    distinct words' n-grams, log(1 + number of words); each is multiplied by
    the log ratio of its mean among label 1 to that among label 0, both
    smoothed by ``smoothing`` rows of the overall mean count one, so that rare
    n-grams get ratios near 0; n-grams below ``least_ratio`` are left out.

    The logistic weights are fitted by iterative parameter mixing: in each
    round every partition (about ``part_rows`` texts) takes ``steps`` steps of
    AdaGrad from the common weights, and the weighted mean of the results is
    the next start.  With one class or none, the model is a constant.
    """
    lab = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("double").alias("label")))
    texts = (docs.filter(F.col(text_col).isNotNull())
             .select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
             .withColumn("h", F.xxhash64("id", "text")))
    # ids first: the sample is chosen on (id, hash) pairs, at most max_rows of them, and only its texts are read again
    chosen = C.checkpointed(texts.select("id", "h").join(lab, "id").distinct().orderBy("h", "id").limit(max_rows))
    share = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = 1 << BITS
    if len(share) < 2:
        return Model(np.zeros(size), 20.0 if 1.0 in share else -20.0)
    sample = texts.join(F.broadcast(chosen), ["id", "h"]).select("label", "text")
    total = pa.schema([("label", pa.float64()), ("bucket", pa.int32()), ("n", pa.float64())])

    def sums(batches):
        mass = np.zeros((2, size))
        for batch in batches:
            for t in C.slices(batch):
                row, bucket, value = _counts(C.Words(t.column("text"), lower=True))
                label = t.column("label").to_numpy()
                for k in (0, 1):
                    mine = label[row] == k
                    mass[k] += np.bincount(bucket[mine], weights=value[mine], minlength=size)
        for k in (0, 1):
            at = np.flatnonzero(mass[k])
            yield C.frame(total, np.full(len(at), float(k)), at.astype(np.int32), mass[k, at])

    got = (sample.mapInArrow(sums, "label double, bucket int, n double")
           .groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow())       # at most 2 x 2^BITS rows
    mass = np.zeros((2, size))
    mass[got.column("label").to_numpy().astype(int), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    rows = np.array([[share[0.0]], [share[1.0]]], float)
    mean = (mass + smoothing * rows / rows.sum()) / rows
    ratio = np.log(mean[1] / mean[0])
    ratio[np.abs(ratio) < least_ratio] = 0
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def scaled(batches):
        for batch in batches:
            for t in C.slices(batch):
                row, bucket, value = _counts(C.Words(t.column("text"), lower=True), sent.value)
                at = pa.array(np.searchsorted(row, np.arange(t.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [t.column("label").combine_chunks(), pa.ListArray.from_arrays(at, pa.array(bucket)),
                     pa.ListArray.from_arrays(at, pa.array((value * sent.value[bucket]).astype(np.float32)))],
                    names=["label", "bucket", "value"])

    n_parts = max(1, round(sum(share.values()) / part_rows))
    made = C.checkpointed(sample.mapInArrow(scaled, "label double, bucket array<int>, value array<float>")
                          .repartition(n_parts))
    weight, intercept = np.zeros(size), float(np.log(share[1.0] / share[0.0]))
    for _ in range(rounds):
        start = docs.sparkSession.sparkContext.broadcast((weight, intercept))

        def local(batches):
            w, b = start.value
            return _adagrad(list(batches), w.copy(), b, reg, steps, rate)

        mixed = made.mapInArrow(local, "n long, intercept double, weight binary").collect()     # one row a partition
        n = sum(r["n"] for r in mixed)
        weight = sum(r["n"] / n * np.frombuffer(r["weight"], np.float32) for r in mixed).astype(float)
        intercept = sum(r["n"] / n * r["intercept"] for r in mixed)
    return Model(weight * ratio, intercept)


def _adagrad(batches: list[pa.RecordBatch], w: np.ndarray, b: float, reg: float, steps: int, rate: float):
    """Full-gradient steps on one partition's rows; yields (rows, intercept, weights)."""
    batches = [x for x in batches if x.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches).combine_chunks()
    y = t.column("label").to_numpy()
    bucket, value = t.column("bucket").chunk(0), t.column("value").chunk(0)
    row = np.repeat(np.arange(len(y)), np.diff(bucket.offsets.to_numpy()))
    bucket, value = bucket.flatten().to_numpy(), value.flatten().to_numpy().astype(float)
    past = np.zeros(len(w))
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=value * w[bucket], minlength=len(y)) + b,
                                         -700, 700))) - y
        g = np.bincount(bucket, weights=value * error[row], minlength=len(w)) / len(y) + reg * w
        past += g * g
        w -= rate * g / np.sqrt(past + 1e-10)
        b -= rate * float(error.mean())
    yield pa.RecordBatch.from_arrays([pa.array([len(y)]), pa.array([b]), pa.array([w.astype(np.float32).tobytes()],
                                                                                 pa.binary())],
                                     names=["n", "intercept", "weight"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Probability of label 1 for every whole text, from the text alone.

    Returns id_col, score (0 to 1), predicted (1 if score >= 0.5): one row per
    input row.  A null or empty text has no features and gets the intercept's
    score.  Extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.intercept))     # 2^BITS numbers
    schema = StructType([StructField("id", LongType()), StructField("score", DoubleType()),
                         StructField("predicted", IntegerType())])

    def run(batches):
        weight, intercept = shared.value
        for batch in batches:
            for t in C.slices(batch):
                words = C.Words(t.column("text"), lower=True)
                row, bucket, value = _counts(words, weight)
                z = intercept + np.bincount(row, weights=value * weight[bucket], minlength=words.rows)
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                yield pa.RecordBatch.from_arrays(
                    [t.column("id").combine_chunks(), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    names=["id", "score", "predicted"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)
