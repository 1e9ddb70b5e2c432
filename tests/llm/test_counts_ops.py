"""Substring removal, Katz scores, quality and shards against brute force."""

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from partyframe.llm.katz import katz_scores
from partyframe.llm.quality import perplexity, rate_quality
from partyframe.llm.sharding import shard_by_bytes
from partyframe.llm.substring import remove_repeats
from tests.llm import brute


@pytest.mark.parametrize("block_bytes", [1 << 12, 8 << 20])
def test_substring_removal(docs, texts, block_bytes):
    """With one block and with many, the same words go as by the plain rule."""
    want = brute.kept_words(texts)
    got = {r["doc_id"]: r for r in remove_repeats(docs, block_bytes=block_bytes).collect()}
    assert set(got) == set(want) and sum(r["n_removed"] for r in got.values()) > 500
    for i, (kept, every) in want.items():
        assert (got[i]["text"], got[i]["n_words"], got[i]["n_removed"]) == (
            " ".join(kept), len(every), len(every) - len(kept))
        assert got[i]["changed"] == (len(kept) < len(every))


def test_substring_keeps_columns_and_untouched_texts(docs, texts, empty):
    out = remove_repeats(docs, as_is=True)
    assert set(docs.columns) <= set(out.columns)
    same = {r["doc_id"]: r["text"] for r in out.filter("not changed").collect()}
    before = dict(texts)
    assert same and all(same[i] == before[i] for i in same)
    assert remove_repeats(empty).count() == 0


def test_substring_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (1, text), (1, "other words"), (2, text)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in remove_repeats(df).collect()}
    assert got == {(None, 40): 0, (1, 40): 40, (1, 2): 0, (2, 40): 40}       # null comes first


@pytest.mark.parametrize("block_bytes", [1 << 14, 16 << 20])
def test_katz_scores(docs, texts, block_bytes):
    train = F.pmod(F.col("doc_id"), F.lit(4)) != 1
    tokens = {i: [*brute.words((t or "").translate(brute.LOWER)), None] for i, t in texts}
    m = brute.Katz([x for i, x in tokens.items() if i % 4 != 1])
    got = {r["doc_id"]: r for r in katz_scores(docs, train, block_bytes=block_bytes).collect()}
    assert set(got) == set(tokens)
    for i, x in tokens.items():
        r = got[i]
        assert (r["train"], r["n_tokens"], r["train_tokens"]) == (i % 4 != 1, len(x), m.n)
        assert r["n_known"] == sum(m.c[w] > 0 for w in x)
        base = sum(math.log10((m.c[w] + 0.5) / (m.n + 0.5 * (m.v + 1))) for w in x)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(m.score(x), rel=1e-9)


def test_katz_is_normalised(texts):
    m = brute.Katz([[*brute.words(t), None] for _, t in texts])
    for v in list(m.ctx)[:40]:
        assert sum(m.p(v, w) for w in m.c) + m.p(v, "never seen") == pytest.approx(1, abs=1e-9)


def test_katz_without_training_rows_and_on_nothing(docs, empty):
    rows = katz_scores(docs.limit(5), F.lit(None).cast("boolean")).collect()
    assert len(rows) == 5 and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] <= 0 for r in rows)
    assert katz_scores(empty, F.lit(True)).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 14, 16 << 20])
def test_kneser_ney_perplexity(docs, texts, block_bytes):
    h = F.xxhash64(F.col("doc_id"), F.col("text"))
    chosen = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), h.alias("h"))
    tokens = {i: [*brute.words(t), None] for i, t in texts}
    m = brute.KneserNey([x for i, x in tokens.items() if i % 2 == 0])
    out = perplexity(docs, chosen, block_bytes=block_bytes)
    got = {r["id"]: r for r in out.collect()}
    assert set(got) == set(tokens)
    for i, x in tokens.items():
        assert got[i]["trained"] == (i % 2 == 0) and got[i]["n_tokens"] == len(x)
        assert got[i]["perplexity"] == pytest.approx(m.perplexity(x), rel=1e-9)
        alone = m.perplexity_without(x) if i % 2 == 0 else m.perplexity(x)
        assert got[i]["left_out"] == pytest.approx(alone, rel=1e-9)
    for v in list(m.ctx)[:40]:
        assert sum(m.p(v, w) for w in m.cont) + m.p(v, "never seen") == pytest.approx(1, abs=1e-9)


def test_quality_keeps_prose_and_drops_noise(spark, empty):
    import random

    from tests.llm.conftest import make_words
    rng = random.Random(1)
    rows = [(i, " ".join(make_words(rng, 80)), "en" if i % 2 else "xx") for i in range(400)]
    noise = [(1000 + i, " ".join("%$#" + str(rng.random()) for _ in range(60)), "en") for i in range(10)]
    odd = [(2000, None, None), (2001, "", "en"), (None, rows[0][1], "en"), (1, rows[1][1], "en"), (1, rows[1][1], "en")]
    docs = spark.createDataFrame(rows + noise + odd, "doc_id long, text string, lang string")
    docs = docs.withColumn("kept", F.lit("clash")).withColumn("own", F.lit(1))
    trusted = spark.createDataFrame([(i,) for i in range(300)] + [(None,), (3,)], "doc_id long")
    rated = rate_quality(docs, trusted).collect()
    assert len(rated) == len(rows) + len(noise) + len(odd)
    kept = {r["doc_id"] for r in rated if r["kept"]}
    assert not kept & {i for i, _, _ in noise} and len(kept & set(range(400))) >= 392
    # nothing trusted: nothing rejected, no threshold
    blank = rate_quality(docs, trusted.limit(0)).collect()
    assert all(r["kept"] and r["threshold"] is None for r in blank)
    assert rate_quality(empty, trusted).count() == 0


def test_shards(docs, texts, empty):
    rows = shard_by_bytes(docs, 4).collect()
    size = {i: len((t or "").encode()) + 1 for i, t in texts}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {
        i: (size[i], zlib.crc32((t or "").encode())) for i, t in texts}
    by = {s: sorted((r["slot"], r["doc_id"]) for r in rows if r["shard"] == s) for s in range(4)}
    assert [d for s in range(4) for _, d in by[s]] == sorted(size)                  # contiguous in id order
    assert all([x for x, _ in by[s]] == list(range(len(by[s]))) for s in by)
    mean = sum(size.values()) / 4
    assert all(abs(sum(size[d] for _, d in by[s]) - mean) <= max(size.values()) for s in by)
    assert shard_by_bytes(empty, 4).count() == 0


def test_shards_split_one_hot_key(spark):
    df = spark.createDataFrame([(None, "same")] * 300 + [(i, "t" * (i % 9)) for i in range(100)], "doc_id long, text string")
    rows = shard_by_bytes(df, 8).collect()
    total = sum(r["size"] for r in rows)
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert len(rows) == 400 and max(abs(x - total / 8) for x in sizes) <= 10
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
               for s in range(8))


def test_registered_substring_query(spark):
    from partyframe.llm.queries import op10_substring
    from tests.conftest import SF_SMALL
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = {i: (len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest())
            for i, (k, w) in brute.kept_words(rows).items()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op10_substring(spark, SF_SMALL).collect()}
    assert got == want


def test_quality_keeps_languages_with_little_trusted_text(spark):
    """Clean texts of a language with 10 trusted rows and of one with none stay, among many English ones."""
    import random

    from tests.llm.conftest import make_words
    rng = random.Random(21)

    def other(letters):
        return " ".join("".join(rng.choices(letters, k=6)) for _ in range(60))

    rows = [(i, " ".join(make_words(rng, 60)), "en") for i in range(300)]
    rows += [(1000 + i, other("абвгд"), "ru") for i in range(40)] + [(2000 + i, other("αβγδε"), None) for i in range(40)]
    rows += [(3000 + i, other("qxzjk"), "en") for i in range(5)]
    base = [other("абвгд") for _ in range(4)]               # the ten trusted ones share words; noise has none of them
    rows = [(i, t if lang != "ru" else " ".join(rng.sample(" ".join(base).split(), 60)), lang) for i, t, lang in rows]
    rows += [(4000 + i, " ".join(f"%{rng.random()}" for _ in range(60)), "ru") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in [*range(250), *range(1000, 1010)]], "doc_id long")
    got = {r["doc_id"]: r for r in rate_quality(docs, trusted).collect()}
    assert all(got[i]["kept"] for i in [*range(1000, 1040), *range(2000, 2040)])
    assert not any(got[3000 + i]["kept"] for i in range(5)) and not any(got[4000 + i]["kept"] for i in range(6))
    assert {got[i]["n_trusted"] for i in range(1000, 1040)} == {10} and got[2000]["n_trusted"] is None
    assert len({got[i]["threshold"] for i in range(1000, 1040)}) == 1
    assert all(got[i]["threshold"] is None for i in range(2000, 2040))


def test_filter_scan_keeps_its_tasks(spark, monkeypatch):
    """The texts of the Bloom filter are exchanged before the 8 maps, not scanned by them."""
    from partyframe.llm import quality

    df = spark.createDataFrame([(f"some words {i}",) for i in range(50)], "text string")
    plans = []
    real = type(df).mapInArrow

    def spy(df, *a, **kw):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, *a, **kw)

    monkeypatch.setattr(type(df), "mapInArrow", spy)
    assert quality._trained_filter(df).any() and "Repartition 8, true" in plans[-1]


def test_quality_trains_on_every_trusted_text(spark):
    """20,001 trusted texts of one word: each of them is counted, none is left to a sample."""
    docs = spark.range(20_001).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionByName(spark.createDataFrame([(-1, "word", "en")], "doc_id long, text string, lang string"))
    got = {r["n_trusted"]: (r["n"], r["ranks"]) for r in rate_quality(docs, docs.filter("doc_id >= 0")).groupBy(
        "n_trusted").agg(F.count("*").alias("n"), F.collect_set(F.round("perplexity", 12)).alias("ranks")).collect()}
    m = brute.KneserNey([[b"word", None]] * 20_001)
    inside, outside = m.perplexity_without([b"word", None]), m.perplexity([b"word", None])
    assert set(got) == {20_001} and got[20_001][0] == 20_002
    assert sorted(got[20_001][1]) == pytest.approx(sorted({round(inside, 12), round(outside, 12)}), rel=1e-11)


def test_quality_rounds_run_in_parts(docs, texts, monkeypatch):
    """No shard answers while the texts are exchanged, and no job asks for all blocks or answers for all shards."""
    from partyframe.llm import quality

    h = F.xxhash64(F.col("doc_id"), F.col("text"))
    chosen = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), h.alias("h"))
    plain = {r["id"]: r["left_out"] for r in perplexity(docs, chosen).collect()}
    packed, ranges = [], []
    pack_docs, answer = quality.K.pack_docs, quality.K.answer

    def spy_pack(rows, *a, **kw):
        packed.append(rows.count())
        return pack_docs(rows, *a, **kw)

    def spy_answer(asked, *a, **kw):
        assert "FlatMapCoGroups" not in asked._jdf.queryExecution().optimizedPlan().toString()
        ranges.append({r["shard"] for r in asked.select("shard").distinct().collect()})
        return answer(asked, *a, **kw)

    monkeypatch.setattr(quality.K, "plan_sizes", lambda *a: (7, 6))
    monkeypatch.setattr(quality.K, "pack_docs", spy_pack)
    monkeypatch.setattr(quality.K, "answer", spy_answer)
    got = {r["id"]: r["left_out"] for r in perplexity(docs, chosen).collect()}
    assert got == pytest.approx(plain, rel=1e-9)
    assert all(n < len(texts) for n in packed) and sum(packed) == 3 * len(texts)
    assert all(len(x) < 6 for x in ranges) and sorted(s for x in ranges for s in x) == sorted([*range(6)] * 2)
