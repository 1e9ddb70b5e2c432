"""Language spans, toxicity, packing and the whole pipeline."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from partyframe.llm import langid, packing, toxicity
from partyframe.llm.common import fold_of
from tests.llm import brute
from tests.llm.conftest import DOCS, make_words

PARTS = {"aa": "an er in on re th st ti nd".split(), "bb": "ou eau que le ré ent ai ch".split(),
         "cc": "про ста ли ное ком вер".split()}


def _prose(rng, lang, n):
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    rows = [(i, _prose(rng, lang, 60), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    rows += [(900, None, "aa"), (901, "text", None), (902, "", "bb")]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_languages_and_spans(spark, model):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(60):
        a, b = rng.sample(["aa", "bb", "cc"], 2)
        n, m = rng.randint(12, 60), rng.randint(12, 60)
        rows.append((i, f"{_prose(rng, a, n)} 42 !? {_prose(rng, b, m)}", "x", 1, 2, "id", "row", "spans"))
        want[i] = (a, b, n)
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, DOCS), model).collect()}
    hits = [i for i, (a, b, n) in want.items() if [s["lang"] for s in got[i]["spans"]] == [a, b]
            and abs(got[i]["spans"][1]["first_word"] - n) <= 4]
    assert len(hits) >= 55
    for i, r in got.items():
        assert 0 < r["score"] <= 1 and r["lang_pred"] in want[i][:2]
        assert sum(s["n_words"] for s in r["spans"]) == len(brute.words(rows[i][1]))
        assert r["spans"][0]["first_word"] == 0


def test_every_language_is_learned(spark):
    """A rare language among many texts of others, and a hot text, in a small sample."""
    rng = random.Random(4)
    rows = [(_prose(rng, "aa", 20), "aa") for _ in range(1500)] + [(_prose(rng, "bb", 20), "bb") for _ in range(4)]
    rows += [(_prose(rng, "cc", 20), "cc") for _ in range(300)] + [(rows[0][0], "aa")] * 500
    df = spark.createDataFrame(rows, "text string, lang string")
    sample = [(r["lang"], r["text"]) for r in langid.training_sample(df, max_rows=60).collect()]
    per = {lang: sum(x == lang for x, _ in sample) for lang in PARTS}
    assert len(set(sample)) == len(sample) and per["bb"] == 4 and all(14 <= per[x] <= 45 for x in ("aa", "cc"))
    assert langid.training_sample(df, max_rows=5000).count() == len(set(rows))
    assert langid.train(df, max_rows=1).langs == ["aa", "bb", "cc"]


def test_odd_texts_have_a_language_or_none(docs, texts, model, empty, spark):
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        if t is None or not any(ch.isalpha() for ch in t):
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["spans"]) == ("und", 0.0, [])
        else:
            assert got[i]["lang_pred"] in model.langs and 0 < got[i]["score"] <= 1
    assert langid.identify(empty, model).count() == 0
    strange = spark.createDataFrame([(1, "ℝ ℕ"), (2, "々"), (3, "° ½ ✓"), (4, "ℝ abc")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(strange, model).collect()}
    assert all(got[i]["lang_pred"] in model.langs and 0 < got[i]["score"] <= 1 and got[i]["spans"] for i in (1, 2, 4))
    assert got[3]["lang_pred"] == "und"
    blank = langid.train(empty)
    assert blank.langs == [] and {r["lang_pred"] for r in langid.identify(docs, blank).collect()} == {"und"}


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    counts = [0, 1, 5, 7, 0, 3]
    scores = rng.normal(size=(sum(counts), 3)).astype(np.float32)
    first = np.concatenate(([0], np.cumsum(counts)))
    got = langid.viterbi(scores, first, 1.5)
    for a, b in zip(first, first[1:]):
        def total(path):
            return sum(scores[a + k, x] for k, x in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:]))
        if b > a:
            best = max(itertools.product(range(3), repeat=int(b - a)), key=total)
            assert total(got[a:b].tolist()) == pytest.approx(total(best), abs=1e-5)


def test_scripts_of_characters():
    text = "aé1Яا漢あ한€𠀀"
    got = langid._scripts(np.frombuffer(text.encode(), np.uint8))
    starts = np.cumsum([0] + [len(c.encode()) for c in text])[:-1]
    assert [int(got[s]) for s in starts] == [2, 2, 0, 4, 7, 20, 21, 18, 0, 20]


def test_toxicity_on_held_out_texts(spark, docs, texts, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(700):
        w = make_words(rng, rng.randint(20, 120))
        bad = i % 6 == 0
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["vilescum", "dirtbag", "lowlife"]))
        rows.append((i, " ".join(w), "en", 1, 1, "score", "label", "h"))
        labels.append((i, int(bad), 7))
    table = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame(labels + [(3, 0, 7), (None, 1, 7), (5, None, 7), (99_999, 1, 7)],
                                "doc_id long, toxic int, h int")
    held = fold_of("doc_id") == 0
    model = toxicity.train(table.filter(~held), lab.filter(~held))
    scored = {r["doc_id"]: r for r in toxicity.score(table, model).collect()}
    out = [i for i in range(700) if brute.fold(i) == 0]
    right = sum(scored[i]["predicted"] == int(i % 6 == 0) for i in out)
    assert right / len(out) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in scored.values())
    odd = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(odd) == len(texts) and toxicity.score(empty, model).count() == 0
    none = {odd[i] for i, t in texts if not brute.words(t)}
    assert len(none) == 1                                       # no words: the intercept alone
    for label, want in ((lab.filter("toxic = 1"), 1), (lab.filter("toxic = 0"), 0), (lab.limit(0), 0)):
        flat = toxicity.train(table, label)
        assert {r["predicted"] for r in toxicity.score(docs, flat).collect()} == {want}


# ---------------------------------------------------------------- packing

def test_packing_round_trip(docs, texts, empty):
    """Tokens equal the tokenizer's; every token has exactly one place and no place two."""
    import public_tokenizers
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts}
    rows = packing.pack(docs, 128, with_ids=True).collect()
    placed, whole_docs = {}, {i: {} for i in ids}
    for r in rows:
        a = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert list(r["ids"]) == a and 1 <= r["length"] <= 128
        assert r["ids_crc32"] == zlib.crc32(np.array(a, "<u4").tobytes())
        whole_docs[r["doc_id"]][r["piece"]] = r
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, got in whole_docs.items():
        n = len(ids[i])
        assert sorted(got) == list(range(-(-n // 128)))
        assert all(got[k]["length"] == 128 for k in got if k) and sum(r["length"] for r in got.values()) == n
    for spots in placed.values():
        spots.sort()
        assert spots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spots, spots[1:]))
        assert sum(spots[-1]) <= 128
    total = sum(map(len, ids.values()))
    assert len(placed) <= 1.03 * total / 128 + 3
    assert packing.pack(empty).count() == 0


def test_plans_use_up_every_histogram():
    rng = np.random.default_rng(2)
    for scale in (0, 1, 30, 3000):
        hist = rng.poisson(scale * rng.random(65))
        hist[0] = 0
        used, bins = np.zeros(65, int), 0
        for got, n in packing.plan(hist, 64):
            assert sum(got) <= 64 and n > 0
            for x in got:
                used[x] += n
            bins += n
        assert (used == hist).all()
        assert bins <= 1.05 * (hist * np.arange(65)).sum() / 64 + 33


def test_best_fit_equals_the_one_by_one_rule_in_bins():
    rng = np.random.default_rng(5)
    for _ in range(30):
        hist = rng.poisson(2, 33)
        hist[0] = 0
        bins: list[int] = []
        for x in (x for x in range(32, 0, -1) for _ in range(hist[x])):
            fit = min((b for b in range(len(bins)) if bins[b] >= x), key=lambda b: bins[b], default=None)
            if fit is None:
                bins.append(32 - x)
            else:
                bins[fit] -= x
        assert abs(sum(n for _, n in packing.best_fit(hist, 32)) - len(bins)) <= 1


def test_fit_lowers_the_error_and_stays_non_negative():
    hist = np.zeros(33)
    hist[[4, 12, 16, 28, 20, 8]] = [100, 40, 60, 30, 10, 80]
    pats = packing.patterns(np.flatnonzero(hist), 32)
    assert {tuple(p) for p in pats} == {(28, 4, 0), (20, 12, 0), (20, 8, 4), (16, 16, 0), (16, 12, 4), (16, 8, 8),
                                        (12, 12, 8)}

    def error(x):
        return sum((hist[n] - sum(x[j] * (p == n).sum() for j, p in enumerate(pats))) ** 2 for n in range(1, 33))
    few, many = packing.fit(hist, pats, 3), packing.fit(hist, pats, 400)
    assert (many >= 0).all() and error(many) <= error(few) <= error(np.zeros(len(pats)))


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each later stage on what the one before kept, restated plainly; all five run in order."""
    import corpus_pipeline
    from tests.conftest import SF_SMALL
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages",
                                                      "benchmark_leaks", "packing"]
    state = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF_SMALL)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r["doc_id"]: r.asDict() for r in docs.collect()}
        state[name] = len(after)
        if name == "quality":
            good = {r["doc_id"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").filter("quality = 1").collect()}
            assert len(good & set(after)) >= 0.97 * len(good) and len(after) < len(before)
        elif name == "near_duplicates":
            sets = {i: brute.shingle_set(t) for i, t in before.items()}
            pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b]
                     and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            group = brute.linked(sets, pairs)
            assert set(after) == {i for i in sets if group[i] == i}
        elif name == "repeated_passages":
            want = brute.kept_words(before.items())
            assert set(after) == {i for i, (k, w) in want.items() if k or not w}
            for i, r in after.items():
                kept, every = want[i]
                assert r["text"] == (" ".join(kept) if len(kept) < len(every) else before[i])
                assert r["n_chars"] == len(r["text"])
        elif name == "benchmark_leaks":
            from tests.llm.test_joins import _leaks
            assert set(before) - set(after) == {d for d, _ in _leaks(before.items(), bench)}
    assert state["packing"] == state["benchmark_leaks"]


def test_pipeline_stages_on_odd_rows(spark, docs, texts, empty):
    """Nulls, repeated rows, missing texts and an empty table pass through every stage."""
    import corpus_pipeline
    from tests.conftest import SF_SMALL
    extra = spark.createDataFrame([(None, texts[0][1], None, 1, 2, None, "r", "k"), (1, texts[0][1], "en", 1, 2, "x", "y", "z"),
                                   (1, texts[0][1], "en", 1, 2, "x", "y", "z")], DOCS)
    rows = docs.unionByName(extra).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for table in (rows, rows.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF_SMALL)
            if name != "packing":
                assert out.columns == table.columns
            n = out.count()
            assert (n > 0) == (table is rows)
            if name == "near_duplicates" and n:
                ids = [r["doc_id"] for r in out.select("doc_id").collect()]
                assert ids.count(1) == 1 and ids.count(None) == 1
            now = out.cache()
