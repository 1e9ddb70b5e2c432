"""Rules by weak supervision, ranked search, collocations: against plain restatements."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partyframe.llm import collocations as col
from partyframe.llm import lexical, rules, terms
from tests.llm import brute
from tests.llm.conftest import DOCS, make_words


# ---------------------------------------------------------------- tokens

def test_tokens_and_joined_words():
    import pyarrow as pa
    texts = ["a  bb\tccc", None, "", "x", "ééa.b", " lead and trail "]
    t = terms.Tokens(pa.array(texts), terms.byte_set(" \t."))
    raw = t.data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(t.start, t.end)] == ["a", "bb", "ccc", "x", "ééa", "b", "lead", "and", "trail"]
    assert t.counts.tolist() == [3, 0, 0, 1, 2, 3]
    assert t.joined(np.array([0, 6]), 3).to_pylist() == ["a bb ccc", "lead and trail"]
    h = terms.Tokens(pa.array(["same word same", "same"]), terms.byte_set(" ")).hashes()
    assert h[0] == h[2] == h[3] != h[1]


def test_key_filter_holds_its_keys(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("key"))
    table = terms.key_filter(df, "key", 20)
    keys = np.array([r["key"] for r in df.collect()]).view(np.uint64)
    assert terms.in_filter(table, keys).all()
    other = np.array([r["k"] for r in spark.range(5000, 10_000).select(F.xxhash64("id").alias("k")).collect()])
    assert terms.in_filter(table, other.view(np.uint64)).mean() < 0.01
    assert not terms.in_filter(terms.key_filter(df.limit(0), "key", 10), keys).any()


# ---------------------------------------------------------------- rules

def test_signals_against_brute_force(spark, docs, texts, empty):
    more = [(5001, "a b c d e\na b c d e\r\n\n \na b c d e"), (5002, "One! two# THREE three three 漢字 é."),
            (5003, "x\x0by\x0cz\n\nx"), (5004, "one two three four five one two three four five six")]
    table = docs.unionByName(spark.createDataFrame([(i, t, None, 1, 2, "i", "r", "k") for i, t in more], DOCS))
    got = {r["id"]: r.asDict() for r in rules.signals(table).collect()}
    for i, t in [*texts, *more]:
        want = brute.text_signals(t)
        assert {k: got[i][k] for k in want} == want, (i, t[:80])
    assert rules.signals(empty).count() == 0


def _em(votes, faults, rounds=3000):
    """The mixture of good and one kind a fault, text by text."""
    kinds = list(dict.fromkeys(faults))
    q = []
    for v in votes:
        against = [sum(x == -1 and f == k for x, f in zip(v, faults)) for k in kinds]
        row = [20.0 if not sum(against) else 0.5, *(a + 0.01 for a in against)]
        q.append([x / sum(row) for x in row])
    for _ in range(rounds):
        share = [(sum(r[k] for r in q) + 1) / (len(votes) + len(kinds) + 1) for k in range(len(kinds) + 1)]
        plus = [[(sum(r[k] for r, v in zip(q, votes) if v[j] == 1) + 1) / (sum(r[k] for r, v in zip(q, votes) if v[j]) + 2)
                 for j in range(len(faults))] for k in range(len(kinds) + 1)]
        plus = [plus[0], *([min(a, b) for a, b in zip(p, plus[0])] for p in plus[1:])]
        new = []
        for v in votes:
            p = [s * np.prod([(x if y == 1 else 1 - x) for x, y in zip(row, v) if y]) for s, row in zip(share, plus)]
            new.append([x / sum(p) for x in p])
        if max(abs(a - b) for r, s in zip(q, new) for a, b in zip(r, s)) < 1e-10:
            return [r[0] for r in new]
        q = new
    return [r[0] for r in q]


def test_rules_rate_texts_as_the_text_by_text_estimate(spark, texts, docs, empty):
    rng = random.Random(4)
    rows = list(texts)
    for i in range(60):
        w = make_words(rng, 80)
        kind = i % 4
        text = (" ".join(x.upper() + "!!" for x in w[:20] * 3), " ".join(x + "%%%" for x in w), " ".join(w[:1] * 90),
                " ".join(w[:40]) + ". " + " ".join(w[40:]) + ".")[kind]
        rows.append((9000 + i, text))
    table = spark.createDataFrame([(i, t, None, 1, 2, "i", "r", "k") for i, t in rows], DOCS).repartition(3)
    got = {r["doc_id"]: r for r in rules.rate_by_rules(table).collect()}
    assert len(got) == len(rows)
    votes = [tuple(got[i][f"vote_{r.name}"] for r in rules.RULES) for i, _ in rows]
    want = _em(votes, [r.fault for r in rules.RULES])
    for (i, t), p in zip(rows, want):
        r, s = got[i], brute.text_signals(t)
        failed = s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]
        assert r["base_failed"] == failed and r["p_good"] == pytest.approx(p, abs=1e-6)
        assert r["kept"] == (not failed and p >= 0.5)
    assert not any(got[9000 + i]["kept"] for i in range(60) if i % 4 < 3)
    assert all(got[9000 + i]["kept"] for i in range(3, 60, 4))
    assert rules.rate_by_rules(empty).count() == 0
    twice = rules.rate_by_rules(docs.unionByName(docs).withColumn("p_good", F.lit("x")))
    assert twice.count() == 2 * docs.count()


def test_trust_is_learned_not_given():
    """A rule that votes at random gets no weight; one that others bear out gets much."""
    rng = np.random.default_rng(1)
    bad = rng.random(4000) < 0.15
    votes = np.stack([np.where(bad, -1, 1) * np.where(rng.random(4000) < 0.03, -1, 1),
                      np.where(bad, -1, 1) * np.where(rng.random(4000) < 0.05, -1, 1),
                      np.where(rng.random(4000) < 0.5, -1, 1),
                      np.where(rng.random(4000) < 0.4, 0, np.where(bad, -1, 1))], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    trust = rules.estimate(patterns, counts, ["f"] * 4)
    none, up, down = trust.weights()
    assert down[0][2] < 0.5 < 2 < min(down[0][[0, 1, 3]]) and trust.share[1] == pytest.approx(bad.mean(), abs=0.03)
    p = 1 / (1 + np.exp(none[0] + (votes == 1) @ up[0] + (votes == -1) @ down[0]))
    assert ((p < 0.5) == bad).mean() > 0.97


# ---------------------------------------------------------------- ranked search

def _ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


@pytest.mark.parametrize("options", [{}, {"group_rows": 64, "block_bytes": 300}])
def test_search_against_brute_force(spark, docs, texts, empty, options):
    rng = random.Random(9)
    items = [(i, " ".join(make_words(rng, n))) for i, n in enumerate((1, 2, 5, 12, 40, 90, 200))]
    items += [(20, "THE the The of of"), (21, "élève ПРИВЕТ 你好"), (22, ""), (23, None), (24, "zzzz qqqq"), (25, "x" * 30_000)]
    table = spark.createDataFrame([(i, t, 7, "rank", 1) for i, t in [*items, items[3]]],
                                  "item_id long, text string, doc_id int, rank string, score int")
    got = _ranked(lexical.search(docs, table, 7, **options))
    want = {i: r for i, r in brute.search(texts, items, 7).items() if r}
    assert got == want
    assert lexical.search(empty, table).count() == 0 and lexical.search(docs, table.limit(0)).count() == 0


def test_search_ties_repeats_and_null_ids(spark):
    rows = [(i, "alpha beta") for i in (9, 3, 5, 5, 8, 1)] + [(None, "alpha beta"), (2, None), (4, "gamma"), (6, "gamma delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([("q", "alpha"), (None, "gamma"), ("r", "gamma"), ("r", "delta")], "item_id string, text string")
    got = lexical.search(docs, items, 4).collect()
    by = {}
    for r in got:
        by.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"]))
    assert sorted(by["q"]) == [(1, None), (2, 1), (3, 3), (4, 5)]
    assert sorted(by[None]) == [(1, 4), (2, 6)] and sorted(by["r"]) == [(1, 4), (1, 6), (2, 6)]


def test_masks_below_the_bound_are_not_scored():
    """Best-first over masks: the rest of a large group is left alone, and nothing is lost by it."""
    rng = np.random.default_rng(3)
    n, k = 3000, 12
    present = rng.random((k, n)) < np.linspace(0.02, 0.6, k)[:, None]
    term, doc = np.nonzero(present)
    tf = rng.integers(1, 3, len(term))
    items = lexical.Items([0], np.arange(k).astype(np.uint64), [np.arange(k)], [np.ones(k, np.int64)])
    weights = np.linspace(6000, 400, k).astype(np.int64)
    norm = np.full(n, 100)
    best = lexical.Best(1, 20)
    scored = lexical.search_group(items, weights, (term, doc, tf), norm, np.arange(n), best)
    full = np.zeros(n, np.int64)
    np.add.at(full, doc, weights[term] * ((10**9 * tf) // (1000 * tf + 12 * 100)))
    assert sorted(best.score[0].tolist(), reverse=True) == sorted(full.tolist(), reverse=True)[:20]
    assert scored < n / 4, scored
    group, one = lexical.masks(np.repeat(present, 7, axis=0))         # 84 terms: two words of bits
    cols = [tuple(c) for c in present.T.tolist()]
    assert len(one) == len(set(cols))
    assert all(cols[i] == cols[one[g]] for i, g in enumerate(group))


# ---------------------------------------------------------------- collocations

def _phrases(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def _corpus(rng):
    rows = []
    for i in range(150):
        w = [rng.choice("the of and in a to".split()) if rng.random() < 0.8 else x for x in make_words(rng, rng.randint(3, 60))]
        for j in range(4, len(w), 9):
            w[j] += rng.choice(".,;:!?")
        rows.append((" ".join(w).replace("and in", "and\t  in").capitalize(), rng.choice(["en", "xx", None])))
    rows += [("Éléphant bleu dort. new YORK city hall\nnew york city", "fr")] * 14
    rows += [(None, "en"), ("", None), (" \t ", "xx"), ("...", "de"), ("rare pair", "de"), ("ab" * 9000, "en"), ("a a a a a a a", "und")]
    return rows


@pytest.mark.parametrize("options,words", [({}, 3), ({"share": 0.0}, 3), ({"max_words": 5, "bits": 12, "share": 0.9}, 5),
                                           ({"max_words": 2, "min_count": 3, "top": 25, "inside": 101}, 2)])
def test_collocations_against_brute_force(spark, empty, options, words):
    """Also with a sample that proposes nothing (every pass is an expansion) and a filter that is nearly full."""
    rows = _corpus(random.Random(2))
    df = spark.createDataFrame([(i, t, lang, 1, 2, "x", "n", "phrase") for i, (t, lang) in enumerate(rows)], DOCS).repartition(5)
    want = brute.collocations(rows, words, options.get("min_count", 10), options.get("inside", 50), options.get("top", 2000))
    assert len(want) > 20 and _phrases(col.collocations(df, **options)) == want
    if not options:
        assert col.collocations(empty).count() == 0


def test_hot_language_and_copies(spark):
    """A third of the rows is one text, ids are null or equal: counts are exact, order is by bytes."""
    rng = random.Random(12)
    rows = [(" ".join(make_words(rng, 30)), "en") for _ in range(200)] + [("zé za zé za zz", "en")] * 100
    df = spark.createDataFrame([(None if i % 2 else 1, t, lang, 1, 2, "x", "n", "a") for i, (t, lang) in enumerate(rows)], DOCS)
    assert _phrases(col.collocations(df)) == brute.collocations(rows)


def test_score_passes_64_bits(spark):
    rows = [(10**14 + 7, 3 * 10**14, 10**14 + 9), (10, 10, 10), (999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("*", col.score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r["s"] == 10**6 * r["a"] ** 2 // (r["l"] * r["r"]) for r in got.collect())
