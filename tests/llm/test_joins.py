"""Near duplicates (texts and vectors), components and benchmark leaks against brute force."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partyframe.llm import decontaminate, jaccard, metricjoin
from partyframe.llm.components import components, merge
from partyframe.llm.decontaminate import find_leaks
from partyframe.llm.jaccard import near_texts
from partyframe.llm.metricjoin import near_vectors
from tests.llm import brute
from tests.llm.conftest import make_words


def _near(rows, least=0.8):
    """Rows are (id, text), ids may repeat: {place: (links, smallest id of the group)}."""
    sets = [brute.shingle_set(t) for _, t in rows]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2)
             if sets[a] and rows[a][0] is not None and rows[b][0] is not None
             and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) and sets[b]]
    links = {i: 0 for i in range(len(rows))}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    group = brute.linked(range(len(rows)), pairs)
    low = {}
    for i, g in group.items():
        low[g] = rows[i][0] if g not in low else min(low[g], rows[i][0])
    return [(rows[i], links[i], low[group[i]]) for i in range(len(rows))]


def _check_texts(df, rows, **kw):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_links"], r["class_id"] or 0, r["kept"])
                  for r in near_texts(df, **kw).collect()))
    want = sorted(((i is None, i or 0, n, g or 0, i == g) for (i, _), n, g in _near(rows)))
    assert got == want


def test_near_texts(docs, texts):
    _check_texts(docs, texts)
    assert sum(n for _, n, _ in _near(texts)) > 40


def test_large_buckets_are_split_and_chunked(docs, texts, monkeypatch):
    """With tiny limits every path goes through recursion, chunk pairs and the dense join; nothing changes."""
    monkeypatch.setattr(jaccard, "CHUNK", 2)
    _check_texts(docs, texts, small=2)


def test_near_texts_repeated_rows_ids_and_nulls(spark, empty):
    rng = random.Random(2)
    a, b = " ".join(make_words(rng, 60)), " ".join(make_words(rng, 60))
    rows = [(5, a), (5, a), (5, b), (6, b), (7, a), (None, a), (8, None), (9, ""), (10, "short text"), (11, "short text")]
    _check_texts(spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)), rows)
    assert near_texts(empty).count() == 0


def test_near_texts_plan_has_no_runtime_filters(spark, capsys, tmp_path):
    """On small tables Spark would put Bloom filters of a megabyte and more each into the plan that the driver sends."""
    rng = random.Random(3)
    a = " ".join(make_words(rng, 40))
    rows = [(1, a), (2, a + " more"), (None, a), (None, ""), (None, None), (3, ""), (3, None), (3, a), (4, "  "), (4, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))         # a file's size is known, that of local rows is not
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")        # as for tables too large to broadcast
    try:
        near_texts(df).explain("extended")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    plan = capsys.readouterr().out
    assert "Join" in plan and "bloom" not in plan.lower() and "might_contain" not in plan
    _check_texts(df, rows)


def test_survival_gives_the_recall_it_states():
    """Chance of a shared path, by simulation of the branching that `survival` computes."""
    rng = np.random.default_rng(0)
    alive = np.ones(20_000, int)
    for _ in range(3):
        alive = rng.binomial(alive * jaccard.POSITIONS, 1 / jaccard.POSITIONS)
    assert abs((alive > 0).mean() - jaccard.survival(3)) < 0.02


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    pairs += [(i, i + 1) for i in range(1000, 1100)] + [(5000, 2000 + i) for i in range(200)] + [(7, 7), (None, 3), (7, 7)]
    got = {r["node"]: r["component"] for r in
           components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    want = brute.linked({x for p in real for x in p}, real)
    assert got == want
    labels = merge(np.arange(6), np.array([0, 4, 2]), np.array([2, 5, 3]))
    assert labels.tolist() == [0, 1, 0, 0, 4, 4]


def _vectors(rng, n, dim):
    base = rng.normal(size=(n, dim))
    near = base[: n // 3] + rng.normal(size=(n // 3, dim)) * rng.uniform(0.02, 0.3, (n // 3, 1))
    return np.concatenate([base, near, base[:9] * 2.5, base[:4], base[:1].repeat(20, axis=0)]).astype(np.float32)


def _check_vectors(spark, rows, **kw):
    schema = "vec_id long, embedding array<float>, label int, rep long, n long"
    got = near_vectors(spark.createDataFrame([(*r, 1, 2) for r in rows], schema), **kw).collect()
    ok = [k for k, (i, v, lab) in enumerate(rows) if i is not None and v and lab is not None
          and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: 0 for k in range(len(rows))}
    pairs = []
    for a, b in itertools.combinations(ok, 2):
        x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
        if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
            links[a] += 1
            links[b] += 1
            pairs.append((a, b))
    low = {}
    for k, g in brute.linked(range(len(rows)), pairs).items():
        low.setdefault(g, []).append(k)
    group = {k: min((rows[j][0] for j in ks), key=lambda x: (x is None, x)) for ks in low.values() for k in ks}
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=key) == sorted(
        ((r[0], links[k], group[k]) for k, r in enumerate(rows)), key=key)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    return pairs


@pytest.mark.parametrize("cell_rows,chunk", [(1024, 4096), (12, 4096), (12, 16)])
def test_near_vectors(spark, monkeypatch, cell_rows, chunk):
    """One cell, many cells, many cells cut into chunks: the same links."""
    monkeypatch.setattr(metricjoin, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    rows = [(int(i), v.tolist(), int(i) % 2) for i, v in enumerate(_vectors(rng, 120, 6))]
    assert len(_check_vectors(spark, rows, cell_rows=cell_rows)) > 100


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0] * 3, 0),
            (8, [1.0, None, 3.0], 0), (9, [1.0, float("nan"), 3.0], 0), (10, [float("inf"), 2.0, 3.0], 0), (None, v, 0),
            (11, [1.0, 2.0], 0), (12, [-1.0, -2.0, -3.0], 0), (13, [1e-30, 2e-30, 3e-30], 0), (13, [3.0, -2.0, 1.0], 0)]
    _check_vectors(spark, rows)
    _check_vectors(spark, rows[:0])


def _leaks(docs, items, least=0.8):
    sets = {i: {tuple(s) for s in brute.shingle_set((t or "").lower()) if len(s) == 5} for i, t in items}
    out = set()
    for d, t in docs:
        have = brute.shingle_set((t or "").lower())
        out |= {(d, i) for i, s in sets.items() if s and len(have & s) >= least * len(s)}
    return out


def test_leaks(spark, texts):
    """Exact copies at any offset, copies with one edit, short and long items; nothing else."""
    rng = random.Random(9)
    sizes = [5, 6, 9, 10, 11, 14, 15, 19, 22, 37, 59, 140]
    items = [(i, " ".join(make_words(rng, n))) for i, n in enumerate(sizes)]
    odd = [(100, None), (101, ""), (102, "only four words here"), (3, items[3][1])]
    rows = list(texts)
    for k in range(40):
        i, passage = items[k % len(items)]
        around = make_words(rng, rng.randint(0, 60))
        cut = rng.randint(0, len(around))
        rows.append((10_000 + k, " ".join(around[:cut]) + "\n " + passage.upper() + "\t" + " ".join(around[cut:])))
    edited = items[-1][1].split()
    edited[60] = "edited"
    rows += [(20_000, " ".join(make_words(rng, 20) + edited)), (20_001, rows[-1][1]), (20_001, rows[-1][1]),
             (None, items[9][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, item int")
    bench = spark.createDataFrame([(i, t, 5) for i, t in items + odd], "item_id long, text string, share int")
    got = find_leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == _leaks(rows, items)
    assert sum(r["doc_id"] == 20_001 for r in got) == 2 * len({p for p in _leaks(rows, items) if p[0] == 20_001})
    assert (20_000, len(sizes) - 1) in _leaks(rows, items)
    assert all(0.8 <= r["similarity"] <= 1 for r in got)


def test_edited_leaks(spark):
    """Copies with one and two replaced words at every place, items of 15 to 140 words: what brute force accepts."""
    rng = random.Random(11)
    items = [(i, " ".join(make_words(rng, n))) for i, n in enumerate((15, 20, 26, 30, 34, 39, 59, 66, 99, 131, 140))]
    rows = []
    for _, passage in items:
        n = len(passage.split())
        for at in range(n):
            for apart in {0, 1, 7, n // 3, n // 2}:
                words = passage.split()
                words[at] = words[(at + apart) % n] = "edited"
                rows.append((len(rows), " ".join(make_words(rng, at % 9) + words + make_words(rng, 5))))
    want = _leaks(rows, items)
    got = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"),
                     spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) > 2000


def test_leaks_are_in_one_place(spark):
    """Swapped halves and moved words are one place; a passage strewn over a long text is none."""
    rng = random.Random(12)
    words = make_words(rng, 80)
    far = make_words(rng, 100)
    texts = [words[40:] + words[:40], words[:40] + far[:6] + words[40:], words[:40] + far + words[40:],
             (words[:44] + far) * 3, words * 3, words[:20] * 4]
    got = find_leaks(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"),
                     spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()
    assert {r["doc_id"]: round(r["similarity"], 6) for r in got} == {0: round(72 / 76, 6), 1: round(72 / 76, 6), 4: 1.0}


def _shares(docs, items):
    """{(doc, item): highest share of the item's weight in a stretch of its length and four more at either end}."""
    lists = {i: [tuple(w[j:j + 5]) for j in range(len(w) - 4)] for i, t in items if (w := brute.words((t or "").lower()))}
    lists = {i: h for i, h in lists.items() if h}
    df = collections.Counter(x for h in lists.values() for x in set(h))
    weight = {x: math.log1p(len(lists) / n) for x, n in df.items()}
    out = {}
    for d, t in docs:
        w = brute.words((t or "").lower())
        have = [tuple(w[j:j + 5]) for j in range(len(w) - 4)]
        for i, h in lists.items():
            mine, best = set(h), 0.0
            if mine.isdisjoint(have):
                continue
            for s in range(len(have)):
                best = max(best, sum(weight[x] for x in mine.intersection(have[s:s + len(h) + 8])))
            if best >= (0.8 - 1e-12) * sum(weight[x] for x in mine):
                out[d, i] = best / sum(weight[x] for x in mine)
    return out


def test_weighted_shares_in_one_place(spark):
    """Items that share half of their words with all others: rare shingles decide, and similarity is exact."""
    rng = random.Random(21)
    common = make_words(rng, 30)
    items = [(i, " ".join(make_words(rng, 8 + i) + common[:4 + i % 20] + make_words(rng, 3 + i % 7))) for i in range(24)]
    items += [(90, "again " * 12), (91, "one two three four five six seven " * 3)]
    rows = []
    for i, t in items:
        for cut in range(12):
            w = t.split()
            for _ in range(cut % 4):
                at = rng.randrange(len(w))
                if cut < 4:
                    w[at] = "other"
                elif cut < 8:
                    del w[at]
                else:
                    w.insert(at, "more")
            rows.append((len(rows), " ".join(make_words(rng, cut) + w + make_words(rng, 6))))
    got = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"),
                     spark.createDataFrame(items, "item_id long, text string")).collect()
    want = _shares(rows, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(want) and 100 < len(want) < len(rows)
    assert all(r["similarity"] == pytest.approx(want[r["doc_id"], r["item_id"]], abs=1e-6) for r in got)


def test_index_parts_change_nothing(spark, monkeypatch):
    rng = random.Random(22)
    items = [(i, " ".join(make_words(rng, 12 + i))) for i in range(12)]
    rows = [(i, " ".join(make_words(rng, 9)) + " " + t) for i, t in items] + [(50, items[3][1] + " " + items[5][1])]
    frames = (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    whole = sorted(map(tuple, find_leaks(*frames).collect()))
    monkeypatch.setattr(decontaminate, "INDEX_ROWS", 150)
    assert sorted(map(tuple, find_leaks(*frames).collect())) == whole and len(whole) == 14


def test_leaks_of_nothing(docs, empty, spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    assert find_leaks(empty, bench).count() == 0
    assert find_leaks(docs, bench.limit(0)).count() == 0
    assert find_leaks(docs, spark.createDataFrame([(1, "too short")], "item_id long, text string")).count() == 0


def test_leak_plan_runs_no_python(docs, spark):
    bench = spark.createDataFrame([(1, " ".join("abcdefghijklmnop"))], "item_id long, text string")
    plan = find_leaks(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
