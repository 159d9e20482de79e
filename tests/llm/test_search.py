"""Operators 11 to 13 against plain Python and numpy, on odd rows too."""

import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from glossaria.llm import language, lexical_search, whitening
from test_edges import CLASHES, ROWS, frame

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def brute_search(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m, score = 100 - 75 + (75 * sum(c.values()) * n_docs) // total, 0
            for t in terms(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(heapq.nsmallest(k, found), 1)]
    return sorted(out, key=repr)


def made_docs(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Über", "日本", "ÀB", "x_y", "A.B", "7"]
    return [(i, " ".join(words[min(len(words) - 1, int(rng.expovariate(0.03)))] for _ in range(rng.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize(("shard", "block"), [(1 << 23, 1 << 20), (900, 60)])
def test_search_equals_brute_force(spark, shard, block):
    docs = [*ROWS, *made_docs(300, 1), (17, "w1 w2"), (17, "w1 w2")]
    items = [(1, "w1 W2 w200 w200 日本 über"), (2, None), (3, ""), (3, "a b c one"), (3, "a b c one"), (None, "lost id w3"), (4, "nowhere"), (5, " ".join(f"w{i}" for i in range(150))), (6, "x x x")]
    rows = frame(spark, docs).repartition(5)
    index = lexical_search.build_index(rows, shard_bytes=shard)
    got = lexical_search.search(index.persist(), frame(spark, items, "item_id"), 10, query_bytes=block)
    want = brute_search(docs, items, 10)
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) > 40
    none, some = frame(spark, []), frame(spark, items, "item_id")
    for a, b in ((none, some), (rows, frame(spark, [], "item_id")), (frame(spark, [(1, None), (2, "!?")]), some)):
        assert lexical_search.lexical_search(a, b).count() == 0
    index.unpersist()


def test_terms_whose_hashes_are_equal_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "word_hashes", lambda data, begin, end: (end - begin).astype(np.uint64))
    docs = made_docs(60, 2)
    ids, texts = [i for i, _ in docs], [t.encode() for _, t in docs]
    _, _, raw, _ = lexical_search.index_shard(ids, texts)
    lexicon, words = lexical_search.Lexicon(raw), sorted({t.encode() for _, text in docs for t in terms(text)})
    df = Counter(t.encode() for _, text in docs for t in set(terms(text)))
    places = dict(lexicon.places([*words, b"zz"], np.array([len(w) for w in [*words, b"zz"]], np.uint64)))
    assert {words[i]: int(lexicon.a["df"][p]) for i, p in places.items()} == df


def test_varints():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**48 + 5, 7])
    data, ends = lexical_search.to_varints(values)
    assert lexical_search.from_varints(data).tolist() == values.tolist() and ends[-1] == len(data) and ends[:4].tolist() == [1, 2, 3, 5]


def test_merge_leaves_no_better_document_out():
    rng = random.Random(5)
    for _ in range(200):
        lists, want = [], Counter()
        for _ in range(rng.randrange(1, 7)):
            docs = sorted(rng.sample(range(80), rng.randrange(1, 80)))
            gained, times = [rng.randrange(rng.choice([2, 9, 100])) for _ in docs], rng.randrange(1, 3)
            lists.append((docs, gained, max(gained), times))
            for d, g in zip(docs, gained, strict=True):
                want[d] += g * times
        best = [(rng.randrange(40), -1000 - i) for i in range(rng.randrange(4))]
        heapq.heapify(best)
        every = [*best, *((s, -d) for d, s in want.items() if s > 0)]
        lexical_search.merge(lists, [-d for d in range(80)], best, 3)
        assert sorted(best) == sorted(heapq.nlargest(3, every))


def numpy_whitening(vectors, k=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    d = n * x - sums
    c = (d / n).astype(float)
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    return d, c @ axes / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(c.T @ c / n)


def vector_frame(spark, rows):
    kinds = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), *(T.StructField(c, T.StringType()) for c in CLASHES)])
    return spark.createDataFrame([(*r, *["?"] * len(CLASHES)) for r in rows], kinds)


@pytest.mark.parametrize(("dims", "k", "scale"), [(6, 3, 1.0), (48, 32, 0.2), (5, 32, 1.0), (3, 2, 1e12)])
def test_whitening_equals_numpy(spark, dims, k, scale):
    rng = np.random.default_rng(dims)
    good = [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(rng.normal(size=(200, dims)) * scale * np.linspace(1, 2, dims))]
    good += [(None, good[0][1]), (3, good[3][1]), (7, good[9][1])]
    odd = [(900, None), (901, [None] * dims), (902, [float("nan")] * dims), (903, [float("inf")] * dims), (904, [1.0]), (905, []), (906, [-float("inf"), *[0.0] * (dims - 1)]), (907, [3e38] * dims)]
    got = whitening.whiten(vector_frame(spark, good + odd).repartition(4), k).collect()
    deviations, want, explained = numpy_whitening([v for _, v in good], k)
    assert len(got) == len(good) * min(k, dims) and {r["n"] for r in got} == {len(good)} and max(r["identity_error"] for r in got) < 1e-9
    exact = {i: sum(int(x) ** 2 for x in row) for (i, _), row in zip(good, deviations, strict=True)}
    by = {(i, j + 1): row[j] for (i, _), row in zip(good, want, strict=True) for j in range(len(row))}
    signs = {}
    for r in got:
        if r["vec_id"] in (7,):
            continue  # two vectors under one id
        assert r["deviation"] == (exact[r["vec_id"]] if exact[r["vec_id"]] < 1 << 63 else None)
        w = by[r["vec_id"], r["component"]]
        sign = signs.setdefault(r["component"], 1 if r["whitened"] * w >= 0 else -1) if abs(w) > 1e-3 else signs.get(r["component"])
        assert sign is None or abs(sign * r["whitened"] - w) < 1e-7
        assert abs(r["explained"] - explained[r["component"] - 1]) < 1e-9
    assert [r["vec_id"] for r in got].count(None) == min(k, dims)


def test_whitening_without_variance(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)]):
        assert whitening.whiten(vector_frame(spark, rows)).count() == 0
    plane = [(i, [float(i % 7), float(i % 3), float(i % 7 + i % 3)]) for i in range(50)]  # the third entry adds nothing
    assert {r["component"] for r in whitening.whiten(vector_frame(spark, plane)).collect()} == {1, 2}


def test_subspace_iteration_certifies_every_component(spark):
    rng = np.random.default_rng(3)
    steep = [(i, [float(x) for x in row]) for i, row in enumerate(rng.normal(size=(400, 40)) * 50 * 0.5 ** np.arange(40))]
    vectors, d = whitening.usable(vector_frame(spark, steep))
    found = whitening.moments(vectors, d)
    values, axes, trace, passes = whitening.components(vectors, found, 3, 3)
    covariance = np.stack([whitening.product(vectors, found, np.eye(d))[0]])[0]
    assert np.abs(covariance @ axes - axes * values).max() <= 1e-11 * values[0] and 3 <= passes < 40 and abs(trace - np.trace(covariance)) < 1e-6 * trace


def test_languages(spark):
    heads = {"en": "the house of this and that with some words there", "de": "das haus und der weg nicht schön über alle", "xx": "日本語 の テスト です"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.sample(heads[lang].split(), 4)), lang) for i in range(300) for lang in [rng.choice(["en", "de", "xx"])]]
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "123 !? 45", "en"), (None, "the house of words", "zz"), (1003, "das haus und der weg", None), (1004, "THE HOUSE of that퟿", None), (5, rows[5][1], rows[5][2]), (1005, "über " * 400_000, None)]
    frames = frame(spark, [(i, t, c) for i, t, c in rows + odd], columns=("text", "lang")).repartition(3)
    got = language.languages(frames).collect()
    assert len(got) == len(rows + odd) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [by[i] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[None] == "en" and by[1003] == "de" and by[1004] == "en" and by[1005] == "de"
    assert sum(by[i] == lang for i, _, lang in rows) >= 0.99 * len(rows)
    assert language.languages(frame(spark, [], columns=("text", "lang"))).count() == 0
    unlabelled = language.languages(frame(spark, [(1, "some words", None)], columns=("text", "lang"))).first()
    assert (unlabelled["lang_pred"], unlabelled["score"]) == ("und", 0.0)
    only = language.languages(frame(spark, [(i, "some words", "en") for i in range(20)], columns=("text", "lang"))).first()
    assert (only["lang_pred"], only["score"]) == ("en", 1.0)


def test_labels_of_held_out_rows_and_null_ids_teach_nothing(spark):
    rows = [(i, "the house" if i % 2 else "das haus", "en" if i % 2 else "de") for i in range(200)]
    wrong = [(i, t, c if zlib.crc32(str(i).encode()) % 5 else "qq") for i, t, c in rows] + [(None, "the house", "qq")] * 50
    model = language.fit(spark.createDataFrame(wrong, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"] and model.predict("the house")[0] == "en"


def test_counts_of_long_texts_are_those_of_their_parts(monkeypatch):
    text = " ".join(f"Wörter{i} ünd 日本 — mehr!" for i in range(300))
    whole = language.counts(text)
    monkeypatch.setattr(language, "TOGETHER", 500)
    parts = language.counts(text)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True)) and whole[1].sum() > 4 * 300


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_temperature_calibrates():
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 3, 4000)
    logits = rng.normal(size=(4000, 3))
    truth = np.array([rng.choice(3, p=language.softmax(x)) for x in logits])
    assert abs(language.temperature(logits * 4, truth) - 4) < 0.5 and language.temperature(logits, labels) > 5


def test_the_l1_penalty_makes_weights_sparse(monkeypatch):
    kept = []
    for penalty in (0.0, 0.02, 0.2):
        monkeypatch.setattr(language, "L1", penalty)
        leader, rng = language.Leader(np.zeros((language.BUCKETS + 1, 2)), np.zeros((language.BUCKETS + 1, 2))), np.random.default_rng(0)
        for _ in range(500):
            label = int(rng.integers(2))
            at = np.unique(np.append(rng.integers(100, 5000, 40), label))
            leader.learn(np.append(at, language.BUCKETS), np.append(np.full(len(at), 0.15), 1), label)
        w = leader.weights()
        assert w[0, 0] > 0.5 and w[1, 1] > 0.5
        kept.append((w[100:5000] != 0).mean())
    assert kept[0] > kept[1] > 2 * kept[2]
