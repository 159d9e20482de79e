"""The searches for near texts, held against brute force over Jaccard indexes."""

import numpy as np
import pytest

from glossaria.llm import jaccard, minhash, simhash


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute(texts, similar=0.8, also=()):
    """For each text the least place that chains of links lead to."""
    texts = list(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j])]
    for i, j in [*links, *also]:
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def folded(texts):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in texts]


def edited(rng, words, n):
    out = list(words)
    for i in rng.choice(len(words), n, replace=False):
        out[i] = f"e{rng.integers(0, 10**9)}"
    return out


def copies(rng, count, at):
    """An original at place ``at`` among copies that are near to it, but mostly not to each other."""
    base = [f"w{x}" for x in rng.integers(0, 50_000, 300)]
    out = [" ".join(edited(rng, base, 6)) for _ in range(count)]
    out[at] = " ".join(base)
    return out


def fp_links(texts):
    fps = [simhash.fingerprint(t.encode()) for t in texts]
    return [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]


def got(df, name):
    return [r[name] for r in sorted(df.collect(), key=lambda r: r["doc_id"])]


def test_copies_of_an_original_with_a_middle_id_are_one_group(spark):
    rng = np.random.default_rng(1)
    texts = copies(rng, 60, 31) + [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 200)) for _ in range(5)]
    want = brute(texts, also=fp_links(texts))
    assert len(set(want)) == 6
    assert got(simhash.near_texts(frame(spark, list(enumerate(texts)))), "component_id") == want


def test_texts_without_usable_passages_meet(spark):
    """Anchor words at every fifth place leave no passage; lines that repeat leave few."""
    import xxhash

    rng, rows = np.random.default_rng(2), []
    anchors = [w for w in (f"a{i}" for i in range(20_000)) if xxhash.xxh64_intdigest(w.encode(), 7) % 16 == 0]
    for _ in range(12):
        base = [str(rng.choice(anchors)) if i % 5 == 0 else f"w{rng.integers(0, 50_000)}" for i in range(220)]
        rows += [" ".join(base), " ".join(edited(rng, base, 4))]
    for _ in range(12):
        line = [f"w{x}" for x in rng.integers(0, 50_000, 80)]
        rows += [" ".join(line * 5), " ".join([*line[:40], "edit", *line[41:]] + line[:60] * 2)]
    want = brute(rows, also=fp_links(rows))
    assert len(set(want)) < len(rows) - 12
    assert got(simhash.near_texts(frame(spark, list(enumerate(rows)))), "component_id") == want


def test_near_texts_equal_brute_force_at_any_length(spark):
    rng, rows = np.random.default_rng(3), []
    common = [f"c{x}" for x in range(40)]
    for n in (1, 3, 4, 5, 6, 7, 9, 12, 20, 33, 60, 120, 170, 400, 900):
        for _ in range(4):
            base = [f"w{x}" for x in rng.integers(0, 50_000, n)]
            rows += [" ".join(base), " ".join(edited(rng, base, 1 + n // 60)), " ".join(common + edited(rng, base, n // 40)), " ".join([*common, *base])]
    rng.shuffle(rows)
    assert got(simhash.near_texts(frame(spark, list(enumerate(rows)))), "component_id") == brute(rows, also=fp_links(rows))


def test_links_of_a_text_that_does_not_name_its_simhash_component(spark):
    """0 and 1 have near whole fingerprints, by their repeated line; 2 has the shingles of 1, but once each."""
    rng = np.random.default_rng(4)
    line, one, two = (" ".join(f"w{x}" for x in rng.integers(0, 50_000, 31)) for _ in range(3))
    texts = [" ".join([line] * 200 + [one]), " ".join([line] * 200 + [two]), f"{line} {line} {two}"]
    links = fp_links(texts)
    assert links == [(1, 0)] and brute(texts) == [0, 1, 1]
    assert got(simhash.near_texts(frame(spark, list(enumerate(texts)))), "component_id") == [0, 0, 0]


def test_groups_that_only_their_originals_connect_are_joined(spark):
    """Copies link to their own original first; the two originals, each linked by then, must still meet."""
    rng = np.random.default_rng(5)
    first = copies(rng, 25, 12)
    base = first[12].split()
    second = [" ".join(edited(rng, base, 6))]
    second = [" ".join(edited(rng, second[0].split(), 6)) for _ in range(12)] + second + [" ".join(edited(rng, second[0].split(), 6)) for _ in range(12)]
    texts = first + second
    want = brute(texts, also=fp_links(texts))
    assert len(set(want)) == 1
    assert got(simhash.near_texts(frame(spark, list(enumerate(texts)))), "component_id") == want


def test_near_duplicates_in_groups_of_copies_equal_brute_force(spark):
    rng, texts = np.random.default_rng(6), []
    for count in (40, 25, 60):
        texts += copies(rng, count, count // 2)
    want = brute(texts)
    assert len(set(want)) == 3
    assert got(minhash.near_duplicates(frame(spark, list(enumerate(texts)))), "class_id") == want


def test_no_bucket_goes_through_one_window_group(spark):
    members = spark.createDataFrame([(1, i, 10, 0, 0.0, i) for i in range(50)], "key long, rep long, n long, pos long, own double, root long")
    for pairs in (jaccard._led(members, 0, 0.8), jaccard._across(members, 0.8)):
        assert "Window" not in pairs._jdf.queryExecution().toString()


@pytest.mark.parametrize(("search", "name"), [(minhash.near_duplicates, "class_id"), (simhash.near_texts, "component_id")])
def test_texts_under_repeated_ids_keep_their_links(spark, search, name):
    rng = np.random.default_rng(7)
    x, y = (" ".join(f"w{i}" for i in rng.integers(0, 50_000, 80)) for _ in range(2))
    rows = [(7, x), (7, y), (9, x + " end"), (10, y + " end"), (7, x)]
    out = search(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r[name]) for r in out) == [(7, 7), (7, 7), (7, 7), (9, 7), (10, 7)]
    assert sorted(r["doc_id"] for r in out if r["kept"]) == [7, 7, 7]  # two groups, one of which has a repeated row


def test_near_texts_take_no_account_of_case(spark):
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 50_000, 200)]
    texts = [" ".join(base), " ".join(w.upper() if i % 3 else w for i, w in enumerate(edited(rng, base, 3))), "Ä Ö Ü ä ö ü", "ä ö ü Ä Ö Ü", "A", "a", None]
    want = brute(folded(t or "" for t in texts), also=fp_links(t or "" for t in texts))
    assert want == [0, 0, 2, 3, 4, 4, 6] and brute(t or "" for t in texts)[1] == 1
    assert got(simhash.near_texts(frame(spark, list(enumerate(texts)))), "component_id") == want


def test_pairs_in_a_crowd_that_shares_a_long_passage_are_all_found(spark):
    rng = np.random.default_rng(8)
    common, texts = [f"c{i}" for i in range(240)], []
    for _ in range(400):
        own = [f"w{x}" for x in rng.integers(0, 10**6, 80)]
        texts += [" ".join(common + own), " ".join([*common, *own, "end"])]
    order = rng.permutation(len(texts))
    place = np.argsort(order)  # texts of a pair have ids far apart
    want = {int(i): int(min(place[2 * k], place[2 * k + 1])) for k in range(400) for i in (place[2 * k], place[2 * k + 1])}
    rows = [(i, texts[order[i]]) for i in range(len(texts))]
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()} == want
    links = simhash.near_texts(frame(spark, rows)).select("doc_id", "component_id").collect()
    assert all(r["component_id"] == {r["doc_id"]: r["component_id"] for r in links}[want[r["doc_id"]]] for r in links)


@pytest.mark.parametrize(("range_bytes", "fan"), [(1500, 4)])
def test_ranges_of_shingles_in_several_levels(spark, monkeypatch, range_bytes, fan):
    rng, texts = np.random.default_rng(12), []
    for count in (20, 9):
        texts += copies(rng, count, count // 2)
    texts += ["", "one", "one two three four five", "one two three four five six"] + [" ".join(f"w{x}" for x in rng.integers(0, 300, 150)) for _ in range(40)]
    want = got(simhash.near_texts(frame(spark, list(enumerate(texts)))), "component_id")
    chosen = spark.createDataFrame(list(enumerate(texts)), "rep long, text string").repartition(7)
    one_level = {(r["rep"], r["n"], r["pos"] == 0) for r in jaccard.prefix_keys(chosen).collect()}
    monkeypatch.setattr(jaccard, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(jaccard, "RANGES", fan)
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 3000)
    levels = []
    real = jaccard._kinds
    monkeypatch.setattr(jaccard, "_kinds", lambda rows, more, level=2: levels.append(level) or real(rows, more, level))
    keys = jaccard.prefix_keys(chosen).collect()
    assert max(levels) >= 3 and {(r["rep"], r["n"], r["pos"] == 0) for r in keys} == one_level
    found = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t else set() for t in texts]
    shared = {}
    for r in keys:
        shared.setdefault(r["key"], set()).add(r["rep"])
    for i, a in enumerate(found):
        for j in range(i):
            if a and len(a & found[j]) >= 0.8 * len(a | found[j]):
                assert any({i, j} <= reps for reps in shared.values())
    assert got(simhash.near_texts(frame(spark, list(enumerate(texts)))), "component_id") == want == brute(texts, also=fp_links(texts))


def test_a_templated_crowd_forms_few_pairs(spark):
    """20,000 texts that share a passage of 60 words and have 12 of their own: none is alike to another."""
    rng = np.random.default_rng(13)
    passage = " ".join(f"c{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"w{x}" for x in own)) for i, own in enumerate(rng.integers(0, 10**7, (20_000, 12)))]
    chosen = spark.createDataFrame(rows, "rep long, text string").repartition(8)
    keys = jaccard.written(jaccard.prefix_keys(chosen), "keys")
    crowd = keys.groupBy("key").count().agg({"count": "max"}).first()[0]
    assert crowd > 10_000
    members = keys.withColumn("root", keys["rep"])
    assert jaccard._across(members, 0.8).count() < 20_000


def test_pairs_of_a_bucket_are_those_that_can_be_alike(spark):
    """Pruning by classes of lengths loses no pair that the plain condition lets meet."""
    rng = np.random.default_rng(14)
    rows = [(int(k), i, int(n), int(rng.integers(0, n // 5 + 1)), 0.0, i) for i, (k, n) in enumerate(zip(rng.integers(0, 3, 400), rng.choice([1, 2, 3, 5, 10, 31, 32, 33, 40, 100, 125, 126], 400), strict=True))]
    members = spark.createDataFrame(rows, "key long, rep long, n long, pos long, own double, root long")
    want = {(max(a[1], b[1]), min(a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and min(a[2] - a[3], b[2] - b[3]) >= 0.8 / 1.8 * (a[2] + b[2]) - 1e-6}
    assert {tuple(r) for r in jaccard._across(members, 0.8).collect()} == want and len(want) > 500


def test_bands_of_a_templated_crowd_form_few_pairs(spark, monkeypatch):
    """300 texts that share a passage, and so bands, of which every tenth has a copy; and copies that only their original
    connects. Texts of the crowd meet leaders, but not all each other."""
    rng, counted = np.random.default_rng(15), []
    passage = [f"c{i}" for i in range(60)]
    crowd = [" ".join([*passage, *(f"w{x}" for x in own)]) for own in rng.integers(0, 10**7, (300, 40))]
    texts = crowd + [f"{t} end" for t in crowd[::10]] + copies(rng, 40, 17)
    texts = [texts[i] for i in rng.permutation(len(texts))]
    real = jaccard._alike
    monkeypatch.setattr(jaccard, "_alike", lambda pairs, sets, similar: counted.append(pairs.count()) or real(pairs, sets, similar))
    assert got(minhash.near_duplicates(frame(spark, list(enumerate(texts)))), "class_id") == brute(texts)
    assert sum(counted) < len(texts) ** 2 / 2 / 10
