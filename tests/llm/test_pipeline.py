"""The pipeline's stages on a small corpus, and the operators' SQL."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from glossaria.llm import common, queries
from glossaria.llm import quality as Q
from glossaria.llm.common import written

from test_edges import brute_substrings
from test_near import brute, folded, fp_links

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    ours = queries.QUERIES[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(ours.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, ours.collect()))) == sorted(map(repr, want))


def plain_scores(texts, labelled):
    """The classifier in plain numpy, over all rows at once: statistics, features, ridge weights and isotonic levels."""
    stats = np.array([Q.statistics(t.encode()) for t in texts]).astype(np.float32).astype(np.float64)
    rows, y = np.array([i for i, _ in labelled]), np.array([float(label) for _, label in labelled])
    x = stats[rows]
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.02)
    rng = np.random.default_rng(7)
    frequencies, phases = rng.normal(size=(Q.N_STATISTICS, Q.FOURIER)) / np.sqrt(Q.N_STATISTICS), rng.uniform(0, 2 * np.pi, Q.FOURIER)
    features = lambda s: np.hstack([np.sqrt(2 / Q.FOURIER) * np.cos((s - mean) / scale @ frequencies + phases), np.ones((len(s), 1))])
    z, penalty = features(x), Q.RIDGE * len(y) * np.eye(Q.FOURIER + 1)
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    cell = np.clip(((z @ weights + 0.5) / 2 * Q.BINS).astype(int), 0, Q.BINS - 1)
    cells = np.unique(cell)
    n, ones = np.array([(cell == c).sum() for c in cells]), np.array([y[cell == c].sum() for c in cells])
    rates = (ones + 0.5 * y.mean()) / (n + 0.5)
    levels = [max(min(np.average(rates[a : b + 1], weights=n[a : b + 1] + 0.5) for b in range(k, len(cells))) for a in range(k + 1)) for k in range(len(cells))]  # nearest non-decreasing levels
    raw = features(stats) @ weights
    return np.clip(0.999 * np.interp(raw, (cells + 0.5) / Q.BINS * 2 - 0.5, levels) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def test_stages_equal_plain_python(spark):
    """Every stage on all that its predecessor kept, against the same in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        ids = sorted(before)
        docs = written(stage(spark, docs, SF), name)
        if name == "quality":
            learned = [(k, label[i]) for k, i in enumerate(ids) if label.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1]
            score = dict(zip(ids, plain_scores([before[i] for i in ids], learned)))
            got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op8_quality"](spark, SF).collect()}
            assert max(abs(got[i] - score[i]) for i in ids) < 1e-5
            want = {i: before[i] for i in ids if score[i] >= 0.5}
        elif name == "exact_dedup":
            want = {i: t for t, i in {before[i]: i for i in ids}.items()}
        elif name == "simhash":
            texts = [before[i] for i in ids]
            want = {ids[k]: before[ids[k]] for k in set(brute(folded(texts), also=fp_links(texts)))}
        elif name == "substring_dedup":
            left = brute_substrings(sorted(before.items()))
            want = {i: kept for (i, n, gone, _), kept in zip(left, left_words(sorted(before.items()))) if not gone or gone < n}
            want = {i: before[i] if not n else t for (i, t), n in zip(want.items(), [g for _, n, g, _ in left if not g or g < n])}
        else:
            check_packing(docs.collect(), before)
            continue
        assert {r["doc_id"]: r["text"] or "" for r in docs.collect()} == want and 0 < len(want) <= len(before)
        assert docs.columns == columns


def left_words(rows, window=20):
    seen, out = set(), []
    for _, text in rows:
        words = text.encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out.append(b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


def check_packing(rows, texts):
    """Pieces tile each document's ids and each sequence, and few ids are padding."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[i]) and r["ids_crc32"] == zlib.crc32(ids[i][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[i])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 4096 and {r["padded_length"] for r in pieces} == {at if at & (at - 1) == 0 else 4096}
        padding += pieces[0]["padded_length"] - at
    total = sum(map(len, ids.values()))
    assert padding <= 0.03 * total + 4096


def test_intermediate_tables_go(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    folder = Path(urlparse(common.shared_dir(spark)).path)
    before = set(folder.iterdir()) if folder.exists() else set()
    rows = corpus_pipeline.run(spark, SF).count()
    left = set(folder.iterdir()) - before
    assert rows and len(left) == 1 and next(iter(left)).name.startswith("stage-packing")


def test_a_cluster_needs_a_shared_folder(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "a"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Elsewhere)


def test_near_stage_keeps_one_of_each_group(spark):
    base = [f"word{i}" for i in range(300)]
    edited = [" ".join("x" if i in (40 + k, 170) else w for i, w in enumerate(base)) for k in range(5)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([" ".join(base), *edited, "something else entirely " * 9, None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, docs, SF).collect()) == [0, 6, 7]


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_keep_columns_whose_names_clash(spark):
    """Every name that a stage uses within itself, as a column of the documents, and one with a dot."""
    names = "gone_id text_sha256 component_id keep_id kept stays n_words n_removed kept_sha256 chunk block data other0 guest fp rep sha score label y stats a.b".split()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("*", *(F.col("doc_id").cast("string").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = stage(spark, docs.drop(*names), SF)
        out = written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        assert out.where(" or ".join(f"not (`{n}` <=> cast(doc_id as string))" for n in names)).count() == 0
        assert sorted(map(tuple, out.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
