"""Words are told apart by their bytes: words whose polynomial hashes agree, and hashes that collide on purpose."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from glossaria.llm import lexicon, substring_dedup, words
from glossaria.llm.words import Words

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def thue_morse(n, a, b):
    """The word that collides with its complement (a and b exchanged) under any polynomial modulo a power of two."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join((a, b)[x] for x in bits)


PAIR = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
TEXTS = [f"{x[:k]} {y[:k]} mid {x[:k]}" for k in (8, 9, 64, 199, 200, 201, 2048) for x, y in (PAIR, PAIR[::-1])] + [PAIR[0], PAIR[1]]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_of_words_that_polynomials_confuse(path):
    encoder = words.Words(path)
    for _ in range(2):  # met anew, and remembered
        got = encoder.encode(TEXTS)
        assert [x.tolist() for x in got] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("remembered", [20, 1_500_000])
def test_ids_do_not_depend_on_the_hash(monkeypatch, path, remembered):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(words, "word_hashes", lambda data, begin, end: (end - begin).astype(np.uint64) % np.uint64(3))
    monkeypatch.setattr(words, "REMEMBERED", remembered)
    encoder = words.Words(path)
    for _ in range(3):
        texts = [" ".join(f"w{x}" if x % 7 else "y" * int(x) for x in rng.integers(0, 400, 50)) for _ in range(20)]
        assert [x.tolist() for x in encoder.encode(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_hashes_of_spans_are_those_of_their_bytes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    begin = rng.integers(0, 4500, 3000)
    end = begin + rng.integers(1, 40, 3000)
    for hashes in words.word_hash_pairs(data, begin, end):
        by_bytes = {}
        for h, a, b in zip(hashes.tolist(), begin.tolist(), end.tolist()):
            assert by_bytes.setdefault(data[a:b].tobytes(), h) == h
        assert len(set(by_bytes.values())) == len(by_bytes)
    lanes = words.eights(data)
    assert (words.same_bytes(lanes, begin, end, lanes, begin[::-1], end[::-1]) == [data[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(begin, end, begin[::-1], end[::-1])]).all()


@pytest.mark.parametrize("k", [16, 128, 2048])
def test_windows_that_differ_in_one_such_word(spark, k):
    rest = " ".join(f"r{i}" for i in range(19))
    rows = [(1, f"{PAIR[0][:k]} {rest}"), (2, f"{PAIR[1][:k]} {rest}"), (3, f"x {PAIR[1][:k]} {rest}")]
    one, two, _ = substring_dedup.chunk_windows(pa.table({"text": [t for _, t in rows]}), 20)
    assert one[0] != one[1] and two[0] != two[1]
    got = sorted(tuple(r)[:4] for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(1, 20, 0, rows[0][1]), (2, 20, 0, rows[1][1]), (3, 21, 20, "x")]
    assert got == [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in want]


def test_codes_of_such_words_through_spark(spark):
    rows = list(enumerate(TEXTS))
    tokenizer = words.Words.of(BYTE).tokenizer
    got = {r["doc_id"]: r["ids"] for r in lexicon.encode_and_decode(spark.createDataFrame(rows, "doc_id long, text string"), BYTE, digests=False).collect()}
    assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in rows}


def made_text(rng, n):
    parts = ["it's", "we'll", "naïve", "Straße", "日本語の文章", "русский язык", "العربية", "हिन्दी", "ภาษาไทย", "한국어", "🙂🙃", "e\u0301", "\u200b", "\u3000", "…", "—", "١٢٣", "½", "٣", "x" * 201, "é" * 150, "  ", "\n\n", "\t", " ", "'s", "don't", "123", "a_b", "\x00", "\x85", "\ufeff", "𝔘𝔫𝔦", "<|", "|>"]
    return "".join(rng.choice(parts) + rng.choice(["", " ", "  ", "\n"]) for _ in range(n))


def test_ids_of_every_script_are_the_library_s():
    rng = random.Random(3)
    texts = [made_text(rng, rng.randrange(30)) for _ in range(1500)] + ["<|endoftext|>", "a <|endoftext|> ü's", "", " ", "plain"]
    for path in (BYTE, WORD):
        library, words = Tokenizer.from_file(path), Words(path)
        library.no_truncation(), library.no_padding()
        got = words.encode(texts)
        assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(not Words.of(BYTE).plain(t) for t in texts) > 1000


def test_the_lexicon_meets_words_of_every_script(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["слово", "язык", "日本", "語", "it's", "naïve…", "한국어", "हिन्दी"]) for _ in range(40)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met = [0, 0]
    known = lexicon.Lexicon(lexicon.build_lexicon(docs, BYTE))
    for text in texts:
        numbers = known.numbers(Words.of(BYTE).pieces(text))
        met[0] += int((numbers >= 0).sum())
        met[1] += len(numbers)
    assert met[0] / met[1] > 0.98, met
    library = Tokenizer.from_file(BYTE)
    for r in lexicon.encode_and_decode(docs, BYTE, digests=False).collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["decoded"] == texts[r["doc_id"]]


def test_words_of_equal_count_fill_the_lexicon(spark):
    counts = spark.createDataFrame([(f"w{i}".encode(), 7) for i in range(3000)] + [(b"often", 900)], "word binary, n long")
    found = lexicon.frequent_words(counts, 1000)
    assert len(found) == 1000 and b"often" in found and found == sorted(found)
    assert found == lexicon.frequent_words(counts.repartition(7), 1000) and len(lexicon.frequent_words(counts, 5000)) == 3001
