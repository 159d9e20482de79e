"""BPE encoding and decoding with a lexicon of frequent words in a minimal acyclic transducer.

Frequent words are counted over all documents and compiled, with the ids they encode to, into an automaton that shares
prefixes and suffixes: it is minimal, its edges add up to the number of the word, and the number leads to the ids. The
automaton is one file of the shared folder that every worker maps into memory. Words it doesn't know are merged
exactly. Decoding looks up every id's bytes.

Counting is lossy counting: a word that a partition holds fewer than FLOOR times isn't reported by it. That can only
leave a rare word out of the lexicon; the ids are the same.

Defined cases: a null text counts as empty and has no ids. Special tokens' strings in a text become their ids, as by
the library. Null ids and repeated rows stay as they are. An empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, texts, written
from .merges import Merges, byte_letters
from .shared_files import pack, read_bytes, unpack, write_bytes
from .words import TOGETHER, Words, _spread, cut_bytes, cut_cased, lowered, word_hashes

#: Words of the lexicon at most, bytes of the longest, and the count that a partition reports from.
LEXICON, LONGEST, FLOOR = 50_000, 32, 4


def count_words(docs: DataFrame, vocabulary_path: str, floor: int = FLOOR) -> DataFrame:
    """(word, n) over all texts of ``docs``: counts by partition, summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.of(vocabulary_path)
        hashes, totals, known = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, f"S{LONGEST}")
        for batch in batches:
            for data, begin, end in _joined(words, batch["text"]):
                short = end - begin <= LONGEST
                begin, end = begin[short], end[short]
                distinct, where, n = np.unique(word_hashes(data, begin, end), return_index=True, return_counts=True)
                raw = data.tobytes()
                some = np.array([raw[a:b] for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)] or [b""], f"S{LONGEST}")[: len(where)]
                merged, at, of = np.unique(np.concatenate([hashes, distinct]), return_index=True, return_inverse=True)
                totals = np.bincount(of, np.concatenate([totals, n]), len(merged)).astype(np.int64)
                hashes, known = merged, np.concatenate([known, some])[at]
        often = totals >= floor
        yield pa.RecordBatch.from_arrays([pa.array(known[often].tolist(), pa.binary()), pa.array(totals[often])], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _joined(words: Words, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in a row, about TOGETHER bytes at a time, and where their words begin and end. Texts that aren't plain are
    cut by the library; those of a vocabulary that changes letters, or with a special token, are left out."""
    some, odd, size = [], [], 0
    for text in [*column, None]:
        value = text.as_py() if text is not None else ""
        if value and words.plain(value):
            some.append(value.encode())
            size += len(some[-1])
        elif value and (pieces := words.pieces(value)) is not None:
            odd += pieces
            size += len(value)
        if text is None or size >= TOGETHER:
            if some:
                data = np.frombuffer(b"".join(some), np.uint8)
                first = np.zeros(len(data), bool)
                first[np.cumsum([0, *map(len, some[:-1])])] = True
                data = lowered(data) if words.cased else data
                yield data, *(cut_cased if words.cased else cut_bytes)(data, first)
            if odd:
                ends = np.cumsum([len(w) for w in odd], dtype=np.int64)
                yield np.frombuffer(b"".join(odd), np.uint8), np.concatenate([[0], ends[:-1]]), ends
            some, odd, size = [], [], 0


def compile_lexicon(words: list[bytes], ids: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The minimal automaton of distinct words and the ids of each.

    ``key`` holds state and byte of every edge in ascending order, ``to`` where it leads and ``add`` how many words
    sort before those beyond it. States are numbered so that equal states are one.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    counts, finals, edges = [], [], []

    def settled(final: bool, out: list[tuple[int, int]]) -> int:
        signature = (final, *out)
        if signature not in register:
            register[signature] = len(counts)
            counts.append(final + sum(counts[to] for _, to in out))
            finals.append(final)
            edges.append(out)
        return register[signature]

    path: list[list] = [[False, []]]  # states of the last word that aren't settled: final, edges
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            final, out = path.pop()
            path[-1][1].append((last[len(path) - 1], settled(final, out)))

    for i in order:
        word = words[i]
        shared = next((k for k, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        settle(shared)
        path += [[False, []] for _ in word[shared:]]
        path[-1][0] = True
        last = word
    settle(0)
    root = settled(*path[0])

    key, to, add = [], [], []
    for state, out in enumerate(edges):
        before = int(finals[state])
        for byte, target in out:
            key.append(state << 8 | byte)
            to.append(target)
            add.append(before)
            before += counts[target]
    ordered = [ids[i] for i in order]
    return {
        "root": np.array([root], "<i8"), "key": np.array(key, "<i8"), "to": np.array(to, "<i4"), "add": np.array(add, "<i4"), "final": np.array(finals, np.uint8),
        "starts": np.concatenate([[0], np.cumsum([len(x) for x in ordered], dtype=np.int64)]).astype("<i8"), "ids": np.concatenate([np.zeros(0, "<u4"), *ordered]).astype("<u4"),
    }


class Lexicon:
    """The mapped automaton. All words are led through it together, a byte of each at a time."""

    def __init__(self, uri: str):
        self.a = unpack(read_bytes(uri))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in the lexicon; -1 for words that aren't in it."""
        a, n = self.a, len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lengths) - lengths
        state, number = np.full(n, a["root"][0], np.int64), np.zeros(n, np.int64)
        out = np.full(n, -1, np.int64)
        live = np.flatnonzero(lengths <= LONGEST) if len(a["key"]) else np.zeros(0, np.int64)
        for depth in range(LONGEST + 1):
            ready = live[lengths[live] == depth]
            ready = ready[a["final"][state[ready]] == 1]
            out[ready] = number[ready]
            live = live[lengths[live] > depth]
            if not len(live):
                break
            key = state[live] << 8 | data[begin[live] + depth]
            at = np.minimum(np.searchsorted(a["key"], key), len(a["key"]) - 1)
            found = a["key"][at] == key
            live, at = live[found], at[found]
            state[live] = a["to"][at]
            number[live] += a["add"][at]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The known words' ids in a row, and where each word's begin; none for others."""
        number = self.numbers(words)
        known = number >= 0
        n = np.zeros(len(words), np.int64)
        n[known] = np.diff(self.a["starts"])[number[known]]
        at = np.where(known, self.a["starts"][np.maximum(number, 0)], 0)
        return self.a["ids"][_spread(at, n)].astype(np.int64), np.concatenate([[0], np.cumsum(n)])


class Decoder:
    """Ids to text as a byte-level vocabulary decodes them, special tokens included."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            file = json.load(source)
        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        by_id = {i: bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode() for token, i in file["model"]["vocab"].items()}
        by_id |= {t["id"]: t["content"].encode() for t in file.get("added_tokens", [])}
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.n = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.n) - self.n
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        ids = ids.astype(np.int64)
        return self.pool[_spread(self.at[ids], self.n[ids])].tobytes().decode("utf-8", "replace")


def frequent_words(counts: DataFrame, size: int) -> list[bytes]:
    """The most frequent words of ``counts`` (word, n), ``size`` if there are as many, without a sort.

    Words are counted by classes of their count, of which there are few hundred. All words of the highest classes come
    to the driver, and of the next one as many as are still missing, those of the least hashes; no other.
    """
    classed = counts.withColumn("level", F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int"))
    total, least, rest = 0, None, []
    for r in classed.groupBy("level").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():
        if total + r["words"] > size:
            rest = classed.where(F.col("level") == r["level"]).orderBy(F.xxhash64("word"), "word").limit(size - total).select("word").collect()
            break
        total, least = total + r["words"], r["level"]
    every = classed.where(F.col("level") >= least).select("word").collect() if least is not None else []
    return sorted(bytes(r["word"]) for r in [*every, *rest])


def build_lexicon(docs: DataFrame, vocabulary_path: str, size: int = LEXICON) -> str:
    """Counts the words of ``docs`` and writes the lexicon of the most frequent, ``size`` at most; returns its file's place."""
    words = frequent_words(written(count_words(docs, vocabulary_path), "word-counts"), size)
    merges = Merges(vocabulary_path)
    flat, starts = merges.encode(words) if words else (np.zeros(0, np.int64), np.zeros(1, np.int64))
    place = new_path(docs.sparkSession, "lexicon")
    write_bytes(place, pack(compile_lexicon(words, np.split(flat.astype("<u4"), starts[1:-1]) if words else [])))
    return place


_decoders: dict[str, Decoder] = {}


def encode_and_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """doc_id, n_tokens, and either digests of ids and decoded text or both themselves (ids, decoded)."""
    source = texts(docs, id_col, text_col)
    place = build_lexicon(source, vocabulary_path)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.of(vocabulary_path, place, lambda: Lexicon(place).encode)
        if vocabulary_path not in _decoders:
            _decoders[vocabulary_path] = Decoder(vocabulary_path)
        decoder = _decoders[vocabulary_path]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few texts at a time: some may be long
                part = batch.slice(at, 64)
                ids = words.encode(part["text"].to_pylist())
                decoded = [decoder.decode(x) for x in ids]
                n = pa.array([len(x) for x in ids], pa.int64())
                if digests:
                    more = [pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string())]
                else:
                    more = [pa.array([x.tolist() for x in ids], pa.list_(pa.int64())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([part["doc_id"], n, *more], names)

    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
    kinds = ["long", "long", *(["string", "string"] if digests else ["array<long>", "string"])]
    return source.mapInArrow(code, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
