"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained with FTRL.

A text's letters, lower-cased, with one blank for anything between them, give n-grams of one to four characters, hashed to
BUCKETS features. Document frequencies are counted over all texts that may be learned from. The weights are learned by
follow-the-regularised-leader with elastic-net penalties from a bounded sample: in each round every shard of it runs
through the whole sequence of its texts from the state of the round before, and the shards' states are averaged. The L1
penalty leaves most weights at zero. Last, a temperature is fitted on texts that the weights weren't learned from.

Bounds of the fit: at most about FIT_ROWS texts of each language, and the LANGUAGES most frequent values of lang.

Defined cases: a text that is null or has no letter is ``und`` with score 0, is scored whatever its id, and is never
learned from. Rows with a null id or lang are not learned from; a null id isn't held out. With nothing to learn from all
are ``und``; with one language it gets all texts that have letters. Repeated rows all count. Extra columns are not looked at.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Features, sizes of n-grams, and the parts of a text that are taken up at a time (characters).
BUCKETS, SIZES, TOGETHER = 1 << 16, (1, 2, 3, 4), 1 << 20
#: Bounds of the fit, shards that learn side by side and rounds; one text in CALIBRATION serves the temperature alone.
FIT_ROWS, LANGUAGES, SHARDS, ROUNDS, CALIBRATION = 1000, 500, 8, 3, 5
#: FTRL: learning rate, its delay, and the L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.01
UNKNOWN = "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)


@cache
def _kinds() -> np.ndarray:
    """2 for letters, 1 for marks that belong to letters, 0 for all other characters."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text and how often each occurs; none where it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[points]
    if not (kinds == 2).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = kinds > 0
    keep = letter | np.concatenate([[True], letter[:-1]])  # the first of the others between letters
    letters = np.concatenate([[32], np.where(letter, points, 32)[keep], [32]]).astype(np.uint64)
    total = np.zeros(BUCKETS, np.int64) if len(letters) > TOGETHER else None
    for at in range(0, len(letters), TOGETHER):
        part, rolled, hashed = letters[at : at + TOGETHER + max(SIZES) - 1], np.zeros(0, np.uint64), []
        for size in SIZES[: len(part)]:
            n = len(part) - size + 1
            rolled = part + _ODD if size == 1 else rolled[:n] * _ODD + part[size - 1 :]
            hashed.append((rolled[:TOGETHER] * _ODD >> np.uint64(48)).astype(np.uint16))
        grams = np.sort(np.concatenate(hashed), kind="stable")
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        found, n = grams[first].astype(np.int64), np.diff(first, append=len(grams))
        if total is not None:
            total[found] += n
    if total is None:
        return found, n
    found = np.flatnonzero(total)
    return found, total[found]


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id, as text, leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Leader:
    """Follow-the-regularised-leader, with its own step size for each weight."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full((len(z), 1), L1)
        l1[(np.arange(len(self.z))[at]) == BUCKETS] = 0  # the intercept's
        return np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(values @ w)
        p[label] -= 1
        g = values[:, None] * p
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[at] = more


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    """What a fit has learned, of a bounded size: languages, idf of the features, weights, temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def values(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """TF-IDF of length 1 (the logarithm of the occurrences, plus 1), and the intercept's 1."""
        x = (1 + np.log(n)) * self.idf[at]
        return np.append(x / np.sqrt(x @ x), 1)

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.values(at, n) @ self.weights[np.append(at, BUCKETS)]

    def predict(self, text: str | None) -> tuple[str, float]:
        at, n = counts(text)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(at, n) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """By which logits are divided so that the labels are likeliest; between 1/20 and 20."""

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()

    low, high = -np.log(20), np.log(20)
    for _ in range(60):
        a, b = high - (high - low) * 0.618, low + (high - low) * 0.618
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _features(docs: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Of each task the number of its texts and of those that hold each feature (df), and the features of the sample."""
    level = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20))
    limits = F.from_json(F.lit(json.dumps({k: int(v * (1 << 20)) for k, v in shares.items()})), "map<string,int>")
    rows = docs.select("lang", "text", F.coalesce(level < F.element_at(limits, F.col("lang")), F.lit(False)).alias("chosen"), F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(SHARDS * CALIBRATION)).cast("int").alias("part"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, texts = np.zeros(BUCKETS, "<i8"), 0
        for batch in batches:
            some = []
            for lang, text, chosen, part in zip(*(batch[c] for c in ("lang", "text", "chosen", "part")), strict=True):
                at, n = counts(text.as_py())
                df[at] += 1
                texts += bool(len(at))
                if chosen.as_py() and len(at):
                    some.append((0, lang.as_py(), part.as_py(), at.astype("<u2").tobytes(), n.astype("<u4").tobytes()))
            yield rows_of(some)
        yield rows_of([(texts, None, None, df.tobytes(), None)])

    def rows_of(rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["texts", "lang", "part", "at", "n"])

    return rows.mapInArrow(work, "texts long, lang string, part int, at binary, n binary")


def _pair(at: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(n, "<u4").astype(np.int64)


def _frequencies(features: DataFrame) -> tuple[int, np.ndarray]:
    """Texts, and how many of them hold each feature: each task's numbers are added up by Spark, feature by feature."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for raw in batch["at"]:
                df += np.frombuffer(raw.as_py(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS), pa.int32()), pa.array(df)], ["at", "df"])

    totals = features.where("lang is null")
    texts = totals.agg(F.sum("texts")).first()[0] or 0
    df = np.zeros(BUCKETS)
    for r in totals.select("at").mapInArrow(spread, "at int, df long").groupBy("at").agg(F.sum("df").alias("df")).where("df > 0").collect():
        df[r["at"]] = r["df"]
    return texts, df


def _round(model: Model, number: dict[str, int], state: np.ndarray, turn: int) -> Callable[[pa.Table], pa.Table]:
    """Runs through a shard's texts in an order of its own, from ``state``, and returns the state of what it has met."""

    def learn(rows: pa.Table) -> pa.Table:
        leader = Leader(*state.copy())
        texts = sorted(zip(*(rows[c].to_pylist() for c in ("lang", "at", "n")), strict=True))
        for i in np.random.default_rng(turn).permutation(len(texts)).tolist():
            at, n = _pair(*texts[i][1:])
            leader.learn(np.append(at, BUCKETS), model.values(at, n), number[texts[i][0]])
        moved = np.stack([leader.z, leader.n])
        some = np.flatnonzero(moved[1].any(axis=1))
        return pa.table([pa.array([some.astype("<i4").tobytes()], pa.binary()), pa.array([moved[:, some].tobytes()], pa.binary())], names=["at", "state"])

    return learn


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from the rows (doc_id, text, lang) that aren't held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    features = written(_features(usable, {r["lang"]: min(1.0, fit_rows / r["n"]) for r in known}), "language-features")
    texts, df = _frequencies(features)
    sample = features.where("lang is not null")
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # of at most LANGUAGES
    model = Model(languages, np.log((texts + 1) / (df + 1)) + 1, np.zeros((BUCKETS + 1, len(languages))))
    if len(languages) < 2:
        return model
    number = {lang: i for i, lang in enumerate(languages)}
    shards = sample.where(F.col("part") % CALIBRATION > 0).withColumn("shard", F.floor(F.col("part") / CALIBRATION).cast("int"))
    state = np.zeros((2, BUCKETS + 1, len(languages)))
    for turn in range(ROUNDS):
        learned = shards.groupBy("shard").applyInArrow(_round(model, number, state, turn), "at binary, state binary").collect()  # SHARDS rows
        state = np.zeros_like(state)
        for r in learned:
            at = np.frombuffer(r["at"], "<i4")
            state[:, at] += np.frombuffer(r["state"]).reshape(2, len(at), -1) / len(learned)
    model.weights = Leader(*state).weights()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.logits(*_pair(at.as_py(), n.as_py())).tolist() for at, n in zip(batch["at"], batch["n"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(found, pa.list_(pa.float64()))], ["lang", "logits"])

    judged = sample.where(F.col("part") % CALIBRATION == 0).select("lang", "at", "n").mapInArrow(judge, "lang string, logits array<double>").collect()
    if judged:
        model.temperature = temperature(np.array([r["logits"] for r in judged]), np.array([number[r["lang"]] for r in judged]))
    return model


def languages(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row; without a ``model`` one is fitted to ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.col(lang_col).alias("lang")] if model is None else []))
    judge = model or fit(rows)
    present = np.flatnonzero(judge.weights.any(axis=1))
    weights = judge.weights[present].astype(np.float32)
    judge = Model(judge.languages, judge.idf, np.zeros((0, 0)), judge.temperature)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge.weights = np.zeros((BUCKETS + 1, len(judge.languages)), np.float32)
        judge.weights[present] = weights
        for batch in batches:
            found = [judge.predict(text.as_py()) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    out = rows.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
