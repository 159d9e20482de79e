"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

A document's statistics are shares and ratios of its whole text. Random Fourier features approximate a Gaussian
kernel over them; each partition of the labelled rows sums its normal equations, the driver adds a bounded number of
such sums and solves for the ridge weights; a histogram of the raw scores gives the isotonic calibration.

Defined cases: a null text counts as empty; an empty text has statistics of zero and gets the score that follows from
them. Rows without a label, or with one other than 0 or 1, are scored but not learned from. With no labelled row at
all every score is 0.5. Null ids are scored and are never learned from. Repeated rows are all scored, and repeated
labels all count. Labels, language, source and id never enter a score. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written

#: Bounds of the fit: labelled rows that are learned from, partitions that they are summed in, Fourier features.
FIT_ROWS, FIT_PARTITIONS, FOURIER, RIDGE, BINS = 500_000, 32, 192, 1e-4, 512

_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\t\n\x0b\x0c\r", b".,;:", b"!", b"?", b"|", b"#$%&*", b"+=<>@^_~/\\`", b"()[]{}", b"'\"-"]
_MEMBER = np.zeros((256, len(_GROUPS) + 1))
for _i, _g in enumerate(_GROUPS):
    _MEMBER[list(_g), _i] = 1
_MEMBER[128:, -1] = 1
N_STATISTICS = len(_GROUPS) + 1 + 9


def statistics(text: bytes) -> np.ndarray:
    """Numbers of between 0 and about 2 that describe the whole text."""
    out = np.zeros(N_STATISTICS)
    n = len(text)
    if not n:
        return out
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _MEMBER / n
    out[: len(shares)] = np.sqrt(shares)
    words, at = text.split(), len(shares)
    if words:
        distinct = len(set(words))
        lines = text.split(b"\n")
        letters = sum(map(bytes.isalpha, words))
        out[at:] = (
            np.log1p(len(words)) / 8,
            distinct / len(words),
            np.log1p(distinct) / np.log1p(len(words)),
            sum(map(eq, words, words[1:])) / len(words),
            min(2.0, (n / len(words)) / 10),
            letters / len(words),
            sum(map(bytes.isupper, words)) / len(words),
            len(set(lines)) / len(lines),
            sum(len(w) == 1 for w in words) / len(words),
        )
    return out


def statistics_of(column: pa.Array) -> np.ndarray:
    whole = column.cast(pa.large_binary())
    return np.array([statistics(x.as_py() or b"") for x in whole]).reshape(-1, N_STATISTICS)


@dataclass
class Model:
    """What a fit has learned; small, and the same whatever the size of the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale, self.frequencies, self.phases)

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated likelihood of label 1. A thousandth follows the raw score, so that the calibration's steps keep its order."""
        raw = self.fourier(stats) @ self.weights
        return np.clip(0.999 * np.interp(raw, self.knots, self.levels) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def fourier(x: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    z = np.cos(x @ frequencies + phases) * np.sqrt(2 / len(phases))
    return np.hstack([z, np.ones((len(x), 1))])


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing levels nearest to ``values`` in weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics, from one pass over the texts."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics_of(batch["text"]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), N_STATISTICS).cast(pa.list_(pa.float32()))], ["doc_id", "stats"])

    return docs.mapInArrow(compute, "doc_id long, stats array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, N_STATISTICS).astype(np.float64)


def held_out(doc_id):
    """Rows whose crc32 of the id, as text, leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnable(labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id and y of the labels that aren't held out: all of them, or an even sample of about ``fit_rows``."""
    usable = labels.select("doc_id", F.col(label).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0)).where(~held_out(F.col("doc_id")))
    n = usable.count()
    if n > fit_rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(fit_rows / n * (1 << 20)))
    return usable


def fit(stats: DataFrame, usable: DataFrame) -> Model:
    """Learns from the rows of ``stats`` that ``usable`` has labels for."""
    # The labels are bounded by about fit_rows, so they go to the statistics, which stay where they are.
    rows = written(stats.join(F.broadcast(usable), "doc_id").select("y", "stats"), "labelled")
    rng = np.random.default_rng(7)
    frequencies, phases = rng.normal(size=(N_STATISTICS, FOURIER)) / np.sqrt(N_STATISTICS), rng.uniform(0, 2 * np.pi, FOURIER)

    moments = rows.select("y", F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    blank = np.zeros(FOURIER + 1)
    if not moments:
        blank[-1] = 0.5
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), frequencies, phases, blank, np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    mean, scale = np.array([r["m"] for r in moments]), np.array([max(r["s"], 0.02) for r in moments])
    model = Model(mean, scale, frequencies, phases, blank, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each partition: the sums of z zᵀ and z y."""
        gram = np.zeros((FOURIER + 1, FOURIER + 2))
        for batch in batches:
            z, y = model.fourier(_matrix(batch["stats"])), batch["y"].to_numpy()
            gram += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary())], ["gram"])

    total = sum(np.frombuffer(r["gram"]).reshape(FOURIER + 1, FOURIER + 2) for r in rows.repartition(FIT_PARTITIONS).mapInArrow(normal_equations, "gram binary").collect())
    penalty = RIDGE * total[-1, -2] * np.eye(FOURIER + 1)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])

    def raw_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.fourier(_matrix(batch["stats"])) @ model.weights
            cell = np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch["y"]], ["cell", "y"])

    cells = rows.mapInArrow(raw_scores, "cell long, y double").groupBy("cell").agg(F.sum("y").alias("ones"), F.count("y").alias("n")).orderBy("cell").collect()
    at = (np.array([r["cell"] for r in cells]) + 0.5) / BINS * 2 - 0.5
    ones, n = np.array([r["ones"] for r in cells]), np.array([float(r["n"]) for r in cells])
    prior = ones.sum() / n.sum()
    model.knots, model.levels = at, pool_adjacent((ones + 0.5 * prior) / (n + 0.5), n + 0.5)
    return model


def scores(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for rows of ``document_statistics``."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(_matrix(batch["stats"])))], ["doc_id", "score"])

    out = stats.mapInArrow(judge, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    stats = written(document_statistics(texts(docs)), "statistics")
    return scores(stats, fit(stats, learnable(labels)))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose own text scores at least ``threshold``."""
    usable = learnable(labels)
    # Statistics are taken of labelled texts here, and of every text where it is judged, without keeping them.
    labelled = texts(docs).join(F.broadcast(usable.select("doc_id").distinct()), "doc_id", "left_semi")
    model = fit(document_statistics(labelled), usable)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(statistics_of(batch.column(text))) >= threshold))

    text = docs.columns.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # mapInArrow takes no names with dots
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
