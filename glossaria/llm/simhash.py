"""SimHash near-dedup over a forest of vantage-point trees.

Fingerprints: words are runs of anything but ASCII white space, A-Z lower-cased; shingles of three words, repeats
included, hashed by XXH64 with seed 42; a bit is set where over half of the hashes have it.

Search for all pairs within r bits. The 64 bits are cut into t disjoint masks, one tree each. Distance under a mask
is a metric that never exceeds the whole distance, and a pair within r bits is within floor(r / t) bits under some
mask. So tree by tree, fingerprints are partitioned by their masked Hamming distance to vantage points, and by the
triangle inequality a fingerprint at distance d only has to query shards that overlap [d - floor(r/t), d + floor(r/t)].
With t = 3 and r = 2 that margin is 0: every branch but one is pruned. With fewer trees the boundary-overlapping
shards are queried. Inside a shard a vantage-point tree over the whole distance finds the pairs, pruned by the same
bound; shards of more than LEAF fingerprints go an exact way that needs no large group.

Defined cases: a null text counts as empty. No words: fingerprint zero, which links like any other; fewer words than
a shingle: the whole sequence is the one shingle. Repeated rows and texts share a fingerprint and so a component.
Null ids get a component like any other row, named by its smallest id that isn't null (null if there is none).
Empty tables give empty results. Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_classes, settled, texts, written
from .components import components
from .jaccard import SIMILAR, bucket_links, distinct_texts, least_ids, prefix_keys, with_digest

SHINGLE, BITS, TREES = 3, 2, 3
#: Fingerprints that a shard aims at, and the most that one task compares.
SHARD, LEAF = 500, 8192

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SLICE = 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    first, last = starts[:n].tolist(), ends[shingle - 1 :].tolist()
    for at in range(0, n, _SLICE):  # a very long text needs no more memory than others
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(first[at : at + _SLICE], last[at : at + _SLICE], strict=True)], np.uint64)
        ones += bit_sums(hashes)
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest bit first. Adds bytes in words of eight counters, where that pays."""
    if len(hashes) <= 1500:
        return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    out, ones = np.zeros(64, np.int64), np.uint64(0x0101010101010101)
    for at in range(0, len(hashes), 255 * 64):
        part = hashes[at : at + 255 * 64]
        for shift in range(8):
            lanes = (part >> np.uint64(shift)) & ones  # one bit of each of the eight bytes
            sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255)).astype("<u8")
            per_byte = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)  # byte 0 is the lowest
            out[[63 - 8 * b - shift for b in range(8)]] += per_byte
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed integer."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py() or b"", shingle) for x in batch["text"].cast(pa.large_binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(compute, "doc_id long, fp long")


def masks(trees: int) -> list[int]:
    """Disjoint masks that cover the 64 bits."""
    cuts = [64 * i // trees for i in range(trees + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def vantage_points(n: int, count: int, bits: int) -> int:
    """How many vantage points bring ``count`` fingerprints down to shards of about SHARD.

    Distances to the first tell about three bits apart and to each more about two (their parities agree).
    """
    return max(1, min(bits, math.ceil((math.log2(max(count, 2) / n) - 3) / 2) + 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _crossed(leaves, shards):
    """Every path of ``leaves`` followed by each of ``shards``; the own path stays first."""
    return F.flatten(F.transform(leaves, lambda path: F.transform(shards, lambda x: F.concat(path, F.array(x)))))


def _leaf_rows(leaves, tree: int):
    return F.transform(leaves, lambda path, i: F.struct(F.lit(tree).alias("tree"), F.xxhash64(path).alias("leaf"), (i > 0).alias("guest")))


def placed(points: DataFrame, count: int, bits: int = BITS, trees: int = TREES, shard: int = SHARD) -> DataFrame:
    """(tree, leaf, fp, guest) for points (fp): its own shard in each tree, and as a guest those its query overlaps."""
    margin, rng = bits // trees, np.random.default_rng(11)
    width = 1 if margin == 0 else 4 * margin
    per_tree = []
    for t, mask in enumerate(masks(trees)):
        each = []
        for _ in range(vantage_points(shard, count, bin(mask).count("1"))):
            point = int(rng.integers(0, 1 << 64, dtype=np.uint64)) & mask
            d = F.bit_count(F.col("fp").bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.lit(_signed(point)))).cast("int")
            low, own, high = (F.floor((d + x) / width).cast("int") for x in (-margin, 0, margin))
            each.append(F.array(own) if margin == 0 else F.array_distinct(F.array(own, low, high)))
        leaves = F.transform(each[0], lambda x: F.array(x))
        for more in each[1:]:
            leaves = _crossed(leaves, more)
        per_tree.append(_leaf_rows(leaves, t))
    return points.select("fp", F.explode(F.flatten(F.array(*per_tree))).alias("p")).select("p.tree", "p.leaf", "fp", "p.guest")


def near_pairs(x: np.ndarray, y: np.ndarray | None, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within ``bits``, of x with itself or of x with y, in blocks. A vantage-point tree: what the triangle
    inequality shows to be farther apart is never compared."""
    if y is None:
        if len(x) <= 256:
            yield from _compared(x, x, bits, True)
            return
        d = np.bitwise_count(x ^ x[0]).astype(np.int64)
        middle = int(np.median(d))
        inner, outer = d <= middle, d > middle
        if inner.all() or not inner.any():
            yield from _compared(x, x, bits, True)
            return
        yield from near_pairs(x[inner], None, bits)
        yield from near_pairs(x[outer], None, bits)
        yield from near_pairs(x[inner & (d > middle - bits)], x[outer & (d <= middle + bits)], bits)
    elif len(x) and len(y):
        if min(len(x), len(y)) <= 256:
            yield from _compared(x, y, bits, False)
            return
        dx, dy = (np.bitwise_count(part ^ x[0]).astype(np.int64) for part in (x, y))
        for band in np.unique(dx):
            near = y[np.abs(dy - band) <= bits]
            if len(near):
                yield from _compared(x[dx == band], near, bits, False)


def _compared(x: np.ndarray, y: np.ndarray, bits: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a in range(0, len(x), 1024):
        for b in range(a if same else 0, len(y), 1024):
            i, j = np.nonzero(np.bitwise_count(x[a : a + 1024, None] ^ y[None, b : b + 1024]) <= bits)
            if same and a == b:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield x[a : a + 1024][i], y[b : b + 1024][j]


def spanning(points: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Links to the least point of its component for every other point of ``points`` (sorted) that has a pair.

    They connect what the pairs connect, and are fewer than the points however many pairs there are.
    """
    label = np.arange(len(points))
    for a, b in pairs:
        i, j = np.searchsorted(points, a), np.searchsorted(points, b)
        while True:
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            label = label[label]
            if (label == before).all():
                break
    while (label != label[label]).any():
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(points)))
    return np.stack([points[moved], points[label[moved]]])


def links(points: DataFrame, count: int, bits: int = BITS, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """Links (a, b) that connect all ``points`` (fp, distinct) within ``bits``, through chains of near points too."""
    shards = placed(points, count, bits, trees)
    sizes = shards.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"))
    large = written(sizes.where(F.col("n") > leaf), "large-shards")
    small = shards.join(large, ["tree", "leaf"], "left_anti")

    def search(rows):
        own = rows["fp"].to_numpy().view(np.uint64)
        guest = rows["guest"].to_numpy(zero_copy_only=False)
        home, visit = np.unique(own[~guest]), np.unique(own[guest])
        both = np.union1d(home, visit)

        def pairs():
            yield from near_pairs(home, None, bits)
            yield from near_pairs(home, visit, bits)

        a, b = spanning(both, pairs())
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    found = small.groupBy("tree", "leaf").applyInArrow(search, "a long, b long")
    crowded = shards.join(large, ["tree", "leaf"], "left_semi").select("fp").distinct()
    return found.unionByName(_crowded_links(crowded, bits))


def _crowded_links(points: DataFrame, bits: int) -> DataFrame:
    """The exact way for crowded shards: two points within 2r bits have a common point within r bits of each.

    Every point names the balls of that radius it lies in; for an even number of bits the points of a ball link to its
    least. For an odd number the next larger radius is needed, whose pairs are then compared one by one.
    """
    radius = (bits + 1) // 2
    flips = [0]
    for _ in range(radius):
        flips = sorted({f ^ (1 << i) for f in flips for i in range(64)} | set(flips))
    balls = points.select("fp", F.explode(F.array(*(F.lit(_signed(f)) for f in flips))).alias("flip")).select("fp", F.expr("fp ^ flip").alias("ball"))
    if bits % 2 == 0:
        least = balls.groupBy("ball").agg(F.min("fp").alias("b"))
        return balls.join(least, "ball").select(F.col("fp").alias("a"), "b").where("a <> b").distinct()
    other = balls.select("ball", F.col("fp").alias("b"))
    return balls.withColumnRenamed("fp", "a").join(other, "ball").where((F.col("a") > F.col("b")) & (F.bit_count(F.expr("a ^ b")) <= bits)).select("a", "b").distinct()


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, trees: int = TREES, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row."""
    rows = written(fingerprints(texts(docs, id_col, text_col), shingle), "fingerprints")
    points = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "points")
    count, total = points.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    _, roots = settled(lambda: components(links(points.select("fp"), count, bits, trees)), docs.sparkSession, "roots")
    rooted = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(names, "root").select("fp", "n", "component_id"), "settled")
    out = join_classes(rows, named, ["fp"], "n", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_texts(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, component_id and kept over two kinds of links: whole fingerprints within BITS, as by ``simhash``,
    and texts whose sets of five-word shingles, A-Z lower-cased, have a Jaccard index of at least ``similar``.

    Each distinct text, known by a 128-bit digest, is searched, by a prefix filter that misses no such pair. Several
    texts under one id are several texts. Null ids are left out. ``kept``: one document of each component.
    """
    rows, spark = with_digest(texts(docs, id_col, text_col)), docs.sparkSession
    chosen = distinct_texts(rows)

    def linked() -> DataFrame:
        whole = written(simhash(chosen, "rep").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).where("a <> b"), "whole-links")
        return components(bucket_links(prefix_keys(chosen, similar, fold=True), chosen, whole, similar, fold=True))

    _, roots = settled(linked, spark, "roots")
    return least_ids(written(rows.select("doc_id", "digest"), "ids"), chosen, roots, "component_id")
