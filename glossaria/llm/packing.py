"""Packing of documents into sequences by Karmarkar-Karp multiway differencing.

Documents are dealt to groups of about GROUP_WINDOWS windows by a hash of the row and its number. In a group, each document's ids are cut: as
many whole windows as it fills stand by themselves, and the rest is cut into pieces of at most PIECE ids. The pieces
are packed into the least number of windows that their ids could fill: partial partitions with opposing imbalances are
merged, those of the largest difference first, until one partition with nearly equal windows is left. If its largest
window exceeds the capacity, the number of windows rises and the pieces are packed anew.

A sequence is padded to the capacity, unless its length is a power of two.

Defined cases: a null text counts as empty; every document has at least the end id, so every document has a piece.
Repeated rows are packed as often as they occur; null ids are packed and returned as null. An empty table gives no
rows. Extra columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, texts
from .words import Words

CAPACITY, END_ID, GROUP_WINDOWS, PIECE = 4096, 2, 128, 1024
#: Bytes of text that a window is taken to hold when groups are counted.
WINDOW_BYTES = 11_000


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp: ``sizes`` dealt to ``ways`` windows of nearly equal sums; for each window its places in ``sizes``.

    A partition is a descending list of (sum, places) above its least window, which is left out where nothing is in it.
    """
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        spare = ways - len(a)
        joined = a + b[:spare]
        for (total, places), k in zip(b[spare:], range(len(a) - 1, -1, -1), strict=False):
            joined[k] = (a[k][0] + total, a[k][1] + places)
        joined.sort(key=lambda x: -x[0])
        least = joined[-1][0] if len(joined) == ways else 0
        if least:
            joined = [(total - least, places) for total, places in joined]
        heapq.heappush(heap, (-joined[0][0], serial, joined))
        serial += 1
    out = [places for _, places in heap[0][2]] if heap else []
    return out + [[] for _ in range(ways - len(out))]


def packed(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``: as few as differencing can fill without exceeding it."""
    if not sizes:
        return []
    ways = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        windows = differencing(sizes, ways)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return [w for w in windows if w]
        ways += 1


def packing(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, piece: int = PIECE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length."""
    source = texts(docs, id_col, text_col)
    groups = max(1, math.ceil(text_bytes(source) / (GROUP_WINDOWS * WINDOW_BYTES * capacity / CAPACITY)))
    dealt = source.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(groups)))

    def pack_group(rows):
        ids = [np.append(x, np.uint32(end_id)).astype("<u4") for x in Words.of(vocabulary_path).encode(rows["text"].to_pylist())]
        pieces, whole = [], []  # (row, start, length)
        for row, x in enumerate(ids):
            full = len(x) // capacity * capacity
            whole += [(row, at, capacity) for at in range(0, full, capacity)]
            pieces += [(row, at, min(piece, len(x) - at)) for at in range(full, len(x), piece)]
        windows = [[p] for p in whole] + [[pieces[i] for i in sorted(w)] for w in packed([p[2] for p in pieces], capacity)]
        out = []
        first = rows["grp"][0].as_py() << 32
        for number, window in enumerate(windows):
            offset, total = 0, sum(p[2] for p in window)
            padded = total if total & (total - 1) == 0 else capacity
            for row, start, length in window:
                out.append((row, start, length, zlib.crc32(ids[row][start : start + length].tobytes()), len(ids[row]), first + number, offset, padded))
                offset += length
        columns = np.array(out, np.int64).reshape(-1, 8)
        names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"]
        return pa.table([rows["doc_id"].take(pa.array(columns[:, 0])), *(pa.array(columns[:, k + 1]) for k in range(7))], names=["doc_id", *names])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
    return dealt.groupBy("grp").applyInArrow(pack_group, schema)
