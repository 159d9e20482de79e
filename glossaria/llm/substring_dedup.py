"""Substring dedup: removes words covered by a window of words that also starts earlier in the corpus.

Documents are dealt to chunks of ascending id, so that the order of chunks is the order of windows.

1. Every chunk makes a sparse count-min sketch of its windows: in each of DEPTH rows the cells that they fall in, sent
   by blocks of cells. A block merges the sketches of all chunks and answers each chunk which of its cells others fill
   too; where there are very many blocks, groups of chunks merge theirs first. The merged count of a window's emptiest cell is never below the number of chunks that hold the window, so
   no repeated window is lost; windows that are estimated to occur once go no further.
2. Windows estimated repeated are grouped exactly, by 128-bit hashes of their words. A chunk sends each distinct one
   once, whatever its copies in the chunk, and learns which of them an earlier chunk holds.
3. Every chunk removes the covered words.

Sketches, hashes and answers travel as packed arrays, a row for each chunk and block. The documents are shuffled once;
the steps reuse that exchange.

Defined cases: a null text counts as empty and has no words. Texts of fewer words than a window lose nothing. Rows that
repeat an id are taken in the order of their texts, a repeated row as the later copy of the first; null ids come last.
Empty tables give empty results. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_chunks, texts
from .fusefilter import mix
from .words import word_hash_pairs

WINDOW, CHUNK_BYTES = 20, 4 << 20
#: Rows of the sketch, its cells for each byte of text, cells of a block, and windows aimed at for a block of hashes.
DEPTH, CELLS_PER_BYTE, BLOCK_BITS, BLOCK_WINDOWS = 2, 1.5, 23, 1 << 20
#: Bits of the number of blocks that a chunk sends its sketch in; more blocks are reached over groups of GROUP chunks.
COARSE_BITS, GROUP = 12, 1024

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SEGMENT = 1 << 20
_BASES = (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)


def in_order(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def word_spans(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end; ``first``: places where a text begins, which end a word too."""
    word = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[first] = True
    begin = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | edge[:-1]))
    end = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | edge[1:])) + 1
    return begin, end


def chunk_words(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk in order, and how many words each row has."""
    hashes, _, counts = _chunk_words(rows, False)
    return hashes, counts


def _chunk_words(rows: pa.Table, both: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each word, built in different ways (or the first alone), and how many words each row has."""
    raw = [x.as_py() for x in rows["text"].cast(pa.large_binary())]
    hashes, others, counts = [], [], []
    batch: list[bytes] = []
    size = 0

    def flush():
        data = np.frombuffer(b"".join(batch), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in batch], dtype=np.int64)])
        begin, end = word_spans(data, bounds[:-1]) if len(data) else (np.zeros(0, np.int64),) * 2
        at = 0
        while at < len(begin):  # by segments of words, so that a very long text needs no more memory than others
            to = max(at + 1, int(np.searchsorted(end, begin[at] + _SEGMENT)))
            base = begin[at]
            one, other = word_hash_pairs(data[base : end[to - 1]], begin[at:to] - base, end[at:to] - base, both)
            hashes.append(one)
            if both:
                others.append(other)
            at = to
        counts.append(np.diff(np.searchsorted(begin, bounds)))

    for x in raw:
        batch.append(x)
        size += len(x)
        if size >= _SEGMENT:
            flush()
            batch, size = [], 0
    if batch:
        flush()
    none = np.zeros(0, _U)
    return np.concatenate([none, *hashes]), np.concatenate([none, *others]), np.concatenate([np.zeros(0, np.int64), *counts])


def chunk_windows(rows: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window, over word hashes that are built in different ways, and the place of its first
    word in the chunk."""
    *words, counts = _chunk_words(rows, True)
    ends = np.repeat(np.cumsum(counts), counts)
    start = np.flatnonzero(np.arange(len(words[0])) + window <= ends)
    out = []
    for seed, base in enumerate(_BASES):
        # A window is hashed in place: a polynomial of its words, by doubling, needs no powers of its place.
        with np.errstate(over="ignore"):
            out.append(mix(_windowed(mix(words[seed], seed + 1), base, window)[start], seed + 7) if len(start) else np.zeros(0, _U))
    return out[0], out[1], start


def _windowed(values: np.ndarray, base: int, window: int) -> np.ndarray:
    """For each place the sum of values[place + k] * base ** (window - 1 - k) over its window; no meaning near the end."""
    total, width, built, power = None, 0, values, base
    size = 1
    while size <= window:
        if window & size:
            if total is None:
                total, width = built.copy(), size
            else:
                total = total * _U(pow(base, size, 1 << 64)) + _shifted(built, width)
                width += size
        built = built * _U(power) + _shifted(built, size)
        power = power * power % (1 << 64)
        size *= 2
    return total


def _shifted(values: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(values)
    out[: max(0, len(values) - by)] = values[by:]
    return out


def _cells(h: np.ndarray, row: int, cell_bits: int) -> np.ndarray:
    return mix(h, 101 + row) >> _U(64 - cell_bits)


def _deltas(cells: np.ndarray) -> bytes:
    """Ascending places within a block, as steps of 16 bits; longer steps as full ones and a rest. Where that would be
    longer, the places themselves, behind a byte."""
    steps = np.diff(cells.astype(np.int64), prepend=0)
    many = steps // 0xFFFF
    if not many.any():
        return steps.astype(np.uint16).tobytes()
    if int(many.sum()) > 3 * len(steps):
        return b"\1" + cells.astype("<i8").tobytes()
    out = np.full(len(steps) + int(many.sum()), 0xFFFF, np.uint16)
    out[np.cumsum(many + 1) - 1] = steps % 0xFFFF
    return out.tobytes()


def _undeltas(data: bytes) -> np.ndarray:
    if len(data) % 2:
        return np.frombuffer(data, "<i8", offset=1)
    steps = np.frombuffer(data, np.uint16)
    return np.cumsum(steps, dtype=np.int64)[steps != 0xFFFF]


def _by_block(sorted_values: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The blocks that ascending values fall in, and the bounds of their runs."""
    block = sorted_values >> _U(shift)
    at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    return block[at].astype(np.int64), np.append(at, len(block))


def sketch(rows: pa.Table, window: int, cell_bits: int, block_bits: int) -> list[tuple[int, bytes]]:
    """The chunk's sparse sketch: for each block (row and high bits of the cell) the cells in it."""
    h, _, _ = chunk_windows(rows, window)
    out = []
    for row in range(DEPTH):
        cells = np.unique(_cells(h, row, cell_bits))
        blocks, at = _by_block(cells, block_bits)
        inner = cells & _U((1 << block_bits) - 1)
        out += [(row << 40 | b, _deltas(inner[a:e])) for b, a, e in zip(blocks.tolist(), at[:-1], at[1:], strict=True)]
    return out


def shared_cells(sent: list[bytes], block_bits: int) -> list[bytes]:
    """Merges one block of all chunks' sketches: for each chunk a bit for each cell sent, set where others fill it too."""
    counts = np.zeros(1 << block_bits, np.uint8)
    for data in sent:
        cells = _undeltas(data)
        counts[cells] = np.minimum(counts[cells], 1) + 1
    return [np.packbits(counts[_undeltas(data)] > 1).tobytes() for data in sent]


def group_cells(sent: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells of a block that a group of chunks fills, and which of them several of its chunks fill."""
    cells, n = np.unique(np.concatenate([_undeltas(x) for x in sent]), return_counts=True)
    return cells.astype(_U), n > 1


def group_sketch(sent: list[bytes], block_bits: int) -> list[tuple[int, bytes]]:
    """A group's merged sketch of one coarse block, by its fine blocks: cells, and a bit for each that several fill."""
    cells, several = group_cells(sent)
    fine, at = _by_block(cells, block_bits)
    inner, out = cells & _U((1 << block_bits) - 1), []
    for b, a, e in zip(fine.tolist(), at[:-1], at[1:], strict=True):
        steps = _deltas(inner[a:e])
        out.append((b, len(steps).to_bytes(8, "little") + steps + np.packbits(several[a:e]).tobytes()))
    return out


def shared_by_groups(sent: list[bytes], block_bits: int) -> list[bytes]:
    """``shared_cells`` over the merged sketches of groups."""
    counts, read = np.zeros(1 << block_bits, np.uint8), []
    for data in sent:
        end = 8 + int.from_bytes(data[:8], "little")
        cells = _undeltas(data[8:end])
        several = np.unpackbits(np.frombuffer(data, np.uint8, offset=end), count=len(cells))
        counts[cells] = np.minimum(counts[cells] + 1 + several, 2)
        read.append(cells)
    return [np.packbits(counts[cells] > 1).tobytes() for cells in read]


def group_answers(sent: list[bytes], answers: dict[int, bytes], block_bits: int) -> list[bytes]:
    """What ``shared_cells`` answers each chunk of a group, from the answers to the group by fine block."""
    cells, _ = group_cells(sent)
    fine, at = _by_block(cells, block_bits)
    bits = np.concatenate([np.unpackbits(np.frombuffer(answers[b], np.uint8), count=e - a) for b, a, e in zip(fine.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)])
    return [np.packbits(bits[np.searchsorted(cells, _undeltas(x).astype(_U))]).tobytes() for x in sent]


def repeated(rows: pa.Table, answers: dict[int, bytes], window: int, cell_bits: int, block_bits: int, hash_bits: int) -> list[tuple[int, bytes]]:
    """What the exact step gets from a chunk: for each block of hashes the distinct windows that others may hold, and
    under block -1 the windows that an earlier one of the same chunk equals."""
    h1, h2, start = chunk_windows(rows, window)
    order = np.lexsort((start, h2, h1))
    h1, h2, start = h1[order], h2[order], start[order]
    again = np.concatenate([[False], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])])[: len(h1)]
    out = [(-1, start[again].astype("<u4").tobytes())]
    h1, h2, start = h1[~again], h2[~again], start[~again]
    maybe = np.ones(len(h1), bool)
    for row in range(DEPTH):
        cells = _cells(h1, row, cell_bits)
        distinct, of = np.unique(cells, return_inverse=True)
        blocks, at = _by_block(distinct, block_bits)
        bits = [np.unpackbits(np.frombuffer(answers[row << 40 | b], np.uint8), count=e - a) for b, a, e in zip(blocks.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
        maybe &= np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)[of]
    h1, h2, start = h1[maybe], h2[maybe], start[maybe].astype("<u4")
    blocks, at = _by_block(h1, 64 - hash_bits) if hash_bits else (np.zeros(min(1, len(h1)), np.int64), np.array([0, len(h1)][: 1 + min(1, len(h1))]))
    out += [(b, h1[a:e].tobytes() + h2[a:e].tobytes() + start[a:e].tobytes()) for b, a, e in zip(blocks.tolist(), at[:-1], at[1:], strict=True)]
    return out


def held_earlier(chunks: np.ndarray, sent: list[bytes]) -> list[bytes]:
    """For each chunk of one block of hashes, which of the windows that it sent an earlier chunk holds."""
    sizes = [len(x) // 20 for x in sent]
    h1 = np.concatenate([np.frombuffer(x, _U, n) for x, n in zip(sent, sizes, strict=True)])
    h2 = np.concatenate([np.frombuffer(x, _U, n, offset=8 * n) for x, n in zip(sent, sizes, strict=True)])
    which = np.repeat(np.arange(len(sent)), sizes)
    order = np.lexsort((chunks[which], h2, h1))
    later = np.zeros(len(h1), bool)
    later[order[1:]] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
    at = np.concatenate([[0], np.cumsum(sizes)])
    return [np.frombuffer(x, "<u4", n, offset=16 * n)[later[a : a + n]].tobytes() for x, n, a in zip(sent, sizes, at[:-1].tolist(), strict=True)]


def kept_texts(rows: pa.Table, removed: np.ndarray, window: int) -> list[tuple[int, int, bytes | None]]:
    """For each row: words, words removed, and the kept words joined by one space."""
    words = [x.as_py().split() for x in rows["text"].cast(pa.binary())]
    counts = np.array([len(w) for w in words], np.int64)
    edge = np.zeros(int(counts.sum()) + 1, np.int32)
    np.add.at(edge, removed, 1)
    np.add.at(edge, removed + window, -1)
    gone, at, out = np.cumsum(edge)[:-1] > 0, 0, []
    for w in words:
        mask = gone[at : at + len(w)]
        n = int(mask.sum())
        out.append((len(w), n, b" ".join(w if not n else [x for x, g in zip(w, mask.tolist(), strict=True) if not g])))
        at += len(w)
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, columns: tuple[str, ...] = (), keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, the other ``columns`` asked for, and ``kept``: the text that is left.

    ``kept`` is the text itself, unchanged, where nothing is removed, else the kept words joined by one space.
    """
    source = texts(docs, id_col, text_col) if not columns else docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"_{c}") for c in columns])
    chunks, size = id_chunks(source, CHUNK_BYTES)
    cell_bits = max(10, math.ceil(math.log2(max(1, size * CELLS_PER_BYTE))))
    hash_bits = max(0, math.ceil(math.log2(max(1, size / 6 / BLOCK_WINDOWS))))
    block_bits = min(BLOCK_BITS, cell_bits)
    fine_bits = max(0, cell_bits - block_bits - COARSE_BITS)
    sent_bits = block_bits + fine_bits  # of the blocks in which chunks send their sketches
    dealt = chunks.groupBy("chunk")
    packed = "chunk int, block long, data binary"

    def table(chunk: list, block: list, data: list[bytes]) -> pa.Table:
        return pa.table({"chunk": pa.array(chunk, pa.int32()), "block": pa.array(block, pa.int64()), "data": pa.array(data, pa.binary())})

    def make_sketch(rows):
        found = sketch(in_order(rows), window, cell_bits, sent_bits)
        return table([rows["chunk"][0].as_py()] * len(found), [b for b, _ in found], [x for _, x in found])

    def merge_sketches(rows):
        return pa.table([rows["chunk"], rows["block"], pa.array(shared_cells(rows["data"].to_pylist(), block_bits), pa.binary())], names=["chunk", "block", "data"])

    def gather(rows):
        found, coarse = group_sketch(rows["data"].to_pylist(), block_bits), rows["block"][0].as_py()
        return pa.table([pa.array([rows["grp"][0].as_py()] * len(found), pa.int32()), pa.array([coarse] * len(found), pa.int64()), pa.array([coarse << fine_bits | b for b, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["grp", "coarse", "block", "data"])

    def merge_groups(rows):
        return rows.set_column(3, "data", pa.array(shared_by_groups(rows["data"].to_pylist(), block_bits), pa.binary()))

    def spread(rows, answers):
        by_fine = {b & (1 << fine_bits) - 1: x for b, x in zip(answers["block"].to_pylist(), answers["data"].to_pylist(), strict=True)}
        return table(rows["chunk"].to_pylist(), rows["block"].to_pylist(), group_answers(rows["data"].to_pylist(), by_fine, block_bits))

    def find_repeated(rows, answers):
        if not rows.num_rows:
            return table([], [], [])
        found = repeated(in_order(rows), dict(zip(answers["block"].to_pylist(), answers["data"].to_pylist(), strict=True)), window, cell_bits, sent_bits, hash_bits)
        return table([rows["chunk"][0].as_py()] * len(found), [b for b, _ in found], [x for _, x in found])

    def settle(rows):
        if rows["block"][0].as_py() < 0:
            return rows
        return table(rows["chunk"].to_pylist(), rows["block"].to_pylist(), held_earlier(rows["chunk"].to_numpy(), rows["data"].to_pylist()))

    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept", T.StringType())] * keep_text + [T.StructField(f"_{c}", source.schema[f"_{c}"].dataType) for c in columns]
    schema = T.StructType(fields)

    def remove(rows, found):
        rows = in_order(rows)
        removed = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(x, "<u4") for x in found["data"].to_pylist())]).astype(np.int64)
        result = kept_texts(rows, removed, window)
        out = {"doc_id": rows["doc_id"], "n_words": pa.array([r[0] for r in result], pa.int64()), "n_removed": pa.array([r[1] for r in result], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(r[2]).hexdigest() for r in result], pa.string())}
        if keep_text:
            out["kept"] = pa.array([r[2].decode() if r[1] else t for t, r in zip(rows["text"].to_pylist(), result, strict=True)], pa.string())
        return pa.table(out | {f"_{c}": rows[f"_{c}"] for c in columns})

    sketches = dealt.applyInArrow(make_sketch, packed)
    if not fine_bits:
        answers = sketches.groupBy("block").applyInArrow(merge_sketches, packed)
    else:
        # Beyond 2 ** COARSE_BITS blocks a row of one chunk and one block would hold next to nothing: groups of chunks
        # merge their sketches of a coarse block first, and only the groups' meet in the fine blocks.
        grouped = sketches.withColumn("grp", (F.col("chunk") / GROUP).cast("int"))
        finer = "grp int, coarse long, block long, data binary"
        settled = grouped.groupBy("block", "grp").applyInArrow(gather, finer).groupBy("block").applyInArrow(merge_groups, finer)
        answers = grouped.groupBy("block", "grp").cogroup(settled.groupBy("coarse", "grp")).applyInArrow(spread, packed)
    candidates = dealt.cogroup(answers.groupBy("chunk")).applyInArrow(find_repeated, packed)
    # What a chunk found within itself needs no other chunk: it is grouped by chunk under block -1 - chunk.
    homed = candidates.withColumn("block", F.when(F.col("block") < 0, -1 - F.col("chunk").cast("long")).otherwise(F.col("block")))
    gone = homed.groupBy("block").applyInArrow(settle, packed)
    out = dealt.cogroup(gone.groupBy("chunk")).applyInArrow(remove, schema)
    return out.select(*[c for c in out.columns if not c.startswith("_")], *[F.col(f"_{c}").alias(c) for c in columns])

