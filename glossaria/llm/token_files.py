"""Token ids as binary files: raw id payloads behind a minimal perfect hash of document keys.

A shard is one file of the shared folder. It holds the ids of a range of documents in ascending id order, where each
document's ids end, and an index: a minimal perfect hash (levels of collision-free bits and their ranks) takes a
document key to a slot, which stores a fingerprint of the key and the rows that the key has in the shard. A look-up
reads a bounded number of places; a key that isn't there fails the fingerprint but for one in 2^32.

Defined cases: a null text counts as empty and has only the end id. Repeated ids stay, ordered by text, as one run of
rows under their key. Null ids come after all others and have no key; they are read by their place. An empty table
gives no file and no rows. Extra columns are not looked at. ``look_up`` gives every row of a key, no row for null keys and for keys
that aren't there, and repeats nothing for repeated keys.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, RANGES, id_chunks, id_ranges, new_path, texts, written
from .fusefilter import mix
from .shared_files import pack, read_bytes, unpack, write_bytes
from .words import Words

END_ID = 2
#: Ids that a look-up returns in one batch, but for a single document of more.
BATCH_IDS = 1 << 20
_U = np.uint64


def build_index(keys: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The hash of distinct 64-bit keys, and each key's slot: 0 to their number, each once."""
    sizes, words, left, level = [], [], np.arange(len(keys)), 0
    while len(left):
        size = -(-max(64, 2 * len(left)) // 64) * 64
        at = (mix(keys[left], level + 1) % _U(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, np.uint8)
        bits[at[alone]] = 1
        words.append(np.packbits(bits, bitorder="little").view("<u8"))
        sizes.append(size)
        left, level = left[~alone], level + 1
    bits = np.concatenate(words) if words else np.zeros(0, "<u8")
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
    index = {"sizes": np.array(sizes, "<i8"), "bits": bits, "ranks": ranks.astype("<i8")}
    return index, slots(index, keys)


def slots(index: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 where some level shows that the key wasn't built in."""
    out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(index["sizes"].tolist()):
        at = (mix(keys[left], level + 1) % _U(size)).astype(np.int64) + base
        word, bit = at >> 6, (at & 63).astype(_U)
        value = index["bits"][word]
        here = (value >> bit & _U(1)).astype(bool)
        below = np.bitwise_count(value & ((_U(1) << bit) - _U(1))).astype(np.int64)
        out[left[here]] = (index["ranks"][word] + below)[here]
        left, base = left[~here], base + size
    return out


def key_prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 0x5EED) >> _U(32)).astype("<u4")


def shard_parts(ids: list[np.ndarray], keys: np.ndarray, vocabulary: int) -> list[bytes]:
    """The file of documents in order; ``keys``: those of the first ``len(keys)``, ascending, the rest have none."""
    distinct, first, n = np.unique(keys, return_index=True, return_counts=True)
    index, slot = build_index(distinct.view(_U))
    prints, at, runs = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    prints[slot], at[slot], runs[slot] = key_prints(distinct.view(_U)), first, n
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype("<i8")
    payload = np.concatenate([np.zeros(0, kind), *ids]).astype(kind)
    return pack(index | {"prints": prints, "at": at, "runs": runs, "keys": keys.astype("<i8"), "ends": ends, "payload": payload})


class Shard:
    """Keyed access to one file."""

    def __init__(self, uri: str):
        self.arrays = unpack(read_bytes(uri))
        self.keys, self.ends, self.payload = (self.arrays[k] for k in ("keys", "ends", "payload"))

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first row of each key and how many follow it, itself included: 0 for keys that aren't in the shard."""
        keys = np.ascontiguousarray(keys, np.int64).view(_U)
        slot = slots(self.arrays, keys)
        there = slot >= 0
        there[there] = self.arrays["prints"][slot[there]] == key_prints(keys[there])
        at, n = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at[there], n[there] = self.arrays["at"][slot[there]], self.arrays["runs"][slot[there]]
        return at, n

    def rows_of(self, keys: np.ndarray) -> list[range]:
        """The rows of each key, compared by the key itself."""
        at, n = self.rows(keys)
        there = n > 0
        there[there] = self.keys[at[there]] == keys[there]
        return [range(a, a + k) for a, k in zip(at.tolist(), np.where(there, n, 0).tolist(), strict=True)]

    def ids(self, row: int) -> np.ndarray:
        return self.payload[self.ends[row] : self.ends[row + 1]].astype("<u4")


def write_shards(docs: DataFrame, vocabulary_path: str, end_id: int = END_ID) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes the shards. Returns their manifest: chunk, path, documents, tokens,
    first_id, last_id (null where no row has an id), start.

    ``start``: the ids of all shards before. A lost task writes its shard again under another name, and only files of
    tasks that ended are in the manifest.
    """
    folder = new_path(docs.sparkSession, "tokens")

    def write(rows):
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        words = Words.of(vocabulary_path)
        ids = [np.append(x, np.uint32(end_id)) for x in words.encode(rows["text"].to_pylist())]
        keys = rows["doc_id"].drop_null().to_numpy()
        path = f"{folder}/{uuid.uuid4().hex}.tokens"
        write_bytes(path, shard_parts(ids, keys, words.tokenizer.get_vocab_size()))
        numbers = [len(ids), sum(map(len, ids)), *((keys[0], keys[-1]) if len(keys) else (None, None))]
        return pa.Table.from_arrays([rows["chunk"][:1].combine_chunks(), pa.array([path]), *(pa.array([x], pa.int64()) for x in numbers)], ["chunk", "path", "documents", "tokens", "first_id", "last_id"])

    schema = "chunk int, path string, documents long, tokens long, first_id long, last_id long"
    manifest = written(id_chunks(docs, CHUNK_BYTES)[0].groupBy("chunk").applyInArrow(write, schema), "manifest")
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one small row for each shard
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_shards(manifest: DataFrame, shards: int) -> DataFrame:
    """Every document of the files, by its key: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                shard = Shard(path)
                distinct = np.unique(shard.keys)
                at, n = shard.rows(distinct)
                rows = np.concatenate([np.arange(a, a + k) for a, k in zip(at.tolist(), n.tolist(), strict=True)] or [np.zeros(0, np.int64)])
                rows = np.append(rows, np.arange(len(shard.keys), len(shard.ends) - 1)).astype(np.int64)
                crc = [zlib.crc32(shard.ids(r).tobytes()) for r in rows.tolist()]
                lost = len(shard.ends) - 1 - len(shard.keys)
                keys = pa.array([*np.repeat(distinct, n).tolist(), *[None] * lost], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pa.array(start + shard.ends[rows]), pa.array(np.diff(shard.ends)[rows]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.repartition(max(1, shards), "chunk").select("path", "start")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def look_up(manifest: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """The documents of ``keys`` from the files of ``manifest``: doc_id, start (ids of all documents before), n_tokens, ids.

    A key meets the shards whose range of ids holds it: ranges are dealt to at most RANGES cells by their quantiles, so
    that a key is compared with one shard in so many. Pairs of shard and key are then dealt by ranges of both, to as many
    tasks as there are shards: a shard that many keys ask for is read by several tasks. A task looks up the keys that ask
    for one shard together.
    """
    ranges = manifest.where("first_id IS NOT NULL").select("chunk", "path", "start", "first_id", "last_id")
    bounds = ranges.agg(F.percentile_approx("first_id", [i / RANGES for i in range(1, RANGES)], 20 * RANGES)).first()[0] or []
    cells = [id_ranges(ranges.select("chunk", F.col(c).alias("doc_id")), bounds, "cell").select("chunk", F.col("cell").alias(f"{c}_cell")) for c in ("first_id", "last_id")]
    spans = ranges.join(cells[0], "chunk").join(cells[1], "chunk")
    spans = spans.select("*", F.explode(F.sequence("first_id_cell", "last_id_cell")).alias("cell"))
    asked = id_ranges(keys.select(F.col(key_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), bounds, "cell")
    met = asked.join(spans, "cell").where(F.col("doc_id").between(F.col("first_id"), F.col("last_id")))
    dealt = met.select("chunk", "doc_id", "path", "start").repartitionByRange(max(1, ranges.count()), "chunk", "doc_id").sortWithinPartitions("chunk", "doc_id")

    def batch_of(out: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        ids, starts, held = zip(*out, strict=True)
        ends = np.cumsum([0, *map(len, held)])
        flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(held).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(np.diff(ends), pa.int64()), flat], ["doc_id", "start", "n_tokens", "ids"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, shard, out, size = None, None, [], 0
        for batch in batches:
            paths, starts, asked_keys = batch["path"].to_pylist(), batch["start"].to_pylist(), batch["doc_id"].to_numpy(zero_copy_only=False)
            cuts = [i for i in range(len(paths)) if not i or paths[i] != paths[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(paths)], strict=True):
                if paths[a] != opened:
                    opened, shard = paths[a], Shard(paths[a])
                for key, found in zip(asked_keys[a:b].tolist(), shard.rows_of(asked_keys[a:b]), strict=True):
                    for row in found:
                        out.append((key, starts[a] + int(shard.ends[row]), shard.ids(row)))
                        size += len(out[-1][2])
                        if size >= BATCH_IDS:
                            yield batch_of(out)
                            out, size = [], 0
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids array<int>")


def token_files(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    manifest = write_shards(texts(docs, id_col, text_col), vocabulary_path, end_id)
    return read_shards(manifest, manifest.count())
