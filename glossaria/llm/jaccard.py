"""Shingle sets of word sequences, candidates from a complete prefix filter, and links verified by the Jaccard index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, join_classes, text_bytes, written
from .components import components
from .fusefilter import mix
from .substring_dedup import _windowed, chunk_words

SHINGLE, SIMILAR = 5, 0.8
#: Text bytes for each range of shingle hashes that one task counts, and into how many ranges a task deals what it has.
RANGE_BYTES, RANGES = 12 << 20, 4096
#: Rounds in which every member of a bucket meets one leader, and members that the last search holds against each other at a time.
ROUNDS, BLOCK = 2, 1000
_U = np.uint64
_BASE = 0xA0761D6478BD642F


def shingles(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the hashes of its shingles, from the hashes of all texts' words in a row."""
    words = mix(words, 5)
    with np.errstate(over="ignore"):
        rolled = mix(_windowed(words, _BASE, size), 9) if len(words) else words
    ends, out = np.cumsum(counts), []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= size:
            out.append(rolled[end - n : end - size + 1])
        elif n:
            with np.errstate(over="ignore"):
                out.append(mix(_windowed(words[end - n : end], _BASE, n)[:1], 10 + n))
        else:
            out.append(words[:0])
    return out


def _slices(batch: pa.RecordBatch):
    """Parts of about CHUNK_BYTES of text and at most 65,536 rows."""
    part = np.cumsum(pc.binary_length(batch["text"].cast(pa.large_binary())).to_numpy(zero_copy_only=False)) // CHUNK_BYTES
    cuts = np.unique(np.concatenate([[0, batch.num_rows], np.flatnonzero(np.diff(part)) + 1, np.arange(0, batch.num_rows, 1 << 16)]))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        yield batch.slice(a, b - a)


def _distinct_shingles(batch: pa.RecordBatch, fold: bool) -> list[np.ndarray]:
    """For each text of ``batch`` the hashes of its shingles, each once; ``fold``: of its words with A-Z lower-cased."""
    text = pc.ascii_lower(batch["text"]) if fold else batch["text"]
    return [np.unique(x) for x in shingles(*chunk_words(pa.table({"text": text})))]


def prefix_keys(chosen: DataFrame, similar: float = SIMILAR, fold: bool = False) -> DataFrame:
    """The rarest shingles of each text of ``chosen`` (rep, text; reps are distinct): rows (key, rep, n, pos, own).

    A text of n distinct shingles names the first n - ceil(similar * n) + 1 in an order that all texts share, rare ones
    first. Two texts whose index is ``similar`` or more have one of these in common, whatever the order is. Shingles
    that no other text has are left out. ``pos``: the shingle's place in the text's order; ``own``: the share of
    shingles that only this text has. ``fold``: words are taken with A-Z lower-cased.

    The order is by a class of the frequency, then by hash. Frequencies are counted by cells of the hash, in ranges of
    the hash that each fit a task; a shared cell is a shared key, so a collision can only add a candidate. Beyond RANGES
    ranges, cells have 64 bits instead of 32, and ranges are dealt in several levels (``_kinds``), whatever their number.
    """
    ranges = max(1, math.ceil(text_bytes(chosen) / RANGE_BYTES))
    wide, first = ranges > RANGES, min(RANGES, ranges)
    form = "<u8" if wide else "<u4"

    def deal(batches):
        for whole in batches:
            for batch in _slices(whole):
                found = _distinct_shingles(batch, fold)
                flat = np.concatenate(found)
                owner = np.repeat(np.arange(len(found), dtype="<u2"), [len(x) for x in found])
                at = _digit(flat, 1, first)
                order = np.argsort(at, kind="stable")
                ends = np.cumsum(np.bincount(at, minlength=first))
                cells, owner, lo = flat[order].astype(form), owner[order], 0
                reps = batch["rep"].to_pylist()
                columns = [[reps[0]] * first, list(range(first)), [reps, *[None] * (first - 1)], [], []]
                for end in ends.tolist():
                    columns[3].append(cells[lo:end].tobytes())
                    columns[4].append(owner[lo:end].tobytes())
                    lo = end
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["piece", "part", "reps", "cells", "owners"])

    def count(rows):
        return rows.append_column("kinds", _counted(rows["cells"], form))

    def choose(rows):
        reps = np.array(next(x for x in rows["reps"].to_pylist() if x is not None), np.int64)
        cells, owner, kind = (np.concatenate([np.frombuffer(x, t) for x in rows[c].to_pylist()]) for c, t in (("cells", form), ("owners", "<u2"), ("kinds", "u1")))
        if wide:
            keys = mix(cells, 12)
            order = np.lexsort((keys, kind, owner))
            owner, kind, keys = owner[order].astype(np.int64), kind[order], keys[order]
        else:
            part = np.repeat(rows["part"].to_numpy(), [len(x) // 4 for x in rows["cells"].to_pylist()])
            low = mix(part.astype(_U) << _U(32) | cells.astype(_U), 12) >> _U(24)
            ordered = np.sort(owner.astype(_U) << _U(48) | kind.astype(_U) << _U(40) | low)
            owner, kind, keys = (ordered >> _U(48)).astype(np.int64), ordered >> _U(40) & _U(255), ordered & _U((1 << 48) - 1)
        n = np.bincount(owner, minlength=len(reps))
        prefix = n - np.ceil(similar * n - 1e-9).astype(np.int64) + 1
        pos = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
        shared = kind > 0
        own = 1 - np.bincount(owner[shared], minlength=len(reps)) / np.maximum(n, 1)
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])[: len(owner)]
        keep = shared & (pos < prefix[owner]) & new
        owner, keys = owner[keep], keys[keep]
        return pa.table([pa.array(keys.view(np.int64)), pa.array(reps[owner]), pa.array(n[owner]), pa.array(pos[keep]), pa.array(own[owner])], names=["key", "rep", "n", "pos", "own"])

    held = "piece long, part long, reps array<long>, cells binary, owners binary"
    dealt = chosen.select("rep", "text").mapInArrow(deal, held)
    if wide:
        dealt = written(dealt, "dealt-shingles")
        counted = _with_kinds(dealt, _kinds(dealt.select("piece", "part", "cells"), ranges / first))
    else:
        counted = dealt.groupBy("part").applyInArrow(count, held + ", kinds binary")
    return counted.groupBy("piece").applyInArrow(choose, "key long, rep long, n long, pos long, own double")


def _digit(hashes: np.ndarray, level: int, parts: int) -> np.ndarray:
    """Which of ``parts`` ranges each hash belongs to. On every level it is another, independent part of the hash."""
    x = hashes if level == 1 else mix(hashes, 100 + level)
    return ((x >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def _counted(column: pa.ChunkedArray, form: str) -> pa.Array:
    """For each row's cells the classes of how often they occur in all rows: 0 for once, a byte for each."""
    cells = [np.frombuffer(x, form) for x in column.to_pylist()]
    _, where, n = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
    kind = np.minimum(255, 8 * np.log2(n)).astype(np.uint8)[where]
    ends = np.cumsum([len(x) for x in cells])
    return pa.array([kind[e - len(x) : e].tobytes() for e, x in zip(ends.tolist(), cells, strict=True)], pa.binary())


def _with_kinds(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    return rows.join(kinds.select(F.col("piece").alias("_piece"), F.col("part").alias("_part"), "kinds"), (F.col("piece") == F.col("_piece")) & (F.col("part") == F.col("_part"))).drop("_piece", "_part")


def _kinds(rows: DataFrame, more: float, level: int = 2) -> DataFrame:
    """piece, part and kinds for rows (piece, part, cells of 64 bits), where each part is still ``more`` ranges' worth.

    The rows of a part are taken together in blocks of about RANGES pieces, so that a block is as large as a piece was;
    each block deals its cells to at most RANGES finer parts. What they count comes back to the block, and from it to the
    rows. Where a finer part is still too large, its blocks are dealt once more in the same way.
    """
    blocks = max(1, math.ceil(rows.select("piece").distinct().count() / RANGES))
    finer = min(RANGES, math.ceil(more))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("piece"), F.lit(blocks)))

    def inside(block: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Sizes of the block's rows in the order of piece, all their cells, and in which order they are dealt."""
        block = block.sort_by("piece")
        cells = [np.frombuffer(x, "<u8") for x in block["cells"].to_pylist()]
        flat = np.concatenate(cells)
        at = _digit(flat, level, finer)
        return [len(x) for x in cells], flat, at, np.argsort(at, kind="stable")

    def deal(block: pa.Table) -> pa.Table:
        _, flat, at, order = inside(block)
        ends = np.cumsum(np.bincount(at, minlength=finer)).tolist()
        dealt = np.split(flat[order], ends[:-1])
        part, number = block["part"][0].as_py(), block["block"][0].as_py()
        return pa.table([[number] * finer, [part * finer + i for i in range(finer)], pa.array([x.tobytes() for x in dealt], pa.binary())], names=["piece", "part", "cells"])

    def back(block: pa.Table, found: pa.Table) -> pa.Table:
        sizes, flat, _, order = inside(block)
        kinds = np.empty(len(flat), np.uint8)
        kinds[order] = np.frombuffer(b"".join(found.sort_by("part")["kinds"].to_pylist()), np.uint8)
        block = block.sort_by("piece")
        return pa.table([block["piece"], block["part"], pa.array([x.tobytes() for x in np.split(kinds, np.cumsum(sizes)[:-1])], pa.binary())], names=["piece", "part", "kinds"])

    dealt = written(placed.groupBy("part", "block").applyInArrow(deal, "piece long, part long, cells binary"), f"dealt-{level}")
    if more > RANGES:
        counted = _kinds(dealt, more / finer, level + 1)
    else:
        counted = dealt.groupBy("part").applyInArrow(lambda rows: rows.select(["piece", "part"]).append_column("kinds", _counted(rows["cells"], "<u8")), "piece long, part long, kinds binary")
    counted = counted.select(F.col("piece").alias("block"), F.floor(F.col("part") / finer).cast("long").alias("of"), "part", "kinds")
    return written(placed.groupBy("part", "block").cogroup(counted.groupBy("of", "block")).applyInArrow(back, "piece long, part long, kinds binary"), f"kinds-{level}")


def bucket_links(keys: DataFrame, chosen: DataFrame, known: DataFrame | None = None, similar: float = SIMILAR, fold: bool = False, bands: bool = False) -> DataFrame:
    """Links (a, b) that connect, with the links ``known``, all texts that share a key and whose index is ``similar`` or
    more, through chains of such texts too. ``keys``: key, rep, n, pos and own as by ``prefix_keys``, or ``bands``, whose
    n, pos and own are 0. ``chosen``: rep, text. ``fold``: as for ``prefix_keys``.

    Texts that chains of links connect already are not compared. In each of ROUNDS rounds all members of a bucket meet
    one leader, first the one of the fewest shingles of its own: copies link to their original. Then, in buckets whose
    members are not yet all connected, every member outside the bucket's largest group meets every other one of another
    group. So nothing is left out, and the pairs grow with a bucket's square only where its texts are not alike.

    Texts that share a passage share ``bands``, in pairs that grow with the square of their number; few of them share a
    rare shingle, too. So after the first leader, texts meet where they share a band and a prefix shingle, as any two do
    that share a band and are alike; again they first meet the one of the fewest shingles of its own.
    """
    keys = written(keys, "keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    open_ = written(join_classes(keys, sizes, ["key"], "m", keys.count()), "buckets")
    named = open_.select("rep").distinct()
    shared = chosen.select("rep", "text").join(named, "rep", "left_semi")
    shared = written(shared, "shared-texts") if bands else shared
    sets = written(_shingle_sets(shared, fold), "shingle-sets")
    links = written(known if known is not None else named.sparkSession.createDataFrame([], "a long, b long"), "known-links")
    done = held = None
    for number in range(ROUNDS + 1):
        roots = written(components(links), "roots")
        open_ = written(_unsettled(open_, roots), f"open-{number}")
        if not open_.head(1):
            return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        if bands and number == 1:
            held, open_ = open_, _by_prefix(open_, shared, roots, similar, fold)
        pairs = (_led(open_, 0 if bands else number, similar) if number < ROUNDS else _across(open_, similar)).distinct()
        pairs = _sharing(pairs, held) if held is not None else pairs
        pairs = written(pairs.join(done, ["a", "b"], "left_anti") if done is not None else pairs, "pairs")
        done = pairs if done is None else done.unionByName(pairs)
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_alike(pairs, sets, similar))
    return links


def _unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with their present ``root``, of buckets in which there are several."""
    columns = [c for c in members.columns if c != "root"]
    labelled = members.select(*columns).join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("key", "size")
    return join_classes(written(labelled, "labelled"), mixed, ["key"], "size", members.count()).select(*columns, "root")


def _by_prefix(members: DataFrame, chosen: DataFrame, roots: DataFrame, similar: float, fold: bool) -> DataFrame:
    """The texts of ``members`` once more, by their prefix shingles that several roots have. Texts without shingles have
    none: they are all alike, and connected since the first leader."""
    named = written(chosen.join(members.select("rep").distinct(), "rep", "left_semi"), "open-texts")
    return written(_unsettled(written(prefix_keys(named, similar, fold), "prefixes"), roots), "open-prefixes")


def _sharing(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The ``pairs`` that share a key of ``members``."""
    held = members.groupBy("rep").agg(F.collect_set("key").alias("held"))
    left, right = (held.select(F.col("rep").alias(n), F.col("held").alias(f"held_{n}")) for n in "ab")
    return pairs.join(left, "a").join(right, "b").where(F.arrays_overlap("held_a", "held_b")).select("a", "b")


def _met(rows: DataFrame, similar: float) -> DataFrame:
    """Pairs a > b of rows (rep, n, pos, root) and (rep2, n2, pos2, root2) that can still be links: what follows the
    shared shingle in both orders must be enough for the index, if it is the first that they share."""
    enough = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= similar / (1 + similar) * (F.col("n") + F.col("n2")) - 1e-6
    return rows.where((F.col("root") != F.col("root2")) & enough).select(F.greatest("rep", "rep2").alias("a"), F.least("rep", "rep2").alias("b"))


def _led(members: DataFrame, number: int, similar: float) -> DataFrame:
    """Every member with its bucket's leader of this round."""
    rank = F.struct("own", F.xxhash64("rep").alias("by")) if number == 0 else F.struct(F.xxhash64("rep", F.lit(number)).alias("by"))
    leader = members.groupBy("key").agg(F.min_by(F.struct("rep", "n", "pos", "root"), rank).alias("x"), F.count(F.lit(1)).alias("size"))
    leader = leader.select("key", "size", *(F.col(f"x.{c}").alias(f"{c}2") for c in ("rep", "n", "pos", "root")))
    return _met(join_classes(members, leader, ["key"], "size", members.count()), similar)


#: Texts whose numbers of shingles have the same logarithm to this base meet as one class.
LENGTHS = 1.03


def _partners(members: DataFrame, similar: float) -> DataFrame:
    """Each row once for every class of lengths in which a text could be alike to its own: ``least`` and ``most``, the
    lower and the higher of both classes.

    What follows the shared shingle in the text must be enough for the index with the shortest text of that class. So a
    text whose shared shingle comes late doesn't meet texts of its length at all, however many share it.
    """
    classes = lambda n: F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log(LENGTHS) + 1e-9).cast("int")
    n, own = F.col("n"), classes(F.col("n"))
    reach = F.sequence(F.greatest(classes(F.floor(n * similar)) - 1, F.lit(0)), classes(F.ceil(n / similar)) + 1)
    shortest = lambda c: F.floor(F.pow(F.lit(LENGTHS), c.cast("double")) * (1 - 1e-9))
    fits = F.filter(reach, lambda c: n - F.col("pos") >= similar / (1 + similar) * (n + F.when(n > 0, shortest(c)).otherwise(0)) - 1e-6)
    rows = members.withColumn("_other", F.explode(fits))
    return rows.select(*members.columns, F.least(own, F.col("_other")).alias("least"), F.greatest(own, F.col("_other")).alias("most"), (own <= F.col("_other")).alias("lower"), (own >= F.col("_other")).alias("higher"))


def _across(members: DataFrame, similar: float) -> DataFrame:
    """Every member outside its bucket's largest group with every member of another group that is of a fitting length, in
    blocks of about BLOCK."""
    groups = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n_root"))
    main = groups.groupBy("key").agg(F.max_by("root", F.struct("n_root", "root")).alias("main"), F.sum("n_root").alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    full = written(_partners(join_classes(members, main, ["key"], "size", members.count()).withColumn("blocks", blocks), similar), "across")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    every = full.select("key", "least", "most", block.alias("block"), F.col("lower").alias("lower2"), F.col("higher").alias("higher2"), *(F.col(c).alias(f"{c}2") for c in ("rep", "n", "pos", "root")))
    others = full.where("root <> main").select("key", "least", "most", "lower", "higher", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "n", "pos", "root")
    pairs = others.join(every, ["key", "least", "most", "block"]).where("(lower and higher2) or (higher and lower2)")
    return _met(pairs, similar)


def _shingle_sets(chosen: DataFrame, fold: bool) -> DataFrame:
    """rep and the hashes of its distinct shingles."""

    def cut(batches):
        for whole in batches:
            for batch in _slices(whole):
                found = _distinct_shingles(batch, fold)
                yield pa.RecordBatch.from_arrays([batch["rep"], pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["rep", "shingles"])

    return chosen.select("rep", "text").mapInArrow(cut, "rep long, shingles array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The ``pairs`` whose sets of shingles have a Jaccard index of at least ``similar``."""
    left, right = (sets.select(F.col("rep").alias(n), F.col("shingles").alias(f"s{n}")) for n in "ab")
    common, sizes = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    return pairs.join(left, "a").join(right, "b").where((common >= similar * (sizes - common)) | (sizes == 0)).select("a", "b")


def with_digest(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with a 128-bit digest of the text, by which equal texts are known. Null ids are left out."""
    return docs.where("doc_id is not null").withColumn("digest", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """Each text of ``rows`` (doc_id, text, digest) once, written: rep, a number of its own, digest, text, the least id
    that has it, and how many rows have it (size)."""
    grouped = rows.groupBy("digest").agg(F.first("text").alias("text"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
    return written(grouped.withColumn("rep", F.monotonically_increasing_id()), "distinct-texts")


def least_ids(rows: DataFrame, chosen: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """doc_id, digest, ``name`` and kept for every row of ``rows``: the least id of all documents connected with it, and
    whether it is the document that stands for them.

    Of several texts under the least id the one of the least digest stands for them; rows that repeat it all do.
    ``chosen``: as by ``distinct_texts``; ``roots``: (node, root) over reps.
    """
    texts = chosen.select("rep", "digest", "least", "size").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    rooted = written(texts.withColumn("root", F.coalesce("root", "rep")), "rooted")
    names = rooted.groupBy("root").agg(F.min(F.struct("least", "digest")).alias("first"), F.count(F.lit(1)).alias("members"))
    named = join_classes(rooted, names, ["root"], "members", rooted.count())
    settled = written(named.select("digest", "size", F.col("first.least").alias(name), (F.col("digest") == F.col("first.digest")).alias("_first")), "settled")
    out = join_classes(rows.select("doc_id", "digest"), settled, ["digest"], "size", rows.count())
    return out.select("doc_id", "digest", name, (F.col("_first") & (F.col("doc_id") == F.col(name))).alias("kept"))
