"""MinHash fingerprints of documents, and near duplicates by signature bands with the Jaccard index verified.

A shingle is five consecutive words (runs of anything but ASCII white space); a text with fewer words is one shingle.
Each of PERMUTATIONS multiply-add hashes permutes the 64-bit shingle hashes; the least value of each, cut to 16 bits,
is a component of the signature. Two signatures agree in about as many components as their shingle sets' Jaccard
index says.

Defined cases: a null text counts as empty. A text without words has no shingle: all components are ffff, and two such
texts are alike. Equal texts have equal fingerprints. Documents are ordered by id and, for repeated ids, by text; null
ids stand above all others. The next document is the one below; the lowest one's is the highest. An only document is
its own next. Empty tables give empty results. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, id_chunks, settled, texts, written
from .components import components
from .jaccard import SIMILAR, bucket_links, distinct_texts, least_ids, shingles, with_digest
from .substring_dedup import chunk_words, in_order

PERMUTATIONS = 128
#: Chunks whose bounds may be broadcast: 24 bytes of each.
BROADCAST_CHUNKS = 1_000_000

_U = np.uint64
_rng = np.random.default_rng(2024)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * _U(2) + _U(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """PERMUTATIONS components of 16 bits."""
    least = np.full(PERMUTATIONS, np.iinfo(_U).max, _U)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 512):
            np.minimum(least, (_A[:, None] * hashes[None, at : at + 512] + _B[:, None]).min(axis=1), out=least)
    if not len(hashes):
        return np.full(PERMUTATIONS, 0xFFFF, np.uint16)
    return ((least >> _U(7)) ^ (least >> _U(29))).astype(np.uint16)


def signatures(column: pa.Array | list[str]) -> np.ndarray:
    words, counts = chunk_words(pa.table({"text": column}))
    return np.array([signature(x) for x in shingles(words, counts)], np.uint16).reshape(-1, PERMUTATIONS)


def _hex(signatures: np.ndarray) -> pa.Array:
    return pa.array([s.astype(">u2").tobytes().hex() for s in signatures], pa.string())


def _with_next(source: DataFrame) -> DataFrame:
    """The documents by chunk, with each chunk's ``guest``: the highest document of the chunk below."""
    dealt, size = id_chunks(source, CHUNK_BYTES)
    tops = dealt.groupBy("chunk").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy("chunk")  # one small row for each chunk
    tops = tops.withColumn("to", F.coalesce(F.lead("chunk").over(order), F.min("chunk").over(Window.partitionBy(F.lit(0))))).withColumnRenamed("chunk", "of")
    tops = F.broadcast(tops) if size <= BROADCAST_CHUNKS * CHUNK_BYTES else tops
    highest = dealt.join(tops, (F.col("chunk") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")))
    guests = highest.groupBy("of", "to", "top").agg(F.max("text").alias("text"))
    guests = guests.select(F.col("top").alias("doc_id"), "text", F.lit(1).alias("guest"), F.col("to").alias("chunk"))
    return dealt.select("doc_id", "text", F.lit(0).alias("guest"), "chunk").unionByName(guests)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    The edited text has its last half replaced by as much of the beginning of the next document.
    """
    source = texts(docs, id_col, text_col)
    dealt = _with_next(source)

    def work(rows):
        guest = np.array(rows["guest"].to_pylist(), bool)
        own, above = in_order(rows.filter(pa.array(~guest))), in_order(rows.filter(pa.array(guest)))
        if not own.num_rows:
            return pa.table({n: pa.array([], k) for n, k in kinds.items()})
        body = own["text"].to_pylist()
        before = [above["text"][-1].as_py(), *body[:-1]]  # the next document of each, in descending order
        edited = [t[: len(t) - len(t) // 2] + b[: len(t) // 2] for t, b in zip(body, before, strict=True)]
        plain, changed = signatures(pa.array([before[0], *body], pa.string())), signatures(pa.array(edited, pa.string()))
        columns = [
            own["doc_id"], pa.array([len(t) for t in body], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            _hex(plain[1:]), _hex(changed), pa.array((plain[1:] == changed).mean(axis=1)), pa.array((plain[1:] == plain[:-1]).mean(axis=1)),
        ]
        return pa.table(columns, names=list(kinds))

    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.groupBy("chunk").applyInArrow(work, schema)


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, class_id, the least id that chains of links lead to, and kept, as by ``least_ids``. Null ids are
    left out.

    Texts are compared once for each distinct text, known by a 128-bit digest. Signatures are cut into bands of four
    components; texts that share a band meet in Spark, all with all unless links connect them already. A comparison is
    a link where the Jaccard index of the shingle sets is at least ``similar``.
    """
    rows, spark = with_digest(texts(docs, id_col, text_col)), docs.sparkSession
    chosen = distinct_texts(rows)

    def bands(batches):
        for batch in batches:
            found = signatures(batch["text"]).view("<u8").view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["rep"], pa.array(list(found), pa.list_(pa.int64()))], ["rep", "bands"])

    banded = chosen.mapInArrow(bands, "rep long, bands array<long>").select("rep", F.posexplode("bands").alias("band", "value"))
    none = F.lit(0).cast("long")
    keys = banded.select(F.xxhash64("band", "value").alias("key"), "rep", none.alias("n"), none.alias("pos"), F.lit(0.0).alias("own"))
    _, roots = settled(lambda: components(bucket_links(keys, chosen, None, similar, bands=True)), spark, "roots")
    return least_ids(written(rows.select("doc_id", "digest"), "ids"), chosen, roots, "class_id")
