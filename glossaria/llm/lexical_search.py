"""Ranked lexical search: a document-at-a-time heap merge over the compressed postings of shards.

Each task cuts its documents into shards of about SHARD_BYTES of text, without a shuffle, and writes one row for each: a
dictionary of its terms, and for each term the documents that hold it in the order of doc_id, as gaps and occurrences in
variable-length bytes. Queries are distinct texts in blocks of about QUERY_BYTES. For a block one pass over the
dictionaries adds up how many documents hold each term; another merges, for each query, the lists of its terms by a heap
of their next documents. A bounded heap, keyed by score and doc_id, holds a task's best. Lists that together can't lift a
document into it are left out of the merge and only looked up for documents that the others find (MaxScore), which
changes no result. Spark merges the tasks' best by a rank over each query.

Defined cases: a null text has no terms, and a document or item without terms has no rows. Null doc_ids rank last among
equal scores. Repeated documents rank each for itself; repeated items each get their rows. Empty tables give no rows.
Extra columns are not looked at.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .shared_files import pack, unpack
from .words import _spread, eights, same_bytes, word_hashes

#: Results of each item, bytes of text of a shard, and of the queries that are answered together.
BEST, SHARD_BYTES, QUERY_BYTES = 10, 8 << 20, 1 << 20

_TERM = np.zeros(256, bool)
_TERM[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in a row with A-Z lower-cased, where each term begins and ends, and whose it is."""
    data = _LOWER[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)]  # a zero belongs to no term
    inside = np.concatenate([[False], _TERM[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    bounds = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return data, begin, end, np.searchsorted(bounds, begin, "right")


def terms_of(text: str | None) -> list[bytes]:
    data, begin, end, _ = term_spans([(text or "").encode()])
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def to_varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits of each value in a byte, the lowest first; the highest bit says that more follow. And where each ends."""
    n = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        n += values >= 1 << bits
    ends = np.cumsum(n)
    out, starts = np.zeros(int(n.sum()), np.uint8), ends - n
    for k in range(int(n.max(initial=0))):
        more = n > k
        out[starts[more] + k] = (values[more] >> 7 * k & 127) | (n[more] > k + 1) << 7
    return out, ends


def from_varints(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128) + 1
    starts = np.concatenate([[0], ends[:-1]])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts) if len(data) else np.zeros(0, np.int64)


def _grouped(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct terms, ascending, a span of each, and which each span is. Bytes confirm the hashes."""
    hashes = word_hashes(data, begin, end)
    distinct, where, of = np.unique(hashes, return_index=True, return_inverse=True)
    lanes = eights(data)
    if same_bytes(lanes, begin, end, lanes, begin[where[of]], end[where[of]]).all():
        return distinct, where, of
    raw = data.tobytes()
    numbers: dict[bytes, int] = {}
    of = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    where = np.unique(of, return_index=True)[1]
    order = np.argsort(hashes[where], kind="stable")
    return hashes[where[order]], where[order], np.argsort(order)[of]


def index_shard(ids: list[int | None], texts: list[bytes]) -> tuple[int, int, bytes, bytes]:
    """How many documents have terms, how many terms they have, the dictionary and the postings."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    data, begin, end, owner = term_spans([texts[i] for i in order])
    distinct, where, of = _grouped(data, begin, end)
    lengths, n = np.bincount(owner, minlength=len(ids)), len(ids)
    pairs, tf = np.unique(of * n + owner, return_counts=True)
    term, doc = pairs // n, pairs % n
    df = np.bincount(term, minlength=len(distinct))
    first = np.cumsum(df) - df
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first]
    values, place = np.zeros(2 * len(pairs), np.int64), np.arange(len(pairs)) + first[term]
    values[place], values[place + df[term]] = gap, tf
    postings, ends = to_varints(values)
    ends = ends[2 * np.cumsum(df) - 1]
    size = end[where] - begin[where]
    lexicon = pack({"hash": distinct.astype("<u8"), "df": df.astype("<i8"), "end": ends.astype("<i8"), "size": size.astype("<i8"), "words": data[_spread(begin[where], size)]})
    known = [ids[i] for i in order]
    rest = pack({"id": np.array([i or 0 for i in known], "<i8"), "null": np.array([i is None for i in known], np.uint8), "length": lengths.astype("<i8"), "postings": postings})
    return int((lengths > 0).sum()), len(begin), b"".join(lexicon), b"".join(rest)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each shard: documents, terms, lexicon, postings."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            columns = zip(index_shard(ids, texts), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in columns], ["documents", "terms", "lexicon", "postings"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"].cast(pa.large_binary()), strict=True):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= shard_bytes:
                    yield row()
                    ids, texts, size = [], [], 0
        if ids:
            yield row()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInArrow(build, "documents long, terms long, lexicon binary, postings binary")


class Lexicon:
    """A shard's dictionary."""

    def __init__(self, raw: bytes):
        self.a = unpack(np.frombuffer(raw, np.uint8))
        self.at = np.cumsum(self.a["size"]) - self.a["size"]

    def places(self, words: list[bytes], hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Number of the word and place in the dictionary, for words that it holds."""
        known = self.a["hash"]
        first, last = np.searchsorted(known, hashes), np.searchsorted(known, hashes, "right")
        for i in np.flatnonzero(last > first).tolist():
            for place in range(first[i], last[i]):
                if self.a["words"][self.at[place] : self.at[place] + self.a["size"][place]].tobytes() == words[i]:
                    yield i, place


def _hashes(words: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    return word_hashes(np.frombuffer(b"".join(words), np.uint8), ends - sizes, ends)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def gains(tf: np.ndarray, m: np.ndarray, w: int) -> np.ndarray:
    """What a term of weight ``w`` adds to the scores of documents that hold it ``tf`` times."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def length_terms(length: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Each document's m, by how many terms it has."""
    exact = length if 75 * documents * int(length.max(initial=0)) < 1 << 63 else length.astype(object)
    return (25 + (75 * exact * documents) // terms).astype(np.int64)


def merge(lists: list[tuple[list[int], list[int], int, int]], names: list[float], best: list[tuple[int, float]], k: int) -> None:
    """Takes the documents of all lists one after another and keeps the ``k`` best in the heap ``best``, as score and name.

    Of each list: documents, ascending; what they gain; the most of it; and how often the query has the term. Names rise
    as documents are preferred among equal scores.
    """
    lists = sorted(lists, key=lambda x: x[2] * x[3])
    bounds = list(accumulate(most * times for _, _, most, times in lists))  # what a list and those before it can give
    width, at = len(lists), [0] * len(lists)
    least = best[0][0] if len(best) == k else 1
    first = bisect_left(bounds, least)  # lists before this one can't lift a document by themselves
    heads = [lists[i][0][0] * width + i for i in range(first, width)]
    heapify(heads)
    while heads:
        doc, score = heads[0] // width, 0
        while heads and heads[0] // width == doc:
            i = heads[0] % width
            docs, gained, _, times = lists[i]
            score += times * gained[at[i]]
            at[i] += 1
            if at[i] < len(docs):
                heapreplace(heads, docs[at[i]] * width + i)
            else:
                heappop(heads)
        for i in range(first - 1, -1, -1):
            if score + bounds[i] < least:
                break
            docs, gained, _, times = lists[i]
            at[i] = place = bisect_left(docs, doc, at[i])
            if place < len(docs) and docs[place] == doc:
                score += times * gained[place]
        if score < least:
            continue
        if len(best) < k:
            heappush(best, (score, names[doc]))
        elif (score, names[doc]) > best[0]:
            heapreplace(best, (score, names[doc]))
        if len(best) == k and best[0][0] > least:
            least = best[0][0]
            if (now := bisect_left(bounds, least)) > first:
                first = now
                heads = [h for h in heads if h % width >= first]
                heapify(heads)


def _answers(index: DataFrame, queries: dict[bytes, Counter], documents: int, terms: int, k: int) -> DataFrame:
    """digest, score and doc_id: of each query the ``k`` best of each task."""
    words = sorted(set().union(*queries.values()))
    hashes = _hashes(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(words), np.int64)
        for batch in batches:
            for raw in batch["lexicon"]:
                lexicon = Lexicon(raw.as_py())
                for i, place in lexicon.places(words, hashes):
                    df[i] += lexicon.a["df"][place]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], ["word", "df"])

    held = index.select("lexicon").mapInArrow(count, "word int, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()
    weights = {r["word"]: weight(documents, r["df"]) for r in held}
    numbers = {w: i for i, w in enumerate(words)}
    asked = {digest: [(numbers[w], n) for w, n in query.items()] for digest, query in queries.items()}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, list[tuple[int, float]]] = {digest: [] for digest in asked}
        for batch in batches:
            for raw, rest in zip(batch["lexicon"], batch["postings"], strict=True):
                lexicon, a = Lexicon(raw.as_py()), unpack(np.frombuffer(rest.as_py(), np.uint8))
                m = length_terms(a["length"], documents, terms)
                names = [-math.inf if null else -i for i, null in zip(a["id"].tolist(), a["null"].tolist(), strict=True)]
                found = {}
                for i, place in lexicon.places(words, hashes):
                    n, start = int(lexicon.a["df"][place]), int(lexicon.a["end"][place - 1]) if place else 0
                    values = from_varints(a["postings"][start : lexicon.a["end"][place]])
                    docs = np.cumsum(values[:n])
                    gained = gains(values[n:], m[docs], weights[i])
                    found[i] = (docs.tolist(), gained.tolist(), int(gained.max()))
                for digest, query in asked.items():
                    if lists := [(*found[i], times) for i, times in query if i in found]:
                        merge(lists, names, best[digest], k)
        rows = [(digest, score, None if name == -math.inf else -name) for digest, heap in best.items() for score, name in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.binary(), pa.int64(), pa.int64()))], ["digest", "score", "doc_id"])

    return index.select("lexicon", "postings").mapInArrow(search, "digest binary, score long, doc_id long")


def search(index: DataFrame, items: DataFrame, k: int = BEST, item_col: str = "item_id", text_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` best documents of ``build_index`` for each item, of scores above 0.

    ``index`` is read twice for each block of queries, so it should be a written table.
    """
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    texts = written(asked.groupBy("digest").agg(F.first("text").alias("text")), "query-texts")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    documents, terms = index.agg(F.sum("documents"), F.sum("terms")).first()
    blocks, found = math.ceil(total / query_bytes), None
    for block in range(blocks if documents else 0):
        rows = texts.where(F.pmod(F.xxhash64("digest"), F.lit(blocks)) == block).collect()  # about query_bytes
        queries = {bytes(r["digest"]): q for r in rows if (q := Counter(terms_of(r["text"])))}
        if queries:
            part = _answers(index, queries, documents, terms, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("digest").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return asked.select("item_id", "digest").join(ranked, "digest").select("item_id", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """``search`` over an index of ``docs`` (doc_id, text) that is built for it."""
    return search(written(build_index(docs), "postings"), items, k)
