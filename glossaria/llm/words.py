"""Texts to token ids, exactly as the tokenizers library encodes them, many texts at a time.

A tokenizer's merges never cross the words that its pre-tokenizer cuts. Texts of ASCII and Latin letters are cut into
words as array operations over their bytes; equal words are found by hashing and confirmed byte for byte, and each
distinct one is merged once, or remembered from before. A text with any other character, or with an apostrophe (they
begin the pattern's contractions), is cut by the library; its words are then merged here like others. Texts with a special
token's string, and those for a vocabulary that changes letters, go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from tokenizers import Tokenizer

from .fusefilter import mix
from .merges import Merges, byte_letters

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel ones

_U = np.uint64
#: Distinct words that a worker remembers before it starts anew, and bytes of text that it takes up at a time.
REMEMBERED, TOGETHER, LONGEST = 1_500_000, 2 << 20, 200

_LETTER, _NUMBER, _SPACE, _BREAK, _MARK = range(5)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 192), 0xC3, 0xC4, 0xC5]] = _LETTER
_CLASS[list(b"0123456789")] = _NUMBER
_CLASS[32] = _SPACE
_CLASS[[9, 10, 13]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Texts of these characters alone are cut here: letters up to U+017F, for lower-casing vocabularies up to U+00FF.
_BYTE_PLAIN = re.compile("[\t\n\r -&(-~À-ÖØ-öø-ſ]*")
_CASE_PLAIN = re.compile("[\t\n\r -&(-~À-ÖØ-öø-ÿ]*")

#: The byte that each letter of a byte-level vocabulary stands for.
_BYTE_OF = {ord(letter): byte for byte, letter in byte_letters().items()}

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def eights(data: np.ndarray) -> np.ndarray:
    """A view of the eight bytes that begin at each place as one integer; zeros follow the last."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _rounds(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Eight bytes of each span at a time: which spans still have some, how far inside they are, and a mask for them."""
    live, left, inside = np.arange(len(begin)), end - begin, 0
    while len(live):
        yield live, inside, _MASKS[np.minimum(left, 8)]
        on = left > 8
        live, left, inside = live[on], left[on] - 8, inside + 8


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    return word_hash_pairs(data, begin, end, False)[0]


def word_hash_pairs(data: np.ndarray, begin: np.ndarray, end: np.ndarray, both: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Two 64-bit hashes of the bytes of each span, built in different ways: a chain over its groups of eight bytes, and
    a sum of hashes of each group by its place. Spans beyond LONGEST bytes have the halves of their XXH3-128."""
    lanes = eights(data)
    chain = mix((end - begin).astype(_U), 3)
    total = mix((end - begin).astype(_U), 4) if both else None
    long = end - begin > LONGEST
    some = np.flatnonzero(~long) if long.any() else None
    first, last = (begin, end) if some is None else (begin[some], end[some])
    for live, inside, mask in _rounds(first, last):
        x = lanes[first[live] + inside] & mask
        at = live if some is None else some[live]
        chain[at] = mix(chain[at] ^ x, 5)
        if both:
            with np.errstate(over="ignore"):
                total[at] += mix(x ^ _U(0x9E3779B97F4A7C15 * (inside + 1) % (1 << 64)), 6)
    for i in np.flatnonzero(long).tolist():
        digest = xxhash.xxh3_128_intdigest(memoryview(data[begin[i] : end[i]]))
        chain[i] = digest & 0xFFFFFFFFFFFFFFFF
        if both:
            total[i] = digest >> 64
    return chain, total


def same_bytes(one: np.ndarray, begin: np.ndarray, end: np.ndarray, other: np.ndarray, begin2: np.ndarray, end2: np.ndarray) -> np.ndarray:
    """Whether each span of ``one`` holds the same bytes as its partner in ``other``; both are views of ``eights``."""
    same = end - begin == end2 - begin2
    where = np.flatnonzero(same)
    first, second = begin[where], begin2[where]
    for live, inside, mask in _rounds(first, end[where]):
        differ = (one[first[live] + inside] ^ other[second[live] + inside]) & mask != 0
        same[where[live[differ]]] = False
    return same


def cut_bytes(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the words of a byte-level vocabulary. ``first``: True where a text begins."""
    kind = _CLASS[data]
    blank = (kind == _SPACE) | (kind == _BREAK)
    last = np.append(first[1:], True)
    changed = np.concatenate([[True], kind[1:] != kind[:-1]]) | first
    after_space = np.concatenate([[False], kind[:-1] == _SPACE]) & ~first
    begins = ~blank & changed & ~after_space
    begins |= blank & (np.concatenate([[True], ~blank[:-1]]) | first)  # a run of white space
    begins |= blank & np.concatenate([~blank[1:], [False]]) & ~last  # its last character, before a word
    begin = np.flatnonzero(begins)
    return begin, np.append(begin[1:], len(data))


def cut_cased(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the words of a vocabulary that drops white space and takes each digit by itself."""
    kind = _CLASS[data]
    blank = (kind == _SPACE) | (kind == _BREAK)
    begins = ~blank & (np.concatenate([[True], kind[1:] != kind[:-1]]) | first | (kind == _NUMBER))
    ends = np.append(begins[1:] | blank[1:] | first[1:], True) & ~blank
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes of plain text in lower case: A-Z, and À-Þ after their lead byte."""
    out = _LOWER[data]
    capital = np.concatenate([[False], data[:-1] == 0xC3]) & (data < 0x9F)
    out[capital] += 32
    return out


class Words:
    """Encodes texts by one vocabulary file. One instance serves a worker process.

    ``shortcut``: another source of a word's ids, tried before the merges. It gets words and returns what ``Merges.encode``
    returns, with no ids for those it doesn't know.
    """

    _open: dict[tuple, Words] = {}

    def __init__(self, path: str, shortcut: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]] | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cased = self.tokenizer.normalizer is not None
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges, self.shortcut = Merges(path), shortcut
        self._forget()

    @classmethod
    def of(cls, path: str, key: str = "", shortcut=None) -> Words:
        if (path, key) not in cls._open:
            cls._open[path, key] = cls(path, shortcut() if shortcut else None)
        return cls._open[path, key]

    def _forget(self) -> None:
        """Remembered words: their hashes, ascending; where each one's ids and bytes are, and how many."""
        self.hashes = np.zeros(0, _U)
        self.at, self.n, self.byte_at, self.bytes_n = (np.zeros(0, np.int64) for _ in range(4))
        self.pool, self.bytes = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def plain(self, text: str) -> bool:
        pattern = _CASE_PLAIN if self.cased else _BYTE_PLAIN
        return bool(pattern.fullmatch(text)) and not ("<|" in text and any(s in text for s in self.specials))

    def pieces(self, text: str) -> list[bytes] | None:
        """The words that the library cuts a text into; None if its ids aren't those of its words one by one."""
        if self.cased or any(s in text for s in self.specials):
            return None
        return [word.translate(_BYTE_OF).encode("latin-1") for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _encode_pieces(self, texts: list[tuple[int, list[bytes]]], out: list) -> None:
        words = [w for _, pieces in texts for w in pieces]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        end, ids, counts = np.cumsum(lengths), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if words:
            ids, counts = self._ids(np.frombuffer(b"".join(words), np.uint8), end - lengths, end)
        marks = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *(len(pieces) for _, pieces in texts)])]
        for k, (i, _) in enumerate(texts):
            out[i] = ids[marks[k] : marks[k + 1]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        out: list[np.ndarray | None] = [None] * len(texts)
        some, odd, size, odd_size = [], [], 0, 0
        for i, text in enumerate(texts):
            if not self.plain(text):
                if (pieces := self.pieces(text)) is None:
                    out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                    continue
                odd.append((i, pieces))
                odd_size += len(text)
                if odd_size >= TOGETHER:
                    self._encode_pieces(odd, out)
                    odd, odd_size = [], 0
                continue
            some.append((i, text.encode()))
            size += len(some[-1][1])
            if size >= TOGETHER:
                self._encode_plain(some, out)
                some, size = [], 0
        self._encode_plain(some, out)
        self._encode_pieces(odd, out)
        return out

    def _encode_plain(self, some: list[tuple[int, bytes]], out: list) -> None:
        lengths = np.array([len(t) for _, t in some], np.int64)
        data = np.frombuffer(b"".join(t for _, t in some), np.uint8)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.zeros(0, np.int64)
        begin, ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        if len(data):
            first = np.zeros(len(data), bool)
            first[bounds[:-1][lengths > 0]] = True
            if self.cased:
                data = lowered(data)
            begin, end = (cut_cased if self.cased else cut_bytes)(data, first)
            ids, counts = self._ids(data, begin, end)
        ends = np.concatenate([[0], np.cumsum(counts)])
        marks = ends[np.searchsorted(begin, bounds)]
        for k, (i, _) in enumerate(some):
            out[i] = ids[marks[k] : marks[k + 1]]

    def _ids(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all spans in a row, and how many each has.

        Hashes find equal words, and bytes confirm them. What isn't the word that its hash stands for, and spans beyond
        LONGEST, are told apart by their bytes alone.
        """
        distinct, where, of = np.unique(word_hashes(data, begin, end), return_index=True, return_inverse=True)
        lanes, first, last = eights(data), begin[where], end[where]
        place = np.searchsorted(self.hashes, distinct)
        met = np.zeros(len(distinct), bool)
        inside = place < len(self.hashes)
        met[inside] = self.hashes[place[inside]] == distinct[inside]
        short = last - first <= LONGEST
        new = ~met & short
        if len(self.hashes) and len(self.hashes) + int(new.sum()) > REMEMBERED:
            self._forget()
            return self._ids(data, begin, end)
        sure = short.copy()
        if met.any():
            known = np.flatnonzero(met & short)
            at = self.byte_at[place[known]]
            sure[known] = same_bytes(lanes, first[known], last[known], eights(self.bytes), at, at + self.bytes_n[place[known]])
        if new.any():
            raw = data.tobytes()
            some = [raw[a:b] for a, b in zip(first[new].tolist(), last[new].tolist(), strict=True)]
            flat, starts = self.encode_words(some)
            to, lengths = place[new], last[new] - first[new]
            self.hashes = np.insert(self.hashes, to, distinct[new])
            self.at, self.n = np.insert(self.at, to, starts[:-1] + len(self.pool)), np.insert(self.n, to, np.diff(starts))
            self.byte_at, self.bytes_n = np.insert(self.byte_at, to, np.cumsum(lengths) - lengths + len(self.bytes)), np.insert(self.bytes_n, to, lengths)
            self.pool = np.concatenate([self.pool, flat.astype(np.uint32)])
            self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(some), np.uint8)])
            place = np.searchsorted(self.hashes, distinct)
        sure_span = sure[of]
        sure_span[sure_span] = same_bytes(lanes, begin[sure_span], end[sure_span], lanes, first[of[sure_span]], last[of[sure_span]])
        if sure_span.all():
            n = self.n[place][of]
            return self.pool[_spread(self.at[place][of], n)], n
        return self._ids_apart(data, begin, end, place[of], sure_span)

    def _ids_apart(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, place: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_ids``, where the spans that aren't ``sure`` are grouped by their bytes."""
        raw, odd = data.tobytes(), np.flatnonzero(~sure)
        spans = [raw[a:b] for a, b in zip(begin[odd].tolist(), end[odd].tolist(), strict=True)]
        number = {word: i for i, word in enumerate(dict.fromkeys(spans))}
        flat, starts = self.encode_words(list(number))
        which = np.fromiter((number[w] for w in spans), np.int64, len(spans))
        n = np.zeros(len(begin), np.int64)
        n[sure], n[odd] = self.n[place[sure]], np.diff(starts)[which]
        out, to = np.zeros(int(n.sum()), np.uint32), np.cumsum(n) - n
        out[_spread(to[sure], n[sure])] = self.pool[_spread(self.at[place[sure]], n[sure])]
        out[_spread(to[odd], n[odd])] = flat[_spread(starts[:-1][which], n[odd])]
        return out, n

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where each word's begin, with the end."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        pieces: list[np.ndarray | None] = [None] * len(words)
        rest = [i for i, w in enumerate(words) if len(w) <= LONGEST]
        for i in set(range(len(words))).difference(rest):
            pieces[i] = np.array(self.tokenizer.encode([words[i].decode()], is_pretokenized=True, add_special_tokens=False).ids, np.uint32)
        if self.shortcut and rest:
            flat, starts = self.shortcut([words[i] for i in rest])
            for i, a, b in zip(rest, starts.tolist(), starts[1:].tolist(), strict=False):
                if b > a:
                    pieces[i] = flat[a:b]
            rest = [i for i in rest if pieces[i] is None]
        if len(rest) == len(words):
            return self.merges.encode(words)
        flat, starts = self.merges.encode([words[i] for i in rest])
        for i, a, b in zip(rest, starts.tolist(), starts[1:].tolist(), strict=False):
            pieces[i] = flat[a:b]
        return np.concatenate([np.zeros(0, np.int64), *pieces]), np.concatenate([[0], np.cumsum([len(p) for p in pieces], dtype=np.int64)])


def _spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of the runs that begin at ``at`` and are ``n`` long."""
    before = np.cumsum(n) - n
    return np.repeat(at - before, n) + np.arange(int(n.sum()))
