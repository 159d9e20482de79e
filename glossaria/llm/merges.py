"""Byte-pair merges of many words at a time, as array operations over all their symbols.

Round by round, every word merges the pair of lowest rank that it holds, the leftmost of equals, until none is left:
the definition of byte-pair encoding, with the merges of a tokenizers vocabulary file.
"""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int64(1) << 62
_AT = 40  # bits of a position; ranks need 17 more


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class Merges:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            model = json.load(source)["model"]
        vocabulary, suffix, letters = model["vocab"], model.get("end_of_word_suffix") or "", byte_letters()
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[letters[b] + suffix] for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.rank, self.made = keys, first.astype(np.int64), made[first]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return np.where(known, self.rank[at], -1), self.made[at]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where each word's ids begin, with the end. No word may be empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        sym[starts[1:] - 1] = self.last[raw[starts[1:] - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_word, done_sym = [], []
        rank, made = np.full(len(sym), -1, np.int64), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            inside = word[:-1] == word[1:]
            r, m = self._ranks(sym[:-1], sym[1:])
            rank[:-1], made[:-1] = np.where(inside, r, -1), m
        while len(sym):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            order = np.where(rank >= 0, rank << _AT | np.arange(len(sym)), _NONE)
            best = np.minimum.reduceat(order, begin)
            active = best < _NONE
            if active.sum() * 2 < len(active):  # words that are ready leave
                busy = np.repeat(active, np.diff(np.append(begin, len(sym))))
                done_word.append(word[~busy])
                done_sym.append(sym[~busy])
                sym, word, rank, made = sym[busy], word[busy], rank[busy], made[busy]
                continue
            at = best[active] & ((1 << _AT) - 1)
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            to = at - np.arange(len(at))  # places after the compaction: one symbol of each earlier word has gone
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            look = np.concatenate([to, to[to > 0] - 1])
            other = np.minimum(look + 1, len(sym) - 1)
            r, m = self._ranks(sym[look], sym[other])
            rank[look], made[look] = np.where((word[look] == word[other]) & (other > look), r, -1), m
        all_words, ids = np.concatenate(done_word or [np.zeros(0, np.int64)]), np.concatenate(done_sym or [np.zeros(0, np.int64)])
        ids = ids[np.argsort(all_words, kind="stable")]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(all_words, minlength=len(words)))])
