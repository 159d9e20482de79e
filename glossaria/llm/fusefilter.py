"""A static three-wise binary fuse filter over 64-bit keys, built once and never changed."""

from __future__ import annotations

import math

import numpy as np

_U = np.uint64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A well mixed 64-bit hash of each 64-bit key."""
    with np.errstate(over="ignore"):
        x = keys.astype(_U) + _U(seed)
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


def _shape(n: int) -> tuple[int, int]:
    """Length of a segment (a power of two) and number of start segments."""
    length = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(max(n, 2)))
    segments = max(1, math.ceil(max(n, 1) * factor / length) - 2)
    return length, segments


def _places(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """Three cells for each hash, in three adjoining segments."""
    first = ((h >> _U(32)) * _U(segments) >> _U(32)).astype(np.int64) * length
    inner = _U(length - 1)
    return np.stack([first + ((h >> _U(shift)) & inner).astype(np.int64) + part * length for part, shift in enumerate((0, 18, 36))])


def _print(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> _U(32))).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """The filter of the distinct keys: a header of seed, segment length and segments, then one byte a cell."""
    keys = np.unique(keys.astype(_U))
    length, segments = _shape(len(keys))
    for seed in range(1, 200):
        h = mix(keys, seed)
        places = _places(h, length, segments)
        cells = length * (segments + 2)
        order, owner = _peel(places, cells)
        if len(order) == len(keys):
            prints = _print(h)
            table = np.zeros(cells, np.uint8)
            # Waves are peeled from the last to the first; keys of one wave own different cells.
            for wave in reversed(owner):
                key, cell = wave
                three = places[:, key]
                table[cell] = prints[key] ^ table[three[0]] ^ table[three[1]] ^ table[three[2]] ^ table[cell]
            return np.array([seed, length, segments], "<u8").tobytes() + table.tobytes()
        if seed % 20 == 0:
            segments += max(1, segments // 8)
    raise RuntimeError("no seed peels these keys")


def _peel(places: np.ndarray, cells: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Takes off, wave by wave, the keys that are alone in some cell. A wave: keys and the cells they own."""
    n = places.shape[1]
    count = np.bincount(places.ravel(), minlength=cells)
    which = np.zeros(cells, np.int64)
    ids = np.arange(n)
    for row in places:
        np.bitwise_xor.at(which, row, ids)
    waves, done, gone = [], [], np.zeros(n, bool)
    alone = np.flatnonzero(count == 1)
    while len(alone):
        keys = which[alone]
        keys, at = np.unique(keys, return_index=True)
        cell = alone[at]
        fresh = ~gone[keys]
        keys, cell = keys[fresh], cell[fresh]
        if not len(keys):
            break
        # A key whose cell shares another key of the wave is no trouble: each cell here has count 1.
        gone[keys] = True
        done.append(keys)
        waves.append((keys, cell))
        touched = places[:, keys]
        for row in touched:
            np.subtract.at(count, row, 1)
            np.bitwise_xor.at(which, row, keys)
        alone = np.unique(touched.ravel())
        alone = alone[count[alone] == 1]
    return (np.concatenate(done) if done else np.zeros(0, np.int64)), waves


def contains(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key that was built in, and for about one other in 256."""
    seed, length, segments = (int(x) for x in np.frombuffer(filter_bytes, "<u8", 3))
    table = np.frombuffer(filter_bytes, np.uint8, offset=24)
    h = mix(keys, seed)
    a, b, c = _places(h, length, segments)
    return table[a] ^ table[b] ^ table[c] == _print(h)
