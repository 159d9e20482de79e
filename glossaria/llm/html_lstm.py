"""A bidirectional LSTM in numpy that labels the blocks of a page as main text or not, and its training.

A block is a vector: hashed tags, classes and ids of its path, hashed words, and a few numbers. The network reads a
page's blocks in both directions, so every block is judged by the whole document. It is trained on the pages that
``html_training`` writes.
"""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np

from .html_blocks import Block, Element, blocks
from .html_training import MARK, training_page

PATHS, WORDS, NUMBERS, HIDDEN = 192, 64, 10, 24
SIZE = PATHS + WORDS + NUMBERS
#: Elements around a block that describe it, and blocks of a page that are vectors at a time.
DEPTH, STRETCH = 32, 4096

_places: dict[tuple, np.ndarray] = {}


def _element_places(element: Element) -> np.ndarray:
    """The places of an element's name and marks among PATHS."""
    key = (element.name, element.words)
    if key not in _places:
        if len(_places) > 50_000:
            _places.clear()
        tokens = {element.name, *(f".{m}" for mark in element.words for m in {mark, *_parts(mark)})}
        _places[key] = np.array(sorted({zlib.crc32(t.encode("utf-8", "replace")) % PATHS for t in tokens}), np.int64)
    return _places[key]


def _path_vector(inside: Element | None) -> np.ndarray:
    if inside is None:
        return np.zeros(PATHS, np.float32)
    if inside.vector is None:
        out = np.zeros(PATHS, np.float32)
        for depth, element in enumerate(inside.path(DEPTH)):
            at = _element_places(element)
            out[at] = np.maximum(out[at], 1.0 if depth < 6 else 0.7)
        inside.vector = out
    return inside.vector


def _parts(mark: str) -> list[str]:
    return [p for p in mark.replace("_", "-").split("-") if p]


def vectors(page: list[Block], begin: int = 0, end: int | None = None) -> np.ndarray:
    """One row for each block from ``begin`` to ``end``."""
    part, total = page[begin:end], len(page)
    out = np.zeros((len(part), SIZE), np.float32)
    for i, block in enumerate(part):
        out[i, :PATHS] = _path_vector(block.inside)
        words = block.text.split(" ")
        hashed = np.fromiter((zlib.crc32(w.strip(".,:;!?()").lower().encode("utf-8", "replace")) for w in words), np.int64, len(words)) % WORDS
        out[i, PATHS : PATHS + WORDS] = np.sqrt(np.bincount(hashed, minlength=WORDS) / len(words))
        n, place = len(block.text), begin + i
        out[i, PATHS + WORDS :] = (
            np.log1p(n) / 8, np.log1p(len(words)) / 6, min(1.0, block.linked / n), min(3.0, n / len(words) / 16), block.text[-1] in ".!?:\"”",
            place / total, (total - place) / total, np.log1p(total) / 6, "©" in block.text, block.text.count(",") > 0,
        )
    return out


@dataclass
class Labeller:
    """Weights: for each direction the input's, the state's and the bias of four gates; then the output's."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"{d}x"] = rng.normal(0, 1 / np.sqrt(SIZE), (SIZE, 4 * HIDDEN)).astype(np.float32)
            w[f"{d}h"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            w[f"{d}c"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
        w["o"] = rng.normal(0, 0.1, 2 * HIDDEN).astype(np.float32)
        w["s"] = rng.normal(0, 0.1, SIZE).astype(np.float32)
        w["c"] = np.zeros(1, np.float32)
        return cls(w)

    def _scan(self, x: np.ndarray, there: np.ndarray, d: str, kept: list | None = None, begin: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """States (time, pages, hidden) of one direction, and the last one, from which a scan can ``begin``. ``kept``
        gets what the gradient needs. Padding leaves the state alone."""
        w, (steps, pages, _) = self.weights, x.shape
        pre = x @ w[f"{d}x"] + w[f"{d}c"]
        h, c = begin or (np.zeros((pages, HIDDEN), np.float32),) * 2
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ w[f"{d}h"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = there[t][:, None]
            c2 = np.where(m, f * c + i * g, c)
            tc = np.tanh(c2)
            h2 = np.where(m, o * tc, h)
            if kept is not None:
                kept.append((t, h, c, i, f, o, g, tc, m))
            h, c, out[t] = h2, c2, h2
        return out, (h, c)

    def logits(self, x: np.ndarray, there: np.ndarray, kept: dict[str, list] | None = None):
        both = np.concatenate([self._scan(x, there, d, kept[d] if kept else None)[0] for d in "fb"], axis=2)
        return both @ self.weights["o"] + x @ self.weights["s"] + self.weights["c"], both

    def _long_page(self, page: list[Block]) -> np.ndarray:
        """The logits of a page of many blocks, STRETCH of which are vectors at a time."""
        forward, out, state = np.zeros((len(page), HIDDEN), np.float32), np.zeros(len(page), np.float32), None
        for at in range(0, len(page), STRETCH):
            x = vectors(page, at, at + STRETCH)[:, None]
            states, state = self._scan(x, np.ones(x.shape[:2], bool), "f", begin=state)
            forward[at : at + STRETCH] = states[:, 0]
        state = None
        for at in reversed(range(0, len(page), STRETCH)):
            x = vectors(page, at, at + STRETCH)[:, None]
            states, state = self._scan(x, np.ones(x.shape[:2], bool), "b", begin=state)
            both = np.concatenate([forward[at : at + STRETCH], states[:, 0]], axis=1)
            out[at : at + STRETCH] = both @ self.weights["o"] + x[:, 0] @ self.weights["s"] + self.weights["c"]
        return out

    def _back(self, x: np.ndarray, kept: list, dout: np.ndarray, d: str, grads: dict[str, np.ndarray]) -> None:
        w = self.weights
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t, h, c, i, f, o, g, tc, m in reversed(kept):
            dh = dh + dout[t]
            dc2 = dc + np.where(m, dh * o * (1 - tc * tc), 0)
            zero = np.float32(0)
            dz = np.concatenate([np.where(m, dc2 * g * i * (1 - i), zero), np.where(m, dc2 * c * f * (1 - f), zero), np.where(m, dh * tc * o * (1 - o), zero), np.where(m, dc2 * i * (1 - g * g), zero)], axis=1)
            dz_all[t] = dz
            grads[f"{d}h"] += h.T @ dz
            dh = np.where(m, dz @ w[f"{d}h"].T, dh)
            dc = np.where(m, dc2 * f, dc2)
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grads[f"{d}x"] += x.reshape(-1, SIZE).T @ flat
        grads[f"{d}c"] += flat.sum(axis=0)

    def gradients(self, x: np.ndarray, there: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss of the blocks that are there, and its gradients."""
        kept: dict[str, list] = {"f": [], "b": []}
        logits, both = self.logits(x, there, kept)
        p = 1 / (1 + np.exp(-logits))
        n = max(1, int(there.sum()))
        loss = -np.log(np.clip(np.where(y > 0, p, 1 - p), 1e-7, 1))[there].sum() / n
        dl = (np.where(there, p - y, 0) / n).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.weights.items()}
        grads["o"] = np.einsum("tp,tph->h", dl, both)
        grads["s"] = np.einsum("tp,tps->s", dl, x)
        grads["c"][0] = dl.sum()
        dboth = dl[:, :, None] * self.weights["o"]
        self._back(x, kept["f"], dboth[:, :, :HIDDEN], "f", grads)
        self._back(x, kept["b"], dboth[:, :, HIDDEN:], "b", grads)
        return float(loss), grads

    def main_blocks(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text. Pages of like length are read together."""
        out = [np.zeros(len(p), bool) for p in pages]
        for i, page in enumerate(pages):
            if len(page) > STRETCH:
                out[i] = self._long_page(page) > 0
        order = sorted((i for i in range(len(pages)) if 0 < len(pages[i]) <= STRETCH), key=lambda i: len(pages[i]))
        group: list[int] = []
        for k, i in enumerate(order):
            group.append(i)
            if k + 1 == len(order) or (len(group) + 1) * len(pages[order[k + 1]]) > STRETCH:
                x, there = padded([vectors(pages[j]) for j in group])
                logits = self.logits(x, there)[0]
                for column, j in enumerate(group):
                    out[j] = logits[: len(pages[j]), column] > 0
                group = []
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, there = np.zeros((steps, len(pages), SIZE), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], there[: len(p), k] = p, True
    return x, there


def marked_blocks(page: str) -> tuple[list[Block], np.ndarray]:
    """The blocks of a training page, and which are main text."""
    found = blocks(page)
    main = np.array([MARK in b.text for b in found], bool)
    for b in found:
        b.text = b.text.replace(MARK, "") or "."
    return found, main


@cache
def train(pages: int = 2400, epochs: int = 10, seed: int = 4) -> Labeller:
    """Adam over pages of ``training_page``; the same seed gives the same weights. A process trains once."""
    rng = random.Random(seed)
    data = []
    for _ in range(pages):
        found, main = marked_blocks(training_page(rng))
        if found:
            data.append((vectors(found), main.astype(np.float32)))
    model = Labeller.fresh(seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        rng.shuffle(data)
        alike = [d for at in range(0, len(data), 400) for d in sorted(data[at : at + 400], key=lambda d: len(d[0]))]
        batches = [alike[at : at + 40] for at in range(0, len(alike), 40)]  # pages of like length, so that little is padding
        rng.shuffle(batches)
        for part in batches:
            x, there = padded([v for v, _ in part])
            y = np.zeros(there.shape, np.float32)
            for k, (_, labels) in enumerate(part):
                y[: len(labels), k] = labels
            _, grads = model.gradients(x, there, y)
            step += 1
            for k, g in grads.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                model.weights[k] = model.weights[k] - np.float32(0.02 * 0.82**epoch) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)
    return model


#: Where the weights that ``python -m glossaria.llm.html_lstm`` has learned are kept.
WEIGHTS = Path(__file__).with_name("html_weights.npz")


@cache
def pretrained() -> Labeller:
    """The kept weights: what ``train`` learns. A change of the features, the pages or the fit needs them anew."""
    with np.load(WEIGHTS) as kept:
        return Labeller({name: kept[name] for name in kept.files})


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **train().weights)
