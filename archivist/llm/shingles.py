"""Hashed word shingles of whole texts, a batch at a time.

Words are runs of bytes other than space and 0x09 to 0x0D, A to Z in lower case. A word's hash comes from one
running sum over the batch, so nothing is done for each word in Python. Hashes have 64 bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse."""
    if len(_powers[0]) < n:
        n = max(n, _CHUNK + 1)
        for k, p in enumerate((_P, _INVERSE)):
            a = np.full(n, p, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers[0], _powers[1]


def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about a megabyte; a longer text is a run of its own."""
    run, n = [], 0
    for t in texts:
        if run and n + len(t) > _CHUNK:
            yield run
            run, n = [], 0
        run.append(t)
        n += len(t)
    if run:
        yield run


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has one, a text without words none."""
    out = []
    for run in chunks(texts):
        data = np.frombuffer(b" ".join(run) + b" ", np.uint8)
        up, down = powers(len(data) + 1)
        space = _SPACE[data]
        start = np.flatnonzero(~space & np.r_[True, space[:-1]])
        end = np.flatnonzero(space & np.r_[False, ~space[:-1]])
        total = np.r_[np.uint64(0), np.cumsum(_LOWER[data] * up[: len(data)], dtype=np.uint64)]
        word = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _P)
        bounds = np.cumsum([len(t) + 1 for t in run])
        cut = np.searchsorted(start, bounds)
        m = len(word) - words + 1
        if m > 0:
            h = word[:m].copy()
            for k in range(1, words):
                h = h * _P + word[k : m + k]
            h = mix(h)
        a = 0
        for b in cut.tolist():
            if b - a >= words:
                out.append(np.unique(h[a : b - words + 1]))
            elif b > a:
                h1 = np.full(1, b - a, np.uint64)
                for k in range(a, b):
                    h1 = mix(h1 * _P + word[k : k + 1])
                out.append(h1)
            else:
                out.append(np.empty(0, np.uint64))
            a = b
    return out
