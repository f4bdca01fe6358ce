"""The offline embedder: signed feature hashing of words and character trigrams."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS, PROJECTIONS = 1024, 3
#: FNV-1a. Fixed values.
OFFSET, PRIME = 0x811C9DC5, 0x01000193
#: Texts that are embedded at a time.
ROWS = 1000


@lru_cache(maxsize=50_000)
def _word(word: str) -> frozenset[str]:
    solid = re.sub("[_-]", "", word)
    around = f" {solid or word} "
    return frozenset({word, solid or word, *(around[i : i + 3] for i in range(len(around) - 2))})


def features(text: str) -> set[str]:
    low = unicodedata.normalize("NFKD", text.lower())
    low = re.sub("[\u0300-\u036f]", "", low)
    return set().union(*map(_word, re.sub(r"[^a-z0-9_\s-]+", " ", low).split()))


def fnv1a(tokens: list[str], seed: int) -> np.ndarray:
    """The hash of each token, of ASCII characters."""
    size = np.array([len(t) for t in tokens], np.int64)
    chars = np.zeros((len(tokens), int(size.max(initial=0))), np.uint64)
    chars[np.arange(chars.shape[1])[None, :] < size[:, None]] = np.frombuffer("".join(tokens).encode("ascii"), np.uint8)
    h = np.full(len(tokens), OFFSET ^ seed, np.uint64)
    for k in range(chars.shape[1]):
        h = np.where(k < size, ((h ^ chars[:, k]) * np.uint64(PRIME)) & np.uint64(0xFFFFFFFF), h)
    return h


def embed_all(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A unit vector for each text, or zeros for one without words. Each distinct token is hashed once, ROWS texts at a time."""
    if len(texts) > ROWS:
        return np.concatenate([embed_all(texts[k : k + ROWS], dimensions) for k in range(0, len(texts), ROWS)])
    found = [features(t or "") for t in texts]
    number = {t: k for k, t in enumerate(set().union(*found))}
    tokens = list(number)
    of = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    token = np.array([number[t] for f in found for t in sorted(f)], np.int64)  # sorted: sums don't depend on the order of a set
    weight = np.where(np.array([len(t) for t in tokens], np.int64) <= 3, 0.5, 1.0)
    v = np.zeros(len(texts) * dimensions)
    for k in range(PROJECTIONS if tokens else 0):
        place = (fnv1a(tokens, k + 1) % np.uint64(dimensions)).astype(np.int64)
        signed = np.where(fnv1a(tokens, k + 100) & np.uint64(1), weight, -weight)
        v += np.bincount(of * dimensions + place[token], signed[token], len(v))  # halves: sums are exact in any order
    v = v.reshape(len(texts), dimensions)
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, norm, out=v, where=norm > 0).astype(np.float32)


def embed(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    return embed_all([text], dimensions)[0]


def embed_column(c: Column, dimensions: int = DIMENSIONS) -> Column:
    return F.pandas_udf(lambda s: pd.Series([*embed_all(s.tolist(), dimensions)], dtype=object), "array<float>")(c)
