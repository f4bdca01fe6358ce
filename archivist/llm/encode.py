"""Byte-level BPE token ids, with a bounded memory of words already encoded.

A text is cut before each single space that stands between two characters that aren't white
space. The pre-tokenizer of a byte-level BPE never puts such a boundary inside a piece, so the ids
of the parts, joined, are the ids of the text. Each distinct part goes through the tokenizers
library once per Python worker while the memory has room; texts with other white space around a
space go through the library whole. Of a part made of Latin letters, ASCII marks but the apostrophe, and single line feeds,
each run of one kind is a piece of the pre-tokenizer, so it goes to the library's BPE model directly.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Distinct words that a worker remembers; when full, only words of the batch at hand stay.
MEMORY = 700_000
#: Words that one call of the library encodes.
TOGETHER = 300
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
_PIECES = re.compile(f"[{_LETTERS}{_MARKS}]+(?:\n[{_LETTERS}{_MARKS}]+)*").fullmatch
_RUNS = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+|\n").findall
#: The character that stands for each byte in a byte-level vocabulary.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def default_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordEncoder:
    """ids(text) as little-endian bytes of unsigned integers of `width` bytes."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.memory = memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.starts = np.zeros(size, bool)  # ids whose bytes begin with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.starts[i] = token.startswith("Ġ")
        self.words: dict[str, bytes | None] = {}
        self.runs: dict[str, bytes] = {}
        self.packed = [int(i).to_bytes(self.dtype.itemsize, "little") for i in range(size)]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        cutter, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.plain = type(cutter).__name__ == "ByteLevel" and cutter.use_regex and not cutter.add_prefix_space and self.tokenizer.normalizer is None and type(self.model).__name__ == "BPE"

    def whole(self, text: str) -> bytes:
        # the same ids as encode(), without offsets
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def piece(self, run: str, before: str = "") -> bytes:
        """The ids of a piece of the pre-tokenizer; a space before it is a Ġ."""
        if not run.isascii() or run == "\n":
            run = run.encode().decode("latin-1").translate(_BYTES)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(before + run)])

    def of_runs(self, word: str) -> bytes:
        first, *rest = _RUNS(word)
        ids = self.words.get(first) or self.piece(first, "Ġ")
        for r in rest:
            if r not in self.runs:
                if len(self.runs) > self.memory // 8:
                    self.runs.clear()
                self.runs[r] = self.piece(r)
            ids += self.runs[r]
        return ids

    def learn(self, new: list[str]) -> None:
        """The ids of ' ' + word for each new word; None where a cut beside it would not be safe."""
        good, packed, tokenize = [], self.packed, self.model.tokenize
        for w in new:
            if not w or w.strip() != w:
                self.words[w] = None
            elif self.plain and w.isascii() and w.isalpha() and w not in self.added:
                self.words[w] = b"".join([packed[t.id] for t in tokenize("Ġ" + w)])
            elif self.plain and _PIECES(w) and not any(t in w for t in self.added):
                self.words[w] = self.of_runs(w)
            else:
                good.append(w)
        size = self.dtype.itemsize
        for k in range(0, len(good), TOGETHER):
            part = good[k : k + TOGETHER]
            raw = self.whole(" " + " ".join(part))
            at = np.flatnonzero(self.starts[np.frombuffer(raw, self.dtype)])
            if len(at) == len(part) and at[0] == 0:
                cut = [*(at * size).tolist(), len(raw)]
                self.words.update(zip(part, map(raw.__getitem__, map(slice, cut, cut[1:])), strict=True))
            else:
                self.words.update((w, self.whole(" " + w)) for w in part)

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [t.split(" ") for t in texts]
        heads = [p.pop(0) for p in parts]
        seen = set().union(*parts)
        new = seen.difference(self.words)
        if len(self.words) + len(new) > self.memory:  # words that came back stay
            self.words = {w: self.words[w] for w in seen - new}
        self.learn(list(new))
        get, out = self.words.__getitem__, []
        for text, head, p in zip(texts, heads, parts, strict=True):
            if head and head[-1].isspace():
                out.append(self.whole(text))
                continue
            try:
                rest = b"".join(map(get, p))
            except TypeError:
                out.append(self.whole(text))
                continue
            out.append((self.whole(head) if head else b"") + rest)
        return out


@lru_cache(maxsize=2)
def encoder(path: str, memory: int = MEMORY) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path, memory)
