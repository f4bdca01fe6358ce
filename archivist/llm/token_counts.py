"""Exact token counts of every prefix of a text, by dynamic programming.

For a BPE, the tokens of a prefix without its last token are the tokens of the shorter prefix. So
with t the last token of text[:i], count(i) = count(i - len(t)) + 1, and t is the one token that
ends at i and is compatible with the last token before it: the library encodes the two together as
those two. Whether a pair is compatible is asked of the library once and remembered.

The state runs word by word, as no piece of the vocabulary holds a space after another character.
What is stored for a text is one signed byte a character, the change of the count; sums of it answer
how many tokens any prefix has and how long a prefix a token budget allows, without encoding again.

Nulls count as empty texts; an empty text has no prefix and no token. Repeated rows are counted each
for itself, and rows without an id as any other; very long texts are counted whole. Only the id and the text column are read, so other
columns can't clash. An empty table gives no rows. Where the recurrence and the library's count of the whole text differ, all prefixes of
the word are encoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivist.llm.common import table

#: Distinct words and token pairs that a worker remembers; when full, a memory starts anew.
MEMORY = 1_000_000
SPACE = "▁"


class PrefixCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [(i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]
        plain = [p for i, p in names if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        if any(SPACE in p.lstrip(SPACE) for p in plain) or any("\n" in p for p in plain):
            raise ValueError("a piece of this model crosses words")
        self.pieces = {p for p in plain if self.of(p) == [p]}  # no text is encoded with the others
        self.bigrams = {p[i : i + 2] for p in plain for i in range(len(p) - 1)}
        self.longest = max(map(len, plain))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def of(self, s: str) -> list[str]:
        """The pieces of s as it stands inside a text. A line feed is a token of its own."""
        return self.model.encode("\n" + s.replace(SPACE, " "), out_type=str)[2:]

    def compatible(self, before: str, after: str) -> bool:
        found = self.pairs.get((before, after))
        if found is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            found = self.pairs[before, after] = self.of(before + after) == [before, after]
        return found

    def cut(self, word: str) -> list[str]:
        """The word cut where no piece of the vocabulary holds the two characters in a row."""
        bigrams = self.bigrams
        at = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in bigrams]
        return [word[i:j] for i, j in zip([0, *at], [*at, len(word)], strict=True)] if at else [word]

    def learn(self, words: set[str]) -> None:
        """Run the recurrence over the parts of new words, in sorted order: a part takes over the states of
        the prefix that it shares with the one before it."""
        if len(self.words) + len(words) > MEMORY:
            self.words.clear()
        cut = {w: self.cut(w) for w in words}
        new = sorted({p for parts in cut.values() for p in parts} - self.parts.keys())
        if len(self.parts) + len(new) > MEMORY:
            self.parts.clear()
            new = sorted({p for parts in cut.values() for p in parts})
        pieces, longest, pairs, whole = self.pieces, self.longest, self.pairs, self.model.encode(["\n" + p.replace(SPACE, " ") for p in new], num_threads=1)
        last: list[str] = [""]  # "": nothing that the next piece could have merged with
        count, before = [0], ""
        for part, ids in zip(new, whole, strict=True):
            k, n = 0, min(len(part), len(before))
            while k < n and part[k] == before[k]:
                k += 1
            del last[k + 1 :], count[k + 1 :]
            before = part
            for i in range(k + 1, len(part) + 1):
                for j in range(i - longest if i > longest else 0, i):
                    t = part[j:i]
                    if t in pieces:
                        p = last[j]
                        if not p or (pairs[p, t] if (p, t) in pairs else self.compatible(p, t)):
                            last.append(t)
                            count.append(count[j] + 1)
                            break
                else:
                    last.append("")
                    count.append(count[-1] + len(part[i - 1].encode("utf-8", "replace")))
            right = count if count[-1] == len(ids) - 2 else [0, *(len(self.of(part[:i])) for i in range(1, len(part) + 1))]
            self.parts[part] = bytes([y - x & 255 for x, y in zip(right, right[1:], strict=False)])
        get = self.parts.__getitem__
        self.words.update((w, b"".join(map(get, parts))) for w, parts in cut.items())

    def texts(self, texts: list[str]) -> list[bytes]:
        """For each text the changes of the count at each character; they sum up to the count of the whole."""
        split = []
        for t in texts:
            parts = t.replace(SPACE, " ").split(" ")  # the model holds the two for the same
            if "" in parts:
                words, run = [], SPACE  # a text is encoded with a space before it
                for p in parts:
                    if p:
                        words.append(run + p)
                        run = SPACE
                    else:
                        run += SPACE
                if not parts[-1]:
                    words.append(run[:-1])
                split.append(words if t else [])
            else:
                split.append((SPACE + t.replace(SPACE, " ").replace(" ", " " + SPACE)).split(" "))
        seen = set().union(*split)
        if new := seen - self.words.keys():
            self.learn(seen if len(self.words) + len(new) > MEMORY else new)
        get, out = self.words.__getitem__, []
        for words in split:
            changes = b"".join(map(get, words))
            first = sum(np.frombuffer(changes[:2], np.int8).tolist())
            out.append(np.int8(first).tobytes() + changes[2:] if changes else b"")  # the space before it is no character of the text
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One for each Python worker."""
    return PrefixCounter(path)


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def prefix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, prefix_changes (one signed byte for each character)."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for b in batches:
            got = c.texts(b.column(1).to_pylist())
            n = [tokens_of_prefix(d, len(d)) for d in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(got, pa.binary())], names=["id", "n_bytes", "n_tokens", "prefix_changes"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long, prefix_changes binary").withColumnRenamed("id", id_col)


def tokens_of_prefix(changes: bytes, n_chars: int) -> int:
    """Tokens of the first n_chars characters."""
    return int(np.frombuffer(changes, np.int8)[:n_chars].sum(dtype=np.int64))


def longest_prefix(changes: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def truncate(docs: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """id, kept_chars, kept_text: the longest prefix of each row's text within the token budget."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            kept = [longest_prefix(d, budget) for d in counter(model).texts(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.int64()), pa.array([t[:k] for t, k in zip(texts, kept, strict=True)], pa.string())], names=["id", "kept_chars", "kept_text"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, kept_chars long, kept_text string").withColumnRenamed("id", id_col)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_counts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


QUERIES = {"op9_token_counts": op9_token_counts}
SQL: dict[str, str] = {}
