"""Keyword search without an index: counts of terms, BM25 over whole words, and matching of queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivist.functions.text import Term, alternatives, plain_tokens

K1, B = 1.2, 0.75


def term_counts(tokens: Column, docs: DataFrame) -> DataFrame:
    """(term, df, cf): in how many documents a term occurs, and how often. One shuffle of terms, counted before it."""
    marks = F.concat(F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"))), F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"))))
    found = docs.select(F.explode(marks).alias("m"))
    return found.groupBy("m.term").agg(F.sum("m.d").cast("long").alias("df"), F.sum(1 - F.col("m.d")).cast("long").alias("cf"))


def how_often(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def bm25(docs: DataFrame, id_col: str, tokens: Column, terms: list[str], limit: int) -> DataFrame:
    """(id, score), best first: documents that hold every term, without an index. Higher is better; ties by id. Documents without tokens don't count.

    Both the totals and the hits are read from narrow rows of each document, so only sums are shuffled."""
    wanted = sorted(set(terms))
    words = docs.select(F.col(id_col).alias("id"), tokens.alias("_w"))
    each = words.select("id", F.size("_w").alias("length"), *[how_often(F.col("_w"), t).alias(f"t{k}") for k, t in enumerate(wanted)]).filter("length > 0")
    whole = each.agg(F.count("*").alias("_n"), F.avg("length").alias("_avg"), *[F.count_if(F.col(f"t{k}") > 0).alias(f"d{k}") for k in range(len(wanted))])
    hits = each.filter(reduce(and_, [F.col(f"t{k}") > 0 for k in range(len(wanted))])).crossJoin(F.broadcast(whole))  # one row of totals

    def weight(k: int) -> Column:
        df, tf = F.col(f"d{k}"), F.col(f"t{k}")
        return F.log((F.col("_n") - df + 0.5) / (df + 0.5) + 1) * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("_avg"))))

    return hits.select("id", reduce(lambda x, y: x + y, [weight(k) for k in range(len(wanted))]).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def _holds(words: Column, term: list[str], prefix: bool) -> Column:
    """The words hold the term's tokens in a row; the last may be a prefix."""
    if len(term) == 1:
        return F.exists(words, lambda w: w.startswith(term[0]) if prefix else w == term[0])
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - 1))

    def starts(i: Column) -> Column:
        last = F.get(words, i + len(term) - 1)
        same = [F.get(words, i + k) == t for k, t in enumerate(term[:-1])]
        return reduce(lambda a, b: a & b, [*same, last.startswith(term[-1]) if prefix else last == term[-1]])

    return F.exists(at, starts)


def matching(docs: DataFrame, q: str, words: Column | None = None, text_col: str = "text") -> tuple[DataFrame, bool]:
    """(documents that a query matches, degraded). A query that isn't understood matches nothing and is degraded."""
    words = plain_tokens(F.col(text_col)) if words is None else words
    try:
        wanted = alternatives(q)
    except ValueError:
        return docs.limit(0), True
    if not wanted:
        return docs.limit(0), False
    return docs.filter(holding(wanted, lambda term: _holds(words, list(term[0]), term[1]))), False


def holding(wanted: list[list[tuple[bool, list[Term]]]], there: Callable[[Term], Column]) -> Column:
    """Whether a query holds, given a condition for each term."""
    clause = lambda negated, terms: ~reduce(and_, map(there, terms)) if negated else reduce(and_, map(there, terms))
    return reduce(or_, [reduce(and_, [clause(*c) for c in clauses]) for clauses in wanted])


def provider(requested: str | None, enabled: dict[str, bool], preferred: str | None = None) -> tuple[str, str | None]:
    """The embedding provider to use and why it isn't the requested one. The offline one is always there."""
    order = [p for p in (preferred, "openai", "voyage", "ollama") if p and p != "local" and enabled.get(p)]
    if requested in (None, "", "auto"):
        return (order[0] if order else "local"), None
    if requested == "local" or enabled.get(requested):
        return requested, None
    return (order[0] if order else "local"), f"{requested} is not available"
