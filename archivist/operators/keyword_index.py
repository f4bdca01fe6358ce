"""Ranked keyword search over positional postings, and a stored index that is kept up to date in segments.

A posting is (id, term, tf, positions, length): how often and where a term occurs in a document of so many tokens. Fields lie
FIELD positions apart, so no phrase crosses them. A query's terms (words, prefixes, phrases) are each ranked as a unit: a unit's
frequency in a document is the number of places where it begins, its document frequency the number of documents that hold it.

The stored index is three Parquet tables in folders by segment: postings sorted by (term, id), so that a range of terms reads few
files; documents (id, hash, length; no length: removed); commits. An update writes only what changed, as a new segment, and its commit last; a segment
without a commit doesn't exist, so an update that died is simply done again. Of several segments the last one that has a
document holds for it. Compaction writes the live postings as one segment, from which on reading starts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from archivist.functions.text import Term, alternatives, token_column, web_terms
from archivist.operators.keyword import K1, B, holding
from archivist.sources.store import delete, exists, scratch

FIELD = 1 << 20
#: The least weight of a unit that most documents hold. Fixed value.
LEAST_IDF = 1e-6
#: Segments after which an update compacts.
SEGMENTS = 16
#: Documents that a task takes apart together.
ROWS = 256


def search_fields(items: DataFrame, library: str, stemmed: bool = True, id_col: str = "id") -> DataFrame:
    """(id, fields) of a library's items: the tokens of author, shortcode, key, type, and collections or source; nulls are empty."""
    last = F.array_join(F.filter("collections", lambda c: c.isNotNull() & (c != "")), " ") if library == "saves" else F.col("source")
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in (F.col("author_username"), F.col("shortcode"), F.col("media_key"), F.col("media_type"), last)]
    return items.select(F.col(id_col).alias("id"), F.array(*[token_column(t, stemmed) for t in texts]).alias("fields"))


def _length(fields: Column) -> Column:
    return F.aggregate(fields, F.lit(0).cast("long"), lambda n, words: n + F.size(words))


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, hash, fields): one row of id, hash and length (no tf), and one for each of the document's terms, in their order."""
    names = ["id", "term", "tf", "positions", "length", "hash"]
    for whole in batches:
        for first in range(0, whole.num_rows, ROWS):
            b = whole.slice(first, ROWS)
            ids, hashes, fields = b.columns
            words = fields.flatten()
            terms = pc.dictionary_encode(words.flatten(), null_encoding="encode")
            each, many = words.value_lengths().to_numpy(), fields.value_lengths().to_numpy()
            row = np.repeat(np.repeat(np.arange(len(ids)), many), each)
            place = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
            at = np.arange(len(row)) + np.repeat(place * FIELD - (np.cumsum(each) - each), each)
            lengths = np.bincount(row, minlength=len(ids))
            yield pa.RecordBatch.from_arrays([ids, pa.nulls(len(ids), pa.string()), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.list_(pa.int32())), pa.array(lengths, pa.int64()), hashes], names=names)
            if len(row):
                code = terms.indices.to_numpy()
                key = row * len(terms.dictionary) + code
                order = np.argsort(key, kind="stable")
                cut = np.flatnonzero(np.diff(key[order], prepend=-1))
                of, ends = row[order[cut]], np.append(cut, len(row))
                positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[order], pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), terms.dictionary.take(pa.array(code[order[cut]])), pa.array(np.diff(ends), pa.int64()), positions, pa.array(lengths[of], pa.int64()), pa.nulls(len(of), pa.int64())], names=names)


def _rows(docs: DataFrame) -> DataFrame:
    """(id, term, tf, positions, length, hash) of documents (id, fields): the postings, and a row without tf for each document. Each row is taken apart
    by itself, so nothing is shuffled."""
    shape = StructType([docs.schema["id"], *StructType.fromDDL("term string, tf long, positions array<int>, length long, hash long").fields])
    return docs.select("id", F.xxhash64("fields").alias("hash"), "fields").mapInArrow(_posted, shape)


def positional(docs: DataFrame) -> DataFrame:
    """Postings of documents (id, fields), fields an array of arrays of tokens; one row for each id."""
    return _rows(docs).filter("tf is not null").drop("hash")


def totals(docs: DataFrame) -> DataFrame:
    """One row: how many documents, and their tokens."""
    return docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(_length(F.col("fields"))), F.lit(0)).alias("tokens"))


def unit_hits(postings: DataFrame, units: list[Term]) -> DataFrame:
    """(id, unit, tf, length): in how many places of a document each unit begins."""
    fits = [[F.col("term").startswith(t) if prefix and i == len(ts) - 1 else F.col("term") == t for i, t in enumerate(ts)] for ts, prefix in units]
    some = postings.filter(reduce(or_, [c for cs in fits for c in cs]))
    place = lambda u, i: F.struct(F.lit(u).alias("unit"), F.lit(i).alias("i"))
    tagged = some.withColumn("_m", F.explode(F.array_compact(F.array(*[F.when(c, place(u, i)) for u, cs in enumerate(fits) for i, c in enumerate(cs)]))))
    single = [u for u, (ts, _) in enumerate(units) if len(ts) == 1]
    out = tagged.filter(F.col("_m.unit").isin(*single)).groupBy("id", F.col("_m.unit").alias("unit")).agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
    if len(single) < len(units):
        size = F.element_at(F.array(*[F.lit(len(ts)) for ts, _ in units]), F.col("unit") + 1)
        begins = tagged.filter(~F.col("_m.unit").isin(*single)).select("id", "length", F.col("_m.unit").alias("unit"), F.col("_m.i").alias("i"), F.explode("positions").alias("at"))
        begins = begins.groupBy("id", "unit", (F.col("at") - F.col("i")).alias("start")).agg(F.count_distinct("i").alias("n"), F.max("length").alias("length")).filter(F.col("n") == size)
        out = out.unionByName(begins.groupBy("id", "unit").agg(F.count("*").alias("tf"), F.max("length").alias("length")))
    return out


def _by_document(postings: DataFrame, units: list[Term]) -> DataFrame:
    """(id, length, t0, t1 ..): the frequency of each unit, null where it doesn't occur."""
    return unit_hits(postings, units).groupBy("id").agg(F.max("length").alias("length"), *[F.max(F.when(F.col("unit") == k, F.col("tf"))).alias(f"t{k}") for k in range(len(units))])


def _begins(words: Column, unit: Term) -> Column:
    """In how many places of some words a unit begins."""
    terms, prefix = unit

    def here(w: Column, i: Column) -> Column:
        there = [w, *(F.get(words, i + k) for k in range(1, len(terms)))]
        return reduce(and_, [c.startswith(t) if prefix and k == len(terms) - 1 else c == t for k, (c, t) in enumerate(zip(there, terms, strict=True))])

    return F.size(F.filter(words, here))


def _of_rows(docs: DataFrame, units: list[Term]) -> DataFrame:
    """The same of documents (id, fields), one row for each id, and with those where no unit occurs. Units are counted within each row, so nothing is
    shuffled; the narrow rows are stored, so that texts are cut once."""
    count = lambda unit: F.aggregate("fields", F.lit(0).cast("long"), lambda n, words: n + _begins(words, unit))
    many = [count(u) for u in units]
    rows = docs.select("id", _length(F.col("fields")).alias("length"), *[F.nullif(n, F.lit(0).cast("long")).alias(f"t{k}") for k, n in enumerate(many)])
    rows.write.parquet(path := scratch(docs.sparkSession))
    return docs.sparkSession.read.parquet(path)


def _none(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.lit(0.0).alias("score")).limit(0)


def ranked_search(postings: DataFrame, whole: DataFrame, q: str, limit: int = 200, stemmed: bool = False) -> tuple[DataFrame, bool]:
    """((id, score) best first, degraded): the documents that matching() finds, by BM25 over the units that may hold. Higher is better; ties by id.
    whole: totals() of the documents."""
    return _ranked(postings, lambda units: (_by_document(postings, units), whole), q, limit, stemmed)


def ranked_documents(docs: DataFrame, q: str, limit: int = 200, stemmed: bool = False) -> tuple[DataFrame, bool]:
    """The same over documents (id, fields) that no index holds."""

    def each(units: list[Term]) -> tuple[DataFrame, DataFrame]:
        rows = _of_rows(docs, units)
        return rows, rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))

    return _ranked(docs, each, q, limit, stemmed)


def _ranked(rows: DataFrame, frequencies: Callable[[list[Term]], tuple[DataFrame, DataFrame]], q: str, limit: int, stemmed: bool) -> tuple[DataFrame, bool]:
    try:
        wanted = alternatives(q, stemmed)
    except ValueError:
        return _none(rows), True
    if not wanted:
        return _none(rows), False
    units = list(dict.fromkeys(t for clauses in wanted for _, terms in clauses for t in terms))
    scored = {units.index(t) for clauses in wanted for negated, terms in clauses if not negated for t in terms}
    each, whole = frequencies(units)
    df = each.agg(*[F.count(f"t{k}").alias(f"d{k}") for k in range(len(units))])
    both = each.filter(holding(wanted, lambda t: F.col(f"t{units.index(t)}").isNotNull())).crossJoin(F.broadcast(df)).crossJoin(F.broadcast(whole))  # one row each
    mean = F.col("tokens") / F.col("docs")

    def weight(k: int) -> Column:
        idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("docs") - F.col(f"d{k}") + 0.5) / (F.col(f"d{k}") + 0.5)))
        tf = F.col(f"t{k}")
        return F.coalesce(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / mean)), F.lit(0.0))

    return both.select("id", reduce(lambda a, b: a + b, [weight(k) for k in sorted(scored)]).alias("score")).orderBy(F.desc("score"), "id").limit(limit), False


def web_search(postings: DataFrame, q: str, limit: int = 200) -> DataFrame:
    """(id, score) of the web style: words and phrases without stemming or prefixes, `or`, and - for what must not occur. The rank weighs
    frequency: each unit gives 0.1 times the sum of 1 / j**2 over its occurrences, in shares of that sum's limit, and units are averaged.
    Only units that may hold are ranked; an alternative of nothing but - finds nothing here, as a query by postings can't list the rest."""
    return _web(postings, lambda units: _by_document(postings, units), q, limit)


def web_documents(docs: DataFrame, q: str, limit: int = 200) -> DataFrame:
    """The same over documents (id, fields) that no index holds."""
    return _web(docs, lambda units: _of_rows(docs, units), q, limit)


def _web(rows: DataFrame, frequencies: Callable[[list[Term]], DataFrame], q: str, limit: int) -> DataFrame:
    wanted = [a for a in web_terms(q) if not all(negated for negated, _ in a)]
    if not wanted:
        return _none(rows)
    units = list(dict.fromkeys(t for a in wanted for _, t in a))
    ranked = sorted({units.index(t) for a in wanted for negated, t in a if not negated})
    each = frequencies(units)
    share = lambda n: F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, j: s + 1.0 / (j * j)) * (0.1 / 1.64493406685)
    found = each.filter(holding([[(negated, [t]) for negated, t in a] for a in wanted], lambda t: F.col(f"t{units.index(t)}").isNotNull()))
    score = reduce(lambda a, b: a + b, [F.when(F.col(f"t{k}").isNotNull(), share(F.col(f"t{k}"))).otherwise(F.lit(0.0)) for k in ranked]) / len(ranked)
    return found.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


class KeywordIndex:
    """The stored index under a folder that all of Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _commits(self) -> list[tuple[int, bool, int, int]]:
        """(segment, base, documents and tokens: added, or all of them where base) since the last base; SEGMENTS rows, about."""
        if not exists(self.spark, f"{self.folder}/commits"):
            return []
        rows = sorted(tuple(r) for r in self.spark.read.parquet(f"{self.folder}/commits").select("seg", "base", "docs", "tokens").collect())
        last = max((k for k, r in enumerate(rows) if r[1]), default=0)
        return rows[last:]

    def _read(self, name: str, segments: list[int]) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.folder}/{name}/seg={n}").withColumn("seg", F.lit(n)) for n in segments]
        return reduce(lambda a, b: a.unionByName(b), parts)

    def _commit(self, seg: int, base: bool, docs: int, tokens: int) -> None:
        row = self.spark.range(1).select(F.lit(base).alias("base"), F.lit(docs).cast("long").alias("docs"), F.lit(tokens).cast("long").alias("tokens"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/seg={seg}")

    def documents(self) -> DataFrame | None:
        """(id, hash, length) of what is indexed."""
        segments = [c[0] for c in self._commits()]
        if not segments:
            return None
        if len(segments) == 1:
            return self._read("documents", segments).filter("length is not null").select("id", "hash", "length")
        last = self._read("documents", segments).groupBy("id").agg(F.max_by(F.struct("hash", "length"), "seg").alias("d"))
        return last.filter("d.length is not null").select("id", "d.hash", "d.length")

    def postings(self) -> DataFrame | None:
        """The live postings. Only documents of later segments take part in the join; a compacted index needs none."""
        segments = [c[0] for c in self._commits()]
        if not segments:
            return None
        found = self._read("postings", segments)
        if len(segments) > 1:
            later = self._read("documents", segments[1:]).groupBy(F.col("id").alias("_id")).agg(F.max("seg").alias("_seg"))
            found = found.join(later, (F.col("id") == F.col("_id")) & (F.col("seg") < F.col("_seg")), "left_anti")
        return found.drop("seg")

    def totals(self) -> DataFrame:
        commits = self._commits()
        return self.spark.range(1).select(F.lit(sum(c[2] for c in commits)).cast("long").alias("docs"), F.lit(sum(c[3] for c in commits)).cast("long").alias("tokens"))

    def count(self) -> int:
        return sum(c[2] for c in self._commits())

    def _write(self, seg: int, postings: DataFrame, documents: DataFrame) -> None:
        postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{self.folder}/postings/seg={seg}")
        documents.write.mode("overwrite").parquet(f"{self.folder}/documents/seg={seg}")

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> int:
        """Index changed documents (id, fields), one row for each id, in place of what there is of them, and drop removed (id); the segment's number."""
        commits = self._commits()
        seg = commits[-1][0] + 1 if commits else 0
        before = self.documents()
        staged = f"{self.folder}/staged/seg={seg}"
        _rows(changed).write.mode("overwrite").parquet(staged)  # texts are cut once, for the postings, their ranges and the documents
        made = self.spark.read.parquet(staged)
        docs = made.filter("tf is null").select("id", "hash", "length")
        if removed is not None:
            docs = docs.unionByName(removed.select("id", F.lit(None).cast("long").alias("hash"), F.lit(None).cast("long").alias("length")))
        self._write(seg, made.filter("tf is not null").drop("hash"), docs)
        delete(self.spark, staged)
        docs = self.spark.read.parquet(f"{self.folder}/documents/seg={seg}")
        now = docs.agg(F.count("length").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
        n, tokens = now["n"], now["tokens"]
        if before is not None:
            gone = before.join(docs.select("id"), "id", "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
            n, tokens = n - gone["n"], tokens - gone["tokens"]
        self._commit(seg, not commits, n, tokens)
        if len(commits) >= SEGMENTS:
            self.compact()
        return seg

    def compact(self) -> None:
        """The live index as one segment; what lies before it goes after its commit."""
        commits = self._commits()
        if len(commits) < 2:
            return
        seg = commits[-1][0] + 1
        self._write(seg, self.postings(), self.documents())
        self._commit(seg, True, sum(c[2] for c in commits), sum(c[3] for c in commits))
        for old, *_ in commits:
            for name in ("commits", "postings", "documents"):
                delete(self.spark, f"{self.folder}/{name}/seg={old}")

    def sync(self, docs: DataFrame) -> dict[str, int]:
        """Make the index hold exactly the documents (id, fields): new, changed and vanished ones are dealt with, the rest stays as it is."""
        before = self.documents()
        now = docs.withColumn("_new", F.xxhash64("fields"))
        if before is None:
            self.update(docs)
            return {"added": self.count(), "changed": 0, "removed": 0, "same": 0}
        both = now.select("id", "_new").join(before, "id", "full_outer")
        what = F.when(F.col("hash").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("hash") != F.col("_new"), "changed").otherwise("same")
        both.select("id", what.alias("what")).write.mode("overwrite").parquet(f"{self.folder}/compared")
        both = self.spark.read.parquet(f"{self.folder}/compared")
        found = {r["what"]: r["count"] for r in both.groupBy("what").count().collect()}  # four rows at most
        counts = {k: found.get(k, 0) for k in ("added", "changed", "removed", "same")}
        if counts["same"] < sum(counts.values()):
            todo = both.filter(F.col("what").isin("added", "changed")).select("id")
            self.update(docs.join(todo, "id", "left_semi"), both.filter("what = 'removed'").select("id"))
        delete(self.spark, f"{self.folder}/compared")
        return counts

    def search(self, q: str, limit: int = 200, stemmed: bool = True) -> tuple[DataFrame | None, bool]:
        """Ranked (id, score), None from an index that isn't there, and whether the search was degraded."""
        found = self.postings()
        return (None, True) if found is None else ranked_search(found, self.totals(), q, limit, stemmed)
