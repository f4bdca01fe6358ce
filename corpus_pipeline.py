"""A training corpus from the documents: toxic texts out, one of each group of near copies, repeated
passages cut, sources mixed to target weights, and the rest packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from archivist.llm.common import shared_folder, table
from archivist.llm.mixing import mix_sources
from archivist.llm.ngram_join import one_of_each
from archivist.llm.packing import pack
from archivist.llm.passage_dedup import without_repeats
from archivist.llm.toxicity import clean

#: Words that a worker remembers while packing; the stages before have left less room in it than a query of its own has.
WORDS = 200_000


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents with their token ids and places in sequences (doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, ids); `packing.sequences` makes rows of full width of them.

    Null and empty texts are the end id alone. Rows without an id are packed as any other, repeated rows each for itself, very long texts
    whole. Columns may have any names. An empty table gives no rows."""
    return pack(docs, with_ids=True, memory=WORDS)


STAGES = [
    ("toxicity", clean),
    ("n-gram Jaccard join", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("mixing sources", mix_sources),
    ("packing", packed),
]

#: Classifiers, tokenizers and suffix arrays are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
