from collections import Counter, defaultdict

import corpus_pipeline
from archivist.llm.common import shared_folder
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_passages import brute as passages
from tests.llm.test_records_packing import crc, encode

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        path = shared_folder(spark)
        stage(spark, seen[-1], SF).write.parquet(path)
        seen.append(spark.read.parquet(path))
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen[:5]]
    assert all(d.columns == columns for d in seen[:5])
    assert texts[1].items() <= texts[0].items() and len(texts[1]) > 0.7 * len(texts[0])
    assert texts[2] == {i: texts[1][i] for i, (_, c) in groups(texts[1]).items() if i == c}
    assert set(texts[3]) == set(texts[2])
    gone = passages(texts[2])
    assert all((texts[3][i] == texts[2][i]) == (gone[i][1] == 0) for i in gone)
    assert texts[4] == texts[3]
    copies = Counter(r.doc_id for r in seen[4].select("doc_id").collect())
    pieces, by_seq = seen[5].collect(), defaultdict(int)
    for p in pieces:
        ids = [*encode(texts[4][p.doc_id]), 0]
        assert p.doc_tokens == len(ids) and p.ids == ids[p.start : p.start + p.length] and p.ids_crc32 == crc(p.ids)
        by_seq[p.sequence_id] += p.length
    assert max(by_seq.values()) <= 1024
    total = sum(n * (len(encode(texts[4][i])) + 1) for i, n in copies.items())
    assert sum(by_seq.values()) == total
