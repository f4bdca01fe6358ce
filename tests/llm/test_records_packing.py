import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from archivist.llm import packing, records
from archivist.llm.encode import WordEncoder, default_tokenizer, encoder

SF = "/root/testdata/sf0.001"
TEXTS = ["", None, "a b", " a  b ", "x<|endoftext|> <|endoftext|> y", "don't, can' t\x1c b", "日本 語　a  b", "\n a\n b", "word " * 3000]


def encode(t, tok=[]):
    tok[:] = tok or [Tokenizer.from_file(default_tokenizer())]
    return tok[0].encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_remembered_encode_as_the_library():
    rnd, e = random.Random(3), encoder(default_tokenizer())
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choices(" \n\ta'sé1., 　\x1c<|endoftext|>", k=rnd.randint(1, 40))) for _ in range(800)]
    for t, got in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(got, e.dtype).tolist() == encode(t)


def test_single_pieces_skip_the_pre_tokenizer():
    """Words of letters, marks and line feeds are encoded by the BPE model, run by run, with the library's ids; the others by the library."""
    rnd, e = random.Random(4), WordEncoder(default_tokenizer(), 3000)
    texts = ["".join(rnd.choices("abcdeAEéÀɏ  \n.,!-_*<|>[]7'", k=rnd.randint(1, 60))) for _ in range(800)]
    texts += ["x a<|endoftext|>.b <|endoftext|> endoftext", "a b\nc\nd. e\n.f g\n\nh ÿ÷ ×a", *("".join(rnd.choices("abé.\n", k=9)) for _ in range(200))]
    for k in range(0, len(texts), 50):
        for t, got in zip(texts[k : k + 50], e.encode(texts[k : k + 50]), strict=True):
            assert np.frombuffer(got, e.dtype).tolist() == encode(t)
    seen, whole = [], e.whole
    e.whole = lambda t: seen.append(t) or whole(t)
    e.encode(["start Zebrastripes, zebraé\nstripedé... don't 77 x<|endoftext|>"])
    assert seen and not any("ebra" in t for t in seen)


def test_crc32c():
    assert records.crc32c([b"123456789", b"", b"\0" * 32]).tolist() == [0xE3069283, 0, 0x8A9136AA]
    rnd = random.Random(1)
    data = [rnd.randbytes(n) for n in (1, 3, 255, 256, 257, 1000, 5000)]

    def slow(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= x
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert records.crc32c(data).tolist() == [slow(b) for b in data]


def test_damage_is_found():
    good = records.frames([b"abc", b""])
    assert records.unframe(good) == [b"abc", b""]
    for i in (0, 9, 13, len(good[0]) - 1):
        bad = bytearray(good[0])
        bad[i] ^= 1
        with pytest.raises(ValueError):
            records.unframe([bytes(bad)])


def test_record_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in records.op1_token_records(spark, SF).collect()}
    at = 0
    for i in sorted(docs):
        ids = [*encode(docs[i]), 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_records_of_odd_rows(spark):
    from archivist.llm.common import shared_folder

    df = spark.createDataFrame([*enumerate(TEXTS), (3, "again"), (None, "no id")], "doc_id long, text string").selectExpr("*", "'x' AS part", "1 AS position")
    folder = shared_folder(spark)
    index = records.starts(records.write_records(df, folder))
    rows = records.read_records(index, folder, records.width_of()).orderBy("start").collect()
    want = sorted([(-1, "no id"), *((i, t or "") for i, t in enumerate(TEXTS)), (3, "again")])
    assert [np.frombuffer(r.payload, "<u2").tolist() for r in rows] == [[*encode(t), 2] for _, t in want]
    empty = records.write_records(df.limit(0), shared_folder(spark))
    assert records.starts(empty).count() == 0


def check_packed(rows, docs, width=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for i, t in docs.items():
        ids, at = [*encode(t), 0], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= width
    return sum(r.length for r in rows) / (width * len(by_seq))


def test_packing_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_packed(packing.op3_packing(spark, SF).collect(), docs) > 0.98


def test_packing_odd_rows(spark):
    docs = dict(enumerate(TEXTS))
    df = spark.createDataFrame([*docs.items()], "doc_id long, text string").selectExpr("*", "'x' AS length", "'y' AS sequence_id")
    check_packed(packing.pack(df).collect(), docs)
    assert packing.pack(df.limit(0)).count() == 0
    seqs = packing.sequences(packing.pack(df, with_ids=True)).collect()
    assert all(len(s.ids) == 1024 for s in seqs)
    twice = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert len(twice) == 3 and len({(r.sequence_id, r.offset) for r in twice}) == 3


def test_patterns_hold_the_histogram():
    rnd = random.Random(2)
    for _ in range(50):
        width = rnd.choice([8, 32, 1024])
        h = {rnd.randint(1, width): rnd.randint(1, 500) for _ in range(rnd.randint(1, 60))}
        got = Counter()
        for pack, n in packing.shortest_pack_first(h, width):
            assert sum(pack) <= width and n > 0
            for length in pack:
                got[length] += n
        assert got == h


def test_ids_are_packed_without_a_shuffle(spark, monkeypatch):
    """Ranks come from counts that are broadcast, or joined by a shuffle where there are many parts; a small memory of words gives the same ids."""
    docs = dict(enumerate(TEXTS))
    df = spark.createDataFrame([*docs.items()], "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = packing.pack(df, with_ids=True, memory=3)
        assert "BroadcastHashJoin [part#" in few._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(packing, "PARTS", 0)
        many = packing.pack(df, with_ids=True)
        check_packed(few.collect(), docs)
        check_packed(many.collect(), docs)
        ids = lambda p: sorted((r.doc_id, r.start, r.ids) for r in p.collect())
        assert ids(few) == ids(many)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
