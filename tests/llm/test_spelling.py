import random
import re
import zlib

import numpy as np

from archivist.llm import spelling as s


def counts(rows, slips=97, letters=5, times=3):
    n = {}
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] = n.get(w, 0) + 1
    return {w: k for w, k in n.items() if len(w) >= letters and k >= times}


def brute(n):
    """{word: (form, root, n, n_near, form_n)}: words that share a pattern with one place left out are near."""
    at = {}
    for w in n:
        for k in range(len(w)):
            at.setdefault(("replace", k, w[:k] + "\0" + w[k + 1 :]), []).append(w)
    near = {w: set() for w in n}
    for group in at.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    for w in n:
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            if short in n:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    mine = got(s.op12_spelling_variants(spark, sf))
    assert mine == brute(counts(rows)) and sum(v[0] is not None for v in mine.values()) > 20


def made(rnd, size, alphabet):
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(5, 10))) for _ in range(size // 4)]
    out = []
    for _ in range(size):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            k = rnd.randrange(len(w))
            w[k : k + rnd.randrange(2)] = rnd.choice(["", rnd.choice(alphabet)])
        out.append("".join(w))
    return out


def test_cells_parts_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(s, "CELL", 60)
    monkeypatch.setattr(s, "LEAF", 4)
    monkeypatch.setattr(s, "PORTION", 50)
    rnd = random.Random(2)
    rows = []
    for alphabet in ("abcdeéÉ÷", "abcdefghijklmnopqrstuvwxyzß"):
        some = made(rnd, 700, alphabet)
        rows += [(i, " ".join(rnd.choices(some, k=120))) for i in range(60)]
    rows += [(900, None), (901, ""), (902, "12 .. œœœœœ"), (None, "Straße STRASSE straßE " * 9), (903, "x" * 50_000 + " " + "y" * 70_000), (903, "x" * 50_000), (904, "x" * 50_000 + "y"), (5, rows[5][1]), (5, rows[5][1])]
    rows += [(905 + i, " ".join(["abcde", "edcba", "badce", "dabce", "cabed", "abcdee"])) for i in range(4)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(6)
    for slips in (97, 3, None):
        assert got(s.spelling_groups(df, slips=slips)) == brute(counts(rows, slips))
    assert got(s.spelling_groups(df.filter("false"))) == {} and got(s.spelling_groups(df.filter("text is null"))) == {}


def test_one_large_anagram_group(spark, monkeypatch):
    """Words that no split can part are cut by a hash, and none is lost."""
    monkeypatch.setattr(s, "CELL", 20)
    rnd = random.Random(3)
    words = {"".join(rnd.sample("abcdefg", 7)) for _ in range(300)}
    words |= {w[:3] + "h" + w[3:] for w in sorted(words)[:100]} | {w[:2] + w[3:] for w in sorted(words)[:50]}
    rows = [(i, " ".join(sorted(words))) for i in range(3)] + [(9, " ".join(sorted(words)[:40] * 5))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(s.spelling_groups(df)) == brute(counts(rows, None))


def test_chains(spark):
    rows = [(1, " ".join("abcdefghij"[: 5 + k] for k in range(5) for _ in range(3 * 2**k)))]
    mine = got(s.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert mine == brute(counts(rows, None)) and mine["abcde"][1] == "abcdefghi"


def test_order_of_letters():
    m = lambda ws: s._matrix([w.encode() for w in ws], len(ws[0]))
    assert s.one_apart(m(["abcde", "abcde", "abcde"]), m(["abcdx", "abced", "abcde"])).tolist() == [True, False, False]
    assert s.one_apart(m(["abcde"] * 4), m(["abcdef", "xabcde", "abccde", "abcxed"])).tolist() == [True, True, True, False]
    c = s.letter_counts([b"aab", b"abc", b"aaa", b"\xe9bc"])
    assert np.bitwise_count(s.count_bits(c)[:, None] ^ s.count_bits(c)[None, :]).max() <= 6
