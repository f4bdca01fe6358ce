import math
import random
import re
import zlib

import pytest

from archivist.llm import url_filter as u


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    after = url.split("://", 1)[1]
    host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", after, re.S).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules=u.RULES):
    fits = []
    for r, v in rules:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r), r, v))
    return max(fits)[1:] if fits else (None, None)


class Model:
    """Dictionary counts of one class, with the contexts that all known URLs together keep."""

    def __init__(self, texts, keep_context, keep_gram):
        self.n, self.keep_context, self.keep_gram = {}, keep_context, keep_gram
        for t in texts:
            for s, c in symbols(t):
                d = self.n.setdefault(s, {})
                d[c] = d.get(c, 0) + 1

    def log(self, t):
        total = 0.0
        marked = b"\0" + t + b"\0"
        for i in range(1, len(marked)):
            p = 1 / 256
            for k in range(min(u.ORDER, i) + 1):
                s, c = (k, marked[i - k : i]), marked[i]
                d = self.n.get(s)
                if not d or s not in self.keep_context:
                    continue
                held = {x: y for x, y in d.items() if (s, x) in self.keep_gram}
                n, distinct = sum(d.values()), len(d)
                p = (held.get(c, 0) + (n - sum(held.values()) + distinct) * p) / (n + distinct)
            total += math.log(p)
        return total


def symbols(t):
    marked = b"\0" + t + b"\0"
    for i in range(1, len(marked)):
        for k in range(min(u.ORDER, i) + 1):
            yield (k, marked[i - k : i]), marked[i]


def brute(rows, half):
    """{id: (host, path, rule, verdict, score)}; half: {url: 0 or 1}"""
    texts = {i: (url or "").encode() for i, url in rows}
    given = {i: rule_of(*parts(url)) for i, url in rows}
    known = {v: [texts[i] for i in texts if given[i][1] == v] for v in ("allow", "block")}
    grams, contexts = {}, {}
    for t in known["allow"] + known["block"]:
        for s, c in symbols(t):
            grams[s, c] = grams.get((s, c), 0) + 1
            contexts[s] = contexts.get(s, 0) + 1
    total = sum(n for (s, _), n in grams.items() if s[0] == 0)
    kc, kg = ({x for x, n in d.items() if n >= u.LEAST * total} for d in (contexts, grams))
    model = {(v, h): Model([t for t in known[v] if h is None or half[t] != h], kc, kg) for v in known for h in (None, 0, 1)}
    score = lambda t, h: (model["allow", h].log(t) - model["block", h].log(t)) / (len(t) + 1)
    held = [(score(t, half[t]), v) for v in known for t in known[v]]
    steps = sorted({math.floor(d / u.STEP) for d, _ in held})
    rate = lambda at: sum(d < at * u.STEP for d, v in held if v == "allow") / max(1, len(known["allow"])) + sum(d >= at * u.STEP for d, v in held if v == "block") / max(1, len(known["block"]))
    bound = min((round(rate(at), 12), abs(at), at) for at in range(min(steps[0], 0), max(steps[-1], 0) + 2))[2] * u.STEP if steps else 0
    out = {}
    for i, url in rows:
        d = score(texts[i], None)
        judged = "allow" if not known["block"] else "block" if not known["allow"] or d < bound else "allow"
        out[i] = (*parts(url), given[i][0], given[i][1] or judged, d)
    return out


def halves(spark, rows):
    df = spark.createDataFrame([(url or "",) for _, url in rows], "t string").selectExpr("t", "int(pmod(xxhash64(cast(t as binary)), 2)) as h")
    return {r.t.encode(): r.h for r in df.collect()}


def same(got, want):
    assert set(got) == set(want)
    for i, (host, path, rule, verdict, score) in want.items():
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.score == pytest.approx(score, abs=1e-9)
        assert r.verdict == verdict, (i, score)


ODD = [None, "", "no scheme/com/", "http://", "HTTP://A.COM", "http://A.Com/x?y#z", "x://net/es/1", "x://net/es", "x://sub.net/fr/?q", "x://subnet/fr/1", "x://www.example.com/en/a", "x://a.www.example.com/en/", "x://example.com/en/", "x://Example.COM/en/#f", "x://example.com/english", "a://b://c.com/", "x://com/", "x://é.com/ü", "x://a.com?/p", "x://a.org/" + "long/" * 3000, "x://a.com\n/p\nq"]


def test_small_against_brute_force(spark):
    rnd = random.Random(4)
    hosts = ["good.example.com", "www.example.com", "spam-pills.example.net", "news.example.org", "x.net"]
    rows = [(i, f"https://{rnd.choice(hosts)}/{rnd.choice(['en', 'es', 'fr', 'de'])}/{rnd.randrange(300)}{rnd.choice(['', '/', '?a=1'])}") for i in range(150)]
    rows += [(1000 + i, x) for i, x in enumerate(ODD)] + [(2000, rows[0][1]), (2001, rows[0][1])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, text string, score string")
    same({r.page_id: r for r in u.filter_urls(df.repartition(5)).collect()}, brute(rows, halves(spark, rows)))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    same({r.page_id: r for r in u.op11_url_filter(spark, sf).collect()}, brute(rows, halves(spark, rows)))


def test_pruned_contexts(spark, monkeypatch):
    monkeypatch.setattr(u, "LEAST", 0.004)
    rnd = random.Random(6)
    rows = [(i, f"http://{rnd.choice(['a', 'bb', 'pills'])}.{rnd.choice(['com', 'net'])}/{rnd.choice(['fr', 'es', 'de'])}/{zlib.crc32(b'%d' % i)}") for i in range(120)]
    got = {r.page_id: r for r in u.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    same(got, brute(rows, halves(spark, rows)))


def test_one_sided_and_empty(spark):
    shape = "page_id long, url string"
    assert u.filter_urls(spark.createDataFrame([], shape)).collect() == []
    only = lambda *urls: [r.verdict for r in u.filter_urls(spark.createDataFrame([(i, x) for i, x in enumerate(urls)], shape).coalesce(1)).collect()]
    assert only("x://a.com/", "x://a.org/") == ["allow", "allow"] and only("x://a.net/es/1", "x://a.org/") == ["block", "block"] and only("x://a.org/", None) == ["allow", "allow"]
    got = u.filter_urls(spark.createDataFrame([(None, None), (None, "x://a.com/")], shape)).collect()
    assert sorted(r.verdict for r in got) == ["allow", "allow"]


def test_held_out_accuracy(spark):
    """Unknown URLs that look like the accepted or the rejected ones."""
    rnd = random.Random(9)
    word = lambda side: "".join(rnd.choice("aeilmnorst" if side else "bdgkpuvwxz") for _ in range(8))
    url = lambda side, end: f"http://{word(side)}.{end}/{'de' if end == 'com' else 'es' if end == 'net' else 'it'}/{word(side)}"
    rows = [(i, url(i % 2, "com" if i % 2 else "net")) for i in range(600)] + [(1000 + i, url(i % 2, "org")) for i in range(200)]
    got = {r.page_id: r.verdict for r in u.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    right = sum(got[1000 + i] == ("allow" if i % 2 else "block") for i in range(200))
    assert right >= 190
