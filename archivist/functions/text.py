"""Tokens for keyword search, and the query language."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWEL = "aeiou"


def _shape(w: str) -> str:
    """c for a consonant, v for a vowel, letter by letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in _VOWEL or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _ends_cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


#: Suffix rules of Porter's published algorithm (1980), steps 2 to 4. Fixed values.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _replace(w: str, rules: dict[str, str]) -> str:
    end = max((s for s in rules if w.endswith(s)), key=len, default=None)
    return w[: -len(end)] + rules[end] if end and _measure(w[: -len(end)]) > 0 else w


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    """Porter's stemmer for words of a to z; other words stay."""
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _ends_cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _STEP2), _STEP3)
    end = max((s for s in _STEP4 if w.endswith(s)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _ends_cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def tokens(text: str, stemmed: bool = True) -> list[str]:
    """Runs of letters and digits, without diacritics; the underscore parts words."""
    found = re.findall(r"[^\W_]+", fold(text or ""))
    return [stem(t) for t in found] if stemmed else found


def token_column(c: Column, stemmed: bool = True) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: tokens(t, stemmed) if t is not None else []), "array<string>")(c)


def plain_tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, without Python."""
    return F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), "")


def keyword_query(q: str) -> tuple[str, list[list[str]]] | None:
    """('prefix' or 'raw', for each term its tokens), or None for an empty query. All terms have to occur; a term of several
    tokens is a phrase, and its last token is a prefix. Queries with AND, OR, NOT, NEAR, quotes or * are raw."""
    q = q.strip()
    if not q:
        return None
    if re.search(r'\b(and|or|not|near)\b|["*]', q, re.I):
        return "raw", [[q]]
    terms = [t for t in (tokens(w, False) for w in q.split()) if t]
    return ("prefix", terms) if terms else None


#: A term of a query: its tokens in a row, and whether the last may go on.
Term = tuple[tuple[str, ...], bool]


def alternatives(q: str, stemmed: bool = False) -> list[list[tuple[bool, list[Term]]]]:
    """Alternatives of clauses of terms. A query holds where in one alternative each clause has all its terms, or not all of them if it is
    negated. NOT binds tighter than AND, AND than OR, and words side by side more than these; operators are in capitals.
    No alternative: an empty query. What the raw language has besides words, "phrases" and * is an error, which searches report as degraded."""
    query = keyword_query(q)
    if query is None:
        return []
    cut = lambda ts: tuple(stem(t) if stemmed else t for t in ts)
    if query[0] == "prefix":
        return [[(False, [(cut(t), True) for t in query[1]])]]
    out: list[list[tuple[bool, list[Term]]]] = [[(False, [])]]
    parts = re.findall(r'"[^"]*"\*?|\w+\*?|\S', q)
    for p in parts:
        here = out[-1][-1][1]
        if p in ("AND", "OR", "NOT"):
            if not here:
                raise ValueError("an operator without a term")
            if p == "OR":
                out.append([(False, [])])
            else:
                out[-1].append((p == "NOT", []))
            continue
        found = tokens(p.strip('"*'), False)
        if not found or p == "NEAR":
            raise ValueError("not understood")
        here.append((cut(found), p.endswith("*")))
    if not out[-1][-1][1]:
        raise ValueError("an operator without a term")
    return out


def web_terms(q: str) -> list[list[tuple[bool, Term]]]:
    """The web style: words and "phrases" as they are, `or` between alternatives, - before what must not occur. Never an error."""
    out: list[list[tuple[bool, Term]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)"([^"]*)"?|(\S+)', q):
        if word.lower() == "or":
            if out[-1]:
                out.append([])
            continue
        found = tokens(phrase or word, False)
        if found:
            out[-1].append((bool(minus) or word.startswith("-"), (tuple(found), False)))
    return [a for a in out if a]
