"""Scalar functions against plain Python and known values."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.functions.fuzzy import lcs, plain_lexical, plain_ratio, plain_token_set, plain_token_sort
from matchloom.functions.translit import plain_transliterate

# Names with their Latin spelling and both scores, to one decimal.
SPELLED = [
    ("North Investment", "नॉर्थ इन्वेस्टमेंट", "nonrth investtmentt", 6.1, 91.4),
    ("Shiv Global Limited", "शिव ग्लोबल लिमिटेड", "shiv globl limittedd", 11.4, 92.3),
    ("Supreme Investments", "सुप्रीम इन्वेस्टमेंट्स", "supriim investtmentts", 5.6, 85.0),
    ("Urban Guru Investments Limited", "अर्बन गुरु इन्वेस्टमेंट्स लिमिटेड", "arbn guru investtmentts limittedd", 10.5, 88.9),
    ("Anand Marketing Limited", "आनंद मार्केटिंग लिमिटेड", "aannd maarketting limittedd", 9.8, 88.0),
    ("Lotus Marketing Limited", "लोटस मार्केटिंग लिमिटेड", "lotts maarketting limittedd", 10.3, 88.0),
    ("Digital Investments", "डिजिटल इन्वेस्टमेंट्स", "ddijittl investtmentts", 5.4, 82.9),
    ("Baba Vijay Marketing", "बाबा विजय मार्केटिंग", "baabaa vijy maarketting", 11.1, 88.4),
]
STRINGS = [
    "", " ", "Star Technologies Private Limited", "A & B Co.", "27 Amratolsa Street, Kolkata", "007 Road No 12-B", "Straße 5", "x", "ab", "राम मार्केटिंग",
    "tab\tand  spaces", "under_score", "ÉCOLE Ñandú", "n° 0042", "PVT LTD", "प्लॉट ०१२ रोड", None,
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(STRINGS)], "i int, s string")


def values(frame, column):
    return [r.v for r in frame.select("i", column.alias("v")).orderBy("i").collect()]


def norm(s):
    return T.plain(s or "")


def test_normalize(frame):
    assert values(frame, T.normalize("s")) == [norm(s) for s in STRINGS]
    assert values(frame, T.normalize_exact("s")) == [norm(s) for s in STRINGS]


def test_marks_fall_apart(frame):
    assert norm("राम मार्केटिंग प्राइवेट") == "र म म र क ट ग प र इव ट"


def test_tokens(frame):
    n = T.normalize("s")
    order = lambda x: list(dict.fromkeys(x))
    assert values(frame, T.tokens(n)) == [norm(s).split() for s in STRINGS]
    assert values(frame, T.token_set(n)) == [order(norm(s).split()) for s in STRINGS]
    assert values(frame, T.meaningful_tokens(n)) == [order(t for t in norm(s).split() if t not in T.LEGAL) for s in STRINGS]
    assert values(frame, T.without_legal_forms(n)) == [" ".join(t for t in norm(s).split() if t not in T.LEGAL) for s in STRINGS]
    assert values(frame, T.address_tokens(n)) == [order(t for t in norm(s).split() if t not in T.STOP and not t.isdigit() and len(t) > 1) for s in STRINGS]


def test_grams(frame):
    def ngrams(s, n=3):
        x = s.replace(" ", "")
        return list(dict.fromkeys([x[i : i + n] for i in range(len(x) - n + 1)] or [x])) if x else []

    def bounded(s, low, high):
        out = []
        for t in s.split():
            p = f" {t} "
            for n in range(low, high + 1):
                if len(p) >= n:
                    out += [p[i : i + n] for i in range(len(p) - n + 1)]
                elif n == low:
                    out.append(p)
        return out

    n = T.normalize("s")
    assert values(frame, T.char_ngrams(n)) == [ngrams(norm(s)) for s in STRINGS]
    for low, high in ((3, 4), (3, 5), (4, 5)):
        assert values(frame, T.boundary_grams(n, low, high)) == [bounded(norm(s), low, high) for s in STRINGS]


def test_numbers(frame):
    want = [[str(int(d)) for d in re.findall(r"\d+", norm(s))] for s in STRINGS]
    assert values(frame, T.ordered_numbers(T.normalize("s"))) == want
    assert values(frame, T.numbers(T.normalize("s"))) == [list(dict.fromkeys(w)) for w in want]
    assert values(frame, T.raw_numbers(T.normalize("s"))) == [list(dict.fromkeys(re.findall(r"\d+", norm(s)))) for s in STRINGS]


def test_routing_keys(frame):
    def prefix(t):
        c = "".join(x for x in t if x.isalnum())
        return f"p:{c[:2]}" if c else None

    order = lambda x: list(dict.fromkeys(k for k in x if k))
    names = [order(prefix(t) for t in norm(s).split() if t not in T.LEGAL) for s in STRINGS]
    places = [order(f"n:{int(t)}" if t.isdigit() else prefix(t) for t in norm(s).split() if t not in T.STOP) for s in STRINGS]
    assert values(frame, T.name_keys(T.normalize("s"))) == names
    assert values(frame, T.address_keys(T.normalize("s"))) == places


def test_split(frame):
    def fraction(s):
        return int(hashlib.md5(f"42:{s}".encode()).hexdigest()[:16], 16) / 16**16

    assert values(frame, T.hash_fraction("s")) == [fraction(s or "") for s in STRINGS]
    assert values(frame, T.split_name("s")) == ["val" if fraction(s or "") < 0.2 else "train" for s in STRINGS]


def test_small_ones(spark, frame):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    a, b, none = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z")), F.array().cast("array<string>")
    assert get(T.jaccard(a, b)) == pytest.approx(1 / 3) and get(T.jaccard(none, none)) == 0 and get(T.jaccard(a, none)) == 0
    assert get(T.containment(T.overlap(a, b), F.size(a))) == 0.5 and get(T.containment(F.lit(0.0), F.lit(0))) == 0
    assert [get(T.length_ratio(F.lit(x), F.lit(y))) for x, y in (("", ""), ("a", ""), ("ab", "abcd"))] == [1, 0, 0.5]
    assert [get(T.match_bucket(F.lit(n))) for n in (0, 4, 5, 11)] == ["0", "4", "5+", "5+"]
    assert get(T.id_list(F.lit(" a, b ,,c"))) == ["a", "b", "c"] and get(T.id_list(F.lit(""))) == []
    assert get(T.path_name(F.lit("A/B C"))) == "A_B_C"
    assert values(frame, T.contains_non_ascii("s")) == [not (s or "").isascii() for s in STRINGS]


def test_spelling_and_scores():
    for latin, other, spelled, before, after in SPELLED:
        assert plain_transliterate(other) == spelled
        best = lambda a, b: round(100 * plain_lexical(a, b), 1)
        assert best(T.plain(latin), T.plain(other)) == before
        assert best(plain_transliterate(latin), spelled) == after
    assert plain_transliterate("Ørsted Łódź œuvre ß १२") == "orsted lodz oeuvre ss 12"


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=14), st.text("abc ", max_size=14))
def test_ratios(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], (last + 1 if x == y else max(row[j], row[j - 1]))
    assert lcs(a, b) == row[-1]
    assert plain_ratio(a, b) == plain_ratio(b, a) and 0 <= plain_ratio(a, b) <= 100
    assert plain_token_sort(a, b) == plain_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    assert plain_token_set(a, b) == plain_token_set(b, a)
    if set(a.split()) and set(a.split()) <= set(b.split()):
        assert plain_token_set(a, b) == 100


def test_edge_ratios():
    assert plain_ratio("", "") == 100 and plain_ratio("a", "") == 0
    assert plain_token_set("", "") == 0 and plain_token_set("", "a") == 0
    assert plain_lexical("", "a") == 0


def test_sql_functions(spark):
    T.register(spark)
    row = spark.sql("select fuzzy_ratio('abcd', 'abed') r, token_set_ratio('a b', 'b a c') t, normalize_exact('ＡＢＣ & d') n, transliterate('शिव') l, lexical_similarity('a b', 'b a') x").first()
    assert (row.r, row.t, row.n, row.l, row.x) == (75.0, 100.0, "abc and d", "shiv", 1.0)
