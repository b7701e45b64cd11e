"""Collocations against brute force: nulls, empty and long texts, ties, repeated rows, heavy words, small groups."""

import random
import re
from collections import Counter, defaultdict

import pytest

from convlake.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, words long, a long, n long"


def brute(rows, least=4, longest=5, first=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang in f:
        found = {p: c for p, c in f[lang].items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, cut = min((1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), cut, f[lang][p[:cut]], f[lang][p[cut:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s, cut) for i, (s, a, p, cut, l, r) in enumerate(sorted(kept)[:first], 1)]
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "ab", "bé", "c-d", "x" * 300, "e", "f", "Ω", "\U0001f600"]
    rows = [(i, "".join(rng.choice(vocabulary[: 3 + i % 9]) + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "  ", " "]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None, "und", ""]), "p", 1, 2, 3) for i in range(n)]
    rows += [(n, None, "en", None, None, None, None), (None, "", None, "p", 1, 2, 3), (n + 1, "of the " * 4000, "en", "p", 1, 2, 3), (n + 2, " \t.,", "fr", "p", 1, 2, 3), (n + 3, "ha " * 30, "es", "p", 1, 2, 3)]
    return rows + rows[:9]


@pytest.mark.parametrize("seed,budget", [(0, 1 << 22), (1, 64), (2, 8)])
def test_against_brute_force(spark, seed, budget):
    rows = corpus(seed)
    made = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), least=4, budget=budget)
    assert made.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut"]
    assert sorted(map(tuple, made.collect())) == brute(rows)


def test_first_ones_and_ties(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, collocations.collocations(docs, least=4, first=3).collect())) == brute(rows, first=3)


def test_full_maps(spark):
    """Bit maps in which nearly every word has a wrong bit."""
    rows = corpus(4, 40)
    assert sorted(map(tuple, collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least=4, budget=16, bits=64).collect())) == brute(rows)
    blocks = list(collocations._blocks(collocations.pa.Table.from_pydict({"lang": ["en"] * 3, "text": ["a b", "b. a c", ""]}).to_batches()))
    assert [b.joined.tolist() for b in blocks] == [[True, False, False, True, False]]


def test_empty(spark):
    docs = spark.createDataFrame(corpus(0)[:0], SCHEMA)
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "", 1, 1, 1)], SCHEMA)).collect() == []


def test_products_beyond_64_bits(spark):
    """Counts whose product has more than 64 bits come out exact."""
    words = spark.createDataFrame([("en", "p", 4 * 10**9), ("en", "q", 3 * 10**9), ("en", "z", 9 * 10**15)], "lang string, word string, a long")
    found = spark.createDataFrame([("en", "p q", 2, 2 * 10**9)], "lang string, phrase string, words int, a long")
    n = 9 * 10**15 + 7 * 10**9
    assert [r.score for r in collocations.ranked(found, words, least=1).collect()] == [1000 * 2 * 10**9 * n // (12 * 10**18)]
