import random
import re
from collections import Counter, defaultdict

import numpy as np

from basalt.llm import divergence as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=50, scale=10**9, added=5):
    counts, docs = defaultdict(lambda: defaultdict(Counter)), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang or ""][source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    found = []
    for lang, groups in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(c):
            total = sum(c[t] for t in kept)
            return [1 + scale * (c[t] + added) // (total + added * len(kept)) for t in kept]

        p, q = {s: shares(c) for s, c in groups.items()}, shares(sum(groups.values(), Counter()))
        for s, c in groups.items():
            pairs = sorted((-sum(abs(a - b) for a, b in zip(p[s], p[o])), o.encode()) for o in groups if o != s)
            terms = sorted((b - a, t.encode()) for t, a, b in zip(kept, p[s], q) if c[t] and a > b)[:top]
            found += [(lang, s, part, item.decode(), -v, n) for part, rows in (("pair", pairs), ("term", terms)) for n, (v, item) in enumerate(rows, 1)]
    return sorted(found)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, docs=200, sources=9):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x", "don't", "a_b", "日本", "w3w", *(f"t{chr(97 + n)}" for n in range(20))]
    return [(" ".join(rng.choices(words, k=rng.randrange(12))) if rng.random() < 0.95 else None, rng.choice(["en", "fr", None]), rng.choice([None, *(f"s{n}" for n in range(sources))])) for _ in range(docs)]


def test_values_are_those_of_every_term_and_pair(spark):
    for seed, least, top in ((1, 3, 50), (2, 10, 4), (3, 10**6, 50)):
        rows = corpus(seed)
        frame = spark.createDataFrame([(*r, 5, "v") for r in rows], "text string, lang string, source string, value int, part string")
        want = brute(rows, least, top)
        assert want and result(D.divergence(frame, least_docs=least, top=top)) == want


def test_more_sources_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(D, "_BLOCK", 4)
    monkeypatch.setattr(D, "_CELLS", 40)
    rows = corpus(5, docs=400, sources=23)
    assert result(D.divergence(spark.createDataFrame(rows, "text string, lang string, source string"), least_docs=3)) == brute(rows, 3)


def test_odd_rows(spark):
    rows = [(None, None, None), ("", "en", ""), ("One one ONE", "en", "a")] + [("one two", "en", "b")] * 40 + [("w " * 50_000, "en", "b"), ("solo", "xx", "only")]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    assert result(D.divergence(frame, least_docs=2)) == brute(rows, 2)
    assert result(D.divergence(frame.limit(0))) == []


def test_long_texts_are_split_between_terms(monkeypatch):
    monkeypatch.setattr(D, "_PIECE", 7)
    text = "Abc déf" * 5 + " tail-end 日本 x"
    assert [t.decode() for part in D.terms_of(text.encode()) for t in part] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))


def test_long_division():
    counts, totals = np.array([[0, 7, 9 * 10**12, 123_456_789]]), np.array([5, 10**12, 9 * 10**12, 10**10])
    want = [[1 + 10**9 * (int(c) + 5) // (int(n) + 15) for c, n in zip(counts[0], totals)]]
    assert D.shares(counts, totals, 3, 10**9, 5).tolist() == want
