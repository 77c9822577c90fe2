import random
import re

import xxhash

from basalt.llm import simhash as S


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def roots(prints):
    parent = {f: f for f in prints}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    order = sorted(prints)
    for n, a in enumerate(order):
        for b in order[:n]:
            if ((a ^ b) % (1 << 64)).bit_count() <= 2 and find(a) != find(b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in prints}


TEXTS = [None, "", " \n", "One", "one", "one two", "One two  three", "É É é", "a b c d", "w " * 70_000, "p q r s t " * 50] + [" ".join(random.Random(n).choices("abcdefgh", k=30)) for n in range(20)]


def test_fingerprints(spark):
    rows = spark.createDataFrame([(n, t, 7) for n, t in enumerate(TEXTS)], "doc_id long, text string, bits int")
    assert {r["id"]: r["bits"] % (1 << 64) for r in S.fingerprints(rows).collect()} == {n: brute(t) for n, t in enumerate(TEXTS)}


def test_links_are_those_of_all_pairs(spark):
    rng, prints = random.Random(5), set()
    for _ in range(150):
        f = rng.getrandbits(64)
        prints.add(f)
        for _ in range(rng.randrange(6)):  # chains, stars and near misses
            for _ in range(rng.choice((1, 2, 2, 3))):
                f ^= 1 << rng.randrange(64)
            prints.add(f)
    prints |= {0, 1, (1 << 64) - 1, (1 << 63), (1 << 64) - 2}
    signed = {f - (1 << 64) if f >> 63 else f for f in prints}
    df = spark.createDataFrame([(f,) for f in signed], "bits long")
    found = {r["bits"]: r["root"] for r in S.components(S.links(df)).collect()}
    assert {f: found.get(f, f) for f in signed} == roots(signed)


def test_a_long_chain_and_a_dense_group(spark):
    chain, f = [], 0
    for n in range(40):
        chain.append(f)
        f ^= (3 << (n % 31) * 2) if n % 2 else (1 << 62 - n)
    dense = [(1 << 63) ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)]
    signed = {f - (1 << 64) if f >> 63 else f for f in [*chain, *dense]}
    df = spark.createDataFrame([(f,) for f in signed], "bits long")
    found = {r["bits"]: r["root"] for r in S.components(S.links(df)).collect()}
    assert {f: found.get(f, f) for f in signed} == roots(signed)


def test_the_grid_gives_the_links(spark, monkeypatch):
    df = spark.createDataFrame([(0,), (3,), (12 + (1 << 40),)], "bits long")
    assert [tuple(r) for r in S.links(df).collect()] == [(3, 0)]
    monkeypatch.setattr(S, "near_cells", lambda at: S.F.array(at))  # without the neighbouring cells nothing meets
    assert S.links(df).count() == 0


def test_cells_keep_the_distance(spark):
    rng = random.Random(2)
    rows = [(a, b) for a in (rng.getrandbits(63) for _ in range(100)) for b in (a ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)), rng.getrandbits(63))]
    counts = lambda f: [(f >> k & 3).bit_count() for k in range(0, 64, 2)]
    df = spark.createDataFrame(rows, "a long, b long")
    met = df.select("a", "b", S.F.arrays_overlap(S.near_cells(S.cell(S.F.col("a"))), S.near_cells(S.cell(S.F.col("b")))).alias("meet")).collect()
    assert all(r["meet"] == (sum(abs(x - y) for x, y in zip(counts(r["a"]), counts(r["b"]))) <= 2) for r in met)


def test_near_duplicates(spark):
    rows = spark.createDataFrame([(n, t, 7, None) for n, t in enumerate(TEXTS)] + [(None, "one", 1, None), (3, "other words here", 1, None)], "doc_id long, text string, id int, component_id string")
    found = S.near_duplicates(rows).collect()
    prints = {r["bits"] for r in found}
    root = roots(prints)
    for r in found:
        assert r["component_id"] == min(x["id"] for x in found if x["id"] is not None and root[x["bits"]] == root[r["bits"]])
    kept = S.near_dedup(rows)
    assert kept.columns == rows.columns
    assert {root[brute(r["text"]) - (1 << 64) if brute(r["text"]) >> 63 else brute(r["text"])] for r in kept.collect()} == set(root.values())


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a b c d", 5, 6), (2, "a b c d", 7, 8)], "doc_id long, text string, gone_id int, __id int")
    assert [tuple(r) for r in S.near_dedup(rows).collect()] == [(1, "a b c d", 5, 6)]
