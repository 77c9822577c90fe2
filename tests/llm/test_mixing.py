import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basalt.llm.mixing import mixed, pareto_mix
from basalt.llm.shared import join_groups


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, source string, text string, size int, target double")


def water_fill(sizes):
    """Targets by repeated sharing: 5, 2, 1 by code point, at most 3 times a source's size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        left, free = total - sum(fixed.values()), [s for s in names if s not in fixed]
        if not free:
            return fixed
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def rows():
    rng = random.Random(4)
    out = [(k, rng.choice(["hot"] * 6 + ["a", "b", "c", "d", None]), " ".join(["w"] * rng.randint(1, 60))) for k in range(900)]
    return out + [(2000, "a", None), (2001, "empty", ""), (None, "b", "x y"), (5, "b", "x y"), (5, "b", "x y"), (2002, "c", "w\t" * 20_000)]


def test_targets_and_taken(spark):
    data = rows()
    found = pareto_mix(docs(spark, data)).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, s, t in data:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = water_fill(sizes)
    taken = {}
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in want.items():
        if s != "c":  # one document is nearly all of it
            assert abs(taken[s] - t) <= 0.01 * t + 60, (s, taken[s], t)
    assert len(found) == len(data)


def test_reruns_agree(spark):
    data = rows()
    one, two = (sorted(map(repr, pareto_mix(docs(spark, data).repartition(n)).select("id", "source", "size", "taken").collect())) for n in (1, 5))
    assert one == two


def test_inclusion_odds(spark):
    """Documents with higher odds are taken more often; the sample's words stay near the target."""
    data = [(k, "s", "a b c d") for k in range(4000)]
    table = docs(spark, data).selectExpr("*", "if(doc_id % 2 = 0, 4.0, 1.0) as odds")
    found = pareto_mix(table, share=0.4, odds_col="odds").collect()
    even, odd = (sum(r["copies"] > 0 for r in found if r["id"] % 2 == k) for k in (0, 1))
    assert abs(even + odd - 1600) <= 1 and even > 2 * odd


def test_mixture(spark):
    data = rows()
    got = mixed(docs(spark, data))
    assert got.columns == docs(spark, data).columns
    plan = Counter({})
    for r in pareto_mix(docs(spark, data)).collect():
        plan[r["id"], r["source"], r["size"]] += r["copies"] if r["size"] else 0
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["source"], count(r["text"])) for r in got.collect()) == +plan


def crowd():
    """Null ids with unlike texts, and one row very often, beside usual rows."""
    rng = random.Random(9)
    usual = [(k, "ab"[k % 2], " ".join(["w"] * rng.randint(1, 30))) for k in range(500)]
    return usual + [(None, "a", f"t{n} " * (1 + n % 20)) for n in range(300)] + [(7000, "b", "p q r")] * 400


def test_null_ids_and_repeated_rows(spark):
    found = pareto_mix(docs(spark, crowd())).collect()
    of = lambda k: [r["copies"] for r in found if r["id"] == k]
    assert len(set(of(None))) > 1, "null ids are drawn one by one"
    assert len(of(7000)) == 400 and len(set(of(7000))) == 1, "equal rows are one block"
    for s in "ab":
        taken, target = sum(r["taken"] for r in found if r["source"] == s), next(r["target"] for r in found if r["source"] == s)
        assert abs(taken - target) <= 40, (s, taken, target)
    got = Counter(r["doc_id"] for r in mixed(docs(spark, crowd())).collect())
    assert got[7000] == sum(of(7000)) and got[None] == sum(of(None))


def test_bins_are_cut_until_they_are_small(spark, monkeypatch):
    """Further cuts change which rows are ordered one by one, not the result."""
    from basalt.llm import mixing

    once = sorted(map(repr, pareto_mix(docs(spark, crowd()), rounds=1).collect()))
    monkeypatch.setattr(mixing, "BIN_ROWS", 2)
    assert sorted(map(repr, pareto_mix(docs(spark, crowd()), rounds=1).collect())) == once


def test_ranks_follow_odds_and_ties_are_told_apart(spark):
    marks = spark.range(2000).selectExpr("id", "xxhash64(id) as mark")
    from basalt.llm.mixing import RANK_BITS, pareto_rank

    for odds in (1e-13, 1.0, 1e13):
        ranks = [r["rank"] for r in pareto_rank(marks, F.lit(odds)).collect()]
        assert all(0 <= r < 1 << RANK_BITS for r in ranks) and len(set(ranks)) > 1990


@pytest.mark.parametrize("parts", [1, 4, 1000])
def test_groups_meet_their_rows_at_any_size(spark, parts):
    rows = spark.createDataFrame([(k, n) for k, times in (("x", 60), ("y", 30), ("z", 9), ("alone", 1)) for n in range(times)], "k string, n int")
    groups = spark.createDataFrame([("x", 60, 1), ("y", 30, 2), ("z", 9, 3)], "k string, members int, g int")
    for how, lost in (("inner", 1), ("left", 0)):
        got = Counter((r["k"], r["g"]) for r in join_groups(rows, groups, "k", "members", 100, how, parts).collect())
        assert got == Counter({("x", 1): 60, ("y", 2): 30, ("z", 3): 9} | ({} if lost else {("alone", None): 1}))


def test_no_rows(spark):
    assert pareto_mix(docs(spark, [])).count() == 0 and pareto_mix(docs(spark, [(1, "a", None)])).first()["taken"] == 0


def test_clashing_names(spark):
    rows = spark.createDataFrame([(n, "a b c", "s", 1, 2, 3, 4) for n in range(4)], "doc_id long, text string, source string, `__words` int, `__copy` int, copy int, copies int")
    from basalt.llm.mixing import mixed

    found = mixed(rows)
    assert found.columns == rows.columns and {tuple(r)[3:] for r in found.collect()} == {(1, 2, 3, 4)}
