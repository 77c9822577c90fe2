import hashlib
import re

from pyspark.sql import functions as F

from basalt.llm.exact_dedup import DigestIndex, Filter, exact_dedup, exact_groups

TEXTS = [(5, "a b"), (3, "a \t\n b"), (9, "a b"), (1, None), (2, ""), (7, " "), (8, "   "), (None, "a b"), (4, "x" * 100_000), (6, "x" * 100_000), (6, "y"), (10, "Y")]


def expected(rows):
    groups = {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "clash", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, digest string, keep_id int")


def groups(df, **options):
    rows = exact_groups(df, **options).select("id", "keep_id", "copies", "kept", F.lower(F.hex("digest"))).collect()
    return sorted(map(tuple, rows), key=repr)


def test_against_brute_force(spark):
    assert groups(table(spark)) == expected(TEXTS)


def test_texts_that_share_a_digest_are_told_apart(spark):
    got = groups(table(spark), digest=lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 2, "0")))
    assert [r[:4] for r in got] == [r[:4] for r in expected(TEXTS)]


def test_empty_table_and_other_options(spark):
    assert groups(table(spark).where("false")) == []
    assert groups(table(spark), memtable_rows=2, fanout=2) == expected(TEXTS)


def test_dedup_keeps_columns(spark):
    kept = exact_dedup(table(spark))
    assert kept.columns == table(spark).columns
    assert sorted((r["doc_id"], (r["text"] or "")[:9]) for r in kept.collect()) == [(1, ""), (3, "a \t\n b"), (4, "x" * 9), (6, "y"), (7, " "), (9, "a\u00a0b"), (10, "Y")]
    assert exact_dedup(table(spark, [(1, "a"), (1, "a"), (1, "b"), (2, "a")])).count() == 2


def test_rows_that_share_id_and_text(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "c"), (None, "c")]
    got = exact_groups(table(spark, rows)).collect()
    assert sorted((str(r["id"]), str(r["keep_id"]), r["copies"]) for r in got if r["kept"]) == [("1", "1", 1), ("1", "1", 3), ("None", "None", 2)]
    assert sorted((str(r["doc_id"]), r["text"]) for r in exact_dedup(table(spark, rows)).collect()) == [("1", "a"), ("1", "b"), ("None", "c")]


def test_index_of_several_flushes(spark):
    import random

    rng, index, known = random.Random(3), DigestIndex(spark, memtable_rows=40, fanout=3), {}
    for flush in range(4):
        rows = [(rng.randrange(1000), n + 1000 * flush, bytes([rng.randrange(120)])) for n in range(70)]
        index.flush(spark.createDataFrame(rows, "id long, row long, digest binary"), len(rows))
        for i, _, d in rows:
            known[d] = (min(i, known.get(d, (i, 0))[0]), known.get(d, (0, 0))[1] + 1)
        asked = [(bytes([k]),) for k in range(0, 200, 3)] * 2
        got = {bytes(r["digest"]): (r["keep_id"], r["copies"]) for r in index.lookup(spark.createDataFrame(asked, "digest binary")).collect()}
        assert got == {d: known[d] for d, in asked if d in known}
    # eight memtables of a batch's half each: two merges of three, and two that wait
    assert [len(level) for level in index.levels] == [2, 2] and [r["digest"] for r in index.levels[1][0].rows.coalesce(1).collect()]
    assert {bytes(r["digest"]): (r["keep_id"], r["copies"]) for r in index.view().collect()} == known and len(index.runs()) == 1


def test_filters_lose_nothing(spark):
    digests = spark.range(3000).selectExpr("unhex(sha2(cast(id as string), 256)) as digest")
    made = Filter.of(digests.where("true"), 3000)
    assert made.bits == 16 and made.may_have(digests).count() == 3000
    assert made.may_have(spark.range(3000, 6000).selectExpr("unhex(sha2(cast(id as string), 256)) as digest")).count() < 600


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a", 5, 6, 7, 8), (2, "a", 5, 6, 7, 8)], "doc_id long, text string, group_id int, __id int, text_digest int, kept int")
    assert [tuple(r) for r in exact_dedup(rows).collect()] == [(1, "a", 5, 6, 7, 8)]


def test_the_groups_come_through_lookups_filters_and_merges(spark, monkeypatch):
    import random

    calls = {"lookup": 0, "may_have": 0, "_merged": 0}
    for owner, name in ((DigestIndex, "lookup"), (DigestIndex, "_merged"), (Filter, "may_have")):
        monkeypatch.setattr(owner, name, lambda self, *a, f=getattr(owner, name), n=name: (calls.__setitem__(n, calls[n] + 1), f(self, *a))[1])
    rng = random.Random(8)
    rows = [(n, rng.choice(["same", " same", f"text {rng.randrange(60)}", f"own {n}"])) for n in rng.sample(range(1000), 300)]
    assert groups(table(spark, rows)) == expected(rows)
    # three lookups in one, two and three runs, a filter for each and one for the texts; the four runs are one level up
    assert calls == {"lookup": 3, "may_have": 7, "_merged": 1}
    calls.update(dict.fromkeys(calls, 0))
    assert groups(table(spark, rows), memtable_rows=40, fanout=3) == expected(rows)
    assert calls["lookup"] == 7 and calls["_merged"] >= 3


def test_flushes_tell_what_is_shared(spark):
    index = DigestIndex(spark, memtable_rows=3, fanout=2)
    known = {}
    for batch in (["a", "b", "b", "c"], ["d"], ["c", "e", "a", "f", "f"], []):
        frame = spark.createDataFrame([(n, n, d.encode()) for n, d in enumerate(batch)], "id long, row long, digest binary")
        for d in batch:
            known[d] = known.get(d, 0) + 1
        assert {bytes(r["digest"]).decode() for r in index.flush(frame, len(batch)).collect()} == {d for d in batch if known[d] > 1}
