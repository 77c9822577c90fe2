import hashlib
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from basalt.llm.fingerprint import LANES, as_text, combine, edit_report, fingerprints, remove

TEXTS = [(4, "a b c d e f g h"), (2, "one two three\nfour five six"), (2, "four five six\n\none two three"), (9, None), (7, ""), (None, "last one here"), (5, "é😀 wörter und mehr"), (6, "w " * 50_000), (4, "a b c d e f g h"), (8, "x" * 40_000)]


def table(spark, rows=TEXTS, kind="long"):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], f"doc_id {kind}, text string, lanes int, next_body string, __at int")


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def chain(*values):
    """Spark's hash of several columns: each with the last one's hash as the seed; nulls are passed over."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i", v) if abs(v) < 9 else struct.pack("<q", signed(v)), seed)
    return seed


def brute(text):
    parts = []
    for p in filter(None, (text or "").split("\n")):
        words = p.split(" ")
        parts.append(chain("\n", p))
        if len(words) < 12:
            letters = [*p, *[None] * 3]
            parts += [chain(*letters[i : i + 4]) for i in range(max(len(p) - 3, 1))]
        else:
            parts += [chain(a, b) for a, b in zip(words, [*words[1:], None])]
    lanes = [0] * LANES
    for h in parts:
        for k in range(LANES // 64):
            x = h if k == 0 else chain(k, h)
            for j in range(16):
                for f in range(4):
                    lanes[64 * k + 4 * j + f] += 1 if x >> (j + 16 * f) & 1 else -1
    return [(n + (1 << 15)) % (1 << 16) - (1 << 15) for n in lanes]


def test_lanes_against_brute_force(spark):
    some = [(n, t) for n, t in enumerate([*(t for _, t in TEXTS), "a", "ab\n\nabcd", "  two  blanks " * 9, "word " * 40_000])]
    got = {r["id"]: r["lanes"] for r in fingerprints(table(spark, some)).collect()}
    assert got == {n: brute(t) for n, t in some}


def like(a, b):
    lengths = sum(x * x for x in a) + sum(x * x for x in b)
    apart = sum(((x - y + (1 << 15)) % (1 << 16) - (1 << 15)) ** 2 for x, y in zip(a, b))
    return max(0.0, 1 - apart / lengths) if lengths else 1.0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_report_against_brute_force(spark, kind):
    import numpy as np

    rows = [(i if i is None or kind == "long" else f"{i:03d}", t) for i, t in TEXTS] + [(None, None), (None, "zz top"), (None, "zz top")]
    order = sorted(((i is None, i or 0, signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), i, t or "") for i, t in rows), key=lambda r: r[:1] + (r[1] if kind == "long" else str(r[1]),) + r[2:3])
    want = []
    for n, (*_, i, t) in enumerate(order):
        k, follower = len(t) // 4, order[(n + 1) % len(order)][4]
        edited = t[: len(t) - k] + follower[:k]
        a, b, c = brute(t), brute(edited), brute(follower)
        text = lambda v: "".join(f"{x % (1 << 16):04x}" for x in v)
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), like(a, b), like(a, c)))
    got = [(str(r["id"]), *list(r.asDict().values())[1:]) for r in edit_report(table(spark, rows, kind)).collect()]
    assert [r[:5] for r in sorted(got)] == [r[:5] for r in sorted(want)]
    assert np.allclose([r[5:] for r in sorted(got)], [r[5:] for r in sorted(want)])


def test_fingerprints_of_equal_multisets(spark):
    rows = [r["lanes"] for r in fingerprints(table(spark, TEXTS[:3])).orderBy("id").collect()]
    assert rows[0] == rows[1] != rows[2]


def test_homomorphism(spark):
    parts = spark.createDataFrame([(1, "p one\np two", "p two\np three", "p one\np two\np two\np three")], "k int, x string, y string, xy string")
    lanes = {c: fingerprints(parts, "k", c).first()["lanes"] for c in ("x", "y", "xy")}
    df = spark.createDataFrame([(lanes["x"], lanes["y"], lanes["xy"])], "x array<int>, y array<int>, xy array<int>")
    row = df.select(combine(F.col("x"), F.col("y")).alias("c"), remove(F.col("xy"), F.col("y")).alias("r"), F.length(as_text(F.col("x"))).alias("n")).first()
    assert row["c"] == lanes["xy"] and row["r"] == lanes["x"] and row["n"] == 4 * len(lanes["x"])


def test_likeness(spark):
    words = [f"word{n}" for n in range(400)]
    text = "\n".join(" ".join(words[k : k + 10]) for k in range(0, 400, 10))
    rows = edit_report(table(spark, [(1, text), (2, "\n".join(f"quite other{n} words{n} here{n} now{n}" for n in range(100))), (3, None)])).collect()
    one = next(r for r in rows if r["id"] == 1)
    assert one["near_edited"] > 0.5 > one["near_next"] and all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))


def test_many_null_ids_share_no_bucket(spark):
    from basalt.llm.fingerprint import dealt

    rows = spark.createDataFrame([(None, f"text {n}") for n in range(2000)], "id long, body string")
    sizes = [r["count"] for r in dealt(rows, "id", "body").groupBy("__at").count().collect()]
    assert sum(sizes) < 2100 and max(sizes) < 500


def test_no_rows(spark):
    assert edit_report(table(spark).where("false")).count() == 0
