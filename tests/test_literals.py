import random
import re

import pytest
from pyspark.sql import functions as F

from basalt.operators import literals as L
from basalt.operators.secrets import DETECTORS, possible, secrets
from basalt.sources.files import files_from_table


@pytest.mark.parametrize(
    "pattern,found",
    [("foobar", {"foobar"}), ("a.c", set()), ("[a-z]{3}foo[12]bar|quux", {"foo1bar", "foo2bar", "quux"}), ("(?i)Key\\s*=", {"key"}), ("x(?:abc|defg)+y", {"abc", "defg"}), ("(?:foo)?", set()), ("foo(?=barbar)", {"foo"}), ("ab(?:cd)?ef", {"abcdef", "abef"}), ("(", set()), ("[a&&[ab]]ccc", set()), ("(?x)a b c d", set()), ("", set()), ("abc|", set())],
)
def test_required_literals(pattern, found):
    assert set(L.literals(pattern)) == found


def test_what_matches_holds_a_literal():
    """Random expressions over a few letters, and random texts: a match without a literal would be a lost finding."""
    rng = random.Random(7)

    def part(depth):
        kind = rng.choice(["text", "text", "class", "dot", *(["group", "maybe", "many", "or"] if depth < 3 else [])])
        inner = lambda: "".join(part(depth + 1) for _ in range(rng.randrange(1, 4)))
        return {"text": lambda: "".join(rng.choices("abcK", k=rng.randrange(1, 4))), "class": lambda: rng.choice(["[ab]", "[a-c]", "[^a]", r"\w"]), "dot": lambda: ".", "group": lambda: f"({inner()})", "maybe": lambda: f"(?:{inner()})?", "many": lambda: f"(?:{inner()})" + rng.choice(["+", "*", "{2}", "{0,1}", "+?"]), "or": lambda: f"(?:{inner()}|{inner()})"}[kind]()

    hits = 0
    for _ in range(8000):
        pattern = "".join(part(0) for _ in range(rng.randrange(1, 5)))
        wanted, compiled = L.literals(pattern), re.compile(pattern, rng.choice([0, re.IGNORECASE]))
        for _ in range(20):
            text = "".join(rng.choices("abcKk\u212a", k=rng.randrange(14)))
            if wanted and (m := compiled.search(text)):
                hits += 1
                assert any(x in L.fold(m[0]) for x in wanted), (pattern, text)
    assert hits > 500


TEXTS = ["", None, "ab", "password = 'abcdefghijkl1234'", "PA\u017f\u017fWORD = 'abcdefghijkl1234'", "to\u212aen = 'qwertyuiop123456'", "id AKIA" + "A1B2" * 4, "nothing to see", "x" * 70_000 + " secret: 'zxcvbnmasdfg9876' ", "red\u0130s://u:pass@h"]


def corpus(spark, texts=TEXTS):
    return files_from_table(spark.createDataFrame(list(enumerate(texts)), "n int, t string"), F.col("n"), F.col("t"))


def test_the_index_loses_no_finding_and_prunes(spark, tmp_path):
    files, index = corpus(spark), L.TrigramIndex(spark, str(tmp_path / "index"))
    assert index.known().count() == 0 and index.candidates({"a": "abc"}).count() == 0
    assert index.add(files.where("path < '5'")).count() == 5
    plain = {tuple(r) for r in secrets(files).select("path", "rule_id", "start_col").collect()}
    assert {p for p, *_ in plain} >= {"3", "4", "5", "6", "8"}
    for _ in range(2):  # with half of the files in the index, and with all of them
        assert {tuple(r) for r in secrets(files, index=index).select("path", "rule_id", "start_col").collect()} == plain
        index.add(files)
    assert {r["path"] for r in possible(files, index).collect()} == {p for p, *_ in plain} | {r["path"] for r in possible(files, index).collect() if r["path"] == "9"}
    rows = index.postings().count()
    assert index.add(files).count() == 0 and index.postings().count() == rows and len(index.versions.numbers()) == 2
    index.compact()
    assert index.versions.numbers() == [2] and index.postings().count() == rows and index.known().count() == 9


def test_lookups_read_few_grams(spark, tmp_path):
    index = L.TrigramIndex(spark, str(tmp_path / "index"))
    index.add(corpus(spark, [f"text number {n} of many" for n in range(50)] + ["needle"]))
    found = index.candidates({"n": "need(le|led)", "all": ".*", "number": "number 7 "})
    assert {r["name"]: r["count"] for r in found.groupBy("name").count().collect()} == {"n": 1, "all": 51, "number": 1}
    assert "PushedFilters: [In(gram" in found._jdf.queryExecution().toString()


def test_detectors_have_literals():
    assert all(L.literals(d.pattern) for d in DETECTORS)
