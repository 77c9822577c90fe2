import math
import re
from collections import Counter

from pyspark.sql import functions as F

from basalt.functions import text as X

HOSTILE = ["", "a", "aaaa", "ab", "abcd", "a b\t c  d\x0b", "x\r\ny\rz\n", "last\u2028line\u2029end", "\x85a\x1cb\x1d", "\U0001f600 é\u00a0ß", "\n", "\n\n", "12345678", "123456789"]


def values(spark, column):
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(HOSTILE)], "n int, t string")
    return [r[0] for r in rows.orderBy("n").select(column).collect()]


def test_lines_are_those_of_splitlines(spark):
    assert values(spark, X.lines(F.col("t"))) == [t.splitlines() for t in HOSTILE]


def test_squeezed(spark):
    assert values(spark, X.squeezed(F.col("t"))) == [re.sub(r"\s+", " ", t).strip() for t in HOSTILE]


def test_newlines(spark):
    assert values(spark, X.unix_newlines(F.col("t"))) == [t.replace("\r\n", "\n").replace("\r", "\n") for t in HOSTILE]


def test_entropy(spark):
    def entropy(t):
        return -sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values()) if t else 0.0

    for got, t in zip(values(spark, X.entropy(F.col("t"))), HOSTILE):
        assert abs(got - entropy(t)) < 1e-9


def test_masked(spark):
    assert values(spark, X.masked(F.col("t"))) == ["*" * len(t) if len(t) <= 8 else t[:4] + "*" * (len(t) - 8) + t[-4:] for t in HOSTILE]


def test_null_gives_null(spark):
    row = spark.createDataFrame([(None,)], "t string").select(X.lines(F.col("t")), X.masked(F.col("t")), X.html_escaped(F.col("t"))).first()
    assert list(row) == [None, None, None]


def test_client_ip(spark):
    cases = [("1.1.1.1, 2.2.2.2", "9.9.9.9", 1, "2.2.2.2"), ("1.1.1.1, ,2.2.2.2", "9.9.9.9", 2, "1.1.1.1"), ("1.1.1.1", "9.9.9.9", 5, "1.1.1.1"), ("1.1.1.1", "9.9.9.9", 0, "9.9.9.9"), ("", None, 1, "unknown")]
    rows = spark.createDataFrame(cases, "f string, p string, h int, want string").select(X.client_ip(F.col("f"), F.col("p"), F.col("h")).alias("got"), "want").collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
