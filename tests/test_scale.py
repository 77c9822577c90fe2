import os

import pyarrow as pa
from pyspark.sql import functions as F

from basalt.operators.facts import FLOW_KINDS, code_facts, facts_of
from basalt.plans import scan as S
from basalt.plans.scan import Options, scan
from basalt.plans.store import Rounds, stored
from basalt.sources.files import files_from_table


def table(spark, files):
    return files_from_table(spark.createDataFrame(list(files.items()), "p string, c string"), F.col("p"), F.col("c"))


def test_tables_between_rounds_have_no_marks(spark):
    rounds = Rounds(spark.range(3))
    for df in (stored(spark.range(3)), rounds.add(spark.range(3))):
        folder = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
        assert df.count() == 3 and not [f for f in os.listdir(folder) if "_SUCCESS" in f]


class Caught:
    """In place of a DataFrame: gives the function that its tasks would run."""

    where = select = lambda self, *columns: self
    mapInArrow = lambda self, run, schema: run


def test_small_files_share_a_batch(spark):
    texts = [f"f{n}(x)\ny = x\n" for n in range(100)] + ["", "z = (\n"]
    given = pa.RecordBatch.from_pydict({"path": [str(n) for n in range(102)], "language": ["python"] * 102, "content": texts, "followed": [n % 2 == 0 for n in range(102)]})
    found = list(code_facts(Caught())(iter([given])))
    assert len(found) == 1
    want = [(str(n), *row) for n, t in enumerate(texts) for row in facts_of("python", t) if n % 2 == 0 or row[0] not in FLOW_KINDS]
    columns = [c.to_pylist() for c in found[0].columns]
    assert list(zip(columns[0], *columns[2:])) == [(*r[:10], *r[10:]) for r in want]
    assert list(code_facts(Caught())(iter([]))) == []


FILES = {
    "source.py": "q = request.args.get('id')\n", "sink.py": "cursor.execute(q)\n", "both.py": "cursor.execute(request.args.get('id'))\n", "apart.py": "q = request.args.get('id')\ncursor.execute(p)\n",
    "plain.py": "eval(x)\n", "plain.js": "eval(x)\n", "none.py": "x = 1\n",
}


def test_only_files_with_a_source_and_a_sink_are_followed(spark, monkeypatch):
    asked = []

    def caught(files, trees, flows):
        asked.append({r["content"]: r["f"] for r in files.select("content", flows.alias("f")).collect()})
        return code_facts(files, trees, flows)

    monkeypatch.setattr(S, "code_facts", caught)
    found = lambda passes: sorted((r["p"], r["rule_id"]) for r in scan(table(spark, FILES), Options(passes=passes)).select(F.col("location.path").alias("p"), "rule_id").collect())
    assert found(("taint",)) == [("both.py", "py.taint.sql-injection")]
    assert asked.pop() == {FILES["both.py"]: True, FILES["apart.py"]: True}
    assert found(("patterns",)) == [("plain.js", "js.dangerous.eval"), ("plain.py", "py.dangerous.eval")]
    assert not any(asked.pop().values())
    assert found(("patterns", "taint")) == [("both.py", "py.taint.sql-injection"), ("plain.js", "js.dangerous.eval"), ("plain.py", "py.dangerous.eval")]
    assert {t for t, f in asked.pop().items() if f} == {FILES["both.py"], FILES["apart.py"]}


def test_passes_of_rules_without_their_roles_find_nothing(spark):
    assert scan(table(spark, FILES), Options(rules=[], passes=("patterns", "taint"))).count() == 0


def test_nested_patterns_alone_store_no_rows_of_flows(spark, monkeypatch):
    from basalt import rules as rulepacks
    from basalt.plans.queries import NESTED_RULES

    kinds = []

    def caught(df):
        if "kind" in df.columns:
            kinds.append({r["kind"] for r in df.select("kind").distinct().collect()})
        return stored(df)

    monkeypatch.setattr(S, "stored", caught)
    files = {"a.py": "def v(k):\n    send(encode(k), 1, k)\n    s = f(k + k)\n", "b.py": "send(decode(a), 1, key[2], b)\n"}
    found = scan(table(spark, files), Options(rules=[rulepacks.checked(r) for r in NESTED_RULES], passes=("patterns",)))
    assert {(r["p"], r["rule_id"]) for r in found.select(F.col("location.path").alias("p"), "rule_id").collect()} == {("a.py", "own.encoded-twice"), ("a.py", "own.doubled"), ("b.py", "own.keyed")}
    assert len(kinds) == 1 and "expr" in kinds[0] and not kinds[0] & FLOW_KINDS
