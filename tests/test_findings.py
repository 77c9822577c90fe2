import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from basalt.operators import findings as fin
from basalt.operators.reports import REPORTERS, register_report, report
from basalt.plans.scan import scan
from basalt.sources.files import files_from_table


@pytest.fixture(scope="module")
def found(spark):
    files = {"a.py": "eval(x)\nq = request.args.get('<id>')\ncursor.execute(q)\n", "b.js": "el.innerHTML = a | b\n"}
    return scan(files_from_table(spark.createDataFrame(list(files.items()), "p string, c string"), F.col("p"), F.col("c"))).cache()


def test_threshold(found):
    assert fin.fails(found, "HIGH").first()[0] == 1 and fin.fails(found, "CRITICAL").first()[0] == 0 and fin.fails(found.where("false")).first()[0] == 0


def test_baseline(found, spark, tmp_path):
    fin.save_baseline(found.where("rule_id != 'py.dangerous.eval'"), str(tmp_path / "b"))
    assert [r["rule_id"] for r in fin.new_since(found, fin.load_baseline(spark, str(tmp_path / "b"))).collect()] == ["py.dangerous.eval"]


def test_counts_hold_every_severity(found):
    assert {r["severity"]: r["n"] for r in fin.severity_counts(found).collect()} == {"CRITICAL": 0, "HIGH": 2, "MEDIUM": 1, "LOW": 0, "INFO": 0}


def test_restamp(found):
    row = fin.restamped(found.where("engine = 'taint'"), F.lit("new.py")).first()
    assert row["location"]["path"] == "new.py" and {s["location"]["path"] for s in row["data_flow"]} == {"new.py"}


def test_search(found):
    assert fin.matching(found, "A.PY", "HIGH").count() == 2 and fin.matching(found, "nowhere").count() == 0


def test_cache(spark):
    files = files_from_table(spark.createDataFrame([("a.py", "x"), ("b.js", "x"), ("c.py", "y")], "p string, c string"), F.col("p"), F.col("c"))
    cache = files.where("path = 'a.py'").select(F.lit("v1").alias("config"), "language", "digest")
    hits, misses = fin.cache_split(files, cache, "v1")
    assert [r["path"] for r in hits.collect()] == ["a.py"] and sorted(r["path"] for r in misses.collect()) == ["b.js", "c.py"]
    assert fin.cache_split(files, cache, "v2")[0].count() == 0


@pytest.mark.parametrize("form", sorted(REPORTERS))
def test_reports(found, form):
    text = "\n".join(report(found, form, 2))
    assert "py.dangerous.eval" in text
    if form == "json":
        assert [f["rule_id"] for f in json.loads(text)["findings"]] == ["py.dangerous.eval", "py.taint.sql-injection", "js.xss.inner-html"]
    if form == "sarif":
        run = json.loads(text)["runs"][0]
        assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["py.dangerous.eval", "py.taint.sql-injection", "js.xss.inner-html"]
        assert [r["ruleIndex"] for r in run["results"]] == [0, 1, 2] and run["results"][1]["codeFlows"][0]["threadFlows"][0]["locations"]
        assert run["results"][0]["locations"][0]["physicalLocation"]["region"]["startColumn"] == 1 and run["results"][2]["level"] == "warning"
    if form == "junit":
        assert len(ET.fromstring(text.split("?>", 1)[1])[0]) == 3
    if form == "html":
        assert "&lt;id&gt;" in text and "<id>" not in text


@pytest.mark.parametrize("form", sorted(REPORTERS))
def test_reports_of_nothing(found, form):
    assert "\n".join(report(found.where("false"), form, 0))


def test_unknown_format(found):
    with pytest.raises(ValueError):
        report(found, "pdf", 1)


def test_own_report(found, monkeypatch):
    monkeypatch.setattr("basalt.operators.reports.REPORTERS", dict(REPORTERS))
    register_report("count", lambda findings, files: iter([f"{findings.count()} in {files}"]))
    assert list(report(found, "count", 2)) == ["3 in 2"]
    with pytest.raises(ValueError):
        register_report("json", None)
