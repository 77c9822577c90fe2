import json
import os

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.model import FINDING
from basalt.operators.reports import REPORTERS, register_report, report, write_report
from basalt.sources.lines import LinesWriter, Part, write_lines


def findings(spark, n, parts=7):
    location = "named_struct('path', concat('d/f', id % 50, '.py'), 'start_line', cast(id as int), 'start_col', 0, 'end_line', cast(id as int), 'end_col', 1)"
    values = {"location": location, "rule_id": "concat('r.', id % 3)", "message": "'a \"message\" | with <é>'", "severity": "elt(cast(id % 3 + 1 as int), 'HIGH', 'LOW', 'CRITICAL')", "confidence": "'LOW'", "snippet": "concat('x = 1\\n# ', id)", "engine": "'regex'", "cwe": "array('CWE-1')", "references": "array('https://example.org')", "fingerprint": "sha2(cast(id as string), 256)"}
    names = [f.name for f in spark.createDataFrame([], FINDING).schema]
    empty = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], FINDING).schema}
    rows = spark.range(0, n, 1, parts).selectExpr(*(f"{values.get(c, 'cast(array() as ' + empty[c] + ')' if empty[c].startswith('array') else 'cast(null as ' + empty[c] + ')')} as {c}" for c in names), "id as seq")
    return rows


@pytest.mark.parametrize("form", sorted(REPORTERS))
def test_a_file_is_what_the_lines_are(spark, tmp_path, form):
    for n in (0, 1, 300):
        found = findings(spark, n)
        write_report(found, form, n, str(tmp_path / "out"))
        assert (tmp_path / "out").read_bytes().decode() == "".join(line + "\n" for line in report(found, form, n))
    assert os.listdir(tmp_path) == ["out"]


def test_large_reports_do_not_pass_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a, **k: pytest.fail("rows came to the driver"))
    write_report(findings(spark, 50_000), "sarif", 1, str(tmp_path / "out.sarif"))
    run = json.loads((tmp_path / "out.sarif").read_text())["runs"][0]
    assert len(run["results"]) == 50_000 and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["r.0", "r.2", "r.1"]
    places = [(r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], r["locations"][0]["physicalLocation"]["region"]["startLine"]) for r in run["results"]]
    assert places == sorted(places)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    (tmp_path / "out").write_text("before")
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")))
    with pytest.raises(Exception, match="stop"):
        write_lines(bad, str(tmp_path / "out"), ["head"])
    assert os.listdir(tmp_path) == ["out"] and (tmp_path / "out").read_text() == "before"


def test_only_parts_that_were_told_of_count(tmp_path):
    writer = LinesWriter({"path": str(tmp_path / "out"), "head": '["["]', "tail": '["]"]', "separator": ","})
    os.makedirs(writer.parts)
    for name, text in (("1-7", "b\n,c\n"), ("0-3", "a\n"), ("0-2", "lost\n"), ("2-9", "")):
        with open(os.path.join(writer.parts, name), "w") as f:
            f.write(text)
    writer.commit([Part(1, "1-7", 2), None, Part(2, "2-9", 0), Part(0, "0-3", 1)])
    assert (tmp_path / "out").read_text() == "[\na\n,b\n,c\n]\n" and os.listdir(tmp_path) == ["out"]


def test_nulls_and_line_ends(spark, tmp_path):
    write_lines(spark.createDataFrame([(0, "a"), (1, None), (2, "b\nc")], "n int, t string").orderBy("n").select("t"), str(tmp_path / "out"), separator=";")
    assert (tmp_path / "out").read_text() == "a\n;\n;b\nc\n"


def test_own_forms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("basalt.operators.reports.REPORTERS", dict(REPORTERS))
    register_report("count", lambda found, files: iter([f"{found.count()} in {files}"]))
    write_report(findings(spark, 3), "count", 2, str(tmp_path / "out"))
    assert (tmp_path / "out").read_text() == "3 in 2\n"
    with pytest.raises(ValueError):
        write_report(findings(spark, 1), "pdf", 1, str(tmp_path / "out"))
