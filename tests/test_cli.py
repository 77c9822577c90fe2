import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from basalt.__main__ import load_config, main
from basalt.operators.reports import share, shared


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("eval(x)\n")
    (tmp_path / "src/b.py").write_text("x = 1\n")
    monkeypatch.chdir(tmp_path)
    return tmp_path


def test_exit_codes_and_formats(folder, capsys):
    assert main(["scan", "src", "-f", "json"]) == 1
    assert [f["location"]["path"] for f in json.loads(capsys.readouterr().out)["findings"]] == ["a.py"]
    assert main(["scan", "src", "--fail-on", "CRITICAL"]) == 0
    assert main(["scan", "src/b.py"]) == 0
    assert main(["scan", "missing"]) == 2 and main(["scan", "src", "-f", "pdf"]) == 2


def test_baseline(folder):
    assert main(["baseline", "src", "-o", "known"]) == 0
    assert main(["scan", "src", "--baseline", "known"]) == 0
    (folder / "src/c.py").write_text("exec(y)\n")
    assert main(["scan", "src", "--baseline", "known", "-o", "out.txt"]) == 1
    assert "py.dangerous.exec" in (folder / "out.txt").read_text()


def test_config(folder):
    assert main(["init"]) == 0 and main(["init"]) == 2 and main(["init", "--force"]) == 0
    assert load_config()["fail_on"] == "LOW"
    (folder / ".basalt.yml").write_text("disabled_rules: [py.dangerous.eval]\n")
    assert main(["scan", "src"]) == 0 and main(["scan", "src", "--no-config"]) == 1
    (folder / ".basalt.yml").write_text("typo: 1\n")
    assert main(["scan", "src"]) == 2


def test_shared_reports(spark, tmp_path):
    rows, at = spark.createDataFrame([("r",)], "rule_id string"), dt.datetime(2024, 1, 8)
    share(rows, str(tmp_path), "abc_123", F.lit(at))
    assert shared(spark, str(tmp_path), "abc_123", F.lit(at)).count() == 1
    assert shared(spark, str(tmp_path), "abc_123", F.lit(at + dt.timedelta(seconds=1))).count() == 0
    with pytest.raises(ValueError):
        share(rows, str(tmp_path), "../x", F.lit(at))
