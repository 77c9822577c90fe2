"""Reports. Spark makes a report's lines, in the findings' order; a file is written by the tasks (see sources.lines), other outputs line by line."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.functions.text import html_escaped, markdown_escaped
from basalt.model import SEVERITIES
from basalt.operators.findings import order_key
from basalt.sources.lines import write_lines

NAME, VERSION = "basalt", "0.1"
# Fixed values of the SARIF standard's users.
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
SCORES = {"CRITICAL": "9.5", "HIGH": "8.0", "MEDIUM": "5.0", "LOW": "3.0", "INFO": "1.0"}


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key]


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*order_key())


def rule_index(findings: DataFrame) -> DataFrame:
    """rule_id, rule_index: rules numbered by their first finding."""
    firsts = findings.groupBy("rule_id").agg(F.min(F.struct(*order_key())).alias("first"))
    return firsts.select("rule_id", (F.row_number().over(Window.orderBy("first")) - 1).alias("rule_index"))  # a row for each rule


def _physical(at: Column, snippet: Column | None = None) -> Column:
    ends = [at["start_line"].alias("startLine"), (at["start_col"] + 1).alias("startColumn"), at["end_line"].alias("endLine"), (at["end_col"] + 1).alias("endColumn")]
    if snippet is not None:
        ends.append(F.when(snippet != "", F.struct(snippet.alias("text"))).alias("snippet"))
    return F.struct(F.struct(at["path"].alias("uri")).alias("artifactLocation"), F.struct(*ends).alias("region"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """A SARIF result, as JSON text, of each finding, with the columns that order them."""
    steps = F.transform("data_flow", lambda s: F.struct(F.struct(_physical(s["location"]).alias("physicalLocation"), F.struct(s["message"].alias("text")).alias("message")).alias("location")))
    flows = F.when(F.size("data_flow") > 0, F.array(F.struct(F.array(F.struct(steps.alias("locations"))).alias("threadFlows"))))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), lookup(LEVELS, F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(_physical(F.col("location"), F.col("snippet")).alias("physicalLocation"))).alias("locations"), F.create_map(F.lit(f"{NAME}/v1"), F.col("fingerprint")).alias("partialFingerprints"), flows.alias("codeFlows"),
    )
    return findings.join(F.broadcast(rule_index(findings)), "rule_id").select(*findings.columns, F.to_json(result).alias("result"))


@dataclass
class Lines:
    """A report: lines before, a line for each finding (one text column, in order), what stands before each but the first, and lines after."""

    head: list[str]
    rows: DataFrame
    tail: list[str]
    separator: str = ""

    def __iter__(self) -> Iterator[str]:
        """All lines; rows come from the executors a partition at a time."""
        yield from self.head
        for n, row in enumerate(self.rows.toLocalIterator()):
            yield (self.separator if n else "") + row[0]
        yield from self.tail


def _sarif(findings: DataFrame, files: int) -> Lines:
    rules = findings.groupBy("rule_id").agg(F.min_by(F.struct("message", "severity", "cwe", "owasp", "references"), F.struct(*order_key())).alias("r")).join(rule_index(findings), "rule_id").orderBy("rule_index")
    described = []
    for r in rules.collect():  # a row for each rule
        one = {"id": r["rule_id"], "name": r["rule_id"], "shortDescription": {"text": r["r"]["message"]}, "properties": {"tags": ["security", *r["r"]["cwe"], *filter(None, [r["r"]["owasp"]])], "security-severity": SCORES[r["r"]["severity"]]}}
        described.append(one | ({"helpUri": r["r"]["references"][0]} if r["r"]["references"] else {}))
    driver = {"name": NAME, "version": VERSION, "rules": described}
    head = '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": ' + json.dumps({"driver": driver}, ensure_ascii=False) + ', "results": ['
    return Lines([head], ordered(sarif_results(findings)).select("result"), ["]}]}"], ",")


def _json(findings: DataFrame, files: int) -> Lines:
    fields = [c for c in findings.columns if c != "seq"]
    head = json.dumps({"tool": NAME, "version": VERSION, "files_scanned": files})[:-1] + ', "findings": ['
    shown = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return Lines([head], ordered(findings.withColumn("shown", shown)).select("shown"), ["]}"], ",")


def counts(findings: DataFrame) -> dict[str, int]:
    found = {r["severity"]: r["n"] for r in findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {s: found[s] for s in SEVERITIES if s in found}


def place() -> Column:
    return F.concat_ws(":", F.col("location.path"), F.col("location.start_line").cast("string"))


def markdown_rows(findings: DataFrame) -> DataFrame:
    row = F.concat(F.lit("| "), "severity", F.lit(" | `"), "rule_id", F.lit("` | `"), place(), F.lit("` | "), markdown_escaped(F.col("message")), F.lit(" |"))
    return findings.withColumn("row", row)


def _markdown(findings: DataFrame, files: int) -> Lines:
    found = counts(findings)
    head = [f"### {NAME}", ""]
    rows = ordered(markdown_rows(findings)).select("row")
    if not found:
        return Lines([*head, f"No findings ({files} files)."], rows, [])
    total = f"{sum(found.values())} findings: " + ", ".join(f"**{n}** {s}" for s, n in found.items()) + f" ({files} files)."
    return Lines([*head, total, "", "| Severity | Rule | Place | Message |", "| --- | --- | --- | --- |"], rows, [])


def _html(findings: DataFrame, files: int) -> Lines:
    head = f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{NAME}</title><h1>{NAME}</h1><p>{sum(counts(findings).values())} findings in {files} files.</p><table>'
    cells = [html_escaped(c) for c in (F.col("severity"), F.col("rule_id"), place(), F.col("message"))]
    row = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells), F.lit("<td><pre>"), html_escaped(F.col("snippet")), F.lit("</pre></td></tr>"))
    return Lines([head], ordered(findings.withColumn("row", row)).select("row"), ["</table></html>"])


def _junit(findings: DataFrame, files: int) -> Lines:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                case = ET.Element("testcase", {"classname": r["rule_id"], "name": r["place"]})
                failure = ET.SubElement(case, "failure", {"message": r["message"], "type": r["severity"]})
                flow = [f"  {s['location']['path']}:{s['location']['start_line']} - {s['message']}" for s in r["data_flow"]]
                failure.text = "\n".join([f"{r['severity']} {r['rule_id']} at {r['place']}", r["snippet"], *(["Data flow:", *flow] if flow else [])])
                out.append(ET.tostring(case, encoding="unicode"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["row"])

    n = sum(counts(findings).values())
    head = f'<?xml version="1.0" encoding="utf-8"?><testsuites><testsuite name="{NAME}" tests="{n}" failures="{n}">'
    rows = ordered(findings.withColumn("place", place())).select("rule_id", "severity", "message", "snippet", "place", "data_flow").mapInArrow(run, "row string")
    return Lines([head], rows, ["</testsuite></testsuites>"])


def _console(findings: DataFrame, files: int) -> Lines:
    row = F.concat(F.rpad("severity", F.greatest(F.length("severity"), F.lit(9)), F.lit(" ")), F.rpad("rule_id", F.greatest(F.length("rule_id"), F.lit(45)), F.lit(" ")), place(), F.lit("  "), "message")
    found = counts(findings)
    return Lines([], ordered(findings.withColumn("row", row)).select("row"), [", ".join(f"{n} {s}" for s, n in found.items()) + f" in {files} files" if found else f"No findings in {files} files"])


#: The lines of a report by form, from the findings and the number of files. register_report adds one.
REPORTERS: dict[str, Callable[[DataFrame, int], Iterable[str]]] = {"console": _console, "json": _json, "sarif": _sarif, "markdown": _markdown, "html": _html, "junit": _junit}


def register_report(form: str, lines: Callable[[DataFrame, int], Iterable[str]]) -> None:
    """Raises ValueError if the form is taken."""
    if form in REPORTERS:
        raise ValueError(f"there is a format {form} already")
    REPORTERS[form] = lines


def report(findings: DataFrame, form: str, files: int) -> Iterator[str]:
    """The lines of a report. Rows come from the executors a partition at a time. Raises ValueError for an unknown form."""
    if form not in REPORTERS:
        raise ValueError(f"unknown format: {form}")
    return iter(REPORTERS[form](findings, files))


def write_report(findings: DataFrame, form: str, files: int, path: str) -> None:
    """The same as a file. Tasks write the findings' lines, and the driver joins the parts; only a form of one's own that isn't made of Lines
    passes the driver. Raises ValueError for an unknown form."""
    if form not in REPORTERS:
        raise ValueError(f"unknown format: {form}")
    lines = REPORTERS[form](findings, files)
    if isinstance(lines, Lines):
        write_lines(lines.rows, path, lines.head, lines.tail, lines.separator)
        return
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(line + "\n" for line in lines)


REPORT_ID = r"^[A-Za-z0-9_-]{6,64}$"


def share(findings: DataFrame, folder: str, report_id: str, expires_at: Column) -> None:
    """Keeps the findings below folder under that id until they expire. Raises ValueError for an id with other characters."""
    if not re.fullmatch(REPORT_ID[1:-1], report_id):
        raise ValueError(f"not a report id: {report_id!r}")
    findings.withColumn("expires_at", expires_at).write.mode("overwrite").parquet(f"{folder}/report={report_id}")


def shared(spark: SparkSession, folder: str, report_id: str, now: Column) -> DataFrame:
    """The findings of a shared report; none if it has expired."""
    if not re.fullmatch(REPORT_ID[1:-1], report_id):
        raise ValueError(f"not a report id: {report_id!r}")
    return spark.read.parquet(f"{folder}/report={report_id}").where(F.col("expires_at") >= now).drop("expires_at")
