"""Rules: the ones that come with the package, and those of a user's YAML files."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from basalt.model import CONFIDENCES, SEVERITIES
from basalt.operators.patterns import PatternError, compile_pattern, pattern_rows

ALLOWED = {"id", "languages", "mode", "severity", "confidence", "message", "cwe", "owasp", "pattern", "pattern-either", "sources", "sanitizers", "sinks", "fix_suggestion", "fix_example", "references", "tests"}
METADATA = "rule_id string, message string, severity string, confidence string, cwe array<string>, owasp string, fix_suggestion string, fix_example string, references array<string>"


class RuleError(ValueError):
    """A rule that can't be used, with the reason."""


def checked(raw: dict) -> dict:
    """The rule with its patterns as lists. Raises RuleError for unknown keys, ranks and modes, and for patterns that can't be read."""
    name = raw.get("id")
    if not name:
        raise RuleError("a rule has no id")
    if unknown := set(raw) - ALLOWED:
        raise RuleError(f"{name}: unknown keys {sorted(unknown)}")
    if raw.get("severity") not in SEVERITIES or raw.get("confidence") not in CONFIDENCES:
        raise RuleError(f"{name}: unknown severity or confidence")
    rule = {**raw, "pattern": [*([raw["pattern"]] if raw.get("pattern") else []), *raw.get("pattern-either", [])]}
    for role in ("sources", "sanitizers", "sinks"):
        rule[role] = [p["pattern"] if isinstance(p, dict) else p for p in raw.get(role, [])]
    rule["arguments"] = [p.get("taint_arg", 0) if isinstance(p, dict) else 0 for p in raw.get("sinks", [])]
    if raw.get("mode") == "pattern":
        if not rule["pattern"]:
            raise RuleError(f"{name}: no pattern")
    elif raw.get("mode") == "taint":
        if not rule["sources"] or not rule["sinks"]:
            raise RuleError(f"{name}: a taint rule needs sources and sinks")
    else:
        raise RuleError(f"{name}: unknown mode {raw.get('mode')}")
    for language in rule["languages"]:
        for text in (*rule["pattern"], *rule["sources"], *rule["sanitizers"], *rule["sinks"]):
            try:
                compile_pattern(text, language)
            except PatternError as e:
                raise RuleError(f"{name}: {language} can't read {text!r}") from e
    return rule


def load_rules(folder: str | Path) -> list[dict]:
    """The rules of all *.yml files below the folder, in order of path. Raises RuleError for an id that is used twice."""
    rules: list[dict] = []
    for path in sorted(Path(folder).rglob("*.yml")):
        rules += [checked(raw) for raw in yaml.safe_load(path.read_text(encoding="utf-8")) or []]
    ids = [r["id"] for r in rules]
    if twice := {i for i in ids if ids.count(i) > 1}:
        raise RuleError(f"used twice: {sorted(twice)}")
    return rules


def built_in() -> list[dict]:
    return load_rules(Path(__file__).parent)


def metadata(spark: SparkSession, rules: list[dict]) -> DataFrame:
    rows = [(r["id"], r["message"], r["severity"], r["confidence"], r.get("cwe", []), r.get("owasp"), r.get("fix_suggestion"), r.get("fix_example"), r.get("references", [])) for r in rules]
    return spark.createDataFrame(rows, METADATA)


def all_patterns(rules: list[dict]) -> list[tuple]:
    """Pattern rows (see operators.patterns) of all roles; a sink's row has the argument to watch."""
    rows = pattern_rows([r for r in rules if r["mode"] == "pattern"])
    taint = [r for r in rules if r["mode"] == "taint"]
    for role in ("sources", "sanitizers", "sinks"):
        found = pattern_rows(taint, role)
        if role == "sinks":
            watched = [a for r in taint for _ in r["languages"] for a in r["arguments"]]
            found = [(*row[:-1], a) for row, a in zip(found, watched)]
        rows += found
    return rows
