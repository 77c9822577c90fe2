"""The findings schema, and the order of severities and confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of ranks, worst or surest first.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")

LOCATION = "struct<path: string, start_line: int, start_col: int, end_line: int, end_col: int>"
FLOW = f"array<struct<location: {LOCATION}, message: string>>"
FINDING = (
    f"rule_id string, message string, severity string, confidence string, location {LOCATION}, snippet string, engine string, cwe array<string>, owasp string, "
    f"data_flow {FLOW}, fix_suggestion string, fix_example string, references array<string>, fingerprint string"
)
FINDING_COLUMNS = ["rule_id", "message", "severity", "confidence", "location", "snippet", "engine", "cwe", "owasp", "data_flow", "fix_suggestion", "fix_example", "references", "fingerprint"]

#: What the passes give before a finding is completed: seq is the order within (path, engine); value is a secret to be masked.
CANDIDATE = f"path string, engine string, rule_id string, seq long, start_line int, start_col int, end_line int, end_col int, value string, data_flow {FLOW}"


def rank(value: Column, order: tuple[str, ...]) -> Column:
    """Place in the order, 0 first; null if it isn't in it."""
    place = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(place > 0, (place - 1).cast("int"))


def severity_rank(value: Column) -> Column:
    return rank(value, SEVERITIES)


def confidence_rank(value: Column) -> Column:
    return rank(value, CONFIDENCES)
