"""Secrets by regular expressions, entropy and format, all within the JVM.

A text is folded once and searched for the literals that the expressions require (see operators.literals); only a detector whose literal is
there runs its expression. An index of trigrams, where there is one, leaves out the texts that no detector can match before that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.functions.text import entropy
from basalt.operators.literals import TrigramIndex, folded, may_match, of_digests
from basalt.plans.store import stored


@dataclass(frozen=True)
class Detector:
    """pattern: a Java regular expression whose group 1, if it has one, is the value and ends one character before the match does."""

    rule_id: str
    pattern: str
    severity: str
    confidence: str
    cwe: str
    message: str
    grouped: bool = False
    min_entropy: float | None = None
    jwt: bool = False


# Rule names, patterns, ranks and entropy limits.
DETECTORS = (
    Detector("secrets.aws.access-key-id", r"(?U)\bAKIA[0-9A-Z]{16}\b", "HIGH", "HIGH", "CWE-798", "An AWS access key id is written in the code."),
    Detector("secrets.aws.secret-access-key", r"(?iU)aws.{0,40}?['\"]([A-Za-z0-9/+=]{40})['\"]", "HIGH", "MEDIUM", "CWE-798", "What looks like an AWS secret key is written next to 'aws'.", True, 3.5),
    Detector("secrets.github.token", r"(?U)\b(?:gh[oprsu]_[A-Za-z0-9]{36}|github_pat_[0-9A-Za-z_]{82})\b", "HIGH", "HIGH", "CWE-798", "A GitHub token is written in the code."),
    Detector("secrets.google.api-key", r"(?U)\bAIza[0-9A-Za-z\-_]{35}\b", "HIGH", "MEDIUM", "CWE-798", "A Google API key is written in the code."),
    Detector("secrets.slack.token", r"(?U)\bxox[baprs]-[0-9A-Za-z-]{10,}\b", "HIGH", "MEDIUM", "CWE-798", "A Slack token is written in the code."),
    Detector("secrets.private-key.pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----", "CRITICAL", "HIGH", "CWE-321", "A private key is written in the code."),
    Detector("secrets.jwt", r"(?U)\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "LOW", "LOW", "CWE-312", "A JSON web token is written in the code.", jwt=True),
    Detector("secrets.db.connection-string", r"(?iU)\b(?:mongodb(?:\+srv)?|postgres(?:ql)?|mysql|redis|amqps?)://[^\s:@/]+:([^\s@/]{3,})@", "HIGH", "MEDIUM", "CWE-798", "A connection string holds a password.", True),
    Detector("secrets.generic.high-entropy-assignment", r"(?iU)(?:api[_-]?key|secret|token|passwd|password)\s*[:=]\s*['\"]([^'\"]{12,})['\"]", "MEDIUM", "LOW", "CWE-798", "A random-looking value is assigned to a sensitive name.", True, 3.2),
)
FIX = "Keep secrets in the environment or a secret store, and replace this one: it is known to all who can read the code."


def rules_table(spark: SparkSession, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """A row of rule metadata for each detector."""
    rows = [(d.rule_id, d.message, d.severity, d.confidence, [d.cwe], None, FIX, None, [f"https://cwe.mitre.org/data/definitions/{d.cwe[4:]}.html"]) for d in detectors]
    return spark.createDataFrame(rows, "rule_id string, message string, severity string, confidence string, cwe array<string>, owasp string, fix_suggestion string, fix_example string, references array<string>")


def is_jwt(value: Column) -> Column:
    """Whether the first segment is the base64 of a JSON object with a key alg or typ."""
    head = F.translate(F.substring_index(value, ".", 1), "-_", "+/")
    data = F.try_to_binary(F.concat(head, F.repeat(F.lit("="), F.pmod(-F.length(head), F.lit(4)))), F.lit("base64"))
    keys = F.json_object_keys(F.try_validate_utf8(data.cast("string")))
    return F.coalesce(F.arrays_overlap(keys, F.array(F.lit("alg"), F.lit("typ"))), F.lit(False))


def _matches(content: Column, text: Column, at: int, detector: Detector) -> Column:
    """text: content, folded. detector (number), at, lead (text from the last match to the value), value, tail (characters of the match after the value)."""
    gaps = F.split(content, detector.pattern, -1)
    whole = F.regexp_extract_all(content, F.lit(detector.pattern if detector.grouped else f"({detector.pattern})"), F.lit(0))
    values = F.regexp_extract_all(content, F.lit(detector.pattern), F.lit(1)) if detector.grouped else whole
    found = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), values.alias("value"))
    found = F.filter(found, lambda m: m["value"].isNotNull())
    tail = 1 if detector.grouped else 0
    lead = lambda m: F.concat(m["gap"], F.expr("''") if not detector.grouped else F.left(m["whole"], F.length(m["whole"]) - F.length(m["value"]) - 1))
    cut = F.transform(found, lambda m, i: F.struct(F.lit(at).alias("detector"), i.alias("at"), lead(m).alias("lead"), m["value"].alias("value"), F.lit(tail).alias("tail")))
    return F.when(may_match(text, detector.pattern) & content.rlike(detector.pattern), cut)


def _last_line(text: Column) -> Column:
    return F.length(F.substring_index(text, "\n", -1))


def possible(files: DataFrame, index: TrigramIndex, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """The files (digest) that a detector may match by the index, and those that it doesn't know. Of the others only digests move."""
    may = index.candidates({d.rule_id: d.pattern for d in detectors}).select("digest").distinct()
    unknown = files.select("digest").distinct().join(index.known(), "digest", "left_anti")
    return of_digests(files, stored(may.unionByName(unknown)))


def secrets(files: DataFrame, detectors: tuple[Detector, ...] = DETECTORS, index: TrigramIndex | None = None) -> DataFrame:
    """Candidates (see model.CANDIDATE) of files (path, content; with an index also digest). One scan of the texts serves all detectors."""
    files = possible(files, index, detectors) if index else files
    content, empty = F.col("content"), F.expr("cast(array() as array<struct<detector: int, at: int, lead: string, value: string, tail: int>>)")
    every = F.concat(*(F.coalesce(_matches(content, F.col("text"), n, d), empty) for n, d in enumerate(detectors)))
    rows = files.select("path", "content", folded(content).alias("text")).select("path", F.explode(every).alias("m")).select("path", "m.*")
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    upto = Window.partitionBy("path", "detector").orderBy("at")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    # Positions add up over the matches of a file; nothing looks at its whole text again.
    rows = rows.select("path", "detector", "at", "value", F.length("lead").alias("lead"), newlines(F.col("lead")).alias("lead_lines"), _last_line(F.col("lead")).alias("lead_last"), F.length("value").alias("size"), newlines(F.col("value")).alias("value_lines"), _last_line(F.col("value")).alias("value_last"), "tail")
    rows = rows.withColumn("first", F.coalesce(F.sum(F.col("lead") + F.col("size") + F.col("tail")).over(before), F.lit(0)) + F.col("lead"))
    rows = rows.withColumn("line", 1 + F.coalesce(F.sum(F.col("lead_lines") + F.col("value_lines")).over(before), F.lit(0)) + F.col("lead_lines"))
    in_lead = F.when(F.col("lead_lines") > 0, F.col("first") - F.col("lead_last"))
    in_value = F.when(F.col("value_lines") > 0, F.col("first") + F.col("size") - F.col("value_last"))
    line_start = F.greatest(F.coalesce(in_lead, F.lit(0)), F.coalesce(F.max(F.greatest(F.coalesce(in_lead, F.lit(0)), F.coalesce(in_value, F.lit(0)))).over(before), F.lit(0)))
    rows = rows.withColumn("start_col", F.col("first") - line_start).withColumn("end_line", F.col("line") + F.col("value_lines"))
    rows = rows.withColumn("end_col", F.when(F.col("value_lines") > 0, F.col("value_last")).otherwise(F.col("start_col") + F.col("size")))
    keep = F.lit(True)
    for n, d in enumerate(detectors):
        if d.min_entropy is not None:
            keep = keep & ((F.col("detector") != n) | (entropy(F.col("value")) >= d.min_entropy))
        if d.jwt:
            keep = keep & ((F.col("detector") != n) | is_jwt(F.col("value")))
    name = F.get(F.array(*(F.lit(d.rule_id) for d in detectors)), F.col("detector"))
    ints = [F.col(c).cast("int").alias(a) for c, a in (("line", "start_line"), ("start_col", "start_col"), ("end_line", "end_line"), ("end_col", "end_col"))]
    return rows.where(keep).select("path", F.lit("regex").alias("engine"), name.alias("rule_id"), (F.shiftleft(F.col("detector").cast("long"), 32) + F.col("at")).alias("seq"), *ints, "value", F.expr("cast(array() as array<struct<location: struct<path: string, start_line: int, start_col: int, end_line: int, end_col: int>, message: string>>)").alias("data_flow"))
