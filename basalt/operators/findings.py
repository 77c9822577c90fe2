"""From candidates to findings: snippets, fingerprints, suppression, order, duplicates, thresholds, baselines and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.functions.text import lines, masked, squeezed
from basalt.model import CONFIDENCES, FINDING_COLUMNS, SEVERITIES, confidence_rank, severity_rank

SNIPPET, CONTEXT = 2, 3
DIRECTIVE = "basalt:ignore"
FIELDS = ["rule_id", "message", "severity", "confidence", "cwe", "owasp", "fix_suggestion", "fix_example", "references"]


def occurrence(keys: list[str] = ["path", "engine", "rule_id"], order: str = "seq") -> Column:  # noqa: B006
    """How many findings of the rule come before in the file and pass."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1


def fingerprint(rule_id: Column, context: Column, index: Column) -> Column:
    """The path has no part in it, so a moved file keeps its findings' identity."""
    nul = F.char(F.lit(0))
    return F.sha2(F.concat(rule_id, nul, context, nul, index.cast("string")), 256)


def completed(candidates: DataFrame, files: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of candidates: rule metadata, masked snippet, fingerprint. rules is a small table of rule metadata.

    Only lines near a candidate leave the texts. They meet the candidates by (path, line), an equality join.
    """
    numbered = candidates.withColumn("index", occurrence())
    reach = F.explode(F.sequence(F.lit(-CONTEXT), F.lit(CONTEXT)))
    near = numbered.select("path", "engine", "seq", "start_line", reach.alias("off")).withColumn("line", F.col("start_line") + F.col("off"))
    hit = candidates.select("path").distinct()
    text = files.select("path", "content").join(hit, "path", "left_semi").select("path", F.posexplode(lines(F.col("content"))).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")
    values = candidates.where("value is not null").groupBy("path", F.col("start_line").alias("line")).agg(F.sort_array(F.collect_set("value"), asc=False).alias("values"))
    hidden = F.aggregate(F.coalesce("values", F.expr("cast(array() as array<string>)")), F.col("text"), lambda t, v: F.replace(t, v, masked(v)))
    text = text.join(near.select("path", "line").distinct(), ["path", "line"], "left_semi").join(values, ["path", "line"], "left").select("path", "line", "text", hidden.alias("hidden"))
    around = near.join(text, ["path", "line"]).groupBy("path", "engine", "seq").agg(F.sort_array(F.collect_list(F.struct("off", "text", "hidden"))).alias("around"))
    rows = numbered.join(around, ["path", "engine", "seq"], "left").join(F.broadcast(rules.select(FIELDS)), "rule_id")
    shown = F.filter("around", lambda x: F.abs(x["off"]) <= SNIPPET)
    context = F.array_join(F.transform("around", lambda x: squeezed(x["text"])), "\n")
    rows = rows.withColumn("snippet", F.coalesce(F.array_join(F.transform(shown, lambda x: x["hidden"]), "\n"), F.lit("")))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.coalesce(context, F.lit("")), F.col("index")))
    return rows.withColumn("location", F.struct("path", "start_line", "start_col", "end_line", "end_col")).select(*FINDING_COLUMNS, "seq")


def suppressed_lines(files: DataFrame, directive: str = DIRECTIVE) -> DataFrame:
    """path, line, rule_id that a comment excuses: `<directive> <rule> -- <reason>` covers its line and the next. No reason, no effect."""
    pattern = rf"{directive}\s+([\w.\-]+)\s+--\s+\S.*$"
    text = files.where(F.col("content").contains(directive)).select("path", F.posexplode(lines(F.col("content"))).alias("at", "text"))
    found = text.where(F.col("text").rlike(pattern)).select("path", F.regexp_extract("text", pattern, 1).alias("rule_id"), F.explode(F.array(F.col("at") + 1, F.col("at") + 2)).alias("line"))
    return found.distinct()


def without_suppressed(findings: DataFrame, files: DataFrame, directive: str = DIRECTIVE) -> DataFrame:
    gone = suppressed_lines(files, directive).withColumnRenamed("rule_id", "rule")
    same = (F.col("location.path") == F.col("path")) & (F.col("location.start_line") == F.col("line")) & (F.col("rule_id") == F.col("rule"))
    return findings.join(gone, same, "left_anti")


def order_key() -> list[Column]:
    return [F.col("location.path"), F.col("location.start_line"), F.col("location.start_col"), F.col("rule_id"), F.col("engine"), F.col("seq")]


def deduplicated(findings: DataFrame) -> DataFrame:
    """Of findings with the same path and fingerprint, the first in order."""
    first = F.row_number().over(Window.partitionBy("location.path", "fingerprint").orderBy(*order_key()))
    return findings.withColumn("__n", first).where("__n = 1").drop("__n")


def configured(findings: DataFrame, *, disabled: tuple[str, ...] = (), min_confidence: str = "LOW") -> DataFrame:
    kept = findings.where(confidence_rank(F.col("confidence")) <= CONFIDENCES.index(min_confidence))
    return kept.where(~F.col("rule_id").isin(*disabled)) if disabled else kept


def fails(findings: DataFrame, fail_on: str = "LOW") -> DataFrame:
    """One row: exit_code 1 if a finding is at least that severe, else 0."""
    hit = F.max(F.when(severity_rank(F.col("severity")) <= SEVERITIES.index(fail_on), 1).otherwise(0))
    return findings.agg(F.coalesce(hit, F.lit(0)).alias("exit_code"))


def baseline(findings: DataFrame) -> DataFrame:
    return findings.select("fingerprint").distinct()


def new_since(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings whose fingerprint isn't in the baseline."""
    return findings.join(known.select("fingerprint"), "fingerprint", "left_anti").select(findings.columns)


def save_baseline(findings: DataFrame, path: str) -> None:
    baseline(findings).write.mode("overwrite").parquet(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def severity_counts(findings: DataFrame) -> DataFrame:
    """severity, n for each severity, zeros included."""
    names = findings.sparkSession.createDataFrame([(s, n) for n, s in enumerate(SEVERITIES)], "severity string, rank int")
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(names).join(counts, "severity", "left").select("severity", "rank", F.coalesce("n", F.lit(0)).alias("n"))


def matching(findings: DataFrame, text: str = "", severity: str | None = None) -> DataFrame:
    """Findings of the severity whose rule, message or path holds the text, in any case."""
    found = findings.where(F.lower(F.concat_ws(" ", "rule_id", "message", "location.path")).contains(text.lower()))
    return found.where(F.col("severity") == severity) if severity else found


def restamped(findings: DataFrame, path: Column) -> DataFrame:
    """Findings of another file with the same content: path in the location and in every step of the flow."""
    flow = F.transform("data_flow", lambda s: s.withField("location", s["location"].withField("path", path)))
    return findings.withColumn("location", F.col("location").withField("path", path)).withColumn("data_flow", flow)


def cache_split(files: DataFrame, cache: DataFrame, config: str) -> tuple[DataFrame, DataFrame]:
    """files that the cache (config, language, digest) knows under this configuration, and the others."""
    valid = cache.where(F.col("config") == config).select(F.coalesce("language", F.lit("")).alias("__l"), F.col("digest").alias("__d")).distinct()
    same = (F.coalesce("language", F.lit("")) == F.col("__l")) & (F.col("digest") == F.col("__d"))
    return files.join(valid, same, "left_semi"), files.join(valid, same, "left_anti")
