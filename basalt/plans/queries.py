"""The engine's queries over the shipped tables, and the SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt import rules as rulepacks
from basalt.functions.text import client_ip, entropy, html_escaped, lines, masked, percent_done, squeezed
from basalt.model import SEVERITIES, severity_rank
from basalt.operators import findings as fin
from basalt.operators import reports
from basalt.operators.facts import code_facts
from basalt.operators.literals import TrigramIndex, literals
from basalt.operators.patterns import pattern_candidates, pattern_rows, patterns_table
from basalt.operators.secrets import DETECTORS, rules_table, secrets
from basalt.plans.cache import ScanCache
from basalt.plans.corpus import PYTHON_LINES, SCRIPT_LINES, STEPS, TEMPLATES, TREE_FOLDERS, TREE_SUFFIXES, branching, nested, planted, planted_parts, ruled, templated, tree_paths, write_archives, write_tree
from basalt.plans.scan import Options, scan
from basalt.plans.store import shared_path, stored
from basalt.sources.files import base_name, files_from_archives, files_from_dir, files_from_table, ignored, language, repository
from basalt.sources.tree import local_path
from basalt.streaming.limits import fresh, in_flight, rate_limited

WEEK = "interval 168 hours"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_from_table(table(spark, sf_dir, "documents").select("doc_id", "text"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"))


def found_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret findings in all documents."""
    files = documents(spark, sf_dir)
    return fin.completed(stored(secrets(files)), files, rules_table(spark))


def graded_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents with their rules' ranks: all that counting needs, without snippets or fingerprints."""
    ranks = rules_table(spark).select("rule_id", "severity", "confidence")
    return secrets(documents(spark, sf_dir)).join(F.broadcast(ranks), "rule_id")


def secret_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(documents(spark, sf_dir))
    return found.select("path", "rule_id", "start_line", masked(F.col("value")).alias("shown"), F.length("value").cast("long").alias("size"), F.round(entropy(F.col("value")), 6).alias("bits"))


def indexed_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents, found through an index of trigrams that was filled in two steps."""
    files, index = documents(spark, sf_dir), TrigramIndex(spark, shared_path(spark))
    index.add(files.where("digest < '8'"))
    index.add(files)
    found = secrets(files, index=index)
    return found.select("path", "rule_id", "start_line", masked(F.col("value")).alias("shown"))


def literal_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many contents the index leaves to each detector, and how many there are."""
    index = TrigramIndex(spark, shared_path(spark))
    index.add(documents(spark, sf_dir))
    counts = index.candidates({d.rule_id: d.pattern for d in DETECTORS}).groupBy(F.col("name").alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([(d.rule_id,) for d in DETECTORS], "rule_id string")
    total = index.known().agg(F.count(F.lit(1)).alias("contents")).first()[0]
    return F.broadcast(names).join(counts, "rule_id", "left").select("rule_id", F.coalesce("n", F.lit(0)).alias("n"), F.lit(total).cast("long").alias("contents"))


def planted_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every kind, in texts made from the events."""
    found = secrets(planted(table(spark, sf_dir, "events")))
    return found.select("path", "rule_id", "start_line", masked(F.col("value")).alias("shown"), F.length("value").alias("size"), F.round(entropy(F.col("value")), 6).alias("bits"))


def planted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by rule, of medium confidence at least and without a disabled rule."""
    ranks = rules_table(spark).select("rule_id", "severity", "confidence")
    found = secrets(planted(table(spark, sf_dir, "events"))).join(F.broadcast(ranks), "rule_id")
    return fin.configured(found, disabled=("secrets.slack.token",), min_confidence="MEDIUM").groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def secrets_all_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(d.rule_id,) for d in DETECTORS], "rule_id string")
    counts = secrets(documents(spark, sf_dir)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(names).join(counts, "rule_id", "left").select("rule_id", F.coalesce("n", F.lit(0)).alias("n"))


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fin.severity_counts(graded_secrets(spark, sf_dir)).select("severity", "n")


def fail_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graded_secrets(spark, sf_dir)
    return found.agg(*(F.coalesce(F.max((severity_rank(F.col("severity")) <= n).cast("int")), F.lit(0)).alias(f"fails_on_{s.lower()}") for n, s in enumerate(SEVERITIES)))


def min_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graded_secrets(spark, sf_dir)
    return fin.configured(found, min_confidence="MEDIUM").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def line_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_secrets(spark, sf_dir)
    return found.select(F.col("location.path").alias("path"), "rule_id", F.col("location.start_line").alias("line"), "snippet")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_secrets(spark, sf_dir).select(F.col("location.path").alias("path"), "rule_id", F.col("location.start_line").alias("line"), "fingerprint")


def dedup_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_secrets(spark, sf_dir)
    return fin.deduplicated(found.unionByName(found)).groupBy(F.col("location.path").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fingerprint").alias("n_fingerprints"))


def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all documents that aren't known from the English ones."""
    found = stored(found_secrets(spark, sf_dir))
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("p"))
    known = fin.baseline(found.join(english, F.col("location.path") == F.col("p"), "left_semi"))
    return fin.new_since(found, known).select(F.col("location.path").alias("path"), "fingerprint")


def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.markdown_rows(found_secrets(spark, sf_dir)).select("row")


def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of findings in a Markdown file that tasks wrote, with their numbers in the file's order."""
    path = local_path(shared_path(spark)) + ".md"
    reports.write_report(stored(found_secrets(spark, sf_dir)), "markdown", 0, path)
    lines = spark.read.option("wholetext", True).text(f"file://{path}").select(F.posexplode(F.split("value", "\n")).alias("at", "row"))
    return lines.where("row rlike '^[|] [A-Z]+ [|]'").select((F.row_number().over(Window.orderBy("at")) - 1).alias("n"), "row")


def ui_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fin.matching(found_secrets(spark, sf_dir), "Doc/1", "MEDIUM").select(F.col("location.path").alias("path"), "rule_id")


def sarif_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = stored(found_secrets(spark, sf_dir))
    found = every.join(F.broadcast(reports.rule_index(every)), "rule_id")
    return found.groupBy("rule_id", "rule_index", reports.lookup(reports.LEVELS, F.col("severity")).alias("level"), reports.lookup(reports.SCORES, F.col("severity")).alias("score")).agg(F.count(F.lit(1)).alias("n"))


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("size").alias("size"))


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a cache filled from the English documents knows."""
    files = documents(spark, sf_dir)
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.sha2(F.regexp_replace("text", "\r\n?", "\n"), 256).alias("digest"))
    cache = english.select(F.lit("v1").alias("config"), F.lit(None).cast("string").alias("language"), "digest")
    hits, misses = fin.cache_split(files, cache, "v1")
    return hits.select("path", F.lit(True).alias("hit")).unionByName(misses.select("path", F.lit(False).alias("hit")))


def line_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = documents(spark, sf_dir).select("path", F.posexplode(lines(F.col("content"))).alias("at", "line"))
    return each.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length(squeezed(F.col("line")))).alias("n_chars"))


def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html_escaped(F.col("html")).cast("binary")).alias("escaped_md5"))


def paths(events: DataFrame) -> DataFrame:
    """event_id, path: a plausible path for each event."""
    suffix = F.get(F.array(*map(F.lit, (".py", ".JS", ".tsx", ".min.js", ".pyi", ".txt", ""))), (F.col("event_id") % 7).cast("int"))
    folder = F.get(F.array(*map(F.lit, ("src", "node_modules/a", "lib/dist", "build", "a/b/.git"))), (F.col("event_id") % 5).cast("int"))
    return events.select("event_id", "event_type", F.concat(folder, F.lit("/"), F.col("event_type"), suffix).alias("path"))


def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("event_id") % 3 == 0, "#!/usr/bin/env python3\n").when(F.col("event_id") % 3 == 1, "#!/usr/bin/node\n").otherwise("x\n")
    return paths(table(spark, sf_dir, "events")).select("event_id", F.coalesce(language(F.col("path"), first), F.lit("none")).alias("language"), base_name(F.col("path")).alias("name"))


def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = ("node_modules/", "dist/", "build/", ".git/", "*.min.js", "/src/view*", "!/src/view.py")
    return paths(table(spark, sf_dir, "events")).where(~ignored(F.col("path"), patterns)).select("event_id", "path")


def repository_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 5
    url = F.concat(F.when(kind == 0, "https://github.com/").when(kind == 1, "http://www.github.com/").when(kind == 2, "https://example.com/").otherwise("https://github.com/"), F.col("event_type"), F.lit("/repo"), F.col("user_id").cast("string"), F.when(kind == 3, ".git").when(kind == 4, "/tree/main").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", repository(url).alias("r")).where("r is not null").select("event_id", "r.owner", "r.name")


def client_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    forwarded = F.concat(F.lit("10.0.0."), user, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(", , 10.1.1."), user)).otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", client_ip(forwarded, F.lit("192.0.2.1"), (F.col("event_id") % 3).cast("int")).alias("ip"))


def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", percent_done(F.col("event_id") % 300, F.col("event_id") % 200).alias("percent"))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return rate_limited(events, "user_id", "ts", "event_id", limit=3, window=3600.0).select("event_id", "accepted")


def open_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("ts") + F.expr("interval 6 hours")).alias("done"))
    return in_flight(events, "user_id", "ts", "done").select("event_id", F.col("n_open").cast("long").alias("n_open"))


def report_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = table(spark, sf_dir, "events").select("event_id", (F.col("ts") + F.expr(WEEK)).alias("expires_at"))
    return fresh(shared, "expires_at", F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id")


def feedback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback by rule; ids that aren't rule ids are refused."""
    rule = F.concat(F.lit("rule."), F.col("event_type"), F.when(F.col("event_id") % 10 == 0, "!").otherwise(""))
    return table(spark, sf_dir, "events").select(rule.alias("rule_id")).where(F.col("rule_id").rlike(r"^[a-z0-9]+(?:[.-][a-z0-9]+)*$")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def script_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of track with one argument in the scripts of pages."""
    code = F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1)), "\n")
    files = files_from_table(table(spark, sf_dir, "pages"), F.concat(F.col("page_id").cast("string"), F.lit(".js")), code)
    rows = pattern_rows([{"id": "js.track", "languages": ["javascript"], "pattern": ["track($X)"]}])
    found = pattern_candidates(code_facts(files), patterns_table(spark, rows))
    return found.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("page_id"), "rule_id", "start_line")


def _templated(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = templated(table(spark, sf_dir, "events").select("event_id"))
    return files_from_table(files, F.col("path"), F.col("content"))


def code_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passes over a file for each event."""
    found = scan(_templated(spark, sf_dir))
    return found.select(F.col("location.path").alias("path"), "rule_id", F.col("location.start_line").alias("line"))


def cached_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passes over a file for each event, through a cache that holds every other one already, and was compacted."""
    files, cache = _templated(spark, sf_dir), ScanCache(spark, shared_path(spark))
    scan(files.where(F.crc32("path") % 2 == 0), cache=cache)
    scan(files.where(F.crc32("path") % 3 == 0), cache=cache)
    cache.compact()
    found = scan(files, cache=cache)
    return found.select(F.col("location.path").alias("path"), "rule_id", F.col("location.start_line").alias("line"))


def cache_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many contents each of three scans searches: the English documents, all, and all again."""
    files, cache, options = documents(spark, sf_dir), ScanCache(spark, shared_path(spark)), Options(passes=("secrets",))
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    for which in (files.join(english, "path", "left_semi"), files, files):
        scan(which, options, cache=cache)
    steps = spark.range(3).select((F.col("id") + 1).alias("scan"))
    counts = cache.contents.read().groupBy(F.regexp_extract(F.input_file_name(), r"/v(\d+)/", 1).cast("long").alias("version")).agg(F.count(F.lit(1)).alias("contents"))
    return steps.join(counts, F.col("version") + 1 == F.col("scan"), "left").select("scan", F.coalesce("contents", F.lit(0)).alias("contents"))


def taint_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_templated(spark, sf_dir), Options(passes=("taint",)))
    return found.select(F.col("location.path").alias("path"), "rule_id", F.get("data_flow", F.lit(0))["location"]["start_line"].alias("first_line"), F.element_at("data_flow", -1)["location"]["start_line"].alias("last_line"))


def rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every code rule finds in two lines for each event."""
    files = ruled(table(spark, sf_dir, "events").select("event_id"))
    found = scan(files_from_table(files, F.col("path"), F.col("content")), Options(passes=("patterns", "taint")))
    return found.select(F.col("location.path").alias("path"), "rule_id", F.col("location.start_line").alias("line"))


def branch_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows through three statements of branches, loops and handlers, by every event."""
    files = branching(table(spark, sf_dir, "events").select("event_id"))
    found = scan(files_from_table(files, F.col("path"), F.col("content")), Options(passes=("taint",)))
    return found.select(F.col("location.path").alias("path"), "rule_id")


NESTED_RULES = [{"id": f"own.{name}", "languages": ["python"], "mode": "pattern", "severity": "LOW", "confidence": "LOW", "message": name, "pattern": text} for name, text in (("encoded-twice", "send(encode($X), ..., $X)"), ("doubled", "f($X + $X)"), ("keyed", "send($F($X), ..., key[$K], $Y)"))]


def nested_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns with calls, operators and subscripts inside, over two lines for each event."""
    files = nested(table(spark, sf_dir, "events"))
    found = scan(files_from_table(files, F.col("path"), F.col("content")), Options(rules=[rulepacks.checked(r) for r in NESTED_RULES], passes=("patterns",)))
    return found.select(F.col("location.path").alias("path"), "rule_id", F.col("location.start_line").alias("line"))


def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of a tree with ignored folders and nested ignore files, as the tree's source reads them."""
    root = local_path(shared_path(spark))
    write_tree(tree_paths(table(spark, sf_dir, "documents")), root)
    found = files_from_dir(spark, root, nested=True)
    return found.where("path not like '%.gitignore'").select("path", "size", "language", "digest")


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as members of zip and tar archives, read by ranges of members."""
    root = local_path(shared_path(spark))
    write_archives(table(spark, sf_dir, "documents").select("doc_id", "text"), root)
    return files_from_archives(spark, root).select(base_name(F.col("archive")).alias("archive"), "path", "size", "digest")


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each code rule fires in two lines for each event, zeros included."""
    rules = rulepacks.metadata(spark, rulepacks.built_in()).select("rule_id", "severity")
    counts = rule_lines(spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(rules).join(counts, "rule_id", "left").select("rule_id", "severity", F.coalesce("n", F.lit(0)).alias("n"))


QUERIES = {f.__name__: f for f in (severity_counts, secret_values, indexed_secrets, literal_pruning, planted_secrets, planted_confidence, secrets_all_counts, fail_threshold, min_confidence, line_snippets, fingerprints, dedup_findings, baseline_diff, markdown_rows, written_report, ui_search, sarif_levels, content_dedup, cache_hits, line_shapes, html_escape, language_detect, ignore_filter, repository_urls, client_ips, progress_percent, rate_limit, open_requests, report_ttl, feedback_counts, script_calls, code_scan, cached_scan, cache_growth, taint_flows, rule_lines, branch_flows, nested_calls, source_tree, archive_members, rule_counts)}

# The same in SQL. RE2 patterns: its \s has no vertical tab, its \b is of ASCII letters.
_RE = {
    "secrets.aws.access-key-id": (r"\bAKIA[0-9A-Z]{16}\b", 0, 0.0, "HIGH"),
    "secrets.aws.secret-access-key": (r"(?i)aws.{0,40}?['\"]([A-Za-z0-9/+=]{40})['\"]", 1, 3.5, "HIGH"),
    "secrets.github.token": (r"\b(?:gh[oprsu]_[A-Za-z0-9]{36}|github_pat_[0-9A-Za-z_]{82})\b", 0, 0.0, "HIGH"),
    "secrets.google.api-key": (r"\bAIza[0-9A-Za-z\-_]{35}\b", 0, 0.0, "HIGH"),
    "secrets.slack.token": (r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b", 0, 0.0, "HIGH"),
    "secrets.private-key.pem": (r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----", 0, 0.0, "CRITICAL"),
    "secrets.jwt": (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", 0, 0.0, "LOW"),
    "secrets.db.connection-string": (r"(?i)\b(?:mongodb(?:\+srv)?|postgres(?:ql)?|mysql|redis|amqps?)://[^\s:@/]+:([^\s@/]{3,})@", 1, 0.0, "HIGH"),
    "secrets.generic.high-entropy-assignment": (r"(?i)(?:api[_-]?key|secret|token|passwd|password)\s*[:=]\s*['\"]([^'\"]{12,})['\"]", 1, 3.2, "MEDIUM"),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# whole: the match, value: its group; hits of a file and rule are numbered in order; a value's line is counted in what stands before it.
_FOUND = "WITH det(rule_id, pat, grp, least, severity) AS (VALUES " + ", ".join(f"({_quoted(r)}, {_quoted(p)}, {g}, {e}, '{s}')" for r, (p, g, e, s) in _RE.items()) + r"""),
txt AS (SELECT 'doc/' || doc_id || '.txt' AS path, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS body FROM documents),
hit0 AS (""" + " UNION ALL ".join(f"SELECT path, body, {_quoted(r)} AS rule_id, unnest(regexp_extract_all(body, {_quoted(p)})) AS whole, unnest(regexp_extract_all(body, {_quoted(p)}, {g})) AS value, generate_subscripts(regexp_extract_all(body, {_quoted(p)}), 1) AS nth FROM txt" for r, (p, g, _, _) in _RE.items()) + r"""),
bits AS (SELECT value, sum(-p * log2(p)) AS bits FROM (SELECT value, c, count(*) / any_value(length(value))::DOUBLE AS p FROM (SELECT value, unnest(string_split(value, '')) AS c FROM (SELECT DISTINCT value FROM hit0)) GROUP BY value, c) GROUP BY value),
-- the n-th hit begins after the texts of those before it: found by cutting at each whole match in turn
hit1 AS (SELECT *, (SELECT count(*) FROM hit0 b WHERE b.path = a.path AND b.rule_id = a.rule_id AND b.whole = a.whole AND b.nth < a.nth) AS same FROM hit0 a),
hit AS (SELECT h.*, d.severity, b.bits,
          CAST(list_sum(list_transform(string_split(body, whole)[1:same + 1], lambda x: length(x))) AS BIGINT) + (same + 1) * length(whole) - CASE WHEN d.grp = 1 THEN length(value) + 1 ELSE length(value) END AS first
        FROM hit1 h JOIN det d USING (rule_id) JOIN bits b USING (value) WHERE b.bits >= d.least),
found AS (SELECT *, 1 + length(left(body, first)) - length(replace(left(body, first), chr(10), '')) AS line,
            CASE WHEN length(value) <= 8 THEN repeat('*', length(value)) ELSE left(value, 4) || repeat('*', length(value) - 8) || right(value, 4) END AS shown,
            row_number() OVER (PARTITION BY path, rule_id ORDER BY nth) - 1 AS idx FROM hit)
"""
_LINES = r""", rows AS (SELECT path, unnest(regexp_split_to_array(body, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]')) AS text, generate_subscripts(regexp_split_to_array(body, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'), 1) AS n, body FROM txt WHERE path IN (SELECT path FROM found)),
lin AS (SELECT path, n, text FROM rows r WHERE NOT (text = '' AND n = (SELECT max(n) FROM rows q WHERE q.path = r.path)))
"""
_EXPECTED = "(VALUES " + ", ".join(f"({n}, '{s}', {_quoted(e[0])}, {e[1]}, {e[2] if len(e) > 2 else 0})" for n, (s, _, e) in enumerate(TEMPLATES) if e) + ") AS t(n, suffix, rule_id, line, first_line)"

# What a rule finds in a line of code: suffix, rule, a regular expression of the line.
_LINE_RULES = (
    ("py", "py.crypto.weak-hash-md5", r"^d = hashlib\.md5\("), ("py", "py.crypto.weak-hash-sha1", r"^d = hashlib\.sha1\("), ("py", "py.crypto.weak-hash-new", r"hashlib\.new\('(md5|sha1)'"),
    ("py", "py.crypto.requests-no-verify", r"^requests\..*verify=False"), ("py", "py.crypto.ssl-unverified-context", r"ssl\._create_unverified"), ("py", "py.dangerous.os-system", r"^os\.system\("),
    ("py", "py.dangerous.eval", r"^eval\("), ("py", "py.dangerous.yaml-load", r"^yaml\.load\([^,]*\)$"), ("py", "py.dangerous.exec", r"^exec\("), ("py", "py.dangerous.tempfile-mktemp", r"tempfile\.mktemp\("),
    ("py", "py.deser.pickle-load", r"^pickle\.load\("), ("py", "py.deser.pickle-loads", r"^pickle\.loads\("), ("py", "py.deser.marshal-loads", r"^marshal\.loads\("), ("py", "py.deser.yaml-unsafe-load", r"^yaml\.unsafe_load\("),
    ("py", "py.deser.jsonpickle", r"^jsonpickle\.decode\("), ("py", "py.flask.debug-run", r"\.run\(.*debug=True"), ("py", "py.django.raw-sql", r"\.raw\("), ("py", "py.xss.flask-markup", r"^mark_safe\("),
    ("py", "py.injection.subprocess-shell-true", r"^subprocess\..*shell=True"), ("py", "py.injection.os-popen", r"^os\.popen\("), ("py", "py.injection.subprocess-getoutput", r"^subprocess\.getoutput\("),
    ("py", "py.taint.sql-injection", r"\.execute\(request\."), ("py", "py.taint.command-injection", r"^subprocess\.call\(request\."),
    ("js", "js.crypto.weak-hash", r"createHash\('(md5|sha1)'\)"), ("js", "js.crypto.create-cipher", r"^crypto\.createCipher\("), ("js", "js.dangerous.eval", r"^eval\("), ("js", "js.dangerous.child-process-exec", r"^cp\.exec\([^,]*\);"),
    ("js", "js.dangerous.child-process-exec-sync", r"\.execSync\("), ("js", "js.dangerous.new-function", r"new Function\("), ("js", "js.dangerous.vm-run", r"^vm\.runIn"), ("js", "js.xss.document-write", r"^document\.write\("),
    ("js", "js.xss.inner-html", r"\.innerHTML ="), ("js", "js.xss.outer-html", r"\.outerHTML ="), ("js", "js.xss.insert-adjacent-html", r"\.insertAdjacentHTML\("), ("js", "js.taint.sql-injection", r"\.query\(req\."),
    ("js", "js.taint.command-injection", r"^cp\.exec\(req\."),
)
_SEVERITY = {rule["id"]: rule["severity"] for rule in rulepacks.built_in()}
_LINE_AT = lambda lines, at: f"CASE ({at}) % {len(lines)} " + " ".join(f"WHEN {n} THEN {_quoted(x)}" for n, x in enumerate(lines)) + " END"
_LINE_TEXTS = ", ".join(f"CASE WHEN event_id % 2 = 0 THEN {_LINE_AT(PYTHON_LINES, py)} ELSE {_LINE_AT(SCRIPT_LINES, js)} END" for py, js in (("event_id // 2",) * 2, tuple(f"event_id // 2 // {len(x)}" for x in (PYTHON_LINES, SCRIPT_LINES))))

# The same texts from the events, in SQL; what is in them is found by the same patterns as in the documents.
_PLANTED_TEXT = "CASE event_id % " + str(len(planted_parts())) + " " + " ".join(f"WHEN {n} THEN " + " || ".join(_quoted(p) if isinstance(p, str) else f"left({'upper(h)' if p[0] else 'h'}, {p[1]})" for p in parts) for n, parts in enumerate(planted_parts())) + " END"
_PLANTED = re.sub(r"txt AS \(SELECT .*? FROM documents\)", lambda _: f"txt AS (SELECT 'ev/' || event_id AS path, {_PLANTED_TEXT} AS body FROM (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h FROM events))", _FOUND)

_EFFECT = lambda k: f"CASE event_id // {len(STEPS) ** k} % {len(STEPS)} " + " ".join(f"WHEN {n} THEN {kept}" for n, (kept, _) in enumerate(STEPS) if kept is not None) + " END"
_CHOICE = lambda names, k: f"list_extract({list(names)}, CAST(doc_id // {k} % {len(names)} + 1 AS INTEGER))"
_PLAIN = lambda c: f"regexp_replace(coalesce({c}, 'none'), '[^A-Za-z0-9]', '_', 'g')"
_TEXT = r"regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')"

ORACLE = {
    # what the last statement with a sure effect leaves, or the source
    "branch_flows": f"SELECT event_id || '.py' AS path, 'py.taint.sql-injection' AS rule_id FROM events WHERE coalesce({_EFFECT(2)}, {_EFFECT(1)}, {_EFFECT(0)}, TRUE)",
    "nested_calls": """SELECT event_id || '.py' AS path, r.rule_id, r.line FROM events, (VALUES ('own.encoded-twice', 1), ('own.doubled', 2), ('own.keyed', 1)) r(rule_id, line)
        WHERE CASE r.rule_id WHEN 'own.encoded-twice' THEN event_type = 'view' AND event_id % 3 = user_id % 3 WHEN 'own.doubled' THEN event_id % 5 = user_id % 5 ELSE event_id % 4 = 0 END""",
    "source_tree": f"""WITH t AS (SELECT {_PLAIN('lang')} AS top, {_CHOICE(TREE_FOLDERS, 1)} AS folder, {_CHOICE(TREE_SUFFIXES, 4)} AS suffix, {_PLAIN('source')} AS source, doc_id, {_TEXT} AS body FROM documents)
        SELECT top || '/' || source || '/' || folder || '/d' || doc_id || suffix AS path, strlen(body) AS size, CASE suffix WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' END AS language, sha256(body) AS digest
        FROM t WHERE folder <> 'node_modules' AND (suffix <> '.log' OR folder = 'src') AND (suffix <> '.txt' OR top <> 'en')""",
    "archive_members": f"SELECT doc_id // 100 || CASE WHEN doc_id // 100 % 3 = 0 THEN '.zip' ELSE '.tar' END AS archive, 'd/' || doc_id || '.txt' AS path, strlen({_TEXT}) AS size, sha256({_TEXT}) AS digest FROM documents",
    "planted_secrets": _PLANTED + "SELECT path, rule_id, CAST(line AS INTEGER) AS start_line, shown, length(value) AS size, round(bits, 6) AS bits FROM found",
    "planted_confidence": _PLANTED + "SELECT rule_id, severity, count(*) AS n FROM found WHERE rule_id NOT IN ('secrets.jwt', 'secrets.generic.high-entropy-assignment', 'secrets.slack.token') GROUP BY rule_id, severity",
    "severity_counts": _FOUND + "SELECT s.severity, count(path) AS n FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) s(severity) LEFT JOIN found USING (severity) GROUP BY s.severity",
    "secret_values": _FOUND + "SELECT path, rule_id, CAST(line AS INTEGER) AS start_line, shown, length(value) AS size, round(bits, 6) AS bits FROM found",
    "indexed_secrets": _FOUND + "SELECT path, rule_id, CAST(line AS INTEGER) AS start_line, shown FROM found",
    "literal_pruning": "WITH t AS (SELECT DISTINCT " + _TEXT + " AS body FROM documents), f AS (SELECT lower(translate(body, 'ſKıİ', 'skii')) AS body FROM t) SELECT rule_id, n, (SELECT count(*) FROM t) AS contents FROM ("
    + " UNION ALL ".join(f"SELECT {_quoted(d.rule_id)} AS rule_id, count(*) FILTER (WHERE " + " OR ".join("(" + " AND ".join(f"contains(body, {_quoted(x[k : k + 3])})" for k in range(len(x) - 2)) + ")" for x in literals(d.pattern)) + ") AS n FROM f" for d in DETECTORS) + ")",
    "secrets_all_counts": _FOUND + "SELECT det.rule_id, count(path) AS n FROM det LEFT JOIN found USING (rule_id) GROUP BY det.rule_id",
    "fail_threshold": _FOUND + "SELECT " + ", ".join(f"coalesce(max(CAST(severity IN ({', '.join(map(repr, SEVERITIES[: n + 1]))}) AS INTEGER)), 0) AS fails_on_{s.lower()}" for n, s in enumerate(SEVERITIES)) + " FROM found",
    "min_confidence": _FOUND + "SELECT rule_id, count(*) AS n FROM found WHERE rule_id NOT IN ('secrets.jwt', 'secrets.generic.high-entropy-assignment') GROUP BY rule_id",
    "line_snippets": _FOUND + _LINES + """, hid AS (SELECT l.path, l.n, coalesce(replace(l.text, any_value(f.value), any_value(f.shown)), l.text) AS text FROM lin l LEFT JOIN found f ON f.path = l.path AND f.line = l.n GROUP BY l.path, l.n, l.text)
        SELECT f.path, f.rule_id, CAST(f.line AS INTEGER) AS line, string_agg(h.text, chr(10) ORDER BY h.n) AS snippet FROM found f JOIN hid h ON h.path = f.path AND h.n BETWEEN f.line - 2 AND f.line + 2 GROUP BY f.path, f.rule_id, f.line, f.nth""",
    "fingerprints": _FOUND + _LINES + """SELECT f.path, f.rule_id, CAST(f.line AS INTEGER) AS line, sha256(f.rule_id || chr(0) || string_agg(trim(regexp_replace(h.text, '[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}]+', ' ', 'g')), chr(10) ORDER BY h.n) || chr(0) || f.idx) AS fingerprint
        FROM found f JOIN lin h ON h.path = f.path AND h.n BETWEEN f.line - 3 AND f.line + 3 GROUP BY f.path, f.rule_id, f.line, f.nth, f.idx""",
    "dedup_findings": _FOUND + "SELECT path, count(*) AS n, count(*) AS n_fingerprints FROM found GROUP BY path",
    "markdown_rows": _FOUND + "SELECT '| ' || severity || ' | `' || rule_id || '` | `' || path || ':' || line || '` | ' || m.message || ' |' AS row FROM found JOIN (VALUES " + ", ".join(f"({_quoted(d.rule_id)}, {_quoted(d.message)})" for d in DETECTORS) + ") m(rule_id, message) USING (rule_id)",
    "written_report": _FOUND + "SELECT CAST(row_number() OVER (ORDER BY path, line, first, rule_id) - 1 AS INTEGER) AS n, '| ' || severity || ' | `' || rule_id || '` | `' || path || ':' || line || '` | ' || m.message || ' |' AS row FROM found JOIN (VALUES " + ", ".join(f"({_quoted(d.rule_id)}, {_quoted(d.message)})" for d in DETECTORS) + ") m(rule_id, message) USING (rule_id)",
    "ui_search": _FOUND + "SELECT path, rule_id FROM found WHERE severity = 'MEDIUM' AND path LIKE 'doc/1%'",
    "sarif_levels": _FOUND + "SELECT rule_id, CAST(row_number() OVER (ORDER BY min((path, line))) - 1 AS INTEGER) AS rule_index, CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level, CASE severity WHEN 'CRITICAL' THEN '9.5' WHEN 'HIGH' THEN '8.0' WHEN 'MEDIUM' THEN '5.0' ELSE '3.0' END AS score, count(*) AS n FROM found GROUP BY rule_id, severity",
    "content_dedup": r"SELECT sha256(t) AS digest, count(*) AS copies, CAST(min(strlen(t)) AS BIGINT) AS size FROM (SELECT regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents) GROUP BY 1",
    "cache_hits": "SELECT 'doc/' || doc_id || '.txt' AS path, sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'en') AS hit FROM documents",
    "html_escape": "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped_md5 FROM pages",
    "language_detect": """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript' WHEN 3 THEN 'javascript' WHEN 4 THEN 'python' ELSE CASE event_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'none' END END AS language,
        event_type || CASE event_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.JS' WHEN 2 THEN '.tsx' WHEN 3 THEN '.min.js' WHEN 4 THEN '.pyi' WHEN 5 THEN '.txt' ELSE '' END AS name FROM events""",
    "ignore_filter": """SELECT event_id, 'src/' || name AS path FROM (SELECT event_id, event_type || CASE event_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.JS' WHEN 2 THEN '.tsx' WHEN 3 THEN '.min.js' WHEN 4 THEN '.pyi' WHEN 5 THEN '.txt' ELSE '' END AS name FROM events WHERE event_id % 5 = 0)
        WHERE name NOT LIKE '%.min.js' AND (name NOT LIKE 'view%' OR name = 'view.py')""",
    "repository_urls": "SELECT event_id, event_type AS owner, 'repo' || user_id AS name FROM events WHERE event_id % 5 IN (0, 1, 3)",
    "client_ips": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '192.0.2.1' WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN '10.1.1.' ELSE '10.0.0.' END || user_id ELSE '10.0.0.' || user_id END AS ip FROM events",
    "progress_percent": "SELECT event_id, CAST(CASE WHEN event_id % 200 > 0 THEN least(100, floor((event_id % 300) / (event_id % 200)::DOUBLE * 100 + 0.5)) ELSE 0 END AS INTEGER) AS percent FROM events",
    "rate_limit": """WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
        r AS (SELECT user_id, rn, event_id, TRUE AS accepted, [t] AS log FROM o WHERE rn = 1
          UNION ALL SELECT o.user_id, o.rn, o.event_id, len(list_filter(r.log, lambda x: o.t - x <= 3600000000)) < 3,
            CASE WHEN len(list_filter(r.log, lambda x: o.t - x <= 3600000000)) < 3 THEN list_append(list_filter(r.log, lambda x: o.t - x <= 3600000000), o.t) ELSE list_filter(r.log, lambda x: o.t - x <= 3600000000) END
          FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
        SELECT event_id, accepted FROM r""",
    "open_requests": "SELECT a.event_id, count(*) AS n_open FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts + INTERVAL 6 HOURS > a.ts GROUP BY a.event_id",
    "report_ttl": "SELECT event_id FROM events WHERE ts + INTERVAL 168 HOURS >= TIMESTAMP '2024-01-20 00:00:00'",
    "feedback_counts": "SELECT 'rule.' || event_type AS rule_id, count(*) AS n FROM events WHERE event_id % 10 <> 0 AND regexp_full_match('rule.' || event_type, '[a-z0-9]+([.-][a-z0-9]+)*') GROUP BY 1",
    "script_calls": "SELECT page_id, 'js.track' AS rule_id, CAST(1 AS INTEGER) AS start_line FROM pages WHERE regexp_matches(html, '<script>[^<]*(</p>)?[^<]*track\\([^,)]+\\)')",
    "code_scan": f"SELECT event_id || '.' || suffix AS path, rule_id, CAST(line AS INTEGER) AS line FROM events JOIN {_EXPECTED} ON event_id % {len(TEMPLATES)} = n",
    "cached_scan": f"SELECT event_id || '.' || suffix AS path, rule_id, CAST(line AS INTEGER) AS line FROM events JOIN {_EXPECTED} ON event_id % {len(TEMPLATES)} = n",
    "cache_growth": f"""WITH t AS (SELECT {_TEXT} AS body, bool_or(coalesce(lang = 'en', FALSE)) AS english FROM documents GROUP BY 1)
        SELECT CAST(scan AS BIGINT) AS scan, CASE scan WHEN 1 THEN (SELECT count(*) FROM t WHERE english) WHEN 2 THEN (SELECT count(*) FROM t WHERE NOT english) ELSE 0 END AS contents FROM range(1, 4) s(scan)""",
    "rule_lines": f"""WITH l AS (SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'py' ELSE 'js' END AS suffix, unnest([1, 2]) AS line, replace(unnest([{_LINE_TEXTS}]), '{{0}}', CAST(event_id AS VARCHAR)) AS text FROM events)
        SELECT event_id || '.' || suffix AS path, rule_id, CAST(line AS INTEGER) AS line FROM l JOIN (VALUES {", ".join(f"('{s}', '{r}', {_quoted(p)})" for s, r, p in _LINE_RULES)}) r(suffix, rule_id, pattern) USING (suffix) WHERE regexp_matches(text, pattern)""",
    "rule_counts": f"""WITH l AS (SELECT CASE event_id % 2 WHEN 0 THEN 'py' ELSE 'js' END AS suffix, replace(unnest([{_LINE_TEXTS}]), '{{0}}', CAST(event_id AS VARCHAR)) AS text FROM events)
        SELECT r.rule_id, r.severity, count(l.text) AS n FROM (VALUES {", ".join(f"('{s}', '{r}', {_quoted(p)}, '{_SEVERITY[r]}')" for s, r, p in _LINE_RULES)}) r(suffix, rule_id, pattern, severity) LEFT JOIN l ON l.suffix = r.suffix AND regexp_matches(text, pattern) GROUP BY ALL""",
    "taint_flows": f"SELECT event_id || '.' || suffix AS path, rule_id, CAST(first_line AS INTEGER) AS first_line, CAST(line AS INTEGER) AS last_line FROM events JOIN {_EXPECTED} ON event_id % {len(TEMPLATES)} = n WHERE first_line > 0",
    "baseline_diff": _FOUND + _LINES + """, fp AS (SELECT f.path, sha256(f.rule_id || chr(0) || string_agg(trim(regexp_replace(h.text, '[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}]+', ' ', 'g')), chr(10) ORDER BY h.n) || chr(0) || f.idx) AS fingerprint
        FROM found f JOIN lin h ON h.path = f.path AND h.n BETWEEN f.line - 3 AND f.line + 3 GROUP BY f.path, f.rule_id, f.line, f.nth, f.idx)
        SELECT path, fingerprint FROM fp WHERE fingerprint NOT IN (SELECT fingerprint FROM fp JOIN documents ON path = 'doc/' || doc_id || '.txt' WHERE lang = 'en')""",
    "line_shapes": r"""WITH l AS (SELECT 'doc/' || doc_id || '.txt' AS path, unnest(regexp_split_to_array(regexp_replace(text, '(\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}])$', ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]')) AS line FROM documents WHERE text <> '')
        SELECT path, count(*) AS n_lines, CAST(sum(length(trim(regexp_replace(line, '[\s\x0B\x1C-\x1F\x{85}\x{A0}]+', ' ', 'g')))) AS BIGINT) AS n_chars FROM l GROUP BY path""",
}
