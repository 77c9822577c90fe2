"""File corpora: directories, archives and tables as rows of path and content."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions.text import unix_newlines
from basalt.sources import tree

MAX_BYTES, SNIFFED = 5_000_000, 8192
# What is never scanned, and how languages are told.
IGNORED = (".git/", ".hg/", ".svn/", "node_modules/", ".venv/", "venv/", "env/", "__pycache__/", ".mypy_cache/", ".ruff_cache/", ".pytest_cache/", "dist/", "build/", "*.min.js", "*.map")
TEXT_SUFFIXES = (".py", ".pyi", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts", ".json", ".yml", ".yaml", ".txt", ".md", ".cfg", ".ini", ".toml")
LANGUAGES = {"javascript": (".js", ".jsx", ".mjs", ".cjs"), "typescript": (".ts", ".tsx", ".mts", ".cts"), "python": (".py", ".pyi")}


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """A line of an ignore file as a regular expression over relative paths, and whether it excludes; None for comments."""
    line = pattern.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    excludes, line = not line.startswith("!"), line.removeprefix("!")
    folder, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.lstrip("/")
    out, at = "", 0
    while at < len(line):
        if line.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif line.startswith("**", at):
            out, at = out + (".+" if line[:at].endswith("/") else ".*"), at + 2
        elif line[at] == "*":
            alone = line[at - 1 : at] in ("", "/") and line[at + 1 : at + 2] in ("", "/")
            out, at = out + ("[^/]+" if alone else "[^/]*"), at + 1
        elif line[at] == "?":
            out, at = out + "[^/]", at + 1
        elif line[at] == "[" and (end := line.find("]", at + 2)) > 0:
            out, at = out + "[" + line[at + 1 : end].replace("\\", "\\\\").replace("!", "^", 1 if line[at + 1] == "!" else 0) + "]", end + 1
        else:
            at += line[at] == "\\" and at + 1 < len(line)
            out, at = out + (line[at] if line[at].isalnum() or line[at] in "_/" else "\\" + line[at]), at + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$"), excludes


def ignored(path: Column, patterns: tuple[str, ...] | list[str] = IGNORED) -> Column:
    """Whether the last pattern that matches excludes the path; a pattern that starts with ! includes it again."""
    found = [r for r in map(ignore_regex, patterns) if r]
    return reduce(lambda so_far, r: F.when(path.rlike(r[0]), F.lit(r[1])).otherwise(so_far), found, F.lit(False))


def language(path: Column, content: Column) -> Column:
    """By suffix, else by the interpreter that the first line names."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    found = F.when(F.lit(False), "")
    for name, suffixes in LANGUAGES.items():
        found = found.when(suffix.isin(*suffixes), name)
    first = F.lower(F.regexp_extract(F.left(content, F.lit(1000)), r"^(#![^\n]*)", 1))
    return found.when(first.contains("python"), "python").when(first.contains("node"), "javascript")


def is_binary(path: Column, data: Column) -> Column:
    """Whether a zero byte is among the first bytes; suffixes of text files are trusted."""
    text = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*TEXT_SUFFIXES)
    return ~text & F.hex(F.substring(data, 1, SNIFFED)).rlike("^(?:..)*?00")


def with_language(files: DataFrame) -> DataFrame:
    """files (path, content) with newlines made uniform, size, language and digest."""
    text = unix_newlines(F.coalesce(F.col("content"), F.lit("")))
    rows = files.withColumn("content", text).withColumn("size", F.octet_length("content").cast("long"))
    return rows.withColumn("language", language(F.col("path"), F.col("content"))).withColumn("digest", F.sha2("content", 256))


def decoded(data: Column) -> Column:
    @F.pandas_udf("string")
    def decode(values):
        return values.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))

    return F.coalesce(F.try_validate_utf8(data.cast("string")), decode(data))


def files_from_dir(spark: SparkSession, root: str, *, max_bytes: int = MAX_BYTES, ignore: tuple[str, ...] = (), ignore_files: tuple[str, ...] = (".gitignore",), nested: bool = False, tasks: int | None = None) -> DataFrame:
    """path (relative), content, size, language, digest of the text files below root that no ignore pattern excludes.

    A local root (one that all executors share) is listed by tasks that leave out ignored folders before they look into them (see
    sources.tree), and then read by `tasks` tasks; its own ignore files count, and with `nested` those of folders below it. Other
    stores are read by Spark's reader, which passes over names that start with _ or a dot; give their ignore lines as `ignore`.
    """
    root = root.rstrip("/")
    if "://" not in tree.local_path(root):
        listed = tree.listing(spark, root, ignore=ignore, ignore_files=ignore_files, nested=nested, max_bytes=max_bytes)
        rows = tree.read_files(listed, root, tasks)
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        tail = "'" + (root.split("://", 1)[-1].lstrip("/") + "/").replace("\\", "\\\\").replace("'", "\\'") + "'"
        rows = found.where(F.col("length") <= max_bytes).select(F.expr(f"substring(path, instr(path, {tail}) + length({tail}))").alias("path"), F.col("content").alias("data"))
        rows = rows.where(~ignored(F.col("path"), [*IGNORED, *ignore]))
    rows = rows.where(~is_binary(F.col("path"), F.col("data")))
    return with_language(rows.select("path", decoded(F.col("data")).alias("content")))


def files_from_table(df: DataFrame, path: Column, content: Column) -> DataFrame:
    """Any table of texts as a file corpus."""
    return with_language(df.select(path.cast("string").alias("path"), content.cast("string").alias("content")))


def files_from_archives(spark: SparkSession, path: str, *, max_files: int = 20_000, max_bytes: int = 200 << 20, tasks: int | None = None) -> DataFrame:
    """archive, path, content, size, language, digest, error of the members of an archive, or of all archives in a folder.

    The path must be one that all executors share. Tasks share an archive by ranges of its members (see sources.tree). An archive that breaks
    a limit, or that can't be read, gives one row with an error; of one that is damaged further in, what comes before stays.
    """
    top = tree.local_path(path)
    if os.path.isdir(top):
        listed = tree.listing(spark, top, recursive=False, default_ignores=False)
    else:
        top, name = os.path.split(top)
        listed = spark.createDataFrame([(name,)], "path string")
    found = tree.read_archives(listed, top, max_files, max_bytes, _is_text, tasks)
    rows = found.select(F.concat(F.lit(f"{top}/"), "archive").alias("archive"), "path", decoded(F.col("data")).alias("content"), "error")
    return with_language(rows.where(F.col("error").isNotNull() | ~ignored(F.col("path"))))


def _is_text(data: bytes) -> bool:
    return b"\0" not in data[:SNIFFED]


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]+$", 0)


def repository(url: Column) -> Column:
    """owner and name of a repository address on github.com, or null if it isn't a plain one."""
    pattern = r"^https?://(?:www\.)?github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$"
    plain = F.trim(url)
    return F.when(plain.rlike(pattern), F.struct(F.regexp_extract(plain, pattern, 1).alias("owner"), F.regexp_extract(plain, pattern, 2).alias("name")))
