"""python -m basalt scan | baseline | rules | init. Exit codes: 0 clean, 1 findings at the threshold, 2 an error."""

from __future__ import annotations

import argparse
import os
import sys
from functools import reduce
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

CONFIG, CACHE = ".basalt.yml", ".basalt-cache"
COMPACT = 20  # versions of the cache
KEYS = {"exclude": [], "fail_on": "LOW", "format": "console", "min_confidence": "LOW", "disabled_rules": []}
TEMPLATE = "# Settings of scans below this folder.\nexclude: []\nfail_on: LOW\nformat: console\nmin_confidence: LOW\ndisabled_rules: []\n"


def load_config(path: str = CONFIG) -> dict:
    """Settings of a file over the defaults; the defaults if there is none. Raises ValueError for an unknown key."""
    given = (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}) if os.path.isfile(path) else {}
    if unknown := set(given) - set(KEYS):
        raise ValueError(f"{path}: unknown keys {sorted(unknown)}")
    return KEYS | given


def targets(spark: SparkSession, paths: list[str], exclude: tuple[str, ...]) -> DataFrame:
    """The files of folders and single files. Raises FileNotFoundError for one that is missing."""
    from pyspark.sql import functions as F

    from basalt.sources.files import decoded, files_from_dir, with_language

    found = []
    for path in paths:
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        if os.path.isdir(path):
            found.append(files_from_dir(spark, os.path.abspath(path), ignore=exclude).select("path", "content"))
        else:
            one = spark.read.format("binaryFile").load(os.path.abspath(path)).select(F.lit(path).alias("path"), decoded(F.col("content")).alias("content"))
            found.append(one)
    return with_language(reduce(DataFrame.unionByName, found))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="basalt", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan")
    scan.add_argument("paths", nargs="*", default=["."])
    scan.add_argument("-f", "--format")
    scan.add_argument("-o", "--output")
    scan.add_argument("--fail-on")
    scan.add_argument("--baseline")
    scan.add_argument("--no-config", action="store_true")
    scan.add_argument("--cache", default=CACHE, help="a folder of what earlier scans found; contents that it knows aren't searched again")
    scan.add_argument("--no-cache", action="store_true")
    make = commands.add_parser("baseline")
    make.add_argument("paths", nargs="*", default=["."])
    make.add_argument("-o", "--output", default=".basalt-baseline")
    commands.add_parser("rules")
    init = commands.add_parser("init")
    init.add_argument("--force", action="store_true")
    given = parser.parse_args(args)
    try:
        return _run(given)
    except (ValueError, OSError) as e:
        print(f"basalt: {e}", file=sys.stderr)
        return 2


def _run(given: argparse.Namespace) -> int:
    from basalt.operators import findings as fin
    from basalt.operators.reports import REPORTERS, report, write_report
    from basalt.plans.cache import ScanCache
    from basalt.plans.scan import Options
    from basalt.plans.scan import scan as scan_files
    from basalt.plans.store import stored
    from basalt.rules import built_in

    if given.command == "init":
        if os.path.exists(CONFIG) and not given.force:
            raise ValueError(f"{CONFIG} is there; --force replaces it")
        Path(CONFIG).write_text(TEMPLATE, encoding="utf-8")
        return 0
    if given.command == "rules":
        print(f"{len(built_in())} rules")
        return 0
    settings = KEYS if getattr(given, "no_config", True) else load_config()
    form = getattr(given, "format", None) or settings["format"]
    fail_on = getattr(given, "fail_on", None) or settings["fail_on"]
    if form not in REPORTERS:
        raise ValueError(f"unknown format: {form}")
    options = Options(disabled=tuple(settings["disabled_rules"]), min_confidence=settings["min_confidence"], fail_on=fail_on)
    spark = SparkSession.builder.appName("basalt").getOrCreate()
    folder = getattr(given, "cache", CACHE)
    files = targets(spark, given.paths, (*settings["exclude"], f"{os.path.basename(folder)}/"))
    if given.command == "baseline":
        fin.save_baseline(scan_files(files), os.path.abspath(given.output))
        return 0
    known = fin.load_baseline(spark, os.path.abspath(given.baseline)) if given.baseline else None
    cache = None if given.no_cache else ScanCache(spark, os.path.abspath(folder))
    found = stored(scan_files(files, options, known, cache))
    if cache and len(cache.contents.numbers()) > COMPACT:
        cache.compact()
    if given.output:
        write_report(found, form, files.count(), os.path.abspath(given.output))
    else:
        for line in report(found, form, files.count()):
            print(line)
    return fin.fails(found, fail_on).first()["exit_code"]


if __name__ == "__main__":
    sys.exit(main())
