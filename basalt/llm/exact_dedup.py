"""Exact duplicates through a log-structured merge index of digests.

Rows are flushed through memtables of bounded size, four at least, each of which becomes a run: (digest, smallest id, copies), sorted by
digest, with a bitmap filter of its digests. Before a memtable is flushed its digests are looked up in the runs before it: each run's
filter is asked first, so only digests that may be known are joined with the run. Compaction is tiered: when a level has `fanout` runs they
merge into one of the next level, which keeps the smallest id of each digest. The digests that a lookup hit, and those that a memtable
itself holds twice, are shared: only their rows meet the index again, and a filter of them picks the texts whose bytes are compared, so
texts without a copy never move. All of it is DataFrame work in the JVM; runs are tables in the shared folder.

Defined results: null texts count as empty texts; null ids sort after all others; rows that repeat an id are judged by their own
text; of rows that share both the smallest id and the text exactly one is kept; very long texts are digested whole; empty input
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WHITE, HashFilter, free_names, join_groups, stored, text_of

#: Bits of one filter slice; Spark's bitmap functions use this size.
SLICE = 32768
#: Filters have at least so many bits for each digest, and at most 2**MOST_BITS (128 MB, for 67 million digests). A filter
#: over that bound passes more rows that aren't there, and loses none.
BITS_EACH, MOST_BITS = 16, 30
#: The memtables of a table at least.
MEMTABLES = 4


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass
class Filter:
    """A bitmap of 2**bits bits, in slices; small enough to broadcast at any input size."""

    slices: DataFrame
    bits: int

    @staticmethod
    def _position(bits: int) -> str:
        return f"(xxhash64(digest) & {(1 << bits) - 1}L)"

    @classmethod
    def of(cls, digests: DataFrame, count: int) -> Filter:
        """A filter of a stored table with so many digests (column digest)."""
        bits = min(MOST_BITS, max(15, math.ceil(math.log2(max(1, count) * BITS_EACH))))
        at = cls._position(bits)
        return cls(stored(digests.groupBy(F.expr(f"{at} div {SLICE}").alias("slice")).agg(F.expr(f"bitmap_construct_agg({at} % {SLICE})").alias("bits"))), bits)

    def may_have(self, rows: DataFrame) -> DataFrame:
        """Rows (with a column digest) that may be in the filter; none that is in it is lost."""
        at, names = self._position(self.bits), rows.columns
        hit = F.expr(f"cast(conv(hex(substring(bits, cast(({at} % {SLICE}) div 8 as int) + 1, 1)), 16, 10) as int)")
        bit = F.expr(f"shiftleft(1, cast({at} % 8 as int))")
        return rows.withColumn("slice", F.expr(f"{at} div {SLICE}")).join(F.broadcast(self.slices), "slice").where(hit.bitwiseAND(bit) != 0).select(names)


@dataclass
class Run:
    """rows: digest, keep_id, keep_row, copies, sorted by digest."""

    rows: DataFrame
    count: int
    filter: Filter | None = None

    def filtered(self) -> Filter:
        if self.filter is None:
            self.filter = Filter.of(self.rows.select("digest"), self.count)
        return self.filter


class DigestIndex:
    """Sorted runs by level. flush() adds level-0 runs for a batch and compacts levels that are full, lookup() probes, view() merges all."""

    def __init__(self, spark: SparkSession, memtable_rows: int = 50_000_000, fanout: int = 4):
        self.spark, self.memtable_rows, self.fanout = spark, memtable_rows, fanout
        self.levels: list[list[Run]] = []

    def flush(self, rows: DataFrame, count: int, least: int = 1) -> DataFrame:
        """The distinct digests of rows that others share, among the rows and all that were flushed before them.

        rows: id, row (a number that tells equal ids apart), digest, a stored table of so many rows. Each memtable, of which there are `least` or more,
        takes about memtable_rows of them.
        """
        tables = max(least, -(-count // self.memtable_rows))
        first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")
        runs = rows.groupBy(F.pmod(F.xxhash64("row"), F.lit(tables)).cast("int").alias("memtable"), "digest").agg(first, F.count(F.lit(1)).alias("copies"))
        runs = runs.select("digest", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "copies", "memtable")
        written = stored(runs, sort_by="digest", partition_by="memtable")
        shared = written.where("copies > 1").select("digest")
        for m in range(tables):
            run = written.where(F.col("memtable") == m).drop("memtable")
            if self.runs():
                shared = shared.unionByName(stored(self.lookup(run).select("digest")))
            self._add(0, Run(run, run.count()))
        return stored(shared.distinct())

    def _add(self, level: int, run: Run) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._add(level + 1, self._merged(full))

    def _merged(self, runs: list[Run]) -> Run:
        """One sorted run: smallest id and sum of copies of each digest."""
        rows = runs[0].rows
        for run in runs[1:]:
            rows = rows.unionByName(run.rows)
        first = F.min(F.struct(F.col("keep_id").isNull().alias("last"), F.col("keep_id").alias("id"), F.col("keep_row").alias("row"))).alias("first")
        merged = rows.groupBy("digest").agg(first, F.sum("copies").alias("copies")).select("digest", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "copies")
        written = stored(merged, sort_by="digest")
        return Run(written, written.count())

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def view(self) -> DataFrame:
        """One row per digest over all runs: digest, keep_id, keep_row, copies. What had several runs is one run afterwards."""
        runs = self.runs()
        if len(runs) != 1:
            self.levels = [[] for _ in self.levels[:-1]] + [[self._merged(runs)]]
        return self.runs()[0].rows

    def lookup(self, rows: DataFrame) -> DataFrame:
        """digest, keep_id, copies of the rows' digests that the index holds. rows: a column digest."""
        wanted, found = rows.select("digest").distinct(), None
        for run in self.runs():
            hits = run.filtered().may_have(wanted).join(run.rows, "digest")
            found = hits if found is None else found.unionByName(hits)
        if found is None:
            raise ValueError("nothing was flushed yet")
        first = F.min(F.struct(F.col("keep_id").isNull().alias("last"), F.col("keep_id").alias("id"))).alias("first")
        return found.groupBy("digest").agg(first, F.sum("copies").alias("copies")).select("digest", F.col("first.id").alias("keep_id"), "copies")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest: Callable[[Column], Column] = sha256, memtable_rows: int = 50_000_000, fanout: int = 4) -> DataFrame:
    """One row per row of docs: id, keep_id (smallest id of the equal texts), copies, kept, digest (binary).

    Texts are equal if they are identical after white space runs become one space. digest may be any hash of the text;
    texts that share a digest but differ in bytes are told apart.
    """
    index = DigestIndex(docs.sparkSession, memtable_rows, fanout)
    text = normalised(text_of(text_col))
    ids = stored(docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), digest(text).alias("digest")))
    rows = ids.count()
    shared = index.flush(ids, rows, least=MEMTABLES)
    groups = stored(index.view().join(shared, "digest", "left_semi"))

    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("body")).withColumn("digest", digest(F.col("body")))
    suspects = Filter.of(shared, shared.count()).may_have(texts)
    # Of each digest the smallest and the largest text, gathered in each task first: equal bytes if, and only if, they are equal.
    differing = stored(suspects.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low != high").select("digest"))

    # Rows that share their digest with no other are groups of their own.
    found, alone = join_groups(ids, groups, "digest", "copies", rows, "left"), F.col("copies").isNull()
    own = lambda c, mine: F.when(alone, mine).otherwise(F.col(c)).alias(c)
    found = found.select("id", "row", own("keep_id", F.col("id")), own("keep_row", F.col("row")), own("copies", F.lit(1)), "digest")
    if not differing.isEmpty():
        split = stored(texts.join(differing, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()))
        first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")
        exact = split.groupBy("digest", "body").agg(first, F.count(F.lit(1)).alias("copies")).select("digest", "body", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "copies")
        found = found.join(differing, "digest", "left_anti").unionByName(split.join(exact, ["digest", "body"]).drop("body"))
    return found.select("id", "keep_id", "copies", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest: Callable[[Column], Column] = sha256, **options) -> DataFrame:
    """docs without all but the first (smallest id) of equal texts; every column stays. Of rows that share both id and text one stays."""
    key, mark, own = free_names(docs, "group_id", "group_digest", "text_digest")
    groups = exact_groups(docs, id_col, text_col, digest=digest, **options)
    each = stored(groups.groupBy(F.col("id").alias(key), F.col("digest").alias(mark)).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1"))
    # Only texts of rows that may have to go, or to be counted, are shuffled.
    rows = docs.withColumn(own, digest(normalised(text_of(text_col))))
    clear, rest = HashFilter(stored(each.select(F.xxhash64(key, mark).alias("h")))).parted(rows, F.xxhash64(F.col(f"`{id_col}`"), own))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & (F.col(own) == F.col(mark))
    rest = rest.join(each.where("not kept").select(key, mark), same, "left_anti")
    twice = each.where("kept").select(key, mark)
    if not twice.isEmpty():
        once = rest.join(twice, same, "left_semi").dropDuplicates([id_col, own])
        rest = rest.join(twice, same, "left_anti").unionByName(once)
    left = clear.unionByName(rest)
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
