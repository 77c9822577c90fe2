"""Small helpers that several corpus operators use."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a row of a filter, bits for each hash, and the most bits of a filter (2**30, 128 MB).
_ROW, _BITS_EACH, _MOST_BITS = 32768, 16, 30


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where a local session has no such setting, a temporary folder becomes the checkpoint folder; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="basalt-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/basalt-{uuid.uuid4().hex}"


def stored(df: DataFrame, sort_by: str | None = None, partition_by: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark)
    writer = (df.sortWithinPartitions(sort_by) if sort_by else df).write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(name: str) -> Column:
    """The column as text, null as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with underscores before it until no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def join_groups(rows: DataFrame, groups: DataFrame, key: str, members: str, total: int, how: str = "inner", parts: int = 1000) -> DataFrame:
    """rows with their groups: a stored table with one row for each value of the key, and a number of members in all `total` rows.

    Groups of more than a `parts`-th of all rows, of which there are fewer than `parts`, go to every task, so their rows stay where they
    are; only rows of smaller groups meet theirs by a shuffle.
    """
    large = F.col(members) > total // parts
    if groups.where(large).isEmpty():
        return rows.join(groups, key, how)
    heavy, light = F.broadcast(groups.where(large)), groups.where(~large)
    return rows.join(heavy, key).unionByName(rows.join(heavy, key, "left_anti").join(light, key, how))


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows (it must be a stored, narrow table), else df."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class HashFilter:
    """A bitmap of hashes as a table of rows of 512 longs. It never loses a hash, and lets few others through."""

    def __init__(self, hashes: DataFrame):
        """hashes: a stored table with a column h."""
        self.bits = min(_MOST_BITS, max(15, math.ceil(math.log2(max(1, hashes.count()) * _BITS_EACH))))
        at = self._at("h")
        words = hashes.groupBy(F.expr(f"{at} div {_ROW}").alias("filter_row"), F.expr(f"cast({at} % {_ROW} div 64 as int)").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({at} % 64 as int)))").alias("b"))
        found = words.groupBy("filter_row").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"))
        full = F.transform(F.sequence(F.lit(0), F.lit(_ROW // 64 - 1)), lambda w: F.coalesce(F.col("m")[w], F.lit(0).cast("long")))
        self.rows = stored(found.select("filter_row", full.alias("filter_bits")))

    def _at(self, h: str) -> str:
        return f"(`{h}` & {(1 << self.bits) - 1}L)"

    def marked(self, rows: DataFrame, h: str, name: str) -> DataFrame:
        """rows with a boolean column of that name: whether the hash (a long column, or null) may be there."""
        at, (row, bits) = self._at(h), free_names(rows, "filter_row", "filter_bits")
        own = self.rows.select(F.col("filter_row").alias(row), F.col("filter_bits").alias(bits))
        hit = F.expr(f"coalesce((shiftrightunsigned(`{bits}`[cast({at} % {_ROW} div 64 as int)], cast({at} % 64 as int)) & 1L) = 1L, false)")
        return rows.withColumn(row, F.expr(f"{at} div {_ROW}")).join(F.broadcast(own), row, "left").withColumn(name, hit).drop(row, bits)

    def parted(self, rows: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        """The rows whose hash surely isn't there, and those whose hash may be. Nothing is shuffled."""
        h, flag = free_names(rows, "row_hash", "may_be")
        marked = self.marked(rows.withColumn(h, key), h, flag)
        return marked.where(~F.col(flag)).drop(h, flag), marked.where(flag).drop(h, flag)
