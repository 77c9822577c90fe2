"""Fixity audit of web archives by Merkle trees.

A replica is a table of WARC records. Its manifest has a hash and a length for each record, and lays the records out in ranges:
a record's range is the hash of its name, and within a range records lie in order of name. Each replica has a tree of its own over
its ranges. A node's hash covers, for each child in order, its number, its range of offsets (counted from the node's
start) and its hash, so a record that a replica lacks changes the nodes above it and no others. The roots are compared first, and then
only the children of nodes that differ; records are compared in the ranges that are left at the end.

Payloads are read once, to be hashed; what moves after that are the manifest's narrow rows (once by name, once by range). The trees are
rows for ranges, and what the two replicas exchange is roots and mismatching branches. The number of ranges follows the input, so a range holds
about `records_per_range` records at any size. DataFrame functions only.

A record's name is its id. An id that is null, or that names several records of a replica, names nothing: such records are known by
their hash, so they spread over the ranges, and a changed one is missing from one replica and extra in the other.

Defined results: null payloads count as empty; an empty replica lacks all records; equal records that share an id are one entry with a
number of copies, and differing numbers are a change; equal replicas, and empty ones, give an empty result; very long records
are hashed whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small, stored

END = "\r\n\r\n"
MARK = b"WARC/1.0\r\n"


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """id, url, record (text of a WARC response record, without the blank lines that end it)."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    url = F.coalesce(F.regexp_replace(F.col(f"`{url_col}`").cast("string"), r"[\x00-\x20]", ""), F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url)
    record = F.concat(head, F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(END), payload)
    return pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), record.alias("record"))


def write_warc(records: DataFrame, path: str, files: int) -> None:
    """Writes the records to about so many WARC files below path."""
    records.repartition(files, "id").sortWithinPartitions("id").select(F.concat("record", F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").text(path)


def cut_warc(data: bytes) -> Iterator[tuple[int, int, str, bytes, bool]]:
    """offset, length, uri, payload, whole of each record of a file's bytes.

    A record goes as far as its Content-Length says. Where that is missing, no number, or leads beyond the file or to something
    other than a record's end, the record goes up to the next record's mark or the end of the file, and is not whole.
    """
    at = data.find(MARK)
    while at >= 0:
        body = data.find(END.encode(), at)
        body = len(data) if body < 0 else body + len(END)
        head = dict(line.split(": ", 1) for line in data[at:body].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        said = head.get("Content-Length", "").strip()
        stop = body + int(said) if said.isascii() and said.isdigit() and len(said) < 19 else -1
        after = data[stop : stop + len(END)] if stop >= 0 else b""
        whole = 0 <= stop <= len(data) and (after == END.encode() or (stop + len(after) == len(data) and not after.strip(b"\r\n")))
        if not whole:
            stop = data.find(MARK, max(body, at + len(MARK)))
            stop = len(data) if stop < 0 else stop
        yield at, stop - at, head.get("WARC-Target-URI", ""), data[body:stop], whole
        at = data.find(MARK, stop)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, length, uri, payload, whole of every record of the WARC files (uncompressed, up to 2 GB each) below path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for at, length, uri, payload, whole in cut_warc(data.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([length], pa.int64()), pa.array([uri]), pa.array([payload], pa.binary()), pa.array([whole])], ["file", "offset", "length", "uri", "payload", "whole"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, offset long, length long, uri string, payload binary, whole boolean")


def hashed(records: DataFrame) -> DataFrame:
    """id, digest, length, copies of the records, stored: the only reading of payloads."""
    rows = records.select("id", F.sha2(F.col("record"), 256).alias("digest"), (F.octet_length("record") + len(END)).cast("long").alias("length"))
    return stored(rows.groupBy("id", "digest", "length").agg(F.count(F.lit(1)).alias("copies")))


@dataclass
class Replica:
    """leaves: range, name, id, digest, length (of all copies), copies. levels: for ranges and each level above, node, hash, length; the root last."""

    leaves: DataFrame
    levels: list[DataFrame]


def _hash_of(order: list[Column], child: Column) -> Column:
    """A hash of the children in order, each with its range of offsets within the node."""
    parts = F.array_sort(F.collect_list(F.struct(*(c.alias(f"k{n}") for n, c in enumerate(order)), F.col("length").alias("length"), child.alias("hash"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("seen"))
    step = lambda s, c: F.struct((s["at"] + c["length"]).alias("at"), F.concat(s["seen"], F.array(F.concat_ws(":", c["k0"].cast("string"), s["at"].cast("string"), (s["at"] + c["length"]).cast("string"), c["hash"]))).alias("seen"))
    return F.aggregate(parts, start, step, lambda s: F.sha2(F.array_join(s["seen"], ","), 256))


def plant(rows: DataFrame, unnamed: DataFrame, ranges: int, fanout: int) -> Replica:
    """The tree of a replica. rows: hashed(); unnamed: a table of the ids that name nothing; ranges: a power of fanout."""
    names = rows.join(unnamed.withColumnRenamed("id", "other"), F.col("id") == F.col("other"), "left")
    by_digest = F.col("id").isNull() | F.col("other").isNotNull()
    name = F.when(by_digest, F.concat(F.lit("#"), "digest")).otherwise(F.concat(F.lit("="), F.col("id").cast("string")))
    named = names.select(name.alias("name"), "id", "digest", (F.col("length") * F.col("copies")).alias("length"), "copies")
    leaves = stored(named.withColumn("range", F.pmod(F.xxhash64("name"), F.lit(ranges))))
    entry = F.concat_ws("/", "name", "digest", F.col("copies").cast("string"))
    level = stored(leaves.groupBy(F.col("range").alias("node")).agg(_hash_of([F.col("name"), F.col("digest")], entry).alias("hash"), F.sum("length").alias("length")))
    levels = [level]
    while ranges > 1:
        ranges //= fanout
        level = level.groupBy(F.expr(f"node div {fanout}").alias("above")).agg(_hash_of([F.col("node")], F.col("hash")).alias("hash"), F.sum("length").alias("length"))
        level = stored(level.withColumnRenamed("above", "node"))
        levels.append(level)
    return Replica(leaves, levels)


def descend(ours: Replica, theirs: Replica, fanout: int) -> list[DataFrame]:
    """For each level from the root down, the nodes that differ; the last are ranges. Below an equal node nothing is read."""
    found: list[DataFrame] = []
    for a, b in zip(reversed(ours.levels), reversed(theirs.levels)):
        if found:
            marked = small(found[-1].withColumnRenamed("node", "parent"))
            a, b = (side.join(marked, F.expr(f"node div {fanout}") == F.col("parent"), "left_semi") for side in (a, b))
        both = a.select("node", F.col("hash").alias("hash_a")).join(b.select("node", F.col("hash").alias("hash_b")), "node", "full")
        found.append(stored(both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("node")))
        if found[-1].isEmpty():
            break
    return found


def audit(ours: DataFrame, theirs: DataFrame, *, records_per_range: int = 8, fanout: int = 16) -> DataFrame:
    """Records that differ: id, range, status (changed, missing, extra), and digest, length and copies in both replicas.

    ours, theirs: tables of id and record.
    """
    sides = [hashed(ours), hashed(theirs)]
    most = max(side.count() for side in sides)
    ranges = fanout ** max(0, math.ceil(math.log(max(1, most / records_per_range), fanout)))
    twice = [side.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id") for side in sides]
    unnamed = small(stored(twice[0].union(twice[1]).distinct()))
    replicas = [plant(side, unnamed, ranges, fanout) for side in sides]
    suspects = small(descend(*replicas, fanout)[-1].withColumnRenamed("node", "suspect"))
    # the records of mismatching ranges only
    a, b = (side.leaves.join(suspects, F.col("range") == F.col("suspect"), "left_semi").select("range", "name", F.struct("id", "digest", "length", "copies").alias(f"record_{at}")) for side, at in zip(replicas, "ab"))
    both = a.join(b, ["range", "name"], "full")
    status = F.when(F.col("record_b").isNull(), "missing").when(F.col("record_a").isNull(), "extra").otherwise("changed")
    different = both.where(~F.struct("record_a.digest", "record_a.copies").eqNullSafe(F.struct("record_b.digest", "record_b.copies")))
    each = [F.col(f"record_{at}.{c}").alias(f"{c}_{at}") for at in "ab" for c in ("digest", "length", "copies")]
    return different.select(F.coalesce("record_a.id", "record_b.id").alias("id"), "range", status.alias("status"), *each)
