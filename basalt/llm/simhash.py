"""Near duplicates by SimHash, found through a segment-popcount embedding.

A fingerprint (64 bits) is embedded as its bit counts in 32 segments of 2 bits. The Manhattan distance of two embeddings
is at most the number of differing bits, so fingerprints within 2 bits lie within distance 2 on the grid. Every
fingerprint visits its own cell and the cells one step away (49 rows on average); two fingerprints meet in a cell if, and only if,
their embeddings are within distance 2, so this range join is one shuffle keyed by cell. A cell keeps three numbers: how
many fingerprints visit it, the smallest and the largest. A cell of two visitors is a candidate pair, whose bits are compared.

Short segments make the bound tight: of unlike fingerprints, about one pair in 10**10 meets by chance, so what meets is mostly
what is linked, and its number follows the input.

In a crowded cell no pairs are made. Two fingerprints differ in at most 2 bits if, and only if, some 64-bit number differs
from each in at most 1 bit; such a number lies in a cell that both visit. So the visitors of a crowded cell are keyed by the
numbers within 1 bit of them that lie in that cell, and each links to the smallest visitor at the same number. The links have the
components of all pairs within 2 bits, however large a group of near copies is.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other; texts under three words are one
shingle; null ids never become a component's id unless all its ids are null; rows that repeat an id each have
their own fingerprint; empty input gives an empty result; very long texts are hashed whole, 65,536 shingles at a time; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import HashFilter, free_names, join_groups, small, stored, text_of

SHINGLE_WORDS, SEED = 3, 42
SEGMENTS, SEGMENT_BITS = 32, 2


def simhash(text: bytes) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and exactly the white space \x20 \x09-\x0D
    if not words:
        return 0
    joined, k = b" ".join(words), SHINGLE_WORDS
    if len(words) <= k:
        return xxh64_intdigest(joined, SEED)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    hashes = np.fromiter([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])], np.uint64)
    total = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        total += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, mark (a hash of the text, which tells rows with the same id apart), bits (the fingerprint as a signed 64-bit number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(t) for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["id", "mark", "bits"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(text_col)).alias("mark"), text_of(text_col).cast("binary").alias("body"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("mark", T.LongType()), T.StructField("bits", T.LongType())]))


def cell(bits: Column) -> Column:
    """The bit counts of all segments, packed into one number: counts of 0 to 2 in fields of 2 bits."""
    odd = F.lit(0x5555555555555555)
    right, left = bits.bitwiseAND(odd), F.shiftrightunsigned(bits, 1).bitwiseAND(odd)
    return F.shiftleft(left.bitwiseAND(right), 1).bitwiseOR(left.bitwiseXOR(right))


def near_cells(at: Column) -> Column:
    """The cell and those one step away: a segment's count is one more (up to 2) or one less (down to 0)."""
    found = [at]
    for low in range(0, SEGMENTS * SEGMENT_BITS, SEGMENT_BITS):
        # counts are 00, 01, 10: one step from 0 or 2 leads to 1, one from 1 to either
        field = F.shiftrightunsigned(at, low).bitwiseAND(F.lit(3).cast("long"))
        one, three = _long(1 << low), _long(3 << low)
        found += [F.when(field == 2, at.bitwiseXOR(three)).otherwise(at.bitwiseXOR(one)), F.when(field == 1, at.bitwiseXOR(three))]
    return F.filter(F.array(*found), lambda c: c.isNotNull())


def _long(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def near_points(bits: Column) -> Column:
    """bits and all numbers that differ from it in one bit."""
    return F.array(bits, *(bits.bitwiseXOR(_long(1 << i)) for i in range(64)))


def visits(prints: DataFrame) -> DataFrame:
    """cell, bits: each fingerprint (distinct, column bits) at its cell and those one step away."""
    return prints.select("bits", cell(F.col("bits")).alias("at")).select(F.explode(near_cells(F.col("at"))).alias("cell"), "bits")


def meetings(prints: DataFrame) -> DataFrame:
    """cell, low, high, visitors of the cells where at least two fingerprints meet: the grid range join."""
    seen = visits(prints).groupBy("cell").agg(F.min("bits").alias("low"), F.max("bits").alias("high"), F.count(F.lit(1)).alias("visitors"))
    return seen.where("visitors > 1")


def differing(a: Column, b: Column) -> Column:
    """How many bits differ."""
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame, most: int = 2) -> DataFrame:
    """a, b: each linked fingerprint a with smaller ones b, so that the links' components are those of all pairs within 2 bits."""
    met = stored(meetings(prints))
    pairs = met.where("visitors = 2").select(F.col("high").alias("a"), F.col("low").alias("b"))
    crowded = small(stored(met.where("visitors > 2").select("cell")), 1_000_000)
    inside = visits(prints).join(crowded, "cell", "left_semi")
    points = inside.select("cell", "bits", F.explode(near_points(F.col("bits"))).alias("point")).where(cell(F.col("point")) == F.col("cell"))
    lowest = points.groupBy("cell", "point").agg(F.min("bits").alias("b"), F.max("bits").alias("high")).where("b != high").drop("high")
    shared = points.join(lowest, ["cell", "point"]).where("bits != b").select(F.col("bits").alias("a"), "b")
    return pairs.unionByName(shared).where(differing(F.col("a"), F.col("b")) <= most).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """bits, root (the smallest fingerprint of its component) of every fingerprint in pairs (a, b).

    Rounds of hooking and pointer jumping: a fingerprint's root becomes the smallest root among its neighbours', then its root's
    root. The number of rounds grows with the logarithm of a chain's length; each round is written to the shared folder.
    """
    both = stored(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    roots = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).select(F.col("a").alias("bits"), "root"))
    while True:
        seen = both.join(roots.withColumnsRenamed({"bits": "b", "root": "theirs"}), "b").join(roots.withColumnsRenamed({"bits": "a", "root": "mine"}), "a")
        # the smallest root next to any member hooks the member's root, and the member itself
        low = seen.groupBy("a", "mine").agg(F.min("theirs").alias("low")).where("low < mine")
        hooks = low.select(F.col("mine").alias("bits"), "low").unionByName(low.select(F.col("a").alias("bits"), "low")).groupBy("bits").agg(F.min("low").alias("low"))
        hooked = stored(roots.join(hooks, "bits", "left").select("bits", F.least("root", "low").alias("root"), F.col("low").isNotNull().alias("moved")))
        if hooked.where("moved").isEmpty():
            return roots
        above = hooked.select(F.col("bits").alias("root"), F.col("root").alias("above"))
        once = stored(hooked.join(above, "root").select("bits", F.col("above").alias("root")))
        above = once.select(F.col("bits").alias("root"), F.col("root").alias("above"))
        roots = stored(once.join(above, "root").select("bits", F.col("above").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, mark, bits, component_id (the smallest id reachable over links of 2 bits or fewer) of every row of docs."""
    prints = stored(fingerprints(docs, id_col, text_col))
    # Each fingerprint makes about 49 visits, so its narrow row is dealt to all tasks.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = stored(prints.groupBy("bits").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("members")).repartition(parts, "bits"))
    found = components(links(distinct.select("bits")))
    grouped = found.join(distinct.drop("members"), "bits")
    firsts = grouped.groupBy("root").agg(F.min("first_id").alias("linked_id"))
    linked = stored(grouped.join(firsts, "root").select("bits", "linked_id"))
    ids = stored(distinct.join(linked, "bits", "left").select("bits", "members", F.coalesce("linked_id", "first_id").alias("component_id")))
    return join_groups(prints, ids, "bits", "members", prints.count()).select("id", "mark", "bits", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one with the smallest id (rows that share it stay together). Every column stays."""
    key, mark = free_names(docs, "gone_id", "gone_mark")
    gone = near_duplicates(docs, id_col, text_col).where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(key), F.col("mark").alias(mark))
    gone = stored(gone.distinct())
    clear, rest = HashFilter(stored(gone.select(F.xxhash64(key, mark).alias("h")))).parted(docs, F.xxhash64(F.col(f"`{id_col}`"), F.xxhash64(text_of(text_col))))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & (F.xxhash64(text_of(text_col)) == F.col(mark))
    return clear.unionByName(rest.join(gone, same, "left_anti"))
