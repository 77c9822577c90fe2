"""Document fingerprints by a homomorphic multiset hash.

A paragraph hashes to a wide vector: the sum of +1/-1 lanes drawn from the hashes of the paragraph and of its parts (pairs of
words; four letters at a time where it has few words). A document's fingerprint is the sum of its paragraphs' vectors,
each lane modulo 2**16. So it doesn't depend on the order of paragraphs, texts with the same paragraphs have the same
fingerprint, and adding or removing a paragraph adds or subtracts its vector (combine, remove). Lanes are random projections,
so the squared distance of two fingerprints estimates how many parts differ (likeness). DataFrame functions only.

Defined results: null and empty texts have the zero vector, alike (1.0) only to itself; empty paragraphs count nothing; ids are of any
type that has an order; null ids come last in the order of documents, ties go by a hash of the text; repeated rows each have
their row; very long texts are summed whole, 32,767 parts at a time; empty input gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, text_of

#: Each hash of 64 bits gives 64 lanes, so each part is hashed LANES / 64 times.
LANES = 256
#: Four lanes of 16 bits are summed in one long (which stays positive), for so many parts at a time.
FIELDS, CHUNK = 0x0001000100010001, 32767
#: Longs that hold a vector's counts.
GROUPS = LANES // 4
MODULUS = 1 << 16
#: Paragraphs of fewer words are hashed by letters.
FEW_WORDS, LETTERS = 12, 4


def _parts(paragraph: Column, words: Column) -> Column:
    """The hashes of a paragraph: itself, and its pairs of words (the last word with nothing) or, of few words, its letters, four at a time."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    of_letters = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - LETTERS, F.lit(0))), lambda i: F.xxhash64(*(F.get(c, i + k) for k in range(LETTERS))))
    letters = F.flatten(F.transform(F.array(F.split(paragraph, "")), of_letters))
    return F.concat(F.array(F.xxhash64(F.lit("\n"), paragraph)), F.when(F.size(words) < FEW_WORDS, letters).otherwise(pairs))


def hashes(text: Column) -> Column:
    """The hashes of a text's parts."""
    paragraphs = F.filter(F.split(text, "\n"), lambda p: p != "")
    worded = F.transform(paragraphs, lambda p: F.struct(p.alias("text"), F.split(p, " ").alias("words")))
    return F.flatten(F.transform(worded, lambda p: _parts(p["text"], p["words"])))


def vectors(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """For each row and each group of four lanes: keys (which must tell rows apart), group, and for each text the lanes <text>_0 to <text>_3.

    Hashes become rows and are counted by generated code, bit by bit, four lanes in a long. If rows are partitioned by one of
    the keys nothing is shuffled; else only a row of counts for each text is.
    """
    tagged = F.array(*(F.struct(F.lit(k).alias("which"), hashes(F.col(t)).alias("hashes")) for k, t in enumerate(texts)))
    each = rows.select(*keys, F.explode(tagged).alias("x")).select(*keys, "x.which", F.posexplode_outer("x.hashes").alias("pos", "h0"))
    each = each.select(*keys, "which", F.expr(f"coalesce(pos, 0) div {CHUNK}").alias("chunk"), "h0", *(F.xxhash64(F.lit(k), "h0").alias(f"h{k}") for k in range(1, LANES // 64)))
    ones = [F.coalesce(F.sum(F.shiftrightunsigned(F.when(F.col("h0").isNotNull(), F.col(f"h{k}")), j).bitwiseAND(F.lit(FIELDS))), F.lit(0)).alias(f"s{k}_{j}") for k in range(LANES // 64) for j in range(16)]
    counts = each.groupBy(*keys, "which", "chunk").agg(F.count("h0").alias("n"), *ones)
    packed = counts.select(*keys, "which", "n", F.posexplode(F.array(*(f"s{k}_{j}" for k in range(LANES // 64) for j in range(16)))).alias("group", "packed"))
    lane = lambda k, f: F.sum(F.when(F.col("which") == k, F.shiftrightunsigned("packed", 16 * f).bitwiseAND(F.lit(MODULUS - 1)) * 2 - F.col("n")).otherwise(0))
    return packed.groupBy(*keys, "group").agg(*(centred(lane(k, f)).alias(f"{t}_{f}") for k, t in enumerate(texts) for f in range(4)))


def _hex(name: str) -> Column:
    """Four lanes of a group, four hex digits each."""
    field = lambda f: F.shiftleft(F.col(f"{name}_{f}").cast("long").bitwiseAND(F.lit(MODULUS - 1)), 48 - 16 * f)
    return F.lower(F.lpad(F.hex(field(0).bitwiseOR(field(1)).bitwiseOR(field(2)).bitwiseOR(field(3))), 16, "0"))


def _joined(name: str) -> Column:
    """The groups of a row in order, as text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", F.col(name).alias("hex")))), lambda g: g["hex"]), "")


def centred(lane: Column) -> Column:
    """A lane modulo 2**16, as a number around 0."""
    return (F.pmod(lane + MODULUS // 2, F.lit(MODULUS)) - MODULUS // 2).cast("int")


def combine(a: Column, b: Column) -> Column:
    """The fingerprint of two documents' paragraphs together."""
    return F.zip_with(a, b, lambda x, y: centred(x + y))


def remove(a: Column, b: Column) -> Column:
    """The fingerprint of a without b's paragraphs."""
    return F.zip_with(a, b, lambda x, y: centred(x - y))


def likeness(norm_a: Column, norm_b: Column, distance: Column) -> Column:
    """0 to 1: an estimate of twice the shared parts over all parts of both, from squared lengths and the squared distance."""
    both = norm_a + norm_b
    return F.when(both == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - distance / both))


def _square(a: str, b: str | None = None) -> Column:
    """Over the group's four lanes, the squares of a, or of a - b."""
    diff = lambda f: F.col(f"{a}_{f}").cast("long") if b is None else centred(F.col(f"{a}_{f}") - F.col(f"{b}_{f}")).cast("long")
    return sum((diff(f) * diff(f) for f in range(1, 4)), diff(0) * diff(0))


def as_text(lanes: Column) -> Column:
    """Four hex digits a lane."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(F.pmod(x, F.lit(MODULUS))), 4, "0")), ""))


def dealt(rows: DataFrame, key: str, text: str) -> DataFrame:
    """rows in order of key (nulls last, then by a hash of the text), cut into buckets of about equal counts: adds __order, __at (bucket), __halo.

    The first rows of a bucket also come, as its halo, to the bucket before it (the very first to the last one), so that each
    bucket finds its own successors: one shuffle, no global sort, no task that holds more than a bucket. The cuts are the ends of a
    range partitioning of the narrow order; there are a few for each shuffle partition.
    """
    spark = rows.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = math.isqrt(buckets)
    order = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), F.xxhash64(text).alias("tie"))
    rows = rows.withColumn("__order", order)
    first = rows.select("__order").repartitionByRange(buckets, "__order").groupBy(F.spark_partition_id()).agg(F.min("__order").alias("o"))
    cuts = [r["o"] for r in first.orderBy("o").collect()]  # at most one for each bucket
    kind = rows.schema[key].dataType
    lit = lambda cut: F.struct(F.lit(cut["last"]).alias("last"), F.lit(cut["key"]).cast(kind).alias("key"), F.lit(cut["tie"]).alias("tie"))
    below = lambda some: F.size(F.filter(some, lambda c: c <= F.col("__order")))
    if not cuts:
        return rows.withColumns({"__at": F.lit(0), "__halo": F.lit(False)})
    groups = [F.array(*map(lit, cuts[i : i + step])) for i in range(0, len(cuts), step)]
    group = F.greatest(below(F.array(*(F.get(g, F.lit(0)) for g in groups))), F.lit(1))
    placed = rows.withColumn("__group", group).withColumn("__bucket", (F.col("__group") - 1) * step + below(F.element_at(F.array(*groups), F.col("__group"))))

    heads = placed.groupBy("__bucket").agg(F.min("__order").alias("__head"))
    in_order = Window.orderBy("__bucket")  # a row for each bucket
    heads = heads.withColumn("__before", F.coalesce(F.lag("__bucket").over(in_order), F.max("__bucket").over(Window.partitionBy())))
    own = F.struct(F.col("__bucket").alias("at"), F.lit(False).alias("halo"))
    halo = F.struct(F.col("__before").alias("at"), F.lit(True).alias("halo"))
    spread = placed.join(F.broadcast(heads), "__bucket").withColumn("__to", F.explode(F.when(F.col("__order") == F.col("__head"), F.array(own, halo)).otherwise(F.array(own))))
    return spread.select(*rows.columns, F.col("__to.at").alias("__at"), F.col("__to.halo").alias("__halo")).repartition("__at")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lanes (LANES ints in [-2**15, 2**15)) of every text."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("body"))
    four = F.struct("group", F.array(*(f"body_{f}" for f in range(4))).alias("lanes"))
    found = vectors(rows, ["row", "id"], ["body"]).groupBy("row", "id").agg(F.array_sort(F.collect_list(four)).alias("groups"))
    return found.select("id", F.flatten(F.transform("groups", lambda g: g["lanes"])).alias("lanes"))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How the fingerprint follows an edit: the last quarter of each text gives way to the start of the next text in order of id.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint (as text), near_edited, near_next. Texts move once, into buckets
    of the order (dealt); everything else happens within a bucket.
    """
    placed = dealt(docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("body")), "id", "body")
    after = Window.partitionBy("__at").orderBy("__halo", "__order")
    rows = placed.select("__at", "__halo", "id", "body", F.lead("body").over(after).alias("next_body"), F.length("body").alias("n_chars"))
    rows = rows.withColumn("edited", F.expr("concat(left(body, n_chars - n_chars div 4), left(coalesce(next_body, ''), cast(n_chars div 4 as int)))"))
    rows = rows.select("__at", "__halo", F.monotonically_increasing_id().alias("__row"), "id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "body", "edited")
    keys = ["__at", "__halo", "__row", "id", "n_chars", "edited_sha256"]
    groups = vectors(rows, keys, ["body", "edited"])
    follower = Window.partitionBy("__at", "group").orderBy("__row")
    groups = groups.select("*", *(F.lead(f"body_{f}").over(follower).alias(f"next_{f}") for f in range(4))).where(~F.col("__halo"))
    measured = {"own": _square("body"), "edit": _square("edited"), "next": _square("next"), "to_edited": _square("body", "edited"), "to_next": _square("body", "next")}
    found = groups.select(*keys, "group", _hex("body").alias("hex"), _hex("edited").alias("edited_hex"), *(c.alias(n) for n, c in measured.items()))
    found = found.groupBy(*keys).agg(_joined("hex").alias("fingerprint"), _joined("edited_hex").alias("edited_fingerprint"), *(F.sum(n).alias(n) for n in measured))
    near = {f"near_{b}": likeness(F.col("own"), F.col(a), F.col(f"to_{b}")) for a, b in (("edit", "edited"), ("next", "next"))}
    return found.select("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *(c.alias(n) for n, c in near.items()))
