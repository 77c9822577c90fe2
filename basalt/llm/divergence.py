"""How unlike the sources of a language are: distances between their term shares, and the terms that set a source apart.

Tasks count terms, and in how many documents they stand, by (language, source, term). A kept term becomes its sparse vector of counts by
source. Many terms share their vector, so terms are grouped by identical vectors: each distinct vector is dealt once, in chunks, to
tasks that evaluate every pair of sources on it and weigh the result by the number of terms that have the vector. What leaves a task is one
sum for each pair of sources, never a row for each pair and term. The terms themselves are ranked from their own counts.

Shares are whole numbers, p = 1 + floor(scale * (count + added) / (N + added * V)), for a group with N occurrences of its language's V kept
terms. All arithmetic is in whole numbers (exact for counts up to 9 * 10**12).

Defined results: null text, language and source are empty strings, which are groups like any other; very long texts are counted whole;
rows that are equal or repeat an id each count; a language without kept terms has pairs of value 0 and no terms; a language of one source
has no pairs; ties rank by name in UTF-8 order; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored, text_of

#: In UTF-8, letters A-Z become a-z, other letters and all bytes beyond ASCII stay, and the rest ends a term.
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Bytes of a text that are split at once; counts of terms and sums of pairs that a task holds before it hands them on.
_PIECE, _HELD_TERMS, _HELD_PAIRS = 4 << 20, 300_000, 4_000_000
#: Sources whose pairs with all others are evaluated by one task, and whole numbers in the matrix of a chunk of vectors.
_BLOCK, _CELLS = 256, 2_000_000


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text (UTF-8), some megabytes at a time."""
    text, at = text.translate(_TERM_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + _PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, count, docs (the documents that hold it); a row with a null term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (count, docs) in held.items():
                terms = pa.array([None, *count], pa.binary()).cast(pa.string())
                numbers = [pa.array([0, *count.values()], pa.int64()), pa.array([0, *(docs[t] for t in count)], pa.int64())]
                names = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(terms), np.int32))) for x in (lang, source)]
                yield from pa.Table.from_arrays([*names, terms, *numbers], ["lang", "source", "term", "count", "docs"]).to_batches(20_000)
            held.clear()

        size = 0
        for batch in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in batch.columns)):
                count, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(count), set()
                for part in terms_of(text):
                    count.update(part)
                    own.update(part)
                docs.update(own)
                size += len(count) - before
                if size > _HELD_TERMS:
                    yield from handed_on()
                    size = 0
        yield from handed_on()

    rows = docs.select(text_of(text_col).cast("binary").alias("text"), text_of(lang_col).alias("lang"), text_of(source_col).alias("source"))
    found = rows.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column, scale: int, added: int) -> Column:
    """p of a count in a group with so many occurrences of so many kept terms; decimal, so that no product overflows."""
    whole = (count.cast("decimal(19,0)") + added) * F.lit(scale).cast("decimal(10,0)")
    return F.call_function("div", whole, total.cast("decimal(19,0)") + added * kept.cast("decimal(17,0)")) + 1


def shares(counts: np.ndarray, totals: np.ndarray, kept: int, scale: int, added: int) -> np.ndarray:
    """p of counts, a row for each vector and a column for each source; long division keeps all within 64 bits."""
    whole, below = 0, totals + added * kept
    rest, step = counts + added, 1
    while step < scale:
        rest = rest * 10
        whole, rest, step = whole * 10 + rest // below, rest % below, step * 10
    return whole + 1


def _pair_sums(scale: int, added: int):
    """Rows (lang, chunk, block, kept, totals, vectors as copies, at, counts) to sums of |p - q| by (lang, a, b), a in the block and a < b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, block), sums in held.items():
                a, b = np.indices(sums.shape)
                a += block * _BLOCK
                use = a < b
                names = pa.array([lang], pa.string()).take(pa.array(np.zeros(int(use.sum()), np.int32)))
                yield from pa.Table.from_arrays([names, pa.array(a[use]), pa.array(b[use]), pa.array(sums[use])], ["lang", "a", "b", "value"]).to_batches(20_000)
            held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                totals = np.array(row["totals"], np.int64)
                first = row["block"] * _BLOCK
                mine = slice(first, min(first + _BLOCK, len(totals)))
                sums = held.setdefault((row["lang"], row["block"]), np.zeros((mine.stop - first, len(totals)), np.int64))
                counts = np.zeros((len(row["vectors"]), len(totals)), np.int64)
                for n, vector in enumerate(row["vectors"]):
                    counts[n, [x["at"] for x in vector["entries"]]] = [x["count"] for x in vector["entries"]]
                copies = np.array([v["copies"] for v in row["vectors"]], np.int64)
                p = shares(counts, totals, row["kept"], scale, added)
                for s in range(first, mine.stop):
                    sums[s - first] += copies @ np.abs(p - p[:, s : s + 1])
                if sum(x.size for x in held.values()) > _HELD_PAIRS:
                    yield from handed_on()
        yield from handed_on()

    return run


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, top: int = 50, scale: int = 1_000_000_000, added: int = 5) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: the distance to each other source; part `term`: the `top` terms above the language's share.

    A term is kept in a language if at least `least_docs` of its documents hold it. scale is a power of ten.
    """
    counts = stored(term_counts(docs, text_col, lang_col, source_col))
    # One row for each source: numbers from 0 in each language.
    groups = stored(counts.where("term IS NULL").select("lang", "source", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).alias("at")))
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term")
    numbered = counts.where("term IS NOT NULL").join(kept, ["lang", "term"]).join(groups, ["lang", "source"]).select("lang", "term", "at", "count")
    vectors = stored(numbered.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("at", "count"))).alias("entries")))
    distinct = stored(vectors.groupBy("lang", "entries").agg(F.count(F.lit(1)).alias("copies")))

    # Totals of each source and language, from the distinct vectors.
    entry = distinct.select("lang", "copies", F.explode("entries").alias("e")).groupBy("lang", F.col("e.at").alias("at")).agg(F.sum(F.col("e.count") * F.col("copies")).alias("total"))
    v = distinct.groupBy("lang").agg(F.sum("copies").alias("kept"), F.count(F.lit(1)).alias("different"))
    groups = stored(groups.join(entry, ["lang", "at"], "left").join(v, "lang", "left").select("lang", "at", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept", "different"))))
    langs = stored(groups.groupBy("lang").agg(F.sum("total").alias("all_total"), F.first("kept").alias("kept"), F.first("different").alias("different"), F.count(F.lit(1)).alias("sources"), F.transform(F.array_sort(F.collect_list(F.struct("at", "total"))), lambda x: x["total"]).alias("totals")))

    # A chunk is a row of at most about _CELLS numbers once its vectors are written out.
    chunks = F.expr(f"cast(ceil(different / greatest(1, least(1024, {_CELLS} div sources))) as long)")
    chunk = distinct.join(langs.select("lang", "different", "sources"), "lang").withColumn("chunk", F.pmod(F.xxhash64("entries"), chunks))
    dealt = chunk.groupBy("lang", "chunk").agg(F.collect_list(F.struct("copies", "entries")).alias("vectors"))
    blocks = F.explode(F.expr(f"sequence(0, cast((sources - 1) div {_BLOCK} as int))"))
    work = dealt.join(langs.select("lang", "totals", "kept", "sources"), "lang").select("lang", blocks.alias("block"), "kept", "totals", "vectors")
    sums = work.mapInArrow(_pair_sums(scale, added), "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sums = stored(sums)
    # Languages without kept terms have no vectors: their pairs are formed from their sources, all others have a sum already.
    bare = groups.where("kept = 0").select("lang", F.col("at").alias("a"))
    none = bare.join(bare.withColumnRenamed("a", "b"), "lang").where("a < b").select("lang", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.lit(0).cast("long").alias("value"))
    half = sums.unionByName(none)
    both = half.unionByName(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = groups.select("lang", "at", "source")
    pairs = both.join(name.withColumnRenamed("at", "a"), ["lang", "a"]).join(name.select("lang", F.col("at").alias("b"), F.col("source").alias("item")), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    there = vectors.select("lang", "term", F.explode("entries").alias("e"), F.aggregate("entries", F.lit(0).cast("long"), lambda n, x: n + x["count"]).alias("all_count"))
    known = there.select("lang", "term", "all_count", F.col("e.at").alias("at"), F.col("e.count").alias("count")).join(groups, ["lang", "at"]).join(langs.select("lang", "all_total"), "lang")
    p, q = (share(F.col(c), F.col(t), F.col("kept"), scale, added) for c, t in (("count", "total"), ("all_count", "all_total")))
    terms = known.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).cast("long").alias("value")).where("value > 0")

    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best).select("lang", "source", "part", "item", "value", "rank")
