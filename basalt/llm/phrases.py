"""Phrases (collocations) of each language: n-grams whose words stand together more often than their parts do alone.

Texts are cut into pieces and words, and n-grams are exploded into rows and summed by (language, phrase), partly in the tasks before
anything moves. A phrase can only be frequent if all its words and pairs are, so three passes keep the rare ones at home: words are counted;
then pairs of frequent words, by their hash; then all n-grams of 2 to `longest` words whose pairs are frequent, by their text. What
a pass hands to the next is a bitmap of hashes of bounded size: it may let a rare n-gram through, which its exact count then drops, and never
holds back a frequent one. So the phrases and counts are those of exploding every n-gram.

Each candidate joins the counts of its first and last parts for every cut, is scored in decimals, loses to a longer phrase by an anti-join on
its one-word extensions (a longer phrase that holds it has such an extension, at least as frequent, among its parts), and is ranked by a window
over the best of each of 64 shares of its language.

Defined results: null texts count as empty; a null language is `und`, together with rows that say so; texts without words give nothing;
very long texts are cut into pieces by tasks, a piece at a time; equal rows, and rows that repeat an id, each count; ties rank by phrase in UTF-8
order; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import HashFilter, stored, text_of

#: What ends a piece; a tab is a space.
ENDS = ".,;:!?\n\x0b\x0c\r"
_SHARES = 64


def positions(docs: DataFrame, length: int, text_col: str, lang_col: str) -> DataFrame:
    """lang, w0 to w{length-1}: a row for each word with the words after it in its piece (null beyond its end)."""
    lower = F.translate(text_of(text_col), string.ascii_uppercase + ENDS + "\t", string.ascii_lowercase + "\n" * len(ENDS) + " ")
    pieces = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(lower, "\n")).alias("piece"))
    words = pieces.where("piece != ''").select("lang", F.array_remove(F.split("piece", " "), "").alias("w"))
    columns = [F.col("w"), *(F.slice("w", k + 1, F.greatest(F.size("w"), F.lit(1))) for k in range(1, length))]
    zipped = words.select("lang", F.inline(F.arrays_zip(*(c.alias(f"w{k}") for k, c in enumerate(columns)))))
    return zipped.toDF("lang", *(f"w{k}" for k in range(length)))


def _hash(*words: str) -> Column:
    return F.xxhash64("lang", *words)


def phrase_counts(docs: DataFrame, longest: int = 4, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Stored tables: lang, words (1 to longest), phrase, f (at least `least`); and lang, n (all word occurrences)."""
    single = stored(positions(docs, 1, text_col, lang_col).groupBy("lang", "w0").agg(F.count(F.lit(1)).alias("f")))
    totals = stored(single.groupBy("lang").agg(F.sum("f").alias("n")))
    often = stored(single.where(F.col("f") >= least).select("lang", F.lit(1).alias("words"), F.col("w0").alias("phrase"), "f"))
    words = HashFilter(stored(often.select(_hash("phrase").alias("h"))))

    two = positions(docs, 2, text_col, lang_col).where("w1 IS NOT NULL").select(_hash("w0").alias("a"), _hash("w1").alias("b"), _hash("w0", "w1").alias("h"))
    often_two = words.marked(words.marked(two, "a", "first").where("first"), "b", "second").where("second")
    pairs = HashFilter(stored(often_two.groupBy("h").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= least).select("h")))

    # A row forms a phrase of k + 1 words if all its pairs up to there are frequent.
    rows = positions(docs, longest, text_col, lang_col).where("w1 IS NOT NULL")
    formed = []
    for k in range(1, longest):
        rows = pairs.marked(rows.withColumn("h", F.when(F.col(f"w{k}").isNotNull(), _hash(f"w{k - 1}", f"w{k}"))), "h", f"go{k}")
        rows = rows.where("go1") if k == 1 else rows.withColumn(f"go{k}", F.col(f"go{k - 1}") & F.col(f"go{k}"))
        formed.append(F.when(F.col(f"go{k}"), F.struct(F.lit(k + 1).alias("words"), F.concat_ws(" ", *(f"w{j}" for j in range(k + 1))).alias("phrase"))))
    counted = rows.select("lang", F.explode(F.array_compact(F.array(*formed))).alias("p")).groupBy("lang", "p").agg(F.count(F.lit(1)).alias("f"))
    return stored(often.unionByName(counted.where(F.col("f") >= least).select("lang", "p.words", "p.phrase", "f"))), totals


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, share: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of 2 to `longest` words of each language.

    The score is 2,000,000 * a / (l + r), rounded down, of the cut with the lowest score (of equal ones the first). A candidate goes if a longer
    one that holds its words is at least `share` hundredths as frequent.
    """
    counts, totals = phrase_counts(docs, longest, least, text_col, lang_col)
    many = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    cut = many.select("*", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cut = cut.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - words)"))
    sides = cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", wide("a") * F.lit(2_000_000).cast("decimal(7,0)"), wide("l") + wide("r"))
    scored = sides.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    longer = many.where("words > 2").select("lang", F.col("a").alias("whole"), F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"))
    held = longer.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    held = held.join(many.select("lang", "phrase", "a"), ["lang", "phrase"]).where(wide("whole") * 100 >= wide("a") * share).select("lang", "phrase")
    left = scored.join(held, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = left.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(_SHARES)))
    best = part.withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
