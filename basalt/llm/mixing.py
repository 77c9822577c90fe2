"""Mixing sources to target weights by Pareto order sampling.

A source whose target is r times its own words takes floor(r) whole copies of each document. What is left of the target is a
sample without replacement: each document has inclusion odds p / (1 - p), a random number u (a hash of its id, source and text) has odds
u / (1 - u), and documents go by the quotient of both, smallest first, until the words are reached. The documents at the cut are
then tried by size, so that the words taken come near the target. DataFrame functions only.

Defined results: null texts have size 0 and take 0 words; null sources are one source, after all others; null and repeated ids are told
apart by source and text; rows that are equal in id, source and text are one block, which is taken together where it fits, and
each have their row; very long texts are counted whole, and are taken where they fit; empty input gives an empty result; other columns are
carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, HashFilter, free_names, join_groups, stored, text_of

#: Ranks have RANK_BITS bits and are cut by BIN_BITS at a time, LEVELS times or until the bin at the cut has at most BIN_ROWS rows (or none
#: of the bits is left), so that only the rows of one tiny bin are ever ordered one by one. The last TIE_BITS tell equal quotients apart.
RANK_BITS, TIE_BITS, BIN_BITS, LEVELS, BIN_ROWS = 60, 20, 10, 2, 100_000
#: Up to so many sources, tables with a row per source are broadcast.
MANY_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: list[float], most: float, share: float = 1.0) -> DataFrame:
    """sizes: source, source_size. Adds target: share of all sizes by weight, at most `most` times the source's size.

    What a source can't use goes to the others by weight, until none is above: with level L, a source gets
    min(most * size, L * weight). Sources sorted by most * size / weight give L in one pass of window sums. One row
    per source, so these windows are as small as the list of sources.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows, before, onward = Window.partitionBy(), by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_rows) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level).withColumn("free", F.col("cap") / F.col("weight") >= F.col("level"))
    rows = rows.withColumn("level", F.min_by("level", F.when(F.col("free"), F.col("cap") / F.col("weight"))).over(all_rows))
    return rows.select("source", "source_size", F.when(F.col("free"), F.least("cap", F.col("level") * F.col("weight"))).otherwise(F.col("cap")).alias("target"))


def block_mark(id_col: str, source_col: str, text_col: str, odds: Column, seed: int) -> Column:
    """The random number of a row: a hash of what makes it another document."""
    own, origin = F.col(f"`{id_col}`"), F.col(f"`{source_col}`")
    return F.xxhash64(F.lit(seed), own.isNull(), own, origin.isNull(), origin, odds, text_of(text_col))


def pareto_rank(docs: DataFrame, odds: Column) -> DataFrame:
    """Adds rank: (u / (1 - u)) / odds, mapped to [0, 1) and scaled to its bits, then bits of the mark. u comes from the mark, so reruns agree."""
    scale = 1 << (RANK_BITS - TIE_BITS)
    u = (F.pmod("mark", F.lit(scale)) + 0.5) / float(scale)
    quotient = u / (1 - u) / F.when(odds > 0, odds).otherwise(1.0)
    first = F.least(F.floor(quotient / (1 + quotient) * float(scale)), F.lit(scale - 1)).cast("long")
    return docs.withColumn("rank", F.shiftleft(first, TIE_BITS).bitwiseOR(F.shiftrightunsigned("mark", 64 - TIE_BITS)))


def _fill(ranked: DataFrame, state: DataFrame, mark, again: bool, most: float) -> DataFrame:
    """One round: each source takes its candidates in the order of rank until the next one no longer fits.

    ranked: source, size, rank, mark, words (of all rows with that mark), whole. again: documents get one more copy on top of the sampled ones, if that stays within `most`.
    state: source, gap (words still wanted), end (position of the last document looked at), steps (earlier rounds).
    """
    place = F.struct("rank", "mark")
    fits = (F.col("words") > 0) & (F.col("words") <= F.col("gap")) & (place > F.col("end")) & (F.lit(not again) | (F.col("whole") + 2 <= most))

    def candidates(at: DataFrame) -> DataFrame:
        at = mark(at.withColumnRenamed("source", "its_source"))
        return ranked.join(at, F.col("source").eqNullSafe(F.col("its_source"))).where(fits)

    at = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long"))
    shift, level = RANK_BITS, 0
    while level < LEVELS or (shift > 0 and not at.where(F.col("rows") > BIN_ROWS).isEmpty()):
        level += 1
        inside, shift = F.shiftright("rank", shift) == F.col("prefix"), shift - BIN_BITS
        bins = candidates(at).where(inside).groupBy("source", "gap", "before", F.shiftright("rank", shift).alias("bin")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        upto = bins.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
        over = F.col("upto") > F.col("gap")
        cut = upto.groupBy("source").agg(F.min(F.when(over, F.struct("bin", "rows"))).alias("cut"), F.max(F.when(~over, F.col("upto"))).alias("filled"))
        # without a bin that overflows, prefix -1 says that all candidates are taken
        cut = cut.select(F.col("source").alias("s"), F.col("cut.bin").alias("prefix"), F.col("cut.rows").alias("rows"), "filled")
        at = at.drop("prefix", "rows").join(mark(cut), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        at = stored(at.withColumn("before", F.greatest("before", F.coalesce("filled", F.lit(0)))).withColumn("prefix", F.coalesce("prefix", F.lit(-1))).drop("filled"))

    one_by_one = candidates(at).where(F.shiftright("rank", shift) == F.col("prefix"))
    one_by_one = one_by_one.groupBy("source", "gap", "before", "rank", "mark").agg(F.max("words").alias("words"))
    one_by_one = one_by_one.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("rank", "mark"))).where(F.col("upto") <= F.col("gap"))
    last = one_by_one.groupBy("source").agg(F.max(place).alias("last"), F.max("upto").alias("used"))
    at = at.join(mark(last.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")), "left")
    at_bin = F.when(F.col("prefix") < 0, F.lit(1 << (RANK_BITS + 1))).otherwise(F.expr(f"shiftleft(prefix, {shift})"))
    nobody = F.struct(at_bin.cast("long").alias("rank"), F.lit(None).cast("long").alias("mark"))
    end = F.coalesce("last", nobody)
    step = F.struct(F.col("end").alias("start"), F.col("gap").alias("most"), end.alias("end"), F.lit(again).alias("again"))
    return stored(at.select("source", F.concat("steps", F.array(step)).alias("steps"), (F.col("gap") - F.coalesce("used", "before")).alias("gap"), end.alias("end")))


def pareto_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, share: float = 1.0, odds_col: str | None = None, seed: int = 7, rounds: int = 3) -> DataFrame:
    """id, source, size, source_size, target, copies, taken of every row of docs.

    odds_col: optional relative inclusion odds of documents within their source (equal if not given).
    rounds: how often what a source still lacks is offered, further down the ranking, to documents of at most that size; two more
    rounds then offer what is lacking as one more copy, from the top of the ranking.
    """
    return _mix(docs, id_col, source_col, text_col, weights, most, share, odds_col, seed, rounds).drop("mark", "rows")


def _odds(odds_col: str | None) -> Column:
    return F.coalesce(F.col(f"`{odds_col}`").cast("double"), F.lit(1.0)) if odds_col else F.lit(1.0)


def _mix(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[float, ...], most: float, share: float, odds_col: str | None, seed: int, rounds: int) -> DataFrame:
    """The columns of pareto_mix, mark (see block_mark), and rows (how many have that mark)."""
    own = block_mark(id_col, source_col, text_col, _odds(odds_col), seed).alias("mark")
    sized = stored(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), words(text_of(text_col)).alias("size"), _odds(odds_col).alias("odds"), own))
    by_source = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    # Tables with a row per source go to every task, as long as there are few sources.
    mark = F.broadcast if by_source.limit(MANY_SOURCES + 1).count() <= MANY_SOURCES else (lambda df: df)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = targets(by_source, list(weights), most, share).withColumn("ratio", ratio).withColumn("whole", F.floor("ratio").cast("long"))
    goals = stored(goals.withColumn("gap", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")))

    def with_source(rows: DataFrame, more: DataFrame) -> DataFrame:
        return rows.join(mark(more.withColumnRenamed("source", "its_source")), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")

    p = F.least(F.col("ratio") - F.col("whole"), F.lit(1 - 1e-12))
    ranked = with_source(sized, goals.select("source", "source_size", "target", "ratio", "whole"))
    blocks = stored(sized.groupBy("mark").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words")).where("rows > 1"))
    ranked = pareto_rank(ranked, p / (1 - p) * F.col("odds")).drop("odds", "ratio")
    ranked = join_groups(ranked, blocks, "mark", "rows", sized.count(), "left")
    ranked = stored(ranked.withColumn("rows", F.coalesce("rows", F.lit(1))).withColumn("words", F.coalesce("words", "size")))

    place = F.struct("rank", "mark")
    start = F.struct(F.lit(-1).cast("long").alias("rank"), F.lit(None).cast("long").alias("mark"))
    step = F.struct(start.alias("start"), F.lit(0).cast("long").alias("most"), start.alias("end"), F.lit(False).alias("again"))
    state = goals.select("source", F.slice(F.array(step), 1, 0).alias("steps"), "gap", start.alias("end"))
    for k in range(rounds + 2):
        if k == rounds:
            state = state.withColumn("end", start)
        state = _fill(ranked.select("source", "size", "rank", "mark", "words", "whole"), state, mark, k >= rounds, most)
    took = F.filter("steps", lambda s: (place > s["start"]) & (place <= s["end"]) & (F.col("words") <= s["most"]) & (F.col("words") > 0) & (~s["again"] | (F.col("whole") + 2 <= most)))
    copies = F.col("whole") + F.size(took)
    return with_source(ranked, state.select("source", "steps")).select("id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), "mark", "rows")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, share: float = 1.0, odds_col: str | None = None, seed: int = 7, rounds: int = 3) -> DataFrame:
    """The mixture itself: every row of docs as often as it is taken, all columns kept. Rows of size 0 go. Options as for pareto_mix."""
    mark, times, members, each = free_names(docs, "plan_mark", "copies", "rows", "copy")
    plan = stored(_mix(docs, id_col, source_col, text_col, weights, most, share, odds_col, seed, rounds).select("mark", F.when(F.col("size") > 0, F.col("copies")).otherwise(0).alias("copies"), "rows").where("copies != 1"))
    total = plan.count()
    plan = plan if plan.where("rows > 1").isEmpty() else stored(plan.distinct())
    # Rows that are taken once stay where they are; of the others, those that go or are repeated are told by their mark.
    rows = docs.withColumn(mark, block_mark(id_col, source_col, text_col, _odds(odds_col), seed))
    once, rest = HashFilter(stored(plan.select(F.col("mark").alias("h")))).parted(rows, F.col(mark))
    plan = plan.select(F.col("mark").alias(mark), F.col("copies").cast("long").alias(times), F.col("rows").alias(members))
    out = [F.col(f"`{c}`") for c in docs.columns]
    rest = join_groups(rest, plan, mark, members, total, "left").withColumn(times, F.coalesce(times, F.lit(1))).where(F.col(times) > 0)
    rest = rest.select(*out, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(each)).drop(each)
    return once.select(*out).unionByName(rest)
