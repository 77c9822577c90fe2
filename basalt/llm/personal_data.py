"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction of what they miss.

The fixed patterns (email, ip, card, phone) give the base spans, whose instances are seeds. Values that are assigned to a name such as
token or password are seeds of a fifth kind, secret, which has no base spans: a secret is reported only where a pattern tells it.
The words before an instance, and the word after it, are its lexical patterns. Patterns and instances form a bipartite graph, which
is scored in rounds: a pattern's confidence for a kind is the share of its distinct instances that are known, counted over
all places in the corpus where its words stand (also beside a plain word); an instance's score is 1 less the product of
its patterns' doubts. Instances with a high score count as known in the next round. At the end the places where a pattern
of high confidence stands beside an identifier that is known (or, for secrets, a seed), and no base span is, are added as spans of the
pattern's kind. DataFrame functions only.

Defined results: null and empty texts have no spans; spans that share a start are in the order of kinds; patterns and
instances are compared in lower case with every digit as 0 in patterns; repeated rows each get their spans, and their
instances count once; very long texts are read whole, and candidates meet base spans by blocks of text, so their work is
linear; null ids are kept; empty input gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, stored, text_of

BASE = ("email", "ip", "card", "phone")
SECRET = len(BASE)
KINDS = (*BASE, "secret")
#: Java patterns; possessive, and tried only where a run begins, so that long runs take linear time and no stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9])(?<![0-9][ -]))[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What may be an identifier: a word with a digit or an at sign.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
TRIGGER = {"email": "@", "ip": ".", "card": None, "phone": "+"}
CONTEXT_CHARS = 80
#: Before a cue that is the word after an identifier (no word begins with a blank).
AFTER = " "
WRAPPING = "\"'`()[]{}<>.,;:!?#*&%$"
#: What stands before a seed of the kind secret: a telling name and an assignment.
SECRET_BEFORE = r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)[\"']?[\x20\x09-\x0D]*[:=][\x20\x09-\x0D]*$"
SECRET_LENGTH = 12
#: Candidates and base spans meet within blocks of so many characters.
BLOCK = 64


def _found(body: Column, kind: int, pattern: str, trigger: str | None) -> Column:
    """kind, gap (characters since the last match), value, before and after (the end and the start of what stands in the gap) of each match.

    A last element without a value holds what follows the last match.
    """
    gaps, values = F.split(body, pattern, -1), F.regexp_extract_all(body, F.lit(f"({pattern})"), F.lit(1))
    pairs = F.zip_with(gaps, values, lambda g, v: F.struct(F.lit(kind).alias("kind"), F.length(g).alias("gap"), v.alias("value"), F.right(g, F.lit(CONTEXT_CHARS)).alias("before"), F.left(g, F.lit(CONTEXT_CHARS)).alias("after")))
    matches = F.filter(pairs, lambda p: p["value"].isNotNull() | (p["gap"] < F.length(body)))
    maybe = body.rlike("[0-9@]") if trigger is None else F.contains(body, F.lit(trigger))
    return F.coalesce(F.when(maybe, matches), F.expr("cast(array() as array<struct<kind: int, gap: int, value: string, before: string, after: string>>)"))


def luhn(digits: Column) -> Column:
    """Whether the last digit checks the others."""
    places = F.split(F.reverse(digits), "")
    values = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + (d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0))) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == 1, value.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == 2, F.when((n >= 14) & (n <= 19), luhn(digits)).otherwise(False))
        .when(kind == 3, (n >= 10) & (n <= 15))
        .otherwise(True)
    )


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (row, id) of docs, and all matches (row, kind, start, end, value, before, after); the last kind are candidates, the others valid base spans."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("body"))
    body = F.col("body")
    per_kind = [_found(body, k, PATTERNS[name], TRIGGER[name]) for k, name in enumerate(BASE)]
    all_found = stored(rows.select("row", "id", F.concat(*per_kind, _found(body, len(KINDS), CANDIDATE, None)).alias("found")))
    flat = all_found.select("row", F.posexplode("found").alias("at", "m")).select("row", "at", "m.*")
    order = Window.partitionBy("row", "kind").orderBy("at")
    upto = F.sum(F.col("gap") + F.length("value")).over(order)
    placed = flat.select("row", "kind", "value", "before", F.lead("after").over(order).alias("after"), upto.cast("long").alias("end")).withColumn("start", F.col("end") - F.length("value"))
    return all_found.select("row", "id"), stored(placed.where(F.col("value").isNotNull() & _valid(F.col("kind"), F.col("value"))))


def _cues(before: Column, after: Column) -> Column:
    """The last word, and the last two words, of what stands before, and the first word after, in lower case, digits as 0.

    The word after is told apart by the mark that it follows.
    """
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[0-9]", "0"))
    one = F.regexp_extract(plain(before), r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+$", 1)
    two = F.regexp_extract(plain(before), r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]+$", 1)
    following = F.regexp_extract(plain(after), r"^[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", 1)
    cues = F.array(one, F.regexp_replace(two, r"[\x20\x09-\x0D]+", " "), F.when(following != "", F.concat(F.lit(AFTER), following)))
    return F.filter(cues, lambda c: c != "")


def _blocks(start: Column, end: Column) -> Column:
    """The blocks of text that a span touches."""
    return F.explode(F.sequence(F.floor(start / BLOCK), F.floor((F.greatest(end, start + 1) - 1) / BLOCK)))


def context_edges(found: DataFrame) -> DataFrame:
    """row, start, end, value (trimmed, lower case), kind (of the base span that it begins or holds, or null), seed (a secret by its assignment), cue: candidates by the words beside them."""
    tokens = found.where(F.col("kind") == len(KINDS)).withColumn("inner", F.ltrim(F.col("value"), F.lit(WRAPPING))).where("inner != ''")
    tokens = tokens.withColumn("first", F.col("end") - F.length("inner")).withColumn("inner", F.rtrim(F.col("inner"), F.lit(WRAPPING)))
    span = [F.col("first").alias("start"), (F.col("first") + F.length("inner")).alias("end")]
    tokens = tokens.where("inner != ''").select("row", *span, F.lower("inner").alias("value"), "before", "after")
    base = found.where(F.col("kind") < len(BASE)).select("row", F.col("kind"), F.col("start").alias("s"), F.col("end").alias("e"), F.lower("value").alias("whole"))
    in_blocks = tokens.select("row", "start", "end", _blocks(F.col("start"), F.col("end")).alias("block"))
    base_blocks = base.withColumn("block", _blocks(F.col("s"), F.col("e")))
    # The instance is the whole span, told at the token in which it starts; its other tokens are parts, which teach nothing.
    state = F.when(F.col("s") >= F.col("start"), F.col("kind")).otherwise(-2)
    held = in_blocks.join(base_blocks, ["row", "block"]).where((F.col("s") < F.col("end")) & (F.col("start") < F.col("e")))
    held = held.groupBy("row", "start", "end").agg(F.max(F.struct(state.alias("kind"), "whole")).alias("top"))
    each = tokens.join(held, ["row", "start", "end"], "left").where(F.coalesce(F.col("top.kind"), F.lit(-1)) != -2)
    known = F.col("top.kind").isNotNull()
    seed = ~known & F.col("before").rlike(SECRET_BEFORE) & (F.length("value") >= SECRET_LENGTH)
    return each.select("row", "start", "end", F.when(known, F.col("top.whole")).otherwise(F.col("value")).alias("value"), F.when(known, F.col("top.kind")).when(seed, SECRET).alias("kind"), F.explode(_cues(F.col("before"), F.col("after"))).alias("cue"))


def cue_places(docs: DataFrame, cues: DataFrame, text_col: str) -> DataFrame:
    """cue, places: how often each cue (a table of a column cue) stands in the texts, whatever is beside it.

    Words come with the word before them; only those that end a cue go on.
    """
    words = F.split(F.lower(F.regexp_replace(text_of(text_col), "[0-9]", "0")), r"[\x20\x09-\x0D]+")
    nothing = F.array(F.lit(None).cast("string"))
    each = docs.select(words.alias("w")).select(F.inline(F.arrays_zip(F.col("w").alias("word"), F.concat(nothing, "w").alias("last"))))
    ends = small(stored(cues.select(F.regexp_extract("cue", "[^ ]*$", 0).alias("word")).distinct()))
    kept = each.join(ends, "word", "left_semi")
    pair = F.when(F.col("last") != "", F.concat("last", F.lit(" "), "word"))
    after = F.when(F.col("last").isNotNull(), F.concat(F.lit(AFTER), "word"))
    seen = kept.select(F.explode(F.array("word", pair, after)).alias("cue")).where("cue is not null")
    return seen.join(cues, "cue", "left_semi").groupBy("cue").agg(F.count(F.lit(1)).alias("places"))


def bootstrap(docs: DataFrame, found: DataFrame, text_col: str = "text", *, rounds: int = 3, least: int = 5, sure: float = 0.8, accept: float = 0.9) -> DataFrame:
    """row, kind, start, end of identifiers beside which a pattern stands and that no base span covers.

    least: how many distinct known instances a pattern needs; sure: its confidence, over all places where it stands; accept: the
    score that makes an instance known.
    """
    edges = stored(context_edges(found))
    graph = stored(edges.groupBy("cue", "value").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("places")))
    # Cues that have enough seeds of one kind among their identifiers; only these are counted over all texts.
    share = graph.groupBy("cue").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n{k}") for k in range(len(KINDS))))
    most = F.greatest(*(f"n{k}" for k in range(len(KINDS))))
    likely = stored(share.where((most >= least) & (most >= 0.3 * F.col("n"))).select("cue"))
    none = found.where("false").select("row", "kind", "start", "end")
    if likely.isEmpty():
        return none
    everywhere = cue_places(docs, small(likely), text_col)
    narrowed = graph.join(small(likely), "cue", "left_semi")
    plain = narrowed.groupBy("cue").agg(F.sum("places").alias("with_value")).join(everywhere, "cue").select("cue", F.greatest(F.col("places") - F.col("with_value"), F.lit(0)).alias("plain"))
    plain = stored(plain)
    known = stored(narrowed.where("kind is not null").select("value", "kind", F.lit(1.0).alias("score")).distinct())
    patterns = None
    for _ in range(rounds):
        scored = narrowed.select("cue", "value").join(known, "value")
        sums = scored.groupBy("cue", "kind").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("seeds"))
        sizes = narrowed.groupBy("cue").agg(F.count(F.lit(1)).alias("n")).join(plain, "cue")
        confidence = F.col("mass") / (F.col("n") + F.col("plain"))
        patterns = stored(sums.join(sizes, "cue").where((F.col("seeds") >= least) & (confidence >= sure)).select("cue", "kind", F.least(confidence, F.lit(0.99)).alias("confidence")))
        reached = narrowed.where("kind is null").select("cue", "value").join(small(patterns), "cue")
        fresh = reached.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        best = Window.partitionBy("value").orderBy(F.desc("score"), "kind")
        fresh = fresh.where(F.col("score") >= accept).withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")
        known = stored(known.where("score = 1.0").unionByName(fresh.where("score < 1.0").select("value", "kind", "score")))
    known = known.where((F.col("score") < 1.0) | (F.col("kind") == SECRET)).select("value", F.col("kind").alias("its"))
    free = edges.where(F.col("kind").isNull() | (F.col("kind") == SECRET)).drop("kind")
    reliable = free.join(small(patterns), "cue").join(known, "value")
    return reliable.where("kind = its").select("row", "kind", "start", "end").distinct()


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, base and spans (arrays of start, kind, end, by start, then kind) of every row of docs."""
    rows, found = matches(docs, id_col, text_col)
    base = found.where(F.col("kind") < len(BASE)).select("row", "kind", "start", "end", F.lit(True).alias("base"))
    added = bootstrap(docs, found, text_col, **options).select("row", "kind", "start", "end", F.lit(False).alias("base"))
    span = F.struct("start", "kind", "end")
    spans = base.unionByName(added).groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
    empty = F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)")
    return rows.join(spans, "row", "left").select("id", F.coalesce("base", empty).alias("base"), F.coalesce("spans", empty).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
