"""Toxicity from a learned lexicon, matched by a Levenshtein automaton over a trie, with scores of the words around.

The lexicon is learned from labelled texts: words, and word stems, that many toxic and few clean texts hold. Its trie is
walked in step with the Levenshtein automaton of each distinct word of a text, so misspelled terms are found without
comparing the word to every term; words that clean texts use too are known not to be misspellings. A hit within quotation
marks, or next to words that clean texts have around such hits (someone is quoted), counts as quotation, not as abuse. A logistic
regression on these few counts, fitted on a bounded sample of the labelled rows, gives the score.

Defined results: null and empty texts have no hits and get the score of a text without hits; without toxic labels every
score is 0; labels that are null or no number, ids without a label, and ids with unlike labels teach nothing, so reruns agree; texts that
have both labels count under both; very long texts are read whole; repeated rows get equal scores; null ids are kept; empty input
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small, stored

#: Words (runs of letters and digits) and quotation marks.
TOKEN = re.compile(r"[^\W_]+|[\"“”„«»‹›]")
QUOTES = frozenset('"“”„«»‹›')
STEMS = range(4, 8)
#: Partial counts of a task go out when they have so many entries.
HELD_COUNTS = 300_000
#: Words whose match a worker keeps; when there are more, it starts anew.
KEPT_WORDS = 300_000
FEATURES = 8


class Trie:
    """Terms by letters. A term that ends in * is a stem: it matches any word that starts with it."""

    def __init__(self, terms: list[str]):
        self.terms, self.next, self.word, self.stem = terms, [{}], [-1], [-1]
        for n, term in enumerate(terms):
            at = 0
            for c in term.removesuffix("*"):
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({}), self.word.append(-1), self.stem.append(-1)
                at = self.next[at][c]
            (self.stem if term.endswith("*") else self.word)[at] = n


class Automaton:
    """The Levenshtein automaton of up to `bound` errors, intersected with a trie and made deterministic as words need it.

    A state is a set of (place in the trie, errors so far). Most words leave the automaton after a few letters, and states that were
    reached once are kept, so a word costs a look-up for each letter.
    """

    def __init__(self, trie: Trie, bound: int):
        self.trie, self.bound, self.ids = trie, bound, {}
        self.steps: list[dict[str, int]] = []
        self.places: list[dict[int, int]] = []
        self.ends: list[tuple[int, int, int] | None] = []
        self.stems: list[int] = []
        self.start = self._state({0: 0})

    def _state(self, places: dict[int, int]) -> int:
        """The number of the state, or -1 for the empty one. A letter that is missing from the word takes an error and nothing else."""
        todo = list(places.items())
        while todo:
            at, errors = todo.pop()
            if errors < self.bound:
                for below in self.trie.next[at].values():
                    if places.get(below, self.bound + 1) > errors + 1:
                        places[below] = errors + 1
                        todo.append((below, errors + 1))
        if not places:
            return -1
        key = frozenset(places.items())
        if key not in self.ids:
            self.ids[key] = len(self.steps)
            self.steps.append({})
            self.places.append(places)
            self.ends.append(min(((e, 0, self.trie.word[at]) for at, e in places.items() if self.trie.word[at] >= 0), default=None))
            self.stems.append(max((self.trie.stem[at] for at, e in places.items() if e == 0), default=-1))
        return self.ids[key]

    def _step(self, state: int, letter: str) -> int:
        after: dict[int, int] = {}

        def reach(at: int, errors: int) -> None:
            if errors <= self.bound and after.get(at, self.bound + 1) > errors:
                after[at] = errors

        for at, errors in self.places[state].items():
            reach(at, errors + 1)
            for c, below in self.trie.next[at].items():
                reach(below, errors + (c != letter))
        found = self.steps[state][letter] = self._state(after)
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        """Term and errors of the closest term, or None; of equally close ones a whole word goes before a stem."""
        at, stem, steps, stems = self.start, -1, self.steps, self.stems
        for letter in word:
            to = steps[at].get(letter)
            at = self._step(at, letter) if to is None else to
            if at < 0:
                break
            if stems[at] >= 0:
                stem = stems[at]
        end = self.ends[at] if at >= 0 else None
        if stem >= 0 and (end is None or end[0] > 0):
            return stem, 0
        return None if end is None else (end[2], end[0])


@dataclass
class ToxicityModel:
    """terms with their log odds; benign: words that resemble terms but are used in clean texts; context: log odds of the words
    around hits; weights: of the logistic regression, the constant last."""

    terms: list[str] = field(default_factory=list)
    odds: list[float] = field(default_factory=list)
    benign: frozenset[str] = frozenset()
    context: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)
    window: int = 5

    def __post_init__(self):
        trie = Trie(self.terms)
        self.automata = [Automaton(trie, bound) for bound in range(3)]
        self.kept: dict[str, tuple[int, int] | None] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("automata", "kept")}

    def match(self, word: str) -> tuple[int, int] | None:
        """Term and errors: none are allowed below 5 letters, two from 12 on."""
        n = len(word)
        return self.automata[0 if n < 5 else 1 if n < 12 else 2].match(word)

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def hits(self, tokens: list[str]) -> list[tuple[int, int, int, bool]]:
        """place, term, distance, whether within quotation marks."""
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        kept, hit = self.kept, {}
        for word in set(tokens):
            try:
                one = kept[word]
            except KeyError:
                one = kept[word] = None if word in self.benign or word in QUOTES else self.match(word)
            if one:
                hit[word] = one
        if not hit:
            return []
        found, quoted, marks = [], False, {}
        for at, word in enumerate(tokens):
            if word in QUOTES:
                quoted = not quoted
                marks[at] = quoted
            elif word in hit:
                found.append((at, *hit[word], quoted))
        if quoted:  # the last mark opens a quotation that never ends
            last = max(marks)
            found = [(at, t, d, q and at < last) for at, t, d, q in found]
        return found

    def features(self, text: str) -> list[float]:
        tokens = TOKEN.findall(text.lower())
        found = self.hits(tokens)
        if not found:
            return [0.0] * FEATURES
        plain = near = quoted = total = about = 0.0
        top = 0.0
        for at, term, distance, within in found:
            around = [self.context.get(w, 0.0) for w in tokens[max(0, at - self.window) : at] + tokens[at + 1 : at + 1 + self.window]]
            score = sum(around) / max(1, len(around))
            about += score
            if within:
                quoted += 1
            elif distance:
                near += 1
            else:
                plain += 1
            if not within:
                total += self.odds[term] / (1 + distance)
                top = max(top, self.odds[term] / (1 + distance))
        return [math.log1p(plain), math.log1p(near), math.log1p(quoted), math.log1p(total), top, about / len(found), float(plain > 0), 100 * (plain + near) / (100 + len(tokens))]

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        x = sum(a * b for a, b in zip(self.features(text), self.weights)) + self.weights[-1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _counted(rows: DataFrame, find, schema: str) -> DataFrame:
    """Counts of what find(text) gives (keys), for clean and toxic texts apart. rows: text, toxic. Each task adds up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            made = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[0][k] for k in keys], pa.int64()), pa.array([counts[1][k] for k in keys], pa.int64())], ["key", "clean", "toxic"])
            counts[0].clear(), counts[1].clear()
            return made

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic].update(find(text))
                if len(counts[0]) + len(counts[1]) > HELD_COUNTS:
                    yield out()
        yield out()

    parts = rows.select("text", "toxic").mapInArrow(run, schema)
    return parts.groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _unquoted(tokens: list[str]) -> list[str]:
    """The words that don't stand between quotation marks; a last mark without a partner opens nothing."""
    marks = [at for at, word in enumerate(tokens) if word in QUOTES]
    ends = [0, *marks[: len(marks) // 2 * 2], len(tokens)]
    return [word for a, b in zip(ends[::2], ends[1::2]) for word in tokens[a:b] if word not in QUOTES]


def _terms_of(text: str) -> set[str]:
    """Words and stems of the text outside quotations."""
    tokens = TOKEN.findall(text.lower())
    words = set(tokens) if QUOTES.isdisjoint(tokens) else set(_unquoted(tokens))
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}


def log_odds(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))


def families(sketches: list[list[int]], band: int = 4) -> np.ndarray:
    """A number for each text: texts that agree on a band of min-hashes (near copies, mostly) have the same one."""
    parent = list(range(len(sketches)))

    def find(n: int) -> int:
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    first: dict[tuple, int] = {}
    for n, sketch in enumerate(sketches):
        for k in range(0, len(sketch), band):
            a, b = find(n), find(first.setdefault((k, *sketch[k : k + band]), n))
            parent[max(a, b)] = min(a, b)
    return np.array([find(n) for n in range(len(sketches))], np.int64)


def sketch_of(text: str, size: int = 16) -> list[int]:
    """Min-hashes of the text's words."""
    from xxhash import xxh64_intdigest

    words = np.array([xxh64_intdigest(w) for w in set(TOKEN.findall(text.lower()))] or [0], np.uint64)
    return [int((words * np.uint64(2 * k + 0x9E3779B97F4A7C15) >> np.uint64(1)).min()) for k in range(size)]


def choose_terms(holders: dict[str, np.ndarray], odds: dict[str, float], most: int, times: int = 3, least: int = 3) -> list[str]:
    """Up to `most` terms that together cover each text up to `times` times, by greedy choice; each must add `least` texts.

    holders: the numbers of the texts, or of their families, that hold a term. What a group of near copies has in common, once
    covered, adds no terms; where families are given, it is one text from the start.
    """
    lacking = np.full(1 + max((int(h.max()) for h in holders.values()), default=-1), times)
    gains = {t: len(h) for t, h in holders.items() if len(h) >= least}
    # A stem whose texts nearly all hold one longer term says no more than that term, but matches more by chance.
    longest: dict[str, int] = {}
    for term, gain in gains.items():
        letters = term.removesuffix("*")
        for k in STEMS:
            if k < len(letters):
                longest[f"{letters[:k]}*"] = max(gain, longest.get(f"{letters[:k]}*", 0))
    gains = {t: g for t, g in gains.items() if longest.get(t, 0) < 0.8 * g}
    queue = sorted(gains, key=lambda t: (gains[t], odds[t], not t.endswith("*"), t), reverse=True)
    chosen, heap = [], [(-gains[t], at, t) for at, t in enumerate(queue)]  # sorted, so a heap
    looks = 0
    while heap and len(chosen) < most:
        *_, term = heapq.heappop(heap)
        gain = int((lacking[holders[term]] > 0).sum())
        if gain < least:
            continue
        if heap and gain < -heap[0][0]:  # its gain fell: look again when the others have had their turn
            looks += 1
            heapq.heappush(heap, (-gain, -looks, term))
            continue
        chosen.append(term)
        lacking[holders[term]] -= 1
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> list[float]:
    """Weights, the constant last, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(y) + ridge / 10 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge / 10 * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    return w.tolist()


def fit_toxicity(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", *, max_terms: int = 1000, max_texts: int = 4000, window: int = 5) -> ToxicityModel:
    """A model from rows with a text and a label 0 or 1.

    Equal texts of a label count once. Counts of words, and of words around hits, cover all texts; every clean word that resembles a
    term, and every word that is around hits of five texts, is kept. max_texts: how many toxic, and how many clean texts (those with the
    smallest hash) choose the terms, from all keys that `least` of them hold, and fit the regression; max_terms: the size of the lexicon.
    """
    rows = labelled.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("toxic in (0, 1)")
    rows = stored(rows.distinct()).withColumn("hash", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return ToxicityModel()
    counts = stored(_counted(rows, _terms_of, "key string, clean long, toxic long"))
    strength = F.log((F.col("toxic") + 0.5) / (totals[1] + 1)) - F.log((F.col("clean") + 0.5) / (totals[0] + 1))

    def sample(toxic: int) -> DataFrame:
        # Twice the texts wanted, by a share of the hash range.
        share = min(1.0, 2 * max_texts / totals[toxic])
        return rows.where(F.col("toxic") == toxic).where(F.col("hash") < int(share * (1 << 40)))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sketch_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["hash", "sketch"])

    sketches = sorted((r["hash"], r["sketch"]) for r in sample(1).select("hash", "text").mapInArrow(sketched, "hash long, sketch array<long>").collect())[:max_texts]
    hashes = [h for h, _ in sketches]
    family = families([k for _, k in sketches])

    def own_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = list(_terms_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(keys), pa.int64()), pa.array(keys, pa.string())], ["hash", "key"])

    own = sample(1).where(F.col("hash") <= hashes[-1]).select("hash", "text").mapInArrow(own_terms, "hash long, key string")
    own = own.groupBy("key").agg(F.collect_list("hash").alias("held")).where("size(held) >= 3")
    strong = counts.where("toxic >= 3").withColumn("odds", strength).where("odds >= 3").select("key", "odds")
    found = own.join(strong, "key").toArrow()
    keys = found.column("key").to_pylist()
    odds = dict(zip(keys, found.column("odds").to_pylist()))
    number = np.asarray(hashes)
    # A term must stand in texts that are unlike each other, so it is held by families of near copies.
    holders = {key: np.unique(family[np.searchsorted(number, held.values.to_numpy())]) for key, held in zip(keys, found.column("held"))}
    terms = choose_terms(holders, odds, max_terms)
    model = ToxicityModel(terms, [odds[t] for t in terms], window=window)

    # Words of clean texts that the automaton takes for a term, and that toxic texts have no more often, are no misspellings.
    def resembling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool((hit := model.match(word)) and hit[1]) for word in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    seen = counts.where("clean > 0 and not endswith(key, '*')").withColumn("odds", strength).where("odds < 2").select("key", "clean")
    benign = seen.mapInArrow(resembling, "key string, clean long").select("key").collect()
    model = ToxicityModel(terms, model.odds, frozenset(r["key"] for r in benign), window=window)

    def around(text: str) -> set[str]:
        tokens = TOKEN.findall(text.lower())
        places = [at for at, *_ in model.hits(tokens)]
        return {w for at in places for w in tokens[max(0, at - window) : at] + tokens[at + 1 : at + 1 + window]} - {tokens[at] for at in places}

    near = _counted(rows, around, "key string, clean long, toxic long").where("clean + toxic >= 5").orderBy("key").collect()
    clean_hits, toxic_hits = sum(r["clean"] for r in near), sum(r["toxic"] for r in near)
    context = {r["key"]: log_odds(r["toxic"], r["clean"], toxic_hits, clean_hits) for r in near} if clean_hits else {}
    model = ToxicityModel(terms, model.odds, model.benign, context, window=window)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["hash", "toxic", "x"])

    fitted = []
    for toxic in (0, 1):
        got = sample(toxic).select("hash", "toxic", "text").mapInArrow(featured, "hash long, toxic int, x array<double>").collect()
        fitted += sorted(got, key=lambda r: (r["hash"], r["x"]))[:max_texts]
    y = np.array([r["toxic"] for r in fitted], float)
    model.weights = fit_logistic(np.array([r["x"] for r in fitted]), y)
    return model


def toxicity_of(spark: SparkSession, model: ToxicityModel) -> Callable[[Column], Column]:
    """A function from a text column to its scores."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t or "") for t in texts], dtype=float)

    return lambda text: score(text.cast("string"))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of every row of docs."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), toxicity_of(docs.sparkSession, model)(F.col(f"`{text_col}`")).alias("score"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """docs with a score below the limit, all columns kept."""
    return docs.where(toxicity_of(docs.sparkSession, model)(F.col(f"`{text_col}`")) < limit)


def fold_is(key: Column, folds: int, held: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(folds)) == held


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, folds: int = 5, held: int = 0, **options) -> ToxicityModel:
    """A model from the labelled rows outside the held-out fold (crc32 of the id modulo folds)."""
    marked = labels.select(F.col(f"`{id_col}`").alias("__id"), F.expr(f"try_cast(`{label_col}` as int)").alias("__label"))
    marked = marked.groupBy("__id").agg(F.min("__label").alias("__label"), F.max("__label").alias("__top")).where("__label = __top").drop("__top")
    marked = small(stored(marked), 1_000_000)
    rows = docs.select(F.col(f"`{id_col}`").alias("__doc"), F.col(f"`{text_col}`").alias("text")).where(~fold_is(F.col("__doc"), folds, held))
    joined = rows.join(marked, F.col("__doc") == F.col("__id")).select("text", F.col("__label").alias("toxic"))
    return fit_toxicity(joined, "text", "toxic", **options)


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 5, held: int = 0, **options) -> DataFrame:
    """id, held_out, score, predicted of every row of docs."""
    model = learn(docs, labels, id_col, text_col, folds=folds, held=held, **options)
    found = toxicity_scores(docs, model, id_col, text_col)
    return found.select("id", fold_is(F.col("id"), folds, held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
