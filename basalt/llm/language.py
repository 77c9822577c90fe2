"""Language identification with a string kernel.

Two texts are alike by the n-grams (1 to 3 letters, a blended spectrum) that are present in both: k(x, y) = |X & Y| /
sqrt(|X| |Y|). Nyström landmarks (some texts of each language) turn the kernel into a short feature vector, and a
one-versus-rest kernel ridge regression on a bounded sample of labelled texts gives a weight vector for each
language. A batch of texts is scored by two matrix products: presence of the landmarks' n-grams times the landmarks'
incidence, and the kernel values times the weights. Both factors of the first are sparse, and are kept and multiplied so: for each n-gram
of the vocabulary, the landmarks that hold it.

Defined results: null texts and texts without a letter are `und` with score 0, as are all texts where nothing could be
learned; ties go to the language that sorts first; null ids are in the training fold of the text ''; repeated rows get equal
predictions; very long texts count with all their n-grams; empty input gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_LETTERS = regex.compile(r"\P{L}+")
#: The same for Spark: what NOT_LETTERS leaves.
LETTER = r"\p{L}"
#: More than there are code points, so three letters are one number of 63 bits; 1 is the end of a word.
CLASSES = 1 << 21
NO_LANGUAGE = "und"


class Spectrum:
    """The distinct n-grams of whole texts, as numbers below CLASSES ** 3; unlike n-grams have unlike numbers."""

    def __init__(self):
        self.table = np.arange(0x110000, dtype=np.int64)
        self.table[ord(" ")] = 1

    def grams(self, text: str) -> np.ndarray:
        letters = NOT_LETTERS.sub(" ", text.lower()).strip()
        if not letters:
            return np.zeros(0, np.int64)
        one = self.table[np.frombuffer(f" {letters} ".encode("utf-32-le", "replace"), np.uint32)]
        two = one[:-1] * CLASSES + one[1:]
        return np.unique(np.concatenate([one, two, two[:-1] * CLASSES + one[2:]]))


_SPECTRUM: list[Spectrum] = []


def spectrum() -> Spectrum:
    if not _SPECTRUM:
        _SPECTRUM.append(Spectrum())
    return _SPECTRUM[0]


@dataclass
class Incidence:
    """vocab: sorted n-grams of the landmarks; those at n are in the landmarks `marks[starts[n]:starts[n + 1]]`; scale: 1 / sqrt of a landmark's n-grams."""

    vocab: np.ndarray
    starts: np.ndarray
    marks: np.ndarray
    scale: np.ndarray

    @classmethod
    def of(cls, landmarks: list[np.ndarray]) -> Incidence:
        sizes = [len(g) for g in landmarks]
        grams, held = np.concatenate([*landmarks, np.zeros(0, np.int64)]), np.repeat(np.arange(len(landmarks), dtype=np.int32), sizes)
        order = np.argsort(grams, kind="stable")
        vocab, starts = np.unique(grams[order], return_index=True)
        return cls(vocab, np.append(starts, len(grams)), held[order], 1 / np.sqrt(np.maximum(sizes, 1)))

    def product(self, found: list[np.ndarray]) -> np.ndarray:
        """How many n-grams each text shares with each landmark, over the root of the landmark's number."""
        shared = np.zeros((len(found), len(self.scale)))
        for row, grams in enumerate(found):
            at = np.searchsorted(self.vocab, grams)
            at = at[at < len(self.vocab)] if len(at) and at[-1] == len(self.vocab) else at
            at = at[self.vocab[at] == grams[: len(at)]]
            counts = self.starts[at + 1] - self.starts[at]
            # the places of all landmarks of all hits: for each hit a run of consecutive numbers
            places = np.arange(counts.sum()) + np.repeat(self.starts[at] - np.cumsum(counts) + counts, counts)
            shared[row] = np.bincount(self.marks[places], minlength=len(self.scale))
        return shared * self.scale


@dataclass
class LanguageModel:
    """languages; incidence of the landmarks; weights: landmarks x languages."""

    languages: list[str]
    incidence: Incidence
    weights: np.ndarray

    def kernel(self, found: list[np.ndarray]) -> np.ndarray:
        sizes = np.sqrt(np.maximum([len(g) for g in found], 1))
        return self.incidence.product(found) / sizes[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [spectrum().grams(t or "") for t in texts]
        if not self.languages:
            return [NO_LANGUAGE] * len(texts), [0.0] * len(texts)
        values = self.kernel(found) @ self.weights
        best = values.argmax(1)
        score = np.clip((values[np.arange(len(texts)), best] + 1) / 2, 0, 1)
        known = [len(g) > 0 for g in found]
        return [self.languages[b] if k else NO_LANGUAGE for b, k in zip(best, known)], [float(s) if k else 0.0 for s, k in zip(score, known)]


def fit_language(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", *, per_language: int = 300, landmarks: int = 32, all_texts: int = 20_000, all_landmarks: int = 4096, ridge: float = 1e-3) -> LanguageModel:
    """A model from rows with text and language.

    Every language that has a text with a letter is learned. At most per_language distinct texts of each (those with the smallest
    hash of the text) come to the driver, as arrays of n-grams; landmarks of the texts of each language are the Nyström landmarks. Where languages are
    so many that this would exceed all_texts or all_landmarks, each language has an equal share of these, and at least 8 texts and one
    landmark. Texts without a letter teach nothing.
    """
    rows = labelled.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("text is not null and lang is not null").where(F.col("text").rlike(LETTER))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    texts = rows.groupBy("lang", "hash").count().groupBy("lang").agg(F.count("*").alias("texts"))
    counts = texts.collect()  # a row for each language
    if not counts:
        return LanguageModel([], Incidence.of([]), np.zeros((0, 0)))
    per_language = max(8, min(per_language, all_texts // len(counts)))
    landmarks = max(1, min(landmarks, all_landmarks // len(counts)))
    # Of languages with many texts, a share by hash that holds about twice the texts wanted, however often each is repeated.
    share = F.broadcast(texts.select(F.col("lang").alias("its"), F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("texts")).alias("share")))
    picked = rows.join(share, F.col("lang") == F.col("its")).where(F.pmod("hash", F.lit(1 << 40)) < F.col("share") * float(1 << 40))
    picked = picked.groupBy("lang", "hash").agg(F.min("text").alias("text"))  # copies count once
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 40)), "hash"))
    picked = picked.withColumn("place", first).where(F.col("place") <= per_language).select("text", "lang", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                grams = pa.array([spectrum().grams(t) for t in part.column(0).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), grams], ["lang", "place", "grams"])

    seen = picked.mapInArrow(run, "lang string, place int, grams array<long>").where("size(grams) > 0").toArrow().sort_by([("lang", "ascending"), ("place", "ascending")])
    by: dict[str, list[np.ndarray]] = {}
    for name, grams in zip(seen["lang"].to_pylist(), seen["grams"]):
        by.setdefault(name, []).append(grams.values.to_numpy())
    languages = sorted(by)
    texts = [g for name in languages for g in by[name]]
    truth = np.repeat(np.arange(len(languages)), [len(by[name]) for name in languages])
    marks = [g for name in languages for g in by[name][:landmarks]]
    model = LanguageModel(languages, Incidence.of(marks), np.zeros((len(marks), len(languages))))
    values, vectors = np.linalg.eigh(model.kernel(marks))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6))
    z = model.kernel(texts) @ whiten
    goal = np.where(truth[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Each language weighs the same, however many texts it has.
    weight = (1 / np.bincount(truth, minlength=len(languages)))[truth][:, None]
    solved = np.linalg.solve(z.T @ (weight * z) + ridge * np.eye(z.shape[1]), z.T @ (weight * goal))
    model.weights = whiten @ solved
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", *, batch_rows: int = 256) -> DataFrame:
    """id, lang_pred, score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                names, scores = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, folds: int = 4, held: int = 2, **options) -> DataFrame:
    """id, held_out, lang_pred, score; the model is learned from the rows of the other folds (crc32 of the id modulo folds)."""
    fold = F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), F.lit(folds)) == held
    model = fit_language(docs.where(~fold), text_col, lang_col, **options)
    found = identify(docs, model, id_col, text_col)
    return found.select("id", (F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(folds)) == held).alias("held_out"), "lang_pred", "score")
