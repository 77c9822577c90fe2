"""Literals that a regular expression can't match without, and an index of trigrams that tells which files may hold them.

Of an expression's parts that each match has, the one whose shortest text is longest is required: any of its texts (a few characters each)
must be in the file. Texts are compared in folded case, so nothing that matches is passed over; an expression without such a part is tried
on every file.

The index is a table of blocks. A block is some thousand contents that one task read, numbered from 0, and has a row for each gram (three
bytes in a row of a folded text) with the numbers of the contents that hold it, and one of gram -1 with all numbers and digests. So a posting
takes a small number instead of a digest, nothing is shuffled to build the index, and as a task sorts its rows by gram, a lookup reads the
row groups of its few grams. Contents that it knows aren't read again. A literal's files are those that hold all its grams, found by
intersecting the lists of each block; a detector's are those of any of its literals.

Defined results: null contents count as empty; contents under three bytes have no grams, and no detector with literals; files that share
a digest share their postings; an empty table gives an empty index; adding the same files again changes nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.plans.store import Versions, stored

#: At most so many texts for a part, and characters of a class.
_MOST, _CLASS = 64, 8


#: Letters beyond ASCII that an expression that ignores case takes for the ASCII ones below.
_LIKE, _ASCII = "\u017f\u212a\u0131\u0130", "skii"


def folded(content: Column) -> Column:
    """content so that what a regular expression takes for the same letter is the same letter."""
    return F.lower(reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), zip(_LIKE, _ASCII), content))


def fold(text: str) -> str:
    return text.translate(str.maketrans(_LIKE, _ASCII)).lower()


def literals(pattern: str) -> tuple[str, ...]:
    """Folded texts of three characters or more, one of which is in whatever the (Java) expression matches; none if there is no such set."""
    if re.search(r"&&|\[[^\]\\]*\[|\(\?[a-zA-Z]*x", pattern):  # classes within classes and free spacing are read in another way there
        return ()
    try:
        tree = re._parser.parse(re.sub(r"\(\?[a-zA-Z]+\)", "", pattern))
    except (re.error, RecursionError):
        return ()
    found = _required(tree)
    return tuple(sorted(found)) if found and min(map(len, found)) >= 3 else ()


def _required(tree) -> set[str]:
    """The best set of texts of a sequence: runs of literals and small classes, or what one of its groups requires."""
    best: set[str] = set()
    run = {""}

    def better(new: set[str]) -> None:
        nonlocal best
        if new and (not best or min(map(len, new)) > min(map(len, best))):
            best = new

    for op, value in tree:
        op = str(op)
        nexts = _texts(op, value)
        if nexts is not None and len(run) * len(nexts) <= _MOST:
            run = {a + b for a, b in product(run, nexts)}
            continue
        better(run)
        run = {""} if nexts is None or len(nexts) > _MOST else set(nexts)
        if nexts is None:
            if op == "SUBPATTERN":
                better(_required(value[-1]))
            elif op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                better(_required(value[2]))
            elif op == "BRANCH":
                parts = [_required(part) for part in value[1]]
                if all(parts):
                    better(set().union(*parts))
    better(run)
    return {x for x in best if x} if all(best) else set()


def _texts(op: str, value) -> set[str] | None:
    """All texts of a part of the expression, if they are few; None if not."""
    if op == "LITERAL":
        return {fold(chr(value))}
    if op == "AT":
        return {""}
    if op == "IN":
        found: set[str] = set()
        for kind, v in value:
            if str(kind) == "LITERAL":
                found.add(fold(chr(v)))
            elif str(kind) == "RANGE" and v[1] - v[0] < _CLASS:
                found |= {fold(chr(c)) for c in range(v[0], v[1] + 1)}
            else:
                return None
        return found if len(found) <= _CLASS else None
    if op == "SUBPATTERN":
        return _sequence(value[-1])
    if op == "BRANCH":
        parts = [_sequence(part) for part in value[1]]
        return None if any(p is None for p in parts) or sum(map(len, parts)) > _MOST else set().union(*parts)
    if op in ("MAX_REPEAT", "MIN_REPEAT") and value[1] == 1:
        inner = _sequence(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _sequence(tree) -> set[str] | None:
    found = {""}
    for op, value in tree:
        texts = _texts(str(op), value)
        if texts is None or len(found) * len(texts) > _MOST:
            return None
        found = {a + b for a, b in product(found, texts)}
    return found


def may_match(text: Column, pattern: str) -> Column:
    """Whether a folded text holds one of the literals that the expression requires."""
    return reduce(Column.__or__, (text.contains(x) for x in literals(pattern)), F.lit(not literals(pattern)))


def _grams(text: str) -> np.ndarray:
    data = np.frombuffer(fold(text).encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    return np.unique(data[:-2] << 16 | data[1:-1] << 8 | data[2:])


def grams(text: str) -> list[int]:
    """Three bytes in a row as a number each, without repeats."""
    return _grams(text).tolist()


#: A block has at most so many contents, and postings but for its last content. Digests that meet texts by a broadcast of their hashes.
_CONTENTS, _POSTINGS, _BROADCAST = 16384, 1 << 21, 500_000


def of_digests(files: DataFrame, digests: DataFrame) -> DataFrame:
    """The files whose digest is in a stored table, and perhaps others (whose hash is equal). Up to a bounded number of digests, no text moves."""
    if digests.limit(_BROADCAST + 1).count() > _BROADCAST:
        return files.join(digests, "digest", "left_semi")
    hashes = digests.select(F.xxhash64("digest").alias("__h"))
    return files.join(F.broadcast(hashes), F.xxhash64(files["digest"]) == F.col("__h"), "left_semi")


def _block(digests: list[str], found: list[np.ndarray]) -> pa.RecordBatch:
    """The rows of a block: found has the grams of each of its contents."""
    sizes = [len(g) for g in found]
    keys = np.sort(np.concatenate(found) << 32 | np.repeat(np.arange(len(found), dtype=np.int64), sizes)) if sum(sizes) else np.empty(0, np.int64)
    all_grams = keys >> 32
    starts = np.flatnonzero(np.diff(all_grams, prepend=-1))
    n = len(digests)
    numbers = np.concatenate([np.arange(n), keys & 0xFFFFFFFF]).astype(np.int32)
    offsets = np.concatenate([[0], starts + n, [len(numbers)]]).astype(np.int32)
    columns = [pa.array(np.concatenate([[-1], all_grams[starts]]).astype(np.int32)), pa.array([uuid.uuid4().hex] * (len(starts) + 1)), pa.ListArray.from_arrays(offsets, pa.array(numbers)), pa.array([digests] + [None] * len(starts), pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["gram", "block", "numbers", "digests"])


class TrigramIndex:
    """Blocks in a folder that all executors share. Each add() writes a version beside the ones before; compact() makes them one."""

    SCHEMA = "gram int, block string, numbers array<int>, digests array<string>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path, self.SCHEMA)

    def postings(self) -> DataFrame:
        """gram, digest, each once; gram -1 for every content."""
        rows = self.versions.read().select("gram", "block", F.explode("numbers").alias("number"))
        return self._named(rows).select("gram", "digest").distinct()

    def _named(self, rows: DataFrame) -> DataFrame:
        """rows (block, number) with their digest."""
        names = self.versions.read().where("gram = -1").select("block", F.posexplode("digests").alias("number", "digest"))
        return rows.join(names, ["block", "number"])

    def known(self) -> DataFrame:
        """The digests in the index."""
        return self.versions.read().where("gram = -1").select(F.explode("digests").alias("digest")).distinct()

    def _arranged(self, rows: DataFrame) -> DataFrame:
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartitionByRange(parts, "gram", "block").sortWithinPartitions("gram", "block")

    def add(self, files: DataFrame) -> DataFrame:
        """Indexes the files (content, digest) that are new; returns them. A content that two new files have may be in two blocks."""
        new = files
        if self.versions.numbers():
            digests = stored(files.select("digest").distinct().join(self.known(), "digest", "left_anti"))
            new = of_digests(files, digests)
            if digests.isEmpty():
                return files.join(digests, "digest", "left_semi")
        elif files.isEmpty():
            return new

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            digests, found, size = [], [], 0
            for batch in batches:
                for digest, content in zip(*(c.to_pylist() for c in batch.columns)):
                    digests.append(digest)
                    found.append(_grams(content or ""))
                    size += len(found[-1])
                    if size >= _POSTINGS or len(digests) == _CONTENTS:
                        yield _block(digests, found)
                        digests, found, size = [], [], 0
            if digests:
                yield _block(digests, found)

        self.versions.add(new.select("digest", "content").mapInArrow(run, self.SCHEMA).sortWithinPartitions("gram", "block"))
        return new

    def compact(self) -> None:
        self.versions.replace(self._arranged)

    def candidates(self, patterns: dict[str, str]) -> DataFrame:
        """name, digest: the contents that each of the named expressions may match. An expression without literals has all."""
        wanted = [(name, n, gram, len(grams(text))) for name, p in patterns.items() for n, text in enumerate(literals(p)) for gram in grams(text)]
        free = [F.lit(name) for name, p in patterns.items() if not literals(p)]
        table = self.spark.createDataFrame(wanted, "name string, n int, gram int, need int")
        met = self.versions.read().where(F.col("gram").isin(sorted({w[2] for w in wanted}))).select("gram", "block", "numbers").join(F.broadcast(table), "gram")
        whole = met.groupBy("name", "n", "need", "block").agg(F.collect_list("numbers").alias("lists")).where(F.size("lists") == F.col("need"))
        both = F.aggregate(F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(1))), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
        found = self._named(whole.select("name", "block", F.explode(both).alias("number")).distinct()).select("name", "digest").distinct()
        return found.unionByName(self.known().select(F.explode(F.array(*free)).alias("name"), "digest")) if free else found
