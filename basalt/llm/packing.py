"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Each group of pieces is packed best-fit (longest first, into the fullest bin that still has room). Bins that are nearly full are
done; the others become items of a later round in fewer groups, and so on up a tree until one group is left or nothing
merges any more. A round only moves (bin, fill) rows. At the end the rounds' maps are composed and pieces get their
sequence and place. Every group is bounded by items_per_task at any input size.

Defined results: null and empty texts are one piece with just the end token; null ids and repeated rows are packed like any
other row; very long texts are cut into as many pieces as they need; empty input gives an empty result; other columns are carried
along, except that those named sequence_id or offset are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored, text_of

END_TOKEN = 1
#: Words of a text whose ids a worker keeps; when there are more, it starts anew.
CACHED_WORDS = 500_000


class WordTokenizer:
    """Token ids of whole texts from a tokenizer file whose tokens never cross white space.

    A text's ids are those of its white-space separated words in order, so ids are kept by word. Latin words go straight
    to the vocabulary's merges; all others through the whole tokenizer. A text that holds a special token's string goes through the
    whole tokenizer in one piece.
    """

    LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)", re.IGNORECASE)
        self.kept: dict[str, bytes] = {}
        # Byte-level vocabularies write bytes as printable characters: those that are printable as themselves, the others from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        shown = {b: chr(b if b in plain else next(others)) for b in range(256)}
        self.shown = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(192, 256)}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if (ids := self.kept.get(piece)) is None:
            ids = self.kept[piece] = array("I", [x.id for x in self.model.tokenize(piece.lower().translate(self.shown))]).tobytes()
        return ids

    def _word(self, word: str) -> bytes:
        if m := self.LATIN.fullmatch(word):
            ids = self._piece(m[1]) + (self._piece(m[2]) if m[2] else b"")
        else:
            ids = self._whole(word)
        self.kept[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The text's ids as unsigned 32-bit little-endian numbers."""
        if len(self.kept) > CACHED_WORDS:
            self.kept.clear()
        if self.special.search(text):
            return self._whole(text)
        kept, word = self.kept, self._word
        return b"".join([kept.get(w) or word(w) for w in re.split(r"[\x20\x09-\x0D]+", text) if w])


@cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096) -> DataFrame:
    """id, piece, start, length, ids (little-endian unsigned 32-bit numbers) of every document, cut at capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, step, end = _tokenizer(tokenizer_file), 4 * capacity, END_TOKEN.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                row, piece, start, length, ids = [], [], [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    all_ids = tokenizer.ids(text) + end
                    for n, i in enumerate(range(0, len(all_ids), step)):
                        cut = all_ids[i : i + step]
                        row.append(k), piece.append(n), start.append(i // 4), length.append(len(cut) // 4), ids.append(cut)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("body"))
    schema = T.StructType([rows.schema["id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    names = schema.names
    return rows.mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and the fill of each bin. Longest first, each into the bin with the least room that fits."""
    bins, offsets, fills = [0] * len(lengths), [0] * len(lengths), []
    with_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if some bin has room r
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        need = lengths[i]
        if fitting := rooms >> need:
            room = need + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, capacity - room
        room -= need
        fills[b] = capacity - room
        if room:
            with_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins, offsets, fills


def _round(items: DataFrame, groups: int, number: int, capacity: int) -> DataFrame:
    """items with a column length, packed in so many groups: adds bin, offset, fill (of the bin), first (one row of each bin)."""
    dealt = items.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    names = items.columns

    def run(rows: pa.Table) -> pa.Table:
        group = rows.column("__group")[0].as_py()
        bins, offsets, fills = best_fit(rows.column("length").to_pylist(), capacity)
        base = (number << 56) + (group << 32)
        first = [o == 0 for o in offsets]
        new = [pa.array([base + b for b in bins], pa.int64()), pa.array(offsets, pa.int64()), pa.array([fills[b] for b in bins], pa.int64()), pa.array(first, pa.bool_())]
        return pa.table([*(rows.column(n) for n in names), *new], names=[*names, "bin", "offset", "fill", "first"])

    schema = T.StructType([*items.schema.fields, T.StructField("bin", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("fill", T.LongType()), T.StructField("first", T.BooleanType())])
    return dealt.groupBy("__group").applyInArrow(run, schema)


def pack(items: DataFrame, capacity: int = 4096, *, slack: int = 16, fan_in: int = 8, items_per_task: int = 200_000) -> DataFrame:
    """items (a column length of 1 to capacity, and any others) with sequence_id and offset.

    slack: bins with at most so much room are done. fan_in: how many groups of a round meet in one of the next.
    """
    spark = items.sparkSession
    kept = [c for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    plain = {c: "length" if c == "length" else f"column_{k}" for k, c in enumerate(kept)}  # names that clash with none of the rounds'
    items = stored(items.select(*(F.col(f"`{c}`").alias(name) for c, name in plain.items())))
    back = [F.col(name).alias(c) for c, name in plain.items()]
    count = items.count()
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // items_per_task))
    placed = stored(_round(items, groups, 0, capacity))
    latest, maps, number = placed, [], 0
    while groups > 1:
        under = latest.where(F.col("first") & (F.col("fill") < capacity - slack)).select(F.col("bin").alias("item"), F.col("fill").alias("length"))
        left = under.count()
        fewer = max(-(-groups // fan_in), -(-left // items_per_task))
        if left < 2 or fewer >= groups:
            break
        number, groups = number + 1, fewer
        latest = stored(_round(under, groups, number, capacity))
        maps.append(latest)
    if not maps:
        return placed.select(*back, F.col("bin").alias("sequence_id"), "offset")
    root = maps[-1].select("item", F.col("bin").alias("root"), F.col("offset").alias("base"))
    for earlier in reversed(maps[:-1]):
        above = root.withColumnsRenamed({"item": "bin", "base": "above"})
        root = earlier.join(above, "bin", "left").select("item", F.coalesce("root", "bin").alias("root"), (F.col("offset") + F.coalesce("above", F.lit(0))).alias("base"))
    root = stored(root)
    return placed.join(root, F.col("bin") == F.col("item"), "left").select(*back, F.coalesce("root", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))


def sequences(cut: DataFrame, packed: DataFrame) -> DataFrame:
    """sequence_id and ids of each packed sequence. cut: pieces() of the documents; packed: pack() of their id, piece and length."""
    same = cut["id"].eqNullSafe(packed["id"]) & (cut["piece"] == packed["piece"])
    rows = packed.join(cut.select("id", "piece", "ids").dropDuplicates(["id", "piece"]), same).select("sequence_id", "offset", "ids")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["ids"]))
    return rows.groupBy("sequence_id").agg(joined.alias("ids"))
