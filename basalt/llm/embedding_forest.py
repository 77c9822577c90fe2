"""Near duplicates of embeddings through a forest of random-projection trees with spill.

Equal vectors are one class. A tree cuts the classes again and again along random directions; vectors within a margin of a cut go to both
sides (spill), so that a pair at the threshold is seldom parted, and `trees` independent trees find what one of them parts. Trees grow in
rounds: nodes with more than `leaf` vectors are sampled (at most `sample` vectors a node), a subtree is fitted to each sample in a task
of its own, and then every vector of the node is dealt along it. A node that no cut divides with little spill is a dense leaf.

In a leaf, tasks compare all vectors by cosine in double precision, in matrix products; a leaf of more than two blocks is compared block by
block, in as many tasks as it has pairs of blocks. Nothing is emitted for a pair: a task counts the links of each vector, leaving out
those pairs that met in an earlier leaf (each vector carries its leaves), and adds one edge from each linked vector to the smallest one
that it is joined with in the task. So dense groups are counted in full, and what moves is a row for each vector and block. The edges are
joined by hooking and pointer jumping.

Only the choice of candidates is approximate: of pairs at a cosine of 0.9, a tree with the defaults parts about 5 in 100 at each cut, and all eight
part fewer than 1 in 1000 (fewer still above 0.9). Counting all links of m mutually near vectors takes m * m products.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different lengths
never link; a huge or tiny vector is scaled before its norm is taken; rows with equal vectors link with each other; rows that repeat an id
are judged by their own vector; null ids never become a component's id unless all its ids are null; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_groups, small, stored
from .simhash import components

#: Directions and cuts that are tried at a node; a cut must leave at most this share of a node's comparisons; depth of a subtree.
_DIRECTIONS, _CUTS, _WORTH, _DEPTH = 3, (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8, 0.1, 0.9), 0.9, 9
#: A node's sample is cut no further once it has so few vectors.
_LEAST_SAMPLE = 48
#: Codes of nodes: the tree above, and the path below (a 1, then 0 or 1 for each cut).
_PATH_BITS = 54


def usable(vector: Column) -> Column:
    """Whether all components are finite numbers and one isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    scaled = vectors.astype(np.float64)
    scaled /= np.abs(scaled).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def below(node: int) -> int:
    """The code of a node's first child; the second has the next one."""
    return 2 * node - (node >> _PATH_BITS << _PATH_BITS)


def directions(code: int, dim: int, seed: int) -> np.ndarray:
    """The unit vectors that are tried at a node."""
    found = np.random.default_rng([seed, code, dim]).standard_normal((_DIRECTIONS, dim))
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def fit(sample: np.ndarray, code: int, size: int, leaf: int, margin: float, seed: int) -> dict[int, tuple[int, float]]:
    """Cuts of a subtree: node code to (direction, where), with direction -1 for a dense leaf. sample: unit vectors of the node's `size`."""
    cuts: dict[int, tuple[int, float]] = {}
    each, todo = size / max(1, len(sample)), [(code, np.arange(len(sample)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        if len(rows) * each <= leaf or len(rows) < _LEAST_SAMPLE or depth == _DEPTH:
            continue
        along = sample[rows] @ directions(node, sample.shape[1], seed).T
        best = (_WORTH, -1, 0.0)
        for k in range(_DIRECTIONS):
            ordered = np.sort(along[:, k])
            where = np.quantile(ordered, _CUTS)
            low = np.searchsorted(ordered, where + margin, "right") / len(rows)
            high = 1 - np.searchsorted(ordered, where - margin, "left") / len(rows)
            work = low**2 + high**2
            at = int(work.argmin())
            best = min(best, (float(work[at]), k, float(where[at])))
        cuts[node] = best[1:]
        if best[1] >= 0:
            side = along[:, best[1]]
            todo += [(below(node), rows[side <= best[2] + margin], depth + 1), (below(node) + 1, rows[side >= best[2] - margin], depth + 1)]
    return cuts


def deal(units: np.ndarray, code: int, cuts: dict[int, tuple[int, float]], margin: float, seed: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """The leaves below a node: (code, rows, whether it is dense)."""
    todo = [(code, np.arange(len(units)))]
    while todo:
        node, rows = todo.pop()
        direction, where = cuts.get(node, (-1, 0.0))
        if direction < 0 or not len(rows):
            if len(rows):
                yield node, rows, node in cuts
            continue
        along = units[rows] @ directions(node, units.shape[1], seed)[direction]
        todo += [(below(node), rows[along <= where + margin]), (below(node) + 1, rows[along >= where - margin])]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


_CUTS_OUT = pa.schema([("dim", pa.int32()), ("code", pa.int64()), ("codes", pa.list_(pa.int64())), ("ways", pa.list_(pa.int32())), ("wheres", pa.list_(pa.float64()))])
_PLACES_OUT = pa.schema([("key", pa.int64()), ("dim", pa.int32()), ("code", pa.int64()), ("dense", pa.bool_())])


def _round(rows: DataFrame, nodes: DataFrame, leaf: int, sample: int, spill: float, cosine: float, seed: int) -> DataFrame:
    """key, dim, code, dense: where the rows (key, vec, dim, code) of the nodes (dim, code, size) go.

    A node's sample is drawn by hash, at a rate that gives three quarters of `sample` vectors; of more than `sample` the first by hash are
    taken. All vectors are dealt, in parts of a node of some thousand vectors, each of which meets a copy of its node's cuts.
    """

    def margin(dim: int) -> float:
        return spill * (2 - 2 * cosine) ** 0.5 / dim**0.5

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        dim, code = (x.as_py() for x in key)
        table = table.sort_by("draw").slice(0, sample)
        cuts = fit(unit(_matrix(table["vec"])), code, table["size"][0].as_py(), leaf, margin(dim), seed)
        row = {"dim": dim, "code": code, "codes": list(cuts), "ways": [d for d, _ in cuts.values()], "wheres": [w for _, w in cuts.values()]}
        return pa.Table.from_pylist([row], _CUTS_OUT)

    def dealt(key: tuple, part: pa.Table, cut: pa.Table) -> pa.Table:
        dim, code, _ = (x.as_py() for x in key)
        keys, found = part["key"].to_numpy(), []
        cuts = {c: (d, w) for row in cut.to_pylist() for c, d, w in zip(row["codes"], row["ways"], row["wheres"])}
        for node, at, dense in deal(unit(_matrix(part["vec"])), code, cuts, margin(dim), seed) if len(keys) else ():
            found.append(pa.Table.from_arrays([pa.array(keys[at]), *(pa.array(np.full(len(at), v, t)) for v, t in ((dim, np.int32), (node, np.int64), (dense, bool)))], schema=_PLACES_OUT))
        return pa.concat_tables(found) if found else _PLACES_OUT.empty_table()

    known = rows.join(small(nodes), ["dim", "code"]).withColumn("draw", F.xxhash64("key", "code", F.lit(seed)))
    rate = F.least(F.lit(1.0), F.lit(0.75 * sample) / F.col("size"))
    cuts = stored(known.where(F.pmod("draw", F.lit(1_000_000)) < rate * 1_000_000).select("dim", "code", "size", "draw", "vec").groupBy("dim", "code").applyInArrow(grow, "dim int, code long, codes array<long>, ways array<int>, wheres array<double>"))
    parts = F.ceil(F.col("size") / 4096).cast("long")
    left = known.select("key", "vec", "dim", "code", F.pmod("draw", parts).alias("part")).groupBy("dim", "code", "part")
    right = cuts.join(nodes, ["dim", "code"]).select("dim", "code", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "codes", "ways", "wheres").groupBy("dim", "code", "part")
    return left.cogroup(right).applyInArrow(dealt, "key long, dim int, code long, dense boolean")


def places(vectors: DataFrame, trees: int, leaf: int, sample: int, spill: float, cosine: float, seed: int) -> DataFrame:
    """key, dim, code of each leaf that a vector (key, vec) lies in."""
    dims = vectors.withColumn("dim", F.size("vec"))
    roots = F.explode(F.array(*(F.lit((tree << _PATH_BITS) + 1) for tree in range(trees)))).alias("code")
    sizes = stored(dims.groupBy("dim").agg(F.count(F.lit(1)).alias("size")))
    # The few vectors of a rare length are one leaf, of the first tree.
    few = sizes.where(F.col("size") <= leaf).select("dim", F.lit(1).cast("long").alias("code"))
    every = dims.join(small(few), "dim").select("key", "dim", "code")
    nodes = stored(sizes.where(F.col("size") > leaf).select("dim", roots, "size"))
    rows = dims.select("key", "vec", "dim", roots)
    while not nodes.isEmpty():
        found = stored(_round(rows, nodes, leaf, sample, spill, cosine, seed))
        counts = found.groupBy("dim", "code").agg(F.count(F.lit(1)).alias("size"), F.bool_or("dense").alias("dense"))
        room = F.col("code") % (1 << _PATH_BITS) < 1 << (_PATH_BITS - 2 * _DEPTH)
        nodes = stored(counts.where((F.col("size") > 2 * leaf) & ~F.col("dense") & room).select("dim", "code", "size"))
        more = small(nodes.select("dim", "code"))
        every = every.unionByName(found.join(more, ["dim", "code"], "left_anti").select("key", "dim", "code"))
        rows = dims.join(found.join(more, ["dim", "code"], "left_semi").select("key", "dim", "code"), ["key", "dim"])
    return every


def _met(codes: list[np.ndarray], own: int) -> np.ndarray:
    """Which pairs share a leaf before this one."""
    met = np.zeros((len(codes), len(codes)), bool)
    row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    row, flat = row[flat < own], flat[flat < own]
    order = np.argsort(flat, kind="stable")
    row, flat = row[order], flat[order]
    for group in np.split(row, np.flatnonzero(np.diff(flat)) + 1):
        if len(group) > 1:
            met[np.ix_(group, group)] = True
    return met


def lowest(linked: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The smallest key of each row's component in a boolean matrix."""
    low = keys.copy()
    while True:
        least = np.where(linked, low[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
        new = np.minimum(low, least)
        if (new == low).all():
            return low
        low = new


def leaf_links(at: DataFrame, vectors: DataFrame, cosine: float, leaf: int) -> DataFrame:
    """key, n (linked rows first met in a leaf), low (the smallest key that it is joined with there), from all leaves and blocks."""
    sizes = stored(at.groupBy("dim", "code").agg(F.count(F.lit(1)).alias("size")))
    big = small(stored(sizes.where(F.col("size") > 2 * leaf).select("dim", "code", F.expr(f"cast(ceil(size / {leaf}) as int)").alias("blocks"))))
    carried = vectors.join(at.groupBy("key").agg(F.collect_list("code").alias("met")), "key")
    rows = carried.withColumn("dim", F.size("vec")).withColumn("code", F.explode("met")).join(big, ["dim", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("key"), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("dim", "code", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "key", "copies", "vec", "met")
    out = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("low", pa.int64())])

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        _, code, i, j = (x.as_py() for x in key)
        units, keys, copies = unit(_matrix(table["vec"])), table["key"].to_numpy(), table["copies"].to_numpy()
        linked = units @ units.T >= cosine
        np.fill_diagonal(linked, False)
        if i != j:
            side = table["mine"].to_numpy() == i
            linked &= side[:, None] != side[None, :]
        use = np.flatnonzero(linked.any(1))
        if not len(use):
            return out.empty_table()
        linked = linked[np.ix_(use, use)]
        low = lowest(linked, keys[use])
        first = linked & ~_met([np.array(x, np.int64) for x in table["met"].take(pa.array(use)).to_pylist()], code)
        return pa.Table.from_arrays([pa.array(keys[use]), pa.array(first @ copies[use]), pa.array(low)], schema=out)

    return rows.groupBy("dim", "code", "i", "j").applyInArrow(compare, "key long, n long, low long")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, trees: int = 8, leaf: int = 512, sample: int = 16384, spill: float = 0.36, seed: int = 11) -> DataFrame:
    """id, n_links (other rows linked directly), component_id (the smallest id reachable) of every row.

    spill: the margin of a cut, in standard deviations of what a pair at the threshold differs by along a random direction.
    """
    vector = F.col(f"`{vector_col}`")
    table = stored(rows.select(F.col(f"`{id_col}`").alias("id"), F.when(usable(vector), vector).alias("vec")))
    classes = stored(table.where("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).withColumn("key", F.monotonically_increasing_id()))
    vectors = classes.select("key", "vec", "copies")
    at = stored(places(vectors.select("key", "vec"), trees, leaf, sample, spill, cosine, seed))
    found = stored(leaf_links(at, vectors, cosine, leaf))
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    roots = components(found.where("key != low").select(F.col("key").alias("a"), F.col("low").alias("b")).distinct())
    grouped = stored(roots.withColumnRenamed("bits", "key").join(classes.select("key", "first_id"), "key"))
    firsts = stored(grouped.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members")))
    linked = join_groups(grouped.drop("first_id"), firsts, "root", "members", grouped.count()).select("key", "component_id")
    known = classes.join(counts, "key", "left").join(linked, "key", "left")
    known = stored(known.select("vec", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id")))
    alone = table.where("vec IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return join_groups(table.where("vec IS NOT NULL"), known, "vec", "copies", table.count()).select("id", "n_links", "component_id").unionByName(alone)
