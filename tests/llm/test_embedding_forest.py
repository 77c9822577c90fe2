import numpy as np

from basalt.llm import embedding_forest as E
from basalt.llm.queries import ORACLE, op11_embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, n_links int"


def brute(rows, cosine=0.9):
    """vec_id to (links, component), of rows (vec_id, vector) with distinct ids, by all pairs."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root, links = {i: i for i, _ in rows}, dict.fromkeys((i for i, _ in rows), 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for dim in {len(v) for _, v in good}:
        ids = [i for i, v in good if len(v) == dim]
        units = np.stack([v / np.abs(v).max() for _, v in good if len(v) == dim])
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(units @ units.T >= cosine, 1))):
            links[ids[a]] += 1
            links[ids[b]] += 1
            x, y = find(ids[a]), find(ids[b])
            root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i, _ in rows}


def clusters(rng, dim, sizes, noise):
    """Vectors around centres: near copies for little noise."""
    found = []
    for size in sizes:
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        found += [(centre + noise * rng.standard_normal(dim) / dim**0.5).astype(np.float32) for _ in range(size)]
    return found


def test_forest_finds_what_all_pairs_find(spark):
    rng = np.random.default_rng(3)
    vectors = [*rng.standard_normal((700, 16)).astype(np.float32), *clusters(rng, 16, [2] * 60 + [5] * 20, 0.3), *clusters(rng, 16, [300], 0.15)]
    order = rng.permutation(len(vectors))
    rows = [(int(n), vectors[k].tolist()) for n, k in enumerate(order)]
    want = brute(rows)
    frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(frame, leaf=64, sample=512).collect()}
    links = sum(n for n, _ in want.values())
    assert links > 80_000 and len(got) == len(want)
    assert sum(n for n, _ in got.values()) >= 0.995 * links
    assert all(got[i][0] <= n for i, (n, _) in want.items())  # no link that isn't one, and none counted twice
    assert sum(got[i][1] == c for i, (_, c) in want.items()) >= 0.99 * len(want)


def test_dense_leaves_are_compared_by_blocks(spark):
    rng = np.random.default_rng(5)
    vectors = [*clusters(rng, 8, [200], 0.05), *rng.standard_normal((40, 8)).astype(np.float32)]
    rows = [(n, v.tolist()) for n, v in enumerate(vectors)]
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), leaf=16, sample=256).collect()}
    want = brute(rows)
    assert {i: got[i] for i in range(200)} == {i: want[i] for i in range(200)}


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(5, [1.0, 0.0]), (3, [1.0, 0.0]), (8, [2.0, 0.1]), (9, [0.0, 0.0]), (10, None), (11, []), (12, [None, 1.0]), (13, [nan, 1.0]), (14, [inf, 1.0]), (15, [0.0, -1.0]), (16, [1.0, 0.0, 0.0]), (17, [1e30, 1e20]), (18, [1e-40, 0.0]), (None, [0.0, -2.0])]
    frame = spark.createDataFrame([(i, v, 7) for i, v in rows], SCHEMA)
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(frame).collect()}
    assert got == {5: (4, 3), 3: (4, 3), 8: (4, 3), 17: (4, 3), 18: (4, 3), **{i: (0, i) for i in (9, 10, 11, 12, 13, 14, 16)}, 15: (1, 15), None: (1, 15)}
    assert E.near_vectors(frame.limit(0)).count() == 0


def test_repeated_ids_and_rows(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 3.0], 0)], SCHEMA)
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in E.near_vectors(frame).collect()) == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1)]


def test_cuts_part_few_pairs_and_bound_the_leaves():
    rng = np.random.default_rng(1)
    units = E.unit(rng.standard_normal((4000, 32)))
    turned = E.unit(units + 0.484 * E.unit(rng.standard_normal((4000, 32))))  # about 0.9
    margin = 0.36 * 0.447 / 32**0.5
    cuts = E.fit(units, 1, 4000, 200, margin, 11)
    leaves = lambda x: [{node for node, rows, _ in E.deal(x[k : k + 1], 1, cuts, margin, 11)} for k in range(300)]
    together = sum(bool(a & b) for a, b in zip(leaves(units), leaves(turned)))
    assert 150 < together  # in one tree; eight of them leave next to none apart
    assert max(len(rows) for _, rows, dense in E.deal(units, 1, cuts, margin, 11) if not dense) <= 200


def test_query_and_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(9)
    vectors = [*clusters(rng, 12, [1] * 80 + [3] * 10, 0.2), *([np.zeros(12, np.float32)] * 2)]
    spark.createDataFrame([(n, v.tolist(), 0) for n, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in op11_embedding_dedup(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == sorted(db.sql(ORACLE["op11_embedding_dedup"]).fetchall())
