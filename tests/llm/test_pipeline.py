import random

import corpus_pipeline as P


def test_whole_pipeline(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choices("bcdfglmnprst", k=3)) + rng.choice("aeiou") for _ in range(2000)]
    docs, labels = [], []
    for k in range(240):
        text = rng.choices(words, k=120)
        toxic = k % 6 == 0
        for _ in range(4 if toxic else 0):
            text.insert(rng.randrange(100), rng.choice(["idiot", "moron", "trash"]))
        docs.append((k, " ".join(text), "en", f"src{k % 4}", 1))
        labels.append((k, 1, int(toxic)))
    docs += [(1000 + k, docs[7][1].replace(" ", "  "), "en", "src1", 1) for k in range(30)]
    docs += [(2000, None, None, None, None), (2001, "", "en", "src0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table, at = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for n, (name, stage) in enumerate(P.STAGES):
        table = stage(spark, table, str(tmp_path))
        table.write.parquet(str(tmp_path / f"stage{n}"))
        table = spark.read.parquet(str(tmp_path / f"stage{n}"))
        at[name] = table
        if n + 1 < len(P.STAGES):
            assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r["doc_id"] for r in at["toxicity"].collect()}
    assert not kept & {k for k in range(240) if k % 6 == 0} and kept >= {k for k in range(240) if k % 6}
    kept = {r["doc_id"] for r in at["exact_dedup"].collect()}
    assert 7 in kept and not any(k >= 1000 and k < 1030 for k in kept)
    near = {r["doc_id"] for r in at["simhash_near_dedup"].collect()}
    assert near <= kept and len(near) > 190
    mixed = [r["doc_id"] for r in at["mixing"].collect()]
    assert set(mixed) <= near and mixed
    packed = at["packing"].collect()
    assert {r["doc_id"] for r in packed} == set(mixed) and all(r["offset"] + r["length"] <= 4096 for r in packed)
