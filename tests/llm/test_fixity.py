from pyspark.sql import functions as F

from basalt.llm.fixity import audit, cut_warc, descend, hashed, plant, read_warc, warc_records, write_warc

ROWS = [(n, f"http://x/{n}", "p" * n) for n in range(200)] + [(None, None, None), (5, "http://twice/", "again"), (7, "http://x/7", "p" * 7), (300, "http://é/", "long " * 100_000)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


def differences(a, b, **options):
    return sorted(((r["id"], r["status"]) for r in audit(a, b, **options).collect()), key=repr)


def test_equal_replicas(spark):
    records = warc_records(pages(spark))
    assert differences(records, records.repartition(3), records_per_range=16, fanout=4) == []


def test_damage_is_located(spark):
    ours = warc_records(pages(spark))
    theirs = ours.where("id is null or id not in (11, 12)").withColumn("record", F.when(F.col("id").isin(3, 150), F.concat(F.expr("left(record, length(record) - 1)"), F.lit("?"))).otherwise(F.col("record"))).unionByName(warc_records(pages(spark, [(999, "http://new/", "x")])))
    want = sorted([(3, "changed"), (150, "changed"), (11, "missing"), (12, "missing"), (999, "extra")], key=repr)
    for per_range, fanout in ((16, 4), (4096, 16), (1, 2)):
        assert differences(ours, theirs, records_per_range=per_range, fanout=fanout) == want


def test_empty_replicas(spark):
    some, none = warc_records(pages(spark, ROWS[:3])), warc_records(pages(spark, []))
    assert differences(some, none) == [(0, "missing"), (1, "missing"), (2, "missing")] and differences(none, none) == []


def test_only_mismatching_branches_are_read(spark):
    records = warc_records(pages(spark, ROWS[:64]))
    damaged = records.where("id != 50").withColumn("record", F.when(F.col("id") == 37, F.lit("x")).otherwise(F.col("record")))
    nothing = spark.createDataFrame([], "id long")
    a, b = (plant(hashed(side), nothing, 64, 4) for side in (records, damaged))
    assert [level.count() for level in a.levels][1:] == [16, 4, 1]
    found = [[r["node"] for r in level.collect()] for level in descend(a, b, 4)]
    assert found[0] == [0] and all(1 <= len(level) <= 2 for level in found)
    want = {r["range"] for side in (a, b) for r in side.leaves.where("id in (37, 50)").collect()}
    assert set(found[-1]) == want and all(n // 4 in above for above, level in zip(found, found[1:]) for n in level)
    # the compared leaves are those of the ranges that differ
    assert sum(side.leaves.where(F.col("range").isin(found[-1])).count() for side in (a, b)) < 20
    same = descend(a, plant(hashed(records.repartition(5)), nothing, 64, 4), 4)
    assert len(same) == 1 and same[0].count() == 0


def test_a_node_covers_its_offsets(spark):
    """Equal children at other places give another node: a hash of digests alone would not tell."""
    rows = spark.createDataFrame([("1", "d", 10, 1), ("2", "e", 20, 1)], "id string, digest string, length long, copies long")
    other = spark.createDataFrame([("1", "d", 20, 1), ("2", "e", 10, 1)], "id string, digest string, length long, copies long")
    nothing = spark.createDataFrame([], "id string")
    assert plant(rows, nothing, 1, 4).levels[-1].collect()[0]["hash"] != plant(other, nothing, 1, 4).levels[-1].collect()[0]["hash"]


def test_null_and_repeated_ids_are_known_by_content(spark):
    ours = warc_records(pages(spark, [(None, "u", f"page {n}") for n in range(40)] + [(1, "u", "a"), (1, "u", "b"), (2, "u", "c"), (2, "u", "c"), (3, "u", "d")]))
    theirs = warc_records(pages(spark, [(None, "u", f"page {n}") for n in range(1, 41)] + [(1, "u", "a"), (1, "u", "B"), (2, "u", "c"), (3, "u", "d")]))
    assert differences(ours, theirs, records_per_range=2, fanout=2) == sorted([(None, "missing"), (None, "extra"), (1, "missing"), (1, "extra"), (2, "changed")], key=repr)


def test_malformed_archives():
    good = b"WARC/1.0\r\nWARC-Target-URI: u\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for length in (b"x", b"-5", b"99999", b"2", b"9" * 30, "\u0664".encode()):
        bad = good.replace(b"Length: 3", b"Length: " + length)
        found = list(cut_warc(bad + good))
        assert [r[4] for r in found] == [False, True] and found[1][2:4] == ("u", b"abc") and found[1][0] == len(bad)
    assert [r[3:] for r in cut_warc(good + good[:-5])] == [(b"abc", True), (b"ab", False)]
    assert list(cut_warc(b"")) == [] and [r[4] for r in cut_warc(b"junk WARC/1.0\r\nno end")] == [False]
    inner = good.replace(b"abc", b"WARC/1.0\r\n x").replace(b"Length: 3", b"Length: 12")
    assert [r[3] for r in cut_warc(inner + good)] == [b"WARC/1.0\r\n x", b"abc"]


def test_files_round_trip(spark, tmp_path):
    records = warc_records(pages(spark))
    write_warc(records, str(tmp_path / "w"), 3)
    read = read_warc(spark, str(tmp_path / "w/*.txt"))
    assert sorted(bytes(r["payload"]).decode() for r in read.select("payload").collect()) == sorted(r[2] or "" for r in ROWS)
