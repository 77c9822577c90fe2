import datetime as dt
import itertools
import random
import time

from pyspark.sql import functions as F

from basalt.sources.files import with_language
from basalt.streaming.limits import _segments, fresh, in_flight, rate_limited, rate_limited_stream, streamed_scan

START = dt.datetime(2024, 1, 1)


def at(*seconds):
    return [START + dt.timedelta(seconds=s) for s in seconds]


def requests(spark):
    rows = [(n, "a", t) for n, t in enumerate(at(0, 10, 20, 30, 59, 61, 62, 200))] + [(100, "b", at(5)[0])]
    return spark.createDataFrame(rows, "n int, k string, ts timestamp")


WANT = {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: True, 100: True}


def test_rejected_requests_do_not_count(spark):
    rows = rate_limited(requests(spark), "k", "ts", "n").collect()
    assert {r["n"]: r["accepted"] for r in rows} == WANT


def test_null_and_large_keys(spark):
    big = (1 << 53) + 1
    rows = [(n, k, t) for k, first in ((None, 0), (big, 10), (big - 1, 20)) for n, t in enumerate(at(*range(6)), first)] + [(30, None, None), (31, big, None)]
    got = {r["n"]: (r["k"], r["accepted"]) for r in rate_limited(spark.createDataFrame(rows, "n int, k long, ts timestamp").repartition(3), "k", "ts", "n").collect()}
    for k, first in ((None, 0), (big, 10), (big - 1, 20)):
        assert [got[first + n] for n in range(6)] == [(k, n < 3) for n in range(6)]
    assert got[30] == (None, None) and got[31] == (big, None)


def test_stream_gives_the_same(spark, tmp_path):
    requests(spark).select("k", "ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    query = rate_limited_stream(stream, "k", "ts").writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r["key"], r["ts"], r["accepted"]) for r in spark.table("limited").collect())
    assert got == sorted((r["k"], r["ts"], WANT[r["n"]]) for r in requests(spark).collect())


def brute(rows, limit, window):
    """rows (n, key, seconds): decided one by one for each key."""
    logs, out = {}, {}
    for n, k, t in sorted(rows, key=lambda r: (str(r[1]), r[2], r[0])):
        log = [x for x in logs.get(k, []) if t - x <= window]
        out[n] = len(log) < limit
        logs[k] = log + [t] * out[n]
    return out


def test_a_hot_key_is_decided_by_many_tasks(spark):
    rng = random.Random(2)
    rows, t = [], 0
    for n in range(3000):  # most rows are of one key, with quiet times longer than the window now and then
        t += rng.choice([0, 1, 1, 2, 30, 61, 60]) if rng.random() < 0.3 else rng.choice([0, 1, 5])
        rows.append((n, rng.choice(["hot"] * 8 + [None, "b"]), t))
    frame = spark.createDataFrame([(n, k, START + dt.timedelta(seconds=t), n) for n, k, t in rows], "n int, k string, ts timestamp, row_number int").repartition(5)
    found = rate_limited(frame, "k", "ts", "n", limit=3, window=60.0).collect()
    assert {r["n"]: r["accepted"] for r in found} == brute(rows, 3, 60) and len(found[0]) == 5
    hot = _segments(frame, "k", "ts", "n", 60.0, "r", "s").where("k = 'hot'")
    cuts = [b - a > 60 for a, b in itertools.pairwise(sorted(t for _, k, t in rows if k == "hot"))]
    assert hot.select("s").distinct().count() == 1 + sum(cuts) > 10
    assert hot.select(F.shiftright("r", 33)).distinct().count() == 4  # its ranges, one for each shuffle partition
    assert rate_limited(frame.limit(0), "k", "ts", "n").count() == 0


def test_stream_with_null_and_large_keys(spark, tmp_path):
    big = (1 << 53) + 1
    rows = [(k, t) for k in (None, big, big - 1) for t in at(*range(5))] + [(big, None)]
    spark.createDataFrame(rows, "k long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "in"))
    query = rate_limited_stream(stream, "k", "ts").writeStream.format("memory").queryName("odd").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("odd").collect()
    for k in (None, big, big - 1):
        assert [r["accepted"] for r in sorted((r for r in got if r["key"] == k and r["ts"]), key=lambda r: r["ts"])] == [True] * 3 + [False] * 2
    assert [(r["key"], r["accepted"]) for r in got if r["ts"] is None] == [(big, None)]


def test_in_flight(spark):
    rows = [(1, "a", *at(0, 10)), (2, "a", *at(5, 20)), (3, "a", *at(10, 12)), (4, "b", *at(6, 7))]
    got = in_flight(spark.createDataFrame(rows, "n int, k string, s timestamp, e timestamp"), "k", "s", "e").collect()
    assert {r["n"]: r["n_open"] for r in got} == {1: 1, 2: 2, 3: 2, 4: 1}


def test_expiry(spark):
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(at(0, 10, 20))], "n int, e timestamp")
    assert [r["n"] for r in fresh(rows, "e", F.lit(at(10)[0])).collect()] == [1, 2]


def test_streamed_scan(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([(f"f{n}.py", "eval(x)\n")], "path string, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    files = with_language(spark.readStream.schema("path string, content string").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")))
    query = streamed_scan(files, str(tmp_path / "out"), str(tmp_path / "c"), total=3)
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out/findings")).count() == 3
    progress = spark.read.parquet(str(tmp_path / "out/progress"))
    assert progress.agg(F.sum("files"), F.sum("findings")).first() == (3, 3)
