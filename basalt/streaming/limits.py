"""Time-keyed operators: a sliding-window rate limiter, requests in flight, expiry, and progress of a streamed scan."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from basalt.operators.findings import severity_counts
from basalt.plans.scan import Options, scan
from basalt.plans.store import stored


def _decide(log: deque, at: float, limit: int, window: float) -> bool:
    """Whether a request is accepted. Only accepted ones count against the limit."""
    while log and at - log[0] > window:
        log.popleft()
    if len(log) >= limit:
        return False
    log.append(at)
    return True


def _segments(requests: DataFrame, key: str, ts: str, tie: str, window: float, row: str, segment: str) -> DataFrame:
    """requests in order of key, ts and tie, with their place in that order (row) and a number of their segment.

    A segment ends where the key changes, or where it was quiet for longer than the window: nothing before counts there. Rows are dealt by
    ranges of (key, ts, tie), so a key's rows lie in many tasks; each compares its rows with those before them, and only the last row
    of a range and the number of its segments go to the others.
    """
    spark = requests.sparkSession
    parts, rest = int(spark.conf.get("spark.sql.shuffle.partitions")), int(window * 1e6) + 1
    order = F.struct(F.col(f"`{key}`").alias("key"), F.unix_micros(F.col(f"`{ts}`").cast("timestamp")).alias("at"))
    ranged = requests.repartitionByRange(parts, F.col(f"`{key}`"), F.col(f"`{ts}`"), F.col(f"`{tie}`")).sortWithinPartitions(f"`{key}`", f"`{ts}`", f"`{tie}`")
    ranged = stored(ranged.withColumn(row, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(f"`{row}`"), 33)
    ends = stored(ranged.groupBy(part.alias("part")).agg(F.max_by(order, F.col(f"`{row}`")).alias("end")))
    # one row for each range
    before_range = F.broadcast(ends.select("part", F.struct(F.lag("end").over(Window.orderBy("part")).alias("end")).alias("last")))
    own = Window.partitionBy("part").orderBy("row")
    narrow = ranged.select(F.col(f"`{row}`").alias("row"), part.alias("part"), order.alias("own")).join(before_range, "part")
    before = F.coalesce(F.lag("own").over(own), F.col("last.end"))
    starts = before.isNull() | ~before["key"].eqNullSafe(F.col("own.key")) | (F.col("own.at") - before["at"] > rest)
    counted = stored(narrow.withColumn("n", F.sum(starts.cast("long")).over(own)).select("row", "part", "n"))
    offset = counted.groupBy("part").agg(F.max("n").alias("segments")).select("part", F.coalesce(F.sum("segments").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    numbered = counted.join(F.broadcast(offset), "part").select(F.col("row").alias(row), (F.col("n") + F.col("offset")).alias(segment))
    return ranged.join(numbered, row)


def rate_limited(requests: DataFrame, key: str, ts: str, tie: str, *, limit: int = 3, window: float = 60.0) -> DataFrame:
    """requests with accepted. A key's requests are taken in order of time, then of tie.

    Null is a key like any other. A request without a time can't be decided: its accepted is null, and it counts for nothing. Each
    decision depends on those before it, but only within the window: where a key was quiet for longer, a new segment begins, and the
    segments of a key are decided by as many tasks as there are. A segment's rows come to its task as sorted batches, and the task keeps only
    `limit` times. Only the decision is made in Python: all columns pass through as they are.
    """
    schema, columns = T.StructType([*requests.schema.fields, T.StructField("accepted", T.BooleanType())]), requests.columns
    taken = {c.lower() for c in columns}
    row, segment = (next(n for k in range(len(taken) + 1) if (n := "_" * k + name) not in taken) for name in ("row_number", "segment_number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, log = None, deque()
        for batch in batches:
            times = batch.column(batch.schema.names.index(ts)).cast(pa.timestamp("us")).cast(pa.int64()).to_pylist()
            out = []
            for number, at in zip(batch.column(batch.schema.names.index(segment)).to_pylist(), times):
                if number != current:
                    current, log = number, deque()
                out.append(_decide(log, at / 1e6, limit, window))
            kept = batch.select(columns)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.bool_())], schema=kept.schema.append(pa.field("accepted", pa.bool_())))

    timed = _segments(requests.where(F.col(f"`{ts}`").isNotNull()), key, ts, tie, window, row, segment)
    decided = timed.repartition(segment).sortWithinPartitions(segment, row).mapInArrow(run, schema)
    return decided.unionByName(requests.where(F.col(f"`{ts}`").isNull()).withColumn("accepted", F.lit(None).cast("boolean")))


def rate_limited_stream(requests: DataFrame, key: str, ts: str, *, limit: int = 3, window: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """The same over a stream: key (of its own type), ts, accepted. State is the accepted times of a key; it goes when the key has been quiet for the window.

    Within a micro-batch requests are taken in order of time; one that comes after later ones were decided is decided as of then. A request
    without a time has accepted null. Null is a key like any other.
    """
    kind = requests.schema[key].dataType
    out = T.StructType([T.StructField("key", kind), T.StructField("ts", T.TimestampType()), T.StructField("accepted", T.BooleanType())])
    state_type = T.StructType([T.StructField("log", T.ArrayType(T.DoubleType()))])

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(frames)).sort_values("at")
        # microseconds since 1970, so the session's time zone has no part in it
        accepted = [None if pd.isna(at) else _decide(log, at / 1e6, limit, window) for at in rows["at"]]
        state.update((list(log),))
        state.setTimeoutTimestamp(max(int((log[-1] if log else 0) * 1000), state.getCurrentWatermarkMs()) + int(window * 1000) + 1)
        yield pd.DataFrame({"key": pd.Series([name[0]] * len(rows), dtype=object, index=rows.index), "ts": rows["ts"], "accepted": pd.Series(accepted, dtype=object, index=rows.index)})

    rows = requests.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at")).withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(run, out, state_type, "append", "EventTimeTimeout")


def in_flight(requests: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """requests with n_open: how many of the key's requests, itself included, are open at its start (those that end just then aren't)."""
    moments = requests.select("*", F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))).alias("m"))
    order = Window.partitionBy(key).orderBy("m.at", "m.step").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return moments.withColumn("n_open", F.sum("m.step").over(order)).where("m.step = 1").select(*requests.columns, "n_open")


def fresh(rows: DataFrame, expires: str, now: Column) -> DataFrame:
    """Rows that haven't expired; one that expires now is still there."""
    return rows.where(F.col(expires) >= now)


def streamed_scan(files: DataFrame, out: str, checkpoint: str, options: Options = Options(), total: int | None = None):  # noqa: B008
    """Starts a query over a stream of files (path, content, language, digest, size).

    Each micro-batch is scanned by the batch plan: findings go to out/findings, a progress row (batch, files, counts by severity)
    to out/progress. A batch that is run again after a failure replaces its own folder.
    """

    def one(batch: DataFrame, number: int) -> None:
        found = scan(batch, options)
        found.write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
        seen = batch.sparkSession.read.parquet(f"{out}/findings/batch={number}")
        progress = severity_counts(seen).agg(F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("counts"), F.sum("n").alias("findings"))
        progress.withColumn("files", F.lit(batch.count())).withColumn("total", F.lit(total).cast("long")).write.mode("overwrite").parquet(f"{out}/progress/batch={number}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
