"""A Python data sink for one text file: `basalt_lines`. Tasks write their lines to parts, and the commit joins the parts in order.

Input: a DataFrame of one text column, in order (as orderBy leaves it). Options: path (below a folder that driver and executors share), head
and tail (lines before and after, as JSON arrays), separator (what stands before each line but the first). The driver copies parts as
bytes and holds none of them, so its memory doesn't grow with the file.

Defined results: null lines are empty; without lines the file is head and tail; lines may hold line ends; a task that is run again writes a
part of its own, and only the parts that the commit is told of count; a failed write leaves the file as it was, and no parts.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from basalt.sources.tree import local_path


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    lines: int


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = local_path(options["path"])
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"
        self.head, self.tail = (json.loads(options.get(k, "[]")) for k in ("head", "tail"))
        self.separator = options.get("separator", "")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context = TaskContext.get()
        name, lines = f"{context.partitionId()}-{context.taskAttemptId()}", 0
        os.makedirs(self.parts, exist_ok=True)
        with open(os.path.join(self.parts, name), "w", encoding="utf-8", newline="") as f:
            for batch in iterator:
                for line in batch.column(0).to_pylist():
                    f.write((self.separator if lines else "") + (line or "") + "\n")
                    lines += 1
        return Part(context.partitionId(), name, lines)

    def commit(self, messages: list[Part | None]) -> None:
        whole, any_line = f"{self.path}.{uuid.uuid4().hex}", False
        with open(whole, "wb") as out:
            out.write("".join(line + "\n" for line in self.head).encode())
            for part in sorted((m for m in messages if m is not None and m.lines), key=lambda m: m.number):
                out.write(self.separator.encode() if any_line else b"")
                any_line = True
                with open(os.path.join(self.parts, part.name), "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
            out.write("".join(line + "\n" for line in self.tail).encode())
        os.replace(whole, self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class LinesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "basalt_lines"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter(dict(self.options))


def write_lines(lines: DataFrame, path: str, head: list[str] = [], tail: list[str] = [], separator: str = "") -> None:  # noqa: B006
    """Writes the one column of lines to a file."""
    spark = lines.sparkSession
    spark.dataSource.register(LinesSink)
    lines.toDF("line").write.format("basalt_lines").mode("append").options(path=os.path.abspath(local_path(path)), head=json.dumps(head), tail=json.dumps(tail), separator=separator).save()
