"""Directory trees and archives as Python data sources: planned by directory and by range of members, listed and read by tasks.

`basalt_tree` lists a tree below a folder that driver and executors share: path, size. The planner looks only at the topmost
directories, until there are enough of them to share out; no name of a file is part of a plan. Each task walks its directories, leaving out
ignored ones before it looks into them; a directory with very many files is listed by several tasks, each of which takes a share of the
names by hash. Options: path, ignore (lines, as a JSON array), ignore_files (names, as a JSON array), nested (whether ignore files below the
root count for what lies below them; a deeper line outweighs those above it), max_bytes, spread (how many directories to look for) and slice
(how many entries of a directory one task takes).

An archive is opened by two steps of tasks: one reads its index and cuts its members into ranges of some megabytes, one reads a range each.
Only what is compressed as a whole (tar.gz and the like) is read in one go, by one task, a member at a time.

Defined results: a folder that is missing is an error; files and folders that can't be read, and links to folders, are left out; links to files
are read; an empty folder gives no rows; a file that vanishes between listing and reading gives no row.
"""

from __future__ import annotations

import json
import os
import re
import tarfile
import zipfile
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Layer = tuple[str, tuple[str, ...]]  # a folder ("" or "a/b/"), and the ignore lines that hold below it
BATCH_BYTES, RANGE_BYTES = 4 << 20, 16 << 20


class Ignored:
    """Ignore lines of a folder and of those above it, as expressions over the path below each folder; the last match decides."""

    def __init__(self, layers: tuple[Layer, ...]):
        from basalt.sources.files import ignore_regex

        self.rules = [(base, re.compile(found[0]), found[1]) for base, lines in layers for line in lines if (found := ignore_regex(line))]

    def __call__(self, path: str) -> bool:
        """path: relative to the root, with a slash at the end for a folder."""
        for base, pattern, excludes in reversed(self.rules):
            if path.startswith(base) and len(path) > len(base) and pattern.search(path[len(base) :]):
                return excludes
        return False


@dataclass
class Share(InputPartition):
    """What one task lists: a whole subtree, or (deep is False) the files of a folder whose names have a remainder."""

    folder: str
    layers: tuple[Layer, ...]
    deep: bool = True
    of: int = 1
    remainder: int = 0

    def __post_init__(self):
        super().__init__(None)


@dataclass
class Tree:
    """A root with its ignore lines. seen counts the folders that were looked into."""

    root: str
    lines: tuple[str, ...] = ()
    ignore_files: tuple[str, ...] = ()
    nested: bool = False
    max_bytes: int = 1 << 62
    recursive: bool = True
    seen: int = field(default=0, compare=False)

    def entries(self, folder: str) -> Iterator[os.DirEntry]:
        self.seen += 1
        try:
            with os.scandir(os.path.join(self.root, folder)) as found:
                yield from found
        except OSError:
            if not folder:
                raise

    def layers_at(self, folder: str, above: tuple[Layer, ...]) -> tuple[Layer, ...]:
        """above, with the lines of the ignore files in the folder."""
        lines: list[str] = []
        for name in self.ignore_files if self.nested or not folder else ():
            try:
                with open(os.path.join(self.root, folder, name), encoding="utf-8", errors="replace") as f:
                    lines += f.read().splitlines()
            except OSError:
                continue
        own = (folder, tuple(lines)) if lines else None
        if not folder:  # lines that the caller gives come after those of the root's own files
            return tuple(filter(None, (*above[:1], own, *above[1:])))
        return (*above, own) if own else above

    def folders(self, folder: str, ignored: Ignored) -> list[str]:
        if not self.recursive:
            return []
        return sorted(f for e in self.entries(folder) if e.is_dir(follow_symlinks=False) and not ignored(f := f"{folder}{e.name}/"))

    def shares(self, default: tuple[str, ...], spread: int, slice_size: int) -> list[Share]:
        """The plan: subtrees, and the files of the folders above them."""
        top: tuple[Layer, ...] = (("", default), ("", self.lines))
        todo: deque[tuple[str, tuple[Layer, ...]]] = deque([("", self.layers_at("", top))])
        plan: list[Share] = []
        while todo and len(todo) < spread and self.seen < 8 * spread:
            folder, layers = todo.popleft()
            if folder:
                layers = self.layers_at(folder, layers)
            below = self.folders(folder, Ignored(layers))
            count = sum(1 for _ in self.entries(folder)) - len(below)
            slices = max(1, -(-count // slice_size))
            plan += [Share(folder, layers, False, slices, n) for n in range(slices)] if count else []
            todo += [(f, layers) for f in below]
        return plan + [Share(folder, layers) for folder, layers in todo]

    def files(self, share: Share) -> Iterator[tuple[str, int]]:
        """path, size of the files of a share."""
        todo = [(share.folder, share.layers)]
        while todo:
            folder, layers = todo.pop()
            if share.deep and folder:
                layers = self.layers_at(folder, layers)
            ignored = Ignored(layers)
            for entry in self.entries(folder):
                path = f"{folder}{entry.name}"
                try:
                    if entry.is_dir(follow_symlinks=False):
                        if share.deep and not ignored(path + "/"):
                            todo.append((path + "/", layers))
                    elif (share.of == 1 or zlib.crc32(entry.name.encode("utf-8", "surrogateescape")) % share.of == share.remainder) and not ignored(path) and entry.is_file():
                        if (size := entry.stat().st_size) <= self.max_bytes:
                            path.encode()  # names that aren't text are left out
                            yield path, size
                except (OSError, UnicodeEncodeError):
                    continue


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        from basalt.sources.files import IGNORED

        read = lambda name, other: tuple(json.loads(options.get(name, "null")) or other)
        flag = lambda name, other: options.get(name, other).lower() == "true"
        self.default = IGNORED if flag("default_ignores", "true") else ()
        self.tree = Tree(local_path(options["path"]), read("ignore", ()), read("ignore_files", ()), flag("nested", "false"), int(options.get("max_bytes", 1 << 62)), flag("recursive", "true"))
        self.spread, self.slice = int(options.get("spread", 256)), int(options.get("slice", 50_000))

    def partitions(self) -> list[Share]:
        if not os.path.isdir(self.tree.root):
            raise FileNotFoundError(self.tree.root)
        return self.tree.shares(self.default, self.spread, self.slice) or [Share("", (), False)]

    def read(self, share: Share) -> Iterator[tuple[str, int]]:
        return self.tree.files(share)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "basalt_tree"

    def schema(self) -> str:
        return "path string, size long"

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def local_path(root: str) -> str:
    return re.sub("^file:(?://)?(?=/)", "", root).rstrip("/") or "/"


def listing(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """path, size of the files below root; options as in the module's description."""
    spark.dataSource.register(TreeSource)
    given = {k: v if isinstance(v, str) else json.dumps(list(v) if isinstance(v, tuple) else v) for k, v in options.items()}
    return spark.read.format("basalt_tree").options(**given).load(root)


def _shared_out(listed: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows dealt anew: how many files a task reads mustn't depend on how they lie in folders."""
    return listed.repartition(tasks or 4 * listed.sparkSession.sparkContext.defaultParallelism, *keys)


def read_files(listed: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """path, data of the listed files."""
    top = local_path(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, data, size = [], [], 0
            for path in batch.column(0).to_pylist():
                try:
                    with open(os.path.join(top, path), "rb") as f:
                        data.append(f.read())
                except OSError:
                    continue
                paths.append(path)
                size += len(data[-1])
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(data, pa.binary())], ["path", "data"])
                    paths, data, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(data, pa.binary())], ["path", "data"])

    return _shared_out(listed.select("path"), tasks, "path").mapInArrow(run, "path string, data binary")


# ---- archives


def _checked(name: str, members: Iterator[tuple[str, int]], max_files: int, max_bytes: int) -> None:
    """Raises ValueError for too many or too large members, and for paths that leave the archive."""
    total = 0
    for n, (path, size) in enumerate(members, 1):
        total += size
        if n > max_files or total > max_bytes:
            raise ValueError(f"{name}: more than {max_files} files or {max_bytes} bytes")
        if path.startswith(("/", "\\")) or ".." in path.replace("\\", "/").split("/") or ":" in path[:3]:
            raise ValueError(f"{name}: {path} leaves the archive")


def _zip_members(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return [i for i in archive.infolist() if not i.is_dir() and (i.external_attr >> 28) != 0xA]


def _cut(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges (first, behind) of about so many bytes."""
    first = total = 0
    for n, size in enumerate(sizes):
        if total and total + size > limit:
            yield first, n
            first, total = n, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


@dataclass(frozen=True)
class Range:
    """Members of an archive: of a zip by number, of a plain tar by place (offset, size, path), of a compressed tar all."""

    kind: str
    first: int = 0
    behind: int = 0
    paths: tuple[str, ...] = ()
    offsets: tuple[int, ...] = ()
    sizes: tuple[int, ...] = ()


def ranges(path: str, max_files: int, max_bytes: int, limit: int = RANGE_BYTES) -> list[Range]:
    """How an archive is shared out. Raises ValueError, OSError, BadZipFile or TarError."""
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as archive:
            members = _zip_members(archive)
            _checked(path, ((m.filename, m.file_size) for m in members), max_files, max_bytes)
            return [Range("zip", a, b) for a, b in _cut([m.file_size for m in members], limit)]
    try:
        tar = tarfile.open(path, "r:")
    except tarfile.ReadError:
        with tarfile.open(path, "r|*") as whole:  # read as a stream: nothing is kept
            _checked(path, ((m.name, m.size) for m in whole if m.isfile()), max_files, max_bytes)
        return [Range("stream")]
    with tar:
        found = []
        _checked(path, ((found.append((m.name, m.offset_data, m.size, m.issparse())) or (m.name, m.size)) for m in tar if m.isfile()), max_files, max_bytes)
    if any(m[3] for m in found):
        return [Range("stream")]
    return [Range("tar", a, b, *(tuple(m[k] for m in found[a:b]) for k in range(3))) for a, b in _cut([m[2] for m in found], limit)]


def members(path: str, part: Range) -> Iterator[tuple[str, bytes]]:
    """The members of a range."""
    if part.kind == "zip":
        with zipfile.ZipFile(path) as archive:
            for member in _zip_members(archive)[part.first : part.behind]:
                yield member.filename.removeprefix("./"), archive.read(member)
    elif part.kind == "tar":
        with open(path, "rb") as f:
            for name, offset, size in zip(part.paths, part.offsets, part.sizes):
                f.seek(offset)
                yield name.removeprefix("./"), f.read(size)
    else:
        with tarfile.open(path, "r|*") as tar:
            for member in tar:
                if member.isfile():
                    yield member.name.removeprefix("./"), tar.extractfile(member).read()


_BROKEN = (ValueError, OSError, EOFError, zlib.error, zipfile.BadZipFile, tarfile.TarError, RuntimeError, NotImplementedError)


def read_archives(listed: DataFrame, root: str, max_files: int, max_bytes: int, keep, tasks: int | None = None, limit: int = RANGE_BYTES) -> DataFrame:
    """archive, path, data, error of the members of the listed archives (path) for whose bytes keep(data) is true."""
    top, schema = local_path(root), "archive string, path string, data binary, error string"
    out = pa.schema([("archive", pa.string()), ("path", pa.string()), ("data", pa.binary()), ("error", pa.string())])

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    rows = [(path, json.dumps(vars(r)), None) for r in ranges(os.path.join(top, path), max_files, max_bytes, limit)]
                except _BROKEN as e:
                    rows = [(path, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 3, ["archive", "range", "error"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, part, error in zip(*(c.to_pylist() for c in batch.columns)):
                if error is not None:
                    yield pa.RecordBatch.from_pylist([{"archive": path, "path": "", "error": error}], out)
                    continue
                try:
                    for name, data in members(os.path.join(top, path), Range(**json.loads(part))):
                        if keep(data):
                            yield pa.RecordBatch.from_pylist([{"archive": path, "path": name, "data": data}], out)
                except _BROKEN as e:
                    yield pa.RecordBatch.from_pylist([{"archive": path, "path": "", "error": str(e)}], out)

    planned = _shared_out(listed.select("path"), tasks, "path").mapInArrow(plan, "archive string, range string, error string")
    return _shared_out(planned, tasks, "archive", "range").mapInArrow(read, schema)
