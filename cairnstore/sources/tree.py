"""A file tree as a data source: `spark.read.format("filetree").option("path", ...)`.

Gives files and folders, empty and hidden ones too, which the built-in file sources leave out; symbolic links only
with the option `links`. The first levels, until there are many folders, are listed to plan; what is below is walked
in parallel, so neither one deep folder nor a wide root is a single task.
Options: path, ignore (globs by line, relative to path; a matching folder is not entered), content (true: read bytes),
links. Entries that can't be read are passed over. All executors must see the path.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import glob_regex

SCHEMA = "path string, is_folder boolean, size long, mtime_ms long, ctime_ms long, owner string, grp string, permissions string, hidden boolean, readonly boolean, link_target string, content binary"
#: Partitions, entries to deal over them, and levels that are listed to get so many.
FAN, ENTRIES, LEVELS = 64, 512, 4


def ignore_globs(text: str) -> list[str]:
    """Lines trimmed; blank ones and those that start with # dropped."""
    return [x for x in (line.strip() for line in text.splitlines()) if x and not x.startswith("#")]


class Slice(InputPartition):
    """Entries of the tree, each with whether it is entered."""

    def __init__(self, number: int, entries: list[tuple[str, bool]]) -> None:
        super().__init__(number)
        self.entries = entries


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.globs = ignore_globs(options.get("ignore", ""))
        self.content = options.get("content", "false").lower() == "true"
        self.links = options.get("links", "false").lower() == "true"

    def _pattern(self):
        return re.compile("|".join(f"(?:{glob_regex(g)})" for g in self.globs)) if self.globs else None

    def _inside(self, folder: str, pattern) -> list[str]:
        """Entries of a folder that aren't ignored; none of what is no folder, a link or can't be read."""
        if os.path.islink(folder) and folder != self.root:
            return []
        try:
            names = sorted(os.listdir(folder))
        except OSError:
            return []
        found = [os.path.join(folder, x) for x in names]
        return [x for x in found if not (pattern and pattern.match(os.path.relpath(x, self.root)))]

    def partitions(self):
        pattern, done, front = self._pattern(), [(self.root, False)], self._inside(self.root, self._pattern())
        for _ in range(LEVELS):
            if len(done) + len(front) >= ENTRIES or not front:
                break
            done += [(x, False) for x in front]
            front = [y for x in front for y in self._inside(x, pattern)]
        done += [(x, True) for x in front]
        n = min(FAN, len(done))
        return [Slice(i, done[i::n]) for i in range(n)]

    def read(self, part: Slice) -> Iterator[tuple]:
        pattern, todo = self._pattern(), part.entries[::-1]
        while todo:
            path, deep = todo.pop()
            link = os.path.islink(path) and path != self.root
            yield from self._row(path, os.readlink(path) if link else None)
            if deep and not link:
                todo += [(x, True) for x in self._inside(path, pattern)[::-1]]

    def _row(self, path: str, target: str | None) -> Iterator[tuple]:
        if target is not None and not self.links:
            return
        try:
            s = os.lstat(path)
            folder = stat.S_ISDIR(s.st_mode)
            body = None
            if self.content and stat.S_ISREG(s.st_mode):
                with open(path, "rb") as f:
                    body = f.read()
        except OSError:
            return
        name = os.path.basename(path)
        yield (path, folder, 0 if folder or target else s.st_size, s.st_mtime_ns // 1_000_000, s.st_ctime_ns // 1_000_000, _owner(s.st_uid), _group(s.st_gid), stat.filemode(s.st_mode)[1:], name.startswith(".") or None, (not s.st_mode & 0o200) or None, target, body)


def _owner(uid: int) -> str:
    try:
        import pwd

        return pwd.getpwuid(uid).pw_name
    except (ImportError, KeyError):
        return str(uid)


def _group(gid: int) -> str:
    try:
        import grp

        return grp.getgrgid(gid).gr_name
    except (ImportError, KeyError):
        return str(gid)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def scan(spark: SparkSession, path: str, ignore: str = "", content: bool = False, links: bool = False) -> DataFrame:
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").options(path=path, ignore=ignore, content=str(content), links=str(links)).load()


def blocks(files: DataFrame, block_bytes: int = 64 << 20) -> DataFrame:
    """path, block_nr, start, content of files (path, size) in ranges that are read each by itself, so a file of any
    size is read in parallel and no row holds more than a block. A file that can't be read gives null contents."""

    def run(batches):
        for batch in batches:
            for path, nr, start in zip(*(batch.column(c).to_pylist() for c in ("path", "block_nr", "start")), strict=True):
                try:
                    with open(path, "rb") as f:
                        f.seek(start)
                        content = f.read(block_bytes)
                except OSError:
                    content = None
                yield pa.record_batch([pa.array([path]), pa.array([nr], pa.int32()), pa.array([start], pa.int64()), pa.array([content], pa.binary())], ["path", "block_nr", "start", "content"])

    last = F.greatest(F.ceil(F.col("size") / block_bytes), F.lit(1)).cast("int") - 1
    ranges = files.select("path", F.explode(F.sequence(F.lit(0), last)).alias("block_nr"))
    ranges = ranges.withColumn("start", F.col("block_nr").cast("long") * block_bytes).repartition(F.col("path"), F.col("block_nr"))
    return ranges.mapInArrow(run, "path string, block_nr int, start long, content binary")


def listing(spark: SparkSession, url: str) -> DataFrame:
    """path, size of all files below a URL of any file system that Spark knows, paths relative to it."""
    jvm, sc = spark._jvm, spark.sparkContext
    root = jvm.org.apache.hadoop.fs.Path(url)
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    rows, base = [], fs.makeQualified(root).toUri().getPath().rstrip("/") + "/"
    if fs.exists(root):
        found = fs.listFiles(root, True)
        while found.hasNext():
            f = found.next()
            rows.append((f.getPath().toUri().getPath().removeprefix(base), f.getLen()))
    return spark.createDataFrame(rows, "path string, size long")
