"""Folder trees as a Spark data source: listed and read by executors, empty files included.

Spark's own file sources list all names in the driver and leave out files of no bytes. Here every task lists the
directories above `fan` levels and takes its share by a hash of names; what lies below is listed by the one task that took it.
So the driver holds no names, and each file is opened once, by the task that found it.
"""

from __future__ import annotations

import fnmatch
import re
import sys
import zlib
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def filesystem(root: str):
    """The file system of a folder's name, and the name in it; s3a is S3."""
    from pyarrow import fs

    if re.match("(file:)?/", root):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", root).rstrip("/") or "/"
    found, path = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", root))
    return found, path.rstrip("/")


class Folder(DataSource):
    """Options: path, names (comma-separated patterns of file names, all if left out), recursive, content, fan, parts."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return "path string, relpath string, size long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(dict(self.options))


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.names = [n for n in options.get("names", "").split(",") if n]
        self.recursive = options.get("recursive", "true") == "true"
        self.content = options.get("content", "false") == "true"
        self.fan, self.parts = int(options.get("fan", "1")), int(options.get("parts", "8"))

    def wanted(self, name: str) -> bool:
        """As in a shell, only a pattern that begins with a dot finds a name that does."""
        return not self.names or any(fnmatch.fnmatchcase(name, n) and (n[0] == "." or name[0] != ".") for n in self.names)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system, root = filesystem(self.root)

        def mine(relpath: str) -> bool:
            return zlib.crc32(relpath.encode("utf-8", "surrogateescape")) % self.parts == partition.value

        def below(folder: str, depth: int) -> Iterator[tuple]:
            for info in system.get_file_info(fs.FileSelector(folder)):
                relpath = info.path[len(root.rstrip("/")) + 1:]
                # Above `fan` levels all tasks list, and share out files and folders; below that everything is this task's.
                if info.type == fs.FileType.Directory:
                    if self.recursive and (depth + 1 < self.fan or depth >= self.fan or mine(relpath)):
                        yield from below(info.path, depth + 1)
                elif (depth >= self.fan or mine(relpath)) and self.wanted(info.base_name):
                    data = None
                    if self.content:
                        with system.open_input_stream(info.path) as stream:
                            data = stream.read()
                    yield info.path, relpath, info.size, data

        return below(root, 0)


def folder(spark: SparkSession, root: str, names: tuple[str, ...] = (), recursive: bool = True, content: bool = False, fan: int = 1,
           parts: int | None = None) -> DataFrame:
    """(path, relpath, size, content) of the files below `root`; content is null unless asked for.

    `names` are patterns of file names, as a shell has them, case included. `fan` is the number of levels whose entries are dealt
    out one by one; all tasks list those, so it is best kept to levels of few names. `parts` tasks do the work, two per core if not said.
    """
    spark.dataSource.register(Folder)
    return (spark.read.format("folder").options(names=",".join(names), recursive=str(recursive).lower(), content=str(content).lower(), fan=fan,
                                                parts=parts or 2 * spark.sparkContext.defaultParallelism).load(root))
