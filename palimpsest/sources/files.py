"""The data source `repo_files`: every entry below a storage root as (path, kind, length, content).

Names that begin with an underscore or a dot, empty directories and links are listed too, which Spark's file readers
leave out. Content is read for declarations, inventories and sidecars only. A partition is one entry of the root, so
one task lists one subtree; the root may be any URI that pyarrow's file systems know, or a folder all executors see.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, kind string, length long, content binary"


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def is_metadata(name: str) -> bool:
    return name.startswith("0=") or name.startswith("inventory.json") or name == "ocfl_layout.json"


class Subtree(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class FilesReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")

    def _entries(self, directory: str):
        from pyarrow import fs

        store, _ = _store(self.root)
        return store, sorted(store.get_file_info(fs.FileSelector(directory)), key=lambda x: x.base_name)

    def partitions(self) -> list[InputPartition]:
        return [Subtree(x.base_name) for x in self._entries(_store(self.root)[1])[1]]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        from pyarrow import fs

        store, top = _store(self.root)
        todo = [store.get_file_info(f"{top}/{partition.name}")]
        kinds = {fs.FileType.File: "file", fs.FileType.Directory: "directory"}
        while todo:
            x = todo.pop()
            kind = kinds.get(x.type, "other")
            content = None
            if kind == "file" and is_metadata(x.base_name):
                with store.open_input_stream(x.path) as f:
                    content = f.read()
            yield x.path[len(top) + 1 :], kind, x.size if kind == "file" else None, content
            if kind == "directory":
                todo += self._entries(x.path)[1]


class RepoFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FilesReader(self.options["path"])


def repo_files(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(RepoFiles)
    return spark.read.format("repo_files").option("path", root).load()
