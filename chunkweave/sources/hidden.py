"""Files whose names Spark's file sources skip (``__init__.py``, ``.config/x.md``).

A small Spark data source. Planning lists folders, not files; the tasks list and read the files of
their own folders.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size bigint, raw binary"
LISTED_LEVELS = 2
SAME_STORE = {"s3a": "s3", "s3n": "s3"}


class _Folder(InputPartition):
    def __init__(self, path: str, below: bool) -> None:
        self.path = path
        self.below = below


class _HiddenReader(DataSourceReader):
    """The driver lists folders of the first two levels only; a task lists and reads what is below one."""

    def __init__(self, root: str, extensions: tuple[str, ...]) -> None:
        self.root = root
        self.extensions = extensions

    def _open(self):
        from pyarrow import fs

        scheme, mark, rest = self.root.partition("://")
        if not mark:
            return fs.LocalFileSystem(), self.root.removeprefix("file:")
        try:
            return fs.FileSystem.from_uri(f"{SAME_STORE.get(scheme, scheme)}://{rest}")
        except ValueError as error:
            raise ValueError(f"files with hidden names cannot be listed below {self.root}; read with hidden=False") from error

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = self._open()
        found, level = [], [base.rstrip("/")]
        for depth in range(LISTED_LEVELS + 1):
            found += [_Folder(path, depth == LISTED_LEVELS) for path in level]
            if depth < LISTED_LEVELS:
                level = [
                    info.path for path in level for info in store.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory
                ]
        return found

    def read(self, partition: _Folder) -> Iterator[tuple]:
        from pyarrow import fs

        store, base = self._open()
        cut = len(base.rstrip("/")) + 1
        for info in store.get_file_info(fs.FileSelector(partition.path, recursive=partition.below)):
            path = info.path[cut:]
            hidden = any(part[0] in "_." for part in path.split("/") if part)
            if info.type == fs.FileType.File and hidden and path.lower().endswith(self.extensions):
                with store.open_input_stream(info.path) as stream:
                    raw = stream.read()
                yield path, len(raw), raw


class HiddenFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hidden_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _HiddenReader(self.options["root"], tuple(self.options["extensions"].split(",")))


def hidden_files(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    spark.dataSource.register(HiddenFiles)
    return (
        spark.read.format("hidden_files").option("root", root).option("extensions", ",".join(extensions)).load()
    )
