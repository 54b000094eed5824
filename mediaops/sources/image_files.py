"""Image files below a folder as a data source: names are listed by tasks, of each file only the head is read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mediaops.sources.readers import IMAGE_SUFFIXES

HEAD_BYTES = 12


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file named as Spark names it."""
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "/", uri))


def hidden(name: str) -> bool:
    return name.startswith(("_", "."))


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class FileNames(DataSource):
    """Files below the option ``path``: path, dir, name, size; a partition per folder of the first ``levels`` levels."""

    @classmethod
    def name(cls) -> str:
        return "file_names"

    def schema(self) -> str:
        return "path string, dir string, name string, size long"

    def reader(self, schema) -> FileNameReader:
        return FileNameReader(self.options["path"], int(self.options.get("levels", 2)))


class FileNameReader(DataSourceReader):
    def __init__(self, root: str, levels: int):
        self.root, self.levels = root.rstrip("/"), levels

    def partitions(self) -> list[InputPartition]:
        """Only folders are named here, and only those of the first levels; tasks list what is in them."""
        fs, top = open_folder(self.root)
        found, level = [], [top.rstrip("/")]
        for depth in range(self.levels + 1):
            found += [Folder(path, depth == self.levels) for path in level]
            if depth < self.levels:
                inside = [i for path in level for i in fs.get_file_info(pafs.FileSelector(path))]
                level = sorted(i.path for i in inside if i.type == pafs.FileType.Directory and not hidden(i.base_name))
        return found

    def read(self, partition: Folder) -> Iterator[tuple]:
        fs, top = open_folder(self.root)
        top = top.rstrip("/")
        for info in fs.get_file_info(pafs.FileSelector(partition.path, recursive=partition.deep)):
            below = info.path[len(top) :]
            if info.type == pafs.FileType.File and not any(hidden(p) for p in below.split("/")):
                path = self.root + below
                yield path, path.rsplit("/", 1)[0], info.base_name, info.size


def read_image_heads(
    spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, levels: int = 2, tasks: int | None = None
) -> DataFrame:
    """Image files below a folder: path, dir, name, size, header (the first 12 bytes), as ``list_images`` gives them.

    Empty files are listed too.  The names of one large folder are dealt to ``tasks`` tasks (the session's shuffle
    partitions by default) before the heads are read.  Names that begin with a dot or an underscore are left out.
    """
    spark.dataSource.register(FileNames)
    files = spark.read.format("file_names").options(path=root, levels=str(levels)).load()
    suffix = F.lower(F.element_at(F.split("name", r"\."), -1))
    wanted = files.filter(F.col("name").contains(".") & suffix.isin(*suffixes))
    dealt = wanted.repartition(tasks, "path") if tasks else wanted.repartition("path")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_folder(root)
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                with fs.open_input_file(top.rstrip("/") + path[len(root.rstrip("/")) :]) as file:
                    out.append(file.read(HEAD_BYTES))
            yield from pa.Table.from_batches([batch]).append_column("header", pa.array(out, pa.binary())).to_batches()

    return dealt.mapInArrow(heads, "path string, dir string, name string, size long, header binary")
