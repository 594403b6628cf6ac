"""Data sources for manifests and logs, whose writes take effect whole or not at all, and for listings of media.

A manifest is a folder of CSV files and a folder of commits. Each task of a write makes one file and says so to the driver; the
commit, one small file, names those that count. What a failed task or job has left is in no commit, so no reader sees it. Appends
of several writers at once all count; an overwrite hides what was committed before it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as csv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import share_package

#: Files of a folder that are listed by one task.
LISTED_TOGETHER = 10_000


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _read(files: fs.FileSystem, path: str) -> bytes:
    with files.open_input_stream(path) as f:
        return f.read()


def _write(files: fs.FileSystem, path: str, data: bytes) -> None:
    """Under another name first, so that nobody reads a part of it."""
    with files.open_output_stream(f"{path}.part") as f:
        f.write(data)
    files.move(f"{path}.part", path)


def committed(path: str) -> list[dict]:
    """(name, rows) of the files that count, in the order of their commits."""
    files, root = _place(path)
    found = files.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True))
    out: list[dict] = []
    for info in sorted((x for x in found if x.path.endswith(".json")), key=lambda x: x.base_name):
        commit = json.loads(_read(files, info.path))
        out = commit["files"] if commit["replaces"] else out + commit["files"]
    return out


@dataclass
class CsvFile(InputPartition):
    name: str


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class ManifestReader(DataSourceReader):
    """A partition for each file that counts."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.kinds = path, to_arrow_schema(schema)

    def partitions(self) -> list[CsvFile]:
        return [CsvFile(f["name"]) for f in committed(self.path)] or [CsvFile("")]

    def read(self, partition: CsvFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            yield pa.RecordBatch.from_pylist([], self.kinds)
            return
        files, root = _place(self.path)
        options = csv.ConvertOptions(column_types=self.kinds, include_columns=self.kinds.names, include_missing_columns=True, strings_can_be_null=True, quoted_strings_can_be_null=False)
        with files.open_input_stream(f"{root}/{partition.name}") as f:
            yield from csv.open_csv(f, parse_options=csv.ParseOptions(newlines_in_values=True), convert_options=options)


class ManifestWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.kinds, self.overwrite = path, to_arrow_schema(schema), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _place(self.path)
        files.create_dir(root)
        name, rows = f"part-{uuid.uuid4().hex}.csv", 0
        try:
            with files.open_output_stream(f"{root}/{name}") as f, csv.CSVWriter(f, self.kinds, write_options=csv.WriteOptions(quoting_style="all_valid")) as out:
                for batch in iterator:
                    out.write_batch(batch.cast(self.kinds))
                    rows += batch.num_rows
        except BaseException:
            files.delete_file(f"{root}/{name}")
            raise
        return Written(name, rows)

    def commit(self, messages: list[Written]) -> None:
        files, root = _place(self.path)
        files.create_dir(f"{root}/_commits")
        done = {"replaces": self.overwrite, "files": [{"name": m.name, "rows": m.rows} for m in messages if m is not None]}
        _write(files, f"{root}/_commits/{time.time_ns():020d}-{uuid.uuid4().hex}.json", json.dumps(done).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _place(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(f"{root}/{m.name}")


class ManifestSource(DataSource):
    """``spark.read.format("manifest").schema(...).load(path)`` and ``df.write.format("manifest").mode("append").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "manifest"

    def reader(self, schema: StructType) -> ManifestReader:
        return ManifestReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> ManifestWriter:
        return ManifestWriter(self.options["path"], schema, overwrite)


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool


class ListingReader(DataSourceReader):
    """A partition for the files of the folder itself, and one for each folder in it."""

    def __init__(self, path: str, endings: tuple[str, ...]):
        self.path, self.endings = path, endings

    def partitions(self) -> list[Folder]:
        files, root = _place(self.path)
        inner = [x.path for x in files.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory]
        return [Folder(root, False), *[Folder(p, True) for p in sorted(inner)]]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        files, _ = _place(self.path)
        found = files.get_file_info(fs.FileSelector(partition.path, recursive=partition.deep))
        kept = sorted((x for x in found if x.type == fs.FileType.File and x.base_name.lower().endswith(self.endings)), key=lambda x: x.path)
        for at in range(0, len(kept), LISTED_TOGETHER):
            part = kept[at : at + LISTED_TOGETHER]
            columns = [pa.array([x.path for x in part]), pa.array([x.size for x in part], pa.int64()), pa.array([x.mtime for x in part], pa.timestamp("us", "UTC"))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "length", "modified"])


class ListingSource(DataSource):
    """``spark.read.format("media_listing").option("endings", ".wav,.flac").load(path)``: (path, length, modified), folders within folders included."""

    @classmethod
    def name(cls) -> str:
        return "media_listing"

    def schema(self) -> str:
        return "path string, length long, modified timestamp"

    def reader(self, schema: StructType) -> ListingReader:
        return ListingReader(self.options["path"], tuple(x.strip().lower() for x in self.options.get("endings", ".wav,.flac,.mp3,.m4a,.ogg,.opus").split(",")))


def remove_leftovers(path: str, older_than: float = 86_400.0) -> list[str]:
    """Delete the files that no commit names and that are older than so many seconds, more than any write takes; their names."""
    files, root = _place(path)
    known = {f["name"] for info in files.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True)) if info.path.endswith(".json") for f in json.loads(_read(files, info.path))["files"]}
    gone = []
    for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.type == fs.FileType.File and info.base_name.endswith(".csv") and info.base_name not in known and info.mtime.timestamp() < time.time() - older_than:
            files.delete_file(info.path)
            gone.append(info.base_name)
    return gone


def register(spark: SparkSession) -> None:
    share_package(spark)
    for source in (ManifestSource, ListingSource):
        spark.dataSource.register(source)


def append_rows(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows of ``df`` behind those of the manifest, or in their place; all or none of them."""
    register(df.sparkSession)
    df.write.format("manifest").mode("overwrite" if overwrite else "append").save(path)


def read_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows that are committed; none for a manifest that isn't there. Columns that a file lacks are null."""
    register(spark)
    return spark.read.format("manifest").schema(schema).load(path)


def list_files(spark: SparkSession, path: str, endings: tuple[str, ...] = (".wav", ".flac", ".mp3", ".m4a", ".ogg", ".opus")) -> DataFrame:
    register(spark)
    return spark.read.format("media_listing").option("endings", ",".join(endings)).load(path)
