"""JSON lines within zip files as a Spark data source, for reading and writing: ``spark.read.format("zip_jsonl")``.

Reading plans one split per file. A split streams the member's lines in order and stops after ``want`` lines whose stripped text has ``low`` to
``high`` characters, or after ``most`` lines; the limits are the feature, and ``nth``, the line's number, makes the choice the same in every run.
Writing is a commit in two steps: tasks write files under names that readers pass over, and the driver gives them their names when
all are there, or deletes them when the job fails. Files are opened by Arrow's file systems, so paths may be of any that it knows.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "zip_jsonl"
#: Rows and characters that a task holds as Python values at a time, about, whatever the size of Spark's batches.
ROWS, CHARS = 256, 2_000_000
COLUMNS = pa.schema({"path": pa.string(), "nth": pa.int64(), "text": pa.string()})


def _listed(path: str) -> list[str]:
    """The file, or the zip files of the folder in order of their names, without those whose name begins with _ or a dot."""
    files, base = fs.FileSystem.from_uri(path)
    if files.get_file_info(base).type != fs.FileType.Directory:
        return [path]
    found = files.get_file_info(fs.FileSelector(base))
    return [posixpath.join(path, f.base_name) for f in sorted(found, key=lambda f: f.base_name) if f.base_name.endswith(".zip") and f.base_name[0] not in "_."]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COLUMNS, strict=True)], schema=COLUMNS)


@dataclass
class File(InputPartition):
    path: str


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [File(f) for p in self.options["path"].split(",") for f in _listed(p.strip())]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for row in self.rows(partition):
            rows.append(row)
            chars += len(row[2])
            if len(rows) == ROWS or chars >= CHARS:
                yield _batch(rows)
                rows, chars = [], 0
        if rows:
            yield _batch(rows)

    def rows(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # no file at all
            return
        o = self.options
        low, high = int(o.get("low", 0)), int(o.get("high", 1 << 62))
        want, most, text = int(o.get("want", 1 << 62)), int(o.get("most", 1 << 62)), o.get("text", "text")
        files, base = fs.FileSystem.from_uri(partition.path)
        hits = 0
        with files.open_input_file(base) as raw, zipfile.ZipFile(raw) as z, z.open(o["member"]) as lines:
            for nth, line in enumerate(lines):
                if nth >= most or hits >= want:
                    return
                try:
                    value = json.loads(line).get(text)
                except (ValueError, AttributeError):
                    continue  # blank, unreadable and half-written lines count as lines
                if isinstance(value, str) and low <= len(value.strip()) <= high:
                    hits += 1
                    yield partition.path, nth, value


@dataclass
class Written(WriterCommitMessage):
    staged: str
    rows: int


class ZipWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.member, self.columns = options["path"], options["member"], columns

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, base = fs.FileSystem.from_uri(self.path)
        files.create_dir(base, recursive=True)
        staged, rows = f"_staged-{uuid.uuid4().hex}.zip", 0
        try:
            with files.open_output_stream(posixpath.join(base, staged)) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z, z.open(self.member, "w", force_zip64=True) as binary:
                with io.TextIOWrapper(binary, encoding="utf-8") as out:
                    for part in (b.slice(lo, ROWS) for b in iterator for lo in range(0, b.num_rows, ROWS)):
                        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                            out.write(json.dumps(dict(zip(self.columns, row, strict=True)), ensure_ascii=False) + "\n")
                        rows += part.num_rows
        except BaseException:
            files.delete_file(posixpath.join(base, staged))
            raise
        return Written(staged, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = fs.FileSystem.from_uri(self.path)
        run = uuid.uuid4().hex[:12]
        for i, m in enumerate(x for x in messages if x):
            files.move(posixpath.join(base, m.staged), posixpath.join(base, f"part-{i:05}-{run}.zip"))

    def abort(self, messages: list[Written | None]) -> None:
        files, base = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m:
                files.delete_file(posixpath.join(base, m.staged))


class ZipJsonLines(DataSource):
    """Options: ``path`` (files or folders, commas between), ``member``; for reading ``text`` (the key), ``low``, ``high``, ``want``, ``most``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, nth long, text string"

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ZipWriter:
        if overwrite:
            raise ValueError("zip_jsonl only appends")
        return ZipWriter(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipJsonLines)
