"""DXF as a format of ``spark.read`` and ``spark.readStream``: one row per entity.

    dxf_format.register(spark)
    spark.read.format("dxf").load("s3://drawings/")
    spark.read.format("dxf").schema("drawing_id string, layer string, length double").load(folder)

Each file is a partition of its own, or as many small ones together as make up
``bytes`` (an option, 8 MB if not given). Only the columns of the schema are made.
Equality on ``drawing_id`` is pushed down, so other files are not opened. Files are
reached by the file systems that pyarrow knows; what only Spark can open goes by
``dxf.read_dxf``. A stream takes files by their time of change, and those of one
moment in the order of their paths.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from plumbline.sources import dxf

BYTES = 8 << 20


@dataclass(frozen=True)
class _File:
    path: str
    size: int
    changed: int

    @property
    def drawing_id(self) -> str:
        return re.sub(r"\.dxf$", "", self.path.rsplit("/", 1)[-1], flags=re.IGNORECASE)


@dataclass
class _Files(InputPartition):
    paths: tuple[tuple[str, str], ...]


def _open(where: str) -> tuple[fs.FileSystem, str]:
    if "://" in where:
        return fs.FileSystem.from_uri(where)
    return fs.LocalFileSystem(), unquote(re.sub(r"^file:", "", where))


def write_files(texts: DataFrame, folder: str) -> None:
    """Write each row of (name, value) as a file ``name``.dxf of the folder, all in one folder that is listed at once.

    Tasks write by pyarrow, under another name until a file is whole: Spark's writers need a
    folder for each name. A task that runs again writes the same files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(re.sub(r"^s3[an]:", "s3:", folder))
        store.create_dir(path, recursive=True)
        for batch in batches:
            for name, value in zip(batch["name"].to_pylist(), batch["value"], strict=True):
                temp = f"{path}/_temporary-{uuid.uuid4().hex}"
                with store.open_output_stream(temp) as out:
                    out.write(value.as_buffer())
                store.move(temp, f"{path}/{name}.dxf")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, schema=pa.schema([("n", pa.int64())]))

    texts.select("name", "value").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def listed(where: str) -> list[_File]:
    """The files named ``*.dxf`` below a folder, or the one file that ``where`` names, by time of change and path."""
    store, path = _open(where)
    info = store.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
    files = [_File(f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".dxf")]
    return sorted(files, key=lambda f: (f.changed, f.path))


def grouped(files: list[_File], most: int) -> list[_Files]:
    """Files together as far as they make up ``most`` bytes."""
    out: list[list[_File]] = []
    size = 0
    for f in files:
        if not out or size + f.size > most:
            out.append([])
            size = 0
        out[-1].append(f)
        size += f.size
    return [_Files(tuple((f.drawing_id, f.path) for f in part)) for part in out]


class _Reading:
    """What both readers share: the options, and how a partition is read."""

    def __init__(self, options: dict[str, str], schema: StructType):
        if "path" not in options:
            raise ValueError("the dxf format needs a path")
        self.where, self.names = options["path"], schema.names
        self.strict, self.most = options.get("mode", "PERMISSIVE").upper() == "FAILFAST", int(options.get("bytes", BYTES))

    def rows(self, partition: _Files) -> Iterator[tuple]:
        store, _ = _open(self.where)
        for drawing_id, path in partition.paths:
            with store.open_input_stream(path) as stream:
                text = stream.read().decode("utf-8", "replace")
            try:
                found = dxf.parse(text, self.strict)[2]
            except dxf.NotADrawing:
                if self.strict:
                    raise
                found = []
            for row in found:
                row["drawing_id"] = drawing_id
                yield tuple(_cell(row.get(n)) for n in self.names)


def _cell(value):
    return [(p["x"], p["y"]) for p in value] if isinstance(value, list) else value


class DxfReader(_Reading, DataSourceReader):
    wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("drawing_id",):
                values = {f.value} if isinstance(f, EqualTo) else {*f.value}
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[_Files]:
        return grouped([f for f in listed(self.where) if self.wanted is None or f.drawing_id in self.wanted], self.most)

    def read(self, partition: _Files) -> Iterator[tuple]:
        return self.rows(partition)


class DxfStreamReader(_Reading, DataSourceStreamReader):
    """Offsets are the time of change and path of the last file taken."""

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.where)
        return {"changed": files[-1].changed, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        place = lambda o: (o["changed"], o["path"])
        return grouped([f for f in listed(self.where) if place(start) < (f.changed, f.path) <= place(end)], self.most)

    def read(self, partition: _Files) -> Iterator[tuple]:
        return self.rows(partition)


class DxfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dxf"

    def schema(self) -> str:
        return dxf.ENTITY

    def reader(self, schema: StructType) -> DxfReader:
        return DxfReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DxfStreamReader:
        return DxfStreamReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make ``dxf`` known to ``spark.read.format`` and ``spark.readStream.format``, with pushed filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DxfSource)
