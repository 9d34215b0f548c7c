"""Point clouds as files of the PLY format, ASCII and little-endian binary.

`read_points` reads them from any file system that Spark reads, one Arrow batch per block of points. The data source
`spark.read.format("ply")` and `df.write.format("ply")` opens files by itself and needs a path that all executors mount;
it reads one file per task without holding it, and writes one binary file per task, block by block. Columns: file_path, x,
y, z, red, green, blue, instance_id (from the colour, in base 255).
"""

from __future__ import annotations

import glob
import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Names and types of the vertex properties of the format.
TYPES = {"char": "i1", "uchar": "u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8", "int8": "i1", "uint8": "u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "float32": "<f4", "float64": "<f8"}
SCHEMA = "file_path string, x float, y float, z float, red int, green int, blue int, instance_id int"
POINTS_PER_BATCH = 1 << 17


def header(f) -> tuple[str, int, list[tuple[str, str]]]:
    """(format, number of points, [(property, numpy type)]) of an open file, which is left at the first point."""
    if f.readline().strip() != b"ply":
        raise ValueError("not a point cloud file")
    kind, count, properties, element = "", 0, [], ""
    while True:
        line = f.readline()
        if not line:
            raise ValueError("the header has no end")
        words = line.decode("ascii", "replace").split()
        if words[:1] == ["end_header"]:
            return kind, count, properties
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            element = words[1]
            count = int(words[2]) if element == "vertex" else count
        elif words[:1] == ["property"] and element == "vertex":
            properties.append((words[-1], TYPES[words[1]]))


def blocks(f) -> Iterator[dict[str, np.ndarray]]:
    """The properties of the points of an open file, block by block."""
    kind, count, properties = header(f)
    row = np.dtype(properties)
    for start in range(0, count, POINTS_PER_BATCH):
        n = min(POINTS_PER_BATCH, count - start)
        if kind == "ascii":
            values = np.array([f.readline().split()[: len(properties)] for _ in range(n)], dtype=np.float64).reshape(n, len(properties))
            yield {name: values[:, i] for i, (name, _) in enumerate(properties)}
        elif kind == "binary_little_endian":
            block = np.frombuffer(f.read(n * row.itemsize), row)
            yield {name: block[name] for name, _ in properties}
        else:
            raise ValueError(f"format {kind} is not supported")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The points of the files below a path of any file system; SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                for block in blocks(io.BytesIO(content.as_buffer())):
                    yield points_table(name, block)

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.ply").load(path)
    return found.select(F.col("path"), F.col("content")).mapInArrow(run, SCHEMA)


def points_table(path: str, p: dict[str, np.ndarray]) -> pa.RecordBatch:
    n = len(p["x"])
    colour = [np.asarray(p.get(c, np.zeros(n))).astype(np.int32) for c in ("red", "green", "blue")]
    number = colour[0] + colour[1] * 255 + colour[2] * 65025
    columns = [pa.array([path] * n, pa.string()), *[pa.array(np.asarray(p[c]).astype(np.float32)) for c in "xyz"], *[pa.array(c) for c in colour], pa.array(number.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["file_path", "x", "y", "z", "red", "green", "blue", "instance_id"])


def write_points(path: str, rows: Iterator) -> int:
    """Binary file of x, y, z, red, green, blue of some rows; returns their number, which the header gets at the end."""
    row = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])
    names = {"<f4": "float", "|u1": "uchar"}
    head = lambda n: "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {n:020d}", *[f"property {names[row[c].str]} {c}" for c in row.names], "end_header", ""]).encode()
    count = 0
    with open(path, "wb") as f:
        f.write(head(0))
        while held := list(islice(rows, POINTS_PER_BATCH)):
            block = np.zeros(len(held), row)
            for name in row.names:
                block[name] = [r[name] for r in held]
            f.write(block.tobytes())
            count += len(held)
        f.seek(0)
        f.write(head(count))
    return count


def mounted(path: str) -> str:
    """The path without the scheme of a mounted file system."""
    path = path.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError(f"{path} is not on a mounted file system; read_points reads it")
    return path


@dataclass
class FilePartition(InputPartition):
    path: str


class PlyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = mounted(path)

    def partitions(self) -> list[FilePartition]:
        found = sorted(glob.glob(os.path.join(self.path, "**", "*.ply"), recursive=True)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [FilePartition(p) for p in found]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            for block in blocks(f):
                yield points_table(partition.path, block)


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    points: int


class PlyWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = mounted(path)
        os.makedirs(self.path, exist_ok=True)

    def write(self, rows) -> Written:
        to = os.path.join(self.path, f"part-{uuid.uuid4().hex}.ply")
        count = write_points(to + ".tmp", iter(rows))
        if not count:
            os.remove(to + ".tmp")
        return Written(to if count else None, count)

    def commit(self, messages) -> None:
        for m in messages:
            if m is not None and m.path:
                os.replace(m.path + ".tmp", m.path)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path + ".tmp"):
                os.remove(m.path + ".tmp")


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PlyReader:
        return PlyReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)
