"""Images, matrices, pickles and archives, decoded from `binaryFile` rows on the executors."""

from __future__ import annotations

import io
import pickle
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def binary_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """file_path, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select(F.col("path").alias("file_path"), "content")


def decode(files: DataFrame, kernel: Callable[[bytes], list[tuple]], columns: str) -> DataFrame:
    """file_path and the columns of the rows that the kernel makes of each file; a file it cannot read gives none."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["file_path"], pdf["content"]):
                try:
                    rows += [(path, *r) for r in kernel(bytes(content))]
                except (ValueError, KeyError, IndexError, struct.error, zlib.error, zipfile.BadZipFile, pickle.UnpicklingError, EOFError):
                    continue
            yield pd.DataFrame(rows, columns=["file_path", *names])

    return files.select("file_path", "content").mapInPandas(run, f"file_path string, {columns}")


def pgm(content: bytes) -> np.ndarray:
    """Grey image of 8 or 16 bits."""
    words, at = [], 0
    while len(words) < 4:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while not content[end : end + 1].isspace():
            end += 1
        words.append(content[at:end])
        at = end
    width, height, top = int(words[1]), int(words[2]), int(words[3])
    if words[0] == b"P2":
        return np.array(content[at:].split(), dtype=np.int64).reshape(height, width)
    if words[0] != b"P5":
        raise ValueError("not a grey image")
    return np.frombuffer(content, ">u2" if top > 255 else "u1", width * height, at + 1).reshape(height, width).astype(np.int64)


def png(content: bytes) -> np.ndarray:
    """Grey PNG of 8 or 16 bits without interlacing."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, width, height, depth = 8, b"", 0, 0, 8
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if colour or interlace or depth not in (8, 16):
                raise ValueError("only plain grey images are read")
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    step, raw = depth // 8, zlib.decompress(data)
    line = width * step
    out = np.zeros((height, line), np.uint8)
    for y in range(height):
        how, row = raw[y * (line + 1)], bytearray(raw[y * (line + 1) + 1 : (y + 1) * (line + 1)])
        up = out[y - 1] if y else np.zeros(line, np.uint8)
        for x in range(line if how else 0):
            a, b, c = (row[x - step] if x >= step else 0), int(up[x]), (int(up[x - step]) if x >= step else 0)
            if how == 1:
                add = a
            elif how == 2:
                add = b
            elif how == 3:
                add = (a + b) // 2
            else:
                p = a + b - c
                add = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row[x] = (row[x] + add) & 255
        out[y] = row
    return out.astype(np.int64) if depth == 8 else out.view(">u2").astype(np.int64)


def pixels(image: np.ndarray) -> list[tuple[int, int, int]]:
    """(v, u, value) of the pixels that are not 0."""
    v, u = np.nonzero(image)
    return list(zip(v.tolist(), u.tolist(), image[v, u].tolist()))


def read_depth(spark: SparkSession, path: str, glob: str = "*.pgm") -> DataFrame:
    return decode(binary_files(spark, path, glob), lambda b: pixels(pgm(b)), "v int, u int, value int")


def read_mask(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    return decode(binary_files(spark, path, glob), lambda b: pixels(png(b)), "v int, u int, value int")


def npy(content: bytes) -> np.ndarray:
    return np.load(io.BytesIO(content), allow_pickle=False)


def read_transforms(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    """file_path, t (16 numbers) of 4 x 4 matrices; others are left out."""
    return decode(binary_files(spark, path, glob), lambda b: [(m.ravel().tolist(),)] if (m := npy(b).astype(float)).shape == (4, 4) else [], "t array<double>")


class PlainUnpickler(pickle.Unpickler):
    """Reads containers, numbers, texts and numpy arrays, and refuses anything that would run code."""

    ALLOWED = {("numpy", "dtype"), ("numpy", "ndarray"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar"), ("numpy._core.numeric", "_frombuffer"), ("numpy.core.numeric", "_frombuffer")}

    def find_class(self, module: str, name: str):
        if (module, name) in self.ALLOWED:
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")


def records(content: bytes) -> list[tuple[str]]:
    """JSON of each dictionary of a pickled list; other members are skipped."""
    import json

    found = PlainUnpickler(io.BytesIO(content)).load()
    plain = lambda x: x.tolist() if hasattr(x, "tolist") else str(x)
    return [(json.dumps(r, default=plain),) for r in found if isinstance(r, dict)] if isinstance(found, list) else []


def read_pickles(spark: SparkSession, path: str, schema: str, glob: str = "*.pkl") -> DataFrame:
    """Rows of the given struct of pickled lists of dictionaries."""
    return decode(binary_files(spark, path, glob), records, "json string").select("file_path", F.from_json("json", schema).alias("r")).select("file_path", "r.*")


def members(content: bytes) -> list[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and not i.filename.startswith("/") and ".." not in i.filename.split("/")]


def read_archives(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """file_path, member, content of zip archives; members with unsafe paths are left out."""
    return decode(binary_files(spark, path, glob), members, "member string, content binary")
