"""A Python data source for the feature files of songs (.npy): windows are read by seeking, so only the rows of a window leave
the store, and no file is read whole.

    windows.createOrReplaceTempView(...)
    spark.read.format("npy_windows").option("root", folder).option("windows", table of windows).load()

`root` may be any address that pyarrow opens (a path, file://, s3://, hdfs://). `windows` is a Parquet table with feature (the
file's name), k, source_start and source_end; each of its files is one task, which opens a song once for all its windows.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from metrolith.operators.windows import Windows

SCHEMA = "feature string, k long, frames long, rows array<array<float>>"


def header(file: pa.NativeFile) -> tuple[np.dtype, tuple[int, ...], int]:
    """The type and shape of an array file, and where its numbers begin."""
    start = file.read(10)
    if start[:6] != b"\x93NUMPY":
        raise ValueError("no array file")
    if start[6] == 1:
        size, at = struct.unpack("<H", start[8:10])[0], 10
    else:
        size, at = struct.unpack("<I", start[8:10] + file.read(2))[0], 12
    told = ast.literal_eval(file.read(size).decode("latin-1"))
    if told["fortran_order"] or len(told["shape"]) != 2:
        raise ValueError(f"rows of numbers are expected, not an array of shape {told['shape']}")
    return np.dtype(told["descr"]), told["shape"], at + size


def rows_of(file: pa.NativeFile, kind: np.dtype, shape: tuple[int, ...], at: int, begin: int, end: int) -> np.ndarray:
    """The rows from begin up to end, as far as there are."""
    begin, end = min(max(begin, 0), shape[0]), min(max(end, 0), shape[0])
    width = kind.itemsize * shape[1]
    file.seek(at + begin * width)
    return np.frombuffer(file.read(max(0, end - begin) * width), dtype=kind).reshape(-1, shape[1]).astype(np.float32)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.windows = options["root"], options["windows"]

    def partitions(self) -> list[InputPartition]:
        store, path = fs.FileSystem.from_uri(self.windows)
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        return [_File(f.path) for f in found if f.is_file and f.path.endswith(".parquet")]

    def read(self, partition: _File) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.windows)
        songs, root = fs.FileSystem.from_uri(self.root)
        with store.open_input_file(partition.path) as given:
            wanted = pq.read_table(given, columns=["feature", "k", "source_start", "source_end"]).to_pylist()
        for name, windows in groupby(sorted(wanted, key=lambda w: (w["feature"], w["source_start"], w["k"])), key=lambda w: w["feature"]):
            with songs.open_input_file(f"{root.rstrip('/')}/{name}") as file:
                kind, shape, at = header(file)
                for w in windows:
                    got = rows_of(file, kind, shape, at, w["source_start"], w["source_end"])
                    yield name, w["k"], shape[0], got.tolist()


class NpyWindows(DataSource):
    """The rows of song files that windows ask for."""

    @classmethod
    def name(cls) -> str:
        return "npy_windows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def window_features(windows: DataFrame, root: str, folder: str, w: Windows = Windows(), files: int = 200) -> DataFrame:
    """feature, k, features (as many rows as a window has, zeros where the song has none) and mask, read from the song files
    under root. windows: feature, k, source_start, source_end, left_pad. folder: a new address in a shared store for the list
    of windows, which is written song by song in `files` files."""
    session = windows.sparkSession
    windows.select("feature", "k", "source_start", "source_end", "left_pad").repartition(files, "feature").write.parquet(folder)
    session.dataSource.register(NpyWindows)
    read = session.read.format("npy_windows").option("root", root).option("windows", folder).load()
    told = read.join(session.read.parquet(folder).select("feature", "k", "left_pad"), ["feature", "k"])
    n, left = F.size("rows"), F.least(F.col("left_pad").cast("int"), F.lit(w.features))
    copied = F.least(n, w.features - left)
    width = F.size(F.get("rows", F.lit(0)))
    pad = lambda many: F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), F.coalesce(width, F.lit(0))), many)
    features = F.concat(pad(left), F.slice("rows", F.lit(1), copied), pad(w.features - left - copied))
    mask = F.transform(F.sequence(F.lit(0), F.lit(w.features - 1)), lambda i: (i >= left) & (i < left + copied))
    return told.select("feature", "k", features.alias("features"), mask.alias("mask"))
