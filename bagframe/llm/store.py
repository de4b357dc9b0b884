"""Files in the folder that driver and executors share, and batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from bagframe.session import scratch_path


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder of the session."""
    return scratch_path(spark, name)


#: Rows of a table of short rows that go into one file.
FILE_ROWS = 200_000


def written(df: DataFrame, name: str, rows: int | None = None, files: int | None = None) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: lineage ends, and no lost executor
    takes them along. `rows` (of a table of short rows, if the caller knows a bound) or `files` keep a small table from becoming
    many tiny files; both grow with the data."""
    path = folder(df.sparkSession, name)
    if rows is not None:
        files = 1 + rows // FILE_ROWS
    if files is not None:
        df = df.coalesce(files)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow file system and path for a folder URI; the folder is made if it is missing."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    system.create_dir(where, recursive=True)
    return system, where


def read_bytes(path: str, name: str) -> bytes:
    system, where = open_folder(path)
    with system.open_input_stream(f"{where}/{name}") as f:
        return f.read()


def write_bytes(path: str, name: str, data: bytes) -> None:
    system, where = open_folder(path)
    with system.open_output_stream(f"{where}/{name}") as f:
        f.write(data)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one piece has about `most` bytes of text, or a single row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first, total = 0, 0
        for i, size in enumerate(sizes):
            if i > first and total + size > most:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += int(size)
        yield batch.slice(first)
