"""Shared folders: where tables and files between steps go, and how tasks open files there."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Names in a batch of those that a folder has.
NAMES = 10_000


def shared(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir. Where that is unset a local session gets a folder; a cluster has no default."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='cadenza-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to a shared folder and reads it back, so that all that is made from it sees the same rows."""
    spark, path = df.sparkSession, shared(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder: local, HDFS, S3 or GCS."""
    if uri.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put(files: fs.FileSystem, path: str, content: bytes) -> None:
    """Writes a file under another name and moves it, so that a task that runs twice leaves one whole file."""
    put_parts(files, path, (content,))


def put_parts(files: fs.FileSystem, path: str, parts: Iterable[bytes]) -> None:
    """put() of the parts, one after the other."""
    folder = path.rsplit("/", 1)[0]
    part = f"{folder}/_{uuid.uuid4().hex}"
    try:
        out = files.open_output_stream(part)
    except FileNotFoundError:  # the folder, which most files find there
        files.create_dir(folder, recursive=True)
        out = files.open_output_stream(part)
    with out:
        for content in parts:
            out.write(content)
    try:
        files.move(part, path)
    except OSError:  # a store that does not move over a file
        if files.get_file_info(path).type != fs.FileType.File:
            raise
        files.delete_file(path)
        files.move(part, path)


def _names(files: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """The name of each entry of a folder and whether it is a folder itself; of a local folder one after the other, without a list."""
    if isinstance(files, fs.LocalFileSystem):
        with os.scandir(folder) as entries:
            for entry in entries:
                yield entry.name, entry.is_dir()
    else:
        for info in files.get_file_info(fs.FileSelector(folder)):
            yield info.base_name, info.type == fs.FileType.Directory


def _walk(files: fs.FileSystem, folder: str, suffix: str) -> Iterator[str]:
    for name, inner in _names(files, folder):
        if inner and "=" in name:
            yield from (f"{name}/{n}" for n in _walk(files, f"{folder}/{name}", suffix))
        elif not inner and name.endswith(suffix) and not name.startswith(("_", ".")):
            yield name


def listed(spark: SparkSession, uri: str, suffix: str) -> DataFrame:
    """path of the files with this suffix in a folder, and in its partitions (name=value), dealt to as many tasks as a shuffle has.

    A task lists the folder and passes the names on in batches, so nothing of the driver grows with the number of files. Names that
    begin with _ or . are left out, as Spark does. A path of one file is that file."""
    uri = uri.rstrip("/") or "/"
    files, base = store(uri)
    kind = files.get_file_info(base).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(uri)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(uri)
        for batch in batches:
            found = []
            for name in _walk(files, base, suffix) if batch.num_rows else ():
                found.append(f"{uri}/{name}")
                if len(found) == NAMES:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["path"])
                    found = []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["path"])

    rows = spark.createDataFrame([(uri,)], "path string") if kind == fs.FileType.File else spark.range(0, 1, 1, 1).mapInArrow(names, "path string")
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")


def get(files: fs.FileSystem, path: str) -> bytes:
    with files.open_input_stream(path) as f:
        return f.read()
