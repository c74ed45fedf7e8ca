"""Sinks that show all of a job or nothing: cubes of chunks, and folders of files.

    register(spark)
    blocks.write.format("cadenza_cube").option("path", folder).options(rows=..., cols=..., size=...).mode("append").save()
    files.write.format("cadenza_files").option("path", folder).mode("append").save()

Tasks write into a folder of the job beside the target. When all have ended, the driver moves that folder to the target in one step,
with an index in it; when one fails for good, the driver deletes it. A task that runs twice writes the same names, so the last whole
one stays. A target that is there is an error, or with mode overwrite is replaced in the same step.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from cadenza.sources.folders import put, store


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: numbers that the driver adds up, and names that only one task may have."""

    files: int = 0
    n_bytes: int = 0
    most_k: int = -1
    claims: list[tuple[int, ...]] = field(default_factory=list)


class StagedWriter(DataSourceArrowWriter):
    """Writes of tasks in a folder of the job; the target appears when all of it is there."""

    def __init__(self, options, overwrite: bool):
        self.target, self.overwrite = options["path"].rstrip("/"), overwrite
        self.staged = f"{self.target}.job-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, base = store(self.staged)
        done = Written()
        for name, content in self.contents(batches, done):
            put(files, f"{base}/{name}", content)
            done.files += 1
            done.n_bytes += len(content)
        return done

    def contents(self, batches: Iterator[pa.RecordBatch], done: Written) -> Iterator[tuple[str, bytes]]:
        """Names and contents of the files of a task."""
        raise NotImplementedError

    def finish(self, messages: list[Written]) -> Iterator[tuple[str, bytes]]:
        """Files that describe the whole, from what the tasks say."""
        return iter(())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        found = [m for m in messages if m is not None]
        files, base = store(self.staged)
        target = store(self.target)[1]
        files.create_dir(base, recursive=True)
        try:
            for name, content in self.finish(found):
                put(files, f"{base}/{name}", content)
            there = files.get_file_info(target).type != fs.FileType.NotFound
            if there and not self.overwrite:
                raise FileExistsError(f"{self.target} is there; write with mode overwrite, or to another folder")
            if there:
                old = f"{target}.old-{uuid.uuid4().hex}"
                files.move(target, old)
                files.move(base, target)
                files.delete_dir(old)
            else:
                files.move(base, target)
        except BaseException:
            self.abort(messages)
            raise

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base = store(self.staged)
        if files.get_file_info(base).type != fs.FileType.NotFound:
            files.delete_dir(base)


class FilesWriter(StagedWriter):
    """Rows (name, content) as files, and an index of the names and lengths in parts, one by each task."""

    def contents(self, batches, done):
        index = []
        for batch in batches:
            for name, content in zip(batch["name"].to_pylist(), batch["content"].to_pylist()):
                if name.startswith(("/", "_")) or ".." in name.split("/"):
                    raise ValueError(f"no name for a file: {name}")
                index.append(json.dumps({"name": name, "n_bytes": len(content)}))
                yield name, content
        if index:
            yield f"_index/{TaskContext.get().partitionId():06d}.json", "\n".join(index).encode()

    def finish(self, messages):
        yield "_done", json.dumps({"files": sum(m.files for m in messages), "n_bytes": sum(m.n_bytes for m in messages)}).encode()


def _array(shape: list[int], chunks: list[int], dtype: str, fill) -> bytes:
    return json.dumps({
        "zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": dtype, "compressor": {"id": "zlib", "level": 5}, "fill_value": fill, "order": "C", "filters": None,
    }).encode()


class CubeWriter(StagedWriter):
    """Rows (k, micros, by, bx, bt) as a cube (Zarr, version 2) with chunks of `frames` frames by size by size pixels.

    The rows of a chunk come to one task one after another, as write_cube() deals them; two tasks with one chunk are an error, and so are
    two different blocks at one place."""

    def __init__(self, options, overwrite: bool):
        super().__init__(options, overwrite)
        self.rows, self.cols, self.size = (int(options[k]) for k in ("rows", "cols", "size"))
        self.frames = int(options.get("frames", 16))
        self.bbox, self.attrs = json.loads(options["bbox"]), json.loads(options.get("attrs", "{}"))

    def contents(self, batches, done):
        here, chunk, seen, times = None, None, None, {}

        def flush():
            if here is None:
                return
            done.claims.append(here)
            yield f"bt/{here[0]}.{here[1]}.{here[2]}", zlib.compress(chunk.tobytes(), 5)
            if here[1:] == (0, 0):
                stamps = np.zeros(self.frames, "<i8")
                for place, micros in times.items():
                    stamps[place] = micros * 1000
                yield f"time/{here[0]}", zlib.compress(stamps.tobytes(), 5)

        for batch in batches:
            lists = batch["bt"]
            offsets, values = lists.offsets.to_numpy(), lists.values.cast(pa.float32()).to_numpy(zero_copy_only=False)
            for n, (k, micros, by, bx) in enumerate(zip(*[batch[c].to_pylist() for c in ("k", "micros", "by", "bx")])):
                if (k // self.frames, by, bx) != here:
                    yield from flush()
                    here, times, seen = (k // self.frames, by, bx), {}, {}
                    chunk = np.full((self.frames, self.size, self.size), np.nan, "<f4")
                h, w = min(self.size, self.rows - by * self.size), min(self.size, self.cols - bx * self.size)
                own = values[offsets[n] : offsets[n + 1]]
                place = k % self.frames
                if place in seen and not np.array_equal(chunk[place, :h, :w].ravel(), own, equal_nan=True):
                    raise ValueError(f"two different blocks at k = {k}, by = {by}, bx = {bx}")
                chunk[place, :h, :w] = own.reshape(h, w)
                seen[place], times[place] = True, micros
                done.most_k = max(done.most_k, k)
        yield from flush()

    def finish(self, messages):
        claims = [c for m in messages for c in m.claims]
        if len(set(claims)) < len(claims):
            raise ValueError("a chunk was written by two tasks; deal the rows by chunk")
        n = max((m.most_k for m in messages), default=-1) + 1
        if not n:
            raise ValueError("a cube needs at least one frame")
        west, south, east, north = self.bbox
        axes = {"lat": north - (np.arange(self.rows) + 0.5) * (north - south) / self.rows, "lon": west + (np.arange(self.cols) + 0.5) * (east - west) / self.cols}
        for name, axis in axes.items():
            yield f"{name}/0", zlib.compress(axis.astype("<f8").tobytes())
        for name, shape, chunks, dtype, fill, dims in (
            ("bt", [n, self.rows, self.cols], [self.frames, self.size, self.size], "<f4", "NaN", ["time", "lat", "lon"]), ("time", [n], [self.frames], "<i8", None, ["time"]),
            ("lat", [self.rows], [self.rows], "<f8", "NaN", ["lat"]), ("lon", [self.cols], [self.cols], "<f8", "NaN", ["lon"]),
        ):
            yield f"{name}/.zarray", _array(shape, chunks, dtype, fill)
            yield f"{name}/.zattrs", json.dumps({"_ARRAY_DIMENSIONS": dims, **({"units": "nanoseconds since 1970-01-01"} if name == "time" else {})}).encode()
        yield ".zattrs", json.dumps({"Conventions": "CF-1.8", "bbox": self.bbox, **self.attrs}).encode()
        yield ".zgroup", b'{"zarr_format": 2}'


class FilesSink(DataSource):
    """Rows (name string, content binary) as files under `path`."""

    @classmethod
    def name(cls) -> str:
        return "cadenza_files"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options, overwrite)


class CubeSink(DataSource):
    """Rows (k long, micros long, by int, bx int, bt array<double>) as a cube; options path, rows, cols, size, frames, bbox and attrs (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "cadenza_cube"

    def writer(self, schema, overwrite: bool) -> CubeWriter:
        return CubeWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the sinks known to a session."""
    spark.dataSource.register(FilesSink)
    spark.dataSource.register(CubeSink)
