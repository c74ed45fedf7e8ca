"""Cubes of frames as Zarr (version 2), in chunks of some frames by a block of pixels, written as a whole or not at all."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.blocks import Grid, from_frames
from cadenza.sources import sinks
from cadenza.sources.folders import get, store

CHUNK_FRAMES = 16
#: Side of a chunk at most: with CHUNK_FRAMES frames 16 MB of 32-bit values.
CHUNK_SIDE = 512


def write_cube(blocks: DataFrame, folder: str, grid: Grid, bbox: tuple[float, float, float, float], attrs: dict | None = None, chunk_frames: int = CHUNK_FRAMES, overwrite: bool = False) -> None:
    """Writes blocks (k from 0, time, by, bx, bt) as the cube `folder` with bt (time, lat, lon), 32-bit, and its coordinates.

    A chunk's rows meet in one task. A frame or block that is missing is NaN; no frames are an error. A job that fails leaves nothing."""
    sinks.register(blocks.sparkSession)
    micros = F.unix_micros(F.col("time").cast("timestamp")).alias("micros")
    rows = blocks.select(F.col("k").cast("long").alias("k"), micros, "by", "bx", "bt", F.floor(F.col("k") / chunk_frames).alias("chunk"))
    dealt = rows.repartition(F.col("chunk"), F.col("by"), F.col("bx")).sortWithinPartitions("chunk", "by", "bx", "k").drop("chunk")
    options = {"path": folder, "rows": grid.rows, "cols": grid.cols, "size": grid.size, "frames": chunk_frames, "bbox": json.dumps(list(bbox)), "attrs": json.dumps(attrs or {})}
    dealt.write.format("cadenza_cube").options(**options).mode("overwrite" if overwrite else "append").save()


def build_cube(frames: DataFrame, folder: str, rows: int, cols: int, bbox: tuple[float, float, float, float], attrs: dict | None = None, chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """write_cube() of whole frames (k from 0, time, bt as array), replacing what is there; returns a row for each chunk: chunk, n_bytes."""
    if frames.isEmpty():
        raise ValueError("a cube needs at least one frame")
    grid = Grid(rows, cols, min(CHUNK_SIDE, max(rows, cols)))
    write_cube(from_frames(frames, ["k", "time"], ["bt"], grid), folder, grid, bbox, attrs, chunk_frames, overwrite=True)
    return frames.sparkSession.read.format("binaryFile").load(f"{folder}/bt/[0-9]*").select(F.element_at(F.split("path", "/"), -1).alias("chunk"), F.col("length").alias("n_bytes"))


def cube_info(folder: str) -> dict:
    """Shape, chunks, bounds and attributes of a cube; bounds from the attributes, else from the outer cells."""
    files, base = store(folder)
    spec, attrs = json.loads(get(files, f"{base}/bt/.zarray")), json.loads(get(files, f"{base}/.zattrs"))
    lat, lon = (np.frombuffer(zlib.decompress(get(files, f"{base}/{c}/0")), "<f8") for c in ("lat", "lon"))
    return {"shape": spec["shape"], "chunks": spec["chunks"], "attrs": attrs, "bbox": attrs.get("bbox") or edges_of(lat, lon)}


def edges_of(lat: np.ndarray, lon: np.ndarray) -> list[float]:
    """West, south, east and north edge of cells from their centres: half a step beyond the outermost."""
    half = lambda c: abs(c[1] - c[0]) / 2 if len(c) > 1 else 0.0
    return [float(lon.min() - half(lon)), float(lat.min() - half(lat)), float(lon.max() + half(lon)), float(lat.max() + half(lat))]


def read_blocks(spark: SparkSession, folder: str, first: int = 0, last: int | None = None) -> tuple[DataFrame, Grid]:
    """Blocks (k, time, by, bx, bt with missing as NULL) of the frames from `first` to before `last`, and their grid.

    A task reads a chunk at a time, of which other frames' chunks are not opened; a chunk without a file has no blocks. The times
    of a chunk stand beside its first block; where that is missing they are NULL."""
    info = cube_info(folder)
    (n, rows, cols), (step, size, _) = info["shape"], info["chunks"]
    grid, last = Grid(rows, cols, size), n if last is None else min(last, n)
    schema = "k long, micros long, by int, bx int, bt array<double>"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)
        for batch in batches:
            for chunk, by, bx in zip(*[batch.column(c).to_pylist() for c in ("chunk", "by", "bx")]):
                names = [f"{base}/bt/{chunk}.{by}.{bx}", f"{base}/time/{chunk}"]
                body, times = (get(files, i.path) if i.is_file else None for i in files.get_file_info(names))
                if body is None:
                    continue
                low, high = max(first, chunk * step), min(last, (chunk + 1) * step)
                h, w = min(size, rows - by * size), min(size, cols - bx * size)
                bt = np.frombuffer(zlib.decompress(body), "<f4").reshape(step, size, size)[low - chunk * step : high - chunk * step, :h, :w].astype(np.float64)
                micros = np.frombuffer(zlib.decompress(times), "<i8")[low - chunk * step : high - chunk * step] // 1000 if times else None
                flat = bt.reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bt) + 1) * (h * w), pa.int32()), pa.array(flat, mask=np.isnan(flat)))
                place = [pa.array([x] * len(bt), pa.int32()) for x in (by, bx)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, high)), pa.array([None] * len(bt), pa.int64()) if micros is None else pa.array(micros), *place, lists], names=["k", "micros", "by", "bx", "bt"])

    total = max(0, -(-last // step) - first // step) * grid.down * grid.across
    number, each = F.col("id"), grid.down * grid.across
    chunks = spark.range(total).select((F.floor(number / each) + first // step).cast("long").alias("chunk"), F.floor(number % each / grid.across).cast("int").alias("by"), (number % grid.across).cast("int").alias("bx"))
    out = chunks.repartition(max(1, min(total, 1000))).mapInArrow(read, schema)
    return out.select("k", F.timestamp_micros("micros").cast("timestamp_ntz").alias("time"), "by", "bx", "bt"), grid


def read_cube(spark: SparkSession, folder: str) -> DataFrame:
    """k, time and bt (array, missing as NULL) of every frame of a cube whose frames fit a row: its blocks put together."""
    found, grid = read_blocks(spark, folder)
    if grid.down * grid.across == 1:
        return found.select("k", "time", "bt")
    # Rows of a frame: from each block row its lines, from each of these the blocks side by side.
    width = lambda b: F.least(F.lit(grid.size), grid.cols - b["bx"] * grid.size)
    strips = found.groupBy("k", "time", "by").agg(F.array_sort(F.collect_list(F.struct("bx", "bt"))).alias("parts"))
    height = F.least(F.lit(grid.size), grid.rows - F.col("by") * grid.size)
    lines = F.flatten(F.transform(F.sequence(F.lit(0), height - 1), lambda y: F.flatten(F.transform("parts", lambda b: F.slice(b["bt"], (y * width(b) + 1).cast("int"), width(b).cast("int"))))))
    strips = strips.select("k", "time", F.struct("by", lines.alias("bt")).alias("strip"))
    return strips.groupBy("k", "time").agg(F.array_sort(F.collect_list("strip")).alias("strips")).select("k", "time", F.flatten("strips.bt").alias("bt"))
