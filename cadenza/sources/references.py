"""Many files as one virtual cube: a manifest of the byte ranges of their frames along time, and the coordinates in its header.

    combine(spark, files, folder)          # files: rows (path); only headers are read
    open_combined(spark, folder)           # k, time, bt, by ranges

The manifest is a table, so it may have as many rows as there are files; the header is one small document.
"""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import sequence
from cadenza.sources import netcdf
from cadenza.sources.folders import get, put, store

_ROWS = "path string, time string, variable string, dtype string, fill double, n_rows int, n_cols int, offset long, length long, lat binary, lon binary"
_ALIKE = ["variable", "dtype", "fill", "n_rows", "n_cols", "lat", "lon"]


def describe(path: str) -> dict:
    """What a classic file's header says of its frame: type, shape, byte range and coordinates."""
    files, name = store(path)
    with files.open_input_file(name) as f:
        ds = netcdf.open_ranges(lambda offset, length: f.read_at(length, offset))
        own = {k.lower(): k for k in ds.variables}
        variable = next((own[n.lower()] for n in netcdf.BT_NAMES if n.lower() in own), None)
        if variable is None:
            raise ValueError(f"{path}: no temperature")
        v = ds.variables[variable].spec
        if v.record or len(v.shape) < 2:
            raise ValueError(f"{path}: the frame is not in one piece")
        axis = lambda n: np.asarray(ds.variables[n].data, "<f8").tobytes() if n in ds.variables else b""
        return {
            "path": path, "time": ds.attrs.get("time"), "variable": variable, "dtype": v.dtype.str, "fill": float(v.attrs.get("_FillValue", np.nan)), "n_rows": v.shape[-2], "n_cols": v.shape[-1],
            "offset": v.begin, "length": math.prod(v.shape) * v.dtype.itemsize, "lat": axis("lat"), "lon": axis("lon"),
        }


def combine(spark: SparkSession, files: DataFrame, folder: str) -> dict:
    """Writes the manifest of files (path) and its header to `folder`, in order of time and path, and returns the header.

    Files whose variable, type, fill value, shape or coordinates differ from the most usual ones are an error that names one of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([describe(p) for p in batch["path"].to_pylist()], schema)

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in _ROWS.split(", "))])
    found = files.select("path").mapInArrow(run, _ROWS)
    found.write.mode("overwrite").parquet(f"{folder}/described")
    found = spark.read.schema(_ROWS).parquet(f"{folder}/described")
    groups = found.groupBy(*_ALIKE).agg(F.count("*").alias("n"), F.min("path").alias("path")).orderBy(F.desc("n"), "path").limit(2).collect()
    if not groups:
        raise ValueError("no files to combine")
    if len(groups) > 1:
        odd = [c for c in _ALIKE if groups[0][c] != groups[1][c] and not (c == "fill" and math.isnan(groups[0][c]) and math.isnan(groups[1][c]))]
        raise ValueError(f"{groups[1]['path']} differs from the others in {', '.join(odd)}")
    one = groups[0]
    placed = sequence.ordinals(found.select(F.to_timestamp("time").cast("timestamp_ntz").alias("time"), "path", "offset", "length"), ["time", "path"], "k")
    placed.write.mode("overwrite").parquet(f"{folder}/chunks")
    header = {
        "shape": [one["n"], one["n_rows"], one["n_cols"]], "variable": one["variable"], "dtype": one["dtype"], "fill": None if math.isnan(one["fill"]) else one["fill"],
        "lat": base64.b64encode(one["lat"]).decode(), "lon": base64.b64encode(one["lon"]).decode(),
    }
    target, base = store(folder)
    put(target, f"{base}/header.json", json.dumps(header).encode())
    return header


def coordinates(header: dict) -> tuple[np.ndarray, np.ndarray]:
    """Latitudes and longitudes that stand in a header."""
    return tuple(np.frombuffer(base64.b64decode(header[c]), "<f8") for c in ("lat", "lon"))


def open_combined(spark: SparkSession, folder: str, first: int = 0, last: int | None = None) -> DataFrame:
    """k, time and bt (array, missing as NULL) of the frames from `first` to before `last`, each from its bytes alone."""
    files, base = store(folder)
    header = json.loads(get(files, f"{base}/header.json"))
    dtype, fill = np.dtype(header["dtype"]), header["fill"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = []
            for path, offset, length in zip(*[batch[c].to_pylist() for c in ("path", "offset", "length")]):
                where, name = store(path)
                with where.open_input_file(name) as f:
                    values = np.frombuffer(f.read_at(length, offset), dtype).astype(np.float64)
                frames.append(values if fill is None else np.where(values == fill, np.nan, values))
            flat = np.concatenate(frames) if frames else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(x) for x in frames]]), pa.int32()), pa.array(flat, pa.float64(), mask=np.isnan(flat)))
            yield pa.RecordBatch.from_arrays([batch["k"], batch["time"], lists], names=["k", "time", "bt"])

    chunks = spark.read.parquet(f"{folder}/chunks").filter(F.col("k") >= first)
    chunks = chunks.filter(F.col("k") < last) if last is not None else chunks
    return chunks.select("k", "time", "path", "offset", "length").mapInArrow(run, "k long, time timestamp_ntz, bt array<double>")
