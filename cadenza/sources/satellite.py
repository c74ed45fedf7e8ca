"""Frames of geostationary sensors in NetCDF and HDF5 files: a Spark data source that prunes files by sensor and time before it
opens them and reads the byte ranges of what it needs.

    register(spark)
    spark.read.format("cadenza_frames").option("path", folder).option("start", "2025-06-20T00:00:00").load()

With the option `block` a row is a block of a frame (by, bx), read a band of rows at a time, so that no task holds a whole frame.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import lru_cache
from time import time_ns

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from cadenza.functions.text import SOURCE_MARKS
from cadenza.sources import hdf5, netcdf
from cadenza.sources.folders import get, put, store

#: Files of a task that copies; bytes of a partition, each file with those that opening it is worth; partitions, beyond which they grow.
FILES, BYTES, OPEN, TASKS = 32, 64 << 20, 256 << 10, 1000
#: Pixels with which a batch ends; a row of more is one alone.
PIXELS = 32_768
# Patterns of the start time in file names, variables by sensor.
_TIMES = [
    (re.compile(r"_s(\d{4})(\d{3})(\d{2})(\d{2})(\d{2})"), None), (re.compile(r"HS_H\d\d_(\d{8}_\d{4})_B"), "%Y%m%d_%H%M"), (re.compile(r"_(\d{12})\.(?:nc|h5)$"), "%Y%m%d%H%M"),
    (re.compile(r"_(\d{2}[A-Z]{3}\d{4}_\d{4})_"), "%d%b%Y_%H%M"),
]
_HIMAWARI = ["tbb_13", "tbb", "bt", "brightness_temperature", "CMI"]
_GK2A_BT = ["brightness_temperature", "bt", "BT"]
_LAT, _LON = ["lat", "latitude", "Latitude"], ["lon", "longitude", "Longitude"]


class OfflineError(RuntimeError):
    """A store that cannot be reached; says what to do."""


def source_of(path: str) -> str | None:
    """The sensor by the first rule that matches the path."""
    low = path.lower()
    for name, marks in SOURCE_MARKS:
        if any(m in low for m in marks):
            return name
    return None


@lru_cache(4096)
def _parsed(text: str, form: str) -> datetime:
    return datetime.strptime(text, form)


def time_of(path: str) -> datetime | None:
    """The start time in a file's name."""
    name = path.rsplit("/", 1)[-1]
    for pattern, form in _TIMES:
        if found := pattern.search(name):
            if form:
                return _parsed(found[1].title() if "%b" in form else found[1], form)
            year, day, h, m, s = map(int, found.groups())
            return datetime(year, 1, 1, h, m, s) + timedelta(days=day - 1)
    return None


def first_present(names, candidates: list[str]) -> str | None:
    """The first candidate that is there, case aside."""
    have = {n.lower(): n for n in names}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def decoded(v: netcdf.Variable) -> np.ndarray:
    """Values with the fill value as NaN, scaled and offset."""
    raw = np.asarray(v.data)
    out = raw.astype(float)
    if "_FillValue" in v.attrs:
        out = np.where(raw == v.attrs["_FillValue"], np.nan, out)
    return out * float(v.attrs.get("scale_factor", 1)) + float(v.attrs.get("add_offset", 0))


def planck(radiance: np.ndarray, fk1: float, fk2: float, bc1: float, bc2: float) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where(radiance > 0, (fk2 / np.log(fk1 / radiance + 1) - bc1) / bc2, np.nan)


def _scalar(ds: netcdf.Dataset, name: str) -> float:
    return float(np.ravel(ds.variables[name].data)[0])


def scan_angles(ds: netcdf.Dataset) -> tuple[np.ndarray, np.ndarray] | None:
    """Latitude and longitude from scan angles x, y and the projection's attributes; NaN off the disk."""
    if not {"x", "y", "goes_imager_projection"} <= set(ds.variables):
        return None
    p = ds.variables["goes_imager_projection"].attrs
    re_, rp, h = float(p["semi_major_axis"]), float(p["semi_minor_axis"]), float(p["perspective_point_height"]) + float(p["semi_major_axis"])
    x, y = np.meshgrid(decoded(ds.variables["x"]), decoded(ds.variables["y"]))
    square = (re_ / rp) ** 2
    a = np.sin(x) ** 2 + np.cos(x) ** 2 * (np.cos(y) ** 2 + square * np.sin(y) ** 2)
    b, c = -2 * h * np.cos(x) * np.cos(y), h * h - re_ * re_
    with np.errstate(invalid="ignore"):
        r = (-b - np.sqrt(b * b - 4 * a * c)) / (2 * a)
    sx, sy, sz = r * np.cos(x) * np.cos(y), -r * np.sin(x), r * np.cos(x) * np.sin(y)
    return np.degrees(np.arctan(square * sz / np.hypot(h - sx, sy))), float(p["longitude_of_projection_origin"]) - np.degrees(np.arctan(sy / (h - sx)))


def coordinates(ds: netcdf.Dataset, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude of every pixel, from scan angles, from two-dimensional or one-dimensional coordinates, else NaN."""
    if found := scan_angles(ds):
        return found
    names = first_present(ds.variables, _LAT), first_present(ds.variables, _LON)
    if None in names:
        return np.full(shape, np.nan), np.full(shape, np.nan)
    lat, lon = (decoded(ds.variables[n]) for n in names)
    if lat.ndim == 1:
        if (len(lat), len(lon)) != shape:
            raise ValueError(f"coordinates of {len(lat)} by {len(lon)} do not fit a frame of {shape}")
        lon, lat = np.meshgrid(lon, lat)
    return lat, lon


def temperature(ds: netcdf.Dataset, source: str) -> np.ndarray:
    """Brightness temperature of a file: the sensor's own variable, else from radiance, counts or a look-up table."""
    v = ds.variables
    if source.startswith("GOES"):
        if "CMI" in v:
            return decoded(v["CMI"])
        if "Rad" in v:
            return planck(decoded(v["Rad"]), *(_scalar(ds, f"planck_{c}") for c in ("fk1", "fk2", "bc1", "bc2")))
    elif source.startswith("Himawari"):
        if name := first_present(v, _HIMAWARI):
            return decoded(v[name])
    elif source == "GK-2A":
        if name := first_present(v, _GK2A_BT):
            return decoded(v[name])
        if "image_pixel_values" in v:
            a = ds.attrs
            radiance = decoded(v["image_pixel_values"]) * float(a["DN_to_Radiance_Gain"]) + float(a["DN_to_Radiance_Offset"])
            return planck(radiance, *(float(a[f"planck_{c}"]) for c in ("fk1", "fk2", "bc1", "bc2")))
    elif source.startswith("INSAT"):
        if "IMG_TIR1_TEMP" in v and "IMG_TIR1" in v:
            counts, lut = np.squeeze(v["IMG_TIR1"].data).astype(int), np.ravel(v["IMG_TIR1_TEMP"].data).astype(float)
            inside = (counts >= 0) & (counts < len(lut))
            return np.where(inside, lut[np.clip(counts, 0, len(lut) - 1)], np.nan)
        if "IMG_TIR1" in v:
            values = decoded(v["IMG_TIR1"])
            if v["IMG_TIR1"].data.dtype.kind in "iu" or np.nanmax(values) > 1000:
                raise ValueError("counts without a look-up table")
            return values
    return netcdf.frame_of(ds)[1]


def open_file(read: Callable[[int, int], bytes]) -> netcdf.Dataset:
    """A sensor file of either format through read(offset, length); its variables are read when they are asked for."""
    if hdf5.is_hdf5(read(0, 8)):
        file = hdf5.File(read)
        return netcdf.Dataset({}, {name.rsplit("/", 1)[-1]: d for name, d in file.datasets.items()}, file.attrs)
    return netcdf.open_ranges(read)


def read_frame(raw: bytes, source: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Temperature, latitude and longitude of one file."""
    return _band(open_file(lambda offset, length: raw[offset : offset + length]), source)


def _band(ds: netcdf.Dataset, source: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bt = np.squeeze(temperature(ds, source or ""))
    bt = bt.reshape(1, -1) if bt.ndim < 2 else bt
    return (bt, *coordinates(ds, bt.shape))


def frame_shape(ds: netcdf.Dataset) -> tuple[int, int]:
    """Rows and columns of the variable that holds the frame."""
    for name in ["CMI", "Rad", *_HIMAWARI, *_GK2A_BT, "image_pixel_values", "IMG_TIR1", *netcdf.BT_NAMES]:
        found = first_present(ds.variables, [name])
        if found and len(ds.variables[found].shape) > 1:
            return tuple(ds.variables[found].shape[-2:])
    raise ValueError("no frame")


def bands(ds: netcdf.Dataset, source: str | None, height: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, temperature, latitude and longitude of each band of `height` rows; only a band's bytes are read at a time."""
    rows, cols = frame_shape(ds)
    down = [v for name, v in ds.variables.items() if len(v.shape) == 1 and v.shape[0] == rows and name.lower() in ("y", *[x.lower() for x in _LAT])]
    down += [v for v in ds.variables.values() if len(v.shape) > 1 and tuple(v.shape[-2:]) == (rows, cols)]
    for first in range(0, rows, height):
        for v in down:
            v.window = (first, min(rows, first + height))
        bt, lat, lon = _band(ds, source)
        yield first, bt.reshape(-1, cols), lat.reshape(-1, cols), lon.reshape(-1, cols)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays as lists with NaN as NULL, from their buffers."""
    flat = np.concatenate([a.ravel() for a in arrays]).astype(np.float64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[a.size for a in arrays]]), pa.int32()), pa.array(flat, pa.float64(), mask=np.isnan(flat)))


def batched(rows: Iterator[tuple], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of rows: values as `kinds` has them and three arrays bt, lat and lon."""
    held: list[tuple] = []
    pixels = 0

    def batch() -> pa.RecordBatch:
        *values, bt, lat, lon = zip(*held)
        return pa.RecordBatch.from_arrays([*[pa.array(v, kind) for v, kind in zip(values, kinds.values())], *map(_lists, (bt, lat, lon))], names=[*kinds, "bt", "lat", "lon"])

    for row in rows:
        if held and pixels + row[-1].size > PIXELS:
            yield batch()
            held, pixels = [], 0
        held.append(row)
        pixels += row[-1].size
    if held:
        yield batch()


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, str | None, datetime | None]]


_FILE, _ARRAYS = "path string, source string, time timestamp_ntz, n_rows int, n_cols int", "bt array<double>, lat array<double>, lon array<double>"
SCHEMA, BLOCK_SCHEMA = f"{_FILE}, {_ARRAYS}", f"{_FILE}, by int, bx int, {_ARRAYS}"


class FrameReader(DataSourceReader):
    #: Names of the files that it reads end so.
    ENDS: tuple[str, ...] = (".nc", ".h5")

    def __init__(self, options):
        self.folder = options["path"]
        read = lambda name: datetime.fromisoformat(options[name]) if name in options else None
        self.low, self.high = sorted([read("start"), read("end")]) if "start" in options and "end" in options else (read("start"), read("end"))
        self.source, self.block = options.get("source"), int(options.get("block", 0))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of `time` prune files; every filter is applied again by Spark."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("time",) and isinstance(value, datetime):
                value = value.replace(tzinfo=None)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(x for x in (self.low, value) if x)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(x for x in (self.high, value) if x)
            yield f

    def found(self) -> list[tuple[str, str | None, datetime | None, int]]:
        """The files in the bounds with their sizes, in order of time and name."""
        files, base = store(self.folder)
        try:
            found = files.get_file_info(fs.FileSelector(base, recursive=True))
        except FileNotFoundError as e:
            raise OfflineError(f"{self.folder} cannot be listed; download the files first and give their folder as path") from e
        out = []
        for info in found:
            if info.type != fs.FileType.File or not info.path.endswith(self.ENDS):
                continue
            source, time = source_of(info.base_name), time_of(info.base_name)
            if self.source and source != self.source or time and (self.low and time < self.low or self.high and time > self.high):
                continue
            out.append((info.path, source, time, info.size or 0))
        return sorted(out, key=lambda x: (x[2] or datetime.min, x[0]))

    def listed(self) -> list[tuple[str, str | None, datetime | None]]:
        """The files in the bounds, in order of time and name."""
        return [x[:3] for x in self.found()]

    @staticmethod
    def cut(found: list[tuple[str, str | None, datetime | None, int]]) -> list[Files]:
        """Partitions of neighbouring files: large files by themselves, small ones together, so that their number does not grow with the files'."""
        most = max(BYTES, sum(size + OPEN for *_, size in found) // TASKS)
        out, held = [Files([])], 0
        for *file, size in found:
            if out[-1].paths and held + size + OPEN > most:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(tuple(file))
            held += size + OPEN
        return out

    def partitions(self) -> list[Files]:
        return self.cut(self.found())

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """Batches of frames, or of blocks from a band at a time; arrays go as buffers."""
        kinds = {"path": pa.string(), "source": pa.string(), "time": pa.timestamp("us"), "n_rows": pa.int32(), "n_cols": pa.int32()}
        yield from batched(self.rows(partition), kinds | ({"by": pa.int32(), "bx": pa.int32()} if self.block else {}))

    def rows(self, partition: Files) -> Iterator[tuple]:
        files, _ = store(self.folder)
        for path, source, time in partition.paths:
            with files.open_input_file(path) as f:
                ds = open_file(lambda offset, length: f.read_at(length, offset))
                if not self.block:
                    arrays = _band(ds, source)
                    yield path, source, time, *arrays[0].shape, *arrays
                    continue
                shape = frame_shape(ds)
                for first, *arrays in bands(ds, source, self.block):
                    for bx, x in enumerate(range(0, shape[1], self.block)):
                        yield path, source, time, *shape, first // self.block, bx, *[a[:, x : x + self.block] for a in arrays]


class FrameStreamReader(FrameReader, DataSourceStreamReader):
    """Frames in the order in which their files come: an offset is the time of the last file's last change, and its name.

    A file counts when it has not changed for `settle` seconds (2), so that none of the same time comes behind an offset; a frame
    that is older than others but comes later is read, too. What lies between two offsets is listed anew, so a batch that is
    repeated after a restart has the same files. A batch takes all that has come."""

    def __init__(self, options):
        super().__init__(options)
        self.settle = float(options.get("settle", 2))
        self.reached: tuple[int, str] = (-1, "")

    def arrived(self) -> list[tuple[int, str]]:
        files, _ = store(self.folder)
        paths = [p for p, _, _ in self.listed()]
        infos = files.get_file_info(paths) if paths else []
        newest = time_ns() - int(self.settle * 1e9)
        return sorted((i.mtime_ns, i.path) for i in infos if i.mtime_ns <= newest)

    def initialOffset(self) -> dict:
        return {"changed": -1, "name": ""}

    def latestOffset(self) -> dict:
        self.reached = max([self.reached, *self.arrived()])
        return {"changed": self.reached[0], "name": self.reached[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((o["changed"], o["name"]) for o in (start, end))
        self.reached = max(self.reached, high)
        wanted = {path for _, path in (x for x in self.arrived() if low < x <= high)}
        return self.cut([x for x in self.found() if x[0] in wanted])


class FrameSource(DataSource):
    """Frames of all files under `path`; options start, end (ISO, in any order), source and block (the side of blocks)."""

    @classmethod
    def name(cls) -> str:
        return "cadenza_frames"

    def schema(self) -> str:
        return BLOCK_SCHEMA if int(self.options.get("block", 0)) else SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)

    def streamReader(self, schema) -> FrameStreamReader:
        return FrameStreamReader(self.options)


def list_and_download(spark: SparkSession, folder: str, target: str, **options: str) -> DataFrame:
    """Copies the files that the source's options select into `target`, those excepted that are there with their whole size:
    path, target, n_bytes of each that was copied. Tasks copy; the driver lists."""
    here, base = store(target)
    here.create_dir(base, recursive=True)
    have = {i.base_name: i.size for i in here.get_file_info(fs.FileSelector(base))}
    away, _ = store(folder)
    wanted = [p for p, _, _ in FrameReader({"path": folder, **options}).listed() if have.get(p.rsplit("/", 1)[-1]) != away.get_file_info(p).size]

    def copy(batches):
        away, (here, base) = store(folder)[0], store(target)
        for batch in batches:
            out = batch.copy()
            out["target"] = [f"{base}/{p.rsplit('/', 1)[-1]}" for p in batch["path"]]
            bodies = [get(away, p) for p in batch["path"]]
            for path, body in zip(out["target"], bodies):
                put(here, path, body)
            out["n_bytes"] = [len(b) for b in bodies]
            yield out

    rows = spark.createDataFrame([(p,) for p in wanted], "path string").repartition(max(1, min(1000, -(-len(wanted) // FILES))))
    return rows.mapInPandas(copy, "path string, target string, n_bytes long")


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, which then hands its filters to it."""
    from cadenza.sources.himawari import SegmentSource

    spark.dataSource.register(FrameSource)
    spark.dataSource.register(SegmentSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
