"""Himawari standard data: a frame in segments, each a file of header blocks and counts, plain or compressed.

    satellite.register(spark)
    segments = spark.read.format("cadenza_segments").option("path", folder).load()
    bands = complete(segments)

A row is a segment, a band of a frame's lines, so no task holds a whole frame. Format: JMA, Himawari Standard Data User's Guide.
"""

from __future__ import annotations

import bz2
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from cadenza.sources import satellite
from cadenza.sources.folders import get, store, stored

# Fixed values of the format: numbers of header blocks.
_DATA, _PROJECTION, _CALIBRATION, _SEGMENT = 2, 3, 5, 7


@dataclass
class Segment:
    band: int
    number: int
    of: int
    first_line: int
    counts: np.ndarray
    #: Of the projection: longitude below the satellite, scales and offsets of columns and lines, distance, square ratio of the radii.
    projection: tuple[float, ...]
    #: Gain and constant of the radiance, wavelength in micrometres, correction of the temperature, c, h and k, counts that are none.
    calibration: tuple[float, ...]


def parse(raw: bytes) -> Segment:
    """A segment's file; a compressed one is unpacked."""
    if raw[:3] == b"BZh":
        raw = bz2.decompress(raw)
    order = "<" if raw[5] == 0 else ">"
    blocks, at, total = {}, 0, struct.unpack_from(order + "H", raw, 3)[0]
    for _ in range(total):
        number, length = struct.unpack_from(order + "BH", raw, at)
        blocks[number] = at + 3
        at += length
    bits, cols, lines, packing = struct.unpack_from(order + "HHHB", raw, blocks[_DATA])
    if bits != 16 or packing:
        raise ValueError(f"counts of {bits} bits with compression {packing}")
    lon, cfac, lfac, coff, loff, distance, _, _, _, _, ratio, square = struct.unpack_from(order + "dIIffddddddd", raw, blocks[_PROJECTION])
    band, wavelength, _, wrong, outside, gain, constant, c0, c1, c2, _, _, _, c, h, k = struct.unpack_from(order + "HdHHHddddddddddd", raw, blocks[_CALIBRATION])
    of, number, first = struct.unpack_from(order + "BBH", raw, blocks[_SEGMENT])
    counts = np.frombuffer(raw, order + "u2", lines * cols, at).reshape(lines, cols)
    return Segment(band, number, of, first, counts, (lon, cfac, lfac, coff, loff, distance, ratio, square), (gain, constant, wavelength, c0, c1, c2, c, h, k, wrong, outside))


def temperature(s: Segment) -> np.ndarray:
    """Brightness temperature by the inverse of Planck's law and the sensor's correction; NaN for counts that are none."""
    gain, constant, wavelength, c0, c1, c2, c, h, k, wrong, outside = s.calibration
    w = wavelength * 1e-6
    radiance = (gain * s.counts.astype(float) + constant) * 1e6
    with np.errstate(all="ignore"):
        effective = h * c / (k * w * np.log(2 * h * c**2 / (w**5 * radiance) + 1))
    known = (s.counts != wrong) & (s.counts != outside) & (radiance > 0)
    return np.where(known, c0 + c1 * effective + c2 * effective**2, np.nan)


def coordinates(s: Segment) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude of each pixel by the normalised geostationary projection; NaN off the disk."""
    lon, cfac, lfac, coff, loff, distance, ratio, square = s.projection
    lines, cols = s.counts.shape
    x, y = np.meshgrid(np.radians((np.arange(1, cols + 1) - coff) / (cfac / 65536)), np.radians((s.first_line + np.arange(lines) - loff) / (lfac / 65536)))
    down = np.cos(y) ** 2 + ratio * np.sin(y) ** 2
    ahead = distance * np.cos(x) * np.cos(y)
    with np.errstate(invalid="ignore"):
        far = (ahead - np.sqrt(ahead**2 - down * square)) / down
    s1, s2, s3 = distance - far * np.cos(x) * np.cos(y), far * np.sin(x) * np.cos(y), -far * np.sin(y)
    east = (np.degrees(np.arctan(s2 / s1)) + lon + 180) % 360 - 180
    return np.degrees(np.arctan(ratio * s3 / np.hypot(s1, s2))), east


SCHEMA = "path string, source string, time timestamp_ntz, band int, segment int, n_segments int, first_line int, n_lines int, n_cols int, bt array<double>, lat array<double>, lon array<double>"


class SegmentReader(satellite.FrameReader):
    ENDS = (".DAT", ".DAT.bz2")

    def read(self, partition: satellite.Files) -> Iterator[pa.RecordBatch]:
        numbers = ["band", "segment", "n_segments", "first_line", "n_lines", "n_cols"]
        yield from satellite.batched(self.rows(partition), {"path": pa.string(), "source": pa.string(), "time": pa.timestamp("us")} | dict.fromkeys(numbers, pa.int32()))

    def rows(self, partition: satellite.Files) -> Iterator[tuple]:
        files, _ = store(self.folder)
        for path, source, time in partition.paths:
            s = parse(get(files, path))
            yield path, source, time, s.band, s.number, s.of, s.first_line, *s.counts.shape, temperature(s), *coordinates(s)


class SegmentSource(DataSource):
    """Segments of all files under `path`; options start, end and source prune files by their names."""

    @classmethod
    def name(cls) -> str:
        return "cadenza_segments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SegmentReader:
        return SegmentReader(self.options)


def complete(segments: DataFrame) -> DataFrame:
    """A row for each segment that a frame (source, time, band) should have, in the schema of the source: those that are missing have
    no path and NULL arrays, and the place and size that follow from the others. Of a segment's files the one with the first name stays.

    Segments are written once and read back, so that files are opened once, though sizes are needed before the rows."""
    key = ["source", "time", "band"]
    one = segments.groupBy(*key, "segment").agg(F.min_by(F.struct(*[c for c in segments.columns if c not in (*key, "segment")]), "path").alias("s"))
    one = stored(one, "segments")
    shape = one.groupBy(*key).agg(F.max("s.n_segments").alias("n_segments"), F.max("s.n_lines").alias("n_lines"), F.max("s.n_cols").alias("n_cols"))
    wanted = shape.withColumn("segment", F.explode(F.sequence(F.lit(1), F.col("n_segments"))))
    on = [F.col(f"w.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*key, "segment"]]
    joined = wanted.alias("w").join(one.alias("o"), on, "left")
    begin = F.coalesce(F.col("o.s.first_line"), (F.col("w.segment") - 1) * F.col("w.n_lines") + 1).cast("int")
    return joined.select(
        "o.s.path", *[F.col(f"w.{c}") for c in (*key, "segment", "n_segments")], begin.alias("first_line"), F.coalesce("o.s.n_lines", "w.n_lines").alias("n_lines"), "w.n_cols", "o.s.bt", "o.s.lat", "o.s.lon",
    )


def assemble(complete_segments: DataFrame) -> DataFrame:
    """Whole frames (source, time, band, n_rows, n_cols, bt) of complete(): for frames that fit a row; missing segments are NULL pixels."""
    size = (F.col("n_lines") * F.col("n_cols")).cast("int")
    part = F.struct("segment", F.coalesce("bt", F.array_repeat(F.lit(None).cast("double"), size)).alias("bt"))
    parts = complete_segments.groupBy("source", "time", "band").agg(F.sum("n_lines").cast("int").alias("n_rows"), F.max("n_cols").alias("n_cols"), F.array_sort(F.collect_list(part)).alias("parts"))
    return parts.select("source", "time", "band", "n_rows", "n_cols", F.flatten("parts.bt").alias("bt"))
