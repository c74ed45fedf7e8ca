"""Queries on sensor files in HDF5 and Himawari's format: written by tasks as the sensors write them, and read by ranges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import blocks
from cadenza.plans import sensor_files
from cadenza.plans import sql as S
from cadenza.plans.file_queries import _mean_of_known, _n_known, _sensor_name
from cadenza.plans.registry import query, r
from cadenza.sources import folders, himawari, netcdf, references, satellite, views
from cadenza.sources.views import SIDE

GRID = blocks.Grid(SIDE, SIDE, 4)


def _write(spark, d, folder: str, of) -> None:
    """Writes the files (name, content) that of(k, time, bt) gives for each frame."""
    def write(batches):
        files, base = folders.store(folder)
        for batch in batches:
            for k, time, bt in zip(batch["k"], batch["time"], batch["bt"]):
                for name, content in of(k, time, np.array(bt, float).reshape(SIDE, SIDE)):
                    folders.put(files, f"{base}/{time:%Y%m%d}/{name}", content)
            yield batch[["k"]]
    # A table of small rows is read by few tasks.
    frames = views.frames(spark, d).select("k", "time", "bt").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    frames.mapInPandas(write, "k long").write.format("noop").mode("overwrite").save()


def _hdf5(k: int, time, bt: np.ndarray):
    """Three sensors' files by turns: counts with a look-up table, scaled counts in chunks, and temperatures with links in heaps."""
    w = sensor_files.Hdf5Writer(new=k % 3 == 1, dense=k % 3 == 2)
    lat, lon = 38 - (np.arange(SIDE) + 0.5) * 4, 68 + (np.arange(SIDE) + 0.5) * 3.75
    if k % 3 == 0:
        w.add("IMG_TIR1", ((k * 7 + np.arange(64)) % 64).astype("<u2").reshape(1, SIDE, SIDE), chunks=(1, 3, 5))
        w.add("IMG_TIR1_TEMP", 150 + np.arange(60) * 200 / 63)
    elif k % 3 == 1:
        w.add("tbb", np.round((bt - 200) * 100).astype("<i4"), {"scale_factor": 0.01, "add_offset": 200.0, "_FillValue": np.int32(-99999)}, chunks=(4, 8), checksum=True)
    else:
        w.add("brightness_temperature", bt.astype(">f8"), {f"note{n}": float(n) for n in range(9)} | {"units": "K"})
    w.add("latitude", lat)
    w.add("longitude", lon)
    yield _sensor_name([3, 1, 2][k % 3], time).replace(".nc", ".h5"), w.done({"title": "made"})


_HDF5_SQL = f"""{S.FRAMES}, cells AS (SELECT k, time, i, ['INSAT-3DR', 'Himawari-9', 'GK-2A'][k % 3 + 1] AS source, CASE k % 3 WHEN 1 THEN round((bt[i + 1] - 200.0::DOUBLE) * 100.0::DOUBLE) * 0.01::DOUBLE + 200.0::DOUBLE WHEN 2 THEN bt[i + 1]
 ELSE CASE WHEN (k * 7 + i) % 64 < 60 THEN 150.0::DOUBLE + ((k * 7 + i) % 64) * 200.0::DOUBLE / 63 END END AS v FROM frames, {S.CELLS})"""


@query("SRC11 SRC15 SRC18 SRC21 HLP05", f"WITH {_HDF5_SQL} SELECT time, source, count(v) AS n_valid, round(avg(v), 8) AS mean FROM cells WHERE time >= TIMESTAMP '2025-06-20 06:00:00' GROUP BY time, source")
def src_hdf5(spark, d):
    """HDF5 files of three sensors from a time on; earlier files are not opened."""
    folder = folders.shared(spark, "hdf5")
    _write(spark, d, folder, _hdf5)
    satellite.register(spark)
    found = spark.read.format("cadenza_frames").option("path", folder).load().filter("time >= timestamp_ntz'2025-06-20 06:00:00'")
    return found.select("time", "source", _n_known("bt").alias("n_valid"), r(_mean_of_known("bt"), 8).alias("mean"))


@query("SRC11 SRC21 STN01", f"""WITH {_HDF5_SQL}, f AS (SELECT time, source, list(v ORDER BY i) AS bt FROM cells WHERE source <> 'INSAT-3DR' GROUP BY time, source)
 SELECT time, i::INT AS i, round(bt[(7 - abs(7 - abs(i // 8 - 1))) * 8 + 7 - abs(7 - abs(i % 8 + 1)) + 1] + 2 * bt[i // 8 * 8 + 7 - abs(7 - abs(i % 8 + 1)) + 1] + bt[(7 - abs(7 - abs(i // 8 + 1))) * 8 + 7 - abs(7 - abs(i % 8 + 1)) + 1]
 - bt[(7 - abs(7 - abs(i // 8 - 1))) * 8 + abs(i % 8 - 1) + 1] - 2 * bt[i // 8 * 8 + abs(i % 8 - 1) + 1] - bt[(7 - abs(7 - abs(i // 8 + 1))) * 8 + abs(i % 8 - 1) + 1], 5) + 0.0 AS gx FROM f, {S.CELLS}""")
def src_blocks(spark, d):
    """Files read as blocks, a band of rows at a time, and their gradients: no task holds a whole frame."""
    folder = folders.shared(spark, "hdf5")
    _write(spark, d, folder, _hdf5)
    satellite.register(spark)
    read = spark.read.format("cadenza_frames").option("path", folder).option("block", GRID.size).load().filter("source <> 'INSAT-3DR'")
    px = blocks.pixels(blocks.sobel(read.select("time", "by", "bx", "bt"), ["time"], "bt", GRID), ["time"], ["gx"], GRID)
    return px.select("time", (F.col("y") * SIDE + F.col("x")).alias("i"), (r("gx", 5) + 0.0).alias("gx"))  # no negative zero


#: Of a frame's eight segments, each one line, those of lost(k) are not there.
def _segments(k: int, time, bt: np.ndarray):
    gain, constant = 1e-3, 0.0
    counts = np.round((sensor_files.radiance(bt) - constant) / gain).astype(int)
    for n in range(1, SIDE + 1):
        if (k + n) % 11:
            raw = sensor_files.segment_file(counts[n - 1 : n], n, SIDE, n, sensor_files.mjd(time), gain, constant, packed=n % 2 == 0)
            yield f"HS_H09_{time:%Y%m%d_%H%M}_B13_FLDK_R20_S{n:02d}{SIDE:02d}.DAT" + ".bz2" * (n % 2 == 0), raw


_H, _C, _K, _W = 6.62606957e-34, 2.99792458e8, 1.3806488e-23, 10.4073e-6


@query("SRC13 SRC15 SRC16", f"""WITH {S.FRAMES}, cells AS (SELECT k, time, i // 8 + 1 AS segment, i, round({2 * _H * _C**2 / _W**5 * 1e-6!r}::DOUBLE / (exp({_H * _C / (_K * _W)!r}::DOUBLE / bt[i + 1]) - 1) / 0.001::DOUBLE) AS n FROM frames, {S.CELLS})
 SELECT time, segment::INT AS segment, segment::INT AS first_line, CASE WHEN (k + segment) % 11 <> 0 THEN 8 ELSE 0 END AS n_valid, round(avg(CASE WHEN (k + segment) % 11 <> 0 THEN {_H * _C / (_K * _W)!r}::DOUBLE / ln({2 * _H * _C**2 / _W**5!r}::DOUBLE / (n * 0.001::DOUBLE * 1e6::DOUBLE) + 1) END), 4) AS mean FROM cells GROUP BY k, time, segment""")
def src_segments(spark, d):
    """Frames in eight segments of which some are lost: every segment has its row, a lost one without pixels."""
    folder = folders.shared(spark, "segments")
    _write(spark, d, folder, _segments)
    satellite.register(spark)
    found = himawari.complete(spark.read.format("cadenza_segments").option("path", folder).load())
    return found.select("time", "segment", "first_line", F.coalesce(_n_known("bt"), F.lit(0)).cast("int").alias("n_valid"), r(_mean_of_known("bt"), 4).alias("mean"))


@query("SRC27 SRC28 SRC29 SRC30", f"""WITH {S.MASKED} SELECT k, TIMESTAMP '2025-06-20 00:00:00' + to_minutes(30 * k::INT) AS time, count(bt) AS n_valid, round(avg(bt::FLOAT::DOUBLE), 4) AS mean FROM px GROUP BY k""")
def src_combined(spark, d):
    """Files combined along time into one virtual cube, which is then read by ranges."""
    files, manifest = folders.shared(spark, "indexed"), folders.shared(spark, "combined")
    attrs = {"source_frames": "[]", "t": 0.0, "model": "none", "model_version": "0", "kind": "observed", "created": "2025-06-20T00:00:00Z"}
    netcdf.write_frames(netcdf.encode_frames(views.frames(spark, d, masked=True), SIDE, (68.0, 6.0, 98.0, 38.0), attrs), files).write.parquet(f"{manifest}-files")
    references.combine(spark, spark.read.parquet(f"{manifest}-files").select("path"), manifest)
    return references.open_combined(spark, manifest).select("k", "time", _n_known("bt").alias("n_valid"), r(_mean_of_known("bt"), 4).alias("mean"))
