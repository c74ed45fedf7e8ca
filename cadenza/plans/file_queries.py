"""Queries on files: cubes, sensor files, tiles, archives, scenes, reports, caches and streams; and on small functions of text."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from cadenza.functions import text
from cadenza.operators import crossval, grid, stencil
from cadenza.plans import jobs
from cadenza.plans import sql as S
from cadenza.plans.registry import query, r, rounded
from cadenza.sources import cube, folders, netcdf, satellite, tiles, views
from cadenza.sources.cache import ResultCache
from cadenza.sources.views import SIDE, table
from cadenza.streaming import frames as streaming

BBOX = (68.0, 6.0, 98.0, 38.0)


def _mean_of_known(c: str):
    known = F.filter(c, lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known).cast("double"))


def _n_known(c: str):
    return F.size(F.filter(c, lambda v: v.isNotNull())).cast("long")


# --- cubes and sensor files ------------------------------------------------------------------------------------------

@query("SNK01 SNK02 SRC25 SRC26 HLP06 SET01 SCL21", f"""WITH {S.MASKED} SELECT k, TIMESTAMP '2025-06-20 00:00:00' + to_minutes(30 * k::INT) AS time, count(bt) AS n_valid, round(avg(bt::FLOAT::DOUBLE), 4) AS mean FROM px GROUP BY k""")
def snk_cube(spark, d):
    """Frames written as a Zarr cube and read back."""
    folder = folders.shared(spark, "cube")
    cube.build_cube(views.frames(spark, d, masked=True), folder, SIDE, SIDE, BBOX, {"source": "synthetic"}).write.format("noop").mode("overwrite").save()
    return cube.read_cube(spark, folder).select("k", "time", _n_known("bt").alias("n_valid"), r(_mean_of_known("bt"), 4).alias("mean"))


_FK = (10803.3, 1392.74, 0.07396, 0.99961)
_X0 = 0.02


def _sensor_file(k: int, bt: np.ndarray) -> bytes:
    """The file of frame k as its sensor would write it."""
    i = np.arange(64)
    fk1, fk2, bc1, bc2 = _FK
    lat, lon = 38 - (np.arange(8) + 0.5) * 4, 68 + (np.arange(8) + 0.5) * 3.75
    v, V = {}, netcdf.Variable
    attrs: dict = {}
    if k % 4 == 0:
        axis = np.linspace(-_X0, _X0, 8)
        dims = {"y": 8, "x": 8}
        v = {"Rad": V(("y", "x"), (fk1 / (np.exp(fk2 / (bc1 + bc2 * bt)) - 1)).reshape(8, 8)), "y": V(("y",), axis), "x": V(("x",), axis)}
        v |= {f"planck_{n}": V((), np.array(c)) for n, c in zip(("fk1", "fk2", "bc1", "bc2"), _FK)}
        v["goes_imager_projection"] = V((), np.array(0.0), {"semi_major_axis": 6378137.0, "semi_minor_axis": 6356752.31414, "perspective_point_height": 35786023.0, "longitude_of_projection_origin": -75.0})
    else:
        dims = {"lat": 8, "lon": 8}
        v = {"lat": V(("lat",), lat), "lon": V(("lon",), lon)}
        if k % 4 == 1:
            v["tbb"] = V(("lat", "lon"), np.round((bt - 200) * 100).astype(np.int32).reshape(8, 8), {"scale_factor": 0.01, "add_offset": 200.0, "_FillValue": -99999})
        elif k % 4 == 2:
            v["image_pixel_values"] = V(("lat", "lon"), ((k * 5 + i * 3) % 1000).astype(np.int32).reshape(8, 8))
            attrs = {"DN_to_Radiance_Gain": 0.1, "DN_to_Radiance_Offset": 0.5, **{f"planck_{n}": c for n, c in zip(("fk1", "fk2", "bc1", "bc2"), _FK)}}
        else:
            dims["levels"] = 60
            v["IMG_TIR1"] = V(("lat", "lon"), ((k * 7 + i) % 64).astype(np.int32).reshape(8, 8))
            v["IMG_TIR1_TEMP"] = V(("levels",), 150 + np.arange(60) * 200 / 63)
    return netcdf.dump(netcdf.Dataset(dims, v, attrs))


def _sensor_name(k: int, time: pd.Timestamp) -> str:
    return [f"OR_ABI-L1b-RadF-M6C13_G19_s{time:%Y%j%H%M%S}0.nc", f"HS_H09_{time:%Y%m%d_%H%M}_B13_FLDK.nc", f"gk2a_ami_le1b_ir105_fd020ge_{time:%Y%m%d%H%M}.nc", f"3RIMG_{time:%d%b%Y_%H%M}_L1B_STD.nc".replace(f"{time:%b}", f"{time:%b}".upper())][k % 4]


def _write_sensor_files(spark, d, folder: str) -> None:
    def write(batches):
        files, base = folders.store(folder)
        for batch in batches:
            for k, time, bt in zip(batch["k"], batch["time"], batch["bt"]):
                folders.put(files, f"{base}/{time:%Y%m%d}/{_sensor_name(k, time)}", _sensor_file(k, np.array(bt, float)))
            yield batch[["k"]]
    views.frames(spark, d).select("k", "time", "bt").mapInPandas(write, "k long").write.format("noop").mode("overwrite").save()


def _read_sensors(spark, folder: str, **options):
    satellite.register(spark)
    return spark.read.format("cadenza_frames").option("path", folder).options(**options).load()


_PLANCK_SQL = "1392.74::DOUBLE / ln(10803.3::DOUBLE / (((k * 5 + i * 3) % 1000) * 0.1::DOUBLE + 0.5::DOUBLE) + 1)"
_SENSOR_SQL = f"""{S.FRAMES}, cells AS (SELECT k, time, CASE k % 4 WHEN 0 THEN bt[i + 1] WHEN 1 THEN round((bt[i + 1] - 200.0::DOUBLE) * 100.0::DOUBLE) * 0.01::DOUBLE + 200.0::DOUBLE WHEN 2 THEN ({_PLANCK_SQL} - 0.07396::DOUBLE) / 0.99961::DOUBLE
 ELSE CASE WHEN (k * 7 + i) % 64 < 60 THEN 150.0::DOUBLE + ((k * 7 + i) % 64) * 200.0::DOUBLE / 63 END END AS v FROM frames, {S.CELLS}),
 read AS (SELECT k, time, ['GOES-19', 'Himawari-9', 'GK-2A', 'INSAT-3DR'][k % 4 + 1] AS source, count(v) AS n_valid, round(avg(v), 4) AS mean FROM cells GROUP BY k, time)"""


@query("SRC02 SRC03 SRC05 SRC06 SRC09 SRC11 SRC13 SRC15 SRC17 SRC18 SRC21 SRC23 STR20", f"WITH {_SENSOR_SQL} SELECT time, source, n_valid, mean FROM read")
def src_sensors(spark, d):
    """One file a frame as four sensors write them, read by the data source."""
    folder = folders.shared(spark, "sensors")
    _write_sensor_files(spark, d, folder)
    return _read_sensors(spark, folder).select("time", "source", _n_known("bt").alias("n_valid"), r(_mean_of_known("bt"), 4).alias("mean"))


@query("SRC02 SRC09 SRC17 FLT05", f"WITH {_SENSOR_SQL} SELECT time, source, n_valid, mean FROM read WHERE source = 'GK-2A' AND time >= TIMESTAMP '2025-06-21 00:00:00' AND time <= TIMESTAMP '2025-06-23 12:00:00'")
def src_sensors_pruned(spark, d):
    """The same with a sensor and bounds of time, which prune files before they are opened."""
    folder = folders.shared(spark, "sensors")
    _write_sensor_files(spark, d, folder)
    found = _read_sensors(spark, folder, source="GK-2A").filter("time >= timestamp_ntz'2025-06-21 00:00:00' and time <= timestamp_ntz'2025-06-23 12:00:00'")
    return found.select("time", "source", _n_known("bt").alias("n_valid"), r(_mean_of_known("bt"), 4).alias("mean"))


@query("SRC22 SCL20 SCL22 SCL24 GEO01 HLP04", f"""WITH {S.FRAMES}, a AS (SELECT k, time, i, -0.02::DOUBLE + (i % 8) * 0.04::DOUBLE / 7 AS x, -0.02::DOUBLE + (i // 8) * 0.04::DOUBLE / 7 AS y, 6378137.0::DOUBLE AS re, 6356752.31414::DOUBLE AS rp, 42164160.0::DOUBLE AS h FROM frames, {S.CELLS}),
 q AS (SELECT *, pow(sin(x), 2) + pow(cos(x), 2) * (pow(cos(y), 2) + pow(re / rp, 2) * pow(sin(y), 2)) AS a, -2.0 * h * cos(x) * cos(y) AS b, h * h - re * re AS c FROM a), t AS (SELECT *, (-b - sqrt(b * b - 4 * a * c)) / (2 * a) AS r FROM q),
 v AS (SELECT *, r * cos(x) * cos(y) AS sx, -r * sin(x) AS sy, r * cos(x) * sin(y) AS sz FROM t), l AS (SELECT k, time, CASE WHEN k % 4 = 0 THEN degrees(atan(pow(re / rp, 2) * sz / sqrt(pow(h - sx, 2) + sy * sy))) ELSE 38.0::DOUBLE - (i // 8 + 0.5::DOUBLE) * 4.0::DOUBLE END AS lat,
 CASE WHEN k % 4 = 0 THEN -75.0::DOUBLE - degrees(atan(sy / (h - sx))) ELSE 68.0::DOUBLE + (i % 8 + 0.5::DOUBLE) * 3.75::DOUBLE END AS lon FROM v)
 SELECT time, round(min(lat), 5) AS south, round(max(lat), 5) AS north, round(min(lon), 5) AS west, round(max(lon), 5) AS east FROM l GROUP BY time""")
def src_coordinates(spark, d):
    """The outermost pixel centres of every file: from scan angles, or from its own coordinates."""
    folder = folders.shared(spark, "sensors")
    _write_sensor_files(spark, d, folder)
    found = _read_sensors(spark, folder)
    return rounded(found.select("time", F.array_min("lat").alias("south"), F.array_max("lat").alias("north"), F.array_min("lon").alias("west"), F.array_max("lon").alias("east")), 5)


@query("SRC29 SRC30 SNK05 SRC27", f"""WITH {S.MASKED} SELECT k, count(bt) AS n_valid, round(avg(bt::FLOAT::DOUBLE), 4) AS mean FROM px GROUP BY k""")
def src_open_references(spark, d):
    """Files indexed once; the table of byte ranges, written and read again, then opens one variable of all of them."""
    folder, index = folders.shared(spark, "indexed"), folders.shared(spark, "references")
    attrs = {"source_frames": "[]", "t": 0.0, "model": "none", "model_version": "0", "kind": "observed", "created": "2025-06-20T00:00:00Z"}
    written = netcdf.write_frames(netcdf.encode_frames(views.frames(spark, d, masked=True), SIDE, BBOX, attrs), folder)
    netcdf.reference_table(written).write.parquet(index)
    opened = netcdf.open_references(spark.read.schema("k long, path string, variable string, offset long, length long").parquet(index), "bt")
    return opened.select("k", _n_known("values").alias("n_valid"), r(_mean_of_known("values"), 4).alias("mean"))


@query("SRC06 SRC10 SRC14 SRC17 SRC19 SRC20 SRT01", """SELECT step, n FROM (SELECT 'first' AS step, count(*) AS n FROM embeddings WHERE vec_id % 4 = 2 UNION ALL SELECT 'again', 0 UNION ALL SELECT 'others', count(*) FROM embeddings WHERE vec_id % 4 <> 2)""")
def src_download(spark, d):
    """Files of one sensor fetched, then again, when nothing is left to fetch, then those of all sensors."""
    source, target = folders.shared(spark, "store"), folders.shared(spark, "local")
    _write_sensor_files(spark, d, source)
    steps = [(step, satellite.list_and_download(spark, source, target, **options).count()) for step, options in (("first", {"source": "GK-2A"}), ("again", {"source": "GK-2A"}), ("others", {}))]
    return spark.createDataFrame(steps, "step string, n long")


@query("SNK06 SRC31 TRN04", f"""WITH {S.PX} SELECT k, 64 AS n, round(avg(bt::FLOAT::DOUBLE), 4) AS mean FROM px GROUP BY k""")
def snk_npz_shards(spark, d):
    """Samples as arrays in tar shards, read back."""
    from cadenza.sources import images

    def encode(batches):
        for batch in batches:
            yield batch[["n", "key"]].assign(body=[images.npz(bt=np.array(bt, np.float32)) for bt in batch["bt"]])

    rows = views.frames(spark, d).select(F.col("k").alias("n"), F.format_string("%08d", "k").alias("key"), "bt").mapInPandas(encode, "n long, key string, body binary")

    def back(batches):
        for batch in batches:
            found = [(int(key), images.read_npz(parts["npz"])["bt"]) for content in batch["content"] for key, parts in images.read_tar(content)]
            yield pd.DataFrame({"k": [k for k, _ in found], "n": [len(a) for _, a in found], "mean": [float(a.astype(float).mean()) for _, a in found]})
    return images.write_shards(rows, 64, "npz").mapInPandas(back, "k long, n int, mean double").withColumn("mean", r("mean", 4))


# --- jobs from files to files -------------------------------------------------------------------------------------------

@query("WIN14 MDL05 MDL06 SNK08 SNK10", f"""WITH {S.PX}, p AS (SELECT a.k, s, a.bt AS a, b.bt AS b FROM px a LEFT JOIN px b ON b.k = a.k + 1 AND b.i = a.i, unnest([0, 1]) r(s) WHERE s = 0 OR b.k IS NOT NULL)
 SELECT 2 * k + s AS frame, CASE WHEN s = 0 THEN 'observed' ELSE 'interpolated' END AS kind, CASE WHEN s = 1 THEN 0.5::DOUBLE END AS t, CASE WHEN s = 0 THEN '[' || k || ']' ELSE '[' || k || ',' || (k + 1) || ']' END AS source_frames,
 round(avg(CASE WHEN s = 0 THEN a::FLOAT::DOUBLE ELSE (0.5::DOUBLE * a::FLOAT::DOUBLE + 0.5::DOUBLE * b::FLOAT::DOUBLE)::FLOAT::DOUBLE END), 4) AS mean FROM p GROUP BY k, s""")
def job_interpolate(spark, d):
    """NetCDF files of the frames, densified into NetCDF files, and those read back."""
    first, second = folders.shared(spark, "observed"), folders.shared(spark, "dense")
    attrs = {"source_frames": "[]", "t": 0.0, "model": "none", "model_version": "0", "kind": "observed", "created": "2025-06-20T00:00:00Z"}
    netcdf.write_frames(netcdf.encode_frames(views.frames(spark, d), SIDE, BBOX, attrs), first).write.format("noop").mode("overwrite").save()
    jobs.interpolate_files(spark, first, second, SIDE, BBOX, 2).write.format("noop").mode("overwrite").save()
    got = netcdf.read_frames(spark, second)
    a = F.col("attrs")
    return got.select(
        F.regexp_extract("path", r"(\d+)\.nc$", 1).cast("long").alias("frame"), a["kind"].alias("kind"), F.expr("try_cast(attrs['t'] as double)").alias("t"), a["source_frames"].alias("source_frames"),
        r(_mean_of_known("bt"), 4).alias("mean"))


@query("ORC01 ORC02 SNK14 SNK15 SNK17 SNK18 IMG10 SET03 SRC33 VAL13", """SELECT kind, count(*) AS n_frames, count(*) AS n_images, count(*) AS n_thumbs, 5 * count(*) AS n_tiles, count(*) AS n_netcdf, 140.0::DOUBLE AS span, 'blend' AS model
 FROM (SELECT 'observed' AS kind FROM embeddings UNION ALL SELECT 'interpolated' FROM embeddings WHERE vec_id < (SELECT max(vec_id) FROM embeddings)) GROUP BY kind""")
def orc_scene(spark, d):
    """A scene built into a folder: what its manifest says, and the files that are there."""
    folder = folders.shared(spark, "scene")
    # The overlay's metrics are broken, but the range is fixed; that of the model counts.
    jobs.build_scene(spark, views.frames(spark, d), folder, SIDE, BBOX, "scene-1", merge={"metrics": {"data_range_k": 1.0}, "model": {"name": "blend"}})
    document = jobs.read_scene(spark, folder)
    each = jobs.scene_files(spark, folder, document, [(z, x, y) for z in (0, 1) for x in range(1 << z) for y in range(1 << z)])
    names = ["n_images", "n_thumbs", "n_tiles", "n_netcdf"]
    found = each.groupBy("kind").agg(F.count("*").alias("n_frames"), *[F.sum(n).alias(n) for n in names])
    return found.select("*", F.lit(document["metrics"]["data_range_k"]).alias("span"), F.lit(document["model"]["name"]).alias("model"))


@query("ORC05 SNK22 SNK23 ORC03", f"""WITH {S.PX}, {S.MIDDLE}, m AS (SELECT k, avg(pow({S.unit('pred')} - {S.unit('truth')}, 2)) AS mm, {S.rmse('pred', 'truth')} AS e, avg(abs({S.unit('pred')} - {S.unit('a')})) AS s, avg(abs({S.unit('b')} - {S.unit('a')})) AS w FROM middle GROUP BY k)
 SELECT 'M32' AS method_id, 'lead_half' AS metric, round(avg(e), 6) AS value FROM m UNION ALL SELECT 'M39', 'seam', round(avg(s), 6) FROM m UNION ALL SELECT 'M39', 'half_step', round(avg(w) / 2, 6) FROM m UNION ALL SELECT 'M7', 'skipped', NULL""")
def orc_report(spark, d):
    """Methods run, written as a report and read back; one that needs more than a sequence is skipped."""
    report = jobs.make_report(views.frames(spark, d), folders.shared(spark, "report"), ["M32", "M39", "M7"], SIDE)
    return rounded(report.filter("metric <> 'lead_tenth'"))


@query("SNK16 FLW15", f"""WITH {S.PX}, f AS (SELECT k, y, x, (bt - 250) / 10 AS u, (250 - bt) / 20 AS v FROM px) SELECT k, count(*) AS n, round(sum(round(68.0::DOUBLE + (x + 0.5::DOUBLE) * 3.75::DOUBLE + u * 3.75::DOUBLE, 6)), 4) AS lon1, round(sum(round(38.0::DOUBLE - (y + 0.5::DOUBLE) * 4.0::DOUBLE - v * 4.0::DOUBLE, 6)), 4) AS lat1 FROM f WHERE y % 4 = 2 AND x % 4 = 2 GROUP BY k""")
def snk_flow_files(spark, d):
    """Overlay vectors as one JSON file a frame, and those read back."""
    folder = folders.shared(spark, "overlay")
    fr = views.frames(spark, d).select("k", F.transform("bt", lambda b: (b - 250) / 10).alias("u"), F.transform("bt", lambda b: (250 - b) / 20).alias("v"))
    jobs.flow_files(fr, folder, SIDE, 4, BBOX).write.format("noop").mode("overwrite").save()
    got = spark.read.option("wholetext", True).text(f"{folder}/flow").select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json", 1).cast("long").alias("k"), F.explode(F.from_json("value", "array<struct<y int, x int, lon0 double, lat0 double, lon1 double, lat1 double>>")).alias("v"))
    return got.groupBy("k").agg(F.count("*").alias("n"), r(F.sum("v.lon1"), 4).alias("lon1"), r(F.sum("v.lat1"), 4).alias("lat1"))


# --- tiles -----------------------------------------------------------------------------------------------------------

def _colored(spark, d):
    return tiles.colored(views.frames(spark, d, masked=True), lambda b: grid.bt_to_rgba(b))


_TILE_SQL = f"""WITH {S.MASKED_FRAMES}, t AS (SELECT k, z, x, y, (y * 4 + j // 4) AS row_, (x * 4 + j % 4) AS col_ FROM frames, unnest([0, 1]) a(z), unnest([0, 1]) b(x), unnest([0, 1]) c(y), unnest(range(0, 16)) e(j) WHERE x < pow(2, z) AND y < pow(2, z)),
 p AS (SELECT t.k, z, x, y, CASE WHEN z = 1 THEN bt[row_ * 8 + col_ + 1] ELSE bt[(row_ * 2 + 1) * 8 + col_ * 2 + 1 + 1] END AS v FROM t JOIN masked m USING (k))"""


@query("SNK18 TIL02 TIL03 VIZ03 VIZ04", f"""{_TILE_SQL} SELECT k, z::INT AS z, x::INT AS x, y::INT AS y, count(v) AS n_opaque FROM p GROUP BY k, z, x, y""")
def snk_tiles(spark, d):
    """Tiles of every frame as PNG files, decoded again."""
    cut = tiles.cut_tiles(_colored(spark, d), SIDE, 4)

    def opaque(batches):
        for batch in batches:
            yield batch[["k", "z", "x", "y"]].assign(n_opaque=[int((tiles.read_png(p)[:, :, 3] == 255).sum()) for p in batch["png"]])
    return cut.mapInPandas(opaque, "k long, z int, x int, y int, n_opaque long")


@query("SNK19 TIL04 TIL05", f"""{_TILE_SQL} SELECT k, 5 AS n_tiles, 0 AS min_zoom, 1 AS max_zoom, 680000000 AS west_e7, 60000000 AS south_e7, 980000000 AS east_e7, 380000000 AS north_e7, 830000000 AS center_lon_e7, count(v) AS n_opaque FROM p GROUP BY k""")
def snk_pmtiles(spark, d):
    """An archive of each frame's tiles, its header and tiles read back."""
    made = tiles.archives(tiles.cut_tiles(_colored(spark, d), SIDE, 4), BBOX, {"name": "frame"})
    names = ["n_tiles", "min_zoom", "max_zoom", "west_e7", "south_e7", "east_e7", "north_e7", "center_lon_e7"]

    def read(batches):
        for batch in batches:
            rows = []
            for k, content in zip(batch["k"], batch["content"]):
                head, found = tiles.read_archive(content)
                rows.append((k, *[head[n] for n in names], sum(int((tiles.read_png(p)[:, :, 3] == 255).sum()) for p in found.values())))
            yield pd.DataFrame(rows, columns=["k", *names, "n_opaque"])
    return made.mapInPandas(read, "k long, " + ", ".join(f"{n} int" for n in names) + ", n_opaque long")


@query("SNK20 SNK21 VIZ06", """SELECT label, count(*) AS n_images, 8 AS n_rows, 16 AS n_cols, count(*) * 8 * 8 * 2 - 24 * count(*) AS n_opaque FROM embeddings WHERE vec_id > (SELECT min(vec_id) FROM embeddings) AND vec_id < (SELECT max(vec_id) FROM embeddings) GROUP BY label""")
def snk_animation(spark, d):
    """For each label an animation of its triplets: the predicted beside the true frame. An animation has the frames of one scene."""
    from cadenza.sources import images

    channels = [(c, n) for c in ("pred", "truth") for n in "rgba"]
    color = lambda c: F.transform(c, lambda b: grid.bt_to_rgba(b)).alias(c)
    mid = crossval.middle(views.frames(spark, d, masked=True)).select("label", "k", color("pred"), color("truth"))
    plane = lambda c, n: F.transform(c, lambda p: p[n]).alias(f"{c}_{n}")
    mid = mid.select("label", "k", *[plane(c, n) for c, n in channels])

    def pack(batches):
        """Images are made and compressed where their frames are, so that an animation's task gets small rows."""
        for batch in batches:
            planes = {(c, n): batch[f"{c}_{n}"].flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(-1, SIDE, SIDE) for c, n in channels}
            left, right = (np.stack([planes[c, n] for n in "rgba"], axis=-1) for c in ("pred", "truth"))
            rows = [images.packed(images.side_by_side(p, t)) for p, t in zip(left, right)]
            yield pa.RecordBatch.from_arrays([batch["label"], batch["k"], pa.array(rows, pa.binary())], names=["label", "k", "rows"])

    def animate(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        raw = images.animation(group["rows"].tolist(), (SIDE, 2 * SIDE), 200)
        found = [(f.shape, int((f[:, :, 3] == 255).sum())) for f in images.read_animation(raw)]
        return pd.DataFrame({"label": [group["label"].iloc[0]], "n_images": [len(found)], "n_rows": [found[0][0][0]], "n_cols": [found[0][0][1]], "n_opaque": [sum(n for _, n in found)]})
    return mid.mapInArrow(pack, "label int, k long, rows binary").groupBy("label").applyInPandas(animate, "label int, n_images long, n_rows int, n_cols int, n_opaque long")


# --- cache, streams -----------------------------------------------------------------------------------------------------

@query("SRV02 JON16", """SELECT step, state, count(*) AS n FROM (SELECT 'first' AS step, CASE WHEN vec_id % 4 = 0 THEN 'hit' ELSE 'miss' END AS state FROM embeddings UNION ALL SELECT 'second', 'hit' FROM embeddings UNION ALL SELECT 'cleared', 'miss' FROM embeddings
 UNION ALL SELECT 'body', CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END FROM embeddings) GROUP BY step, state""")
def srv_result_cache(spark, d):
    """Set, has, get, missing and clear of the cache of results."""
    cache = ResultCache(spark, folders.shared(spark, "cache"))
    want = table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), text.cache_key(F.col("vec_id").cast("string"), F.lit("png")).alias("key"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("body"))
    steps = []

    def note(step: str, states) -> None:
        # The cache changes between the steps, so each is counted where it stands.
        steps.extend((step, row["state"], row["n"]) for row in states.groupBy("state").agg(F.count("*").alias("n")).collect())
    hits = lambda: cache.has(want.select("key")).select(F.when(F.col("hit"), "hit").otherwise("miss").alias("state"))
    cache.set(want.filter("k % 4 = 0"))
    note("first", hits())
    cache.set(want.join(cache.missing(want.select("key")), "key", "left_semi"))
    note("second", hits())
    note("body", cache.get(want.select("key")).select(F.col("body").cast("string").alias("state")))
    cache.clear()
    note("cleared", hits())
    return spark.createDataFrame(steps, "step string, state string, n long")


@query("STM03 STM06", f"""WITH {S.SERIES}, p AS (SELECT user_id, ts, bt, lag(ts) OVER w AS before, lag(bt) OVER w AS was FROM series WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT user_id, count(*) AS observed, count(before) AS interpolated, round(sum(0.5::DOUBLE * bt + 0.5::DOUBLE * was), 4) AS total FROM p GROUP BY user_id""")
def stm_pairs(spark, d):
    """A stream of frames by scene, densified with the frame before each; files arrive in order of time, rows in any order."""
    source, out = folders.shared(spark, "arriving"), folders.shared(spark, "paired")
    series = views.series(spark, d).select(F.col("user_id").cast("string").alias("scene"), "ts", "bt")
    series.repartitionByRange(4, "ts").write.parquet(source)
    # One batch holds all files, and state goes from batch to batch where there are several.
    stream = spark.readStream.schema("scene string, ts timestamp_ntz, bt double").parquet(source)
    run = streaming.pair_frames(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.schema("scene string, ts timestamp, kind string, t double, bt double").parquet(out)
    made = F.col("kind") == "interpolated"
    return got.groupBy(F.col("scene").cast("long").alias("user_id")).agg(F.count_if(~made).alias("observed"), F.count_if(made).alias("interpolated"), r(F.sum(F.when(made, F.col("bt"))), 4).alias("total"))


@query("STM04", """SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id""")
def stm_skip_present(spark, d):
    """A stream in which a key that has come before is skipped."""
    source, out = folders.shared(spark, "arriving"), folders.shared(spark, "fresh")
    table(spark, d, "events").select("user_id", "event_type", "ts").write.parquet(source)
    stream = spark.readStream.schema("user_id long, event_type string, ts timestamp_ntz").parquet(source)
    run = streaming.skip_present(stream, ["user_id", "event_type"], "400 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("user_id long, event_type string, ts timestamp").parquet(out).groupBy("user_id").agg(F.count("*").alias("n"))


@query("STM01", """SELECT event_id, (epoch_ms(date_trunc('second', ts)) - min(epoch_ms(date_trunc('second', ts))) OVER ()) // 250 AS steps FROM events""")
def stm_clock(spark, d):
    """How many whole steps of a quarter of a second a playback clock has made when each event comes."""
    ev = table(spark, d, "events").select("event_id", (F.unix_seconds(F.col("ts").cast("timestamp")) * 1000).alias("ms"))
    first = ev.agg(F.min("ms").alias("first"))
    return ev.join(F.broadcast(first), F.lit(True)).select("event_id", streaming.clock_steps(F.col("ms") - F.col("first"), 250).alias("steps"))  # one row is broadcast


# --- small functions ----------------------------------------------------------------------------------------------------

@query("STR22 STR10 STR07", """SELECT event_id, strftime(ts, '%d %b · %H:%MZ') AS utc, strftime(ts, '%H:%M:%SZ') AS clock, round((epoch_ms(date_trunc('second', ts)) - epoch_ms(TIMESTAMP '2024-01-01')) / 60000.0::DOUBLE, 4) AS minutes,
 CASE WHEN event_type = 'error' THEN '—' ELSE printf('%.2f', floor(value * 100 + 0.5::DOUBLE) / 100) END AS shown, date_trunc('second', ts) AS first FROM events""")
def str_display(spark, d):
    iso = text.iso_z(F.col("ts"))
    value = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, d, "events").select(
        "event_id", text.display_utc(iso).alias("utc"), text.display_clock(iso).alias("clock"), r(text.minutes_between(F.lit("2024-01-01T00:00:00Z"), iso), 4).alias("minutes"),
        text.shown(text.round_half_up(value, 2), 2).alias("shown"), text.first_time(F.array(text.parse_time(iso), F.lit(None).cast("timestamp_ntz"))).alias("first"))


@query("STR19", """SELECT label, left(sha1(string_agg(vec_id || ':' || printf('%.6f', embedding[1]::DOUBLE), ',' ORDER BY vec_id) || '|grid'), 16) AS key FROM embeddings GROUP BY label""")
def str_grid_key(spark, d):
    """A key of 16 digits for the coordinates of a group and a grid."""
    e = table(spark, d, "embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    listed = F.array_sort(F.collect_list(F.struct("vec_id", F.concat_ws(":", F.col("vec_id").cast("string"), F.format_string("%.6f", "x")).alias("s"))))
    return e.groupBy("label").agg(text.grid_key(F.array_join(F.transform(listed, lambda p: p["s"]), ","), F.lit("grid")).alias("key"))


@query("STR21", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE 7 END AS epochs, CASE WHEN o_orderkey % 2 = 0 THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END AS rate, o_orderkey % 5 = 0 AS amp FROM orders""")
def str_overrides(spark, d):
    """Typed overrides a.b=value: values that do not fit their type leave the default."""
    k = F.col("o_orderkey")
    given = F.array(
        F.concat(F.lit("train.epochs="), F.when(k % 3 == 0, k.cast("string")).otherwise("many")), F.when(k % 2 == 0, "train.rate= 0.5").otherwise("train.other=1"), F.concat(F.lit("train.amp="), F.when(k % 5 == 0, "Yes").otherwise("off")), F.lit("nonsense"))
    return table(spark, d, "orders").select("o_orderkey", text.override(given, "train.epochs", F.lit(7).cast("long"), "long").alias("epochs"), text.override(given, "train.rate", F.lit(0.1), "double").alias("rate"), text.override(given, "train.amp", F.lit(False), "boolean").alias("amp"))


@query("ARR02 ARR03 SCL23", f"""WITH {S.PX} SELECT k, x AS i, y AS j, round(x / 7.0::DOUBLE, 6) AS at, round(bt, 6) AS value FROM px""")
def arr_layout(spark, d):
    """Each frame as rows, transposed, beside inclusive steps from 0 to 1."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda y: F.slice("bt", y * SIDE + 1, SIDE))
    wide = views.frames(spark, d).select("k", stencil.transposed(rows).alias("a"), grid.linspace(0.0, 1.0, SIDE).alias("at"))
    flat = wide.select("k", F.posexplode(F.arrays_zip("a", "at")).alias("i", "p"))
    return flat.select("k", "i", r(F.col("p.at")).alias("at"), F.posexplode("p.a").alias("j", "value")).select("k", "i", "j", "at", r("value").alias("value"))


@query("SET03 SRC33", """SELECT label, round(avg(b), 6) AS mean FROM (SELECT label, 250.0::DOUBLE + 60.0::DOUBLE * unnest(embedding)::DOUBLE AS b FROM embeddings) GROUP BY label""")
def set_stats(spark, d):
    """Statistics by data set, merged one by one into a JSON document and read back; a missing document is empty."""
    folder = folders.shared(spark, "stats")
    assert jobs.load_json(folder, "norm_stats.json") == {}
    found = views.frames(spark, d).select("label", F.explode("bt").alias("b")).groupBy("label").agg(F.avg("b").alias("mean"), F.stddev_pop("b").alias("std"), F.count("*").alias("n")).collect()
    for row in found:  # one row for each data set
        jobs.save_stats(folder, str(row["label"]), {"mean_k": 0.0})
        jobs.save_stats(folder, str(row["label"]), {"mean_k": row["mean"], "std_k": row["std"], "n_samples": row["n"]})
    return rounded(spark.createDataFrame([(int(k), v["mean_k"]) for k, v in jobs.load_json(folder, "norm_stats.json").items()], "label int, mean double"))


@query("FLW13", f"""WITH {S.PX}, f AS (SELECT k, i, (bt - 250) / 30 AS u, (260 - bt) / 60 AS v FROM px), a AS (SELECT k, i, sqrt(u * u + v * v) AS rad, (atan2(-v, -u) / pi() + 1) / 2 * 54 AS fk FROM f) SELECT k, i::INT AS i, floor(fk)::INT AS wheel, round(fk - floor(fk), 4) AS part, rad <= 1 AS inside FROM a""")
def flw_wheel(spark, d):
    """Where on the colour wheel's 55 entries each flow vector falls."""
    px = views.frames(spark, d).select("k", F.posexplode("bt").alias("i", "bt"))
    u, v = (F.col("bt") - 250) / 30, (260 - F.col("bt")) / 60
    place = stencil.wheel_place(u, v)
    return px.select("k", "i", F.floor(place).cast("int").alias("wheel"), r(place - F.floor(place), 4).alias("part"), (F.hypot(u, v) <= 1).alias("inside"))


def _wheel_sql(channel: int) -> str:
    entries = "[" + ", ".join(str(e[channel]) for e in stencil.color_wheel()) + "]"
    at = lambda k: f"{entries}[({k}) % 55 + 1] / 255.0::DOUBLE"
    return f"((1.0::DOUBLE - part) * ({at('first')}) + part * ({at('first + 1')}))"


def _rgb_sql(channel: int) -> str:
    c = _wheel_sql(channel)
    return f"CASE WHEN u IS NULL THEN 0 ELSE floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, CASE WHEN share <= 1 THEN 1.0::DOUBLE - share * (1.0::DOUBLE - {c}) ELSE {c} * 0.75::DOUBLE END * 255.0::DOUBLE)))::INT END"


@query("FLW13 SCL23", f"""WITH {S.MASKED}, f AS (SELECT k, i, (bt - 250) / 30 AS u, (260 - bt) / 60 AS v FROM px), m AS (SELECT k, max(sqrt(u * u + v * v)) * 0.8::DOUBLE + 1.1920928955078125e-07::DOUBLE AS most FROM f GROUP BY k),
 n AS (SELECT k, i, u / most AS u, v / most AS v FROM f JOIN m USING (k)), p AS (SELECT *, sqrt(u * u + v * v) AS share, (atan2(-v, -u) / pi() + 1) / 2 * 54 AS place FROM n), w AS (SELECT *, floor(place)::INT AS first, place - floor(place) AS part FROM p)
 SELECT k, i::INT AS i, {_rgb_sql(0)} AS r, {_rgb_sql(1)} AS g, {_rgb_sql(2)} AS b FROM w""")
def flw_image(spark, d):
    """Flow as colours, normalised by four fifths of each frame's largest magnitude; missing pixels are black."""
    fr = views.frames(spark, d, masked=True).select("k", F.transform("bt", lambda b: (b - 250) / 30).alias("u"), F.transform("bt", lambda b: (260 - b) / 60).alias("v"))
    fr = fr.withColumn("largest", F.array_max(F.zip_with("u", "v", lambda u, v: F.sqrt(u * u + v * v))) * 0.8)
    px = fr.select("k", "largest", F.posexplode(F.arrays_zip("u", "v")).alias("i", "f"))
    return px.select("k", "i", stencil.flow_rgb(F.col("f.u"), F.col("f.v"), F.col("largest")).alias("c")).select("k", "i", "c.*")


@query("MDL01 MDL02 MDL03", f"""WITH {S.PX}, {S.MIDDLE} SELECT k, round(avg(0.75::DOUBLE * a + 0.25::DOUBLE * b), 6) AS linear, round(avg(a), 6) AS copy, true AS unknown FROM middle GROUP BY k""")
def mdl_registry(spark, d):
    """Models by name, at a time of each frame's own; an unknown name is an error."""
    mid = crossval.middle(views.frames(spark, d)).withColumn("t", F.lit(0.25))
    run = lambda name: _mean_of(crossval.get_model(name)(F.col("bt_prev"), F.col("bt_next"), F.col("t")))
    try:
        crossval.get_model("nope")
        unknown = False
    except ValueError:
        unknown = True
    return rounded(mid.select("k", run("linear").alias("linear"), run("copy").alias("copy"), F.lit(unknown).alias("unknown")))


def _mean_of(c):
    return F.try_divide(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), F.size(c).cast("double"))
