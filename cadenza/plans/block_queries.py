"""Queries on frames in blocks with halos; each has the SQL of the same operator on whole frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.scalar import to_unit_interval
from cadenza.operators import blocks, sequence
from cadenza.plans import sql as S
from cadenza.plans.registry import QUERIES, query, r
from cadenza.plans.sensor_queries import _W, _moment
from cadenza.sources import cube, folders, views
from cadenza.sources.views import SIDE

GRID = blocks.Grid(SIDE, SIDE, 4)


def _of(name: str) -> str:
    return QUERIES[name].sql


def _cut(frames, *columns: str):
    return blocks.from_frames(frames, ["k"], list(columns), GRID)


def _cells(found, *columns: str, digits: int = 6):
    """k, i (the pixel's number in the frame) and rounded values."""
    px = blocks.pixels(found, ["k"], list(columns), GRID)
    return px.select("k", (F.col("y") * SIDE + F.col("x")).alias("i"), *[r(c, digits).alias(c) for c in columns])


@query("STN01", _of("stn_sobel"))
def blk_sobel(spark, d):
    return _cells(blocks.sobel(_cut(views.frames(spark, d), "bt"), ["k"], "bt", GRID), "gx", "gy", digits=5)


@query("STN02", _of("stn_census"))
def blk_census(spark, d):
    return _cells(blocks.census(_cut(views.frames(spark, d), "bt"), ["k"], "bt", GRID), "census", digits=5)


@query("FLW04 FLW08 FLW11", _of("flw_warp"))
def blk_warp(spark, d):
    moved = views.frames(spark, d).withColumn("u", F.array_repeat(F.lit(1.5), 64)).withColumn("v", F.array_repeat(F.lit(-0.5), 64))
    return _cells(blocks.warp(_cut(moved, "bt", "u", "v"), ["k"], "bt", "u", "v", GRID, reach=1, scale=0.5).withColumnRenamed("warped", "bt"), "bt")


@query("JON08", _of("jon_bilinear"))
def blk_bilinear(spark, d):
    px = _cells(blocks.bilinear(_cut(views.frames(spark, d), "bt"), ["k"], "bt", GRID, 0.25, 0.5).withColumnRenamed("value", "bt"), "bt")
    return px.select("k", (F.floor(F.col("i") / SIDE) + 0.25).alias("fy"), (F.col("i") % SIDE + 0.5).alias("fx"), "bt")


@query("SMP06 FLT04", _of("smp_patches"))
def blk_patches(spark, d):
    found = blocks.patches(_cut(views.frames(spark, d, masked=True), "bt"), ["k"], "bt", GRID, 3, [0, 3, 5], [0, 3, 5])
    known = F.filter("patch", lambda v: v.isNotNull())
    number = F.array_position(F.array(F.lit(0), F.lit(3), F.lit(5)), F.col("y0")) * 3 + F.array_position(F.array(F.lit(0), F.lit(3), F.lit(5)), F.col("x0")) - 4
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known).cast("double"))
    return found.select("k", number.cast("int").alias("patch"), "y0", "x0", r(mean).alias("mean"), r(F.size(known) / 9.0).alias("valid_fraction"))


@query("TIL03 VIZ07", _of("til_downsample"))
def blk_pyramid(spark, d):
    found, small = blocks.halved(_cut(views.frames(spark, d), "bt"), ["k"], "bt", GRID)
    px = blocks.pixels(found, ["k"], ["bt"], small)
    return px.select("k", (F.col("y") * small.cols + F.col("x")).alias("i"), r("bt").alias("bt"))


@query("IMG02", f"""WITH {S.UNIT_FRAMES}, e AS (SELECT k, p, g, {_W} AS w FROM unit_frames), m AS (SELECT k, {_moment('p[(i // 2 + n // 7) * 8 + i % 2 + n % 7 + 1]')} AS a, {_moment('g[(i // 2 + n // 7) * 8 + i % 2 + n % 7 + 1]')} AS b,
 {_moment('pow(p[(i // 2 + n // 7) * 8 + i % 2 + n % 7 + 1], 2)')} AS aa, {_moment('pow(g[(i // 2 + n // 7) * 8 + i % 2 + n % 7 + 1], 2)')} AS bb, {_moment('p[(i // 2 + n // 7) * 8 + i % 2 + n % 7 + 1] * g[(i // 2 + n // 7) * 8 + i % 2 + n % 7 + 1]')} AS ab FROM e, unnest(range(0, 4)) AS places(i))
 SELECT k, round(avg((2 * a * b + 1e-4::DOUBLE) / (a * a + b * b + 1e-4::DOUBLE) * (2 * (ab - a * b) + 9e-4::DOUBLE) / (aa - a * a + bb - b * b + 9e-4::DOUBLE)), 6) AS ssim, count(*) AS windows FROM m GROUP BY k""")
def blk_ssim(spark, d):
    """SSIM of the linear blend of each frame's neighbours against the frame: sums over blocks."""
    t = sequence.triplets(views.frames(spark, d).select("k", "bt"), ["bt"])
    unit = lambda c: F.transform(c, lambda v: to_unit_interval(v))
    t = t.select("k", unit(F.zip_with("bt_prev", "bt_next", lambda a, b: 0.5 * a + 0.5 * b)).alias("p"), unit(F.col("bt")).alias("g"))
    return blocks.ssim(_cut(t, "p", "g"), ["k"], "p", "g", GRID).select("k", r("ssim").alias("ssim"), "windows")


@query("FLW01")
def blk_flow(spark, d):
    """The flow from each frame to the next."""
    pairs = sequence.brackets(views.frames(spark, d).select("k", "bt"), ["bt"])
    return _cells(blocks.horn_schunck(_cut(pairs, "bt", "bt_next"), ["k"], "bt", "bt_next", GRID, 20), "u", "v")


@query("SNK01 SNK02 SRC25 SRC26 HLP06", f"""WITH {S.MASKED} SELECT k, TIMESTAMP '2025-06-20 00:00:00' + to_minutes(30 * k::INT) AS time, (y // 4)::INT AS by, (x // 4)::INT AS bx, count(bt)::INT AS n_valid, round(avg(bt::FLOAT::DOUBLE), 4) AS mean FROM px GROUP BY ALL""")
def blk_cube(spark, d):
    """Blocks written by the sink that shows all or nothing, and read again chunk by chunk."""
    folder = folders.shared(spark, "cube")
    cut = blocks.from_frames(views.frames(spark, d, masked=True), ["k", "time"], ["bt"], GRID)
    cube.write_cube(cut, folder, GRID, (68.0, 6.0, 98.0, 38.0), {"source": "synthetic"})
    found, _ = cube.read_blocks(spark, folder)
    known = F.filter("bt", lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known).cast("double"))
    return found.select("k", "time", "by", "bx", F.size(known).alias("n_valid"), r(mean, 4).alias("mean"))
