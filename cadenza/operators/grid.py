"""Regridding, patches, crops, tiles and colours."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.scalar import VMAX_K, VMIN_K, haversine_km
from cadenza.functions.text import hex_channel

# Stops of the cloud colour ramp by Kelvin.
IR_CLOUDS = [(180.0, "#ffffff"), (200.0, "#ff64ff"), (220.0, "#ff0000"), (240.0, "#ffa500"), (260.0, "#ffff00"), (275.0, "#00c800"), (290.0, "#0a3d91"), (320.0, "#000000")]
MAX_ZOOM = 8


def nearest_mapping(target: DataFrame, source: DataFrame, radius_km: float = 50.0) -> DataFrame:
    """For each target point (t_id, lat, lon) the nearest source point (s_id, lat, lon) within the radius, ties to the smaller s_id.

    Both are put into cells no narrower than the radius; a target looks into its own and the cells around, so the join
    is an equi-join. Columns of cells widen with latitude and go around the globe: those of a row are counted modulo their
    number, so that neighbours across 180 degrees meet. Points at one place are looked up once: of the sources the smallest s_id counts."""
    deg = radius_km / 111.0
    row = lambda c: F.floor(c / deg).cast("long")
    # Degrees of longitude that the radius spans at the row's edge nearest to a pole; all of them around the pole itself.
    edge = lambda r: F.radians(F.least(F.lit(90.0), F.greatest(F.abs(r), F.abs(r + 1.0)) * deg))
    share = lambda r: F.sin(F.radians(F.lit(deg / 2))) / F.greatest(F.lit(1e-12), F.cos(edge(r)))
    wide = lambda r: F.when(share(r) >= 1, 360.0).otherwise(F.degrees(2 * F.asin(F.least(F.lit(1.0), share(r)))))
    s = source.groupBy(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")).agg(F.min("s_id").alias("s_id")).withColumn("r", row(F.col("s_lat")))
    # Whole columns to a row: as wide as they must be, or a little wider.
    columns = lambda: F.greatest(F.lit(1), F.floor(360.0 / wide(F.col("r").cast("double")))).cast("long")
    column = lambda lon: F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * columns()).cast("long")
    s = s.withColumn("c", column(F.col("s_lon")))
    points = target.select("t_id", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    t = points.select("t_lat", "t_lon").distinct().withColumn("r", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: row(F.col("t_lat")) + d)))
    t = t.withColumn("c", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(column(F.col("t_lon")) + d, columns()))))
    t = t.dropDuplicates(["t_lat", "t_lon", "r", "c"])  # rows of less than three columns
    near = t.join(s, ["r", "c"]).withColumn("km", haversine_km(F.col("t_lat"), F.col("t_lon"), F.col("s_lat"), F.col("s_lon"))).filter(F.col("km") <= radius_km)
    best = near.groupBy("t_lat", "t_lon").agg(F.min(F.struct("km", "s_id")).alias("p"))
    return points.join(best, ["t_lat", "t_lon"]).groupBy("t_id").agg(F.min("p").alias("m")).select("t_id", "m.s_id", "m.km")


def apply_mapping(mapping: DataFrame, target: DataFrame, values: DataFrame) -> DataFrame:
    """Values by the mapping; NULL outside its coverage."""
    return target.select("t_id").join(mapping, "t_id", "left").join(values, "s_id", "left")


def bilinear(pixels: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Values at fractional (fy, fx) from the four pixels around; NULL where one is missing or outside."""
    w = wanted.withColumn("dy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("dx", F.explode(F.array(F.lit(0), F.lit(1))))
    y0, x0 = F.floor("fy").cast("int"), F.floor("fx").cast("int")
    w = w.withColumn("wy", F.col("fy") - y0).withColumn("wx", F.col("fx") - x0)
    part = lambda d, f: F.when(d == 1, f).otherwise(1 - f)
    w = w.withColumn("weight", part(F.col("dy"), F.col("wy")) * part(F.col("dx"), F.col("wx"))).withColumn("y", y0 + F.col("dy")).withColumn("x", x0 + F.col("dx"))
    got = w.filter("weight > 0").join(pixels, [*keys, "y", "x"], "left")
    return got.groupBy(*keys, "fy", "fx").agg(F.when(F.count_if(F.col("bt").isNull()) == 0, F.sum(F.col("bt") * F.col("weight"))).alias("bt"))


def origins(length: int, size: int, stride: int, drop_incomplete: bool = True) -> list[int]:
    """Patch origins; else the last is flush with the end."""
    if size <= 0 or stride <= 0:
        raise ValueError("size and stride must be positive")
    out = list(range(0, length - size + 1, stride))
    if not drop_incomplete and length >= size and out[-1] != length - size:
        out.append(length - size)
    return out


def patches(framed: DataFrame, keys: list[str], side: int, size: int, stride: int, drop_incomplete: bool = True) -> DataFrame:
    """Square patches of frames held as arrays: patch number, origin, bt and the share of pixels that are there."""
    starts = origins(side, size, stride, drop_incomplete)
    made = F.array(*[
        F.struct(F.lit(n).alias("patch"), F.lit(y).alias("y0"), F.lit(x).alias("x0"), F.flatten(F.array(*[F.slice("bt", (y + r) * side + x + 1, size) for r in range(size)])).alias("bt"))
        for n, (y, x) in enumerate((y, x) for y in starts for x in starts)
    ])
    out = framed.select(*keys, F.explode(made).alias("p")).select(*keys, "p.*")
    return out.withColumn("valid_fraction", F.size(F.filter("bt", lambda v: v.isNotNull())) / float(size * size))


def random_crop(framed: DataFrame, keys: list[str], side: int, size: int, seed: int, tries: int = 8, min_valid: float = 0.0) -> DataFrame:
    """One crop a frame: of `tries` origins hashed from the keys the first with enough valid pixels, else the last."""
    if size > side:
        raise ValueError("the crop is larger than the frame")
    span = side - size + 1
    def candidate(n):
        y = F.pmod(F.xxhash64(*keys, F.lit(seed), F.lit(2 * n)), F.lit(span)).cast("int")
        x = F.pmod(F.xxhash64(*keys, F.lit(seed), F.lit(2 * n + 1)), F.lit(span)).cast("int")
        bt = F.flatten(F.array(*[F.slice(F.col("bt"), (y + r) * side + x + 1, F.lit(size)) for r in range(size)]))
        return F.struct(F.lit(n).alias("attempt"), y.alias("y0"), x.alias("x0"), bt.alias("bt"))
    every = F.array(*[candidate(n) for n in range(tries)])
    good = F.filter(every, lambda c: F.size(F.filter(c["bt"], lambda v: v.isNotNull())) >= min_valid * size * size)
    chosen = F.coalesce(F.get(good, F.lit(0)), F.get(every, F.lit(tries - 1)))
    return framed.select(*keys, chosen.alias("c")).select(*keys, "c.*")


def default_max_zoom(height: int, width: int, tile: int = 256) -> int:
    longest = max(height, width, 1)
    return min(MAX_ZOOM, max(0, ceil(log2(longest / tile)))) if longest > tile else 0


def tile_pyramid(frames: DataFrame, key: str, min_zoom: int, max_zoom: int) -> DataFrame:
    """All tiles (z, x, y) of each frame."""
    if max_zoom < min_zoom:
        raise ValueError("max_zoom is below min_zoom")
    z = frames.select(key).withColumn("z", F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom)))).withColumn("n", F.pow(F.lit(2.0), F.col("z")).cast("int"))
    return z.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")


def ramp(x: Column, stops: list[tuple[float, str]], channel: int) -> Column:
    """Channel of the piecewise linear colour ramp, rounded half to even."""
    out = None
    for (a, ca), (b, cb) in zip(stops, stops[1:]):
        lo, hi = hex_channel(F.lit(ca), channel), hex_channel(F.lit(cb), channel)
        value = F.bround(lo + (hi - lo) * (x - a) / (b - a)).cast("int")
        out = F.when(x <= b, value) if out is None else out.when(x <= b, value)
    return out.otherwise(hex_channel(F.lit(stops[-1][1]), channel))


def bt_to_rgba(bt: Column, vmin: float = VMIN_K, vmax: float = VMAX_K, stops: list[tuple[float, str]] | None = None) -> Column:
    """r, g, b, a of a temperature on 256 levels of the fixed range; a missing pixel is transparent."""
    if vmax <= vmin:
        raise ValueError("the range must be positive")
    level = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((bt - vmin) / (vmax - vmin) * 256).cast("int")))
    kelvin = VMIN_K + level / 255.0 * (VMAX_K - VMIN_K)
    parts = [F.when(bt.isNotNull(), ramp(kelvin, stops or IR_CLOUDS, c)).otherwise(0).alias(n) for c, n in enumerate("rgb")]
    return F.struct(*parts, F.when(bt.isNotNull(), 255).otherwise(0).alias("a"))


def linspace(low: float, high: float, n: int) -> Column:
    """n steps from low to high, both included."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + i * (high - low) / float(max(1, n - 1)))
