"""Per-pixel scalar expressions. A missing pixel is NULL; arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The metric range, the model input range (Kelvin) and the operational grid.
VMIN_K, VMAX_K = 180.0, 320.0
MODEL_VMIN_K, MODEL_VMAX_K = 180.0, 330.0
OPERATIONAL_GRID = {"west": 68.0, "south": 6.0, "east": 98.0, "north": 38.0, "n_rows": 800, "n_cols": 750}


def finite(x: Column) -> Column:
    """True for a value that is neither NULL nor NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def nan_to_null(x: Column) -> Column:
    return F.when(finite(x), x)


def normalize_bt(x: Column, vmin: float = MODEL_VMIN_K, vmax: float = MODEL_VMAX_K) -> Column:
    """(x - vmin) / (vmax - vmin) without clipping."""
    if vmax <= vmin:
        raise ValueError("the range must be positive")
    return (x - vmin) / (vmax - vmin)


def denormalize_bt(x: Column, vmin: float = MODEL_VMIN_K, vmax: float = MODEL_VMAX_K) -> Column:
    if vmax <= vmin:
        raise ValueError("the range must be positive")
    return x * (vmax - vmin) + vmin


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """NULL where the deviation is zero."""
    return F.try_divide(x - mean, std)


def un_zscore(z: Column, mean: Column, std: Column) -> Column:
    return z * std + mean


def clip(x: Column, low: float, high: float) -> Column:
    """NULL stays NULL: greatest and least alone would skip it."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def to_unit_interval(x: Column, vmin: float = VMIN_K, vmax: float = VMAX_K, clipped: bool = True) -> Column:
    unit = normalize_bt(x, vmin, vmax)
    return clip(unit, 0.0, 1.0) if clipped else unit


def from_unit_interval(x: Column, vmin: float = VMIN_K, vmax: float = VMAX_K) -> Column:
    return denormalize_bt(x, vmin, vmax)


def model_input(x: Column, fill: float = 0.0) -> Column:
    """Kelvin to the model's unit range, missing pixels filled."""
    return F.coalesce(normalize_bt(nan_to_null(x)), F.lit(fill))


def radiance_to_bt(rad: Column, fk1: float, fk2: float, bc1: float = 0.0, bc2: float = 1.0) -> Column:
    """Inverse Planck function; NULL for a radiance that is not positive."""
    if fk1 == 0 or bc2 == 0:
        raise ValueError("fk1 and bc2 must not be zero")
    return F.when(finite(rad) & (rad > 0), (fk2 / F.ln(fk1 / rad + 1.0) - bc1) / bc2)


def count_to_radiance(count: Column, gain: float, offset: float, quadratic: float = 0.0) -> Column:
    c = count.cast("double")
    return quadratic * c * c + gain * c + offset


def lut_lookup(lut: Column, count: Column) -> Column:
    """lut[count], NULL outside the table and for values that are not positive."""
    value = F.when(count >= 0, F.get(lut, count))
    return F.when(value > 0, value)


def linear_blend(a: Column, b: Column, t: Column | float, null_mode: str = "propagate") -> Column:
    """(1 - t) a + t b; with null_mode one_sided the side that is there counts where the other is missing."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    blend = (1 - t) * a + t * b
    if null_mode == "propagate":
        return blend
    if null_mode == "one_sided":
        return F.coalesce(blend, a, b)
    raise ValueError(f"null_mode {null_mode!r}")


def frame_copy(a: Column, b: Column, t: Column | float) -> Column:
    """The nearer frame; t = 0.5 takes the later one."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    return F.when(t < 0.5, a).otherwise(b)


def restore_mask(value: Column, *inputs: Column) -> Column:
    """NULL where any input is missing."""
    known = F.lit(True)
    for x in inputs:
        known = known & x.isNotNull()
    return F.when(known, value)


def lat_center(y: Column, north: float, south: float, n_rows: int) -> Column:
    """Pixel centres from north to south."""
    return north - (y + 0.5) * ((north - south) / n_rows)


def lon_center(x: Column, west: float, east: float, n_cols: int) -> Column:
    return west + (x + 0.5) * ((east - west) / n_cols)


def scan_angle_to_lat_lon(x: Column, y: Column, r_eq: float, r_pol: float, height: float, lon_0: float) -> tuple[Column, Column]:
    """Geostationary fixed-grid scan angles (radians) to geodetic degrees; NULL off the disk."""
    h = height + r_eq
    ratio = (r_eq / r_pol) ** 2
    a = F.pow(F.sin(x), 2.0) + F.pow(F.cos(x), 2.0) * (F.pow(F.cos(y), 2.0) + ratio * F.pow(F.sin(y), 2.0))
    b = -2.0 * h * F.cos(x) * F.cos(y)
    root = b * b - 4.0 * a * (h * h - r_eq * r_eq)
    distance = F.when(root >= 0, (-b - F.sqrt(F.when(root >= 0, root))) / (2.0 * a))
    sx, sy, sz = distance * F.cos(x) * F.cos(y), -distance * F.sin(x), distance * F.cos(x) * F.sin(y)
    lat = F.degrees(F.atan(ratio * sz / F.sqrt(F.pow(h - sx, 2.0) + sy * sy)))
    lon = lon_0 - F.degrees(F.atan(sy / (h - sx)))
    return lat, lon


def log_add_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    p, q = F.radians(lat1), F.radians(lat2)
    s = F.pow(F.sin((q - p) / 2), 2.0) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), s)))


def shard_length(chunk: int, shard: int, size: int) -> int | None:
    """Largest multiple of `chunk` within both `shard` and `size`; None if that is the chunk itself."""
    length = chunk * max(min(shard, size) // chunk, 1)
    return None if length == chunk else length


def resolved(pixels: DataFrame, stats: DataFrame, dataset: str) -> DataFrame:
    """The pixels (bt and the column `dataset`) with `mean`, `std` and `norm`: by the statistics stored for the data set (dataset, mean,
    std), one row each, else by the fixed range. A spread of nearly nothing counts as no statistics."""
    own = stats.select(F.col(dataset).alias("__dataset"), "mean", "std")
    found = pixels.join(own, F.col(dataset) == F.col("__dataset"), "left").drop("__dataset")
    return found.withColumn("norm", F.when(F.col("std") >= 1e-6, zscore(F.col("bt"), F.col("mean"), F.col("std"))).otherwise(normalize_bt(F.col("bt"))))


def unresolved(norm: Column, mean: Column, std: Column) -> Column:
    """Kelvin of resolved() values."""
    return F.when(std >= 1e-6, un_zscore(norm, mean, std)).otherwise(denormalize_bt(norm))
