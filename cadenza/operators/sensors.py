"""Comparison of several sensors: overlaps in time, inter-calibration, overpasses, collocation errors, bands and wavelets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import metrics


def nearest_in_time(a: DataFrame, b: DataFrame, tolerance_s: int, keys: list[str] | None = None) -> DataFrame:
    """Each row of `a` (time, ...) with the row of `b` nearest in time within the tolerance, ties to the earlier; b's columns
    get the suffix _b. Rows of `a` that are alike stay as many; of b's rows at one time (and keys) the least is met.

    Only times meet: they fall into buckets of the tolerance, a time meets those of its own bucket and of those beside it by an
    equi-join. Then each side is fetched once by its time."""
    keys = keys or []
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    own = a.select(*keys, "time").distinct()
    other = b.select(*[F.col(k).alias(f"{k}_o") for k in keys], F.col("time").alias("time_o")).distinct()
    left = own.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(second("time") / tolerance_s) + d)))
    right = other.withColumn("bucket_o", F.floor(second("time_o") / tolerance_s))
    gap = F.abs(second("time") - second("time_o"))
    met = left.join(right, [F.col("bucket") == F.col("bucket_o"), *[F.col(k) == F.col(f"{k}_o") for k in keys]]).filter(gap <= tolerance_s)
    best = met.groupBy(*keys, "time").agg(F.min(F.struct(gap.alias("gap"), F.col("time_o").alias("at"))).alias("m"))
    best = best.select(*[F.col(k).alias(f"{k}_m") for k in keys], F.col("time").alias("time_m"), F.col("m.at").alias("at_m"), F.col("m.gap").alias("gap_s"))
    named = b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns])
    one = named.groupBy(*[f"{k}_b" for k in keys], "time_b").agg(F.min(F.struct(*named.columns)).alias("row")).select("row.*")
    out = a.join(best, [F.col("time") == F.col("time_m"), *[F.col(k) == F.col(f"{k}_m") for k in keys]])
    out = out.join(one, [F.col("at_m") == F.col("time_b"), *[F.col(k) == F.col(f"{k}_b") for k in keys]])
    return out.select(*[a[c] for c in a.columns], *named.columns, "gap_s")


def pixel_pairs(framed: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """One row a pixel of frames held as arrays: keys, i and the values."""
    return framed.select(*keys, F.posexplode(F.arrays_zip(*columns)).alias("i", "p")).select(*keys, "i", "p.*")


def agreement(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Bias, rmse, correlation and number of pixel pairs that are there on both sides."""
    d = F.col(b) - F.col(a)
    ok = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return ok.groupBy(*keys).agg(F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), F.corr(a, b).alias("corr"), F.count("*").alias("n"))


def calibration(pairs: DataFrame, keys: list[str], reference: str, other: str) -> DataFrame:
    """Line from the other sensor to the reference, and the rmse that is left behind it."""
    x, y = F.col(other), F.col(reference)
    fit = pairs.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_syy(y, x).alias("syy"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))
    return fit.select(*keys, "slope", "intercept", F.sqrt(F.col("syy") * (1 - F.col("r2")) / F.col("n")).alias("rmse"), "n")


def triple_collocation(pairs: DataFrame, keys: list[str], names: tuple[str, str, str]) -> DataFrame:
    """Error variance of each of three independent measurements of one quantity, from their covariances; and the budget:
    each one's share of all error variance. Errors that come out negative, in small samples, count as zero in the shares."""
    x, y, z = names
    c = lambda p, q: F.covar_pop(p, q)
    wide = pairs.groupBy(*keys).agg(
        c(x, x).alias("xx"), c(y, y).alias("yy"), c(z, z).alias("zz"), c(x, y).alias("xy"), c(x, z).alias("xz"), c(y, z).alias("yz"), F.count("*").alias("n"))
    col = F.col
    errors = wide.select(
        *keys, (col("xx") - F.try_divide(col("xy") * col("xz"), col("yz"))).alias(f"error_{x}"), (col("yy") - F.try_divide(col("xy") * col("yz"), col("xz"))).alias(f"error_{y}"),
        (col("zz") - F.try_divide(col("xz") * col("yz"), col("xy"))).alias(f"error_{z}"), "n")
    total = sum((F.greatest(F.lit(0.0), col(f"error_{s}")) for s in names), F.lit(0.0))
    return errors.select("*", *[F.try_divide(F.greatest(F.lit(0.0), col(f"error_{s}")), total).alias(f"share_{s}") for s in names])


def overpasses(points: DataFrame, frames: DataFrame, side: int, bbox: tuple[float, float, float, float], cadence_s: int) -> DataFrame:
    """Points of a polar swath (p_id, time, lat, lon, bt) against the frame (time, bt as array) that their time falls into and
    the pixel that they lie in; points outside of the area meet nothing."""
    west, south, east, north = bbox
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / cadence_s)
    y = F.floor((north - F.col("lat")) / ((north - south) / side)).cast("int")
    x = F.floor((F.col("lon") - west) / ((east - west) / side)).cast("int")
    own = points.select("p_id", slot("time").alias("slot"), y.alias("y"), x.alias("x"), F.col("bt").alias("bt_polar"))
    own = own.filter(F.col("y").between(0, side - 1) & F.col("x").between(0, side - 1))
    met = own.join(frames.select(slot("time").alias("slot"), "k", F.col("bt").alias("frame")), "slot")
    return met.select("p_id", "k", "y", "x", "bt_polar", F.get("frame", F.col("y") * side + F.col("x")).alias("bt"))


def haar(frames: np.ndarray) -> dict[str, np.ndarray]:
    """One step of the Haar transform of a stack (n, rows, columns) of even sides: ll, lh, hl and hh of half its sides."""
    a, b, c, d = (frames[:, y::2, x::2] for y in (0, 1) for x in (0, 1))
    return {"ll": (a + b + c + d) / 2, "lh": (a + b - c - d) / 2, "hl": (a - b + c - d) / 2, "hh": (a - b - c + d) / 2}


def wavelet_energy(framed: DataFrame, keys: list[str], column: str, side: int, levels: int = 2) -> DataFrame:
    """keys, level, band and the mean square of the detail coefficients of each level, of frames held as arrays."""
    def run(batches):
        for batch in metrics.slices(batches, column):
            if not len(batch):
                continue
            image = metrics.stack(batch[column], side)
            for level in range(1, levels + 1):
                bands = haar(image)
                image = bands["ll"]
                for name in ("lh", "hl", "hh"):
                    yield batch[keys].assign(level=level, band=name, energy=(bands[name] ** 2).mean(axis=(1, 2)))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in framed.select(*keys).schema]
    return framed.select(*keys, column).mapInPandas(run, ", ".join([*fields, "level int, band string, energy double"]))
