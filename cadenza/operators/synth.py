"""Synthetic sequences: a warm surface with drifting, growing and fading cold clouds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sharpness of the soft maximum of clouds, and the most that clouds cool.
SOFT, MOST_COOLING_K = 12.0, 93.0
_FIELDS = ["x0", "y0", "vx", "vy", "ax", "ay", "wiggle", "phase", "birth", "life", "long", "short", "turn", "depth"]


def blobs(n: int, seed: int) -> list[dict[str, float]]:
    """Clouds drawn uniformly in a fixed order."""
    draw = np.random.default_rng(seed)
    low = np.array([0.1, 0.1, -0.5, -0.5, -0.2, -0.2, 0.0, 0.0, 0.0, 0.3, 0.06, 0.04, 0.0, 0.4])
    high = np.array([0.9, 0.9, 0.5, 0.5, 0.2, 0.2, 0.03, 2 * np.pi, 1.0, 1.0, 0.2, 0.12, np.pi, 1.0])
    return [dict(zip(_FIELDS, draw.uniform(low, high).tolist())) for _ in range(n)]


_BLOBS = f"array<struct<{', '.join(f'{f}: double' for f in _FIELDS)}>>"


def drawn_blobs(seed: Column, n_blobs: int) -> Column:
    """blobs() of each seed."""
    @F.pandas_udf(_BLOBS)
    def draw(seeds: pd.Series) -> pd.Series:
        return seeds.map(lambda s: blobs(n_blobs, int(s)))

    return draw(seed)


def cubes(scenes: DataFrame, side: int, n_blobs: int = 4, margin: int = 4) -> DataFrame:
    """scene, frame, y, x, time and bt of every pixel of scenes (scene, seed, n_frames), NULL in the space corners.

    A row is spread to its frames, these are dealt to tasks, and a frame to its pixels; the plan has one expression for all clouds."""
    scenes = scenes.select("scene", "n_frames", drawn_blobs(F.col("seed"), n_blobs).alias("blobs"))
    framed = scenes.select("scene", "n_frames", "blobs", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame")).repartition("scene", "frame")
    px = framed.select("scene", "n_frames", "blobs", "frame", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("i"))
    px = px.withColumn("y", F.floor(F.col("i") / side).cast("int")).withColumn("x", (F.col("i") % side).cast("int"))
    t = F.col("frame") / F.greatest(F.lit(1.0), F.col("n_frames") - 1.0)
    u, v = F.col("x") / F.lit(float(side - 1)), F.col("y") / F.lit(float(side - 1))

    def cloud(b: Column) -> Column:
        cx = b["x0"] + b["vx"] * t + b["ax"] * t * t + b["wiggle"] * F.sin(2 * np.pi * t + b["phase"])
        cy = b["y0"] + b["vy"] * t + b["ay"] * t * t
        dx, dy = u - cx, v - cy
        p, q = (F.cos(b["turn"]) * dx + F.sin(b["turn"]) * dy) / b["long"], (F.cos(b["turn"]) * dy - F.sin(b["turn"]) * dx) / b["short"]
        return b["depth"] * F.exp(-0.5 * (p * p + q * q)) * F.exp(-F.pow((t - b["birth"]) / b["life"], F.lit(2.0)))

    cooling = F.aggregate("blobs", F.lit(0.0), lambda total, b: total + F.exp(SOFT * cloud(b)))
    surface = 298.0 - 10.0 * v + 1.5 * F.sin(2 * np.pi * (u + 0.3 * t))
    cool = F.greatest(F.lit(0.0), (F.ln(cooling) - float(np.log(n_blobs))) / SOFT) * MOST_COOLING_K
    knee = 0.85 * MOST_COOLING_K
    soft = F.when(cool > knee, knee + (MOST_COOLING_K - knee) * F.tanh((cool - knee) / (MOST_COOLING_K - knee))).otherwise(cool)
    bt = F.greatest(F.lit(181.0), F.least(F.lit(319.0), surface - soft))
    space = F.least(F.col("y"), side - 1 - F.col("y")) + F.least(F.col("x"), side - 1 - F.col("x")) < margin
    time = F.lit("2025-06-20 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("frame") * 30)
    return px.select("scene", "frame", "y", "x", time.alias("time"), F.when(~space, bt).alias("bt"))


def cube(spark: SparkSession, n_frames: int, side: int, seed: int = 0, n_blobs: int = 4, margin: int = 4) -> DataFrame:
    """frame, y, x, time and bt of every pixel of one scene."""
    return cubes(spark.range(1).select(F.col("id").alias("scene"), F.lit(seed).alias("seed"), F.lit(n_frames).alias("n_frames")), side, n_blobs, margin).drop("scene")


def empty_cube(spark: SparkSession, n_frames: int, n_rows: int, n_cols: int) -> DataFrame:
    i = F.col("id")
    return spark.range(n_frames * n_rows * n_cols).select(
        F.floor(i / (n_rows * n_cols)).cast("int").alias("frame"), F.floor(i / n_cols % n_rows).cast("int").alias("y"), (i % n_cols).cast("int").alias("x"), F.lit(None).cast("double").alias("bt"))
