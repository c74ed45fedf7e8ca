"""The driver's tables seen as frames, pixels and series. Missing values are NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of a frame: an embedding of 64 values is one of 8 by 8 pixels.
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str, masked: bool = False) -> DataFrame:
    """k, label, time and bt (array of double, row by row); masked frames lack their corners."""
    raw = table(spark, sf_dir, "embeddings")
    bt = F.transform("embedding", lambda e, i: 250.0 + 60.0 * e.cast("double"))
    if masked:
        bt = F.transform(bt, lambda v, i: F.when(~corner(F.floor(i / SIDE), i % SIDE, 2), v))
    start = F.lit("2025-06-20 00:00:00").cast("timestamp_ntz")
    time = start + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("vec_id") * 30).cast("int"))
    return raw.select(F.col("vec_id").alias("k"), "label", time.alias("time"), bt.alias("bt"))


def corner(y, x, margin: int):
    """Triangles of off-disk pixels in the corners."""
    return F.least(y, SIDE - 1 - y) + F.least(x, SIDE - 1 - x) < margin


def pixels(framed: DataFrame, *values: str) -> DataFrame:
    """One row a pixel: the other columns, y, x and the values of the array columns."""
    others = [c for c in framed.columns if c not in values]
    zipped = F.posexplode(F.arrays_zip(*[F.col(v) for v in values])).alias("i", "p")
    return framed.select(*others, zipped).select(
        *others, F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).cast("int").alias("x"), *[F.col(f"p.{v}").alias(v) for v in values]
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, ts and bt between 180 and 320 from the events."""
    bt = 180.0 + 140.0 * F.least(F.col("value"), F.lit(350.0)) / 350.0
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", bt.alias("bt"), "event_type")


#: Gain, offset and noise of further sensors that see the same frames, and how many minutes later.
SENSORS = {"b": (1.01, -2.0, 31, 17, 21, 4), "c": (0.99, 1.0, 13, 29, 15, 2)}


def sensor(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The frames as another sensor sees them: an affine function of bt with noise from the frame's and the pixel's number."""
    gain, offset, p, q, m, late = SENSORS[name]
    noise = lambda i: (((F.col("k") * p + i * q) % m) - m // 2) / 10.0
    seen = F.transform("bt", lambda v, i: F.lit(gain) * v + offset + noise(i))
    return frames(spark, sf_dir).select("k", "label", (F.col("time") + F.make_dt_interval(mins=F.lit(late))).alias("time"), seen.alias("bt"))
