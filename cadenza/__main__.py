"""Command line: python -m cadenza <command>, on the session that spark-submit or the environment gives.

synth writes a synthetic cube as files, ingest makes a Zarr cube of files, interpolate densifies files, validate runs methods
on a cube and writes their values, report writes a report with document and plots, precompute builds a scene, demo does all of
these in one folder."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import crossval, sequence, synth
from cadenza.plans import jobs
from cadenza.sources import cube, netcdf

BBOX = (68.0, 6.0, 98.0, 38.0)
_ATTRS = {"source_frames": "[]", "t": 0.0, "model": "none", "model_version": "0", "kind": "observed"}


def _all(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def synth_files(spark: SparkSession, target: str, frames: int, side: int) -> None:
    """A synthetic sequence as NetCDF files."""
    pixels = synth.cube(spark, n_frames=frames, side=side, seed=0).select(F.col("frame").alias("k"), (F.col("y") * side + F.col("x")).alias("i"), "bt")
    rows = pixels.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("bt", F.lit(float("nan"))).alias("bt")))), lambda p: F.when(~F.isnan(p["bt"]), p["bt"])).alias("bt"))
    timed = rows.withColumn("time", F.lit("2025-06-20 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("k") * 30).cast("int"))).withColumn("k", F.col("k").cast("long"))
    _all(netcdf.write_frames(netcdf.encode_frames(timed, side, BBOX, {**_ATTRS, "created": jobs.now_iso_z()}), target))


def ingest(spark: SparkSession, source: str, target: str, side: int) -> None:
    read = netcdf.read_frames(spark, source).select(F.try_to_timestamp(F.col("attrs")["time"]).cast("timestamp_ntz").alias("time"), "path", "bt")
    _all(cube.build_cube(sequence.ordinals(read, ["time", "path"], "k").select("k", "time", "bt"), target, side, side, BBOX))


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cadenza", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["synth", "ingest", "interpolate", "validate", "report", "precompute", "demo"])
    parser.add_argument("source", nargs="?", help="folder that is read")
    parser.add_argument("target", help="folder that is written")
    parser.add_argument("--frames", type=int, default=9)
    parser.add_argument("--side", type=int, default=48)
    parser.add_argument("--factor", type=int, default=2)
    parser.add_argument("--methods", nargs="*", default=["M1", "M18", "M19", "M38"])
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("cadenza").getOrCreate()
    frames = lambda folder: cube.read_cube(spark, folder).withColumn("label", F.lit(0))
    if a.command in ("ingest", "interpolate", "validate", "report", "precompute") and not a.source:
        parser.error(f"{a.command} needs a source folder")
    if a.command == "synth":
        synth_files(spark, a.target, a.frames, a.side)
    elif a.command == "ingest":
        ingest(spark, a.source, a.target, a.side)
    elif a.command == "interpolate":
        _all(jobs.interpolate_files(spark, a.source, a.target, a.side, BBOX, a.factor))
    elif a.command == "validate":
        jobs.make_report(frames(a.source), a.target, a.methods, a.side)
    elif a.command == "report":
        jobs.full_report(frames(a.source), a.target, [m for m in a.methods if m in crossval.runners(a.side)], a.side)
    elif a.command == "precompute":
        jobs.build_scene(spark, frames(a.source), a.target, a.side, BBOX, "scene", a.factor, tile=max(4, a.side // 4), methods=[m for m in a.methods if m in crossval.runners(a.side)])
    else:
        synth_files(spark, f"{a.target}/files", a.frames, a.side)
        ingest(spark, f"{a.target}/files", f"{a.target}/cube", a.side)
        known = [m for m in a.methods if m in crossval.runners(a.side)]
        jobs.make_report(frames(f"{a.target}/cube"), f"{a.target}/report", known, a.side)
        jobs.full_report(frames(f"{a.target}/cube"), f"{a.target}/results", known, a.side)
        jobs.build_scene(spark, frames(f"{a.target}/cube"), f"{a.target}/scene", a.side, BBOX, "demo", a.factor, tile=max(4, a.side // 4), methods=known)


if __name__ == "__main__":
    main()
