"""Sinks that show all of a job or nothing."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import blocks
from cadenza.plans import jobs
from cadenza.sources import cube, folders, netcdf, sinks

GRID = blocks.Grid(7, 5, 3)


@pytest.fixture(scope="module")
def frames(spark):
    draw = np.random.default_rng(0)
    rows = [(k, datetime(2025, 6, 20) + timedelta(minutes=30 * k), [None if v < 0.1 else float(np.float32(v)) for v in draw.random(35)]) for k in range(9) if k != 4]
    return spark.createDataFrame(rows, "k long, time timestamp_ntz, bt array<double>").repartition(3).cache()


def values(df):
    return sorted((r["k"], r["time"], r["bt"]) for r in df.select("k", "time", "bt").collect())


def test_cube_of_blocks(spark, frames, tmp_path):
    folder = str(tmp_path / "cube")
    cube.write_cube(blocks.from_frames(frames, ["k", "time"], ["bt"], GRID), folder, GRID, (0, 0, 5, 7), {"source": "made"}, chunk_frames=2)
    info = cube.cube_info(folder)
    assert info["shape"] == [9, 7, 5] and info["chunks"] == [2, 3, 3] and info["attrs"]["source"] == "made"
    # A frame that is missing beside one that is there is all NULL; the others are what was written.
    got = [r for r in values(cube.read_cube(spark, folder)) if r[0] != 4]
    assert got == values(frames) and all(v is None for r in cube.read_cube(spark, folder).filter("k = 4").collect() for v in r["bt"])
    some, grid = cube.read_blocks(spark, folder, 3, 6)
    assert grid == GRID and {r["k"] for r in some.collect()} == {3, 4, 5} and some.count() == 3 * 6
    with pytest.raises(Exception, match="is there"):
        cube.write_cube(blocks.from_frames(frames, ["k", "time"], ["bt"], GRID), folder, GRID, (0, 0, 5, 7))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["cube"]
    cube.write_cube(blocks.from_frames(frames.filter("k < 2"), ["k", "time"], ["bt"], GRID), folder, GRID, (0, 0, 5, 7), overwrite=True)
    assert cube.cube_info(folder)["shape"][0] == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["cube"]


def test_blocks_that_are_missing(spark, frames, tmp_path):
    cut = blocks.from_frames(frames, ["k", "time"], ["bt"], GRID).filter("not (by = 0 and bx = 0)")
    cube.write_cube(cut, str(tmp_path / "cube"), GRID, (0, 0, 5, 7), chunk_frames=16)
    got, _ = cube.read_blocks(spark, str(tmp_path / "cube"))
    assert got.count() == 9 * 5 and got.filter("time is not null").count() == 0


def test_a_failing_task_leaves_nothing_and_a_retry_one(spark, frames, tmp_path):
    folder = str(tmp_path / "cube")
    cut = blocks.from_frames(frames, ["k", "time"], ["bt"], GRID)
    broken = cut.withColumn("bt", F.when((F.col("k") == 8) & (F.col("by") == 2), F.array(F.lit(1.0))).otherwise(F.col("bt")))  # of the wrong size
    with pytest.raises(Exception):
        cube.write_cube(broken, folder, GRID, (0, 0, 5, 7))
    assert list(tmp_path.iterdir()) == []
    cube.write_cube(cut, folder, GRID, (0, 0, 5, 7))
    with pytest.raises(Exception):
        cube.write_cube(broken, folder, GRID, (0, 0, 5, 7), overwrite=True)
    assert [p.name for p in tmp_path.iterdir()] == ["cube"] and [r for r in values(cube.read_cube(spark, folder)) if r[0] != 4] == values(frames)


def test_blocks_at_one_place(spark, frames, tmp_path):
    cut = blocks.from_frames(frames, ["k", "time"], ["bt"], GRID)
    cube.write_cube(cut.union(cut), str(tmp_path / "twice"), GRID, (0, 0, 5, 7))  # alike: the same cube
    other = cut.withColumn("bt", F.transform("bt", lambda v: v + 1))
    with pytest.raises(Exception, match="two different blocks"):
        cube.write_cube(cut.union(other), str(tmp_path / "two"), GRID, (0, 0, 5, 7))
    with pytest.raises(Exception, match="at least one frame"):
        cube.write_cube(cut.limit(0), str(tmp_path / "none"), GRID, (0, 0, 5, 7))
    assert [p.name for p in tmp_path.iterdir()] == ["twice"]


def test_files(spark, tmp_path):
    sinks.register(spark)
    rows = spark.range(50).select(F.format_string("f/%03d.bin", "id").alias("name"), F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "UTF-8").alias("content")).repartition(4)
    save = lambda df, name, mode="append": df.write.format("cadenza_files").option("path", str(tmp_path / name)).mode(mode).save()
    save(rows, "out")
    assert sorted(p.name for p in (tmp_path / "out" / "f").iterdir()) == [f"{k:03d}.bin" for k in range(50)] and (tmp_path / "out" / "f" / "007.bin").read_bytes() == b"x" * 7
    index = [json.loads(line) for p in (tmp_path / "out" / "_index").iterdir() for line in p.read_text().splitlines()]
    assert {(i["name"], i["n_bytes"]) for i in index} == {(f"f/{k:03d}.bin", k) for k in range(50)}
    with pytest.raises(Exception, match="no name"):
        save(rows.union(spark.createDataFrame([("../up", bytearray(b"x"))], "name string, content binary")), "bad")
    with pytest.raises(Exception, match="is there"):
        save(rows, "out")
    save(rows.filter("name < 'f/010'"), "out", "overwrite")
    assert len(list((tmp_path / "out" / "f").iterdir())) == 10 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_missing_files_of_a_scene_are_counted_by_frame(spark, tmp_path):
    frames = [{"kind": kind, "image": f"i/{n}.png", "thumb": f"t/{n}.png", "tiles_url_template": f"x/{n}/{{z}}/{{x}}/{{y}}.png", "netcdf": f"nc/{n}.nc"} for n, kind in enumerate(["observed", "interpolated"])]
    for name in ("i/0.png", "t/0.png", "t/1.png", "x/0/0/0/0.png", "x/0/1/1/0.png", "x/1/1/1/0.png", "nc/1.nc"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    got = jobs.scene_files(spark, str(tmp_path), {"frames": frames}, [(0, 0, 0), (1, 0, 0), (1, 1, 0)]).collect()
    assert sorted(tuple(r) for r in got) == [("interpolated", 0, 1, 1, 1), ("observed", 1, 1, 2, 0)]


def test_densified_files_of_more_frames_than_a_sample_holds(spark, tmp_path):
    # Bounds of ranges come from a sample, here of a row or two a file partition; no frame may lose its place or its neighbour.
    n, box = 300, (68.0, 6.0, 98.0, 38.0)
    attrs = {"source_frames": "[]", "t": 0.0, "model": "none", "model_version": "0", "kind": "observed", "created": "2025-06-20T00:00:00Z"}
    time = F.lit("2025-06-20 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 30).cast("int"))
    frames = spark.range(n).select(F.col("id").alias("k"), time.alias("time"), F.array_repeat(200.0 + F.col("id"), 4).alias("bt"))
    netcdf.write_frames(netcdf.encode_frames(frames, 2, box, attrs), f"{tmp_path}/first").collect()
    spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", 1)
    try:
        jobs.interpolate_files(spark, f"{tmp_path}/first", f"{tmp_path}/second", 2, box, 2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.rangeExchange.sampleSizePerPartition")
    got = netcdf.read_frames(spark, f"{tmp_path}/second").select("path", "bt").collect()
    assert [r["bt"] for r in sorted(got, key=lambda r: r["path"])] == [[200 + f / 2] * 4 for f in range(2 * n - 1)]


def test_the_driver_lists_no_files_and_tasks_read_each_once(spark, tmp_path, monkeypatch):
    box, attrs = (68.0, 6.0, 98.0, 38.0), {"source_frames": "[]", "t": 0.0, "model": "none", "model_version": "0", "kind": "observed", "created": "2025-06-20T00:00:00Z"}
    frames = spark.range(0, 25, 1, 1).select(F.col("id").alias("k"), F.lit("2025").alias("time"), F.array(200.0 + F.col("id"), F.lit(None), F.lit(220.0), F.lit(float("nan"))).alias("bt"))
    encoded = netcdf.encode_frames(frames, 2, box, attrs)
    assert encoded.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # not one task for few bytes
    netcdf.write_frames(encoded, f"{tmp_path}/in").collect()
    for name in ("_part.nc", ".hidden.nc", "notes.txt", "inner/000099.nc", "day=1/000025.nc"):
        (tmp_path / "in" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes((tmp_path / "in" / "000007.nc").read_bytes())
    monkeypatch.setattr(netcdf, "PIXELS", 8, raising=False)
    monkeypatch.setattr(folders, "NAMES", 10, raising=False)
    read = netcdf.read_frames(spark, f"{tmp_path}/in/")
    assert read.inputFiles() == []
    got = {r["path"].removeprefix(f"{tmp_path}/in/"): r for r in read.collect()}
    assert sorted(got) == sorted([*(f"{k:06d}.nc" for k in range(25)), "day=1/000025.nc"])
    assert all(got[f"{k:06d}.nc"]["bt"] == [200.0 + k, None, 220.0, None] for k in range(25)) and got["day=1/000025.nc"]["bt"][0] == 207.0
    assert {(r["variable"], r["n_rows"], r["n_cols"], r["attrs"]["kind"]) for r in got.values()} == {("bt", 2, 2, "observed")}
    one = netcdf.read_frames(spark, f"file://{tmp_path}/in/000003.nc").collect()
    assert [(r["path"], r["bt"][0]) for r in one] == [(f"file://{tmp_path}/in/000003.nc", 203.0)]
    with pytest.raises(FileNotFoundError):
        netcdf.read_frames(spark, f"{tmp_path}/none")
    (tmp_path / "empty").mkdir()
    assert netcdf.read_frames(spark, f"{tmp_path}/empty").count() == 0


def test_a_scene_of_many_frames_passes_no_rows_of_frames_to_the_driver(spark, tmp_path, monkeypatch):
    n, box, collected = 120, (68.0, 6.0, 98.0, 38.0), []
    time = F.lit("2025-06-20 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 30).cast("int"))
    value = F.when(F.col("id") < 60, 200.0 + F.col("id")).otherwise(200.0 + F.col("id") % 7)  # blends without an error have no finite PSNR
    frames = spark.range(0, n, 1, 3).select(F.col("id").alias("k"), F.lit(0).alias("label"), time.alias("time"), F.array_repeat(value, 16).alias("bt"))
    real = type(frames).collect
    monkeypatch.setattr(type(frames), "collect", lambda self: (collected.append(real(self)), collected[-1])[1])
    monkeypatch.setattr(jobs, "GROUP", 32, raising=False)
    jobs.build_scene(spark, frames, f"{tmp_path}/scene", 4, box, "many", tile=2, merge={"model": {"name": "own"}})
    assert max(map(len, collected)) < 10
    assert sum(p.is_dir() for p in (tmp_path / "scene").rglob("*")) < 2 * n - 1 and not list((tmp_path / "scene").rglob("_*"))
    scene = jobs.read_scene(spark, f"{tmp_path}/scene")
    whole = json.loads((tmp_path / "scene" / "manifest.json").read_text())
    places = [(z, x, y) for z in (0, 1) for x in range(1 << z) for y in range(1 << z)]
    assert [f["index"] for f in whole["frames"]] == list(range(2 * n - 1)) and whole["frames"][3]["bracket"] == [2, 4] and whole["frames"][3]["t"] == 0.5
    assert [m["index"] for m in whole["metrics"]["per_frame"]] == list(range(2, 2 * n - 2, 2)) and whole["metrics"]["per_frame"][0] == {"index": 2, "psnr": None, "bt_rmse_k": 0.0}
    assert whole["metrics"]["per_frame"][-1]["psnr"] > 0 and whole["model"]["name"] == scene["model"]["name"] == "own" and scene["metrics"]["summary"] == whole["metrics"]["summary"]
    assert sorted((r.asDict() for r in scene["frames"].toLocalIterator()), key=lambda f: f["index"]) == whole["frames"]
    assert max(map(len, collected)) < 10
    for document in (whole, scene):
        found = jobs.scene_files(spark, f"{tmp_path}/scene", document, places).groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("n_images", "n_thumbs", "n_tiles", "n_netcdf")])
        assert sorted(map(tuple, real(found))) == [("interpolated", n - 1, n - 1, 5 * (n - 1), n - 1), ("observed", n, n, 5 * n, n)]


def test_an_overlay_may_have_its_own_scores_and_a_scene_no_frames(spark, tmp_path):
    frames = spark.range(0).select(F.col("id").alias("k"), F.lit(0).alias("label"), F.lit("2025-06-20").cast("timestamp_ntz").alias("time"), F.array_repeat(F.lit(200.0), 16).alias("bt"))
    for scores in (None, [], [{"index": 1, "psnr": 2.0}]):
        jobs.build_scene(spark, frames, f"{tmp_path}/scene", 4, (68.0, 6.0, 98.0, 38.0), 'a "frames": [] of "per_frame": []', tile=2, merge=None if scores is None else {"metrics": {"per_frame": scores}})
        whole = json.loads((tmp_path / "scene" / "manifest.json").read_text())
        assert whole["frames"] == [] and whole["metrics"]["per_frame"] == (scores or []) and whole["title"] == 'a "frames": [] of "per_frame": []'
        assert jobs.read_scene(spark, f"{tmp_path}/scene")["frames"].count() == 0
