import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.functions import scalar
from cadenza.operators import grid, manifest, metrics, sequence, stats, stencil, synth
from cadenza.sources import images, netcdf
from cadenza.streaming import frames as streaming


def test_metrics_of_a_constant_error(spark):
    truth = [float(v) for v in np.linspace(200, 300, 64)]
    df = spark.createDataFrame([(1, [v + 5 for v in truth], truth), (2, truth, truth), (3, [None] * 64, truth)], "k int, pred array<double>, truth array<double>")
    out = {r["k"]: r for r in metrics.array_metrics(df, ["k"]).collect()}
    assert out[1]["bt_bias_k"] == pytest.approx(5) and out[1]["bt_rmse_k"] == pytest.approx(5)
    assert out[2]["psnr"] == math.inf and out[3]["psnr"] is None and out[3]["n_valid"] == 0


def test_windowed_metrics():
    draw = np.random.default_rng(0)
    a = draw.random((48, 48))
    assert metrics.ssim(a, a) == pytest.approx(1) and metrics.ms_ssim(a, a) == pytest.approx(1) and metrics.gmsd(a, a) == pytest.approx(0) and metrics.fsim(a, a) == pytest.approx(1)
    b = np.clip(a + draw.normal(0, 0.2, a.shape), 0, 1)
    assert metrics.ssim(a, b) < 0.95 and metrics.fsim(a, b) < 1 and metrics.psd_ratio(a, a) == pytest.approx(1)
    assert math.isnan(metrics.ms_ssim(a[:3, :3], a[:3, :3]))


def test_splits():
    parts = sequence.interior_split(12, 0.7, 0.15)
    assert parts == {"train": (1, 8), "val": (8, 10), "test": (10, 11)}
    assert sequence.time_split(10, 0.6, 0.2) == {"train": (0, 6), "val": (6, 8), "test": (8, 10)}
    assert sequence.time_split(0, 0.6, 0.2)["train"] == (0, 0)
    assert sequence.subdivisions(3) == 4 and sequence.recursion_levels(8) == 3
    with pytest.raises(ValueError):
        sequence.recursion_levels(3)


def test_ordinals(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    assert all(r["v"] == r["ordinal"] for r in sequence.ordinals(df, ["v"]).collect())
    clash = df.withColumns({c: F.lit(1) for c in ("id", "part", "row", "before", "n", "__id", "a.b")})
    out = sequence.ordinals(clash, ["v"], "place")
    assert out.columns == [*clash.columns, "place"] and all(r["v"] == r["place"] for r in out.collect())
    sums = sequence.prefix_sums(df, ["v"], F.col("v"), "sum").collect()
    assert all(r["sum"] == r["v"] * (r["v"] - 1) // 2 for r in sums)


def test_ordinals_of_more_rows_than_a_sample_holds(spark):
    # Bounds of ranges come from a sample of about a hundred rows a partition.
    df = spark.range(60_000).repartition(16).select(((F.col("id") * 7919) % 60_000).alias("v"), F.col("id").cast("string").alias("more"))
    assert sequence.ordinals(df, ["v"]).filter("v <> ordinal").count() == 0
    assert sequence.prefix_sums(df, ["v"], F.col("v"), "sum").filter("sum <> v * (v - 1) / 2").count() == 0


def test_nearest_across_the_date_line(spark):
    source = spark.createDataFrame([(1, 0.0, 179.9), (2, 0.0, -179.7), (3, 60.0, -179.95), (4, -89.9, 10.0)], "s_id long, lat double, lon double")
    target = spark.createDataFrame([(10, 0.05, -179.95), (11, 0.0, 179.6), (12, 60.0, 179.9), (13, -89.9, -170.0), (14, 0.0, 0.0)], "t_id long, lat double, lon double")
    got = {r["t_id"]: r["s_id"] for r in grid.nearest_mapping(target, source).collect()}
    assert got == {10: 1, 11: 1, 12: 3, 13: 4}


def test_references_come_from_the_header():
    # Two variables with equal bytes, and a header that holds the same run of bytes.
    zero = netcdf.Variable(("x",), np.zeros(4, np.float64))
    raw = netcdf.dump(netcdf.Dataset({"x": 4}, {"a": zero, "b": netcdf.Variable(("x",), np.zeros(4, np.float64)), "c": netcdf.Variable(("x",), np.arange(4.0))}))
    refs = netcdf.virtual_reference(raw, "f")
    assert [r[1] for r in refs] == ["a", "b", "c"] and refs[1][2] == refs[0][2] + 32 and refs[2][2] == refs[1][2] + 32
    assert np.frombuffer(raw, ">f8", 4, refs[2][2]).tolist() == [0, 1, 2, 3]


def test_flow_finds_a_shift():
    y, x = np.indices((32, 32))
    a = np.exp(-((x - 14) ** 2 + (y - 16) ** 2) / 40) * 50
    b = np.exp(-((x - 15) ** 2 + (y - 16) ** 2) / 40) * 50
    u, v, half = (f[1] for f in stencil.flow_blend(np.stack([b, a]), np.stack([a, b]), 0.5, "block"))
    assert u[14:18, 11:18].mean() == pytest.approx(1, abs=0.3) and abs(v[14:18, 11:18].mean()) < 0.2
    truth = np.exp(-((x - 14.5) ** 2 + (y - 16) ** 2) / 40) * 50
    assert np.abs(half - truth).mean() < np.abs(a - truth).mean()


def test_statistics(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(10)], "x double, y double")
    assert stats.spearman(df, "x", "y").first()["spearman"] == pytest.approx(1)
    long = df.select(F.lit("m").alias("metric"), F.col("x").alias("value"))
    r = stats.bootstrap(long, "metric", 100).first()
    assert r["low"] < r["mean"] < r["high"]
    # The spread of the resampled means is that of the mean: four standard errors hold the interval.
    wide = stats.bootstrap(spark.range(4000).select(F.lit("m").alias("metric"), (F.col("id") % 100).cast("double").alias("value"), "id").repartition(3), "metric", 500).first()
    assert wide["high"] - wide["low"] == pytest.approx(4 * 28.87 / 4000**0.5, rel=0.2)


def test_patches_and_zoom():
    assert grid.origins(8, 3, 3, False) == [0, 3, 5] and grid.origins(2, 3, 3) == []
    assert grid.default_max_zoom(2048, 100) == 3 and grid.default_max_zoom(100, 100) == 0
    with pytest.raises(ValueError):
        grid.origins(8, 0, 1)


def test_netcdf_round_trip(spark, tmp_path):
    bt = np.linspace(200, 300, 64).reshape(8, 8)
    bt[0, 0] = np.nan
    attrs = {"source_frames": ["a", "b"], "t": 0.5, "model": "linear", "model_version": "1", "kind": "interpolated", "created": "now", "flag": True, "none": None}
    ds = netcdf.load(netcdf.dump(netcdf.frame_dataset(bt, np.arange(8.0), np.arange(8.0), "2025", attrs)))
    assert ds.attrs["source_frames"] == '["a", "b"]' and ds.attrs["flag"] == 1 and ds.attrs["none"] == "null" and ds.attrs["t"] == 0.5
    np.testing.assert_allclose(ds.variables["bt"].data, bt.astype(np.float32))
    with pytest.raises(ValueError):
        netcdf.frame_dataset(bt, np.arange(8.0), np.arange(8.0), "2025", {})
    frames = spark.createDataFrame([(k, "2025", [None if np.isnan(v) else float(v) for v in bt.ravel()]) for k in range(3)], "k long, time string, bt array<double>")
    written = netcdf.write_frames(netcdf.encode_frames(frames, 8, (68.0, 6.0, 98.0, 38.0), attrs), str(tmp_path / "nc"))
    assert written.count() == 3
    back = netcdf.read_frames(spark, str(tmp_path / "nc")).collect()
    assert len(back) == 3 and back[0]["bt"][0] is None and back[0]["bt"][1] == pytest.approx(bt[0, 1], rel=1e-6) and back[0]["attrs"]["model"] == "linear"


def test_images_and_shards(spark):
    raw = images.png(np.zeros((4, 4, 4), np.uint8))
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and images.read_tar(images.tar_shard([("b", {"x": b"1"}), ("a", {"x": b"2"})])) == [("a", {"x": b"2"}), ("b", {"x": b"1"})]
    out = images.write_shards(spark.createDataFrame([(n, f"{n:04d}", bytearray([n])) for n in range(10)], "n long, key string, body binary"), 4).collect()
    assert sorted(r["n"] for r in out) == [2, 4, 4]


def test_manifest_stops_the_invalid(spark):
    bad = spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {t}) AS {c}" for c, t in [(f.name, f.dataType.simpleString()) for f in spark.createDataFrame([], manifest.MANIFEST_TYPE).schema]))
    assert "missing bbox" in bad.select(manifest.problems().alias("p")).first()["p"]
    with pytest.raises(Exception, match="missing bbox"):
        manifest.require_valid(bad).collect()


def test_synthetic_cube(spark):
    cube = synth.cube(spark, 3, 16)
    r = cube.agg(F.min("bt").alias("a"), F.max("bt").alias("b"), F.count("bt").alias("n"), F.count("*").alias("c")).first()
    assert 181 <= r["a"] < r["b"] <= 319 and r["n"] == r["c"] - 3 * 40
    assert synth.empty_cube(spark, 2, 3, 4).filter("bt is null").count() == 24


def test_scalar_guards(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert [r[0] for r in df.select(scalar.finite(F.col("x"))).collect()] == [False, False, False, True]
    with pytest.raises(ValueError):
        scalar.linear_blend(F.col("x"), F.col("x"), 0.5, "other")
    assert scalar.shard_length(8, 32, 100) == 32 and scalar.shard_length(8, 8, 100) is None


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", F.col("value").alias("bt"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming.tumbling(stream, "30 minutes", []).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    own = {(r["start"], r["n"]) for r in spark.table("windows").collect()}
    assert own == {(r["start"], r["n"]) for r in streaming.tumbling(events, "30 minutes", []).collect()}


def test_stateful_pairing(spark, tmp_path):
    rows = pd.DataFrame({"scene": ["a"] * 3 + ["b"], "ts": pd.to_datetime(["2025-01-01 00:00", "2025-01-01 00:30", "2025-01-01 01:00", "2025-01-01 00:00"]), "bt": [200.0, 210.0, 230.0, 250.0]})
    df = spark.createDataFrame(rows, "scene string, ts timestamp, bt double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streaming.pair_frames(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("paired").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.table("paired").toPandas()
    assert sorted(out[out.kind == "interpolated"].bt) == [205.0, 220.0] and len(out) == 6


def test_points_at_one_place_are_looked_up_once(spark):
    # Pairs of all of them would be 1.6 billion, in one task.
    source = spark.range(40_000).select((F.col("id") + 7).alias("s_id"), F.lit(10.0).alias("lat"), F.lit(80.0).alias("lon"))
    target = spark.range(40_000).select(F.col("id").alias("t_id"), F.lit(10.1).alias("lat"), F.when(F.col("id") % 2 == 0, 80.0).otherwise(90.0).alias("lon"))
    began = time.monotonic()
    got = grid.nearest_mapping(target, source).groupBy("s_id").agg(F.count("*").alias("n"), F.count_if(F.col("t_id") % 2 == 0).alias("even")).collect()
    assert [tuple(r) for r in got] == [(7, 20_000, 20_000)] and time.monotonic() - began < 60
