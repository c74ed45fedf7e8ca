"""Files as one virtual cube, nearest frames in time, and quantiles by prefix counts."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import sensors, stats
from cadenza.sources import cube, netcdf, references

ATTRS = {"source_frames": "[]", "t": 0.0, "model": "none", "model_version": "0", "kind": "observed", "created": "2025-06-20T00:00:00Z"}
START = datetime(2025, 6, 20)


@pytest.fixture(scope="module")
def frames(spark):
    draw = np.random.default_rng(2)
    rows = [(k, START + timedelta(minutes=10 * k), [None if v < 0.1 else float(np.float32(200 + 100 * v)) for v in draw.random(16)]) for k in range(12)]
    return spark.createDataFrame(rows, "k long, time timestamp_ntz, bt array<double>")


def test_combined_files_are_the_cube(spark, frames, tmp_path):
    bbox = (0.0, 0.0, 4.0, 4.0)
    files = netcdf.write_frames(netcdf.encode_frames(frames, 4, bbox, ATTRS), str(tmp_path / "files")).cache()
    header = references.combine(spark, files.select("path"), str(tmp_path / "one"))
    assert header["shape"] == [12, 4, 4] and references.coordinates(header)[0].tolist() == [3.5, 2.5, 1.5, 0.5]
    cube.build_cube(frames, str(tmp_path / "cube"), 4, 4, bbox)
    read = lambda df: sorted((r["k"], r["time"], r["bt"]) for r in df.collect())
    assert read(references.open_combined(spark, str(tmp_path / "one"))) == read(cube.read_cube(spark, str(tmp_path / "cube")))
    assert [r[0] for r in read(references.open_combined(spark, str(tmp_path / "one"), 3, 5))] == [3, 4]
    odd = netcdf.write_frames(netcdf.encode_frames(frames.limit(1).withColumn("bt", F.slice("bt", 1, 9)), 3, bbox, ATTRS), str(tmp_path / "odd"))
    with pytest.raises(ValueError, match="odd.*n_rows"):
        references.combine(spark, files.select("path").union(odd.select("path")), str(tmp_path / "two"))
    with pytest.raises(ValueError, match="no files"):
        references.combine(spark, files.select("path").limit(0), str(tmp_path / "none"))


def test_nearest_in_time_keeps_all_rows(spark):
    at = lambda *seconds: [START + timedelta(seconds=s) for s in seconds]
    a = spark.createDataFrame([(1, t, [1.0]) for t in at(0, 0, 100, 1000)] + [(2, None, [1.0])], "n int, time timestamp_ntz, bt array<double>")
    b = spark.createDataFrame([(t, [float(k)]) for k, t in enumerate(at(-60, 60, 130, 130, 5000))], "time timestamp_ntz, bt array<double>")
    got = sorted((int((r["time"] - START).total_seconds()), int((r["time_b"] - START).total_seconds()), r["bt_b"], r["gap_s"]) for r in sensors.nearest_in_time(a, b, 300).collect())
    # Two rows alike stay two; a tie goes to the earlier, of two at one time the least row is met.
    assert got == [(0, -60, [0.0], 60), (0, -60, [0.0], 60), (100, 130, [2.0], 30)]
    keyed = sensors.nearest_in_time(a.withColumn("s", F.lit("x")), b.withColumn("s", F.lit("y")), 300, ["s"])
    assert keyed.count() == 0 and sensors.nearest_in_time(a.limit(0), b, 300).count() == 0


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_quantiles(spark, keys):
    draw = np.random.default_rng(1)
    rows = [(int(g), None if v < 0.02 else float(round(v, 2))) for g, v in zip(draw.integers(0, 3, 500), draw.random(500))] + [(7, 1.5), (8, None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {tuple(r[k] for k in keys): (r["low"], r["mid"], r["high"]) for r in stats.quantiles(df, "v", {"low": 0.05, "mid": 0.5, "high": 1.0}, keys).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault((g,) if keys else (), []).append(v)
    assert set(got) == set(groups) and all(got[k] == pytest.approx(np.quantile(groups[k], [0.05, 0.5, 1.0])) for k in groups)
