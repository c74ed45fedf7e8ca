"""Himawari segments: the parser against what was written, and frames with lost, repeated and odd segments."""

from datetime import datetime

import numpy as np
import pytest

from cadenza.plans import sensor_files
from cadenza.sources import folders, himawari, satellite


def write(folder, time, bt, number, of, packed=False, name=""):
    counts = np.round(sensor_files.radiance(bt) / 1e-3).astype(int)
    raw = sensor_files.segment_file(counts, number, of, (number - 1) * len(bt) + 1, sensor_files.mjd(time), 1e-3, 0.0, correction=(0.5, 1.0, 0.0), packed=packed)
    (folder / f"HS_H09_{time:%Y%m%d_%H%M}_B13_FLDK_R20_S{number:02d}{of:02d}{name}.DAT{'.bz2' if packed else ''}").write_bytes(raw)
    return raw


def test_parser(tmp_path):
    bt = np.linspace(190, 310, 24).reshape(4, 6)
    for packed in (False, True):
        s = himawari.parse(write(tmp_path, datetime(2025, 6, 20), bt, 2, 10, packed))
        assert (s.band, s.number, s.of, s.first_line, s.counts.shape) == (13, 2, 10, 5, (4, 6))
        assert np.abs(himawari.temperature(s) - 0.5 - bt).max() < 0.05
    s.counts = s.counts.copy()
    s.counts[0, :2] = 65535, 65534
    assert np.isnan(himawari.temperature(s)[0, :2]).all() and not np.isnan(himawari.temperature(s)[1:]).any()


def test_coordinates_below_the_satellite(tmp_path):
    s = himawari.parse(write(tmp_path, datetime(2025, 6, 20), np.full((5, 5), 250.0), 1, 1))
    lat, lon = himawari.coordinates(s)
    assert abs(lat[2, 2]) < 1e-9 and abs(lon[2, 2] - 140.7) < 1e-9 and lat[0, 2] > 0 > lat[4, 2] and lon[2, 0] < 140.7 < lon[2, 4]
    s.projection = (*s.projection[:3], -1e6, *s.projection[4:])
    assert np.isnan(himawari.coordinates(s)[0]).all()


def test_frames_of_segments(spark, tmp_path):
    draw = np.random.default_rng(1)
    frames = {datetime(2025, 6, 20, h): 200 + 100 * draw.random((20, 7)) for h in range(3)}
    for time, bt in frames.items():
        for n in range(1, 11):
            if (time.hour, n) not in ((1, 1), (1, 7), (2, 10)):
                write(tmp_path, time, bt[2 * n - 2 : 2 * n], n, 10, packed=n % 3 == 0)
    write(tmp_path, datetime(2025, 6, 20), frames[datetime(2025, 6, 20)][:2] + 50, 1, 10, name="_later")  # a segment that is there twice
    satellite.register(spark)
    read = spark.read.format("cadenza_segments").option("path", str(tmp_path))
    whole = himawari.complete(read.load())
    assert whole.count() == 30 and sorted((r["time"].hour, r["segment"], r["first_line"]) for r in whole.filter("path is null").collect()) == [(1, 1, 1), (1, 7, 13), (2, 10, 19)]
    for r in himawari.assemble(whole).collect():
        got, want = np.array([np.nan if v is None else v for v in r["bt"]]).reshape(r["n_rows"], r["n_cols"]), frames[r["time"]].copy()
        for hour, n in ((1, 1), (1, 7), (2, 10)):
            if r["time"].hour == hour:
                want[2 * n - 2 : 2 * n] = np.nan
        assert (np.isnan(got) == np.isnan(want)).all() and np.nanmax(np.abs(got - 0.5 - want)) < 0.1
    # Bounds of time open no other file.
    (tmp_path / "HS_H09_20250621_0000_B13_FLDK_R20_S0110.DAT").write_bytes(b"broken")
    assert read.option("end", "2025-06-20T12:00:00").load().filter("time <= timestamp_ntz'2025-06-20 01:00:00'").select("segment").count() == 19
    with pytest.raises(Exception):
        spark.read.format("cadenza_segments").option("path", str(tmp_path)).load().count()


def test_temporary_files_are_no_segments(spark, tmp_path):
    files, base = folders.store(str(tmp_path))
    folders.put(files, f"{base}/note.txt", b"x")
    satellite.register(spark)
    assert spark.read.format("cadenza_segments").option("path", str(tmp_path)).load().count() == 0


def test_small_segments_share_tasks_and_batches_and_large_ones_do_not(tmp_path, monkeypatch):
    for k in range(40):
        raw = sensor_files.segment_file(np.full((1, 8), 9000 + k), k % 8 + 1, 8, k % 8 + 1, 60000.0, 1e-3, 0.0)
        (tmp_path / f"HS_H09_20250620_{k // 8:02d}00_B13_FLDK_R20_S{k % 8 + 1:02d}08.DAT").write_bytes(raw)
    reader = himawari.SegmentReader({"path": str(tmp_path)})
    (all_files,) = reader.partitions()
    (batch,) = reader.read(all_files)
    assert batch["path"].to_pylist() == [p for p, _, _ in reader.listed()] and batch["segment"].to_pylist() == [*range(1, 9)] * 5
    monkeypatch.setattr(satellite, "PIXELS", 24)
    assert [b.num_rows for b in reader.read(all_files)] == [3] * 13 + [1]
    monkeypatch.setattr(satellite, "BYTES", 1)
    monkeypatch.setattr(satellite, "OPEN", 0)
    assert [len(p.paths) for p in reader.partitions()] == [1] * 40
    monkeypatch.setattr(satellite, "TASKS", 4)
    assert [len(p.paths) for p in reader.partitions()] == [10] * 4
