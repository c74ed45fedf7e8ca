"""HDF5 files made by a writer of its own, read by byte ranges."""

from datetime import datetime

import numpy as np
import pytest

from cadenza.plans import format_queries
from cadenza.plans.sensor_files import Hdf5Writer
from cadenza.sources import hdf5, netcdf, satellite

FRAME = np.arange(37 * 53, dtype=np.int16).reshape(37, 53)


def made(**how):
    w = Hdf5Writer(**how)
    w.add("IMG_TIR1", FRAME[None], {"_FillValue": np.int16(-1), "long_name": "counts", "levels": np.arange(3, dtype="<i4")}, chunks=(1, 8, 16), checksum=True, skip=((0, 8, 16),))
    w.add("IMG_TIR1_TEMP", np.linspace(150, 350, 2000).astype("<f4"), {f"a{k}": float(k) for k in range(12)})
    w.add("big", FRAME.astype(">f8"), chunks=(37, 53), shuffle=False)
    w.add("scalar", np.float64(5.5))
    for k in range(10):
        w.add(f"more{k}", np.arange(k + 1))
    return w.done({"title": "made", "gain": 0.25})


@pytest.mark.parametrize("how", [{}, {"new": True}, {"dense": True}])
def test_round_trip_by_ranges(how):
    raw = made(**how)
    asked = []
    file = hdf5.File(lambda offset, length: asked.append((offset, length)) or raw[offset : offset + length])
    assert set(file.datasets) == {"IMG_TIR1", "IMG_TIR1_TEMP", "big", "scalar", *[f"more{k}" for k in range(10)]} and file.attrs == {"title": "made", "gain": 0.25}
    want = FRAME[None].copy()
    want[0, 8:16, 16:32] = -1  # a chunk that is not stored has the fill value
    d = file.datasets["IMG_TIR1"]
    assert (d.data == want).all() and d.attrs["long_name"] == "counts" and d.attrs["levels"] == [0, 1, 2] and d.attrs["_FillValue"] == -1
    assert (file.datasets["big"].data == FRAME).all() and file.datasets["scalar"].data == 5.5 and file.datasets["more4"].data.tolist() == [0, 1, 2, 3, 4]
    assert file.datasets["IMG_TIR1_TEMP"].attrs["a11"] == 11.0 and np.allclose(file.datasets["IMG_TIR1_TEMP"].rows(10, 20), np.linspace(150, 350, 2000)[10:20])
    asked.clear()
    assert (d.rows(17, 23) == want[:, 17:23]).all()
    assert len([n for _, n in asked if n != hdf5.AHEAD]) == 4  # the chunks of one band


def test_odd_files():
    with pytest.raises(ValueError):
        hdf5.File(lambda offset, length: b"CDF\x01"[offset : offset + length])
    w = Hdf5Writer()
    w.add("a", np.arange(4, dtype="<i4"))
    file = hdf5.File(lambda offset, length, raw=w.done(): raw[offset : offset + length])
    file.datasets["a"].filters = [99]
    assert file.datasets["a"].data.tolist() == [0, 1, 2, 3] and hdf5.is_hdf5(w.done()) and not hdf5.is_hdf5(b"")


@pytest.mark.parametrize("height", [5, 8, 100])
def test_bands_of_either_format_are_the_frame(height):
    bt = 200 + np.random.default_rng(0).random((37, 53)) * 100
    V = netcdf.Variable
    axis = {"lat": V(("lat",), np.linspace(38, 6, 37)), "lon": V(("lon",), np.linspace(68, 98, 53))}
    classic = netcdf.dump(netcdf.Dataset({"time": 1, "lat": 37, "lon": 53}, {**axis, "tbb": V(("time", "lat", "lon"), bt[None])}))
    w = Hdf5Writer(new=True)
    w.add("lat", axis["lat"].data)
    w.add("lon", axis["lon"].data)
    w.add("tbb", bt, chunks=(10, 20))
    for raw in (classic, w.done()):
        whole = satellite.read_frame(raw, "Himawari-9")
        parts = list(satellite.bands(satellite.open_file(lambda offset, length: raw[offset : offset + length]), "Himawari-9", height))
        assert [p[0] for p in parts] == list(range(0, 37, height))
        for k in range(3):
            assert np.allclose(np.concatenate([p[k + 1] for p in parts]), whole[k])
        assert np.allclose(whole[0], bt)


def test_records_by_ranges():
    """Record variables of a classic file, whose slices alternate."""
    import struct

    name = lambda t: struct.pack(">i", len(t)) + t.encode() + b"\0" * (-len(t) % 4)
    head = b"CDF\x01" + struct.pack(">i", 3) + struct.pack(">ii", 10, 3) + name("t") + struct.pack(">i", 0) + name("y") + struct.pack(">i", 2) + name("x") + struct.pack(">i", 2)
    head += struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 2)
    size = len(head) + sum(len(name(n)) + 4 + 4 * d + 8 + 8 + 4 for n, d in (("bt", 3), ("s", 1)))
    head += name("bt") + struct.pack(">iiii", 3, 0, 1, 2) + struct.pack(">ii", 0, 0) + struct.pack(">iii", 5, 16, size)
    head += name("s") + struct.pack(">ii", 1, 0) + struct.pack(">ii", 0, 0) + struct.pack(">iii", 4, 4, size + 16)
    assert len(head) == size
    raw = head + b"".join(np.arange(k * 4, k * 4 + 4).astype(">f4").tobytes() + struct.pack(">i", k) for k in range(3))
    whole, ranged = netcdf.load(raw), netcdf.open_ranges(lambda offset, length: raw[offset : offset + length])
    for n in ("bt", "s"):
        assert (whole.variables[n].data == ranged.variables[n].data).all()
    ranged.variables["bt"].window = (1, 2)
    assert (ranged.variables["bt"].data == whole.variables["bt"].data[:, 1:2]).all()


def test_blocks_of_several_small_files_are_one_batch(tmp_path):
    for k in (1, 2, 4, 5):
        for name, content in format_queries._hdf5(k, datetime(2025, 6, 20, k), np.linspace(200, 300, 64).reshape(8, 8)):
            (tmp_path / name).write_bytes(content)
    reader = satellite.FrameReader({"path": str(tmp_path), "block": "4"})
    (files,) = reader.partitions()
    (batch,) = reader.read(files)
    assert list(zip(batch["by"].to_pylist(), batch["bx"].to_pylist())) == [(0, 0), (0, 1), (1, 0), (1, 1)] * 4
    assert {len(b) for b in batch["bt"].to_pylist()} == {16} and len(set(batch["path"].to_pylist())) == 4
