"""Queries without SQL against plain numpy over the same frames, and the formats of files against known values."""

import math
import subprocess
import sys

import numpy as np
import pytest

from cadenza.operators import losses, metrics, stencil
from cadenza.plans.queries import QUERIES
from cadenza.plans.sensor_queries import brute_gaussian
from cadenza.sources import cube, netcdf, satellite, tiles, views


@pytest.fixture(scope="module")
def frames(spark, sf_dir):
    return {r["k"]: np.array(r["bt"]).reshape(8, 8) for r in views.frames(spark, sf_dir).collect()}


@pytest.fixture(scope="module")
def masked(frames):
    y, x = np.indices((8, 8))
    corner = np.minimum(y, 7 - y) + np.minimum(x, 7 - x) < 2
    return {k: np.where(corner, np.nan, f) for k, f in frames.items()}


@pytest.fixture(scope="module")
def middles(frames):
    return {k: (0.5 * frames[k - 1] + 0.5 * frames[k + 1], frames[k]) for k in frames if k - 1 in frames and k + 1 in frames}


def unit(x):
    return np.clip((x - 180) / 140, 0, 1)


def rmse(a, b):
    return math.sqrt(np.nanmean((a - b) ** 2))


def values(spark, sf_dir, name):
    return {r["metric"]: r["value"] for r in QUERIES[name].run(spark, sf_dir).collect()}


def slow_flow(a, b, n_iter=60):
    """Horn and Schunck's iteration pixel by pixel."""
    h, w = a.shape
    u, v = np.zeros((h, w)), np.zeros((h, w))
    ix = np.array([[a[y, x + 1] - a[y, x] if x + 1 < w else 0 for x in range(w)] for y in range(h)])
    iy = np.array([[a[y + 1, x] - a[y, x] if y + 1 < h else 0 for x in range(w)] for y in range(h)])
    around = lambda f, y, x: sum(f[p, q] for p, q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= p < h and 0 <= q < w) / 4
    for _ in range(n_iter):
        nu, nv = np.zeros((h, w)), np.zeros((h, w))
        for y in range(h):
            for x in range(w):
                mu, mv = around(u, y, x), around(v, y, x)
                share = (ix[y, x] * mu + iy[y, x] * mv + b[y, x] - a[y, x]) / (1 + ix[y, x] ** 2 + iy[y, x] ** 2)
                nu[y, x], nv[y, x] = mu - ix[y, x] * share, mv - iy[y, x] * share
        u, v = nu, nv
    return u, v


def test_flow_of_a_stack_is_that_of_each_frame(frames):
    a, b = (np.stack([frames[k] for k in ks]) for ks in ((0, 5, 9), (1, 6, 10)))
    u, v = stencil.horn_schunck(a, b)
    for n in range(3):
        p, q = slow_flow(a[n], b[n])
        assert np.allclose(u[n], p) and np.allclose(v[n], q)


def test_blocks_give_the_flow_of_whole_frames(spark, sf_dir, frames):
    keys = [k for k in sorted(frames) if k + 1 in frames]
    u, v = stencil.horn_schunck(np.stack([frames[k] for k in keys]), np.stack([frames[k + 1] for k in keys]), 20)
    own = {(r["k"], r["i"]): (r["u"], r["v"]) for r in QUERIES["blk_flow"].run(spark, sf_dir).collect()}
    assert len(own) == 64 * len(keys)
    assert all(own[k, i] == pytest.approx((u[n].flat[i], v[n].flat[i]), abs=2e-6) for n, k in enumerate(keys) for i in range(64))


def test_flow_queries(spark, sf_dir, frames, middles):
    keys = sorted(middles)
    before, after = (np.stack([frames[k + d] for k in keys]) for d in (-1, 1))
    u, v, pred = stencil.flow_blend(before, after, 0.5)
    speed = np.hypot(u, v).mean(axis=(1, 2))
    truth = np.stack([frames[k] for k in keys])
    linear = np.array([rmse(*middles[k]) for k in keys])
    own = values(spark, sf_dir, "m20_flow")
    assert own["base_rmse"] == pytest.approx(np.mean([rmse(p, t) for p, t in zip(pred, truth)]), abs=1e-5)
    for name, solver in (("m20_block_flow", "block"), ("m20_polynomial", "polynomial"), ("m20_total_variation", "total_variation")):
        blend = stencil.flow_blend(before, after, 0.5, solver)[2]
        assert values(spark, sf_dir, name)["base_rmse"] == pytest.approx(np.mean([rmse(p, t) for p, t in zip(blend, truth)]), abs=1e-5)
    own, cut = values(spark, sf_dir, "m26_extreme_motion"), np.median(speed)
    assert own["fast"] == pytest.approx(linear[speed >= cut].mean(), abs=1e-5) and own["slow"] == pytest.approx(linear[speed < cut].mean(), abs=1e-5)
    assert values(spark, sf_dir, "m31_speed")["pearson"] == pytest.approx(np.corrcoef(speed, linear)[0, 1], abs=1e-5)


def test_motion_of_two_sensors(spark, sf_dir, frames):
    i = np.arange(64).reshape(8, 8)
    other = {k: 1.01 * f - 2 + ((k * 31 + i * 17) % 21 - 10) / 10 for k, f in frames.items()}
    keys = [k for k in sorted(frames) if k + 1 in frames][:20]
    (u, v), (p, q) = (stencil.horn_schunck(np.stack([f[k] for k in keys]), np.stack([f[k + 1] for k in keys])) for f in (frames, other))
    want = dict(zip(keys, np.hypot(u - p, v - q).mean(axis=(1, 2))))
    own = {r["k"]: r["epe"] for r in QUERIES["m10_motion"].run(spark, sf_dir).collect()}
    assert len(own) == len(frames) - 1 and all(own[k] == pytest.approx(x, abs=1e-5) for k, x in want.items())


def test_windowed_queries(spark, sf_dir, masked, middles):
    own = {r["k"]: r for r in QUERIES["img_windowed"].run(spark, sf_dir).collect()}
    taps = metrics.gaussian_taps(7)
    for k in sorted(own)[:12]:
        gone = np.isnan(masked[k - 1]) | np.isnan(masked[k]) | np.isnan(masked[k + 1])
        a, b = (np.where(gone, 0.5, unit(x)) for x in (0.5 * masked[k - 1] + 0.5 * masked[k + 1], masked[k]))
        w = np.outer(taps, taps)
        found = []
        for y in range(2):
            for x in range(2):
                p, q = a[y : y + 7, x : x + 7], b[y : y + 7, x : x + 7]
                mp, mq = (w * p).sum(), (w * q).sum()
                vp, vq, c = (w * p * p).sum() - mp**2, (w * q * q).sum() - mq**2, (w * p * q).sum() - mp * mq
                found.append((2 * mp * mq + 1e-4) / (mp**2 + mq**2 + 1e-4) * (2 * c + 9e-4) / (vp + vq + 9e-4))
        assert own[k]["ssim"] == pytest.approx(np.mean(found), abs=1e-5)
        p, q = np.pad(a, 1, mode="edge"), np.pad(b, 1, mode="edge")
        grad = lambda f: np.array([[math.hypot(f[y : y + 3, x + 2].mean() - f[y : y + 3, x].mean(), f[y + 2, x : x + 3].mean() - f[y, x : x + 3].mean()) for x in range(8)] for y in range(8)])
        ga, gb = grad(p), grad(q)
        assert own[k]["gmsd"] == pytest.approx(((2 * ga * gb + 0.0026) / (ga**2 + gb**2 + 0.0026)).std(), abs=1e-5)
        radius = np.hypot(*(np.indices((8, 8)) - 4)).astype(int)
        power = [np.abs(np.fft.fftshift(np.fft.fft2(f - f.mean()))) ** 2 for f in (a, b)]
        rings = [(power[0][radius == r].mean(), power[1][radius == r].mean()) for r in range(3, radius.max() + 1)]
        assert own[k]["psd_ratio"] == pytest.approx(np.mean([x / y for x, y in rings if y > 1e-12]), rel=1e-4)
    # Similarity over scales and features: one of a frame with itself, less of another.
    assert all(0 <= r["ms_ssim"] <= 1 and 0 <= r["fsim"] <= 1 for r in own.values())


def test_means_of_windowed_metrics(spark, sf_dir, frames, middles):
    keys = sorted(middles)
    a, b = (unit(np.stack([middles[k][n] for k in keys])) for n in (0, 1))
    ratio = metrics.psd_ratio(a, b)
    assert values(spark, sf_dir, "m33_spectra")["psd_ratio"] == pytest.approx(np.nanmean(ratio), rel=1e-5)
    rank = lambda x: np.argsort(np.argsort(x))
    psnr = -10 * np.log10(((a - b) ** 2).mean(axis=(1, 2)))
    assert values(spark, sf_dir, "m36_agreement")["spearman"] == pytest.approx(np.corrcoef(rank(psnr), rank(metrics.ssim(a, b)))[0, 1], abs=1e-5)


def test_combined_loss(spark, sf_dir, middles):
    own = {r["k"]: r for r in QUERIES["los_combined"].run(spark, sf_dir).collect()}
    for k in sorted(own)[:10]:
        a, b = (unit(x)[None] for x in middles[k])
        r = own[k]
        assert r["ms_ssim"] == pytest.approx(1 - float(metrics.ms_ssim(a, b, most=7)[0]), abs=1e-5)
        assert r["total"] == pytest.approx(r["charbonnier"] + 0.5 * r["census"] + 0.25 * r["ms_ssim"] + 0.1 * r["gradient"], abs=1e-5)
    assert losses.WEIGHTS["distillation"] == 0.01


def test_gaussian_window(spark, sf_dir, frames):
    own = {(r["k"], r["i"]): r["value"] for r in QUERIES["stn_gaussian"].run(spark, sf_dir).collect()}
    for k in sorted(frames)[:10]:
        assert [own[k, i] for i in range(4)] == pytest.approx(brute_gaussian(frames[k]).ravel().tolist(), abs=1e-5)


def test_crops(spark, sf_dir, masked):
    rows = QUERIES["smp_crops"].run(spark, sf_dir).collect()
    assert len(rows) == len(masked)
    for r in rows:
        crop = masked[r["k"]][r["y0"] : r["y0"] + 4, r["x0"] : r["x0"] + 4]
        assert crop.shape == (4, 4) and r["n"] == 16 and (np.isfinite(crop).mean() >= 0.9 or r["attempt"] == 7)


def slow_scene(seed, n_frames, side=48):
    """Means of the frames of a synthetic scene, cloud by cloud in numpy."""
    from cadenza.operators import synth

    y, x = np.mgrid[0:side, 0:side]
    u, v, out = x / (side - 1), y / (side - 1), []
    space = np.minimum(y, side - 1 - y) + np.minimum(x, side - 1 - x) < 4
    for frame in range(n_frames):
        t, total = frame / max(1.0, n_frames - 1.0), 0.0
        for b in synth.blobs(4, seed):
            dx = u - (b["x0"] + b["vx"] * t + b["ax"] * t * t + b["wiggle"] * np.sin(2 * np.pi * t + b["phase"]))
            dy = v - (b["y0"] + b["vy"] * t + b["ay"] * t * t)
            c, s = np.cos(b["turn"]), np.sin(b["turn"])
            p, q = (c * dx + s * dy) / b["long"], (c * dy - s * dx) / b["short"]
            total = total + np.exp(12 * b["depth"] * np.exp(-0.5 * (p * p + q * q)) * np.exp(-(((t - b["birth"]) / b["life"]) ** 2)))
        cool = np.maximum(0, (np.log(total) - np.log(4)) / 12) * 93
        cool = np.where(cool > 0.85 * 93, 0.85 * 93 + 0.15 * 93 * np.tanh((cool - 0.85 * 93) / (0.15 * 93)), cool)
        out.append(np.clip(298 - 10 * v + 1.5 * np.sin(2 * np.pi * (u + 0.3 * t)) - cool, 181, 319)[~space].mean())
    return out


def test_generated_cube(spark, sf_dir):
    rows = QUERIES["gen_cube"].run(spark, sf_dir).collect()
    assert len(rows) == sum(3 + n % 7 for n in range(25)) and all(r["cells"] == 48 * 48 and r["cells"] - r["n"] == 40 for r in rows)
    own = {(r["scene"], r["frame"]): r["mean"] for r in rows}
    for seed in (0, 11, 24):
        for frame, mean in enumerate(slow_scene(seed, 3 + seed % 7)):
            assert own[seed, frame] == pytest.approx(mean, abs=1e-3)


def test_images_decode(spark, sf_dir, masked):
    import hashlib

    from cadenza.sources import images

    rgba = np.random.default_rng(0).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    assert (tiles.read_png(images.png(rgba)) == rgba).all()
    own = {r["k"]: r for r in QUERIES["snk_png"].run(spark, sf_dir).collect()}
    colors = {}
    for r in QUERIES["viz_rgba"].run(spark, sf_dir).collect():
        colors.setdefault(r["k"], np.zeros((64, 4), np.uint8))[r["i"]] = (r["r"], r["g"], r["b"], r["a"])
    for k, c in colors.items():
        assert own[k]["sha256"] == hashlib.sha256(images.png(c.reshape(8, 8, 4))).hexdigest()


def test_tile_places_follow_the_curve():
    assert [tiles.tile_id(*t) for t in ((0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0), (12, 3423, 1763))] == [0, 1, 2, 3, 4, 5, 19078479]
    for z in (3, 5):
        every = {tiles.tile_id(z, x, y): (x, y) for x in range(1 << z) for y in range(1 << z)}
        walk = [every[i] for i in sorted(every)]
        assert sorted(every) == list(range((4**z - 1) // 3, (4 ** (z + 1) - 1) // 3)) and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(walk, walk[1:]))


def test_archive_stores_equal_tiles_once():
    body = [(2, x, y, b"same" if x < 2 else f"{x}{y}".encode()) for x in range(4) for y in range(4)] + [(0, 0, 0, b"top")]
    head, found = tiles.read_archive(tiles.archive(body, (-1.5, -2.0, 3.25, 4.0), {}))
    assert head["n_tiles"] == 17 and head["n_bodies"] == 10 and head["west_e7"] == -15000000 and head["center_lon_e7"] == 8750000
    assert {i: b for i, b in found.items()} == {tiles.tile_id(z, x, y): b for z, x, y, b in body}


def test_cube_edges(spark, tmp_path):
    with pytest.raises(ValueError):
        cube.build_cube(spark.createDataFrame([], "k long, time timestamp_ntz, bt array<double>"), str(tmp_path / "none"), 2, 2, (0, 0, 1, 1))
    rows = spark.sql("SELECT * FROM VALUES (0L, timestamp_ntz'2025-01-01', array(1D, null, 3D, 4D)), (33L, timestamp_ntz'2025-01-02', array(5D, 6D, 7D, 8D)) AS t(k, time, bt)")
    cube.build_cube(rows, str(tmp_path / "cube"), 2, 2, (0.0, 0.0, 4.0, 2.0)).collect()
    got = {r["k"]: r["bt"] for r in cube.read_cube(spark, str(tmp_path / "cube")).collect()}
    # The chunk between has no file; what is missing within a chunk is NULL.
    assert got[0] == [1, None, 3, 4] and got[33] == [5, 6, 7, 8] and got[1] == [None] * 4 and 20 not in got
    assert cube.cube_info(str(tmp_path / "cube"))["bbox"] == [0.0, 0.0, 4.0, 2.0]
    assert cube.edges_of(np.array([1.5, 0.5]), np.array([1.0, 3.0])) == [0.0, 0.0, 4.0, 2.0]


def test_sensor_files(tmp_path, spark):
    V = netcdf.Variable
    counts = netcdf.Dataset({"a": 1, "b": 1}, {"IMG_TIR1": V(("a", "b"), np.array([[500]], np.int32))})
    with pytest.raises(ValueError):
        satellite.temperature(counts, "INSAT-3DR")
    wrong = netcdf.Dataset({"y": 2, "x": 2, "lat": 3, "lon": 3}, {"bt": V(("y", "x"), np.zeros((2, 2))), "lat": V(("lat",), np.zeros(3)), "lon": V(("lon",), np.zeros(3))})
    with pytest.raises(ValueError):
        satellite.read_frame(netcdf.dump(wrong), "GK-2A")
    assert satellite.source_of("x/3RIMG_20JUN2025_0015_L1B.nc") == "INSAT-3DR" and satellite.time_of("3RIMG_20JUN2025_0015_L1B.nc").hour == 0 and satellite.time_of("none.nc") is None
    satellite.register(spark)
    with pytest.raises(Exception, match="cannot be listed"):
        spark.read.format("cadenza_frames").option("path", str(tmp_path / "nowhere")).load().count()


def test_entry_without_a_module():
    code = "import sys; sys.modules['xxhash'] = None; import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); print(len(q), 'op5_near_dedup' in q)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=str(__import__("pathlib").Path(__file__).parent.parent)).stdout.split()
    assert int(out[0]) == len(QUERIES) and out[1] == "False"


def test_command_line(spark, tmp_path):
    from cadenza.__main__ import main

    main(["demo", str(tmp_path / "demo"), "--frames", "5", "--side", "16", "--methods", "M1", "M38", "nope"], spark)
    report = spark.read.json(str(tmp_path / "demo" / "report")).collect()
    assert {r["method_id"] for r in report} == {"M1", "M38"} and len(list((tmp_path / "demo" / "scene" / "nc").glob("0*.nc"))) == 9
    import json

    scene = json.loads((tmp_path / "demo" / "scene" / "manifest.json").read_text())
    assert [f["index"] for f in scene["metrics"]["per_frame"]] == [2, 4, 6] and {m["method_id"] for m in scene["crossval"]["methods_run"]} == {"M1", "M38"}
    assert "![histogram_psnr]" in (tmp_path / "demo" / "results" / "RESULTS.md").read_text()
    with pytest.raises(SystemExit):
        main(["ingest", str(tmp_path)], spark)
