"""Windowed-sinc pyramids against plain loops, and reports whose pictures hold the binned counts."""

import json
import math
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import numpy as np
import pytest

from cadenza.operators import blocks, lanczos
from cadenza.plans import jobs
from cadenza.sources import plots


def tap(x):
    return 0.0 if abs(x) >= 3 else 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3)


def plain(rgba, rows, cols):
    """Every output pixel from all input pixels, one by one."""
    h, w, _ = rgba.shape
    out = np.zeros((rows, cols, 4))
    sy, sx = h / rows, w / cols
    for i in range(rows):
        for j in range(cols):
            wy = [tap((y + 0.5 - (i + 0.5) * sy) / max(sy, 1)) for y in range(h)]
            wx = [tap((x + 0.5 - (j + 0.5) * sx) / max(sx, 1)) for x in range(w)]
            wy, wx = [v / sum(wy) for v in wy], [v / sum(wx) for v in wx]
            alpha = sum(a * b * rgba[y, x, 3] / 255 for y, a in enumerate(wy) for x, b in enumerate(wx))
            if alpha > 1 / 510:
                for c in range(3):
                    out[i, j, c] = sum(a * b * rgba[y, x, c] * rgba[y, x, 3] / 255 for y, a in enumerate(wy) for x, b in enumerate(wx)) / alpha
                out[i, j, 3] = alpha * 255
    return np.clip(out, 0, 255)


@pytest.mark.parametrize("shape,to", [((12, 10), (6, 5)), ((9, 7), (4, 4)), ((5, 6), (11, 13)), ((8, 8), (8, 8)), ((3, 3), (1, 1))])
def test_resizing_against_a_loop(shape, to):
    draw = np.random.default_rng(sum(shape))
    image = draw.integers(0, 256, (*shape, 4)).astype(float)
    image[0, :, 3] = 0
    assert np.abs(lanczos.resized(image, *to) - plain(image, *to)).max() < 1e-9


def test_transparent_pixels_do_not_bleed():
    image = np.zeros((16, 16, 4))
    image[:, :8] = (200, 10, 10, 255)
    image[:, 8:] = (0, 255, 0, 0)  # green, but not to be seen
    small = lanczos.resized(image, 8, 8)
    seen = small[..., 3] > 0
    assert np.abs(small[seen][:, :3] - (200, 10, 10)).max() < 1e-9 and not small[:, 7, 3].any()
    tiles = {(z, x, y): t for z, x, y, t in lanczos.pyramid(image, 4, 0, 2)}
    assert len(tiles) == 1 + 4 + 16 and all(t.shape == (4, 4, 4) for t in tiles.values()) and (tiles[0, 0, 0][:, 0, :3] == (200, 10, 10)).all()


@pytest.mark.parametrize("rows,cols,size", [(8, 8, 4), (13, 10, 4), (24, 9, 8), (6, 6, 2)])
def test_blocks_against_whole_frames(spark, rows, cols, size):
    draw = np.random.default_rng(rows)
    frame = np.where(draw.random((rows, cols)) < 0.2, np.nan, 200 + 100 * draw.random((rows, cols)))
    grid = blocks.Grid(rows, cols, size)
    df = spark.createDataFrame([(0, [None if np.isnan(v) else float(v) for v in frame.ravel()])], "k int, bt array<double>")
    found, small = lanczos.halved(blocks.from_frames(df, ["k"], ["bt"], grid), ["k"], "bt", grid)
    assert (small.rows, small.cols, small.size) == (rows // 2, cols // 2, size // 2)
    got = np.full((small.rows, small.cols), -1.0)
    for r in blocks.pixels(found, ["k"], ["bt", "alpha"], small).collect():
        got[r["y"], r["x"]] = np.nan if r["bt"] is None else r["bt"]
    own = frame[: rows // 2 * 2, : cols // 2 * 2]
    wy, wx = (np.array([[tap((i - 2 * o - 0.5) / 2) for i in range(n)] for o in range(n // 2)]) for n in own.shape)
    known = ~np.isnan(own)
    share, total = wy @ known @ wx.T, wy @ np.where(known, own, 0) @ wx.T
    want = np.where(share / (wy @ np.ones(own.shape) @ wx.T) > 1 / 510, total / share, np.nan)
    assert np.allclose(got, want, atol=1e-9, equal_nan=True)


def test_report(spark, tmp_path):
    draw = np.random.default_rng(0)
    rows = [(k, 0, datetime(2025, 6, 20) + timedelta(minutes=30 * k), [float(v) for v in 200 + 100 * draw.random(16)]) for k in range(40)]
    frames = spark.createDataFrame(rows, "k long, label int, time timestamp_ntz, bt array<double>")
    document = jobs.full_report(frames, str(tmp_path / "report"), ["M1", "M18"], 4)
    assert json.loads((tmp_path / "report" / "report.json").read_text()) == document
    stack = np.array([r[3] for r in rows])
    rmse = np.sqrt((((stack[:-2] + stack[2:]) / 2 - stack[1:-1]) ** 2).mean(axis=1))
    counts, _ = np.histogram(rmse, plots.BINS)
    svg = (tmp_path / "report" / document["figures"]["histogram_bt_rmse_k"]).read_text()
    assert plots.counts_of(svg) == {k: n for k, n in enumerate(counts.tolist()) if n}
    assert document["metrics"]["summary"]["bt_rmse_k"]["mean"] == pytest.approx(rmse.mean()) and {m["method_id"] for m in document["crossval"]["methods_run"]} == {"M1", "M18"}
    course = ET.fromstring((tmp_path / "report" / document["figures"]["course_bt_rmse_k"]).read_text())
    dots = [c for c in course.iter("{http://www.w3.org/2000/svg}circle")]
    assert [float(c.get("data-mean")) for c in dots] == pytest.approx(rmse.tolist()) and [int(c.get("data-first")) for c in dots] == list(range(1, 39))
    text = (tmp_path / "report" / "RESULTS.md").read_text()
    assert f"| bt_rmse_k | {rmse.mean():.4f} |" in text and "![histogram_psnr](histogram_psnr.svg)" in text


def test_plots_of_little(spark):
    one = spark.createDataFrame([("m", 2.0), ("m", 2.0), ("m", None), ("n", float("nan"))], "metric string, value double")
    found = [r.asDict() for r in plots.histogram(one).collect()]
    assert [(f["metric"], f["bin"], f["n"]) for f in found] == [("m", 0, 2)] and plots.counts_of(plots.draw_histogram("a <b>", found)) == {0: 2}
    assert plots.histogram(one.limit(0)).count() == 0 and plots.counts_of(plots.draw_histogram("none", [])) == {} and "<svg" in plots.draw_course("none", [])
    many = spark.range(1000).selectExpr("id AS k", "'m' AS metric", "CAST(id AS double) AS value")
    assert plots.course(many, 1000).count() == 200
