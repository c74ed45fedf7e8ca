"""Flow solvers on planted shifts, against Horn and Schunck, and frame by frame."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.operators import blocks, flow, losses, metrics, stencil


def scene(dy, dx, side=64):
    """A smooth texture in Kelvin, moved exactly, as it is known everywhere."""
    draw = np.random.default_rng(3)
    y, x = np.mgrid[0:side, 0:side].astype(float)
    out = np.zeros((side, side))
    for _ in range(14):
        wy, wx, phase = draw.normal(0, 0.22), draw.normal(0, 0.22), draw.random() * 6.3
        out += np.sin(wy * (y - dy) + wx * (x - dx) + phase)
    return 250 + 8 * out


SHIFTS = [(1.5, -2.25), (0.4, 0.3), (-3.0, 4.5)]


@pytest.mark.parametrize("solver", ["total_variation", "polynomial"])
def test_planted_shifts(solver):
    a, b = np.stack([scene(0, 0)] * 3), np.stack([scene(*s) for s in SHIFTS])
    u, v = getattr(flow, solver)(a, b)
    hu, hv = stencil.horn_schunck(a, b)
    inner = (slice(None), slice(12, -12), slice(12, -12))
    for k, (dy, dx) in enumerate(SHIFTS):
        error, plain = (np.hypot(x[inner][k] - dx, y[inner][k] - dy).mean() for x, y in ((u, v), (hu, hv)))
        assert error < 0.2 and error < plain, (solver, dy, dx, error, plain)


@pytest.mark.parametrize("solver", ["total_variation", "polynomial"])
@pytest.mark.parametrize("shape", [(24, 24), (8, 8), (17, 31), (3, 5)])
def test_frames_of_a_stack_do_not_see_each_other(solver, shape):
    draw = np.random.default_rng(0)
    a, b = (250 + 20 * draw.random((3, *shape)) for _ in range(2))
    u, v = getattr(flow, solver)(a, b)
    assert np.isfinite(u).all() and np.isfinite(v).all() and u.shape == v.shape == a.shape
    for k in range(3):
        own = getattr(flow, solver)(a[k : k + 1], b[k : k + 1])
        assert np.allclose(own[0][0], u[k]) and np.allclose(own[1][0], v[k])


def test_flat_frames_do_not_move():
    flat = np.full((1, 16, 16), 250.0)
    for solver in (flow.total_variation, flow.polynomial):
        u, v = solver(flat, flat + 1)
        assert np.abs(u).max() < 1e-6 and np.abs(v).max() < 1e-6


def test_expansion_of_a_quadratic():
    y, x = np.mgrid[-10:11, -10:11].astype(float)
    f = 3 + 0.5 * x - 2 * y + 0.25 * x * x - 0.1 * y * y + 0.3 * x * y
    assert np.allclose(flow.expansion(f[None])[:, 0, 10, 10], [0.5, -2, 0.25, -0.1, 0.3])


def test_total_variation_keeps_an_edge():
    """Two halves that move against each other: the flow changes at the border and is flat elsewhere."""
    a, b = scene(0, 0), scene(0, 0)
    b[:, :32], b[:, 32:] = scene(1.5, 0)[:, :32], scene(-1.5, 0)[:, 32:]
    _, v = flow.total_variation(a[None], b[None])
    assert abs(v[0, 12:-12, 8:24].mean() - 1.5) < 0.2 and abs(v[0, 12:-12, 40:56].mean() + 1.5) < 0.2
    _, smooth = stencil.horn_schunck(a[None], b[None])
    middle = lambda x: np.abs(x[0, 12:-12, 26:38]).mean()
    assert middle(v) > middle(smooth)


def test_blends_by_every_solver():
    a, b = scene(0, 0)[None], scene(2, 1)[None]
    truth = scene(1, 0.5)
    linear = np.sqrt(((0.5 * a + 0.5 * b)[0] - truth)[8:-8, 8:-8] ** 2).mean()
    for solver in ("total_variation", "polynomial"):
        _, _, out = stencil.flow_blend(a, b, 0.5, solver)
        assert np.abs((out[0] - truth)[8:-8, 8:-8]).mean() < 0.3 * linear


def test_stacks_of_blocks_do_not_grow_with_the_batch():
    grid, n = blocks.Grid(8, 8, 4), 12_000
    piece = {"y": 4, "x": 4, "h": 4, "w": 4, "a": [1.0] * 16}
    pieces = pa.array([[piece]] * n, pa.list_(pa.struct([("y", pa.int32()), ("x", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("a", pa.list_(pa.float64()))])))
    found = [(rows, stacks["a"]) for rows, _, stacks in blocks._assemble(pieces, ["a"], np.ones(n, int), np.ones(n, int), grid, 8, "missing")]
    assert max(s.size for _, s in found) <= blocks.STACK_PIXELS and np.concatenate([rows for rows, _ in found]).tolist() == list(range(n))
    assert all((np.nansum(s, axis=(1, 2)) == 16).all() for _, s in found)


def test_stacks_of_frames_do_not_grow_with_the_batch():
    batch = pd.DataFrame({"k": range(10_000), "bt": [np.zeros(64)] * 10_000})
    found = list(metrics.slices([batch, batch.iloc[:0]], "bt"))
    assert max(len(b) * 64 for b in found) <= metrics.STACK_PIXELS and pd.concat(found)["k"].tolist() == list(range(10_000)) and not len(found[-1])
    assert [len(b) for b in metrics.slices([pd.DataFrame({"bt": [np.zeros(metrics.STACK_PIXELS + 1)] * 3})], "bt")] == [1, 1, 1]


def test_a_halo_is_no_wider_than_the_frame(spark):
    frames = spark.createDataFrame([(0, [float(v) for v in range(64)], [float(v % 7) for v in range(64)])], "k long, a array<double>, b array<double>")
    grid = blocks.Grid(8, 8, 4)
    for n in (3, 40):
        got = blocks.pixels(blocks.horn_schunck(blocks.from_frames(frames, ["k"], ["a", "b"], grid), ["k"], "a", "b", grid, n), ["k"], ["u", "v"], grid).orderBy("y", "x").collect()
        own = stencil.horn_schunck(*(np.array(frames.first()[c]).reshape(1, 8, 8) for c in "ab"), n)
        assert np.allclose([[r["u"], r["v"]] for r in got], np.stack([f.ravel() for f in own], axis=1), atol=1e-9)


def one_batch(spark, *columns, n=4000):
    """n frames of 64 pixels in one partition, so in one batch."""
    return spark.range(0, n, 1, 1).select(F.col("id").alias("k"), *[F.array_repeat(0.25 + F.col("id") % 3 / 4, 64).alias(c) for c in columns])


def test_combined_losses_of_bounded_stacks(spark, monkeypatch):
    for name in losses.STACKED:
        monkeypatch.setitem(losses.STACKED, name, lambda a, b: np.full(len(a), float(max(a.size, b.size))))
    got = losses.combined(one_batch(spark, "pred", "truth"), ["k"], 8).toPandas()
    assert sorted(got["k"]) == list(range(4000)) and got[list(losses.STACKED)].max().max() <= 32_768


def test_parts_of_losses_of_bounded_stacks(spark, monkeypatch):
    for name in losses.STACKED:
        monkeypatch.setitem(losses.STACKED, name, lambda a, b: np.full(len(a), float(max(a.size, b.size))))
    got = losses.parts(one_batch(spark, "pred", "truth"), ["k"], 8, ["census", "gradient"]).toPandas()
    assert sorted(got["k"]) == list(range(4000)) and got[["census", "gradient"]].max().max() <= 32_768


@pytest.mark.parametrize("solver", ["polynomial", "total_variation", "block"])
def test_flow_blends_of_bounded_stacks(spark, monkeypatch, solver):
    def blend(a, b, t, name):
        return np.full(a.shape, float(max(a.size, b.size))), np.full(a.shape, float(name == solver)), (a + b) / 2

    monkeypatch.setattr(stencil, "flow_blend", blend)
    pairs = one_batch(spark, "bt", "bt_next")
    got = stencil.flow_frames(pairs, ["k"], 8, solver=solver).select("k", F.array_max("u").alias("u"), F.array_min("v").alias("v")).toPandas()
    assert sorted(got["k"]) == list(range(4000)) and got["u"].max() <= 32_768 and (got["v"] == 1).all()
