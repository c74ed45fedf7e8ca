"""Stencils, warps and optical flow on frames held as arrays, row by row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators import flow
from cadenza.operators.metrics import slices, stack


def at(frame: Column | str, y: Column, x: Column, side: int) -> Column:
    """The pixel at (y, x), coordinates clamped to the frame."""
    y = F.greatest(F.lit(0), F.least(F.lit(side - 1), y.cast("int")))
    x = F.greatest(F.lit(0), F.least(F.lit(side - 1), x.cast("int")))
    return F.get(frame, y * side + x)


def mirrored(frame: Column | str, y: Column, x: Column, side: int) -> Column:
    """The pixel at (y, x), mirrored at the border, which is not repeated."""
    fold = lambda v: F.lit(side - 1) - F.abs(F.lit(side - 1) - F.abs(v))
    return F.get(frame, (fold(y) * side + fold(x)).cast("int"))


def stencil(frame: str, side: int, of) -> Column:
    """A frame of of(y, x) for every pixel."""
    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: of(F.floor(i / side).cast("int"), (i % side).cast("int")))


def sobel(frame: str, side: int) -> tuple[Column, Column]:
    """Horizontal and vertical Sobel gradients with mirrored borders."""
    p = lambda y, x: mirrored(frame, y, x, side)
    gx = stencil(frame, side, lambda y, x: p(y - 1, x + 1) + 2 * p(y, x + 1) + p(y + 1, x + 1) - p(y - 1, x - 1) - 2 * p(y, x - 1) - p(y + 1, x - 1))
    gy = stencil(frame, side, lambda y, x: p(y + 1, x - 1) + 2 * p(y + 1, x) + p(y + 1, x + 1) - p(y - 1, x - 1) - 2 * p(y - 1, x) - p(y - 1, x + 1))
    return gx, gy


def census(frames: np.ndarray, reach: int = 3) -> np.ndarray:
    """Soft census of a stack (n, rows, columns): for each pixel the 49 values d / sqrt(0.81 + d * d) of differences to its
    surroundings, borders mirrored; (n, 49, rows, columns)."""
    n, h, w = frames.shape
    wide = np.pad(frames, ((0, 0), (reach, reach), (reach, reach)), mode="reflect")
    d = np.stack([wide[:, y : y + h, x : x + w] for y in range(2 * reach + 1) for x in range(2 * reach + 1)], axis=1) - frames[:, None]
    return d / np.sqrt(0.81 + d * d)


def sobel_numpy(frames: np.ndarray) -> np.ndarray:
    """sobel() of a stack: (2, n, rows, columns)."""
    p = np.pad(frames, ((0, 0), (1, 1), (1, 1)), mode="reflect")
    across = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    down = p[:, :, :-2] + 2 * p[:, :, 1:-1] + p[:, :, 2:]
    return np.stack([across[:, :, 2:] - across[:, :, :-2], down[:, 2:] - down[:, :-2]])


def census_sums(framed: DataFrame, keys: list[str], column: str, side: int) -> DataFrame:
    """keys and `census`, for each pixel the sum of its soft census values."""
    def run(batches):
        for batch in slices(batches, column):
            out = batch[keys].copy()
            out["census"] = census(stack(batch[column], side)).sum(axis=1).reshape(len(batch), -1).tolist() if len(batch) else []
            yield out
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in framed.select(*keys).schema]
    return framed.select(*keys, column).mapInPandas(run, ", ".join([*fields, "census array<double>"]))


def box_mean(frame: str, side: int, factor: int) -> Column:
    """Means over factor x factor boxes; sides that do not divide are cut off."""
    small = side // factor
    def of(y, x):
        cells = [F.get(F.col(frame), (y * factor + a) * side + x * factor + b) for a in range(factor) for b in range(factor)]
        return sum(cells[1:], cells[0]) / float(factor * factor)
    return stencil(frame, small, of)


def warp(frame: str, u: str, v: str, side: int, scale: float = 1.0) -> Column:
    """Bilinear backward warp: the value at (y + scale v, x + scale u), borders replicated."""
    def of(y, x):
        i = y * side + x
        sx = F.greatest(F.lit(0.0), F.least(F.lit(float(side - 1)), x + scale * F.get(F.col(u), i)))
        sy = F.greatest(F.lit(0.0), F.least(F.lit(float(side - 1)), y + scale * F.get(F.col(v), i)))
        x0, y0 = F.floor(sx), F.floor(sy)
        fx, fy = sx - x0, sy - y0
        p = lambda a, b: at(frame, a, b, side)
        return (1 - fy) * ((1 - fx) * p(y0, x0) + fx * p(y0, x0 + 1)) + fy * ((1 - fx) * p(y0 + 1, x0) + fx * p(y0 + 1, x0 + 1))
    return stencil(frame, side, of)


# Flow: numpy on stacks of frames (n, rows, columns).

def _means_around(f: np.ndarray) -> np.ndarray:
    """Mean of the four neighbours, zero outside: the cross of a stack with a border of zeros."""
    p = np.pad(f, ((0, 0), (1, 1), (1, 1)))
    return (p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:]) / 4


def horn_schunck(a: np.ndarray, b: np.ndarray, n_iter: int = 60, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Dense flow from a to b: Jacobi steps for the optical flow constraint with a smoothness weight alpha (Horn and Schunck, 1981)."""
    gradient_y, gradient_x = np.zeros_like(a), np.zeros_like(a)
    gradient_y[:, :-1] = a[:, 1:] - a[:, :-1]
    gradient_x[:, :, :-1] = a[:, :, 1:] - a[:, :, :-1]
    weight = 1 / (alpha**2 + gradient_x**2 + gradient_y**2)
    flow = np.zeros((2, *a.shape))
    for _ in range(n_iter):
        mean = np.stack([_means_around(f) for f in flow])
        residual = (gradient_x * mean[0] + gradient_y * mean[1] + b - a) * weight
        flow = mean - np.stack([gradient_x, gradient_y]) * residual
    return flow[0], flow[1]


def block_flow(a: np.ndarray, b: np.ndarray, levels: int = 3, radius: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Pyramidal least-squares flow (Lucas-Kanade over a window), coarse to fine."""
    def half(x):
        h, w = x.shape[1] // 2 * 2, x.shape[2] // 2 * 2
        return x[:, :h, :w].reshape(-1, h // 2, 2, w // 2, 2).mean(axis=(2, 4))

    def double(x, shape):
        x = 2 * x.repeat(2, axis=1).repeat(2, axis=2)[:, : shape[0], : shape[1]]
        return np.pad(x, ((0, 0), (0, shape[0] - x.shape[1]), (0, shape[1] - x.shape[2])), mode="edge")

    def summed(x):
        x = np.pad(x, ((0, 0), (radius, radius), (radius, radius)), mode="edge")
        return np.lib.stride_tricks.sliding_window_view(x, (2 * radius + 1,) * 2, axis=(1, 2)).sum(axis=(3, 4))

    pyramid = [(a, b)]
    while len(pyramid) < levels and min(pyramid[-1][0].shape[1:]) >= 8:
        pyramid.append(tuple(half(x) for x in pyramid[-1]))
    u = v = np.zeros_like(pyramid[-1][0])
    for n, (p, q) in enumerate(reversed(pyramid)):
        if n:
            u, v = (double(x, p.shape[1:]) for x in (u, v))
        gy, gx = np.gradient(p, axis=(1, 2))
        dt = warp_numpy(q, u, v) - p
        xx, yy, xy, xt, yt = summed(gx * gx) + 1e-3, summed(gy * gy) + 1e-3, summed(gx * gy), summed(gx * dt), summed(gy * dt)
        det = xx * yy - xy * xy
        u, v = u - (yy * xt - xy * yt) / det, v - (xx * yt - xy * xt) / det
    return u, v


def warp_numpy(frames: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    n, h, w = frames.shape
    k, y, x = np.indices(frames.shape)
    sx, sy = np.clip(x + u, 0, w - 1), np.clip(y + v, 0, h - 1)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = sx - x0, sy - y0
    return (1 - fy) * ((1 - fx) * frames[k, y0, x0] + fx * frames[k, y0, x1]) + fy * ((1 - fx) * frames[k, y1, x0] + fx * frames[k, y1, x1])


SOLVERS = {"horn_schunck": horn_schunck, "block": block_flow, "total_variation": flow.total_variation, "polynomial": flow.polynomial}


def _filled(frames: np.ndarray) -> np.ndarray:
    """Missing pixels by the mean of their frame, zero in a frame without any."""
    known = ~np.isnan(frames)
    mean = np.where(known, frames, 0).sum(axis=(1, 2)) / np.maximum(known.sum(axis=(1, 2)), 1)
    return np.where(known, frames, mean[:, None, None])


def flow_blend(a: np.ndarray, b: np.ndarray, t: float, solver: str = "horn_schunck") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The flow (u, v) from a to b, and both frames moved to t along the flows between them (minus sign), blended; missing
    pixels are filled by the mean and masked again."""
    gone = np.isnan(a) | np.isnan(b)
    a, b = _filled(a), _filled(b)
    (u, v), (p, q) = SOLVERS[solver](a, b), SOLVERS[solver](b, a)
    out = (1 - t) * warp_numpy(a, -t * u, -t * v) + t * warp_numpy(b, -(1 - t) * p, -(1 - t) * q)
    return u, v, np.where(gone, np.nan, out)


def flow_frames(pairs: DataFrame, keys: list[str], side: int, t: float = 0.5, solver: str = "horn_schunck") -> DataFrame:
    """Flow (u, v), its mean speed and the blended frame of each pair (bt, bt_next)."""
    def run(batches):
        for batch in slices(batches, "bt"):
            out = batch[keys].copy()
            if len(batch):
                u, v, blend = flow_blend(*(stack(batch[c], side) for c in ("bt", "bt_next")), t, solver)
                flat = lambda x: x.reshape(len(x), -1).tolist()
                out["u"], out["v"], out["speed"] = flat(u), flat(v), np.hypot(u, v).mean(axis=(1, 2))
                out["pred"] = [[None if x != x else x for x in row] for row in flat(blend)]
            else:
                for name in ("u", "v", "speed", "pred"):
                    out[name] = []
            yield out
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema]
    return pairs.select(*keys, "bt", "bt_next").mapInPandas(run, ", ".join([*fields, "u array<double>", "v array<double>", "speed double", "pred array<double>"]))


def flow_vectors(framed: DataFrame, keys: list[str], side: int, step: int) -> DataFrame:
    """x, y, dx, dy of every step-th pixel from step // 2 on with finite flow."""
    out = framed.select(*keys, F.posexplode(F.arrays_zip("u", "v")).alias("i", "f"))
    y, x = F.floor(F.col("i") / side).cast("int"), (F.col("i") % side).cast("int")
    out = out.select(*keys, y.alias("y"), x.alias("x"), F.col("f.u").alias("dx"), F.col("f.v").alias("dy"))
    return out.filter((F.col("y") % step == step // 2) & (F.col("x") % step == step // 2) & F.col("dx").isNotNull() & F.col("dy").isNotNull() & ~F.isnan("dx") & ~F.isnan("dy"))


def flow_overlay(vectors: DataFrame, side: int, west: float, south: float, east: float, north: float, scale: float = 1.0) -> DataFrame:
    """Start and end of each vector in degrees; positive v goes south."""
    dx, dy = (east - west) / side, (north - south) / side
    lon, lat = west + (F.col("x") + 0.5) * dx, north - (F.col("y") + 0.5) * dy
    return vectors.select("*", F.round(lon, 6).alias("lon0"), F.round(lat, 6).alias("lat0"), F.round(lon + scale * F.col("dx") * dx, 6).alias("lon1"), F.round(lat - scale * F.col("dy") * dy, 6).alias("lat1"))


def one_schema(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x0, y0, x1, y1 of vectors as JSON (json) in either schema: x, y, u, v, or start and end; NULL where neither is whole."""
    v = F.from_json("json", "x double, y double, u double, v double, start array<double>, end array<double>")
    start, end = (lambda i: F.get(v["start"], F.lit(i))), (lambda i: F.get(v["end"], F.lit(i)))
    return texts.select(*keys, *[F.coalesce(v[a], start(i)).alias(f"{a}0") for i, a in enumerate("xy")], *[F.coalesce(v[a] + v[b], end(i)).alias(f"{a}1") for i, (a, b) in enumerate(("xu", "yv"))])


def flow_color(u: Column, v: Column, largest: float) -> tuple[Column, Column]:
    """Hue in degrees by direction and saturation by magnitude; NULL flow has none."""
    hue = F.pmod(F.degrees(F.atan2(-v, -u)) + 360.0, F.lit(360.0))
    return hue, F.least(F.lit(1.0), F.hypot(u, v) / largest)


# Corners of the colour wheel for flow (Baker et al., 2011), and entries from each to the next.
_CORNERS, _ENTRIES = [(255, 0, 0), (255, 255, 0), (0, 255, 0), (0, 255, 255), (0, 0, 255), (255, 0, 255)], [15, 6, 4, 11, 13, 6]
WHEEL = sum(_ENTRIES)


def color_wheel() -> list[tuple[int, ...]]:
    """The wheel's entries: a channel that differs between two corners rises or falls in whole steps, the others stay."""
    out = []
    for a, b, n in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1], _ENTRIES):
        for step in (255 * i // n for i in range(n)):
            out.append(tuple(p if p == q else step if q > p else 255 - step for p, q in zip(a, b)))
    return out


def flow_rgb(u: Column, v: Column, largest: Column) -> Column:
    """r, g, b of a flow vector: hue by direction, from the wheel, towards white by the magnitude's share of the largest and
    darker beyond it; a missing vector is black."""
    eps = float(np.finfo(np.float32).eps)
    most = F.when(largest > 0, largest).otherwise(1.0) + eps
    x, y = u / most, v / most
    share, place = F.sqrt(x * x + y * y), wheel_place(x, y)
    first = F.floor(place).cast("int")
    part, wheel = place - F.floor(place), color_wheel()

    def channel(c: int) -> Column:
        entries = F.array(*[F.lit(e[c]) for e in wheel])
        at = lambda k: F.get(entries, k % WHEEL) / 255.0
        color = (1.0 - part) * at(first) + part * at(first + 1)
        color = F.when(share <= 1, 1.0 - share * (1.0 - color)).otherwise(color * 0.75)
        return F.when(color.isNull(), 0).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), color * 255.0))).cast("int"))

    return F.struct(*[channel(c).alias(n) for c, n in enumerate("rgb")])


def wheel_place(u: Column, v: Column) -> Column:
    """Place of a flow vector's direction on the colour wheel, from 0 to the last entry."""
    return (F.atan2(-v, -u) / F.pi() + 1) / 2 * (WHEEL - 1)


def transposed(rows: Column) -> Column:
    """An array of arrays of one length with rows and columns exchanged."""
    return F.transform(F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))) - 1), lambda j: F.transform(rows, lambda row: F.get(row, j)))
