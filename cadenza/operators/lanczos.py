"""Resampling by a windowed sinc, along rows and then columns; what is transparent or missing has no weight, so it does not bleed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import blocks

#: Zero crossings of the sinc on each side that the window holds; alpha below which a pixel is missing.
LOBES, LEAST_ALPHA = 3, 1 / 510


def kernel(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < LOBES, np.sinc(x) * np.sinc(x / LOBES), 0.0)


def taps(of: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of `to` pixels the places (clipped) among `of` pixels that it is made of, and their weights, which sum to one."""
    scale = of / to
    wide = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale - 0.5
    reach = int(np.ceil(LOBES * wide))
    place = np.floor(centre).astype(int)[:, None] + np.arange(-reach, reach + 2)
    weight = kernel((place - centre[:, None]) / wide) * ((place >= 0) & (place < of))
    return np.clip(place, 0, of - 1), weight / weight.sum(axis=1, keepdims=True)


def _along(x: np.ndarray, axis: int, to: int) -> np.ndarray:
    place, weight = taps(x.shape[axis], to)
    moved = np.moveaxis(x, axis, 0)
    out = sum(moved[place[:, k]] * weight[:, k].reshape(-1, *[1] * (x.ndim - 1)) for k in range(place.shape[1]))
    return np.moveaxis(out, 0, axis)


def resized(rgba: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """An image (rows, columns, 4) with values from 0 to 255 at another size: colours are weighted by alpha, and by it again divided."""
    image = rgba.astype(float)
    alpha = image[..., 3:] / 255
    out = _along(_along(np.concatenate([image[..., :3] * alpha, alpha], axis=-1), 0, rows), 1, cols)
    alpha = out[..., 3:]
    seen = alpha > LEAST_ALPHA
    color = np.where(seen, out[..., :3] / np.where(seen, alpha, 1), 0)
    return np.clip(np.concatenate([color, np.where(seen, alpha, 0) * 255], axis=-1), 0, 255)


def pyramid(rgba: np.ndarray, tile: int, min_zoom: int, max_zoom: int):
    """(z, x, y, tile of bytes) over an image: the deepest level from the image, every other from the next deeper one."""
    level = None
    for z in range(max_zoom, min_zoom - 1, -1):
        level = resized(rgba if level is None else level, tile << z, tile << z)
        shown = np.rint(level).astype(np.uint8)
        for x in range(1 << z):
            for y in range(1 << z):
                yield z, x, y, shown[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile]


def halved(frames: DataFrame, keys: list[str], column: str, grid: blocks.Grid) -> tuple[DataFrame, blocks.Grid]:
    """The next level of frames in blocks, and its grid: `column` at half the size, missing where its `alpha`, the weight of the known
    pixels, is nearly nothing. A last odd row or column is cut off; the side of a block must be even. A block needs a halo of six."""
    if grid.size % 2:
        raise ValueError("the side of a block must be even")
    small = blocks.Grid(grid.rows // 2, grid.cols // 2, grid.size // 2)
    halo = 2 * LOBES
    # Output y lies between inputs 2 y and 2 y + 1.
    offsets = np.arange(-halo + 1, halo + 1)
    weight = kernel((offsets - 0.5) / 2)

    def of(stacks, place):
        x = stacks[column]
        h, w = place.height // 2, place.width // 2
        # Inputs beyond the rows and columns that are halved count as outside of the frame.
        rows, cols = (p[:, None] + np.arange(n + 2 * halo) - halo for p, n in ((place.y, place.height), (place.x, place.width)))
        inside = ((rows >= 0) & (rows < 2 * small.rows))[:, :, None] & ((cols >= 0) & (cols < 2 * small.cols))[:, None]
        known = inside & ~np.isnan(x)
        value = np.where(known, x, 0.0)

        def half(a: np.ndarray) -> np.ndarray:
            a = sum(t * a[:, halo + o : halo + o + 2 * h : 2] for o, t in zip(offsets, weight))
            return sum(t * a[:, :, halo + o : halo + o + 2 * w : 2] for o, t in zip(offsets, weight))

        total, share = half(value), half(known.astype(float))
        alpha = share / half(inside.astype(float))
        seen = alpha > LEAST_ALPHA
        pad = lambda a: np.pad(a, ((0, 0), (0, place.height - h), (0, place.width - w)), constant_values=np.nan)
        return {column: pad(np.where(seen, total / np.where(seen, share, 1), np.nan)), "alpha": pad(np.where(seen, alpha, 0.0))}

    found = blocks.apply(frames, keys, [column], grid, halo, of, {column: "array<double>", "alpha": "array<double>"})
    return _shrunk(found, keys, [column, "alpha"], grid, small), small


def _shrunk(found: DataFrame, keys: list[str], columns: list[str], grid: blocks.Grid, small: blocks.Grid) -> DataFrame:
    """Blocks whose pixels stand in the upper left quarter, cut to it."""
    width = F.least(F.lit(grid.size), grid.cols - F.col("bx") * grid.size)
    h = F.least(F.lit(small.size), small.rows - F.col("by") * small.size)
    w = F.least(F.lit(small.size), small.cols - F.col("bx") * small.size)
    cut = found.withColumn("h_", h).withColumn("w_", w).filter("h_ > 0 and w_ > 0")
    return cut.select(*keys, "by", "bx", *[blocks._cut(F.col(c), width, F.lit(0), F.lit(0), F.col("h_"), F.col("w_")).alias(c) for c in columns])
