"""Frames in blocks: a frame is rows (keys, by, bx, arrays of a block's pixels), so that no task holds a whole one.

    grid = Grid(rows=5500, cols=5500, size=512)
    edges = sobel(from_frames(frames, ["k"], ["bt"], grid), ["k"], "bt", grid)

What an operator needs of a block's surroundings, its halo, is cut from the neighbours and sent to the block in one shuffle: a
block of n by n pixels with a halo of h gets and sends about 4 h (n + h) pixels, whatever the frame's size. Beyond the frame's
border the halo is mirrored, replicated or missing. Blocks at the lower and right border may be smaller. A missing pixel is NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators import metrics

#: Pixels of a stack of blocks with their halos.
STACK_PIXELS = 1 << 16


@dataclass(frozen=True)
class Grid:
    """Rows and columns of a frame, and the side of a block."""

    rows: int
    cols: int
    size: int

    @property
    def down(self) -> int:
        return -(-self.rows // self.size)

    @property
    def across(self) -> int:
        return -(-self.cols // self.size)


def _cut(values: Column, width: Column, y: Column, x: Column, h: Column, w: Column) -> Column:
    """The pixels of h rows and w columns from (y, x) on of an array of rows of `width`; whole slices, no pixel on its own."""
    return F.flatten(F.transform(F.sequence(y, y + h - 1), lambda row: F.slice(values, (row * width + x + 1).cast("int"), w.cast("int"))))


def from_frames(frames: DataFrame, keys: list[str], columns: list[str], grid: Grid) -> DataFrame:
    """Blocks of frames held as arrays, row by row; nothing is shuffled. Sources that read files by ranges give blocks themselves."""
    n = F.explode(F.sequence(F.lit(0), F.lit(grid.down * grid.across - 1))).alias("n")
    by, bx = F.floor(F.col("n") / grid.across).cast("int"), (F.col("n") % grid.across).cast("int")
    cut = frames.select(*keys, *columns, n).withColumn("by", by).withColumn("bx", bx)
    y, x = F.col("by") * grid.size, F.col("bx") * grid.size
    h, w = F.least(F.lit(grid.size), grid.rows - y), F.least(F.lit(grid.size), grid.cols - x)
    return cut.select(*keys, "by", "bx", *[_cut(F.col(c), F.lit(grid.cols), y, x, h, w).alias(c) for c in columns])


def pixels(blocks: DataFrame, keys: list[str], columns: list[str], grid: Grid) -> DataFrame:
    """A row a pixel: keys, y, x in the frame, values."""
    width = F.least(F.lit(grid.size), grid.cols - F.col("bx") * grid.size)
    each = blocks.select(*keys, "by", "bx", width.alias("w"), F.posexplode(F.arrays_zip(*columns)).alias("i", "p"))
    y, x = F.col("by") * grid.size + F.floor(F.col("i") / F.col("w")), F.col("bx") * grid.size + F.col("i") % F.col("w")
    return each.select(*keys, y.cast("int").alias("y"), x.cast("int").alias("x"), *[F.col(f"p.{c}").alias(c) for c in columns])


def with_halo(blocks: DataFrame, keys: list[str], columns: list[str], grid: Grid, halo: int) -> DataFrame:
    """keys, by, bx and `pieces`, the block's own pixels and those within `halo` of it, each with its place in the frame.

    Each block cuts what its neighbours need; one shuffle brings the pieces of a block together, of which there are as many as
    blocks touch its halo, nine if a block is no smaller than the halo."""
    reach = -(-halo // grid.size)
    down, across = min(reach, grid.down - 1), min(reach, grid.across - 1)
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in range(-down, down + 1) for b in range(-across, across + 1)])
    to = blocks.select(*keys, "by", "bx", *columns, F.explode(steps).alias("d"))
    to = to.withColumn("ty", F.col("by") + F.col("d.dy")).withColumn("tx", F.col("bx") + F.col("d.dx"))
    to = to.filter((F.col("ty") >= 0) & (F.col("tx") >= 0) & (F.col("ty") < grid.down) & (F.col("tx") < grid.across))

    def overlap(own: str, target: str, length: int) -> tuple[Column, Column, Column]:
        """Where the block begins, and begin and length of what the target's halo covers of it."""
        begin = F.col(own) * grid.size
        low = F.greatest(begin, F.col(target) * grid.size - halo)
        high = F.least(begin + grid.size, F.lit(length), F.col(target) * grid.size + grid.size + halo)
        return begin, low, high - low

    y0, y, h = overlap("by", "ty", grid.rows)
    x0, x, w = overlap("bx", "tx", grid.cols)
    width = F.least(F.lit(grid.size), grid.cols - x0)
    cut = to.filter((h > 0) & (w > 0)).select(
        *keys, "ty", "tx", F.struct(y.alias("y"), x.alias("x"), h.alias("h"), w.alias("w"), *[_cut(F.col(c), width, y - y0, x - x0, h, w).alias(c) for c in columns]).alias("piece")
    )
    return cut.groupBy(*keys, F.col("ty").alias("by"), F.col("tx").alias("bx")).agg(F.collect_list("piece").alias("pieces"))


@dataclass
class Place:
    """Where in the frame the pixels of a stack of blocks of one shape begin, without their halos, and how large they are."""

    y: np.ndarray
    x: np.ndarray
    height: int
    width: int


def _assemble(pieces: pa.Array, columns: list[str], by: np.ndarray, bx: np.ndarray, grid: Grid, halo: int, mode: str) -> Iterator[tuple[np.ndarray, Place, dict[str, np.ndarray]]]:
    """For the blocks of each shape: their rows, place, and stacks (n, height + 2 halo, width + 2 halo) with NaN for missing pixels.

    A stack has STACK_PIXELS pixels at most, or one block, however many rows a batch has."""
    offsets, flat = pieces.offsets.to_numpy(), pieces.values
    part = {f: flat.field(f).to_numpy(zero_copy_only=False) for f in ("y", "x", "h", "w")}
    values = {}
    for c in columns:
        lists = flat.field(c)
        numbers = lists.values
        values[c] = lists.offsets.to_numpy(), numbers.cast(pa.float64()).to_numpy(zero_copy_only=False)
    height, width = np.minimum(grid.size, grid.rows - by * grid.size), np.minimum(grid.size, grid.cols - bx * grid.size)
    alike = [(h, w, np.flatnonzero((height == h) & (width == w))) for h, w in sorted({*zip(height.tolist(), width.tolist())})]
    most = lambda h, w: max(1, STACK_PIXELS // ((h + 2 * halo) * (w + 2 * halo)))
    for h, w, rows in ((h, w, rows[k : k + most(h, w)]) for h, w, rows in alike for k in range(0, len(rows), most(h, w))):
        place = Place(by[rows] * grid.size, bx[rows] * grid.size, h, w)
        stacks = {}
        for c in columns:
            begins, numbers = values[c]
            out = np.full((len(rows), h + 2 * halo, w + 2 * halo), np.nan)
            for n, row in enumerate(rows.tolist()):
                y0, x0 = by[row] * grid.size - halo, bx[row] * grid.size - halo
                for k in range(offsets[row], offsets[row + 1]):
                    y, x, ph, pw = (int(part[f][k]) for f in ("y", "x", "h", "w"))
                    out[n, y - y0 : y - y0 + ph, x - x0 : x - x0 + pw] = numbers[begins[k] : begins[k] + ph * pw].reshape(ph, pw)
                if mode != "missing":
                    # What lies within the frame, and how far the halo goes beyond it on each side.
                    top, left = max(0, -y0), max(0, -x0)
                    bottom, right = max(0, y0 + h + 2 * halo - grid.rows), max(0, x0 + w + 2 * halo - grid.cols)
                    if top or left or bottom or right:
                        inner = out[n, top : h + 2 * halo - bottom, left : w + 2 * halo - right]
                        out[n] = np.pad(inner, ((top, bottom), (left, right)), mode=mode)
            stacks[c] = out
        yield rows, place, stacks


def apply(
    blocks: DataFrame, keys: list[str], columns: list[str], grid: Grid, halo: int, of: Callable[[dict[str, np.ndarray], Place], dict[str, np.ndarray]], outputs: dict[str, str], mode: str = "missing",
) -> DataFrame:
    """keys, by, bx and the outputs of `of` for every block: an array of each block's pixels, or a number.

    `of` gets the stacks of the columns for blocks of one shape, with halos, and gives for each output an array (n, height, width) or
    (n,). mode is that of the halo beyond the frame: missing (NaN), reflect (mirrored, the border not repeated) or edge (replicated)."""
    fields = {f.name: f for f in blocks.select(*keys).schema}
    schema = ", ".join([*(f"`{k}` {fields[k].dataType.simpleString()}" for k in keys), "by int, bx int", *(f"{c} {t}" for c, t in outputs.items())])
    kinds = {c: pa.list_(pa.float64()) if t.startswith("array") else pa.int64() if t in ("long", "bigint") else pa.float64() for c, t in outputs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by, bx = (batch.column(c).to_numpy().astype(np.int64) for c in ("by", "bx"))
            for rows, place, stacks in _assemble(batch.column("pieces"), columns, by, bx, grid, halo, mode):
                found = of(stacks, place)
                out = []
                for c in outputs:
                    if pa.types.is_list(kinds[c]):
                        flat = found[c].reshape(-1)
                        numbers = pa.array(flat, pa.float64(), mask=np.isnan(flat))
                        out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * (place.height * place.width), pa.int32()), numbers))
                    else:
                        out.append(pa.array(found[c], kinds[c]))
                own = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*[own.column(k) for k in keys], own.column("by"), own.column("bx"), *out], names=[*keys, "by", "bx", *outputs])

    return with_halo(blocks, keys, columns, grid, halo).mapInArrow(run, schema)


def _inner(x: np.ndarray, halo: int, dy: int = 0, dx: int = 0) -> np.ndarray:
    """The pixels without halo, or those at an offset from them."""
    h, w = x.shape[1] - 2 * halo, x.shape[2] - 2 * halo
    return x[:, halo + dy : halo + dy + h, halo + dx : halo + dx + w]


def sobel(blocks: DataFrame, keys: list[str], column: str, grid: Grid) -> DataFrame:
    """Horizontal and vertical Sobel gradients gx and gy with mirrored borders."""
    def of(stacks, place):
        p = lambda dy, dx: _inner(stacks[column], 1, dy, dx)
        return {"gx": p(-1, 1) + 2 * p(0, 1) + p(1, 1) - p(-1, -1) - 2 * p(0, -1) - p(1, -1), "gy": p(1, -1) + 2 * p(1, 0) + p(1, 1) - p(-1, -1) - 2 * p(-1, 0) - p(-1, 1)}

    return apply(blocks, keys, [column], grid, 1, of, {"gx": "array<double>", "gy": "array<double>"}, "reflect")


def census(blocks: DataFrame, keys: list[str], column: str, grid: Grid, reach: int = 3) -> DataFrame:
    """`census`: for each pixel the sum of the soft census of its surroundings, borders mirrored."""
    def of(stacks, place):
        centre, total = _inner(stacks[column], reach), 0.0
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                d = _inner(stacks[column], reach, dy, dx) - centre
                total = total + d / np.sqrt(0.81 + d * d)
        return {"census": total}

    return apply(blocks, keys, [column], grid, reach, of, {"census": "array<double>"}, "reflect")


def warp(blocks: DataFrame, keys: list[str], column: str, u: str, v: str, grid: Grid, reach: int, scale: float = 1.0) -> DataFrame:
    """Bilinear backward warp of `column`: the value at (y + scale v, x + scale u), clamped to the frame.

    `reach` bounds scale times the flow in whole pixels, which is the halo; a larger flow is an error, never cut."""
    def of(stacks, place):
        image, halo = stacks[column], reach + 1
        du, dv = scale * _inner(stacks[u], halo), scale * _inner(stacks[v], halo)
        far = np.nanmax(np.maximum(np.abs(du), np.abs(dv)), initial=0.0)
        if far > reach:
            raise ValueError(f"a flow of {far} pixels goes beyond the reach of {reach}")
        n, h, w = du.shape
        k, y, x = np.indices(du.shape)
        sy = np.clip(place.y[:, None, None] + y + dv, 0, grid.rows - 1)
        sx = np.clip(place.x[:, None, None] + x + du, 0, grid.cols - 1)
        gone = np.isnan(sy) | np.isnan(sx)
        y0, x0 = (np.floor(np.where(gone, 0, s)).astype(int) for s in (sy, sx))
        y1, x1 = np.minimum(y0 + 1, grid.rows - 1), np.minimum(x0 + 1, grid.cols - 1)
        fy, fx = sy - y0, sx - x0
        at = lambda a, b: image[k, np.where(gone, 0, a - place.y[:, None, None] + halo), np.where(gone, 0, b - place.x[:, None, None] + halo)]
        return {"warped": (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x1)) + fy * ((1 - fx) * at(y1, x0) + fx * at(y1, x1))}

    return apply(blocks, keys, [column, u, v], grid, reach + 1, of, {"warped": "array<double>"}, "edge")


def ssim(blocks: DataFrame, keys: list[str], pred: str, truth: str, grid: Grid, span: float = 1.0) -> DataFrame:
    """keys, ssim and the number of windows: the mean over all windows that lie in the frame and have no missing pixel.

    Blocks give sums and counts, which are added up."""
    taps = metrics.gaussian_taps(metrics.kernel_size(min(grid.rows, grid.cols)))
    halo = len(taps) // 2

    def of(stacks, place):
        values = metrics._ssim_maps(stacks[pred], stacks[truth], span, taps)[0]
        known = ~np.isnan(values)
        return {"total": np.where(known, values, 0).sum(axis=(1, 2)), "windows": known.sum(axis=(1, 2))}

    sums = apply(blocks, keys, [pred, truth], grid, halo, of, {"total": "double", "windows": "long"})
    return sums.groupBy(*keys).agg(F.try_divide(F.sum("total"), F.sum("windows").cast("double")).alias("ssim"), F.sum("windows").alias("windows"))


def bilinear(blocks: DataFrame, keys: list[str], column: str, grid: Grid, fy: float, fx: float) -> DataFrame:
    """`value` at (y + fy, x + fx) for every pixel, fy and fx from 0 to 1; missing where a corner lies outside of the frame."""
    def of(stacks, place):
        p = lambda dy, dx: _inner(stacks[column], 1, dy, dx)
        return {"value": (1 - fy) * ((1 - fx) * p(0, 0) + fx * p(0, 1)) + fy * ((1 - fx) * p(1, 0) + fx * p(1, 1))}

    return apply(blocks, keys, [column], grid, 1, of, {"value": "array<double>"})


def halved(blocks: DataFrame, keys: list[str], column: str, grid: Grid) -> tuple[DataFrame, Grid]:
    """The next level of a pyramid: means of the known pixels of boxes of two by two, a last odd row or column cut off, as blocks
    of half the side. The side of a block must be even, so boxes lie in blocks and nothing is shuffled; level upon level may follow."""
    if grid.size % 2:
        raise ValueError("the side of a block must be even")
    small = Grid(grid.rows // 2, grid.cols // 2, grid.size // 2)
    width = F.least(F.lit(grid.size), grid.cols - F.col("bx") * grid.size)
    h = F.least(F.lit(small.size), small.rows - F.col("by") * small.size)
    w = F.least(F.lit(small.size), small.cols - F.col("bx") * small.size)

    def box(i: Column) -> Column:
        y, x = F.floor(i / F.col("w_")).cast("int") * 2, (i % F.col("w_")).cast("int") * 2
        cells = F.filter(F.array(*[F.get(F.col(column), ((y + a) * F.col("width_") + x + b).cast("int")) for a in (0, 1) for b in (0, 1)]), lambda v: v.isNotNull())
        return F.try_divide(F.aggregate(cells, F.lit(0.0), lambda total, v: total + v), F.size(cells).cast("double"))

    out = blocks.withColumn("width_", width).withColumn("h_", h).withColumn("w_", w).filter("h_ > 0 and w_ > 0")
    return out.select(*keys, "by", "bx", F.transform(F.sequence(F.lit(0), (F.col("h_") * F.col("w_") - 1).cast("int")), box).alias(column)), small


def patches(blocks: DataFrame, keys: list[str], column: str, grid: Grid, side: int, ys: list[int], xs: list[int]) -> DataFrame:
    """keys, y0, x0 and `patch`, the pixels of each patch with its upper left corner in ys and xs; the block of the corner cuts it."""
    if max(ys) + side > grid.rows or max(xs) + side > grid.cols:
        raise ValueError("a patch goes beyond the frame")
    halo = side - 1
    fields = {f.name: f for f in blocks.select(*keys).schema}
    schema = ", ".join([*(f"`{k}` {fields[k].dataType.simpleString()}" for k in keys), "y0 int, x0 int, patch array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by, bx = (batch.column(c).to_numpy().astype(np.int64) for c in ("by", "bx"))
            for rows, place, stacks in _assemble(batch.column("pieces"), [column], by, bx, grid, halo, "missing"):
                own, corners, values = [], [], []
                for n, row in enumerate(rows.tolist()):
                    for y in (y for y in ys if 0 <= y - place.y[n] < place.height):
                        for x in (x for x in xs if 0 <= x - place.x[n] < place.width):
                            a, b = y - place.y[n] + halo, x - place.x[n] + halo
                            own.append(row)
                            corners.append((y, x))
                            values.append(stacks[column][n, a : a + side, b : b + side].ravel())
                flat = np.concatenate(values) if values else np.zeros(0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * side * side, pa.int32()), pa.array(flat, pa.float64(), mask=np.isnan(flat)))
                taken = batch.take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*[taken.column(k) for k in keys], pa.array([c[0] for c in corners], pa.int32()), pa.array([c[1] for c in corners], pa.int32()), lists], names=[*keys, "y0", "x0", "patch"]
                )

    return with_halo(blocks, keys, [column], grid, halo).mapInArrow(run, schema)


def horn_schunck(blocks: DataFrame, keys: list[str], first: str, then: str, grid: Grid, n_iter: int = 60, alpha: float = 1.0) -> DataFrame:
    """Flow u, v from the first to the second column, exactly that of the whole frame: a step moves by one pixel, so a halo of one pixel
    for each step is enough, or the whole frame. Missing pixels count as zero."""
    halo = min(n_iter + 1, max(grid.rows, grid.cols))

    def of(stacks, place):
        a, b = (np.nan_to_num(stacks[c]) for c in (first, then))
        rows, cols = (p[:, None] + np.arange(n + 2 * halo) - halo for p, n in ((place.y, place.height), (place.x, place.width)))
        inside = ((rows >= 0) & (rows < grid.rows))[:, :, None] & ((cols >= 0) & (cols < grid.cols))[:, None]
        gy, gx = np.zeros_like(a), np.zeros_like(a)
        gy[:, :-1] = (a[:, 1:] - a[:, :-1]) * (inside[:, 1:] & inside[:, :-1])
        gx[:, :, :-1] = (a[:, :, 1:] - a[:, :, :-1]) * (inside[:, :, 1:] & inside[:, :, :-1])
        weight, change = 1 / (alpha**2 + gx**2 + gy**2), b - a
        u, v = np.zeros_like(a), np.zeros_like(a)
        for _ in range(n_iter):
            mu, mv = _cross_mean(u), _cross_mean(v)
            step = (gx * mu + gy * mv + change) * weight
            u, v = (mu - gx * step) * inside, (mv - gy * step) * inside
        return {"u": _inner(u, halo), "v": _inner(v, halo)}

    return apply(blocks, keys, [first, then], grid, halo, of, {"u": "array<double>", "v": "array<double>"})


def _cross_mean(x: np.ndarray) -> np.ndarray:
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    return (_inner(p, 1, -1) + _inner(p, 1, 1) + _inner(p, 1, 0, -1) + _inner(p, 1, 0, 1)) / 4
