"""Error and similarity metrics of predicted against true pixels, with one fixed range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.scalar import VMAX_K, VMIN_K, to_unit_interval

SPAN_K = VMAX_K - VMIN_K
# Windows and constants of SSIM, scales of MS-SSIM.
SSIM_TAPS, SSIM_SIGMA, SSIM_K1, SSIM_K2 = 11, 1.5, 0.01, 0.03
MS_WEIGHTS = [0.0448, 0.2856, 0.3001, 0.2363, 0.1333]


def valid(pred: str, truth: str, exclude: str | None = None) -> Column:
    """Pixels that count: both there and not excluded."""
    ok = F.col(pred).isNotNull() & F.col(truth).isNotNull()
    return ok & ~F.coalesce(F.col(exclude), F.lit(False)) if exclude else ok


def psnr(mse: Column) -> Column:
    """Of a mean square error on the unit interval; infinite for none."""
    return F.when(mse <= 0, F.lit(float("inf"))).otherwise(-10.0 * F.log10(mse))


def pixel_metrics(pixels: DataFrame, keys: list[str], pred: str = "pred", truth: str = "truth", exclude: str | None = None) -> DataFrame:
    """bt_bias_k and bt_rmse_k in Kelvin, mse, rmse, mae and psnr on the fixed unit interval, n_valid; NULL without a valid pixel."""
    ok = valid(pred, truth, exclude)
    error = F.when(ok, F.col(pred) - F.col(truth))
    unit = F.when(ok, to_unit_interval(F.col(pred)) - to_unit_interval(F.col(truth)))
    out = pixels.groupBy(*keys).agg(
        F.avg(error).alias("bt_bias_k"), F.sqrt(F.avg(error * error)).alias("bt_rmse_k"), F.avg(unit * unit).alias("mse"),
        F.avg(F.abs(unit)).alias("mae"), F.count(error).alias("n_valid"),
    )
    return out.withColumn("rmse", F.sqrt("mse")).withColumn("psnr", F.when(F.col("mse").isNotNull(), psnr(F.col("mse"))))


def array_metrics(framed: DataFrame, keys: list[str], pred: str = "pred", truth: str = "truth") -> DataFrame:
    """pixel_metrics() of frames held as arrays, in one projection: nothing is shuffled."""
    pairs = F.filter(F.zip_with(pred, truth, lambda p, g: F.when(p.isNotNull() & g.isNotNull(), F.struct(p.alias("p"), g.alias("g")))), lambda s: s.isNotNull())
    framed = framed.withColumn("__v", pairs).withColumn("__n", F.size("__v"))

    def mean(of) -> Column:
        return F.try_divide(F.aggregate("__v", F.lit(0.0), lambda acc, s: acc + of(s["p"], s["g"])), F.col("__n").cast("double"))

    unit = lambda p, g: to_unit_interval(p) - to_unit_interval(g)
    mse = mean(lambda p, g: F.pow(unit(p, g), 2.0))
    return framed.select(
        *keys, mean(lambda p, g: p - g).alias("bt_bias_k"), F.sqrt(mean(lambda p, g: F.pow(p - g, 2.0))).alias("bt_rmse_k"), mse.alias("mse"),
        F.sqrt(mse).alias("rmse"), mean(lambda p, g: F.abs(unit(p, g))).alias("mae"), F.when(F.col("__n") > 0, psnr(mse)).alias("psnr"), F.col("__n").cast("long").alias("n_valid"),
    )


def long_metrics(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return wide.unpivot(keys, metrics, "metric", "value")


def summarize(long: DataFrame, by: list[str]) -> DataFrame:
    """Mean and number of the finite values."""
    ok = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    return long.groupBy(*by).agg(F.avg(ok).alias("mean"), F.count(ok).alias("n_finite"))


def weighted_product(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the product of `value` to the power of `weight`; a value of zero or less makes it zero."""
    out = scores.groupBy(*keys).agg(F.min("value").alias("__least"), F.sum(F.col("weight") * F.ln("value")).alias("__log"))
    return out.select(*keys, F.when(F.col("__least") <= 0, 0.0).otherwise(F.exp("__log")).alias("product"))


def contingency(pixels: DataFrame, keys: list[str], threshold_k: float, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Cloud tops colder than a threshold: POD, FAR, CSI and frequency bias."""
    ok = valid(pred, truth)
    p, g = F.col(pred) < threshold_k, F.col(truth) < threshold_k
    n = pixels.groupBy(*keys).agg(F.count_if(ok & p & g).alias("hits"), F.count_if(ok & ~p & g).alias("misses"), F.count_if(ok & p & ~g).alias("false_alarms"))
    h, m, f = F.col("hits"), F.col("misses"), F.col("false_alarms")
    return n.withColumn("pod", F.try_divide(h, h + m)).withColumn("far", F.try_divide(f, h + f)).withColumn("csi", F.try_divide(h, h + m + f)).withColumn("freq_bias", F.try_divide(h + f, h + m))


# Windowed metrics: numpy on stacks of frames (..., rows, columns), batched through Arrow; one value for each frame.

def gaussian_taps(n: int = SSIM_TAPS, sigma: float = SSIM_SIGMA) -> np.ndarray:
    x = np.arange(n) - (n - 1) / 2
    w = np.exp(-(x**2) / (2 * sigma**2))
    return w / w.sum()


def _valid_filter(images: np.ndarray, taps: np.ndarray) -> np.ndarray:
    images = np.lib.stride_tricks.sliding_window_view(images, len(taps), axis=-2) @ taps
    return np.lib.stride_tricks.sliding_window_view(images, len(taps), axis=-1) @ taps


def _ssim_maps(a: np.ndarray, b: np.ndarray, span: float, taps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c1, c2 = (SSIM_K1 * span) ** 2, (SSIM_K2 * span) ** 2
    ma, mb = _valid_filter(a, taps), _valid_filter(b, taps)
    va, vb = _valid_filter(a * a, taps) - ma**2, _valid_filter(b * b, taps) - mb**2
    cov = _valid_filter(a * b, taps) - ma * mb
    contrast = (2 * cov + c2) / (va + vb + c2)
    return (2 * ma * mb + c1) / (ma**2 + mb**2 + c1) * contrast, contrast


def kernel_size(side: int, most: int = SSIM_TAPS) -> int:
    """Largest odd size up to `most` that fits, 3 at least."""
    n = min(most, side)
    return max(3, n if n % 2 else n - 1)


def _nan(images: np.ndarray) -> np.ndarray:
    return np.full(images.shape[:-2], np.nan)


def ssim(a: np.ndarray, b: np.ndarray, span: float = 1.0) -> np.ndarray:
    side = min(a.shape[-2:])
    return _nan(a) if side < 3 else _ssim_maps(a, b, span, gaussian_taps(kernel_size(side)))[0].mean(axis=(-2, -1))


def ms_ssim(a: np.ndarray, b: np.ndarray, span: float = 1.0, most: int = SSIM_TAPS) -> np.ndarray:
    """Over as many scales as leave four pixels a side, weights renormalised; NaN below four pixels."""
    side = min(a.shape[-2:])
    if side < 4:
        return _nan(a)
    scales = [w for k, w in enumerate(MS_WEIGHTS) if side >> k >= 4]
    out = np.ones(a.shape[:-2])
    for k, w in enumerate(np.array(scales) / sum(scales)):
        full, contrast = _ssim_maps(a, b, span, gaussian_taps(kernel_size(min(a.shape[-2:]), most)))
        value = (full if k == len(scales) - 1 else contrast).mean(axis=(-2, -1))
        out = out * np.maximum(value, 0.0) ** w
        h, v = a.shape[-2] // 2 * 2, a.shape[-1] // 2 * 2
        a, b = (x[..., :h, :v].reshape(*x.shape[:-2], h // 2, 2, v // 2, 2).mean(axis=(-3, -1)) for x in (a, b))
    return out


def _edged(images: np.ndarray) -> np.ndarray:
    return np.pad(images, [(0, 0)] * (images.ndim - 2) + [(1, 1), (1, 1)], mode="edge")


def gmsd(a: np.ndarray, b: np.ndarray, c: float = 0.0026) -> np.ndarray:
    """Deviation of the similarity of Prewitt gradients."""
    def gradient(x: np.ndarray) -> np.ndarray:
        p = _edged(x)
        rows = (p[..., :-2, :] + p[..., 1:-1, :] + p[..., 2:, :]) / 3
        cols = (p[..., :-2] + p[..., 1:-1] + p[..., 2:]) / 3
        return np.hypot(rows[..., 2:] - rows[..., :-2], cols[..., 2:, :] - cols[..., :-2, :])
    ga, gb = gradient(a), gradient(b)
    return ((2 * ga * gb + c) / (ga**2 + gb**2 + c)).std(axis=(-2, -1))


def phase_congruency(images: np.ndarray, scales: int = 4, turns: int = 4) -> np.ndarray:
    """Log-Gabor phase congruency with a fixed noise floor."""
    h, w = images.shape[-2:]
    fy, fx = np.meshgrid(np.fft.fftfreq(h), np.fft.fftfreq(w), indexing="ij")
    radius = np.hypot(fy, fx)
    radius[0, 0] = 1.0
    angle = np.arctan2(-fy, fx)
    spectrum = np.fft.fft2(images)
    energy, amplitude = np.zeros(images.shape), np.zeros(images.shape)
    for o in range(turns):
        away = np.abs(np.arctan2(np.sin(angle - o * np.pi / turns), np.cos(angle - o * np.pi / turns)))
        spread = np.exp(-(away**2) / (2 * (np.pi / turns / 1.2) ** 2))
        total = np.zeros(images.shape, complex)
        for s in range(scales):
            gabor = np.exp(-(np.log(radius * 6 * 2.0**s) ** 2) / (2 * np.log(0.55) ** 2))
            gabor[0, 0] = 0.0
            response = np.fft.ifft2(spectrum * gabor * spread)
            total += response
            amplitude += np.abs(response)
        energy += np.abs(total)
    return np.maximum(energy - 1e-4, 0) / (amplitude + 1e-4)


def fsim(a: np.ndarray, b: np.ndarray, t1: float = 0.85, t2: float = 160 / 255**2) -> np.ndarray:
    """Feature similarity: phase congruency and Scharr gradients, weighted by the larger congruency."""
    def scharr(x: np.ndarray) -> np.ndarray:
        p = _edged(x)
        cell = lambda y, z: p[..., y : y + x.shape[-2], z : z + x.shape[-1]]
        dx = (3 * cell(0, 2) + 10 * cell(1, 2) + 3 * cell(2, 2) - 3 * cell(0, 0) - 10 * cell(1, 0) - 3 * cell(2, 0)) / 16
        dy = (3 * cell(2, 0) + 10 * cell(2, 1) + 3 * cell(2, 2) - 3 * cell(0, 0) - 10 * cell(0, 1) - 3 * cell(0, 2)) / 16
        return np.hypot(dx, dy)
    pa, pb, ga, gb = phase_congruency(a), phase_congruency(b), scharr(a), scharr(b)
    like = (2 * pa * pb + t1) / (pa**2 + pb**2 + t1) * (2 * ga * gb + t2) / (ga**2 + gb**2 + t2)
    weight = np.maximum(pa, pb)
    total = weight.sum(axis=(-2, -1))
    return np.where(total > 0, (like * weight).sum(axis=(-2, -1)) / np.where(total > 0, total, 1.0), 1.0)


def radial_psd(images: np.ndarray) -> np.ndarray:
    """Mean power by whole radius around the centre of the shifted spectrum of the demeaned images."""
    power = np.abs(np.fft.fftshift(np.fft.fft2(images - images.mean(axis=(-2, -1), keepdims=True)), axes=(-2, -1))) ** 2
    h, w = images.shape[-2:]
    y, x = np.indices((h, w))
    r = np.hypot(y - h // 2, x - w // 2).astype(int).ravel()
    member = np.zeros((h * w, r.max() + 1))
    member[np.arange(h * w), r] = 1
    return power.reshape(*images.shape[:-2], h * w) @ (member / np.maximum(member.sum(axis=0), 1))


def psd_ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean ratio of powers over the upper half of the radii where the second has any."""
    pa, pb = radial_psd(a), radial_psd(b)
    ok = (np.arange(pb.shape[-1]) >= pb.shape[-1] // 2) & (pb > 1e-12)
    n = ok.sum(axis=-1)
    return np.where(n > 0, np.where(ok, pa / np.where(ok, pb, 1.0), 0.0).sum(axis=-1) / np.maximum(n, 1), np.nan)


def stack(frames, side: int) -> np.ndarray:
    """Frames held as lists, row by row and of one length, as (n, rows, columns); missing pixels are NaN."""
    return np.array([[np.nan if v is None else v for v in f] for f in frames], float).reshape(len(frames), -1, side)


#: Pixels that are worked on at once.
STACK_PIXELS = 1 << 15


def slices(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """The batches in runs of rows whose frames in `column` have STACK_PIXELS together, or one row of a larger frame: a stack and what
    is computed from it has that size however many rows a batch has."""
    for batch in batches:
        n = max(1, STACK_PIXELS // max(1, len(batch[column].iloc[0]))) if len(batch) else 1
        for k in range(0, max(1, len(batch)), n):
            yield batch.iloc[k : k + n]


WINDOWED = {"ssim": ssim, "ms_ssim": ms_ssim, "fsim": fsim, "gmsd": gmsd, "psd_ratio": psd_ratio}


def windowed_metrics(framed: DataFrame, keys: list[str], side: int, names: list[str] | None = None, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Windowed metrics of frames held as arrays of side * side; missing pixels are 0.5 in both unit images."""
    names = names or list(WINDOWED)

    def run(batches):
        for batch in slices(batches, pred):
            out = batch[keys].copy()
            p, g = (stack(batch[c], side) for c in (pred, truth))
            gone = np.isnan(p) | np.isnan(g)
            a, b = (np.where(gone, 0.5, np.clip((x - VMIN_K) / SPAN_K, 0, 1)) for x in (p, g))
            for m in names:
                out[m] = WINDOWED[m](a, b) if len(batch) else []
            yield out

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in framed.select(*keys).schema] + [f"{m} double" for m in names]
    return framed.select(*keys, pred, truth).mapInPandas(run, ", ".join(fields))
