"""Training losses as values of frames held as arrays: per frame, on the unit interval."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.scalar import VMIN_K, to_unit_interval
from cadenza.operators import metrics, stencil

# Smoothing terms and the weights of the combined loss.
EPS, SMALL = 1e-3, 1e-6
WEIGHTS = {"charbonnier": 1.0, "census": 0.5, "ms_ssim": 0.25, "gradient": 0.1, "distillation": 0.01}


def mean(array: Column) -> Column:
    """Mean of an array of doubles; NULL of an empty one, or if an element is missing."""
    return F.try_divide(F.aggregate(array, F.lit(0.0), lambda a, v: a + v), F.size(array).cast("double"))


def _rough(a: Column, b: Column, square: float) -> Column:
    """Mean of sqrt(d * d + square) over the differences of two arrays."""
    return mean(F.zip_with(a, b, lambda x, y: F.sqrt((x - y) * (x - y) + square)))


def charbonnier(pred: str, truth: str, eps: float = EPS) -> Column:
    return _rough(F.col(pred), F.col(truth), eps * eps)


def distillation(student: tuple[str, str], teacher: tuple[str, str], eps: float = EPS) -> Column:
    """Between the flows (u, v) of a student and its teacher of one size; zero where either is missing."""
    joined = lambda names: F.concat(*[F.col(c) for c in names])
    return F.coalesce(_rough(joined(student), joined(teacher), eps * eps), F.lit(0.0))


def _mean(x: np.ndarray) -> np.ndarray:
    return x.reshape(len(x), -1).mean(axis=1)


def census(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between the soft census values of both stacks, a value for each frame."""
    return _mean(np.sqrt((stencil.census(a) - stencil.census(b)) ** 2 + SMALL))


def gradient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between the Sobel gradients, of both directions."""
    return sum(_mean(np.sqrt((p - g) ** 2 + SMALL)) for p, g in zip(stencil.sobel_numpy(a), stencil.sobel_numpy(b)))


def ms_ssim(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One less the multi-scale similarity with windows of seven at most, between zero and one."""
    return np.clip(1 - metrics.ms_ssim(a, b, most=7), 0, 1)


STACKED = {"census": census, "gradient": gradient, "ms_ssim": ms_ssim}


def parts(framed: DataFrame, keys: list[str], side: int, names: list[str] | None = None, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """keys, charbonnier and the stacked losses `names` of unit frames."""
    names = names or list(STACKED)

    def run(batches):
        for batch in metrics.slices(batches, pred):
            out = batch[[*keys, "charbonnier"]].copy()
            a, b = (metrics.stack(batch[c], side) for c in (pred, truth))
            for name in names:
                out[name] = STACKED[name](a, b) if len(batch) else []
            yield out

    own = framed.select(*keys, pred, truth, charbonnier(pred, truth).alias("charbonnier"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*keys, "charbonnier").schema]
    return own.mapInPandas(run, ", ".join([*fields, *[f"{n} double" for n in names]]))


def unit_frames(framed: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Both frames on the unit interval; a missing pixel is the lower end."""
    own = lambda v: to_unit_interval(F.coalesce(v, F.lit(VMIN_K)))
    return framed.withColumn(pred, F.transform(pred, own)).withColumn(truth, F.transform(truth, own))


def combined(framed: DataFrame, keys: list[str], side: int, weights: dict[str, float] | None = None) -> DataFrame:
    """keys, the parts charbonnier, census, gradient and ms_ssim of unit frames (pred, truth), and their weighted sum `total`."""
    w = WEIGHTS | (weights or {})
    return parts(framed, keys, side).withColumn("total", sum((F.col(c) * w[c] for c in ("charbonnier", "census", "gradient", "ms_ssim")), F.lit(0.0)))
