"""Dense optical flow on stacks of frames (n, rows, columns): total variation with an L1 data term, and polynomial expansion.

Each solver takes two stacks in Kelvin and gives u (columns) and v (rows), so that a pixel at x in the first frame is at x + u in
the second. Frames of a stack do not see each other. Both go from coarse to fine over a pyramid of halved frames.
"""

from __future__ import annotations

import numpy as np

from cadenza.functions.scalar import VMAX_K, VMIN_K

#: Total variation: step, weight of the data, coupling, levels, warps at a level, steps at a warp (Zach, Pock and Bischof, 2007).
TAU, WEIGHT, THETA, TV_LEVELS, WARPS, STEPS = 0.25, 0.15, 0.3, 5, 5, 30
#: Polynomial expansion: radius and width of the fit, side of the window, levels, rounds at a level (Farnebäck, 2003).
FIT_RADIUS, FIT_SIGMA, WINDOW, FIT_LEVELS, ROUNDS = 5, 1.2, 15, 3, 3
#: Side of the coarsest frame at least.
LEAST_SIDE = 8


def scaled(frames: np.ndarray) -> np.ndarray:
    """Kelvin on the scale from 0 to 255, for which the weights are meant."""
    return (frames - VMIN_K) / (VMAX_K - VMIN_K) * 255.0


def sampled(frames: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Bilinear values at (y + v, x + u), clamped to the frame; frames may have further axes in front of those of the flow."""
    h, w = u.shape[-2:]
    y, x = np.clip(np.arange(h)[:, None] + v, 0, h - 1), np.clip(np.arange(w) + u, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(0, h - 2)), np.minimum(x.astype(int), max(0, w - 2))
    fy, fx = y - y0, x - x0
    flat = frames.reshape(*frames.shape[:-2], h * w)
    def at(dy: int, dx: int) -> np.ndarray:
        place = (np.minimum(y0 + dy, h - 1) * w + np.minimum(x0 + dx, w - 1)).reshape(*u.shape[:-2], h * w)
        return np.take_along_axis(flat, np.broadcast_to(place, flat.shape), -1).reshape(frames.shape)
    return (1 - fy) * ((1 - fx) * at(0, 0) + fx * at(0, 1)) + fy * ((1 - fx) * at(1, 0) + fx * at(1, 1))


def _pyramid(a: np.ndarray, b: np.ndarray, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Both stacks from coarse to fine; a level is smoothed (binomially) and every second pixel of it taken."""
    def smaller(x: np.ndarray) -> np.ndarray:
        p = np.pad(x, ((0, 0), (2, 2), (2, 2)), mode="edge")
        taps = np.array([1, 4, 6, 4, 1]) / 16
        p = sum(t * p[:, k : k + x.shape[1]] for k, t in enumerate(taps))
        return sum(t * p[:, :, k : k + x.shape[2]] for k, t in enumerate(taps))[:, ::2, ::2]

    out = [(a, b)]
    while len(out) < levels and min(out[-1][0].shape[1:]) >= 2 * LEAST_SIDE:
        out.append(tuple(smaller(x) for x in out[-1]))
    return out[::-1]


def _larger(flow: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The flow of a level on the next finer one, where it is twice as long: pixel y is y / 2 of the coarse level."""
    h, w = flow.shape[-2:]
    y, x = np.minimum(np.arange(shape[0]) / 2, h - 1), np.minimum(np.arange(shape[1]) / 2, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(0, h - 2)), np.minimum(x.astype(int), max(0, w - 2))
    fy, fx = (y - y0)[:, None], x - x0
    rows = (1 - fy) * flow[:, y0] + fy * flow[:, np.minimum(y0 + 1, h - 1)]
    return 2 * ((1 - fx) * rows[:, :, x0] + fx * rows[:, :, np.minimum(x0 + 1, w - 1)])


def _ahead(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward differences along columns and rows, zero at the end."""
    dx, dy = np.zeros_like(x), np.zeros_like(x)
    dx[:, :, :-1] = np.diff(x, axis=2)
    dy[:, :-1] = np.diff(x, axis=1)
    return dx, dy


def _divergence(px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """The negative adjoint of the forward differences."""
    out = np.zeros_like(px)
    out[:, :, :-1] += px[:, :, :-1]
    out[:, :, 1:] -= px[:, :, :-1]
    out[:, :-1] += py[:, :-1]
    out[:, 1:] -= py[:, :-1]
    return out


def total_variation(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flow that minimises its total variation and the absolute difference of the warped frames, by turns: the data term pixel by pixel
    by thresholding, the total variation by steps in its dual."""
    u = v = None
    for p, q in _pyramid(scaled(a), scaled(b), TV_LEVELS):
        u, v = (np.zeros_like(p) if x is None else _larger(x, p.shape[1:]) for x in (u, v))
        dual = np.zeros((4, *p.shape))
        gy, gx = np.gradient(q, axis=(1, 2))
        for _ in range(WARPS):
            moved, mx, my = (sampled(x, u, v) for x in (q, gx, gy))
            square = mx * mx + my * my
            fixed = moved - mx * u - my * v - p
            bound = WEIGHT * THETA * square
            for _ in range(STEPS):
                rho = fixed + mx * u + my * v
                step = np.where(rho < -bound, WEIGHT * THETA, np.where(rho > bound, -WEIGHT * THETA, -rho / np.maximum(square, 1e-9)))
                u, v = u + step * mx + THETA * _divergence(dual[0], dual[1]), v + step * my + THETA * _divergence(dual[2], dual[3])
                slopes = np.stack([*_ahead(u), *_ahead(v)])
                for k in (0, 2):
                    length = np.sqrt(slopes[k] ** 2 + slopes[k + 1] ** 2)
                    dual[k : k + 2] = (dual[k : k + 2] + TAU / THETA * slopes[k : k + 2]) / (1 + TAU / THETA * length)
    return u, v


def expansion(frames: np.ndarray, radius: int = FIT_RADIUS, sigma: float = FIT_SIGMA) -> np.ndarray:
    """Of each pixel's neighbourhood the quadratic polynomial that fits it best under a Gaussian weight: coefficients of x, y, x * x, y * y
    and x * y, (5, n, rows, columns)."""
    offsets = np.arange(-radius, radius + 1)
    weight = np.exp(-(offsets**2) / (2 * sigma**2))
    weight /= weight.sum()
    wide = np.pad(frames, ((0, 0), (radius, radius), (radius, radius)), mode="edge")
    h, w = frames.shape[1:]
    powers = [weight * offsets**k for k in range(3)]
    rows = [sum(t * wide[:, k : k + h] for k, t in enumerate(taps)) for taps in powers]
    moment = lambda px, py: sum(t * rows[py][:, :, k : k + w] for k, t in enumerate(powers[px]))
    basis = [(0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)]
    single = [float((weight * offsets**k).sum()) for k in range(5)]
    gram = np.array([[single[a + c] * single[b + d] for c, d in basis] for a, b in basis])
    return np.einsum("ij,jnyx->inyx", np.linalg.inv(gram)[1:], np.stack([moment(*p) for p in basis]))


def _window(x: np.ndarray, side: int) -> np.ndarray:
    """Sums over windows, the border replicated, from running sums."""
    r = side // 2
    for axis in (-2, -1):
        pad = [(0, 0)] * x.ndim
        pad[axis] = (r + 1, r)
        total = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis)
        n = x.shape[axis]
        x = np.take(total, np.arange(2 * r + 1, 2 * r + 1 + n), axis) - np.take(total, np.arange(n), axis)
    return x


def polynomial(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flow from how the quadratic polynomials around each pixel move: if f(x) = x'Ax + b'x moves by d, then b changes by -2 A d, which a
    window of pixels gives by least squares; what is known of d already is where the second polynomial is taken."""
    u = v = None
    for p, q in _pyramid(scaled(a), scaled(b), FIT_LEVELS):
        u, v = (np.zeros_like(p) if x is None else _larger(x, p.shape[1:]) for x in (u, v))
        first, second = expansion(p), expansion(q)
        side = min(WINDOW, min(p.shape[1:]) // 2 * 2 - 1)
        for _ in range(ROUNDS):
            moved = sampled(second, u, v)
            xx, yy, xy = (first[2:] + moved[2:]) / 2 * np.array([1, 1, 0.5])[:, None, None, None]
            bx, by = (first[:2] - moved[:2]) / 2
            bx, by = bx + xx * u + xy * v, by + xy * u + yy * v
            g11, g12, g22, h1, h2 = _window(np.stack([xx * xx + xy * xy, xy * (xx + yy), yy * yy + xy * xy, xx * bx + xy * by, xy * bx + yy * by]), side)
            det = g11 * g22 - g12 * g12 + 1e-9 + 1e-6 * (g11 + g22) ** 2
            u, v = (g22 * h1 - g12 * h2) / det, (g11 * h2 - g12 * h1) / det
    return u, v
