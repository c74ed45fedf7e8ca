"""Numerics of a hidden Markov model over symbols: scaled forward and backward recursions of many sequences at once.

Sequences are cut into segments of at most SEGMENT symbols. A segment's transfer matrix, the product of its steps, carries
the forward vector across it, so that the segments of a long sequence run side by side and the likelihood is still exact;
the same matrices carry the backward vector the other way. Sequences of one segment need no matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SEGMENT = 2_048
#: While so many sequences run side by side, steps cost less than matrices, so segments are as long as the sequence of that rank.
WIDE = 32
#: Symbols in hand at once.
GROUP = 1_000_000


@dataclass
class Model:
    """start[k], moves[k, j] and emits[symbol, k]; rows of start and moves sum to one, emits over the symbols."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray


@dataclass
class Counts:
    """Expected starts, moves (by pairs of states) and emissions, and the log likelihood of what was counted."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray
    log: float = 0.0


class _Layout:
    """Segments as one array in order of time: symbols of step t of all segments that have it, longest segments first."""

    def __init__(self, segments: list[np.ndarray]):
        lengths = np.array([len(s) for s in segments])
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        steps = int(self.lengths[0])
        # Segments that have a step, for each step; where the step begins.
        self.width = len(lengths) - np.searchsorted(self.lengths[::-1], np.arange(steps), "right")
        self.begin = np.concatenate([[0], np.cumsum(self.width)])
        row = np.repeat(np.arange(len(lengths)), self.lengths)
        step = np.arange(len(row)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        at = self.begin[step] + row
        self.symbols = np.empty(len(row), np.int64)
        self.symbols[at] = np.concatenate([segments[i] for i in self.order])
        self.row = np.empty(len(row), np.int64)
        self.row[at] = row
        self.last = self.begin[self.lengths - 1] + np.arange(len(lengths))

    def steps(self) -> Iterator[tuple[int, int]]:
        return zip(self.begin[:-1].tolist(), self.width.tolist())


def _forward(model: Model, layout: _Layout, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward vectors and scales of each symbol; into[segment]: the state before its first symbol is met."""
    alpha = model.emits[layout.symbols]
    scale = np.empty(len(alpha), alpha.dtype)
    before = into[layout.order]
    moves, ones = model.moves, np.ones(alpha.shape[1], alpha.dtype)
    for n, (a, width) in enumerate(layout.steps()):
        now = alpha[a : a + width]
        now *= before[:width] if n == 0 else before[:width] @ moves
        total = scale[a : a + width]
        np.dot(now, ones, out=total)
        now /= total[:, None]
        before = now
    return alpha, scale


def _backward(model: Model, layout: _Layout, scale: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled backward vectors, and those times the emission by the scale, of each symbol; end[segment]: that of its last."""
    beta = np.empty((len(scale), end.shape[1]), end.dtype)
    beta[layout.last] = end[layout.order]
    met = model.emits[layout.symbols]
    met /= scale[:, None]
    back = np.ascontiguousarray(model.moves.T)
    steps = list(layout.steps())
    for n in range(len(steps) - 1, -1, -1):
        a, width = steps[n]
        met[a : a + width] *= beta[a : a + width]
        if n:
            beta[steps[n - 1][0] : steps[n - 1][0] + width] = met[a : a + width] @ back
    return beta, met


def _values(model: Model, segments: list[np.ndarray]) -> np.ndarray:
    """How likely each segment is from each state before its first symbol, up to a factor."""
    layout = _Layout(segments)
    out = np.ones((len(segments), len(model.start)), model.emits.dtype)
    back = np.ascontiguousarray(model.moves.T)
    steps = list(layout.steps())
    for n in range(len(steps) - 1, -1, -1):
        a, width = steps[n]
        now = out[:width]
        now *= model.emits[layout.symbols[a : a + width]]
        now /= now.max(axis=1, keepdims=True)
        if n:
            now[:] = now @ back
    found = np.empty_like(out)
    found[layout.order] = out
    return found


def _transfer(model: Model, segments: list[np.ndarray]) -> np.ndarray:
    """The matrix from the state before each segment's first symbol to that behind its last, up to a factor."""
    layout = _Layout(segments)
    k = len(model.start)
    now = np.broadcast_to(np.eye(k, dtype=model.emits.dtype), (len(segments), k, k)).copy()
    room, ones = np.empty((len(segments) * k, k), now.dtype), np.ones(k, now.dtype)
    for n, (a, width) in enumerate(layout.steps()):
        met = model.emits[layout.symbols[a : a + width]]
        met /= (met @ ones)[:, None]
        now[:width] *= met[:, None, :]
        np.matmul(now[:width].reshape(-1, k), model.moves, out=room[: width * k])
        now[:width] = room[: width * k].reshape(width, k, k)
        if n % 8 == 7:  # far from the least number
            now[:width] /= now[:width].sum(axis=(1, 2), keepdims=True)
    out = np.empty_like(now)
    out[layout.order] = now
    return out


def _groups(segments: list[np.ndarray]) -> Iterator[slice]:
    """Runs of segments with about GROUP symbols."""
    first, size = 0, 0
    for n, s in enumerate(segments):
        if size and size + len(s) > GROUP:
            yield slice(first, n)
            first, size = n, 0
        size += len(s)
    if segments:
        yield slice(first, len(segments))


class Batch:
    """Sequences, none of them empty, cut into segments, with the state before each segment and the backward vector behind it."""

    def __init__(self, model: Model, sequences: list[np.ndarray], backward: bool):
        self.model = model
        self.segments: list[np.ndarray] = []
        owner, first = [], []
        lengths = sorted((len(s) for s in sequences), reverse=True)
        segment = max(SEGMENT, lengths[WIDE - 1] if len(lengths) >= WIDE else 0)
        for n, s in enumerate(sequences):
            for a in range(0, len(s), segment):
                self.segments.append(s[a : a + segment])
                owner.append(n)
                first.append(a == 0)
        self.owner, self.first = np.array(owner, np.int64), np.array(first, bool)
        k, kind = len(model.start), model.emits.dtype
        self.into = np.tile(model.start.astype(kind), (len(owner), 1))
        self.end = np.ones((len(owner), k), kind)
        bounds = np.flatnonzero(self.first)
        self.counts = np.diff(np.append(bounds, len(owner)))
        many = [(int(b), int(c)) for b, c in zip(bounds, self.counts) if c > 1]
        if not many:
            return
        # Only segments between the first and the last need matrices.
        middle = [n for b, c in many for n in range(b + 1, b + c - 1)]
        matrix, pieces = np.empty((len(middle), k, k), kind), [self.segments[n] for n in middle]
        for part in _groups(pieces):
            matrix[part] = _transfer(model, pieces[part])
        place = np.zeros(len(owner), np.int64)
        place[middle] = np.arange(len(middle))
        heads, tails = np.array([b for b, _ in many]), np.array([b + c - 1 for b, c in many])
        pieces = [self.segments[n] for n in heads.tolist()]
        for part in _groups(pieces):
            layout = _Layout(pieces[part])
            alpha, _ = _forward(model, layout, self.into[heads[part]])
            self.into[heads[part][layout.order] + 1] = alpha[layout.last] @ model.moves
        for n in range(2, max(c for _, c in many)):
            at = np.array([b + n for b, c in many if c > n])
            vector = np.einsum("si,sij->sj", self.into[at - 1], matrix[place[at - 1]])
            self.into[at] = vector / vector.sum(axis=1, keepdims=True)
        if not backward:
            return
        behind = np.ones((len(owner), k), kind)
        pieces = [self.segments[n] for n in tails.tolist()]
        for part in _groups(pieces):
            behind[tails[part] - 1] = _values(model, pieces[part])
        for n in range(max(c for _, c in many) - 2, 0, -1):
            at = np.array([b + n for b, c in many if c > n + 1])
            vector = np.einsum("sij,sj->si", matrix[place[at]], behind[at])
            behind[at - 1] = vector / vector.sum(axis=1, keepdims=True)
        inner = np.concatenate([np.arange(b, b + c - 1) for b, c in many])
        self.end[inner] = behind[inner] @ model.moves.T

    def logs(self) -> np.ndarray:
        """The natural log of each sequence's likelihood."""
        out = np.zeros(int(self.owner[-1]) + 1 if len(self.owner) else 0)
        for part in _groups(self.segments):
            layout = _Layout(self.segments[part])
            _, scale = _forward(self.model, layout, self.into[part])
            own = self.owner[part][layout.order]
            out += np.bincount(own[layout.row], np.log(scale, dtype=np.float64), len(out))
        return out

    def count(self, counts: Counts) -> None:
        """Adds the expected counts of all sequences."""
        moves = self.model.moves
        k = len(moves)
        ends, starts = np.empty_like(self.end), np.empty_like(self.end)
        for part in _groups(self.segments):
            layout = _Layout(self.segments[part])
            alpha, scale = _forward(self.model, layout, self.into[part])
            last = alpha[layout.last]
            end = self.end[part]
            # So scaled that forward times backward sums to one at each symbol.
            end[layout.order] /= (last * end[layout.order]).sum(axis=1, keepdims=True)
            beta, met = _backward(self.model, layout, scale, end)
            own_ends, own_starts = ends[part], starts[part]
            own_ends[layout.order], own_starts[layout.order] = last, met[: len(layout.lengths)]
            later = layout.begin[1] if len(layout.begin) > 1 else 0
            before = np.arange(later, len(alpha)) - np.repeat(layout.width[:-1], layout.width[1:])
            counts.moves += moves * (alpha[before].T @ met[later:])
            alpha *= beta
            counts.start += alpha[: len(layout.lengths)][self.first[part][layout.order]].sum(axis=0)
            for j, share in enumerate(alpha.T):
                counts.emits[:, j] += np.bincount(layout.symbols, share, len(counts.emits))
            counts.log += float(np.log(scale, dtype=np.float64).sum())
        inner = np.flatnonzero(~self.first)
        if len(inner):
            counts.moves += moves * (ends[inner - 1].T @ starts[inner])


def batches(sequences: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Runs of sequences with about GROUP symbols; a longer sequence is a run of its own."""
    run, size = [], 0
    for s in sequences:
        if run and size + len(s) > GROUP:
            yield run
            run, size = [], 0
        run.append(s)
        size += len(s)
    if run:
        yield run
