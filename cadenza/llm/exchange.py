"""Golomb-coded fingerprint exchange.

Every sender (a partition of the input) sorts its distinct fingerprints, cuts them into the ranges of
their owners and sends each range as Rice-coded differences. An owner decodes what it has received, finds
the fingerprints that occur more than once anywhere and answers each sender with a bitmap, one bit for
each fingerprint in the order sent. A fingerprint shared by a third of all rows costs each sender one code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SENT_FIELDS = "sender long, owner int, n int, k int, code binary, repeated binary"


def rice_encode(values: np.ndarray, universe: int) -> tuple[int, bytes]:
    """Ascending distinct values below `universe` as (k, code): k-bit remainders, then unary quotients, of the differences."""
    n = len(values)
    if not n:
        return 0, b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, universe * 0.69 / n))))
    low = gaps & np.uint64((1 << k) - 1)
    high = (gaps >> np.uint64(k)).astype(np.int64)
    ones = np.cumsum(high + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1, np.uint8)
    unary[ones] = 1
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    bits = ((low[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    return k, np.packbits(np.concatenate([bits, unary])).tobytes()


def rice_decode(n: int, k: int, code: bytes) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    low = np.zeros(n, np.uint64)
    table = bits[: n * k].reshape(n, k)
    for j in range(k):
        low = (low << np.uint64(1)) | table[:, j].astype(np.uint64)
    ones = np.flatnonzero(bits[n * k :])[:n]
    high = np.diff(ones, prepend=-1) - 1
    return np.cumsum((high.astype(np.uint64) << np.uint64(k)) | low, dtype=np.uint64)


def edges(owners: int, bits: int) -> list[int]:
    """Where the owners' ranges begin: owner o has the fingerprints from o * 2**bits / owners on, so that each part is a run."""
    return [(o << bits) // owners for o in range(owners)]


def pack(sender: int, values: np.ndarray, counts: np.ndarray, owners: int, bits: int) -> Iterator[tuple]:
    """Rows of SENT_FIELDS for ascending distinct fingerprints below 2**bits; counts over 1 are repeats within the sender."""
    begins = [*edges(owners, bits), 1 << bits]
    cuts = np.searchsorted(values, np.array(begins[:-1], np.uint64)).tolist() + [len(values)]
    for o in range(owners):
        a, b = cuts[o], cuts[o + 1]
        if b > a:
            base = begins[o]
            k, code = rice_encode(values[a:b] - np.uint64(base), begins[o + 1] - base)
            yield sender, o, b - a, k, code, np.packbits(counts[a:b] > 1).tobytes()


def owner_of(values: np.ndarray, owners: int, bits: int) -> np.ndarray:
    return np.searchsorted(np.array(edges(owners, bits), np.uint64), values, "right") - 1


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    lists = [rice_decode(n, k, c) for n, k, c in zip(group["n"], group["k"], group["code"])]
    local = [np.unpackbits(np.frombuffer(r, np.uint8))[:n].astype(bool) for n, r in zip(group["n"], group["repeated"])]
    every = np.concatenate(lists)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    fresh = np.ones(len(ranked), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(fresh)
    times = np.diff(np.append(starts, len(ranked)))
    often = times > 1
    often |= np.logical_or.reduceat(np.concatenate(local)[order], starts)
    flags = np.zeros(len(every), bool)
    flags[order] = np.repeat(often, times)
    ends = np.cumsum([len(x) for x in lists])
    return pd.DataFrame({
        "sender": group["sender"].to_numpy(),
        "owner": group["owner"].to_numpy(),
        "n": group["n"].to_numpy(),
        "bitmap": [np.packbits(flags[e - len(x) : e]).tobytes() for e, x in zip(ends.tolist(), lists)],
    })


def answers(sent: DataFrame) -> DataFrame:
    """(sender, owner, n, bitmap) for the rows of SENT_FIELDS, with a bit for each of their n fingerprints: whether it is repeated anywhere.

    An owner holds the codes of its range only: with R rows and O owners about R / O fingerprints."""
    return sent.groupBy("owner").applyInPandas(_answer, "sender long, owner int, n int, bitmap binary")
