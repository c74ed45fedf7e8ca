"""Tile pyramids of frames as PNG files and as PMTiles archives."""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.grid import default_max_zoom
from cadenza.sources.images import mapped, png

# Fixed values of the archive format: length and layout of the header, tile types and compressions.
_HEADER, _PNG, _NONE, _GZIP = 127, 2, 1, 2


def read_png(raw: bytes) -> np.ndarray:
    """An image of images.png(): RGBA, rows without a filter."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, body, shape = 8, b"", None
    while at < len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        part = raw[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", raw, at + 8 + size)[0]:
            raise ValueError("a chunk's checksum is wrong")
        shape = struct.unpack_from(">II", part)[::-1] if kind == b"IHDR" else shape
        body += part if kind == b"IDAT" else b""
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(shape[0], -1)
    if rows[:, 0].any():
        raise ValueError("rows with a filter")
    return rows[:, 1:].reshape(*shape, 4)


def thumbnail(rgba: np.ndarray, longest: int) -> np.ndarray:
    """The image with its longer side at most `longest`, by the nearest pixels."""
    h, w = rgba.shape[:2]
    scale = max(1.0, max(h, w) / longest)
    return nearest(rgba, max(1, round(h / scale)), max(1, round(w / scale)))


def nearest(image: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """The image at another size: each pixel the one at its centre."""
    pick = lambda n, of: ((np.arange(n) + 0.5) * of / n).astype(int)
    return image[pick(rows, image.shape[0])][:, pick(cols, image.shape[1])]


def pyramid(image: np.ndarray, tile: int, min_zoom: int, max_zoom: int):
    """(z, x, y, tile) of the square pyramid over an image."""
    for z in range(min_zoom, max_zoom + 1):
        level = nearest(image, tile << z, tile << z)
        for x in range(1 << z):
            for y in range(1 << z):
                yield z, x, y, level[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile]


def cut_tiles(colored: DataFrame, side: int, tile: int, min_zoom: int = 0) -> DataFrame:
    """k, z, x, y and png of every tile of frames (k, c: array of struct r, g, b, a)."""
    top = default_max_zoom(side, side, tile)

    def of(ks: list[int], images: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, image in zip(ks, images):
            z, x, y, body = zip(*[(z, x, y, png(t)) for z, x, y, t in pyramid(image, tile, min_zoom, top)])
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(z), pa.int64()), *[pa.array(v, pa.int32()) for v in (z, x, y)], pa.array(body, pa.binary())], names=["k", "z", "x", "y", "png"])

    return mapped(colored, side, of, "k long, z int, x int, y int, png binary")


def tile_id(z: int, x: int, y: int) -> int:
    """Place of a tile: all tiles of lower zooms first, then along the Hilbert curve of its zoom."""
    place = (4**z - 1) // 3
    half = 1 << z >> 1
    while half:
        right, low = bool(x & half), bool(y & half)
        place += half * half * ((3 * right) ^ low)
        if not low:
            if right:
                x, y = half - 1 - x & half * 2 - 1, half - 1 - y & half * 2 - 1
            x, y = y, x
        x, y, half = x & half - 1, y & half - 1, half >> 1
    return place


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def archive(tiles: list[tuple[int, int, int, bytes]], bounds: tuple[float, float, float, float], metadata: dict) -> bytes:
    """A PMTiles archive (version 3) of PNG tiles (z, x, y, body) with one root directory; equal tiles in a row are stored once."""
    placed = sorted((tile_id(z, x, y), body) for z, x, y, body in tiles)
    entries, data, seen = [], bytearray(), {}
    for place, body in placed:
        at = seen.get(body)
        if at is None:
            at = seen[body] = len(data)
            data += body
        if entries and entries[-1][2:] == [at, len(body)] and entries[-1][0] + entries[-1][1] == place:
            entries[-1][1] += 1
        else:
            entries.append([place, 1, at, len(body)])
    listed, before = bytearray(_varint(len(entries))), 0
    for place, *_ in entries:
        listed += _varint(place - before)
        before = place
    for _, run, *_ in entries:
        listed += _varint(run)
    for *_, size in entries:
        listed += _varint(size)
    for n, (_, _, at, _) in enumerate(entries):
        follows = n and at == entries[n - 1][2] + entries[n - 1][3]
        listed += _varint(0 if follows else at + 1)
    root, meta = gzip.compress(bytes(listed), mtime=0), gzip.compress(json.dumps(metadata).encode(), mtime=0)
    zooms = [z for z, *_ in tiles]
    e7 = [int(v * 1e7) for v in (*bounds, (bounds[0] + bounds[2]) / 2, (bounds[1] + bounds[3]) / 2)]  # towards zero
    begin = _HEADER + len(root) + len(meta)
    header = b"PMTiles\x03" + struct.pack(
        "<QQQQQQQQQQQBBBBBBiiiiBii", _HEADER, len(root), _HEADER + len(root), len(meta), 0, 0, begin, len(data), len(placed), len(entries), len(seen),
        1, _GZIP, _NONE, _PNG, min(zooms), max(zooms), *e7[:4], min(zooms), *e7[4:])
    return header + root + meta + bytes(data)


def read_archive(raw: bytes) -> tuple[dict, dict[int, bytes]]:
    """The header's fields, and the body of each tile by its place."""
    if raw[:8] != b"PMTiles\x03":
        raise ValueError("no archive of version 3")
    v = struct.unpack_from("<QQQQQQQQQQQBBBBBBiiiiBii", raw, 8)
    names = ["root_at", "root_size", "meta_at", "meta_size", "leaf_at", "leaf_size", "data_at", "data_size", "n_tiles", "n_entries", "n_bodies", "clustered",
             "directory_compression", "tile_compression", "tile_type", "min_zoom", "max_zoom", "west_e7", "south_e7", "east_e7", "north_e7", "center_zoom", "center_lon_e7", "center_lat_e7"]
    head = dict(zip(names, v))
    listed, at = gzip.decompress(raw[head["root_at"] : head["root_at"] + head["root_size"]]), 0

    def take() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = listed[at]
            at += 1
            n |= (byte & 127) << shift
            if byte < 128:
                return n
            shift += 7

    n = take()
    places = np.cumsum([take() for _ in range(n)]).tolist()
    runs, sizes = [take() for _ in range(n)], [take() for _ in range(n)]
    out, offset = {}, 0
    for place, run, size in zip(places, runs, sizes):
        given = take()
        offset = given - 1 if given else offset
        for k in range(run):
            out[place + k] = raw[head["data_at"] + offset : head["data_at"] + offset + size]
        offset += size
    return head, out


def archives(tiles: DataFrame, bounds: tuple[float, float, float, float], metadata: dict) -> DataFrame:
    """k and the archive of each frame's tiles (k, z, x, y, png); a frame's pyramid is bounded by its size."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(group["z"], group["x"], group["y"], group["png"]))
        return pd.DataFrame({"k": [group["k"].iloc[0]], "content": [archive(rows, bounds, metadata)]})
    return tiles.groupBy("k").applyInPandas(run, "k long, content binary")


def colored(frames: DataFrame, of) -> DataFrame:
    """k and c, the colours `of` every pixel of bt."""
    return frames.select("k", F.transform("bt", of).alias("c"))
