"""PNG files and shards of samples."""

from __future__ import annotations

import io
import struct
import tarfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _rows(rgba: np.ndarray) -> bytes:
    h, w, _ = rgba.shape
    return zlib.compress(np.concatenate([np.zeros((h, 1), np.uint8), rgba.astype(np.uint8).reshape(h, w * 4)], axis=1).tobytes(), 6)


def _head(rgba: np.ndarray) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", rgba.shape[1], rgba.shape[0], 8, 6, 0, 0, 0))


def png(rgba: np.ndarray) -> bytes:
    """An RGBA image (rows, columns, 4) of bytes as PNG."""
    return _head(rgba) + _chunk(b"IDAT", _rows(rgba)) + _chunk(b"IEND", b"")


def even(rgba: np.ndarray) -> np.ndarray:
    """The image with even sides, its last row and column repeated."""
    return np.pad(rgba, ((0, rgba.shape[0] % 2), (0, rgba.shape[1] % 2), (0, 0)), mode="edge")


def side_by_side(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return even(np.concatenate([left, right], axis=1))


def packed(rgba: np.ndarray) -> bytes:
    """The compressed rows of an image of even sides, as animation() takes them."""
    return _rows(even(rgba))


def animation(rows: list[bytes], shape: tuple[int, int], millis: int) -> bytes:
    """Images of one shape, each as packed() has it, as an animated PNG that loops; a viewer without animation shows the first."""
    h, w = (n + n % 2 for n in shape)
    out = [_head(np.empty((h, w, 0))), _chunk(b"acTL", struct.pack(">II", len(rows), 0))]
    serial = 0
    for n, body in enumerate(rows):
        out.append(_chunk(b"fcTL", struct.pack(">IIIIIHHBB", serial, w, h, 0, 0, millis, 1000, 0, 0)))
        serial += 1
        if n:
            out.append(_chunk(b"fdAT", struct.pack(">I", serial) + body))
            serial += 1
        else:
            out.append(_chunk(b"IDAT", body))
    return b"".join([*out, _chunk(b"IEND", b"")])


def read_animation(raw: bytes) -> Iterator[np.ndarray]:
    """The images of animation(), one after the other."""
    at, shape = 8, None
    while at < len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", raw, at + 8)[::-1]
        elif kind in (b"IDAT", b"fdAT"):
            body = raw[at + 8 + 4 * (kind == b"fdAT") : at + 8 + size]
            yield np.frombuffer(zlib.decompress(body), np.uint8).reshape(shape[0], -1)[:, 1:].reshape(*shape, 4)
        at += 12 + size


def mapped(colored: DataFrame, side: int, of: Callable[[list[int], np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The batches that of(ks, images) gives for frames of rows (k, c: array of struct r, g, b, a): images is a stack (n, side, side, 4)
    of bytes, put together from the buffers of four columns, so that no pixel is an object of its own."""
    channel = lambda n: F.transform("c", lambda p: p[n]).alias(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                planes = [batch[n].flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(-1, side, side) for n in "rgba"]
                yield from of(batch["k"].to_pylist(), np.stack(planes, axis=-1))

    return colored.select("k", *[channel(n) for n in "rgba"]).mapInArrow(run, schema)


def render(colored: DataFrame, side: int) -> DataFrame:
    """k and a PNG for each frame of rows (k, c: array of struct r, g, b, a)."""
    def of(ks: list[int], images: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array([png(i) for i in images], pa.binary())], names=["k", "png"])

    return mapped(colored, side, of, "k long, png binary")


def tar_shard(samples: list[tuple[str, dict[str, bytes]]]) -> bytes:
    """A tar of <key>.<extension> members."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for key, parts in samples:
            for extension, body in parts.items():
                info = tarfile.TarInfo(f"{key}.{extension}")
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
    return out.getvalue()


def read_tar(raw: bytes) -> list[tuple[str, dict[str, bytes]]]:
    """Members grouped by the name before the first dot, in order of the keys."""
    found: dict[str, dict[str, bytes]] = {}
    with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
        for member in tar:
            if member.isfile():
                key, _, extension = member.name.partition(".")
                found.setdefault(key, {})[extension] = tar.extractfile(member).read()
    return sorted(found.items())


def npz(**arrays: np.ndarray) -> bytes:
    """Named arrays as one file of numpy's format."""
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def read_npz(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as f:
        return dict(f)


def write_shards(samples: DataFrame, most: int, extension: str = "bin") -> DataFrame:
    """shard, name, n and the tar of at most `most` samples (n ordinal, key, body binary) each; a group is bounded by `most`."""
    def run(group):
        rows = sorted(zip(group["key"], group["body"]))
        shard = int(group["shard"].iloc[0])
        return pd.DataFrame({"shard": [shard], "name": [f"shard-{shard:06d}.tar"], "n": [len(rows)], "content": [tar_shard([(k, {extension: b}) for k, b in rows])]})
    placed = samples.withColumn("shard", F.floor(F.col("n") / most).cast("long"))
    return placed.groupBy("shard").applyInPandas(run, "shard long, name string, n long, content binary")
