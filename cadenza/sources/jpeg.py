"""Baseline JPEG images and motion JPEG: every frame stands alone, so tasks encode frames and videos are put together by offsets.

    encode_video(frames, folder)     # rows (video, k, jpeg) -> <folder>/<video>.avi

An image has its own Huffman codes, made from its own symbols. A video's frames get their places by prefix sums; parts of some frames
are written by tasks, and a task for each file copies its parts, one at a time, behind the header and in front of the index.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import sequence
from cadenza.sources.folders import get, put, store

#: Frames of a part; bytes of a file's frames, about, beyond which a further file begins (the index has 32-bit places).
PART, VOLUME = 64, 1 << 30


def zigzag() -> np.ndarray:
    """Places of the coefficients (row by row) in the order of their diagonals, which run up and down by turns."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([y * 8 + x for y, x in cells])


def steps(quality: int) -> np.ndarray:
    """Quantisation steps that grow with the frequency; quality from 1 to 100, at which all steps are one."""
    y, x = np.indices((8, 8))
    scale = (100 - min(max(quality, 1), 100)) / 25
    return np.clip(np.round(1 + scale * (1 + y + x)), 1, 255).astype(int)


_ZIGZAG = zigzag()
_COSINES = np.cos((2 * np.arange(8) + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]
#: Red, green and blue to brightness and two colour differences (ITU-R BT.601, as JFIF has it).
_TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168735892, -0.331264108, 0.5], [0.5, -0.418687589, -0.081312411]])


def _sizes(values: np.ndarray) -> np.ndarray:
    """Bits of each absolute value."""
    return np.ceil(np.log2(np.abs(values) + 1)).astype(int)


def code_lengths(counts: dict[int, int], most: int = 16) -> dict[int, int]:
    """Lengths of prefix codes of symbols, none longer than `most` and none all ones, which is kept free for a symbol that never comes."""
    heap = [(n, s, [s]) for s, n in [*counts.items(), (256, 0)]]
    heapq.heapify(heap)
    depth = dict.fromkeys([*counts, 256], 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    number = np.bincount(list(depth.values()), minlength=most + 1).tolist()
    for k in range(len(number) - 1, most, -1):
        while number[k]:  # two leaves of a level too deep: one goes up, the other beside a leaf that is split
            j = next(j for j in range(k - 2, 0, -1) if number[j])
            number[k] -= 2
            number[k - 1] += 1
            number[j + 1] += 2
            number[j] -= 1
    lengths = [k for k, n in enumerate(number) for _ in range(n)]
    order = sorted(depth, key=lambda s: (depth[s], s == 256, s))
    order = [s for s in order if s != 256] + [256]
    return {s: n for s, n in zip(order, lengths) if s != 256}


def codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(code, length) of each symbol: counted up through the lengths in the order of the symbols given."""
    out, code, last = {}, 0, 0
    for s, n in lengths.items():
        code <<= n - last
        out[s], last = (code, n), n
        code += 1
    return out


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, mark, len(body) + 2) + body


def _blocks(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)


def encode(rgb: np.ndarray, quality: int = 95) -> bytes:
    """An image (rows, columns, 3) of bytes, or (rows, columns) in grey, as a baseline JPEG without subsampling."""
    grey = rgb.ndim == 2
    h, w = rgb.shape[:2]
    wide = np.pad(rgb, [(0, -h % 8), (0, -w % 8)] + [(0, 0)] * (not grey), mode="edge").astype(float)
    planes = [wide - 128] if grey else [p + (0 if k else -128) for k, p in enumerate(np.moveaxis(wide @ _TO_YCC.T, -1, 0))]
    step = steps(quality)
    found = np.stack([np.rint(_COSINES @ _blocks(p) @ _COSINES.T / step).astype(int).reshape(-1, 64)[:, _ZIGZAG] for p in planes], axis=1)
    found[:, :, 0] = np.diff(found[:, :, 0], axis=0, prepend=0)
    flat = found.reshape(-1, 64)
    # Items of each block in order: the first coefficient, then for each other that is not zero the runs of sixteen zeros before it and itself, then the end.
    block, place = np.nonzero(flat[:, 1:])
    place += 1
    before = np.concatenate([[0], place[:-1]]) if len(place) else place
    before = np.where(np.concatenate([[True], block[1:] != block[:-1]]) if len(block) else np.zeros(0, bool), 0, before)
    run = place - before - 1
    value = flat[block, place]
    last = np.zeros(len(flat), int)
    np.maximum.at(last, block, place)
    ended = np.flatnonzero(last < 63)
    many = np.repeat(np.arange(len(run)), run // 16)
    order = np.concatenate([np.arange(len(flat)) * 256, block[many] * 256 + place[many] * 2, block * 256 + place * 2 + 1, ended * 256 + 255])
    symbol = np.concatenate([_sizes(flat[:, 0]), np.full(len(many), 0xF0), (run % 16) * 16 + _sizes(value), np.zeros(len(ended), int)])
    extra = np.concatenate([flat[:, 0], np.zeros(len(many), int), value, np.zeros(len(ended), int)])
    size = np.concatenate([_sizes(flat[:, 0]), np.zeros(len(many), int), _sizes(value), np.zeros(len(ended), int)])
    first = np.arange(len(order)) < len(flat)
    at = np.argsort(order, kind="stable")
    symbol, extra, size, first = symbol[at], extra[at], size[at], first[at]
    tables, code, length = [], np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64)
    for kind, own in ((0, first), (1, ~first)):
        names, counts = np.unique(symbol[own], return_counts=True)
        lengths = code_lengths(dict(zip(names.tolist(), counts.tolist())))
        tables.append(bytes([kind << 4]) + bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)) + bytes(lengths))
        table = codes(lengths)
        lookup = np.zeros((256, 2), np.int64)
        for s, pair in table.items():
            lookup[s] = pair
        code[own], length[own] = lookup[symbol[own], 0], lookup[symbol[own], 1]
    bits = np.where(extra < 0, extra + (1 << size) - 1, extra)
    whole, n = code << size | bits, length + size
    starts = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    stream = (whole[owner] >> (n[owner] - 1 - (np.arange(n.sum()) - starts[owner]))) & 1
    body = np.packbits(np.concatenate([stream, np.ones(-len(stream) % 8, np.int64)]).astype(np.uint8)).tobytes().replace(b"\xff", b"\xff\0")
    parts = len(planes)
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xDB, b"\0" + bytes(step.reshape(-1)[_ZIGZAG].tolist()))
    head += _segment(0xC0, struct.pack(">BHHB", 8, h, w, parts) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(parts)))
    head += b"".join(_segment(0xC4, t) for t in tables) + _segment(0xDA, bytes([parts]) + b"".join(bytes([k + 1, 0]) for k in range(parts)) + b"\0\x3f\0")
    return head + body + b"\xff\xd9"


def decode(raw: bytes) -> np.ndarray:
    """The image of a baseline JPEG without subsampling or restarts, as encode() makes them."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    at, tables, step, shape, parts = 2, {}, None, None, 0
    while True:
        mark, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            step = np.frombuffer(body, np.uint8, 64, 1).astype(int)
        elif mark == 0xC0:
            _, h, w, parts = struct.unpack_from(">BHHB", body)
            shape = (h, w)
        elif mark == 0xC4:
            lengths = dict(zip(body[17:], [k + 1 for k in range(16) for _ in range(body[1 + k])]))
            tables[body[0] >> 4] = {(n, code): s for s, (code, n) in codes(lengths).items()}
        elif mark == 0xDA:
            break
    bits = np.unpackbits(np.frombuffer(raw[at : raw.rindex(b"\xff\xd9")].replace(b"\xff\0", b"\xff"), np.uint8)).tolist()
    here = 0

    def symbol(kind: int) -> int:
        nonlocal here
        code = n = 0
        while (n, code) not in tables[kind]:
            code, n, here = code << 1 | bits[here], n + 1, here + 1
        return tables[kind][n, code]

    def number(size: int) -> int:
        nonlocal here
        v = 0
        for _ in range(size):
            v, here = v << 1 | bits[here], here + 1
        return v if not size or v >> size - 1 else v - (1 << size) + 1

    h, w = -(-shape[0] // 8), -(-shape[1] // 8)
    found = np.zeros((h * w, parts, 64), int)
    level = [0] * parts
    for n in range(h * w):
        for p in range(parts):
            level[p] += number(symbol(0))
            found[n, p, 0] = level[p]
            k = 1
            while k < 64:
                s = symbol(1)
                if not s:
                    break
                k += s >> 4
                found[n, p, k] = number(s & 15)
                k += 1
    plain = np.zeros_like(found)
    plain[:, :, _ZIGZAG] = found * step
    pixels = _COSINES.T @ plain.reshape(h, w, parts, 8, 8) @ _COSINES
    planes = pixels.transpose(2, 0, 3, 1, 4).reshape(parts, h * 8, w * 8)[:, : shape[0], : shape[1]]
    planes[0] += 128
    image = planes[0] if parts == 1 else np.moveaxis(planes, 0, -1) @ np.linalg.inv(_TO_YCC).T
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)


def size_of(raw: bytes) -> tuple[int, int]:
    """Rows and columns in a JPEG's header."""
    at = 2
    while raw[at + 1] not in (0xC0, 0xC1, 0xC2):
        at += 2 + struct.unpack_from(">H", raw, at + 2)[0]
    return struct.unpack_from(">HH", raw, at + 5)


def _list(kind: bytes, *chunks: bytes) -> bytes:
    body = kind + b"".join(chunks)
    return b"LIST" + struct.pack("<I", len(body)) + body


def _riff(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi_head(rows: int, cols: int, frames: int, n_bytes: int, millis: int) -> bytes:
    """All of a file in front of its frames, which have n_bytes with their own heads; an index of 16 bytes a frame follows them."""
    main = _riff(b"avih", struct.pack("<14I", millis * 1000, 0, 0, 0x10, frames, 0, 1, 0, cols, rows, 0, 0, 0, 0))
    stream = _riff(b"strh", b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, millis, 1000, 0, frames, 0, 0xFFFFFFFF, 0, 0, 0, cols, rows))
    form = _riff(b"strf", struct.pack("<IiiHH4sIiiII", 40, cols, rows, 1, 24, b"MJPG", rows * cols * 3, 0, 0, 0, 0))
    lists = _list(b"hdrl", main, _list(b"strl", stream, form))
    total = 4 + len(lists) + 12 + n_bytes + 8 + 16 * frames
    return b"RIFF" + struct.pack("<I", total) + b"AVI " + lists + b"LIST" + struct.pack("<I", 4 + n_bytes) + b"movi"


def read_avi(raw: bytes) -> list[bytes]:
    """The frames that a file's index names."""
    movi = raw.index(b"movi")
    at = raw.index(b"idx1", movi + 4 + struct.unpack_from("<I", raw, movi - 4)[0] - 4)
    n = struct.unpack_from("<I", raw, at + 4)[0] // 16
    entries = [struct.unpack_from("<4sIII", raw, at + 8 + 16 * k) for k in range(n)]
    out = []
    for name, _, place, size in entries:
        if raw[movi + place : movi + place + 4] != name:
            raise ValueError("an entry of the index names no frame")
        out.append(raw[movi + place + 8 : movi + place + 8 + size])
    return out


def encode_video(frames: DataFrame, folder: str, millis: int = 200) -> DataFrame:
    """Writes <folder>/<video>-<volume>.avi of frames (video string, k long, jpeg binary), in order of k; one row a file: path, n_frames, n_bytes.

    Frames of a video have one size, else it is an error. A video of more than VOLUME bytes has several files. Memory: a part of a file."""
    spark = frames.sparkSession
    written = f"{folder}/_frames"
    chunk = F.octet_length("jpeg") + F.octet_length("jpeg") % 2 + 8
    frames.select("video", F.col("k").cast("long").alias("k"), "jpeg", chunk.cast("long").alias("chunk")).write.mode("overwrite").parquet(written)
    stored = spark.read.parquet(written)
    places = sequence.prefix_sums(stored.select("video", "k", "chunk"), ["video", "k"], F.col("chunk"), "before")
    places = sequence.ordinals(places, ["video", "k"], "number")
    first = places.groupBy(F.col("video").alias("v")).agg(F.min("before").alias("first_byte"), F.min("number").alias("first_number"))
    placed = places.join(first, F.col("video") == F.col("v"))
    placed = placed.select("video", "k", F.floor((F.col("before") - F.col("first_byte")) / VOLUME).cast("int").alias("volume"), F.floor((F.col("number") - F.col("first_number")) / PART).cast("int").alias("part"))
    dealt = stored.join(placed.withColumnsRenamed({"video": "p_video", "k": "p_k"}), (F.col("video") == F.col("p_video")) & (F.col("k") == F.col("p_k")))
    dealt = dealt.select("video", "volume", "part", "k", "jpeg").repartition("video", "volume", "part").sortWithinPartitions("video", "volume", "part", "k")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes each part's frames as they stand in the file; a row with the sizes of its frames."""
        files, base = store(folder)
        key, run = None, []

        def flush() -> pa.RecordBatch:
            sizes = {size_of(j) for j in run}
            if len(sizes) > 1:
                raise ValueError(f"frames of several sizes in {key[0]}")
            path = f"{base}/_parts/{key[0]}/{key[1]:04d}-{key[2]:08d}"
            put(files, path, b"".join(_riff(b"00dc", j) for j in run))
            rows, cols = sizes.pop()
            return pa.RecordBatch.from_pylist([{"video": key[0], "volume": key[1], "part": key[2], "path": path, "rows": rows, "cols": cols, "sizes": [len(j) for j in run]}], schema)

        for batch in batches:
            for video, volume, part, jpeg in zip(*[batch[c].to_pylist() for c in ("video", "volume", "part", "jpeg")]):
                if run and (video, volume, part) != key:
                    yield flush()
                    run = []
                key = (video, volume, part)
                run.append(jpeg)
        if run:
            yield flush()

    schema = pa.schema([("video", pa.string()), ("volume", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("rows", pa.int32()), ("cols", pa.int32()), ("sizes", pa.list_(pa.int32()))])
    dealt.mapInArrow(parts, "video string, volume int, part int, path string, rows int, cols int, sizes array<int>").write.mode("overwrite").parquet(f"{folder}/_sizes")
    # A file's index is as long as its header says; its rows here are parts, not frames.
    listed = spark.read.parquet(f"{folder}/_sizes").groupBy("video", "volume").agg(
        F.array_sort(F.collect_list(F.struct("part", "path", "sizes"))).alias("parts"), F.min("rows").alias("rows"), F.max("rows").alias("most_rows"), F.min("cols").alias("cols"), F.max("cols").alias("most_cols"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["rows"] != row["most_rows"] or row["cols"] != row["most_cols"]:
                    raise ValueError(f"frames of several sizes in {row['video']}")
                sizes = [s for p in row["parts"] for s in p["sizes"]]
                starts = np.cumsum([0, *[s + s % 2 + 8 for s in sizes]]).tolist()
                path = f"{base}/{row['video']}-{row['volume']:03d}.avi"
                files.create_dir(base, recursive=True)
                with files.open_output_stream(f"{path}.part") as f:
                    f.write(avi_head(row["rows"], row["cols"], len(sizes), starts[-1], millis))
                    for p in row["parts"]:
                        f.write(get(files, p["path"]))
                    f.write(_riff(b"idx1", b"".join(struct.pack("<4sIII", b"00dc", 0x10, 4 + a, s) for a, s in zip(starts, sizes))))
                files.move(f"{path}.part", path)
                out.append({"path": path, "n_frames": len(sizes), "n_bytes": files.get_file_info(path).size})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("n_frames", pa.int64()), ("n_bytes", pa.int64())]))

    done = listed.repartition("video", "volume").mapInArrow(join, "path string, n_frames long, n_bytes long")
    done.write.mode("overwrite").parquet(f"{folder}/_files")
    files, base = store(folder)
    for rest in ("_frames", "_parts", "_sizes"):
        if files.get_file_info(f"{base}/{rest}").type != fs.FileType.NotFound:
            files.delete_dir(f"{base}/{rest}")
    return spark.read.schema("path string, n_frames long, n_bytes long").parquet(f"{folder}/_files")
