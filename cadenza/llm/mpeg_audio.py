"""MPEG audio in binary columns: frame headers with resynchronisation, tags, VBR tables, checksums, durations, seek offsets.

The writer carries a payload losslessly in Layer III frames: the side information says that a frame holds no coded
audio, and the bytes behind it, which decoders skip as ancillary data, hold a count and so many units of 64 bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common

# Fixed values of the MPEG audio standard: kbit/s by bitrate index (0 is free format), Hz by sample rate index.
_V1_L1 = [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448]
_V1_L2 = [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384]
_V1_L3 = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
_V2_L1 = [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256]
_V2_L23 = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
_VERSIONS = {3: "1", 2: "2", 0: "2.5"}

UNIT = 64
#: Units that the largest frame of the writer (320 kbit/s at 48 kHz, 960 bytes) holds beside 24 bytes of header.
_MOST_UNITS = 14
_HEAD = 4 + 2 + 17 + 1


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(4096)
def read_header(word: bytes) -> Header | None:
    """The header in four bytes, or None if they are none (free format counts as none)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    bit_index, rate_index, padding = word[2] >> 4, word[2] >> 2 & 3, word[2] >> 1 & 1
    if version == 1 or layer == 4 or bit_index in (0, 15) or rate_index == 3:
        return None
    if version == 3:
        kbit = (_V1_L1, _V1_L2, _V1_L3)[layer - 1][bit_index]
    else:
        kbit = (_V2_L1 if layer == 1 else _V2_L23)[bit_index]
    rate = _RATES[version][rate_index]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    if layer == 1:
        size = (12000 * kbit // rate + padding) * 4
    else:
        size = samples // 8 * kbit * 1000 // rate + padding
    return Header(version, layer, not word[1] & 1, kbit, rate, word[3] >> 6 == 3, size, samples)


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 0x8005, from 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass
class Audio:
    """What a stream holds. Without a frame: no header, no samples."""

    first: Header | None = None
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    bitrates: set[int] = field(default_factory=set)
    skipped: int = 0
    checked: int = 0
    failed: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: str | None = None
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes | None = None

    @property
    def seconds(self) -> float:
        return self.samples / self.first.rate if self.first else 0.0


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _text(raw: bytes) -> str:
    if not raw:
        return ""
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0])
    return (raw[1:].decode(kind, "replace") if kind else raw.decode("latin-1")).rstrip("\0").strip()


def _read_id3v2(data: bytes, audio: Audio) -> int:
    """Reads a leading ID3v2 tag's text frames and returns where the audio begins."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    major, end = data[3], min(len(data), 10 + _syncsafe(data[6:10]))
    at = 10
    if data[5] & 0x40 and major >= 3 and end >= at + 4:
        at += _syncsafe(data[at : at + 4]) if major == 4 else 4 + int.from_bytes(data[at : at + 4], "big")
    head, n = (6, 3) if major == 2 else (10, 4)
    while at + head <= end and data[at]:
        name = data[at : at + n].decode("latin-1")
        size = _syncsafe(data[at + 4 : at + 8]) if major == 4 else int.from_bytes(data[at + n : at + n + (3 if n == 3 else 4)], "big")
        if name[0] == "T":
            audio.tags.setdefault(name, _text(data[at + head : min(end, at + head + size)]))
        at += head + size
    return end + (10 if data[5] & 0x10 else 0)


def _read_table(data: bytes, at: int, head: Header, audio: Audio) -> bool:
    """Whether the frame at `at` holds a Xing, Info or VBRI table instead of audio."""
    tag = at + 4 + 2 * head.protected + head.side
    if data[tag : tag + 4] in (b"Xing", b"Info"):
        audio.table = data[tag : tag + 4].decode()
        flags, at = int.from_bytes(data[tag + 4 : tag + 8], "big"), tag + 8
        if flags & 1:
            audio.table_frames, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if flags & 2:
            audio.table_bytes, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if flags & 4:
            audio.toc = data[at : at + 100]
        return True
    tag = at + 36
    if data[tag : tag + 4] == b"VBRI":
        audio.table = "VBRI"
        audio.table_bytes = int.from_bytes(data[tag + 10 : tag + 14], "big")
        audio.table_frames = int.from_bytes(data[tag + 14 : tag + 18], "big")
        return True
    return False


def parse(data: bytes) -> Audio:
    """Walks the frames. Where none begins, the next place is taken at which a header is followed by a like one or the end.

    The last 128 bytes are an ID3v1 tag if they begin with 'TAG' and no frame that follows another reaches through them to the end."""
    audio = Audio()
    at, end = _read_id3v2(data, audio), len(data)
    last = end - 128
    if last < at or data[last : last + 3] != b"TAG":
        _walk(data, at, end, audio)
        return audio
    tagged = Audio(tags=dict(audio.tags))
    if _walk(data, at, end, audio):
        return audio
    _walk(data, at, last, tagged)
    for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97)):
        if value := data[last + a : last + b].split(b"\0")[0].decode("latin-1").strip():
            tagged.tags.setdefault(name, value)
    return tagged


def _walk(data: bytes, at: int, end: int, audio: Audio) -> bool:
    """Reads the frames from `at` to `end`; whether the last 128 bytes are all in frames, of which each begins where another ends."""
    last, through = end - 128, False
    synced = False
    while at + 4 <= end:
        head = read_header(data[at : at + 4])
        ok = head is not None and at + head.size <= end
        if ok and not synced:
            then = at + head.size
            after = read_header(data[then : then + 4])
            ok = then == end or after is not None and (after.version, after.layer, after.rate) == (head.version, head.layer, head.rate)
        if not ok:
            synced = through = False
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            audio.skipped += found - at
            at = found
            continue
        through |= at <= last
        synced = True
        if audio.first is None:
            audio.first = head
            if _read_table(data, at, head, audio):
                at += head.size
                continue
        if head.protected and head.layer == 3:
            audio.checked += 1
            covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + head.side]
            audio.failed += crc16(covered) != int.from_bytes(data[at + 4 : at + 6], "big")
        audio.offsets.append(at)
        audio.samples += head.samples
        audio.bitrates.add(head.bitrate)
        at += head.size
    audio.skipped += max(0, end - at)
    return through and at == end


def _frame(units: int) -> bytes:
    """The smallest mono 48 kHz frame for so many units, filled with zeros but for header, checksum and count."""
    for index in range(1, 15):
        size = 144 * _V1_L3[index] // 48
        if size >= _HEAD + UNIT * units:
            head = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
            crc = crc16(head[2:] + bytes(17))
            return (head + crc.to_bytes(2, "big") + bytes(17) + bytes([units])).ljust(size, b"\0")
    raise ValueError(units)


_FRAMES = {n: _frame(n) for n in range(1, _MOST_UNITS + 1)}
_TAG = (lambda body: b"ID3\x03\0\0" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + body)(b"TSSE" + (8).to_bytes(4, "big") + b"\0\0\0cadenza")


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of UNIT."""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\0")


def write(payload: bytes) -> bytes:
    """A stream that carries a payload of whole units: a tag, a frame with a Xing table, the frames."""
    units = len(payload) // UNIT
    full, rest = divmod(units, _MOST_UNITS)
    body = np.tile(np.frombuffer(_FRAMES[_MOST_UNITS], np.uint8), (full, 1))
    size, cut = body.shape[1], full * _MOST_UNITS * UNIT
    body[:, _HEAD : _HEAD + _MOST_UNITS * UNIT] = np.frombuffer(payload[:cut], np.uint8).reshape(full, _MOST_UNITS * UNIT)
    last = b""
    if rest:
        last = bytearray(_FRAMES[rest])
        last[_HEAD : _HEAD + rest * UNIT] = payload[cut:]
    frames, total = full + bool(rest), full * size + len(last)
    first = bytes([0xFF, 0xFB, 5 << 4 | 1 << 2, 0xC0]) + bytes(17)
    first_size = 144 * _V1_L3[5] // 48
    whole = total + first_size
    toc = bytes(min(255, (first_size + min(total, frames * i // 100 * size)) * 256 // whole) for i in range(100))
    first += b"Xing" + (7).to_bytes(4, "big") + frames.to_bytes(4, "big") + whole.to_bytes(4, "big") + toc
    return _TAG + first.ljust(first_size, b"\0") + body.tobytes() + bytes(last)


def payload_of(data: bytes, audio: Audio) -> bytes:
    """The payload that write() has put into the frames."""
    return b"".join([data[at + _HEAD : at + _HEAD + data[at + _HEAD - 1] * UNIT] for at in audio.offsets])


_SCHEMA = pa.schema([
    ("version", pa.string()), ("layer", pa.int32()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("n_frames", pa.int64()),
    ("n_samples", pa.int64()), ("seconds", pa.float64()), ("bitrate_mode", pa.string()), ("crc_checked", pa.int64()),
    ("crc_failed", pa.int64()), ("skipped_bytes", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("vbr_table", pa.string()),
    ("vbr_frames", pa.int64()), ("vbr_bytes", pa.int64()), ("seek_offsets", pa.list_(pa.int64())),
])
_DDL = (
    "version string, layer int, sample_rate int, channels int, n_frames long, n_samples long, seconds double, bitrate_mode string, "
    "crc_checked long, crc_failed long, skipped_bytes long, tags map<string,string>, vbr_table string, vbr_frames long, "
    "vbr_bytes long, seek_offsets array<long>"
)


def _row(data: bytes | None) -> dict:
    a = parse(data or b"")
    h = a.first
    return {
        "version": _VERSIONS[h.version] if h else None, "layer": h.layer if h else None, "sample_rate": h.rate if h else None,
        "channels": (1 if h.mono else 2) if h else None, "n_frames": len(a.offsets), "n_samples": a.samples, "seconds": a.seconds,
        "bitrate_mode": None if not h else "vbr" if len(a.bitrates) > 1 or a.table in ("Xing", "VBRI") else "cbr",
        "crc_checked": a.checked, "crc_failed": a.failed, "skipped_bytes": a.skipped, "tags": list(a.tags.items()), "vbr_table": a.table,
        "vbr_frames": a.table_frames, "vbr_bytes": a.table_bytes, "seek_offsets": a.offsets,
    }


def audio_columns(df: DataFrame, key: str, media: str) -> DataFrame:
    """`key` and what parse() finds in the binary column `media` of each row; null and bytes without a frame give no frames."""
    common.tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_pylist([_row(x) for x in batch.column(1).to_pylist()], _SCHEMA).combine_chunks()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(c.combine_chunks() for c in found.columns)], names=[batch.schema.names[0], *_SCHEMA.names])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(key, media).mapInArrow(run, f"`{key}` {kind}, {_DDL}")


def store_texts(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) as MPEG audio in the shared folder: doc_id, n_bytes, media."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write(pad(t)) for t in texts], pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.materialize(own.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores the texts of `docs` (doc_id long, text string) as MPEG audio, reads them back and describes them.

    One row per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    A null or empty text has a payload of 64 zero bytes. Nothing of the stored form depends on more than the text.
    Rows that repeat a doc_id are separate. An empty table gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for data in batch.column(2).to_pylist():
                audio = parse(data)
                payload = payload_of(data, audio)
                seek = zlib.crc32(np.array(audio.offsets, "<u8").tobytes())
                feature = (
                    f"mpeg{_VERSIONS[audio.first.version]}-layer{audio.first.layer};hz={audio.first.rate};frames={len(audio.offsets)};"
                    f"samples={audio.samples};seconds={audio.seconds:.6f};table={audio.table}:{audio.table_frames}:{audio.table_bytes};"
                    f"crc={audio.checked - audio.failed}/{audio.checked};skipped={audio.skipped};seek={seek:08x}"
                )
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["doc_id", "n_bytes", *names])

    return store_texts(docs).mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
