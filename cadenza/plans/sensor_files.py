"""Writers of sensor files in the formats that the sources read; queries and tests make their files with them."""

from __future__ import annotations

import bz2
import struct
import zlib

import numpy as np

_NOWHERE = b"\xff" * 8


def _pack(fmt: str, *values) -> bytes:
    return struct.pack("<" + fmt, *values)


def _even(raw: bytes, n: int = 8) -> bytes:
    return raw + bytes(-len(raw) % n)


def _type(value) -> bytes:
    """The datatype of an array or of text, of the first version."""
    if isinstance(value, str):
        return bytes([0x13, 0, 0, 0]) + _pack("I", len(value.encode()) + 1)
    kind, size = value.dtype.kind, value.dtype.itemsize
    big = int(value.dtype.str[0] == ">")
    if kind in "iu":
        return bytes([0x10, big | 8 * (kind == "i"), 0, 0]) + _pack("IHH", size, 0, 8 * size)
    sign, place, bits, mantissa, bias = {4: (31, 23, 8, 23, 127), 8: (63, 52, 11, 52, 1023)}[size]
    return bytes([0x11, 0x20 | big, sign, 0]) + _pack("IHHBBBBI", size, 0, 8 * size, place, bits, 0, mantissa, bias)


def _space(shape: tuple[int, ...], new: bool) -> bytes:
    head = bytes([2, len(shape), 0, int(bool(shape))]) if new else bytes([1, len(shape), 0, 0]) + bytes(4)
    return head + b"".join(_pack("Q", n) for n in shape)


def _attribute(name: str, value, new: bool) -> bytes:
    raw = name.encode() + b"\0"
    if isinstance(value, str):
        body, shape = value.encode() + b"\0", ()
    else:
        value = np.asarray(value)
        body, shape = value.tobytes(), value.shape
    kind, space = _type(value), _space(shape, new)
    if new:
        return bytes([3, 0]) + _pack("HHH", len(raw), len(kind), len(space)) + b"\0" + raw + kind + space + body
    return bytes([1, 0]) + _pack("HHH", len(raw), len(kind), len(space)) + _even(raw) + _even(kind) + _even(space) + body


class Hdf5Writer:
    """An HDF5 file of arrays in the root group: with old groups and headers (version 1), or new ones whose links and attributes are in
    the headers or, with `dense`, in heaps."""

    def __init__(self, new: bool = False, dense: bool = False):
        self.new, self.dense = new or dense, dense
        self.raw = bytearray(48 if self.new else 96)
        self.links: list[tuple[str, int]] = []

    def put(self, body: bytes) -> int:
        self.raw += bytes(-len(self.raw) % 8)
        self.raw += body
        return len(self.raw) - len(body)

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        if self.new:
            body = b"".join(bytes([kind]) + _pack("HB", len(m), 0) + m for kind, m in messages)
            return self.put(b"OHDR" + bytes([2, 2]) + _pack("I", len(body)) + body + bytes(4))
        # The second half of the messages stands in a continuation.
        parts = [_pack("HHBxxx", kind, len(_even(m)), 0) + _even(m) for kind, m in messages]
        more = b"".join(parts[len(parts) // 2 :])
        at = self.put(more)
        first = b"".join(parts[: len(parts) // 2]) + _pack("HHBxxx", 16, 16, 0) + _pack("QQ", at, len(more))
        return self.put(bytes([1, 0]) + _pack("HII", len(parts) + 1, 1, len(first)) + bytes(4) + first)

    def heap(self, objects: list[bytes], record: int) -> tuple[int, int]:
        """A fractal heap of one block and the B-tree of its objects; the addresses of both."""
        offsets, block = [], bytearray(b"FHDB\0" + bytes(8) + bytes(4))
        for o in objects:
            offsets.append(len(block))
            block += o
        size = max(512, 1 << (len(block) - 1).bit_length())
        root = self.put(bytes(block) + bytes(size - len(block)))
        heap = self.put(b"FRHP\0" + _pack("HHBI", 8 if record == 8 else 7, 0, 0, 4096) + bytes(8 * 12) + _pack("HQQHHQH", 4, size, max(65536, size), 32, 1, root, 0) + bytes(4))
        rows = []
        for offset, o in zip(offsets, objects):
            name = b"\0" + _pack("I", offset) + _pack("H", len(o))
            rows.append(name + b"\0" + bytes(9) if record == 8 else bytes(4) + name)
        each = len(rows[0])
        leaf = self.put(b"BTLF\0" + bytes([record]) + b"".join(rows) + bytes(512))
        tree = self.put(b"BTHD\0" + bytes([record]) + _pack("IHHBBQHQ", 16 + each * len(rows), each, 0, 100, 40, leaf, len(rows), len(rows)) + bytes(4))
        return heap, tree

    def attributes(self, attrs: dict) -> list[tuple[int, bytes]]:
        bodies = [_attribute(k, v, self.new) for k, v in attrs.items()]
        if self.dense and bodies:
            heap, tree = self.heap(bodies, 8)
            return [(21, bytes([0, 0]) + _pack("QQ", heap, tree))]
        return [(12, b) for b in bodies]

    def add(self, name: str, array: np.ndarray, attrs: dict | None = None, chunks: tuple[int, ...] | None = None, shuffle: bool = True, checksum: bool = False, skip: tuple = ()) -> None:
        """An array, whole or in chunks (deflated, shuffled, with a checksum); chunks whose offset is in `skip` are not stored."""
        array = np.asarray(array)
        size = array.dtype.itemsize
        messages = [(1, _space(array.shape, self.new)), (3, _type(array))]
        if chunks:
            entries, filters = [], [*([2] if shuffle else []), 1, *([3] if checksum else [])]
            for index in np.ndindex(*[-(-n // c) for n, c in zip(array.shape, chunks)]):
                offset = tuple(i * c for i, c in zip(index, chunks))
                if offset in skip:
                    continue
                block = np.zeros(chunks, array.dtype)
                part = array[tuple(slice(o, o + c) for o, c in zip(offset, chunks))]
                block[tuple(slice(0, n) for n in part.shape)] = part
                body = block.tobytes()
                if shuffle:
                    body = np.frombuffer(body, np.uint8).reshape(-1, size).T.tobytes()
                body = zlib.compress(body) + bytes(4 * checksum)
                entries.append((offset, self.put(body), len(body)))
            # Leaves of three chunks under one node.
            key = lambda offset, length: _pack("II", length, 0) + b"".join(_pack("Q", o) for o in (*offset, 0))
            end = key(array.shape, 0)
            leaves = []
            for k in range(0, len(entries), 3):
                part = entries[k : k + 3]
                leaves.append((part[0][0], self.put(b"TREE\1\0" + _pack("H", len(part)) + _NOWHERE * 2 + b"".join(key(o, n) + _pack("Q", at) for o, at, n in part) + end)))
            tree = self.put(b"TREE\1\1" + _pack("H", len(leaves)) + _NOWHERE * 2 + b"".join(key(o, 0) + _pack("Q", at) for o, at in leaves) + end)
            one = lambda f: _pack("HHHH", f, 0, 0, 1) + _pack("II", size, 0) if not self.new else _pack("HHH", f, 0, 1) + _pack("I", size)
            messages += [(11, (bytes([2, len(filters)]) if self.new else bytes([1, len(filters)]) + bytes(6)) + b"".join(one(f) for f in filters))]
            messages += [(8, bytes([3, 2, array.ndim + 1]) + _pack("Q", tree) + b"".join(_pack("I", c) for c in (*chunks, size)))]
        else:
            messages += [(8, bytes([3, 1]) + _pack("QQ", self.put(array.tobytes()), array.nbytes))]
        if attrs and "_FillValue" in attrs:
            fill = np.asarray(attrs["_FillValue"], array.dtype).tobytes()
            messages += [(5, bytes([3, 32]) + _pack("I", len(fill)) + fill if self.new else bytes([2, 2, 2, 1]) + _pack("I", len(fill)) + fill)]
        self.links.append((name, self.header(messages + self.attributes(attrs or {}))))

    def done(self, attrs: dict | None = None) -> bytes:
        messages = self.attributes(attrs or {})
        link = lambda n, at: bytes([1, 0, len(n.encode())]) + n.encode() + _pack("Q", at)
        if self.dense:
            heap, tree = self.heap([link(n, at) for n, at in self.links], 5)
            messages.append((2, bytes([0, 0]) + _pack("QQ", heap, tree)))
        elif self.new:
            messages += [(6, link(n, at)) for n, at in self.links]
        else:
            names, offsets = bytearray(8), []
            for n, _ in sorted(self.links):
                offsets.append(len(names))
                names += _even(n.encode() + b"\0")
            data = self.put(bytes(names))
            heap = self.put(b"HEAP" + bytes(4) + _pack("QQQ", len(names), (1 << 64) - 1, data))
            nodes = [self.put(b"SNOD\1\0" + _pack("H", len(part)) + b"".join(_pack("QQII", o, at, 0, 0) + bytes(16) for o, (_, at) in part))
                     for part in (list(zip(offsets, sorted(self.links)))[k : k + 4] for k in range(0, len(self.links), 4))]
            tree = self.put(b"TREE\0\0" + _pack("H", len(nodes)) + _NOWHERE * 2 + bytes(8) + b"".join(_pack("QQ", at, 0) for at in nodes))
            messages.append((17, _pack("QQ", tree, heap)))
        root = self.header(messages)
        end = len(self.raw)
        if self.new:
            head = b"\x89HDF\r\n\x1a\n" + bytes([2, 8, 8, 0]) + _pack("QQQQ", 0, (1 << 64) - 1, end, root) + bytes(4)
        else:
            head = b"\x89HDF\r\n\x1a\n" + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + _pack("HHI", 4, 16, 0) + _pack("QQQQ", 0, (1 << 64) - 1, end, (1 << 64) - 1) + _pack("QQII", 0, root, 0, 0) + bytes(16)
        self.raw[: len(head)] = head
        return bytes(self.raw)


def segment_file(counts: np.ndarray, number: int, of: int, first_line: int, mjd: float, gain: float, constant: float, wavelength_um: float = 10.4073, correction: tuple = (0.0, 1.0, 0.0), packed: bool = False) -> bytes:
    """One segment of a frame of counts (16 bits) in the Himawari standard format, as little-endian blocks."""
    lines, cols = counts.shape
    block = lambda n, body, size: bytes([n]) + _pack("H", size) + body.ljust(size - 3, b"\0")
    data = counts.astype("<u2").tobytes()
    sizes = {1: 282, 2: 50, 3: 127, 4: 139, 5: 147, 6: 259, 7: 47, 8: 61, 9: 85, 10: 47, 11: 259}
    total = sum(sizes.values())
    bodies = {
        1: _pack("HB", 11, 0) + b"Himawari-9".ljust(16, b"\0") + b"MSC".ljust(16, b"\0") + b"FLDK" + b"  " + _pack("HdddII", 0, mjd, mjd, mjd, total, len(data)),
        2: _pack("HHHB", 16, cols, lines, 0),
        3: _pack("dIIffddddddd", 140.7, 20466275, 20466275, cols / 2 + 0.5, lines * of / 2 + 0.5, 42164.0, 6378.137, 6356.7523, 0.0066943844, 0.993305616, 1.006739501, 1737122264.0),
        5: _pack("HdHHHdd", 13, wavelength_um, 12, 65535, 65534, gain, constant) + _pack("ddddddddd", *correction, 0.0, 1.0, 0.0, 2.99792458e8, 6.62606957e-34, 1.3806488e-23),
        7: _pack("BBH", of, number, first_line),
    }
    raw = b"".join(block(n, bodies.get(n, b""), size) for n, size in sizes.items()) + data
    return bz2.compress(raw) if packed else raw


def mjd(time) -> float:
    """The modified Julian day of a time."""
    return (time - type(time)(1858, 11, 17)).total_seconds() / 86400


def radiance(bt: np.ndarray, wavelength_um: float = 10.4073) -> np.ndarray:
    """Spectral radiance (W / m2 sr um) of a black body."""
    h, c, k, w = 6.62606957e-34, 2.99792458e8, 1.3806488e-23, wavelength_um * 1e-6
    return 2 * h * c**2 / (w**5 * (np.exp(h * c / (k * w * bt)) - 1)) * 1e-6


