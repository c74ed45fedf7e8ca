"""HDF5 files read by byte ranges: the parts of the format that sensor files use (the public format specification, version 3).

    file = File(lambda offset, length: ...)
    band = file.datasets["IMG_TIR1"].rows(0, 512)

Superblocks 0 to 3; old groups (symbol tables) and new ones (links in the header or in a fractal heap); attributes in the header
or in a heap; integers, floats, enumerations and text; compact, contiguous and chunked layouts with a B-tree (version 1) or one
chunk; deflate, shuffle and Fletcher-32. A dataset reads the chunks that a request needs and no other bytes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format: signature, numbers of messages and filters, classes of types, the address of nothing.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
_SPACE, _LINK_INFO, _TYPE, _FILL, _LINK, _LAYOUT, _FILTERS, _ATTRIBUTE, _CONTINUED, _SYMBOLS, _ATTRIBUTE_INFO = 1, 2, 3, 5, 6, 8, 11, 12, 16, 17, 21
_DEFLATE, _SHUFFLE, _FLETCHER = 1, 2, 3
_FIXED, _FLOAT, _STRING, _ENUM, _VARIABLE = 0, 1, 3, 8, 9
_NOWHERE = (1 << 64) - 1
#: Bytes read at once where the length of a structure is not known yet.
AHEAD = 4096


class Unsupported(ValueError):
    """A part of the format that this reader does not know."""


@dataclass
class Kind:
    """A type: numpy's, or None for text of variable length."""

    size: int
    dtype: np.dtype | None
    text: bool = False


def _number(raw: bytes, at: int, size: int) -> int:
    return int.from_bytes(raw[at : at + size], "little")


def _kind(raw: bytes) -> Kind:
    number, bits, size = raw[0] & 15, _number(raw, 1, 3), _number(raw, 4, 4)
    order = ">" if bits & 1 else "<"
    if number == _FIXED:
        return Kind(size, np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}"))
    if number == _FLOAT:
        return Kind(size, np.dtype(f"{order}f{size}"))
    if number == _STRING:
        return Kind(size, np.dtype(f"S{size}"), True)
    if number == _ENUM:
        return Kind(size, _kind(raw[8:]).dtype)
    if number == _VARIABLE and bits & 15 == 1:
        return Kind(size, None, True)
    raise Unsupported(f"type class {number}")


def _shape(raw: bytes) -> tuple[int, ...]:
    version, rank = raw[0], raw[1]
    at = 8 if version == 1 else 4
    return tuple(_number(raw, at + 8 * k, 8) for k in range(rank))


@dataclass
class Dataset:
    """An array in a file; `data` reads all of it, `rows` those of its last axis but one."""

    file: File
    shape: tuple[int, ...]
    kind: Kind
    layout: bytes
    filters: list[int]
    attrs: dict = field(default_factory=dict)
    fill: bytes = b""
    #: Rows that `data` reads, by default all.
    window: tuple[int, int] | None = None

    @property
    def data(self) -> np.ndarray:
        return self.rows(*self.window) if self.window else self._read([(0, n) for n in self.shape])

    def rows(self, first: int, last: int) -> np.ndarray:
        """Rows of the last axis but one (of the only axis, if there is one), from `first` to before `last`."""
        bounds = [(0, n) for n in self.shape]
        bounds[-2 if len(bounds) > 1 else 0] = (first, last)
        return self._read(bounds)

    def _read(self, bounds: list[tuple[int, int]]) -> np.ndarray:
        if self.kind.dtype is None:
            raise Unsupported("an array of text of variable length")
        dtype, size = self.kind.dtype, self.kind.size
        out = np.zeros([b - a for a, b in bounds], dtype)
        if len(self.fill) == size:
            out[...] = np.frombuffer(self.fill, dtype)[0]
        raw = self.layout
        if raw[0] not in (3, 4):
            raise Unsupported(f"layout version {raw[0]}")
        if raw[1] == 0:  # in the header
            whole = np.frombuffer(raw, dtype, math.prod(self.shape), 4).reshape(self.shape)
            return whole[tuple(slice(a, b) for a, b in bounds)].copy()
        if raw[1] == 1:  # in one piece: the rows that are wanted lie together if only the first axis of more than one is bounded
            address = _number(raw, 2, 8)
            if address == _NOWHERE:
                return out
            axis = next((k for k, n in enumerate(self.shape) if n > 1), 0)
            whole = all(x == (0, n) for k, (x, n) in enumerate(zip(bounds, self.shape)) if k != axis)
            a, b = bounds[axis] if whole and self.shape else (0, self.shape[axis] if self.shape else 1)
            each = math.prod(self.shape[axis + 1 :]) if self.shape else 1
            piece = np.frombuffer(self.file.read(address + a * each * size, (b - a) * each * size), dtype)
            if whole:
                return piece.reshape(out.shape).copy()
            return piece.reshape(self.shape)[tuple(slice(x, y) for x, y in bounds)].copy()
        for offset, address, length, mask, chunk in self._chunks(bounds):
            block = np.frombuffer(self._plain(self.file.read(address, length), mask, math.prod(chunk) * size), dtype, math.prod(chunk)).reshape(chunk)
            lows = [max(a, o) for (a, _), o in zip(bounds, offset)]
            highs = [min(b, o + c) for (_, b), o, c in zip(bounds, offset, chunk)]
            if all(x < y for x, y in zip(lows, highs)):
                out[tuple(slice(x - a, y - a) for x, y, (a, _) in zip(lows, highs, bounds))] = block[tuple(slice(x - o, y - o) for x, y, o in zip(lows, highs, offset))]
        return out

    def _chunks(self, bounds: list[tuple[int, int]]) -> Iterator[tuple[tuple[int, ...], int, int, int, tuple[int, ...]]]:
        """Offset, address, stored length, filter mask and shape of each chunk that the bounds meet."""
        raw, rank = self.layout, len(self.shape)
        if raw[0] == 3:
            address, sizes = _number(raw, 3, 8), tuple(_number(raw, 11 + 4 * k, 4) for k in range(rank))
            if address != _NOWHERE:
                for offset, at, length, mask in self.file.chunk_tree(address, rank, bounds, sizes):
                    yield offset, at, length, mask, sizes
            return
        flags, width = raw[2], raw[4]
        sizes, at = tuple(_number(raw, 5 + width * k, width) for k in range(rank)), 5 + width * raw[3]
        if raw[at] != 1:
            raise Unsupported(f"chunk index {raw[at]}")
        plain = math.prod(sizes) * self.kind.size
        length, mask, at = (_number(raw, at + 1, 8), _number(raw, at + 9, 4), at + 13) if flags & 2 else (plain, 0, at + 1)
        if (address := _number(raw, at, 8)) != _NOWHERE:
            yield (0,) * rank, address, length, mask, sizes

    def _plain(self, raw: bytes, mask: int, length: int) -> bytes:
        """A chunk's bytes with its filters undone, the last first."""
        for k in range(len(self.filters) - 1, -1, -1):
            if mask >> k & 1:
                continue
            if self.filters[k] == _DEFLATE:
                raw = zlib.decompress(raw)
            elif self.filters[k] == _SHUFFLE:
                whole = len(raw) // self.kind.size * self.kind.size
                raw = np.frombuffer(raw, np.uint8, whole).reshape(self.kind.size, -1).T.tobytes() + raw[whole:]
            elif self.filters[k] == _FLETCHER:
                raw = raw[:-4]
            else:
                raise Unsupported(f"filter {self.filters[k]}")
        if len(raw) < length:
            raise ValueError(f"a chunk has {len(raw)} bytes of {length}")
        return raw


class File:
    """The datasets of a file by path, and the attributes of its root, read through read(offset, length)."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        head = read(0, 128)
        if head[:8] != SIGNATURE:
            raise ValueError("no HDF5 file")
        version = head[8]
        if version in (0, 1):
            at = 24 + 4 * version
            if head[13] != 8 or head[14] != 8:
                raise Unsupported("addresses of other than 8 bytes")
            root = _number(head, at + 32 + 8, 8)
        elif version in (2, 3):
            if head[9] != 8 or head[10] != 8:
                raise Unsupported("addresses of other than 8 bytes")
            root = _number(head, 36, 8)
        else:
            raise Unsupported(f"superblock version {version}")
        self.datasets: dict[str, Dataset] = {}
        self.attrs: dict = {}
        self._walk("", root, set())

    def _walk(self, path: str, address: int, seen: set[int]) -> None:
        if address in seen:
            return
        seen.add(address)
        messages = self._messages(address)
        by = {}
        for kind, body in messages:
            by.setdefault(kind, body)
        attrs = self._attributes(messages)
        if _LAYOUT in by and _TYPE in by and _SPACE in by:
            try:
                kind = _kind(by[_TYPE])
            except Unsupported:
                return
            self.datasets[path] = Dataset(self, _shape(by[_SPACE]), kind, by[_LAYOUT], _filters(by.get(_FILTERS)), attrs, _fill(by.get(_FILL)))
            return
        if not path:
            self.attrs = attrs
        for name, target in self._links(messages):
            self._walk(f"{path}/{name}" if path else name, target, seen)

    def _messages(self, address: int) -> list[tuple[int, bytes]]:
        """The messages of an object header, of either version, with those of its continuations."""
        raw = self.read(address, AHEAD)
        out: list[tuple[int, bytes]] = []
        if raw[:4] == b"OHDR":
            flags = raw[5]
            at = 6 + 16 * bool(flags & 32) + 4 * bool(flags & 16)
            width = 1 << (flags & 3)
            size, at = _number(raw, at, width), at + width
            blocks = [(address + at, size)]
            while blocks:
                begin, length = blocks.pop(0)
                body, at = self.read(begin, length), 0
                while at + 4 + 2 * bool(flags & 4) <= length:
                    kind, n, at = body[at], _number(body, at + 1, 2), at + 4 + 2 * bool(flags & 4)
                    self._keep(out, kind, body[at : at + n], blocks, 4)
                    at += n
            return out
        if raw[0] != 1:
            raise Unsupported(f"object header version {raw[0]}")
        blocks = [(address + 16, _number(raw, 8, 4))]
        while blocks:
            begin, length = blocks.pop(0)
            body, at = self.read(begin, length), 0
            while at + 8 <= length:
                kind, n = _number(body, at, 2), _number(body, at + 2, 2)
                self._keep(out, kind, body[at + 8 : at + 8 + n], blocks, 0)
                at += 8 + n
        return out

    @staticmethod
    def _keep(out: list, kind: int, body: bytes, blocks: list, frame: int) -> None:
        """Keeps a message, or goes on where a continuation says; blocks of the second version have a signature and a checksum."""
        if kind == _CONTINUED:
            blocks.append((_number(body, 0, 8) + frame, _number(body, 8, 8) - 2 * frame))
        elif kind:
            out.append((kind, body))

    def _links(self, messages: list[tuple[int, bytes]]) -> Iterator[tuple[str, int]]:
        for kind, body in messages:
            if kind == _SYMBOLS:
                yield from self._symbols(_number(body, 0, 8), _number(body, 8, 8))
            elif kind == _LINK and (found := _link(body)):
                yield found
            elif kind == _LINK_INFO:
                at = 2 + 8 * (body[1] & 1)
                if (heap := _number(body, at, 8)) != _NOWHERE:
                    for item in self._heap_items(heap, _number(body, at + 8, 8), 4):
                        if found := _link(item):
                            yield found

    def _symbols(self, tree: int, heap: int) -> Iterator[tuple[str, int]]:
        """Names and object headers of an old group: a B-tree of nodes of symbols, names in a local heap."""
        head = self.read(heap, 32)
        names = self.read(_number(head, 24, 8), _number(head, 8, 8))
        todo = [tree]
        while todo:
            node = todo.pop(0)
            raw = self.read(node, AHEAD)
            used = _number(raw, 6, 2)
            if raw[:4] == b"TREE":
                raw = self.read(node, 32 + 16 * used)
                todo += [_number(raw, 32 + 16 * k, 8) for k in range(used)]
            elif raw[:4] == b"SNOD":
                raw = self.read(node, 8 + 40 * used)
                for k in range(used):
                    at = 8 + 40 * k
                    start = _number(raw, at, 8)
                    yield names[start : names.index(b"\0", start)].decode(), _number(raw, at + 8, 8)

    def _attributes(self, messages: list[tuple[int, bytes]]) -> dict:
        bodies = [b for kind, b in messages if kind == _ATTRIBUTE]
        for kind, body in messages:
            if kind == _ATTRIBUTE_INFO:
                at = 2 + 2 * (body[1] & 1)
                if (heap := _number(body, at, 8)) != _NOWHERE:
                    bodies += self._heap_items(heap, _number(body, at + 8, 8), 0)
        out = {}
        for body in bodies:
            try:
                name, value = self._attribute(body)
            except Unsupported:
                continue
            out[name] = value
        return out

    def _attribute(self, raw: bytes) -> tuple[str, object]:
        version = raw[0]
        sizes = [_number(raw, 2 + 2 * k, 2) for k in range(3)]
        at = 9 if version == 3 else 8
        padded = [n + (-n % 8 if version == 1 else 0) for n in sizes]
        if version > 1 and raw[1] & 1:
            raise Unsupported("a shared type")
        name = raw[at : at + sizes[0]].split(b"\0")[0].decode()
        kind = _kind(raw[at + padded[0] :])
        space = raw[at + padded[0] + padded[1] :]
        shape, body = _shape(space), raw[at + sum(padded) :]
        n = 0 if space[0] == 2 and space[3] == 2 else math.prod(shape)
        if kind.dtype is None:
            texts = [self._global(_number(body, 16 * k, 4), _number(body, 16 * k + 4, 8), _number(body, 16 * k + 12, 4)) for k in range(n)]
            return name, texts[0] if not shape or n == 1 else texts
        values = np.frombuffer(body, kind.dtype, n)
        if kind.text:
            texts = [v.split(b"\0")[0].decode("utf-8", "replace") for v in values.tolist()]
            return name, texts[0] if n == 1 else texts
        return name, values[0].item() if n == 1 else values.tolist()

    def _global(self, length: int, collection: int, number: int) -> str:
        """A text of variable length: an object of a collection of the global heap."""
        if not length or not collection:
            return ""
        raw = self.read(collection, _number(self.read(collection, 16), 8, 8))
        at = 16
        while at + 16 <= len(raw):
            own, size = _number(raw, at, 2), _number(raw, at + 8, 8)
            if own == number:
                return raw[at + 16 : at + 16 + length].split(b"\0")[0].decode("utf-8", "replace")
            if not own:
                break
            at += 16 + size + -size % 8
        return ""

    def chunk_tree(self, address: int, rank: int, bounds: list[tuple[int, int]], sizes: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """Chunks under a node of the B-tree that the bounds meet; subtrees that begin behind the last one are not read."""
        entry = 8 + 8 * (rank + 1)
        raw = self.read(address, AHEAD)
        if raw[:4] != b"TREE" or raw[4] != 1:
            raise ValueError("no node of chunks")
        level, used = raw[5], _number(raw, 6, 2)
        need = 24 + used * (entry + 8) + entry
        if need > len(raw):
            raw = self.read(address, need)
        last = tuple(b - 1 for _, b in bounds)
        keys = [tuple(_number(raw, 24 + k * (entry + 8) + 8 + 8 * d, 8) for d in range(rank)) for k in range(used + 1)]
        first = tuple(a - a % c for (a, _), c in zip(bounds, sizes))
        for k in range(used):
            at = 24 + k * (entry + 8)
            child = _number(raw, at + entry, 8)
            if level:
                if keys[k] <= last and (k + 1 == used or keys[k + 1] > first):
                    yield from self.chunk_tree(child, rank, bounds, sizes)
            elif all(o < b and o + c > a for o, c, (a, b) in zip(keys[k], sizes, bounds)):
                yield keys[k], child, _number(raw, at, 4), _number(raw, at + 4, 4)

    def _heap_items(self, heap: int, tree: int, skip: int) -> Iterator[bytes]:
        """Objects of a fractal heap that the records of a B-tree (version 2) name; `skip` bytes of a record stand before the name."""
        raw = self.read(heap, 256)
        if raw[:4] != b"FRHP":
            raise ValueError("no fractal heap")
        id_length, filters = _number(raw, 5, 2), _number(raw, 7, 2)
        if filters:
            raise Unsupported("a heap with filters")
        largest_managed = _number(raw, 10, 4)
        at = 14 + 8 * 12
        width, start, largest, bits = _number(raw, at, 2), _number(raw, at + 2, 8), _number(raw, at + 10, 8), _number(raw, at + 18, 2)
        root, rows = _number(raw, at + 22, 8), _number(raw, at + 30, 2)
        offset_bytes = -(-bits // 8)
        length_bytes = min(8, max(1, -(-max(1, min(largest, largest_managed).bit_length()) // 8)))
        #: (offset in the heap, address, size) of direct blocks; offsets count the blocks' own heads.
        blocks: list[tuple[int, int, int]] = []

        def direct(address: int, size: int, offset: int) -> None:
            if address != _NOWHERE:
                blocks.append((offset, address, size))

        def indirect(address: int, rows_: int, offset: int) -> None:
            if address == _NOWHERE:
                return
            body, at_ = self.read(address, 5 + 8 + offset_bytes + rows_ * width * 8 + 4), 5 + 8 + offset_bytes
            for row in range(rows_):
                size = start << max(0, row - 1)
                for _ in range(width):
                    child, at_ = _number(body, at_, 8), at_ + 8
                    if size <= largest:
                        direct(child, size, offset)
                    else:
                        indirect(child, (size // start // width).bit_length(), offset)
                    offset += size

        if rows:
            indirect(root, rows, 0)
        else:
            direct(root, start, 0)
        for record in self._records(tree):
            name = record[skip : skip + id_length]
            if name[0] >> 4 & 3 != 0:
                raise Unsupported("an object outside of the heap's blocks")
            offset, length = _number(name, 1, offset_bytes), _number(name, 1 + offset_bytes, length_bytes)
            begin, address, _ = max(b for b in blocks if b[0] <= offset)
            yield self.read(address + offset - begin, length)

    def _records(self, tree: int) -> Iterator[bytes]:
        """All records of a B-tree of the second version."""
        raw = self.read(tree, 38)
        if raw[:4] != b"BTHD":
            raise ValueError("no B-tree of the second version")
        node, size, depth = _number(raw, 6, 4), _number(raw, 10, 2), _number(raw, 12, 2)
        root, used = _number(raw, 16, 8), _number(raw, 24, 2)
        most = [(node - 10) // size]
        total = [most[0]]
        for _ in range(depth):
            count_bytes = -(-most[0].bit_length() // 8)
            pointer = 8 + count_bytes + (-(-total[-1].bit_length() // 8) if len(total) > 1 else 0)
            most.append((node - 10 - pointer) // (size + pointer))
            total.append((most[-1] + 1) * total[-1] + most[-1])

        def walk(address: int, n: int, level: int) -> Iterator[bytes]:
            body = self.read(address, node)
            for k in range(n):
                yield body[6 + k * size : 6 + (k + 1) * size]
            if level:
                at, count_bytes = 6 + n * size, -(-most[0].bit_length() // 8)
                more = -(-total[level - 1].bit_length() // 8) if level > 1 else 0
                for _ in range(n + 1):
                    yield from walk(_number(body, at, 8), _number(body, at + 8, count_bytes), level - 1)
                    at += 8 + count_bytes + more

        if root != _NOWHERE:
            yield from walk(root, used, depth)


def _link(raw: bytes) -> tuple[str, int] | None:
    """The name and object header of a hard link."""
    flags, at = raw[1], 2
    kind = 0
    if flags & 8:
        kind, at = raw[at], at + 1
    at += 8 * bool(flags & 4) + bool(flags & 16)
    width = 1 << (flags & 3)
    n, at = _number(raw, at, width), at + width
    return (raw[at : at + n].decode(), _number(raw, at + n, 8)) if kind == 0 else None


def _filters(raw: bytes | None) -> list[int]:
    if not raw:
        return []
    out, at = [], 8 if raw[0] == 1 else 2
    for _ in range(raw[1]):
        number = _number(raw, at, 2)
        named = raw[0] == 1 or number >= 256
        length = _number(raw, at + 2, 2) if named else 0
        values = _number(raw, at + (6 if named else 4), 2)
        at += (8 if named else 6) + length + (-length % 8 if raw[0] == 1 else 0) + 4 * values + (4 * (values % 2) if raw[0] == 1 else 0)
        out.append(number)
    return out


def _fill(raw: bytes | None) -> bytes:
    if not raw:
        return b""
    if raw[0] in (1, 2):
        return raw[8 : 8 + _number(raw, 4, 4)] if raw[0] == 1 or raw[3] else b""
    return raw[6 : 6 + _number(raw, 2, 4)] if raw[1] & 32 else b""


def is_hdf5(head: bytes) -> bool:
    return head[:8] == SIGNATURE
