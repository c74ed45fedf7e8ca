"""Token ids in flat unsigned integer files with 64-bit document offsets.

A range-partitioned sort gives every shard a run of ascending doc_ids. Each task encodes its run and streams the
ids into `<shard>.bin`, nothing but unsigned little-endian integers, and its index into `<shard>.idx`: eight bytes
of magic, then as 64-bit integers the width of an id in bytes, the number of documents, n + 1 offsets in ids, n
doc_ids and n null flags. The manifest names the files of the tasks that were committed, so a task that is run
again leaves no trace; a prefix sum over its few rows gives the base of each shard.
"""

from __future__ import annotations

import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress, count, islice
from operator import not_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm import common

MAGIC = b"CDZTOK01"
#: Pieces whose ids a worker remembers; this bounds its memory, not its results.
CACHE_PIECES = 800_000
#: The id that ends every document.
END_ID = 0

#: Any character on which the short cuts below might differ from the library's Unicode tables, or a special token.
_ODD = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff\\u180e\\u200b]|<\\|").search
_NOT_WESTERN = re.compile("[^\\x00-\\x7f\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]").search
#: Cuts between the pre-tokens of a byte-level vocabulary; the first is coarser and holds for any letters.
_COARSE = re.compile(rb" ?[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+(?![^\x20\x09-\x0d])|[\x20\x09-\x0d]").findall
_FINE = re.compile(
    rb"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[^\x20\x09-\x0dA-Za-z0-9\x80-\xff]+|[\x20\x09-\x0d]+(?![^\x20\x09-\x0d])|[\x20\x09-\x0d]"
).findall


class ByteEncoder:
    """Encodes with the tokenizers library, each distinct piece of text once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.dtype = np.dtype("<u2" if self.full.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_piece = self.full.normalizer is None and "ByteLevel" in str(self.full.pre_tokenizer) and "use_regex=True" in str(self.full.pre_tokenizer)
        self.cache: dict[bytes, bytes] = {}

    def raw(self, ids: list[int]) -> bytes:
        own = array("H" if self.dtype.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            own.byteswap()
        return own.tobytes()

    def learn(self, pieces: set[bytes]) -> None:
        order = list(pieces)
        found = self.full.encode_batch_fast([p.decode() for p in order], add_special_tokens=False)
        self.cache.update(zip(order, [self.raw(x.ids) for x in found]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text as bytes."""
        out: list[bytes | None] = [None] * len(texts)
        split: dict[int, list[bytes]] = {}
        for n, text in enumerate(texts):
            if not self.by_piece or _ODD(text):
                out[n] = self.raw(self.full.encode(text, add_special_tokens=False).ids)
            else:
                split[n] = (_COARSE if _NOT_WESTERN(text) else _FINE)(text.encode())
        get = self.cache.get
        found = {n: list(map(get, pieces)) for n, pieces in split.items()}
        # No piece is without ids, so only what is missing is false.
        gaps = {n: list(compress(count(), map(not_, x))) for n, x in found.items() if None in x}
        missing = {split[n][k] for n, places in gaps.items() for k in places}
        if len(self.cache) + len(missing) > CACHE_PIECES:
            self.cache = dict(islice(self.cache.items(), len(self.cache) // 2, None))  # what was learnt last
            get = self.cache.get
            missing -= self.cache.keys()
        if missing:
            self.learn(missing)
        for n, places in gaps.items():
            pieces, own = split[n], found[n]
            for k in places:
                own[k] = get(pieces[k])
        for n, x in found.items():
            out[n] = b"".join(x)
        return out


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a shared folder: local, HDFS, S3 or GCS."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encodes `docs` (doc_id, text) into shards under `folder`; the manifest: shard, file, n_docs, n_tokens, base, width.

    Documents are in ascending doc_id order, null first; rows that share a doc_id are ordered by text. Null text is
    empty. Each document ends with end_id. Only totals of shards are gathered, never of documents.
    """
    spark = docs.sparkSession
    common.tune(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        end = own.raw([end_id])
        store, base = open_folder(folder)
        shard = TaskContext.get().partitionId()
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        counts, ids = [], []
        stream = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if stream is None:
                store.create_dir(base, recursive=True)
                stream = store.open_output_stream(f"{base}/{name}.bin")
            for text in own.encode([t or "" for t in batch.column(1).to_pylist()]):
                stream.write(text + end)
                counts.append((len(text) + len(end)) // own.dtype.itemsize)
            ids.append(batch.column(0))
        if stream is None:
            return
        stream.close()
        ids = pa.chunked_array(ids)
        offsets = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype("<u8")
        with store.open_output_stream(f"{base}/{name}.idx") as index:
            index.write(MAGIC + np.array([own.dtype.itemsize, len(counts)], "<u8").tobytes())
            index.write(offsets.tobytes())
            index.write(ids.fill_null(0).to_numpy().astype("<i8").tobytes())
            index.write(ids.is_null().to_numpy().astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([
            pa.array([shard], pa.int64()), pa.array([name]), pa.array([len(counts)], pa.int64()),
            pa.array([int(offsets[-1])], pa.int64()), pa.array([own.dtype.itemsize], pa.int32()),
        ], names=["shard", "file", "n_docs", "n_tokens", "width"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = own.repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = common.materialize(dealt.mapInArrow(write, "shard long, file string, n_docs long, n_tokens long, width int"), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_index(store: fs.FileSystem, path: str) -> tuple[int, np.ndarray, list[int | None]]:
    """Width of an id, offsets and doc_ids of a shard."""
    with store.open_input_file(path) as f:
        raw = f.read()
    if raw[:8] != MAGIC:
        raise ValueError(f"{path} is no token index")
    width, n = (int(x) for x in np.frombuffer(raw, "<u8", 2, 8))
    offsets = np.frombuffer(raw, "<u8", n + 1, 24).astype(np.int64)
    at = 24 + 8 * (n + 1)
    ids = np.frombuffer(raw, "<i8", n, at).tolist()
    null = np.frombuffer(raw, np.uint8, n, at + 8 * n)
    return width, offsets, [None if x else i for i, x in zip(ids, null.tolist())]


def map_tokens(store: fs.FileSystem, path: str, width: int) -> np.ndarray:
    """The ids of a shard, memory-mapped where the file system is mounted."""
    dtype = np.dtype(f"<u{width}")
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def read_tokens(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents from the shards: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers), and ids on demand."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        for batch in batches:
            for name, start in zip(batch["file"].to_pylist(), batch["base"].to_pylist()):
                width, offsets, ids = read_index(store, f"{base}/{name}.idx")
                tokens = map_tokens(store, f"{base}/{name}.bin", width)
                step = common.BATCH_ROWS
                for a in range(0, len(ids), step):
                    cut = offsets[a : a + step + 1].tolist()
                    own = [tokens[x:y] for x, y in zip(cut, cut[1:])]
                    columns = [
                        pa.array(ids[a : a + step], pa.int64()), pa.array(start + offsets[a : a + len(own)]),
                        pa.array([len(x) for x in own], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    spark = manifest.sparkSession
    return manifest.select("file", "base").repartition(common.partitions(spark)).mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the token files of `docs` to the shared folder and returns what read_tokens() finds in them.

    One row per row of `docs` (doc_id long, text string): doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32. A null, empty or blank text gives its own ids and the end id. An empty table gives an empty result.
    Other columns are not read.
    """
    folder = common.new_path(docs.sparkSession, "tokens")
    manifest = common.materialize(write_tokens(docs, tokenizer, folder, end_id), "token-bases")
    return read_tokens(manifest, folder)
