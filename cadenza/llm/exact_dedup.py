"""Exact deduplication by a Golomb-coded fingerprint exchange and a verification on whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common, exchange

#: Bits of a fingerprint: at 10**10 texts about one in a hundred is suspected without need.
FINGERPRINT_BITS = 40

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a sender at most; a partition with more is several senders.
SENDER_ROWS = 1_000_000
#: Fingerprints of an owner, about.
OWNER_PRINTS = 5_000_000
_STATE = f"{exchange.SENT_FIELDS}, ids binary, nulls binary, digests binary, places binary"


def normalised(text: Column) -> Column:
    """Null is empty; A-Z alone are lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def _sender(owners: int, bits: int):
    schema = pa.schema([
        ("sender", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("code", pa.binary()), ("repeated", pa.binary()),
        ("ids", pa.binary()), ("nulls", pa.binary()), ("digests", pa.binary()), ("places", pa.binary()),
    ])

    def row(**values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)

    def pack(sender: int, ids: list[pa.Array], digests: list[bytes]) -> Iterator[pa.RecordBatch]:
        """A row for each owner with fingerprints of its range, and one (owner -1) with the sender's rows."""
        raw = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 4)
        values, places, counts = np.unique(raw[:, 0].astype(np.uint64) >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        own = pa.chunked_array(ids)
        yield row(
            sender=sender, owner=-1, n=len(raw), ids=own.fill_null(0).to_numpy().tobytes(), nulls=np.packbits(own.is_null().to_numpy()).tobytes(),
            digests=raw.tobytes(), places=places.astype("<u4").tobytes(),
        )
        for sent in exchange.pack(sender, values, counts, owners, bits):
            yield row(**dict(zip(("sender", "owner", "n", "k", "code", "repeated"), sent)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = TaskContext.get().partitionId() << 24
        ids, digests, n = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column(0))
            digests.append(b"".join(batch.column(1).to_pylist()))
            n += batch.num_rows
            if n >= SENDER_ROWS:
                yield from pack(sender, ids, digests)
                sender, ids, digests, n = sender + 1, [], [], 0
        if ids:
            yield from pack(sender, ids, digests)

    return send


def _flag(state: pa.Table, replies: pa.Table) -> pa.Table:
    """A sender's rows: seq, doc_id, digest and whether the owners have seen its fingerprint more than once."""
    own = state.to_pylist()[0]
    n = own["n"]
    answers = sorted(zip(replies["owner"].to_pylist(), replies["n"].to_pylist(), replies["bitmap"].to_pylist()))
    # Owners have runs of the sorted fingerprints, so their bitmaps stand in the order of the places.
    flags = np.concatenate([np.unpackbits(np.frombuffer(bitmap, np.uint8), count=k) for _, k, bitmap in answers])
    ids = pa.array(np.frombuffer(own["ids"], np.int64), mask=np.unpackbits(np.frombuffer(own["nulls"], np.uint8), count=n).astype(bool))
    digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), n, [None, pa.py_buffer(own["digests"])]).cast(pa.binary())
    suspect = flags[np.frombuffer(own["places"], "<u4")] == 1
    return pa.Table.from_arrays(
        [pa.array(np.full(n, own["sender"])), pa.array(np.arange(n)), ids, digests, pa.array(suspect)], names=["sender", "seq", "doc_id", "digest", "suspect"]
    )


def exact_duplicates(docs: DataFrame, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """One row per row of `docs` (doc_id long, text string): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts the
    row with the largest doc_id stays; a null doc_id is smaller than any. Rows that repeat a doc_id and its text
    are separate members of their group, and one of them stays. An empty table gives an empty result. Other
    columns are not read.
    """
    spark = docs.sparkSession
    common.tune(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    owners = max(common.partitions(spark), -(-docs.count() // OWNER_PRINTS))
    hashed = own.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"))
    state = common.materialize(hashed.mapInArrow(_sender(owners, bits), _STATE), "exact-state")
    replies = exchange.answers(state.filter("owner >= 0").select("sender", "owner", "n", "k", "code", "repeated"))
    rows = state.filter("owner < 0").select("sender", "n", "ids", "nulls", "digests", "places")
    flagged = common.materialize(
        rows.groupBy("sender").cogroup(replies.groupBy("sender")).applyInArrow(_flag, "sender long, seq long, doc_id long, digest binary, suspect boolean"), "exact-flagged"
    )
    common.release(state)
    suspects = flagged.filter("suspect")
    # Whole texts of the suspects are compared by grouping on them; copies meet in the map-side aggregation first.
    texts = (
        common.keep_ids(own, suspects)
        .groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    groups = common.materialize(texts.select(F.unhex(F.sha2("norm", 256)).alias("t_digest"), "keep_id", "group_size"), "exact-groups")
    if groups.groupBy("t_digest").count().filter("count > 1").limit(1).count():
        raise ValueError("two different texts have the same SHA-256 digest")
    # Which of the rows that repeat the kept doc_id stays; one row of each group and sender at most is compared.
    winner = suspects.groupBy(F.col("digest").alias("w_digest"), "doc_id").agg(F.min(F.struct("sender", "seq")).alias("first"))
    groups = groups.filter("group_size > 1").join(
        winner, (F.col("t_digest") == F.col("w_digest")) & F.col("keep_id").eqNullSafe(F.col("doc_id"))
    ).select("t_digest", "keep_id", "group_size", "first")
    out = flagged.join(groups, F.col("suspect") & (F.col("digest") == F.col("t_digest")), "left")
    alone = F.col("t_digest").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.struct("sender", "seq") == F.col("first")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that exact_duplicates() keeps; of rows alike in doc_id and text one.

    Nulls, empty tables and columns of any name are handled as there."""
    found = common.materialize(exact_duplicates(docs.select("doc_id", "text")).select("doc_id", "kept", "text_sha256"), "exact-kept")
    left = common.keep_ids(docs, found.filter(~F.col("kept")), "left_anti")
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("gone")).filter("n > 1 and gone > 0")
    if not repeated.limit(1).count():
        return left
    # Some doc_id has several rows: those are told apart by their text too.
    again = common.keep_ids(docs, repeated)
    rows = common.wrapped(again, own_id=again["doc_id"], own_sha=F.sha2(normalised(again["text"]), 256))
    stay = found.filter("kept").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"))
    rows = rows.join(stay, F.col("k_id").eqNullSafe(F.col("own_id")) & (F.col("k_sha") == F.col("own_sha"))).dropDuplicates(["k_id", "k_sha"])
    return left.unionByName(rows.select("row.*"))
