"""Removal of repeated passages: FM-indexes over shards of shared content, through which documents are streamed.

Windows of 13 words are grouped by their minimizer, the smallest hash of their six-word grams, so that equal windows
meet in one shard whatever documents they are in. A fingerprint exchange first tells which minimizers occur more than
once; only the stretches around those go on, each distinct one of a chunk of documents once to its shard. A shard builds
one FM-index over its distinct stretches, computes matching statistics of all of them, and answers each chunk with one
bit for each window: whether the window's interval holds a smaller document. A passage in a third of all documents thus
costs each chunk one stretch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common, exchange, kernels
from cadenza.llm.fm_index import FMIndex, sorted_suffixes

WINDOW, GRAM = 13, 6
#: Bits of a minimizer's fingerprint in the exchange; a chance hit only means that a stretch is indexed without need.
FINGERPRINT_BITS = 48
#: Fingerprints of an owner in the exchange, about.
OWNER_PRINTS = 4_000_000
#: Words of a shard's index at most, repeats counted.
SHARD_WORDS = 1_000_000
#: Words of the stretches that a task packs into one chunk.
CHUNK_WORDS = 4_000_000
#: Stretches of one minimizer from which its windows are dealt out one by one, by their own hash.
HOT = 5_000
#: In the byte that holds a stretch's number of windows (at most 8): its minimizer is hot.
_HOT_BIT = 128


def mark_of(text: Column) -> Column:
    """Tells rows that share a doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digests = [], []
        for text in batch.column(1).to_pylist():
            words = (text or "").encode().split()  # of bytes: at the white space of the word pattern
            n.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "mark", "n_words", "digest"]
        )


def stretches(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer: row, first word in the row, number of windows, minimizer."""
    starts, ends, rows = kernels.find_words(raw, offsets)
    n = len(starts) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    grams = kernels.fold(kernels.hash_words(raw, starts, ends, lower=False), GRAM)
    best, at = grams[:n].copy(), np.arange(n)
    for k in range(1, WINDOW - GRAM + 1):
        other = grams[k : k + n]
        less = np.flatnonzero(other < best)
        best[less] = other[less]
        at[less] = less + k
    window = np.flatnonzero(rows[:n] == rows[WINDOW - 1 :])
    if not len(window):
        return none, none, none, np.zeros(0, np.uint64)
    at = at[window]
    begin = np.flatnonzero(np.diff(at, prepend=-1) != 0)
    length = np.diff(np.append(begin, len(window)))
    first = window[begin]
    row = rows[first]
    return row, first - kernels.row_bounds(rows, len(offsets) - 1)[row], length, best[first]


# --- first exchange: which minimizers occur more than once ----------------------------------------------------------

_STATE = [
    ("sender", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("code", pa.binary()), ("repeated", pa.binary()),
    ("often", pa.binary()), ("steps", pa.binary()), ("rows", pa.binary()), ("firsts", pa.binary()), ("windows", pa.binary()),
]


def _narrow(values: np.ndarray) -> bytes:
    """The width in bytes, then the values in so many bytes each."""
    out = values.astype(np.uint16 if not len(values) or values.max() < 1 << 16 else np.uint32)
    return bytes([out.dtype.itemsize]) + out.tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def _row(kinds: list[tuple], **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(k)], t) for k, t in kinds], names=[k for k, _ in kinds])


def _sender(owners: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a partition: a row for each owner with fingerprints of its range, and one (owner -1) with doc_ids and marks."""
        sender, seen = TaskContext.get().partitionId(), 0
        ids, marks, every = [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column(0).to_numpy())
            marks.append(batch.column(2).to_numpy())
            for a, _, raw, offsets in kernels.slices(batch.column(1)):
                row, first, length, minimizer = stretches(raw, offsets)
                every.append(((minimizer >> np.uint64(64 - FINGERPRINT_BITS)), (row + seen + a).astype(np.uint32), first.astype(np.uint32), length.astype(np.uint8)))
            seen += batch.num_rows
        if not every:
            return
        yield _row(_STATE, sender=sender, owner=-1, rows=np.concatenate(ids).tobytes(), firsts=np.concatenate(marks).tobytes())
        prints, rows, firsts, windows = (np.concatenate(x) for x in zip(*every))
        order = np.argsort(prints, kind="stable")
        prints, rows, firsts, windows = prints[order], rows[order], firsts[order], windows[order]
        fresh = np.diff(prints, prepend=~prints[:1]) != 0
        begins = np.flatnonzero(fresh)
        counts = np.diff(np.append(begins, len(prints)))
        at = 0
        for _, owner, n, k, code, repeated in exchange.pack(sender, prints[begins], counts, owners, FINGERPRINT_BITS):
            own = counts[at : at + n]
            a, b = begins[at], begins[at] + own.sum()
            # One bit for each stretch: whether it begins the next fingerprint.
            steps = fresh[a:b].copy()
            steps[:1] = False
            yield _row(
                _STATE, sender=sender, owner=owner, n=n, k=k, code=code, repeated=repeated, often=own[own > 1].astype("<u4").tobytes(),
                steps=np.packbits(steps).tobytes(), rows=_narrow(rows[a:b]), firsts=_narrow(firsts[a:b]), windows=windows[a:b].tobytes(),
            )
            at += n

    return send


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _answer(hot: int):
    def answer(group: pd.DataFrame) -> pd.DataFrame:
        """An owner's bitmaps for each sender: fingerprints with more than one stretch, and those with more than `hot`."""
        lists = [exchange.rice_decode(n, k, c) for n, k, c in zip(group["n"], group["k"], group["code"])]
        every = np.concatenate(lists)
        times = np.ones(len(every), np.int64)
        times[np.concatenate([_bits(r, n) for n, r in zip(group["n"], group["repeated"])])] = np.concatenate([np.frombuffer(x, "<u4") for x in group["often"]])
        order = np.argsort(every, kind="stable")
        begins = np.flatnonzero(np.diff(every[order], prepend=~every[order][:1]) != 0)
        total = np.empty(len(every), np.int64)
        total[order] = np.repeat(np.add.reduceat(times[order], begins), np.diff(np.append(begins, len(every))))
        ends = np.cumsum([len(x) for x in lists]).tolist()
        parts = [total[e - len(x) : e] for e, x in zip(ends, lists)]
        return pd.DataFrame({
            "sender": group["sender"].to_numpy(), "owner": group["owner"].to_numpy(),
            "bitmap": [np.packbits(p > 1).tobytes() for p in parts], "hot": [np.packbits(p > hot).tobytes() for p in parts],
        })

    return answer


_WANTED = "doc_id long, mark long, words long, firsts binary, windows binary, prints binary"


def _suspects(owners: int):
    def merge(sent: pa.Table, replies: pa.Table) -> pa.Table:
        """A sender's documents with the stretches whose minimizer the owners found more than once."""
        edges = exchange.edges(owners, FINGERPRINT_BITS)
        answer = {o: (b, h) for o, b, h in zip(*(replies[c].to_pylist() for c in ("owner", "bitmap", "hot")))}
        ids = marks = None
        found = []
        for r in sent.to_pylist():
            if r["owner"] < 0:
                ids, marks = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["firsts"], np.int64)
                continue
            bitmap, hot = (_bits(x, r["n"]) for x in answer[r["owner"]])
            rows, firsts, windows = _wide(r["rows"]), _wide(r["firsts"]), np.frombuffer(r["windows"], np.uint8)
            place = np.cumsum(np.unpackbits(np.frombuffer(r["steps"], np.uint8), count=len(rows)), dtype=np.int64)
            hit = bitmap[place]
            place = place[hit]
            prints = exchange.rice_decode(r["n"], r["k"], r["code"])[place] + np.uint64(edges[r["owner"]])
            found.append((rows[hit].astype(np.int64), firsts[hit].astype(np.uint32), windows[hit] | np.where(hot[place], _HOT_BIT, 0).astype(np.uint8), prints))
        names = ["doc_id", "mark", "words", "firsts", "windows", "prints"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        columns: list[list] = [[] for _ in names]
        if found:
            rows, firsts, windows, prints = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((firsts, rows))
            rows, firsts, windows, prints = rows[order], firsts[order], windows[order], prints[order]
            n, hot = (windows % _HOT_BIT).astype(np.int64), windows >= _HOT_BIT
            words = np.concatenate([[0], np.cumsum(np.where(hot, n * WINDOW, n + WINDOW - 1))])
            cuts = np.flatnonzero(np.diff(rows, prepend=-1) != 0)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)]):
                own = (ids[rows[a]], marks[rows[a]], words[b] - words[a], firsts[a:b].tobytes(), windows[a:b].tobytes(), prints[a:b].tobytes())
                for column, value in zip(columns, own):
                    column.append(value)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return merge


# --- second exchange: stretches to shards, bits back ----------------------------------------------------------------

_PACKED = [
    ("chunk", pa.int64()), ("shard", pa.int32()), ("keys", pa.binary()), ("least", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("codes", pa.binary()),
    ("ids", pa.binary()), ("marks", pa.binary()), ("piece", pa.binary()), ("doc", pa.binary()), ("first", pa.binary()),
]
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for each run of the given size, one after another."""
    cuts = np.cumsum(size) - size
    return np.repeat(begin - cuts, size) + np.arange(int(size.sum()))


def _keys(words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each run of `words`, from prefix sums of two polynomials."""
    out = []
    for base, inverse in zip(_BASES, _INVERSES):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * kernels.power(base, len(words)), out=total[1:])
        out.append(kernels.mix((total[begin + size] - total[begin]) * kernels.power(inverse, len(words) + 1)[begin] ^ size.astype(np.uint64)))
    return out


class _Chunk:
    """Stretches of some documents, until they are packed."""

    def __init__(self):
        self.words, self.ids, self.marks, self.parts = [], [], [], []
        self.n_words = self.n_docs = self.size = 0

    def add(self, hashes, ids, marks, begin, windows, prints, doc, first) -> None:
        """Stretches that begin at the words `begin` of `hashes`; hot ones are taken window by window."""
        n, hot = (windows % _HOT_BIT).astype(np.int64), windows >= _HOT_BIT
        if hot.any():
            cold = ~hot
            one = _ranges(np.zeros(int(hot.sum()), np.int64), n[hot])
            begin, first, doc, prints = (np.concatenate([x[cold], np.repeat(x[hot], n[hot])]) for x in (begin, first, doc, prints))
            fresh = int(cold.sum())
            begin[fresh:] += one
            first[fresh:] += one
            n = np.concatenate([n[cold], np.ones(len(one), np.int64)])
        k1, k2 = _keys(hashes, begin, n + WINDOW - 1)
        if hot.any():
            prints = np.concatenate([prints[:fresh], k1[fresh:]])
        self.parts.append((k1, k2, begin + self.n_words, n, prints, doc + self.n_docs, first))
        self.words.append(hashes)
        self.ids.append(ids)
        self.marks.append(marks)
        self.n_words += len(hashes)
        self.n_docs += len(ids)
        self.size += int((n + WINDOW - 1).sum())

    def pack(self, chunk: int, shards: int) -> Iterator[pa.RecordBatch]:
        """A row for each shard with the chunk's distinct stretches, and one (shard -1) with where they are."""
        k1, k2, begin, n, prints, doc, first = (np.concatenate(x) for x in zip(*self.parts))
        ids, marks = np.concatenate(self.ids), np.concatenate(self.marks)
        shard = (kernels.mix(prints) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((k2, k1, shard))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0) | (np.diff(shard[order]) != 0)
        cuts = np.flatnonzero(fresh)
        piece = np.cumsum(fresh) - 1
        least = np.minimum.reduceat(ids[doc[order]], cuts)
        one = order[cuts]
        names, code = np.unique(np.concatenate(self.words), return_inverse=True)
        place = np.zeros(len(names), np.int64)
        bounds = np.searchsorted(shard[one], np.arange(shards + 1)).tolist()
        for s in range(shards):
            a, b = bounds[s], bounds[s + 1]
            if a == b:
                continue
            own = one[a:b]
            codes = code[_ranges(begin[own], n[own] + WINDOW - 1)]
            seen = np.zeros(len(names), bool)
            seen[codes] = True
            used = np.flatnonzero(seen)
            place[used] = np.arange(len(used))
            yield _row(
                _PACKED, chunk=chunk, shard=s, keys=np.stack([k1[own], k2[own]]).tobytes(), least=least[a:b].tobytes(), sizes=n[own].astype(np.uint8).tobytes(),
                words=names[used].tobytes(), codes=_narrow(place[codes]),
            )
        yield _row(
            _PACKED, chunk=chunk, shard=-1, sizes=n[one].astype(np.uint8).tobytes(), ids=ids.tobytes(), marks=marks.tobytes(), piece=piece.astype("<u4").tobytes(),
            doc=doc[order].astype("<u4").tobytes(), first=first[order].astype("<u4").tobytes(),
        )


def _cut(shards: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs the suspected stretches of (doc_id, mark, text, firsts, windows, prints) in chunks."""
        number = TaskContext.get().partitionId() << 24
        chunk = _Chunk()
        for batch in batches:
            ids, marks = batch["doc_id"].to_numpy(), batch["mark"].to_numpy()
            packed = [batch[c].to_pylist() for c in ("firsts", "windows", "prints")]
            for a, b, raw, offsets in kernels.slices(batch["text"]):
                starts, ends, rows = kernels.find_words(raw, offsets)
                bounds = kernels.row_bounds(rows, b - a)
                firsts, windows, prints = (np.frombuffer(b"".join(c[a:b]), t) for c, t in zip(packed, ("<u4", np.uint8, "<u8")))
                firsts = firsts.astype(np.int64)
                doc = np.repeat(np.arange(b - a), [len(x) for x in packed[1][a:b]])
                chunk.add(kernels.hash_words(raw, starts, ends, lower=False), ids[a:b], marks[a:b], bounds[doc] + firsts, windows, prints, doc, firsts)
                if chunk.size > CHUNK_WORDS:
                    yield from chunk.pack(number, shards)
                    number, chunk = number + 1, _Chunk()
        if chunk.size:
            yield from chunk.pack(number, shards)

    return cut


def _search(group: pa.Table) -> pa.Table:
    """One shard: for each chunk a byte for each of its stretches, in which bit w tells that a smaller document has window w."""
    rows = group.select(["keys", "least", "sizes", "words", "codes"]).to_pylist()
    keys = [np.frombuffer(r["keys"], "<u8").reshape(2, -1) for r in rows]
    k1, k2 = np.concatenate(keys, axis=1)
    sizes = np.concatenate([np.frombuffer(r["sizes"], np.uint8) for r in rows]).astype(np.int64)
    own_least = np.concatenate([np.frombuffer(r["least"], "<i8") for r in rows])
    order = np.lexsort((k2, k1))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)
    cuts = np.flatnonzero(fresh)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    least = np.minimum.reduceat(own_least[order], cuts)
    chosen = np.zeros(len(order), bool)
    chosen[order[cuts]] = True
    # The words of one of each distinct stretch, in the order of the rows.
    words, at = [], 0
    for r, k in zip(rows, keys):
        n = k.shape[1]
        size = sizes[at : at + n] + WINDOW - 1
        words.append(np.frombuffer(r["words"], "<u8")[_wide(r["codes"])[np.repeat(chosen[at : at + n], size)]])
        at += n
    del rows
    windows, docs = sizes[chosen], least[number[chosen]]
    place = np.empty(len(cuts), np.int64)
    place[number[chosen]] = np.arange(len(cuts))
    names, symbol = np.unique(np.concatenate(words), return_inverse=True)
    length = windows + WINDOW - 1
    text = np.zeros(int(length.sum()) + len(length), np.int64)
    begins = np.cumsum(length + 1) - length - 1
    text[_ranges(begins, length)] = symbol + 1
    suffixes = sorted_suffixes(text, WINDOW)
    index = FMIndex(text, suffixes, len(names) + 1, WINDOW)
    by_suffix = np.append(np.repeat(docs, length + 1)[suffixes], np.iinfo(np.int64).max)
    del suffixes
    found = np.repeat(docs, windows)
    ends = _ranges(begins + WINDOW - 1, windows)
    for a in range(0, len(ends), 1 << 16):
        reach, low, high = index.matches(text, ends[a : a + (1 << 16)])
        full = np.flatnonzero(reach == WINDOW)
        if len(full):
            lows, back = np.unique(low[full], return_inverse=True)
            highs = np.zeros(len(lows), np.int64)
            highs[back] = high[full]
            found[a + full] = np.minimum.reduceat(by_suffix, np.stack([lows, highs], 1).ravel())[::2][back]
    # Bits for each stretch of each chunk, against the smallest document that has it there.
    heads = np.cumsum(windows) - windows
    own = place[number]
    smaller = found[_ranges(heads[own], sizes)] < np.repeat(own_least, sizes)
    weight = np.left_shift(1, _ranges(np.zeros(len(sizes), np.int64), sizes))
    bits = np.add.reduceat(smaller * weight, np.cumsum(sizes) - sizes).astype(np.uint8)
    ends = np.cumsum([k.shape[1] for k in keys]).tolist()
    return pa.Table.from_arrays(
        [group["chunk"], group["shard"], pa.array([bits[e - k.shape[1] : e].tobytes() for e, k in zip(ends, keys)], pa.binary())], names=["chunk", "shard", "bits"]
    )


def _runs(placed: pa.Table, answers: pa.Table) -> pa.Table:
    """Of a chunk's documents the covered windows, as runs (first word, windows)."""
    names = ["doc_id", "mark", "starts", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    columns: list[list] = [[] for _ in names]
    for r in placed.to_pylist():
        bits = np.concatenate([np.frombuffer(x, np.uint8) for _, x in sorted(zip(answers["shard"].to_pylist(), answers["bits"].to_pylist()))])
        ids, marks = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["marks"], "<i8")
        piece, doc, first = (np.frombuffer(r[c], "<u4").astype(np.int64) for c in ("piece", "doc", "first"))
        n = np.frombuffer(r["sizes"], np.uint8).astype(np.int64)[piece]
        # Another document of the chunk with the stretch covers it whole.
        least = np.minimum.reduceat(ids[doc], np.flatnonzero(np.diff(piece, prepend=-1) != 0))[piece]
        own = np.where(ids[doc] > least, (1 << n) - 1, bits[piece])
        window = _ranges(np.zeros(len(n), np.int64), n)
        covered = (np.repeat(own, n) >> window) & 1 == 1
        at, doc = (np.repeat(first, n) + window)[covered], np.repeat(doc, n)[covered]
        order = np.lexsort((at, doc))
        at, doc = at[order], doc[order]
        begins = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
        counts = np.diff(np.append(begins, len(at)))
        starts, doc = at[begins], doc[begins]
        cuts = np.flatnonzero(np.diff(doc, prepend=-1) != 0).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(doc)]):
            for column, value in zip(columns, (ids[doc[a]], marks[doc[a]], starts[a:b].astype("<u4").tobytes(), counts[a:b].astype("<u4").tobytes())):
                column.append(value)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for doc_id, mark, text, starts, counts in zip(*(batch[c].to_pylist() for c in ("doc_id", "mark", "text", "starts", "counts"))):
            words = text.encode().split()
            kept, at = [], 0
            for first, n in zip(np.frombuffer(starts, "<u4").tolist(), np.frombuffer(counts, "<u4").tolist()):
                kept += words[at:first]
                at = max(at, first + n + WINDOW - 1)
            kept += words[at:]
            joined = b" ".join(kept)
            for column, value in zip(out, (doc_id, mark, len(words) - len(kept), hashlib.sha256(joined).digest(), joined.decode())):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["r_id", "r_mark", "removed", "kept_digest", "kept_text"])


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (doc_id, mark, ...) with the texts of its rows of `docs` (doc_id, mark, text)."""
    own = wanted.withColumnsRenamed({"doc_id": "w_id", "mark": "w_mark"})
    count = wanted.count()
    if count <= common.BROADCAST_IDS:
        docs = docs.join(F.broadcast(own.select("w_id", "w_mark")), (F.col("doc_id") == F.col("w_id")) & (F.col("mark") == F.col("w_mark")), "left_semi")
    return docs.join(own, (F.col("doc_id") == F.col("w_id")) & (F.col("mark") == F.col("w_mark"))).drop("w_id", "w_mark")


def _fields(kinds: list[tuple]) -> str:
    return ", ".join(f"{name} {'binary' if t == pa.binary() else 'int' if t == pa.int32() else 'long'}" for name, t in kinds)


def repeated_windows(docs: DataFrame, n_words: int) -> DataFrame:
    """(doc_id, mark, starts, counts) of `docs` (doc_id long not null, mark long, text; about n_words words): the runs of
    windows, as unsigned 32-bit integers, that are in a smaller document too. Rows are distinct in doc_id and mark."""
    spark = docs.sparkSession
    owners = max(common.partitions(spark), -(-n_words // (4 * OWNER_PRINTS)))
    state = common.materialize(docs.select("doc_id", "text", "mark").mapInArrow(_sender(owners), _fields(_STATE)), "substring-state")
    sent = state.filter("owner >= 0").select("sender", "owner", "n", "k", "code", "repeated", "often")
    replies = sent.groupBy("owner").applyInPandas(_answer(HOT), "sender long, owner int, bitmap binary, hot binary")
    wanted = state.groupBy("sender").cogroup(replies.groupBy("sender")).applyInArrow(_suspects(owners), _WANTED)
    wanted = common.materialize(wanted, "substring-wanted")
    common.release(state)
    words = wanted.agg(F.sum("words")).first()[0] or 0
    shards = max(common.partitions(spark), -(-words // SHARD_WORDS))
    texts = _with_texts(docs, wanted.drop("words")).select("doc_id", "mark", "text", "firsts", "windows", "prints")
    packed = common.materialize(texts.mapInArrow(_cut(shards), _fields(_PACKED)), "substring-packed")
    common.release(wanted)
    content = packed.filter("shard >= 0").select("chunk", "shard", "keys", "least", "sizes", "words", "codes")
    bits = content.groupBy("shard").applyInArrow(_search, "chunk long, shard int, bits binary")
    placed = packed.filter("shard < 0").select("chunk", "sizes", "ids", "marks", "piece", "doc", "first")
    runs = placed.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(_runs, "doc_id long, mark long, starts binary, counts binary")
    runs = common.materialize(runs, "substring-runs")
    common.release(packed)
    return runs


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id long, text string): doc_id, n_words, n_removed, kept_sha256, kept_text.

    Words covered by a window of 13 words that also starts in a document with a smaller doc_id are removed; kept_text
    joins the others by one space, and is null where nothing was removed or everything. Null, empty and blank texts
    have no words. Rows that share a doc_id do not cover each other; a row with a null doc_id neither covers nor is
    covered. Words are compared by 64-bit hashes of their bytes. An empty table gives an empty result. Other columns
    are not read.
    """
    spark = docs.sparkSession
    common.tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", mark_of(F.col("text")).alias("mark"))
    first = common.materialize(docs.mapInArrow(_digests, "doc_id long, mark long, n_words long, digest binary"), "substring-digests")
    # Of texts with the same words the smallest doc_id covers all others whole; only one of each goes on.
    least = first.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW)).groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    least = common.materialize(least.filter("n > 1").select(F.col("digest").alias("l_digest"), "least"), "substring-least")
    base = common.materialize(
        first.join(common.sized(least), F.col("digest") == F.col("l_digest"), "left").select("doc_id", "mark", "n_words", "digest", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("copy")),
        "substring-base",
    )
    common.release(first, least)
    own = base.filter("doc_id is not null").select("doc_id", "mark", "n_words", (F.col("copy") | (F.col("n_words") < WINDOW)).alias("idle"))
    idle = own.filter("idle").select(F.col("doc_id").alias("i_id"), F.col("mark").alias("i_mark")).distinct()
    facts = own.agg(F.sum(F.when(~F.col("idle"), F.col("n_words"))), F.count("*"), F.count_if("idle")).first()
    same = (F.col("doc_id") == F.col("i_id")) & (F.col("mark") == F.col("i_mark"))
    docs = docs.filter("doc_id is not null")
    if own.select("doc_id", "mark").distinct().count() < facts[1]:
        docs = docs.dropDuplicates(["doc_id", "mark"])  # rows alike in both have one result
    runs = repeated_windows(docs.join(common.sized(idle, facts[2]), same, "left_anti"), facts[0] or 0)
    changed = _with_texts(docs, runs).select("doc_id", "mark", "text", "starts", "counts")
    changed = changed.mapInArrow(_remove, "r_id long, r_mark long, removed long, kept_digest binary, kept_text string")
    out = base.join(changed, (F.col("doc_id") == F.col("r_id")) & (F.col("mark") == F.col("r_mark")), "left")
    none = F.unhex(F.sha2(F.lit("").cast("binary"), 256))
    return out.select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(F.col("copy"), none).otherwise(F.coalesce("kept_digest", "digest")))).alias("kept_sha256"),
        F.when(~F.col("copy"), F.col("kept_text")).alias("kept_text"),
    )
