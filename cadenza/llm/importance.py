"""Resampling of documents towards a target's distribution of hashed features, met by an Aho-Corasick automaton.

Features are words and runs of words. The dictionary holds distinct words between delimiters, each with the CRC-32 and
the length of its bytes as payload. A scan of the text emits the payloads of its words; those of neighbours compose to the
CRC of a run, whose bucket is counted or scored, so that no run is ever put together as text. Each worker grows its
dictionary from the words it meets; what stands between two matches and is in no dictionary yet is hashed there and
then, so results do not depend on the dictionary. Counting and scoring are two scans; between them go BUCKETS counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm import common

BUCKETS = 10_000
#: Words of a run at most, words of a document that may be drawn, percent of such documents that are drawn.
MOST_RUN, LEAST_WORDS, PERCENT = 1, 20, 10
#: Words of a worker's automaton, and words met once, that are kept at most; of a full automaton the half that is met most stays.
MOST_KNOWN, MOST_FRESH = 60_000, 200_000
#: Bytes of a word in the dictionary at most.
LONGEST = 48
#: Bytes of text scanned at once.
SCAN_BYTES = 1 << 20

#: Letters and digits of ASCII, lower-cased, and all bytes of longer UTF-8 sequences; all else delimits.
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _shifts(longest: int) -> np.ndarray:
    """shifts[n, b]: the CRC register with bit b alone after n zero bytes."""
    out = np.zeros((longest + 1, 32), np.uint32)
    out[0] = np.uint32(1) << np.arange(32, dtype=np.uint32)
    table = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    for n in range(1, longest + 1):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ table[out[n - 1] & np.uint32(255)]
    return out


_SHIFTS = _shifts(LONGEST + 1)


def combine(first: np.ndarray, then: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings put together, from theirs and the length of the second."""
    out = then.astype(np.uint32)
    first, left = first.astype(np.uint32), length.astype(np.int64)
    while True:
        step = np.minimum(left, LONGEST + 1)
        moved = np.zeros_like(out)
        for b in range(32):
            moved ^= np.where(first >> np.uint32(b) & np.uint32(1), _SHIFTS[step, b], np.uint32(0))
        first, left = moved, left - step
        if not left.any():
            return out ^ first


class Dictionary:
    """Words between delimiters in an automaton; a payload is the CRC-32, shifted by 31 bits, and the length in bytes.

    The automaton holds numbers of 32 bits: a word's is its place in `words`, and that of its payload and of its hits."""

    def __init__(self):
        self.machine: ahocorasick.Automaton | None = None
        self.words: list[str] = []
        self.loads = self.hits = np.zeros(0, np.int64)
        self.fresh: dict[str, int] = {}
        self.due: dict[str, int] = {}

    def payload(self, word: str) -> int:
        """Of a word outside of the automaton; one that is met twice is due to be taken in."""
        known = self.fresh.get(word)
        if known is not None:
            self.due[word] = known
            return known
        raw = word.encode("latin-1")
        value = zlib.crc32(raw) << 31 | len(raw)
        if len(raw) <= LONGEST:
            self.fresh[word] = value
        return value

    def grow(self) -> None:
        """Takes words in when they are enough to pay for building the automaton anew."""
        if len(self.due) >= max(1_000, len(self.words) // 3):
            kept = self.words
            if not self.machine or len(self.words) + len(self.due) > MOST_KNOWN:
                stay = np.sort(np.argsort(-self.hits, kind="stable")[: MOST_KNOWN // 2])
                kept, self.words, self.loads = [self.words[i] for i in stay.tolist()], [], self.loads[stay]
                self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            new = list(self.due)[: MOST_KNOWN - len(kept)]
            self.loads = np.append(self.loads, np.array([self.due[w] for w in new], np.int64))
            every = kept + new
            for n in range(len(self.words), len(every)):
                self.machine.add_word(f" {every[n]} ", n)
            self.machine.make_automaton()
            self.words, self.hits = every, np.zeros(len(every), np.int64)
            self.due, self.fresh = {}, {}
        if len(self.fresh) > MOST_FRESH:
            self.due, self.fresh = {}, {}

    def scan(self, text: str) -> np.ndarray:
        """The payloads of all words, in order, of a text of words with one space around each."""
        self.grow()
        found = np.fromiter(chain.from_iterable(self.machine.iter(text)), np.int64) if self.machine else np.zeros(0, np.int64)
        ends, loads = found[::2], self.loads[found[1::2]]
        self.hits += np.bincount(found[1::2], minlength=len(self.hits))
        # A match begins at the delimiter where the last one ended, unless words of no dictionary stand between.
        opens = np.append(ends - (loads & 0x7FFFFFFF) - 1, len(text) - 1)
        closes = np.concatenate([[0], ends])
        gaps = np.flatnonzero(opens > closes)
        if not len(gaps):
            return loads
        between = [[self.payload(w) for w in text[a + 1 : b].split(" ")] for a, b in zip(closes[gaps].tolist(), opens[gaps].tolist())]
        return np.insert(loads, np.repeat(gaps, [len(x) for x in between]), np.fromiter(chain.from_iterable(between), np.int64))


_own = Dictionary()


def _spaced(texts: list[str | None]) -> Iterator[tuple[int, bytes, int]]:
    """(text, its words lower-cased with a space behind each, their number), in parts of about SCAN_BYTES cut between words."""
    for n, text in enumerate(texts):
        raw = (text or "").encode().translate(_TABLE)
        at = 0
        while at < len(raw) or not at:
            end = at + SCAN_BYTES
            end = len(raw) if end >= len(raw) else raw.find(b" ", end) % (len(raw) + 1)
            words = raw[at:end].split()
            yield n, b" ".join(words), len(words)
            at = max(end, 1)


def word_payloads(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The payloads of every whole text's words; null has none."""
    done: list[list[np.ndarray]] = [[] for _ in texts]
    run: list[tuple[int, bytes, int]] = []
    size = ready = 0

    def flush() -> None:
        loads = _own.scan((b" " + b" ".join([x for _, x, _ in run if x]) + b" ").decode("latin-1")) if any(x for _, x, _ in run) else np.zeros(0, np.int64)
        cuts = np.cumsum([k for _, _, k in run])[:-1]
        for (n, _, _), part in zip(run, np.split(loads, cuts)):
            done[n].append(part)
        run.clear()

    for item in _spaced(texts):
        run.append(item)
        size += len(item[1])
        if size >= SCAN_BYTES:
            flush()
            size = 0
            while ready < item[0]:  # all before the text in hand are whole
                yield np.concatenate(done[ready])
                done[ready] = []
                ready += 1
    if run:
        flush()
    for parts in done[ready:]:
        yield np.concatenate(parts)


def feature_buckets(loads: np.ndarray, most_run: int = MOST_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all runs of 1 to `most_run` words of a text, from the words' payloads."""
    crcs, lengths = (loads >> 31).astype(np.uint32), loads & 0x7FFFFFFF
    out, run = [crcs], crcs
    space = np.uint32(zlib.crc32(b" "))
    for n in range(2, min(most_run, len(loads)) + 1):
        spaced = combine(run[:-1], np.full(len(run) - 1, space), np.ones(len(run) - 1, np.int64))
        run = combine(spaced, crcs[n - 1 :], lengths[n - 1 :])
        out.append(run)
    return (np.concatenate(out) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, most_run: int = MOST_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket is met in the whole texts of `texts` (text); a task sends a row for a bucket at most."""
    common.tune(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for loads in word_payloads(batch.column(0).to_pylist()):
                total += np.bincount(feature_buckets(loads, most_run, buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: the log ratio of the smoothed shares, in thousandths, rounded down."""
    n = len(source)
    own, aim = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((aim + 1) * (own.sum() + n) / ((own + 1) * (aim.sum() + n)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, most_run: int = MOST_RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of `docs` (doc_id, text)."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for loads in word_payloads(batch.column(1).to_pylist()):
                own = feature_buckets(loads, most_run, len(gain))
                rows.append((len(loads), len(own), int(gain[own].sum())))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "n_words", "n_features", "weight"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = 2024) -> Column:
    """A draw from Gumbel's distribution, in thousandths, rounded down, that the seed and the doc_id fix; a null doc_id is empty."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, most_run: int = MOST_RUN, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of `docs` (doc_id long, text string): doc_id, n_features, weight, score, rank, all long.

    weight sums the gains of a document's features, the log ratio of their buckets' shares in `target` (text) and in `docs`;
    score adds Gumbel's noise, so that the highest scores are a draw without replacement in proportion to exp(weight / 1000).
    Of the documents with `least_words` words, `percent` in a hundred (rounded down) are drawn and have their rank from 1; ties
    go to the smaller doc_id, a null one last; rank is null for the rest. Null, empty and wordless texts have weight 0. Rows
    that repeat a doc_id are separate. Empty tables give an empty result; an empty target gives gains that favour rare
    buckets. Other columns are not read.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, most_run), bucket_counts(target, most_run))
    # Written before it is ordered: drawing the bounds of ranges reads all rows once more.
    weighted = common.materialize(weights(docs, gain, most_run), "importance-weights")
    scored = weighted.withColumn("score", F.col("weight") + gumbel(F.col("doc_id")))
    order = [(F.col("n_words") >= least_words).desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranged = scored.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order)
    # And before it is counted: bounds of ranges are drawn anew whenever a plan runs.
    ranged = common.materialize(ranged.withColumn("place", F.monotonically_increasing_id()), "importance-scored")
    common.release(weighted)
    ranged = ranged.withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1))
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"), F.count(F.when(F.col("n_words") >= least_words, 1)).alias("fit"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition.
    parts = parts.select(
        F.col("part").alias("own_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("fit").over(Window.partitionBy()).alias("fit"),
    )
    placed = ranged.join(F.broadcast(parts), F.col("part") == F.col("own_part"))
    rank = F.col("before") + F.col("place") + 1
    drawn = (F.col("n_words") >= least_words) & (rank <= F.floor(F.col("fit") * percent / 100))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, rank).alias("rank"))
