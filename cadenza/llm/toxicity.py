"""Toxicity by a factorization machine over hashed terms.

The machine adds to the weights of a text's terms the interaction of every pair of them, through a short vector for
each term, so that two terms can say together what neither says alone. Terms are learnt that say something alone, and
those of the pairs that say something together. Texts are hashed and scored where they are; the driver fits the machine
on a bounded sample of labelled rows, of which it gets the terms in question only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common, kernels

#: Terms are hashed into so many buckets.
BUCKETS = 1 << 20
#: Length of a term's vector in each of the fits, which differ in their first vectors and are averaged.
FACTORS, FITS = 4, 2
#: Most labelled rows that a fit takes: those with the smallest hash of doc_id.
MOST_ROWS = 20_000
#: A term is learnt if it is in so many labelled texts and the chi-square of its presence and the label is so large.
LEAST_TEXTS, LEAST_CHI = 4, 10.8
#: Pairs are searched among so many terms, the most frequent ones that are in at most half of the texts; of a pair each of
#: the four cases needs so many texts, and their contrast so many standard deviations; so many pairs count at most.
PAIRED_TERMS, LEAST_CASES, LEAST_CONTRAST, MOST_PAIRS = 1_000, 8, 6.0, 500
#: Most terms that say something alone: those with the largest chi-square.
MOST_TERMS = 30_000
THRESHOLD = 0.3
EPOCHS, RATE = 150, 0.1
#: Decay of weights and of vectors.
DECAY = (1e-4, 3e-3)


def term_buckets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct buckets of each text's terms: runs of letters and digits, lower-cased A-Z."""
    starts, ends, rows = kernels.find_words(raw, offsets, alnum=True)
    bucket = (kernels.hash_words(raw, starts, ends, lower=True) >> np.uint64(64 - 20)).astype(np.int32)
    bounds = kernels.row_bounds(rows, len(offsets) - 1).tolist()
    return [np.unique(bucket[a:b]) for a, b in zip(bounds, bounds[1:])]


@dataclass
class Machine:
    """bias, then for each learnt bucket (ascending) its weight and vector."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def rows_of(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(text, learnt term) of every learnt term in the texts."""
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        every = np.concatenate(sets) if sets else np.zeros(0, np.int32)
        if not len(self.buckets):
            return row[:0], row[:0]
        at = np.minimum(np.searchsorted(self.buckets, every), len(self.buckets) - 1)
        known = self.buckets[at] == every
        return row[known], at[known]

    def margin(self, row: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The log odds of n texts, and the sums of their vectors."""
        total = np.zeros((n, self.vectors.shape[1]))
        square = np.zeros(n)
        linear = np.bincount(row, self.weights[term], n) if len(row) else np.zeros(n)
        for k in range(self.vectors.shape[1] if len(row) else 0):
            own = self.vectors[term, k]
            total[:, k] = np.bincount(row, own, n)
            square += np.bincount(row, own * own, n)
        return self.bias + linear + 0.5 * ((total**2).sum(axis=1) - square), total

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        row, term = self.rows_of(sets)
        margin, _ = self.margin(row, term, len(sets))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def telling(texts: np.ndarray, hits: np.ndarray, n: float, ones: float) -> np.ndarray:
    """Whether each term says something alone, from the numbers of texts and of texts with label 1 that have it."""
    cross = hits * (n - ones - (texts - hits)) - (texts - hits) * (ones - hits)
    chi = n * cross**2 / np.maximum(1e-9, texts * (n - texts) * ones * (n - ones))
    good = (texts >= LEAST_TEXTS) & (chi >= LEAST_CHI)
    if good.sum() > MOST_TERMS:
        good[np.argsort(np.where(good, -chi, 0), kind="stable")[MOST_TERMS:]] = False
    return good


def common_terms(texts: np.ndarray, n: float) -> np.ndarray:
    """Whether each term is among those whose pairs are searched."""
    fit_ = np.flatnonzero((texts >= 2 * LEAST_CASES) & (texts <= n - 2 * LEAST_CASES))
    # Rare and very frequent terms leave one of the four cases of a pair empty.
    order = fit_[np.argsort(-np.minimum(texts, n - texts)[fit_], kind="stable")[:PAIRED_TERMS]]
    out = np.zeros(len(texts), bool)
    out[order] = True
    return out


def telling_pairs(row: np.ndarray, term: np.ndarray, m: int, y: np.ndarray) -> np.ndarray:
    """Whether each of m terms is in a pair that says what its terms do not say alone: the label's share among texts with
    both or neither differs from that among texts with one of them."""
    n = len(y)
    both, hits = np.zeros((m, m), np.float32), np.zeros((m, m), np.float32)
    cuts = np.searchsorted(row, np.arange(0, n + 2048, 2048))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        some = np.zeros((min(2048, n - k * 2048), m), np.float32)
        some[row[a:b] - k * 2048, term[a:b]] = 1
        both += some.T @ some
        hits += (some * y[k * 2048 : k * 2048 + len(some), None].astype(np.float32)).T @ some
    alone, alone_hits, ones = np.diag(both).copy(), np.diag(hits).copy(), y.sum()
    found: list[tuple[float, int, int]] = []
    for k in range(0, m, 250):
        some, some_hits, own, own_hits = both[k : k + 250], hits[k : k + 250], alone[k : k + 250, None], alone_hits[k : k + 250, None]
        contrast, variance, least = 0.0, 0.0, np.inf
        for sign, count, hit in (
            (1, some, some_hits), (-1, own - some, own_hits - some_hits), (-1, alone - some, alone_hits - some_hits),
            (1, n - own - alone + some, ones - own_hits - alone_hits + some_hits),
        ):
            share = (hit + 0.5) / (count + 1)
            contrast = contrast + sign * share
            variance = variance + share * (1 - share) / (count + 1)
            least = np.minimum(least, count)
        score = np.where(least >= LEAST_CASES, np.abs(contrast) / np.sqrt(variance), 0)
        a, b = np.nonzero(score >= LEAST_CONTRAST)
        found += [(-float(score[i, j]), i + k, j) for i, j in zip(a.tolist(), b.tolist()) if i + k < j]
        found = sorted(found)[:MOST_PAIRS]
    out = np.zeros(m, bool)
    out[[x for _, i, j in found for x in (i, j)]] = True
    return out


def _fit_once(machine: Machine, row: np.ndarray, term: np.ndarray, y: np.ndarray) -> None:
    """Full-batch AdaGrad on the log loss with weight decay."""
    n, m = len(y), len(machine.weights)
    power = [1e-8, np.full(m, 1e-8), np.full(machine.vectors.shape, 1e-8)]
    for _ in range(EPOCHS):
        margin, total = machine.margin(row, term, n)
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / n
        each = error[row]
        d_weight = np.bincount(term, each, m) + DECAY[0] * machine.weights
        d_vector = DECAY[1] * machine.vectors
        for k in range(machine.vectors.shape[1]):
            d_vector[:, k] += np.bincount(term, each * (total[row, k] - machine.vectors[term, k]), m)
        d_bias = float(error.sum())
        for k, gradient in enumerate((d_bias, d_weight, d_vector)):
            power[k] = power[k] + gradient**2
        machine.bias -= 2 * RATE * d_bias / float(np.sqrt(power[0]))
        machine.weights -= 4 * RATE * d_weight / np.sqrt(power[1])
        machine.vectors -= RATE * d_vector / np.sqrt(power[2])


def fit(sets: list[np.ndarray], labels: np.ndarray, seed: int = 7, factors: int = FACTORS) -> Machine:
    """A machine for texts as sets of buckets with labels 0 and 1; without texts it answers 0.5, with one label nearly that label.

    The mean of FITS machines is a machine: its weights are their mean, its vectors stand side by side."""
    y = labels.astype(np.float64)
    n, ones = len(y), float(y.sum())
    prior = (ones + 0.5) / (n + 1)
    empty = Machine(float(np.log(prior / (1 - prior))), np.zeros(0, np.int32), np.zeros(0), np.zeros((0, factors)))
    if not 0 < ones < n:
        return empty
    row = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    buckets, term = np.unique(np.concatenate(sets), return_inverse=True)
    texts = np.bincount(term, minlength=len(buckets)).astype(np.float64)
    chosen = telling(texts, np.bincount(term, y[row], len(buckets)), n, ones)
    some = common_terms(texts, n)
    if factors and some.sum() > 1:
        place = np.cumsum(some) - 1
        chosen[np.flatnonzero(some)[telling_pairs(row[some[term]], place[term[some[term]]], int(some.sum()), y)]] = True
    if not chosen.any():
        return empty
    keep = chosen[term]
    row, term = row[keep], (np.cumsum(chosen) - 1)[term[keep]]
    m = int(chosen.sum())
    fits = []
    for k in range(FITS if factors else 1):
        fits.append(Machine(empty.bias, buckets[chosen], np.zeros(m), np.random.default_rng(seed + k).normal(0, 0.05, (m, factors))))
        _fit_once(fits[-1], row, term, y)
    return Machine(
        float(np.mean([f.bias for f in fits])), buckets[chosen], np.mean([f.weights for f in fits], axis=0), np.concatenate([f.vectors for f in fits], axis=1) / np.sqrt(len(fits))
    )


def held_out(doc_id: Column) -> Column:
    """Whether a row is left out of fitting: crc32 of the doc_id as text has the remainder 2 by 4; a null doc_id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, factors: int = FACTORS) -> Machine:
    """Fits on the texts of `docs` (doc_id, text) with a label in `labels` (doc_id, toxic), held-out ones excepted.

    At most `most_rows` labelled ids (bounded whatever the input) are taken, which are broadcast to the texts; of several
    labels of an id 1 counts; null labels and ids are left out. The driver gets counts of the buckets, and of each text
    the terms that may be learnt, of which there are at most MOST_TERMS and PAIRED_TERMS."""
    common.tune(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("label")).dropna()
    known = known.filter(~held_out(F.col("l_id"))).groupBy("l_id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("l_id"), "l_id").limit(most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, _, raw, offsets in kernels.slices(batch.column(1)) for s in term_buckets(raw, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["label", "buckets"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))
    found = common.materialize(texts.select("label", "text").mapInArrow(run, "label int, buckets array<int>"), "toxicity-sample")
    n, ones = found.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = found.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("texts"), F.sum("label").alias("hits"))
    counts = counts.filter(F.col("texts") >= LEAST_TEXTS).toPandas().sort_values("bucket")
    texts_, hits = counts["texts"].to_numpy(np.float64), counts["hits"].to_numpy(np.float64)
    wanted = counts["bucket"].to_numpy(np.int32)[telling(texts_, hits, n, ones) | common_terms(texts_, n)] if 0 < ones < n else np.zeros(0, np.int32)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = batch.column(1).flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])
            keep = np.zeros(len(flat), bool)
            if len(wanted):
                keep = wanted[np.minimum(np.searchsorted(wanted, flat), len(wanted) - 1)] == flat
            sets = [flat[a:b][keep[a:b]].tobytes() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["label", "buckets"])

    narrowed = found.mapInArrow(narrow, "label int, buckets binary").toPandas()
    common.release(found)
    # The order of the rows must not matter for the sums of the fit.
    narrowed = narrowed.sort_values(["label", "buckets"], kind="stable")
    return fit([np.frombuffer(x, np.int32) for x in narrowed["buckets"]], narrowed["label"].to_numpy(np.int64), factors=factors)


def score(text: Column, machine: Machine) -> Column:
    """The probability of label 1 of every whole text; null is empty."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        parts = [machine.scores(term_buckets(raw, offsets)) for _, _, raw, offsets in kernels.slices(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id long, text string): doc_id, held_out, score, predicted.

    score is the probability of the label `toxic` of `labels` (doc_id, toxic) from 0 to 1, from the text alone; a
    null or empty text has that of a text without terms. predicted is 1 from 0.3 on. Rows that repeat a doc_id are
    separate. An empty table gives an empty result, empty labels one score for all. Other columns are not read.
    """
    machine = learn(docs, labels)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text"), machine).alias("score"))
    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that toxicity() does not predict to be toxic.

    Nulls, empty tables and columns of any name are handled as there."""
    machine = learn(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return docs.filter(score(docs["text"], machine) < THRESHOLD)
