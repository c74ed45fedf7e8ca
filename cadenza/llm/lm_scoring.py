"""Scores of texts by a hidden Markov language model that is trained on them.

Latent states move from token to token and emit the tokens. Baum-Welch counts of all training texts are added up in each
partition and then across partitions, a row per token; the driver, which holds the model alone, makes the next one of them.
The scaled forward recursion gives the exact likelihood of every whole text. The most frequent MOST_SYMBOLS tokens are
symbols of the model; the others, however many, are emitted together as one symbol and drawn by their own counts, which
tables on the cluster hold and a join brings to them.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common, hidden_markov
from cadenza.llm.hidden_markov import Batch, Counts, Model

STATES, ROUNDS = 12, 4
#: Tokens that are symbols of their own at most; they and the model are all that the driver and each task hold.
MOST_SYMBOLS = 120_000
#: Share of the states' common distribution in each state's emissions, and of uniform moves.
SMOOTHING, RESTLESS = 0.05, 1e-4
#: Different tokens that a task counts before it sends their counts on.
HELD_WORDS = 400_000
#: A longer word goes by its SHA-256 behind a line feed, which no word has; the line feed alone is the end of a text.
LONGEST_WORD, END = 64, b"\n"
PART_BYTES = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = bytes(b if b not in b"\t\n\x0b\x0c\r" else 32 for b in range(256))


def held_out(doc_id: Column) -> Column:
    """Whether a row is left out of training: crc32 of the doc_id as text has the remainder 1 by 5; a null doc_id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def _parts(text: str | None) -> Iterator[list[bytes]]:
    """The tokens of a text, a part of about PART_BYTES at a time, the end in the last."""
    raw = (text or "").encode().translate(_LOWER).translate(_SPACE)
    at = 0
    while at < len(raw):
        end = at + PART_BYTES
        end = len(raw) if end >= len(raw) else raw.find(b" ", end) % (len(raw) + 1)
        words = raw[at:end].split()
        if len(max(words, key=len, default=b"")) > LONGEST_WORD:
            words = [w if len(w) <= LONGEST_WORD else END + hashlib.sha256(w).hexdigest().encode() for w in words]
        yield words
        at = end
    yield [END]


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the whole texts of `texts` (text); tasks add up what they read before anything is shuffled."""

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words in _parts(text):
                    held.update(words)
                if len(held) > HELD_WORDS:
                    yield rows(held)
                    held = Counter()
        if held:
            yield rows(held)

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The words, and their counts, above the least count that no more than `most` words reach, the end first, which always is one.

    Counts are told apart by sixteenths of their power of two, so that the driver gets a few hundred numbers to choose from."""
    step = F.floor(F.log2("n") * 16).alias("step")
    fine = counts.filter(F.length("word") <= LONGEST_WORD).groupBy(step).agg(F.count("*").alias("words")).toPandas().sort_values("step", ascending=False)
    within = fine["step"][fine["words"].cumsum() <= most]
    if not len(fine):
        return [], np.zeros(0, np.int64)
    least = int(within.min()) if len(within) else int(fine["step"].max()) + 1
    some = counts.filter((step >= least) & ~F.startswith("word", F.lit(END.decode())) | (F.col("word") == END.decode())).toPandas()
    some = some.sort_values(["n", "word"], ascending=[False, True], kind="stable")
    words = [w.encode() for w in some["word"]]
    first = words.index(END)
    order = [first, *range(first), *range(first + 1, len(words))]
    return [words[i] for i in order], some["n"].to_numpy(np.int64)[order]


def encode(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """(row, doc_id, held_out, ids, others): the number of each token among `words`, len(words) for any other; those with their counts."""
    other = len(words)
    known = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(known.value)}
        for batch in batches:
            every, rest, times, sizes = [], [], [], [0]
            for text in batch.column(2).to_pylist():
                parts, unlike = [], Counter()
                for tokens in _parts(text):
                    ids = np.fromiter(map(number.get, tokens, repeat(other)), np.int32, len(tokens))
                    unlike.update([tokens[i] for i in np.flatnonzero(ids == other).tolist()])
                    parts.append(ids)
                every.append(np.concatenate(parts).tobytes())
                rest += unlike
                times += unlike.values()
                sizes.append(len(rest))
            items = pa.StructArray.from_arrays([pa.array(rest, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], ["word", "n"])
            others = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(every, pa.binary()), others], names=["doc_id", "held_out", "ids", "others"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    out = own.mapInArrow(run, "doc_id long, held_out boolean, ids binary, others array<struct<word: string, n: long>>")
    return out.withColumn("row", F.monotonically_increasing_id())


def first_model(shares: np.ndarray, states: int = STATES, seed: int = 12) -> Model:
    """States that stay, each with the common emissions `shares` changed by chance, which is what tells them apart at first."""
    draw = np.random.default_rng(seed)
    emits = shares[:, None] * np.exp(draw.normal(0, 0.5, (len(shares), states)))
    moves = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(moves, 0.95)
    return Model(np.full(states, 1 / states), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))


def next_model(counts: Counts, shares: np.ndarray) -> Model:
    """The model of expected counts, smoothed."""
    k = len(counts.start)
    emits = counts.emits / np.maximum(counts.emits.sum(axis=0), 1e-300)
    emits = (1 - SMOOTHING) * emits + SMOOTHING * shares[:, None]
    moves = counts.moves / np.maximum(counts.moves.sum(axis=1, keepdims=True), 1e-300)
    start = counts.start / max(counts.start.sum(), 1e-300)
    model = Model((1 - RESTLESS) * start + RESTLESS / k, (1 - RESTLESS) * moves + RESTLESS / k, emits)
    return Model(model.start / model.start.sum(), model.moves / model.moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))


def expected(encoded: DataFrame, model: Model) -> Counts:
    """Baum-Welch counts of all rows of `encoded` (ids): a task sends a row for each symbol that it met."""
    k, n = len(model.start), len(model.emits)
    # Single precision holds the scaled vectors; counts are double.
    sent = encoded.sparkSession.sparkContext.broadcast(Model(model.start.astype(np.float32), model.moves.astype(np.float32), model.emits.astype(np.float32)))
    names = [f"s{j}" for j in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counts(np.zeros(k), np.zeros((k, k)), np.zeros((n, k)))
        sequences = (np.frombuffer(x, np.int32) for batch in batches for x in batch.column(0).to_pylist())
        for group in hidden_markov.batches(sequences):
            Batch(sent.value, group, True).count(total)
        met = np.flatnonzero(total.emits.any(axis=1))
        rows = np.concatenate([total.emits[met], total.moves, total.start[None], np.full((1, k), total.log)])
        symbol = np.concatenate([met, -1 - np.arange(k + 2)])
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(symbol, pa.int64()), *[pa.array(rows[:, j]) for j in range(k)]], names=["symbol", *names])

    found = encoded.select("ids").mapInArrow(run, "symbol long, " + ", ".join(f"{c} double" for c in names))
    found = found.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    sent.unpersist()
    rows, symbol = found[names].to_numpy(), found["symbol"].to_numpy()
    emits, rest = np.zeros((n, k)), np.zeros((k + 2, k))
    emits[symbol[symbol >= 0]] = rows[symbol >= 0]
    rest[-1 - symbol[symbol < 0]] = rows[symbol < 0]
    return Counts(rest[k], rest[:k], emits, float(rest[k + 1, 0]))


def train(encoded: DataFrame, counts: np.ndarray, other: float, single_others: float, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model of the rows of `encoded` (ids) after `rounds` of Baum-Welch, and the log likelihood that each round found.

    counts: of each symbol; other: occurrences of all other tokens; single_others: how many of them occurred once. Tokens of no
    training text are as likely as those that occurred once (Good and Turing), so the last symbol gets their occurrences too."""
    once = np.flatnonzero(counts == 1)
    total = np.append(counts, other + single_others + len(once) + 0.5).astype(np.float64)
    shares = total / total.sum()
    model, logs = first_model(shares, states), []
    for _ in range(rounds if len(counts) else 0):
        found = expected(encoded, model)
        logs.append(found.log)
        if other:
            found.emits[-1] *= (other + single_others) / other
        found.emits[-1] += found.emits[once].sum(axis=0)
        model = next_model(found, shares)
    return model, logs


def _score(encoded: DataFrame, model: Model, base: np.ndarray) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, symbols, base, log): tokens, how many are symbols, their base score, and the sequence's log10."""
    other = len(base)
    sent = encoded.sparkSession.sparkContext.broadcast((model, np.append(base, 0.0)))
    names = ["row", "doc_id", "held_out", "n_tokens", "symbols", "base", "log"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, single = sent.value
        for batch in batches:
            sequences = [np.frombuffer(x, np.int32) for x in batch.column(3).to_pylist()]
            logs = [x for group in hidden_markov.batches(iter(sequences)) for x in Batch(own, group, False).logs().tolist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2), pa.array([len(s) for s in sequences], pa.int64()), pa.array([int((s < other).sum()) for s in sequences], pa.int64()),
                pa.array([float(single[s].sum()) for s in sequences], pa.float64()), pa.array(np.array(logs, np.float64) / np.log(10)),
            ], names=names)

    return encoded.select("row", "doc_id", "held_out", "ids").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, symbols long, base double, log double")


def score_texts(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, most_symbols: int = MOST_SYMBOLS) -> DataFrame:
    """One row per row of `docs` (doc_id long, text string): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words, lower-cased A-Z, and one end of each text; null and empty texts have the end alone. The model and the
    counts learn from the rows that are not held out; a null doc_id is not. base_score is the log10 of the tokens' smoothed
    shares; score the log10 probability of the whole text by the model, where a token of no training text is the one unknown
    token. Rows that repeat a doc_id are separate. Without rows to learn from both scores are 0. An empty table gives an empty
    result. Other columns are not read.
    """
    common.tune(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    counts = common.materialize(word_counts(texts.filter(~held_out(F.col("doc_id")))), "lm-counts")
    n, v, once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count(F.when(F.col("n") == 1, 1))).first()
    words, own = frequent(counts, most_symbols)
    encoded = common.materialize(encode(texts, words), "lm-encoded")
    other, single_others = int(n - own.sum()), int(once - (own == 1).sum())
    model, _ = train(encoded.filter("not held_out"), own, other, single_others, states, rounds)

    floor = n + 0.5 * (v + 1)
    scored = _score(encoded, model, np.log10((own + 0.5) / floor))
    # The tokens that are no symbols: what the base and the last symbol give each of them.
    unknown = single_others + float((own == 1).sum()) + 0.5
    below = other + 0.5 * (v - len(own)) + unknown
    rest = encoded.select("row", F.explode("others").alias("o")).select("row", "o.word", F.col("o.n").alias("times"))
    if v > len(own):
        tail = counts.select(F.col("word").alias("known"), "n")
        rest = rest.join(tail, F.col("word") == F.col("known"), "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    else:
        rest = rest.select("row", "times", F.lit(0).cast("long").alias("n"))
    share = F.when(F.col("n") > 0, F.col("n") + 0.5).otherwise(unknown) / below
    sums = rest.groupBy(F.col("row").alias("r_row")).agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("r_known"), F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / floor)).alias("r_base"),
        F.sum(F.col("times") * F.log10(share)).alias("r_log"),
    )
    joined = scored.join(sums, F.col("row") == F.col("r_row"), "left")
    nothing = F.lit(0.0)
    if not n:  # nothing to learn from: one token, which is certain
        out = joined.select("doc_id", "held_out", "n_tokens", F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), nothing.alias("base_score"), nothing.alias("score"))
    else:
        out = joined.select(
            "doc_id", "held_out", "n_tokens", (F.col("symbols") + F.coalesce("r_known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("r_base", nothing)).alias("base_score"), (F.col("log") + F.coalesce("r_log", nothing)).alias("score"),
        )
    out = common.materialize(out, "lm-scores")
    common.release(counts, encoded)
    return out
