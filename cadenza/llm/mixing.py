"""Mixing sources to target weights by the cube method of balanced sampling.

Every document gets floor(rate) copies and a fractional inclusion probability, the rest of its source's rate. The
flight phase moves these probabilities along the null space of the constraints (documents and words taken), so that the largest
document lands next and all others make up for it, until at most two in a chunk are fractional; those meet again in larger
chunks, so that at last a source has at most two small documents left to land. No step changes a document's probability.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm import common

#: Weights of the sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Most copies of a document, and of a source's size.
MOST = 3
#: Documents of a chunk in one flight.
CHUNK = 2_000
_EPS = 1e-9


def words_in(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, documents) with weight and target by water filling.

    Sources are in code point order, null last; a target stops at MOST times its source's size and the excess goes
    to the others by weight. The sources that stop are those with the smallest size by weight: behind each of them,
    in that order, the level of the rest is known from prefix sums.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    n = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (n % len(WEIGHTS) + 1).cast("int"))
    known = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * MOST).withColumn("rank", n)
    known = known.withColumn("fills_at", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("fills_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    from_here = Window.orderBy("fills_at", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    known = known.withColumn("level", level)
    # The first source, in this order, that the level does not fill sets the level of all behind it.
    free = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "rank", "level"))).over(every)
    return known.withColumn("free", free).withColumn(
        "target", F.when(F.col("free").isNull() | (F.col("cap") <= F.col("free.level") * F.col("weight")), F.col("cap")).otherwise(F.col("free.level") * F.col("weight"))
    ).select("source", "source_size", "documents", "target")


def _direction(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A direction in which the first document moves by one, and the others together against it by one document and its words.

    The others share it by their room to move, min(x, 1 - x), with an affine function of their sizes."""
    room, own = np.minimum(x[1:], 1 - x[1:]), size[1:]
    a, b, c = room.sum(), (room * own).sum(), (room * own * own).sum()
    det = a * c - b * b
    if det > 1e-9 * a * c:
        rest = room * ((b * size[0] - c) + (b - a * size[0]) * own) / det
    elif b > 0:  # all others have one size: words are kept
        rest = -room * size[0] / b
    else:
        rest = -room / a
    return np.concatenate([[1.0], rest])


def _fly(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase: probabilities of which at most two stay fractional, with sum(x * size) kept, and sum(x) as long as
    the documents left have several sizes. Documents land in the order given, so that those left are among the last."""
    x = pi.copy()
    live = np.arange(len(x))
    while True:
        near = np.minimum(x[live], 1 - x[live]) <= _EPS
        x[live[near]] = np.round(x[live[near]])
        live = live[~near]
        if len(live) <= 2:
            return x
        own = x[live]
        u = _direction(own, size[live])
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - own) / u, np.where(u < 0, own / -u, np.inf))
            down = np.where(u > 0, own / u, np.where(u < 0, (1 - own) / -u, np.inf))
        if rng.random() * (up.min() + down.min()) < down.min():
            step, lands = up.min(), int(up.argmin())
        else:
            step, lands = -down.min(), int(down.argmin())
        x[live] = np.clip(own + step * u, 0, 1)
        x[live[lands]] = np.round(x[live[lands]])


def _land(x: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The landing phase for at most two documents: first the words are kept alone, then each is drawn. Probabilities hold throughout."""
    open_ = np.flatnonzero((x > 0) & (x < 1)).tolist()
    if len(open_) == 2:
        a, b = open_
        u = (float(size[b]), -float(size[a]))
        if u == (0.0, 0.0):
            u = (1.0, -1.0)
        up = min((1 - x[k]) / v if v > 0 else x[k] / -v for k, v in zip(open_, u) if v)
        down = min(x[k] / v if v > 0 else (1 - x[k]) / -v for k, v in zip(open_, u) if v)
        step = up if rng.random() * (up + down) < down else -down
        for k, v in zip(open_, u):
            x[k] = min(1.0, max(0.0, x[k] + step * v))
    for k in open_:
        if _EPS < x[k] < 1 - _EPS:
            x[k] = float(rng.random() < x[k])
        x[k] = round(x[k])
    return x


_UNITS = "doc_id long, size long, source string, seed long, chunk long, last boolean, pi double"


def _flight(group: pd.DataFrame) -> pd.DataFrame:
    # Large documents first, so that a small one is left to land.
    group = group.sort_values(["size", "seed", "doc_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
    size = group["size"].to_numpy(np.float64)
    rng = np.random.default_rng(group["seed"].to_numpy(np.int64).view(np.uint64))
    x = _fly(group["pi"].to_numpy(np.float64), size, rng)
    if group["last"].iloc[0]:
        x = _land(x, size, rng)
    return group.assign(pi=x)


def mix_sources(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id long, text string, source string): doc_id, source, size, source_size, target, taken, copies.

    size is the number of words; a null or empty text has none. The words that a source's documents take, repeats
    counted, come near its target; no document is taken more than three times. Draws
    are hashes of doc_id and size, so reruns agree. Rows that repeat a doc_id are separate documents. A source
    without words has target zero. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    common.tune(spark)
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_in(F.col("text")).alias("size"), "source")
    units = common.materialize(units, "mix-units")
    sizes = targets(units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")))
    sizes = common.materialize(sizes, "mix-sources")
    renamed = sizes.select(F.col("source").alias("s"), "source_size", "documents", "target")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(F.lit(0.0))
    seed = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "size", F.lit("mix"))
    flying = (
        units.join(common.sized(renamed, limit=100_000), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("pi", rate - F.floor(rate)).withColumn("seed", seed)
        .withColumn("chunks", F.ceil(F.col("documents") / CHUNK))
    )
    most = sizes.agg(F.max("documents")).first()[0] or 0
    done = None
    while True:
        dealt = flying.select(
            "doc_id", "size", "source", "seed", F.pmod(F.xxhash64("seed", F.lit(most)), F.col("chunks")).alias("chunk"), (F.col("chunks") <= 1).alias("last"), "pi"
        )
        flown = common.materialize(dealt.groupBy("source", "chunk").applyInPandas(_flight, _UNITS), "mix-flown")
        closed = flown.filter("last or pi = 0 or pi = 1")
        done = closed if done is None else done.unionByName(closed)
        if most <= CHUNK:
            break
        left = flown.filter("not last and pi > 0 and pi < 1")
        most = 2 * -(-most // CHUNK)
        # A source with C chunks has at most 2 C documents left.
        counts = left.groupBy(F.col("source").alias("s2")).agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        flying = left.join(common.sized(counts, limit=100_000), F.col("source").eqNullSafe(F.col("s2"))).select("doc_id", "size", "source", "seed", "chunks", "pi")
    out = done.join(common.sized(renamed, limit=100_000), F.col("source").eqNullSafe(F.col("s")))
    copies = (F.floor(rate) + F.col("pi")).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, each as often as mix_sources() takes it.

    Rows alike in doc_id, size and source share what they are given together, as evenly as it goes: the words taken are
    the same. Nulls, empty tables and columns of any name are handled as there."""
    mixed = common.materialize(mix_sources(docs.select("doc_id", "text", "source")), "mix-taken")
    share = mixed.groupBy("doc_id", "size", "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("alike"))
    share = common.materialize(share.filter("copies > 0").withColumnsRenamed({"doc_id": "m_id", "size": "m_size", "source": "m_source"}), "mix-share")
    rows = common.wrapped(docs, own_id=docs["doc_id"].cast("long"), own_size=words_in(docs["text"]), own_source=docs["source"])
    same = F.col("own_id").eqNullSafe(F.col("m_id")) & F.col("own_source").eqNullSafe(F.col("m_source")) & (F.col("own_size") == F.col("m_size"))
    rows = rows.join(common.sized(share), same)
    single = rows.filter("alike = 1").select("row", "copies")
    several = rows.filter("alike > 1").select("row", "copies", "alike", "m_id", "m_size", "m_source")
    if share.filter("alike > 1").limit(1).count():
        # Which of the alike rows a row is: its number in its partition, behind those of earlier partitions.
        several = common.materialize(several.withColumn("part", F.spark_partition_id()), "mix-alike")
        key = ["m_id", "m_size", "m_source"]
        before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = several.groupBy(*key, "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
        counts = counts.select(*[F.col(k).alias("c_" + k) for k in key], F.col("part").alias("c_part"), "before")
        here = F.row_number().over(Window.partitionBy(*key, "part").orderBy(F.lit(1)))
        placed = several.withColumn("here", here).join(counts, (F.col("part") == F.col("c_part")) & F.col("m_id").eqNullSafe(F.col("c_m_id"))
            & F.col("m_size").eqNullSafe(F.col("c_m_size")) & F.col("m_source").eqNullSafe(F.col("c_m_source")))
        extra = (F.col("before") + F.col("here") <= F.col("copies") % F.col("alike")).cast("long")
        single = single.unionByName(placed.select("row", (F.floor(F.col("copies") / F.col("alike")) + extra).alias("copies")).filter("copies > 0"))
    return single.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select("row.*")
