"""Statistics of metric tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import sequence


def guarded_corr(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson correlation; NULL for fewer than three pairs or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    ok = (F.count(a) >= least) & (F.stddev_pop(a) >= 1e-9) & (F.stddev_pop(b) >= 1e-9)
    return F.when(ok, F.corr(a, b))


def average_rank(df: DataFrame, column: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Ranks with ties averaged, from one row per distinct value and its prefix count: rows are aggregated before they are
    ordered, and distinct values are range-partitioned, so that no task sorts them all."""
    keys = keys or []
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("__c"))
    if keys:
        before = F.coalesce(F.sum("__c").over(Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = counts.withColumn("__before", before)
    else:
        ranked = sequence.prefix_sums(counts, [column], F.col("__c"), "__before")
    ranked = ranked.withColumn(name, F.col("__before") + (F.col("__c") + 1) / 2.0).drop("__c", "__before")
    return df.join(ranked, [*keys, column])


def quantiles(df: DataFrame, column: str, shares: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """Exact quantiles of the values that are there, linear between two, within the keys: a column for each name in `shares`.

    Values are counted before they are ordered; distinct values are range-partitioned and numbered by prefix counts, so that no
    task and no buffer holds all values of a key. A key without values has no row."""
    wanted, keys = keys or [], keys or ["__one"]
    counts = df.withColumn("__one", F.lit(1)).filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("__v")).agg(F.count("*").alias("__c"))
    placed = sequence.prefix_sums(counts, [*keys, "__v"], F.col("__c"), "__before")
    # Of each key its first place and its number of values.
    total = placed.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min("__before").alias("__first"), F.sum("__c").alias("__n"))
    both = placed.join(total, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    low = F.col("__before") - F.col("__first")
    at = {name: (F.col("__n") - 1) * share for name, share in shares.items()}
    value = lambda place: F.max(F.when((place >= low) & (place < low + F.col("__c")), F.col("__v")))
    found = both.groupBy(*keys).agg(*[x for name, p in at.items() for x in (value(F.floor(p)).alias(f"__a_{name}"), value(F.ceil(p)).alias(f"__b_{name}"), F.max(p - F.floor(p)).alias(f"__f_{name}"))])
    return found.select(*wanted, *[(F.col(f"__a_{n}") + (F.col(f"__b_{n}") - F.col(f"__a_{n}")) * F.col(f"__f_{n}")).alias(n) for n in shares])


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    ranked = average_rank(average_rank(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "__rx"), y, "__ry")
    return ranked.agg(guarded_corr(F.col("__rx"), F.col("__ry")).alias("spearman"), F.count("*").alias("n"))


def bootstrap(long: DataFrame, by: str, n_boot: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Poisson bootstrap of the mean of `value` within `by`: each row's weights come from its hash, so no group is gathered.

    Weights of resample b are Poisson(1), drawn by inverting its distribution on a hash of the row and b. A task sums all
    resamples of its rows, so that a row for each resample, group and batch is shuffled and none for each row."""
    rows = long.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    keyed = rows.select(F.col(by), F.xxhash64(*[F.col(c) for c in long.columns], F.lit(seed)).alias("key"), "value")
    # The cumulative Poisson(1) distribution.
    cumulative = np.cumsum([np.exp(-1) / float(np.prod(np.arange(1, k + 1))) for k in range(8)])
    steps = np.arange(n_boot, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, part in batch.groupby(by):
                sums, weights = np.zeros(n_boot), np.zeros(n_boot)
                keys, values = part["key"].to_numpy(np.int64).view(np.uint64), part["value"].to_numpy(float)
                for a in range(0, len(part), 500):
                    x = keys[a : a + 500, None] + steps
                    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    w = np.searchsorted(cumulative, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53))
                    sums += values[a : a + 500] @ w
                    weights += w.sum(axis=0)
                yield pd.DataFrame({by: group, "b": np.arange(n_boot), "s": sums, "w": weights})

    kind = rows.schema[by].dataType.simpleString()
    drawn = keyed.mapInPandas(draw, f"`{by}` {kind}, b long, s double, w double")
    means = drawn.groupBy(by, "b").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m"))
    interval = means.groupBy(by).agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))
    return rows.groupBy(by).agg(F.avg("value").alias("mean"), F.count("*").alias("n")).join(interval, by)


def wilcoxon(df: DataFrame, x: str, y: str) -> DataFrame:
    """Signed-rank test with zero differences split, normal approximation with ties: w_plus, z, n; NULL z below three pairs."""
    diffs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select((F.col(x) - F.col(y)).alias("d")).withColumn("a", F.abs("d"))
    ranked = average_rank(diffs, "a", "r")
    half = F.when(F.col("d") > 0, F.col("r")).when(F.col("d") == 0, F.col("r") / 2).otherwise(0.0)
    total = ranked.agg(F.sum(half).alias("w_plus"), F.sum("r").alias("all"), F.sum(F.col("r") * F.col("r")).alias("squares"), F.count("*").alias("n"), F.count_if(F.col("d") != 0).alias("moved"))
    z = F.try_divide(F.col("w_plus") - F.col("all") / 2, F.sqrt(F.col("squares") / 4))
    return total.select("w_plus", F.when((F.col("n") >= 3) & (F.col("moved") > 0), z).alias("z"), "n")
