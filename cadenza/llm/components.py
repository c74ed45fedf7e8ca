"""Connected components of a distributed link table: union-find in each partition, then star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common


def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the links of a batch: each node that is not its group's smallest, with the smallest."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(find(x), x) for x in parent]
        yield pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["a", "b"], dtype="int64")


def _stars(links: DataFrame) -> DataFrame:
    return links.mapInPandas(forest, "a long, b long")


def _fingerprint(links: DataFrame) -> tuple:
    """Number, sum and exclusive or of two hashes of the links, which tell a changed table but for a chance of about 2**-128."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of `links` (a long, b long); the component is its smallest node.

    Each round hangs every node under the smallest node next to it (large star, then small star) and writes
    the links to the shared folder; the rounds end when no link changes, after about log2 of the longest path.
    """
    links = common.materialize(_stars(links.select("a", "b")).distinct(), name)
    print_ = _fingerprint(links)
    while True:
        both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).filter("b > a").select(F.col("m").alias("a"), "b").distinct()
        # After the large star every link goes from a smaller node a to a larger node b.
        under = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m")
        small = large.join(under, F.col("b") == F.col("u"))
        step = small.select(F.explode(F.array(
            F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b"))
        )).alias("x")).select("x.a", "x.b").filter("a <> b").distinct()
        nxt = common.materialize(step, name)
        common.release(links)
        before, links, print_ = print_, nxt, _fingerprint(nxt)
        if print_ == before:
            break
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
