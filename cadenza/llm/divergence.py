"""Audit of how sources of a language diverge in their use of words, over run-length columns.

Terms with the same counts in all sources of a language are one row with their number; rows are ordered by their counts, so
that equal counts lie together, and cut into blocks. In a block the counts of each source are a column of runs. Two sources
are compared on the common bounds of their runs: the difference of the shares there times the number of terms. Blocks are
compared where they are and their sums added up, so neither the terms nor the pairs of a language meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm import common

#: Documents of the language that a kept term is in, at least; ranks of part `term`; what is added to each count.
LEAST_DOCUMENTS, MOST_RANK, ADDED = 30, 50, 5
SCALE = 1_000_000_000
#: Different terms that a task counts before it sends their counts on.
HELD_TERMS = 400_000
#: Numbers (rows times sources) of a block.
BLOCK_CELLS = 1 << 20
#: Bytes of a text taken at once.
PART_BYTES = 1 << 20

#: Letters of ASCII, lower-cased, and all bytes of longer UTF-8 sequences; all else stands between terms.
_TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _parts(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, a part of about PART_BYTES at a time."""
    raw = text.encode().translate(_TABLE)
    at = 0
    while at < len(raw):
        end = at + PART_BYTES
        end = len(raw) if end >= len(raw) else raw.find(b" ", end) % (len(raw) + 1)
        yield raw[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of a group; the term '' stands for the group itself.

    Tasks add up what they read before anything is shuffled."""
    common.tune(docs.sparkSession)
    schema = "lang string, source string, term string, n long, docs long"

    def rows(groups: dict) -> pa.RecordBatch:
        flat = [(lang, source, term, n, d) for (lang, source), own in groups.items() for term, (n, d) in own.items()]
        lang, source, term, n, d = zip(*flat)
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array([t.decode() for t in term], pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())],
            names=["lang", "source", "term", "n", "docs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns]):
                own = groups.setdefault((lang, source), {b"": [0, 0]})
                own[b""][1] += 1
                held -= len(own)
                met: set[bytes] = set()
                for terms in _parts(text):
                    for term in terms:
                        if (at := own.get(term)) is None:
                            own[term] = at = [0, 0]
                        at[0] += 1
                    met.update(terms)
                for term in met:
                    own[term][1] += 1
                held += len(own)
                if held > HELD_TERMS:
                    yield rows(groups)
                    groups, held = {}, 0
        if groups:
            yield rows(groups)

    own = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return own.mapInArrow(run, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column, added: int = ADDED) -> Column:
    """1 + floor(SCALE * (n + added) / (total + added * terms)), exact; null without terms."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + added).cast("decimal(20,0)")
    below = (total + added * terms).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", above, below) + 1)


def _shares(n: np.ndarray, total: int, terms: int, added: int) -> np.ndarray:
    """The same of an array; in whole numbers of any size where 64 bits are too few."""
    below = total + added * terms
    if not len(n) or int(n.max()) + added < (1 << 63) // SCALE:
        return 1 + SCALE * (n + added) // below
    return np.array([1 + SCALE * (int(x) + added) // below for x in n.tolist()], np.int64)


def run_length(column: np.ndarray) -> np.ndarray:
    """Where the runs of a column begin."""
    return np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1])


def pair_sums(counts: np.ndarray, lengths: np.ndarray, totals: list[int], terms: int, added: int = ADDED) -> np.ndarray:
    """Sums over all terms of abs(p - q) of each two sources.

    counts[r, s]: occurrences of each term of row r in source s; lengths[r]: the terms that row r stands for."""
    n = counts.shape[1]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    runs = [run_length(counts[:, s]) for s in range(n)]
    shares = [_shares(counts[at, s], totals[s], terms, added) for s, at in enumerate(runs)]
    out = np.zeros((n, n), np.int64)
    for a in range(n):
        for b in range(a + 1, n):
            bounds = np.union1d(runs[a], runs[b])
            f = np.abs(shares[a][np.searchsorted(runs[a], bounds, "right") - 1] - shares[b][np.searchsorted(runs[b], bounds, "right") - 1])
            out[a, b] = (f * (np.append(ends[bounds[1:]], ends[-1]) - ends[bounds])).sum()
    return out


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (lang, sources, own, n), ordered by counts, packed: (lang, sources, sig, n), each list a block of one language."""
    schema = "lang string, sizes binary, places binary, counts binary, terms binary"

    def pack(lang: str, own: list, lengths: list[int]) -> pa.RecordBatch:
        flat = [x for row in own for x in row]
        columns = [
            np.array([len(row) for row in own], np.int32), np.array([x["place"] for x in flat], np.int32), np.array([x["n"] for x in flat], np.int64), np.array(lengths, np.int64),
        ]
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), *[pa.array([c.tobytes()], pa.binary()) for c in columns]], names=["lang", "sizes", "places", "counts", "terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, own, lengths, most = None, [], [], 1
        for batch in batches:
            for new, sources, row, n in zip(*[c.to_pylist() for c in batch.columns]):
                if own and (new != lang or len(own) * most >= BLOCK_CELLS):
                    yield pack(lang, own, lengths)
                    own, lengths = [], []
                lang, most = new, max(1, sources)
                own.append(row)
                lengths.append(n)
        if own:
            yield pack(lang, own, lengths)

    return rows.mapInArrow(run, schema)


def _compare(blocks: DataFrame, added: int) -> DataFrame:
    """(lang, a, b, value): the sums of each block, by the places a < b of two sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, sizes, places, counts, terms, totals, kept in zip(*[c.to_pylist() for c in batch.columns]):
                sizes, places, counts, lengths = (np.frombuffer(x, t) for x, t in ((sizes, np.int32), (places, np.int32), (counts, np.int64), (terms, np.int64)))
                dense = np.zeros((len(sizes), len(totals)), np.int64)
                dense[np.repeat(np.arange(len(sizes)), sizes), places] = counts
                sums = pair_sums(dense, lengths, totals, kept, added)
                a, b = np.triu_indices(len(totals), 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(sums[a, b], pa.int64())], names=["lang", "a", "b", "value"]
                )

    return blocks.mapInArrow(run, "lang string, a int, b int, value long")


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, most_rank: int = MOST_RANK, added: int = ADDED) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group (lang, source) of `docs` (text, lang, source).

    Part `pair` has a row for each other source of the language, with the difference of their shares summed over all kept
    terms, 0 where none is kept; part `term` the `most_rank` kept terms of the group whose share exceeds the language's most.
    Ranks go from 1, the largest value first, then by the item's bytes. Null text, lang and source are ''. A language with
    one source has no pairs, a group without terms only pairs. Rows that repeat count as often. An empty table gives an
    empty result. Other columns are not read. A row of a term, a language's row of totals and a block hold as many numbers as
    the language has sources, of which the result has the square.
    """
    counts = common.materialize(term_counts(docs), "divergence-counts")
    groups = counts.filter("term = ''").select("lang", "source", "docs")
    # Columns with few different counts first: small groups have them.
    groups = groups.select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("docs", "source")) - 1).alias("place"))
    groups = common.materialize(groups, "divergence-groups")
    n_groups = groups.count()
    known = common.sized(groups.withColumnsRenamed({"lang": "g_lang", "source": "g_source"}), n_groups)
    placed = counts.filter("term <> ''").join(known, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")))
    kept = placed.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("place"), F.col("n")))).alias("own")
    )
    kept = common.materialize(kept.filter(F.col("docs") >= least_documents).select("lang", "term", "n", "own"), "divergence-kept")
    common.release(counts)
    each = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("own").alias("x")).select("lang", "term", "lang_n", "x.place", "x.n")
    totals = each.groupBy(F.col("lang").alias("t_lang"), F.col("place").alias("t_place")).agg(F.sum("n").alias("total"))
    langs = kept.groupBy(F.col("lang").alias("l_lang")).agg(F.sum("n").alias("lang_total"), F.count("*").alias("kept"))
    table = groups.join(totals, (F.col("lang") == F.col("t_lang")) & (F.col("place") == F.col("t_place")), "left").join(langs, F.col("lang") == F.col("l_lang"), "left")
    table = common.materialize(table.select(
        "lang", "source", "place", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total", "lang_total", "kept")]
    ), "divergence-totals")
    names = table.select(F.col("lang").alias("g_lang"), F.col("place").alias("g_place"), "source", "total", "lang_total", "kept")

    # Part `term`: Spark keeps the first ranks of each task before it shuffles them.
    found = each.join(common.sized(names, n_groups), (F.col("lang") == F.col("g_lang")) & (F.col("place") == F.col("g_place")))
    value = share(F.col("n"), F.col("total"), F.col("kept"), added) - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"), added)
    found = found.select("lang", "source", F.col("term").alias("item"), value.alias("value")).filter("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_rank).withColumn("part", F.lit("term"))

    # Part `pair`: equal rows of counts are one; blocks of them meet the totals of their language.
    alike = kept.groupBy("lang", "own").agg(F.count("*").alias("n"))
    by_lang = table.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "total"))).alias("all"), F.max("kept").alias("kept"))
    by_lang = by_lang.select(F.col("lang").alias("b_lang"), F.col("all.total").alias("totals"), "kept")
    wide = alike.join(common.sized(by_lang.select("b_lang", F.size("totals").alias("sources")), n_groups), F.col("lang") == F.col("b_lang")).select("lang", "sources", "own", "n")
    ordered = wide.repartitionByRange(common.partitions(docs.sparkSession), "lang", "own").sortWithinPartitions("lang", "own")
    blocks = _blocks(ordered).join(common.sized(by_lang, n_groups), F.col("lang") == F.col("b_lang"))
    sums = _compare(blocks.select("lang", "sizes", "places", "counts", "terms", "totals", "kept"), added).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # A language without kept terms has no block: its pairs are 0.
    bare = table.filter("kept = 0")
    none = bare.select("lang", F.col("place").alias("a")).join(bare.select(F.col("lang").alias("o_lang"), F.col("place").alias("b")), (F.col("lang") == F.col("o_lang")) & (F.col("a") < F.col("b")))
    sums = sums.union(none.select("lang", "a", "b", F.lit(0).cast("long")))
    both = sums.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "value").select("lang", "p.a", "p.b", "value")
    one = common.sized(names.select("g_lang", "g_place", "source"), n_groups)
    other = common.sized(names.select(F.col("g_lang").alias("h_lang"), F.col("g_place").alias("h_place"), F.col("source").alias("item")), n_groups)
    pairs = both.join(one, (F.col("lang") == F.col("g_lang")) & (F.col("a") == F.col("g_place"))).join(other, (F.col("lang") == F.col("h_lang")) & (F.col("b") == F.col("h_place")))
    pairs = pairs.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    out = common.materialize(pairs.select(*columns).unionByName(terms.select(*columns)), "divergence-result")
    common.release(groups, kept, table)
    return out
