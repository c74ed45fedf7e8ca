"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full shingle sets, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common, components, kernels

#: Words of a shingle; linked from 100 * intersection >= PERCENT * union on.
SHINGLE, PERCENT = 5, 75
#: 32 bands of 4 rows: a pair at similarity 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6.
BANDS, ROWS = 32, 4
#: A candidate pair is verified if at least this share of its 128 signature values agree; 0.75 fails this in
#: one of about 10**7 pairs (the share's standard deviation is 0.038, less for SuperMinHash).
LEAST_AGREEMENT = 0.55
#: Members of a bucket whose sketches are compared with each other at once, and shingles of those whose sets are; larger
#: buckets are dealt out in pairs of blocks.
BLOCK_ROWS, BLOCK = 1_000, 500_000


def superminhash(sets: list[np.ndarray], m: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash signatures (row per set) of nonempty sets of 64-bit hashes.

    Each element draws ranks j + r on a random permutation of the m places, so that its ranks differ between
    places. All elements take their step j together; a set stops as soon as every place has a rank below j + 1,
    since later ranks cannot be smaller. The order of elements does not matter.
    """
    n = len(sets)
    sig = np.full((n, m), np.uint64(0xFFFFFFFFFFFFFFFF))
    if not n:
        return sig
    element = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    flat, perm, first = sig.reshape(-1), None, None
    for j in range(m):
        draw = kernels.mix(element + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) % (1 << 64)))
        rank = (np.uint64(j) << np.uint64(56)) | (draw >> np.uint64(8))
        k = j + ((kernels.mix(draw ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            place, first = k, k
        else:
            at = np.arange(len(element))
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint8), (len(element), 1))
                perm[at, first], perm[:, 0] = 0, first
            place = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
        np.minimum.at(flat, row * m + place, rank)
        open_rows = (sig >> np.uint64(56)).max(axis=1) > j
        go = open_rows[row]
        left = int(go.sum())
        if not left:
            break
        if j == 0 or left < 0.7 * len(element):
            element, row = element[go], row[go]
            if perm is None:
                first = first[go]
            else:
                perm = perm[go]
    return sig


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offsets in kernels.slices(batch.column(1)):
            sets = kernels.shingle_sets(raw, offsets, SHINGLE)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = superminhash([sets[i] for i in full])
            bands = np.zeros((len(full), BANDS), np.uint64)
            for r in range(ROWS):
                bands = kernels.mix(bands ^ sig[:, r::ROWS][:, :BANDS]) + np.arange(BANDS, dtype=np.uint64)
            bands = kernels.mix(bands)
            low = (kernels.mix(sig) & np.uint64(0xFF)).astype(np.uint8)
            band_rows, sketches, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            for at, i in enumerate(full):
                band_rows[i], sketches[i] = bands[at].view(np.int64), low[at].tobytes()
                keys[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                pa.array(band_rows, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
            ], names=["doc_id", "n_shingles", "set_key", "bands", "sketch"])


def _agree(a: pa.Array, b: pa.Array) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1) for c in (a, b))
    share = (x == y).mean(axis=1)
    return (share - 1 / 256) / (1 - 1 / 256) >= LEAST_AGREEMENT


def _similar_size(a, b):
    """Necessary for a link: the smaller set has PERCENT of the larger."""
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ok = _similar_size(batch["n_a"].to_numpy(), batch["n_b"].to_numpy()) & _agree(batch["sketch_a"], batch["sketch_b"])
            yield batch.select(["a", "b"]).filter(pa.array(ok))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of texts whose full sets pass the threshold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        for out, column in ((left, "text_a"), (right, "text_b")):
            for _, _, raw, offsets in kernels.slices(batch[column]):
                out += kernels.shingle_sets(raw, offsets, SHINGLE)
        ok = [_linked(x, y) for x, y in zip(left, right)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The links among candidate `pairs` (a, b): first by size and signature, then on the whole texts."""
    one = reps.select(F.col("doc_id").alias("id_a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a"))
    two = reps.select(F.col("doc_id").alias("id_b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("sketch_b"))
    sketched = pairs.join(two, F.col("b") == F.col("id_b")).join(one, F.col("a") == F.col("id_a"))
    likely = common.materialize(
        sketched.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_likely, "a long, b long"), f"{name}-likely"
    )
    ids = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct()
    texts = common.keep_ids(docs, ids)
    one = texts.select(F.col("doc_id").alias("id_a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("id_b"), F.col("text").alias("text_b"))
    full = likely.join(two, F.col("b") == F.col("id_b")).join(one, F.col("a") == F.col("id_a"))
    return common.materialize(full.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"), f"{name}-links")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets pass the threshold."""
    if not len(x) or not len(y) or not _similar_size(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def _likely_pairs(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Members outside of a bucket's largest component, each with the members of other components that it may be linked
    with, by size and sketch. A pair is met in the first band that its members share only, and once."""
    rep, comp, n, band, minor, side = (group[c].to_numpy(zero_copy_only=False) for c in ("rep", "comp", "n_shingles", "band", "minor", "side"))
    first, second = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
    if not len(first) or not len(second):
        return
    sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(len(comp), -1)
    bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(len(comp), -1)
    least = LEAST_AGREEMENT * (1 - 1 / 256) + 1 / 256
    for i in first.tolist():
        other = second[(comp[second] != comp[i]) & _similar_size(n[second], n[i]) & ~(minor[second] & (rep[second] > rep[i]))]
        if len(other):
            other = other[(sketch[other] == sketch[i]).mean(axis=1) >= least]
        if len(other):
            other = other[(bands[other] == bands[i]).argmax(axis=1) == band[i]]
        if len(other):
            yield i, other


def _grouped(compare):
    """Runs compare on each (key, lo, hi) of sorted rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if kept is None else pa.concat_tables([kept, now]).combine_chunks()
            if not now.num_rows:
                continue
            marks = np.stack([now[c].to_numpy() for c in ("key", "lo", "hi")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:]):
                yield from compare(now.slice(a, b - a))
            kept = now.slice(cuts[-1])
        if kept is not None:
            yield from compare(kept)

    return run


def _sketched(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """(key, rep) of the members that may be linked with one of another component here; their texts are worth a look."""
    hit = np.zeros(group.num_rows, bool)
    for i, other in _likely_pairs(group):
        hit[i] = hit[other] = True
    if hit.any():
        yield pa.RecordBatch.from_arrays([pa.array(group[c].to_numpy()[hit], pa.int64()) for c in ("key", "rep")], names=["key", "rep"])


def _compared(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links between different components, verified on full sets; what a link has joined here is not compared again."""
    rep, comp, texts, sets, parent = group["rep"].to_numpy(), group["comp"].to_numpy(), group["text"], {}, {}

    def find(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    def set_of(i: int) -> np.ndarray:
        if i not in sets:
            (_, _, raw, offsets), = kernels.slices(pa.array([texts[i].as_py()], pa.string()))
            sets[i] = kernels.shingle_sets(raw, offsets, SHINGLE)[0]
        return sets[i]

    found: list[tuple[int, int]] = []
    for i, other in _likely_pairs(group):
        for j in other.tolist():
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y and _linked(set_of(i), set_of(j)):
                parent[max(x, y)] = min(x, y)
                found.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])


def _in_blocks(members: DataFrame, every: Column, minors: Column) -> DataFrame:
    """Rows (key, rep, minor, ...) of buckets in blocks: each member once for each block of its bucket's minors (side 0),
    each minor once for each block of its bucket's members (side 1); sorted by pair of blocks."""
    members = members.withColumn("n_lo", every.cast("int")).withColumn("n_hi", minors.cast("int"))
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n).cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = members.withColumn("side", F.lit(0)).withColumn("lo", block("n_lo")).withColumn("hi", each("n_hi"))
    dealt = dealt.unionByName(members.filter("minor").withColumn("side", F.lit(1)).withColumn("lo", each("n_lo")).withColumn("hi", block("n_hi")))
    return dealt.drop("n_lo", "n_hi").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id long, text string): doc_id, n_shingles, component_id, kept.

    The set of a text is its distinct shingles of five words, lower-cased A-Z; a shorter text is one shingle as
    a whole; a null, empty or blank text has the empty set and is linked with nothing. Two documents are linked
    from a Jaccard similarity of 0.75 on. component_id is the smallest doc_id reachable; kept marks the document
    that has it. Rows with the same doc_id are one document; a row with a null doc_id is linked with nothing,
    has a null component and is kept. An empty table gives an empty result. Other columns are not read.

    Equal sets form a class first. In each band's bucket of classes all members are compared with its smallest,
    which a group of any size passes in one row each. What then is outside of its bucket's largest component is compared
    with all of the bucket in blocks, without a cap, so that no candidate pair between components is left out.
    """
    spark = docs.sparkSession
    common.tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = common.materialize(
        docs.mapInArrow(_signatures, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary"), "near-marks"
    )
    some = marks.filter("n_shingles > 0 and doc_id is not null")
    classes = common.materialize(some.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "near-classes")
    chosen = classes.select(F.col("rep"), F.col("set_key").alias("rep_key"))
    reps = common.materialize(
        some.join(chosen, (F.col("doc_id") == F.col("rep")) & (F.col("set_key") == F.col("rep_key"))).select("doc_id", "n_shingles", "bands", "sketch"),
        "near-reps",
    )
    rows = reps.select(F.col("doc_id").alias("rep"), F.posexplode("bands").alias("band", "key"))
    leaders = rows.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("members")).filter("members > 1").withColumnRenamed("key", "l_key")
    leaders = common.materialize(leaders, "near-leaders")
    shared = common.materialize(rows.join(common.sized(leaders), F.col("key") == F.col("l_key")).select("key", "band", "rep", "leader"), "near-shared")
    pairs = shared.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = _verified(pairs, reps, docs, "near-first")
    # Rows that share a doc_id are one document: their classes are linked by it.
    own = some.select("doc_id", "set_key").join(classes, "set_key")
    same = own.filter("doc_id <> rep").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    twice = own.join(same.filter("lo <> hi").select(F.col("doc_id").alias("d2"), "lo"), F.col("doc_id") == F.col("d2")).select(F.col("lo").alias("a"), F.col("rep").alias("b"))
    found = components.components(links.union(twice.filter("a <> b")), "near-comp")

    # Buckets that still have several components: members are compared in blocks by sketch, then those that may be linked on
    # their sets, with their texts at hand.
    sizes = reps.select(F.col("doc_id").alias("r_id"), "n_shingles")
    placed = shared.join(found, F.col("rep") == F.col("node"), "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("comp"))
    met = common.materialize(placed.join(sizes, F.col("rep") == F.col("r_id")).select("key", "band", "rep", "comp", "n_shingles"), "near-placed")
    # Of two members in different components one at least is a minor: not in the bucket's largest component.
    counts = met.groupBy("key", "comp").agg(F.count("*").alias("n"))
    split = counts.groupBy(F.col("key").alias("s_key")).agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.sum("n").alias("members"), (F.sum("n") - F.max("n")).alias("minors"))
    split = common.materialize(split.filter("minors > 0"), "near-split")
    rest = met.join(common.sized(split), F.col("key") == F.col("s_key")).withColumn("minor", F.col("comp") != F.col("major")).drop("s_key", "major")
    rest = common.materialize(rest, "near-rest")
    marked = reps.select(F.col("doc_id").alias("m_id"), "bands", "sketch")
    sketched = rest.join(marked, F.col("rep") == F.col("m_id")).drop("m_id")
    flags = _in_blocks(sketched, F.ceil(F.col("members") / BLOCK_ROWS), F.ceil(F.col("minors") / BLOCK_ROWS)).mapInArrow(_grouped(_sketched), "key long, rep long")
    flags = common.materialize(flags.distinct().select(F.col("key").alias("f_key"), F.col("rep").alias("f_rep")), "near-flags")
    wanted = rest.join(flags, (F.col("key") == F.col("f_key")) & (F.col("rep") == F.col("f_rep"))).drop("f_key", "f_rep", "members", "minors")
    sizes = wanted.groupBy(F.col("key").alias("s_key")).agg(F.sum("n_shingles").alias("size"), F.sum(F.when(F.col("minor"), F.col("n_shingles"))).alias("minor_size"))
    sizes = common.materialize(sizes, "near-sizes")
    wanted = common.materialize(wanted.join(common.sized(sizes), F.col("key") == F.col("s_key")).drop("s_key"), "near-wanted")
    texts = common.keep_ids(docs, wanted.select(F.col("rep").alias("doc_id"))).select(F.col("doc_id").alias("t_id"), "text")
    full = wanted.join(marked, F.col("rep") == F.col("m_id")).join(texts, F.col("rep") == F.col("t_id")).drop("m_id", "t_id")
    extra = common.materialize(_in_blocks(full, F.ceil(F.col("size") / BLOCK), F.ceil(F.col("minor_size") / BLOCK)).mapInArrow(_grouped(_compared), "a long, b long"), "near-extra")
    stars = found.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    found = components.components(stars.union(extra), "near-all")

    placed = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("set_key").alias("c_key"), F.coalesce("component", "rep").alias("component"))
    out = marks.select("doc_id", "n_shingles", "set_key").join(placed, F.col("set_key") == F.col("c_key"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    common.release(reps, leaders, shared, met, split, rest, flags, wanted, extra)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose document near_duplicates() keeps."""
    found = common.materialize(near_duplicates(docs.select("doc_id", "text")), "near-kept")
    return common.keep_ids(docs, found.filter(~F.col("kept")), "left_anti")
