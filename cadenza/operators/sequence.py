"""Frame sequences: neighbours, catalogues, splits, densification and times."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalar import linear_blend
from cadenza.functions.text import iso_z
from cadenza.sources import folders


def shifted(frames: DataFrame, by: int, suffix: str, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """The frames `by` places on, as columns with a suffix: an equi-join on the ordinal k, so no task holds a whole sequence."""
    keys = keys or []
    return frames.select((F.col("k") - by).alias("k"), *keys, *[F.col(c).alias(c + suffix) for c in columns])


def brackets(frames: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Each frame with the next one's columns (suffix _next); the last frame has none."""
    return frames.join(shifted(frames, 1, "_next", columns, keys), ["k", *(keys or [])])


def triplets(frames: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Interior frames with both neighbours' columns (suffixes _prev and _next)."""
    on = ["k", *(keys or [])]
    return frames.join(shifted(frames, -1, "_prev", columns, keys), on).join(shifted(frames, 1, "_next", columns, keys), on)


def triplet_catalog(frames: DataFrame, cadence_min: int) -> DataFrame:
    t = triplets(frames, ["time"])
    return t.select(
        F.col("k").alias("mid_index"), (F.col("k") - 1).alias("prev_index"), (F.col("k") + 1).alias("next_index"), iso_z("time_prev").alias("prev_time"),
        iso_z("time").alias("mid_time"), iso_z("time_next").alias("next_time"), F.lit(0.5).alias("t"), F.lit(cadence_min).alias("cadence_min"),
    )


def lag_lead(df: DataFrame, partition: list[str], order: list[str], column: str) -> DataFrame:
    """Previous and next value within each partition."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(f"prev_{column}", F.lag(column).over(w)).withColumn(f"next_{column}", F.lead(column).over(w))


def _ranged(df: DataFrame, order: list[Column | str], **columns: Column) -> DataFrame:
    """The rows as the struct `row` and their partition `part`, range-partitioned and sorted by the order; no name can clash.

    They are written once and read back: bounds of ranges come from a sample, which differs each time that a plan runs, so counts and
    rows of two runs would not belong together."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return folders.stored(ranged.select(own, F.monotonically_increasing_id().alias("id"), *[c.alias(k) for k, c in columns.items()]).withColumn("part", F.shiftright("id", 33)), "ranged")


def _before(parts: DataFrame) -> DataFrame:
    """(before_part, before): the sums of `n` over the partitions before each; one row for each partition is windowed."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(F.col("part").alias("before_part"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))


def ordinals(df: DataFrame, order: list[Column | str], name: str = "ordinal") -> DataFrame:
    """A column with each row's place, from 0, in the whole order, without one task sorting all rows.

    Rows are range-partitioned, sorted and written; a window over one row per partition gives the places before each. Rows
    that the order does not tell apart get their places in any order."""
    ranged = _ranged(df, order)
    before = _before(ranged.groupBy("part").agg(F.count("*").alias("n")))
    placed = ranged.join(F.broadcast(before), F.col("part") == F.col("before_part"))  # one row for each partition
    return placed.select("row.*", (F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1)).alias(name))


def prefix_sums(df: DataFrame, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """A column with the sum of `value` over all rows before each in the whole order, which must tell all rows apart."""
    ranged = _ranged(df, order, value=value)
    before = _before(ranged.groupBy("part").agg(F.sum("value").alias("n")))
    inside = F.coalesce(F.sum("value").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("inside", inside).join(F.broadcast(before), F.col("part") == F.col("before_part"))
    return placed.select("row.*", (F.col("before") + F.col("inside")).alias(name))


def _half_even(x: float) -> int:
    return round(x)


def interior_split(n_frames: int, train_frac: float, val_frac: float) -> dict[str, tuple[int, int]]:
    """Ranges [a, b) of interior frame indices: at least one frame each where there are three."""
    n = max(0, n_frames - 2)
    n_train = max(_half_even(n * train_frac), 1) if n >= 1 else 0
    n_val = _half_even(n * val_frac)
    if n >= 3:
        n_val, n_train = max(n_val, 1), min(n_train, n - 2)
    a, b = min(n, n_train), min(n, n_train + n_val)
    return {"train": (1, 1 + a), "val": (1 + a, 1 + b), "test": (1 + b, 1 + n)}


def time_split(n: int, train_frac: float, val_frac: float) -> dict[str, tuple[int, int]]:
    """Ranges of places in time order: train and validation have at least one of two."""
    if n == 0:
        return {"train": (0, 0), "val": (0, 0), "test": (0, 0)}
    n_train = max(1, min(_half_even(train_frac * n), n - 1)) if n >= 2 else n
    n_val = max(0, min(_half_even(val_frac * n), n - n_train))
    if n >= 2 and n_val == 0:
        n_val, n_train = 1, min(n_train, n - 1)
    return {"train": (0, n_train), "val": (n_train, n_train + n_val), "test": (n_train + n_val, n)}


def split_column(index: Column, ranges: dict[str, tuple[int, int]]) -> Column:
    out = F.lit(None).cast("string")
    for name, (a, b) in ranges.items():
        out = F.when((index >= a) & (index < b), name).otherwise(out)
    return out


def subdivisions(factor: int) -> int:
    """The factor rounded up to a power of two."""
    return 2 ** max(1, ceil(log2(factor))) if factor > 1 else 1


def recursion_levels(factor: int) -> int:
    if factor not in (2, 4, 8):
        raise ValueError("factor must be 2, 4 or 8")
    return int(log2(factor))


def blend_arrays(a: Column, b: Column, t: Column, null_mode: str = "propagate") -> Column:
    return F.zip_with(a, b, lambda x, y: linear_blend(x, y, t, null_mode))


def densify_direct(frames: DataFrame, factor: int, last: int) -> DataFrame:
    """Observed frames and, in each bracket, the blends at t = i / subdivisions; `last` is the last index, which stands alone.

    frame is the place in the densified sequence; bracket_obs counts observed frames, bracket_frame densified ones."""
    n = subdivisions(factor)
    pair = frames.join(shifted(frames, 1, "_next", ["time", "bt"]), "k", "left")
    steps = F.when(F.col("k") < last, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))
    out = pair.withColumn("step", F.explode(steps)).withColumn("f", F.col("step") / F.lit(float(n)))
    observed = F.col("step") == 0
    micros = F.unix_micros(F.col("time").cast("timestamp"))
    gap = F.unix_micros(F.col("time_next").cast("timestamp")) - micros
    time = F.timestamp_micros(micros + F.coalesce(F.bround(gap * F.col("f")), F.lit(0)).cast("long")).cast("timestamp_ntz")
    return out.select(
        (F.col("k") * n + F.col("step")).alias("frame"), F.when(observed, "observed").otherwise("interpolated").alias("kind"),
        F.when(~observed, F.col("f")).alias("t"), F.when(~observed, F.array("k", F.col("k") + 1)).alias("bracket_obs"),
        F.when(~observed, F.array(F.col("k") * n, (F.col("k") + 1) * n)).alias("bracket_frame"), time.alias("time"),
        F.when(observed, F.col("bt")).otherwise(blend_arrays(F.col("bt"), F.col("bt_next"), F.col("f"), "one_sided")).alias("bt"),
    )


def densify_recursive(frames: DataFrame, factor: int) -> DataFrame:
    """Midpoints of midpoints, one round for each halving; frame, kind and bt."""
    out = frames.select(F.col("k").alias("frame"), F.lit("observed").alias("kind"), "bt")
    for _ in range(recursion_levels(factor)):
        wide = out.select((F.col("frame") * 2).alias("frame"), "kind", "bt")
        after = out.select(((F.col("frame") - 1) * 2).alias("frame"), F.col("bt").alias("bt_next"))
        mids = wide.join(after, "frame").select((F.col("frame") + 1).alias("frame"), F.lit("interpolated").alias("kind"), blend_arrays(F.col("bt"), F.col("bt_next"), F.lit(0.5)).alias("bt"))
        out = wide.unionByName(mids)
    return out


def fill_forward(df: DataFrame, partition: list[str], order: list[str], column: str, known: Column) -> DataFrame:
    """As-of: the last known value up to each row, else the first after it."""
    w = Window.partitionBy(*partition).orderBy(*order)
    value = F.when(known, F.col(column))
    back = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return df.withColumn("asof", F.coalesce(back, ahead))


def resolve_times(df: DataFrame, start: str, cadence_min: int) -> DataFrame:
    """The frame's own time, else start plus its index times the cadence."""
    made = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("k") * cadence_min).cast("int"))
    return df.withColumn("time", F.coalesce("time", made))
