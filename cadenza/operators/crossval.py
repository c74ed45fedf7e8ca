"""Cross-validation of temporal interpolation: a registry of 40 methods, of which those below run on one dense sequence.

Each runner takes frames (k, label, time, bt as array) and returns rows (method_id, metric, value).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.scalar import linear_blend, to_unit_interval
from cadenza.operators import metrics, sequence, stats, stencil

BASIC = ["psnr", "mse", "rmse", "mae", "bt_rmse_k", "bt_bias_k"]
# Number, group, whether one dense sequence is enough, and subject of each method.
REGISTRY = [
    (1, "A", True, "leave the middle frame out"), (2, "A", False, "leave the middle out on a second sensor"), (3, "A", True, "several steps against direct"),
    (4, "A", True, "recursion depth"), (5, "A", True, "off-centre times"), (6, "A", True, "long gaps"),
    (7, "B", False, "overlap of two satellites over the Pacific"), (8, "B", False, "overlap over the Indian Ocean"), (9, "B", False, "three-way common scene"),
    (10, "B", False, "consistency of derived motion"), (11, "B", False, "inter-calibration"), (12, "C", False, "polar overpass, first instrument"),
    (13, "C", False, "polar overpass, second instrument"), (14, "C", False, "polar overpass, third instrument"), (15, "C", False, "triple collocation"),
    (16, "C", False, "n-way collocation"), (17, "C", False, "error budget"), (18, "D", True, "persistence baseline"), (19, "D", True, "linear blend baseline"),
    (20, "D", True, "classical flow baseline"), (21, "D", False, "backbone ranking"), (22, "E", False, "ablation of losses"), (23, "E", False, "ablation of inputs"),
    (24, "E", False, "ablation of scales"), (25, "E", False, "ablation of training data"), (26, "F", True, "extreme motion"), (27, "F", False, "by phenomenon"),
    (28, "F", False, "by region"), (29, "F", False, "by season"), (30, "F", True, "by temperature regime"), (31, "F", True, "error against speed"),
    (32, "F", True, "error against lead time"), (33, "G", True, "ratio of spectra"), (34, "G", False, "wavelet spectra"), (35, "G", True, "significance"),
    (36, "G", True, "agreement of metrics"), (37, "H", False, "several bands"), (38, "H", True, "conservation of the mean"), (39, "H", True, "seams"),
    (40, "H", True, "two implementations"),
]

Model = Callable[[Column, Column, Column], Column]


def blend_model(a: Column, b: Column, t: Column) -> Column:
    return sequence.blend_arrays(a, b, t)


def copy_model(a: Column, b: Column, t: Column) -> Column:
    return F.when(t < 0.5, a).otherwise(b)


MODELS: dict[str, Model] = {"linear": blend_model, "copy": copy_model}


def get_model(name: str) -> Model:
    if name not in MODELS:
        raise ValueError(f"unknown model {name}; there are {sorted(MODELS)}")
    return MODELS[name]


def registry(spark, run: list[int] | None = None) -> DataFrame:
    """The 40 rows; those that need more than one dense sequence are skipped, the others registered or, if given, run."""
    rows = [(f"M{n}", name, group, dense, "skipped" if not dense else "run" if n in (run or []) else "registered") for n, group, dense, name in REGISTRY]
    return spark.createDataFrame(rows, "method_id string, name string, category string, runnable boolean, status string")


#: Frames that a sequence needs for a method, three if it is not here.
LEAST_FRAMES = {3: 9, 4: 5, 6: 5}


def statuses(sequences: DataFrame, key: str) -> DataFrame:
    """key, method_id and status of every method for each sequence (key, n_frames): run if one dense sequence of that length is enough."""
    every = F.array(*[F.struct(F.lit(f"M{n}").alias("method_id"), F.lit(LEAST_FRAMES.get(n, 3) if dense else None).cast("int").alias("least")) for n, _, dense, _ in REGISTRY])
    rows = sequences.select(key, "n_frames", F.explode(every).alias("m"))
    return rows.select(key, "m.method_id", F.when(F.col("n_frames") >= F.col("m.least"), "run").otherwise("skipped").alias("status"))


def middle(frames: DataFrame, model: Model = blend_model) -> DataFrame:
    """Interior frames as truth, with pred from their neighbours."""
    t = sequence.triplets(frames, ["bt"])
    return t.select("k", "label", F.col("bt_prev"), F.col("bt_next"), F.col("bt").alias("truth"), model(F.col("bt_prev"), F.col("bt_next"), F.lit(0.5)).alias("pred"))


def per_triplet(frames: DataFrame, model: Model = blend_model) -> DataFrame:
    return metrics.array_metrics(middle(frames, model), ["k", "label"])


def _means(df: DataFrame, method: str, names: dict[str, str]) -> DataFrame:
    wide = df.agg(*[F.avg(c).alias(n) for n, c in names.items()])
    return wide.unpivot([], list(names), "metric", "value").select(F.lit(method).alias("method_id"), "metric", "value")


def m1(frames: DataFrame, model: Model = blend_model) -> DataFrame:
    return _means(per_triplet(frames, model), "M1", {m: m for m in BASIC})


def across(frames: DataFrame, lead: int, fractions: list[int], model: Model = blend_model) -> DataFrame:
    """Frames k + j from the frames k and k + lead, for each j and every start k that lead divides."""
    start = frames.filter(F.col("k") % lead == 0).select("k", F.col("bt").alias("a"))
    end = frames.select((F.col("k") - lead).alias("k"), F.col("bt").alias("b"))
    steps = start.join(end, "k").withColumn("j", F.explode(F.array(*[F.lit(j) for j in fractions])))
    truth = frames.select(F.col("k").alias("m"), F.col("bt").alias("truth"))
    return steps.withColumn("m", F.col("k") + F.col("j")).join(truth, "m").select("m", "j", "truth", model(F.col("a"), F.col("b"), F.col("j") / F.lit(float(lead))).alias("pred"))


def m3(frames: DataFrame, factors: tuple[int, ...] = (2, 4, 8)) -> DataFrame:
    out = None
    for f in factors:
        found = metrics.array_metrics(across(frames, f, list(range(1, f))), ["m"]).agg(F.avg("bt_rmse_k").alias("value"))
        row = found.select(F.lit("M3").alias("method_id"), F.lit(f"bt_rmse_k_x{f}").alias("metric"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def m4(frames: DataFrame) -> DataFrame:
    """Level one against truth; level two, quarter frames from the predicted middle, against the blend of the bracket."""
    mid = middle(frames)
    one = metrics.array_metrics(mid, ["k"]).agg(F.avg("bt_rmse_k").alias("level1"))
    quarter = lambda a: sequence.blend_arrays(a, F.col("pred"), F.lit(0.5))
    proxy = lambda t: sequence.blend_arrays(F.col("bt_prev"), F.col("bt_next"), F.lit(t))
    q = mid.select("k", F.explode(F.array(F.struct(quarter(F.col("bt_prev")).alias("pred"), proxy(0.25).alias("truth")), F.struct(quarter(F.col("bt_next")).alias("pred"), proxy(0.75).alias("truth")))).alias("q")).select("k", "q.*")
    two = metrics.array_metrics(q, ["k"]).agg(F.avg("bt_rmse_k").alias("level2"))
    both = one.withColumn("one", F.lit(1)).join(two.withColumn("one", F.lit(1)), "one")
    both = both.withColumn("ratio", F.try_divide("level2", "level1"))
    return both.unpivot([], ["level1", "level2", "ratio"], "metric", "value").select(F.lit("M4").alias("method_id"), "metric", "value")


def m5(frames: DataFrame) -> DataFrame:
    """At t = 0.5 against truth, at 0.25 and 0.75 the copied nearer frame against the blend proxy."""
    mid = middle(frames)
    cases = [F.struct(F.lit(t).alias("t"), sequence.blend_arrays(F.col("bt_prev"), F.col("bt_next"), F.lit(t)).alias("pred"), (F.col("truth") if t == 0.5 else sequence.blend_arrays(F.col("bt_prev"), F.col("bt_next"), F.lit(t))).alias("truth")) for t in (0.25, 0.5, 0.75)]
    q = mid.select("k", F.explode(F.array(*cases)).alias("q")).select("k", "q.*")
    found = metrics.array_metrics(q, ["k", "t"]).groupBy("t").agg(F.avg("bt_rmse_k").alias("value"))
    return found.select(F.lit("M5").alias("method_id"), F.concat(F.lit("bt_rmse_k_t"), F.format_string("%.2f", "t")).alias("metric"), "value")


def m6(frames: DataFrame, lead: int | None = None) -> DataFrame:
    """The middle of brackets `lead` wide, by default of the widest even bracket of the sequence, against that of adjacent ones."""
    if lead is None:
        low, high = frames.agg(F.min("k"), F.max("k")).first()
        lead = (high - low) // 2 * 2 if high is not None else 0
        ends = frames.filter(F.col("k") == (low or 0)).select((F.col("k") + lead // 2).alias("m"), F.col("bt").alias("a"))
        ends = ends.join(frames.select((F.col("k") - lead + lead // 2).alias("m"), F.col("bt").alias("b")), "m")
        found = ends.join(frames.select(F.col("k").alias("m"), F.col("bt").alias("truth")), "m").select("m", "truth", blend_model(F.col("a"), F.col("b"), F.lit(0.5)).alias("pred"))
    else:
        found = across(frames, lead, [lead // 2])
    wide = metrics.array_metrics(found, ["m"]).agg(F.avg("bt_rmse_k").alias("value"))
    near = metrics.array_metrics(middle(frames), ["k"]).agg(F.avg("bt_rmse_k").alias("value"))
    return wide.select(F.lit("M6").alias("method_id"), F.lit("long_gap").alias("metric"), "value").unionByName(near.select(F.lit("M6"), F.lit("adjacent"), "value").toDF("method_id", "metric", "value"))


def baseline(frames: DataFrame, method: str, base: Model, model: Model = blend_model) -> DataFrame:
    """Means of baseline and model, and what the model gains: psnr up, rmse down."""
    a = per_triplet(frames, base).agg(F.avg("psnr").alias("base_psnr"), F.avg("bt_rmse_k").alias("base_rmse")).withColumn("one", F.lit(1))
    b = per_triplet(frames, model).agg(F.avg("psnr").alias("model_psnr"), F.avg("bt_rmse_k").alias("model_rmse")).withColumn("one", F.lit(1))
    both = a.join(b, "one").withColumn("gain_psnr", F.col("model_psnr") - F.col("base_psnr")).withColumn("gain_rmse", F.col("base_rmse") - F.col("model_rmse"))
    return both.unpivot([], [c for c in both.columns if c != "one"], "metric", "value").select(F.lit(method).alias("method_id"), "metric", "value")


def with_flow(frames: DataFrame, side: int, solver: str = "horn_schunck") -> DataFrame:
    """Interior frames with the flow between their neighbours, its speed and the flow blend."""
    mid = middle(frames)
    pairs = mid.select("k", F.col("bt_prev").alias("bt"), "bt_next")
    return stencil.flow_frames(pairs, ["k"], side, solver=solver).join(mid.select("k", "truth", F.col("pred").alias("linear")), "k")


def m20(frames: DataFrame, side: int, solver: str = "horn_schunck") -> DataFrame:
    flow = metrics.array_metrics(with_flow(frames, side, solver), ["k"])
    return _means(flow, "M20", {"base_psnr": "psnr", "base_rmse": "bt_rmse_k"})


def m26(frames: DataFrame, side: int) -> DataFrame:
    """Errors of the blend at slow and fast motion, split at the median speed."""
    f = with_flow(frames, side)
    errors = metrics.array_metrics(f.select("k", "speed", F.col("linear").alias("pred"), "truth"), ["k", "speed"])
    cut = stats.quantiles(errors, "speed", {"cut": 0.5}).withColumn("one", F.lit(1))
    return errors.withColumn("one", F.lit(1)).join(cut, "one").groupBy(F.when(F.col("speed") >= F.col("cut"), "fast").otherwise("slow").alias("metric")).agg(F.avg("bt_rmse_k").alias("value")).select(F.lit("M26").alias("method_id"), "metric", "value")


def m30(frames: DataFrame, cold_k: float = 240.0) -> DataFrame:
    """Errors of cold and warm pixels: each frame's own, then their mean."""
    mid = middle(frames)
    out = None
    for name, test in (("cold", lambda g: g < cold_k), ("warm", lambda g: g >= cold_k)):
        cut = mid.withColumn("truth", F.transform("truth", lambda g: F.when(test(g), g)))
        row = metrics.array_metrics(cut, ["k"]).agg(F.avg("bt_rmse_k").alias("value")).select(F.lit("M30").alias("method_id"), F.lit(name).alias("metric"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def m31(frames: DataFrame, side: int) -> DataFrame:
    f = with_flow(frames, side)
    errors = metrics.array_metrics(f.select("k", "speed", F.col("linear").alias("pred"), "truth"), ["k", "speed"])
    return errors.agg(stats.guarded_corr(F.col("speed"), F.col("bt_rmse_k")).alias("value")).select(F.lit("M31").alias("method_id"), F.lit("pearson").alias("metric"), "value")


def m32(frames: DataFrame) -> DataFrame:
    """At t = 0.5 against truth, at t = 0.1 against the earlier frame."""
    mid = middle(frames)
    early = metrics.array_metrics(mid.select("k", F.col("bt_prev").alias("truth"), sequence.blend_arrays(F.col("bt_prev"), F.col("bt_next"), F.lit(0.1)).alias("pred")), ["k"])
    return _means(metrics.array_metrics(mid, ["k"]), "M32", {"lead_half": "bt_rmse_k"}).unionByName(_means(early, "M32", {"lead_tenth": "bt_rmse_k"}))


def m33(frames: DataFrame, side: int) -> DataFrame:
    return _means(metrics.windowed_metrics(middle(frames), ["k"], side, ["psd_ratio"]).withColumn("psd_ratio", F.nanvl("psd_ratio", F.lit(None))), "M33", {"psd_ratio": "psd_ratio"})


def m35(frames: DataFrame, n_boot: int = 2000) -> DataFrame:
    """Mean, interval and signed-rank test of the gain over persistence."""
    model, base = per_triplet(frames), per_triplet(frames, copy_model).select("k", F.col("psnr").alias("base_psnr"))
    long = metrics.long_metrics(model.select("k", "psnr", "bt_rmse_k"), ["k"], ["psnr", "bt_rmse_k"])
    ci = stats.bootstrap(long, "metric", n_boot).unpivot(["metric"], ["mean", "low", "high"], "of", "value")
    test = stats.wilcoxon(model.join(base, "k"), "psnr", "base_psnr").select(F.lit("z_psnr").alias("metric"), F.col("z").alias("value"))
    return ci.select(F.concat_ws("_", "metric", "of").alias("metric"), "value").unionByName(test).select(F.lit("M35").alias("method_id"), "metric", "value")


def m36(frames: DataFrame, side: int) -> DataFrame:
    both = per_triplet(frames).select("k", "psnr").join(metrics.windowed_metrics(middle(frames), ["k"], side, ["ssim"]), "k")
    return stats.spearman(both, "psnr", "ssim").select(F.lit("M36").alias("method_id"), F.lit("spearman").alias("metric"), F.col("spearman").alias("value"))


def m38(frames: DataFrame, slack_k: float = 2.0) -> DataFrame:
    """Share of inserted means more than the slack outside the neighbours' means."""
    mean = lambda c: F.try_divide(F.aggregate(F.filter(c, lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v), F.size(F.filter(c, lambda v: v.isNotNull())).cast("double"))
    m = middle(frames).select(mean("pred").alias("p"), mean("bt_prev").alias("a"), mean("bt_next").alias("b"))
    out = (F.col("p") < F.least("a", "b") - slack_k) | (F.col("p") > F.greatest("a", "b") + slack_k)
    return m.agg((F.count_if(out) / F.count("*")).alias("value")).select(F.lit("M38").alias("method_id"), F.lit("violations").alias("metric"), "value")


def m39(frames: DataFrame) -> DataFrame:
    """Mean step to the inserted frame, and half the mean step of the bracket."""
    m = middle(frames)
    step = metrics.array_metrics(m.select("k", "pred", F.col("bt_prev").alias("truth")), ["k"]).agg(F.avg("mae").alias("value"))
    half = metrics.array_metrics(m.select("k", F.col("bt_next").alias("pred"), F.col("bt_prev").alias("truth")), ["k"]).agg((F.avg("mae") / 2).alias("value"))
    return step.select(F.lit("M39").alias("method_id"), F.lit("seam").alias("metric"), "value").unionByName(half.select(F.lit("M39").alias("method_id"), F.lit("half_step").alias("metric"), "value"))


def _ssim_columns(side: int) -> Column:
    """SSIM of the unit frames pred and truth as one column expression: the Gaussian window at every place where it fits."""
    taps = metrics.gaussian_taps(metrics.kernel_size(side)).tolist()
    n, room = len(taps), side - len(taps) + 1
    weights = F.array(*[F.lit(a * b) for a in taps for b in taps])
    c1, c2 = metrics.SSIM_K1**2, metrics.SSIM_K2**2

    def of(place: Column) -> Column:
        cell = lambda f, j: F.get(f, ((F.floor(place / room) + F.floor(j / n)) * side + place % room + j % n).cast("int"))
        total = lambda f, g: F.aggregate(F.sequence(F.lit(0), F.lit(n * n - 1)), F.lit(0.0), lambda acc, j: acc + F.get(weights, j) * (cell(f, j) if g is None else cell(f, j) * cell(g, j)))
        a, b = total("pred", None), total("truth", None)
        va, vb, ab = total("pred", "pred") - a * a, total("truth", "truth") - b * b, total("pred", "truth") - a * b
        return (2 * a * b + c1) / (a * a + b * b + c1) * (2 * ab + c2) / (va + vb + c2)

    places = F.transform(F.sequence(F.lit(0), F.lit(room * room - 1)), of)
    return F.aggregate(places, F.lit(0.0), lambda acc, v: acc + v) / float(room * room)


def m40(frames: DataFrame, side: int) -> DataFrame:
    """Two implementations of SSIM on the first triplet: one column expression, and arrays in numpy."""
    first = frames.agg(F.min("k").alias("first")).select((F.col("first") + 1).alias("k"))
    mid = middle(frames).join(F.broadcast(first), "k")  # one row
    unit = lambda c: F.transform(c, lambda v: to_unit_interval(v)).alias(c)
    a = mid.select("k", unit("pred"), unit("truth")).select("k", _ssim_columns(side).alias("columns"))
    both = a.join(metrics.windowed_metrics(mid, ["k"], side, ["ssim"]).withColumnRenamed("ssim", "arrays"), "k")
    both = both.withColumn("difference", F.abs(F.col("columns") - F.col("arrays")))
    return both.unpivot(["k"], ["columns", "arrays", "difference"], "metric", "value").select(F.lit("M40").alias("method_id"), "metric", "value")


def compare(frames: DataFrame, models: dict[str, Model]) -> DataFrame:
    """model, mean psnr and bt_rmse_k over all triplets, and its place by psnr; there is one row for each model."""
    out = None
    for name, model in models.items():
        row = per_triplet(frames, model).agg(F.avg("psnr").alias("psnr"), F.avg("bt_rmse_k").alias("bt_rmse_k")).select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    best = F.array_sort(F.collect_list(F.struct((-F.col("psnr")).alias("order"), "model", "psnr", "bt_rmse_k")))
    return out.agg(best.alias("b")).select(F.posexplode("b").alias("place", "b")).select("b.model", "b.psnr", "b.bt_rmse_k", (F.col("place") + 1).alias("place"))


def runners(side: int) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """All methods that run on one dense sequence."""
    return {
        "M1": m1, "M3": m3, "M4": m4, "M5": m5, "M6": m6, "M18": lambda f: baseline(f, "M18", copy_model), "M19": lambda f: baseline(f, "M19", blend_model),
        "M20": lambda f: m20(f, side), "M26": lambda f: m26(f, side), "M30": m30, "M31": lambda f: m31(f, side), "M32": m32, "M33": lambda f: m33(f, side), "M35": m35,
        "M36": lambda f: m36(f, side), "M38": m38, "M39": m39, "M40": lambda f: m40(f, side),
    }


def run_method(frames: DataFrame, method_id: str, side: int) -> DataFrame:
    """One method's rows; an unknown or failing method gives one row without a value whose metric says so."""
    try:
        return runners(side)[method_id](frames)
    except KeyError:
        known = method_id in {f"M{n}" for n, *_ in REGISTRY}
        return frames.sparkSession.createDataFrame([(method_id, "skipped" if known else "failed", None)], "method_id string, metric string, value double")
