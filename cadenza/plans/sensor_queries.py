"""Queries on losses and on several sensors, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import crossval, losses, metrics, sensors, stencil
from cadenza.plans import sql as S
from cadenza.plans.registry import query, r, rounded
from cadenza.sources import views
from cadenza.sources.views import SIDE, table

BBOX = (68.0, 6.0, 98.0, 38.0)


def _unit_middle(spark, d) -> DataFrame:
    return losses.unit_frames(crossval.middle(views.frames(spark, d)).select("k", "pred", "truth"))


def _sobel_sql(values: str) -> tuple[str, str]:
    c = lambda dy, dx: S.mirrored(values, dy, dx)
    return (
        f"{c(-1, 1)} + 2 * {c(0, 1)} + {c(1, 1)} - {c(-1, -1)} - 2 * {c(0, -1)} - {c(1, -1)}",
        f"{c(1, -1)} + 2 * {c(1, 0)} + {c(1, 1)} - {c(-1, -1)} - 2 * {c(-1, 0)} - {c(-1, 1)}",
    )


(_PX, _PY), (_GX, _GY) = _sobel_sql("p"), _sobel_sql("g")
_SHIFTED = S.mirrored("{}", "n // 7 - 3", "n % 7 - 3")


@query("LOS01 LOS02 LOS04", f"""WITH {S.UNIT_FRAMES}, c AS (SELECT k, avg(sqrt(pow(p[i + 1] - g[i + 1], 2) + 1e-6::DOUBLE)) AS charbonnier,
 avg(sqrt(pow(({_PX}) - ({_GX}), 2) + 1e-6::DOUBLE)) + avg(sqrt(pow(({_PY}) - ({_GY}), 2) + 1e-6::DOUBLE)) AS gradient FROM unit_frames, {S.CELLS} GROUP BY k),
 d AS (SELECT k, {_SHIFTED.format('p')} - p[i + 1] AS dp, {_SHIFTED.format('g')} - g[i + 1] AS dg FROM unit_frames, {S.CELLS}, unnest(range(0, 49)) AS around(n)),
 e AS (SELECT k, avg(sqrt(pow(dp / sqrt(0.81::DOUBLE + dp * dp) - dg / sqrt(0.81::DOUBLE + dg * dg), 2) + 1e-6::DOUBLE)) AS census FROM d GROUP BY k)
 SELECT k, round(charbonnier, 6) AS charbonnier, round(census, 6) AS census, round(gradient, 6) AS gradient FROM c JOIN e USING (k)""")
def los_parts(spark, d):
    return rounded(losses.parts(_unit_middle(spark, d), ["k"], SIDE, ["census", "gradient"]))


@query("LOS03 LOS06")
def los_combined(spark, d):
    return rounded(losses.combined(_unit_middle(spark, d), ["k"], SIDE))


@query("LOS05", f"""WITH {S.PX}, f AS (SELECT k, (bt - 250) / 10 AS u, (260 - bt) / 20 AS v, (bt - 248) / 11 AS tu, (262 - bt) / 19 AS tv FROM px)
 SELECT k, round((sum(sqrt(pow(u - tu, 2) + 1e-6::DOUBLE)) + sum(sqrt(pow(v - tv, 2) + 1e-6::DOUBLE))) / (2 * count(*)), 6) AS distillation FROM f GROUP BY k""")
def los_distillation(spark, d):
    f = views.frames(spark, d).select("k", *[F.transform("bt", of).alias(n) for n, of in {
        "u": lambda v: (v - 250) / 10, "v": lambda v: (260 - v) / 20, "tu": lambda v: (v - 248) / 11, "tv": lambda v: (262 - v) / 19}.items()])
    return f.select("k", r(losses.distillation(("u", "v"), ("tu", "tv"))).alias("distillation"))


# --- methods that need further sensors -----------------------------------------------------------------------------------

@query("M2", f"""WITH {S.as_px('b')}, {S.MIDDLE} SELECT k, {S.pixel_metrics()} FROM middle GROUP BY k""")
def m02_second_sensor(spark, d):
    return rounded(crossval.per_triplet(views.sensor(spark, d, "b")).drop("label"), mse=8)


def _agreement_sql(a: str, b: str) -> str:
    return f"round(avg({b} - {a}), 6) AS bias, round(sqrt(avg(pow({b} - {a}, 2))), 6) AS rmse, round(corr({a}, {b}), 6) AS corr, count(*) AS n"


def _overlap_sql(method: str, a: str, b: str, source: str) -> str:
    return f"SELECT '{method}' AS method_id, k, {_agreement_sql(a, b)} FROM {source} WHERE x >= 4 GROUP BY k"


@query("M7-M9 JON01", f"""WITH {S.PX}, {S.sensor('b')}, {S.sensor('c')}, three AS (SELECT a.k, a.x, a.bt AS a, b.bt AS b, c.bt AS c, (b.bt + c.bt) / 2 AS bc FROM px a JOIN px_b b ON b.k = a.k AND b.i = a.i JOIN px_c c ON c.k = a.k AND c.i = a.i)
 {_overlap_sql('M7', 'a', 'b', 'three')} UNION ALL {_overlap_sql('M8', 'a', 'c', 'three')} UNION ALL {_overlap_sql('M9', 'a', 'bc', 'three')}""")
def m07_overlaps(spark, d):
    """Sensors that see the eastern half of each other's area, at times up to five minutes apart."""
    own = lambda f, c: f.select("k", "time", F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: F.when(i % SIDE >= 4, F.get("bt", i))).alias(c))
    a, b, c = own(views.frames(spark, d), "a"), own(views.sensor(spark, d, "b"), "b"), own(views.sensor(spark, d, "c"), "c")
    two = lambda x, y: sensors.nearest_in_time(x, y, 300)
    three = two(two(a, b).select("k", "time", "a", F.col("b_b").alias("b")), c).select("k", "a", "b", F.col("c_b").alias("c"))
    px = sensors.pixel_pairs(three, ["k"], "a", "b", "c").withColumn("bc", (F.col("b") + F.col("c")) / 2)
    out = None
    for method, of, other in (("M7", "a", "b"), ("M8", "a", "c"), ("M9", "a", "bc")):
        found = sensors.agreement(px, ["k"], of, other).select(F.lit(method).alias("method_id"), "*")
        out = found if out is None else out.unionByName(found)
    return rounded(out)


@query("M10 FLW01")
def m10_motion(spark, d):
    """Mean distance of the flow vectors that two sensors see between the same frames."""
    def flow(frames: DataFrame, name: str) -> DataFrame:
        pairs = frames.join(frames.select((F.col("k") - 1).alias("k"), F.col("bt").alias("bt_next")), "k")
        found = stencil.flow_frames(pairs, ["k"], SIDE)
        return found.select("k", F.arrays_zip("u", "v").alias(name))
    both = flow(views.frames(spark, d), "a").join(flow(views.sensor(spark, d, "b"), "b"), "k")
    return both.select("k", r(losses.mean(F.zip_with("a", "b", lambda p, q: F.hypot(p["u"] - q["u"], p["v"] - q["v"])))).alias("epe"))


@query("M11 AGG18", f"""WITH {S.PX}, {S.sensor('b')}, p AS (SELECT a.label, a.bt AS a, b.bt AS b FROM px a JOIN px_b b ON b.k = a.k AND b.i = a.i)
 SELECT label, round(regr_slope(a, b), 6) AS slope, round(regr_intercept(a, b), 5) AS intercept, round(sqrt(regr_syy(a, b) * (1 - regr_r2(a, b)) / count(*)), 6) AS rmse, count(*) AS n FROM p GROUP BY label""")
def m11_calibration(spark, d):
    met = sensors.nearest_in_time(views.frames(spark, d).select("k", "label", "time", F.col("bt").alias("a")), views.sensor(spark, d, "b").select("time", F.col("bt").alias("b")), 300)
    px = sensors.pixel_pairs(met.withColumnRenamed("b_b", "b"), ["label"], "a", "b")
    return rounded(sensors.calibration(px, ["label"], "a", "b"), intercept=5)


@query("M12-M14", f"""WITH {S.FRAMES}, pts AS (SELECT c_custkey AS p, (c_custkey * 7 % 15000) // 30 AS k, floor((38.0::DOUBLE - (6.0::DOUBLE + (c_custkey * 37 % 3200) / 100.0::DOUBLE)) / 4.0::DOUBLE)::INT AS y,
 floor(((68.0::DOUBLE + (c_custkey * 53 % 3000) / 100.0::DOUBLE) - 68.0::DOUBLE) / 3.75::DOUBLE)::INT AS x, 250.0::DOUBLE + c_acctbal / 100 AS polar FROM customer),
 m AS (SELECT 'M' || (12 + p % 3) AS method_id, polar, bt[y * 8 + x + 1] AS bt FROM pts JOIN frames USING (k) WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7)
 SELECT method_id, {_agreement_sql('bt', 'polar')} FROM m GROUP BY method_id""")
def m12_overpasses(spark, d):
    """Points of three polar instruments against the frames that they fall into."""
    c = F.col("c_custkey")
    time = F.lit("2025-06-20 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(c * 7 % 15000).cast("int"))
    points = table(spark, d, "customer").select(
        c.alias("p_id"), time.alias("time"), (6.0 + (c * 37 % 3200) / 100.0).alias("lat"), (68.0 + (c * 53 % 3000) / 100.0).alias("lon"), (250.0 + F.col("c_acctbal") / 100).alias("bt"))
    met = sensors.overpasses(points, views.frames(spark, d), SIDE, BBOX, 1800)
    return rounded(sensors.agreement(met.withColumn("method_id", F.concat(F.lit("M"), 12 + F.col("p_id") % 3)), ["method_id"], "bt", "bt_polar"))


_COV = {p + q: f"covar_pop({p}, {q})" for p, q in ("aa", "bb", "cc", "ab", "ac", "bc")}


@query("M15-M17", f"""WITH {S.PX}, {S.sensor('b')}, {S.sensor('c')}, three AS (SELECT a.label, a.bt AS a, b.bt AS b, c.bt AS c FROM px a JOIN px_b b ON b.k = a.k AND b.i = a.i JOIN px_c c ON c.k = a.k AND c.i = a.i),
 w AS (SELECT label, {', '.join(f'{v} AS {k}' for k, v in _COV.items())}, count(*) AS n FROM three GROUP BY label),
 e AS (SELECT label, n, aa - ab * ac / bc AS ea, bb - ab * bc / ac AS eb, cc - ac * bc / ab AS ec FROM w), t AS (SELECT *, greatest(ea, 0) + greatest(eb, 0) + greatest(ec, 0) AS total FROM e)
 SELECT label, round(ea, 4) AS error_a, round(eb, 4) AS error_b, round(ec, 4) AS error_c, n, round(greatest(ea, 0) / total, 4) AS share_a, round(greatest(eb, 0) / total, 4) AS share_b, round(greatest(ec, 0) / total, 4) AS share_c FROM t""")
def m15_triple(spark, d):
    a = views.frames(spark, d).select("k", "label", F.col("bt").alias("a"))
    for name in "bc":
        a = a.join(views.sensor(spark, d, name).select("k", F.col("bt").alias(name)), "k")
    return rounded(sensors.triple_collocation(sensors.pixel_pairs(a, ["label"], "a", "b", "c"), ["label"], ("a", "b", "c")), 4)


def _model_sql(name: str, pred: str) -> str:
    return f"SELECT '{name}' AS model, avg(-10 * log10(m)) AS psnr, avg(e) AS bt_rmse_k FROM (SELECT k, avg(pow({S.unit(pred)} - {S.unit('truth')}, 2)) AS m, {S.rmse(pred, 'truth')} AS e FROM middle GROUP BY k)"


@query("M21-M25 SRT05", f"""WITH {S.PX}, {S.MIDDLE}, e AS ({_model_sql('linear', 'pred')} UNION ALL {_model_sql('copy', 'b')} UNION ALL {_model_sql('early', '(0.75::DOUBLE * a + 0.25::DOUBLE * b)')})
 SELECT model, round(psnr, 6) AS psnr, round(bt_rmse_k, 6) AS bt_rmse_k, row_number() OVER (ORDER BY psnr DESC, model)::INT AS place FROM e""")
def m21_models(spark, d):
    """Models on the same triplets, the best first."""
    fr = views.frames(spark, d)
    models = {"linear": crossval.blend_model, "copy": crossval.copy_model, "early": lambda a, b, t: crossval.blend_model(a, b, t / 2)}
    return rounded(crossval.compare(fr, models))


def _stratum_sql(kind: str, value: str) -> str:
    return f"SELECT '{kind}' AS stratum, ({value})::VARCHAR AS part, round({S.rmse('pred', 'truth')}, 6) AS bt_rmse_k, count(*) AS n FROM middle GROUP BY 2"


@query("M27-M29", f"""WITH {S.PX}, {S.MIDDLE} {_stratum_sql('phenomenon', 'label')} UNION ALL {_stratum_sql('region', "(y // 4) || '-' || (x // 4)")} UNION ALL {_stratum_sql('season', 'k // 96')}""")
def m27_strata(spark, d):
    """Errors by label, by quarter of the area and by two days of the sequence."""
    mid = crossval.middle(views.frames(spark, d))
    px = mid.select("k", "label", F.posexplode(F.arrays_zip("pred", "truth")).alias("i", "p")).select("k", "label", "i", "p.*")
    quarter = F.concat_ws("-", F.floor(F.col("i") / (4 * SIDE)).cast("string"), F.floor(F.col("i") % SIDE / 4).cast("string"))
    parts = F.array(*[F.struct(F.lit(n).alias("stratum"), v.cast("string").alias("part")) for n, v in (("phenomenon", F.col("label")), ("region", quarter), ("season", F.floor(F.col("k") / 96)))])
    e = F.col("pred") - F.col("truth")
    found = px.withColumn("s", F.explode(parts)).groupBy("s.stratum", "s.part").agg(F.sqrt(F.avg(e * e)).alias("bt_rmse_k"), F.count("*").alias("n"))
    return rounded(found)


def _haar_sql(source: str, value: str) -> str:
    sign = lambda t: f"sum(CASE WHEN {t} = 0 THEN {value} ELSE -{value} END) / 2"
    return f"SELECT k, y // 2 AS y, x // 2 AS x, sum({value}) / 2 AS ll, {sign('y % 2')} AS lh, {sign('x % 2')} AS hl, {sign('(y + x) % 2')} AS hh FROM {source} GROUP BY k, y // 2, x // 2"


def _bands_sql(level: int) -> str:
    return " UNION ALL ".join(f"SELECT {level} AS level, '{b}' AS band, avg({b} * {b}) AS energy FROM l{level} GROUP BY k" for b in ("lh", "hl", "hh"))


@query("M34", f"""WITH {S.PX}, {S.MIDDLE}, l1 AS ({_haar_sql('middle', 'pred')}), l2 AS ({_haar_sql('l1', 'll')}), e AS ({_bands_sql(1)} UNION ALL {_bands_sql(2)})
 SELECT level, band, round(avg(energy), 5) AS energy, count(*) AS n FROM e GROUP BY level, band""")
def m34_wavelets(spark, d):
    found = sensors.wavelet_energy(crossval.middle(views.frames(spark, d)), ["k"], "pred", SIDE)
    return found.groupBy("level", "band").agg(r(F.avg("energy"), 5).alias("energy"), F.count("*").alias("n"))


@query("M37", f"""WITH {S.PX}, {S.sensor('b')}, p AS (SELECT a.k, a.bt AS a, b.bt AS b FROM px a JOIN px_b b ON b.k = a.k AND b.i = a.i) SELECT k, {_agreement_sql('a', 'b')} FROM p GROUP BY k""")
def m37_bands(spark, d):
    """Two bands of the same frames: their difference and how they vary together."""
    both = views.frames(spark, d).select("k", F.col("bt").alias("a")).join(views.sensor(spark, d, "b").select("k", F.col("bt").alias("b")), "k")
    return rounded(sensors.agreement(sensors.pixel_pairs(both, ["k"], "a", "b"), ["k"], "a", "b"))


_TAPS = metrics.gaussian_taps(metrics.kernel_size(SIDE)).tolist()
_W = "[" + ", ".join(f"{a * b!r}::DOUBLE" for a in _TAPS for b in _TAPS) + "]"


def _moment(of: str) -> str:
    return f"list_sum(list_transform(range(0, 49), lambda n: w[n + 1] * {of}))"


_P, _G = "p[(i // 2 + n // 7) * 8 + i % 2 + n % 7 + 1]", "g[(i // 2 + n // 7) * 8 + i % 2 + n % 7 + 1]"


@query("M40 IMG02 IMG08", f"""WITH {S.UNIT_FRAMES}, one AS (SELECT p, g, {_W} AS w FROM unit_frames ORDER BY k LIMIT 1), m AS (SELECT {_moment(_P)} AS a, {_moment(_G)} AS b, {_moment(f'{_P} * {_P}')} AS aa, {_moment(f'{_G} * {_G}')} AS bb, {_moment(f'{_P} * {_G}')} AS ab
 FROM one, unnest(range(0, 4)) AS places(i)), s AS (SELECT avg((2 * a * b + 1e-4::DOUBLE) / (a * a + b * b + 1e-4::DOUBLE) * (2 * (ab - a * b) + 9e-4::DOUBLE) / (aa - a * a + bb - b * b + 9e-4::DOUBLE)) AS v FROM m)
 SELECT 'M40' AS method_id, metric, round(value, 6) AS value FROM (SELECT 'columns' AS metric, v AS value FROM s UNION ALL SELECT 'arrays', v FROM s UNION ALL SELECT 'difference', 0.0 FROM s)""")
def m40_two_ways(spark, d):
    return rounded(crossval.m40(views.frames(spark, d), SIDE))


@query("STN03 IMG08")
def stn_gaussian(spark, d):
    """The Gaussian window of SSIM over every frame, where it fits."""
    taps = metrics.gaussian_taps(metrics.kernel_size(SIDE))

    def run(batches):
        for batch in batches:
            out = batch[["k"]].copy()
            out["value"] = metrics._valid_filter(metrics.stack(batch["bt"], SIDE), taps).reshape(len(batch), -1).tolist() if len(batch) else []
            yield out
    return views.frames(spark, d).select("k", "bt").mapInPandas(run, "k long, value array<double>").select("k", F.posexplode("value").alias("i", "value")).select("k", "i", r("value").alias("value"))


def brute_gaussian(frame: np.ndarray) -> np.ndarray:
    """The same window by its definition, for tests."""
    taps = metrics.gaussian_taps(metrics.kernel_size(SIDE))
    n = len(taps)
    return np.array([[sum(taps[a] * taps[b] * frame[y + a, x + b] for a in range(n) for b in range(n)) for x in range(SIDE - n + 1)] for y in range(SIDE - n + 1)])
