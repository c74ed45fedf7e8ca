"""Queries on small functions: normalisation by stored statistics, weighted products, flow vectors in two schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import scalar
from cadenza.operators import metrics, stencil
from cadenza.plans import sql as S
from cadenza.plans.registry import query, r
from cadenza.sources import views


@query("SCL09", f"""WITH {S.PX}, s AS (SELECT label, avg(bt) AS mean, stddev_pop(bt) AS std FROM px WHERE label % 2 = 0 GROUP BY label),
 n AS (SELECT label, bt, mean, std, CASE WHEN std >= 1e-6 THEN (bt - mean) / std ELSE (bt - 180.0::DOUBLE) / 150.0::DOUBLE END AS norm FROM px LEFT JOIN s USING (label))
 SELECT label, round(min(norm), 6) AS low, round(max(norm), 6) AS high, round(avg(CASE WHEN std >= 1e-6 THEN norm * std + mean ELSE norm * 150.0::DOUBLE + 180.0::DOUBLE END), 6) AS back FROM n GROUP BY label""")
def scl_resolved(spark, d):
    """Every second data set has stored statistics; the others go by the fixed range."""
    px = views.pixels(views.frames(spark, d).select("k", "label", "bt"), "bt")
    stats = px.filter(F.col("label") % 2 == 0).groupBy("label").agg(F.avg("bt").alias("mean"), F.stddev_pop("bt").alias("std"))
    found = scalar.resolved(px, stats, "label")
    return found.groupBy("label").agg(r(F.min("norm")).alias("low"), r(F.max("norm")).alias("high"), r(F.avg(scalar.unresolved(F.col("norm"), F.col("mean"), F.col("std")))).alias("back"))


@query("AGG22", f"""WITH {S.PX}, {S.MIDDLE}, u AS (SELECT k, {S.unit('pred')} - {S.unit('truth')} AS u FROM middle), q AS (SELECT k, avg(abs(u)) AS mae, sqrt(avg(u * u)) AS rmse FROM u GROUP BY k) SELECT k, round(exp(0.25::DOUBLE * ln(greatest(1.0 - mae, 0.0)) + 0.75::DOUBLE * ln(greatest(1.0 - rmse, 0.0))), 5) AS score FROM q""")
def agg_product(spark, d):
    """The weighted product of two scores of each frame's blend."""
    each = metrics.array_metrics(_middle(spark, d), ["k"])
    scores = each.select("k", F.explode(F.array(*[F.struct((1 - F.col(m)).alias("value"), F.lit(w).alias("weight")) for m, w in (("mae", 0.25), ("rmse", 0.75))])).alias("s")).select("k", "s.*")
    return metrics.weighted_product(scores, ["k"]).select("k", r("product", 5).alias("score"))


def _middle(spark, d):
    from cadenza.operators import crossval

    return crossval.middle(views.frames(spark, d))


@query("FLW16", f"""WITH {S.PX}, f AS (SELECT k, y, x, (bt - 250) / 10 AS u, (250 - bt) / 20 AS v FROM px WHERE y % 4 = 2 AND x % 4 = 2) SELECT k, round(x + 0.0::DOUBLE, 6) AS x0, round(y + 0.0::DOUBLE, 6) AS y0, round(x + u, 6) AS x1, round(y + v, 6) AS y1 FROM f""")
def flw_schemas(spark, d):
    """Flow vectors of two schemas in one table, by start and displacement or by start and end, brought to one."""
    fr = views.frames(spark, d).select("k", F.transform("bt", lambda b: (b - 250) / 10).alias("u"), F.transform("bt", lambda b: (250 - b) / 20).alias("v"))
    vectors = stencil.flow_vectors(fr, ["k"], views.SIDE, 4)
    first = vectors.filter(F.col("k") % 2 == 0).select("k", F.to_json(F.struct("x", "y", F.col("dx").alias("u"), F.col("dy").alias("v"))).alias("json"))
    ends = F.struct(F.array("x", "y").alias("start"), F.array(F.col("x") + F.col("dx"), F.col("y") + F.col("dy")).alias("end"))
    both = first.unionByName(vectors.filter(F.col("k") % 2 == 1).select("k", F.to_json(ends).alias("json")))
    return stencil.one_schema(both, ["k"]).select("k", *[r(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
