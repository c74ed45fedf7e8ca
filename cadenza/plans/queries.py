"""Queries over the driver's tables, each with the SQL that a second engine runs on them where SQL can express it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import scalar, text
from cadenza.operators import crossval, grid, manifest, metrics, sequence, stats, stencil, synth
from cadenza.plans import sql as S
from cadenza.plans.registry import QUERIES, query, r
from cadenza.plans.registry import rounded as _rounded
from cadenza.sources import images, netcdf, views
from cadenza.sources.views import SIDE, table
from cadenza.streaming import frames as streaming


def _values(rows: DataFrame) -> DataFrame:
    """method_id, metric and rounded value."""
    return rows.select("method_id", "metric", r("value").alias("value"))


# --- scalars ---------------------------------------------------------------------------------------------------

@query("SCL01 SCL03 SCL05 SCL06 SCL07 SCL08 SCL10 ARR04 FLT08", f"""WITH {S.SERIES} SELECT event_id, round((bt - 180.0) / 150.0, 6) AS norm, round({S.unit('bt')}, 6) AS unit,
 round((bt - 180.0) / 150.0 * 150.0 + 180.0, 6) AS back, round({S.unit('bt')} * 140.0 + 180.0, 6) AS from_unit, round(coalesce((CASE WHEN event_type = 'error' THEN NULL ELSE bt END - 180.0) / 150.0, 0.0), 6) AS filled FROM series""")
def scl_normalize(spark, d):
    bt = F.col("bt")
    missing = F.when(F.coalesce(F.col("event_type") == "error", F.lit(False)), F.lit(None)).otherwise(bt)
    return _rounded(views.series(spark, d).select(
        "event_id", scalar.normalize_bt(bt).alias("norm"), scalar.to_unit_interval(bt).alias("unit"), scalar.denormalize_bt(scalar.normalize_bt(bt)).alias("back"),
        scalar.from_unit_interval(scalar.to_unit_interval(bt)).alias("from_unit"), scalar.model_input(missing).alias("filled")))


@query("SCL02 SCL04 AGG01", f"""WITH {S.PX}, s AS (SELECT label, avg(bt) AS m, stddev_pop(bt) AS s FROM px GROUP BY label)
 SELECT k, label, i::INT AS i, round((bt - m) / s, 5) AS z, round((bt - m) / s * s + m, 5) AS back FROM px JOIN s USING (label)""")
def scl_zscore(spark, d):
    fr = views.frames(spark, d)
    px = fr.select("k", "label", F.posexplode("bt").alias("i", "bt"))
    st = px.groupBy("label").agg(F.avg("bt").alias("m"), F.stddev_pop("bt").alias("s"))
    z = scalar.zscore(F.col("bt"), F.col("m"), F.col("s"))
    return px.join(st, "label").select("k", "label", "i", r(z, 5).alias("z"), r(scalar.un_zscore(z, F.col("m"), F.col("s")), 5).alias("back"))


@query("SCL11 SCL13 SCL14", """SELECT l_orderkey, l_linenumber, round(CASE WHEN rad > 0 THEN (1392.74::DOUBLE / ln(10803.3::DOUBLE / rad + 1) - 0.07396::DOUBLE) / 0.99961::DOUBLE END, 6) AS bt
 FROM (SELECT l_orderkey, l_linenumber, 0.0005::DOUBLE * l_quantity * l_quantity + 2.0::DOUBLE * l_quantity - 10.0::DOUBLE AS rad FROM lineitem)""")
def scl_planck(spark, d):
    rad = scalar.count_to_radiance(F.col("l_quantity"), 2.0, -10.0, 0.0005)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(scalar.radiance_to_bt(rad, 10803.3, 1392.74, 0.07396, 0.99961)).alias("bt"))


@query("SCL12 JON15 AGG01", """WITH t AS (SELECT l_returnflag, l_quantity::INT AS c FROM lineitem)
 SELECT l_returnflag, count(*) AS n, count(v) AS n_valid, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high
 FROM (SELECT l_returnflag, CASE WHEN c < 40 THEN 150.0::DOUBLE + c * 200.0::DOUBLE / 63 END AS v FROM t) GROUP BY l_returnflag""")
def scl_lut(spark, d):
    lut = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: 150.0 + i * 200.0 / 63)
    v = scalar.lut_lookup(lut, F.col("l_quantity").cast("int"))
    return _rounded(table(spark, d, "lineitem").select("l_returnflag", v.alias("v")).groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count("v").alias("n_valid"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high")))


@query("SCL15 SCL16 SCL17 FLT03 JON02", f"""WITH {S.MASKED_FRAMES}, p AS (SELECT a.k, i, CASE WHEN a.k % 3 = 0 AND i % 5 = 0 THEN NULL ELSE a.bt[i + 1] END AS a, b.bt[i + 1] AS b FROM masked a JOIN masked b ON b.k = a.k + 1, {S.CELLS})
 SELECT k, i::INT AS i, round(0.75::DOUBLE * a + 0.25::DOUBLE * b, 6) AS blend, round(coalesce(0.75::DOUBLE * a + 0.25::DOUBLE * b, a, b), 6) AS one_sided, round(b, 6) AS copied,
 round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN coalesce(a, 0) END, 6) AS restored FROM p""")
def scl_blend(spark, d):
    p = sequence.brackets(views.frames(spark, d, masked=True), ["bt"]).select("k", F.posexplode(F.arrays_zip("bt", "bt_next")).alias("i", "v"))
    a = F.when(~((F.col("k") % 3 == 0) & (F.col("i") % 5 == 0)), F.col("v.bt"))
    b = F.col("v.bt_next")
    return _rounded(p.select("k", "i", scalar.linear_blend(a, b, 0.25).alias("blend"), scalar.linear_blend(a, b, 0.25, "one_sided").alias("one_sided"), scalar.frame_copy(a, b, 0.5).alias("copied"), scalar.restore_mask(F.coalesce(a, F.lit(0.0)), a, b).alias("restored")))


@query("SCL18 SCL19 ARR01 HLP01 HLP02", """WITH g AS (SELECT s_suppkey, (4 + s_suppkey % 4)::INT AS n_rows, (3 + s_suppkey % 5)::INT AS n_cols, 30.0::DOUBLE + s_suppkey % 9 AS north, 60.0::DOUBLE + s_suppkey % 11 AS west FROM supplier)
 SELECT s_suppkey, y::INT AS y, x::INT AS x, round(north - (y + 0.5::DOUBLE) * 0.5::DOUBLE, 6) AS lat, round(west + (x + 0.5::DOUBLE) * 0.25::DOUBLE, 6) AS lon, n_rows * n_cols AS n_cells FROM g, unnest(range(0, n_rows)) a(y), unnest(range(0, n_cols)) b(x)""")
def scl_grid(spark, d):
    """The pixel centres of each supplier's own grid, whose parameters went through JSON."""
    k = F.col("s_suppkey")
    rows, cols, north, west = (4 + k % 4).cast("int"), (3 + k % 5).cast("int"), 30.0 + k % 9, 60.0 + k % 11
    spec = F.struct(west.alias("west"), (north - rows * 0.5).alias("south"), (west + cols * 0.25).alias("east"), north.alias("north"), rows.alias("n_rows"), cols.alias("n_cols"))
    read = F.from_json(F.to_json(spec), "west double, south double, east double, north double, n_rows int, n_cols int")
    g = table(spark, d, "supplier").select("s_suppkey", read.alias("g")).select("s_suppkey", "g.*", (F.col("g.n_rows") * F.col("g.n_cols")).alias("n_cells"))
    cells = g.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_cells") - 1))).withColumn("y", F.floor(F.col("i") / F.col("n_cols")).cast("int")).withColumn("x", (F.col("i") % F.col("n_cols")).cast("int"))
    lat, lon = scalar.lat_center(F.col("y"), F.col("north"), F.col("south"), F.col("n_rows")), scalar.lon_center(F.col("x"), F.col("west"), F.col("east"), F.col("n_cols"))
    return _rounded(cells.select("s_suppkey", "y", "x", lat.alias("lat"), lon.alias("lon"), "n_cells"))


_GEO = dict(r_eq=6378137.0, r_pol=6356752.31414, height=35786023.0, lon_0=-75.0)


@query("GEO01 MTH01", """WITH s AS (SELECT c_custkey, ((c_custkey % 40) - 20) * 0.008::DOUBLE AS x, ((c_custkey // 40 % 40) - 20) * 0.008::DOUBLE AS y, 6378137.0::DOUBLE AS re, 6356752.31414::DOUBLE AS rp, 42164160.0::DOUBLE AS h FROM customer),
 q AS (SELECT *, pow(sin(x), 2) + pow(cos(x), 2) * (pow(cos(y), 2) + pow(re / rp, 2) * pow(sin(y), 2)) AS a, -2.0 * h * cos(x) * cos(y) AS b, h * h - re * re AS c FROM s),
 t AS (SELECT *, CASE WHEN b * b - 4 * a * c >= 0 THEN (-b - sqrt(greatest(0.0::DOUBLE, b * b - 4 * a * c))) / (2 * a) END AS rs FROM q),
 v AS (SELECT *, rs * cos(x) * cos(y) AS sx, -rs * sin(x) AS sy, rs * cos(x) * sin(y) AS sz FROM t)
 SELECT c_custkey, round(degrees(atan(pow(re / rp, 2) * sz / sqrt(pow(h - sx, 2) + sy * sy))), 6) AS lat, round(-75.0::DOUBLE - degrees(atan(sy / (h - sx))), 6) AS lon FROM v""")
def geo_scan_angles(spark, d):
    k = F.col("c_custkey")
    x, y = (k % 40 - 20) * F.lit(0.008), (F.floor(k / 40) % 40 - 20) * F.lit(0.008)
    lat, lon = scalar.scan_angle_to_lat_lon(x, y, **_GEO)
    return _rounded(table(spark, d, "customer").select("c_custkey", lat.alias("lat"), lon.alias("lon")))


# --- names, times, sources ----------------------------------------------------------------------------------------

_NAMES_SQL = """names AS (SELECT o_orderkey, o_orderdate AS t,
 'OR_ABI-L1b-RadF-M6C13_G19_s' || strftime(o_orderdate, '%Y%j%H%M%S') || '0.nc' AS a, 'HS_H09_' || strftime(o_orderdate, '%Y%m%d_%H%M') || '_B13_FLDK.nc' AS b,
 'gk2a_ami_le1b_ir105_fd020ge_' || strftime(o_orderdate, '%Y%m%d%H%M') || '.nc' AS c, '3RIMG_' || upper(strftime(o_orderdate, '%d%b%Y_%H%M')) || '_L1B_STD.h5' AS e FROM orders)"""


def _names(spark, d) -> DataFrame:
    t = F.col("o_orderdate")
    f = lambda p: F.date_format(t, p)
    return table(spark, d, "orders").select(
        "o_orderkey", t.alias("t"), F.concat(F.lit("OR_ABI-L1b-RadF-M6C13_G19_s"), f("yyyyDDDHHmmss"), F.lit("0.nc")).alias("a"),
        F.concat(F.lit("HS_H09_"), f("yyyyMMdd_HHmm"), F.lit("_B13_FLDK.nc")).alias("b"), F.concat(F.lit("gk2a_ami_le1b_ir105_fd020ge_"), f("yyyyMMddHHmm"), F.lit(".nc")).alias("c"),
        F.concat(F.lit("3RIMG_"), F.upper(f("ddMMMyyyy_HHmm")), F.lit("_L1B_STD.h5")).alias("e"))


@query("STR03 STR04 STR05 STR06 SRC13", f"""WITH {_NAMES_SQL} SELECT o_orderkey, date_trunc('second', t) AS scan, date_trunc('minute', t) AS segment, date_trunc('minute', t) AS stamp, date_trunc('minute', t) AS named FROM names""")
def str_frame_times(spark, d):
    return _names(spark, d).select("o_orderkey", text.day_of_year_time(F.col("a")).alias("scan"), text.segment_time(F.col("b")).alias("segment"), text.stamp_time(F.col("c")).alias("stamp"), text.month_name_time(F.col("e")).alias("named"))


@query("SRC01 SRC04 JON13", f"""WITH {_NAMES_SQL} SELECT o_orderkey, 'GOES-19' AS a, 'Himawari-9' AS b, 'GK-2A' AS c, 'INSAT-3DR' AS e, CASE WHEN o_orderkey % 2 = 0 THEN 'GOES-19' END AS alias FROM names""")
def src_infer(spark, d):
    alias = F.when(F.col("o_orderkey") % 2 == 0, F.lit(" GOES_19")).otherwise(F.lit("nope"))
    return _names(spark, d).select("o_orderkey", *[text.infer_source(F.col(c)).alias(c) for c in "abce"], text.source_key(alias).alias("alias"))


@query("SRC02 SRC09 SRC17 FLT05 SRT01", f"""WITH {_NAMES_SQL} SELECT a AS name, t FROM names WHERE date_trunc('second', t) BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30 12:00:00'""")
def src_list(spark, d):
    start, end = F.lit("1996-06-30 12:00:00").cast("timestamp_ntz"), F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")
    own = text.day_of_year_time(F.col("a"))
    return _names(spark, d).filter(own.between(F.least(start, end), F.greatest(start, end))).select(F.col("a").alias("name"), "t")


@query("JON16", f"""WITH {_NAMES_SQL} SELECT o_orderkey || '/' || a AS name FROM names WHERE o_orderkey % 3 <> 0""")
def src_missing(spark, d):
    names = _names(spark, d).select(F.concat_ws("/", "o_orderkey", "a").alias("name"), "o_orderkey")
    return names.join(names.filter("o_orderkey % 3 = 0").select("name"), "name", "left_anti").select("name")


@query("SRC12 STR12 SRC09", """SELECT o_orderkey, strftime(h, '%Y/%j/%H') AS prefix FROM (SELECT o_orderkey, unnest(generate_series(date_trunc('hour', o_orderdate), date_trunc('hour', o_orderdate + INTERVAL 3 HOUR), INTERVAL 1 HOUR)) AS h FROM orders)""")
def src_hours(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.explode(text.hour_prefixes(t + F.expr("interval 3 hours"), t)).alias("prefix"))


@query("STR01 STR02 STR09 STR11 STR14", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, true AS ok, date_trunc('second', ts) AS parsed, date_trunc('second', ts) AS local, date_trunc('second', ts) - INTERVAL 2 HOUR AS shifted, try_cast(event_type AS DOUBLE) AS opt FROM events""")
def str_iso(spark, d):
    iso = text.iso_z(F.col("ts"))
    offset = F.regexp_replace(iso, "Z$", "+02:00")
    return table(spark, d, "events").select("event_id", iso.alias("iso"), text.is_iso_z(iso).alias("ok"), text.parse_time(iso).alias("parsed"), text.parse_iso_local(offset).alias("local"), text.parse_time(offset).alias("shifted"), F.expr("try_cast(event_type as double)").alias("opt"))


@query("STR13 TIL02 TIL01", """SELECT k, z, x, y, printf('tiles/%03d/{z}/{x}/{y}.webp', k) AS template FROM (SELECT vec_id AS k FROM embeddings), unnest([0, 1, 2, 3]) a(z), unnest(range(0, 8)) b(x), unnest(range(0, 8)) c(y) WHERE x < pow(2, z) AND y < pow(2, z)""")
def til_pyramid(spark, d):
    fr = table(spark, d, "embeddings").select(F.col("vec_id").alias("k"))
    t = grid.tile_pyramid(fr, "k", 0, grid.default_max_zoom(2048, 1500))
    return t.select("k", "z", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), text.tile_template(F.col("k")).alias("template"))


@query("STR18", """SELECT vec_id AS k, 'interp:' || sha256(vec_id || '|' || label || '|t=0.5|linear') AS key FROM embeddings""")
def str_cache_key(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), text.cache_key(F.col("vec_id").cast("string"), F.col("label").cast("string"), F.concat(F.lit("t="), F.regexp_replace(text.nine_digits(F.lit(0.5)), "0+$", "")), F.lit("linear")).alias("key"))


@query("STR17 VIZ02 VIZ08", """WITH c AS (SELECT c_custkey, printf('#%06x', c_custkey * 7919 % 16777216) AS c FROM customer) SELECT c_custkey, ('0x' || substr(c, 2, 2))::INT AS r, ('0x' || substr(c, 4, 2))::INT AS g, ('0x' || substr(c, 6, 2))::INT AS b FROM c""")
def str_colors(spark, d):
    """Channels of a colour for each customer."""
    color = F.format_string("#%06x", F.col("c_custkey") * 7919 % 16777216)
    return table(spark, d, "customer").select("c_custkey", *[text.hex_channel(color, n).alias("rgb"[n]) for n in range(3)])


# --- filters, joins, sequence ---------------------------------------------------------------------------------------

@query("FLT01 FLT02 FLT04 FLT10 JON03", f"""WITH {S.MASKED} SELECT m.k, round(avg(CASE WHEN m.bt IS NOT NULL AND a.bt IS NOT NULL AND b.bt IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS valid_fraction
 FROM px m JOIN px a ON a.k = m.k - 1 AND a.i = m.i JOIN px b ON b.k = m.k + 1 AND b.i = m.i GROUP BY m.k""")
def flt_triplet_mask(spark, d):
    t = sequence.triplets(views.frames(spark, d, masked=True), ["bt"])
    ok = F.filter(F.arrays_zip("bt_prev", "bt", "bt_next"), lambda s: s["bt_prev"].isNotNull() & s["bt"].isNotNull() & s["bt_next"].isNotNull())
    return t.select("k", r(F.size(ok) / 64.0).alias("valid_fraction"))


@query("FLT12 FLT09 FLT11", """SELECT event_id, CASE WHEN isfinite(v) THEN round(v, 6) END AS v FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'nan'::DOUBLE WHEN 'click' THEN 'inf'::DOUBLE ELSE value END AS v FROM events)""")
def flt_finite(spark, d):
    v = F.when(F.col("event_type") == "error", float("nan")).when(F.col("event_type") == "click", float("inf")).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", r(scalar.nan_to_null(v)).alias("v"))


@query("FLT13", """SELECT page_id, regexp_matches(url, '(/|\\\\|\\.\\.)') AS unsafe FROM pages""")
def flt_traversal(spark, d):
    return table(spark, d, "pages").select("page_id", F.col("url").rlike(r"(/|\\|\.\.)").alias("unsafe"))


@query("WIN01 SNK04 JON03", f"""WITH {S.FRAMES} SELECT * FROM (SELECT k AS mid_index, k - 1 AS prev_index, k + 1 AS next_index, strftime(lag(time) OVER w, '%Y-%m-%dT%H:%M:%SZ') AS prev_time, strftime(time, '%Y-%m-%dT%H:%M:%SZ') AS mid_time,
 strftime(lead(time) OVER w, '%Y-%m-%dT%H:%M:%SZ') AS next_time, 0.5::DOUBLE AS t, 30 AS cadence_min FROM frames WINDOW w AS (ORDER BY k)) WHERE prev_time IS NOT NULL AND next_time IS NOT NULL""")
def win_catalog(spark, d):
    return sequence.triplet_catalog(views.frames(spark, d), 30)


@query("WIN02 SET05", f"""WITH {S.FRAMES}, n AS (SELECT count(*) - 2 AS n FROM frames), c AS (SELECT n, least(greatest(round_even(n * 0.7::DOUBLE, 0), 1), n - 2)::BIGINT AS tr, greatest(round_even(n * 0.15::DOUBLE, 0), 1)::BIGINT AS va FROM n)
 SELECT k, CASE WHEN k <= tr THEN 'train' WHEN k <= tr + va THEN 'val' ELSE 'test' END AS split FROM frames, c WHERE k BETWEEN 1 AND n""")
def win_interior_split(spark, d):
    fr = views.frames(spark, d).select("k")
    n = fr.agg(F.count("*")).first()[0]
    return fr.withColumn("split", sequence.split_column(F.col("k"), sequence.interior_split(n, 0.7, 0.15))).filter("split is not null")


@query("WIN03 TRN02 HLP10", """WITH o AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place, count(*) OVER () AS n FROM events), c AS (SELECT *, greatest(1, least(round_even(0.8::DOUBLE * n, 0), n - 1)) AS tr FROM o)
 SELECT event_id, place, CASE WHEN place < tr THEN 'train' WHEN place < tr + greatest(1, least(round_even(0.1::DOUBLE * n, 0), n - tr)) THEN 'val' ELSE 'test' END AS split FROM c""")
def win_time_split(spark, d):
    ev = table(spark, d, "events").select("event_id", "ts")
    n = ev.agg(F.count("*")).first()[0]
    placed = sequence.ordinals(ev, ["ts", "event_id"], "place")
    return placed.select("event_id", "place", sequence.split_column(F.col("place"), sequence.time_split(n, 0.8, 0.1)).alias("split"))


@query("WIN05 WIN06 WIN07 WIN13 SET02 MDL05", f"""WITH {S.PX}, p AS (SELECT a.k, a.i, s, a.bt AS a, b.bt AS b FROM px a LEFT JOIN px b ON b.k = a.k + 1 AND b.i = a.i, unnest([0, 1, 2, 3]) r(s) WHERE s = 0 OR b.k IS NOT NULL)
 SELECT 4 * k + s AS frame, CASE WHEN s = 0 THEN 'observed' ELSE 'interpolated' END AS kind, CASE WHEN s > 0 THEN s / 4.0::DOUBLE END AS t, CASE WHEN s > 0 THEN k ELSE -1 END AS bracket_from, CASE WHEN s > 0 THEN 4 * k ELSE -1 END AS bracket_frame_from,
 TIMESTAMP '2025-06-20 00:00:00' + to_seconds((k * 1800 + s * 450)::INT) AS time, round(avg(CASE WHEN s = 0 THEN a ELSE (1 - s / 4.0::DOUBLE) * a + s / 4.0::DOUBLE * b END), 6) AS mean FROM p GROUP BY k, s""")
def win_densify(spark, d):
    fr = views.frames(spark, d)
    last = fr.agg(F.max("k")).first()[0]
    dense = sequence.densify_direct(fr, 3, last if last is not None else 0)
    mean = F.aggregate("bt", F.lit(0.0), lambda a, v: a + v) / F.size("bt")
    return dense.select("frame", "kind", "t", F.coalesce(F.get("bracket_obs", F.lit(0)), F.lit(-1)).alias("bracket_from"), F.coalesce(F.get("bracket_frame", F.lit(0)), F.lit(-1)).alias("bracket_frame_from"), "time", r(mean).alias("mean"))


@query("WIN04 WIN17", f"""WITH {S.PX}, p AS (SELECT a.k, s, a.bt AS a, b.bt AS b FROM px a LEFT JOIN px b ON b.k = a.k + 1 AND b.i = a.i, unnest([0, 1, 2, 3]) r(s) WHERE s = 0 OR b.k IS NOT NULL)
 SELECT 4 * k + s AS frame, CASE WHEN s = 0 THEN 'observed' ELSE 'interpolated' END AS kind, round(avg(CASE WHEN s = 0 THEN a ELSE (1 - s / 4.0::DOUBLE) * a + s / 4.0::DOUBLE * b END), 6) AS mean FROM p GROUP BY k, s""")
def win_recursive(spark, d):
    mean = F.aggregate("bt", F.lit(0.0), lambda a, v: a + v) / F.size("bt")
    return sequence.densify_recursive(views.frames(spark, d), 4).select("frame", "kind", r(mean).alias("mean"))


@query("JON05 WIN09 STM01", f"""WITH {S.SERIES}, v AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN bt END AS o FROM series)
 SELECT user_id, event_id, round(coalesce(last_value(o IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(o IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS asof FROM v""")
def win_asof(spark, d):
    return sequence.fill_forward(views.series(spark, d), ["user_id"], ["ts", "event_id"], "bt", F.col("event_id") % 3 == 0).select("user_id", "event_id", r("asof").alias("asof"))


@query("WIN12 WIN08", f"""WITH {S.SERIES} SELECT user_id, event_id, round(bt - lag(bt) OVER w, 6) AS step, round(lead(bt) OVER w - bt, 6) AS next_step FROM series WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_steps(spark, d):
    s = sequence.lag_lead(views.series(spark, d), ["user_id"], ["ts", "event_id"], "bt")
    return s.select("user_id", "event_id", r(F.col("bt") - F.col("prev_bt")).alias("step"), r(F.col("next_bt") - F.col("bt")).alias("next_step"))


@query("WIN10 WIN11 STR08", f"""WITH {S.FRAMES} SELECT k, CASE WHEN k % 2 = 0 THEN time ELSE TIMESTAMP '2025-06-20 00:00:00' + to_minutes(15 * k::INT) END AS time FROM frames""")
def win_resolve_times(spark, d):
    fr = views.frames(spark, d).select("k", F.when(F.col("k") % 2 == 0, F.col("time")).alias("time"))
    return sequence.resolve_times(fr, "2025-06-20 00:00:00", 15)


@query("WIN15 JON11", f"""WITH {S.PX}, e AS (SELECT a.k + 1 AS k, 0.5::DOUBLE * a.bt + 0.5::DOUBLE * b.bt AS pred, t.bt AS truth FROM px a JOIN px b ON b.k = a.k + 2 AND b.i = a.i JOIN px t ON t.k = a.k + 1 AND t.i = a.i WHERE a.k % 2 = 0)
 SELECT k, {S.pixel_metrics()} FROM e GROUP BY k""")
def win_holdout(spark, d):
    found = metrics.array_metrics(crossval.across(views.frames(spark, d), 2, [1]), ["m"])
    return _rounded(found.withColumnRenamed("m", "k"), mse=8)


@query("WIN01 SRT02", """SELECT conv_id, turn, role, lag(role) OVER w AS prev_role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def win_turns(spark, d):
    return sequence.lag_lead(table(spark, d, "conversations"), ["conv_id"], ["turn"], "role").select("conv_id", "turn", "role", "prev_role", "next_role")


@query("JON04 JON14 SET04", f"""WITH {S.PX}, {S.MIDDLE}, m AS (SELECT k, round({S.rmse('pred', 'truth')}, 6) AS e FROM middle GROUP BY k) SELECT vec_id AS k, label, e AS bt_rmse_k FROM embeddings LEFT JOIN m ON m.k = vec_id AND vec_id % 2 = 1""")
def jon_metric_left(spark, d):
    fr = views.frames(spark, d)
    m = crossval.per_triplet(fr).filter("k % 2 = 1").select("k", r("bt_rmse_k").alias("bt_rmse_k"))
    return fr.select("k", "label").join(m, "k", "left")


# --- metrics ---------------------------------------------------------------------------------------------------------

@query("M1 JON01 AGG02 AGG03 AGG04 AGG05 AGG06 AGG07 IMG01 FLT01", f"""WITH {S.MASKED}, {S.MIDDLE} SELECT k, {S.pixel_metrics()} FROM middle GROUP BY k""")
def m01_leave_middle_out(spark, d):
    return _rounded(crossval.per_triplet(views.frames(spark, d, masked=True)).drop("label"), mse=8)


@query("JON01 IMG06 AGG08 AGG09", f"""WITH {S.MASKED}, {S.MIDDLE} SELECT label, {S.pixel_metrics()} FROM middle GROUP BY label""")
def agg_pixels_by_label(spark, d):
    mid = crossval.middle(views.frames(spark, d, masked=True)).select("label", F.explode(F.arrays_zip("pred", "truth")).alias("p")).select("label", "p.*")
    return _rounded(metrics.pixel_metrics(mid, ["label"]), mse=8)


@query("AGG10 AGG11 AGG12 AGG13 AGG20 AGG21", f"""WITH {S.PX}, {S.MIDDLE}, m AS (SELECT k, label, {S.pixel_metrics()} FROM middle GROUP BY k, label), l AS (UNPIVOT (SELECT label, bt_bias_k, bt_rmse_k, mae, psnr, rmse FROM m) ON bt_bias_k, bt_rmse_k, mae, psnr, rmse INTO NAME metric VALUE value)
 SELECT coalesce(label, -1) AS label, coalesce(metric, 'all') AS metric, round(avg(value), 4) AS mean, count(value) AS n_finite FROM l GROUP BY ROLLUP (metric, label)""")
def agg_summaries(spark, d):
    long = metrics.long_metrics(_rounded(crossval.per_triplet(views.frames(spark, d)), mse=8), ["label"], ["bt_bias_k", "bt_rmse_k", "mae", "psnr", "rmse"])
    found = long.rollup("metric", "label").agg(r(F.avg("value"), 4).alias("mean"), F.count("value").alias("n_finite"))
    return found.select(F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("metric", F.lit("all")).alias("metric"), "mean", "n_finite")


@query("AGG14 M18 JON12", f"""WITH {S.PX}, {S.MIDDLE}, m AS (SELECT k, avg(pow({S.unit('pred')} - {S.unit('truth')}, 2)) AS mm, {S.rmse('pred', 'truth')} AS mr, avg(pow({S.unit('b')} - {S.unit('truth')}, 2)) AS bm, {S.rmse('b', 'truth')} AS br FROM middle GROUP BY k),
 a AS (SELECT avg(-10 * log10(bm)) AS base_psnr, avg(br) AS base_rmse, avg(-10 * log10(mm)) AS model_psnr, avg(mr) AS model_rmse FROM m)
 SELECT 'M18' AS method_id, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT *, model_psnr - base_psnr AS gain_psnr, base_rmse - model_rmse AS gain_rmse FROM a) ON COLUMNS(*) INTO NAME metric VALUE value)""")
def m18_persistence(spark, d):
    return _values(crossval.baseline(views.frames(spark, d), "M18", crossval.copy_model))


@query("M19", f"""WITH {S.PX}, {S.MIDDLE}, m AS (SELECT k, avg(pow({S.unit('pred')} - {S.unit('truth')}, 2)) AS mm, {S.rmse('pred', 'truth')} AS mr FROM middle GROUP BY k),
 a AS (SELECT avg(-10 * log10(mm)) AS base_psnr, avg(mr) AS base_rmse, avg(-10 * log10(mm)) AS model_psnr, avg(mr) AS model_rmse FROM m)
 SELECT 'M19' AS method_id, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT *, model_psnr - base_psnr AS gain_psnr, base_rmse - model_rmse AS gain_rmse FROM a) ON COLUMNS(*) INTO NAME metric VALUE value)""")
def m19_linear(spark, d):
    return _values(crossval.baseline(views.frames(spark, d), "M19", crossval.blend_model))


def _across_sql(lead: int, where: str = "TRUE") -> str:
    return f"""SELECT t.k, {S.rmse(f"((1 - (t.k - a.k) / {lead}.0::DOUBLE) * a.bt + (t.k - a.k) / {lead}.0::DOUBLE * b.bt)", 't.bt')} AS e FROM px a JOIN px b ON b.k = a.k + {lead} AND b.i = a.i JOIN px t ON t.k > a.k AND t.k < b.k AND t.i = a.i WHERE a.k % {lead} = 0 AND {where} GROUP BY t.k"""


@query("M3 WIN16", f"""WITH {S.PX} SELECT 'M3' AS method_id, metric, round(value, 6) AS value FROM (SELECT 'bt_rmse_k_x2' AS metric, avg(e) AS value FROM ({_across_sql(2)}) UNION ALL SELECT 'bt_rmse_k_x4', avg(e) FROM ({_across_sql(4)}) UNION ALL SELECT 'bt_rmse_k_x8', avg(e) FROM ({_across_sql(8)}))""")
def m03_multi_step(spark, d):
    return _values(crossval.m3(views.frames(spark, d)))


@query("M4 FLT09", f"""WITH {S.PX}, {S.MIDDLE}, one AS (SELECT avg(e) AS level1 FROM (SELECT {S.rmse('pred', 'truth')} AS e FROM middle GROUP BY k)),
 q AS (SELECT k, (a + pred) / 2 AS p, 0.75::DOUBLE * a + 0.25::DOUBLE * b AS g FROM middle UNION ALL SELECT k, (b + pred) / 2, 0.25::DOUBLE * a + 0.75::DOUBLE * b FROM middle), two AS (SELECT avg(e) AS level2 FROM (SELECT {S.rmse('p', 'g')} AS e FROM q GROUP BY k))
 SELECT 'M4' AS method_id, metric, round(value, 6) AS value FROM (SELECT 'level1' AS metric, level1 AS value FROM one UNION ALL SELECT 'level2', level2 FROM two UNION ALL SELECT 'ratio', level2 / level1 FROM one, two)""")
def m04_recursion(spark, d):
    return _values(crossval.m4(views.frames(spark, d)))


@query("M5", f"""WITH {S.PX}, {S.MIDDLE}, e AS (SELECT avg(e) AS v FROM (SELECT {S.rmse('pred', 'truth')} AS e FROM middle GROUP BY k)) SELECT 'M5' AS method_id, metric, round(value, 6) AS value FROM (SELECT 'bt_rmse_k_t0.25' AS metric, 0.0::DOUBLE AS value UNION ALL SELECT 'bt_rmse_k_t0.50', v FROM e UNION ALL SELECT 'bt_rmse_k_t0.75', 0.0)""")
def m05_asymmetric(spark, d):
    return _values(crossval.m5(views.frames(spark, d)))


@query("M6 WIN16", f"""WITH {S.PX}, {S.MIDDLE}, l AS (SELECT min(k) AS lo, (max(k) - min(k)) // 2 * 2 AS lead FROM px), far AS (SELECT {S.rmse('(0.5::DOUBLE * a.bt + 0.5::DOUBLE * b.bt)', 't.bt')} AS e FROM l JOIN px a ON a.k = lo JOIN px b ON b.k = lo + lead AND b.i = a.i JOIN px t ON t.k = lo + lead // 2 AND t.i = a.i)
 SELECT 'M6' AS method_id, metric, round(value, 6) AS value FROM (SELECT 'long_gap' AS metric, e AS value FROM far UNION ALL SELECT 'adjacent', avg(e) FROM (SELECT {S.rmse('pred', 'truth')} AS e FROM middle GROUP BY k))""")
def m06_long_gap(spark, d):
    return _values(crossval.m6(views.frames(spark, d)))


@query("M30 FLT06", f"""WITH {S.PX}, {S.MIDDLE} SELECT 'M30' AS method_id, metric, round(value, 6) AS value FROM (SELECT 'cold' AS metric, avg(e) AS value FROM (SELECT {S.rmse('pred', 'truth')} AS e FROM middle WHERE truth < 240 GROUP BY k) UNION ALL SELECT 'warm', avg(e) FROM (SELECT {S.rmse('pred', 'truth')} AS e FROM middle WHERE truth >= 240 GROUP BY k))""")
def m30_regimes(spark, d):
    return _values(crossval.m30(views.frames(spark, d)))


@query("M32", f"""WITH {S.PX}, {S.MIDDLE} SELECT 'M32' AS method_id, metric, round(value, 6) AS value FROM (SELECT 'lead_half' AS metric, avg(e) AS value FROM (SELECT {S.rmse('pred', 'truth')} AS e FROM middle GROUP BY k) UNION ALL SELECT 'lead_tenth', avg(e) FROM (SELECT {S.rmse('(0.9::DOUBLE * a + 0.1::DOUBLE * b)', 'a')} AS e FROM middle GROUP BY k))""")
def m32_lead(spark, d):
    return _values(crossval.m32(views.frames(spark, d)))


@query("M38 AGG15", f"""WITH {S.PX}, {S.MIDDLE}, m AS (SELECT k, avg(pred) AS p, avg(a) AS a, avg(b) AS b FROM middle GROUP BY k) SELECT 'M38' AS method_id, 'violations' AS metric, round(avg(CASE WHEN p < least(a, b) - 2 OR p > greatest(a, b) + 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS value FROM m""")
def m38_conservation(spark, d):
    return _values(crossval.m38(views.frames(spark, d)))


@query("M39 AGG19 WIN12", f"""WITH {S.PX}, {S.MIDDLE} SELECT 'M39' AS method_id, metric, round(value, 6) AS value FROM (SELECT 'seam' AS metric, avg(e) AS value FROM (SELECT avg(abs({S.unit('pred')} - {S.unit('a')})) AS e FROM middle GROUP BY k) UNION ALL SELECT 'half_step', avg(e) / 2 FROM (SELECT avg(abs({S.unit('b')} - {S.unit('a')})) AS e FROM middle GROUP BY k))""")
def m39_seams(spark, d):
    return _values(crossval.m39(views.frames(spark, d)))


@query("M20 FLW01 FLW04 FLW05 FLW06 FLW08 FLW09")
def m20_flow(spark, d):
    return _values(crossval.m20(views.frames(spark, d), SIDE))


@query("M20 FLW09")
def m20_block_flow(spark, d):
    """The same with the windowed least-squares flow."""
    return _values(crossval.m20(views.frames(spark, d), SIDE, "block"))


@query("M20 FLW02 FLW05 FLW06 FLW09")
def m20_polynomial(spark, d):
    """The same with the flow of polynomial expansions."""
    return _values(crossval.m20(views.frames(spark, d), SIDE, "polynomial"))


@query("M20 FLW03 FLW05 FLW07 FLW09")
def m20_total_variation(spark, d):
    """The same with the flow of least total variation."""
    return _values(crossval.m20(views.frames(spark, d), SIDE, "total_variation"))


@query("M26 FLW10 FLT07")
def m26_extreme_motion(spark, d):
    return _values(crossval.m26(views.frames(spark, d), SIDE))


@query("M31 STA02")
def m31_speed(spark, d):
    return _values(crossval.m31(views.frames(spark, d), SIDE))


@query("M33 IMG09 AGG17")
def m33_spectra(spark, d):
    return _values(crossval.m33(views.frames(spark, d), SIDE))


@query("M35 STA01 STA04")
def m35_significance(spark, d):
    return _values(crossval.m35(views.frames(spark, d)))


@query("M36")
def m36_agreement(spark, d):
    return _values(crossval.m36(views.frames(spark, d), SIDE))


@query("IMG02 IMG03 IMG04 IMG05 IMG07 IMG08 AGG22")
def img_windowed(spark, d):
    mid = crossval.middle(views.frames(spark, d, masked=True))
    return _rounded(metrics.windowed_metrics(mid, ["k"], SIDE))


@query("JON17 AGG16 SRT03", """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), r AS (SELECT user_id, CASE WHEN n >= 9 THEN 18 WHEN n >= 5 THEN 17 WHEN n >= 3 THEN 15 ELSE 0 END AS run FROM n)
 SELECT user_id, status, n FROM (SELECT user_id, 'run' AS status, run::BIGINT AS n FROM r UNION ALL SELECT user_id, 'skipped', 40 - run FROM r) WHERE n > 0""")
def m_registry(spark, d):
    """How many of the 40 methods each user's sequence of events is long and dense enough for."""
    sequences = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n_frames"))
    return crossval.statuses(sequences, "user_id").groupBy("user_id", "status").agg(F.count("*").alias("n"))


@query("STA03", """WITH v AS (SELECT l_quantity AS x, l_discount AS y FROM lineitem), a AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx FROM v), b AS (SELECT rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM a)
 SELECT round(corr(rx, ry), 8) AS spearman, count(*) AS n FROM b""")
def sta_spearman(spark, d):
    return stats.spearman(table(spark, d, "lineitem"), "l_quantity", "l_discount").select(r("spearman", 8).alias("spearman"), "n")


@query("STA04", """WITH v AS (SELECT l_quantity - 25.0::DOUBLE AS d FROM lineitem), a AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM v),
 t AS (SELECT sum(CASE WHEN d > 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0.0::DOUBLE END) AS w, sum(r) AS s, sum(r * r) AS q, count(*) AS n FROM a) SELECT round(w, 3) AS w_plus, round((w - s / 2) / sqrt(q / 4), 6) AS z, n FROM t""")
def sta_wilcoxon(spark, d):
    return stats.wilcoxon(table(spark, d, "lineitem").withColumn("c", F.lit(25.0)), "l_quantity", "c").select(r("w_plus", 3).alias("w_plus"), r("z").alias("z"), "n")


@query("STA02 STA05", f"""WITH {S.SERIES} SELECT event_type, round(median(bt), 6) AS mid, round(quantile_cont(bt, 0.05), 6) AS low, round(quantile_cont(bt, 0.95), 6) AS high, round(corr(bt, user_id::DOUBLE), 8) AS r FROM series GROUP BY event_type""")
def sta_percentiles(spark, d):
    series = views.series(spark, d)
    q = stats.quantiles(series, "bt", {"mid": 0.5, "low": 0.05, "high": 0.95}, ["event_type"])
    corr = series.groupBy(F.col("event_type").alias("c_type")).agg(r(stats.guarded_corr(F.col("bt"), F.col("user_id").cast("double")), 8).alias("r"))
    return q.join(corr, F.col("event_type").eqNullSafe(F.col("c_type"))).select("event_type", r("mid").alias("mid"), r("low").alias("low"), r("high").alias("high"), "r")


@query("EXT-CSI", f"""WITH {S.PX}, {S.MIDDLE}, c AS (SELECT label, count_if(pred < 240 AND truth < 240)::BIGINT AS hits, count_if(pred >= 240 AND truth < 240)::BIGINT AS misses, count_if(pred < 240 AND truth >= 240)::BIGINT AS false_alarms FROM middle GROUP BY label)
 SELECT label, hits, misses, false_alarms, round(hits / nullif(hits + misses, 0)::DOUBLE, 6) AS pod, round(false_alarms / nullif(hits + false_alarms, 0)::DOUBLE, 6) AS far, round(hits / nullif(hits + misses + false_alarms, 0)::DOUBLE, 6) AS csi, round((hits + false_alarms) / nullif(hits + misses, 0)::DOUBLE, 6) AS freq_bias FROM c""")
def ext_contingency(spark, d):
    mid = crossval.middle(views.frames(spark, d)).select("label", F.explode(F.arrays_zip("pred", "truth")).alias("p")).select("label", "p.*")
    return _rounded(metrics.contingency(mid, ["label"], 240.0))


@query("LOS01", f"""WITH {S.PX}, {S.MIDDLE} SELECT k, round(avg(sqrt(pow({S.unit('pred')} - {S.unit('truth')}, 2) + 1e-6::DOUBLE)), 6) AS charbonnier FROM middle GROUP BY k""")
def los_charbonnier(spark, d):
    px = crossval.middle(views.frames(spark, d)).select("k", F.explode(F.arrays_zip("pred", "truth")).alias("p")).select("k", "p.*")
    diff = scalar.to_unit_interval(F.col("pred")) - scalar.to_unit_interval(F.col("truth"))
    return px.groupBy("k").agg(r(F.avg(F.sqrt(F.pow(diff, 2.0) + 1e-6))).alias("charbonnier"))


# --- stencils, grids, rendering ----------------------------------------------------------------------------------------

def _cell(dy: int, dx: int) -> str:
    """The pixel at an offset of pixel i of the list bt, mirrored at the border."""
    return f"bt[(7 - abs(7 - abs(i // 8 + {dy}))) * 8 + 7 - abs(7 - abs(i % 8 + {dx})) + 1]"


@query("STN01", f"""WITH {S.FRAMES} SELECT k, i::INT AS i, round({_cell(-1, 1)} + 2 * {_cell(0, 1)} + {_cell(1, 1)} - {_cell(-1, -1)} - 2 * {_cell(0, -1)} - {_cell(1, -1)}, 5) AS gx,
 round({_cell(1, -1)} + 2 * {_cell(1, 0)} + {_cell(1, 1)} - {_cell(-1, -1)} - 2 * {_cell(-1, 0)} - {_cell(-1, 1)}, 5) AS gy FROM frames, {S.CELLS}""")
def stn_sobel(spark, d):
    gx, gy = stencil.sobel("bt", SIDE)
    return views.frames(spark, d).select("k", gx.alias("gx"), gy.alias("gy")).select("k", F.posexplode(F.arrays_zip("gx", "gy")).alias("i", "g")).select("k", "i", r("g.gx", 5).alias("gx"), r("g.gy", 5).alias("gy"))


@query("STN02", f"""WITH {S.FRAMES}, around AS (SELECT k, i, bt[i + 1] AS c, [bt[(7 - abs(7 - abs(i // 8 + n // 7 - 3))) * 8 + 7 - abs(7 - abs(i % 8 + n % 7 - 3)) + 1] FOR n IN range(0, 49)] AS v FROM frames, {S.CELLS})
 SELECT k, i::INT AS i, round(list_sum([(x - c) / sqrt(0.81::DOUBLE + pow(x - c, 2)) FOR x IN v]), 5) AS census FROM around""")
def stn_census(spark, d):
    c = stencil.census_sums(views.frames(spark, d), ["k"], "bt", SIDE)
    return c.select("k", F.posexplode("census").alias("i", "census")).select("k", "i", r("census", 5).alias("census"))


@query("FLW04 FLW08 FLW11", f"""WITH {S.FRAMES}, c AS (SELECT k, i, bt, greatest(0.0::DOUBLE, least(7.0::DOUBLE, i % 8 + 0.5::DOUBLE * 1.5::DOUBLE)) AS sx, greatest(0.0::DOUBLE, least(7.0::DOUBLE, i // 8 + 0.5::DOUBLE * -0.5::DOUBLE)) AS sy FROM frames, {S.CELLS}),
 w AS (SELECT k, i, bt, floor(sx)::INT AS x0, floor(sy)::INT AS y0, least(7, floor(sx)::INT + 1) AS x1, least(7, floor(sy)::INT + 1) AS y1, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM c)
 SELECT k, i::INT AS i, round((1 - fy) * ((1 - fx) * bt[y0 * 8 + x0 + 1] + fx * bt[y0 * 8 + x1 + 1]) + fy * ((1 - fx) * bt[y1 * 8 + x0 + 1] + fx * bt[y1 * 8 + x1 + 1]), 6) AS bt FROM w""")
def flw_warp(spark, d):
    fr = views.frames(spark, d).withColumn("u", F.array_repeat(F.lit(1.5), 64)).withColumn("v", F.array_repeat(F.lit(-0.5), 64))
    return fr.select("k", F.posexplode(stencil.warp("bt", "u", "v", SIDE, 0.5)).alias("i", "bt")).select("k", "i", r("bt").alias("bt"))


@query("FLW14 FLW15 SMP05 FLT14 FLW16", f"""WITH {S.PX}, f AS (SELECT k, y, x, (bt - 250) / 10 AS u, (250 - bt) / 20 AS v FROM px) SELECT k, y, x, round(68.0::DOUBLE + (x + 0.5::DOUBLE) * 3.75::DOUBLE, 6) AS lon0, round(38.0::DOUBLE - (y + 0.5::DOUBLE) * 4.0::DOUBLE, 6) AS lat0,
 round(68.0::DOUBLE + (x + 0.5::DOUBLE) * 3.75::DOUBLE + u * 3.75::DOUBLE, 6) AS lon1, round(38.0::DOUBLE - (y + 0.5::DOUBLE) * 4.0::DOUBLE - v * 4.0::DOUBLE, 6) AS lat1 FROM f WHERE y % 4 = 2 AND x % 4 = 2""")
def flw_overlay(spark, d):
    fr = views.frames(spark, d).select("k", F.transform("bt", lambda b: (b - 250) / 10).alias("u"), F.transform("bt", lambda b: (250 - b) / 20).alias("v"))
    return stencil.flow_overlay(stencil.flow_vectors(fr, ["k"], SIDE, 4), SIDE, 68.0, 6.0, 98.0, 38.0).select("k", "y", "x", "lon0", "lat0", "lon1", "lat1")


@query("FLW13", f"""WITH {S.PX}, f AS (SELECT k, i, (bt - 250) / 10 AS u, (260 - bt) / 20 AS v FROM px) SELECT k, i::INT AS i, round((degrees(atan2(-v, -u)) + 360) % 360, 4) AS hue, round(least(1.0::DOUBLE, sqrt(u * u + v * v) / 3), 6) AS saturation FROM f""")
def flw_color(spark, d):
    px = views.frames(spark, d).select("k", F.posexplode("bt").alias("i", "bt"))
    hue, saturation = stencil.flow_color((F.col("bt") - 250) / 10, (260 - F.col("bt")) / 20, 3.0)
    return px.select("k", "i", r(hue, 4).alias("hue"), r(saturation).alias("saturation"))


@query("JON06 JON07 JON09 JON10 SRT04", """WITH s AS (SELECT s_suppkey AS s_id, 8.0::DOUBLE + (s_suppkey * 37 % 280) / 10.0::DOUBLE AS lat, 70.0::DOUBLE + (s_suppkey * 53 % 260) / 10.0::DOUBLE AS lon FROM supplier), t AS (SELECT c_custkey AS t_id, 8.0::DOUBLE + (c_custkey * 11 % 290) / 10.0::DOUBLE + 0.03::DOUBLE AS lat, 70.0::DOUBLE + (c_custkey * 29 % 270) / 10.0::DOUBLE + 0.02::DOUBLE AS lon FROM customer),
 d AS (SELECT t_id, s_id, 2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(s.lat - t.lat) / 2), 2) + cos(radians(t.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - t.lon) / 2), 2)))) AS km FROM t, s), m AS (SELECT * FROM d WHERE km <= 50 QUALIFY row_number() OVER (PARTITION BY t_id ORDER BY km, s_id) = 1)
 SELECT t.t_id, coalesce(s_id, -1) AS s_id, round(km, 5) AS km FROM t LEFT JOIN m USING (t_id)""")
def jon_regrid(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k.alias("s_id"), (8.0 + (k * 37 % 280) / 10.0).alias("lat"), (70.0 + (k * 53 % 260) / 10.0).alias("lon"))
    k = F.col("c_custkey")
    t = table(spark, d, "customer").select(k.alias("t_id"), (8.0 + (k * 11 % 290) / 10.0 + 0.03).alias("lat"), (70.0 + (k * 29 % 270) / 10.0 + 0.02).alias("lon"))
    found = grid.apply_mapping(grid.nearest_mapping(t, s), t, s.select("s_id"))
    return found.select("t_id", F.coalesce("s_id", F.lit(-1)).alias("s_id"), r("km", 5).alias("km"))


@query("JON08", f"""WITH {S.FRAMES} SELECT k, i // 8 + 0.25::DOUBLE AS fy, i % 8 + 0.5::DOUBLE AS fx, round(CASE WHEN i // 8 < 7 AND i % 8 < 7 THEN 0.75::DOUBLE * (0.5::DOUBLE * bt[i + 1] + 0.5::DOUBLE * bt[i + 2]) + 0.25::DOUBLE * (0.5::DOUBLE * bt[i + 9] + 0.5::DOUBLE * bt[i + 10]) END, 6) AS bt FROM frames, {S.CELLS}""")
def jon_bilinear(spark, d):
    px = views.pixels(views.frames(spark, d).select("k", "bt"), "bt")
    wanted = px.select("k", (F.col("y") + 0.25).alias("fy"), (F.col("x") + 0.5).alias("fx"))
    return _rounded(grid.bilinear(px, wanted, ["k"]))


@query("SMP06 FLT04", f"""WITH {S.MASKED}, o AS (SELECT y0, x0, row_number() OVER (ORDER BY y0, x0) - 1 AS n FROM unnest([0, 3, 5]) a(y0), unnest([0, 3, 5]) b(x0))
 SELECT k, n::INT AS patch, y0, x0, round(avg(bt), 6) AS mean, round(count(bt) / 9.0::DOUBLE, 6) AS valid_fraction FROM px, o WHERE y BETWEEN y0 AND y0 + 2 AND x BETWEEN x0 AND x0 + 2 GROUP BY k, n, y0, x0""")
def smp_patches(spark, d):
    p = grid.patches(views.frames(spark, d, masked=True), ["k"], SIDE, 3, 3, drop_incomplete=False)
    known = F.filter("bt", lambda v: v.isNotNull())
    return p.select("k", "patch", "y0", "x0", r(F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known).cast("double"))).alias("mean"), r("valid_fraction").alias("valid_fraction"))


@query("SMP01 SMP02 SMP03 SMP04")
def smp_crops(spark, d):
    c = grid.random_crop(views.frames(spark, d, masked=True), ["k"], SIDE, 4, seed=7, min_valid=0.9)
    return c.select("k", "attempt", "y0", "x0", F.size("bt").alias("n"))


@query("TIL03 VIZ07", f"""WITH {S.PX} SELECT k, (y // 2 * 4 + x // 2)::INT AS i, round(avg(bt), 6) AS bt FROM px GROUP BY k, y // 2, x // 2""")
def til_downsample(spark, d):
    return views.frames(spark, d).select("k", F.posexplode(stencil.box_mean("bt", SIDE, 2)).alias("i", "bt")).select("k", "i", r("bt").alias("bt"))


def _ramp_sql(channel: int) -> str:
    cases = []
    for (a, ca), (b, cb) in zip(grid.IR_CLOUDS, grid.IR_CLOUDS[1:]):
        lo, hi = (int(c[1 + 2 * channel : 3 + 2 * channel], 16) for c in (ca, cb))
        cases.append(f"WHEN t <= {b} THEN round_even({lo} + ({hi - lo}) * (t - {a}) / {b - a}, 0)::INT")
    return "CASE " + " ".join(cases) + " ELSE 0 END"


@query("VIZ01 VIZ02 VIZ05 ARR04", f"""WITH {S.MASKED}, l AS (SELECT k, i, bt, 180.0::DOUBLE + greatest(0, least(255, floor((bt - 180.0::DOUBLE) / 140.0::DOUBLE * 256)::INT)) / 255.0::DOUBLE * 140.0::DOUBLE AS t FROM px)
 SELECT k, i::INT AS i, CASE WHEN bt IS NULL THEN 0 ELSE {_ramp_sql(0)} END AS r, CASE WHEN bt IS NULL THEN 0 ELSE {_ramp_sql(1)} END AS g, CASE WHEN bt IS NULL THEN 0 ELSE {_ramp_sql(2)} END AS b, CASE WHEN bt IS NULL THEN 0 ELSE 255 END AS a FROM l""")
def viz_rgba(spark, d):
    return views.frames(spark, d, masked=True).select("k", F.posexplode("bt").alias("i", "bt")).select("k", "i", grid.bt_to_rgba(F.col("bt")).alias("c")).select("k", "i", "c.*")


@query("TIL05", """SELECT c_custkey, trunc((c_acctbal / 100 - 20) * 1e7::DOUBLE)::BIGINT AS e7 FROM customer""")
def til_e7(spark, d):
    return table(spark, d, "customer").select("c_custkey", ((F.col("c_acctbal") / 100 - 20) * 1e7).cast("long").alias("e7"))


@query("SNK03 SNK06 SRT02", """SELECT vec_id AS k, vec_id // 128 AS shard, printf('shard-%06d.tar', vec_id // 128) AS name, printf('%08d', vec_id) AS key FROM embeddings""")
def snk_shards(spark, d):
    k = F.col("vec_id")
    placed = sequence.ordinals(table(spark, d, "embeddings").select("vec_id"), ["vec_id"], "n")
    shard = F.floor(F.col("n") / scalar.shard_length(64, 128, 1000))
    return placed.select(k.alias("k"), shard.alias("shard"), F.format_string("shard-%06d.tar", shard).alias("name"), F.format_string("%08d", k).alias("key"))


# --- manifests --------------------------------------------------------------------------------------------------------------

def _manifests(spark, d) -> DataFrame:
    k = F.col("k")
    frames = views.frames(spark, d).select(
        "label", k.cast("int").alias("index"), F.when(k % 7 == 0, "June").otherwise(text.iso_z("time")).alias("time"), F.when(k % 2 == 0, "observed").otherwise("interpolated").alias("kind"),
        F.when((k % 2 == 1) & (k % 5 > 0), 0.5).alias("t"), F.when(k % 2 == 1, F.array((k - 1).cast("int"), (k + 1).cast("int"))).alias("bracket"), F.lit("i").alias("image"), F.lit("h").alias("thumb"),
        text.tile_template(k).alias("tiles_url_template"), F.when(k % 11 == 0, "").otherwise("p").alias("pmtiles"), F.lit("n").alias("netcdf"))
    label = F.col("label")
    made = manifest.build(frames, ["label"])
    return made.select(
        "label", F.lit("1.0").alias("schema_version"), F.lit("s").alias("scene_id"), *[F.lit("x").alias(c) for c in ("title", "description", "satellite", "channel")], F.lit(10.8).alias("wavelength_um"),
        F.lit(30).alias("native_cadence_min"), F.lit(15).alias("interp_cadence_min"), F.when(label % 3 == 1, F.array(*map(F.lit, (98.0, 6.0, 68.0, 38.0)))).otherwise(F.array(*map(F.lit, (68.0, 6.0, 98.0, 38.0)))).alias("bbox"),
        F.lit("EPSG:4326").alias("crs"), F.array(F.lit(180.0), F.lit(320.0)).alias("value_range_k"), F.when(label % 4 != 3, "ir_clouds").alias("colormap"), F.lit(0).alias("min_zoom"), F.lit(2).alias("max_zoom"), F.lit(256).alias("tile_size"),
        "frames", F.create_map(F.lit("observed"), F.lit("o"), F.lit("interpolated"), F.lit("i"), F.lit("side_by_side"), F.lit("s")).alias("videos"),
        F.struct(F.when(label % 3 == 2, 150.0).otherwise(140.0).alias("data_range_k"), F.array(F.lit(180.0), F.lit(320.0)).alias("value_range_k"), F.array(F.struct(F.lit(1).alias("index"), F.lit(30.0).alias("psnr"))).alias("per_frame")).alias("metrics"),
        F.struct(F.array(F.struct(F.lit("M1").alias("method_id"), F.lit("run").alias("status"))).alias("methods_run")).alias("crossval"),
        F.create_map(F.lit("name"), F.lit("linear"), F.lit("version"), F.lit("1"), F.lit("params_m"), F.lit("0")).alias("model"), F.lit("2025-06-20T00:00:00Z").alias("generated_at"))


@query("VAL01 VAL02 VAL03 VAL04 VAL05 VAL06 VAL07 VAL08 VAL09 VAL10 VAL11 VAL12 VAL13 VAL14 SNK14 SET06", """WITH f AS (SELECT label, vec_id AS k FROM embeddings),
 p AS (SELECT label, k, 'frame ' || k || ': empty pmtiles' AS problem FROM f WHERE k % 11 = 0 UNION ALL SELECT label, k, 'frame ' || k || ': interpolated without t or bracket' FROM f WHERE k % 2 = 1 AND k % 5 = 0 UNION ALL SELECT label, k, 'frame ' || k || ': time is not ISO-8601 Z' FROM f WHERE k % 7 = 0
 UNION ALL SELECT DISTINCT label, -3, 'missing colormap' FROM f WHERE label % 4 = 3 UNION ALL SELECT DISTINCT label, -2, 'bbox west is not below east' FROM f WHERE label % 3 = 1 UNION ALL SELECT DISTINCT label, -1, 'data_range_k is not the span' FROM f WHERE label % 3 = 2)
 SELECT label, problem FROM p""")
def val_manifest(spark, d):
    return _manifests(spark, d).select("label", F.explode(manifest.problems()).alias("problem"))


@query("STR15 STR16 HLP03 SNK14", """SELECT label, count(*) AS n_frames, count(DISTINCT vec_id % 2) AS n_kinds FROM embeddings GROUP BY label""")
def val_json_round_trip(spark, d):
    own = _manifests(spark, d)
    back = own.select("label", F.to_json(F.struct(*own.columns)).alias("json")).select("label", F.from_json("json", manifest.MANIFEST_TYPE)["frames"].alias("frames"))
    kinds = F.array_distinct(F.transform("frames", lambda f: f["kind"]))
    return back.select("label", F.size("frames").cast("long").alias("n_frames"), F.size(kinds).cast("long").alias("n_kinds"))


# --- generators, streaming ------------------------------------------------------------------------------------------------------

@query("GEN01 GEN02 GEN03 GEN04 GEN05 GEN06")
def gen_cube(spark, d):
    """A synthetic sequence for each nation, which gives its seed and length."""
    scenes = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("scene"), F.col("n_nationkey").cast("long").alias("seed"), (3 + F.col("n_nationkey") % 7).cast("int").alias("n_frames"))
    return synth.cubes(scenes, side=48).groupBy("scene", "frame").agg(r(F.avg("bt"), 4).alias("mean"), F.count("bt").alias("n"), F.count("*").alias("cells"))


@query("STM02", f"""WITH {S.SERIES} SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start, event_type, count(*) AS n, round(avg(bt), 6) AS mean FROM series GROUP BY 1, 2""")
def stm_tumbling(spark, d):
    out = streaming.tumbling(views.series(spark, d), "30 minutes", ["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r("mean").alias("mean"))


@query("STM02-sliding", f"""WITH {S.SERIES}, w AS (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM series) SELECT start, count(*) AS n, round(avg(bt), 6) AS mean FROM w GROUP BY 1""")
def stm_sliding(spark, d):
    out = streaming.tumbling(views.series(spark, d), "1 hour", [], slide="30 minutes")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", r("mean").alias("mean"))


@query("STM05", f"""WITH {S.SERIES}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM series WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
 SELECT user_id, min(ts) AS start, count(*) AS n, round(avg(bt), 6) AS mean FROM s GROUP BY user_id, s""")
def stm_sessions(spark, d):
    out = streaming.sessions(views.series(spark, d), "6 hours", ["user_id"])
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", r("mean").alias("mean"))


# --- files, cache, samples, extensions -----------------------------------------------------------------------------------------

_ATTRS = {"source_frames": ["a", "b"], "t": 0.5, "model": "linear", "model_version": "1", "kind": "observed", "created": "2025-06-20T00:00:00Z"}


@query("SRC03 SRC05 SRC23 SRC24 SRC32 SNK01 SNK07 SNK08 SNK09 SNK10 SNK11 SNK12 SNK13", f"""WITH {S.MASKED} SELECT k, 8 AS n_rows, count(bt) AS n_valid, round(avg(bt::FLOAT::DOUBLE), 3) AS mean FROM px GROUP BY k""")
def snk_netcdf(spark, d):
    files = netcdf.encode_frames(views.frames(spark, d, masked=True), SIDE, (68.0, 6.0, 98.0, 38.0), _ATTRS)

    def read(batches):
        for batch in batches:
            found = [netcdf.frame_of(netcdf.load(c))[1] for c in batch["content"]]
            out = batch[["k"]].copy()
            out["n_rows"] = [f.shape[0] for f in found]
            out["n_valid"] = [int(np.isfinite(f).sum()) for f in found]
            out["mean"] = [float(np.nanmean(f.astype(np.float64))) for f in found]
            yield out
    return files.mapInPandas(read, "k long, n_rows int, n_valid long, mean double").withColumn("mean", r("mean", 3))


@query("SRC27 SRC28 SRC29 SRC30 SNK05", """SELECT vec_id AS k, unnest(['lat', 'lon', 'bt']) AS variable, unnest([64, 64, 256])::BIGINT AS length FROM embeddings""")
def src_references(spark, d):
    files = netcdf.encode_frames(views.frames(spark, d), SIDE, (68.0, 6.0, 98.0, 38.0), _ATTRS)

    def refer(batches):
        for batch in batches:
            rows = [(k, v, n) for k, c in zip(batch["k"], batch["content"]) for _, v, _, n in netcdf.virtual_reference(c, str(k))]
            yield pd.DataFrame(rows, columns=["k", "variable", "length"])
    return files.mapInPandas(refer, "k long, variable string, length long")


@query("SRC31 SNK06", """SELECT vec_id // 128 AS shard, printf('shard-%06d.tar', vec_id // 128) AS name, count(*) AS n FROM embeddings GROUP BY 1, 2""")
def snk_tar_shards(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.format_string("%08d", "vec_id").alias("key"), F.to_json(F.struct("label")).cast("binary").alias("body"))

    def back(batches):
        for batch in batches:
            out = batch[["shard", "name"]].copy()
            out["n"] = [len(images.read_tar(c)) for c in batch["content"]]
            yield out
    return images.write_shards(rows, 128).mapInPandas(back, "shard long, name string, n long")


@query("SNK17 VIZ03 VIZ04")
def snk_png(spark, d):
    colored = views.frames(spark, d, masked=True).select("k", F.transform("bt", lambda b: grid.bt_to_rgba(b)).alias("c"))
    return images.render(colored, SIDE).select("k", F.length("png").cast("long").alias("n_bytes"), F.sha2("png", 256).alias("sha256"))


@query("JON16", """SELECT CASE WHEN vec_id % 4 = 0 THEN 'hit' ELSE 'miss' END AS state, count(*) AS n FROM embeddings GROUP BY 1""")
def srv_cache(spark, d):
    want = table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), text.cache_key(F.col("vec_id").cast("string"), F.lit("png")).alias("key"))
    have = want.filter("k % 4 = 0").select("key")
    hits = want.join(have, "key", "left_semi").select(F.lit("hit").alias("state"))
    return hits.unionByName(want.join(have, "key", "left_anti").select(F.lit("miss").alias("state"))).groupBy("state").agg(F.count("*").alias("n"))


@query("TRN04 SCL08 FLT02 FLT08 HLP07", f"""WITH {S.MASKED} SELECT m.k, round(avg(coalesce((a.bt - 180) / 150.0::DOUBLE, 0.0)), 6) AS i0, round(avg(coalesce((m.bt - 180) / 150.0::DOUBLE, 0.0)), 6) AS it, round(avg(coalesce((b.bt - 180) / 150.0::DOUBLE, 0.0)), 6) AS i1,
 count(CASE WHEN a.bt IS NOT NULL AND m.bt IS NOT NULL AND b.bt IS NOT NULL THEN 1 END) AS n_valid FROM px m JOIN px a ON a.k = m.k - 1 AND a.i = m.i JOIN px b ON b.k = m.k + 1 AND b.i = m.i GROUP BY m.k""")
def trn_samples(spark, d):
    t = sequence.triplets(views.frames(spark, d, masked=True), ["bt"])
    mean = lambda c: r(F.aggregate(F.transform(c, lambda v: scalar.model_input(v)), F.lit(0.0), lambda a, v: a + v) / F.size(c))
    ok = F.filter(F.arrays_zip("bt_prev", "bt", "bt_next"), lambda s: s["bt_prev"].isNotNull() & s["bt"].isNotNull() & s["bt_next"].isNotNull())
    return t.select("k", mean("bt_prev").alias("i0"), mean("bt").alias("it"), mean("bt_next").alias("i1"), F.size(ok).cast("long").alias("n_valid"))


@query("AGG20", f"""WITH {S.PX}, {S.MIDDLE}, m AS (SELECT k, label, {S.rmse('pred', 'truth')} AS e FROM middle GROUP BY k, label) SELECT coalesce(label, -1) AS label, round(avg(e), 6) AS bt_rmse_k, count(*) AS n FROM m GROUP BY ROLLUP (label)""")
def m_strata(spark, d):
    found = crossval.per_triplet(views.frames(spark, d)).rollup("label").agg(r(F.avg("bt_rmse_k")).alias("bt_rmse_k"), F.count("*").alias("n"))
    return found.select(F.coalesce("label", F.lit(-1)).alias("label"), "bt_rmse_k", "n")


@query("EXT-FSS", f"""WITH {S.PX}, {S.MIDDLE}, b AS (SELECT k, y // 2 AS by, x // 2 AS bx, avg(CASE WHEN pred < 240 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p, avg(CASE WHEN truth < 240 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS g FROM middle GROUP BY 1, 2, 3)
 SELECT k, round(1 - sum(pow(p - g, 2)) / nullif(sum(p * p) + sum(g * g), 0.0), 6) AS fss FROM b GROUP BY k""")
def ext_fss(spark, d):
    cold = lambda c: F.transform(c, lambda v: F.when(v < 240, 1.0).otherwise(0.0))
    mid = crossval.middle(views.frames(spark, d)).select("k", cold("pred").alias("p"), cold("truth").alias("g"))
    mid = mid.select("k", F.arrays_zip(stencil.box_mean("p", SIDE, 2).alias("p"), stencil.box_mean("g", SIDE, 2).alias("g")).alias("s"))
    total = lambda of: F.aggregate("s", F.lit(0.0), lambda a, s: a + of(s["p"], s["g"]))
    return mid.select("k", r(1 - F.try_divide(total(lambda p, g: F.pow(p - g, 2.0)), total(lambda p, g: p * p + g * g))).alias("fss"))


@query("EXT-EPE", f"""WITH {S.PX} SELECT k, round(avg(sqrt(pow((bt - 250) / 10, 2) + pow((260 - bt) / 20, 2))), 6) AS epe FROM px GROUP BY k""")
def ext_epe(spark, d):
    px = views.frames(spark, d).select("k", F.explode("bt").alias("bt"))
    return px.groupBy("k").agg(r(F.avg(F.hypot((F.col("bt") - 250) / 10, (260 - F.col("bt")) / 20))).alias("epe"))


@query("AGG18", f"""WITH {S.SERIES} SELECT event_type, round(regr_slope(bt, user_id::DOUBLE), 8) AS slope, round(regr_intercept(bt, user_id::DOUBLE), 5) AS intercept, round(coalesce(avg(bt), 0), 6) AS fill FROM series GROUP BY event_type""")
def agg_calibration(spark, d):
    u = F.col("user_id").cast("double")
    return views.series(spark, d).groupBy("event_type").agg(r(F.regr_slope("bt", u), 8).alias("slope"), r(F.regr_intercept("bt", u), 5).alias("intercept"), r(F.coalesce(F.avg("bt"), F.lit(0.0))).alias("fill"))


from cadenza.plans import block_queries, file_queries, format_queries, media_queries, sensor_queries, small_queries, stream_queries  # noqa: E402,F401 - they add theirs
