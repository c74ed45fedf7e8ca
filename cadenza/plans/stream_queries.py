"""Queries on streams of arriving files and of frames in any order."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.plans import format_queries
from cadenza.plans import sql as S
from cadenza.plans.file_queries import _mean_of_known, _n_known
from cadenza.plans.registry import query, r
from cadenza.sources import folders, satellite, views
from cadenza.streaming import pairing


@query("STM03 STM06", f"""WITH {S.SERIES}, p AS (SELECT user_id, ts, bt, lag(ts) OVER w AS before, lag(bt) OVER w AS was FROM series WINDOW w AS (PARTITION BY user_id ORDER BY ts, bt))
 SELECT user_id, count(*) AS observed, count(before) AS interpolated, round(sum(0.5::DOUBLE * bt + 0.5::DOUBLE * was), 4) AS total FROM p GROUP BY user_id""")
def stm_inserted(spark, d):
    """Frames that come in no order of time, in several batches: what holds of the log at last is what the batch gives."""
    source, out = folders.shared(spark, "arriving"), folders.shared(spark, "inserted")
    series = views.series(spark, d).select(F.col("user_id").cast("string").alias("scene"), "ts", "bt")
    series.repartition(3, F.xxhash64("ts")).write.parquet(source)
    stream = spark.readStream.schema("scene string, ts timestamp_ntz, bt double").option("maxFilesPerTrigger", 1).parquet(source)
    log = pairing.insert_frames(stream, late_seconds=400 * 86_400, idle_seconds=86_400)
    log.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    got = pairing.settled(spark.read.schema(pairing.LOG).parquet(out))
    made = F.col("kind") == "interpolated"
    return got.groupBy(F.col("scene").cast("long").alias("user_id")).agg(F.count_if(F.col("kind") == "observed").alias("observed"), F.count_if(made).alias("interpolated"), r(F.sum(F.when(made, F.col("bt"))), 4).alias("total"))


@query("SRC02 STM02 STM06", f"WITH {format_queries._HDF5_SQL} SELECT time, source, count(v) AS n_valid, round(avg(v), 8) AS mean FROM cells GROUP BY time, source")
def stm_files(spark, d):
    """Sensor files that arrive in a folder, read by a stream of several batches that is stopped and goes on: every frame once."""
    folder, out = folders.shared(spark, "arriving"), folders.shared(spark, "frames")
    satellite.register(spark)
    for odd in (1, 0):  # the later half of each pair of frames comes first
        format_queries._write(spark, d, folder, lambda k, time, bt, odd=odd: format_queries._hdf5(k, time, bt) if k % 2 == odd else ())
        stream = spark.readStream.format("cadenza_frames").option("path", folder).option("settle", 0).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(satellite.SCHEMA).parquet(out)
    return got.select("time", "source", _n_known("bt").alias("n_valid"), r(_mean_of_known("bt"), 8).alias("mean"))
