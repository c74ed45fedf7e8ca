"""Queries on videos, image pyramids and plots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import blocks, crossval, grid, lanczos
from cadenza.plans import jobs
from cadenza.plans import sql as S
from cadenza.plans.registry import query, r
from cadenza.sources import folders, jpeg, plots, views
from cadenza.sources.views import SIDE


def _rgb(column: str):
    """Three arrays of bytes of a frame's colours."""
    color = F.transform(column, lambda b: grid.bt_to_rgba(b))
    channel = lambda n: F.transform(color, lambda c: c[n]).alias(f"{column}_{n}")
    return [channel(n) for n in "rgb"]


def _images(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Frames (n, rows, columns, 3) of the columns that _rgb() made."""
    planes = [batch[f"{column}_{n}"].flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(-1, SIDE, SIDE) for n in "rgb"]
    return np.stack(planes, axis=-1)


@query("SNK20 SNK21 VIZ06 HLP12", """SELECT label, count(*) AS n_frames, 8 AS n_rows, 16 AS n_cols, TRUE AS near FROM embeddings WHERE vec_id > (SELECT min(vec_id) FROM embeddings) AND vec_id < (SELECT max(vec_id) FROM embeddings) GROUP BY label""")
def snk_video(spark, d):
    """A video for each label, the predicted beside the true frame; read back, each frame within 40 dB of what was drawn."""
    folder = folders.shared(spark, "videos")
    mid = crossval.middle(views.frames(spark, d, masked=True)).select("label", "k", *_rgb("pred"), *_rgb("truth"))

    def pairs(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([_images(batch, "pred"), _images(batch, "truth")], axis=2)

    def encode(batches):
        for batch in batches:
            images = pairs(batch)
            yield pa.RecordBatch.from_arrays([batch["label"].cast(pa.string()), batch["k"], pa.array([jpeg.encode(i, 100) for i in images], pa.binary())], names=["video", "k", "jpeg"])

    jpeg.encode_video(mid.mapInArrow(encode, "video string, k long, jpeg binary"), folder)

    def read(batches):
        files, _ = folders.store(folder)
        for batch in batches:
            for path in batch["path"].to_pylist():
                for n, raw in enumerate(jpeg.read_avi(folders.get(files, path))):
                    yield pa.RecordBatch.from_pylist([{"label": int(path.rsplit("/", 1)[-1].split("-")[0]), "n": n, "pixels": jpeg.decode(raw).tobytes(), "n_rows": jpeg.size_of(raw)[0], "n_cols": jpeg.size_of(raw)[1]}], schema)

    schema = pa.schema([("label", pa.int32()), ("n", pa.int32()), ("pixels", pa.binary()), ("n_rows", pa.int32()), ("n_cols", pa.int32())])
    shown = spark.read.parquet(f"{folder}/_files").select("path").mapInArrow(read, "label int, n int, pixels binary, n_rows int, n_cols int")

    def drawn(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["label"], batch["k"], pa.array([i.tobytes() for i in pairs(batch)], pa.binary())], names=["o_label", "k", "own"])

    own = mid.mapInArrow(drawn, "o_label int, k long, own binary").withColumn("o_n", F.row_number().over(Window.partitionBy("o_label").orderBy("k")) - 1)

    @F.arrow_udf("double")
    def psnr(a: pa.Array, b: pa.Array) -> pa.Array:
        error = [np.mean((np.frombuffer(x, np.uint8).astype(float) - np.frombuffer(y, np.uint8)) ** 2) for x, y in zip(a.to_pylist(), b.to_pylist())]
        return pa.array([10 * np.log10(255**2 / max(e, 1e-9)) for e in error], pa.float64())

    both = shown.join(own, (F.col("label") == F.col("o_label")) & (F.col("n") == F.col("o_n")))
    return both.groupBy("label").agg(F.count("*").alias("n_frames"), F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"), (F.min(psnr("pixels", "own")) >= 40).alias("near"))


_TAP = lambda x: f"CASE WHEN abs({x}) < 3 THEN sin(pi() * {x}) / (pi() * {x}) * sin(pi() * {x} / 3) / (pi() * {x} / 3) ELSE 0 END"


@query("TIL03 HLP12", f"""WITH {S.MASKED}, o AS (SELECT y::INT AS oy, x::INT AS ox FROM unnest(range(0, 4)) a(y), unnest(range(0, 4)) b(x)),
 w AS (SELECT k, oy, ox, bt, {_TAP('((y - 2 * oy - 0.5::DOUBLE) / 2)')} * {_TAP('((x - 2 * ox - 0.5::DOUBLE) / 2)')} AS w FROM px, o),
 s AS (SELECT k, oy, ox, sum(w * bt) AS total, sum(CASE WHEN bt IS NOT NULL THEN w ELSE 0 END) AS known, sum(w) AS every FROM w GROUP BY k, oy, ox)
 SELECT k, oy AS y, ox AS x, round(CASE WHEN known / every > 1 / 510.0::DOUBLE THEN total / known END, 5) AS bt, round(CASE WHEN known / every > 1 / 510.0::DOUBLE THEN known / every ELSE 0 END, 6) AS alpha FROM s""")
def til_lanczos(spark, d):
    """The next level of masked frames in blocks by a windowed sinc; missing pixels have no weight."""
    whole = blocks.Grid(SIDE, SIDE, 4)
    found, small = lanczos.halved(blocks.from_frames(views.frames(spark, d, masked=True), ["k"], ["bt"], whole), ["k"], "bt", whole)
    px = blocks.pixels(found, ["k"], ["bt", "alpha"], small)
    return px.select("k", "y", "x", r("bt", 5).alias("bt"), r("alpha").alias("alpha"))


@query("SNK22 SNK23 ORC05", f"""WITH {S.PX}, {S.MIDDLE}, m AS (SELECT k, {S.pixel_metrics()} FROM middle GROUP BY k), e AS (SELECT k, {S.rmse('pred', 'truth')} AS v FROM middle GROUP BY k),
 b AS (SELECT least(23, floor((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 24)::INT) AS bin FROM e) SELECT 'bt_rmse_k' AS metric, bin, count(*) AS n FROM b GROUP BY bin""")
def orc_plots(spark, d):
    """The histogram of a whole report, as its picture shows it."""
    folder = folders.shared(spark, "report")
    document = jobs.full_report(views.frames(spark, d), folder, ["M1", "M18", "M19"], SIDE)
    files, base = folders.store(folder)
    svg = folders.get(files, f"{base}/{document['figures']['histogram_bt_rmse_k']}").decode()
    return spark.createDataFrame([("bt_rmse_k", b, n) for b, n in plots.counts_of(svg).items()], "metric string, bin int, n long")
