"""Jobs from files to files: densified sequences, scenes and reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import text
from cadenza.operators import crossval, grid, manifest, metrics, sequence, stencil
from cadenza.sources import images, netcdf, plots, tiles
from cadenza.sources.folders import get, put, put_parts, store, stored

#: Frames of a scene whose images share folders, which one task writes: tasks that write into one folder wait for each other.
GROUP = 256


def now_iso_z() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def interpolate_frames(frames: DataFrame, folder: str, side: int, bbox: tuple[float, float, float, float], factor: int, model: str = "linear") -> DataFrame:
    """Densifies frames (k, time, bt) and writes one NetCDF file for each frame of the result: k, path, n_bytes.

    Every file says which frames it is made of, its t, kind and model."""
    last = frames.agg(F.max("k")).first()[0]
    dense = sequence.densify_direct(frames, factor, last if last is not None else 0)
    own = F.struct(
        F.to_json(F.coalesce("bracket_obs", F.array(F.floor(F.col("frame") / sequence.subdivisions(factor)).cast("long")))).alias("source_frames"), "t", F.lit(model).alias("model"), F.lit("1").alias("model_version"), "kind",
        F.lit(now_iso_z()).alias("created"))
    encoded = netcdf.encode_frames(dense.select(F.col("frame").alias("k"), "time", "bt", F.to_json(own, {"ignoreNullFields": "false"}).alias("attrs")), side, bbox, {})
    return netcdf.write_frames(encoded, folder)


def interpolate_files(spark: SparkSession, source: str, folder: str, side: int, bbox: tuple[float, float, float, float], factor: int, model: str = "linear") -> DataFrame:
    """interpolate_frames() of the NetCDF files under `source`, in order of their time."""
    read = netcdf.read_frames(spark, source).select(F.try_to_timestamp(F.col("attrs")["time"]).cast("timestamp_ntz").alias("time"), "path", "bt")
    placed = sequence.ordinals(read, ["time", "path"], "k")
    return interpolate_frames(placed.select("k", "time", "bt"), folder, side, bbox, factor, model)


def build_scene(spark: SparkSession, frames: DataFrame, folder: str, side: int, bbox: tuple[float, float, float, float], scene_id: str, factor: int = 2, tile: int = 4, merge: dict | None = None, methods: list[str] | None = None) -> dict:
    """Builds a scene of frames (k, label, time, bt): densified frames as NetCDF, images, thumbnails and tiles, quality of the
    middles by frame, values of the `methods`, and the manifest, which is checked before it is written but for its frames:
    densify_direct() gives t and bracket to all that are interpolated. Returns the manifest without the frames and their metrics,
    which are in its file only; read_scene() reads them.

    `merge` overlays the manifest's metrics, crossval and model as far as the result is still valid. Tasks write the files and the
    manifest's entries. GROUP frames share the folders of their images and of each tile: folders of each frame would be six more inodes a frame."""
    last = frames.agg(F.max("k")).first()[0] or 0
    dense = sequence.densify_direct(frames, factor, last)
    interpolate_frames(frames, f"{folder}/nc", side, bbox, factor).write.format("noop").mode("overwrite").save()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # files take time by their number, while Spark cuts tasks by bytes
    color = tiles.colored(dense.select(F.col("frame").alias("k"), "bt").repartition(tasks, F.floor(F.col("k") / GROUP)), lambda b: grid.bt_to_rgba(b))

    def write(ks: list[int], stack: np.ndarray):
        files, base = store(folder)
        for k, image in zip(ks, stack):
            name = f"{k // GROUP:05d}/{k:06d}.png"
            put(files, f"{base}/frames/{name}", images.png(image))
            put(files, f"{base}/thumbs/{name}", images.png(tiles.thumbnail(image, max(1, side // 2))))
            for z, x, y, part in tiles.pyramid(image, tile, 0, grid.default_max_zoom(side, side, tile)):
                put(files, f"{base}/tiles/{k // GROUP:05d}/{z}/{x}/{y}/{k:06d}.png", images.png(part))
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64())], names=["k"])

    images.mapped(color, side, write, "k long").write.format("noop").mode("overwrite").save()

    def entry(r: dict) -> dict:
        group, name = f"{r['index'] // GROUP:05d}", f"{r['index']:06d}"
        return {**r, "image": f"frames/{group}/{name}.png", "thumb": f"thumbs/{group}/{name}.png", "tiles_url_template": f"tiles/{group}/{{z}}/{{x}}/{{y}}/{name}.png", "pmtiles": None, "netcdf": f"nc/{name}.nc"}

    finite = lambda v: None if v is None or v != v or abs(v) == float("inf") else v
    each = stored(crossval.per_triplet(frames).select((F.col("k") * sequence.subdivisions(factor)).alias("index"), "psnr", "bt_rmse_k"), "scores")
    _write_entries(dense.select(F.col("frame").alias("index"), text.iso_z("time").alias("time"), "kind", "t", F.col("bracket_frame").alias("bracket")), entry, f"{folder}/_frames")
    _write_entries(each, lambda r: {n: finite(v) for n, v in r.items()}, f"{folder}/_scores")
    ran = [{"method_id": x["method_id"], "metric": x["metric"], "value": x["value"]} for name in methods or [] for x in crossval.run_method(frames, name, side).collect()]
    quality = metrics.summarize(metrics.long_metrics(each, [], ["psnr", "bt_rmse_k"]), ["metric"]).collect()
    own = {
        "schema_version": "1.0", "scene_id": scene_id, "title": scene_id, "description": "", "satellite": "synthetic", "channel": "IR", "wavelength_um": 10.8, "native_cadence_min": 30, "interp_cadence_min": 30 // sequence.subdivisions(factor),
        "bbox": list(bbox), "crs": "EPSG:4326", "value_range_k": [metrics.VMIN_K, metrics.VMAX_K], "colormap": "ir_clouds", "min_zoom": 0, "max_zoom": grid.default_max_zoom(side, side, tile), "tile_size": tile,
        "frames": [],
        "videos": {"observed": None, "interpolated": None, "side_by_side": None},
        "metrics": {"data_range_k": metrics.SPAN_K, "value_range_k": [metrics.VMIN_K, metrics.VMAX_K], "per_frame": [], "summary": {r["metric"]: r["mean"] for r in quality}},
        "crossval": {"methods_run": ran}, "model": {"name": "linear", "version": "1", "params_m": "0"}, "generated_at": now_iso_z(),
    }
    document = merged(own, merge or {})
    pieces, rest = [], json.dumps(document)
    # Both empty lists are the first of their names; per_frame is its own unless the overlay has one.
    for name, entries in [("frames", "_frames")] + [("per_frame", "_scores")] * (document["metrics"]["per_frame"] is own["metrics"]["per_frame"]):
        before, rest = rest.split(f'"{name}": []', 1)
        pieces += [f'{before}"{name}": [\n'.encode(), entries]
        rest = "]" + rest
    _join_entries(spark, folder, [*pieces, rest.encode() + b"\n"])
    files, base = store(folder)
    for name in ("_frames", "_scores"):
        files.delete_dir(f"{base}/{name}")
    return document


def _write_entries(rows: DataFrame, of: Callable[[dict], dict], folder: str) -> None:
    """The JSON of each row, in order of its index, as lines that begin with the comma after the line before: parts in order of their names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(["," + json.dumps(of(r)) for r in batch.to_pylist()], pa.string())], names=["value"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(tasks, "index").sortWithinPartitions("index").mapInArrow(run, "value string").write.mode("overwrite").text(folder)


def _join_entries(spark: SparkSession, folder: str, pieces: list[bytes | str]) -> None:
    """manifest.json of texts and of the folders of _write_entries(): a task copies its parts, one block at a time."""
    def blocks(files: fs.FileSystem, inner: str) -> Iterator[bytes]:
        first = True
        for info in sorted(files.get_file_info(fs.FileSelector(inner)), key=lambda i: i.path):
            if info.base_name.startswith("part-"):
                with files.open_input_stream(info.path) as f:
                    while block := f.read(1 << 22):
                        yield b" " + block[1:] if first else block
                        first = False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                files, base = store(folder)
                put_parts(files, f"{base}/manifest.json", (block for p in pieces for block in ((p,) if isinstance(p, bytes) else blocks(files, f"{base}/{p}"))))
            yield batch

    spark.range(0, 1, 1, 1).mapInArrow(run, "id long").write.format("noop").mode("overwrite").save()


def read_scene(spark: SparkSession, folder: str) -> dict:
    """The manifest of build_scene() with its frames as rows of FRAME_TYPE and without their metrics: tasks read its lines, the driver
    gets those that are no entry of a frame."""
    lines = spark.read.text(f"{folder}/manifest.json").select("value", F.col("_metadata.file_block_start").alias("at"))
    of_frame = F.col("value").rlike(r"^[ ,]\{")
    document = json.loads("".join(r["value"] for r in sorted(lines.filter(~of_frame).collect(), key=lambda r: r["at"])))
    found = lines.filter(of_frame).select(F.from_json(F.expr("substring(value, 2)"), manifest.FRAME_TYPE).alias("f")).filter("f.kind is not null")
    return {**document, "frames": found.select("f.*")}


def scene_files(spark: SparkSession, folder: str, document: dict, tile_places: list[tuple[int, int, int]]) -> DataFrame:
    """Of each frame of a manifest (as document, or as read_scene() gives it) its kind and how many of its files are there: n_images,
    n_thumbs, n_tiles (of the places z, x, y) and n_netcdf. Tasks look for the files of their frames; nothing lists the folder."""
    names, frames = ["kind", "image", "thumb", "tiles_url_template", "netcdf"], document["frames"]
    if not isinstance(frames, DataFrame):
        frames = spark.createDataFrame(pa.table({n: pa.array([f[n] for f in frames], pa.string()) for n in names}), ", ".join(f"{n} string" for n in names))

    def look(batches):
        files, base = store(folder)
        for batch in batches:
            there = lambda paths: [i.type == fs.FileType.File for i in files.get_file_info([f"{base}/{p}" for p in paths])]
            found = {n: np.array(there(batch[n].to_pylist()), np.int64) for n in ("image", "thumb", "netcdf")}
            tiles_ = [t.format(z=z, x=x, y=y) for t in batch["tiles_url_template"].to_pylist() for z, x, y in tile_places]
            n_tiles = np.array(there(tiles_), np.int64).reshape(batch.num_rows, len(tile_places)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch["kind"], *map(pa.array, (found["image"], found["thumb"], n_tiles, found["netcdf"]))], names=["kind", "n_images", "n_thumbs", "n_tiles", "n_netcdf"])

    dealt = frames.select(*names).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(look, "kind string, n_images long, n_thumbs long, n_tiles long, n_netcdf long")


def valid(document: dict) -> bool:
    """What a viewer needs: bounds and ranges in order, whole metrics, and interpolated frames with t and bracket."""
    west, south, east, north = document["bbox"]
    low, high = document["value_range_k"]
    m = document["metrics"]
    frames = all(f["kind"] == "observed" or f["t"] is not None and f["bracket"] for f in document["frames"])
    return west < east and south < north and low < high and m.get("data_range_k") == high - low and "per_frame" in m and "methods_run" in document["crossval"] and frames


def merged(document: dict, other: dict) -> dict:
    """The document with metrics, crossval and model of the other over its own, the range fixed; itself where that is not valid."""
    out = {**document, **{k: {**document[k], **other[k]} for k in ("metrics", "crossval", "model") if isinstance(other.get(k), dict)}}
    out["metrics"] = {**out["metrics"], "data_range_k": metrics.SPAN_K, "value_range_k": [metrics.VMIN_K, metrics.VMAX_K]}
    return out if valid(out) else document


def load_json(folder: str, name: str) -> dict:
    """A JSON document of a folder; empty where it is missing or broken."""
    try:
        files, base = store(folder)
        return json.loads(get(files, f"{base}/{name}"))
    except (OSError, ValueError):
        return {}


def save_stats(folder: str, dataset: str, record: dict) -> dict:
    """norm_stats.json with the record of a data set put in place of its former one."""
    files, base = store(folder)
    out = {**load_json(folder, "norm_stats.json"), dataset: record}
    put(files, f"{base}/norm_stats.json", json.dumps(out, sort_keys=True).encode())
    return out


def make_report(frames: DataFrame, folder: str, methods: list[str], side: int) -> DataFrame:
    """Runs the methods and writes their rows as JSON lines under `folder`, which it reads back: method_id, metric, value."""
    out = None
    for name in methods:
        rows = crossval.run_method(frames, name, side).select("method_id", "metric", F.col("value").cast("double").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    out.write.mode("overwrite").json(folder)
    return frames.sparkSession.read.schema("method_id string, metric string, value double").json(folder)


def full_report(frames: DataFrame, folder: str, methods: list[str], side: int) -> dict:
    """A report with its document: per-frame metrics as a table, a summary of the blend and of persistence, the methods' values, a
    histogram and a course of each metric as SVG, and RESULTS.md. Returns the summary, which is report.json, too.

    The driver gets sums, bins and the methods' values; per-frame rows stay in <folder>/per_frame."""
    names = ["psnr", "bt_rmse_k", "bt_bias_k", "mae"]
    files, base = store(folder)
    each = crossval.per_triplet(frames)
    each.select("k", *names).write.mode("overwrite").parquet(f"{folder}/per_frame")
    rows = frames.sparkSession.read.parquet(f"{folder}/per_frame")
    long = metrics.long_metrics(rows, ["k"], names)
    summary = {r["metric"]: {"mean": r["mean"], "n": r["n_finite"]} for r in metrics.summarize(long, ["metric"]).collect()}
    before = metrics.array_metrics(crossval.middle(frames).select("k", F.col("bt_prev").alias("pred"), "truth"), ["k"])
    persistence = {r["metric"]: {"mean": r["mean"], "n": r["n_finite"]} for r in metrics.summarize(metrics.long_metrics(before, [], names), ["metric"]).collect()}
    values: dict[str, dict[str, float]] = {}
    for r in make_report(frames, f"{folder}/methods", methods, side).collect():
        values.setdefault(r["method_id"], {})[r["metric"]] = r["value"]
    n_frames = rows.agg(F.max("k")).first()[0]
    figures = {}
    for kind, found, draw in (("histogram", plots.histogram(long), plots.draw_histogram), ("course", plots.course(long, (n_frames or 0) + 1), plots.draw_course)):
        by: dict[str, list[dict]] = {}
        for r in found.collect():  # BINS or STEPS rows a metric at most
            by.setdefault(r["metric"], []).append(r.asDict())
        for metric, own in by.items():
            figures[f"{kind}_{metric}"] = f"{kind}_{metric}.svg"
            put(files, f"{base}/{kind}_{metric}.svg", draw(metric, own).encode())
    document = {
        "metrics": {"data_range_k": metrics.SPAN_K, "value_range_k": [metrics.VMIN_K, metrics.VMAX_K], "per_frame": "per_frame", "summary": summary, "baselines": {"persistence": persistence}},
        "crossval": {"methods_run": [{"method_id": m, "values": v} for m, v in sorted(values.items())]}, "figures": figures,
    }
    put(files, f"{base}/report.json", json.dumps(document).encode())
    put(files, f"{base}/RESULTS.md", _results(document).encode())
    return document


def _results(document: dict) -> str:
    """The report as a document of tables and figures."""
    shown = lambda v: "" if v is None else f"{v:.4f}"
    own, base = document["metrics"]["summary"], document["metrics"]["baselines"]["persistence"]
    lines = ["# Results", "", "| metric | blend | persistence | frames |", "| --- | --- | --- | --- |"]
    lines += [f"| {m} | {shown(v['mean'])} | {shown(base.get(m, {}).get('mean'))} | {v['n']} |" for m, v in sorted(own.items())]
    lines += ["", "| method | metric | value |", "| --- | --- | --- |"]
    lines += [f"| {x['method_id']} | {m} | {shown(v)} |" for x in document["crossval"]["methods_run"] for m, v in sorted(x["values"].items())]
    lines += ["", *[f"![{name}]({path})" for name, path in sorted(document["figures"].items())], ""]
    return "\n".join(lines)


def flow_files(framed: DataFrame, folder: str, side: int, step: int, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Overlay vectors of frames (k, u, v) as one JSON file a frame: k, path, n."""
    west, south, east, north = bbox
    vectors = stencil.flow_overlay(stencil.flow_vectors(framed, ["k"], side, step), side, west, south, east, north)
    rows = vectors.groupBy("k").agg(F.to_json(F.array_sort(F.collect_list(F.struct("y", "x", "lon0", "lat0", "lon1", "lat1")))).alias("body"), F.count("*").alias("n"))

    def write(batches):
        files, base = store(folder)
        for batch in batches:
            paths = [f"{base}/flow/{k:06d}.json" for k in batch["k"]]
            for path, body in zip(paths, batch["body"]):
                put(files, path, body.encode())
            yield batch[["k", "n"]].assign(path=paths)

    return rows.mapInPandas(write, "k long, n long, path string")


__all__ = ["build_scene", "flow_files", "full_report", "interpolate_files", "interpolate_frames", "load_json", "make_report", "manifest", "merged", "read_scene", "save_stats", "scene_files", "valid"]
