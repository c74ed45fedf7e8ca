"""Scene manifests: building, and validation as one list of problems per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import ISO_Z

# Names that a manifest must have.
REQUIRED = [
    "schema_version", "scene_id", "title", "description", "satellite", "channel", "wavelength_um", "native_cadence_min", "interp_cadence_min", "bbox", "crs",
    "value_range_k", "colormap", "min_zoom", "max_zoom", "tile_size", "frames", "videos", "metrics", "crossval", "model", "generated_at",
]
FRAME_KEYS = ["index", "time", "kind", "image", "thumb", "tiles_url_template", "pmtiles", "netcdf"]
VIDEO_KEYS = ["observed", "interpolated", "side_by_side"]
MODEL_KEYS = ["name", "version", "params_m"]

FRAME_TYPE = "index int, time string, kind string, t double, bracket array<int>, image string, thumb string, tiles_url_template string, pmtiles string, netcdf string"
MANIFEST_TYPE = (
    "schema_version string, scene_id string, title string, description string, satellite string, channel string, wavelength_um double, native_cadence_min int, "
    "interp_cadence_min int, bbox array<double>, crs string, value_range_k array<double>, colormap string, min_zoom int, max_zoom int, tile_size int, "
    f"frames array<struct<{', '.join(': '.join(f.split(' ')) for f in FRAME_TYPE.split(', '))}>>, videos map<string,string>, "
    "metrics struct<data_range_k: double, value_range_k: array<double>, per_frame: array<struct<index: int, psnr: double>>>, "
    "crossval struct<methods_run: array<struct<method_id: string, status: string>>>, model map<string,string>, generated_at string"
)


def _when(bad: Column, problem: str) -> Column:
    return F.when(bad, F.lit(problem))


def _has(item: Column, key: str) -> Column:
    return item[key].isNotNull()


def problems(profile: str = "full") -> Column:
    """All problems of a manifest row (columns of MANIFEST_TYPE), empty if valid.

    The web profile does not look at tile templates and asks for at least one frame."""
    span = F.get("value_range_k", F.lit(1)) - F.get("value_range_k", F.lit(0))
    bbox = [F.get("bbox", F.lit(n)) for n in range(4)]
    four, two = F.size("bbox") == 4, F.size("value_range_k") == 2
    out = [_when(F.col(c).isNull(), f"missing {c}") for c in REQUIRED]
    out += [
        _when(F.col("bbox").isNotNull() & ~four, "bbox needs four numbers"), _when(four & ~(bbox[0] < bbox[2]), "bbox west is not below east"),
        _when(four & ~(bbox[1] < bbox[3]), "bbox south is not below north"),
        _when(F.col("value_range_k").isNotNull() & ~two, "value_range_k needs two numbers"), _when(two & ~(span > 0), "value_range_k does not increase"),
        _when(F.col("min_zoom") > F.col("max_zoom"), "min_zoom is above max_zoom"),
        _when(F.col("metrics").isNotNull() & F.col("metrics.data_range_k").isNull(), "metrics without data_range_k"),
        _when(F.col("metrics.data_range_k") <= 0, "data_range_k is not positive"),
        _when(two & (F.abs(F.col("metrics.data_range_k") - span) > 1e-6), "data_range_k is not the span"),
        _when(F.col("metrics").isNotNull() & F.col("metrics.value_range_k").isNull(), "metrics without value_range_k"),
        _when(F.col("metrics").isNotNull() & F.col("metrics.per_frame").isNull(), "metrics without per_frame"),
        _when(F.col("crossval").isNotNull() & F.col("crossval.methods_run").isNull(), "crossval without methods_run"),
    ]
    out += [_when(F.col("videos").isNotNull() & ~F.map_contains_key("videos", k), f"videos without {k}") for k in VIDEO_KEYS]
    out += [_when(F.col("model").isNotNull() & ~F.map_contains_key("model", k), f"model without {k}") for k in MODEL_KEYS]
    if profile == "web":
        out.append(_when(F.size("frames") == 0, "no frames"))

    def of_frame(f: Column) -> Column:
        name = lambda text: F.concat(F.lit("frame "), F.coalesce(f["index"].cast("string"), F.lit("?")), F.lit(": " + text))
        rules = [F.when(f[k].isNull(), name(f"missing {k}")) for k in (FRAME_KEYS if profile == "full" else FRAME_KEYS[:3])]
        if profile == "full":
            template = f["tiles_url_template"]
            rules += [F.when(template.isNotNull() & ~(template.contains("{z}") & template.contains("{x}") & template.contains("{y}")), name("template without z, x, y")), F.when(f["pmtiles"] == "", name("empty pmtiles"))]
        made = f["kind"] == "interpolated"
        rules += [F.when(~f["kind"].isin("observed", "interpolated"), name("unknown kind")), F.when(made & (f["t"].isNull() | f["bracket"].isNull()), name("interpolated without t or bracket")), F.when(~f["time"].rlike(ISO_Z), name("time is not ISO-8601 Z"))]
        return F.array_compact(F.array(*rules))

    frames = F.flatten(F.transform(F.coalesce("frames", F.array().cast(f"array<struct<{', '.join(': '.join(f.split(' ')) for f in FRAME_TYPE.split(', '))}>>")), of_frame))
    return F.concat(F.array_compact(F.array(*out)), frames)


def require_valid(manifests: DataFrame, profile: str = "full") -> DataFrame:
    """The manifests; an invalid one stops the query with its problems."""
    found = problems(profile)
    ok = F.when(F.size(found) == 0, F.lit(True)).otherwise(F.raise_error(F.array_join(found, "; ")).cast("boolean"))
    return manifests.filter(ok)


def build(frames: DataFrame, by: list[str], **constants) -> DataFrame:
    """Frames (columns of FRAME_TYPE) of each scene as one ordered array, with constants as further columns."""
    one = F.struct(*[F.col(f.split(" ")[0]) for f in FRAME_TYPE.split(", ")])
    out = frames.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("frames"))
    for name, value in constants.items():
        out = out.withColumn(name, value if isinstance(value, Column) else F.lit(value))
    return out


def to_json(manifests: DataFrame) -> DataFrame:
    return manifests.select(F.to_json(F.struct(*manifests.columns)).alias("json"))


def from_json(texts: DataFrame) -> DataFrame:
    return texts.select(F.from_json("json", MANIFEST_TYPE).alias("m")).select("m.*")
