"""Strings, times and names of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: ISO-8601 with Z and an optional fraction.
ISO_Z = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
# Source names by the first rule that matches a lower-cased path, and by alias.
SOURCE_MARKS = [
    ("GOES-19", ["goes19", "noaa-goes19", "_g19_"]), ("GOES-18", ["goes18", "noaa-goes18", "_g18_"]),
    ("Himawari-9", ["himawari", "hs_h09", "_h09_", "ahi"]), ("GK-2A", ["gk2a", "gk-2a", "ami", "ir105"]),
    ("INSAT-3DR", ["3dr", "insat-3dr", "3rimg"]), ("INSAT-3DS", ["insat", "3ds", "3simg"]),
]
SOURCE_ALIASES = {
    "GOES-19": ["goes-19", "goes19", "goes", "g19"], "GOES-18": ["goes-18", "goes18", "g18"],
    "Himawari-9": ["himawari-9", "himawari9", "himawari", "h09", "ahi"], "GK-2A": ["gk-2a", "gk2a", "ami"],
    "INSAT-3DS": ["insat-3ds", "insat3ds", "insat", "3ds"], "INSAT-3DR": ["insat-3dr", "insat3dr", "3dr"],
}
_MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def infer_source(url: Column, strict: bool = False) -> Column:
    """Source by ordered substrings; NULL, or an error if strict, where none matches."""
    u = F.lower(url)
    out = None
    for name, marks in SOURCE_MARKS:
        hit = F.lit(False)
        for mark in marks:
            hit = hit | u.contains(mark)
        if name == "INSAT-3DS":
            hit = hit | u.endswith(".h5")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown source: "), url)).cast("string")) if strict else out


def source_key(name: Column) -> Column:
    """Canonical source of an alias, case and separators aside; NULL if unknown."""
    key = F.regexp_replace(F.lower(F.trim(name)), "[_ ]", "-")
    table = F.create_map(*[F.lit(x) for canon, names in SOURCE_ALIASES.items() for a in names for x in (a, canon)])
    return F.try_element_at(table, key)


def parse_time(text: Column) -> Column:
    """ISO text to a UTC timestamp without zone; Z or no zone is UTC, an offset is converted; NULL if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")).cast("timestamp_ntz")


def parse_iso_local(text: Column) -> Column:
    """ISO text whose zone is dropped without conversion."""
    return F.try_to_timestamp(F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")).cast("timestamp_ntz")


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_iso_z(text: Column) -> Column:
    return text.rlike(ISO_Z)


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("int")


def day_of_year_time(name: Column) -> Column:
    """Scan start _sYYYYDDDHHMMSS."""
    p = r"_s(\d{4})(\d{3})(\d{2})(\d{2})(\d{2})"
    year, day, h, m, s = (_number(name, p, g) for g in range(1, 6))
    base = F.make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return base + F.make_dt_interval(day - 1, h, m, s.cast("decimal(18,6)"))


def segment_time(name: Column) -> Column:
    """HS_Hnn_YYYYMMDD_HHMM_Bnn_."""
    p = r"HS_H\d\d_(\d{8})_(\d{4})_B(\d\d)_"
    return F.try_to_timestamp(F.concat(F.regexp_extract(name, p, 1), F.regexp_extract(name, p, 2)), F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")


def stamp_time(name: Column) -> Column:
    """_YYYYMMDDHHMM.nc at the end."""
    return F.try_to_timestamp(F.regexp_extract(name, r"_(\d{12})\.nc$", 1), F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")


def month_name_time(name: Column) -> Column:
    """_DDMONYYYY_HHMM_ with English month names."""
    p = r"_(\d{2})([A-Z]{3})(\d{4})_(\d{2})(\d{2})_"
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.regexp_extract(name, p, 2)).cast("int")
    day, year, h, m = (_number(name, p, g) for g in (1, 3, 4, 5))
    return F.when(month > 0, F.make_timestamp_ntz(year, month, day, h, m, F.lit(0)))


def hour_prefixes(start: Column, end: Column) -> Column:
    """Hourly y/ddd/hh prefixes covering the two times, in any order."""
    low, high = F.least(start, end), F.greatest(start, end)
    hours = F.sequence(F.date_trunc("hour", low), F.date_trunc("hour", high), F.expr("interval 1 hour"))
    return F.transform(hours, lambda h: F.date_format(h, "yyyy/DDD/HH"))


def tile_template(index: Column) -> Column:
    return F.format_string("tiles/%03d/{z}/{x}/{y}.webp", index)


def first_present(df: DataFrame, candidates: list[str]) -> str | None:
    """The first of the candidate columns that `df` has, case aside."""
    have = {c.lower(): c for c in df.columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def hex_channel(color: Column, channel: int) -> Column:
    """0, 1, 2 for red, green, blue of #rrggbb."""
    return F.conv(F.substring(color, 2 + 2 * channel, 2), 16, 10).cast("int")


def nine_digits(x: Column) -> Column:
    """A number with nine significant digits, for cache keys."""
    return F.format_string("%.9g", x)


def cache_key(*parts: Column, prefix: str = "interp") -> Column:
    return F.concat(F.lit(prefix + ":"), F.sha2(F.concat_ws("|", *parts), 256))


def grid_key(coordinates: Column, grid: Column) -> Column:
    """Sixteen digits that tell coordinates and grid apart."""
    return F.left(F.sha1(F.concat_ws("|", coordinates, grid)), F.lit(16))


def first_time(times: Column) -> Column:
    """The first time of an array that is there."""
    return F.get(F.filter(times, lambda t: t.isNotNull()), F.lit(0))


def display_utc(iso: Column) -> Column:
    """Day, month and minute; text that is no time stays as it is."""
    return F.coalesce(F.date_format(parse_time(iso), "dd MMM '\u00b7' HH:mm'Z'"), iso)


def display_clock(iso: Column) -> Column:
    return F.coalesce(F.date_format(parse_time(iso), "HH:mm:ss'Z'"), iso)


def minutes_between(a: Column, b: Column) -> Column:
    millis = lambda c: F.unix_millis(parse_time(c).cast("timestamp"))
    return (millis(b) - millis(a)) / 60000.0


def round_half_up(x: Column, digits: int) -> Column:
    """Halves go up, also below zero."""
    f = float(10**digits)
    return F.floor(x * f + 0.5) / f


def shown(x: Column, digits: int) -> Column:
    """A number with fixed decimals; a dash where there is none."""
    return F.when(x.isNull() | F.isnan(x), "\u2014").otherwise(F.format_string(f"%.{digits}f", x))


def override(given: Column, key: str, default: Column, kind: str) -> Column:
    """The last `key=value` of an array of overrides as `kind`; the default without one, or where it does not fit."""
    mine = F.filter(given, lambda g: F.trim(F.substring_index(g, "=", 1)) == F.lit(key))
    value = F.trim(F.substring_index(F.get(mine, F.size(mine) - 1), "=", -1))
    typed = F.lower(value).isin("1", "true", "yes", "on") if kind == "boolean" else value.try_cast(kind)
    return F.coalesce(typed, default)
