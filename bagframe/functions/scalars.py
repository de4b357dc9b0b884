"""Scalar functions over columns: units, paths, parsing, level choice, formatting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def px_to_mm2(px: Column, spacing: Column | float) -> Column:
    """Pixel area to square millimetres; spacing in micrometres per pixel."""
    s = spacing if isinstance(spacing, Column) else F.lit(float(spacing))
    return px * (s * s) / 1e6


def mm2_to_px(area: Column, spacing: Column | float) -> Column:
    s = spacing if isinstance(spacing, Column) else F.lit(float(spacing))
    return area * 1e6 / (s * s)


def px_to_um2(px: Column, spacing: Column | float) -> Column:
    s = spacing if isinstance(spacing, Column) else F.lit(float(spacing))
    return px * (s * s)


def distance_to_px(distance: Column, spacing: Column | float) -> Column:
    """Rounded half to even."""
    s = spacing if isinstance(spacing, Column) else F.lit(float(spacing))
    return F.rint(distance / s).cast("long")


def px_to_distance(px: Column, spacing: Column | float) -> Column:
    s = spacing if isinstance(spacing, Column) else F.lit(float(spacing))
    return F.rint(px * s).cast("long")


def columns_to_mm2(df: DataFrame, cols: Sequence[str], spacing: float = 2.0) -> DataFrame:
    """Convert pixel columns in place; missing columns and columns with 'tils' in the name are left alone."""
    change = {c: px_to_mm2(F.col(c).cast("double"), spacing) for c in cols if c in df.columns and "tils" not in c}
    return df.withColumns(change) if change else df


def file_name(path: str | Column) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.element_at(F.split(c, "/"), -1)


def stem(path: str | Column) -> Column:
    """File name without its last ending."""
    return F.regexp_replace(file_name(path), "(.)\\.[^.]+$", "$1")


def suffix(path: str | Column) -> Column:
    """Last ending with its dot, or empty."""
    return F.regexp_extract(file_name(path), ".(\\.[^.]+)$", 1)


def short_stem(path: str | Column) -> Column:
    """File name up to the first dot."""
    return F.element_at(F.split(file_name(path), "\\."), 1)


def strip_ending(c: str | Column) -> Column:
    """Text without its last ``.ending``; text without a dot becomes empty."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(col, "(^|\\.)[^.]*$", "")


def strip_non_ascii(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(col, "[^\\x00-\\x7F]", "")


def duration_text(seconds: str | Column) -> Column:
    """Seconds as ``1d2h03m04s``; below one second as ``0.5000s`` or ``0.05ms``."""
    s = (F.col(seconds) if isinstance(seconds, str) else seconds).cast("double")
    sec, minutes = s % 60, F.floor(s / 60)
    mins, hours = minutes % 60, F.floor(minutes / 60)
    hrs, days = hours % 24, F.floor(hours / 24)
    whole = F.floor(sec).cast("long")
    return (
        F.when(s == 0, F.lit("0s"))
        .when(s <= 1e-4, F.format_string("%.2fms", s * 1000))
        .when(s < 1, F.format_string("%.4fs", s))
        .when(days > 0, F.format_string("%dd%dh%02dm%02ds", days, hrs, mins, whole))
        .when(hours > 0, F.format_string("%dh%02dm%02ds", hours, mins, whole))
        .when(minutes > 0, F.format_string("%02dm%02ds", minutes, whole))
        .otherwise(F.format_string("%ds", whole)))


def parse_number(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.try_cast("double")


def parse_boolean(c: str | Column) -> Column:
    """'true'/'false' in any case; anything else is NULL."""
    col = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(col == "true", True).when(col == "false", False)


def parse_list(c: str | Column, element: str = "double") -> Column:
    """``[1,2]`` or ``1,2`` to a typed array; a single value is a one-element array."""
    col = F.trim(F.col(c) if isinstance(c, str) else c)
    inner = F.regexp_replace(col, "^\\[|\\]$", "")
    return F.transform(F.split(inner, ","), lambda v: F.trim(v).try_cast(element))


def parse_map(c: str | Column, value: str = "double") -> Column:
    """``{a:1,b:2}`` to MAP<STRING, value>."""
    col = F.trim(F.col(c) if isinstance(c, str) else c)
    inner = F.regexp_replace(F.regexp_replace(col, "^\\{|\\}$", ""), "\\s", "")
    pairs = F.str_to_map(inner, F.lit(","), F.lit(":"))
    return F.transform_values(pairs, lambda k, v: v.try_cast(value))


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested struct columns to flat columns with dotted names."""
    out: list[Column] = []

    def walk(field: T.StructField, path: list[str]) -> None:
        here = [*path, field.name]
        if isinstance(field.dataType, T.StructType):
            for f in field.dataType.fields:
                walk(f, here)
        else:
            out.append(F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here)))

    for f in df.schema.fields:
        walk(f, [])
    return df.select(*out)


def nested_get(json: str | Column, key: str, default: str | None = None) -> Column:
    """Dotted lookup in a JSON text column."""
    col = F.col(json) if isinstance(json, str) else json
    value = F.get_json_object(col, "$." + key)
    return value if default is None else F.coalesce(value, F.lit(default))


def remap_values(array: str | Column, mapping: Mapping) -> Column:
    """Replace array values by ``{old: new}``, all at the same time."""
    a = F.col(array) if isinstance(array, str) else array
    if not mapping:
        return a

    def one(x: Column) -> Column:
        e = None
        for old, new in mapping.items():
            e = F.when(x == old, F.lit(new)) if e is None else e.when(x == old, F.lit(new))
        return e.otherwise(x)

    return F.transform(a, one)


def require_finite(c: str) -> Column:
    """The column itself; NaN or infinite values are an error. NULL counts as missing and passes."""
    v = F.col(c)
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{c} contains nan or inf")).cast("double")).otherwise(v)


def closest_level(spacings: Column, spacing: Column | float, tolerance: float = 0.25, error: bool = False) -> Column:
    """Index of the nearest spacing, the lower one on a tie; NULL (or an error) beyond tolerance * spacing."""
    s = spacing if isinstance(spacing, Column) else F.lit(float(spacing))
    gaps = F.transform(spacings, lambda x: F.abs(x - s))
    level = (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")
    near = F.array_min(gaps) <= s * tolerance
    miss = F.raise_error(F.concat(F.lit("no level for spacing "), s.cast("string"))).cast("int") if error else F.lit(
        None).cast("int")
    return F.when(near, level).otherwise(miss)


def first_level_within(spacings: Column, spacing: Column | float, tolerance: float = 0.25) -> Column:
    """Index of the first spacing within tolerance * spacing, else NULL."""
    s = spacing if isinstance(spacing, Column) else F.lit(float(spacing))
    hit = F.array_position(F.transform(spacings, lambda x: F.abs(x - s) <= s * tolerance), True)
    return F.when(hit > 0, (hit - 1).cast("int"))


def thumbnail_level(shapes: Column, max_pixels: int = 1024 * 1024) -> Column:
    """First level whose h * w is at most ``max_pixels``, else the last level."""
    hit = F.array_position(F.transform(shapes, lambda s: s["h"] * s["w"] <= max_pixels), True)
    return F.when(hit > 0, hit - 1).otherwise(F.size(shapes) - 1).cast("int")


def closest_number(numbers: Column, x: Column | float) -> Column:
    """Nearest list element, the first one on a tie."""
    v = x if isinstance(x, Column) else F.lit(x)
    gaps = F.transform(numbers, lambda n: F.abs(n - v))
    return F.get(numbers, (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int"))


def closest_number_index(numbers: Column, x: Column | float) -> Column:
    v = x if isinstance(x, Column) else F.lit(x)
    gaps = F.transform(numbers, lambda n: F.abs(n - v))
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def first_not_smaller(numbers: Column, x: Column | float) -> Column:
    """First list element >= x in list order, else NULL."""
    v = x if isinstance(x, Column) else F.lit(x)
    return F.get(F.filter(numbers, lambda n: n >= v), F.lit(0))


def largest_not_greater(numbers: Column, x: Column | float, error: bool = False) -> Column:
    """Largest list element <= x; none is NULL or an error."""
    v = x if isinstance(x, Column) else F.lit(x)
    best = F.array_max(F.filter(numbers, lambda n: n <= v))
    if not error:
        return best
    return F.coalesce(best, F.raise_error(F.lit("no value is small enough")).cast("double"))


def grey_value(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114
