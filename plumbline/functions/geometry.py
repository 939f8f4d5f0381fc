"""Geometry, number and text expressions as Columns; vertices are arrays of struct(x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segment_length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def _next(points: Column, i: Column) -> Column:
    return F.get(points, F.pmod(i + 1, F.size(points)))


def polyline_length(points: Column, closed: Column) -> Column:
    """The sum of edges, with the closing edge of a closed one."""
    steps = F.transform(points, lambda p, i: F.when((i + 1 < F.size(points)) | closed, F.hypot(_next(points, i)["x"] - p["x"], _next(points, i)["y"] - p["y"])).otherwise(F.lit(0.0)))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


def polygon_area(points: Column) -> Column:
    """Shoelace area; below three points it is 0."""
    cross = F.transform(points, lambda p, i: p["x"] * _next(points, i)["y"] - _next(points, i)["x"] * p["y"])
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2)


def circle_length(r: Column) -> Column:
    return 2 * F.pi() * r


def circle_area(r: Column) -> Column:
    return F.pi() * r * r


def arc_length(r: Column, start: Column, end: Column) -> Column:
    """Of angles in degrees; a sweep of 0 is a whole turn."""
    sweep = F.pmod(end - start, F.lit(360.0))
    return r * F.radians(F.when(sweep == 0, F.lit(360.0)).otherwise(sweep))


def point_in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd test by a ray to the right; half open on the lower and left edges of a rectangle."""

    def crosses(p: Column, i: Column) -> Column:
        q = _next(points, i)
        return ((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"]))

    hits = F.transform(points, lambda p, i: F.when(p["y"] == _next(points, i)["y"], F.lit(0)).otherwise(crosses(p, i).cast("int")))
    return F.aggregate(hits, F.lit(0), lambda a, h: a + h) % 2 == 1


def distance_to_segment(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / F.nullif(square, F.lit(0.0)))))
    return F.hypot(x - (ax + t * dx), y - (ay + t * dy))


def near_boundary(x: Column, y: Column, points: Column, tol: Column) -> Column:
    near = F.transform(points, lambda p, i: distance_to_segment(x, y, p["x"], p["y"], _next(points, i)["x"], _next(points, i)["y"]) <= tol)
    return F.exists(near, lambda b: b)


def number(text: Column) -> Column:
    """A number without its thousands commas; null where it is none. Never raises."""
    return F.regexp_replace(F.regexp_replace(text.cast("string"), ",", ""), r"^\s+|\s+$", "").try_cast("double")


def rounded(value: Column, places: int = 3) -> Column:
    """Null for null and undefined values."""
    return F.round(F.when(~F.isnan(value), value), places)


def general(value: Column) -> Column:
    """Six significant digits without trailing zeros below a million, else an integer."""
    exact = F.format_string("%.6g", value)
    short = F.regexp_replace(F.regexp_replace(exact, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return F.when(F.abs(value) >= 1e6, F.format_string("%.0f", value)).when(value == F.floor(value), F.format_string("%d", value.cast("long"))).otherwise(short)


def same_diameter(radius: Column, diameter: Column) -> Column:
    return F.coalesce(F.abs(2 * radius - diameter) < 1e-6 * F.greatest(F.lit(1.0), diameter) + 1e-6, F.lit(False))


def contains_text(text: Column, part: Column) -> Column:
    """Case-insensitive literal containment; null never matches."""
    return F.coalesce(F.contains(F.upper(text), F.upper(part)), F.lit(False))


def same_name(a: Column, b: Column) -> Column:
    """Case-insensitive equality; null counts as empty."""
    return F.upper(F.coalesce(a, F.lit(""))) == F.upper(F.coalesce(b, F.lit("")))
