"""DXF drawings as an entity table, read with plain Python on the executors.

``read_dxf`` gives one row per file with its entities, its warnings and how many places were
damaged; ``entities`` gives one row per modelspace entity, ``drawings`` one per file with its
units, layers, extents and warnings. A file is parsed by one task; thousands of files
spread over the cluster. ``dxf_format`` has the same entities as a format of ``spark.read``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.staging import gathered

ENTITY = (
    "drawing_id string, ordinal int, handle string, type string, layer string, x_min double, y_min double, x_max double, y_max double, "
    "cx double, cy double, length double, area double, closed boolean, radius double, text string, block string, scale double, rotation double, "
    "measurement double, vertices array<struct<x:double,y:double>>, attribs map<string,string>"
)
PARSED = f"drawing_id string, unit_code int, errors int, warnings array<string>, entities array<struct<{', '.join(f'{c.split(" ", 1)[0]}:{c.split(" ", 1)[1]}' for c in ENTITY.split(', ')[1:])}>>"

#: Drawing unit codes, and metres in one unit.
UNITS = {0: "unitless", 1: "in", 2: "ft", 4: "mm", 5: "cm", 6: "m"}
METRES = {"mm": 0.001, "cm": 0.01, "m": 1.0, "in": 0.0254, "ft": 0.3048}


class NotADrawing(ValueError):
    """The file has no readable sections."""


#: What begins a record: group code 0, and a name on the next line.
_NAME = re.compile(r"\s*[A-Z][A-Z0-9_]*\s*$")


def _pairs(text: str, bad: list[int]) -> Iterator[tuple[int, str]]:
    """Group codes and values. Where a line should be a code and is none, reading goes on at the next beginning of a record.

    The line before may be that beginning, as it is where a line was lost. Numbers of such
    lines are added to ``bad``; a last line without a value is one of them.
    """
    lines = text.splitlines()
    i, resumed = 0, -1
    while i + 1 < len(lines):
        try:
            code = int(lines[i])
        except ValueError:
            bad.append(i + 1)
            at = max(i - 1, resumed + 1)
            while at + 1 < len(lines) and not (lines[at].strip() == "0" and _NAME.match(lines[at + 1])):
                at += 1
            i = resumed = at
            continue
        yield code, lines[i + 1].strip("\r\n")
        i += 2
    if i < len(lines) and lines[i].strip():
        bad.append(i + 1)


def _records(pairs: Iterator[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    held: list[tuple[int, str]] = []
    for code, value in pairs:
        if code == 0 and held:
            yield held
            held = []
        held.append((code, value.strip() if code == 0 else value))
    if held:
        yield held


class _Group:
    """The codes of one record."""

    def __init__(self, record: list[tuple[int, str]]):
        self.kind, self.codes = record[0][1], record[1:]

    def text(self, code: int, default: str | None = None) -> str | None:
        for c, v in self.codes:
            if c >= 1000:
                break
            if c == code:
                return v
        return default

    def number(self, code: int, default: float | None = None) -> float | None:
        found = self.text(code)
        return default if found is None else float(found)

    def all(self, code: int) -> list[float]:
        return [float(v) for c, v in self.codes if c == code]


def _plain(mtext: str) -> str:
    """MTEXT without its formatting codes."""
    out, i = [], 0
    while i < len(mtext):
        ch = mtext[i]
        if ch in "{}":
            i += 1
        elif ch == "\\" and i + 1 < len(mtext):
            code = mtext[i + 1]
            if code in "\\{}":
                out.append(code)
                i += 2
            elif code == "P":
                out.append("\n")
                i += 2
            elif code in "LlOoKk":
                i += 2
            elif code == "~":
                out.append(" ")
                i += 2
            else:
                end = mtext.find(";", i)
                i = end + 1 if end >= 0 else len(mtext)
        else:
            out.append(ch)
            i += 1
    return "".join(out)


def _box(points: list[tuple[float, float]]) -> tuple[float, float, float, float] | None:
    if not points:
        return None
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)


def _arc_points(x: float, y: float, r: float, start: float, end: float) -> list[tuple[float, float]]:
    """The ends of an arc and the axis points that it passes."""
    sweep = (end - start) % 360 or 360.0
    angles = [start, start + sweep] + [a for k in range(-4, 9) if start <= (a := 90.0 * k) <= start + sweep]
    return [(x + r * math.cos(math.radians(a)), y + r * math.sin(math.radians(a))) for a in angles]


def _outline(g: _Group, vertices: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Points whose box is that of the entity; empty for text."""
    if g.kind == "LINE" or g.kind in ("LWPOLYLINE", "POLYLINE"):
        return vertices
    if g.kind == "CIRCLE":
        x, y, r = g.number(10), g.number(20), g.number(40)
        return [(x - r, y - r), (x + r, y + r)]
    if g.kind == "ARC":
        return _arc_points(g.number(10), g.number(20), g.number(40), g.number(50), g.number(51))
    if g.kind in ("POINT", "SOLID"):
        return list(zip(g.all(10), g.all(20), strict=False))
    return []


def _vertices(g: _Group, children: list[_Group]) -> list[tuple[float, float]]:
    if g.kind == "LINE":
        return [(g.number(10), g.number(20)), (g.number(11), g.number(21))]
    if g.kind == "LWPOLYLINE":
        return list(zip(g.all(10), g.all(20), strict=True))
    if g.kind == "POLYLINE":
        return [(c.number(10), c.number(20)) for c in children if c.kind == "VERTEX"]
    return []


def _edges(points: list[tuple[float, float]], closed: bool) -> float:
    ends = points[1:] + points[:1] * closed
    return sum(math.dist(a, b) for a, b in zip(points, ends, strict=False))


def _shoelace(points: list[tuple[float, float]]) -> float:
    if len(points) < 3:
        return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))) / 2


class _Blocks:
    """Outlines of block definitions, placed by an insert's scale, rotation and base point."""

    def __init__(self) -> None:
        self.base: dict[str, tuple[float, float]] = {}
        self.parts: dict[str, list[tuple[_Group, list[_Group]]]] = {}

    def points(self, insert: _Group, depth: int = 0) -> list[tuple[float, float]]:
        name = insert.text(2, "")
        bx, by = self.base.get(name, (0.0, 0.0))
        sx, sy = insert.number(41, 1.0), insert.number(42, insert.number(41, 1.0))
        turn = math.radians(insert.number(50, 0.0))
        c, s = math.cos(turn), math.sin(turn)
        x0, y0 = insert.number(10, 0.0), insert.number(20, 0.0)

        def place(p: tuple[float, float]) -> tuple[float, float]:
            x, y = (p[0] - bx) * sx, (p[1] - by) * sy
            return x0 + x * c - y * s, y0 + x * s + y * c

        found: list[tuple[float, float]] = []
        for g, children in self.parts.get(name, []):
            if g.kind == "INSERT":
                inner = self.points(g, depth + 1) if depth < 8 else []
                found += map(place, inner)
            elif g.kind == "CIRCLE" and sx == sy:
                x, y = place((g.number(10), g.number(20)))
                r = g.number(40) * abs(sx)
                found += [(x - r, y - r), (x + r, y + r)]
            elif g.kind == "ARC" and sx == sy and sx > 0:
                x, y = place((g.number(10), g.number(20)))
                a = math.degrees(turn)
                found += _arc_points(x, y, g.number(40) * sx, g.number(50) + a, g.number(51) + a)
            else:
                found += map(place, _outline(g, _vertices(g, children)))
        return found


def _entity(g: _Group, children: list[_Group], blocks: _Blocks) -> dict:
    kind, row = g.kind, {"handle": g.text(5, ""), "type": g.kind, "layer": g.text(8, "0"), "closed": False}
    vertices = _vertices(g, children)
    if vertices:
        row["vertices"] = [{"x": x, "y": y} for x, y in vertices]
    if kind == "LINE":
        row["length"] = math.dist(*vertices)
    elif kind in ("LWPOLYLINE", "POLYLINE"):
        row["closed"] = bool(int(g.text(70, "0")) & 1)
        row["length"] = _edges(vertices, row["closed"])
        row["area"] = _shoelace(vertices) if row["closed"] else None
    elif kind == "CIRCLE":
        r = g.number(40)
        row |= {"radius": r, "length": 2 * math.pi * r, "area": math.pi * r * r, "closed": True}
    elif kind == "ARC":
        r = g.number(40)
        row |= {"radius": r, "length": r * math.radians((g.number(51) - g.number(50)) % 360 or 360)}
    elif kind == "TEXT":
        row["text"] = g.text(1, "")
    elif kind == "MTEXT":
        row["text"] = _plain("".join(v for c, v in g.codes if c == 3) + g.text(1, ""))
    elif kind == "INSERT":
        row |= {"block": g.text(2), "scale": abs(g.number(41, 1.0)), "rotation": g.number(50, 0.0)}
        row["attribs"] = {c.text(2, "").upper(): c.text(1, "") for c in children if c.kind == "ATTRIB"} or None
    elif kind == "DIMENSION":
        row["measurement"] = _measured(g)
    box = _box(blocks.points(g) if kind == "INSERT" else _outline(g, vertices))
    at = (g.number(10), g.number(20))
    if box is None and kind in ("INSERT", "TEXT", "MTEXT") and None not in at:
        box = (*at, *at)
    if box:
        row |= dict(zip(("x_min", "y_min", "x_max", "y_max"), box, strict=True))
    if kind == "INSERT" or kind == "MTEXT":
        row["cx"], row["cy"] = at
    elif kind == "TEXT":
        aligned = int(g.text(72, "0")) != 0 and g.number(11) is not None
        row["cx"], row["cy"] = (g.number(11), g.number(21)) if aligned else at
    elif box:
        row["cx"], row["cy"] = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    return row


def _measured(g: _Group) -> float | None:
    """The value of a linear dimension: the stored one, or the extent along its angle."""
    stored = g.number(42)
    if stored is not None:
        return stored
    ends = [g.number(c) for c in (13, 23, 14, 24)]
    if None in ends:
        return None
    turn = math.radians(g.number(50, 0.0))
    return abs((ends[2] - ends[0]) * math.cos(turn) + (ends[3] - ends[1]) * math.sin(turn))


def parse(text: str, strict: bool = False) -> tuple[int, list[str], list[dict]]:
    """(unit code, warnings, entities in file order) of one drawing.

    A pair or an entity that can't be read is skipped with a warning, or raises if
    ``strict``. A text without any section raises ``NotADrawing``.
    """
    unit_code, _, warnings, rows = parse_counted(text, strict)
    return unit_code, warnings, rows


def parse_counted(text: str, strict: bool = False) -> tuple[int, int, list[str], list[dict]]:
    """``parse`` with the number of damaged places and skipped entities behind the unit code.

    After a damaged place reading goes on at the next record, so entities before and after
    it are kept; of the record that it lies in, what was read before it is.
    """
    warnings: list[str] = []
    bad: list[int] = []
    section, unit_code, rows, blocks = None, 0, [], _Blocks()
    block, seen, last_header = None, False, None
    stack: tuple[_Group, list[_Group]] | None = None

    def finish() -> None:
        nonlocal stack
        if stack is None:
            return
        g, children = stack
        stack = None
        if block is not None:
            blocks.parts[block].append((g, children))
            return
        try:
            rows.append(_entity(g, children, blocks))
        except (TypeError, ValueError, IndexError) as error:
            if strict:
                raise
            warnings.append(f"Skipped {g.kind} {g.text(5, '')}: {error}")

    for record in _records(_pairs(text, bad)):
        g = _Group(record)
        if g.kind == "SECTION":
            section, seen = g.text(2), True
            if section == "HEADER":
                for code, value in g.codes:
                    if code == 9:
                        last_header = value.strip()
                    elif last_header == "$INSUNITS" and code == 70:
                        unit_code = int(value)
        elif g.kind in ("ENDSEC", "EOF"):
            finish()
            section = None
        elif section == "BLOCKS":
            if g.kind == "BLOCK":
                block = g.text(2, "")
                blocks.base[block] = (g.number(10, 0.0), g.number(20, 0.0))
                blocks.parts[block] = []
            elif g.kind == "ENDBLK":
                finish()
                block = None
            elif g.kind in ("VERTEX", "ATTRIB", "SEQEND"):
                if stack and g.kind != "SEQEND":
                    stack[1].append(g)
            elif g.kind in ("ATTDEF", "TEXT", "MTEXT"):
                finish()
            else:
                finish()
                stack = (g, [])
        elif section == "ENTITIES":
            if g.kind in ("VERTEX", "ATTRIB", "SEQEND"):
                if stack and g.kind != "SEQEND":
                    stack[1].append(g)
            else:
                finish()
                stack = (g, [])
    if not seen:
        raise NotADrawing("not a DXF file: it has no sections")
    finish()
    errors = len(bad) + len(warnings)
    if bad:
        warnings.insert(0, f"Recovered from {len(bad)} errors: no group code on line {', '.join(map(str, bad[:5]))}{' and more' if len(bad) > 5 else ''}.")
    if strict and warnings:
        raise ValueError(warnings[0])
    for i, row in enumerate(rows):
        row["ordinal"] = i
    return unit_code, errors, warnings, rows


#: Entities after which a task hands on the drawings that it has read.
HELD = 5_000
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<struct<x:double,y:double>>": pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])), "map<string,string>": pa.map_(pa.string(), pa.string())}
_FIELDS = [pa.field(c, _ARROW[kind]) for c, kind in (x.split(" ", 1) for x in ENTITY.split(", ")[1:])]
_PARSED = pa.schema([("drawing_id", pa.string()), ("unit_code", pa.int32()), ("errors", pa.int32()), ("warnings", pa.list_(pa.string())), ("entities", pa.list_(pa.struct(_FIELDS)))])


def _batch(found: list[tuple]) -> pa.RecordBatch:
    """Drawings as Arrow, their entities column by column."""
    rows = [row for *_, entities in found for row in entities]
    for row in rows:
        row["attribs"] = list(row["attribs"].items()) if row.get("attribs") else None
    columns = [pa.array([row.get(f.name) for row in rows], f.type) for f in _FIELDS]
    ends = pa.array(accumulate((len(entities) for *_, entities in found), initial=0), pa.int32())
    entities = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=_FIELDS))
    return pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in found], _PARSED[i].type) for i in range(4)), entities], schema=_PARSED)


def _parse_all(strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for drawing_id, content in zip(batch["drawing_id"], batch["content"], strict=True):
                try:
                    unit_code, errors, warnings, rows = parse_counted(content.as_py().decode("utf-8", "replace"), strict)
                except NotADrawing as error:
                    if strict:
                        raise
                    unit_code, errors, warnings, rows = 0, 1, [str(error)], []
                found.append((drawing_id.as_py(), unit_code, errors, warnings, rows))
                held += len(rows)
                if held >= HELD:
                    yield _batch(found)
                    found, held = [], 0
            if found:
                yield _batch(found)

    return run


def read_dxf(spark: SparkSession, path: str, mode: str = "PERMISSIVE", files: str = "*.dxf", named: str = r"([^/]+)\.dxf$") -> DataFrame:
    """drawing_id, unit_code, errors, warnings and entities (in file order), one row per file below ``path``.

    ``mode`` FAILFAST raises on anything that PERMISSIVE would skip with a warning. In the
    latter a file that is no drawing at all is a row without entities that says so.
    ``errors`` counts damaged places and skipped entities. ``files`` is a pattern of file
    names, and ``named`` has the drawing's id as its first group, of the whole path. Many
    small files share a task.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", files).option("recursiveFileLookup", "true").load(path)
    return gathered(found.select(F.regexp_extract("path", named, 1).alias("drawing_id"), "content")).mapInArrow(_parse_all(mode.upper() == "FAILFAST"), PARSED)


def entities(parsed: DataFrame) -> DataFrame:
    """The entity table: one row per entity of ``read_dxf``."""
    one = parsed.select("drawing_id", F.explode("entities").alias("e"))
    return one.select(*(["drawing_id"] + [F.col(f"e.{c.split(' ', 1)[0]}") for c in ENTITY.split(", ")[1:]]))


def _field(name: str):
    return lambda x: x[name]


def _units(unit_code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), unit_code), F.lit("unitless"))


def _to_m(units: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in METRES.items() for x in kv]), units)


def sheets(rows: DataFrame, unit_code: Column) -> DataFrame:
    """What ``drawings`` gives, from rows of entities: summed up by layer and drawing, so that no drawing's entities are held together."""
    boxed = F.col("x_min").isNotNull()
    solid = boxed & (F.col("type") != "DIMENSION")
    corners = (("x_min", F.min), ("y_min", F.min), ("x_max", F.max), ("y_max", F.max))
    found = [end(F.when(fits, F.col(c))).alias(f"{name}_{c}") for name, fits in (("solid", solid), ("boxed", boxed)) for c, end in corners]
    by_layer = rows.groupBy("drawing_id", "layer").agg(F.count_if(solid).alias("n"), *found)
    again = [end(f"{name}_{c}").alias(f"{name}_{c}") for name in ("solid", "boxed") for c, end in corners]
    summed = by_layer.groupBy("drawing_id").agg(F.array_sort(F.collect_set("layer")).alias("layers"), F.sum("n").alias("n"), *again)
    ends = [F.coalesce(F.when(F.col("n") > 0, F.col(f"solid_{c}")).otherwise(F.col(f"boxed_{c}")), F.lit(0.0)).alias(c) for c, _ in corners]
    base = summed.withColumn("units", _units(unit_code))
    return base.select("drawing_id", "units", _to_m(F.col("units")).alias("to_m"), "layers", F.struct(*ends).alias("extents"), F.array().cast("array<string>").alias("warnings"))


def drawings(parsed: DataFrame) -> DataFrame:
    """drawing_id, units, to_m, layers, extents and warnings, one row per file.

    Extents leave dimensions out unless there is nothing else, and are zero for a drawing
    without geometry. Only layers that hold entities are listed.
    """
    e = F.col("entities")
    boxed = F.filter(e, lambda x: x["x_min"].isNotNull())
    solid = F.filter(boxed, lambda x: x["type"] != "DIMENSION")
    geo = F.when(F.size(solid) > 0, solid).otherwise(boxed)
    ends = [F.coalesce(pick(F.transform("geo", _field(c))), F.lit(0.0)).alias(c) for c, pick in (("x_min", F.array_min), ("y_min", F.array_min), ("x_max", F.array_max), ("y_max", F.array_max))]
    base = parsed.select("drawing_id", _units(F.col("unit_code")).alias("units"), F.array_sort(F.array_distinct(F.transform(e, lambda x: x["layer"]))).alias("layers"), geo.alias("geo"), "warnings")
    return base.select("drawing_id", "units", _to_m(F.col("units")).alias("to_m"), "layers", F.struct(*ends).alias("extents"), "warnings")
