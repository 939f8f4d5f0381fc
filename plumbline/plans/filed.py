"""Drawings written as DXF files from the part table and read by the drawing source, some of them damaged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import dxf, dxf_format
from plumbline.staging import scratch_path

#: A drawing of this many is damaged by a line too many.
DAMAGED = 5


def _lines(*pairs: tuple[int, Column | str | int]) -> Column:
    """Group codes and values, one to a line."""
    said = [x for code, value in pairs for x in (F.lit(str(code)), F.lit(str(value)) if isinstance(value, (str, int)) else value.cast("string"))]
    return F.concat_ws("\n", *said)


def _texts(part: DataFrame) -> DataFrame:
    """name and text of a drawing for every 24 parts: a room, its name, a door with a tag, its swing and a dimension for each."""
    k, x, y, w, h, s = (F.col(c) for c in ("k", "x", "y", "w", "h", "s"))
    handle = lambda t: F.concat(k.cast("string"), F.lit(t))
    corners = [(10, x), (20, y), (10, x + w), (20, y), (10, x + w), (20, y + h), (10, x), (20, y + h)]
    stray = F.when((F.col("d") % DAMAGED == 0) & (F.col("i") == 0), F.array(F.lit("a line too many"))).otherwise(F.array().cast("array<string>"))
    room = F.concat(
        F.array(
            _lines((0, "LWPOLYLINE"), (5, handle("A")), (8, "ROOMS"), (90, 4), (70, 1), *corners),
            _lines((0, "TEXT"), (5, handle("B")), (8, "ROOM_NAMES"), (10, x), (20, y), (72, 1), (11, x + w / 2), (21, y + h / 2), (1, F.concat(F.lit("ROOM "), F.col("i").cast("string")))),
            _lines((0, "ARC"), (5, handle("C")), (8, "DOORS"), (10, x), (20, y), (40, s), (50, 350), (51, F.col("i") % 9 * 10 + 10)),
        ),
        stray,
        F.array(
            _lines((0, "INSERT"), (5, handle("D")), (8, "DOORS"), (66, 1), (2, "DOOR"), (10, x), (20, y), (41, s), (42, s), (50, 90), (0, "ATTRIB"), (2, "tag"), (1, F.concat(F.lit("D"), k.cast("string"))), (0, "SEQEND")),
            _lines((0, "DIMENSION"), (5, handle("E")), (8, "DIMENSIONS"), (10, x), (20, y - 100), (13, x), (23, y), (14, x + w), (24, y + h), (50, F.when(F.col("i") % 2 == 0, 0).otherwise(90))),
        ),
    )
    head = _lines((0, "SECTION"), (2, "HEADER"), (9, "$INSUNITS"), (70, F.when(F.col("d") % 2 == 0, 4).otherwise(1)), (0, "ENDSEC"), (0, "SECTION"), (2, "BLOCKS"), (0, "BLOCK"), (2, "DOOR"), (10, 0), (20, 0), (0, "LINE"), (10, 0), (20, 0), (11, 1), (21, 0), (0, "ARC"), (10, 0), (20, 0), (40, 1), (50, 0), (51, 90), (0, "ENDBLK"), (0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES"))
    sheets = part.groupBy("d").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", room.alias("room")))), lambda r: r["room"])).alias("rooms"))
    return sheets.select(F.concat(F.lit("plan-"), F.col("d").cast("string")).alias("name"), F.concat_ws("\n", head, F.array_join("rooms", "\n"), _lines((0, "ENDSEC"), (0, "EOF"))).alias("value"))


def dxf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the drawing source reads of each part's room, door, swing and dimension, and how many places of its file were damaged."""
    k = F.col("p_partkey")
    i = (k % 24).cast("int")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("k"), F.floor(k / 24).alias("d"), i.alias("i"), (i % 6 * 9000).cast("double").alias("x"), (F.floor(i / 6) * 9000).cast("double").alias("y"),
        (F.col("p_size") * 100 + 1000).cast("double").alias("w"), (k % 31 * 100 + 1800).cast("double").alias("h"), (k % 5 * 50 + 650).cast("double").alias("s"),
    )
    path = scratch_path(spark, "dxf")
    dxf_format.write_files(_texts(part), path)
    parsed = dxf.read_dxf(spark, path)
    found = parsed.select("drawing_id", "unit_code", "errors", F.explode("entities").alias("e")).select("drawing_id", "unit_code", "errors", "e.*")
    of = lambda kind, column: F.max(F.when(F.col("type") == kind, F.col(column)))
    return found.groupBy("drawing_id", "unit_code", "errors", F.regexp_extract("handle", r"^(\d+)", 1).cast("long").alias("k")).agg(
        F.round(of("LWPOLYLINE", "area"), 3).alias("area"), F.round(of("LWPOLYLINE", "length"), 3).alias("around"), of("TEXT", "text").alias("label"), F.round(of("TEXT", "cx"), 3).alias("label_x"),
        F.round(of("ARC", "length"), 6).alias("swing"), F.round(of("ARC", "x_max"), 3).alias("swing_x"), F.round(of("INSERT", "x_min"), 3).alias("door_x"), F.round(of("INSERT", "y_max"), 3).alias("door_y"),
        F.max(F.element_at("attribs", "TAG")).alias("tag"), of("INSERT", "rotation").alias("turned"), F.round(of("DIMENSION", "measurement"), 3).alias("size"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"dxf_files": dxf_files}

ORACLE = {
    "dxf_files": """
WITH r AS (SELECT p_partkey AS k, p_partkey // 24 AS d, p_partkey % 24 AS i, (p_partkey % 24 % 6 * 9000)::DOUBLE AS x, ((p_partkey % 24) // 6 * 9000)::DOUBLE AS y,
  (p_size * 100 + 1000)::DOUBLE AS w, (p_partkey % 31 * 100 + 1800)::DOUBLE AS h, (p_partkey % 5 * 50 + 650)::DOUBLE AS s FROM part)
SELECT 'plan-' || d AS drawing_id, CASE WHEN d % 2 = 0 THEN 4 ELSE 1 END AS unit_code, (d % 5 = 0 AND bool_or(i = 0) OVER (PARTITION BY d))::INT AS errors, k, round(w * h, 3) AS area, round(2 * (w + h), 3) AS around,
  'ROOM ' || i AS label, round(x + w / 2, 3) AS label_x, round(s * radians(i % 9 * 10 + 20), 6) AS swing, round(x + s, 3) AS swing_x, round(x - s, 3) AS door_x, round(y + s, 3) AS door_y,
  'D' || k AS tag, 90.0::DOUBLE AS turned, CASE WHEN i % 2 = 0 THEN w ELSE h END AS size
FROM r
"""
}
