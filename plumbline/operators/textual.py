"""Drawings as text: a line per entity, and an overview of each drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from plumbline.functions.geometry import general
from plumbline.operators import measures

#: Characters of a dump, the mark of a cut one, and the texts of an overview.
MOST_CHARS, CUT, MOST_TEXTS = 12_000, "\n...[truncated]", 30


def _fixed(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", value)


def _point(x: Column, y: Column, places: int = 0) -> Column:
    return F.concat(F.lit("("), _fixed(x, places), F.lit(","), _fixed(y, places), F.lit(")"))


def _plain(value: Column) -> Column:
    """A number as it reads in a program: 2.0, 2.5; None for null."""
    return F.coalesce(F.when(value == F.floor(value), F.format_string("%.1f", value)).otherwise(value.cast("string")), F.lit("None"))


def line(entities: DataFrame) -> DataFrame:
    """drawing_id, ordinal and line: the entity in one line, null for types that a dump leaves out."""
    kind, layer = F.col("type"), F.col("layer")
    corners = F.array_join(F.transform("vertices", lambda p: _point(p["x"], p["y"])), " ")
    ends = F.array_join(F.transform("vertices", lambda p: _point(p["x"], p["y"])), "-")
    held = F.array_join(F.transform(F.map_entries(F.coalesce("attribs", F.create_map().cast("map<string,string>"))), lambda e: F.concat(F.lit(" "), e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))), "")
    drawn = F.size(F.coalesce("vertices", F.array().cast("array<struct<x:double,y:double>>"))) > 0
    text = (
        F.when((kind == "LINE") & drawn, F.concat(F.lit("LINE "), layer, F.lit(" "), ends))
        .when(kind.isin("LWPOLYLINE", "POLYLINE") & drawn, F.concat(F.lit("POLYLINE "), layer, F.lit(" "), F.when(F.col("closed"), "closed ").otherwise(""), corners))
        .when(kind == "CIRCLE", F.concat(F.lit("CIRCLE "), layer, F.lit(" c="), _point(F.col("cx"), F.col("cy"), 1), F.lit(" r="), _fixed(F.col("radius"), 2)))
        .when(kind.isin("TEXT", "MTEXT"), F.concat(F.lit("TEXT "), layer, F.lit(" '"), F.coalesce("text", F.lit("None")), F.lit("' at "), _point(F.col("cx"), F.col("cy"))))
        .when(kind == "INSERT", F.concat(F.lit("INSERT "), layer, F.lit(" block="), "block", F.lit(" scale="), general(F.col("scale")), F.lit(" rot="), general(F.col("rotation")), F.lit(" at "), _point(F.col("cx"), F.col("cy")), held))
        .when(kind == "DIMENSION", F.concat(F.lit("DIMENSION "), layer, F.lit(" value="), _plain(F.col("measurement"))))
        .when(kind == "ARC", F.concat(F.lit("ARC "), layer, F.lit(" r="), _fixed(F.col("radius"), 1)))
    )
    return entities.select("drawing_id", "ordinal", text.alias("line"))


def compact(entities: DataFrame, sheets: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """drawing_id, text: the units and a line per entity in file order, cut at ``most`` characters with a mark.

    Lines are numbered in their drawing first, and those that ``most`` others come before
    are not collected, as they lie past the cut.
    """
    place = F.row_number().over(W.partitionBy("drawing_id").orderBy("ordinal"))
    lines = line(entities).where("line IS NOT NULL").withColumn("place", place).where(F.col("place") <= most)
    body = lines.groupBy("drawing_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("body"))
    whole = sheets.select("drawing_id", "units").join(body, "drawing_id", "left").select("drawing_id", F.concat(F.lit("UNITS: "), "units", F.lit("\n"), F.coalesce("body", F.lit(""))).alias("t"))
    return whole.select("drawing_id", F.when(F.length("t") > most, F.concat(F.substring("t", 1, most), F.lit(CUT))).otherwise(F.col("t")).alias("text"))


def overview(entities: DataFrame, sheets: DataFrame) -> DataFrame:
    """drawing_id, text: domain, units, size, counts by layer and type, blocks with their attributes, and the first texts."""
    def counted(column: str) -> Column:
        return F.array_join(F.transform(F.coalesce(F.col(column), F.array().cast("array<struct<name:string,n:bigint>>")), lambda x: F.concat(x["name"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ")

    known = measures.summary(entities, sheets)
    item = F.concat("block", F.lit(" x"), F.col("n").cast("string"), F.when(F.size("attributes") > 0, F.concat(F.lit(" [attributes: "), F.array_join("attributes", ", "), F.lit("]"))).otherwise(""))
    blocks = measures.blocks(entities).groupBy("drawing_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", item.alias("i")))), lambda x: x["i"]), ", ").alias("blocks"))
    width, height = (_plain(F.round(F.col(f"extents.{c}_max") - F.col(f"extents.{c}_min"), 3)) for c in "xy")
    lines = [
        F.concat(F.lit("Drawing "), "drawing_id", F.lit(": "), F.coalesce("domain", F.lit("general drawing")), F.lit(" ("), "units", F.lit("), "), F.coalesce("n_entities", F.lit(0)).cast("string"), F.lit(" entities.")),
        F.concat(F.lit("Extents: "), width, F.lit(" x "), height, F.lit(" "), "units", F.lit(".")),
        F.concat(F.lit("Layers: "), counted("by_layer")),
        F.concat(F.lit("Entity types: "), counted("by_type")),
        F.when(F.col("blocks").isNotNull(), F.concat(F.lit("Blocks: "), "blocks")),
        F.concat(F.lit("Text: "), F.array_join(F.slice(F.coalesce("texts", F.array().cast("array<string>")), 1, MOST_TEXTS), "; ")),
    ]
    return known.join(blocks, "drawing_id", "left").select("drawing_id", F.concat_ws("\n", *lines).alias("text"))
