"""Counts, lengths and lists over the entity table, for all drawings at once.

Every function takes the entity table and returns one row per drawing or group; none
truncates. A layer, block or text argument of ``None`` filters nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.geometry import contains_text, number, same_diameter, same_name

#: Parts of layer names that mark conductors; attributes that describe an item of a bill of materials, the first one present counts.
CONDUCTORS = ("WIRE", "BUS", "NET", "CONDUCTOR", "CABLE_RUN")
SPEC_KEYS = ["RATING_A", "SIZE_SQMM", "VALUE_OHM", "VALUE_UF", "LOAD_W", "PART"]


def of_types(types: str) -> Column:
    """True for entities of a comma-separated list of types; POLYLINE stands for both of its forms."""
    names = {t.strip().upper() for t in types.split(",")}
    return F.col("type").isin(sorted(names | ({"LWPOLYLINE"} if "POLYLINE" in names else set())))


def chosen(entities: DataFrame, entity_type: str | None = None, layer: str | None = None) -> DataFrame:
    if entity_type:
        entities = entities.where(of_types(entity_type))
    if layer:
        entities = entities.where(F.upper("layer") == layer.strip().upper())
    return entities


def layers(entities: DataFrame) -> DataFrame:
    """drawing_id, layer, n and ``types``, the counts by type."""
    each = entities.groupBy("drawing_id", "layer", "type").agg(F.count(F.lit(1)).alias("k"))
    types = F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "k"))))
    return each.groupBy("drawing_id", "layer").agg(F.sum("k").alias("n"), types.alias("types"))


def blocks(entities: DataFrame) -> DataFrame:
    """drawing_id, block, n and its sorted attribute names."""
    inserts = entities.where("type = 'INSERT'")
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys(F.coalesce("attribs", F.create_map().cast("map<string,string>")))))))
    return inserts.groupBy("drawing_id", "block").agg(F.count(F.lit(1)).alias("n"), names.alias("attributes"))


def domains(entities: DataFrame) -> DataFrame:
    """drawing_id, domain: what kind of drawing it is, by layers, blocks and circles."""
    layer = F.upper("layer")
    seen = entities.groupBy("drawing_id").agg(
        F.bool_or((F.col("type") == "INSERT") & (F.size(F.coalesce("attribs", F.create_map().cast("map<string,string>"))) > 0)).alias("tagged"),
        F.bool_or(layer.rlike("|".join(CONDUCTORS))).alias("wired"),
        F.bool_or(layer == "ROOMS").alias("rooms"),
        F.bool_or(layer == "WALLS").alias("walls"),
        F.bool_or(F.coalesce("closed", F.lit(False))).alias("shut"),
        F.bool_or(layer == "HOLES").alias("holes"),
        F.count_if(F.col("type") == "CIRCLE").alias("circles"),
    )
    domain = (
        F.when(F.col("tagged") & F.col("wired"), "electrical/electronic schematic")
        .when(F.col("rooms") | (F.col("walls") & F.col("shut")), "building floor plan")
        .when(F.col("holes") | (F.col("circles") >= 3), "mechanical part")
        .otherwise("general drawing")
    )
    return seen.select("drawing_id", domain.alias("domain"))


def texts(entities: DataFrame) -> DataFrame:
    """drawing_id and its texts that are not blank, in file order."""
    said = entities.where(F.trim(F.regexp_replace("text", r"\s", " ")) != "").groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("t"))
    return said.select("drawing_id", F.transform("t", lambda x: x["text"]).alias("texts"))


def summary(entities: DataFrame, sheets: DataFrame) -> DataFrame:
    """One row per drawing: units, extents, domain, entities, texts, and counts by layer, type and block, the most frequent first."""
    def counted(key: str, rows: DataFrame) -> DataFrame:
        each = rows.groupBy("drawing_id", key).agg(F.count(F.lit(1)).alias("n"))
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), F.col(key).alias("name"))))
        return each.groupBy("drawing_id").agg(F.transform(ordered, lambda x: F.struct(x["name"].alias("name"), (-x["r"]).alias("n"))).alias(f"by_{key}"))

    size = entities.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n_entities"))
    out = sheets.select("drawing_id", "units", "extents", "warnings").join(size, "drawing_id", "left").join(domains(entities), "drawing_id", "left").join(texts(entities), "drawing_id", "left")
    for key, rows in (("layer", entities), ("type", entities), ("block", entities.where("type = 'INSERT'"))):
        out = out.join(counted(key, rows), "drawing_id", "left")
    return out


def count_entities(entities: DataFrame, entity_type: str | None = None, layer: str | None = None, block_name: str | None = None, diameter: float | None = None, text_contains: str | None = None) -> DataFrame:
    """drawing_id, n of entities that pass every filter given; drawings without any are absent."""
    rows = chosen(entities, entity_type, layer)
    if block_name:
        rows = rows.where(same_name(F.col("block"), F.lit(block_name)))
    if diameter is not None:
        rows = rows.where(same_diameter(F.col("radius"), F.lit(float(diameter))))
    if text_contains:
        rows = rows.where(contains_text(F.col("text"), F.lit(text_contains)))
    return rows.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n"))


def total_length(entities: DataFrame, sheets: DataFrame, layer: str | None = None, entity_type: str | None = None) -> DataFrame:
    """drawing_id, total_length in drawing units, entities_counted (those with a length) and total_length_m."""
    sums = chosen(entities, entity_type, layer).groupBy("drawing_id").agg(F.sum(F.coalesce("length", F.lit(0.0))).alias("total"), F.count("length").alias("entities_counted"))
    named = sums.join(sheets.select("drawing_id", "to_m"), "drawing_id")
    return named.select("drawing_id", F.round("total", 3).alias("total_length"), "entities_counted", F.round(F.col("total") * F.col("to_m"), 3).alias("total_length_m"))


def find_text(entities: DataFrame, pattern: str, layer: str | None = None) -> DataFrame:
    """drawing_id, ordinal, layer, text of every text that contains the pattern."""
    rows = chosen(entities, layer=layer).where(F.col("type").isin("TEXT", "MTEXT") & contains_text(F.col("text"), F.lit(pattern)))
    return rows.select("drawing_id", "ordinal", "layer", "text")


def dimensions(entities: DataFrame) -> DataFrame:
    """drawing_id, ordinal, value, layer."""
    return entities.where("type = 'DIMENSION'").select("drawing_id", "ordinal", F.round("measurement", 3).alias("value"), "layer")


def circles(entities: DataFrame, layer: str | None = None) -> DataFrame:
    """drawing_id, diameter, n, area: circles by diameter."""
    rows = chosen(entities, "CIRCLE", layer).groupBy("drawing_id", F.round(2 * F.col("radius"), 6).alias("d"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 3).alias("area")).select("drawing_id", F.round("d", 3).alias("diameter"), "n", "area")


def in_window(entities: DataFrame, x_min: float, y_min: float, x_max: float, y_max: float, layer: str | None = None) -> DataFrame:
    """drawing_id, layer, type, n of anchors in a closed box; rows with a null layer or type are subtotals."""
    rows = chosen(entities, layer=layer).where(F.col("cx").between(x_min, x_max) & F.col("cy").between(y_min, y_max))
    sets = [[F.col("drawing_id"), F.col("layer")], [F.col("drawing_id"), F.col("type")], [F.col("drawing_id")]]
    return rows.groupingSets(sets, "drawing_id", "layer", "type").agg(F.count(F.lit(1)).alias("n")).select("drawing_id", "layer", "type", "n")


def layer_extents(entities: DataFrame, layer: str) -> DataFrame:
    """drawing_id, width, height of all that is on a layer; drawings without such a layer are absent."""
    rows = chosen(entities, layer=layer).where("x_min IS NOT NULL").groupBy("drawing_id")
    return rows.agg(F.round(F.max("x_max") - F.min("x_min"), 3).alias("width"), F.round(F.max("y_max") - F.min("y_min"), 3).alias("height"))


def with_attribute(parts: DataFrame, component_type: str | None = None, attribute: str | None = None, value: str | None = None) -> DataFrame:
    """The components of a type that have an attribute, or have it equal to a value as text without case or as a number."""
    if component_type:
        parts = parts.where(same_name(F.col("type"), F.lit(component_type)))
    if attribute:
        held = F.element_at("attribs", attribute.strip().upper())
        fits = held.isNotNull()
        if value is not None:
            fits = (F.upper(held) == F.upper(F.lit(value))) | F.coalesce(number(held) == number(F.lit(value)), F.lit(False))
        parts = parts.where(fits)
    return parts


def component_details(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """drawing_id, tag, type, attribs and the sorted tags that share a net with it."""
    near = edges.groupBy("drawing_id", F.col("a").alias("tag")).agg(F.array_sort(F.collect_set("b")).alias("connected_to"))
    return parts.select("drawing_id", "tag", "type", "attribs").join(near, ["drawing_id", "tag"], "left").withColumn("connected_to", F.coalesce("connected_to", F.array().cast("array<string>")))


def bill_of_materials(parts: DataFrame) -> DataFrame:
    """drawing_id, type, spec such as ``RATING_A=32`` (empty without any), qty."""
    spec = F.coalesce(*[F.when(F.element_at("attribs", k) != "", F.concat(F.lit(f"{k}="), F.element_at("attribs", k))) for k in SPEC_KEYS], F.lit(""))
    return parts.groupBy("drawing_id", "type", spec.alias("spec")).agg(F.count(F.lit(1)).alias("qty"))


def sum_attribute(parts: DataFrame, attribute: str, component_type: str | None = None) -> DataFrame:
    """drawing_id, n, total, largest, smallest of an attribute's numbers; drawings without any have n 0, total 0 and nulls."""
    v = number(F.element_at("attribs", attribute.strip().upper()))
    typed = F.lit(True) if component_type is None else same_name(F.col("type"), F.lit(component_type))
    v = F.when(typed, v)
    return parts.groupBy("drawing_id").agg(F.count(v).alias("n"), F.round(F.coalesce(F.sum(v), F.lit(0.0)), 3).alias("total"), F.max(v).alias("largest"), F.min(v).alias("smallest"))


def largest_rooms(regions: DataFrame, smallest: bool = False) -> DataFrame:
    """The room of each drawing with the largest (or smallest) area, of equal ones the first in file order."""
    size = F.col("area") if smallest else -F.col("area")
    return regions.groupBy("drawing_id").agg(F.min_by("label", F.struct(size, "region")).alias("label"), (F.min if smallest else F.max)("area_m2").alias("area_m2"))
