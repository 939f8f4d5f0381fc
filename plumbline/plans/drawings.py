"""Queries over the drawings of ``drawn``, each through the library's operator, with an oracle told from the tables alone."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.geometry import general, number, rounded
from plumbline.operators import measures, netlist, spatial, textual
from plumbline.plans.drawn import drawn, rooms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ROOMS_SQL = """
rooms AS (SELECT *, CASE WHEN i = 5 THEN 'CORRIDOR' ELSE kind || ' ' || i END AS name, i * 10 AS region FROM (
  SELECT 'plan-' || (p_partkey // 24) AS drawing_id, p_partkey AS k, (p_partkey % 24) AS i, ['BEDROOM', 'LIVING', 'KITCHEN', 'STUDY', 'BATH', 'CORRIDOR', 'STORE'][(p_partkey % 24) % 7 + 1] AS kind,
    (p_partkey % 24 % 6 * 9000)::DOUBLE AS x, ((p_partkey % 24) // 6 * 9000)::DOUBLE AS y, (p_size * 100 + 1000)::DOUBLE AS w, (p_partkey % 31 * 100 + 1800)::DOUBLE AS h FROM part)),
named AS (SELECT *, CASE WHEN i % 7 = 6 THEN name || ' / note ' || i ELSE name END AS label FROM rooms)
"""
BOARDS_SQL = """
mcb AS (SELECT 'db-' || (c_custkey // 20) AS drawing_id, c_custkey // 20 AS b, c_custkey % 20 AS p, c_custkey AS c, 'C' || (c_custkey % 20 + 1) AS tag, 'W' || (c_custkey % 20 + 1) AS cable, CASE WHEN c_custkey % 3 <> 0 THEN 'K' || (c_custkey % 20 + 1) END AS rcd,
  ['LIGHT', 'SOCKET', 'AC_UNIT', 'WATER_HEATER'][c_custkey % 4 + 1] AS kind, [6, 10, 16, 20, 32][c_custkey % 5 + 1] AS rating, [1.5, 2.5, 4, 6, 10][c_custkey // 5 % 5 + 1]::DOUBLE AS size, c_custkey % 70 + 5 AS length,
  CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 7 = 0 THEN 100 ELSE 30 END END AS ma FROM customer),
lamp AS (SELECT drawing_id, c, p, kind, 'L' || o_orderkey AS tag, o_orderkey % 1500 + 40 AS w, mcb.tag AS root, cable, rcd FROM orders JOIN mcb ON c = o_custkey),
board AS (SELECT DISTINCT drawing_id, b FROM mcb),
sums AS (SELECT mcb.*, count(lamp.tag) AS n, coalesce(sum(lamp.w), 0)::DOUBLE AS total FROM mcb LEFT JOIN lamp ON lamp.c = mcb.c GROUP BY ALL),
ckt AS (SELECT 'ckt-' || (s_suppkey // 10) AS drawing_id, s_suppkey AS s, s_suppkey % 10 AS n, ['R', 'C', 'D'][s_suppkey % 3 + 1] || (s_suppkey % 10) AS tag, ['RESISTOR', 'CAPACITOR', 'LED'][s_suppkey % 3 + 1] AS type FROM supplier),
net AS (SELECT drawing_id, 'in' AS net, unnest(['SUP1', 'MAIN']) AS tag FROM board UNION ALL SELECT drawing_id, 'bus', 'MAIN' FROM board UNION ALL SELECT drawing_id, 'bus', tag FROM mcb
  UNION ALL SELECT drawing_id, 'a' || p, unnest([tag, cable]) FROM mcb UNION ALL SELECT drawing_id, 'b' || p, unnest([cable, rcd]) FROM mcb WHERE rcd IS NOT NULL
  UNION ALL SELECT drawing_id, 'c' || p, coalesce(rcd, cable) FROM mcb UNION ALL SELECT drawing_id, 'c' || p, tag FROM lamp
  UNION ALL SELECT drawing_id, unnest(['top', 'low']), tag FROM ckt),
near AS (SELECT DISTINCT x.drawing_id, x.tag AS a, y.tag AS b FROM net AS x JOIN net AS y ON x.drawing_id = y.drawing_id AND x.net = y.net AND x.tag <> y.tag),
part_list AS (SELECT drawing_id, tag, 'MCB' AS type FROM mcb UNION ALL SELECT drawing_id, cable, 'CABLE' FROM mcb UNION ALL SELECT drawing_id, rcd, 'RCD' FROM mcb WHERE rcd IS NOT NULL UNION ALL SELECT drawing_id, tag, kind FROM lamp
  UNION ALL SELECT drawing_id, 'SUP1', 'Supply' FROM board UNION ALL SELECT drawing_id, 'MAIN', 'MAIN_SWITCH' FROM board UNION ALL SELECT drawing_id, 'X9', 'METER' FROM board UNION ALL SELECT drawing_id, tag, type FROM ckt),
below AS (SELECT drawing_id, 'SUP1' AS root, tag FROM part_list WHERE type NOT IN ('Supply', 'METER', 'RESISTOR', 'CAPACITOR', 'LED') UNION ALL SELECT drawing_id, 'MAIN', tag FROM part_list WHERE type NOT IN ('Supply', 'METER', 'MAIN_SWITCH', 'RESISTOR', 'CAPACITOR', 'LED')
  UNION ALL SELECT drawing_id, tag, cable FROM mcb UNION ALL SELECT drawing_id, tag, rcd FROM mcb WHERE rcd IS NOT NULL UNION ALL SELECT drawing_id, root, tag FROM lamp
  UNION ALL SELECT drawing_id, cable, rcd FROM mcb WHERE rcd IS NOT NULL UNION ALL SELECT drawing_id, cable, tag FROM lamp UNION ALL SELECT drawing_id, rcd, tag FROM lamp WHERE rcd IS NOT NULL)
"""
PLATES_SQL = "hole AS (SELECT 'brk-' || (s_suppkey // 10) AS drawing_id, s_suppkey // 10 AS d, s_suppkey % 10 AS n, (s_suppkey % 4 + 3)::DOUBLE AS r FROM supplier)"


def _query(oracle: str | None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + oracle
        return f

    return add


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


@_query("SELECT drawing_id, region, label, round(w * h / 1e6, 3) AS area_m2 FROM named WHERE kind IN ('BEDROOM', 'BATH')", ROOMS_SQL)
def regions_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = drawn(spark, sf_dir)
    found = [spatial.labeled_regions(f.entities, f.sheets, " rooms ", word) for word in ("bedroom", "Bath")]
    return found[0].unionByName(found[1]).select("drawing_id", "region", "label", "area_m2")


@_query("SELECT drawing_id, region, label, 'ROOMS' AS layer, round(w, 3) AS width, round(h, 3) AS height, least(w, h) AS min_side, w * h AS area, 'mm^2' AS area_units, round(w * h / 1e6, 3) AS area_m2 FROM named", ROOMS_SQL)
def labeled_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = drawn(spark, sf_dir)
    return spatial.labeled_regions(f.entities, f.sheets, "rooms").withColumn("region", F.col("region").cast("long"))


@_query("SELECT drawing_id, i * 10 + 3 AS ordinal, 'Door' AS block, 'DOORS' AS layer, (k % 5 * 50 + 650)::DOUBLE AS scale, 0.0::DOUBLE AS rotation, x + 300 AS x, y, label AS in_region FROM named", ROOMS_SQL)
def block_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = drawn(spark, sf_dir)
    return spatial.block_inserts(f.entities, f.sheets, "DOOR").withColumn("ordinal", F.col("ordinal").cast("long"))


@_query("""SELECT drawing_id, i * 10 + 3 AS ordinal, (i % 4 * 90)::DOUBLE AS rotation, CASE WHEN i % 4 IN (1, 2) THEN x + w ELSE x END AS x, CASE WHEN i % 4 IN (2, 3) THEN y + h ELSE y END AS y,
  CASE WHEN k % 5 <> 4 THEN label END AS in_region FROM named""", ROOMS_SQL)
def turned_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doors turned by quarters, each set at the corner from which it opens into its room; every fifth is turned by a half more and opens into none."""
    e = drawn(spark, sf_dir).entities.where("layer IN ('ROOMS', 'ROOM_NAMES', 'DOORS')")
    quarter = F.col("i") % 4
    at = rooms(spark, sf_dir).select(
        "drawing_id", (F.col("i") * 10 + 3).alias("ordinal"), (quarter * 90 + F.when(F.col("k") % 5 == 4, 180).otherwise(0)).cast("double").alias("rotation"),
        F.when(quarter.isin(1, 2), F.col("x") + F.col("w")).otherwise(F.col("x")).alias("cx"), F.when(quarter.isin(2, 3), F.col("y") + F.col("h")).otherwise(F.col("y")).alias("cy"),
    )
    doors = e.where("layer = 'DOORS'").drop("rotation", "cx", "cy").join(at, ["drawing_id", "ordinal"]).select(*e.columns)
    found = spatial.block_inserts(e.where("layer <> 'DOORS'").unionByName(doors), drawn(spark, sf_dir).sheets, "door")
    # the half turn is taken off again, so that the angle tells the corner
    turned = F.when(F.col("in_region").isNull(), F.col("rotation") - 180).otherwise(F.col("rotation"))
    return found.select("drawing_id", *_long("ordinal"), turned.alias("rotation"), "x", "y", "in_region")


@_query("SELECT drawing_id, region, label, CASE WHEN k % 3 <> 0 THEN 1 ELSE 0 END::BIGINT AS n FROM named", ROOMS_SQL)
def count_per_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = drawn(spark, sf_dir)
    return spatial.count_per_region(f.entities, f.sheets, "Windows", "ROOMS").select("drawing_id", *_long("region"), "label", F.col("count").cast("long").alias("n"))


@_query("""SELECT 'polyline' AS what, drawing_id, 2 * count(*) AS n FROM rooms GROUP BY drawing_id UNION ALL SELECT 'polyline', drawing_id, count(DISTINCT c) FROM lamp GROUP BY drawing_id UNION ALL SELECT DISTINCT 'polyline', drawing_id, 1::BIGINT FROM hole
  UNION ALL SELECT 'lines and circles', drawing_id, count(*) + count_if(k % 3 <> 0) FROM rooms GROUP BY drawing_id UNION ALL SELECT 'lines and circles', drawing_id, count(*) FROM hole GROUP BY drawing_id UNION ALL SELECT 'lines and circles', drawing_id, 2 + 2 * count(*) FROM ckt GROUP BY drawing_id
  UNION ALL SELECT 'lines and circles', drawing_id, any_value(m) + coalesce(any_value(l), 0) FROM (SELECT drawing_id, 2 + 3 * count(*) + count(rcd) AS m FROM mcb GROUP BY drawing_id) LEFT JOIN (SELECT drawing_id, count(*) AS l FROM lamp GROUP BY drawing_id) USING (drawing_id) GROUP BY drawing_id
  UNION ALL SELECT 'windows', drawing_id, count(*) FROM rooms WHERE k % 3 <> 0 GROUP BY drawing_id UNION ALL SELECT 'breakers', drawing_id, count(*) FROM mcb GROUP BY drawing_id
  UNION ALL SELECT 'eight', drawing_id, count(*) FROM hole WHERE r = 4 GROUP BY drawing_id UNION ALL SELECT 'notes', drawing_id, count(*) FROM rooms WHERE i % 7 = 6 GROUP BY drawing_id""", ROOMS_SQL, BOARDS_SQL, PLATES_SQL)
def count_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = drawn(spark, sf_dir).entities
    asked = {"polyline": {"entity_type": "polyline"}, "lines and circles": {"entity_type": "LINE, circle"}, "windows": {"layer": " windows "}, "breakers": {"block_name": "mcb"}, "eight": {"diameter": 8.0}, "notes": {"text_contains": "NOTE"}}
    return reduce(DataFrame.unionByName, [measures.count_entities(e, **a).select(F.lit(name).alias("what"), "drawing_id", "n") for name, a in asked.items()])


@_query("""SELECT 'walls' AS what, drawing_id, sum(2 * w + h) AS total_length, 2 * count(*) AS entities_counted, round(sum(2 * w + h) * 0.001, 3) AS total_length_m FROM rooms GROUP BY drawing_id
  UNION ALL SELECT 'circles', drawing_id, round(sum(2 * pi() * r), 3), count(*), round(sum(2 * pi() * r) * 0.0254, 3) FROM hole GROUP BY drawing_id""", ROOMS_SQL, PLATES_SQL)
def total_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = drawn(spark, sf_dir)
    return reduce(DataFrame.unionByName, [measures.total_length(f.entities, f.sheets, layer, kind).withColumn("what", F.lit(name)) for name, layer, kind in (("walls", "walls", None), ("circles", None, "CIRCLE"))])


@_query("SELECT drawing_id, i * 10 + 1 AS ordinal, 'ROOM_NAMES' AS layer, name AS text FROM rooms WHERE contains(name, 'BED') OR contains(name, 'B') AND contains(name, 'ED')", ROOMS_SQL)
def find_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.find_text(drawn(spark, sf_dir).entities, "bed", "room_names").withColumn("ordinal", F.col("ordinal").cast("long"))


@_query("SELECT drawing_id, i * 10 + 7 AS ordinal, w AS value, 'DIMENSIONS' AS layer FROM rooms", ROOMS_SQL)
def list_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.dimensions(drawn(spark, sf_dir).entities).withColumn("ordinal", F.col("ordinal").cast("long"))


@_query("SELECT drawing_id, 2 * r AS diameter, count(*) AS n, round(sum(pi() * r * r), 3) AS area FROM hole GROUP BY drawing_id, r", PLATES_SQL)
def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.circles(drawn(spark, sf_dir).entities, "holes")


@_query("""SELECT drawing_id, layer, type, count(*) AS n FROM (SELECT drawing_id, unnest([struct_pack(layer := 'DOORS', type := NULL), struct_pack(layer := NULL, type := 'INSERT'), struct_pack(layer := NULL, type := NULL)], recursive := true)
  FROM rooms WHERE x + 300 BETWEEN 9300 AND 30000 AND y BETWEEN 9000 AND 18000) GROUP BY ALL""", ROOMS_SQL)
def entities_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.in_window(drawn(spark, sf_dir).entities, 9300.0, 9000.0, 30000.0, 18000.0, "doors")


@_query("SELECT drawing_id, max(x + w) - min(x) AS width, max(y + h) - min(y) AS height FROM rooms GROUP BY drawing_id", ROOMS_SQL)
def layer_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.layer_extents(drawn(spark, sf_dir).entities, "WALLS")


@_query("""SELECT drawing_id, 'WALLS' AS layer, 2 * count(*) AS n, 'LINE=' || count(*) || ' LWPOLYLINE=' || count(*) AS types FROM rooms GROUP BY drawing_id
  UNION ALL SELECT drawing_id, unnest(['ROOMS', 'DOORS', 'DIMENSIONS']), count(*), unnest(['LWPOLYLINE', 'INSERT', 'DIMENSION']) || '=' || count(*) FROM rooms GROUP BY drawing_id
  UNION ALL SELECT drawing_id, 'ROOM_NAMES', count(*) + count_if(i % 7 = 6), CASE WHEN count_if(i % 7 = 6) > 0 THEN 'MTEXT=' || count_if(i % 7 = 6) || ' ' ELSE '' END || 'TEXT=' || count(*) FROM rooms GROUP BY drawing_id
  UNION ALL SELECT drawing_id, 'WINDOWS', count(*), 'LINE=' || count(*) FROM rooms WHERE k % 3 <> 0 GROUP BY drawing_id
  UNION ALL SELECT drawing_id, 'HOLES', count(*), 'CIRCLE=' || count(*) FROM hole GROUP BY drawing_id UNION ALL SELECT DISTINCT drawing_id, 'OUTLINE', 1::BIGINT, 'POLYLINE=1' FROM hole""", ROOMS_SQL, PLATES_SQL)
def list_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = drawn(spark, sf_dir).entities
    sheets = e.where(F.startswith("drawing_id", F.lit("plan-")) | F.startswith("drawing_id", F.lit("brk-")))
    types = F.array_join(F.transform(F.array_sort(F.map_entries("types")), lambda t: F.concat(t["key"], F.lit("="), t["value"].cast("string"))), " ")
    return measures.layers(sheets).select("drawing_id", "layer", "n", types.alias("types"))


@_query("""SELECT drawing_id, type AS block, count(*) AS n, CASE type WHEN 'MCB' THEN 'CURVE RATING_A TAG' WHEN 'CABLE' THEN 'LENGTH_M SIZE_SQMM TAG' WHEN 'RCD' THEN 'SENS_MA TAG' WHEN 'Supply' THEN 'TAG VOLTAGE_V' WHEN 'MAIN_SWITCH' THEN 'RATING_A TAG' WHEN 'METER' THEN 'REF'
  WHEN 'RESISTOR' THEN 'TAG VALUE_OHM' WHEN 'CAPACITOR' THEN 'TAG VALUE_UF' WHEN 'LED' THEN 'COLOR TAG' ELSE 'LOAD_W TAG' END AS attributes FROM part_list GROUP BY drawing_id, type UNION ALL SELECT drawing_id, 'Door', count(*), '' FROM rooms GROUP BY drawing_id""", ROOMS_SQL, BOARDS_SQL)
def block_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.blocks(drawn(spark, sf_dir).entities).select("drawing_id", "block", "n", F.array_join("attributes", " ").alias("attributes"))


@_query("""SELECT drawing_id, 'mm' AS units, 'building floor plan' AS domain, 6 * count(*) + count_if(i % 7 = 6) + count_if(k % 3 <> 0) AS n_entities, count(*) + count_if(i % 7 = 6) AS n_texts, 'RN'[2:1] || 'NAMES' AS hint FROM rooms GROUP BY drawing_id
  UNION ALL SELECT drawing_id, 'mm', 'electrical/electronic schematic', 2 + 3 * count(*), 0, 'NAMES' FROM ckt GROUP BY drawing_id UNION ALL SELECT drawing_id, 'in', 'mechanical part', 1 + count(*), 0, 'NAMES' FROM hole GROUP BY drawing_id
  UNION ALL SELECT drawing_id, 'mm', 'electrical/electronic schematic', 5 + 5 * count(*) + 2 * count(rcd) + count_if(n > 0) + (2 * sum(n))::BIGINT, 0, 'NAMES' FROM sums GROUP BY drawing_id""", ROOMS_SQL, BOARDS_SQL, PLATES_SQL)
def drawing_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = drawn(spark, sf_dir)
    return measures.summary(f.entities, f.sheets).select("drawing_id", "units", "domain", "n_entities", F.size(F.coalesce("texts", F.array().cast("array<string>"))).cast("long").alias("n_texts"), F.lit("NAMES").alias("hint"))


@_query("""SELECT drawing_id, any_value(texts) AS texts, string_agg(name || '=' || n, ' ' ORDER BY n DESC, name) FILTER (what = 'layer') AS by_layer, string_agg(name || '=' || n, ' ' ORDER BY n DESC, name) FILTER (what = 'type') AS by_type, string_agg(name || '=' || n, ' ') FILTER (what = 'block') AS by_block
FROM (SELECT drawing_id, texts, unnest([{'what': 'layer', 'name': 'ROOMS', 'n': n}, {'what': 'layer', 'name': 'ROOM_NAMES', 'n': n + m}, {'what': 'layer', 'name': 'DOORS', 'n': n}, {'what': 'layer', 'name': 'WINDOWS', 'n': w}, {'what': 'layer', 'name': 'WALLS', 'n': 2 * n}, {'what': 'layer', 'name': 'DIMENSIONS', 'n': n},
  {'what': 'type', 'name': 'LWPOLYLINE', 'n': 2 * n}, {'what': 'type', 'name': 'TEXT', 'n': n}, {'what': 'type', 'name': 'MTEXT', 'n': m}, {'what': 'type', 'name': 'INSERT', 'n': n}, {'what': 'type', 'name': 'LINE', 'n': n + w}, {'what': 'type', 'name': 'DIMENSION', 'n': n}, {'what': 'block', 'name': 'Door', 'n': n}], recursive := true)
  FROM (SELECT drawing_id, count(*) AS n, count_if(i % 7 = 6) AS m, count_if(k % 3 <> 0) AS w, string_agg(label, ' / ' ORDER BY i) AS texts FROM named GROUP BY drawing_id)) WHERE n > 0 GROUP BY drawing_id""", ROOMS_SQL)
def drawing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = drawn(spark, sf_dir)
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit("="), x["n"].cast("string"))), " ").alias(c)
    plans = measures.summary(f.entities, f.sheets).where("domain = 'building floor plan'")
    return plans.select("drawing_id", F.array_join("texts", " / ").alias("texts"), said("by_layer"), said("by_type"), said("by_block"))


@_query("""SELECT drawing_id, 'UNITS: in' || chr(10) || 'POLYLINE OUTLINE closed (0,0) (200,0) (200,' || (any_value(d) % 5 * 10 + 50) || ') (0,' || (any_value(d) % 5 * 10 + 50) || ')' || chr(10) || string_agg('CIRCLE HOLES c=(' || (n * 18 + 15) || '.0,20.0) r=' || r::INT || '.00', chr(10) ORDER BY n) AS dump,
  'Drawing ' || drawing_id || ': mechanical part (in), ' || (count(*) + 1) || ' entities.' || chr(10) || 'Extents: 200.0 x ' || (any_value(d) % 5 * 10 + 50) || '.0 in.' || chr(10) || CASE WHEN count(*) > 1 THEN 'Layers: HOLES (' || count(*) || '), OUTLINE (1)' ELSE 'Layers: HOLES (1), OUTLINE (1)' END || chr(10)
  || 'Entity types: CIRCLE (' || count(*) || '), POLYLINE (1)' || chr(10) || 'Text: ' AS overview FROM hole GROUP BY drawing_id""", PLATES_SQL)
def plate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = drawn(spark, sf_dir)
    plates = F.startswith("drawing_id", F.lit("brk-"))
    e, s = f.entities.where(plates), f.sheets.where(plates)
    return textual.compact(e, s).select("drawing_id", F.col("text").alias("dump")).join(textual.overview(e, s).select("drawing_id", F.col("text").alias("overview")), "drawing_id")


@_query("SELECT drawing_id, arg_max(label, struct_pack(a := w * h, r := -region)) AS largest, round(max(w * h) / 1e6, 3) AS largest_m2, arg_min(label, struct_pack(a := w * h, r := region)) AS smallest FROM named GROUP BY drawing_id", ROOMS_SQL)
def extreme_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = drawn(spark, sf_dir)
    regions = spatial.labeled_regions(f.entities, f.sheets, "ROOMS")
    large = measures.largest_rooms(regions).select("drawing_id", F.col("label").alias("largest"), F.col("area_m2").alias("largest_m2"))
    return large.join(measures.largest_rooms(regions, True).select("drawing_id", F.col("label").alias("smallest")), "drawing_id")


@_query("SELECT drawing_id, tag, type FROM part_list", BOARDS_SQL)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn(spark, sf_dir).parts.select("drawing_id", "tag", "type")


@_query("SELECT drawing_id, cable AS tag, '4' AS size FROM mcb WHERE size = 4", BOARDS_SQL)
def components_by_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measures.with_attribute(drawn(spark, sf_dir).parts, "cable", " size_sqmm", "4.0")
    return found.select("drawing_id", "tag", F.element_at("attribs", "SIZE_SQMM").alias("size"))


@_query("SELECT p.drawing_id, p.tag, any_value(p.type) AS type, count(b) AS n, coalesce(string_agg(b, ' ' ORDER BY b), '') AS connected_to FROM part_list AS p LEFT JOIN near ON near.drawing_id = p.drawing_id AND a = tag GROUP BY ALL", BOARDS_SQL)
def connected_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = drawn(spark, sf_dir)
    return measures.component_details(f.parts, f.edges).select("drawing_id", "tag", "type", F.size("connected_to").cast("long").alias("n"), F.array_join("connected_to", " ").alias("connected_to"))


@_query("""SELECT drawing_id, 'MCB' AS type, 'RATING_A=' || rating AS spec, count(*) AS qty FROM mcb GROUP BY ALL UNION ALL SELECT drawing_id, 'CABLE', 'SIZE_SQMM=' || CASE WHEN size = size::INT THEN size::INT::VARCHAR ELSE size::VARCHAR END, count(*) FROM mcb GROUP BY ALL
  UNION ALL SELECT drawing_id, 'RCD', '', count(*) FROM mcb WHERE rcd IS NOT NULL GROUP BY ALL UNION ALL SELECT drawing_id, kind, 'LOAD_W=' || format('{:,}', w), count(*) FROM lamp GROUP BY ALL
  UNION ALL SELECT drawing_id, unnest(['Supply', 'METER']), '', 1 FROM board UNION ALL SELECT drawing_id, 'MAIN_SWITCH', 'RATING_A=' || [50, 63, 80, 100][b % 4 + 1], 1 FROM board
  UNION ALL SELECT drawing_id, type, CASE type WHEN 'RESISTOR' THEN 'VALUE_OHM=' || s * 10 WHEN 'CAPACITOR' THEN 'VALUE_UF=' || (s / 10)::VARCHAR ELSE '' END, count(*) FROM ckt GROUP BY ALL""", BOARDS_SQL)
def bill_of_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.bill_of_materials(drawn(spark, sf_dir).parts)


@_query("""SELECT 'load' AS what, d.drawing_id, count(w) AS n, coalesce(sum(w), 0)::DOUBLE AS total, max(w)::DOUBLE AS largest, min(w)::DOUBLE AS smallest FROM (SELECT DISTINCT drawing_id FROM part_list) AS d LEFT JOIN lamp USING (drawing_id) GROUP BY d.drawing_id
  UNION ALL SELECT 'cable', d.drawing_id, count(length), coalesce(sum(length), 0)::DOUBLE, max(length)::DOUBLE, min(length)::DOUBLE FROM (SELECT DISTINCT drawing_id FROM part_list) AS d LEFT JOIN mcb USING (drawing_id) GROUP BY d.drawing_id""", BOARDS_SQL)
def sum_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = drawn(spark, sf_dir).parts
    return measures.sum_attribute(parts, "load_w").withColumn("what", F.lit("load")).unionByName(measures.sum_attribute(parts, "LENGTH_M", "cable").withColumn("what", F.lit("cable")))


@_query("SELECT drawing_id, string_agg(tag, ' ' ORDER BY tag) AS members FROM net GROUP BY drawing_id, net HAVING count(*) > 1", BOARDS_SQL)
def nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return netlist.nets(drawn(spark, sf_dir).attached).select("drawing_id", F.array_join("members", " ").alias("members"))


@_query("""SELECT drawing_id, tag, CASE type WHEN 'Supply' THEN 0 WHEN 'MAIN_SWITCH' THEN 1 WHEN 'MCB' THEN 2 WHEN 'CABLE' THEN 3 WHEN 'RCD' THEN 4 END::BIGINT AS dist FROM part_list WHERE type IN ('Supply', 'MAIN_SWITCH', 'MCB', 'CABLE', 'RCD')
  UNION ALL SELECT drawing_id, tag, CASE WHEN rcd IS NULL THEN 4 ELSE 5 END FROM lamp""", BOARDS_SQL)
def supply_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = drawn(spark, sf_dir)
    return f.distances.select("drawing_id", "tag", F.col("dist").cast("long").alias("dist"))


@_query("SELECT below.drawing_id, below.root, count(*) AS n, coalesce(sum(w), 0)::DOUBLE AS total FROM below LEFT JOIN lamp ON lamp.drawing_id = below.drawing_id AND lamp.tag = below.tag GROUP BY below.drawing_id, below.root", BOARDS_SQL)
def downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = drawn(spark, sf_dir)
    fed = f.below.join(f.parts.select("drawing_id", "tag", number(F.element_at("attribs", "LOAD_W")).alias("w")), ["drawing_id", "tag"])
    return fed.groupBy("drawing_id", "root").agg(F.count(F.lit(1)).alias("n"), rounded(F.coalesce(F.sum("w"), F.lit(0.0))).alias("total"))


@_query("""SELECT drawing_id, tag, 'CABLE=1' || CASE WHEN n > 0 AND kind < 'CABLE' THEN '' ELSE '' END || CASE WHEN rcd IS NULL THEN '' ELSE ' RCD=1' END AS devices, CASE WHEN n > 0 THEN kind || '=' || n ELSE '' END AS loads, total, size, ma::DOUBLE AS ma, rating::DOUBLE AS rating FROM sums""", BOARDS_SQL)
def downstream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drawn(spark, sf_dir).circuits
    entries = F.array_sort(F.map_entries("feeds"))
    said = lambda keep: F.array_join(F.transform(F.filter(entries, lambda e: keep(e["key"])), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    of = lambda column, name: number(F.element_at(F.col(column), name))
    return rows.select("drawing_id", "tag", said(lambda k: k.isin("CABLE", "RCD")).alias("devices"), said(lambda k: ~k.isin("CABLE", "RCD")).alias("loads"), "total", of("cable", "SIZE_SQMM").alias("size"), of("rcd", "SENS_MA").alias("ma"), of("own", "RATING_A").alias("rating"))


@_query("SELECT drawing_id, tag AS b, 'MAIN>' || root || '>' || cable || '>' || CASE WHEN rcd IS NULL THEN '' ELSE rcd || '>' END || tag AS path, CASE WHEN rcd IS NULL THEN 3 ELSE 4 END::BIGINT AS hops FROM lamp UNION ALL SELECT drawing_id, 'MAIN', 'MAIN', 0 FROM board", BOARDS_SQL)
def path_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = drawn(spark, sf_dir)
    loads = f.parts.where(F.element_at("attribs", "LOAD_W").isNotNull() | (F.col("tag") == "MAIN") | (F.col("tag") == "X9"))
    wanted = loads.select("drawing_id", F.lit("MAIN").alias("a"), F.col("tag").alias("b"))
    return netlist.paths(f.attached, wanted).select("drawing_id", "b", F.array_join("path", ">").alias("path"), F.col("hops").cast("long").alias("hops"))


@_query("SELECT drawing_id, count(*) AS circuits, round(sum(total) / 1000, 1) AS load_kw, count(rcd) FILTER (n >= 0) AS protected, arg_max(tag, struct_pack(t := total, p := -p)) AS highest FROM sums GROUP BY drawing_id", BOARDS_SQL)
def board_at_a_glance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drawn(spark, sf_dir).circuits
    return netlist.glance(rows).join(netlist.highest_load(rows).select("drawing_id", F.col("tag").alias("highest")), "drawing_id")


@_query("SELECT drawing_id, tag, total, round(CASE WHEN m > 0 THEN 100 * total / m ELSE 0 END, 3) AS share FROM (SELECT *, max(total) OVER (PARTITION BY drawing_id) AS m FROM sums)", BOARDS_SQL)
def load_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return netlist.load_shares(drawn(spark, sf_dir).circuits)


@_query("SELECT drawing_id, word, CASE word WHEN 'main' THEN 'MAIN' WHEN ' c1 ' THEN 'C1' ELSE 'SUP1' END AS tag FROM (SELECT drawing_id, unnest(['main', 'SUP1']) AS word FROM board UNION ALL SELECT drawing_id, ' c1 ' FROM mcb WHERE p = 0 UNION ALL SELECT drawing_id, ' c1 ' FROM ckt WHERE tag = 'C1')", BOARDS_SQL)
def tag_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = drawn(spark, sf_dir)
    words = f.sheets.select("drawing_id", F.explode(F.array(*map(F.lit, ["main", " c1 ", "SUP1", "Z99"]))).alias("word"))
    return netlist.find(f.parts, words)


@_query("""SELECT p_partkey AS k, CASE WHEN v >= 1e6 OR v = floor(v) THEN v::BIGINT::VARCHAR ELSE rtrim(rtrim(printf('%.' || (5 - floor(log10(v)))::INT || 'f', v), '0'), '.') END AS said, round(v, 3) AS near, (v * 1000)::BIGINT::DOUBLE / 1000 AS parsed FROM (SELECT p_partkey, p_retailprice AS v FROM part) WHERE v > 0""")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v")).where("v > 0")
    return part.select("k", general(F.col("v")).alias("said"), rounded(F.col("v")).alias("near"), rounded(number(F.concat(F.lit(" "), F.format_number("v", 3), F.lit(" ")))).alias("parsed"))
