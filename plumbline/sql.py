"""The drawing operators as table functions of SQL.

    sql.register(spark, facts)
    spark.sql("SELECT * FROM labeled_regions(layer => 'ROOMS') WHERE area_m2 > 9")

A function is a query over views, which Spark puts in place of the call: constant
arguments fold away, and what is left of their conditions reaches the scans. Arguments
have the names and types of ``registry``; one that is null or left out filters nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import measures, netlist, spatial
from plumbline.operators.planner import Facts
from plumbline.registry import OPERATORS

_TYPES = {str: "STRING", float: "DOUBLE"}
#: Conditions; what stands in braces is an argument.
_LAYER = "(coalesce({layer}, '') = '' OR upper(layer) = upper(trim({layer})))"
_NAMED = "transform(split({entity_type}, ','), t -> upper(trim(t)))"
_KIND = f"(coalesce({{entity_type}}, '') = '' OR array_contains({_NAMED}, type) OR type = 'LWPOLYLINE' AND array_contains({_NAMED}, 'POLYLINE'))"
_TYPE = "({component_type} IS NULL OR upper(coalesce(type, '')) = upper({component_type}))"
_TAG = "upper(tag) = upper(trim({tag}))"


def _number(text: str) -> str:
    return f"try_cast(regexp_replace(regexp_replace({text}, ',', ''), R'^\\s+|\\s+$', '') AS DOUBLE)"


_HELD = "element_at(attribs, upper(trim({attribute})))"

#: What each function selects; views are named after the entry of ``_VIEWS`` that makes them.
BODIES: dict[str, str] = {
    "drawing_info": "SELECT * FROM plumbline_summary",
    "list_layers": "SELECT * FROM plumbline_layers",
    "count_entities": f"""SELECT drawing_id, count(*) AS n FROM plumbline_entities WHERE {_KIND} AND {_LAYER} AND (coalesce({{block_name}}, '') = '' OR upper(coalesce(block, '')) = upper({{block_name}}))
      AND ({{diameter}} IS NULL OR abs(2 * radius - {{diameter}}) < 1e-6 * greatest(1D, {{diameter}}) + 1e-6) AND (coalesce({{text_contains}}, '') = '' OR contains(upper(text), upper({{text_contains}}))) GROUP BY drawing_id""",
    "total_length": f"""SELECT drawing_id, round(total, 3) AS total_length, entities_counted, round(total * to_m, 3) AS total_length_m
      FROM (SELECT drawing_id, sum(coalesce(length, 0D)) AS total, count(length) AS entities_counted FROM plumbline_entities WHERE {_KIND} AND {_LAYER} GROUP BY drawing_id) JOIN plumbline_sheets USING (drawing_id)""",
    "find_text": f"SELECT drawing_id, ordinal, layer, text FROM plumbline_entities WHERE type IN ('TEXT', 'MTEXT') AND contains(upper(text), upper({{pattern}})) AND {_LAYER}",
    "list_dimensions": "SELECT drawing_id, ordinal, round(measurement, 3) AS value, layer FROM plumbline_entities WHERE type = 'DIMENSION'",
    "labeled_regions": f"SELECT * FROM plumbline_regions WHERE {_LAYER} AND (coalesce({{label_contains}}, '') = '' OR contains(upper(label), upper({{label_contains}})))",
    "block_inserts": f"SELECT * FROM plumbline_inserts WHERE {_LAYER} AND (coalesce({{block_name}}, '') = '' OR upper(coalesce(block, '')) = upper({{block_name}}))",
    "circles": f"""SELECT drawing_id, round(d, 3) AS diameter, n, area FROM
      (SELECT drawing_id, round(2 * radius, 6) AS d, count(*) AS n, round(sum(area), 3) AS area FROM plumbline_entities WHERE type = 'CIRCLE' AND {_LAYER} GROUP BY drawing_id, round(2 * radius, 6))""",
    "entities_in_region": f"""SELECT drawing_id, layer, type, count(*) AS n FROM plumbline_entities WHERE cx BETWEEN {{x_min}} AND {{x_max}} AND cy BETWEEN {{y_min}} AND {{y_max}} AND {_LAYER}
      GROUP BY GROUPING SETS ((drawing_id, layer), (drawing_id, type), (drawing_id))""",
    "layer_extents": "SELECT drawing_id, round(max(x_max) - min(x_min), 3) AS width, round(max(y_max) - min(y_min), 3) AS height FROM plumbline_entities WHERE upper(layer) = upper(trim({layer})) AND x_min IS NOT NULL GROUP BY drawing_id",
    "count_per_region": """SELECT r.drawing_id, r.region, r.label, coalesce(h.n, 0L) AS count FROM plumbline_regions AS r
      LEFT JOIN (SELECT drawing_id, region, n FROM plumbline_held WHERE item_layer = upper(trim({layer}))) AS h ON h.drawing_id = r.drawing_id AND h.region = r.region
      WHERE coalesce({region_layer}, '') = '' OR upper(r.layer) = upper(trim({region_layer}))""",
    "components": f"""SELECT * FROM plumbline_parts WHERE (coalesce({{component_type}}, '') = '' OR upper(coalesce(type, '')) = upper({{component_type}}))
      AND (coalesce({{attribute}}, '') = '' OR {_HELD} IS NOT NULL AND ({{value}} IS NULL OR upper({_HELD}) = upper({{value}}) OR {_number(_HELD)} = {_number('{value}')}))""",
    "component_details": f"SELECT * FROM plumbline_details WHERE {_TAG}",
    "connected_to": f"SELECT drawing_id, tag, near AS connected_to, size(near) AS n FROM (SELECT drawing_id, tag, connected_to AS near FROM plumbline_details) WHERE {_TAG}",
    "downstream": "SELECT drawing_id, tag, root, type, attribs FROM plumbline_below JOIN (SELECT drawing_id, tag, type, attribs FROM plumbline_parts) USING (drawing_id, tag) WHERE upper(root) = upper(trim({tag}))",
    "downstream_summary": "SELECT s.* FROM plumbline_feeding AS s JOIN plumbline_parts AS p ON p.drawing_id = s.drawing_id AND p.tag = s.tag WHERE upper(p.type) = upper({component_type})",
    "bill_of_materials": "SELECT * FROM plumbline_bill",
    "sum_attribute": f"""SELECT drawing_id, count(v) AS n, round(coalesce(sum(v), 0D), 3) AS total, max(v) AS largest, min(v) AS smallest
      FROM (SELECT drawing_id, CASE WHEN {_TYPE} THEN {_number(_HELD)} END AS v FROM plumbline_parts) GROUP BY drawing_id""",
}

#: Arguments that are given once, to ``register``; and those whose default is no null.
_AT_ONCE = {"downstream_summary": ("attribute",), "count_per_region": ("tolerance",)}
_DEFAULTS = {("downstream_summary", "component_type"): "'MCB'"}


def _views(facts: Facts, attribute: str, tolerance: float | None) -> dict[str, Callable[[], DataFrame]]:
    e, s = facts.entities, facts.sheets
    return {
        "entities": lambda: e,
        "sheets": lambda: s,
        "summary": lambda: measures.summary(e, s),
        "layers": lambda: measures.layers(e),
        "regions": lambda: facts.regions,
        "inserts": lambda: spatial.block_inserts(e, s),
        "held": lambda: spatial.held_by_layer(e, s, tolerance),
        "parts": lambda: facts.parts,
        "details": lambda: measures.component_details(facts.parts, netlist.adjacency(facts.attached)),
        "below": lambda: facts.below,
        "feeding": lambda: netlist.downstream_summary(facts.parts, facts.fed if attribute.upper() == "LOAD_W" else netlist.fed(facts.parts, facts.ways, attribute), None),
        "bill": lambda: measures.bill_of_materials(facts.parts),
    }


def register(spark: SparkSession, facts: Facts, names: Iterable[str] | None = None, attribute: str = "LOAD_W", tolerance: float | None = None) -> None:
    """Make temporary table functions of the operators in ``names``, of all in ``BODIES`` if it is None, and the views that they read.

    What only other operators need is not computed. ``attribute`` is what
    ``downstream_summary`` sums up, ``tolerance`` how far outside a region
    ``count_per_region`` still counts. A second call takes the place of the first.
    ``path_between`` searches round by round, which no query can, and is left to ``registry.call``.
    """
    chosen = list(BODIES) if names is None else list(names)
    for view, made in _views(facts, attribute, tolerance).items():
        if any(f"plumbline_{view}" in BODIES[name] for name in chosen):
            made().createOrReplaceTempView(f"plumbline_{view}")
    for name in chosen:
        taken = {a: t for a, t in OPERATORS[name].arguments.items() if a not in _AT_ONCE.get(name, ())}
        signature = ", ".join(f"{a} {_TYPES[t]}" + ("" if a in OPERATORS[name].required else f" DEFAULT {_DEFAULTS.get((name, a), 'NULL')}") for a, t in taken.items())
        body = BODIES[name].format(**{a: f"{name}.{a}" for a in taken})
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature}) RETURNS TABLE RETURN {body}")


def functions() -> list[str]:
    """Names of the functions that ``register`` can make."""
    return list(BODIES)
