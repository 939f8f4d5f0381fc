"""Operators by name, with the arguments that they take: for callers that choose one at run time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import measures, netlist, spatial
from plumbline.operators.planner import Facts


@dataclass(frozen=True)
class Operator:
    """``run`` takes the drawings' ``Facts`` and the arguments; ``arguments`` maps names to types, those in ``required`` must be given."""

    about: str
    run: Callable[..., DataFrame]
    arguments: dict[str, type] = field(default_factory=dict)
    required: tuple[str, ...] = ()


def _path(facts: Facts, tag_a: str, tag_b: str) -> DataFrame:
    return netlist.path_between(facts.attached, tag_a, tag_b)


def _near(facts: Facts, tag: str) -> DataFrame:
    found = measures.component_details(facts.parts, facts.edges).where(F.upper("tag") == tag.strip().upper())
    return found.select("drawing_id", "tag", "connected_to", F.size("connected_to").alias("n"))


def _details(facts: Facts, tag: str) -> DataFrame:
    return measures.component_details(facts.parts, facts.edges).where(F.upper("tag") == tag.strip().upper())


def _summary(facts: Facts, component_type: str = "MCB", attribute: str = "LOAD_W") -> DataFrame:
    feeding = facts.fed if attribute.upper() == "LOAD_W" else netlist.fed(facts.parts, facts.ways, attribute)
    return netlist.downstream_summary(facts.parts, feeding, component_type)


def _below(facts: Facts, tag: str) -> DataFrame:
    return facts.below.where(F.upper("root") == tag.strip().upper()).join(facts.parts.select("drawing_id", "tag", "type", "attribs"), ["drawing_id", "tag"])


_FILTERS = {"entity_type": str, "layer": str, "block_name": str, "diameter": float, "text_contains": str}
_BOX = {"x_min": float, "y_min": float, "x_max": float, "y_max": float}

OPERATORS: dict[str, Operator] = {
    "drawing_info": Operator("Units, size, layers, types, blocks and texts.", lambda f: measures.summary(f.entities, f.sheets)),
    "list_layers": Operator("Layers with counts by type.", lambda f: measures.layers(f.entities)),
    "count_entities": Operator("Number of entities that pass all filters.", lambda f, **a: measures.count_entities(f.entities, **a), _FILTERS),
    "total_length": Operator("Sum of lengths.", lambda f, **a: measures.total_length(f.entities, f.sheets, **a), {"layer": str, "entity_type": str}),
    "find_text": Operator("Texts that contain a pattern.", lambda f, **a: measures.find_text(f.entities, **a), {"pattern": str, "layer": str}, ("pattern",)),
    "list_dimensions": Operator("Dimension values.", lambda f: measures.dimensions(f.entities)),
    "labeled_regions": Operator("Closed polylines with labels, sizes and areas.", lambda f, **a: spatial.labeled_regions(f.entities, f.sheets, **a), {"layer": str, "label_contains": str}),
    "block_inserts": Operator("Block references and the regions they open into.", lambda f, **a: spatial.block_inserts(f.entities, f.sheets, **a), {"block_name": str, "layer": str}),
    "circles": Operator("Circles by diameter.", lambda f, **a: measures.circles(f.entities, **a), {"layer": str}),
    "entities_in_region": Operator("Entities anchored in a box.", lambda f, **a: measures.in_window(f.entities, **a), {**_BOX, "layer": str}, tuple(_BOX)),
    "layer_extents": Operator("Width and height of a layer.", lambda f, **a: measures.layer_extents(f.entities, **a), {"layer": str}, ("layer",)),
    "count_per_region": Operator("Entities of a layer in or on each region.", lambda f, **a: spatial.count_per_region(f.entities, f.sheets, **a), {"layer": str, "region_layer": str, "tolerance": float}, ("layer",)),
    "components": Operator("Tagged components.", lambda f, **a: measures.with_attribute(f.parts, **a), {"component_type": str, "attribute": str, "value": str}),
    "component_details": Operator("Attributes and neighbours of a component.", _details, {"tag": str}, ("tag",)),
    "connected_to": Operator("Neighbours of a component.", _near, {"tag": str}, ("tag",)),
    "downstream": Operator("What a component feeds.", _below, {"tag": str}, ("tag",)),
    "downstream_summary": Operator("What each component of a type feeds.", _summary, {"component_type": str, "attribute": str}),
    "bill_of_materials": Operator("Components by type and rating.", lambda f: measures.bill_of_materials(f.parts)),
    "sum_attribute": Operator("Sum, largest and smallest of an attribute.", lambda f, **a: measures.sum_attribute(f.parts, **a), {"attribute": str, "component_type": str}, ("attribute",)),
    "path_between": Operator("The shortest way between two components.", _path, {"tag_a": str, "tag_b": str}, ("tag_a", "tag_b")),
}


def schemas() -> list[dict]:
    """Name, description and typed arguments of every operator."""
    names = {str: "string", float: "number"}
    return [
        {"name": name, "description": op.about, "parameters": {"type": "object", "properties": {a: {"type": names[t]} for a, t in op.arguments.items()}, "required": list(op.required)}}
        for name, op in OPERATORS.items()
    ]


def call(facts: Facts, name: str, arguments: dict | None = None) -> DataFrame | dict[str, str]:
    """The operator's table, or ``{"error": ...}`` for an unknown name, wrong arguments or a failing plan; never raises for these."""
    op, given = OPERATORS.get(name), dict(arguments or {})
    if op is None:
        return {"error": f"unknown operator {name!r}"}
    odd, missing = sorted(given.keys() - op.arguments.keys()), [a for a in op.required if given.get(a) is None]
    if odd or missing:
        return {"error": f"bad arguments for {name}: " + ", ".join([*(f"unknown {a}" for a in odd), *(f"missing {a}" for a in missing)])}
    try:
        typed = {a: op.arguments[a](v) for a, v in given.items() if v is not None}
        return op.run(facts, **typed)
    except (TypeError, ValueError, PySparkException) as error:
        return {"error": f"{type(error).__name__}: {error}"[:500]}


