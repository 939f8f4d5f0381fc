"""Answers to plain questions about drawings: a rule is chosen by the question's words, and joined to that rule's results.

``classify`` names the rule of each question and what it asks about; ``answers`` computes
every rule once for all drawings and joins the questions to it. No rule is evaluated
question by question.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.geometry import general, number
from plumbline.operators import measures, netlist, spatial
from plumbline.staging import stage

#: Words for component types.
TYPES = {"socket": "SOCKET", "light": "LIGHT", "rcd": "RCD", "breaker": "MCB", "mcb": "MCB", "cable": "CABLE", "resistor": "RESISTOR", "capacitor": "CAPACITOR", "led": "LED"}
SCHEMATIC = "electrical/electronic schematic"
#: Patterns of questions, here and in the rules of ``classify``.
_MANY = r"\b(how many|number of|count)\b.*"
_HOLES = r"(\d+(?:\.\d+)?)\s*mm\s+(?:diameter\s+)?holes?|holes?\s+(?:of|with)\s+(?:a\s+)?(?:diameter\s+(?:of\s+)?)?(\d+(?:\.\d+)?)"
_KIND = r"\b(?:how many|number of|count)\b.*?\b(sockets?|lights?|rcds?|breakers?|mcbs?|cables?|resistors?|capacitors?|leds?)\b"
_TAG = r"\b([A-Za-z]{1,4}\d+(?:-\d+)?|MAIN)\b"


@dataclass
class Facts:
    """Drawings and what is computed from them, each at most once."""

    entities: DataFrame
    sheets: DataFrame

    @cached_property
    def domains(self) -> DataFrame:
        return stage(measures.domains(self.entities), "plan-domains", grows=True)

    @cached_property
    def regions(self) -> DataFrame:
        return stage(spatial.labeled_regions(self.entities, self.sheets), "plan-regions", grows=True)

    @cached_property
    def doors(self) -> DataFrame:
        return stage(spatial.block_inserts(self.entities, self.sheets, "DOOR"), "plan-doors", grows=True)

    @cached_property
    def parts(self) -> DataFrame:
        return stage(netlist.components(self.entities), "plan-parts", grows=True)

    @cached_property
    def attached(self) -> DataFrame:
        return stage(netlist.attachments(self.entities, self.sheets, self.parts), "plan-nets", grows=True)

    @cached_property
    def edges(self) -> DataFrame:
        return stage(netlist.adjacency(self.attached), "plan-edges", grows=True)

    @cached_property
    def ways(self) -> DataFrame:
        return netlist.ways(self.attached, self.distances)

    @cached_property
    def below(self) -> DataFrame:
        return netlist.downstream(self.ways)

    @cached_property
    def fed(self) -> DataFrame:
        return stage(netlist.fed(self.parts, self.ways), "plan-fed", grows=True)

    @cached_property
    def distances(self) -> DataFrame:
        return netlist.distances(self.attached, netlist.sources(self.parts))

    @cached_property
    def circuits(self) -> DataFrame:
        return stage(netlist.downstream_summary(self.parts, self.fed), "plan-circuits", grows=True)


def spotted_tags(questions: DataFrame, parts: DataFrame) -> DataFrame:
    """(question_id, tag): the first word shaped like a tag that names a component, exactly or else without case."""
    words = questions.select("question_id", "drawing_id", F.posexplode(F.regexp_extract_all("question", F.lit(_TAG), F.lit(1))).alias("at", "word"))
    known = parts.select("drawing_id", "tag", F.upper(F.trim("tag")).alias("_up"), "ordinal")
    hits = words.join(known, "drawing_id").where(F.upper("word") == F.col("_up"))
    first = F.struct("at", (F.col("word") != F.col("tag")).alias("other"), (-F.col("ordinal")).alias("last"))
    return hits.groupBy("question_id").agg(F.min_by("tag", first).alias("tag"))


def spotted_labels(questions: DataFrame, regions: DataFrame) -> DataFrame:
    """(question_id, label): the longest region label that stands in the question between other than letters and digits."""
    labels = regions.where("label IS NOT NULL AND label <> ''").select("drawing_id", "label").distinct()
    text = F.concat(F.lit(" "), F.lower("question"), F.lit(" "))
    quoted = F.regexp_replace(F.lower("label"), r"([^\p{L}\p{N}\s])", r"\\$1")
    pairs = questions.join(labels, "drawing_id").where(F.contains(text, F.lower("label"))).where(F.regexp_like(text, F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])"))))
    return pairs.groupBy("question_id").agg(F.min_by("label", F.struct((-F.length("label")).alias("n"), "label")).alias("label"))


def _has(pattern: str) -> Column:
    return F.col("ql").rlike(pattern)


def classify(questions: DataFrame, facts: Facts) -> DataFrame:
    """question_id, drawing_id, question, domain, tag, label, diameter, kind and rule (C1 to C25) of (question_id, drawing_id, question)."""
    known = questions.join(facts.domains, "drawing_id", "left")
    known = known.join(spotted_tags(questions, facts.parts), "question_id", "left").join(spotted_labels(questions, facts.regions), "question_id", "left")
    known = known.withColumn("ql", F.lower("question"))
    size = F.nullif(F.concat(F.regexp_extract("ql", _HOLES, 1), F.regexp_extract("ql", _HOLES, 2)), F.lit(""))
    word = F.regexp_replace(F.regexp_extract("ql", _KIND, 1), "s+$", "")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), word)
    known = known.withColumn("diameter", size.cast("double")).withColumn("kind", kind)
    cables = facts.fed.where("upper(type) = 'CABLE'")
    known = known.join(cables.select("drawing_id", F.col("root").alias("tag"), F.lit(True).alias("cabled")).distinct(), ["drawing_id", "tag"], "left")
    entered = facts.doors.where("in_region IS NOT NULL").select("drawing_id", F.upper("in_region").alias("_in"), F.lit(True).alias("entered")).distinct()
    known = known.join(entered, (known["drawing_id"] == entered["drawing_id"]) & (F.upper(known["label"]) == entered["_in"]), "left").drop(entered["drawing_id"]).drop("_in")
    tag, label = F.col("tag").isNotNull(), F.col("label").isNotNull()
    schematic = [
        ("C1", tag & _has(r"\b(how many|number of)\b.*\bconnected to\b")),
        ("C2", _has(r"\b(how many|number of)\b\s+(final\s+)?circuits\b")),
        ("C3", _has(_MANY + r"\bcomponents?\b")),
        ("C4", F.col("kind").isNotNull()),
        ("C5", _has(r"\bmain switch\b.*\brating\b|\brating\b.*\bmain switch\b")),
        ("C6", tag & _has(r"\brating of\b")),
        ("C7", tag & _has(r"\b(connected load|total load)\b")),
        ("C8", tag & _has(r"\bcable size\b") & F.coalesce("cabled", F.lit(False))),
        ("C9", _has(r"\btotal cable length\b")),
        ("C10", _has(r"\b(highest|largest|biggest)\b.*\bload\b")),
        ("C11", tag & _has(r"\bvalue of\b")),
    ]
    others = [
        ("C12", F.col("diameter").isNotNull() & _has("how many|number|count")),
        ("C13", _has(_MANY + r"\bholes?\b")),
        ("C14", _has(_MANY + r"\bbedrooms?\b")),
        ("C15", _has(_MANY + r"\brooms?\b")),
        ("C16", _has(_MANY + r"\bdoors?\b")),
        ("C17", _has(_MANY + r"\bwindows?\b")),
        ("C18", _has(r"\b(largest|biggest|smallest)\b") & _has(r"\broom\b")),
        ("C19", _has("door") & label & _has(r"\b(width|wide|opening)\b") & F.coalesce("entered", F.lit(False))),
        ("C20", (F.upper("label") == "CORRIDOR") & _has(r"\b(width|wide)\b")),
        ("C21", label & _has(r"\b(area|size|big)\b")),
        ("C22", _has(r"\bwalls?\b") & _has(r"\b(length|long)\b")),
        ("C23", _has(r"\b(overall|building|footprint)\b") & _has(r"\b(width|wide|depth|deep|length|long)\b")),
        ("C24", _has(r"\b(plate|outline|part)\b") & _has("area")),
    ]
    rule = F.lit("C25")
    for name, fits in reversed(others):
        rule = F.when(F.coalesce(fits, F.lit(False)), name).otherwise(rule)
    for name, fits in reversed(schematic):
        rule = F.when((F.col("domain") == SCHEMATIC) & F.coalesce(fits, F.lit(False)), name).otherwise(rule)
    return known.select("question_id", "drawing_id", "question", "ql", "domain", "tag", "label", "diameter", "kind", rule.alias("rule"))


def _count(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy("drawing_id", *keys).agg(general(F.count(F.lit(1)).cast("double")).alias("final"))


def answers(questions: DataFrame, facts: Facts) -> DataFrame:
    """question_id, drawing_id, rule and final (text; null for the fallback C25) of (question_id, drawing_id, question)."""
    asked = stage(classify(questions, facts), "plan-asked", grows=True)
    entities, regions, parts, doors = facts.entities, facts.regions, facts.parts, facts.doors
    rooms = regions.where("upper(layer) = 'ROOMS'")
    size = F.coalesce("area_m2", "area")

    def of(rule: str) -> DataFrame:
        return asked.where(F.col("rule") == rule)

    def attribute(name: str) -> Column:
        return F.element_at("attribs", name)

    by_sheet = {
        "C2": _count(facts.circuits),
        "C3": _count(parts),
        "C5": parts.where("tag = 'MAIN'").select("drawing_id", attribute("RATING_A").alias("final")),
        "C9": measures.sum_attribute(parts, "LENGTH_M", "CABLE").select("drawing_id", general(F.col("total")).alias("final")),
        "C10": netlist.highest_load(facts.circuits).select("drawing_id", F.col("tag").alias("final")),
        "C14": _count(regions.where("contains(upper(label), 'BEDROOM')")),
        "C15": _count(rooms),
        "C16": _count(doors),
        "C17": _count(measures.chosen(entities, layer="WINDOWS")),
        "C22": measures.total_length(entities, facts.sheets, "WALLS").select("drawing_id", general(F.col("total_length_m")).alias("final")),
        "C24": regions.where("upper(layer) = 'OUTLINE'").groupBy("drawing_id").agg(general(F.max("area")).alias("final")),
    }
    zero = {"C2", "C3", "C4", "C12", "C13", "C14", "C15", "C16", "C17", "C1"}
    out = []
    for rule, results in by_sheet.items():
        out.append(of(rule).join(results, "drawing_id", "left").select("question_id", "drawing_id", "rule", "final"))
    holes = measures.chosen(entities, "CIRCLE").join(measures.chosen(entities, layer="HOLES").select(F.col("drawing_id").alias("_h")).distinct(), F.col("drawing_id") == F.col("_h"), "left")
    holes = _count(holes.where(F.col("_h").isNull() | (F.upper("layer") == "HOLES")))
    out.append(of("C13").join(holes, "drawing_id", "left").select("question_id", "drawing_id", "rule", "final"))
    bored = of("C12").join(entities.where("type = 'CIRCLE'").select("drawing_id", "radius"), "drawing_id").where(F.abs(2 * F.col("radius") - F.col("diameter")) < 1e-6 * F.greatest(F.lit(1.0), "diameter") + 1e-6)
    bored = bored.groupBy("question_id").agg(general(F.count(F.lit(1)).cast("double")).alias("final"))
    out.append(of("C12").join(bored, "question_id", "left").select("question_id", "drawing_id", "rule", "final"))
    typed = parts.groupBy("drawing_id", F.upper("type").alias("kind")).agg(general(F.count(F.lit(1)).cast("double")).alias("final"))
    out.append(of("C4").join(typed, ["drawing_id", "kind"], "left").select("question_id", "drawing_id", "rule", "final"))
    near = facts.edges.groupBy("drawing_id", F.col("a").alias("tag")).agg(general(F.count(F.lit(1)).cast("double")).alias("final"))
    out.append(of("C1").join(near, ["drawing_id", "tag"], "left").select("question_id", "drawing_id", "rule", "final"))
    value = F.coalesce(F.nullif(attribute("VALUE_OHM"), F.lit("")), attribute("VALUE_UF"))
    for rule, held in (("C6", attribute("RATING_A")), ("C11", value)):
        out.append(of(rule).join(parts.select("drawing_id", "tag", held.alias("final")), ["drawing_id", "tag"], "left").select("question_id", "drawing_id", "rule", "final"))
    load = facts.fed.groupBy("drawing_id", F.col("root").alias("tag")).agg(general(F.round(F.sum("total"), 3)).alias("final"))
    out.append(of("C7").join(load, ["drawing_id", "tag"], "left").select("question_id", "drawing_id", "rule", F.coalesce("final", F.lit("0")).alias("final")))
    cables = facts.fed.where("upper(type) = 'CABLE'").groupBy("drawing_id", "root").agg(F.min_by(F.element_at("first", "SIZE_SQMM"), "first_tag").alias("final"))
    out.append(of("C8").join(cables.withColumnRenamed("root", "tag"), ["drawing_id", "tag"], "left").select("question_id", "drawing_id", "rule", "final"))
    extreme = {small: measures.largest_rooms(rooms, small).select("drawing_id", F.col("label").alias("small" if small else "large")) for small in (False, True)}
    either = extreme[False].join(extreme[True], "drawing_id")
    out.append(of("C18").join(either, "drawing_id", "left").select("question_id", "drawing_id", "rule", F.when(_has("smallest"), F.col("small")).otherwise(F.col("large")).alias("final")))
    opened = doors.groupBy("drawing_id", F.upper("in_region").alias("u")).agg(general(F.min_by("scale", "ordinal")).alias("final"))
    out.append(of("C19").withColumn("u", F.upper("label")).join(opened, ["drawing_id", "u"], "left").select("question_id", "drawing_id", "rule", "final"))
    widest = F.struct((-F.col("area")).alias("s"), "region")
    corridor = regions.where("contains(upper(label), 'CORRIDOR')").groupBy("drawing_id").agg(general(F.min_by("min_side", widest)).alias("final"))
    out.append(of("C20").join(corridor, "drawing_id", "left").select("question_id", "drawing_id", "rule", "final"))
    exact = regions.withColumn("u", F.upper("label")).groupBy("drawing_id", "u").agg(general(F.min_by(size, widest)).alias("final"))
    out.append(of("C21").withColumn("u", F.upper("label")).join(exact, ["drawing_id", "u"], "left").select("question_id", "drawing_id", "rule", "final"))
    extents = measures.layer_extents(entities, "WALLS")
    deep = _has(r"\b(depth|deep)\b")
    out.append(of("C23").join(extents, "drawing_id", "left").select("question_id", "drawing_id", "rule", general(F.when(deep, F.col("height")).otherwise(F.col("width"))).alias("final")))
    out.append(of("C25").select("question_id", "drawing_id", "rule", F.lit(None).cast("string").alias("final")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.withColumn("final", F.when(F.col("rule").isin(*sorted(zero)), F.coalesce("final", F.lit("0"))).otherwise(F.col("final")))
