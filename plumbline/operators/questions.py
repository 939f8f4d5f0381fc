"""Questions about drawings with their expected answers, made from manifests, and the run that answers and scores them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.geometry import general
from plumbline.operators import compliance, evaluation, planner, retrieval, router, spatial
from plumbline.operators.planner import Facts
from plumbline.sources import rules
from plumbline.staging import stage

SEED = 7

#: Per kind of drawing, the templates, each in plain and in other words. {R}, {C} and {X} stand for a room, a circuit and a component.
PLAN = [
    ("rooms", "How many rooms are in this plan?", "What's the total number of rooms shown on the drawing?"),
    ("doors", "How many doors are there in the plan?", "What is the door count for this layout?"),
    ("windows", "How many windows does the drawing have?", "What's the window total for this plan?"),
    ("bedrooms", "How many bedrooms are there?", "How many sleeping rooms does this unit have?"),
    ("room_area", "What is the area of the {R} in square metres?", "What floor space does the {R} cover, in square metres?"),
    ("corridor", "What is the width of the corridor in mm?", "How wide is the hallway, in millimetres?"),
    ("door_width", "What is the width of the door into the {R} in mm?", "How wide is the {R}'s door opening in millimetres?"),
    ("walls", "What is the total length of walls in metres?", "Add up all the wall lines: how many metres is that?"),
    ("bldg_width", "What is the overall width of the building in mm?", "How wide is the building footprint from end to end, in mm?"),
    ("largest", "Which room is the largest?", "Which space has the most floor area, not counting the corridor?"),
]
PART = [
    ("holes", "How many holes does this part have?", "What's the hole count?"),
    ("plate_area", "What is the area of the plate outline in mm²?", "How large is the blank in square millimetres?"),
]
BOARD = [
    ("circuits", "How many circuits are in this distribution board?", "How many outgoing ways does the board feed?"),
    ("sockets", "How many sockets are on the drawing?", "What's the socket outlet total?"),
    ("lights", "How many lights are there?", "How many luminaires does the schematic show?"),
    ("rating", "What is the rating of breaker {C} in amps?", "{C} is protected at how many amps?"),
    ("load", "What is the total connected load of circuit {C} in watts?", "How much power do the loads fed by {C} draw altogether, in W?"),
    ("cable", "What cable size feeds circuit {C} in sq mm?", "Which conductor cross-section is used on {C}'s run, in sq mm?"),
    ("cable_len", "What is the total cable length in metres?", "Summing every cable run, how many metres of cable are there?"),
    ("highest", "Which circuit has the highest connected load?", "Which final circuit draws the most power?"),
    ("main", "What is the main switch rating in amps?", "How big is the incoming isolator, in amps?"),
]
CIRCUIT = [
    ("resistors", "How many resistors are in the circuit?", "What's the resistor count?"),
    ("capacitors", "How many capacitors are there?", "How many caps does the board use?"),
    ("r_value", "What is the value of {X} in ohms?", "How many ohms is {X}?"),
    ("neighbours", "How many components are directly connected to {X}?", "How many parts share a connection with {X}?"),
    ("components", "How many components are on the schematic?", "What is the total part count?"),
]
CHECKS = {
    "floorplan": [("corridor", "Does the corridor meet the minimum width required by the spec?"), ("door", "Do all doors meet the minimum clear width in the specification?"),
                  ("area", "Do all rooms meet the minimum floor areas in the spec?"), ("window", "Does every habitable room have a window as the spec requires?")],
    "electrical": [("breaker", "Are all breakers correctly sized for their cables according to the spec?"), ("load", "Do all circuits stay within the connected load limit in the specification?"),
                   ("rcd", "Are all socket circuits protected by an RCD as the spec requires?"), ("lighting", "Do all lighting circuits meet the breaker rating limit in the spec?"), ("length", "Do all cable runs meet the maximum length in the specification?")],
}


def _pick(array: Column, template: str, seed: int) -> Column:
    """One element, by a hash of the drawing and the template."""
    return F.get(array, F.pmod(F.xxhash64("drawing_id", F.lit(template), F.lit(seed)), F.size(array).cast("long")).cast("int"))


def tied(array: Column, name: str, value: str, relative: float = 0.0) -> Column:
    """The names of all elements with the largest value, within a relative tolerance, joined by ``|``."""
    most = F.array_max(F.transform(array, lambda x: x[value].cast("double")))
    return F.array_join(F.transform(F.filter(array, lambda x: x[value].cast("double") >= most * (1 - relative)), lambda x: x[name]), "|")


def _by_kind(made: DataFrame, kind: str, domain: str, templates: list[tuple[str, str, str]], seed: int, marks: dict[str, Column], answers: dict[str, tuple[Column, str]]) -> DataFrame:
    def filled(text: str, template: str) -> Column:
        out = F.lit(text)
        for mark, name in marks.items():
            if f"{{{mark}}}" in text:
                out = F.replace(out, F.lit(f"{{{mark}}}"), name(template))
        return out

    wordings = [
        F.struct(F.lit(template).alias("template"), F.lit(variant).alias("variant"), filled(text, template).alias("question"), answers[template][0].cast("string").alias("expected"), F.lit(answers[template][1]).alias("answer_type"))
        for template, *texts in templates
        for variant, text in zip(("canonical", "paraphrase"), texts, strict=True)
    ]
    rows = made.where(F.col("kind") == kind).select("drawing_id", "spec", F.explode(F.array(*wordings)).alias("q"))
    return rows.select("drawing_id", "spec", F.lit("compute").alias("kind"), F.lit(domain).alias("domain"), "q.*", F.lit("compute").alias("expected_route"))


def _over(table: dict[float, int], size: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(float(x)) for kv in table.items() for x in kv]), size)


def truths(made: DataFrame) -> DataFrame:
    """drawing_id, check and whether the manifest passes it, by the limits of the specifications."""
    plans, boards = made.where("kind = 'floorplan'"), made.where("kind = 'electrical'")
    kind = lambda r: F.regexp_extract(r["name"], r"^\S+", 0)
    need = lambda r: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rules.AREAS_M2.items() for x in kv]), kind(r)), F.lit(0.0))
    c = F.col("circuits")
    over = {
        "corridor": F.col("corridor_width") >= rules.CORRIDOR_MM,
        "door": F.forall("rooms", lambda r: r["door_width"] >= F.when(F.startswith(r["name"], F.lit("BATH")), rules.BATH_DOOR_MM).otherwise(rules.DOOR_MM)),
        "area": F.forall("rooms", lambda r: r["area_m2"] >= need(r)),
        "window": F.forall("rooms", lambda r: ~kind(r).isin(compliance.HABITABLE) | (F.size(r["windows"]) > 0)),
        "breaker": F.forall(c, lambda x: x["rating_a"] <= _over(rules.CAPACITY_A, x["cable_size"])),
        "load": F.forall(c, lambda x: x["load_w"] <= rules.LOAD_PERCENT / 100 * rules.VOLTS * x["rating_a"]),
        "rcd": F.forall(c, lambda x: (x["type"] != "SOCKET") | F.coalesce(x["rcd"]["sens_ma"] <= rules.RCD_MA, F.lit(False))),
        "lighting": F.forall(c, lambda x: (x["type"] != "LIGHT") | (x["rating_a"] <= rules.LIGHTING_A)),
        "length": F.forall(c, lambda x: x["cable_length_m"] <= _over(rules.RUN_M, x["cable_size"])),
    }
    out = []
    for rows, kind_of in ((plans, "floorplan"), (boards, "electrical")):
        checks = F.array(*(F.struct(F.lit(name).alias("check"), over[name].alias("passes")) for name, _ in CHECKS[kind_of]))
        out.append(rows.select("drawing_id", F.explode(checks).alias("t")).select("drawing_id", "t.*"))
    return out[0].union(out[1])


def generate(made: DataFrame, seed: int = SEED) -> DataFrame:
    """question_id, drawing_id, spec, kind, domain, template, variant, question, expected, answer_type, expected_route from manifests.

    Rooms, circuits and components are chosen by hash, so reruns agree. Every template
    comes in both wordings; checks have one.
    """
    room, circuit = lambda t: _pick(F.col("rooms"), t, seed), lambda t: _pick(F.col("circuits"), t, seed)
    count = lambda name: (general(F.element_at("counts", name).cast("double")), "number")
    number = lambda column: (general(column.cast("double")), "number")
    plans = _by_kind(made, "floorplan", "building", PLAN, seed, {"R": lambda t: room(t)["name"]}, {
        **{n: count(n) for n in ("rooms", "doors", "windows", "bedrooms")}, "room_area": number(room("room_area")["area_m2"]), "corridor": number(F.col("corridor_width")), "door_width": number(room("door_width")["door_width"]),
        "walls": number(F.round(F.col("total_wall_length") / 1000, 3)), "bldg_width": number(F.col("width")), "largest": (tied(F.col("rooms"), "name", "area_m2", 1e-9), "label"),
    })
    parts = _by_kind(made, "part", "mechanical", PART, seed, {}, {"holes": count("holes"), "plate_area": number(F.col("plate_area_mm2"))})
    boards = _by_kind(made, "electrical", "electrical", BOARD, seed, {"C": lambda t: circuit(t)["tag"]}, {
        **{n: count(n) for n in ("circuits", "sockets", "lights")}, "rating": number(circuit("rating")["rating_a"]), "load": number(circuit("load")["load_w"]), "cable": number(circuit("cable")["cable_size"]),
        "cable_len": number(F.col("total_cable_length_m")), "highest": (tied(F.col("circuits"), "tag", "load_w"), "label"), "main": number(F.col("main_rating_a")),
    })
    resistor = lambda t: _pick(F.filter("components", lambda p: p["type"] == "RESISTOR"), t, seed)
    anyone = lambda t: _pick(F.col("components"), t, seed)
    named = lambda t: resistor(t)["tag"] if t == "r_value" else anyone(t)["tag"]
    diagrams = _by_kind(made, "electronic", "electronic", CIRCUIT, seed, {"X": named}, {
        **{n: count(n) for n in ("resistors", "capacitors", "components")}, "r_value": (F.element_at(resistor("r_value")["attrs"], "VALUE_OHM"), "number"), "neighbours": number(F.size(F.element_at(F.col("neighbours"), anyone("neighbours")["tag"]))),
    }).where("question IS NOT NULL")
    asked = []
    for kind, checks in CHECKS.items():
        rows = made.where(F.col("kind") == kind).select("drawing_id", "spec", F.explode(F.array(*(F.struct(F.lit(t).alias("template"), F.lit(q).alias("question")) for t, q in checks))).alias("q"))
        asked.append(rows.select("drawing_id", "spec", F.lit("compliance").alias("kind"), F.lit("building" if kind == "floorplan" else "electrical").alias("domain"), "q.*"))
    judged = asked[0].unionByName(asked[1]).join(truths(made).withColumnRenamed("check", "template"), ["drawing_id", "template"])
    judged = judged.select("drawing_id", "spec", "kind", "domain", "template", F.lit("canonical").alias("variant"), "question", F.when(F.col("passes"), "PASS").otherwise("FAIL").alias("expected"), F.lit("verdict").alias("answer_type"), F.lit("compliance").alias("expected_route"))
    whole = reduce(DataFrame.unionByName, [plans, parts, boards, diagrams, judged])
    return whole.withColumn("question_id", F.concat_ws("/", "drawing_id", "kind", "template", "variant"))


def run(questions: DataFrame, facts: Facts, chunks: DataFrame) -> DataFrame:
    """Every question with route, final, sources and correct: routed, answered by its expected route and scored, all in a few joins.

    ``questions`` are those of ``generate``, or any with question_id, drawing_id (null for
    questions to a specification alone), spec, question, expected, answer_type and expected_route.
    """
    routed = questions.withColumn("route", router.route(F.col("question"), F.col("drawing_id").isNotNull(), F.col("spec").isNotNull()))
    computed = planner.answers(routed.where("expected_route = 'compute'").select("question_id", "drawing_id", "question"), facts).select("question_id", "final")
    specs = questions.where("drawing_id IS NOT NULL AND spec IS NOT NULL").select("drawing_id", "spec").distinct()
    judged = verdicts(facts, specs, chunks)
    checked = compliance.answers(routed.where("expected_route = 'compliance'").select("question_id", "drawing_id", "question"), facts.domains, judged).select("question_id", "final")
    told = retrieval.spec_answers(routed.where("expected_route = 'spec'").select(F.col("spec").alias("corpus"), F.col("question_id").alias("query"), F.col("question").alias("text")), chunks)
    none = F.array().cast("array<string>")
    finals = computed.withColumn("sources", none).unionByName(checked.withColumn("sources", none)).unionByName(told.select(F.col("query").alias("question_id"), "final", "sources"))
    answered = routed.join(finals, "question_id", "left")
    return answered.withColumn("correct", evaluation.correct(F.col("answer_type"), F.col("expected"), F.col("final"), F.coalesce("final", F.lit("")), F.col("sources")))


def items(facts: Facts, specs: DataFrame, known: DataFrame) -> DataFrame:
    """What every check of both specifications finds, by drawing."""
    windows = spatial.count_per_region(facts.entities, facts.sheets, "WINDOWS", "ROOMS")
    circuits = facts.circuits
    return reduce(DataFrame.unionByName, [
        compliance.windows(windows, specs, known), compliance.doors(facts.doors, specs, known), compliance.corridors(facts.regions, specs, known), compliance.room_areas(facts.regions, specs, known),
        compliance.sockets_protected(circuits, specs, known), compliance.lighting_breakers(circuits, specs, known), compliance.cable_lengths(circuits, specs, known), compliance.loads(circuits, specs, known),
        compliance.breaker_sizes(circuits, specs, known), compliance.main_switches(facts.parts, specs, known), compliance.points(circuits, specs, known, "lighting_points"), compliance.points(circuits, specs, known, "socket_points"),
    ])


def limits_of(chunks: DataFrame) -> DataFrame:
    """The limits that search finds in the chunks of each specification."""
    docs = chunks.select(F.col("source").alias("corpus"), F.col("id").alias("doc"), "text")
    looked = docs.select("corpus").distinct().crossJoin(F.broadcast(compliance.searches(chunks.sparkSession)))
    hits = retrieval.search(docs, looked, k=compliance.TOP_HITS).join(docs, ["corpus", "doc"])
    # staged, as every limit reads them: the search would stand in the driver's plan once for each
    return compliance.limits(stage(hits.select(F.col("corpus").alias("spec"), "query", "rank", "text"), "limit-hits"))


def verdicts(facts: Facts, specs: DataFrame, chunks: DataFrame) -> DataFrame:
    """drawing_id, check, verdict and failing items of every drawing under its specification."""
    known = stage(limits_of(chunks), "limits")
    return stage(compliance.verdicts(items(facts, specs, known)), "verdicts", grows=True)
