"""Checks of drawings against limits that are read from the clauses of their specification.

``limits`` mines a table of (spec, check, size, limit, clause) from search hits; a check
joins what was measured to it by the drawing's specification. Items are (drawing_id,
check, item, value, limit, clause, failing); failing is null where no limit was found.
``verdicts`` makes one row per drawing and check of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.geometry import number
from plumbline.operators.retrieval import not_less_than, size_table

#: Rooms that need daylight, the hits of a search that may hold a rule, and per check
#: what is searched for, the words that its clause must hold, and how its limit is written.
HABITABLE = ["LIVING", "BEDROOM", "STUDY", "KITCHEN"]
TOP_HITS = 8
SEARCHES = [
    ("window", "every habitable room window external wall", ["window", "habitable"], "none"),
    ("door", "doors serving habitable rooms clear opening width", ["habitable", "opening"], "least"),
    ("bath_door", "bathroom door clear opening width", ["bathroom", "opening"], "least"),
    ("corridor", "minimum clear width internal corridor", ["corridor", "not less than"], "least"),
    *((f"area_{kind.lower()}", f"minimum floor area {kind.lower()}", [kind.lower(), "square metres"], "least") for kind in HABITABLE),
    ("rcd", "circuits supplying socket outlets residual current device RCD", ["socket", "rcd"], r"not exceeding (\d+) ma"),
    ("lighting", "lighting circuits protected by breakers rated not more than", ["lighting", "not more than"], r"not more than (\d+) a\b"),
    ("length", "cable run lengths shall not exceed voltage drop", ["run lengths"], "sizes m"),
    ("load", "connected load final circuit percent breaker rating multiplied", ["percent"], r"(\d+) percent"),
    ("volts", "connected load final circuit percent breaker rating multiplied", ["percent"], r"(\d+) v\b"),
    ("breaker", "circuit breaker rating shall not exceed current-carrying capacity of the cable", ["capacit", "sq mm"], "sizes a"),
    ("main", "main switch of a distribution board rated not less than", ["main switch", "not less than"], "least"),
    ("lighting_points", "lighting circuit supply not more than luminaires", ["not more than", "luminaires"], r"not more than (\d+) luminaires"),
    ("socket_points", "socket circuit supply not more than socket outlets", ["not more than", "socket outlets"], r"not more than (\d+) socket outlets"),
]


def searches(spark: SparkSession) -> DataFrame:
    """(query, text): what is looked up in every specification; query is the check's name."""
    return spark.createDataFrame([(check, text) for check, text, _, _ in SEARCHES], "query string, text string")


def best_clause(hits: DataFrame, needed: list[str]) -> DataFrame:
    """spec, query, clause, text: the first of the top hits (spec, query, rank, text) that contains all words, with its clause number (``?`` if none)."""
    has = reduce(lambda a, b: a & b, (F.contains(F.lower("text"), F.lit(w.lower())) for w in needed), F.lit(True))
    first = hits.where((F.col("rank") < TOP_HITS) & has).groupBy("spec", "query").agg(F.min_by("text", "rank").alias("text"))
    clause = F.coalesce(F.nullif(F.regexp_extract("text", r"(\d+\.\d+)\s", 1), F.lit("")), F.lit("?"))
    return first.select("spec", "query", clause.alias("clause"), "text")


def limits(hits: DataFrame) -> DataFrame:
    """spec, check, size (null but for tables by cable size), limit (null for rules without a number) and clause."""
    out = []
    for check, _, needed, kind in SEARCHES:
        found = best_clause(hits.where(F.col("query") == check), needed)
        if kind.startswith("sizes "):
            pairs = found.select("spec", "clause", F.explode(size_table(F.col("text"), kind.split()[1])).alias("p"))
            out.append(pairs.select("spec", F.lit(check).alias("check"), F.col("p.size").cast("double").alias("size"), F.col("p.value").cast("double").alias("limit"), "clause"))
            continue
        if kind == "none":
            limit = F.lit(None).cast("double")
        else:
            limit = not_less_than(F.col("text")) if kind == "least" else F.regexp_extract(F.lower("text"), kind, 1).try_cast("double")
        out.append(found.select("spec", F.lit(check).alias("check"), F.lit(None).cast("double").alias("size"), limit.alias("limit"), "clause"))
    return reduce(DataFrame.unionByName, out)


def _of(known: DataFrame, check: str, *more: Column) -> DataFrame:
    return known.where(F.col("check") == check).select(F.col("spec").alias("_spec"), "limit", "clause", *more)


def _judged(items: DataFrame, check: str, rule: DataFrame, failing: Column) -> DataFrame:
    """Items of (drawing_id, spec, item, value) with their limit; those of specifications without the rule stay, unjudged."""
    joined = items.join(rule, items["spec"] == rule["_spec"], "left")
    return joined.select("drawing_id", F.lit(check).alias("check"), "item", F.col("value").cast("double").alias("value"), "limit", "clause", failing.alias("failing"))


def windows(per_room: DataFrame, specs: DataFrame, known: DataFrame) -> DataFrame:
    """Habitable rooms of (drawing_id, label, count) without a window."""
    kind = F.regexp_extract(F.upper("label"), r"^\s*(\S+)", 1)
    rooms = per_room.where(kind.isin(HABITABLE)).join(specs, "drawing_id").select("drawing_id", "spec", F.col("label").alias("item"), F.col("count").alias("value"))
    return _judged(rooms, "window", _of(known, "window"), F.when(F.col("clause").isNotNull(), F.col("value") < 1))


def doors(inserts: DataFrame, specs: DataFrame, known: DataFrame) -> DataFrame:
    """Doors of (drawing_id, in_region, scale) narrower than the limit of the room that they open into; a room without a name counts as habitable."""
    named = F.coalesce("in_region", F.lit("?"))
    rule = F.when(F.startswith(F.upper(named), F.lit("BATH")), "bath_door").otherwise("door")
    rows = inserts.join(specs, "drawing_id").select("drawing_id", "spec", named.alias("item"), F.col("scale").alias("value"), rule.alias("rule"))
    found = known.where(F.col("check").isin("door", "bath_door")).select(F.col("spec").alias("_spec"), F.col("check").alias("_rule"), "limit", "clause")
    joined = rows.join(found, (rows["spec"] == found["_spec"]) & (rows["rule"] == found["_rule"]), "left")
    return joined.select("drawing_id", F.lit("door").alias("check"), "item", F.col("value").cast("double").alias("value"), "limit", "clause", (F.col("value") < F.col("limit")).alias("failing"))


def corridors(regions: DataFrame, specs: DataFrame, known: DataFrame) -> DataFrame:
    """The largest corridor of a drawing, whose shorter side is below the limit."""
    rows = regions.where(F.contains(F.upper("label"), F.lit("CORRIDOR")))
    first = rows.groupBy("drawing_id").agg(F.min_by(F.struct("label", "min_side"), F.struct((-F.col("area")).alias("s"), "region")).alias("r"))
    items = first.join(specs, "drawing_id").select("drawing_id", "spec", F.col("r.label").alias("item"), F.col("r.min_side").alias("value"))
    return _judged(items, "corridor", _of(known, "corridor"), F.col("value") < F.col("limit"))


def room_areas(regions: DataFrame, specs: DataFrame, known: DataFrame) -> DataFrame:
    """Rooms on layer ROOMS below the limit of their kind in square metres; kinds without a limit are not checked."""
    found = known.where(F.startswith("check", F.lit("area_"))).select(F.col("spec").alias("_spec"), F.upper(F.substring("check", 6, 40)).alias("_kind"), "limit", "clause").where("limit IS NOT NULL")
    rows = regions.where("upper(layer) = 'ROOMS'").join(specs, "drawing_id")
    joined = rows.join(found, (rows["spec"] == found["_spec"]) & F.startswith(F.upper(rows["label"]), found["_kind"]))
    return joined.select("drawing_id", F.lit("area").alias("check"), F.col("label").alias("item"), F.col("area_m2").alias("value"), "limit", "clause", (F.col("area_m2") < F.col("limit")).alias("failing"))


def _attr(column: str, name: str) -> Column:
    return number(F.element_at(F.col(column), name))


def _feeds(kind: str) -> Column:
    return F.coalesce(F.element_at("feeds", kind), F.lit(0))


def _circuits(circuits: DataFrame, specs: DataFrame, value: Column, where: Column, *more: Column) -> DataFrame:
    return circuits.where(where).join(specs, "drawing_id").select("drawing_id", "spec", F.col("tag").alias("item"), value.cast("double").alias("value"), *more)


def sockets_protected(circuits: DataFrame, specs: DataFrame, known: DataFrame) -> DataFrame:
    """Socket circuits of ``netlist.downstream_summary`` without a residual-current device of known sensitivity, or with one less sensitive than allowed."""
    rows = _circuits(circuits, specs, _attr("rcd", "SENS_MA"), _feeds("SOCKET") > 0)
    failing = F.when(F.col("value").isNull(), F.lit(True)).otherwise(F.col("value") > F.col("limit"))
    return _judged(rows, "rcd", _of(known, "rcd"), F.when(F.col("clause").isNotNull(), failing))


def lighting_breakers(circuits: DataFrame, specs: DataFrame, known: DataFrame) -> DataFrame:
    """Lighting circuits whose breaker is rated above the limit."""
    return _judged(_circuits(circuits, specs, _attr("own", "RATING_A"), _feeds("LIGHT") > 0), "lighting", _of(known, "lighting"), F.col("value") > F.col("limit"))


def loads(circuits: DataFrame, specs: DataFrame, known: DataFrame) -> DataFrame:
    """Circuits whose load exceeds the allowed share of rating times voltage."""
    volts = known.where("check = 'volts'").select(F.col("spec").alias("_vs"), F.col("limit").alias("volts"))
    share = _of(known, "load").withColumnRenamed("limit", "percent").join(volts, F.col("_spec") == F.col("_vs"))
    rows = _circuits(circuits, specs, F.col("total"), F.lit(True), _attr("own", "RATING_A").alias("rating"))
    joined = rows.join(share, rows["spec"] == share["_spec"], "left").withColumn("limit", F.col("percent") / 100 * F.col("rating") * F.col("volts"))
    return joined.select("drawing_id", F.lit("load").alias("check"), "item", "value", F.round("limit", 6).alias("limit"), "clause", (F.col("value") > F.col("limit")).alias("failing"))


def _by_cable_size(circuits: DataFrame, specs: DataFrame, known: DataFrame, check: str, value: Column) -> DataFrame:
    """Circuits whose value exceeds the limit of their cable's size; sizes without a limit are not checked."""
    rows = _circuits(circuits, specs, value, F.lit(True), _attr("cable", "SIZE_SQMM").alias("size"))
    found = _of(known, check, F.col("size").alias("_size"))
    joined = rows.join(found, (rows["spec"] == found["_spec"]) & (rows["size"] == found["_size"]))
    return joined.select("drawing_id", F.lit(check).alias("check"), "item", "value", "limit", "clause", (F.col("value") > F.col("limit")).alias("failing"))


def cable_lengths(circuits: DataFrame, specs: DataFrame, known: DataFrame) -> DataFrame:
    return _by_cable_size(circuits, specs, known, "length", _attr("cable", "LENGTH_M"))


def breaker_sizes(circuits: DataFrame, specs: DataFrame, known: DataFrame) -> DataFrame:
    return _by_cable_size(circuits, specs, known, "breaker", _attr("own", "RATING_A"))


def points(circuits: DataFrame, specs: DataFrame, known: DataFrame, check: str) -> DataFrame:
    """Circuits with more lights (``lighting_points``) or sockets (``socket_points``) than allowed."""
    n = _feeds("LIGHT" if check == "lighting_points" else "SOCKET")
    return _judged(_circuits(circuits, specs, n, n > 0), check, _of(known, check), F.col("value") > F.col("limit"))


def main_switches(parts: DataFrame, specs: DataFrame, known: DataFrame) -> DataFrame:
    """Main switches rated below the limit."""
    mains = parts.where("upper(type) = 'MAIN_SWITCH'").join(specs, "drawing_id").select("drawing_id", "spec", F.col("tag").alias("item"), _attr("attribs", "RATING_A").alias("value"))
    return _judged(mains, "main", _of(known, "main"), F.col("value") < F.col("limit"))


def verdicts(items: DataFrame) -> DataFrame:
    """drawing_id, check, verdict, failing: FAIL with the sorted failing items, null where a limit is unknown and nothing fails, else PASS."""
    bad = F.array_sort(F.collect_list(F.when(F.col("failing"), F.col("item"))))
    each = items.groupBy("drawing_id", "check").agg(bad.alias("failing"), F.count_if(F.col("failing").isNull()).alias("unknown"))
    verdict = F.when(F.size("failing") > 0, "FAIL").when(F.col("unknown") == 0, "PASS")
    return each.select("drawing_id", "check", verdict.alias("verdict"), "failing")


def check_of(question: Column, schematic: Column) -> Column:
    """The check that a question asks for, null if none."""
    text = F.lower(question)
    board = (
        F.when(F.contains(text, F.lit("rcd")) | F.contains(text, F.lit("earth leakage")) | (F.contains(text, F.lit("socket")) & F.contains(text, F.lit("protect"))), "rcd")
        .when(F.contains(text, F.lit("lighting")), "lighting")
        .when(F.contains(text, F.lit("length")) | F.contains(text, F.lit("run")), "length")
        .when(F.contains(text, F.lit("load")), "load")
        .when(F.contains(text, F.lit("breaker")) & (F.contains(text, F.lit("cable")) | F.contains(text, F.lit("sized"))), "breaker")
    )
    plan = (
        F.when(F.contains(text, F.lit("window")), "window")
        .when(F.contains(text, F.lit("door")), "door")
        .when(F.contains(text, F.lit("corridor")), "corridor")
        .when(text.rlike(r"\b(area|size|rooms?)\b"), "area")
    )
    return F.when(schematic, board).otherwise(plan)


def answers(questions: DataFrame, domains: DataFrame, judged: DataFrame) -> DataFrame:
    """question_id, drawing_id, check, final (PASS, FAIL or null) of (question_id, drawing_id, question) by ``verdicts``.

    A check without any item to fail passes; a question that names no check has no answer.
    """
    asked = questions.join(domains, "drawing_id", "left")
    asked = asked.withColumn("check", check_of(F.col("question"), F.coalesce(F.contains("domain", F.lit("schematic")), F.lit(False))))
    found = judged.select("drawing_id", "check", "verdict", F.lit(True).alias("seen"))
    joined = asked.join(found, ["drawing_id", "check"], "left")
    final = F.when(F.col("check").isNull(), F.lit(None)).when(F.col("seen"), F.col("verdict")).when(F.col("check") != "corridor", "PASS")
    return joined.select("question_id", "drawing_id", "check", final.cast("string").alias("final"))
