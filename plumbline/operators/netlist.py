"""Connectivity of schematics, for all drawings at once: conductors, components, distances and what lies downstream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from plumbline.functions.geometry import number
from plumbline.graph import connected_components
from plumbline.operators import apart
from plumbline.operators.measures import CONDUCTORS
from plumbline.operators.spatial import cut_into_segments, points_in_boxes, segments, touching
from plumbline.staging import discard, scratch_path, sent_if_few, stage, unsent

#: Attribute tags in order of precedence, and block names of supplies.
TAGS = ("TAG", "REF", "REFDES", "NAME", "ID")
SOURCES = ("SUPPLY", "SOURCE", "MAINS", "INCOMER", "UTILITY", "GRID")


def is_conductor(layer: Column) -> Column:
    return F.upper(layer).rlike("|".join(CONDUCTORS))


def tag_of(attribs: Column) -> Column:
    """The first of the tag attributes that is not empty."""
    return F.coalesce(*(F.nullif(attribs[k], F.lit("")) for k in TAGS))


def _tolerances(sheets: DataFrame) -> DataFrame:
    extent = F.greatest(F.col("extents.x_max") - F.col("extents.x_min"), F.col("extents.y_max") - F.col("extents.y_min"), F.lit(1.0))
    return sheets.select("drawing_id", F.greatest(F.lit(1e-6), 1e-4 * extent).alias("tol"))


def components(entities: DataFrame) -> DataFrame:
    """drawing_id, tag, ordinal, type, attribs and box of tagged block references; of equal tags the last in file order counts."""
    tag = tag_of(F.col("attribs"))
    tagged = entities.where((F.col("type") == "INSERT") & tag.isNotNull() & F.col("x_min").isNotNull())
    row = F.struct("ordinal", F.col("block").alias("type"), "attribs", "x_min", "y_min", "x_max", "y_max")
    last = tagged.select("drawing_id", tag.alias("tag"), "ordinal", row.alias("r")).groupBy("drawing_id", "tag").agg(F.max_by("r", "ordinal").alias("r"))
    return last.select("drawing_id", "tag", "r.*")


def attachments(entities: DataFrame, sheets: DataFrame, parts: DataFrame) -> DataFrame:
    """(drawing_id, net, tag): components whose box an end of a conductor touches; touching conductors are one net.

    A drawing of ``apart.MOST`` segments and components at most is solved in the task that
    holds it; larger ones go through joins.
    """
    sizes, null = _tolerances(sheets), lambda kind: F.lit(None).cast(kind)
    columns = lambda kind, ordinal, k, tag, *corners: [F.lit(kind).alias("kind"), ordinal.cast("long").alias("ordinal"), k.cast("int").alias("k"), tag.alias("tag"), *(c.cast("double").alias(n) for c, n in zip(corners, ("ax", "ay", "bx", "by"), strict=True))]
    each = cut_into_segments(entities, is_conductor(F.col("layer")))
    rows = [
        sizes.select("drawing_id", *columns(0, null("long"), null("int"), null("string"), F.col("tol"), null("double"), null("double"), null("double"))),
        each.select("drawing_id", *columns(1, F.col("ordinal"), F.col("k"), null("string"), *map(F.col, ("ax", "ay", "bx", "by")))),
        parts.select("drawing_id", *columns(2, F.col("ordinal"), null("int"), F.col("tag"), *map(F.col, ("x_min", "y_min", "x_max", "y_max")))),
    ]
    shape = StructType([parts.schema["drawing_id"], StructField("net", IntegerType()), StructField("tag", StringType())])
    found, large = apart.solved(reduce(DataFrame.union, rows), ["kind", "ordinal", "k"], apart.attached, shape, "net-apart")
    if large.isEmpty():
        return found
    return found.union(_attached_by_joins(*(f.join(large, "drawing_id", "left_semi") for f in (entities, sizes, parts))))


def _attached_by_joins(entities: DataFrame, sizes: DataFrame, parts: DataFrame) -> DataFrame:
    """``attachments`` of drawings of any size; ``sizes`` has their tolerances."""
    wires = stage(segments(entities, is_conductor(F.col("layer"))), "net-segments", grows=True)
    node = lambda c: F.struct("drawing_id", F.col(c).alias("n"))
    joined = connected_components(touching(wires, sizes).select(node("a").alias("a"), node("b").alias("b")))
    named = wires.withColumn("me", node("segment")).join(joined, F.col("me") == F.col("node"), "left").withColumn("net", F.coalesce("component", "me")["n"])
    ends = named.select("drawing_id", "net", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p"))
    ends = ends.select("drawing_id", "net", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    boxed = parts.join(sizes, "drawing_id").select("drawing_id", "tag", "x_min", "y_min", "x_max", "y_max", "tol")
    return points_in_boxes(ends, boxed, pad=F.col("tol")).select("drawing_id", "net", "tag").distinct()


def nets(attached: DataFrame) -> DataFrame:
    """drawing_id, net and its sorted members, for nets of two or more."""
    return attached.groupBy("drawing_id", "net").agg(F.array_sort(F.collect_set("tag")).alias("members")).where(F.size("members") > 1)


def find(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """drawing_id, word, tag: the component that each word of (drawing_id, word) names, exactly or else without case and blanks; of several the last."""
    known = parts.select("drawing_id", "tag", "ordinal", F.upper(F.trim("tag")).alias("_up"))
    hits = wanted.join(known, "drawing_id").where(F.upper(F.trim("word")) == F.col("_up"))
    return hits.groupBy("drawing_id", "word").agg(F.min_by("tag", F.struct((F.col("word") != F.col("tag")).alias("other"), (-F.col("ordinal")).alias("o"))).alias("tag"))


def adjacency(attached: DataFrame) -> DataFrame:
    """(drawing_id, a, b): ordered pairs of components that share a net, for those who want to list them; searches go over nets instead."""
    one, two = attached.alias("x"), attached.alias("y")
    same = (F.col("x.drawing_id") == F.col("y.drawing_id")) & (F.col("x.net") == F.col("y.net")) & (F.col("x.tag") != F.col("y.tag"))
    return one.join(two, same).select(F.col("x.drawing_id").alias("drawing_id"), F.col("x.tag").alias("a"), F.col("y.tag").alias("b")).distinct()


def incidence(links: DataFrame) -> DataFrame:
    """(drawing_id, net, tag): ``links`` as they are if they have nets; each (drawing_id, a, b) as a net of two, whichever way it is given."""
    if "net" in links.columns:
        return links.select("drawing_id", "net", "tag")
    ends = links.select("drawing_id", F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).alias("net"))
    return ends.select("drawing_id", "net", F.explode(F.array("net.a", "net.b")).alias("tag")).distinct()


class _Levels:
    """A table that grows by one folder for each level of a search, and is never rewritten."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.schema = spark, scratch_path(spark, label), None

    def add(self, level: int, rows: DataFrame) -> DataFrame:
        """Write the rows of a level and return them as written."""
        rows.write.parquet(f"{self.path}/level={level}")
        self.schema = rows.schema
        return unsent(self.spark.read.schema(rows.schema).parquet(f"{self.path}/level={level}"))

    def whole(self) -> DataFrame:
        """All levels, with ``level``."""
        return unsent(self.spark.read.schema(StructType([*self.schema.fields, StructField("level", IntegerType())])).parquet(self.path))


def sources(parts: DataFrame) -> DataFrame:
    """(drawing_id, tag): the first supply in file order."""
    supply = parts.where(F.upper("type").rlike("|".join(SOURCES)))
    return supply.groupBy("drawing_id").agg(F.min_by("tag", "ordinal").alias("tag"))


def distances(links: DataFrame, starts: DataFrame, most: int = 10_000) -> DataFrame:
    """(drawing_id, tag, dist): hops from each drawing's starts, over (drawing_id, net, tag) or links (drawing_id, a, b) either way.

    A frontier goes from components to their nets and on to the nets' members; each net is
    opened once, so no pairs of a net are made. Neighbours differ by one hop at most, so
    what was reached before is known from the last nets and the last frontier alone: the
    work and what is written grow with the components and nets reached. Links go from
    component to component at once. Raises where the frontier isn't empty after ``most`` hops.
    Drawings of ``apart.MOST`` rows at most are searched in the tasks that hold them.
    """
    if "net" not in links.columns:
        return _distances_by_links(links, starts, most)
    if not isinstance(links.schema["net"].dataType, (IntegerType, LongType, StringType)):
        return _distances_by_nets(links, starts, most)
    net = links.schema["net"].dataType
    rows = starts.select("drawing_id", F.lit(0).alias("kind"), F.lit(None).cast(net).alias("net"), "tag").union(links.select("drawing_id", F.lit(1).alias("kind"), "net", "tag"))
    shape = StructType([starts.schema["drawing_id"], StructField("tag", starts.schema["tag"].dataType), StructField("dist", IntegerType())])
    found, large = apart.solved(rows, ["kind"], apart.reached(most), shape, "bfs-apart")
    if large.isEmpty():
        return found
    return found.union(_distances_by_nets(*(f.join(large, "drawing_id", "left_semi") for f in (links, starts)), most))


def _distances_by_nets(links: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """``distances`` over nets of drawings of any size, all drawings hop by hop."""
    member = incidence(links)
    levels = _Levels(links.sparkSession, "bfs")
    front, nets = levels.add(0, starts.select("drawing_id", "tag").distinct()), None
    for hop in range(1, most):
        reached = front.join(member, ["drawing_id", "tag"]).select("drawing_id", "net").distinct()
        if nets is not None:
            reached = reached.join(nets, ["drawing_id", "net"], "left_anti")
        opened = stage(reached, "bfs-nets", grows=True)
        found = opened.join(member, ["drawing_id", "net"]).select("drawing_id", "tag").distinct().join(front, ["drawing_id", "tag"], "left_anti")
        if nets is not None:
            discard(nets)
        front, nets = levels.add(hop, found), opened
        if front.isEmpty():
            return levels.whole().select("drawing_id", "tag", F.col("level").alias("dist"))
    raise RuntimeError(f"the frontier is not empty after {most} hops")


def _either_way(links: DataFrame) -> DataFrame:
    """(drawing_id, tag, next): every link of (drawing_id, a, b) from both its ends."""
    return links.select("drawing_id", F.col("a").alias("tag"), F.col("b").alias("next")).union(links.select("drawing_id", "b", "a"))


def _distances_by_links(links: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """``distances`` over links (drawing_id, a, b), which are read as they are: what is new is neither in the last frontier nor in the one before."""
    steps, key = _either_way(links), ["drawing_id", "tag"]
    levels = _Levels(links.sparkSession, "bfs")
    front, before = levels.add(0, starts.select(*key).distinct()), None
    for hop in range(1, most):
        few = sent_if_few(front, front.count())
        found = steps.join(few, key).select("drawing_id", F.col("next").alias("tag")).distinct().join(few, key, "left_anti")
        if before is not None:
            found = found.join(before, key, "left_anti")
        front, before = levels.add(hop, found), few
        if front.isEmpty():
            return levels.whole().select(*key, F.col("level").alias("dist"))
    raise RuntimeError(f"the frontier is not empty after {most} hops")


def ways(links: DataFrame, dist: DataFrame) -> DataFrame:
    """(drawing_id, net, tag, level, below): members of nets that are reached, level being the hops to the net's nearest ones.

    ``below`` marks those one hop further, which the nearest ones feed.
    """
    known = incidence(links).join(dist.select("drawing_id", "tag", "dist"), ["drawing_id", "tag"])
    nearest = known.groupBy("drawing_id", "net").agg(F.min("dist").alias("level"))
    return stage(known.join(nearest, ["drawing_id", "net"]).select("drawing_id", "net", "tag", "level", (F.col("dist") > F.col("level")).alias("below")), "net-ways", grows=True)


def downstream(fed_by: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(drawing_id, root, tag): all that lies on ways of growing distance from each component of ``ways``, itself left out.

    Level by level, what leads to a net is passed to what the net feeds; each level is
    written once. These pairs are the result itself; ``fed`` sums up without making them.
    ``roots`` (drawing_id, tag) limits it to some components. Drawings of ``apart.MOST`` rows
    at most are searched in the tasks that hold them.
    """
    net = fed_by.schema["net"].dataType
    if roots is not None or not isinstance(net, (IntegerType, LongType, StringType)):
        return _downstream_by_levels(fed_by, roots)
    tag = fed_by.schema["tag"].dataType
    shape = StructType([fed_by.schema["drawing_id"], StructField("root", tag), StructField("tag", tag)])
    found, large = apart.solved(fed_by.select("drawing_id", "level", "net", "tag", "below"), [], apart.below, shape, "down-apart")
    if large.isEmpty():
        return found
    return found.union(_downstream_by_levels(fed_by.join(large, "drawing_id", "left_semi"), None))


def _downstream_by_levels(fed_by: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``downstream`` of drawings of any size, all drawings level by level."""
    levels = _Levels(fed_by.sparkSession, "down")
    last = fed_by.agg(F.max("level")).first()[0]
    own = fed_by.where("NOT below").select("drawing_id", F.col("tag").alias("root"), "tag", "level").distinct()
    if roots is not None:
        own = own.join(roots.select("drawing_id", F.col("tag").alias("root")).distinct(), ["drawing_id", "root"])
    own = stage(own, "down-own", grows=True)
    front = levels.add(0, own.where("level < 0").select("drawing_id", "root", "tag"))
    for level in range(last + 1 if last is not None else 0):
        here = fed_by.where(F.col("level") == level).select("drawing_id", "net", "tag", "below")
        leading = front.union(own.where(F.col("level") == level).select("drawing_id", "root", "tag"))
        through = leading.join(here.where("NOT below"), ["drawing_id", "tag"]).select("drawing_id", "root", "net").distinct()
        front = levels.add(level + 1, through.join(here.where("below"), ["drawing_id", "net"]).select("drawing_id", "root", "tag").distinct())
    return levels.whole().select("drawing_id", "root", "tag")


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for the keys: counts and sums added, the attributes of the last by ordinal and of the first by tag."""
    last, first = F.max_by("last", "last_ordinal").alias("last"), F.min_by("first", "first_tag").alias("first")
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last_ordinal").alias("last_ordinal"), last, F.min("first_tag").alias("first_tag"), first)


def fed(parts: DataFrame, fed_by: DataFrame, attribute: str = "LOAD_W") -> DataFrame:
    """What each component feeds, by type: drawing_id, root, type, n, total of an attribute, and the attributes of the last (by ordinal) and first (by tag).

    Components and nets are the nodes of a graph without cycles, by ``ways``. Where every
    node has one parent the graph is a forest, and sums go from the leaves up, level by
    level: one row for each node and type, written once. A node that several lead to is cut
    off its parents, which remember it in place of what it feeds; only such nodes are
    closed over, and each is added once to all that lead to it.
    """
    spark, key = parts.sparkSession, ["drawing_id", "node"]
    node = lambda kind, column: F.struct(F.lit(kind).alias("kind"), F.when(F.lit(kind) == "net", F.to_json(F.struct(column))).otherwise(F.col(column).cast("string")).alias("id"))
    place = F.when(F.col("below"), 2 * F.col("level") + 1).otherwise(2 * F.col("level"))
    up, low = node("part", "tag"), node("net", "net")
    edges = fed_by.select("drawing_id", F.when(F.col("below"), low).otherwise(up).alias("parent"), F.when(F.col("below"), up).otherwise(low).alias("node"), place.alias("place"))
    parents = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("parents"))
    edges = stage(edges.join(parents, key).select("drawing_id", "parent", "node", "place", (F.col("parents") > 1).alias("joined")), "fed-edges", grows=True)
    value = F.coalesce(number(F.element_at("attribs", attribute.upper())), F.lit(0.0))
    part = parts.select("drawing_id", node("part", "tag").alias("node"), "type", F.lit(None).cast(edges.schema["node"].dataType).alias("exit"), F.lit(1).cast("long").alias("n"), value.alias("total"), F.col("ordinal").alias("last_ordinal"), F.col("attribs").alias("last"), F.col("tag").alias("first_tag"), F.col("attribs").alias("first"))
    own = stage(part, "fed-own", grows=True)
    nothing = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("n", "total", "last_ordinal", "last", "first_tag", "first")]
    last = edges.agg(F.max("place")).first()[0]
    levels, below = _Levels(spark, "fed"), own.limit(0)
    below = levels.add((last if last is not None else -1) + 1, below)
    for at in range(last if last is not None else -1, -1, -1):
        here = edges.where(F.col("place") == at)
        # what the children feed and the children themselves, for their one parent; a child of several is remembered by all of them
        sent = own.join(here.where("NOT joined"), key).union(below.join(here.where("NOT joined"), key)) if at % 2 else below.join(here.where("NOT joined"), key)
        held = sent.select("drawing_id", F.col("parent").alias("node"), *own.columns[2:])
        exits = here.where("joined").select("drawing_id", F.col("parent").alias("node"), F.lit(None).cast("string").alias("type"), F.col("node").alias("exit"), *nothing)
        below = levels.add(at, _merged(held.union(exits), "drawing_id", "node", "type", "exit"))
    all_rows = levels.whole().drop("level")
    tree = all_rows.where("exit IS NULL")
    if edges.where("joined").isEmpty():
        whole = tree.where("node.kind = 'part'")
    else:
        reach = stage(all_rows.where("exit IS NOT NULL").select(*key, "exit").distinct(), "fed-exits", grows=True)
        step = reach.select("drawing_id", F.col("node").alias("exit"), F.col("exit").alias("next"))
        grown, front, closure = [reach], reach, reach
        while True:  # exits of exits; each round looks only from what the last one found
            front = stage(front.join(step, ["drawing_id", "exit"]).select(*key, F.col("next").alias("exit")).distinct().join(closure, [*key, "exit"], "left_anti"), "fed-closure", grows=True)
            if front.isEmpty():
                break
            grown.append(front)
            closure = reduce(DataFrame.union, grown)
        cut = edges.where("joined").select(*key).distinct()
        hung = _merged(tree.union(own).join(cut, key, "left_semi"), "drawing_id", "node", "type").withColumnRenamed("node", "exit")
        more = closure.join(stage(hung, "fed-hung", grows=True), ["drawing_id", "exit"]).select(*key, "type", F.lit(None).cast(own.schema["exit"].dataType).alias("exit"), *own.columns[4:])
        whole = _merged(tree.where("node.kind = 'part'").union(more.where("node.kind = 'part'")), "drawing_id", "node", "type")
    return whole.select("drawing_id", F.col("node.id").alias("root"), "type", "n", "total", "last_ordinal", "last", "first_tag", "first")


def downstream_summary(parts: DataFrame, feeding: DataFrame, component_type: str | None = "MCB") -> DataFrame:
    """One row per component of a type, or of any if it is None: its attributes, counts by type of what it feeds, their total, and cable, RCD and RCBO attributes; ``feeding`` is from ``fed``."""
    of_type = F.lit(True) if component_type is None else F.upper("type") == component_type.upper()
    roots = parts.where(of_type).select("drawing_id", F.col("tag").alias("root"), "ordinal", F.col("attribs").alias("own"))
    last = [F.max_by(F.when(F.upper("type") == k, F.col("last")), F.when(F.upper("type") == k, F.col("last_ordinal"))).alias(k.lower()) for k in ("CABLE", "RCD", "RCBO")]
    feeds = F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("feeds")
    out = roots.join(feeding.groupBy("drawing_id", "root").agg(feeds, F.sum("total").alias("total"), *last), ["drawing_id", "root"], "left")
    return out.select("drawing_id", F.col("root").alias("tag"), "ordinal", "own", "feeds", F.round(F.coalesce("total", F.lit(0.0)), 3).alias("total"), "cable", "rcd", "rcbo")


def paths(links: DataFrame, wanted: DataFrame, most: int = 1000) -> DataFrame:
    """(drawing_id, a, b, path, hops): the shortest way of each (drawing_id, a, b), of equal ones the smallest in order of tags.

    ``links`` are as in ``distances``. Pairs without a way are absent; a way from a component
    to itself has no hops. All pairs of one start share its search. A net takes the smallest
    way to any of its members and passes it on, so no pairs of a net are made. Links go from
    component to component at once.
    """
    if "net" not in links.columns:
        return _paths_by_links(links, wanted, most)
    member = incidence(links)
    levels = _Levels(links.sparkSession, "path")
    starts = wanted.select("drawing_id", F.col("a").alias("start")).distinct()
    front, nets = levels.add(0, starts.select("drawing_id", "start", F.col("start").alias("tag"), F.array("start").alias("path"))), None
    for hop in range(1, most):
        reached = front.join(member, ["drawing_id", "tag"]).groupBy("drawing_id", "start", "net").agg(F.min("path").alias("path"))
        if nets is not None:
            reached = reached.join(nets.select("drawing_id", "start", "net"), ["drawing_id", "start", "net"], "left_anti")
        opened = stage(reached, "path-nets", grows=True)
        best = opened.join(member, ["drawing_id", "net"]).groupBy("drawing_id", "start", "tag").agg(F.min("path").alias("path"))
        new = best.join(front.select("drawing_id", "start", "tag"), ["drawing_id", "start", "tag"], "left_anti")
        if nets is not None:
            discard(nets)
        front, nets = levels.add(hop, new.select("drawing_id", "start", "tag", F.concat("path", F.array("tag")).alias("path"))), opened
        if front.isEmpty():
            found = levels.whole().select("drawing_id", F.col("start").alias("a"), F.col("tag").alias("b"), "path")
            return wanted.join(found, ["drawing_id", "a", "b"]).select("drawing_id", "a", "b", "path", (F.size("path") - 1).alias("hops"))
    raise RuntimeError(f"the frontier is not empty after {most} hops")


def _paths_by_links(links: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """``paths`` over links (drawing_id, a, b), which are read as they are."""
    steps, key = _either_way(links), ["drawing_id", "start", "tag"]
    levels = _Levels(links.sparkSession, "path")
    starts = wanted.select("drawing_id", F.col("a").alias("start")).distinct()
    front, before = levels.add(0, starts.select("drawing_id", "start", F.col("start").alias("tag"), F.array("start").alias("path"))), None
    for hop in range(1, most):
        few = sent_if_few(front, front.count())
        best = steps.join(few, ["drawing_id", "tag"]).groupBy("drawing_id", "start", F.col("next").alias("tag")).agg(F.min("path").alias("path"))
        new = best.join(few.select(*key), key, "left_anti")
        if before is not None:
            new = new.join(before.select(*key), key, "left_anti")
        front, before = levels.add(hop, new.select(*key, F.concat("path", F.array("tag")).alias("path"))), few
        if front.isEmpty():
            found = levels.whole().select("drawing_id", F.col("start").alias("a"), F.col("tag").alias("b"), "path")
            return wanted.join(found, ["drawing_id", "a", "b"]).select("drawing_id", "a", "b", "path", (F.size("path") - 1).alias("hops"))
    raise RuntimeError(f"the frontier is not empty after {most} hops")


def path_between(links: DataFrame, a: str, b: str) -> DataFrame:
    """(drawing_id, path, hops): the way from a to b in every drawing that has one."""
    wanted = incidence(links).where(F.col("tag") == a).select("drawing_id", F.lit(a).alias("a"), F.lit(b).alias("b")).distinct()
    return paths(links, wanted).select("drawing_id", "path", "hops")


def highest_load(circuits: DataFrame) -> DataFrame:
    """drawing_id, tag, total: the circuit of ``downstream_summary`` with the highest total, of equal ones the first in file order."""
    place = F.struct((-F.col("total")).alias("t"), "ordinal")
    return circuits.groupBy("drawing_id").agg(F.min_by("tag", place).alias("tag"), F.max("total").alias("total"))


def glance(circuits: DataFrame) -> DataFrame:
    """drawing_id, circuits, load_kw, protected (circuits behind an RCD): a board at a glance."""
    return circuits.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("circuits"), F.round(F.sum("total") / 1000, 1).alias("load_kw"), F.count("rcd").alias("protected"))


def load_shares(circuits: DataFrame) -> DataFrame:
    """drawing_id, tag, total and its percentage of the board's highest, 0 where that is 0."""
    most = circuits.groupBy("drawing_id").agg(F.max("total").alias("most"))
    return circuits.join(most, "drawing_id").select("drawing_id", "tag", "total", F.round(F.when(F.col("most") > 0, 100 * F.col("total") / F.col("most")).otherwise(0.0), 3).alias("share"))
