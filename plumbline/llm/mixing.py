"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source is wanted ``target / source size`` times. The whole part is taken
at once; the fraction is a probability, held as a mass of words. Masses are paired: a
random transfer, fair to both, makes one of the two documents integral (left out or taken
once more), and the other carries the rest on. Blocks of documents are folded this way in
parallel, the one left over from each block goes to the next level, and so on down to one
for each source. That last one is rounded to the nearer side, so the words
taken from a source miss its target by at most half of it. All chance comes from hashes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from plumbline.ranking import number_in_order
from plumbline.staging import stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK = 64
SEED = 20_240_601
#: Equal units that one task makes.
CELL = 20_000
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column).cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")


def counted(units: DataFrame) -> DataFrame:
    """Staged (source, key, size, m): equal units once, with how many of them there are."""
    return stage(units.groupBy("source", "key", "size").agg(F.count(F.lit(1)).alias("m")), "mix-units")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n, target from (source, size), or with m of such units in a row: one row per source.

    Sources by code point, null last, weigh ``weights`` in turn. They share ``share`` of
    all sizes; none gets more than ``most`` times its size, and what is over is shared
    again by weight among the others. Each pass caps at least one source or ends.
    """
    m = F.col("m") if "m" in sizes.columns else F.lit(1).cast("long")
    totals = sizes.groupBy("source").agg(F.sum(m * F.col("size")).cast("long").alias("source_size"), F.sum(m).alias("n")).withColumn("none", F.col("source").isNull())
    placed = number_in_order(totals, [], ["none", "source"], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    known = stage(placed.select("source", "source_size", "n", weight.cast("long").alias("weight")), "mix-sources")
    whole = share * (known.agg(F.sum("source_size")).first()[0] or 0)
    cap = most * F.col("source_size")
    capped, level = -1, 0.0
    rule = F.lit(False)
    while True:
        r = known.agg(F.sum(F.when(rule, cap)).alias("held"), F.count(F.when(rule, 1)).alias("capped"), F.sum(F.when(~rule, F.col("weight"))).alias("open")).first()
        if r["capped"] == capped:
            break
        capped = r["capped"]
        if not r["open"]:
            break
        level = (whole - (r["held"] or 0.0)) / r["open"]
        rule = rule | (F.col("weight") * F.lit(level) > cap)
    target = F.when(rule, cap).otherwise(F.col("weight") * F.lit(level))
    return known.select("source", "source_size", "n", target.cast("double").alias("target"))


def _chance(*of: Column) -> Column:
    """A number from 0 up to 1 that depends on the hash alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), *of), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold(units: Column) -> Column:
    """Settle a block: struct(done array of units, rest the unit that is left). A unit is (size, h, key, whole, mass)."""

    def settled(u: Column, mass: Column) -> Column:
        return F.struct(*(u[f].alias(f) for f in ("size", "h", "key", "whole")), mass.alias("mass"))

    def step(state: Column, u: Column) -> Column:
        c = state["rest"]
        give = F.least(c["mass"], u["size"] - u["mass"])
        take = F.least(u["mass"], c["size"] - c["mass"])
        to_u = _chance(c["h"], u["h"]) * (give + take) < take
        c_mass = F.when(to_u, F.when(give == c["mass"], F.lit(0.0)).otherwise(c["mass"] - give)).otherwise(F.when(take == u["mass"], c["mass"] + take).otherwise(c["size"].cast("double")))
        u_mass = F.when(to_u, F.when(give == c["mass"], u["mass"] + give).otherwise(u["size"].cast("double"))).otherwise(F.when(take == u["mass"], F.lit(0.0)).otherwise(u["mass"] - take))
        c_done = F.when(to_u, give == c["mass"]).otherwise(take != u["mass"])
        return F.struct(F.concat(state["done"], F.array(F.when(c_done, settled(c, c_mass)).otherwise(settled(u, u_mass)))).alias("done"), F.when(c_done, settled(u, u_mass)).otherwise(settled(c, c_mass)).alias("rest"))

    def whole(sorted_units: Column) -> Column:
        first = F.struct(F.slice(sorted_units, 1, 0).alias("done"), sorted_units[0].alias("rest"))
        return F.aggregate(F.slice(sorted_units, 2, F.greatest(F.size(sorted_units) - 1, F.lit(0))), first, step)

    return F.transform(F.array(F.sort_array(units, asc=False)), whole)[0]


def _each(units: DataFrame) -> DataFrame:
    """Counted units one by one, with ``again`` from 0 among equal ones; a unit of many goes to as many tasks as it has cells."""
    few = units.where(F.col("m") <= CELL).select("source", "key", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("again"))
    cells = units.where(F.col("m") > CELL).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / CELL))).alias("cell")).repartition("key", "cell")
    many = cells.select("source", "key", "size", F.explode(F.sequence(F.col("cell") * CELL, F.least("m", (F.col("cell") + 1) * CELL) - 1)).alias("again"))
    return few.union(many)


def copies(units: DataFrame, known: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, key, size, copies long) for units of (source, key struct, size long, m equal ones); one row per single unit.

    Units of no words are taken as often as the whole part of their source's rate.
    Blocks hold some ``block`` units of a source by hash, whatever its size; equal units are
    numbered, so that they lie in blocks of their own.
    """
    each = _each(units)
    rated = each.join(known, each["source"].eqNullSafe(known["source"])).drop(known["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + 1e-12)
    mass = F.greatest(rate - whole, F.lit(0.0)) * F.col("size")
    ready = rated.select("source", "n", F.struct("size", F.when(F.col("again") == 0, F.xxhash64("key", "size")).otherwise(F.xxhash64("key", "size", "again")).alias("h"), "key", whole.cast("long").alias("whole"), mass.alias("mass")).alias("u"))
    settled = ready.where((F.col("u.size") == 0) | (F.col("u.mass") <= 0)).select("source", F.struct(*(F.col(f"u.{f}") for f in ("size", "h", "key", "whole")), F.lit(0.0).alias("mass")).alias("u"))
    level_rows, most, level = ready.where((F.col("u.size") > 0) & (F.col("u.mass") > 0)), known.agg(F.max("n")).first()[0] or 0, 0
    parts = [settled]
    while True:
        blocks = F.when(F.col("n") <= 2 * block, F.lit(1)).otherwise(F.ceil(F.col("n") / block))
        dealt = level_rows.withColumn("n", blocks.cast("long")).withColumn("b", F.pmod(F.xxhash64(F.lit(level), F.col("u.h")), F.col("n")))
        folded = stage(dealt.groupBy("source", "n", "b").agg(F.collect_list("u").alias("us")).select("source", "n", _fold(F.col("us")).alias("f")), "mix-level")
        parts.append(folded.select("source", F.explode("f.done").alias("u")))
        level_rows = folded.select("source", "n", F.col("f.rest").alias("u"))
        if most <= 2 * block:
            break
        most, level = -(-most // block), level + 1
    last = 2 * F.col("u.mass") > F.col("u.size")  # the nearer of the two, so that the miss is at most half a document
    parts.append(level_rows.select("source", F.struct(*(F.col(f"u.{f}") for f in ("size", "h", "key", "whole")), F.when(last, F.col("u.size").cast("double")).otherwise(F.lit(0.0)).alias("mass")).alias("u")))
    done = parts[0]
    for part in parts[1:]:
        done = done.union(part)
    once_more = F.when((F.col("u.size") > 0) & (F.col("u.mass") * 2 > F.col("u.size")), F.lit(1)).otherwise(F.lit(0))
    return done.select("source", F.col("u.key").alias("key"), F.col("u.size").alias("size"), (F.col("u.whole") + once_more).cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken (all but doc_id and target long), one row per document.

    A null text has no words and a null source is a source of its own. Repeated rows
    are documents of their own. An empty table gives an empty table.
    """
    sized = counted(docs.select(F.col(source_col).alias("source"), F.struct(F.col(id_col).alias("doc_id")).alias("key"), word_count(text_col).alias("size")))
    known = stage(targets(sized), "mix-targets")
    taken = copies(sized, known)
    out = taken.join(known, taken["source"].eqNullSafe(known["source"]))
    return out.select(F.col("key.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _hashable(column: Column, kind: DataType) -> Column:
    """The column, or its JSON where its type holds something that can't be hashed."""
    said = kind.simpleString()
    return F.to_json(F.struct(column.alias("c"))) if "map<" in said or "variant" in said else column


def _row_key(docs: DataFrame) -> Column:
    """128 bits that tell a row by all its columns; which of them are null counts too."""
    parts = [_hashable(F.col(f"`{f.name}`"), f.dataType) for f in docs.schema.fields]
    parts += [F.col(f"`{f.name}`").isNull() for f in docs.schema.fields]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("again"), *reversed(parts)).alias("b"))


def mixed_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its columns, whatever their names.

    Rows that are equal in all columns are taken together and repeated. A row is found
    again by 128 bits of hashes of all its columns.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(_row_key(docs).alias("key"), F.col(f"`{source_col}`").alias("source"), word_count(text_col).alias("size"), whole.alias("row"))
    sized = counted(keyed.select("source", "key", "size"))
    wanted = copies(sized, stage(targets(sized), "mix-targets")).groupBy("key").agg(F.sum("copies").alias("times")).where("times > 0")
    wanted = stage(wanted.select("key.a", "key.b", "times"), "mix-wanted")
    once = keyed.select("key.a", "key.b", "row").dropDuplicates(["a", "b"])
    taken = once.join(wanted, ["a", "b"]).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    return taken.select("row.*")
