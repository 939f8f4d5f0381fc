"""Balanced label propagation: linked documents gather in one shard under capacity quotas.

Links are groups: the documents of a group are all linked to each other. As the members
of a group are alike, the state of the propagation is a table of (group, shard, members),
not of documents. Where all are linked to all, a first step without quotas takes a group
to one shard whole; propagation starts from there, with shards by hash. Each round, parts
of a group ask to join its largest part where there is room, and shards that hold too much
pass whole groups on to shards that have room for them. Where no group fits as it is, two
groups of different sizes change places, and only where that doesn't help either is the
smallest part of a full shard split, so cuts stay few. Rounds end when no shard holds too
much and no part can join another. Documents without links then fill every shard exactly
to its capacity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from plumbline.ranking import ROWS_PER_CELL, cells_for, number_within
from plumbline.staging import stage

SHARDS = 8
#: The least number of cells that rows are numbered in, and the sizes of a shard's groups, from the smallest, that may change places.
CELLS, SIZES = 1024, 64


def _running(df: DataFrame, group: list[str], spread: Column, order: list[Column], weight: str, out: str, cells: int) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows before, in each group, by cells of ``spread`` as in ``number_within``."""
    keyed = df.withColumn("_cell", F.pmod(spread, F.lit(cells)))
    names = [*group, "_cell"]
    sums = keyed.groupBy(*names).agg(F.sum(weight).alias("_sum"))
    before = (W.partitionBy(*group) if group else W.partitionBy(F.lit(0))).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_o_{c}") for c in names], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    own = W.partitionBy(*names).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = keyed.withColumn("_own", F.coalesce(F.sum(weight).over(own), F.lit(0)))
    same = [summed[c] == offsets[f"_o_{c}"] for c in names]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return summed.join(offsets, on).withColumn(out, F.col("_offset") + F.col("_own")).drop("_cell", "_own", "_offset", *[f"_o_{c}" for c in names])


def _by_room(number: Column, room: list[int]) -> Column:
    """The shard of a running number when shards are filled one after the other."""
    out, start = F.lit(None).cast("int"), 0
    cases = []
    for j, free in enumerate(room):
        cases.append((start + free, j))
        start += free
    for end, j in reversed(cases):
        out = F.when(number < end, F.lit(j)).otherwise(out)
    return out


def _loads(state: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [int(found.get(j) or 0) for j in range(shards)]


Orders = list[tuple[bytes, int, int, int]]


def _moved(state: DataFrame, orders: Orders) -> DataFrame:
    """The state after (hub, from, to, n) have moved; a few for each shard at most."""
    spark = state.sparkSession
    rows = [(hub, s, -n) for hub, s, _, n in orders] + [(hub, t, n) for hub, _, t, n in orders]
    parts = state.select("hub", "shard", "n").union(spark.createDataFrame(rows, "hub binary, shard int, n long"))
    return stage(parts.groupBy("hub", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "lp-state")


def _passed_on(state: DataFrame, over: dict[int, int], room: dict[int, int], cells: int, turn: int) -> DataFrame | None:
    """Whole parts of shards that hold too much go where there is room for them; null if none does. Only sums by pairs of shards reach the driver."""
    fits = F.filter(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(r).cast("long").alias("r")) for t, r in room.items())), lambda x: x["r"] >= F.col("n"))
    goal = F.get(fits, F.pmod(F.xxhash64("hub", F.lit(turn)), F.greatest(F.size(fits), F.lit(1)).cast("long")).cast("int"))["t"]
    excess = F.coalesce(*(F.when(F.col("shard") == s, F.lit(e).cast("long")) for s, e in over.items()), F.lit(0).cast("long"))
    asked = state.select("hub", "shard", "n", F.when(F.col("n") <= excess, goal).alias("goal"))
    wants = {(r["shard"], r["goal"]): int(r["n"]) for r in asked.where("goal IS NOT NULL").groupBy("shard", "goal").agg(F.sum("n").alias("n")).collect()}
    left, free, quota = dict(over), dict(room), {}
    for (s, t), n in sorted(wants.items(), key=lambda x: (-x[1], x[0])):
        quota[s, t] = min(n, left[s], free[t])
        left[s] -= quota[s, t]
        free[t] -= quota[s, t]
    limit = F.coalesce(*(F.when((F.col("shard") == s) & (F.col("goal") == t), F.lit(n).cast("long")) for (s, t), n in quota.items()), F.lit(0).cast("long"))
    queued = _running(asked.where("goal IS NOT NULL").where(F.col("n") <= limit), ["shard", "goal"], F.xxhash64("hub"), [F.col("n").desc(), F.col("hub")], "n", "before", cells)
    moving = stage(queued.where(F.col("before") + F.col("n") <= limit).select("hub", "shard", "goal", "n"), "lp-moving")
    if moving.isEmpty():
        return None
    gone = moving.select("hub", F.col("shard").alias("from"))
    stay = state.join(gone, (state["hub"] == gone["hub"]) & (state["shard"] == gone["from"]), "left_anti").select("hub", "shard", "n")
    return stage(stay.union(moving.select("hub", F.col("goal").alias("shard"), "n")).groupBy("hub", "shard").agg(F.sum("n").alias("n")), "lp-state")


def _gather(state: DataFrame, room: dict[int, int]) -> Orders:
    """Parts that join their group's largest part, or a larger one where that has no room; those that save most links first, one a shard."""
    rank = F.struct("n", "shard")
    sized = state.groupBy("hub").agg(F.array_sort(F.collect_list(rank)).alias("parts")).where(F.size("parts") > 1)
    free = {t: r for t, r in room.items() if r > 0}
    if not free:
        return []
    open_to = F.coalesce(*(F.when(F.col("b.shard") == t, F.lit(r).cast("long")) for t, r in free.items()), F.lit(0).cast("long"))
    pairs = sized.select("hub", F.explode("parts").alias("a"), "parts").select("hub", "a", F.explode("parts").alias("b")).where((F.struct("b.n", "b.shard") > F.struct("a.n", "a.shard")) & (F.col("a.n") <= open_to))
    best = pairs.groupBy(F.col("b.shard").alias("to")).agg(F.max(F.struct((F.col("a.n") * F.col("b.n")).alias("saved"), "hub", F.col("a.shard").alias("from"), F.col("a.n").alias("n"))).alias("m")).collect()
    taken, orders = set(), []
    for r in sorted(best, key=lambda r: -r["m"]["saved"]):
        hub = bytes(r["m"]["hub"])
        if hub not in taken:
            taken.add(hub)
            orders.append((hub, r["m"]["from"], r["to"], r["m"]["n"]))
    return orders


def _exchanged(state: DataFrame, over: dict[int, int], room: dict[int, int]) -> Orders:
    """For each shard that holds too much: a whole part to a shard with room for it, or two parts that change places, or a split of its smallest part, whichever comes first."""
    smallest = W.partitionBy("shard").orderBy("n")
    kinds = state.groupBy("shard", "n").agg(F.min("hub").alias("hub")).withColumn("_place", F.row_number().over(smallest)).where(F.col("_place") <= SIZES)
    held: dict[int, dict[int, bytes]] = {}
    for r in kinds.collect():
        held.setdefault(r["shard"], {})[r["n"]] = bytes(r["hub"])
    larger = F.coalesce(*(F.when(F.col("shard") == s, F.lit(e).cast("long")) for s, e in over.items()), F.lit(0).cast("long"))
    above = state.where(F.col("shard").isin(list(over))).where(F.col("n") > larger).groupBy("shard").agg(F.min(F.struct("n", "hub")).alias("m")).collect()
    next_up = {r["shard"]: (r["m"]["n"], bytes(r["m"]["hub"])) for r in above}
    free, used, orders = dict(room), set(), []
    for s, e in sorted(over.items(), key=lambda x: (-x[1], x[0])):
        n, hub = next_up.get(s, (0, b""))
        fits = [(r, t) for t, r in free.items() if n and r >= n and t not in used]
        if fits:
            r, t = min(fits)
            orders.append((hub, s, t, n))
            free[t] -= n
            used |= {s, t}
            continue
        swaps = [(min(e, r) - (x - y), x, y, t) for t, r in free.items() if t not in used for x in held.get(s, {}) for y in held.get(t, {}) if 0 < x - y <= min(e, r) and held[s][x] != held[t][y]]
        if swaps:
            _, x, y, t = min(swaps)
            orders += [(held[s][x], s, t, x), (held[t][y], t, s, y)]
            used |= {s, t}
    if orders:
        return orders
    s, e = max(over.items(), key=lambda x: (x[1], -x[0]))
    r, t = max((r, -t) for t, r in free.items())
    n = min(held[s])
    return [(held[s][n], s, -t, min(e, r, n))]


def propagate(groups: DataFrame, capacity: list[int], rounds: int | None = None) -> DataFrame:
    """(hub, shard, n): how many members of each group go to each shard, for ``groups`` of (hub, members).

    The sum of members must fit the capacities, and no shard gets more than its own.
    Every round lessens what shards hold too much or the parts of groups, so rounds end;
    ``rounds`` ends them before, and what is over then is cut off from the smallest parts.
    """
    shards = len(capacity)
    state = stage(groups.select("hub", F.pmod(F.xxhash64("hub"), F.lit(shards)).cast("int").alias("shard"), F.col("members").cast("long").alias("n")), "lp-start")
    cells = max(CELLS, cells_for(state.count()))
    turn, split, whole = 0, False, True
    while rounds is None or turn < rounds:
        turn += 1
        loads = _loads(state, shards)
        over = {j: x - c for j, (x, c) in enumerate(zip(loads, capacity, strict=True)) if x > c}
        room = {j: c - x for j, (x, c) in enumerate(zip(loads, capacity, strict=True)) if x < c}
        orders = _gather(state, room) if split else []
        if not orders and over and whole:
            passed = _passed_on(state, over, room, cells, turn)
            whole = passed is not None
            state = state if passed is None else passed
            continue
        if not orders and over:
            orders = _exchanged(state, over, room)
            split = split or len(orders) == 1
        if not orders:
            return state
        state, whole = _moved(state, orders), True
    return _within(state, capacity, cells)


def _within(state: DataFrame, capacity: list[int], cells: int) -> DataFrame:
    """Move what exceeds a capacity, smallest parts of groups first, to shards with room."""
    loads = _loads(state, len(capacity))
    over = {j: x - c for j, (x, c) in enumerate(zip(loads, capacity, strict=True)) if x > c}
    if not over:
        return state
    room = [max(0, c - x) for c, x in zip(capacity, loads, strict=True)]
    excess = F.lit(0).cast("long")
    for j, n in over.items():
        excess = F.when(F.col("shard") == j, F.lit(n).cast("long")).otherwise(excess)
    queued = _running(state.where(F.col("shard").isin(list(over))), ["shard"], F.xxhash64("hub"), [F.col("n"), F.col("hub")], "n", "before", cells)
    out = stage(queued.withColumn("m", F.greatest(F.least(F.col("n"), excess - F.col("before")), F.lit(0).cast("long"))), "lp-over")
    units = out.where("m > 0").select("hub", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("u"))
    numbered = number_within(stage(units.withColumn("g", F.lit(0)), "lp-units"), ["g"], F.xxhash64("hub", "u"), [F.col("hub"), F.col("u")], "k", cells)
    placed = numbered.select("hub", _by_room(F.col("k"), room).alias("shard"), F.lit(1).cast("long").alias("n"))
    stay = state.where(~F.col("shard").isin(list(over))).union(out.select("hub", "shard", (F.col("n") - F.col("m")).alias("n")))
    return stage(stay.union(placed).where("n > 0").groupBy("hub", "shard").agg(F.sum("n").alias("n")), "lp-state")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` in a shard from 0, under the law ``rows``: counts at most one apart.

    Equal texts are linked (a null text equals an empty one). Columns: doc_id, size long
    (UTF-8 bytes plus 1), text_crc32 long, law, shard int, slot long (gapless from 0 in its
    shard), grown_shard int (always null under this law). Null and repeated ids are rows
    like any other; equal rows are told apart by the partition that they were read in, which
    is stored, so that they spread over cells. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id", (F.octet_length("t") + 1).cast("long").alias("size"), F.crc32("t").alias("text_crc32"), F.unhex(F.md5("t")).alias("hub"), F.spark_partition_id().alias("salt")
    )
    rows = stage(rows, "shard-rows")
    total = rows.count()
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    groups = stage(rows.groupBy("hub").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shard-groups")
    state = propagate(groups, capacity)
    room = [c - x for c, x in zip(capacity, _loads(state, shards), strict=True)]
    cells = max(CELLS, cells_for(total))

    linked = stage(rows.join(groups.select("hub"), "hub", "left_semi"), "shard-linked")
    before = W.partitionBy("hub").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    runs = state.select(F.col("hub").alias("h"), "shard", F.sum("n").over(before).alias("end"), "n")
    named = number_within(linked, ["hub"], F.xxhash64("doc_id", "size", "salt"), [F.col("doc_id")], "k", cells)
    # the runs of a group, at most one a shard, travel as one row, and in as many copies as its members fill cells of rows
    ends = runs.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"), F.ceil(F.max("end") / ROWS_PER_CELL).alias("parts"))
    ends = ends.select("h", "ends", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    dealt_out = named.withColumn("part", F.floor(F.col("k") / ROWS_PER_CELL).cast("long"))
    place = F.filter("ends", lambda e: F.col("k") < e["end"])[0]["shard"]
    placed = dealt_out.join(ends, (dealt_out["hub"] == ends["h"]) & (dealt_out["part"] == ends["part"])).withColumn("shard", place)

    single = stage(rows.join(groups.select("hub"), "hub", "left_anti").withColumn("g", F.lit(0)), "shard-single")
    filled = number_within(single, ["g"], F.xxhash64("hub"), [F.col("hub")], "k", cells).withColumn("shard", _by_room(F.col("k"), room))

    names = ["doc_id", "size", "text_crc32", "salt", "shard"]
    dealt = stage(placed.select(*names).union(filled.select(*names)), "shard-dealt")
    out = number_within(dealt, ["shard"], F.xxhash64("doc_id", "size", "text_crc32", "salt"), [F.col("doc_id"), F.col("text_crc32")], "slot", cells)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
