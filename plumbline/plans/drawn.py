"""Drawings made from the star schema: floor plans, boards, circuits and plates, as parsed drawings.

Every part is a room of a plan (24 to a plan), every customer a circuit of a board (20 to a
board) whose orders are its loads, every supplier a component of a circuit diagram and a
hole of a plate (10 to each). All sizes and places follow from keys, so what an operator
must find can be told from the tables alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators.planner import Facts
from plumbline.sources import dxf
from plumbline.staging import spread, stage

ROOMS, CIRCUITS, COMPONENTS = 24, 20, 10
#: Kinds of rooms by turns, of loads and of components, and ratings and sizes of cables.
ROOM_KINDS = ["BEDROOM", "LIVING", "KITCHEN", "STUDY", "BATH", "CORRIDOR", "STORE"]
LOAD_KINDS = ["LIGHT", "SOCKET", "AC_UNIT", "WATER_HEATER"]
PART_KINDS = [("RESISTOR", "R", "VALUE_OHM"), ("CAPACITOR", "C", "VALUE_UF"), ("LED", "D", "COLOR")]
RATINGS, SIZES, MAINS = [6, 10, 16, 20, 32], ["1.5", "2.5", "4", "6", "10"], [50, 63, 80, 100]
_NAMES = [c.split(" ", 1) for c in dxf.ENTITY.split(", ")[1:]]
_KINDS = dict(_NAMES)


def _pick(values: list, place: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), place.cast("int"))


def _double(v: Column | float) -> Column:
    return (F.lit(v) if isinstance(v, (int, float)) else v).cast("double")


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _entity(rows: DataFrame, ordinal: Column, kind: str, layer: str, points: list[tuple] = (), closed: bool = False, **columns: Column) -> DataFrame:
    """One entity for every row; what is not given is null, and the vertices, box, length and area follow from the points.

    The points are few and known by name, so they are summed up as they stand, in the order
    in which ``geometry`` goes over an array of them, without a function called for each.
    """
    have = {"ordinal": ordinal, "handle": F.hex(ordinal), "type": F.lit(kind), "layer": F.lit(layer), "closed": F.lit(closed), **columns}
    if points:
        ends = [tuple(_double(v) for v in p) for p in points]
        edges = list(zip(ends, ends[1:] + ends[:1] if closed else ends[1:]))
        have["vertices"] = F.array(*(_point(x, y) for x, y in ends))
        have["length"] = reduce(Column.__add__, (G.segment_length(*a, *b) for a, b in edges))
        if closed:
            have["area"] = F.abs(reduce(Column.__add__, (a[0] * b[1] - b[0] * a[1] for a, b in edges))) / 2
        for axis, of in zip("xy", zip(*ends)):
            low, high = F.least(*of), F.greatest(*of)
            have |= {f"{axis}_min": low, f"{axis}_max": high, f"c{axis}": (low + high) / 2}
    if kind == "CIRCLE":
        r = have["radius"]
        have |= {"length": G.circle_length(r), "area": G.circle_area(r), "closed": F.lit(True)}
        for axis in "xy":
            have |= {f"{axis}_min": have[f"c{axis}"] - r, f"{axis}_max": have[f"c{axis}"] + r}
    return rows.select("drawing_id", *(have.get(n, F.lit(None)).cast(t.replace(":", " ") if "<" not in t else t).alias(n) for n, t in _NAMES))


def _line(rows: DataFrame, ordinal: Column, layer: str, a: tuple, b: tuple) -> DataFrame:
    return _entity(rows, ordinal, "LINE", layer, [a, b])


def _attribs(given: dict[str, Column]) -> Column:
    """The attributes that are not null, by name; where none is null, which is the rule, no function is called for each."""
    held = {k: v.cast("string") for k, v in given.items()}
    whole = reduce(Column.__and__, (v.isNotNull() for v in held.values()))
    some = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in held.items())), lambda e: e["v"].isNotNull()))
    return F.when(whole, F.create_map(*(c for k, v in held.items() for c in (F.lit(k), v)))).otherwise(some)


def _device(rows: DataFrame, ordinal: Column, block: Column | str, x: Column | float, top: Column | float, height: float = 20.0, half: float = 10.0, layer: str = "DEVICES", **attribs: Column) -> DataFrame:
    """A block reference with a box around x from ``top`` downwards."""
    name = F.lit(block) if isinstance(block, str) else block
    x, top = (F.lit(v) if isinstance(v, (int, float)) else v for v in (x, top))
    return _entity(rows, ordinal, "INSERT", layer, block=name, scale=F.lit(1.0), rotation=F.lit(0.0), cx=x, cy=top, x_min=x - half, x_max=x + half, y_min=top - height, y_max=top, attribs=_attribs(attribs))


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drawing_id, i, x, y, w, h and name of the room of every part."""
    k = F.col("p_partkey")
    i = (k % ROOMS).cast("int")
    kind = _pick(ROOM_KINDS, i % 7)
    name = F.when(i == 5, "CORRIDOR").otherwise(F.concat(kind, F.lit(" "), i.cast("string")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.concat(F.lit("plan-"), F.floor(k / ROOMS).cast("string")).alias("drawing_id"), k.alias("k"), i.alias("i"), name.alias("name"),
        (i % 6 * 9000).cast("double").alias("x"), (F.floor(i / 6) * 9000).cast("double").alias("y"),
        (F.col("p_size") * 100 + 1000).cast("double").alias("w"), (k % 31 * 100 + 1800).cast("double").alias("h"),
    )


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stage(spread(rooms(spark, sf_dir)), "drawn-rooms", grows=True)
    at, x, y, w, h = F.col("i") * 10, F.col("x"), F.col("y"), F.col("w"), F.col("h")
    mid = {"cx": x + w / 2, "cy": y + h / 2}
    corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    said = r.where("i % 7 = 6")
    return reduce(DataFrame.unionByName, [
        _entity(r, at, "LWPOLYLINE", "ROOMS", corners, closed=True),
        _entity(r, at + 1, "TEXT", "ROOM_NAMES", text=F.col("name"), **mid),
        _entity(said, at + 2, "MTEXT", "ROOM_NAMES", text=F.concat(F.lit("note "), "i"), cx=x + w / 2, cy=y + h / 2 - 300),
        _entity(r, at + 3, "INSERT", "DOORS", block=F.lit("Door"), scale=(F.col("k") % 5 * 50 + 650).cast("double"), rotation=F.lit(0.0), cx=x + 300, cy=y, x_min=x + 300, y_min=y, x_max=x + 1000, y_max=y + 700),
        _line(r.where("k % 3 <> 0"), at + 4, "WINDOWS", (x + 200, y + h), (x + 800, y + h)),
        _line(r, at + 5, "WALLS", (x, y), (x + w, y)),
        _entity(r, at + 6, "LWPOLYLINE", "WALLS", [corners[3], corners[0], corners[1]]),
        _entity(r, at + 7, "DIMENSION", "DIMENSIONS", measurement=w, cx=x, cy=y - 100, x_min=x, x_max=x + w, y_min=y - 100, y_max=y - 100),
    ])


def circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drawing_id, p (place on its board), c, x, kind of load and tag of the circuit of every customer."""
    c = F.col("c_custkey")
    p = (c % CIRCUITS).cast("int")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.concat(F.lit("db-"), F.floor(c / CIRCUITS).cast("string")).alias("drawing_id"), p.alias("p"), c.alias("c"), (p * 100 + 200).cast("double").alias("x"),
        _pick(LOAD_KINDS, c % 4).alias("kind"), F.concat(F.lit("C"), (p + 1).cast("string")).alias("tag"),
    )


def _boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stage(spread(circuits(spark, sf_dir)), "drawn-circuits", grows=True)
    board = c.select("drawing_id", F.floor(F.col("c") / CIRCUITS).cast("int").alias("b")).distinct()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"))
    nth = F.row_number().over(W.partitionBy("c").orderBy("o")) - 1
    load = stage(orders.withColumn("j", nth).join(c, "c"), "drawn-loads", grows=True)
    fed = load.groupBy("drawing_id", "p", "x").agg(F.max("j").alias("last"))
    at, x, number = F.col("p") * 100_000 + 100, F.col("x"), (F.col("p") + 1).cast("string")
    low = (-170 - F.col("j") * 30).cast("double")
    guarded = F.col("c") % 3 != 0
    return reduce(DataFrame.unionByName, [
        _device(board, F.lit(0), "Supply", 10.0, 10.0, TAG=F.lit("SUP1"), VOLTAGE_V=F.lit("230")),
        _line(board, F.lit(1), "WIRES", (20, 0), (60, 0)),
        _device(board, F.lit(2), "MAIN_SWITCH", 70.0, 10.0, TAG=F.lit("MAIN"), RATING_A=_pick(MAINS, F.col("b") % 4)),
        _line(board, F.lit(3), "BUSBAR", (80, 0), (CIRCUITS * 100 + 300, 0)),
        _device(board, F.lit(4), "METER", 10.0, 510.0, REF=F.lit("X9")),
        _line(c, at, "WIRES", (x, 0), (x, -30)),
        _device(c, at + 1, "MCB", x, -30.0, TAG=F.col("tag"), RATING_A=_pick(RATINGS, F.col("c") % 5), CURVE=F.lit("B")),
        _line(c, at + 2, "WIRES", (x, -50), (x, -80)),
        _device(c, at + 3, "CABLE", x, -80.0, TAG=F.concat(F.lit("W"), number), SIZE_SQMM=_pick(SIZES, F.floor(F.col("c") / 5) % 5), LENGTH_M=F.col("c") % 70 + 5),
        _line(c, at + 4, "WIRES", (x, -100), (x, F.when(guarded, -120).otherwise(-160))),
        _device(c.where(guarded), at + 5, "RCD", x, -120.0, TAG=F.concat(F.lit("K"), number), SENS_MA=F.when(F.col("c") % 7 == 0, 100).otherwise(30)),
        _line(c.where(guarded), at + 6, "WIRES", (x, -140), (x, -160)),
        _entity(fed, at + 7, "LWPOLYLINE", "WIRES", [(x, -160), (x + 30, -160), (x + 30, -170 - F.col("last") * 30)]),
        _line(load, at + 10 + F.col("j") * 2, "WIRES", (x + 30, low), (x + 20, low)),
        _device(load, at + 11 + F.col("j") * 2, F.col("kind"), x + 10, low + 5, 10.0, 10.0, "LOADS", TAG=F.concat(F.lit("L"), F.col("o").cast("string")), LOAD_W=F.format_number((F.col("o") % 1500 + 40).cast("double"), 0)),
    ])


def _diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    n = (s % COMPONENTS).cast("int")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.floor(s / COMPONENTS).cast("int").alias("d"), n.alias("n"), s.alias("s"), (n * 100 + 100).cast("double").alias("x"))
    supplier = stage(spread(supplier), "drawn-suppliers", grows=True)
    part = supplier.withColumn("drawing_id", F.concat(F.lit("ckt-"), F.col("d").cast("string")))
    sheet, at, x, turn = part.select("drawing_id").distinct(), F.col("n") * 10 + 10, F.col("x"), F.col("s") % 3
    tag = F.concat(_pick([p[1] for p in PART_KINDS], turn), F.col("n").cast("string"))
    plate = supplier.withColumn("drawing_id", F.concat(F.lit("brk-"), F.col("d").cast("string")))
    outline, high = plate.select("drawing_id", "d").distinct(), F.col("d") % 5 * 10 + 50
    return reduce(DataFrame.unionByName, [
        _line(sheet, F.lit(0), "WIRES", (0, 0), (1100, 0)),
        _line(sheet, F.lit(1), "WIRES", (0, -100), (1100, -100)),
        _line(part, at, "WIRES", (x, 0), (x, -40)),
        _device(part, at + 1, _pick([p[0] for p in PART_KINDS], turn), x, -40.0, layer="COMPONENTS", TAG=tag, VALUE_OHM=F.when(turn == 0, F.col("s") * 10), VALUE_UF=F.when(turn == 1, F.col("s") / 10), COLOR=F.when(turn == 2, F.lit("red"))),
        _line(part, at + 2, "WIRES", (x, -60), (x, -100)),
        _entity(outline, F.lit(0), "POLYLINE", "OUTLINE", [(0, 0), (200, 0), (200, high), (0, high)], closed=True),
        _entity(plate, at, "CIRCLE", "HOLES", radius=(F.col("s") % 4 + 3).cast("double"), cx=F.col("n") * 18.0 + 15, cy=F.lit(20.0)),
    ])


_made: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def _version(spark: SparkSession, sf_dir: str) -> tuple:
    """The application, and length and time of change of the tables that drawings are made from."""
    found = [spark.sparkContext.applicationId, sf_dir]
    for table in ("part", "customer", "orders", "supplier"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
        status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        found += [status.getLen(), status.getModificationTime()]
    return tuple(found)


def drawn(spark: SparkSession, sf_dir: str) -> Facts:
    """All drawings, staged: their entities and, as the DXF source gives them, their sheets.

    The files that other engines would read are made once for each version of the tables;
    whatever is computed from them is computed by each query anew.
    """
    key = _version(spark, sf_dir)
    if key not in _made:
        rows = stage(reduce(DataFrame.unionByName, [_plans(spark, sf_dir), _boards(spark, sf_dir), _diagrams(spark, sf_dir)]), "drawn", grows=True)
        _made[key] = rows, stage(dxf.sheets(rows, F.when(F.startswith("drawing_id", F.lit("brk-")), 1).otherwise(4)), "drawn-sheets", grows=True)
    return Facts(*_made[key])
