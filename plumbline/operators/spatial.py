"""Joins of points, boxes and polygons through a grid, so that no join compares everything with everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from plumbline.functions.geometry import distance_to_segment, near_boundary, point_in_polygon


def _span(low: Column, high: Column, cell: Column) -> Column:
    return F.sequence(F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, group: str = "drawing_id", pad: Column | None = None) -> DataFrame:
    """Pairs of a point (px, py) and a box (x_min, y_min, x_max, y_max) of the same group whose padded, closed box holds it.

    Grids of cells of all powers of two lie over each other. A box goes to the finest one
    whose cells are no smaller than the box, so to four cells at most, however long or wide it
    is; a point goes to its cell in each grid that holds boxes, some for each doubling of
    size between the smallest box and the largest. A pair meets in one cell of one grid, so at
    most once. ``pad`` is a column of ``boxes``. A point or box with a null meets nothing.
    Where many points share a cell with a large box, the adaptive skew join splits them.
    """
    pad = F.lit(0.0) if pad is None else pad
    low_x, low_y, high_x, high_y = F.col("x_min") - pad, F.col("y_min") - pad, F.col("x_max") + pad, F.col("y_max") + pad
    grid = F.ceil(F.log2(F.greatest(high_x - low_x, high_y - low_y, F.lit(1e-9)))).cast("int")
    placed = boxes.withColumnRenamed(group, "_g").withColumn("_grid", grid).where("_grid IS NOT NULL")
    grids = sorted(r["_grid"] for r in placed.select("_grid").distinct().collect())  # one for each doubling of size
    cell = F.pow(F.lit(2.0), F.col("_grid"))
    right = placed.withColumn("_x", F.explode(_span(low_x, high_x, cell))).withColumn("_y", F.explode(_span(low_y, high_y, cell)))
    each = points.withColumn("_h", F.explode(F.array(*map(F.lit, grids)).cast("array<int>")))
    own = F.pow(F.lit(2.0), F.col("_h"))
    left = each.withColumn("_px", F.floor(F.col("px") / own).cast("long")).withColumn("_py", F.floor(F.col("py") / own).cast("long"))
    inside = F.col("px").between(low_x, high_x) & F.col("py").between(low_y, high_y)
    same = (left[group] == right["_g"]) & (F.col("_h") == F.col("_grid")) & (F.col("_px") == F.col("_x")) & (F.col("_py") == F.col("_y"))
    return left.join(right, same & inside).drop("_g", "_grid", "_h", "_x", "_y", "_px", "_py")


def closed_polygons(entities: DataFrame, layer: str | None = None) -> DataFrame:
    """drawing_id, region (ordinal), layer, area, box and vertices of closed polylines."""
    polygons = entities.where(F.col("type").isin("LWPOLYLINE", "POLYLINE") & F.col("closed"))
    if layer:
        polygons = polygons.where(F.upper("layer") == layer.strip().upper())
    return polygons.select("drawing_id", F.col("ordinal").alias("region"), F.col("layer").alias("region_layer"), "area", "x_min", "y_min", "x_max", "y_max", "vertices")


def labeled_regions(entities: DataFrame, sheets: DataFrame, layer: str | None = None, label_contains: str | None = None) -> DataFrame:
    """Every closed polyline with its label, width, height, min_side, area and area_m2."""
    joined = _labelled(entities, layer)
    if label_contains:
        joined = joined.where(F.contains(F.upper("label"), F.upper(F.lit(label_contains))))
    width, height = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    return joined.join(sheets.select("drawing_id", "units", "to_m"), "drawing_id").select(
        "drawing_id", "region", "label", F.col("region_layer").alias("layer"), F.round(width, 3).alias("width"), F.round(height, 3).alias("height"),
        F.round(F.least(width, height), 3).alias("min_side"), F.round("area", 3).alias("area"), F.concat("units", F.lit("^2")).alias("area_units"),
        F.round(F.col("area") * F.col("to_m") * F.col("to_m"), 3).alias("area_m2"),
    )


def _labelled(entities: DataFrame, layer: str | None = None) -> DataFrame:
    polygons = closed_polygons(entities, layer)
    texts = entities.where(F.col("type").isin("TEXT", "MTEXT") & F.col("cx").isNotNull()).select("drawing_id", "ordinal", "text", F.col("cx").alias("px"), F.col("cy").alias("py"))
    pairs = _in_polygons(texts, polygons)
    labels = pairs.groupBy("drawing_id", "region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), " / ").alias("label"))
    return polygons.join(labels, ["drawing_id", "region"], "left")


def _in_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Pairs of points and polygons that hold them."""
    return points_in_boxes(points, polygons).where(point_in_polygon(F.col("px"), F.col("py"), F.col("vertices")))


def block_inserts(entities: DataFrame, sheets: DataFrame, block_name: str | None = None, layer: str | None = None) -> DataFrame:
    """Block references with the region that they open into: the first in file order that holds the probe point.

    The probe lies 0.3 of the scale along both of the block's axes. A region without a
    label goes by its layer.
    """
    rows = entities.where(F.col("type") == "INSERT")
    if layer:
        rows = rows.where(F.upper("layer") == layer.strip().upper())
    if block_name:
        rows = rows.where(F.upper(F.coalesce("block", F.lit(""))) == block_name.upper())
    s, turn = F.coalesce("scale", F.lit(1.0)), F.radians(F.coalesce("rotation", F.lit(0.0)))
    probes = rows.select("drawing_id", "ordinal", "block", "layer", "scale", "rotation", "cx", "cy", (F.col("cx") + 0.3 * s * (F.cos(turn) - F.sin(turn))).alias("px"), (F.col("cy") + 0.3 * s * (F.sin(turn) + F.cos(turn))).alias("py"))
    labelled = _labelled(entities).withColumn("name", F.coalesce("label", "region_layer"))
    hits = _in_polygons(probes.select("drawing_id", "ordinal", "px", "py"), labelled)
    first = hits.groupBy("drawing_id", "ordinal").agg(F.min_by("name", "region").alias("in_region"))
    joined = probes.join(first, ["drawing_id", "ordinal"], "left")
    return joined.select("drawing_id", "ordinal", "block", "layer", F.round("scale", 3).alias("scale"), F.round("rotation", 1).alias("rotation"), F.round("cx", 1).alias("x"), F.round("cy", 1).alias("y"), "in_region")


def count_per_region(entities: DataFrame, sheets: DataFrame, layer: str, region_layer: str | None = None, tolerance: float | None = None) -> DataFrame:
    """Entities of a layer in each closed region or within a tolerance of its boundary; regions without any count 0."""
    extent = F.greatest(F.col("extents.x_max") - F.col("extents.x_min"), F.col("extents.y_max") - F.col("extents.y_min"), F.lit(1.0))
    tol = F.lit(float(tolerance)) if tolerance is not None else 1e-4 * extent
    sizes = sheets.select("drawing_id", tol.alias("tol"))
    regions = _labelled(entities, region_layer)
    items = entities.where((F.upper("layer") == layer.strip().upper()) & F.col("cx").isNotNull()).select("drawing_id", F.col("ordinal").alias("item"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    boxed = regions.join(sizes, "drawing_id").select("drawing_id", "region", "vertices", "x_min", "y_min", "x_max", "y_max", "tol")
    near = points_in_boxes(items, boxed, pad=F.col("tol"))
    hits = near.where(point_in_polygon(F.col("px"), F.col("py"), F.col("vertices")) | near_boundary(F.col("px"), F.col("py"), F.col("vertices"), F.col("tol")))
    counts = hits.groupBy("drawing_id", "region").agg(F.count(F.lit(1)).alias("n"))
    return regions.join(counts, ["drawing_id", "region"], "left").select("drawing_id", "region", "label", F.coalesce("n", F.lit(0)).alias("count"))


def held_by_layer(entities: DataFrame, sheets: DataFrame, tolerance: float | None = None) -> DataFrame:
    """drawing_id, region, item_layer (upper case) and n: entities of each layer in a closed region or within a tolerance of its boundary."""
    extent = F.greatest(F.col("extents.x_max") - F.col("extents.x_min"), F.col("extents.y_max") - F.col("extents.y_min"), F.lit(1.0))
    tol = F.lit(float(tolerance)) if tolerance is not None else 1e-4 * extent
    boxed = closed_polygons(entities).join(sheets.select("drawing_id", tol.alias("tol")), "drawing_id")
    items = entities.where("cx IS NOT NULL").select("drawing_id", F.upper("layer").alias("item_layer"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    near = points_in_boxes(items, boxed.select("drawing_id", "region", "vertices", "x_min", "y_min", "x_max", "y_max", "tol"), pad=F.col("tol"))
    hits = near.where(point_in_polygon(F.col("px"), F.col("py"), F.col("vertices")) | near_boundary(F.col("px"), F.col("py"), F.col("vertices"), F.col("tol")))
    return hits.groupBy("drawing_id", "region", "item_layer").agg(F.count(F.lit(1)).alias("n"))


def cut_into_segments(entities: DataFrame, layers: Column) -> DataFrame:
    """Segments (ax, ay)-(bx, by) of conductor lines and polylines, each the k-th (from 0) of its entity."""
    lines = entities.where(F.col("type").isin("LINE", "LWPOLYLINE", "POLYLINE") & layers & (F.size("vertices") > 1))
    n = F.size("vertices")
    each = lines.select("drawing_id", "ordinal", "closed", "vertices", F.explode(F.sequence(F.lit(0), n - F.when(F.col("closed"), 1).otherwise(2))).alias("k"))
    a, b = F.get("vertices", F.col("k")), F.get("vertices", F.pmod(F.col("k") + 1, n))
    return each.select("drawing_id", "ordinal", "k", a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))


def segments(entities: DataFrame, layers: Column) -> DataFrame:
    """The segments of ``cut_into_segments``, numbered in file order."""
    number = F.row_number().over(W.partitionBy("drawing_id").orderBy("ordinal", "k")) - 1
    return cut_into_segments(entities, layers).select("drawing_id", number.alias("segment"), "ax", "ay", "bx", "by")


def touching(parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(drawing_id, a, b), a < b: segments of which an end of one lies on the other within ``tol``. ``sizes`` has drawing_id and tol."""
    both = F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))))
    ends = parts.select("drawing_id", F.col("segment").alias("e"), both.alias("p")).select("drawing_id", "e", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    boxes = parts.join(sizes, "drawing_id").select("drawing_id", "segment", "ax", "ay", "bx", "by", "tol", F.least("ax", "bx").alias("x_min"), F.least("ay", "by").alias("y_min"), F.greatest("ax", "bx").alias("x_max"), F.greatest("ay", "by").alias("y_max"))
    near = points_in_boxes(ends, boxes, pad=F.col("tol")).where("e <> segment")
    hits = near.where(distance_to_segment(F.col("px"), F.col("py"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= F.col("tol"))
    return hits.select("drawing_id", F.least("e", "segment").alias("a"), F.greatest("e", "segment").alias("b")).distinct()
