"""Centroid clustering by sort-means, exact in whole numbers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.memory import release
from plumbline.staging import discard, stage

MOST_LONG = 2**63 - 1
_LIMB = 31


class Clusters(NamedTuple):
    """``assigned``: the vectors' rows with cluster and distance; ``centroids``: whole numbers by cluster."""

    assigned: DataFrame
    centroids: list[list[int]]


def _whole(value: float, scale: int) -> int:
    """floor(scale * value) of any finite double."""
    return int(value) * scale if abs(value) >= 2.0**53 else math.floor(value * scale)


def _narrow(values: np.ndarray) -> bool:
    """Whether four times a squared distance between such vectors has room in 64 bits."""
    return not values.size or bool(np.abs(values).max() <= math.isqrt(2**60 // values.shape[1]) // 2)


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in 64 bits, or as Python's integers where those are too narrow for distances."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    return y.astype("i8") if _narrow(y) else np.array([[_whole(float(v), scale) for v in row] for row in x], object)


def _centroid_array(centroids: list[list[int]]) -> np.ndarray:
    wide = np.array(centroids, object)
    return wide.astype("i8") if _narrow(wide) else wide


def nearest(v: np.ndarray, c: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row of ``v``, the smallest number among equals, and the squared distance.

    The other centroids are scanned by their distance from the previous one, until that is
    more than twice the row's own distance from the previous one: all further ones are
    farther from the row, by the triangle inequality.
    """
    apart = ((c[:, None] - c[None]) ** 2).sum(-1)
    best, found = previous.copy(), ((v - c[previous]) ** 2).sum(1)
    for i in np.unique(previous):
        rows = np.flatnonzero(previous == i)
        rows = rows[np.argsort(-found[rows], kind="stable")]
        reach, near, at = 4 * found[rows], found[rows], best[rows]
        for j in np.argsort(apart[i], kind="stable"):
            n = int(np.searchsorted(-reach, -apart[i, j], side="right"))
            if n == 0:
                break
            if j == i:
                continue
            d = ((v[rows[:n]] - c[j]) ** 2).sum(1)
            better = ((d < near[:n]) | ((d == near[:n]) & (j < at[:n]))).astype(bool)
            near[:n] = np.where(better, d, near[:n])
            at[:n] = np.where(better, j, at[:n])
        best[rows], found[rows] = at, near
    return best, found


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dims)


def _assigner(centroids: list[list[int]], dims: int, scale: int):
    """A task of ``mapInArrow`` that replaces ``cluster`` and ``distance``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _centroid_array(centroids)
        for batch in batches:
            if batch.num_rows:
                was = batch.column("cluster").to_numpy(zero_copy_only=False).astype("i8")
                best, d = nearest(whole_numbers(_vectors(batch, dims), scale), c, was)
                new = {"cluster": pa.array(best, pa.int32()), "distance": pa.array([min(int(x), MOST_LONG) for x in d], pa.int64())}
                yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)
        release()

    return run


def _summer(dims: int, scale: int):
    """A task of ``mapInArrow`` that gives counts (slot -1) and sums by cluster, in limbs of 31 bits so that sums of sums stay exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            v, cluster = whole_numbers(_vectors(batch, dims), scale), batch.column("cluster").to_numpy(zero_copy_only=False)
            for i in np.unique(cluster).tolist():
                mine = v[cluster == i]
                counts[i] = counts.get(i, 0) + len(mine)
                sums[i] = sums.get(i, 0) + mine.sum(0).astype(object)
        rows: list[tuple[int, int, int, int]] = []
        for i, n in counts.items():
            rows.append((i, -1, 0, n))
            for slot, total in enumerate(sums[i]):
                limb = 0
                while not -(2**_LIMB) < total < 2**_LIMB:
                    rows.append((i, slot, limb, int(total) & (2**_LIMB - 1)))
                    total, limb = int(total) >> _LIMB, limb + 1
                rows.append((i, slot, limb, int(total)))
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3], pa.int64())], ["cluster", "slot", "limb", "value"])
        release()

    return run


def sort_means(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: int = 2) -> Clusters:
    """Clusters of the vectors of ``dims`` finite components, each turned into floor(scale * component).

    The first centroids are the ``k`` vectors with the smallest sha256 of ``seed:key``. Each
    round assigns every vector and floors the exact mean of each non-empty cluster; a last
    assignment follows. ``assigned`` has the columns key, ``x``, ``cluster`` and ``distance``.

    Rows keep their cluster from round to round, where the next scan begins, in a table
    written each round; the one before is deleted. Tasks add up their own rows first, so a
    round sends at most k * dims sums from each task, a cluster may hold any share of the
    rows, and the driver gets k centroids.

    Rows with another number of components, or null, NaN or infinite ones, are left out. A
    null key is hashed as no digits; rows of equal keys start in the order of their vectors.
    Fewer than ``k`` vectors make as many clusters; none gives an empty table. Components of
    any size are exact; a distance too large for a long is given as the largest one.
    """
    finite = F.forall(F.col("x"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    named = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("x"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    state = stage(named.where((F.size("x") == dims) & finite), "sort-means")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = state.select(order.alias("order"), "x").orderBy("order", "x").limit(k).collect()
    centroids = [[_whole(float(v), scale) for v in r["x"]] for r in first]
    if centroids:
        for _ in range(rounds):
            now = stage(state.mapInArrow(_assigner(centroids, dims, scale), state.schema), "sort-means")
            discard(state)
            state = now
            parts = state.mapInArrow(_summer(dims, scale), "cluster int, slot int, limb int, value long")
            count, total = {}, {}
            for r in parts.groupBy("cluster", "slot", "limb").agg(F.sum("value").alias("value")).collect():
                if r["slot"] < 0:
                    count[r["cluster"]] = r["value"]
                else:
                    at = (r["cluster"], r["slot"])
                    total[at] = total.get(at, 0) + (r["value"] << _LIMB * r["limb"])
            centroids = [[total[i, j] // count[i] for j in range(dims)] if i in count else c for i, c in enumerate(centroids)]
        state = state.mapInArrow(_assigner(centroids, dims, scale), state.schema)
    return Clusters(state.withColumnRenamed("id", key), centroids)


def digest(centroid: list[int]) -> str:
    """Lower-case hex sha256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
