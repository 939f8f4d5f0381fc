"""Nearest neighbours by counting collisions on sorted projections.

Unit vectors are projected on random directions; each direction's values are held as a
sorted array. A query's window on an array is centred at its own projection. Windows of
all directions widen together (virtual rehashing: no bucket is ever rebuilt), and a vector
that falls in more than a set share of the windows is verified with its exact cosine. A
query is done when the k-th best id other than its own, verified here or in a sample of
all vectors before, is nearer than the windows reach; of an id found on several rows the
best one counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from plumbline.staging import stage

K = 5
#: A vector at distance d falls in a window of half width d with probability 0.683. At that width 128
#: windows hold one at the k-th distance in more than a share of 0.6 with a chance of 0.97, nearer ones more surely.
PROJECTIONS, SHARE = 128, 0.6
#: Half widths of the windows: the first where no bound is known, the share of the bound where one is, and the
#: factor of each widening. Unit vectors are at most 2 apart.
FIRST, PART, FACTOR = 0.3, 0.5, 1.5
#: Vectors indexed at a time, bytes of queries searched at a time, and vectors of the sample that bounds the k-th distance.
CHUNK, BLOCK_BYTES, SAMPLE = 1 << 14, 16 << 20, 4096
#: Projections lie nearer to 0 than half of this.
APART = 1e4
SEED = 5


def usable(vector: Column) -> Column:
    """True for vectors that take part: no null, no infinite or undefined component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


class CollisionIndex:
    """Sorted projections of up to some ten thousand vectors; ``names`` are their ids, which may repeat."""

    def __init__(self, names: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = SEED):
        self.names, self.vectors = names, vectors
        self.repeats = len(np.unique(names)) < len(names)
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections))
        values = (vectors / self.norms[:, None]) @ self.directions
        order = np.argsort(values, axis=0, kind="stable")
        #: All arrays end to end, each shifted by so much that one binary search places a query on all of them.
        self.shift = APART * np.arange(projections)
        self.order = order.T.astype("i4").ravel()
        self.sorted = (np.take_along_axis(values, order, 0) + self.shift).T.ravel()
        self.verified = 0

    def search(self, queries: np.ndarray, ids: np.ndarray, k: int = K, far: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, (rows, cosines) of the k nearest ids found and ties, one row an id. Rows of a query's own id in ``ids`` are left out.

        ``far`` are distances that each query's k-th nearest is known not to exceed.
        """
        norms = np.sqrt((queries * queries).sum(1))
        centres = (queries / norms[:, None]) @ self.directions + self.shift
        far = np.full(len(queries), np.inf) if far is None else far
        return [self._one(queries[q], norms[q], centres[q], ids[q], k, float(far[q])) for q in range(len(queries))]

    def _one(self, query: np.ndarray, norm: float, centre: np.ndarray, own: int, k: int, far: float) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(self.names), len(centre)
        counts, seen = np.zeros(n, "i8"), self.names == own
        rows, cosines = np.zeros(0, "i8"), np.zeros(0)
        half = PART * far if np.isfinite(far) else FIRST
        lo = hi = np.searchsorted(self.sorted, centre)
        while True:
            whole = not np.isfinite(far) and half > 2.0
            width = min(half, far)  # no wider than what is left to find
            if whole:
                fresh = np.flatnonzero(~seen)
            else:
                low, high = np.searchsorted(self.sorted, centre - width, "left"), np.searchsorted(self.sorted, centre + width, "right")
                rings = [self.order[a:b] for a, b in zip(low, lo, strict=True) if a < b] + [self.order[a:b] for a, b in zip(hi, high, strict=True) if a < b]
                if rings:
                    counts += np.bincount(np.concatenate(rings), minlength=n)
                lo, hi = low, high
                fresh = np.flatnonzero((counts >= SHARE * m) & ~seen)
            seen[fresh] = True
            self.verified += len(fresh)
            # Summed row by row: a matrix product may round equal vectors apart, and ties then go to any id.
            more = (self.vectors[fresh] * query).sum(1) / (self.norms[fresh] * norm)
            rows, cosines = np.concatenate([rows, fresh]), np.concatenate([cosines, more])
            if self.repeats:
                order = np.lexsort((-cosines, self.names[rows]))
                best = order[np.unique(self.names[rows[order]], return_index=True)[1]]
                rows, cosines = rows[best], cosines[best]
            if len(rows) > k:
                part = np.argpartition(-cosines, k - 1)[:k]
                part = np.flatnonzero(cosines >= cosines[part].min())  # ties at the edge are settled by id later
                rows, cosines = rows[part], cosines[part]
            if len(rows) >= k:
                far = min(far, np.sqrt(max(0.0, 2 - 2 * cosines.min())))
            if whole or width >= far:
                return rows, cosines
            half *= FACTOR


def _reach(names: np.ndarray, vectors: np.ndarray, k: int):
    """Adds the distance of each query's k-th nearest id in a sample, infinite if that has fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
        for batch in batches:
            far = np.full(batch.num_rows, np.inf)
            for i, (q, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                x = v.values.to_numpy()
                cosines = (unit @ (x / np.sqrt((x * x).sum())))[names != q]
                if len(cosines) >= k:
                    far[i] = np.sqrt(max(0.0, 2 - 2 * np.partition(cosines, len(cosines) - k)[len(cosines) - k])) + 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far)], names=["vec_id", "v", "far"])

    return run


def _distinct(names: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows without copies of the same id and vector."""
    keep, seen = np.ones(len(names), bool), set()
    _, inverse, times = np.unique(names, return_inverse=True, return_counts=True)
    for i in np.flatnonzero(times[inverse] > 1):
        key = names[i], vectors[i].tobytes()
        keep[i] = key not in seen
        seen.add(key)
    return (names, vectors) if keep.all() else (names[keep], vectors[keep])


def _search(queries: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list) -> pa.RecordBatch:
            names, vectors = _distinct(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            index = CollisionIndex(names, vectors)
            parts = []
            for q, (rows, cosines) in zip(ids, index.search(queries, ids, k, far), strict=True):
                keep = np.lexsort((names[rows], -cosines))[:k]
                parts.append((np.full(len(keep), q), names[rows[keep]], cosines[keep]))
            columns = [np.concatenate([p[i] for p in parts]) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

        held, rows = [], 0
        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, queries.shape[1])
            for start in range(0, batch.num_rows, CHUNK):
                part = slice(start, start + CHUNK)
                held.append((batch.column(0).to_numpy()[part], vectors[part]))
                rows += len(held[-1][0])
                if rows >= CHUNK:
                    yield flush(held)
                    held, rows = [], 0
        if rows:
            yield flush(held)

    return run


def nearest(vectors: DataFrame, k: int = K, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank int from 1, vec_id, score double: the nearest found of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of
    another id and the same number of components. Rows without an id, and vectors that are
    not ``usable``, take no part; of repeated ids the best scoring row counts. Queries go
    in blocks of at most ``BLOCK_BYTES``, so that what every task is sent is bounded; each
    block passes once over all rows. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = stage(rows.withColumn("d", F.size("v")), "ann-rows")
    empty = "query_id long, vec_id long, score double"
    parts = [spark.createDataFrame([], empty)]
    for r in sorted(rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).collect()):
        if not r["q"]:
            continue
        same = rows.where(F.col("d") == r["d"]).select("vec_id", "v")
        dealt = stage(same.repartition(max(1, round(r["n"] / CHUNK))), "ann-dealt")
        drawn = {x["vec_id"]: x["v"] for x in dealt.sample(fraction=min(1.0, SAMPLE / r["n"]), seed=SEED).limit(2 * SAMPLE).collect()}
        known = np.array(list(drawn), "i8"), np.array(list(drawn.values()), "f8").reshape(len(drawn), r["d"])
        blocks = -(-8 * r["d"] * r["q"] // BLOCK_BYTES)
        for b in range(blocks):
            asked = same.where((F.col("vec_id") % every == 0) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).groupBy("vec_id").agg(F.min("v").alias("v"))
            reached = asked.mapInArrow(_reach(*known, k), "vec_id long, v array<double>, far double")
            got = sorted((q["vec_id"], q["v"], q["far"]) for q in reached.collect())
            if got:
                ids, far = np.array([q[0] for q in got], "i8"), np.array([q[2] for q in got])
                found = dealt.mapInArrow(_search(np.array([q[1] for q in got], "f8"), ids, far, k), empty)
                parts.append(stage(found, "ann-found"))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
