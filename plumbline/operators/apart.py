"""Drawings solved one by one in the tasks that hold them: most are small, and a search by joins shuffles all of them in each of its rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.staging import stage

#: Rows of a drawing that is solved in one task; what has more goes through joins.
MOST = 2048
#: Rows that a task gives out at a time.
GIVEN = 50_000


def _one_by_one(solve: Callable[[dict[str, pa.Array]], list], most: int, schema: pa.Schema):
    """Of rows sorted by drawing, what ``solve`` finds in each; of a drawing with more than ``most`` rows, which is never held whole, a row of nulls."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, own, out = [], 0, None, [[] for _ in schema]

        def close() -> None:
            if size > most:
                columns = [[None]] * (len(schema) - 1)
            elif size:
                whole = pa.Table.from_batches(held).combine_chunks()
                columns = solve({name: whole.column(name).combine_chunks() for name in whole.schema.names})
            else:
                return
            out[0].extend([own] * len(columns[0]))
            for kept, new in zip(out[1:], columns, strict=True):
                kept.extend(new)

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(out, schema, strict=True)], schema=schema)
            for values in out:
                values.clear()
            return batch

        for batch in batches:
            ids = batch.column(0)
            code = ids.dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else []
            for start, end in zip(first, [*first[1:], len(code)], strict=True):
                name = ids[int(start)].as_py()
                if name != own:
                    close()
                    held, size, own = [], 0, name
                    if len(out[0]) >= GIVEN:
                        yield given()
                size += int(end - start)
                held = [*held, batch.slice(start, end - start)] if size <= most else []
        close()
        yield given()

    return found


def solved(rows: DataFrame, order: list[str | Column], solve: Callable, shape: StructType, label: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Staged rows of ``shape``, which begins with drawing_id, as ``solve`` finds them from the columns of a drawing's rows, sorted by ``order``; and the drawings that are too large for it."""
    dealt = rows.where("drawing_id IS NOT NULL").repartition("drawing_id").sortWithinPartitions("drawing_id", *order)
    told = stage(dealt.mapInArrow(_one_by_one(solve, MOST if most is None else most, to_arrow_schema(shape)), shape), label, grows=True)
    mark = shape.names[1]
    return told.where(f"{mark} IS NOT NULL"), told.where(f"{mark} IS NULL").select("drawing_id")


def _lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of ``n`` nodes the lowest one that links (a, b) lead to."""
    label = np.arange(n)
    while True:
        low, before = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def attached(row: dict[str, pa.Array]) -> list:
    """net and tag of a drawing's rows of kinds 0 (its tolerance, as ``ax``), 1 (segments, in order) and 2 (boxes of components)."""
    kind = row["kind"].to_numpy()
    corner = np.stack([row[c].to_numpy(zero_copy_only=False).astype(float) for c in ("ax", "ay", "bx", "by")])
    wires, boxes, tol = corner[:, kind == 1], corner[:, kind == 2], corner[0, kind == 0]
    n = wires.shape[1]
    if not len(tol) or not n:
        return [[], []]
    (ax, ay, bx, by), tol = wires, tol[0]
    px, py, end = np.concatenate([ax, bx]), np.concatenate([ay, by]), np.tile(np.arange(n), 2)

    def inside(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero((px[:, None] >= x0 - tol) & (px[:, None] <= x1 + tol) & (py[:, None] >= y0 - tol) & (py[:, None] <= y1 + tol))

    p, s = inside(np.minimum(ax, bx), np.minimum(ay, by), np.maximum(ax, bx), np.maximum(ay, by))
    other = end[p] != s
    p, s = p[other], s[other]
    # as geometry.distance_to_segment has it
    dx, dy = bx[s] - ax[s], by[s] - ay[s]
    square = dx * dx + dy * dy
    t = np.clip(((px[p] - ax[s]) * dx + (py[p] - ay[s]) * dy) / np.where(square == 0, 1.0, square), 0.0, 1.0)
    t = np.where(square == 0, 0.0, t)
    hit = np.hypot(px[p] - (ax[s] + t * dx), py[p] - (ay[s] + t * dy)) <= tol
    net = _lowest(n, end[p[hit]], s[hit])
    p, box = inside(*boxes)
    pairs = np.unique(np.stack([net[end[p]], box]), axis=1)
    return [pairs[0].tolist(), pc.take(row["tag"].filter(pc.equal(row["kind"], 2)), pa.array(pairs[1])).to_pylist()]


def reached(hops: int) -> Callable[[dict[str, pa.Array]], list]:
    """tag and its distance from a drawing's starts (kind 0) over members of nets (kind 1); raises where a frontier isn't empty after ``hops``."""

    def found(row: dict[str, pa.Array]) -> list:
        nets, of = {}, {}
        kind, names, tags = row["kind"].to_pylist(), row["net"].to_pylist(), row["tag"].to_pylist()
        front = list(dict.fromkeys(t for k, t in zip(kind, tags, strict=True) if k == 0 and t is not None))
        for k, net, tag in zip(kind, names, tags, strict=True):
            if k == 1 and net is not None and tag is not None:
                nets.setdefault(net, []).append(tag)
                of.setdefault(tag, []).append(net)
        dist, hop = dict.fromkeys(front, 0), 0
        while front:
            hop += 1
            if hop >= hops:
                raise RuntimeError(f"the frontier is not empty after {hops} hops")
            new = {}
            for tag in front:
                for net in of.get(tag, ()):
                    for t in nets.pop(net, ()):
                        if t not in dist:
                            new[t] = dist[t] = hop
            front = list(new)
        return [list(dist), list(dist.values())]

    return found


def below(row: dict[str, pa.Array]) -> list:
    """root and tag of all that lies below each component, of a drawing's rows of ``netlist.ways``."""
    level, nets, tags, low = (row[c].to_pylist() for c in ("level", "net", "tag", "below"))
    held: dict[tuple, tuple[list, list]] = {}
    for v, net, tag, is_low in zip(level, nets, tags, low, strict=True):
        held.setdefault((v, net), ([], []))[is_low].append(tag)
    fed: dict[str, set] = {}
    for key in sorted(held, key=lambda k: -k[0]):
        up, down = held[key]
        whole = set(down).union(*(fed.get(t, ()) for t in down))
        for t in up:
            fed.setdefault(t, set()).update(whole)
    return [[r for r in fed for _ in fed[r]], [t for r in fed for t in fed[r]]]
