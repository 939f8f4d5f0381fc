"""Gapless numbering that never puts one group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from plumbline.staging import stage

ROWS_PER_CELL = 20_000
MIN_CELLS = 256


def cells_for(rows: int) -> int:
    """Number of hash cells so that a cell holds some ``ROWS_PER_CELL`` rows even if one group holds them all."""
    return max(MIN_CELLS, -(-rows // ROWS_PER_CELL))


def number_within(df: DataFrame, group: list[str], spread: Column, order: list[Column], out: str, cells: int) -> DataFrame:
    """Add ``out``: a gapless number from 0 within each group (null groups count as one group).

    Each group is cut into ``cells`` cells by the hash ``spread``; a row's number is the
    count of rows in the group's earlier cells plus its place in its own cell. Rows of
    equal ``order`` within a cell are numbered in any order. ``df`` is read twice, so
    pass a staged table. The table of counts has at most groups times cells rows.
    """
    keyed = df.withColumn("_cell", F.pmod(spread, F.lit(cells)))
    names = [*group, "_cell"]
    counts = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"_o_{i}") for i, c in enumerate(names)],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    placed = keyed.withColumn("_place", F.row_number().over(W.partitionBy(*names).orderBy(*order)) - 1)
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & placed[c].eqNullSafe(offsets[f"_o_{i}"])
    return placed.join(offsets, same).withColumn(out, F.col("_offset") + F.col("_place")).drop(
        "_cell", "_place", "_offset", *[f"_o_{i}" for i in range(len(names))]
    )


def carried(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """Add what the rows before, by ``order`` within each group, come to: running sums and last values that are not null.

    ``sums`` and ``lasts`` name the new columns. Rows are dealt by range, scanned in each
    range, and joined to what the ranges before carry over, so a group may fill any number
    of tasks. Rows of equal ``order`` lie in one range and follow each other in any order;
    null groups are one group. The table of ranges has a row for each range and group in it.
    """
    sums, lasts = sums or {}, lasts or {}
    names = {c: f"_g{i}" for i, c in enumerate([*group, "_part"])}
    dealt = stage(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    inside = W.partitionBy(*group, "_part").orderBy(*order)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    ends = dealt.withColumn("_at", F.row_number().over(inside)) if lasts else dealt
    totals = [F.sum(c).alias(f"_t_{n}") for n, c in sums.items()] + [F.max_by(c, F.when(c.isNotNull(), F.col("_at"))).alias(f"_t_{n}") for n, c in lasts.items()]
    parts = W.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.groupBy(*group, "_part").agg(*totals).select(
        *[F.col(c).alias(n) for c, n in names.items()],
        *[F.coalesce(F.sum(f"_t_{n}").over(parts), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(parts).alias(f"_c_{n}") for n in lasts],
    )
    own = dealt.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_o_{n}") for n, c in sums.items()], *[F.last(c, ignorenulls=True).over(before).alias(f"_o_{n}") for n, c in lasts.items()])
    same = F.lit(True)
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    joined = own.join(carry, same)
    out = {n: F.col(f"_c_{n}") + F.col(f"_o_{n}") for n in sums} | {n: F.coalesce(f"_o_{n}", f"_c_{n}") for n in lasts}
    return joined.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def number_in_order(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: a gapless number from 0 by ``order`` within each group, which all columns of ``order`` tell apart."""
    return carried(df, group, order, {out: F.lit(1).cast("long")})
