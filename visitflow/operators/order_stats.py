"""Exact order statistics over whole columns with bounded state.

``percentile`` keeps every distinct value in one buffer. Here a bounded sketch
proposes a bracket around the wanted rank, one aggregate counts the rows below
and inside it, and the bracket narrows until few enough values are left to be
sorted in one task. The counts decide, never the sketch, so results are exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SORTED_ROWS = 100_000  # most values one task sorts
ACCURACY = 10_000  # rank error of the sketch is 1 / ACCURACY of the rows
MARGIN = 2.0 / ACCURACY


@dataclass
class _Search:
    """One wanted rank: the values strictly between low and high hold it."""

    name: str
    rank: int  # 0-based among all values of the column
    inside: int  # values strictly between low and high
    below: int = 0  # values up to and including low
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def within(self, x: Column) -> Column:
        condition = x.isNotNull()
        if self.low is not None:
            condition = condition & (x > F.lit(self.low))
        if self.high is not None:
            condition = condition & (x < F.lit(self.high))
        return condition


def count_values(df: DataFrame, columns: dict[str, Column]) -> dict[str, int]:
    row = df.agg(*[F.count(c).alias(n) for n, c in columns.items()]).first()
    return row.asDict()


def values_at_ranks(
    df: DataFrame,
    columns: dict[str, Column],
    ranks: dict[str, list[int]],
    sizes: dict[str, int],
    sorted_rows: int = SORTED_ROWS,
) -> dict[tuple[str, int], float]:
    """Exact values at 0-based ranks of numeric columns (nulls left out)."""
    searches = [
        _Search(name, rank, sizes[name])
        for name in columns
        for rank in sorted(set(ranks.get(name, [])))
        if 0 <= rank < sizes[name]
    ]
    while True:
        wide = [s for s in searches if s.value is None and s.inside > sorted_rows]
        if not wide:
            break
        _narrow(df, columns, wide)
    _sort_brackets(df, columns, [s for s in searches if s.value is None])
    return {(s.name, s.rank): s.value for s in searches}


def _groups(searches: list[_Search]) -> list[list[_Search]]:
    """Searches that look at the same bracket of the same column."""
    groups: dict[tuple, list[_Search]] = {}
    for s in searches:
        groups.setdefault((s.name, s.low, s.high, s.below), []).append(s)
    return list(groups.values())


def _narrow(df: DataFrame, columns: dict[str, Column], searches: list[_Search]) -> None:
    """Shrink every bracket by one sketch pass and one counting pass over ``df``."""
    sketches = []
    groups = _groups(searches)
    for i, group in enumerate(groups):
        x, first = columns[group[0].name], group[0]
        shares = [(s.rank - first.below) / first.inside for s in group]
        bounds = [min(1.0, max(0.0, p + m)) for p in shares for m in (-MARGIN, MARGIN)]
        sketches.append(
            F.percentile_approx(F.when(first.within(x), x), bounds, ACCURACY).alias(f"b{i}")
        )
    row = df.agg(*sketches).first()
    proposed = [
        (s, row[i][2 * j], row[i][2 * j + 1]) for i, g in enumerate(groups) for j, s in enumerate(g)
    ]
    counts = []
    for i, (s, low, high) in enumerate(proposed):
        x = columns[s.name]
        conditions = [x < F.lit(low), x <= F.lit(low), x < F.lit(high), x <= F.lit(high)]
        counts += [F.count_if(c).alias(f"c{i}_{j}") for j, c in enumerate(conditions)]
    counted = df.agg(*counts).first()
    for i, (s, low, high) in enumerate(proposed):
        below_low, upto_low, below_high, upto_high = [counted[f"c{i}_{j}"] for j in range(4)]
        end = s.below + s.inside
        if s.rank < below_low:
            s.high, s.inside = low, below_low - s.below
        elif s.rank < upto_low:
            s.value = low
        elif s.rank < below_high:
            s.low, s.high = low, high
            s.below, s.inside = upto_low, below_high - upto_low
        elif s.rank < upto_high:
            s.value = high
        else:
            s.low, s.below, s.inside = high, upto_high, end - upto_high


def _sort_brackets(df: DataFrame, columns: dict[str, Column], searches: list[_Search]) -> None:
    """Sort the few values left in each bracket, each bracket in its own task."""
    groups = _groups(searches)
    if not groups:
        return
    entries = [
        F.when(
            g[0].within(columns[g[0].name]),
            F.struct(F.lit(i).alias("bracket"), columns[g[0].name].alias("x")),
        )
        for i, g in enumerate(groups)
    ]
    values = (
        df.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy(F.col("e.bracket").alias("bracket"), F.col("e.x").alias("x"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("bracket").orderBy("x")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wanted = F.lit(False)
    for i, g in enumerate(groups):
        for s in g:
            local = s.rank - s.below
            wanted = wanted | (
                (F.col("bracket") == i) & (F.col("upto") > local) & (F.col("upto") - F.col("n") <= local)
            )
    found = values.withColumn("upto", upto).filter(wanted).collect()
    for row in found:
        for s in groups[row["bracket"]]:
            local = s.rank - s.below
            if row["upto"] - row["n"] <= local < row["upto"]:
                s.value = row["x"]


def exact_quantiles(
    df: DataFrame,
    wanted: dict[str, tuple[Column, list[float]]],
    interpolation: str = "linear",
    sorted_rows: int = SORTED_ROWS,
) -> dict[str, list[float | None]]:
    """Exact quantiles of several numeric columns; nulls are left out.

    ``linear`` interpolates between neighbours, ``nearest`` takes the closer
    one (the upper one when both are equally close).
    """
    columns = {name: c for name, (c, _) in wanted.items()}
    sizes = count_values(df, columns)
    ranks: dict[str, list[int]] = {}
    for name, (_, quantiles) in wanted.items():
        positions = [q * (sizes[name] - 1) for q in quantiles]
        if interpolation == "nearest":
            ranks[name] = [math.floor(p + 0.5) for p in positions]
        else:
            ranks[name] = [r for p in positions for r in (math.floor(p), math.ceil(p))]
    found = values_at_ranks(df, columns, ranks, sizes, sorted_rows)
    result: dict[str, list[float | None]] = {}
    for name, (_, quantiles) in wanted.items():
        if sizes[name] == 0:
            result[name] = [None] * len(quantiles)
            continue
        values = []
        for q in quantiles:
            p = q * (sizes[name] - 1)
            if interpolation == "nearest":
                values.append(found[name, math.floor(p + 0.5)])
                continue
            lower, upper = found[name, math.floor(p)], found[name, math.ceil(p)]
            share = p - math.floor(p)
            # Equal neighbours stay exact, also when both are infinite.
            values.append(lower if lower == upper else lower + (upper - lower) * share)
        result[name] = values
    return result
