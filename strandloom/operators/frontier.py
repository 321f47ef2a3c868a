"""Frontiers of points and the trade-offs that support them: less is better in both coordinates.

Skylines and convex hulls are reduced in two levels: each task reduces what it reads, batch by
batch, and only what is left of each group meets in one task. So a group of any share of the rows
is spread, and no two points are compared as a pair. Points with a null coordinate are left out;
null group keys are a group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analytics import same_keys

#: Rows that a task holds of its groups before it hands them on.
HELD = 1 << 18
#: Fixed: tolerances of energies, of costs, and (relative) of a trade-off interval's ends.
ENERGY_EPS, COST_EPS, INTERVAL_EPS = 1e-7, 1e-10, 1e-9


def _grouped(table: pa.Table, by: list[str], x: str, y: str) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The table by group, x and y; the groups' numbers, x and y."""
    table = table.sort_by([(c, "ascending") for c in (*by, x, y)])
    new = np.zeros(len(table), bool)
    for c in by:
        a, b = table[c].slice(1), table[c].slice(0, max(0, len(table) - 1))
        same = pc.coalesce(pc.equal(a, b), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False) if len(table) > 1 else new[1:]
    return table, np.cumsum(new), table[x].cast(pa.float64()).to_numpy(), table[y].cast(pa.float64()).to_numpy()


def _skyline(table: pa.Table, by: list[str], x: str, y: str) -> pa.Table:
    """Points whose y is less than that of all with less x, each once."""
    table, g, _, v = _grouped(table, by, x, y)
    before = pd.Series(v).groupby(g).cummin().groupby(g).shift().to_numpy()
    return table.filter(pa.array(np.isnan(before) | (v < before)))


def _hull(table: pa.Table, by: list[str], x: str, y: str) -> pa.Table:
    """The skyline's points that are below the line between their neighbours, until all are."""
    table, g, u, v = _grouped(_skyline(table, by, x, y), by, x, y)
    at = np.arange(len(g))
    while len(at) > 2:
        a, b, c = at[:-2], at[1:-1], at[2:]
        above = (v[b] - v[a]) * (u[c] - u[a]) >= (v[c] - v[a]) * (u[b] - u[a])
        gone = (g[a] == g[c]) & above
        if not gone.any():
            break
        at = np.concatenate([at[:1], b[~gone], at[-1:]])
    return table.take(pa.array(at))


def _reduced(df: DataFrame, by: list[str], x: str, y: str, reduce: Callable) -> DataFrame:
    points = df.select(*by, x, y).dropna(subset=[x, y])
    names = points.columns

    def run(batches, most):
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = reduce(new if held is None else pa.concat_tables([held, new]), by, x, y)
            if len(held) > most:
                yield from held.select(names).to_batches()
                held = None
        if held is not None:
            yield from held.select(names).to_batches()

    some = points.mapInArrow(lambda batches: run(batches, HELD), points.schema)
    return some.repartition(*by).mapInArrow(lambda batches: run(batches, float("inf")), points.schema)


def skyline(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Points that no point of the group betters in x or y without being worse in the other, each once."""
    return _reduced(df, by, x, y, _skyline)


def hull(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Points that alone have the least y + t * x of their group for some t above zero."""
    return _reduced(df, by, x, y, _hull)


def _arrays(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, _line: the points of each group as one array (a frontier's, so few of the group's rows)."""
    return points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("_line"))


def pareto(df: DataFrame, by: list[str], x: str, y: str, eps_x: float = 0.0, eps_y: float = 0.0) -> DataFrame:
    """Points that no other point of the group dominates, each once: a point dominates if it is no
    worse in either coordinate by more than its tolerance and better in one by more than that.
    Whatever dominates a point, one of the skyline does too, so points meet the skyline alone."""
    front = skyline(df, by, x, y)
    if eps_x == eps_y == 0:
        return front
    points = df.select(*by, x, y).dropna(subset=[x, y]).distinct()
    met = same_keys(points, _arrays(front, by, x, y), by, "left")
    dominates = lambda p: (p["x"] <= F.col(x) + eps_x) & (p["y"] <= F.col(y) + eps_y) & ((p["x"] < F.col(x) - eps_x) | (p["y"] < F.col(y) - eps_y))
    return met.where(~F.exists("_line", dominates)).select(*by, x, y)


def breakpoints(frontier: DataFrame, by: list[str], cost: str, energy: str) -> DataFrame:
    """by, cost, energy, trade_off: the slope to the group's next point by cost, at which one gives
    way to the other; null for the last."""
    line = _arrays(frontier, by, cost, energy)
    slope = F.transform("_line", lambda p, i: F.struct(p["x"].alias(cost), p["y"].alias(energy), (F.get("_line", i + 1)["x"] - p["x"]).alias("dc"), (p["y"] - F.get("_line", i + 1)["y"]).alias("de")))
    rows = line.select(*by, F.explode(slope).alias("s"))
    return rows.select(*by, f"s.{cost}", f"s.{energy}", (F.col("s.de") / F.col("s.dc")).alias("trade_off"))


def support(targets: DataFrame, lines: DataFrame, by: list[str], cost: str, energy: str, *, energy_eps: float = ENERGY_EPS, cost_eps: float = COST_EPS, interval_eps: float = INTERVAL_EPS, search_end: float = 1.0) -> DataFrame:
    """by, cost, energy of each distinct target with supported, low, high, unbounded and
    representative: the trade-offs t of zero or more at which energy + t * cost of the target is as
    low as that of every line of its group.

    Lines as costly as the target within cost_eps only have to have as much energy within
    energy_eps. The ends may cross by interval_eps of their size and are then one. high is null
    where nothing bounds it; the representative is the middle, or without bound the greater of low
    and search_end. Without support all but supported and unbounded (false) are null. A target
    meets the hull of the lines alone: whatever a line forbids, the hull's points forbid too."""
    points = targets.select(*by, cost, energy).dropna(subset=[cost, energy]).distinct()
    met = same_keys(points, _arrays(hull(lines, by, cost, energy), by, cost, energy), by, "left")
    dc, de = lambda p: F.col(cost) - p["x"], lambda p: p["y"] - F.col(energy)
    bound = lambda p: (de(p) / dc(p)).cast("double")
    line = F.coalesce("_line", F.array())
    forbidden = F.exists(line, lambda p: (F.abs(dc(p)) <= cost_eps) & (-de(p) > energy_eps))
    upper = F.array_min(F.transform(F.filter(line, lambda p: dc(p) > cost_eps), bound))
    lower = F.greatest(F.lit(0.0), F.array_max(F.transform(F.filter(line, lambda p: dc(p) < -cost_eps), bound)))
    ends = met.select(*by, cost, energy, F.struct(forbidden.alias("no"), lower.alias("a"), upper.alias("b")).alias("_e"))
    return ends.select(*by, cost, energy, _interval(F.col("_e"), energy_eps, interval_eps, search_end).alias("_i")).select(*by, cost, energy, "_i.*")


def _interval(e: Column, energy_eps: float, interval_eps: float, search_end: float) -> Column:
    low, high = e["a"], e["b"]
    slack = interval_eps * F.greatest(F.lit(1.0), low, F.abs(high))
    ok = ~e["no"] & (high.isNull() | ((high >= -energy_eps) & (low <= high + slack)))
    top = F.greatest(F.lit(0.0), high)
    one = high.isNotNull() & (F.abs(top - low) <= slack)
    middle = (low + top) / 2
    first, last = F.when(one, middle).otherwise(low), F.when(high.isNotNull(), F.when(one, middle).otherwise(top))
    return F.struct(ok.alias("supported"), F.when(ok, first).alias("low"), F.when(ok, last).alias("high"), (ok & high.isNull()).alias("unbounded"), F.when(ok, F.when(high.isNull(), F.greatest(low, F.lit(search_end))).otherwise(middle)).alias("representative"))
