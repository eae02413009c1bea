"""Headway optimisation: screening, evaluation, and the front of best trade-offs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.scalar import scaled_load_factor, vehicles_needed


def candidates(routes: DataFrame, headways: list[int]) -> DataFrame:
    """candidate (text), route_idx, headway_s: every combination over a few routes (five at most)."""
    ids = [r["route_idx"] for r in routes.select("route_idx").orderBy("route_idx").limit(6).collect()]
    if len(ids) > 5:
        raise ValueError("five routes at most")
    out = routes.sparkSession.createDataFrame([(h,) for h in headways], "h long")
    rows = out.select(F.array("h").alias("v"))
    for _ in ids[1:]:
        rows = rows.join(out).select(F.concat("v", F.array("h")).alias("v"))
    named = rows.select(F.concat_ws("-", F.transform("v", lambda x: x.cast("string"))).alias("candidate"), "v")
    keys = F.array(*[F.lit(i).cast("long") for i in ids])
    return named.select("candidate", F.explode(F.arrays_zip(keys.alias("route_idx"), F.col("v").alias("headway_s"))).alias("x")).select(
        "candidate", F.col("x.route_idx").alias("route_idx"), F.col("x.headway_s").alias("headway_s")
    )


def screen(choices: DataFrame, facts: DataFrame, fleet: int, most_load: float) -> DataFrame:
    """Per candidate: vehicles, highest load factor, mean wait, and whether it is feasible.

    facts: route_idx, cycle_s, base_headway_s, load_factor, boardings.
    """
    rows = choices.join(facts, "route_idx").withColumns(
        {"n": vehicles_needed("cycle_s", "headway_s"), "lf": scaled_load_factor("load_factor", "headway_s", "base_headway_s"), "wait": F.col("headway_s") / 120}
    )
    sums = rows.groupBy("candidate").agg(
        F.sum("n").cast("long").alias("vehicles"), F.max("lf").alias("load_factor"),
        F.try_divide(F.sum(F.col("wait") * F.col("boardings")), F.sum("boardings")).alias("mean_wait_min"),
    )
    return sums.withColumn("feasible", (F.col("vehicles") <= fleet) & (F.col("load_factor") <= most_load))


def pareto_front(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that no other row beats in one measure without losing in the other; ties stay.

    Two measures need no self-join: in the order of x, a row is beaten when an
    earlier x has a y as low, or an equal x a lower one. The least y per x is one row
    a distinct x.
    """
    from pyspark.sql import Window

    best = rows.groupBy(x).agg(F.min(y).alias("_y"))
    before = Window.orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_before", F.min("_y").over(before))
    kept = best.where(F.col("_before").isNull() | (F.col("_y") < F.col("_before"))).select(x, "_y")
    return rows.join(kept, x).where(F.col(y) == F.col("_y")).drop("_y")


def nsga2(
    evaluate: Callable[[np.ndarray], np.ndarray], choices: list[int], genes: int, population: int = 40, generations: int = 50, seed: int = 1
) -> tuple[np.ndarray, np.ndarray]:
    """Best integer vectors and their objectives (all minimised; rows of inf are infeasible). Seeded and memoised by the caller."""
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, len(choices), (population, genes))
    values = evaluate(np.asarray(choices)[pool])

    def fronts(v: np.ndarray) -> np.ndarray:
        rank, left, level = np.full(len(v), -1), np.ones(len(v), bool), 0
        while left.any():
            k = np.flatnonzero(left)
            worse = (v[k][:, None] >= v[k][None]).all(-1) & (v[k][:, None] > v[k][None]).any(-1)
            rank[k[~worse.any(1)]] = level
            left[k[~worse.any(1)]] = False
            level += 1
        return rank

    def crowd(v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v))
        for j in range(v.shape[1]):
            order = np.argsort(v[:, j], kind="stable")
            out[order[[0, -1]]] = np.inf
            width = v[order[-1], j] - v[order[0], j]
            if len(v) > 2 and np.isfinite(width) and width > 0:
                out[order[1:-1]] += (v[order[2:], j] - v[order[:-2], j]) / width
        return out

    for _ in range(generations):
        rank, room = fronts(values), crowd(values)
        a, b = rng.integers(0, len(pool), (2, population, 2))
        better = lambda p: np.where((rank[p[:, 0]] < rank[p[:, 1]]) | ((rank[p[:, 0]] == rank[p[:, 1]]) & (room[p[:, 0]] >= room[p[:, 1]])), p[:, 0], p[:, 1])
        mixed = np.where(rng.random((population, genes)) < 0.5, pool[better(a)], pool[better(b)])
        moved = rng.random((population, genes)) < 1 / genes
        mixed = np.where(moved, rng.integers(0, len(choices), mixed.shape), mixed)
        pool = np.unique(np.vstack([pool, mixed]), axis=0)
        values = evaluate(np.asarray(choices)[pool])
        order = np.lexsort((-crowd(values), fronts(values)))[:population]
        pool, values = pool[order], values[order]
    front = (fronts(values) == 0) & np.isfinite(values).all(1)
    picked = np.asarray(choices)[pool[front]]
    order = np.lexsort(picked.T[::-1])
    return picked[order], values[front][order]
