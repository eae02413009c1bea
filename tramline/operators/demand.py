"""Trip ends, doubly constrained balancing, attainability, gateways and station flows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.scalar import ratio
from tramline.operators.graph import components
from tramline.plans.scratch import written

MAX_ITERATIONS = 5000


def trip_ends(zones: DataFrame, attraction: DataFrame, rate: float, share: float) -> DataFrame:
    """zone_idx, origin, destination_proxy, destination: O = population * rate * share; D in proportion to the score, scaled to the sum of O."""
    both = zones.select("zone_idx", "population").join(attraction.select("zone_idx", "employment_score"), "zone_idx", "left")
    both = both.withColumn("origin", F.col("population") * rate * share).fillna(0.0, ["employment_score"])
    every = Window.partitionBy()  # zones: a small table
    proxy = F.col("employment_score").cast("double")
    return both.select(
        "zone_idx", F.col("origin").cast("double").alias("origin"), proxy.alias("destination_proxy"),
        (proxy * F.try_divide(F.sum(F.col("origin").cast("double")).over(every), F.sum(proxy).over(every))).alias("destination"),
    )


def live_pairs(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """Pairs from zones with origins to zones with destinations."""
    o = ends.where("origin > 0").select(F.col("zone_idx").alias("origin_zone"), F.col("origin").alias("o"))
    d = ends.where("destination > 0").select(F.col("zone_idx").alias("dest_zone"), F.col("destination").alias("d"))
    return pairs.join(o, "origin_zone").join(d, "dest_zone")


def bipartite_blocks(pairs: DataFrame) -> DataFrame:
    """pairs with block, the connected part of the origin-destination graph they lie in."""
    edges = pairs.select((F.col("origin_zone") * 2).alias("u"), (F.col("dest_zone") * 2 + 1).alias("v"))
    found = components(edges).select(F.col("node"), F.col("component").alias("block"))
    return pairs.join(found, F.col("origin_zone") * 2 == F.col("node")).drop("node")


def furness(
    origin: np.ndarray, dest: np.ndarray, f: np.ndarray, o: np.ndarray, d: np.ndarray, tolerance: float = 1e-6,
    iterations: int = MAX_ITERATIONS, b: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Trips, column factors and the row errors of each round.

    a = O / F b and b = D / F' a in turn, until the largest relative row error is
    within the tolerance. Unequal totals, or an end without a pair, are errors.
    """
    if not np.isclose(o.sum(), d.sum(), rtol=1e-9):
        raise ValueError(f"origins sum to {o.sum()}, destinations to {d.sum()}")
    if (o[np.bincount(origin, minlength=len(o)) == 0] > 0).any() or (d[np.bincount(dest, minlength=len(d)) == 0] > 0).any():
        raise ValueError("an end with trips has no pair")
    b = np.ones(len(d)) if b is None else b.copy()
    history: list[float] = []
    a = np.zeros(len(o))
    safe = lambda x, y: np.divide(x, y, out=np.zeros_like(y), where=y > 0)
    for _ in range(iterations):
        a = safe(o, np.bincount(origin, f * b[dest], len(o)))
        b = safe(d, np.bincount(dest, f * a[origin], len(d)))
        rows = np.bincount(origin, a[origin] * f * b[dest], len(o))
        history.append(float(np.max(np.abs(safe(rows, o) - (o > 0)), initial=0.0)))
        if history[-1] <= tolerance or not np.isfinite(history[-1]):
            break
    return a[origin] * f * b[dest], b, history


def balance(pairs: DataFrame, beta: float, tolerance: float = 1e-6, unit_s: float = 60.0) -> DataFrame:
    """origin_zone, dest_zone, cost_s, trips: gravity demand exp(-beta cost) balanced block by block.

    pairs: origin_zone, dest_zone, cost_s, o, d, block. A block is as large as a
    connected part of the network's zones and is balanced in one task; `balance_rounds`
    does the same relationally where a block outgrows a task.
    """

    def one(block: pd.DataFrame) -> pd.DataFrame:
        zones_o, origin = np.unique(block["origin_zone"], return_inverse=True)
        zones_d, dest = np.unique(block["dest_zone"], return_inverse=True)
        o, d = np.zeros(len(zones_o)), np.zeros(len(zones_d))
        o[origin], d[dest] = block["o"], block["d"]
        d *= o.sum() / d.sum()
        f = np.exp(-beta * block["cost_s"].to_numpy(float) / unit_s)
        trips, _, history = furness(origin, dest, f, o, d, tolerance)
        if not history or not history[-1] <= tolerance:
            raise RuntimeError(f"not balanced after {len(history)} rounds")
        return block[["origin_zone", "dest_zone", "cost_s"]].assign(trips=trips)

    types = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = f"origin_zone {types['origin_zone']}, dest_zone {types['dest_zone']}, cost_s {types['cost_s']}, trips double"
    return pairs.groupBy("block").applyInPandas(one, schema)


def balance_rounds(pairs: DataFrame, beta: float, rounds: int, unit_s: float = 60.0) -> DataFrame:
    """A fixed number of balancing rounds as joins and sums, for pairs of any size. Each round is written, so that plans stay short."""
    rows = written(pairs.withColumn("t", F.exp(-beta * F.col("cost_s") / unit_s)), "balance")
    for _ in range(rounds):
        for side, total in (("origin_zone", "o"), ("dest_zone", "d")):
            sums = rows.groupBy(side).agg(F.sum("t").alias("_s"))
            rows = rows.join(sums, side).withColumn("t", F.col("t") * F.coalesce(F.try_divide(F.col(total), F.col("_s")), F.lit(0.0))).drop("_s")
        rows = written(rows, "balance")
    return rows.select("origin_zone", "dest_zone", "cost_s", F.col("t").alias("trips"))


def stable_ends(pairs: DataFrame, ends: DataFrame, cut: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Ends left once those without a live pair have gone, round by round until none goes."""
    held, before = ends, -1
    while True:
        live = live_pairs(pairs, held)
        origins = live.select(F.col("origin_zone").alias("zone_idx")).distinct().withColumn("_o", F.lit(1))
        dests = live.select(F.col("dest_zone").alias("zone_idx")).distinct().withColumn("_d", F.lit(1))
        marked = held.join(origins, "zone_idx", "left").join(dests, "zone_idx", "left")
        held = cut(
            marked.withColumn("origin", F.when(F.col("_o").isNotNull(), F.col("origin")).otherwise(0.0))
            .withColumn("destination", F.when(F.col("_d").isNotNull(), F.col("destination")).otherwise(0.0)).drop("_o", "_d")
        )
        now = held.where("origin > 0").count() + held.where("destination > 0").count()
        if now == before:
            return held
        before = now


class Flow:
    """Largest integer flow by layered blocking flows."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, room: int) -> int:
        for x, y, c in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)
        return len(self.to) - 2

    def levels(self, source: int) -> list[int]:
        depth = [-1] * len(self.out)
        depth[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                if self.room[e] > 0 and depth[self.to[e]] < 0:
                    depth[self.to[e]] = depth[x] + 1
                    queue.append(self.to[e])
        return depth

    def run(self, source: int, sink: int) -> int:
        total = 0
        while (depth := self.levels(source))[sink] >= 0:
            at = [0] * len(self.out)
            path: list[int] = []
            x = source
            while True:
                if x == sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    total += least
                    path, x = [], source
                    continue
                while at[x] < len(self.out[x]):
                    e = self.out[x][at[x]]
                    if self.room[e] > 0 and depth[self.to[e]] == depth[x] + 1:
                        break
                    at[x] += 1
                if at[x] < len(self.out[x]):
                    path.append(self.out[x][at[x]])
                    x = self.to[path[-1]]
                elif path:
                    e = path.pop()
                    x = self.to[e ^ 1]
                    at[x] += 1
                else:
                    break
        return total


def attainable(
    origin: np.ndarray, dest: np.ndarray, o: np.ndarray, d: np.ndarray, unit: float = 1e-7
) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Attractions that the pairs can serve, pairs to keep, blocks, and trips moved.

    Where attractions can't all be reached by enough origins, the tightest set of
    zones (a minimal cut of the flow) is split off: its attractions are scaled to its
    origins, pairs across the split go, and both sides are looked at again.
    """
    d = d * (o.sum() / d.sum())
    wanted = d.copy()
    keep = np.ones(len(origin), bool)
    blocks, work = 0, [(np.arange(len(o)), np.arange(len(d)))]
    while work:
        rows, columns = work.pop()
        own = keep & np.isin(origin, rows) & np.isin(dest, columns)
        total = o[rows].sum()
        if not len(rows) or not len(columns) or total <= 0:
            continue
        wanted[columns] *= total / wanted[columns].sum()
        scale = 1 / (unit * total)
        place_o = {z: k + 1 for k, z in enumerate(rows)}
        place_d = {z: k + 1 + len(rows) for k, z in enumerate(columns)}
        flow = Flow(len(rows) + len(columns) + 2)
        sink = len(rows) + len(columns) + 1
        needs = [int(round(o[z] * scale)) for z in rows]
        for z, n in zip(rows, needs, strict=True):
            flow.edge(0, place_o[z], n)
        for z in columns:
            flow.edge(place_d[z], sink, int(round(wanted[z] * scale)) + 1)
        for k in np.flatnonzero(own):
            flow.edge(place_o[origin[k]], place_d[dest[k]], sum(needs))
        if flow.run(0, sink) >= sum(needs) - len(rows):
            blocks += 1
            continue
        depth = flow.levels(0)
        rows_in = np.array([z for z in rows if depth[place_o[z]] >= 0], int)
        columns_in = np.array([z for z in columns if depth[place_d[z]] >= 0], int)
        rows_out, columns_out = np.setdiff1d(rows, rows_in), np.setdiff1d(columns, columns_in)
        if not len(rows_in) or not len(rows_out) or not len(columns_out):
            blocks += 1
            continue
        across = own & (np.isin(origin, rows_in) != np.isin(dest, columns_in))
        keep &= ~across
        work += [(rows_in, columns_in), (rows_out, columns_out)]
    return wanted, keep, blocks, float(np.abs(wanted - d).sum() / 2)


def gateway_table(gateways: DataFrame) -> DataFrame:
    """Gateways with their share of the passengers of the zone they lie in."""
    total = F.sum(F.col("passengers").cast("double")).over(Window.partitionBy("zone_idx"))
    return gateways.withColumn("share", ratio(F.col("passengers"), total))


def gateway_od(gateways: DataFrame, weights: DataFrame, factor: float) -> DataFrame:
    """Singly constrained trips: factor * size spread over destinations by weight."""
    rows = gateways.select(F.col("zone_idx").alias("origin_zone"), "passengers").join(weights, "origin_zone")
    share = F.col("w") / F.sum("w").over(Window.partitionBy("origin_zone", "passengers"))
    return rows.select("origin_zone", "dest_zone", (F.col("passengers") * factor * share).alias("trips"))


def path_shares(segments: DataFrame, reach: DataFrame) -> DataFrame:
    """Departures of a gate pair over the departures that reach the destination."""
    keys = ["origin_zone", "dest_zone"]
    return segments.join(reach.select(*keys, "reached"), keys).withColumn("share", ratio("departures", "reached"))


def walk_pairs(reach: DataFrame) -> DataFrame:
    """Pairs that at least half of the departures reach by walking."""
    return reach.where(F.col("walked") * 2 >= F.col("reached"))


def station_flows(od: DataFrame, shares: DataFrame) -> DataFrame:
    """entry_station, exit_station, trips."""
    rows = od.join(shares, ["origin_zone", "dest_zone"])
    return rows.groupBy("entry_station", "exit_station").agg(F.sum(F.col("trips") * F.col("share")).alias("trips"))


def time_bands(od: DataFrame, bounds_min: list[int], band) -> DataFrame:
    """Per purpose and for all: trips, mean minutes and trips by band (lo, hi] of the cost."""
    minutes = F.col("cost_s") / 60
    labels = [*(f"to_{b}" for b in bounds_min), f"over_{bounds_min[-1]}"]
    rows = od.withColumn("band", band(minutes, bounds_min, labels))
    parts = [F.coalesce(F.sum(F.when(F.col("band") == x, F.col("trips"))), F.lit(0.0)).alias(x) for x in labels]
    both = rows.rollup("purpose").agg(F.sum("trips").alias("trips"), F.try_divide(F.sum(F.col("trips") * minutes), F.sum("trips")).alias("mean_min"), *parts)
    return both.withColumn("purpose", F.coalesce("purpose", F.lit("all")))


def search_least(evaluate: Callable[[float], float], low: float, high: float, grid: int = 12, refine: int = 8) -> tuple[float, bool]:
    """Argument of the least value: a logarithmic grid, then golden sections. Ties go to the smaller; True at a border."""
    points = np.geomspace(low, high, grid)
    seen = {float(x): evaluate(float(x)) for x in points}
    best = min(seen, key=lambda x: (seen[x], x))
    k = int(np.argmin(np.abs(points - best)))
    a, b = float(points[max(0, k - 1)]), float(points[min(grid - 1, k + 1)])
    golden = (5**0.5 - 1) / 2
    x, y = b - golden * (b - a), a + golden * (b - a)
    for _ in range(refine):
        for p in (x, y):
            if p not in seen:
                seen[p] = evaluate(p)
        if seen[x] <= seen[y]:
            b, y = y, x
            x = b - golden * (b - a)
        else:
            a, x = x, y
            y = a + golden * (b - a)
    best = min(seen, key=lambda z: (seen[z], z))
    return best, best in (float(points[0]), float(points[-1]))
