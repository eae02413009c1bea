"""Components and bounded walks on an undirected street graph."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.plans.scratch import written

MAX_ROUNDS = 100
#: Edges that a broadcast walk graph may hold; a larger network is cut into overlapping regions first.
MAX_EDGES = 5_000_000


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node) of every node with an edge (u, v).

    Labels take the least label of the neighbourhood, then that label's own label,
    so that long chains halve with every round. Rounds are written to the shared folder.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = written(both, "graph")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = labels.join(near, "node").withColumn("label", F.least("label", "near")).drop("near")
        step = step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("new"), "label")
        step = written(step.join(labels.select("node", F.col("label").alias("old")), "node"), "labels")
        changed = not step.where("new <> old").isEmpty()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def ranked_components(edges: DataFrame) -> DataFrame:
    """node, component numbered by size: 0 is the largest, ties to the lowest node."""
    found = components(edges)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    ranks = sizes.select("component", (F.row_number().over(Window.orderBy(F.desc("n"), "component")) - 1).alias("rank"))
    return found.join(ranks, "component").select("node", F.col("rank").cast("int").alias("component"))


class WalkGraph:
    """Street edges with points attached at a fraction of an edge and an offset from it."""

    def __init__(self, edges: list[tuple[int, int, int, float]], points: list[tuple[int, int, float, float]]):
        """edges: edge, from, to, metres. points: id, edge, fraction, offset."""
        self.near: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.edges = {e: (a, b, m) for e, a, b, m in edges}
        for _, a, b, m in edges:
            self.near[a].append((b, m))
            self.near[b].append((a, m))
        self.points = {p: (e, x, off) for p, e, x, off in points}
        self.at_node: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.on_edge: dict[int, list[int]] = defaultdict(list)
        for p, (e, x, off) in self.points.items():
            a, b, m = self.edges[e]
            self.at_node[a].append((p, x * m + off))
            self.at_node[b].append((p, (1 - x) * m + off))
            self.on_edge[e].append(p)

    def within(self, edge: int, fraction: float, offset: float, most: float) -> dict[int, float]:
        """Point -> metres, for all points no further than `most`; both offsets count."""
        a, b, m = self.edges[edge]
        out = {p: offset + abs(self.points[p][1] - fraction) * m + self.points[p][2] for p in self.on_edge[edge]}
        best: dict[int, float] = {}
        queue = [(offset + fraction * m, a), (offset + (1 - fraction) * m, b)]
        while queue:
            d, node = heapq.heappop(queue)
            if d > most or best.get(node, float("inf")) <= d:
                continue
            best[node] = d
            for p, extra in self.at_node.get(node, ()):
                out[p] = min(out.get(p, float("inf")), d + extra)
            for other, length in self.near[node]:
                heapq.heappush(queue, (d + length, other))
        return {p: d for p, d in out.items() if d <= most}


def bounded_walks(starts: DataFrame, edges: DataFrame, points: DataFrame, most_m: float) -> DataFrame:
    """id, point, metres for every start and point within reach; never a start with itself as a point of the same id.

    starts: id, edge_idx, fraction, offset. The graph is broadcast once its size is checked.
    """
    n = edges.count()
    if n > MAX_EDGES:
        raise ValueError(f"{n} edges; cut the network into overlapping regions of {MAX_EDGES} at most")
    spark = starts.sparkSession
    graph = spark.sparkContext.broadcast(
        (
            [tuple(r) for r in edges.select("edge_idx", "from_node", "to_node", "length_m").toLocalIterator()],
            [tuple(r) for r in points.select("point", "edge_idx", "fraction", "offset").toLocalIterator()],
        )
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = WalkGraph(*graph.value)
        for batch in batches:
            rows = [
                (r.id, p, d) for r in batch.itertuples() for p, d in sorted(own.within(r.edge_idx, r.fraction, r.offset, most_m).items())
            ]
            yield pd.DataFrame(rows, columns=["id", "point", "metres"])

    return starts.select("id", "edge_idx", "fraction", "offset").mapInPandas(walk, "id long, point long, metres double")
