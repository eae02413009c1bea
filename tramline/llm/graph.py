"""Links inside candidate buckets, and connected components.

Ids may be of any ordered type. Nothing here gathers a bucket, a neighbourhood or
a component in one row, task or the driver: all steps are joins with one row a
key on one side or with members in blocks of bounded size on both, and aggregates
that are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.shared import discard, written

#: Members of a key that one task compares with as many others, and the same where the comparison decides by itself.
BLOCK, DECIDED = 1024, 256
#: Edges up to this number (16 bytes each) are linked in one task, so that a pass needs no exchange; more are dealt out.
ONE_TASK = 1 << 17


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def large_star(edges: DataFrame, few: bool = False) -> DataFrame:
    """Each node's larger neighbours are linked with the smallest of its neighbourhood."""
    both = _together(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), few)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, few: bool = False) -> DataFrame:
    """Each node and its smaller neighbours are linked with the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _together(near.union(least.select("u", F.col("m").alias("v"))), few).distinct()


def _together(frame: DataFrame, few: bool) -> DataFrame:
    """In one partition, without an exchange, if there are few rows."""
    return frame.coalesce(1) if few else frame


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node with an edge (columns u, v).

    Alternates large-star and small-star, each pass written to the shared folder,
    until the edges are the stars of the components. Self-links and nulls are ignored.
    No pass has more edges than the one before it, so that few stay few.
    """
    links = edges.select("u", "v").where("u <> v")
    few = links.count() <= ONE_TASK
    now = written(_together(links, few).distinct(), "edges")
    before = _signature(_together(now, few))
    while before[0]:
        following = written(small_star(large_star(_together(now, few), few), few), "edges")
        after = _signature(_together(following, few))
        discard(now)
        now = following
        if after == before:
            break
        before = after
    edges = _together(now, few)
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = _together(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres), few)
    out._tramline_path = now._tramline_path
    return out


def _groups(links: DataFrame) -> DataFrame:
    """The components, from a table of their own; the edges' last table goes."""
    found = components(links)
    out = written(found, "components")
    discard(found)
    return out


def _with_component(members: DataFrame, found: DataFrame) -> DataFrame:
    """members (…, id) with comp: the id's component, or the id itself."""
    return members.join(found.select(F.col("node").alias("id"), F.col("component").alias("c")), "id", "left").withColumn(
        "comp", F.coalesce("c", "id")
    ).drop("c")


def _open(members: DataFrame) -> DataFrame:
    """Members of the keys that still hold two components."""
    split = members.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    return members.join(split.select("key"), "key", "left_semi")


class Buckets:
    """Ids that share a key, and the links among them.

    members: key, id; a member may occur twice. No pair inside a component found so
    far is looked at:

    1. every member against its key's smallest id (`pairs`);
    2. where a key still holds several components, every member against the one
       most like the first head (in a group of edited copies that is the least
       edited one);
    3. what is left: members outside the second head's component against those of
       other components, unless `narrow` rules them out.

    Heads leave their keys once all their pairs there are decided, so that step 3
    covers every undecided pair and no link is lost. Keys of two members, nearly
    all of them, need no join: the aggregate holds the pair.

    alike(x, y) is a condition on the columns of two members (names prefixed by
    "x." and "y.", from `sketch`: id, ...) that every linked pair meets. narrow(rows)
    adds columns to the rows (key, id, ...) of step 3, and near(x, y) is a condition
    on them that every linked pair meets. decide(x, y), on the same columns, says
    exactly whether a pair is linked: step 3 then compares members where their blocks
    meet, and only links leave the join. With `spent`, the table behind members is
    deleted as soon as the keys are read.
    """

    def __init__(
        self, members: DataFrame, alike: Callable[[str, str], Column] | None = None, sketch: DataFrame | None = None, narrow: Callable[[DataFrame], DataFrame] | None = None,
        near: Callable[[str, str], Column] | None = None, spent: bool = False, decide: Callable[[str, str], Column] | None = None,
    ):
        self.alike, self.narrow, self.near, self.decide = alike, narrow, near, decide
        # The ends are plain values, so that a hash aggregate makes them.
        ends = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("x"), F.max("id").alias("y"))
        ends = written(ends.where("x <> y"), "buckets")
        star = members.join(ends.where("n > 2").select("key", F.col("x").alias("head")), "key").where("id <> head")
        self.star = written(star.select("key", "head", "id").distinct(), "star")
        if spent:
            discard(members)
        pairs = ends.where("n = 2").select("x", "y").union(self.star.select("head", "id"))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        self.sketch = sketch
        if sketch is None or alike is None:
            self.pairs = written(pairs, "pairs")
        else:
            # From here on only the members of shared keys count.
            pairs = written(pairs, "pairs")
            self.sketch = written(sketch.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi"), "sketch", "zstd")
            self.pairs = written(self._screened(pairs), "pairs")
            discard(pairs)
        discard(ends)

    def _screened(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sketches are alike."""
        if self.sketch is None or self.alike is None:
            return pairs
        x = self.sketch.select(F.col("id").alias("a"), F.struct("*").alias("x"))
        y = self.sketch.select(F.col("id").alias("b"), F.struct("*").alias("y"))
        return pairs.join(x, "a").join(y, "b").where(self.alike("x", "y")).select("a", "b")

    def candidates(self) -> DataFrame:
        """id: everything that a step may verify. To be read before `link`."""
        ids = self.pairs.select(F.explode(F.array("a", "b")).alias("id"))
        return ids.union(self.star.select("id")).distinct()

    def link(self, verify: Callable[[DataFrame], DataFrame], known: DataFrame | None = None) -> DataFrame:
        """node, component of all linked ids. verify: (a, b) -> (a, b, sim, linked), deciding exactly. known: links (u, v) that hold anyway."""
        first = written(verify(self.pairs), "decided")
        discard(self.pairs)
        links = first.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        if known is not None:
            links = links.union(known.select("u", "v"))
        found = _groups(links)
        rest = written(_open(_with_component(self.star, found)), "open")
        if rest.isEmpty():
            return found

        sims = first.select(F.col("a").alias("head"), F.col("b").alias("id"), "sim")
        near = rest.join(sims, ["head", "id"], "left").withColumn("sim", F.coalesce("sim", F.lit(-1.0)))
        order = F.struct("sim", "id")
        second = near.groupBy("key").agg(F.max_by("id", order).alias("head"), F.max_by("comp", order).alias("hc"))
        second = written(second, "heads")
        spokes = rest.select("key", "id", "comp").join(second, "key").where("id <> head")
        # Members that are linked with the head already need no comparison.
        pairs = spokes.where("comp <> hc").select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct()
        more = written(verify(self._screened(pairs)), "decided")
        links = links.union(more.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
        discard(found)
        found = _groups(links)
        left = _with_component(spokes.select("key", "id", "head"), found).join(
            found.select(F.col("node").alias("head"), F.col("component").alias("hc")), "head", "left"
        ).withColumn("head_comp", F.coalesce("hc", "head"))
        # Keys of one head go together, so that a pair that shares many keys is looked at once.
        left = left.select(F.col("head").alias("key"), "id", "comp", "head_comp").distinct()
        left = written(_open(left), "open")
        if left.isEmpty():
            return found

        if self.narrow is not None and self.decide is None:
            left = written(self.narrow(left), "narrowed")
        if self.sketch is not None:
            left = left.join(self.sketch, "id")
        if self.decide is not None:
            left = written(left, "narrowed", "zstd")
        if self.decide is None:
            last = written(verify(self._undecided(left)), "decided")
        else:
            last = self._decided(left)
        links = links.union(last.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
        found = _groups(links)
        for table in (first, more, last, rest, second, left):
            discard(table)
        return found

    def _blocks(self, left: DataFrame, size: int) -> tuple[DataFrame, DataFrame, Column]:
        """Rows of step 3 (key: a head, id, comp, head_comp, and what the conditions read) once for each block they meet, as x and y, and when they do."""
        n = left.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n_blocks"))
        left = left.join(n, "key").withColumn("own", F.pmod(F.hash("id"), F.col("n_blocks")))
        every = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
        x = left.where("comp <> head_comp").select("*", F.col("own").alias("bx"), every.alias("by"))
        y = left.select("*", F.col("own").alias("by"), every.alias("bx"))
        new = F.col("x.comp") != F.col("y.comp")
        new &= (F.col("y.comp") == F.col("y.head_comp")) | (F.col("x.id") < F.col("y.id"))
        for condition in (self.alike, self.near):
            new &= condition("x", "y") if condition is not None else F.lit(True)
        return x, y, new

    def _undecided(self, left: DataFrame) -> DataFrame:
        """The pairs (a, b) of step 3 that meet all conditions. Members of a head meet in blocks, so that no task gets the whole of a large one."""
        x, y, new = self._blocks(left, BLOCK)
        x, y = x.alias("x"), y.alias("y")
        new &= (F.col("x.key") == F.col("y.key")) & (F.col("x.bx") == F.col("y.bx")) & (F.col("x.by") == F.col("y.by"))
        return x.join(y, new).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()

    def _decided(self, left: DataFrame) -> DataFrame:
        """The links (a, b, linked) of step 3.

        What `decide` reads is sent only to the blocks where a member meets another that the conditions let pass. Rows are dealt
        out by number: by size, adaptive execution would gather blocks that take long to compare.
        """
        x, y, new = self._blocks(left, DECIDED)
        tasks = max(1, min(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-left.count() // 64)))
        cell = F.xxhash64("key", "bx", "by").alias("cell")
        x, y = (f.select(cell, *[c for c in left.columns if c != "key"]).repartition(tasks, "cell") for f in (x, y))
        meet = (F.col("x.cell") == F.col("y.cell")) & new
        x = written(x.alias("x").join(y.alias("y"), meet, "left_semi"), "cells", "zstd")
        back = y.alias("y").join(x.repartition(tasks, "cell").alias("x"), meet, "left_semi")
        y = written(back, "cells", "zstd")
        used, ids = [left, x, y], x.select("id").union(y.select("id")).distinct()
        if self.narrow is not None:
            more = written(self.narrow(ids), "texts", "zstd")
            used.append(more)
            x, y = x.join(more, "id"), y.join(more, "id")
        # One expression, so that the dear comparison stands behind the cheap ones.
        links = (F.col("x.cell") == F.col("y.cell")) & F.when(new, self.decide("x", "y")).otherwise(False)
        both = x.repartition(tasks, "cell").alias("x").join(y.repartition(tasks, "cell").alias("y"), links)
        both = both.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        out = written(both.withColumn("linked", F.lit(True)), "decided")
        for table in used:
            discard(table)
        return out
