"""Ordered operators: neighbours, running sums, fills, islands, ranks and top rows.

Every function takes an explicit order. Operators per key shuffle once by the key;
`dense_index` numbers a whole table without sending it to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.plans.scratch import written


def _w(keys: list[str], order: list):
    return Window.partitionBy(*keys).orderBy(*order)


def neighbours(rows: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """prev_<c> and next_<c> of each column."""
    w = _w(keys, order)
    made = {f"prev_{c}": F.lag(c).over(w) for c in columns} | {f"next_{c}": F.lead(c).over(w) for c in columns}
    return rows.withColumns(made)


def running_sum(rows: DataFrame, keys: list[str], order: list, value: str, name: str, exclusive: bool = False) -> DataFrame:
    """Sum up to the row, or of the rows before it."""
    frame = _w(keys, order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    return rows.withColumn(name, F.coalesce(F.sum(value).over(frame), F.lit(0)))


def fills(rows: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """last_<value> and next_<value>: the nearest non-null at or before, and at or after, the row."""
    w = _w(keys, order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    # A running frame over the reversed order: frames that end at the last row are far dearer.
    ahead = _w(keys, [F.desc(o) if isinstance(o, str) else o for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns(
        {f"last_{value}": F.last(value, ignorenulls=True).over(back), f"next_{value}": F.last(value, ignorenulls=True).over(ahead)}
    )


def islands(rows: DataFrame, keys: list[str], order: list, inside: Column, least: int = 2) -> DataFrame:
    """Runs of rows that are inside: piece from 0 in order, kept with `least` rows or more, renumbered without holes."""
    w = _w(keys, order)
    marked = rows.withColumn("_in", F.coalesce(inside, F.lit(False)))
    marked = marked.withColumn("_start", (F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))).cast("int"))
    marked = marked.withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_in")
    sized = marked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run"))).where(F.col("_n") >= least)
    return sized.withColumn("piece", (F.dense_rank().over(_w(keys, ["_run"])) - 1).cast("int")).drop("_in", "_start", "_run", "_n")


def sessions(rows: DataFrame, keys: list[str], time: str, gap: int, *ties: str) -> DataFrame:
    """Islands by a gap of more than so many units of `time`: session from 0."""
    w = _w(keys, [time, *ties])
    new = F.coalesce((F.col(time) - F.lag(time).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn(
        "session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    ).drop("_new")


def numbered(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Row number from 0."""
    return rows.withColumn(name, (F.row_number().over(_w(keys, order)) - 1).cast("int"))


def top_rows(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key; Spark cuts every input partition to n rows a key before the shuffle."""
    return rows.withColumn("_k", F.row_number().over(_w(keys, order))).where(F.col("_k") <= n).drop("_k")


def top_fraction(rows: DataFrame, order: list, share: float) -> DataFrame:
    """The first max(1, share of all) rows of a table."""
    n = max(1, int(rows.count() * share))
    return rows.orderBy(*order).limit(n)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of keys that occur more than once; keys with a null never count."""
    held = [F.col(k).isNotNull() for k in keys]
    kept = rows
    for h in held:
        kept = kept.where(h)
    return kept.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n > 1").drop("_n")


def share_of_total(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.try_divide(F.col(value).cast("double"), F.sum(F.col(value).cast("double")).over(Window.partitionBy(*keys))))


def logit_share(rows: DataFrame, keys: list[str], cost: str, scale: float, name: str) -> DataFrame:
    """Shares in proportion to exp(-scale * cost), shifted by the least cost of the key."""
    shifted = rows.withColumn("_e", F.exp(-scale * (F.col(cost) - F.min(cost).over(Window.partitionBy(*keys)))))
    return share_of_total(shifted, keys, "_e", name).drop("_e")


def dense_index(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number all rows from 0 in the given total order.

    The rows are dealt into sorted ranges; each range's count, one number a
    partition, gives the offset of the next. No task sees more than its range. The
    ranges are written once, since a second run could draw other borders.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("_dense_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_dense_part").agg(F.count(F.lit(1)).alias("_dense_n"))
    offsets = counts.withColumn(
        "_dense_before", F.coalesce(F.sum("_dense_n").over(Window.orderBy("_dense_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_dense_part", "_dense_before")
    local = ranged.withColumn("_dense_k", F.row_number().over(_w(["_dense_part"], list(order))) - 1)
    return local.join(offsets, "_dense_part").withColumn(name, (F.col("_dense_before") + F.col("_dense_k")).cast("long")).drop("_dense_part", "_dense_k", "_dense_before")


def signature(rows: DataFrame, keys: list[str], order: str, parts: list[str], name: str = "signature") -> DataFrame:
    """Per key, an ordered text of the parts, used as an equality key."""
    one = F.struct(F.col(order), F.concat_ws("|", *(F.col(p).cast("string") for p in parts)).alias("t"))
    ordered = F.array_sort(F.collect_list(one))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), ",").alias(name))


def sample_rows(rows: DataFrame, keys: list[str], seed: int, n: int) -> DataFrame:
    """n rows without replacement, fixed by the keys and the seed."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)
