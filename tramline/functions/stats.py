"""Weighted and ranked statistics as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.plans.scratch import written


def nearest_rank(value: str, percents: list[int], sentinel: int = 1 << 30) -> list[Column]:
    """Nearest-rank percentiles with nulls as infinite; null where the rank meets one."""
    out = []
    for p in percents:
        rank = F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY coalesce(cast({value} AS bigint), {sentinel}))")
        out.append(F.when(rank < sentinel, rank).cast("long").alias(f"p{p}_s"))
    return out


def weighted_quantiles(rows: DataFrame, keys: list[str], value: str, weight: str, quantiles: list[float]) -> DataFrame:
    """Per group: the smallest value whose cumulated weight reaches q of the total."""
    order = Window.partitionBy(*keys).orderBy(value)
    # Equal values share one step, so that the result doesn't depend on their order.
    steps = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    steps = steps.withColumn("_cum", F.sum("_w").over(order)).withColumn("_all", F.sum("_w").over(Window.partitionBy(*keys)))
    picked = [
        F.min(F.when(F.col("_cum") >= F.col("_all") * q - 1e-12, F.col(value))).alias(f"q{round(q * 100):02d}") for q in quantiles
    ]
    return steps.groupBy(*keys).agg(*picked)


def percentiles(rows: DataFrame, value: Column, shares: dict[str, float]) -> DataFrame:
    """One row: mean and the exact percentiles (linear between neighbours, nulls left out) by name; nulls without values.

    Values are counted, dealt by ranges and the ranks looked up in the ranges that hold them, so that no task gathers all values.
    """
    counts = rows.select(value.cast("double").alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    # Written, as the numbers of the ranges must be the same each time they are read.
    ranged = written(counts.repartitionByRange("x").select("x", "n", F.spark_partition_id().alias("part")), "ranges")
    parts = ranged.groupBy("part").agg(F.sum("n").alias("here"), F.sum(F.col("x") * F.col("n")).alias("sum"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # one row a range
    parts = parts.withColumn("before", F.sum("here").over(order) - F.col("here"))
    parts = parts.select("*", F.sum("here").over(Window.partitionBy()).alias("total"), F.sum("sum").over(Window.partitionBy()).alias("sums"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), ((F.col("total") - 1) * F.lit(p)).alias("at")) for name, p in shares.items()))
    asked = parts.select("part", "before", "here", F.explode(wanted).alias("w")).select("part", "before", "here", "w.name", "w.at")
    asked = asked.where((F.col("before") <= F.ceil("at")) & (F.col("before") + F.col("here") > F.floor("at")))
    steps = ranged.join(F.broadcast(asked.select("part", "before").distinct()), "part")
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("x"))
    steps = steps.select("part", "x", (F.col("before") + upto).alias("upto"), (F.col("before") + upto - F.col("n")).alias("from"))
    found = steps.join(F.broadcast(asked.select("part", "name", "at")), "part")
    holds = lambda rank: F.max(F.when((F.col("from") <= rank) & (F.col("upto") > rank), F.col("x")))
    found = found.groupBy("name", "at").agg(holds(F.floor("at")).alias("low"), holds(F.ceil("at")).alias("high"))
    part = F.col("at") - F.floor("at")
    found = found.select("name", F.when(part == 0, F.col("low")).otherwise(F.col("low") * (1 - part) + F.col("high") * part).alias("v"))
    mean = parts.agg(F.max(F.col("sums") / F.col("total")).alias("mean"))
    return mean.crossJoin(found.agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares)))


def weighted_gini(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Per group: sum of w x (below - above) over (W squared times the mean); 0 without weight or mean."""
    order = Window.partitionBy(*keys).orderBy(value)
    steps = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    steps = steps.withColumn("_upto", F.sum("_w").over(order)).withColumn("_all", F.sum("_w").over(Window.partitionBy(*keys)))
    spread = F.col("_w") * F.col(value) * (2 * F.col("_upto") - F.col("_w") - F.col("_all"))
    sums = steps.groupBy(*keys).agg(F.sum(spread).alias("_s"), F.sum("_w").alias("_t"), F.sum(F.col("_w") * F.col(value)).alias("_wx"))
    gini = F.when((F.col("_t") > 0) & (F.col("_wx") > 0), F.col("_s") / (F.col("_t") * F.col("_wx"))).otherwise(0.0)
    return sums.select(*keys, gini.alias("gini"))


def average_rank(column: str, *keys: str) -> Column:
    """Rank from 1 with ties averaged."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, column)) - 1) / 2


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: correlation of average ranks."""
    ranked = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = ranked.select(average_rank(x).alias("rx"), average_rank(y).alias("ry"))
    return ranked.agg(F.corr("rx", "ry").alias("spearman"))


def geh(simulated: Column, observed: Column) -> Column:
    """sqrt(2 (s - o)^2 / (s + o)); 0 where both are 0."""
    return F.coalesce(F.sqrt(F.try_divide(2 * F.pow(simulated - observed, 2), simulated + observed)), F.lit(0.0))


def fit(rows: DataFrame, keys: list[str], simulated: str, observed: str) -> DataFrame:
    """Per group: rmse of shares, r2, pearson, mean GEH, share of GEH under 5, ratio of levels."""
    s, o = F.col(simulated).cast("double"), F.col(observed).cast("double")
    totals = rows.withColumns(
        {
            "_ss": F.try_divide(s, F.sum(s).over(Window.partitionBy(*keys))),
            "_os": F.try_divide(o, F.sum(o).over(Window.partitionBy(*keys))),
            "_g": geh(s, o),
        }
    )
    agg = totals.groupBy(*keys) if keys else totals
    sums = agg.agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(F.pow(F.col("_ss") - F.col("_os"), 2))).alias("rmse_share"),
        F.sum(F.pow(F.col("_ss") - F.col("_os"), 2)).alias("_res"),
        (F.sum(F.col("_os") * F.col("_os")) - F.count(F.lit(1)) * F.pow(F.avg("_os"), 2)).alias("_tot"),
        F.corr("_ss", "_os").alias("pearson"), F.avg("_g").alias("mean_geh"),
        F.avg((F.col("_g") < 5).cast("double")).alias("share_geh_5"), F.try_divide(F.sum(s), F.sum(o)).alias("level_ratio"),
    )
    return sums.select(
        *keys, "n", "rmse_share", (1 - F.try_divide("_res", "_tot")).alias("r2"), "pearson", "mean_geh", "share_geh_5", "level_ratio"
    )
