"""Travel-time percentiles and cumulative-opportunity accessibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.stats import nearest_rank, weighted_gini, weighted_quantiles

PERCENTILES = [25, 50, 75]
THRESHOLDS = [15, 30, 45, 60]
QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9]


def percentile_matrix(samples: DataFrame, limit_s: int, percents: list[int] = PERCENTILES) -> DataFrame:
    """origin_zone, dest_zone and p<k>_s by nearest rank; unreached samples (null) are infinite.

    A pair is kept where its lowest percentile is within the limit; higher ones
    beyond the limit are null.
    """
    pairs = samples.groupBy("origin_zone", "dest_zone").agg(*nearest_rank("seconds", percents))
    low = f"p{percents[0]}_s"
    rest = [F.when(F.col(f"p{p}_s") <= limit_s, F.col(f"p{p}_s")).alias(f"p{p}_s") for p in percents]
    return pairs.where(F.col(low) <= limit_s).select("origin_zone", "dest_zone", *rest)


def long_matrix(matrix: DataFrame, percents: list[int] = PERCENTILES) -> DataFrame:
    """One row per pair and percentile."""
    parts = ", ".join(f"{p}, p{p}_s" for p in percents)
    return matrix.select("origin_zone", "dest_zone", F.expr(f"stack({len(percents)}, {parts}) AS (percentile, seconds)"))


def opportunities(zones: DataFrame, attraction: DataFrame, score: str) -> DataFrame:
    """zone_idx and shares (est_jobs, population) that sum to 1 each. Uncovered zones are an error."""
    both = zones.select("zone_idx", "population").join(attraction.select("zone_idx", F.col(score).alias("score")), "zone_idx", "left")
    totals = both.agg(F.sum("score").alias("all_jobs"), F.sum("population").alias("all_people"))
    covered = F.when(F.col("score").isNull(), F.raise_error(F.lit("a zone has no attraction"))).otherwise(F.col("score"))
    return both.crossJoin(F.broadcast(totals)).select(  # one row
        "zone_idx", F.try_divide(covered.cast("double"), F.col("all_jobs").cast("double")).alias("est_jobs"),
        F.try_divide(F.col("population").cast("double"), F.col("all_people").cast("double")).alias("population"),
    )


def cumulative(
    matrix: DataFrame, shares: DataFrame, measures: list[str], percents: list[int] = PERCENTILES, thresholds: list[int] = THRESHOLDS
) -> DataFrame:
    """zone_idx, percentile, threshold_min and per measure the share of opportunities reached.

    One pass over the matrix: sums of all percentile and threshold combinations are
    conditional aggregates, so that the shuffle is one row a zone and map task. A
    pair counts with seconds <= threshold; null never counts; every zone has rows.
    """
    dests = shares.withColumnRenamed("zone_idx", "dest_zone")
    joined = matrix.join(dests, "dest_zone")
    cells = [(p, t, m) for p in percents for t in thresholds for m in measures]
    sums = joined.groupBy("origin_zone").agg(
        *[F.sum(F.when(F.col(f"p{p}_s") <= t * 60, F.col(m)).otherwise(0.0)).alias(f"{m}_{p}_{t}") for p, t, m in cells]
    )
    every = shares.select(F.col("zone_idx").alias("origin_zone")).join(sums, "origin_zone", "left")
    rows = [
        F.struct(
            F.lit(p).alias("percentile"), F.lit(t).alias("threshold_min"),
            *[F.coalesce(F.col(f"{m}_{p}_{t}"), F.lit(0.0)).alias(m) for m in measures],
        ) for p in percents for t in thresholds
    ]
    return every.select(F.col("origin_zone").alias("zone_idx"), F.explode(F.array(*rows)).alias("r")).select("zone_idx", "r.*")


def headline_sensitivity(
    matrix: DataFrame, sets: dict[str, DataFrame], percent: int, thresholds: list[int] = THRESHOLDS
) -> DataFrame:
    """weighting, threshold_min, share, change: the opportunity sets' mean reach in one pass, and its change against the first."""
    names = list(sets)
    weights = None
    for name, table in sets.items():
        own = table.select(F.col("zone_idx").alias("dest_zone"), F.col("share").alias(name))
        weights = own if weights is None else weights.join(own, "dest_zone", "full")
    joined = matrix.join(weights, "dest_zone").where(F.col(f"p{percent}_s").isNotNull())
    n = weights.agg(F.count(F.lit(1)).alias("n_zones"))
    sums = joined.agg(
        *[F.sum(F.when(F.col(f"p{percent}_s") <= t * 60, F.coalesce(w, F.lit(0.0))).otherwise(0.0)).alias(f"{w}_{t}") for w in names for t in thresholds]
    ).crossJoin(n)
    rows = [
        F.struct(
            F.lit(w).alias("weighting"), F.lit(t).alias("threshold_min"), (F.coalesce(F.col(f"{w}_{t}"), F.lit(0.0)) / F.col("n_zones")).alias("share"),
            ((F.coalesce(F.col(f"{w}_{t}"), F.lit(0.0)) - F.coalesce(F.col(f"{names[0]}_{t}"), F.lit(0.0))) / F.col("n_zones")).alias("change"),
        ) for w in names for t in thresholds
    ]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def summaries(table: DataFrame, people: DataFrame, edge: DataFrame, measure: str, floor: float = 0.01) -> DataFrame:
    """Per scope (all, no_edge), percentile and threshold: weighted mean, quantiles, gini and the weight below `floor`.

    people: zone_idx, population. edge: zone_idx of edge zones.
    """
    keys = ["scope", "percentile", "threshold_min"]
    rows = table.join(people.select("zone_idx", F.col("population").alias("w")), "zone_idx")
    rows = rows.join(edge.select("zone_idx", F.lit(True).alias("_edge")), "zone_idx", "left")
    scopes = F.when(F.col("_edge"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("no_edge")))
    rows = rows.withColumn("scope", F.explode(scopes)).select(*keys, F.col(measure).alias("v"), F.col("w").cast("double").alias("w"))
    means = rows.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w")).alias("mean"),
        F.try_divide(F.sum(F.when(F.col("v") < floor, F.col("w")).otherwise(0.0)), F.sum("w")).alias("share_below"),
    )
    quantiles = weighted_quantiles(rows, keys, "v", "w", QUANTILES)
    return means.join(quantiles, keys).join(weighted_gini(rows, keys, "v", "w"), keys)


def wide(table: DataFrame, measure: str, percents: list[int] = PERCENTILES, thresholds: list[int] = THRESHOLDS) -> DataFrame:
    """zone_idx and a column for each percentile and threshold."""
    return table.groupBy("zone_idx").agg(
        *[
            F.max(F.when((F.col("percentile") == p) & (F.col("threshold_min") == t), F.col(measure))).alias(f"p{p}_t{t}")
            for p in percents for t in thresholds
        ]
    )


def merge_origins(base: DataFrame, fresh: DataFrame, origins: DataFrame) -> DataFrame:
    """The base matrix with all rows of the given origins replaced."""
    return base.join(origins.select("origin_zone"), "origin_zone", "left_anti").unionByName(fresh)


def candidate_pairs(matrix: DataFrame, cost: str, exclude_intrazonal: bool = True) -> DataFrame:
    """origin_zone, dest_zone, cost_s of pairs with a cost. An unknown column is an error."""
    if cost not in matrix.columns:
        raise ValueError(f"no column {cost}; there are {', '.join(matrix.columns)}")
    pairs = matrix.where(F.col(cost).isNotNull())
    if exclude_intrazonal:
        pairs = pairs.where("origin_zone <> dest_zone")
    return pairs.select("origin_zone", "dest_zone", F.col(cost).alias("cost_s"))


def zone_point(lat: Column, lon: Column, pop_lat: Column, pop_lon: Column) -> list[Column]:
    """The population-weighted point where there is one, else the centre, and which it is."""
    own = pop_lat.isNotNull() & pop_lon.isNotNull()
    return [F.when(own, pop_lat).otherwise(lat).alias("lat"), F.when(own, pop_lon).otherwise(lon).alias("lon"), F.when(own, "population").otherwise("centre").alias("point_kind")]
