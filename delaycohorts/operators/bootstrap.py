"""Bootstrap intervals without a driver loop: replicate x draw rows and additive sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaycohorts.functions import codes
from delaycohorts.operators.topn import row_index


def unit_sums(df: DataFrame, unit: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """One row per resampled unit (a case, or a cluster) with its additive sums."""
    return df.groupBy(*unit).agg(*[F.sum(c).alias(name) for name, c in sums.items()])


def replicate_sums(
    units: DataFrame, unit: Sequence[str], sums: Sequence[str], replicates: int, seed: int,
) -> DataFrame:
    """Per replicate: the sums over as many draws with replacement as there are units.

    Draw (replicate, position) picks position ``hash mod size``. Picks are counted before
    they meet the unit rows, so the join carries counts, not copies.
    """
    order = codes.stable_hash("unit", *[F.col(c) for c in unit])
    placed = row_index(units, order)
    size = units.agg(F.count("*")).scalar()
    draws = placed.select("row_index", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    picked = draws.select(
        "replicate", F.pmod(codes.hash_int(str(seed), F.col("replicate"), F.col("row_index")), size).alias("row_index")
    ).groupBy("replicate", "row_index").agg(F.count("*").alias("times"))
    joined = picked.join(placed.select("row_index", *sums), "row_index")
    return joined.groupBy("replicate").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in sums])


def grouped_replicate_sums(
    units: DataFrame, base: Sequence[str], unit: Sequence[str], sums: Sequence[str], replicates: int, seed: int,
) -> DataFrame:
    """As ``replicate_sums``, with numbering and draws inside each base group.

    Base groups are few (years x candidates); units are numbered by hash range in each.
    """
    order = codes.stable_hash("unit", *[F.col(c) for c in (*base, *unit)])
    placed = row_index(units, order, groups=base)
    size = units.groupBy(*base).agg(F.count("*").alias("_size"))
    draws = placed.join(size, list(base)).select(
        *base, "_size", "row_index", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    )
    pick = F.pmod(codes.hash_int(str(seed), F.col("replicate"), F.col("row_index")), F.col("_size"))
    picked = draws.select(*base, "replicate", pick.alias("row_index")).groupBy(*base, "replicate", "row_index").agg(
        F.count("*").alias("times")
    )
    joined = picked.join(placed.select(*base, "row_index", *sums), [*base, "row_index"])
    return joined.groupBy(*base, "replicate").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in sums])


def interval(estimates: DataFrame, metric: Column, confidence: float = 0.95) -> DataFrame:
    """Percentile interval of a metric over the replicates."""
    alpha = (1 - confidence) / 2
    q = F.percentile("_m", F.array(F.lit(alpha), F.lit(1 - alpha)))
    return estimates.select(metric.alias("_m")).agg(
        F.count("*").cast("bigint").alias("replicates"), q.alias("_q")
    ).select(
        "replicates", F.lit(confidence).alias("confidence"),
        F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"),
    )


def bootstrap_interval(
    df: DataFrame, unit: Sequence[str], sums: dict[str, Column], metric: Column,
    replicates: int = 500, seed: int = 20260811, confidence: float = 0.95,
) -> DataFrame:
    """Interval of a ratio-of-sums metric; ``unit`` is the case id or the cluster columns."""
    if replicates <= 0:
        raise ValueError("bootstrap requires positive replicates")
    units = unit_sums(df, unit, sums)
    return interval(replicate_sums(units, unit, list(sums), replicates, seed), metric, confidence)


def cluster_columns(df: DataFrame) -> DataFrame:
    """Adds the cluster of a case: directional route by year and month."""
    return df.withColumn("cluster_route", F.concat_ws("-", "origin", "destination")).withColumn(
        "cluster_month", F.date_format("prediction_date", "yyyy-MM")
    )


def bin_sums(probability: Column, outcome: Column, weight: Column, bins: int = 10) -> dict[str, Column]:
    """Additive sums that a calibration error needs, one pair per bin."""
    at = F.least(F.floor(probability * bins).cast("int"), F.lit(bins - 1))
    sums = {"w": weight}
    for b in range(bins):
        sums[f"gap_{b}"] = F.when(at == b, (probability - outcome) * weight).otherwise(0.0)
    return sums


def calibration_error_of_sums(bins: int = 10) -> Column:
    total = F.lit(0.0)
    for b in range(bins):
        total = total + F.abs(F.col(f"gap_{b}"))
    return total / F.col("w")
