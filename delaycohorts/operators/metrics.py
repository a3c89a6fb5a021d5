"""Study metrics as ratios of additive sums, so that any grouping is one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 10


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def pinball(actual: Column, predicted: Column, q: float) -> Column:
    error = actual - predicted
    return F.greatest(F.lit(q) * error, F.lit(q - 1) * error)


def covered(actual: Column, predicted: Column) -> Column:
    return (actual <= predicted).cast("double")


def exact_ties(df: DataFrame, columns: Sequence[str], digits: int = 9) -> DataFrame:
    """Rounds the columns, so that the last bits of a double do not part a quantile from a delay of whole
    minutes, or a probability from an edge of its bin."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def arrival_metrics(
    weight: Column | None = None, qs: Sequence[tuple[str, float]] = (("p50", 0.5), ("p75", 0.75), ("p90", 0.9)),
) -> list[Column]:
    """Aggregates over rows with ``actual``, the quantile columns and ``crps``."""
    w = weight if weight is not None else F.lit(1.0)
    actual = F.col("actual")
    out = [F.count("*").cast("bigint").alias("sample_count"), F.sum(w).alias("population_weight")]
    for name, q in qs:
        out.append(weighted_mean(covered(actual, F.col(name)), w).alias(f"{name}_coverage"))
        out.append(weighted_mean(pinball(actual, F.col(name), q), w).alias(f"{name}_pinball_loss"))
    out.append(weighted_mean(F.abs(actual - F.col("p50")), w).alias("median_mae"))
    out.append(weighted_mean(F.col("crps"), w).alias("mean_crps"))
    out.append(weighted_mean((actual > 30).cast("double"), w).alias("severe_delay_frequency"))
    return out


def brier(probability: Column, outcome: Column) -> Column:
    return (probability - outcome) * (probability - outcome)


def bin_of(probability: Column, bins: int = BINS) -> Column:
    return F.least(F.floor(probability * bins).cast("int"), F.lit(bins - 1))


def calibration_bins(
    df: DataFrame, dims: Sequence[str] = (), weight: Column | None = None, bins: int = BINS
) -> DataFrame:
    """Rows with ``probability`` and ``outcome`` per populated bin."""
    w = weight if weight is not None else F.lit(1.0)
    p, y = F.col("probability"), F.col("outcome")
    grouped = df.groupBy(*dims, bin_of(p, bins).alias("bin")).agg(
        F.count("*").cast("bigint").alias("sample_count"), F.sum(w).alias("population_weight"),
        weighted_mean(p, w).alias("mean_predicted_probability"),
        weighted_mean(y, w).alias("observed_success_frequency"),
    )
    b = F.col("bin")
    return grouped.select(*dims, "bin", (b / bins).alias("bin_start"), ((b + 1) / bins).alias("bin_end"),
                          "sample_count", "population_weight", "mean_predicted_probability", "observed_success_frequency")


def calibration_error() -> Column:
    """Aggregate over calibration bins."""
    gap = F.abs(F.col("mean_predicted_probability") - F.col("observed_success_frequency"))
    return F.sum(F.col("population_weight") * gap) / F.sum("population_weight")


def connection_metrics(df: DataFrame, dims: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Sample size, means, Brier, gap and calibration error per group, from one pass over the rows.

    The rows are reduced to sums per group and bin first; every metric is built from those.
    """
    w = weight if weight is not None else F.lit(1.0)
    p, y = F.col("probability"), F.col("outcome")
    sums = df.groupBy(*dims, bin_of(p).alias("bin")).agg(
        F.count("*").cast("bigint").alias("n"), F.sum(w).alias("w"), F.sum(p * w).alias("wp"),
        F.sum(y * w).alias("wy"), F.sum(brier(p, y) * w).alias("wb"),
    )
    total = F.sum("w")
    return sums.groupBy(*dims).agg(
        F.sum("n").cast("bigint").alias("sample_count"),
        (F.sum("wp") / total).alias("mean_predicted_probability"),
        (F.sum("wy") / total).alias("observed_success_frequency"),
        (F.sum("wb") / total).alias("brier_score"),
        ((F.sum("wp") - F.sum("wy")) / total).alias("mean_calibration_gap"),
        (F.sum(F.abs(F.col("wp") - F.col("wy"))) / total).alias("ece"),
    )


def metrics_by(
    df: DataFrame, dims: Sequence[str], aggregates: list[Column], base: Sequence[str] = (),
    min_rows: int = 1,
) -> DataFrame:
    """The same aggregates in total and for each dimension separately: one scan, grouping sets.

    ``base`` columns (a split, a configuration) are part of every set.
    """
    sets = [[*base], *[[*base, d] for d in dims]]
    grouped = df.groupingSets(sets, *base, *dims).agg(
        *[F.grouping(d).alias(f"_g_{d}") for d in dims], F.count("*").alias("_rows"), *aggregates
    )
    name, value = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for d in dims:
        name = name.when(F.col(f"_g_{d}") == 0, d)
        value = value.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string"))
    drop = {*base, *dims, "_rows", *[f"_g_{d}" for d in dims]}
    labels = [c for c in grouped.columns if c not in drop]
    name, value = name.otherwise("all"), value.otherwise("all")
    return grouped.where((F.col("_rows") >= min_rows) | (name == "all")).select(
        *base, name.alias("dimension"), value.alias("value"), *labels
    )


def long_dimensions(df: DataFrame, dims: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Each row once per dimension as (dimension, value); for metrics that need bins."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims]))
    return df.select(*keep, pairs.alias("_d")).select(*keep, "_d.dimension", "_d.value")


def usage(df: DataFrame, level: str = "cohort_level", dims: Sequence[str] = ()) -> DataFrame:
    """Cases and share per level."""
    counts = df.groupBy(*dims, level).agg(F.count("*").cast("bigint").alias("cases"))
    if dims:
        total = counts.groupBy(*dims).agg(F.sum("cases").alias("_t"))
        counts = counts.join(total, list(dims))
    else:
        counts = counts.withColumn("_t", counts.agg(F.sum("cases")).scalar())
    return counts.select(*dims, level, "cases", (F.col("cases") / F.col("_t")).alias("share"))
