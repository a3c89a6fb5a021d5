"""Work on cohort histograms (value, n): quantiles, CRPS, probabilities, resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from delaycohorts.functions.transfer import Transfer
from delaycohorts.operators import packed
from delaycohorts.operators.cohorts import BOUNDS, KEY, packed_histograms

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


def quantile_name(q: float) -> str:
    return f"p{round(q * 100)}"


def quantiles(hist: DataFrame, keys: Sequence[str], qs: Sequence[float] = QUANTILES, value: str = "delay") -> DataFrame:
    """Exact linear-interpolated quantiles per key, weighted by ``n``."""
    q = F.percentile(F.col(value), F.array(*[F.lit(x) for x in qs]), F.col("n"))
    out = hist.groupBy(*keys).agg(q.alias("_q"), F.sum("n").cast("bigint").alias("cohort_n"))
    return out.select(*keys, *[F.col("_q")[i].alias(quantile_name(x)) for i, x in enumerate(qs)], "cohort_n")


def attach_members(selected: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per case and distinct delay of its cohort; rejected cases drop out.

    A case meets the packed row of its cohort, which is listed after the join: no row per delay is moved or sorted.
    """
    met = selected.join(rows.select(*KEY, *BOUNDS, "delays", "counts"), [*KEY, *BOUNDS])
    pair = F.explode(F.arrays_zip("delays", "counts")).alias("_p")
    return met.select(*selected.columns, pair).select(*selected.columns, F.col("_p.delays").alias("delay"), F.col("_p.counts").alias("n"))


def spread(hist: DataFrame, keys: Sequence[str], value: str = "delay") -> DataFrame:
    """Half the mean absolute difference of two draws, per key (the CRPS pair term).

    For a block of n equal values with c values below it the sorted-rank weights add up to
    n * (2c + n - N), so nothing is expanded to single values.
    """
    by_value = W.partitionBy(*keys).orderBy(value)
    whole = W.partitionBy(*keys)
    ranked = hist.select(
        *keys, value, "n",
        F.sum("n").over(by_value.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_to"),
        F.sum("n").over(whole).alias("_N"),
    )
    weight = F.col("n") * (F.lit(2) * (F.col("_to") - F.col("n")) + F.col("n") - F.col("_N"))
    # taken relative to N before squaring: stays inside double range for huge cohorts
    term = F.sum(F.col(value) * (weight.cast("double"))) / F.max(F.col("_N").cast("double")) / F.max(F.col("_N").cast("double"))
    return ranked.groupBy(*keys).agg(term.alias("spread"))


def evaluate_cases(
    selected: DataFrame, members: DataFrame, *, case_columns: Sequence[str],
    layover: Column | None = None, actual: Column | None = None,
    qs: Sequence[float] = (0.5, 0.75, 0.9), transfer: Transfer = Transfer(), value: str = "delay",
    keys: Sequence[str] = (*KEY, *BOUNDS),
) -> DataFrame:
    """Per case: quantiles, and (if asked) connection probability and CRPS.

    Quantiles and the pair term are computed once per distinct cohort, probability and distance once
    per distinct cohort, layover and actual delay. Cases meet the finished values by all of these, so
    that cases of one broad cohort are spread over its layovers or delays.
    """
    v = F.col(value)
    stats = quantiles(members, keys, qs, value)
    if actual is not None:
        stats = stats.join(spread(members, keys, value), list(keys))
    names = [quantile_name(q) for q in qs]
    asked = {name: c for name, c in (("_layover", layover), ("_actual", actual)) if c is not None}
    if not asked:
        return selected.join(stats, list(keys)).select(*case_columns, *names, "cohort_n")
    marked = selected.withColumns({**asked, "_asked": F.struct(*[c.alias(n) for n, c in asked.items()])})
    wanted = marked.select(*keys, "_asked", *asked).distinct()
    aggs = []
    if layover is not None:
        aggs.append((F.sum(F.col("n") * transfer.success(F.col("_layover"), v)) / F.sum("n")).alias("probability"))
    if actual is not None:
        aggs.append((F.sum(F.col("n") * F.abs(v - F.col("_actual"))) / F.sum("n")).alias("_first"))
    found = wanted.join(members, list(keys)).groupBy(*keys, "_asked").agg(*aggs).join(stats, list(keys))
    out = marked.join(found, [*keys, "_asked"])
    if actual is not None:
        out = out.withColumn("crps", F.col("_first") - F.col("spread"))
    results = [*(["probability"] if layover is not None else []), *(["crps"] if actual is not None else [])]
    return out.select(*case_columns, *names, "cohort_n", *results)


def evaluate_cohorts(
    selected: DataFrame, daily: DataFrame, *, case_columns: Sequence[str], layover: Column | None = None,
    actual: Column | None = None, qs: Sequence[float] = (0.5, 0.75, 0.9), transfer: Transfer = Transfer(),
) -> DataFrame:
    """What ``evaluate_cases`` gives, for cases of selected cohorts: each cohort is one packed row, met once per case."""
    rows = packed_histograms(selected, daily, qs=qs)
    return packed.evaluate(selected, rows, [quantile_name(q) for q in qs], case_columns, layover, actual, transfer)


def with_runs(hist: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Adds the 0-based first and last position of each value, the total and the next value."""
    by_value = W.partitionBy(*keys).orderBy(value)
    to = F.sum("n").over(by_value.rowsBetween(W.unboundedPreceding, W.currentRow))
    return hist.select(
        "*", (to - F.col("n")).alias("first_pos"), (to - 1).alias("last_pos"),
        F.sum("n").over(W.partitionBy(*keys)).alias("total"),
        F.lead(value).over(by_value).alias("next_value"),
    )


def upper_tail(runs: DataFrame, count: Column) -> DataFrame:
    """The top ``count`` values as a histogram (a block may be cut)."""
    cut = F.col("total") - count
    kept = F.col("last_pos") + 1 - F.greatest(F.col("first_pos"), cut)
    return runs.withColumn("n", kept).where("n > 0")


def lower_part(runs: DataFrame, count: Column) -> DataFrame:
    """Everything but the top ``count`` values."""
    kept = F.least(F.col("last_pos") + 1, F.col("total") - count) - F.col("first_pos")
    return runs.withColumn("n", kept).where("n > 0")


def midpoint_quantiles(hist: DataFrame, keys: Sequence[str], k: str, value: str = "value") -> DataFrame:
    """Interpolated quantiles at (i + 0.5) / k for i = 0..k-1, as a histogram.

    ``k`` is a column constant per key. Grid points that fall inside a run of equal values
    are counted in closed form with integer arithmetic; only the points between two runs are
    listed. So the output grows with distinct values, not with k.
    """
    runs = with_runs(hist, keys, value)
    m1, size = F.col("total") - 1, F.col(k)
    # position of point i is m1 * (2i + 1) / (2k); the first i at or after position s:
    numerator = lambda pos: F.lit(2) * size * pos - m1
    lo = F.when(m1 == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), _ceil_div(numerator(F.col("first_pos")), F.lit(2) * m1)))
    hi = F.when(m1 == 0, size - 1).otherwise(F.least(size - 1, _floor_div(numerator(F.col("last_pos")), F.lit(2) * m1)))
    nxt = F.when(F.col("next_value").isNotNull(), F.greatest(F.lit(0), _ceil_div(numerator(F.col("last_pos") + 1), F.lit(2) * m1)))
    marked = runs.select(
        *keys, F.col(value).alias("_v"), "next_value", "last_pos", F.col(k).alias("_k"), m1.alias("_m1"),
        lo.cast("bigint").alias("_lo"), hi.cast("bigint").alias("_hi"), nxt.cast("bigint").alias("_next"),
    )
    inside = marked.where("_hi >= _lo").select(
        *keys, F.col("_v").cast("double").alias(value), (F.col("_hi") - F.col("_lo") + 1).alias("n")
    )
    gap_from = F.greatest(F.col("_hi") + 1, F.lit(0))
    gap_to = F.least(F.col("_next"), F.col("_k")) - 1
    between = marked.where(F.col("next_value").isNotNull() & (gap_to >= gap_from)).select(
        *keys, "_v", "next_value", "last_pos", "_k", "_m1", F.explode(F.sequence(gap_from, gap_to)).alias("_i")
    )
    position = F.col("_m1") * (F.lit(2) * F.col("_i") + 1) / (F.lit(2.0) * F.col("_k"))
    share = position - F.col("last_pos")
    points = between.select(
        *keys, (F.col("_v") + (F.col("next_value") - F.col("_v")) * share).alias(value),
        F.lit(1).cast("bigint").alias("n"),
    )
    return inside.unionByName(points)


def _floor_div(a: Column, b: Column) -> Column:
    """Floor division of integers for positive b, exact for 64 bits."""
    return F.call_function("div", a - F.pmod(a, b), b)


def _ceil_div(a: Column, b: Column) -> Column:
    return -_floor_div(-a, b)
