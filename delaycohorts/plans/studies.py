"""The studies: replay, weighted strata, tail candidates, thresholds, data-set comparison.

Every study is one DataFrame of cases crossed with configuration rows. There are no loops over
cases, windows, thresholds or replicates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaycohorts.functions import buckets, codes
from delaycohorts.functions.transfer import Transfer
from delaycohorts.operators import bootstrap as B
from delaycohorts.operators import cohorts as C
from delaycohorts.operators import connections as X
from delaycohorts.operators import distributions as D
from delaycohorts.operators import metrics as M
from delaycohorts.operators import packed
from delaycohorts.operators import pools as PL
from delaycohorts.operators import sampling as S
from delaycohorts.operators.itineraries import checked_requests, score_checked
from delaycohorts.session import materialize

SEED = 20260811


def _written_union(parts: list[DataFrame]) -> DataFrame:
    return materialize(reduce(DataFrame.unionByName, parts))


@dataclass(frozen=True)
class Holdouts:
    """Test years and the first day of the training data."""

    years: tuple[int, ...] = (2024, 2025)
    train_start: str = "2023-01-01"

    def start(self) -> Column:
        return F.lit(self.train_start).cast("date")

    def cutoff(self) -> Column:
        return F.make_date(F.col("test_year"), F.lit(1), F.lit(1))


def fixed_bounds(cases: DataFrame, holdouts: Holdouts) -> DataFrame:
    """All history from the training start to January 1st of the test year."""
    return C.with_bounds(cases, None, holdouts.start(), holdouts.cutoff())


# ------------------------------------------------------------------ arrivals and connections


def arrival_rows(cases: DataFrame, daily: DataFrame, min_obs: int | Column = 30, qs=(0.5, 0.75, 0.9)) -> DataFrame:
    """Bounded cases with the chosen level, quantiles and CRPS."""
    selected = C.select_cohorts(cases, daily, min_obs)
    keep = [*cases.columns, "n_route_carrier", "cohort_level", "cohort_size"]
    return D.evaluate_cohorts(selected, daily, case_columns=keep, actual=F.col("actual"), qs=qs)


def connection_rows(
    cases: DataFrame, daily: DataFrame, records: DataFrame, seed: int, default: str,
    min_obs: int = 30, transfer: Transfer = Transfer(),
) -> DataFrame:
    """Bounded cases (with status) to conditional, combined probability and replayed outcome."""
    routed = materialize(X.connection_options(cases, records, seed, default))
    selected = C.select_cohorts(routed, daily, min_obs)
    scored = D.evaluate_cohorts(
        selected, daily, case_columns=[*routed.columns, "cohort_level", "cohort_size"],
        layover=F.col("layover_minutes"), transfer=transfer,
    ).withColumnRenamed("probability", "conditional_probability")
    shares = C.status_probabilities(cases, records, min_obs).select(
        "case_id", "test_year", "status_level", "completion_probability", "cancellation_probability", "diversion_probability"
    )
    outcome = X.replay_outcome(
        F.col("status") == "completed", F.col("actual"), F.col("layover_minutes"),
        codes.uniform01(F.col("case_id"), str(seed)), transfer,
    )
    return scored.join(shares, ["case_id", "test_year"]).select(
        "*", (F.col("completion_probability") * F.col("conditional_probability")).alias("combined_probability"),
        outcome.alias("outcome"),
    )


# ------------------------------------------------------------------ temporal replay


def replay_configs(windows: Sequence[int | None] = (6, 12, 24, None), thresholds: Sequence[int] = (10, 30, 60)) -> Column:
    """Configuration rows: every window at 30 rows, every threshold on the fixed period."""
    rows = [(f"{w}_months" if w else "fixed_training_period", w, 30) for w in windows]
    rows += [(f"threshold_{t}", None, t) for t in thresholds]
    return F.explode(F.array(*[
        F.struct(F.lit(name).alias("config"), F.lit(w).cast("int").alias("lookback"), F.lit(n).alias("min_obs"))
        for name, w, n in rows
    ])).alias("_c")


def replay_arrivals(cases: DataFrame, daily: DataFrame, holdouts: Holdouts, windows=(6, 12, 24, None), thresholds=(10, 30, 60)) -> DataFrame:
    crossed = cases.select("*", replay_configs(windows, thresholds)).select(*cases.columns, "_c.*")
    end = F.when(F.col("lookback").isNull(), holdouts.cutoff())
    bounded = materialize(C.with_bounds(crossed, F.col("lookback"), holdouts.start(), end))
    rows = arrival_rows(bounded, daily, F.col("min_obs"))
    return rows.withColumn("route_volume_group", buckets.route_volume_group(F.col("n_route_carrier"))).withColumn(
        "month", F.month("prediction_date")
    )


def temporal_replay(
    history: DataFrame, records: DataFrame, holdouts: Holdouts, cases_per_split: int = 50, seed: int = 20260810,
    windows=(6, 12, 24, None), thresholds=(10, 30, 60),
) -> dict[str, DataFrame]:
    """Arrival metrics, level usage, connection calibration and status means per holdout year."""
    daily = materialize(C.daily_delay_counts(history))
    sample = materialize(S.sample_cases(S.replay_cases(history, holdouts.years), cases_per_split, seed, holdouts.years))
    rows = materialize(replay_arrivals(sample, daily, holdouts, windows, thresholds))
    base = ("test_year", "config")
    offers = materialize(S.sample_cases(S.replay_cases(records, holdouts.years), cases_per_split, seed + 1, holdouts.years))
    connections = materialize(connection_rows(fixed_bounds(offers, holdouts), daily, records, seed, "hashed"))
    probability = connections.withColumn("probability", F.col("combined_probability"))
    status = connections.groupBy("test_year").agg(
        F.avg("conditional_probability").alias("mean_conditional_probability"),
        F.avg("combined_probability").alias("mean_combined_probability"),
        F.avg("cancellation_probability").alias("mean_prior_cancellation_probability"),
        F.avg("diversion_probability").alias("mean_prior_diversion_probability"),
    )
    return {
        "arrivals": M.metrics_by(rows, ("carrier", "route_volume_group", "month"), M.arrival_metrics(), base),
        "usage": M.usage(rows, dims=base),
        "connections": M.connection_metrics(probability, ("test_year",)),
        "bins": M.calibration_bins(probability, ("test_year",)),
        "status": status,
    }


def tail_sensitivity(history: DataFrame, layovers: Sequence[int] = (45, 85, 120), transfer: Transfer = Transfer()) -> DataFrame:
    """Median, p75, p90 and connection probabilities before and after clipping the extremes.

    Works on the histogram of distinct delays, which stays small at any scale.
    """
    counts = history.groupBy(F.col("arrival_delay_minutes").alias("delay")).agg(F.count("*").alias("n"))
    bounds = counts.agg(F.percentile("delay", F.array(F.lit(0.001), F.lit(0.999)), F.col("n"))).scalar()
    both = counts.withColumn("b", bounds)
    raw = both.select(F.lit("all_retained").alias("treatment"), "delay", "n")
    cut = both.select(F.lit("winsorized_0.1_99.9").alias("treatment"), buckets.winsorize(F.col("delay"), F.col("b")[0], F.col("b")[1]).alias("delay"), "n")
    rows = raw.unionByName(cut)
    q = F.percentile("delay", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)), F.col("n"))
    chances = [
        (F.sum(F.col("n") * transfer.success(F.lit(m), F.col("delay"))) / F.sum("n")).alias(f"probability_{m}")
        for m in layovers
    ]
    return rows.groupBy("treatment").agg(q.alias("q"), *chances).select(
        "treatment", F.col("q")[0].alias("median"), F.col("q")[1].alias("p75"), F.col("q")[2].alias("p90"),
        *[f"probability_{m}" for m in layovers],
    )


# ------------------------------------------------------------------ stratified study


def stratified_study(
    history: DataFrame, records: DataFrame, holdouts: Holdouts, delay_cases: int = 500,
    connection_cases: int = 300, replicates: int = 500, seed: int = SEED,
) -> dict[str, DataFrame]:
    """Weighted metrics of two history strategies, intervals and the worst cases."""
    daily = materialize(C.daily_delay_counts(history))
    return stratified_arrivals(history, daily, holdouts, delay_cases, replicates, seed) | stratified_connections(
        history, records, daily, holdouts, connection_cases, replicates, seed
    )


def stratified_arrivals(
    history: DataFrame, daily: DataFrame, holdouts: Holdouts, delay_cases: int, replicates: int, seed: int, ties: bool = False,
) -> dict[str, DataFrame]:
    weight = F.col("weight")
    population = materialize(S.with_strata(S.replay_cases(history, holdouts.years), history))
    sample = materialize(S.stratified_sample(population, delay_cases, seed))
    rolling = C.with_bounds(sample.withColumn("strategy", F.lit("previous_24_months")), 24, holdouts.start())
    fixed = fixed_bounds(sample.withColumn("strategy", F.lit("all_prior_fixed_training")), holdouts)
    rows = materialize(arrival_rows(_written_union([rolling, fixed]), daily).select(
        "*", F.month("prediction_date").alias("month"), (F.col("actual") - F.col("p90")).alias("p90_error")
    ))
    rows = M.exact_ties(rows, ("p50", "p75", "p90")) if ties else rows
    base = ("test_year", "strategy")
    dims = ("carrier", "route_volume_group", "season", "month", "time_bucket", "severity", "cohort_level")
    covered = {"covered": M.covered(F.col("actual"), F.col("p90")) * weight, "w": weight}
    return {
        "sample": sample,
        "arrivals": M.metrics_by(rows, dims, M.arrival_metrics(weight), base),
        "usage": M.usage(rows, dims=base),
        "worst": S.top_n_per_group(rows, base, F.struct((-F.col("p90_error")).alias("e"), "case_id"), 20),
        "coverage_interval": intervals(rows, base, ["case_id"], covered, F.col("covered") / F.col("w"), replicates, seed, "p90_coverage"),
    }


def stratified_connections(
    history: DataFrame, records: DataFrame, daily: DataFrame, holdouts: Holdouts, connection_cases: int,
    replicates: int, seed: int, ties: bool = False,
) -> dict[str, DataFrame]:
    weight = F.col("weight")
    offers = materialize(S.with_strata(S.replay_cases(records, holdouts.years), history, by_status=True))
    chosen = materialize(S.stratified_sample(offers, connection_cases, seed + 100))
    connections = materialize(connection_rows(fixed_bounds(chosen, holdouts), daily, records, seed, "constant").select(
        "*", buckets.layover_bucket(F.col("layover_minutes")).alias("layover_bucket"), F.month("prediction_date").alias("month")
    ))
    connections = M.exact_ties(connections, ("combined_probability", "conditional_probability")) if ties else connections
    combined = connections.withColumn("probability", F.col("combined_probability"))
    conditional = connections.withColumn("probability", F.col("conditional_probability"))
    both = combined.withColumn("kind", F.lit("combined")).unionByName(conditional.withColumn("kind", F.lit("conditional")))
    by_dimension = M.long_dimensions(
        combined, ("carrier", "route_volume_group", "layover_bucket", "season", "month"), ("test_year", "probability", "outcome", "weight")
    )
    keys = ("test_year", "dimension", "value")
    return {
        "connections": M.connection_metrics(both, ("test_year", "kind"), weight),
        "bins": M.calibration_bins(both, ("test_year", "kind"), weight),
        "subgroups": M.connection_metrics(by_dimension, keys, weight).where("sample_count >= 5"),
        "connection_intervals": connection_intervals(both, ("test_year", "kind"), ["case_id"], replicates, seed + 1),
        "overconfident": error_cases(combined, 0.0),
        "underconfident": error_cases(combined, 1.0),
    }


def error_cases(rows: DataFrame, outcome: float, n: int = 20) -> DataFrame:
    """Most confident failures (outcome 0) or least confident successes (outcome 1) per year."""
    p = F.col("probability")
    order = F.struct((-p if outcome == 0 else p).alias("p"), "case_id")
    return S.top_n_per_group(rows.where(F.col("outcome") == outcome), ("test_year",), order, n)


def worst_tail_cases(rows: DataFrame, n: int = 20) -> DataFrame:
    """Largest miss above the 90th percentile."""
    return rows.withColumn("p90_error", F.col("actual") - F.col("p90")).orderBy(F.desc("p90_error"), "case_id").limit(n)


def intervals(
    rows: DataFrame, base: Sequence[str], unit: Sequence[str], sums: dict[str, Column], metric: Column,
    replicates: int, seed: int, name: str,
) -> DataFrame:
    """Bootstrap interval per base group: units are numbered and drawn inside their group."""
    units = B.unit_sums(rows, [*base, *unit], sums)
    estimates = B.grouped_replicate_sums(units, base, unit, list(sums), replicates, seed)
    q = F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975)))
    return estimates.select(*base, metric.alias("_m")).groupBy(*base).agg(
        F.count("*").cast("bigint").alias("replicates"), q.alias("_q")
    ).select(*base, F.lit(name).alias("metric"), "replicates", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"))


def connection_intervals(rows: DataFrame, base: Sequence[str], unit: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Brier, calibration-error and gap intervals from one set of draws."""
    p, y, w = F.col("probability"), F.col("outcome"), F.col("weight")
    sums = B.bin_sums(p, y, w) | {"wb": M.brier(p, y) * w, "gap": (p - y) * w}
    units = B.unit_sums(rows, [*base, *unit], sums)
    estimates = B.grouped_replicate_sums(units, base, unit, list(sums), replicates, seed)
    metrics = {
        "brier_score": F.col("wb") / F.col("w"), "ece": B.calibration_error_of_sums(), "mean_calibration_gap": F.col("gap") / F.col("w"),
    }
    long = estimates.select(*base, F.explode(F.array(*[
        F.struct(F.lit(k).alias("metric"), v.alias("m")) for k, v in metrics.items()
    ])).alias("_e")).select(*base, "_e.metric", "_e.m")
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return long.groupBy(*base, "metric").agg(F.count("*").cast("bigint").alias("replicates"), q.alias("_q")).select(
        *base, "metric", "replicates", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper")
    )


# ------------------------------------------------------------------ tail candidates


def tail_pool(
    center: DataFrame, source: DataFrame, keys: Sequence[str], fraction: float = 0.2,
    min_center: int | None = 100, min_source: int = 100,
) -> DataFrame:
    """Top ``fraction`` of the center replaced by midpoint quantiles of the source's top part.

    Both inputs are histograms (keys, value, n). Unchanged where the center tail is large
    enough (``min_center``; None means never), the source tail too small, or the center tail
    empty.
    """
    size = lambda df, name: df.groupBy(*keys).agg(F.floor(F.sum("n") * fraction).cast("bigint").alias(name))
    plan = size(center, "kc").join(size(source, "ks"), list(keys), "left").withColumn("ks", F.coalesce("ks", F.lit(0)))
    use = (F.col("ks") >= min_source) & (F.col("kc") > 0)
    if min_center is not None:
        use = use & (F.col("kc") < min_center)
    plan = plan.withColumn("use", use)
    placed = D.with_runs(center, keys).join(plan, list(keys))
    kept = D.lower_part(placed, F.when(F.col("use"), F.col("kc")).otherwise(0)).select(*keys, "value", "n")
    tail = D.upper_tail(D.with_runs(source, keys).join(plan.where("use"), list(keys)), F.col("ks"))
    added = D.midpoint_quantiles(tail.select(*keys, "value", "n", "kc"), keys, "kc").select(*keys, "value", "n")
    return kept.unionByName(added).groupBy(*keys, "value").agg(F.sum("n").alias("n"))


# Name, source, largest center tail (None: any), smallest source tail.
POOLS = (
    ("hierarchical_tail_pooling", "_season", 100, 100), ("recent_tail_augmentation", "_recent", None, 30),
    ("tail_aware_carrier_month_bucket", "_bucket", 100, 100),
)
TAIL_QS = (("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95))


def tail_candidates(cases: DataFrame, daily: DataFrame, holdouts: Holdouts) -> tuple[DataFrame, DataFrame]:
    """A row per case and candidate with the key of the cohort or pool it reads, and these as packed rows."""
    cases, qs = materialize(cases), [q for _, q in TAIL_QS]
    windows = cases.select("*", F.explode(F.array(F.lit(24), F.lit(6))).alias("lookback"))
    chosen = C.select_cohorts(C.with_bounds(windows, F.col("lookback"), holdouts.start()), daily)
    base, near = chosen.where("lookback = 24"), chosen.where("lookback = 6")
    cohort = F.struct(*PL.COHORT)
    at = lambda level: F.struct(*[C.case_key(level)[k].alias(k) for k in C.KEY], *C.BOUNDS)
    recent = near.select("case_id", F.col("cohort_level").alias("recent_level"), cohort.alias("_recent"))
    met = materialize(base.where("k_text is not null").select(
        *cases.columns, *C.BOUNDS, "cohort_level", "cohort_size", cohort.alias("_center"),
        at("route_carrier_season").alias("_season"), at(C.CARRIER_MONTH_BUCKET).alias("_bucket"),
    ).join(recent, "case_id"))
    requests = met.select(F.explode(F.array("_center", "_season", "_bucket", "_recent")).alias("_k")).select("_k.*")
    cohorts = C.packed_histograms(requests, daily, (*C.LEVELS, C.CARRIER_MONTH_BUCKET), qs)
    severe = F.aggregate(F.zip_with("delays", "counts", lambda v, n: F.when(v > 30, n).otherwise(0)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    share = cohorts.select(cohort.alias("_recent"), (severe / F.col("cohort_n")).alias("recent_severe_share"))
    met = materialize(met.join(share, "_recent", "left"))
    pooled = F.explode(F.array(*[
        F.struct(F.lit(name).alias("candidate"), F.col(source).alias("source"), F.lit(most).cast("int").alias("min_center"), F.lit(least).alias("min_source"))
        for name, source, most, least in POOLS
    ])).alias("_c")
    asked = met.select("*", pooled).select(*met.columns, "_c.*")
    used, pools = PL.pool_tails(asked.select("candidate", F.col("_center").alias("center"), "source", "min_center", "min_source"), cohorts, qs)
    keep = [c for c in met.columns if c not in ("_recent", "_season", "_bucket", *C.BOUNDS)]
    keyed = asked.select(*keep, "candidate", *PL.pool_key(F.col("_center"), F.col("source")))
    found = keyed.join(used.withColumn("_used", F.lit(True)), ["candidate", *PL.COHORT], "left")
    resolved = [F.when(F.col("_used"), F.col(k)).otherwise(F.col("_center")[k]).alias(k) for k in PL.COHORT]
    plain = met.select(*keep, F.lit("baseline").alias("candidate"), "_center.*")
    rows = plain.unionByName(found.select(*keep, "candidate", *resolved)).drop("_center")
    level = F.when(F.col("candidate") == "recent_tail_augmentation", F.concat_ws("+recent_", "cohort_level", "recent_level"))
    return rows.withColumn("cohort_label", F.coalesce(level, F.col("cohort_level"))), cohorts.unionByName(pools)


def tail_arrivals(cases: DataFrame, daily: DataFrame, holdouts: Holdouts) -> DataFrame:
    """Quantiles and CRPS per case and candidate, with the labels the study groups by."""
    rows, cohorts = tail_candidates(cases, daily, holdouts)
    keep = [*cases.columns, "candidate", F.col("cohort_label").alias("cohort_level"), "cohort_size", "recent_severe_share"]
    out = packed.evaluate(rows, cohorts, [name for name, _ in TAIL_QS], keep, actual=F.col("actual"))
    return out.select(
        "*", buckets.cohort_size_bucket(F.col("cohort_size")).alias("cohort_size_bucket"),
        buckets.severe_freq_bucket(F.col("recent_severe_share")).alias("recent_severe_frequency_bucket"),
        F.month("prediction_date").alias("month"),
    )


def tail_experiment(
    history: DataFrame, records: DataFrame, holdouts: Holdouts, arrival_cases: int = 2000,
    connection_cases: int = 1000, replicates: int = 300, seed: int = SEED, transfer: Transfer = Transfer(),
) -> dict[str, DataFrame]:
    """Four candidates: arrival and connection metrics with route-by-month cluster intervals."""
    daily = materialize(C.daily_delay_counts(history))
    return tail_experiment_arrivals(history, daily, holdouts, arrival_cases, replicates, seed) | tail_experiment_connections(
        history, records, daily, holdouts, connection_cases, replicates, seed, transfer
    )


CLUSTER = ("cluster_route", "cluster_month")


def tail_experiment_arrivals(
    history: DataFrame, daily: DataFrame, holdouts: Holdouts, arrival_cases: int, replicates: int, seed: int,
) -> dict[str, DataFrame]:
    w, base = F.col("weight"), ("test_year", "candidate")
    strata = materialize(S.with_strata(S.replay_cases(history, holdouts.years), history))
    sample = materialize(S.stratified_sample(strata, arrival_cases, seed))
    rows = materialize(B.cluster_columns(tail_arrivals(sample, daily, holdouts)))
    dims = ("carrier", "month", "season", "time_bucket", "route_volume_group", "cohort_level", "cohort_size_bucket", "recent_severe_frequency_bucket")
    coverage = {"covered": M.covered(F.col("actual"), F.col("p90")) * w, "w": w}
    crps = {"wc": F.col("crps") * w, "w": w}
    return {
        "arrivals": M.metrics_by(rows, dims, M.arrival_metrics(w, TAIL_QS), base),
        "coverage_interval": intervals(rows, base, CLUSTER, coverage, F.col("covered") / F.col("w"), replicates, seed, "p90_coverage"),
        "crps_interval": intervals(rows, base, CLUSTER, crps, F.col("wc") / F.col("w"), replicates, seed + 1, "crps"),
    }


def tail_experiment_connections(
    history: DataFrame, records: DataFrame, daily: DataFrame, holdouts: Holdouts, connection_cases: int,
    replicates: int, seed: int, transfer: Transfer = Transfer(), ties: bool = False,
) -> dict[str, DataFrame]:
    w, base = F.col("weight"), ("test_year", "candidate")
    strata = materialize(S.with_strata(S.replay_cases(records, holdouts.years), history, by_status=True))
    offers = materialize(S.stratified_sample(strata, connection_cases, seed + 100))
    routed = materialize(X.connection_options(offers, records, seed, "constant"))
    rows, cohorts = tail_candidates(routed, daily, holdouts)
    scored = packed.evaluate(
        rows, cohorts, [name for name, _ in TAIL_QS], [*routed.columns, "candidate"], layover=F.col("layover_minutes"), transfer=transfer,
    )
    outcome = X.replay_outcome(F.col("status") == "completed", F.col("actual"), F.col("layover_minutes"), codes.uniform01(F.col("case_id"), str(seed)), transfer)
    connections = materialize(B.cluster_columns(scored.select("*", outcome.alias("outcome"), buckets.layover_class(F.col("layover_minutes")).alias("layover_class"))))
    connections = M.exact_ties(connections, ("probability",)) if ties else connections
    by_dimension = M.long_dimensions(connections, ("carrier", "layover_class", "time_bucket", "season", "status"), (*base, "probability", "outcome", "weight"))
    return {
        "connections": M.connection_metrics(connections, base, w),
        "bins": M.calibration_bins(connections, base, w),
        "subgroups": M.connection_metrics(by_dimension, (*base, "dimension", "value"), w),
        "connection_intervals": connection_intervals(connections, base, CLUSTER, replicates, seed + 1),
    }


def level_of(key_text: Column) -> Column:
    return F.substring_index(key_text, "|", 1)


def candidate_parity(
    cases: DataFrame, daily: DataFrame, qs=(0.5, 0.75, 0.9, 0.95), min_obs: int = 30, eager_minimums: Sequence[int] = (30,),
) -> DataFrame:
    """Counts-first choice against the path that fetches every level, one row per minimum of the latter.

    With equal minimums both must agree exactly; another one shows what a disagreement looks like.
    The levels are fetched once per case profile; every case reads the candidates of its profile.
    """
    lazy_sel = C.select_cohorts(cases, daily, min_obs)
    lazy = D.evaluate_cohorts(lazy_sel, daily, case_columns=["case_id", "cohort_level"], qs=qs)
    links, heads = C.profiles(cases, C.LEVELS)
    requests = materialize(C.level_requests(heads).select(*C.PROFILE, "level_index", *C.KEY, *C.BOUNDS))
    members = C.member_histograms(requests, daily)
    sized = D.quantiles(members, [*C.KEY, *C.BOUNDS], qs)
    names = [D.quantile_name(q) for q in qs]
    candidate = F.struct("level_index", level_of(F.col("k_text")).alias("level"), *names)
    enough = lambda m: (F.col("cohort_n") >= m) | (F.col("level_index") == len(C.LEVELS) - 1)
    of = {m: f"a_{m}" for m in eager_minimums}
    best = requests.join(sized, [*C.KEY, *C.BOUNDS]).groupBy(*C.PROFILE).agg(*[F.min(F.when(enough(m), candidate)).alias(a) for m, a in of.items()])
    eager = links.join(best, [*C.PROFILE]).groupBy("case_id").agg(*[F.min(a).alias(a) for a in of.values()])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("eager_minimum"), F.col(a).alias("a")) for m, a in of.items()])).alias("_e")
    both = lazy.withColumn("_lazy", F.lit(True)).join(eager, "case_id", "full_outer").select("_lazy", "cohort_level", *names, each).select(
        "_lazy", "cohort_level", *names, "_e.*"
    ).where(F.col("_lazy") | F.col("a").isNotNull())
    gap = F.greatest(*[F.abs(F.col(n) - F.col(f"a.{n}")) for n in names])
    return both.groupBy("eager_minimum").agg(
        F.count("*").cast("bigint").alias("sample_count"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("maximum_quantile_difference"),
        F.count_if(~F.col("cohort_level").eqNullSafe(F.col("a.level"))).cast("bigint").alias("level_mismatches"),
    )


# ------------------------------------------------------------------ threshold study


def blend_cohorts(
    counted: DataFrame, daily: DataFrame, boundary: int = 60, size: int = 2000, min_obs: int = 30
) -> tuple[DataFrame, DataFrame]:
    """Exact cohort mixed with the first eligible broader one by n / boundary.

    Returns the histograms (case_id, value, n) and the cases with ``blend_label`` and weight.
    """
    n = F.col("n_exact")
    whole = C.at_level(counted.where(n >= boundary), "exact")
    empty = C.choose_level(counted.where(n == 0), min_obs)
    mixed = counted.where((n > 0) & (n < boundary))
    narrow, broad = C.at_level(mixed, "exact"), C.choose_level(mixed, min_obs, above=0)
    weight = n / boundary
    specific = F.bround(F.lit(float(size)) * weight).cast("bigint")
    role = lambda df, name, k: df.where("k_text is not null").select("case_id", F.lit(name).alias("role"), k.alias("k"), *C.KEY, *C.BOUNDS)
    wanted = _written_union([
        role(whole, "plain", F.lit(None).cast("bigint")), role(empty, "plain", F.lit(None).cast("bigint")),
        role(narrow, "narrow", specific), role(broad, "broad", F.lit(size) - specific),
    ])
    members = C.member_histograms(wanted, daily)
    hist = materialize(wanted.join(members, [*C.KEY, *C.BOUNDS]).select("case_id", "role", "k", F.col("delay").alias("value"), "n"))
    plain = hist.where("role = 'plain'").select("case_id", F.col("value").cast("double").alias("value"), "n")
    grid = D.midpoint_quantiles(hist.where("role <> 'plain' and k > 0"), ["case_id", "role"], "k").select("case_id", "value", "n")
    out = materialize(plain.unionByName(grid).groupBy("case_id", "value").agg(F.sum("n").alias("n")))
    label = lambda df, text: df.select(*counted.columns, text.alias("blend_label"), F.least(weight, F.lit(1.0)).alias("specific_weight"))
    rows = reduce(DataFrame.unionByName, [
        label(whole, F.lit("blend_exact_100pct")), label(empty, F.concat(F.lit("blend_"), "cohort_level")),
        label(broad, F.format_string("blend_exact_%.3f_%s", weight, F.col("cohort_level"))),
    ])
    return out, rows


def boundary_rows(
    history: DataFrame, records: DataFrame, holdouts: Holdouts, per_count: int = 15, seed: int = SEED,
    transfer: Transfer = Transfer(), targets: Sequence[int] = S.TARGET_COUNTS,
) -> DataFrame:
    """Probability under the exact, the chosen and the next broader cohort near the threshold."""
    daily = materialize(C.daily_delay_counts(history))
    cases = S.near_threshold_cases(history, holdouts.years, holdouts.train_start, per_count, seed, targets)
    routed = materialize(X.connection_options(fixed_bounds(cases, holdouts), records, seed, "hashed"))
    counted = materialize(C.cohort_counts(routed, daily))
    roles = {"specific": C.at_level(counted, "exact"), "production": C.choose_level(counted, 30), "broader": C.next_broader(counted)}
    wanted = _written_union([
        df.where("k_text is not null").select("case_id", "layover_minutes", F.lit(name).alias("role"), "cohort_level", "cohort_size", *C.KEY, *C.BOUNDS)
        for name, df in roles.items()
    ])
    scored = D.evaluate_cohorts(
        wanted, daily, case_columns=["case_id", "layover_minutes", "role", "cohort_level", "cohort_size"],
        layover=F.col("layover_minutes"), transfer=transfer,
    )
    at = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    wide = scored.groupBy("case_id").agg(
        *[at(r, c).alias(f"{r}_{n}") for r in roles for c, n in (
            ("cohort_level", "level"), ("cohort_size", "n"), ("p50", "median"), ("p75", "p75"), ("p90", "p90"), ("probability", "probability"))]
    ).drop("specific_level")
    points = lambda a, b: F.abs(F.col(f"{a}_probability") - F.col(f"{b}_probability")) * 100
    joined = routed.select("case_id", "test_year", "carrier", "origin", "destination", "prediction_date", "layover_minutes").join(wide, "case_id")
    return joined.select(
        "*", points("specific", "production").alias("production_displacement_pp"),
        points("specific", "broader").alias("boundary_contrast_pp"),
    )


def boundary_summary(rows: DataFrame) -> DataFrame:
    """One row of displacement and contrast statistics."""
    d, c = F.col("production_displacement_pp"), F.col("boundary_contrast_pp")
    below = F.when(F.col("specific_n") < 30, d)
    q = lambda value, p: F.percentile(value, F.lit(p))
    return rows.agg(
        F.count("*").cast("bigint").alias("case_count"),
        q(d, 0.5).alias("displacement_median"), q(d, 0.9).alias("displacement_p90"), q(d, 0.95).alias("displacement_p95"),
        F.max(d).alias("displacement_maximum"),
        F.count_if(d >= 5).cast("bigint").alias("at_least_5pp"), F.count_if(d >= 10).cast("bigint").alias("at_least_10pp"),
        F.count(below).cast("bigint").alias("below_30_cases"), q(below, 0.5).alias("below_30_median"),
        q(below, 0.95).alias("below_30_p95"), F.max(below).alias("below_30_maximum"),
        q(c, 0.5).alias("contrast_median"), q(c, 0.95).alias("contrast_p95"), F.max(c).alias("contrast_maximum"),
    )


def material_jump_carriers(rows: DataFrame, points: float = 10.0) -> DataFrame:
    return rows.where(F.col("production_displacement_pp") >= points).groupBy("carrier").agg(F.count("*").cast("bigint").alias("cases"))


def worst_jumps(rows: DataFrame, n: int = 15) -> DataFrame:
    return rows.orderBy(F.desc("production_displacement_pp"), "case_id").limit(n)


def threshold_study(
    history: DataFrame, records: DataFrame, holdouts: Holdouts, cases_per_year: int = 150,
    thresholds: Sequence[int] = (20, 30, 40, 60), seed: int = SEED, transfer: Transfer = Transfer(),
) -> DataFrame:
    """Minimum sizes and the blend on the same cases, layovers and outcomes."""
    daily = materialize(C.daily_delay_counts(history))
    sample = S.sample_cases(S.replay_cases(history, holdouts.years), cases_per_year, seed, holdouts.years)
    routed = materialize(X.connection_options(fixed_bounds(sample, holdouts), records, seed, "hashed"))
    counted = materialize(C.cohort_counts(routed, daily))
    crossed = counted.select("*", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    hard = materialize(C.choose_level(crossed, F.col("threshold")).withColumn("method", F.format_string("hard_n%d", "threshold")))
    keep = ["case_id", "test_year", "method", "cohort_level", "specific_weight", "actual", "status", "layover_minutes"]
    hard = hard.withColumn("specific_weight", F.lit(None).cast("double"))
    rows_hard = D.evaluate_cohorts(hard, daily, case_columns=keep, layover=F.col("layover_minutes"), actual=F.col("actual"), transfer=transfer)
    hist, blended = blend_cohorts(counted, daily)
    blended = blended.withColumn("method", F.lit("research_blend_n_over_60")).withColumn("cohort_level", F.col("blend_label"))
    rows_blend = D.evaluate_cases(blended, hist, case_columns=keep, layover=F.col("layover_minutes"), actual=F.col("actual"), transfer=transfer, value="value", keys=("case_id",))
    outcome = X.replay_outcome(F.lit(True), F.col("actual"), F.col("layover_minutes"), codes.uniform01(F.col("case_id"), str(seed)), transfer)
    rows = rows_hard.unionByName(rows_blend).withColumn("outcome", outcome)
    base = ["test_year", "method"]
    index = F.expr("case " + " ".join(f"when cohort_level = '{lv}' then {i}" for i, lv in enumerate(C.LEVELS)) + " end")
    arrivals = rows.groupBy(*base).agg(*M.arrival_metrics(), F.avg(index).alias("mean_cohort_level_index"), F.avg("specific_weight").alias("mean_specific_weight"))
    connections = M.connection_metrics(rows, base).drop("sample_count")
    return arrivals.join(connections, base)


# ------------------------------------------------------------------ comparisons and sanity


def compare_datasets(a: DataFrame, b: DataFrame, requests: DataFrame, airports: DataFrame, **options) -> DataFrame:
    """The same estimator on two histories: largest differences and mismatches in one row. Requests are checked once."""
    numbers = ("probability", "on_time", "delay_15", "delay_30", "delay_45", "median_minutes", "p75_minutes", "p90_minutes")
    checked = checked_requests(requests, airports, **{k: v for k, v in options.items() if k == "transfer"})
    pick = lambda df, p: score_checked(checked, df, **options).select(
        "request_id", *[F.col(c).alias(f"{p}_{c}") for c in (*numbers, "cohort_level", "cohort_size", "status")]
    )
    both = pick(a, "a").join(pick(b, "b"), "request_id", "full_outer")
    gap = lambda c: F.coalesce(F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))), F.lit(0.0))
    differs = lambda c: F.count_if(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).cast("bigint")
    out = both.agg(
        F.count("*").cast("bigint").alias("cases"),
        F.greatest(*[gap(c) for c in numbers[:5]]).alias("maximum_probability_difference"),
        gap("median_minutes").alias("maximum_p50_difference"), gap("p75_minutes").alias("maximum_p75_difference"),
        gap("p90_minutes").alias("maximum_p90_difference"),
        differs("cohort_level").alias("cohort_mismatches"), differs("cohort_size").alias("sample_size_mismatches"),
        differs("status").alias("status_mismatches"),
    )
    zero = reduce(lambda x, y: x & y, [F.col(c) == 0 for c in out.columns if c != "cases"])
    return out.withColumn("exact_match", zero)


LAYOVERS = (20, 25, 30, 45, 60, 75, 90, 120)


def layover_curve(selected: DataFrame, members: DataFrame, layovers: Sequence[int] = LAYOVERS, transfer: Transfer = Transfer()) -> DataFrame:
    """Per distinct cohort: early shares and the probability at every layover."""
    keys = [*C.KEY, *C.BOUNDS]
    share = lambda limit: (F.sum(F.when(F.col("delay") <= limit, F.col("n")).otherwise(0)) / F.sum("n"))
    chances = [
        (F.sum(F.col("n") * transfer.success(F.lit(m), F.col("delay"))) / F.sum("n")).alias(f"probability_{m}") for m in layovers
    ]
    cohorts = members.groupBy(*keys).agg(
        *[share(-m).alias(f"early_{m}") for m in (5, 10, 15)], F.sum("n").cast("bigint").alias("cohort_n"), *chances
    )
    return selected.where("k_text is not null").groupBy(*keys).agg(F.count("*").cast("bigint").alias("cases")).join(cohorts, keys)


def sanity_report(curve: DataFrame, layovers: Sequence[int] = LAYOVERS) -> DataFrame:
    """Per level: mean curve, early shares and how often a longer layover lowers the chance."""
    steps = list(zip(layovers, layovers[1:]))
    falls = reduce(lambda a, b: a + b, [
        (F.col(f"probability_{b}") < F.col(f"probability_{a}") - 1e-12).cast("int") for a, b in steps
    ])
    return curve.groupBy(level_of(F.col("k_text")).alias("cohort_level")).agg(
        F.count("*").cast("bigint").alias("cohorts"), F.sum("cases").cast("bigint").alias("cases"),
        F.sum(falls).cast("bigint").alias("violations"),
        *[F.avg(f"early_{m}").alias(f"mean_early_{m}") for m in (5, 10, 15)],
        *[F.avg(f"probability_{m}").alias(f"mean_probability_{m}") for m in layovers],
    )


def scenario_order_violations(layovers: DataFrame, transfer: Transfer = Transfer()) -> DataFrame:
    """A later first arrival must never raise the chance, at any layover of the column."""
    d = F.col("layover_minutes")
    p = [transfer.success(d, F.lit(float(x))) for x in (0, 15, 30, 45)]
    bad = (p[0] < p[1]) | (p[1] < p[2]) | (p[2] < p[3])
    return layovers.agg(F.count("*").cast("bigint").alias("rows"), F.count_if(bad).cast("bigint").alias("violations"))
