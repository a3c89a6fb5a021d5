"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from delaycohorts.functions import buckets, clock, codes
from delaycohorts.functions.transfer import scenario_columns, transfer_quantile_columns
from delaycohorts.operators import bootstrap as B
from delaycohorts.operators import cleaning as CL
from delaycohorts.operators import cohorts as C
from delaycohorts.operators import connections as X
from delaycohorts.operators import distributions as D
from delaycohorts.operators import itineraries as I
from delaycohorts.operators import lookup as L
from delaycohorts.operators import metrics as M
from delaycohorts.operators import payloads as P
from delaycohorts.operators import sampling as S
from delaycohorts.operators import schedules as H
from delaycohorts.operators import stability as T
from delaycohorts.operators.topn import exact_sample as exact_rows
from delaycohorts.plans import studies as ST
from delaycohorts.schema import DOMESTIC_COUNTRIES
from delaycohorts.session import materialize, work_folder
from delaycohorts.sources import archives as AR
from delaycohorts.sources import driver_payloads as dp
from delaycohorts.sources import driver_tables as dt
from delaycohorts.sources import files
from delaycohorts.streaming import bounded as BS

Query = Callable[[SparkSession, str], DataFrame]
HOLDOUTS = ST.Holdouts((1999, 2000), "1995-01-01")
SEED = 20260811
HISTORY_KEY = ("flight_date", "reporting_carrier", "origin", "destination", "departure_time_bucket")
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of a sum cannot show."""
    doubles = {name for name, kind in df.dtypes if kind == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ shared inputs


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return dt.raw_rows(spark, sf)


def _raw_wide(spark: SparkSession, sf: str) -> DataFrame:
    return dt.raw_wide_rows(spark, sf)


def _payload_log(spark: SparkSession, sf: str) -> DataFrame:
    return dp.payload_log(spark, sf)


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return CL.refresh_history(dt.flights(spark, sf))


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(C.daily_delay_counts(_history(spark, sf)))


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(C.with_bounds(dt.cases(spark, sf)))


def _selected(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    daily = _daily(spark, sf)
    return C.select_cohorts(_cases(spark, sf), daily), daily


def _schedule(spark: SparkSession, sf: str) -> DataFrame:
    return CL.exact_schedule(dt.flights(spark, sf))


def _replay(spark: SparkSession, sf: str) -> DataFrame:
    """Every flight of the holdout years with quantiles and CRPS from the fixed history."""
    history = materialize(_history(spark, sf))
    daily = materialize(C.daily_delay_counts(history))
    cases = materialize(ST.fixed_bounds(S.replay_cases(history, HOLDOUTS.years), HOLDOUTS))
    return ST.arrival_rows(cases, daily)


def _one_per_flight(spark: SparkSession, sf: str) -> DataFrame:
    f = dt.flights(spark, sf)
    return CL.first_per_key(f.drop("l_orderkey", "l_linenumber"))


def _connections(spark: SparkSession, sf: str) -> DataFrame:
    """Every flight of the holdout years as the first leg of a replayed connection."""
    records = materialize(_one_per_flight(spark, sf))
    daily = _daily(spark, sf)
    cases = materialize(ST.fixed_bounds(S.replay_cases(records, HOLDOUTS.years), HOLDOUTS))
    rows = ST.connection_rows(cases, daily, records, SEED, "hashed")
    return rows.withColumn("probability", F.col("combined_probability"))


# ------------------------------------------------------------------ ingestion


@query
def clean_flights(spark: SparkSession, sf: str) -> DataFrame:
    return CL.clean_flights(_raw(spark, sf))


@query
def clean_flights_wide(spark: SparkSession, sf: str) -> DataFrame:
    wide = CL.clean_flights_wide(_raw_wide(spark, sf))
    legs = F.col("diversion_details")
    leg = lambda i, f: F.get(legs, F.lit(i))[f].alias(f"leg{i + 1}_{f}")
    return wide.select(
        *[c for c in wide.columns if c != "diversion_details"], F.size(legs).alias("leg_count"),
        leg(0, "sequence"), leg(0, "airport"), leg(0, "airport_id"), leg(0, "wheels_on_minutes"),
        leg(0, "total_ground_minutes"), leg(1, "airport"), leg(1, "wheels_off_minutes"), leg(1, "tail_number"),
    )


@query
def quality_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return CL.quality_by_source(dt.raw_rows(spark, sf))


@query
def quality_by_source_wide(spark: SparkSession, sf: str) -> DataFrame:
    return CL.quality_by_source_wide(dt.raw_wide_rows(spark, sf))


@query
def clean_archives(spark: SparkSession, sf: str) -> DataFrame:
    """All raw rows written as ZIP archives, read back by the data source and cleaned."""
    folder = work_folder(spark)
    written = materialize(AR.write_archives(_raw(spark, sf), folder)).agg(F.sum("n_rows")).first()[0]
    raw = AR.read_archive_folder(spark, folder).withColumn("source_file", F.regexp_replace("source_file", "~.*$", ""))
    if (found := raw.count()) != (written or 0):
        raise RuntimeError(f"archives hold {written} rows, {found} were read")
    return CL.clean_flights(raw)


@query
def ingest_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of all files after two runs of the bounded stream; files of later years arrive between the runs."""
    folder, target, checkpoint = (work_folder(spark) for _ in range(3))
    rows = materialize(_raw(spark, sf))
    source = F.regexp_extract("_metadata.file_path", "source_file=([^/]+)/", 1)
    for part in (F.col("source_file") < "m_1997", F.col("source_file") >= "m_1997"):
        rows.where(part).hint("rebalance", "source_file").write.mode("append").option("header", True).partitionBy("source_file").csv(folder)
        BS.ingest_stream(BS.read_bounded_stream(spark, folder, 24, source), target, checkpoint)
    if again := BS.ingest_stream(BS.read_bounded_stream(spark, folder, 24, source), target, checkpoint):
        raise RuntimeError(f"{again} batches ran without a new file")
    return BS.ingested_quality(spark, target)


@query
def upsert_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Wide counters of the later years replace narrow ones of the same file."""
    pick = lambda df, valid: df.select("source_file", "source_rows", F.col(valid).alias("valid_rows"))
    old = pick(CL.quality_by_source(dt.raw_rows(spark, sf)), "cleaned_rows")
    later = dt.raw_wide_rows(spark, sf).where(F.col("source_file") >= "m_1999")
    return CL.upsert_by_source(old, pick(CL.quality_by_source_wide(later), "retained_rows"))


@query
def pending_sources(spark: SparkSession, sf: str) -> DataFrame:
    files = dt.raw_rows(spark, sf).select("source_file").distinct()
    done = dt.flights(spark, sf).where("cancelled and year < 1998").select("source_file").distinct()
    return CL.pending_sources(files, done)


@query
def refresh_history(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf)


@query
def development_sample(spark: SparkSession, sf: str) -> DataFrame:
    return CL.development_sample(dt.flights(spark, sf), 25)


@query
def yearly_status(spark: SparkSession, sf: str) -> DataFrame:
    return CL.yearly_status(dt.flights(spark, sf))


@query
def duplicate_excess(spark: SparkSession, sf: str) -> DataFrame:
    return CL.duplicate_excess(dt.flights(spark, sf))


@query
def date_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return CL.date_coverage(_history(spark, sf))


@query
def route_year_stats(spark: SparkSession, sf: str) -> DataFrame:
    history = _history(spark, sf)
    routes = history.where("day_of_week = 7").select("reporting_carrier", "origin", "destination").distinct()
    return rounded(CL.route_year_stats(history, routes))


@query
def serving_projection(spark: SparkSession, sf: str) -> DataFrame:
    return CL.serving_projection(_history(spark, sf))


@query
def serving_layout(spark: SparkSession, sf: str) -> DataFrame:
    """The serving rows written sorted, counted while they are written, and read back from the files."""
    path = work_folder(spark)
    serving = CL.serving_projection(_history(spark, sf))
    return files.checked_layout(spark, path, files.write_serving(serving, path), serving.schema)


@query
def dataset_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return CL.dataset_fingerprint(CL.serving_projection(_history(spark, sf)))


@query
def exact_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return CL.exact_schedule(CL.clean_flights_wide(_raw_wide(spark, sf)))


@query
def airports_seen(spark: SparkSession, sf: str) -> DataFrame:
    return CL.codes_seen(_history(spark, sf))


@query
def supported_airports(spark: SparkSession, sf: str) -> DataFrame:
    return CL.supported_airports(_history(spark, sf), dt.airports(spark), DOMESTIC_COUNTRIES)


@query
def supported_carriers(spark: SparkSession, sf: str) -> DataFrame:
    return CL.supported_carriers(_history(spark, sf), dt.carrier_names(spark))


@query
def scalar_labels(spark: SparkSession, sf: str) -> DataFrame:
    """All bucket labels and clock expressions over the flights."""
    f = dt.flights(spark, sf)
    day, dep, arr = F.col("flight_date"), F.col("crs_departure_minutes"), F.col("crs_arrival_minutes")
    labelled = f.select(
        clock.season(F.col("month")).alias("season"),
        buckets.delay_severity(F.coalesce("arrival_delay_minutes", F.lit(0.0))).alias("severity"),
        buckets.layover_bucket(dep % 200).alias("layover_bucket"), buckets.layover_class(dep % 200).alias("layover_class"),
        buckets.cohort_size_bucket(dep).alias("size_bucket"), buckets.severe_freq_bucket(dep / 4000).alias("frequency_bucket"),
        buckets.horizon_bucket(day, F.lit("1998-06-01").cast("date")).alias("horizon"),
        clock.circular_minutes(dep, arr).alias("clock_distance"), clock.weekday_bit(day).alias("weekday_bit"),
        clock.mask_includes(F.lit(21), F.col("day_of_week")).alias("in_mask"),
        clock.subtract_months(day, 6).alias("six_months_back"),
        clock.days_of_week_between(day, F.lit("2001-12-31").cast("date"), F.col("day_of_week")).alias("weekdays_left"),
        codes.parse_flight_number(F.concat(F.lower("reporting_carrier"), F.lit(" "), F.col("flight_number")))["number"].alias("number"),
        codes.hash_int(F.col("flight_number"), dep).alias("hash"),
    )
    keys = ("season", "severity", "layover_bucket", "layover_class", "size_bucket", "frequency_bucket", "horizon", "in_mask")
    return labelled.groupBy(*keys).agg(
        F.count("*").cast("bigint").alias("flights"), F.sum("clock_distance").cast("bigint").alias("clock_distance"),
        F.bit_or("weekday_bit").cast("int").alias("weekdays"), F.max("six_months_back").alias("latest_back"),
        F.sum("weekdays_left").cast("bigint").alias("weekdays_left"), F.max("number").alias("last_number"),
        F.max("hash").alias("top_hash"),
    )


# ------------------------------------------------------------------ cohorts


@query
def cohort_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = C.cohort_counts(_cases(spark, sf), _daily(spark, sf))
    return counted.select("case_id", *[f"n_{level}" for level in C.LEVELS])


@query
def cohort_select(spark: SparkSession, sf: str) -> DataFrame:
    selected, _ = _selected(spark, sf)
    return selected.select("case_id", "cohort_level", "cohort_size")


@query
def next_broader(spark: SparkSession, sf: str) -> DataFrame:
    """The first non-empty and the first eligible level above the exact one."""
    counted = materialize(C.cohort_counts(_cases(spark, sf), _daily(spark, sf)))
    a = C.next_broader(counted).select("case_id", F.col("cohort_level").alias("next_level"), F.col("cohort_size").alias("next_size"))
    b = C.choose_level(counted, 30, above=0).select("case_id", F.col("cohort_level").alias("eligible_level"), F.col("cohort_size").alias("eligible_size"))
    return a.join(b, "case_id")


@query
def fallback_usage(spark: SparkSession, sf: str) -> DataFrame:
    selected, _ = _selected(spark, sf)
    return rounded(M.usage(selected.where("cohort_level is not null")))


@query
def cohort_members(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram of every chosen cohort, one row per case and delay."""
    selected, daily = _selected(spark, sf)
    return D.attach_members(selected, C.packed_histograms(selected, daily)).select("case_id", "delay", "n")


@query
def cohort_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    selected, daily = _selected(spark, sf)
    return rounded(D.evaluate_cohorts(selected, daily, case_columns=["case_id"], qs=D.QUANTILES))


@query
def delay_distribution(spark: SparkSession, sf: str) -> DataFrame:
    history = materialize(_history(spark, sf))
    daily = materialize(C.daily_delay_counts(history))
    selected = C.select_cohorts(_cases(spark, sf), daily)
    keep = ["case_id", "prediction_date", "hist_start", "hist_end", "cohort_level", "cohort_size"]
    rows = D.evaluate_cohorts(selected, daily, case_columns=keep, qs=(0.1, 0.25, 0.5, 0.75, 0.9))
    return rounded(C.history_coverage(rows, history).drop("cohort_n", "hist_start", "hist_end"))


@query
def connection_probability(spark: SparkSession, sf: str) -> DataFrame:
    """How likely is each connection? The flagship."""
    selected, daily = _selected(spark, sf)
    return rounded(D.evaluate_cohorts(selected, daily, case_columns=["case_id", "cohort_level", "cohort_size", "layover_minutes"], layover=F.col("layover_minutes"),
    ))


@query
def scenario_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    cases = dt.cases(spark, sf)
    return rounded(cases.select("case_id", *scenario_columns(F.col("layover_minutes")), *transfer_quantile_columns()))


@query
def status_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.status_probabilities(_cases(spark, sf), dt.flights(spark, sf))
    return rounded(rows.select("case_id", "status_level", "status_size", "completion_probability", "cancellation_probability", "diversion_probability"))


@query
def combined_probability(spark: SparkSession, sf: str) -> DataFrame:
    rows = _connections(spark, sf)
    return rounded(rows.select("case_id", "status_level", "conditional_probability", "combined_probability"))


@query
def connection_options(spark: SparkSession, sf: str) -> DataFrame:
    routed = X.connection_options(dt.cases(spark, sf), dt.flights(spark, sf), SEED, "hashed")
    return routed.select("case_id", "layover_minutes", "out_destination", "out_minutes", "has_outbound")


@query
def replay_outcome(spark: SparkSession, sf: str) -> DataFrame:
    routed = X.connection_options(S.replay_cases(_one_per_flight(spark, sf), HOLDOUTS.years), dt.flights(spark, sf), SEED, "constant")
    outcome = X.replay_outcome(F.col("status") == "completed", F.col("actual"), F.col("layover_minutes"), codes.uniform01(F.col("case_id"), str(SEED)))
    return routed.select("case_id", "layover_minutes", outcome.alias("outcome"))


@query
def layover_monotonicity(spark: SparkSession, sf: str) -> DataFrame:
    selected, daily = _selected(spark, sf)
    curve = ST.layover_curve(selected, C.member_histograms(selected, daily))
    return rounded(ST.sanity_report(curve))


@query
def candidate_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Counts-first choice against fetching every level, with the same minimum and with another."""
    return rounded(ST.candidate_parity(_cases(spark, sf), _daily(spark, sf), eager_minimums=(30, 60)))


# ------------------------------------------------------------------ metrics


@query
def crps(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_replay(spark, sf).select("case_id", "cohort_level", "actual", "p50", "p75", "p90", "crps"))


@query
def pinball_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_replay(spark, sf).groupBy("test_year").agg(*M.arrival_metrics()))


@query
def metrics_by_dimension(spark: SparkSession, sf: str) -> DataFrame:
    rows = _replay(spark, sf).select(
        "*", F.month("prediction_date").alias("month"), clock.time_bucket(F.col("departure_minutes")).alias("time_bucket"),
        buckets.delay_severity(F.col("actual")).alias("severity"),
        buckets.route_volume_group(F.col("n_route_carrier")).alias("route_volume_group"),
    )
    dims = ("carrier", "route_volume_group", "month", "time_bucket", "severity", "cohort_level")
    return rounded(M.metrics_by(rows, dims, M.arrival_metrics(), ("test_year",), min_rows=5))


@query
def worst_tail_cases(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ST.worst_tail_cases(_replay(spark, sf)).select("case_id", "actual", "p90", "p90_error"))


@query
def brier(spark: SparkSession, sf: str) -> DataFrame:
    """Brier score, gap and calibration error of every replayed connection, by year."""
    return rounded(M.connection_metrics(_connections(spark, sf), ("test_year",)))


@query
def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.calibration_bins(_connections(spark, sf), ("test_year",)))


@query
def ece(spark: SparkSession, sf: str) -> DataFrame:
    bins = M.calibration_bins(_connections(spark, sf), ("test_year", "status"))
    return rounded(bins.groupBy("test_year", "status").agg(M.calibration_error().alias("ece")))


@query
def error_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(_connections(spark, sf).select("case_id", "test_year", "probability", "outcome"))
    return rounded(ST.error_cases(rows, 0.0).unionByName(ST.error_cases(rows, 1.0)))


@query
def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage interval over resampled route-month-carrier units of all replayed flights."""
    rows = _replay(spark, sf).withColumn("month", F.date_format("prediction_date", "yyyy-MM"))
    sums = {"covered": M.covered(F.col("actual"), F.col("p90")), "w": F.lit(1.0)}
    return rounded(B.bootstrap_interval(rows, ["carrier", "origin", "destination", "month"], sums, F.col("covered") / F.col("w"), 100, SEED))


@query
def cluster_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Brier, calibration error and gap intervals over route-by-month clusters, per year."""
    rows = B.cluster_columns(_connections(spark, sf)).withColumn("weight", F.lit(1.0))
    return rounded(ST.connection_intervals(rows, ["test_year"], ["cluster_route", "cluster_month"], 100, SEED))


@query
def stratified_weights(spark: SparkSession, sf: str) -> DataFrame:
    history = materialize(_history(spark, sf))
    strata = S.with_strata(S.replay_cases(history, HOLDOUTS.years), history)
    sample = S.stratified_sample(strata, 500, SEED)
    return rounded(sample.select("case_id", "test_year", *S.STRATA, "stratum_rank", "population_count", "sampled_count", "weight"))


@query
def route_volume(spark: SparkSession, sf: str) -> DataFrame:
    history = materialize(_history(spark, sf))
    return S.with_route_volume(S.replay_cases(history, HOLDOUTS.years), history).select("case_id", "route_count", "route_volume_group")


@query
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return S.sample_cases(S.replay_cases(_history(spark, sf), HOLDOUTS.years), 200, SEED, HOLDOUTS.years).select("case_id", "test_year", "actual")


# ------------------------------------------------------------------ studies


def _study_inputs(spark: SparkSession, sf: str, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    history = materialize(_history(spark, sf))
    cases = S.sample_cases(S.replay_cases(history, HOLDOUTS.years), n, SEED, HOLDOUTS.years)
    return history, materialize(C.daily_delay_counts(history)), materialize(cases)


def _all_cases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Daily counts and every holdout flight as a case."""
    history = materialize(_history(spark, sf))
    return materialize(C.daily_delay_counts(history)), materialize(S.replay_cases(history, HOLDOUTS.years))


@query
def temporal_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Windows and thresholds on sampled holdout flights."""
    _, daily, cases = _study_inputs(spark, sf, 200)
    rows = ST.replay_arrivals(cases, daily, HOLDOUTS)
    return rounded(M.metrics_by(rows, ("carrier", "route_volume_group", "month"), M.arrival_metrics(), ("test_year", "config")))


@query
def temporal_replay_full(spark: SparkSession, sf: str) -> DataFrame:
    """Windows and thresholds on every holdout flight."""
    daily, cases = _all_cases(spark, sf)
    rows = M.exact_ties(ST.replay_arrivals(cases, daily, HOLDOUTS), ("p50", "p75", "p90"))
    return rounded(M.metrics_by(rows, ("carrier", "route_volume_group", "month"), M.arrival_metrics(), ("test_year", "config")))


@query
def exact_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of the flights of the history, rounded up: exactly that many, in digest order."""
    history = materialize(_history(spark, sf).withColumn("digest", F.md5(F.concat_ws("|", F.lit(str(SEED)), *HISTORY_KEY))))
    return exact_rows(history, F.col("digest"), -(-history.count() // 10)).select(*HISTORY_KEY, "digest")


@query
def tail_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ST.tail_sensitivity(_history(spark, sf)))


@query
def tail_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Carrier-route delays with the top fifth taken from the whole route, all routes."""
    history = _history(spark, sf)
    value = F.col("arrival_delay_minutes").alias("value")
    center = history.groupBy("reporting_carrier", "origin", "destination", value).agg(F.count("*").alias("n"))
    center = materialize(center)
    source = center.groupBy("origin", "destination", "value").agg(F.sum("n").alias("n"))
    routes = center.select("reporting_carrier", "origin", "destination").distinct()
    keys = ["reporting_carrier", "origin", "destination"]
    spread_source = routes.join(source, ["origin", "destination"])
    pooled = ST.tail_pool(center, spread_source, keys, min_center=None)
    return rounded(pooled.groupBy(*keys).agg(
        F.sum("n").cast("bigint").alias("n"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        F.max("value").alias("maximum"), F.percentile("value", F.lit(0.9), F.col("n")).alias("p90"),
    ), 6)


@query
def tail_candidates(spark: SparkSession, sf: str) -> DataFrame:
    daily, cases = _all_cases(spark, sf)
    rows = ST.tail_arrivals(cases, daily, HOLDOUTS)
    return rounded(rows.select("case_id", "candidate", "cohort_level", "cohort_size", "p50", "p75", "p90", "p95", "crps", "recent_severe_share"))


@query
def blend_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    """Blended once per case profile; each case reads the values of its profile."""
    daily, cases = _all_cases(spark, sf)
    links, heads = C.profile_heads(ST.fixed_bounds(cases, HOLDOUTS), C.LEVELS)
    counted = materialize(C.cohort_counts(materialize(heads), daily))
    hist, rows = ST.blend_cohorts(counted, daily)
    sized = D.quantiles(hist, ["case_id"], (0.5, 0.75, 0.9), "value")
    found = rows.select("case_id", "blend_label", "specific_weight").join(sized, "case_id").withColumnRenamed("case_id", "head_id")
    return rounded(links.join(found, "head_id").drop("head_id"), 6)


def _boundary(spark: SparkSession, sf: str) -> DataFrame:
    history = materialize(_history(spark, sf))
    return ST.boundary_rows(history, dt.flights(spark, sf), ST.Holdouts(HOLDOUTS.years, HOLDOUTS.train_start), 15, SEED, targets=BOUNDARY_SIZES)


# The derived flights have small exact cohorts, so the sizes of interest are small as well.
BOUNDARY_SIZES = (2, 3, 4, 5, 6, 20, 24, 25, 28, 29, 30, 31, 32, 35, 40)


@query
def boundary_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_boundary(spark, sf))


@query
def boundary_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ST.boundary_summary(_boundary(spark, sf)))


@query
def worst_jumps(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ST.worst_jumps(_boundary(spark, sf)).select("case_id", "production_displacement_pp"))


@query
def threshold_study(spark: SparkSession, sf: str) -> DataFrame:
    history = materialize(_history(spark, sf))
    return rounded(ST.threshold_study(history, dt.flights(spark, sf), HOLDOUTS, 150, seed=SEED), 6)


@query
def stratified_study(spark: SparkSession, sf: str) -> DataFrame:
    history = materialize(_history(spark, sf))
    daily = materialize(C.daily_delay_counts(history))
    return rounded(ST.stratified_arrivals(history, daily, HOLDOUTS, 500, 200, SEED)["arrivals"], 6)


@query
def stratified_connections(spark: SparkSession, sf: str) -> DataFrame:
    history, records = materialize(_history(spark, sf)), materialize(_one_per_flight(spark, sf))
    daily = materialize(C.daily_delay_counts(history))
    return rounded(ST.stratified_connections(history, records, daily, HOLDOUTS, 300, 200, SEED)["connections"], 6)


@query
def tail_experiment(spark: SparkSession, sf: str) -> DataFrame:
    history, records = materialize(_history(spark, sf)), materialize(_one_per_flight(spark, sf))
    daily = materialize(C.daily_delay_counts(history))
    return rounded(ST.tail_experiment_connections(history, records, daily, HOLDOUTS, 200, 100, SEED, ties=True)["connections"], 6)


# The same studies at full case and replicate counts, with their intervals; values rounded to 9 digits
# before they meet a bin edge or a whole minute, here and in the SQL.


@query
def stratified_study_full(spark: SparkSession, sf: str) -> DataFrame:
    history = materialize(_history(spark, sf))
    daily = materialize(C.daily_delay_counts(history))
    out = ST.stratified_arrivals(history, daily, HOLDOUTS, 500, 500, SEED, ties=True)
    limits = out["coverage_interval"].withColumn("dimension", F.lit("all"))
    return rounded(out["arrivals"].join(limits, ["test_year", "strategy", "dimension"], "left"), 6)


@query
def stratified_connections_full(spark: SparkSession, sf: str) -> DataFrame:
    history, records = materialize(_history(spark, sf)), materialize(_one_per_flight(spark, sf))
    daily = materialize(C.daily_delay_counts(history))
    out = ST.stratified_connections(history, records, daily, HOLDOUTS, 300, 500, SEED, ties=True)
    return rounded(out["connections"].join(out["connection_intervals"], ["test_year", "kind"], "left"), 6)


@query
def tail_experiment_full(spark: SparkSession, sf: str) -> DataFrame:
    history, records = materialize(_history(spark, sf)), materialize(_one_per_flight(spark, sf))
    daily = materialize(C.daily_delay_counts(history))
    out = ST.tail_experiment_connections(history, records, daily, HOLDOUTS, 1000, 300, SEED, ties=True)
    return rounded(out["connections"].join(out["connection_intervals"], ["test_year", "candidate"], "left"), 6)


# ------------------------------------------------------------------ schedules


@query
def weekly_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return H.weekly_signatures(_schedule(spark, sf))


@query
def exact_periods(spark: SparkSession, sf: str) -> DataFrame:
    return H.exact_periods(_schedule(spark, sf))


@query
def pattern_periods(spark: SparkSession, sf: str) -> DataFrame:
    return H.pattern_periods(_schedule(spark, sf))


@query
def expand_periods(spark: SparkSession, sf: str) -> DataFrame:
    return H.expand_periods(H.pattern_periods(_schedule(spark, sf)))


@query
def pattern_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    sched = materialize(_schedule(spark, sf))
    return H.pattern_exclusions(H.pattern_periods(sched), sched)


@query
def false_row_reasons(spark: SparkSession, sf: str) -> DataFrame:
    sched = materialize(_schedule(spark, sf))
    return H.false_row_reasons(H.pattern_periods(sched), sched)


@query
def missing_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Source rows that periods of the first half of the year alone do not claim."""
    sched = materialize(_schedule(spark, sf))
    early = H.pattern_periods(sched.where("month(flight_date) <= 6"))
    return H.pattern_gaps(early, sched)


@query
def reconstruction_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    sched = materialize(_schedule(spark, sf))
    exact = H.reconstruction_accuracy(H.exact_periods(sched), sched, "exact")
    return exact.unionByName(H.reconstruction_accuracy(H.pattern_periods(sched), sched, "pattern"))


@query
def sample_reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    sched = materialize(_schedule(spark, sf))
    keys = materialize(H.stratified_keys(sched, T.route_stability(sched), T.schedule_stability(sched)))
    exact = H.sample_reconstruction(keys, H.exact_periods(sched), sched, "exact")
    return exact.unionByName(H.sample_reconstruction(keys, H.pattern_periods(sched), sched, "pattern"))


@query
def compaction_summary(spark: SparkSession, sf: str) -> DataFrame:
    sched = materialize(_schedule(spark, sf))
    pattern = materialize(H.pattern_periods(sched))
    return H.compaction_summary(sched, H.exact_periods(sched), pattern, H.pattern_exclusions(pattern, sched))


@query
def route_stability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.route_stability(_schedule(spark, sf)))


@query
def schedule_modes(spark: SparkSession, sf: str) -> DataFrame:
    return T.schedule_modes(_schedule(spark, sf))


@query
def schedule_stability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.schedule_stability(_schedule(spark, sf)))


@query
def operating_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.operating_patterns(_schedule(spark, sf)))


@query
def stability_findings(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.route_findings(T.route_stability(_schedule(spark, sf))))


@query
def schedule_findings(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.schedule_findings(T.schedule_stability(_schedule(spark, sf))))


@query
def pattern_counts(spark: SparkSession, sf: str) -> DataFrame:
    return T.pattern_counts(T.operating_patterns(_schedule(spark, sf)))


@query
def stability_examples(spark: SparkSession, sf: str) -> DataFrame:
    sched = materialize(_schedule(spark, sf))
    return T.stability_examples(T.route_stability(sched), T.schedule_stability(sched))


@query
def modal_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return T.modal_accuracy(_schedule(spark, sf))


@query
def lookup_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return T.lookup_statistics(dt.flights(spark, sf))


@query
def lookup_flights(spark: SparkSession, sf: str) -> DataFrame:
    return L.segment_rows(L.lookup_flights(dt.lookup_keys(spark, sf), _schedule(spark, sf)))


@query
def lookup_periods(spark: SparkSession, sf: str) -> DataFrame:
    periods = H.exact_periods(_schedule(spark, sf))
    return L.segment_rows(L.lookup_periods(dt.lookup_keys(spark, sf), periods))


# ------------------------------------------------------------------ itineraries


@query
def elapsed_minutes(spark: SparkSession, sf: str) -> DataFrame:
    rows = dt.itineraries(spark, sf)
    e = clock.elapsed_minutes(F.col("arrival_minutes"), F.col("connecting_minutes"))
    return rows.select("request_id", e["minutes"].alias("minutes"), e["overnight"].alias("overnight"))


@query
def first_leg_duration(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.first_leg_duration(dt.itineraries(spark, sf), dt.airports(spark))
    return rows.select("request_id", "duration_minutes", "rolled", F.col("duration_reason").alias("reason"))


@query
def itinerary_seed(spark: SparkSession, sf: str) -> DataFrame:
    r = dt.requests_text(spark, sf)
    key = codes.itinerary_key(*[F.col(c) for c in r.columns if c != "request_id"])
    return r.select("request_id", key.alias("key")).select("request_id", "key", codes.itinerary_seed(F.col("key")).cast("string").alias("seed"))


@query
def validate_itineraries(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.validate_itineraries(dt.requests_text(spark, sf), dt.airports(spark))
    return rows.select("request_id", "carrier", "reason")


@query
def score_itineraries(spark: SparkSession, sf: str) -> DataFrame:
    history = materialize(_history(spark, sf))
    scored = I.score_itineraries(dt.requests_text(spark, sf), history, dt.airports(spark))
    return rounded(scored.withColumn("seed", F.col("seed").cast("string")))


@query
def compare_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """The full history against a serving projection that lacks one carrier."""
    history = materialize(_history(spark, sf))
    partial = materialize(CL.serving_projection(history.where("reporting_carrier <> 'DL'")))
    return rounded(ST.compare_datasets(history, partial, dt.requests_text(spark, sf), dt.airports(spark)), 6)


@query
def scenario_order(spark: SparkSession, sf: str) -> DataFrame:
    """Does a later first arrival ever raise the chance of a connection?"""
    return ST.scenario_order_violations(dt.cases(spark, sf))


@query
def material_jump_carriers(spark: SparkSession, sf: str) -> DataFrame:
    return ST.material_jump_carriers(_boundary(spark, sf), 2.0)


@query
def lookup_rejections(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that a lookup turns down, with the reason."""
    return L.rejected(dt.careless_lookup_keys(spark, sf))


@query
def representative_itineraries(spark: SparkSession, sf: str) -> DataFrame:
    return S.representative_itineraries(_history(spark, sf), 50, 2000, min_obs=5)


def _two_leg_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests by order; candidates are the schedule rows of both flight numbers that day, listed once per answer.

    ``asked`` holds what a leg asks for: carrier, number and day, once per copy of the order.
    """
    it = dt.itineraries(spark, sf)
    k = F.col("request_id")
    legs = it.select(
        "request_id", F.explode(F.array(
            F.struct(F.lit(1).alias("leg"), F.col("carrier").alias("c"), (k % 12 + 1).cast("string").alias("number")),
            F.struct(F.lit(2).alias("leg"), F.col("carrier").alias("c"), (k * 5 % 12 + 1).cast("string").alias("number")),
        )).alias("l"), F.date_sub("travel_date", 30).alias("day"),
    ).select("request_id", "day", "l.*")
    known = F.col("c").isNotNull() & F.col("number").isNotNull() & F.col("day").isNotNull()
    asked = materialize(legs.groupBy("request_id", "leg").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(known, F.concat_ws(" ", "c", "number", "day")))), ",").alias("asked")
    ))
    wall = lambda minutes: F.timestamp_add("MINUTE", F.col(minutes), F.col("flight_date").cast("timestamp_ntz"))
    flight = F.concat_ws(" ", "reporting_carrier", "flight_number", "flight_date")
    daily = _schedule(spark, sf).distinct().withColumn("_flight", flight)
    answers = asked.select("asked").distinct().select("asked", F.explode(F.split("asked", ",")).alias("_flight"))
    found = answers.join(daily, "_flight")
    order = F.row_number().over(
        Window.partitionBy("asked").orderBy("crs_departure_minutes", "origin", "destination", "crs_arrival_minutes")
    )
    none = F.lit(None)
    candidates = materialize(found.select(
        "asked", (order - 1).alias("position"), F.col("reporting_carrier").alias("carrier"), F.col("flight_number").alias("number"),
        "origin", "destination",
        wall("crs_departure_minutes").alias("departure_local"), wall("crs_arrival_minutes").alias("arrival_local"),
        none.cast("int").alias("departure_offset"), none.cast("int").alias("arrival_offset"),
        F.when(F.col("origin") != "DEN", "T1").alias("departure_terminal"), F.lit("B").alias("arrival_terminal"),
    ))
    outcome = (
        F.when((k % 53 == 1) & (F.col("leg") == 1), "authentication").when((k % 59 == 2) & (F.col("leg") == 2), "malformed")
        .when((k % 61 == 3) & (F.col("leg") == 2), "quota").otherwise("ok")
    )
    lookups = asked.select("request_id", "leg", outcome.alias("outcome"), "asked")
    requests = it.select(
        "request_id", F.when(k % 2 == 0, 0).cast("int").alias("first_choice"),
        F.when(k % 3 == 0, 1).when(k % 3 == 1, 0).cast("int").alias("second_choice"),
    )
    return requests, lookups, candidates


@query
def two_leg_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return I.resolve_two_legs(*_two_leg_inputs(spark, sf), dt.airports(spark), answer="asked")


@query
def two_leg_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved legs with their probability; rejections by the one-leg rules included."""
    history = materialize(_history(spark, sf))
    resolved = materialize(I.resolve_two_legs(*_two_leg_inputs(spark, sf), dt.airports(spark), answer="asked"))
    return rounded(I.score_two_legs(resolved, history, dt.airports(spark)))


# ------------------------------------------------------------------ payloads and logs


@query
def normalize_payloads(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.normalize_payloads(_payload_log(spark, sf))
    return rows.withColumn("quality", F.concat_ws(",", "quality"))


@query
def lookup_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return P.lookup_outcome(P.normalize_payloads(_payload_log(spark, sf)))


@query
def provider_coverage(spark: SparkSession, sf: str) -> DataFrame:
    payloads = _payload_log(spark, sf)
    normalized = materialize(P.normalize_payloads(payloads).select("request_key", "item_index", "reject_reason", "has_item", *P.OPTIONAL_FIELDS))
    log = payloads.select(
        "request_key", F.upper(F.substring("requested_number", 1, 2)).alias("airline"),
        F.coalesce(buckets.horizon_bucket(F.col("requested_date"), F.lit("1995-01-01").cast("date")), F.lit("past")).alias("horizon"),
    ).distinct()
    lookups = log.join(P.lookup_outcome(normalized), "request_key")
    return P.provider_coverage(lookups, P.candidates_of(normalized))


@query
def study_plan(spark: SparkSession, sf: str) -> DataFrame:
    """A plan over every order's flight: far over the request cap, which the plan reports."""
    k = F.col("request_id")
    rows = dt.itineraries(spark, sf).select(
        F.concat(F.lower("carrier"), F.lit(" "), (k % 12 + 1).cast("string")).alias("flight_number"),
        F.col("travel_date").cast("string").alias("flight_date"),
        F.when(k % 19 == 0, "XX").otherwise(F.col("carrier")).alias("airline"),
        (k % 23 != 0).alias("manually_confirmed"), F.when(k % 37 == 0, " ").otherwise("timetable").alias("confirmation_source"),
    )
    return P.study_plan(P.check_study_rows(rows, F.lit("1995-06-01").cast("date")))


@query
def classify_response(spark: SparkSession, sf: str) -> DataFrame:
    return P.grade_responses(dt.response_log(spark, sf))


@query
def flag_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return P.flag_secrets(dt.table(spark, sf, "documents")).select("doc_id", "secret_bearing")


@query
def log_values(spark: SparkSession, sf: str) -> DataFrame:
    return P.log_values(dt.table(spark, sf, "documents"), "doc_id")


@query
def redact(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts with listed secrets replaced, compared by digest."""
    out = P.redact(dt.table(spark, sf, "documents"), "text", ["password", "the ", "a"])
    return out.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("length"))
