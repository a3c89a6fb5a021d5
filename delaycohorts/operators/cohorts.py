"""Cohorts for whole tables of cases: ladder counts, level choice, member histograms.

Every question here is "how many rows of key K lie in [start, end)". It is answered by a
difference of two running totals over the days of a place (see ``packed``). There is no range
join, nothing is paired up, and a group never holds more facts than calendar days, buckets and delays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaycohorts.operators import packed
from delaycohorts.session import materialize

# Ladder levels from narrow to broad.
LEVELS = (
    "exact", "route_carrier_month_bucket", "route_carrier_season", "route_carrier", "route",
    "carrier", "global",
)
STATUS_LEVELS = ("route_carrier", "route", "carrier", "global")
# An extra cohort used by the tail study only.
CARRIER_MONTH_BUCKET = "carrier_month_bucket"

# A cohort key is one text plus its hash; the hash only makes sorting and shuffling cheap,
# equality is always decided on the text as well.
KEY = ("k_hash", "k_text")
PROFILE = ("_profile_hash", "_profile")
BOUNDS = ("hist_start", "hist_end")
OPEN_START = "0001-01-01"
FRESHNESS_WARNING_DAYS = 90

_USES = {
    "exact": ("carrier", "origin", "destination", "month", "dow", "bucket"),
    "route_carrier_month_bucket": ("carrier", "origin", "destination", "month", "bucket"),
    "route_carrier_season": ("carrier", "origin", "destination", "month"),
    "route_carrier": ("carrier", "origin", "destination"),
    "route": ("origin", "destination"),
    "carrier": ("carrier",),
    "global": (),
    CARRIER_MONTH_BUCKET: ("carrier", "month", "bucket"),
}


def daily_delay_counts(history: DataFrame) -> DataFrame:
    """The one pre-aggregate all cohort work reads: rows per route, day, bucket and delay."""
    return history.groupBy(
        F.col("reporting_carrier").alias("carrier"), "origin", "destination", "flight_date",
        F.col("departure_time_bucket").alias("bucket"),
        F.col("arrival_delay_minutes").alias("delay"),
    ).agg(F.count("*").alias("n"))


def with_bounds(
    cases: DataFrame, lookback: int | Column | None = 24, start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Adds ``hist_start`` (inclusive) and ``hist_end`` (exclusive).

    The start is the later of the rolling and the given start; no start means open. A given
    end after the prediction date is an error.
    """
    day = F.col("prediction_date")
    months = F.lit(lookback) if not isinstance(lookback, Column) else lookback
    rolling = F.when(F.coalesce(months, F.lit(0)) > 0, F.add_months(day, -months.cast("int")))
    open_start = F.lit(OPEN_START).cast("date")
    given = start if start is not None else F.lit(None).cast("date")
    limit = F.coalesce(end, day) if end is not None else day
    late = F.raise_error(F.lit("history end cannot be later than the prediction date"))
    return cases.withColumn("hist_start", F.coalesce(F.greatest(rolling, given), open_start)).withColumn(
        "hist_end", F.when(limit > day, late.cast("date")).otherwise(limit)
    )


def history_coverage(cases: DataFrame, history: DataFrame) -> DataFrame:
    """Effective window per case and a warning when the data is too old."""
    available = history.agg(
        F.struct(F.min("flight_date").alias("first"), F.max("flight_date").alias("last"))
    ).scalar()
    base = cases.withColumn("_span", available)
    first, last = F.col("_span.first"), F.col("_span.last")
    late = F.datediff(F.col("prediction_date"), last)
    warning = F.concat(
        F.lit("Historical data ends on "), last.cast("string"), F.lit(", "),
        late.cast("string"), F.lit(" days before the requested prediction date."),
    )
    return base.select(
        *cases.columns, first.alias("available_start"), last.alias("available_end"),
        F.greatest(F.col("hist_start"), first).alias("effective_start"),
        F.least(last, F.date_sub("hist_end", 1)).alias("effective_end"),
        F.col("hist_end").alias("cutoff_exclusive"),
        F.when(late > FRESHNESS_WARNING_DAYS, warning).alias("freshness_warning"),
    )


def _key_text(level: str, month: str, date: str, bucket: str) -> str:
    parts = {
        "month": f"cast({month} as string)", "dow": f"cast(weekday({date}) + 1 as string)", "bucket": bucket,
    }
    used = [parts.get(name, name) for name in _USES[level]]
    return "concat_ws('|', " + ", ".join([f"'{level}'", *used]) + ")"


def _key(level: str, month: str, date: str, bucket: str) -> str:
    """SQL of one key; written as text because seven to nine of them form an array."""
    text = _key_text(level, month, date, bucket)
    return f"named_struct('k_hash', xxhash64({text}), 'k_text', {text})"


CASE_BUCKET = (
    "case when departure_minutes < 360 then 'overnight' when departure_minutes < 720 then 'morning' "
    "when departure_minutes < 1080 then 'afternoon' else 'evening' end"
)


def _case_keys(levels: Sequence[str]) -> Column:
    """Keys of a case; month, weekday and bucket come from the request."""
    keys = [_key(level, "month(prediction_date)", "prediction_date", CASE_BUCKET) for level in levels]
    return F.expr("array(" + ", ".join(keys) + ")")


def case_key(level: str) -> Column:
    return _case_keys([level])[0]


def level_requests(cases: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Every case once per level, with the level's key."""
    keys = F.posexplode(_case_keys(levels))
    return cases.select("*", keys.alias("level_index", "k")).select(
        *cases.columns, "level_index", *[F.col(f"k.{c}").alias(c) for c in KEY]
    )


def _profiled(cases: DataFrame, levels: Sequence[str]) -> DataFrame:
    """``cases`` plus ``_profile``: all that decides their keys at these levels, and the bounds.

    ``_profile_hash`` goes first in joins and groups, as with KEY.
    """
    parts = {"month": F.month("prediction_date"), "dow": F.weekday("prediction_date") + 1, "bucket": F.expr(CASE_BUCKET)}
    used = dict.fromkeys(name for level in levels for name in _USES[level])
    marked = cases.withColumn("_profile", F.struct(*[parts.get(c, F.col(c)).alias(c) for c in used], *BOUNDS))
    return marked.withColumn("_profile_hash", F.xxhash64("_profile"))


def count_profiles(cases: DataFrame, daily: DataFrame, levels: Sequence[str], measures: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``cases`` with their profile, and one row per distinct profile with ``c_<level>``, its measures per level.

    Cases of one profile have equal keys and bounds, so only profiles are counted.
    """
    marked = _profiled(cases, levels)
    fields = marked.schema["_profile"].dataType.names
    heads = marked.select("_profile").distinct().select(*[F.col(f"_profile.{c}").alias(c) for c in fields])
    counted = packed.level_counts(heads, daily, levels, measures)
    named = counted.select(F.struct(*fields).alias("_profile"), *[f"c_{level}" for level in levels])
    return marked, named.withColumn("_profile_hash", F.xxhash64("_profile"))


def profiles(cases: DataFrame, levels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``case_id`` with its PROFILE, and one row per profile with all that its keys are made of."""
    marked = _profiled(cases, levels)
    # month, weekday and bucket are equal within a profile, so any date and departure of it will do
    one = [F.min(c).alias(c) for c in ("prediction_date", "departure_minutes")]
    places = [c for c in marked.schema["_profile"].dataType.names if c not in ("month", "dow", "bucket")]
    heads = marked.groupBy(*PROFILE).agg(*one).select("*", *[F.col(f"_profile.{c}").alias(c) for c in places])
    return marked.select("case_id", *PROFILE), heads


def profile_heads(cases: DataFrame, levels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``case_id`` with ``head_id``, the smallest case of its profile, and the heads as cases.

    What depends on keys and bounds alone is computed for the heads; every case reads it from its head.
    """
    marked = _profiled(cases, levels)
    heads = marked.groupBy(*PROFILE).agg(F.min_by(F.struct(*cases.columns), "case_id").alias("_head"))
    links = marked.select("case_id", *PROFILE).join(heads.select(*PROFILE, F.col("_head.case_id").alias("head_id")), [*PROFILE])
    return links.select("case_id", "head_id"), heads.select("_head.*")


def cohort_counts(
    cases: DataFrame, daily: DataFrame
) -> DataFrame:
    """Size of all seven levels per case, as columns ``n_<level>``."""
    marked, counted = count_profiles(cases, daily, LEVELS, ["n"])
    sizes = counted.select(*PROFILE, *[F.col(f"c_{level}")[0].alias(f"n_{level}") for level in LEVELS])
    return marked.join(sizes, [*PROFILE]).drop(*PROFILE)


def _pick(sizes: list[Column], wanted: list[Column]) -> Column:
    chain = F.when(wanted[0], 0)
    for i, w in enumerate(wanted[1:], start=1):
        chain = chain.when(w, i)
    return chain


def choose_level(counted: DataFrame, min_obs: int | Column = 30, above: int = -1) -> DataFrame:
    """First level after ``above`` with enough rows; ``global`` needs only one.

    Adds ``cohort_level``, ``cohort_size`` and the key columns; all null means rejected.
    """
    minimum = F.lit(min_obs) if isinstance(min_obs, int) else min_obs
    sizes = [F.col(f"n_{level}") for level in LEVELS]
    wanted = []
    for i, (level, n) in enumerate(zip(LEVELS, sizes)):
        enough = (n >= minimum) | (n > 0) if level == "global" else n >= minimum
        wanted.append(enough if i > above else F.lit(False))
    return _with_level(counted, _pick(sizes, wanted))


def next_broader(counted: DataFrame, above: int = 0) -> DataFrame:
    """First non-empty level after ``above``."""
    sizes = [F.col(f"n_{level}") for level in LEVELS]
    return _with_level(counted, _pick(sizes, [(n > 0) if i > above else F.lit(False) for i, n in enumerate(sizes)]))


def at_level(counted: DataFrame, level: str) -> DataFrame:
    """The named level whatever its size; empty means rejected."""
    i = LEVELS.index(level)
    return _with_level(counted, F.when(F.col(f"n_{level}") > 0, i))


def _with_level(counted: DataFrame, index: Column) -> DataFrame:
    """Level, size and key of the level at ``index``; only the text of that level is put together."""
    chosen = lambda values: F.expr("case _i " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end")
    base = counted.drop("cohort_level", "cohort_size", "_i", *KEY).withColumn("_i", index)
    text = chosen([_key_text(level, "month(prediction_date)", "prediction_date", CASE_BUCKET) for level in LEVELS])
    return base.select(
        *base.columns, chosen([f"'{level}'" for level in LEVELS]).alias("cohort_level"),
        chosen([f"n_{level}" for level in LEVELS]).cast("bigint").alias("cohort_size"), text.alias("k_text"),
    ).select(
        *[c for c in base.columns if c != "_i"], "cohort_level", "cohort_size",
        F.when(F.col("k_text").isNotNull(), F.xxhash64("k_text")).alias("k_hash"), "k_text",
    )


def select_cohorts(
    cases: DataFrame, daily: DataFrame, min_obs: int | Column = 30,
) -> DataFrame:
    """The one implementation of the fallback ladder: counts first, then the level."""
    return materialize(choose_level(cohort_counts(cases, daily), min_obs))


def packed_histograms(requests: DataFrame, daily: DataFrame, levels: Sequence[str] = LEVELS, qs: Sequence[float] = ()) -> DataFrame:
    """One written row per requested cohort: sorted delays, counts, quantiles at ``qs``; requests carry KEY and BOUNDS."""
    return packed.histograms(requests, daily, levels, qs)


def member_histograms(
    requests: DataFrame, daily: DataFrame, levels: Sequence[str] = LEVELS,
) -> DataFrame:
    """``key, bounds, delay, n`` of the requested cohorts, read off their written packed rows."""
    return packed.unpacked(packed_histograms(requests, daily, levels))


def status_probabilities(
    cases: DataFrame, records: DataFrame, min_obs: int = 30
) -> DataFrame:
    """Share of completed, cancelled and diverted records at the first sufficient of 4 levels."""
    measures = ["total", "completed", "cancelled", "diverted"]
    daily = records.groupBy(
        F.col("reporting_carrier").alias("carrier"), "origin", "destination", "flight_date",
        F.col("departure_time_bucket").alias("bucket"),
    ).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("flight_status") == "completed").alias("completed"),
        F.count_if("cancelled").alias("cancelled"),
        F.count_if("diverted").alias("diverted"),
    )
    marked, counted = count_profiles(cases, daily, STATUS_LEVELS, measures)
    found = F.array(*[f"c_{level}" for level in STATUS_LEVELS])
    last = len(STATUS_LEVELS) - 1
    enough = F.coalesce(*[
        F.when((F.col(f"c_{level}")[0] >= min_obs) | ((F.col(f"c_{level}")[0] > 0) & F.lit(i == last)), i) for i, level in enumerate(STATUS_LEVELS)
    ])
    shares = counted.select(*PROFILE, enough.alias("_best"), found.alias("_found")).where("_best is not null")
    wide = marked.join(shares, [*PROFILE]).withColumn("_chosen", F.col("_found")[F.col("_best")])
    value = lambda m: F.col("_chosen")[measures.index(m)]
    names = F.array(*[F.lit(level) for level in STATUS_LEVELS])
    return wide.select(
        *cases.columns,
        names[F.col("_best")].alias("status_level"),
        value("total").cast("bigint").alias("status_size"),
        (value("completed") / value("total")).alias("completion_probability"),
        (value("cancelled") / value("total")).alias("cancellation_probability"),
        (value("diverted") / value("total")).alias("diversion_probability"),
    )
