"""Counts and histograms of cohorts from prefix sums over days, one group of places at a time.

Everything asked of one place (a carrier on a route, a route, a carrier, or all flights) meets its daily facts
once. The facts of a selection (months, weekday, bucket) become running totals by day; what lies in
[start, end) is the difference of two of them, found by binary search. So all narrow levels of the ladder are
read from one shuffle of the facts, the broader facts are rolled up from the narrow ones, and a cohort is
one row with its sorted delays and their counts. A group holds at most one row per calendar day, bucket and
delay, and one request per distinct profile, however many flights and cases there are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaycohorts.functions.transfer import Transfer
from delaycohorts.session import materialize

# Fixed values.
BUCKETS = ("overnight", "morning", "afternoon", "evening")
SEASON = "route_carrier_season"
# What a level selects within its places.
SELECTS = {
    "exact": ("month", "dow", "bucket"), "route_carrier_month_bucket": ("month", "bucket"), SEASON: ("month",),
    "route_carrier": (), "route": (), "carrier": (), "carrier_month_bucket": ("month", "bucket"), "global": (),
}
# Places that levels share, narrow ones first.
FAMILIES = (
    (("carrier", "origin", "destination"), ("exact", "route_carrier_month_bucket", SEASON, "route_carrier")),
    (("origin", "destination"), ("route",)),
    (("carrier",), ("carrier", "carrier_month_bucket")),
    ((), ("global",)),
)
BOUNDS = ("hist_start", "hist_end")
FIELDS = "month int, dow int, bucket string"
CHUNK = 4096


def _days(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int32()).fill_null(0).to_numpy().astype(np.int64)


def _codes(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name)
    if name == "bucket":
        column = pc.index_in(column, pa.array(BUCKETS))
    return column.cast(pa.int64()).fill_null(-1).to_numpy()


class Facts:
    """Dated rows of one group, by day."""

    def __init__(self, table: pa.Table) -> None:
        day = _days(table.column("flight_date"))
        self.order = np.argsort(day, kind="stable")
        self.day = day[self.order]
        month = self.day.astype("datetime64[D]").astype("datetime64[M]").astype(np.int64) % 12 + 1
        self.parts = {"month": month, "dow": (self.day + 3) % 7 + 1}
        if "bucket" in table.column_names:
            self.parts["bucket"] = _codes(table, "bucket")[self.order]

    def rows(self, level: str, wanted: dict[str, int]) -> np.ndarray:
        """Places of the facts that a selection takes, in order of their days."""
        held = np.ones(len(self.day), bool)
        for part, value in wanted.items():
            if level == SEASON and part == "month":
                held &= np.isin(self.parts[part], [(value - 2) % 12 + 1, value, value % 12 + 1])
            else:
                held &= self.parts[part] == value
        return np.flatnonzero(held)


def _selections(requests: pa.Table, level: str) -> list[tuple[dict[str, int], np.ndarray]]:
    """Requests of a level by what they select."""
    parts = SELECTS[level]
    if not parts:
        return [({}, np.arange(requests.num_rows))]
    codes = np.stack([_codes(requests, p) for p in parts], axis=1)
    kinds, place = np.unique(codes, axis=0, return_inverse=True)
    order = np.argsort(place.ravel(), kind="stable")
    cuts = np.searchsorted(place.ravel()[order], np.arange(len(kinds) + 1))
    return [(dict(zip(parts, map(int, kind))), order[cuts[i] : cuts[i + 1]]) for i, kind in enumerate(kinds)]


def _totals(day: np.ndarray, column: np.ndarray, weight: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct days, and the running totals of every column before each of them and after the last."""
    days, place = np.unique(day, return_inverse=True)
    small = np.abs(weight).sum() < 2**31
    total = np.zeros((len(days) + 1, width), np.int32 if small else np.int64)
    np.add.at(total, (place + 1, column), weight)
    return days, np.cumsum(total, axis=0, out=total)


def _counter(levels: Sequence[str], measures: Sequence[str], names: Sequence[str]) -> Callable:
    def count(requests: pa.Table, facts: pa.Table) -> pa.Table:
        """Measures of every request at every level, one list after the other."""
        held = Facts(facts)
        weight = np.stack([facts.column(m).cast(pa.int64()).fill_null(0).to_numpy()[held.order] for m in measures], axis=1)
        start, end = (_days(requests.column(b)) for b in BOUNDS)
        out = np.zeros((requests.num_rows, len(levels) * len(measures)), np.int64)
        for k, level in enumerate(levels):
            for wanted, asked in _selections(requests, level) if requests.num_rows else ():
                rows = held.rows(level, wanted)
                total = np.concatenate([np.zeros((1, len(measures)), np.int64), np.cumsum(weight[rows], axis=0)])
                low, high = (np.searchsorted(held.day[rows], b[asked]) for b in (start, end))
                out[asked, k * len(measures) : (k + 1) * len(measures)] = np.where((high > low)[:, None], total[high] - total[low], 0)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.int64()))
        return pa.table([requests.column(n) for n in names] + [lists], names=[*names, "counts"])

    return count


# Fields of a packed row after its key.
ROW = ("delays", "counts", "quantiles", "spread", "cohort_n")
ROW_KINDS = "delays array<double>, counts array<bigint>, quantiles array<double>, spread double, cohort_n bigint"


class Rows:
    """Packed rows under construction: sorted values with counts go in, columns with quantiles and spread come out."""

    def __init__(self, qs: Sequence[float]) -> None:
        self.qs = np.array(qs)
        self.lists: dict[str, list] = {name: [] for name in ROW}

    def add(self, v: np.ndarray, c: np.ndarray) -> None:
        run = c.cumsum()
        n = int(run[-1])
        place = self.qs * (n - 1)
        low, high = np.floor(place), np.ceil(place)
        a, b = (v[np.searchsorted(run, p.astype(np.int64), "right")] for p in (low, high))
        between = np.where(low == high, a, (high - place) * a + (place - low) * b)
        spread = float((v * c / n * ((2 * (run - c) + c - n) / n)).sum())
        for name, value in zip(ROW, (v, c, between, spread, n)):
            self.lists[name].append(value)

    def columns(self) -> list[pa.Array]:
        nested = lambda rows, kind: pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows) if rows else [], kind)
        )
        kinds = (pa.float64(), pa.int64(), pa.float64())
        return [nested(self.lists[n], k) for n, k in zip(ROW, kinds)] + [
            pa.array(self.lists["spread"], pa.float64()), pa.array(self.lists["cohort_n"], pa.int64()),
        ]


def _histogrammer(qs: Sequence[float]) -> Callable:
    keys = ("k_hash", "k_text", *BOUNDS)

    def collect(requests: pa.Table, facts: pa.Table) -> pa.Table:
        """Sorted delays and counts of every request that has any, with quantiles and spread."""
        held = Facts(facts)
        delay = facts.column("delay").cast(pa.float64()).to_numpy()[held.order]
        weight = facts.column("n").cast(pa.int64()).to_numpy()[held.order]
        start, end = (_days(requests.column(b)) for b in BOUNDS)
        level_of = np.array(requests.column("level").to_pylist(), object)
        parts: list[tuple] = []
        for level in dict.fromkeys(level_of):
            own = np.flatnonzero(level_of == level)
            for wanted, asked in _selections(requests.take(pa.array(own)), level):
                rows, asked = held.rows(level, wanted), own[asked]
                if not len(rows):
                    continue
                values, column = np.unique(delay[rows], return_inverse=True)
                days, total = _totals(held.day[rows], column, weight[rows], len(values))
                for at in range(0, len(asked), CHUNK):
                    some = asked[at : at + CHUNK]
                    low, high = (np.searchsorted(days, b[some]) for b in (start, end))
                    counts = total[np.maximum(low, high)].astype(np.int64) - total[low]
                    parts.append((some, values, counts))
        out, taken = Rows(qs), []
        for some, values, counts in parts:
            running = counts.cumsum(axis=1)
            for i in np.flatnonzero(running[:, -1] > 0):
                there = np.flatnonzero(counts[i])
                out.add(values[there], counts[i][there])
                taken.append(int(some[i]))
        found = requests.take(pa.array(taken, pa.int64()))
        return pa.table([found.column(k) for k in keys] + out.columns(), names=[*keys, *ROW])

    return collect


def rolled_up(daily: DataFrame, measures: Sequence[str], more: Sequence[str]) -> list[DataFrame]:
    """Facts of every family: the narrow ones as they are, the others added up from a narrower one."""
    add = [F.sum(m).cast("bigint").alias(m) for m in measures]
    narrow = daily.groupBy("carrier", "origin", "destination", "flight_date", "bucket", *more).agg(*add)
    route = narrow.groupBy("origin", "destination", "flight_date", *more).agg(*add)
    carrier = narrow.groupBy("carrier", "flight_date", "bucket", *more).agg(*add)
    return [narrow, route, carrier, carrier.groupBy("flight_date", *more).agg(*add)]


def _apply(requests: DataFrame, facts: DataFrame, places: Sequence[str], function: Callable, schema: str) -> DataFrame:
    keys = list(places) or ["_all"]
    if not places:
        requests, facts = requests.withColumn("_all", F.lit(0)), facts.withColumn("_all", F.lit(0))
    return requests.groupBy(*keys).cogroup(facts.groupBy(*keys)).applyInArrow(function, schema)


def _kinds(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def level_counts(heads: DataFrame, daily: DataFrame, levels: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """``heads`` (carrier, origin, destination, month, dow, bucket, bounds) plus ``c_<level>``: measures per level.

    Narrow levels are counted where the facts of a place are; broad ones once per distinct place and bounds,
    a small table that is written and then joined. A place without facts counts 0.
    """
    add = [F.sum(m).cast("bigint").alias(m) for m in measures]
    facts = rolled_up(daily, measures, ())
    out = heads
    for (places, members), rows in zip(FAMILIES, facts):
        asked = [level for level in members if level in levels]
        if not asked:
            continue
        narrow = len(places) == 3
        names = list(heads.columns) if narrow else [*places, *BOUNDS]
        requests = out if narrow else heads.select(*names).distinct()
        if not any(SELECTS[level] for level in asked):  # one row per place and day is enough
            rows = rows.groupBy(*places, "flight_date").agg(*add)
        counted = _apply(requests, rows, places, _counter(asked, measures, names), f"{_kinds(requests, names)}, counts array<bigint>")
        if narrow:
            out = counted
        else:
            small = materialize(counted)
            out = out.join(small, names, "left")
        zero = F.array(*[F.lit(0).cast("bigint")] * len(measures))
        slices = [F.coalesce(F.slice("counts", 1 + i * len(measures), len(measures)), zero).alias(f"c_{level}") for i, level in enumerate(asked)]
        out = out.select(*[c for c in out.columns if c != "counts"], *slices)
    return out


def histograms(requests: DataFrame, daily: DataFrame, levels: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """One row per distinct cohort (key and bounds) that has flights, written once.

    delays and counts (sorted), cohort_n, quantiles at ``qs`` and spread, half the mean difference of two draws.
    """
    wanted = requests.where(F.col("k_text").isNotNull()).select("k_hash", "k_text", *BOUNDS).distinct()
    parts = F.split("k_text", r"\|")
    named = wanted.withColumns({"level": parts[0], "_parts": parts})
    out = None
    for (places, members), rows in zip(FAMILIES, rolled_up(daily, ["n"], ("delay",))):
        asked = [level for level in members if level in levels]
        if not asked:
            continue
        own = named.where(F.col("level").isin(asked))
        selects = lambda name: F.coalesce(*[
            F.when(F.col("level") == level, F.get("_parts", F.lit(1 + len(places) + SELECTS[level].index(name)))) for level in asked if name in SELECTS[level]
        ], F.lit(None))
        columns = [F.get("_parts", F.lit(1 + i)).alias(p) for i, p in enumerate(places)]
        request = own.select(
            "k_hash", "k_text", *BOUNDS, "level", *columns, selects("month").try_cast("int").alias("month"),
            selects("dow").try_cast("int").alias("dow"), selects("bucket").cast("string").alias("bucket"),
        )
        schema = f"{_kinds(request, ('k_hash', 'k_text', *BOUNDS))}, {ROW_KINDS}"
        found = _apply(request, rows, places, _histogrammer(tuple(qs)), schema)
        out = found if out is None else out.unionByName(found)
    return materialize(out)


def unpacked(packed: DataFrame) -> DataFrame:
    """Key, bounds, delay and n: one row per distinct delay of a cohort."""
    pair = F.explode(F.arrays_zip("delays", "counts")).alias("_p")
    return packed.select("k_hash", "k_text", *BOUNDS, pair).select("k_hash", "k_text", *BOUNDS, F.col("_p.delays").alias("delay"), F.col("_p.counts").alias("n"))


def evaluate(
    selected: DataFrame, packed: DataFrame, names: Sequence[str], case_columns: Sequence[str],
    layover: Column | None = None, actual: Column | None = None, transfer: Transfer = Transfer(),
) -> DataFrame:
    """Per case: its cohort's quantiles (``names``, in the order of the packed ones), and if asked probability and CRPS.

    A case meets one row, the cohort; what depends on the case is a sum over that row's arrays. Cases whose
    cohort has no flights, or that were rejected, drop out.
    """
    met = selected.join(packed, ["k_hash", "k_text", *BOUNDS])
    size = F.col("cohort_n")
    over = lambda f: F.aggregate(F.zip_with("delays", "counts", lambda v, n: n * f(v)), F.lit(0.0), lambda a, x: a + x) / size
    out = [*case_columns, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)], "cohort_n"]
    if layover is not None:
        met = met.withColumn("_deadline", transfer.deadline(layover))
        out.append(over(lambda v: transfer.cdf(F.col("_deadline") - v)).alias("probability"))
    if actual is not None:
        met = met.withColumn("_actual", actual.cast("double"))
        out.append((over(lambda v: F.abs(v - F.col("_actual"))) - F.col("spread")).alias("crps"))
    return met.select(*out)
