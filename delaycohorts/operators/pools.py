"""Cohorts whose upper part is taken from another cohort, one packed row per pair of cohorts.

A pool depends on its center and its source alone, so it is made once per distinct pair, however many cases
ask for it, and a case meets one row. Cut points are found on the running totals of the two packed rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaycohorts.operators import packed
from delaycohorts.operators.cohorts import BOUNDS, KEY
from delaycohorts.session import materialize

COHORT = (*KEY, *BOUNDS)


def midpoints(values: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Interpolated quantiles at (i + 0.5) / k for i = 0..k-1 of a sorted histogram, as values and counts.

    Points inside a run of equal values are counted, points between two runs are listed. Whole numbers
    have no bound here, so positions are exact at any size.
    """
    to = counts.cumsum().astype(object)
    first, last, m1 = to - counts.astype(object), to - 1, int(to[-1]) - 1
    if m1 == 0:
        return values[:1].astype(float), np.array([k], np.int64)
    at_or_after = lambda pos: np.maximum(0, -((m1 - 2 * k * pos) // (2 * m1)))
    low, high = at_or_after(first), np.minimum(k - 1, (2 * k * last - m1) // (2 * m1))
    inside = np.flatnonzero(high >= low)
    found, times = [values[inside].astype(float)], [(high - low + 1)[inside].astype(np.int64)]
    for r in range(len(values) - 1):
        listed = np.arange(max(int(high[r]) + 1, 0), min(int(low[r + 1]), k))
        if len(listed):
            share = float(m1) * (2 * listed + 1) / (2.0 * k) - float(last[r])
            found.append(values[r] + (values[r + 1] - values[r]) * share)
            times.append(np.ones(len(listed), np.int64))
    return np.concatenate(found), np.concatenate(times)


def pool(center: tuple, source: tuple, kc: int, ks: int) -> tuple[np.ndarray, np.ndarray]:
    """All but the ``kc`` largest values of the center, and ``kc`` midpoints of the ``ks`` largest of the source."""
    v, c = center
    kept = np.minimum(c, np.maximum(0, c.sum() - kc - (c.cumsum() - c)))
    w, d = source
    above = d[::-1].cumsum()[::-1] - d
    top = np.minimum(d, np.maximum(0, ks - above))
    added = midpoints(w[top > 0], top[top > 0], kc)
    values, where = np.unique(np.concatenate([v[kept > 0], added[0]]), return_inverse=True)
    counts = np.zeros(len(values), np.int64)
    np.add.at(counts, where, np.concatenate([kept[kept > 0], added[1]]))
    return values, counts


def _pooler(qs: Sequence[float]) -> Callable:
    def pools(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = packed.Rows(qs)
            lists = {n: batch.column(n) for n in ("c_delays", "c_counts", "s_delays", "s_counts")}
            flat = {n: (a.offsets.to_numpy(), a.values.to_numpy(zero_copy_only=False)) for n, a in lists.items()}
            row = lambda n, i: flat[n][1][flat[n][0][i] : flat[n][0][i + 1]]
            kc, ks = batch.column("kc").to_pylist(), batch.column("ks").to_pylist()
            for i in range(batch.num_rows):
                out.add(*pool((row("c_delays", i), row("c_counts", i)), (row("s_delays", i), row("s_counts", i)), kc[i], ks[i]))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in COHORT] + out.columns(), names=[*COHORT, *packed.ROW])

    return pools


def pool_key(center: Column, source: Column) -> list[Column]:
    """The key of a pool: both cohorts in the text, the bounds of the center."""
    text = F.concat_ws(
        "|", F.lit("pool"), center["k_text"], source["k_text"], source["hist_start"].cast("string"), source["hist_end"].cast("string"),
    )
    return [F.xxhash64(text).alias("k_hash"), text.alias("k_text"), center["hist_start"].alias("hist_start"), center["hist_end"].alias("hist_end")]


def pool_tails(
    asked: DataFrame, rows: DataFrame, qs: Sequence[float], fraction: float = 0.2,
) -> tuple[DataFrame, DataFrame]:
    """Which of the asked pools are used, and their packed rows.

    ``asked``: ``candidate``, structs ``center`` and ``source`` (key and bounds), ``min_center`` (null means no
    limit) and ``min_source``. A pool is used where the top ``fraction`` of the center has values, but fewer than
    ``min_center``, and that of the source at least ``min_source``. The first result holds ``candidate`` and the
    pool keys in use; where a pool is missing, the center stays as it is.
    """
    distinct = asked.where("center.k_text is not null and source.k_text is not null").distinct()
    size = lambda side, name: rows.select(
        *[F.col(c).alias(f"{side}_{c}") for c in COHORT], F.floor(F.col("cohort_n") * fraction).cast("bigint").alias(name)
    )
    flat = distinct.select(
        "candidate", "min_center", "min_source", *pool_key(F.col("center"), F.col("source")),
        *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("center", "source") for c in COHORT],
    )
    planned = flat.join(size("center", "kc"), [f"center_{c}" for c in COHORT]).join(size("source", "ks"), [f"source_{c}" for c in COHORT])
    used = materialize(planned.where(
        "kc > 0 and ks >= min_source and (min_center is null or kc < min_center)"
    ))
    pairs = used.drop("candidate", "min_center", "min_source").distinct()
    arrays = lambda side, short: rows.select(
        *[F.col(c).alias(f"{side}_{c}") for c in COHORT], F.col("delays").alias(f"{short}_delays"), F.col("counts").alias(f"{short}_counts")
    )
    met = pairs.join(arrays("center", "c"), [f"center_{c}" for c in COHORT]).join(arrays("source", "s"), [f"source_{c}" for c in COHORT])
    kinds = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in COHORT)
    made = met.select(*COHORT, "kc", "ks", "c_delays", "c_counts", "s_delays", "s_counts").mapInArrow(
        _pooler(tuple(qs)), f"{kinds}, {packed.ROW_KINDS}"
    )
    return used.select("candidate", *COHORT), materialize(made)
