"""Exact transfer-time probabilities: triangular distribution as expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Transfer:
    """Assumed passenger times in minutes. The defaults are fixed values."""

    minimum: float = 15.0
    mode: float = 25.0
    maximum: float = 40.0
    deplaning: float = 20.0
    cutoff: float = 15.0

    def __post_init__(self) -> None:
        if not 0 <= self.minimum <= self.mode <= self.maximum:
            raise ValueError("transfer minutes must satisfy 0 <= minimum <= mode <= maximum")
        if self.deplaning < 0 or self.cutoff < 0:
            raise ValueError("passenger times must not be negative")

    def deadline(self, layover: Column) -> Column:
        return layover.cast("double") - F.lit(self.deplaning + self.cutoff)

    def cdf(self, x: Column) -> Column:
        """P(transfer <= x); a step when minimum and maximum coincide."""
        a, m, b = self.minimum, self.mode, self.maximum
        if a == b:
            return F.when(x >= a, 1.0).otherwise(0.0)
        rise = F.when(x <= a, 0.0)
        if m > a:
            rise = rise.when(x <= m, (x - a) * (x - a) / F.lit((b - a) * (m - a)))
        if b > m:
            rise = rise.when(x < b, F.lit(1.0) - (F.lit(b) - x) * (F.lit(b) - x) / F.lit((b - a) * (b - m)))
        return rise.otherwise(1.0)

    def inverse(self, u: Column) -> Column:
        """Transfer minutes at probability u."""
        a, m, b = self.minimum, self.mode, self.maximum
        if a == b:
            return F.lit(float(a))
        split = (m - a) / (b - a)
        low = F.lit(a) + F.sqrt(u * F.lit((b - a) * (m - a)))
        high = F.lit(b) - F.sqrt((F.lit(1.0) - u) * F.lit((b - a) * (b - m)))
        return F.when(u < split, low).otherwise(high)

    def success(self, layover: Column, delay: Column) -> Column:
        """Chance to make the connection given one arrival delay."""
        return self.cdf(self.deadline(layover) - delay)


SCENARIO_DELAYS = (0, 15, 30, 45)


def scenario_columns(layover: Column, transfer: Transfer = Transfer()) -> list[Column]:
    names = ("on_time", "delay_15", "delay_30", "delay_45")
    return [
        transfer.success(layover, F.lit(float(d))).alias(name)
        for name, d in zip(names, SCENARIO_DELAYS)
    ]


def transfer_quantile_columns(transfer: Transfer = Transfer()) -> list[Column]:
    return [
        transfer.inverse(F.lit(q)).alias(f"transfer_p{round(q * 100)}") for q in (0.1, 0.5, 0.9)
    ]
