"""Forecast error metrics as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattline.functions.measures import ratio
from wattline.reference_data import QUANTILE_COLUMNS, QUANTILES


def mape(actual: Column, predicted: Column) -> Column:
    """Mean absolute percentage error; rows with an actual of zero are left out."""
    return F.avg(F.abs(ratio(actual - predicted, actual))) * 100


def mape_floor(actual: Column, predicted: Column, floor: float = 1.0) -> Column:
    """Percentage error with the divisor held to at least ``floor``."""
    return F.avg(F.abs(actual - predicted) / F.when(actual.isNotNull(), F.greatest(actual, F.lit(float(floor))))) * 100


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg(F.pow(actual - predicted, 2)))


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def coverage(actual: Column, lower: Column, upper: Column) -> Column:
    """Percentage of actuals inside the interval, both ends included."""
    return F.avg(((actual >= lower) & (actual <= upper)).cast("double")) * 100


def pinball_at(actual: Column, predicted: Column, q: float) -> Column:
    """Pinball loss of one quantile forecast."""
    e = actual - predicted
    return F.when(e.isNotNull(), F.greatest(F.lit(q) * e, F.lit(q - 1) * e))


def quantile_weights(outer: float = 2.0, n: int = len(QUANTILES)) -> list[float]:
    """Outermost quantiles weigh ``outer``, the next ones half-way to 1, the rest 1."""
    steps = 2 if n >= 5 else 1  # how far from the outer ends the extra weight reaches

    def weight(place: int) -> float:
        from_end = min(place, n - 1 - place)
        return 1.0 + (outer - 1.0) * max(steps - from_end, 0) / steps

    return [weight(i) for i in range(n)]


def pinball_row(
    actual: Column,
    columns: list[str] | None = None,
    quantiles: list[float] | None = None,
    weights: list[float] | None = None,
) -> Column:
    """Mean pinball loss of one row over its quantile columns, optionally weighted by quantile."""
    columns = columns or QUANTILE_COLUMNS
    quantiles = quantiles or QUANTILES
    weights = weights or [1.0] * len(columns)
    total = F.lit(0.0)
    for name, q, w in zip(columns, quantiles, weights, strict=True):
        total = total + pinball_at(actual, F.col(name), q) * F.lit(w)
    return total / len(columns)


def direction_accuracy(actual: Column, predicted: Column) -> Column:
    """Share of rows where the forecast has the sign of the actual."""
    return F.avg((F.signum(actual) == F.signum(predicted)).cast("double"))
