"""Energy measures and clean-up rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """``num / den``; NULL instead of an error when the divisor is zero."""
    return num / F.nullif(den, F.lit(0).cast("double"))


def default0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def hdd(temp: Column, base: float = 18.0) -> Column:
    """Heating degrees below ``base``; a missing temperature counts as ``base``."""
    return F.greatest(F.lit(base) - F.coalesce(temp, F.lit(base)), F.lit(0.0))


def cdd(temp: Column, base: float = 18.0) -> Column:
    """Cooling degrees above ``base``; a missing temperature counts as ``base``."""
    return F.greatest(F.coalesce(temp, F.lit(base)) - F.lit(base), F.lit(0.0))


def supply_margin(generation: Column, demand: Column) -> Column:
    """(generation - demand) / demand, a ratio although the column is called a percentage."""
    return ratio(generation - demand, demand)


def geo_risk(severe: Column, events: Column, oil_events: Column, world_events: Column) -> Column:
    """Ten times each share, summed; any missing part makes the whole index 0."""
    term = ratio(severe.cast("double"), events.cast("double")) * 10
    oil = ratio(oil_events.cast("double"), world_events.cast("double")) * 10
    return F.coalesce(term + oil, F.lit(0.0))


def rate(part: Column, total: Column) -> Column:
    """Share of articles, with a total of zero read as one."""
    return part / F.when(total == 0, 1).otherwise(total)


def clip(c: Column, lo: float, hi: float) -> Column:
    """Value held to ``[lo, hi]``; NULL stays NULL (``least``/``greatest`` would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def flag_to_str(c: Column) -> Column:
    return c.cast("int").cast("string")


def finite_or_null(c: Column) -> Column:
    """NaN and both infinities to NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def crisis_weight(signals: list[Column], scale: float = 2.0) -> Column:
    """1 + scale x (largest absolute signal - 1, held to 0..4)."""
    sizes = [F.abs(s) for s in signals]
    largest = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    return F.lit(1.0) + F.lit(float(scale)) * F.coalesce(clip(largest - 1.0, 0.0, 4.0), F.lit(0.0))


def log1p_robust(window: Column) -> dict[str, Column]:
    """Centre (median) and scale (quartile distance) of log1p over one bounded history array."""
    logs = F.array_sort(F.transform(window, lambda x: F.log1p(x)))

    def at(q: float) -> Column:
        pos = (F.size(logs) - 1) * F.lit(q)
        lo = F.get(logs, F.floor(pos).cast("int"))
        hi = F.get(logs, F.ceil(pos).cast("int"))
        return lo + (hi - lo) * (pos - F.floor(pos))

    return {"centre": at(0.5), "scale": at(0.75) - at(0.25)}


def basis_points(p: Column) -> Column:
    """Probability to whole hundredths of a percent, cut off and not rounded."""
    return (p * 10000).cast("bigint")


def risk_class(score: Column, cuts: tuple[float, float, float] = (25.0, 50.0, 75.0)) -> Column:
    """LOW / MEDIUM / HIGH / CRITICAL by three rising cuts.

    The quarter points of a 0-100 score are this library's default; pass other cuts for other scores.
    """
    low, mid, high = cuts
    return (
        F.when(score >= high, "CRITICAL").when(score >= mid, "HIGH").when(score >= low, "MEDIUM").otherwise("LOW")
    )


def alert_level(median: Column, spike_prob: Column, threshold: Column, prob_cut: float = 0.7) -> Column:
    """RED when both the median and the spike probability are past their limits, YELLOW for one."""
    high = F.coalesce(median > threshold, F.lit(False))
    likely = F.coalesce(spike_prob > prob_cut, F.lit(False))
    return F.when(high & likely, "RED").when(high | likely, "YELLOW").otherwise("GREEN")


def family(name: Column, keywords: dict[str, list[str]]) -> Column:
    """First family one of whose parts occurs in the lower-cased name, else ``other``."""
    lowered = F.lower(name)
    out = None
    for label, parts in keywords.items():
        hit = F.lit(False)
        for part in parts:
            hit = hit | lowered.contains(part)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("other")


def has(arr: Column, x) -> Column:
    return F.array_contains(arr, x)


def json_share(shares: Column, key: str | Column) -> Column:
    """Share stored under ``key`` in a map, 0 when absent."""
    k = F.lit(key) if isinstance(key, str) else key
    return F.coalesce(F.try_element_at(shares, k), F.lit(0.0))


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in miles on a sphere of radius 3958.8 miles."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * 3958.8) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))
