"""Window features of the hourly panel and of daily series."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wattline.functions.measures import ratio
from wattline.operators.sequences import over_rows as _over_rows

BY = ["ba_code"]
ORDER = "period"

# A spread below this is rounding noise of a constant window, not a spread.
FLAT = 1e-9


# Areas come from a fixed list of codes (65 at most), which bounds every per-area and per-day table.
over_rows = functools.partial(_over_rows, few_keys=True)


# --- column builders over an ordered window ------------------------------------------------------


def lag_cols(w: WindowSpec, c: str, ns: list[int], prefix: str | None = None) -> dict[str, Column]:
    prefix = prefix or f"{c}_lag"
    return {f"{prefix}_{n}h": F.lag(c, n).over(w) for n in ns}


def mean_over(w: WindowSpec, c: str, n: int) -> Column:
    """Mean of the last ``n`` rows, the current one included; shorter at the start of a key."""
    return F.avg(c).over(w.rowsBetween(-(n - 1), 0))


def std_over(w: WindowSpec, c: str, n: int) -> Column:
    """Sample standard deviation of the last ``n`` rows; NULL for a single row."""
    return F.stddev_samp(c).over(w.rowsBetween(-(n - 1), 0))


def change_over(w: WindowSpec, c: str, n: int) -> Column:
    return F.col(c) - F.lag(c, n).over(w)


def rel_change_over(w: WindowSpec, c: str, n: int) -> Column:
    return ratio(F.col(c) - F.lag(c, n).over(w), F.lag(c, n).over(w))


def spike_flag_over(w: WindowSpec, c: str, n: int = 24, k: float = 2.0) -> Column:
    """Value further than ``k`` spreads from its trailing mean, either side; FALSE without a spread."""
    sd = std_over(w, c, n)
    off = F.abs(F.col(c) - mean_over(w, c, n))
    return F.coalesce((off > k * sd) & (sd > FLAT), F.lit(False))


def spike_magnitude_over(w: WindowSpec, c: str, n: int = 24) -> Column:
    sd = std_over(w, c, n)
    return F.abs(F.col(c) - mean_over(w, c, n)) / F.when(sd > FLAT, sd)


# --- operators over the hourly panel -------------------------------------------------------------


def add_lags(df: DataFrame, c: str = "demand_mw", ns: tuple[int, ...] = (1, 24, 168)) -> DataFrame:
    """Values 1, 24 and 168 rows back. Rows, not hours: a missing hour shifts them."""
    return over_rows(df, BY, ORDER, lambda w: lag_cols(w, c, list(ns)), back=max(ns))


def add_hour_lags(df: DataFrame, c: str = "demand_mw", ns: tuple[int, ...] = (1, 24, 168)) -> DataFrame:
    """Time-correct variant: the value exactly ``n`` hours ago, NULL when that hour is missing."""
    out = df
    for n in ns:
        past = df.select(
            *BY, (F.col(ORDER) + F.expr(f"INTERVAL {int(n)} HOURS")).alias(ORDER), F.col(c).alias(f"{c}_lag_{n}h")
        )
        out = out.join(past, [*BY, ORDER], "left")
    return out


def roll_mean(df: DataFrame, c: str, n: int, name: str | None = None) -> DataFrame:
    name = name or f"{c}_mean_{n}"
    return over_rows(df, BY, ORDER, lambda w: {name: mean_over(w, c, n)}, back=n)


def roll_std(df: DataFrame, c: str, n: int, name: str | None = None) -> DataFrame:
    name = name or f"{c}_std_{n}"
    return over_rows(df, BY, ORDER, lambda w: {name: std_over(w, c, n)}, back=n)


def delta(df: DataFrame, c: str, n: int, name: str | None = None) -> DataFrame:
    name = name or f"{c}_delta_{n}"
    return over_rows(df, BY, ORDER, lambda w: {name: change_over(w, c, n)}, back=n)


def rel_change(df: DataFrame, c: str, n: int, name: str | None = None) -> DataFrame:
    name = name or f"{c}_change_{n}"
    return over_rows(df, BY, ORDER, lambda w: {name: rel_change_over(w, c, n)}, back=n)


def spikes(df: DataFrame, c: str = "demand_mw", n: int = 24, k: float = 2.0) -> DataFrame:
    return over_rows(
        df,
        BY,
        ORDER,
        lambda w: {"is_spike": spike_flag_over(w, c, n, k), "spike_magnitude": spike_magnitude_over(w, c, n)},
        back=n,
    )


def holiday_neighbours(df: DataFrame, c: str = "is_holiday", n: int = 24) -> DataFrame:
    """Flags of the row ``n`` ahead (pre-holiday) and ``n`` back (post-holiday), 0 beyond the ends."""
    return over_rows(
        df,
        BY,
        ORDER,
        lambda w: {
            "is_pre_holiday": F.coalesce(F.lead(F.col(c).cast("int"), n).over(w), F.lit(0)),
            "is_post_holiday": F.coalesce(F.lag(F.col(c).cast("int"), n).over(w), F.lit(0)),
        },
        back=n,
        ahead=n,
    )


def panel_window_columns(w: WindowSpec) -> dict[str, Column]:
    """All trailing features of the feature table over one window."""
    return {
        "gas_pct_delta_24h": change_over(w, "gas_pct", 24),
        "gas_price_change_7d": rel_change_over(w, "gas_price", 168),
        "gas_price_volatility_7d": std_over(w, "gas_price", 168),
        **{f"demand_lag_{n}h": F.lag("demand_mw", n).over(w) for n in (1, 24, 168)},
        "demand_rolling_24h": mean_over(w, "demand_mw", 24),
        "demand_rolling_168h": mean_over(w, "demand_mw", 168),
        "demand_std_24h": std_over(w, "demand_mw", 24),
        "is_spike": spike_flag_over(w, "demand_mw"),
        "spike_magnitude": spike_magnitude_over(w, "demand_mw"),
    }


PANEL_BACK = 168


def add_panel_windows(df: DataFrame, chunk_rows: int = 2048, plan: DataFrame | None = None) -> DataFrame:
    """The window stage of the feature build: one pass for every lag, mean, spread and spike column."""
    return over_rows(df, BY, ORDER, panel_window_columns, back=PANEL_BACK, chunk_rows=chunk_rows, plan=plan)


def halo_window(df: DataFrame, build, chunk: str = "month", halo: str = "7 days") -> DataFrame:
    """Calendar-chunk form: every row also joins the next chunk when it lies within ``halo`` of it.

    Equal to the whole-key window on gap-free hours. With missing hours a chunk start sees fewer rows
    than ``over_rows`` would give it, as in a build that runs month by month.
    """
    own = F.date_trunc(chunk, F.col(ORDER))
    last = F.date_trunc(chunk, F.col(ORDER) + F.expr(f"INTERVAL {halo}"))
    spread = df.withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.sequence(F.col("_own"), last, F.expr(f"INTERVAL 1 {chunk}")))
    )
    w = Window.partitionBy(*BY, "_chunk").orderBy(ORDER)
    return spread.withColumns(build(w)).where(F.col("_chunk") == F.col("_own")).drop("_own", "_chunk")


def time_index(df: DataFrame, order: str = ORDER) -> DataFrame:
    """Whole hours since the first period of the whole table."""
    first = df.agg(F.min(order)).scalar()
    hours = (F.unix_timestamp(order) - F.unix_timestamp(first)) / 3600
    return df.select("*", hours.cast("int").alias("time_idx"))


def latest_n(df: DataFrame, by: list[str], n: int, order: str = ORDER) -> DataFrame:
    """Last ``n`` rows of each key.

    Each slice gives its own last ``n`` rows first, so the final ranking of a key sees at most ``n`` rows
    per slice.
    """
    local = Window.partitionBy(*by, "_slice").orderBy(F.desc(order))
    final = Window.partitionBy(*by).orderBy(F.desc(order))
    return (
        df.withColumn("_slice", F.date_trunc("month", F.col(order)))
        .withColumn("_rn", F.row_number().over(local))
        .where(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(final))
        .where(F.col("_rn") <= n)
        .drop("_rn", "_slice")
    )


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by ``order``, where a missing value comes after any other.

    A minimum over structs combines map-side, so a key with very many copies costs one row per map task
    where a row-number window would sort them all in one.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    known = [x for c in [*order, *rest] for x in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))]
    first = F.min(F.struct(*known)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[f"_first.{c}" for c in [*order, *rest]]).select(*df.columns)


# --- daily series: at most 366 rows a year and key ---------------------------------------------


def trailing_z(
    df: DataFrame, cols: list[str], n: int, order: str, by: list[str] | None = None, min_n: int = 7, suffix: str = "z"
) -> DataFrame:
    """Distance from the mean of the ``n`` rows before, in their sample spreads.

    Needs ``min_n`` known values; a spread of zero counts as one; an undefined score becomes 0. Meant for
    daily tables, where a key has one row a day.
    """
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(-n, -1)
    scores = {}
    for c in cols:
        known = F.count(c).over(w) >= min_n
        sd = F.stddev_samp(c).over(w)
        sd = F.when(F.abs(sd) < 1e-12, F.lit(1.0)).otherwise(sd)
        scores[f"{c}_{suffix}"] = F.coalesce(F.when(known, (F.col(c) - F.avg(c).over(w)) / sd), F.lit(0.0))
    return df.withColumns(scores)


def roll_daily(
    daily: DataFrame, specs: list[tuple[str, str, int]], order: str, by: list[str] | None = None
) -> DataFrame:
    """Rolling aggregates of a daily table: (column, ``avg`` or ``sum``, days) triples."""
    kinds = {"avg": F.avg, "sum": F.sum}
    w = Window.partitionBy(*(by or [])).orderBy(order)
    return daily.withColumns(
        {f"{c}_{n}d_{kind}": kinds[kind](c).over(w.rowsBetween(-(n - 1), 0)) for c, kind, n in specs}
    )


def daily_change(daily: DataFrame, c: str, order: str, by: list[str] | None = None, name: str | None = None) -> DataFrame:
    """Day-over-day change, the shock form of a tone or price series."""
    w = Window.partitionBy(*(by or [])).orderBy(order)
    return daily.withColumn(name or f"{c}_delta", F.col(c) - F.lag(c, 1).over(w))
