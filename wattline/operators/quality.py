"""Filters, bounds checks, audits and column clean-up."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.measures import clip, finite_or_null, flag_to_str
from wattline.operators.ranks import percentiles
from wattline.reference_data import CRISIS_WINDOWS, DEMAND_BOUNDS, FEATURE_BAS, KNOWN_FLAGS, KNOWN_REALS, MONTHLY_CRISIS_WINDOWS
from wattline.reference_data import STATIC_REALS, VARIANT_REALS


def only_bas(df: DataFrame, bas: list[str] = FEATURE_BAS) -> DataFrame:
    return df.where(F.col("ba_code").isin(bas))


def between_half_open(df: DataFrame, start, end, c: str = "period") -> DataFrame:
    return df.where((F.col(c) >= F.lit(start).cast("timestamp")) & (F.col(c) < F.lit(end).cast("timestamp")))


def between_closed(df: DataFrame, start, end, c: str = "period") -> DataFrame:
    return df.where(F.col(c).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def crisis_windows(windows: list[tuple] = CRISIS_WINDOWS) -> Column:
    """The window catalogue as one array literal of (key, label, start, end, escalation)."""
    return F.array(
        *[
            F.struct(
                F.lit(key).alias("window"),
                F.lit(label).alias("label"),
                F.lit(start).cast("date").alias("start"),
                F.lit(end).cast("date").alias("end"),
                F.lit(escalation).cast("date").alias("escalation"),
            )
            for key, label, start, end, escalation in windows
        ]
    )


def windows_at(c: Column, windows: list[tuple] = CRISIS_WINDOWS) -> Column:
    """The windows a timestamp falls in. An array look-up per row, so no range join is needed."""
    midnight = c.cast("timestamp")
    return F.filter(
        crisis_windows(windows),
        lambda w: (midnight >= w["start"].cast("timestamp")) & (midnight <= w["end"].cast("timestamp")),
    )


def in_windows(df: DataFrame, windows: list[tuple] = CRISIS_WINDOWS, c: str = "period") -> DataFrame:
    """Rows inside any window, once per window they fall in, with the window's escalation day (NULL where it has none)."""
    return df.select("*", F.explode(windows_at(F.col(c), windows)).alias("_w")).select(
        *df.columns, "_w.window", "_w.label", "_w.escalation"
    )


def monthly_crisis_windows() -> Column:
    """The catalogue of the monthly views, with escalation days."""
    return crisis_windows(MONTHLY_CRISIS_WINDOWS)


# --- demand bounds ----------------------------------------------------------------------------------


def bound_of(bounds: dict[str, tuple[float, float]] = DEMAND_BOUNDS) -> tuple[Column, Column]:
    """Lowest and highest allowed value by ``ba_code`` as map look-ups."""
    lows, highs = [], []
    for code, (lo, hi) in bounds.items():
        lows += [F.lit(code), F.lit(float(lo))]
        highs += [F.lit(code), F.lit(float(hi))]
    return (
        F.try_element_at(F.create_map(*lows), F.col("ba_code")),
        F.try_element_at(F.create_map(*highs), F.col("ba_code")),
    )


def validate_bounds(
    df: DataFrame, bounds: dict[str, tuple[float, float]] = DEMAND_BOUNDS, c: str = "demand_mw"
) -> DataFrame:
    """Per known area: range found, values below and above the allowed range, and whether it passes."""
    lo, hi = bound_of(bounds)
    return (
        df.where(F.col(c).isNotNull() & F.col("ba_code").isin(list(bounds)))
        .groupBy("ba_code")
        .agg(
            F.min(c).alias("min_value"),
            F.max(c).alias("max_value"),
            F.count_if(F.col(c) < lo).alias("n_below"),
            F.count_if(F.col(c) > hi).alias("n_above"),
        )
        .withColumn("passed", (F.col("n_below") == 0) & (F.col("n_above") == 0))
    )


def null_out_of_bounds(
    df: DataFrame, bounds: dict[str, tuple[float, float]] = DEMAND_BOUNDS, c: str = "demand_mw"
) -> DataFrame:
    """Values outside the range of their area become NULL; areas without a range are left alone."""
    lo, hi = bound_of(bounds)
    bad = F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False))
    return df.withColumn(c, F.when(~bad, F.col(c)))


def cascade_null(df: DataFrame, when: str = "demand_mw", cols: Iterable[str] = ()) -> DataFrame:
    """Columns that were derived from ``when`` become NULL where it is NULL."""
    return df.withColumns({c: F.when(F.col(when).isNotNull(), F.col(c)) for c in cols})


# --- clean-up of the model frame ---------------------------------------------------------------


def drop_dead(df: DataFrame, cols: Iterable[str] = ("oil_price",)) -> DataFrame:
    return df.drop(*cols)


def positive_target(df: DataFrame, c: str = "demand_mw") -> DataFrame:
    return df.where(F.col(c) > 0)


def variant_columns(variant: str) -> list[str]:
    """Columns kept for model variant A, B or C, in order and without repeats."""
    cols = ["period", "time_idx", "demand_mw", "ba_code", *STATIC_REALS, *KNOWN_REALS, *KNOWN_FLAGS]
    return list(dict.fromkeys([*cols, *VARIANT_REALS[variant]]))


def select_variant(df: DataFrame, variant: str = "C") -> DataFrame:
    """The columns of a variant; one that is missing raises an error."""
    return df.select(*variant_columns(variant))


def clip_column(df: DataFrame, c: str = "renewable_pct", lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    return df.withColumn(c, clip(F.col(c), lo, hi))


def flags_to_str(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: flag_to_str(F.col(c)) for c in cols})


def inf_to_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: finite_or_null(F.col(c)) for c in cols})


# --- audits ----------------------------------------------------------------------------------------


def null_report(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """One row per column: NULL count and percentage, from one aggregation over the table."""
    by = by or []
    totals = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    )
    return totals.unpivot([*by, "_rows"], list(cols), "column", "n_null").select(
        *by, "column", "n_null", (F.col("n_null") * 100.0 / F.col("_rows")).alias("null_pct")
    )


def table_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Rows per table; -1 for a table that is absent."""
    out = None
    spark = next(df.sparkSession for df in tables.values() if df is not None)
    for name, df in tables.items():
        if df is None:
            row = spark.range(1).select(F.lit(name).alias("table_name"), F.lit(-1).cast("bigint").alias("n_rows"))
        else:
            row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def table_stats(df: DataFrame, key: str = "ba_code", time: str = "period") -> DataFrame:
    """Rows, distinct keys and time range of a table."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(key).alias("n_keys"),
        F.min(time).alias("first_period"),
        F.max(time).alias("last_period"),
    )


def demand_audit(df: DataFrame, p: float = 0.99, c: str = "demand_mw") -> DataFrame:
    """Per area the range, mean and exact continuous percentile of demand."""
    basic = df.groupBy("ba_code").agg(
        F.min(c).alias("min_value"), F.max(c).alias("max_value"), F.avg(c).alias("avg_value")
    )
    return basic.join(percentiles(df, ["ba_code"], c, {"p_value": p}, few_keys=True), "ba_code", "left")


def count_nulls(df: DataFrame, by: list[str], c: str = "demand_mw") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(c).isNull()).alias("n_null"),
        F.count_if(F.col(c) <= 0).alias("n_not_positive"),
    )


def volume_report(tables: dict[str, DataFrame], by: str) -> DataFrame:
    """Rows per table and key with subtotals per table and a grand total."""
    parts = None
    for name, df in tables.items():
        # counted per table before the union, so the rollup sees one row per key
        counts = df.groupBy(F.col(by).cast("string").alias("part")).agg(F.count(F.lit(1)).alias("n"))
        part = counts.select(F.lit(name).alias("table_name"), "part", "n")
        parts = part if parts is None else parts.unionByName(part)
    return parts.rollup("table_name", "part").agg(F.sum("n").alias("n_rows"))
