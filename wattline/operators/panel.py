"""Raw readings to wide hourly tables, and the complete hour grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.measures import ratio
from wattline.reference_data import FUEL_COLUMNS, REGION_TYPES


def pivot_demand(readings: DataFrame) -> DataFrame:
    """Long region readings to one row per (period, ba_code).

    One reading per (period, respondent, type) is expected; were there several, the largest is kept.
    """
    wide = readings.groupBy("period", F.col("respondent").alias("ba_code")).agg(
        *[F.max(F.when(F.col("type") == code, F.col("value"))).alias(name) for code, name in REGION_TYPES.items()]
    )
    return wide.withColumns(
        {
            "demand_forecast_gap": F.col("demand_mw") - F.col("forecast_mw"),
            "supply_demand_gap": F.col("generation_mw") - F.col("demand_mw"),
        }
    )


def pivot_fuel(readings: DataFrame) -> DataFrame:
    """Long fuel readings to megawatts per fuel, the total, and the gas and renewable percentages."""
    names = list(dict.fromkeys(FUEL_COLUMNS.values()))
    codes = {name: [code for code, n in FUEL_COLUMNS.items() if n == name] for name in names}
    wide = readings.groupBy("period", F.col("respondent").alias("ba_code")).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("fueltype").isin(codes[name]), F.col("value"))), F.lit(0.0)).alias(name)
            for name in names
        ]
    )
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    green = F.col("solar_mw") + F.col("wind_mw") + F.col("hydro_mw")
    return wide.withColumn("total_mw", total).withColumns(
        {
            "gas_pct": ratio(F.col("gas_mw") * 100, F.col("total_mw")),
            "renewable_pct": ratio(green * 100, F.col("total_mw")),
        }
    )


def hour_spine(entities: DataFrame, start: Column, end: Column, by: list[str] | None = None) -> DataFrame:
    """Every hour from ``start`` to ``end`` (both included) for every distinct entity.

    The hours are generated per entity row, so no cross join takes place. Days are generated first and
    spread over the cluster before they become hours.
    """
    by = by or ["ba_code"]
    days = F.sequence(F.date_trunc("day", start), F.date_trunc("day", end), F.expr("INTERVAL 1 DAY"))
    hours = F.sequence(F.col("_day"), F.col("_day") + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR"))
    return (
        entities.select(*by)
        .distinct()
        .select(*by, start.alias("_start"), end.alias("_end"))
        .select("*", F.explode(days).alias("_day"))
        .repartition(*by, "_day")
        .select("*", F.explode(hours).alias("period"))
        .where(F.col("period").between(F.col("_start"), F.col("_end")))
        .select("period", *by)
    )


def fill_hours(panel: DataFrame, start: Column | None = None, end: Column | None = None, target: str = "demand_mw") -> DataFrame:
    """Put the panel on the complete hour grid; ``is_interpolated`` marks hours without a ``target``."""
    if start is None:
        start = panel.agg(F.min("period")).scalar()
    if end is None:
        end = panel.agg(F.max("period")).scalar()
    grid = hour_spine(panel, start, end)
    return grid.join(panel, ["period", "ba_code"], "left").withColumn("is_interpolated", F.col(target).isNull())
